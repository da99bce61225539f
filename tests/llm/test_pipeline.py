"""The pipeline's stages, one after the other, against brute force."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_text_operators import DOCS, brute_components, brute_counts, brute_repeats, invented, words

from quorix.llm import common, decontaminate, rules


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    rows = invented(7, 200)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{top}/documents.parquet")
    item = " ".join(words(rows[11][1])[0:30] and [w.decode() for w in words(rows[11][1])[:30]])
    spark.createDataFrame([(0, item), (1, "no such words " * 9)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages(spark, documents):
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    plain = lambda df: [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]
    (_, good), (_, once), (_, cut), (_, clean), (_, mix) = corpus_pipeline.STAGES
    first = common.table(good(spark, docs, documents), "a")
    verdicts = {(r.doc_id, r.n_words) for r in rules.judge(docs).where("kept").collect()}
    assert {(r[0], brute_counts(r[1])[0]) for r in plain(first)} == verdicts
    second = common.table(once(spark, first, documents), "b")
    names = {eval(x)[2] for x in brute_components(plain(first))}  # noqa: S307
    assert {r[0] for r in plain(second)} == names | ({None} & {r[0] for r in plain(first)})
    third = common.table(cut(spark, second, documents), "c")
    lost = {eval(x)[0]: eval(x)[2] for x in brute_repeats(plain(second))}  # noqa: S307
    for r in plain(third):
        before = next(x for x in plain(second) if x[0] == r[0])
        assert len((before[1] or "").encode()) - len((r[1] or "").encode()) >= lost[r[0]] and r[4] == (len(r[1]) if r[1] is not None else None)
    fourth = common.table(clean(spark, third, documents), "d")
    hit = {r.doc_id for r in decontaminate.overlaps(third, spark.read.parquet(f"{documents}/benchmark.parquet")).collect()}
    assert {r[0] for r in plain(fourth)} == {r[0] for r in plain(third)} - hit
    last = mix(spark, fourth, documents)
    assert last.columns == [*docs.columns, "copies"]
    for df in (first, second, third, fourth):
        assert df.columns == docs.columns and [f.dataType for f in df.schema] == [f.dataType for f in docs.schema]
    run = corpus_pipeline.run(spark, documents)
    assert sorted(map(repr, run.collect())) == sorted(map(repr, last.collect()))
    assert run.where(F.col("copies") < 1).count() == 0
