"""Reference and test files, the stream's gate and bound, and the job of checking a policy."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quorix.functions import features
from quorix.operators import index, jobs, search
from quorix.plans.queries import _payloads
from quorix.session import new_folder
from quorix.sources import fixtures, payload
from quorix.streaming import scorer

SF = "/root/testdata/sf0.001"


def test_references_are_numbered_over_files(spark, tmp_path):
    rows = [{"vector": [round((i * 37 + j * 11) % 10000 / 10000, 4) for j in range(14)], "label": "fraud" if i % 3 == 0 else "legit"} for i in range(700)]
    rows[5]["vector"][5] = -1
    (tmp_path / "a.json").write_text(json.dumps(rows[:100]))
    with gzip.open(tmp_path / "b.json.gz", "wt") as out:
        out.write(json.dumps(rows[100:650]))
    (tmp_path / "c.json").write_text(json.dumps(rows[650:]))
    got = {r.ref_id: r for r in payload.read_references(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(700))
    for i, row in enumerate(rows):
        assert [got[i][f"q{j}"] for j in range(14)] == [round(v * features.SCALE) for v in row["vector"]] and got[i].fraud == (i % 3 == 0)


def test_entries_of_a_test_file(spark, tmp_path):
    texts = [r.payload for r in _payloads(spark, SF).orderBy("request_id").limit(20).collect()]
    entries = [{"request": json.loads(t)} | ({"expected_approved": i % 2 == 0} if i % 5 else {}) for i, t in enumerate(texts)]
    (tmp_path / "test.json").write_text(json.dumps({"entries": entries}))
    got = payload.read_test_entries(spark, str(tmp_path / "test.json"))
    assert {r.entry_id: r.expected_approved for r in got.collect()} == {i: e.get("expected_approved") for i, e in enumerate(entries)}
    assert {r.entry_id for r in jobs.labelled(got).collect()} == {i for i in range(20) if i % 5}
    parsed = payload.parse_requests(got).orderBy("entry_id").select("amount", "mcc", "requested_at").collect()
    plain = payload.parse_requests(spark.createDataFrame(list(enumerate(texts)), "entry_id long, payload string")).orderBy("entry_id").select("amount", "mcc", "requested_at").collect()
    assert parsed == plain
    report = jobs.verify(got, fixtures.vectors(spark, SF)).first()
    assert report.entries == 20 and report.parse_fail == 0 and 0 <= report.approved_mismatch <= 16


def test_a_stream_waits_for_its_index_and_drops_what_is_too_long(spark):
    path, source, target, marks = (new_folder(spark, x) for x in ("index", "in", "out", "marks"))
    assert not scorer.ready(spark, path)
    with pytest.raises(ValueError):
        scorer.start_over_index(spark, source, target, marks, path)
    refs = fixtures.vectors(spark, SF).checkpoint()
    points, centroids = index.build(refs, iterations=1, spread=False)
    index.write(points, centroids, path)
    assert scorer.ready(spark, path)
    some = _payloads(spark, SF).where("request_id % 40 = 0")
    some.withColumn("payload", F.when(F.col("request_id") % 80 == 0, F.rpad("payload", scorer.MOST_BYTES + 1, " ")).otherwise(F.col("payload"))).write.parquet(source)
    scorer.start_over_index(spark, source, target, marks, path).awaitTermination()
    got = {r.request_id for r in spark.read.parquet(target).collect()}
    assert got == {r.request_id for r in some.collect() if r.request_id % 80} and got


def test_replay_goes_round(spark):
    entries = spark.createDataFrame([(7,), (3,), (9,)], "entry long")
    assert [r.entry_id for r in jobs.replay(entries, "entry", 8).orderBy("request_no").collect()] == [3, 7, 9, 3, 7, 9, 3, 7]
    assert search.bounded(7, search.SHORTLIST) == 7
