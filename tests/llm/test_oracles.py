"""Every text operator with SQL against that SQL, and the licence scan over documents full of licences."""

import random

import duckdb
import pytest

from quorix.llm import licenses, queries

SF = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(repr([round(x, 6) if isinstance(x, float) else x for x in row]) for row in plain.values.tolist())


def told(name, folder):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF if t == 'pages' else folder}/{t}.parquet{'' if folder == SF or t == 'pages' else '/*.parquet'}'")
    return rows(con.execute(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == told(name, SF)


def licensed(seed, n):
    rng = random.Random(seed)
    sentences = [t for _, t in licenses.TEMPLATES] + ["The licence of this song is unclear.", "Our driving license office is open!", "SPDX or not"]
    out = []
    for i in range(n):
        kind = rng.random()
        plain = lambda k: " ".join(f"w{rng.randint(0, 60)}" for _ in range(k))
        if kind < 0.08:
            text = rng.choice(licenses.full_texts())[1].replace("<year>", str(2000 + i))
        elif kind < 0.3:
            text = rng.choice(sentences)
        elif kind < 0.6:
            text = rng.choice([". ", "! \n", ".\n\t", "\n", "?\t", " "]).join([plain(8), rng.choice(sentences), plain(rng.randint(0, 9)), rng.choice(sentences), plain(30)])
        else:
            text = rng.choice(["", None, plain(20)])
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "LICENSE", None]), 0))
    return out


def test_licences_equal_sql(spark, tmp_path):
    spark.createDataFrame(licensed(5, 400), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(licenses.query(spark, str(tmp_path)).toPandas())
    assert got == told("op7_license_scan", str(tmp_path))
    assert len({x for x in got[1] if "'a/" in x}) > 50
