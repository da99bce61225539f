"""Golden feature rows, half points, edges of the parser and scores."""

import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from quorix.functions import features
from quorix.operators import metrics
from quorix.sources import fixtures, payload


def body(amount, inst, at, avg, tx, known, merchant, mcc, merch, online, card, km, last):
    return {
        "id": "x", "transaction": {"amount": amount, "installments": inst, "requested_at": at}, "customer": {"avg_amount": avg, "tx_count_24h": tx, "known_merchants": known},
        "merchant": {"id": merchant, "mcc": mcc, "avg_amount": merch}, "terminal": {"is_online": online, "card_present": card, "km_from_home": km},
        "last_transaction": {"timestamp": last[0], "km_from_current": last[1]} if last else None,
    }


T = "2026-03-11T20:23:35Z"
GOLDEN = [
    (body(50, 1, T, 0, 3, [], "m", "0000", 60, True, False, 0, None), [50, 833, 10000, 8696, 3333, -10000, -10000, 0, 1500, 10000, 0, 10000, 5000, 60], 5),
    (body(50, 1, T, 100, 3, ["m"], "m", "5411", 60, False, True, 1.5, ("2026-03-12T20:23:35Z", 5)), [50, 833, 500, 8696, 3333, 0, 50, 15, 1500, 0, 10000, 0, 1500, 60], 10),
    (body(50, 1, T, 100, 3, ["m"], "m", "5411", 60, False, True, 1.5, ("2026-03-09T20:23:35Z", 5)), [50, 833, 500, 8696, 3333, 10000, 50, 15, 1500, 0, 10000, 0, 1500, 60], 10),
    (body(50, 1, "2026/03/11 20:23:35", 100, 3, ["m"], "m", "5411", 60, False, True, 1.5, ("2026/03/11 19:23:35", 5)), [50, 833, 500, 0, 5000, 417, 50, 15, 1500, 0, 10000, 0, 1500, 60], 10),
    (body(3000, 8, "2026-03-14T03:00:00Z", 200, 10, [], "m", "7995", 50, True, False, 300, ("2026-03-14T02:00:00Z", 400)), [3000, 6667, 10000, 1304, 8333, 417, 4000, 3000, 5000, 10000, 0, 10000, 8500, 50], 13),
    (body(20000, 24, "2026-03-15T23:59:59Z", 100, 40, ["m"], "m", "7801", 20000, True, True, 5000, ("2026-03-15T23:59:59Z", 5000)), [10000, 10000, 10000, 10000, 10000, 0, 10000, 10000, 10000, 10000, 10000, 0, 8000, 10000], 11),
    (body(0, 0, "2026-03-16T00:00:00Z", 0, 0, [], "m", "", 0, False, False, 0, None), [0, 0, 0, 0, 0, -10000, -10000, 0, 0, 0, 0, 10000, 5000, 0], 4),
]


def vectors(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "request_id long, payload string")
    return fixtures.to_vectors(payload.parse_requests(rows)).orderBy("request_id").collect()


def test_golden_rows(spark):
    got = vectors(spark, [json.dumps(b) for b, _, _ in GOLDEN])
    for row, (_, q, bucket) in zip(got, GOLDEN, strict=True):
        assert [row[f"q{i}"] for i in range(14)] == q
        assert row["bucket"] == bucket and not row["malformed"]


def test_extreme_profile(spark):
    rows = spark.createDataFrame(list(enumerate(json.dumps(b) for b, _, _ in GOLDEN)), "request_id long, payload string")
    v = fixtures.to_vectors(payload.parse_requests(rows))
    got = v.select("request_id", features.is_extreme(F.col("bucket"), {c: F.col(c) for c in v.columns}).alias("x")).orderBy("request_id").collect()
    assert [r.x for r in got] == [False, False, False, False, True, False, False]


def test_malformed_and_lenient_payloads(spark):
    whole, _, _ = GOLDEN[1]
    without = [json.dumps({k: v for k, v in whole.items() if k != s}) for s in payload.SECTIONS]
    odd = json.loads(json.dumps(whole))
    odd["transaction"]["installments"], odd["transaction"]["amount"] = 3.7, "50"
    empty_last = dict(whole, last_transaction={})
    long_id = json.loads(json.dumps(whole))
    long_id["merchant"]["id"], long_id["customer"]["known_merchants"] = "m" * 40, ["m" * 40]
    got = vectors(spark, ["", "junk", json.dumps(whole)[:60], None, *without, json.dumps(odd), json.dumps(empty_last), json.dumps(long_id), json.dumps(whole).replace("50,", "NaN,", 1)])
    assert [r["malformed"] for r in got[:8]] == [True] * 8
    assert got[8]["installments"] == 3 and got[8]["amount"] == 0.0
    assert got[9]["has_last"] and got[9]["q5"] == 0 and got[9]["q6"] == 0
    assert got[10]["unknown_merchant"]
    assert got[11]["amount"] == 0.0


def test_rounding_is_half_away_from_zero(spark):
    values = [i / 20000 for i in range(20001)] + [0.00005, 0.12345, -1.0, 0.99995]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for r in df.select("v", features.quantize16(F.col("v")).alias("q")).collect():
        x = r.v * 10000
        assert r.q == int(math.copysign(math.floor(abs(x) + 0.5), x)) or abs(abs(x) % 1 - 0.5) < 1e-9


def test_coarse_quantizer_is_odd_and_bounded(spark):
    df = spark.range(-10000, 10001, 250).select(F.col("id").cast("int").alias("q"))
    got = {r.q: r.e for r in df.select("q", features.quantize8(F.col("q")).alias("e")).collect()}
    assert got[10000] == 127 and got[-10000] == -127 and got[0] == 0
    assert all(got[-q] == -e for q, e in got.items() if -q in got)


def test_bucket_gap(spark):
    df = spark.createDataFrame([(0, 7), (0, 8), (5, 5), (15, 9)], "a int, b int")
    assert [r.g for r in df.select(features.bucket_gap(F.col("a"), F.col("b")).alias("g")).collect()] == [3 * 10**8, 0, 0, 2 * 10**8]


@pytest.mark.parametrize(("p99", "score"), [(0.5, 3000.0), (1.0, 3000.0), (10.0, 2000.0), (2001.0, -3000.0), (0.0, 0.0)])
def test_p99_score(spark, p99, score):
    got = spark.range(1).select(metrics.p99_score(F.lit(p99)).alias("s")).first().s
    assert got == pytest.approx(score)


def test_detection_score(spark):
    f = lambda failures, n, e: spark.range(1).select(metrics.detection_score(F.lit(failures), F.lit(n), F.lit(e / n), F.lit(e)).alias("s")).first().s
    assert f(0, 1000, 0) == pytest.approx(3000.0)
    assert f(151, 1000, 151) == -3000.0
    assert f(150, 1000, 150) == pytest.approx(1000 * math.log10(1000 / 150) - 300 * math.log10(151))


def test_rank_percentiles_use_floor_places(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    r = metrics.rank_percentiles(df, "v").first()
    assert (r.n, r.p50, r.p90, r.p99, r.p99_9, r.max) == (1000, 501.0, 901.0, 991.0, 1000.0, 1000.0)
    assert metrics.interpolated_percentiles(df, "v", (0.99,)).first().p99 == pytest.approx(990.01)


def test_average_of_a_customer_adds_in_order_of_time(spark, tmp_path):
    """Added in this order the average lies half-way between two cents or above, added backwards just below."""
    values = [45.9, 3.74, 23.5, 18.37, 58.28, 85.38, 79.25, 79.12]
    rows = [(i, datetime.datetime(2024, 1, 1, 0, i), 1, "view", v, '{"k": 1}') for i, v in enumerate(values)]
    events = spark.createDataFrame(rows[::-1], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    r = fixtures.requests(spark, str(tmp_path))
    # Alone, and beside columns whose windows are sorted.
    assert {x.cust_avg for x in r.select("cust_avg").collect()} == {491.93}
    assert {x.cust_avg for x in fixtures.to_vectors(r).collect()} == {491.93}
