"""Column expressions from a transaction to its fixed-point vector, bucket and decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scoring rule.
SCALE, SCALE8, SENTINEL = 10000, 127, -10000
K, DENY_AT = 5, 3
DIMS = tuple(range(14))
#: Dimensions 9, 10 and 11 are equal within a bucket.
STORED = (0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 13)
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
MCC_DEFAULT = 0.5
EXTREME_MCC = ("7801", "7802", "7995")


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def round4(x: Column) -> Column:
    """Half away from zero on the grid of 4 decimals."""
    return F.round(x * 10000.0) / 10000.0


def quantize16(x: Column) -> Column:
    return F.round(x * float(SCALE)).cast("int")


def quantize8(q: Column) -> Column:
    """From a 16-bit coordinate."""
    wide = F.round(q.cast("double") * float(SCALE8) / float(SCALE)).cast("int")
    return F.least(F.lit(SCALE8), F.greatest(F.lit(-SCALE8), wide))


def mcc_risk(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MCC_RISK.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(MCC_DEFAULT))


def is_iso(ts: Column) -> Column:
    mark = lambda i, c: F.substring(ts, i, 1) == c
    return F.coalesce(mark(5, "-") & mark(8, "-") & mark(11, "T"), F.lit(False))


def _number(ts: Column, at: int, n: int) -> Column:
    return F.coalesce(F.substring(ts, at, n).try_cast("int"), F.lit(0))


def epoch_seconds(ts: Column) -> Column:
    """Seconds from the digits at fixed places, whatever stands between them; null if they are no date."""
    digits = F.concat(F.substring(ts, 1, 4), F.lit("-"), F.substring(ts, 6, 2), F.lit("-"), F.substring(ts, 9, 2))
    day = F.unix_date(digits.try_cast("date")).cast("long")
    return day * 86400 + _number(ts, 12, 2) * 3600 + _number(ts, 15, 2) * 60 + _number(ts, 18, 2)


def hour_of(ts: Column) -> Column:
    """0 for text that is not ISO."""
    return F.when(is_iso(ts), _number(ts, 12, 2)).otherwise(0)


def weekday_of(ts: Column) -> Column:
    """Monday is 0; text that is not ISO counts as the first of January 2026."""
    return F.when(is_iso(ts), F.coalesce(F.weekday(F.substring(ts, 1, 10).try_cast("date")), F.lit(3))).otherwise(3)


def minutes_between(later: Column, earlier: Column) -> Column:
    return (epoch_seconds(later) - epoch_seconds(earlier)).cast("double") / 60.0


def is_unknown_merchant(known: Column, merchant: Column) -> Column:
    return ~F.coalesce(F.array_contains(known, merchant) & (merchant != ""), F.lit(False))


def vector(r: dict[str, Column]) -> list[Column]:
    """The 14 coordinates as doubles in [0, 1] or -1; r: the request's fields by name."""
    b = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    average = F.when(r["cust_avg"] != 0, r["cust_avg"]).otherwise(1e-9)
    minutes = F.coalesce(minutes_between(r["requested_at"], r["last_ts"]), F.lit(0.0))
    return [
        clamp01(r["amount"] / 10000.0), clamp01(r["installments"] / 12.0), clamp01(r["amount"] / average / 10.0),
        hour_of(r["requested_at"]) / 23.0, weekday_of(r["requested_at"]) / 6.0,
        F.when(r["has_last"], clamp01(minutes / 1440.0)).otherwise(-1.0), F.when(r["has_last"], clamp01(r["last_km"] / 1000.0)).otherwise(-1.0),
        clamp01(r["km_home"] / 1000.0), clamp01(r["tx_count_24h"] / 20.0), b(r["is_online"]), b(r["card_present"]), b(r["unknown_merchant"]),
        mcc_risk(r["mcc"]), clamp01(r["merch_avg"] / 10000.0),
    ]


def bucket_key(online: Column, card: Column, unknown: Column, has_last: Column) -> Column:
    bits = [F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate((online, card, unknown, has_last))]
    return bits[0] + bits[1] + bits[2] + bits[3]


def bucket_of_vector(q: list[Column]) -> Column:
    """The same key from quantized coordinates."""
    return bucket_key(q[9] == SCALE, q[10] == SCALE, q[11] == SCALE, q[5] != SENTINEL)


def bucket_gap(a: Column, b: Column) -> Column:
    """Squared distance that two buckets' constant coordinates add."""
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(7))).cast("long") * (SCALE * SCALE)


def is_extreme(bucket: Column, r: dict[str, Column]) -> Column:
    between = {"installments": (6, 10), "amount": (2000, 5000), "cust_avg": (110, 300), "tx_count_24h": (8, 15), "km_home": (180, 500), "last_km": (180, 600)}
    out = bucket.isin(13, 14) & r["has_last"] & (r["merch_avg"] <= 90) & r["mcc"].isin(*EXTREME_MCC)
    for name, (low, high) in between.items():
        out = out & r[name].between(low, high)
    return F.coalesce(out, F.lit(False))


def approved(frauds: Column) -> Column:
    return frauds < DENY_AT


def score(frauds: Column) -> Column:
    return frauds / float(K)
