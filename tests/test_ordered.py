"""Numbers and sums within keys against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinweave.operators import ordered

SCHEMA = "k string, l array<string>, x long, d double, at int"


def some(n, hot):
    rng = random.Random(n)
    return [(("hot" if rng.random() < hot else rng.choice(["a", "b", "", None])), [rng.choice("pq")] if rng.random() < 0.9 else None, rng.choice([None, rng.randrange(9)]), rng.random(), i) for i in range(n)]


@pytest.mark.parametrize(("n", "hot", "by", "parts"), [(400, 0.7, ["k"], 7), (300, 1.0, ["k"], 5), (200, 0.2, ["k", "l"], 4), (150, 0.5, [], 6), (3, 0.5, ["k"], 8)])
def test_sums_and_numbers(spark, n, hot, by, parts):
    rows = some(n, hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = ordered.sums_before(df, by, [F.desc("at")], {"sum": F.col("x"), "half": F.col("d")})
        assert got.columns == [*df.columns, "sum", "half"]
        got = {r.at: (r.sum, round(r.half, 9)) for r in got.collect()}
        numbers = {r.at: r.i for r in ordered.number_within(df, by, [F.desc("at")], "i").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, seen = {}, defaultdict(lambda: [0, 0.0, 0])
    for r in sorted(rows, key=lambda r: -r[4]):
        key = tuple(repr(r[SCHEMA.replace(",", "").split()[::2].index(b)]) for b in by)
        total = seen[key]
        want[r[4]] = (total[0], round(total[1], 9), total[2])
        seen[key] = [total[0] + (r[2] or 0), total[1] + r[3], total[2] + 1]
    assert {a: (*got[a], numbers[a]) for a in got} == want


def test_no_rows(spark):
    assert ordered.number_within(spark.createDataFrame([], SCHEMA), ["k"], [F.col("at")], "i").collect() == []
