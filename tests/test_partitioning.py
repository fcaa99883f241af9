"""Partitioning helpers: distributed running offsets, spread, materialize."""

from pyspark.sql import functions as F

from lensmap.operators.partitioning import broadcast_if_small, running_offsets, spread
from lensmap.session import materialize, release_materialized


def test_running_offsets_match_a_sequential_prefix_sum(spark):
    rows = [(f"f{i:04d}", (i * 7) % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "file string, n long").repartition(7)
    got = {r.file: r.offset for r in running_offsets(df, ["file"], "n").collect()}
    acc, exp = 0, {}
    for f, n in sorted(rows):
        exp[f] = acc
        acc += n
    assert got == exp


def test_spread_only_touches_few_partition_inputs(spark):
    one = spark.range(100, numPartitions=1)
    many = spark.range(100, numPartitions=16)
    assert spread(one).rdd.getNumPartitions() > 1
    assert spread(many) is many
    assert sorted(r.id for r in spread(one, barrier=True).collect()) == list(range(100))


def test_materialize_and_release(spark):
    df = materialize(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    assert df.agg(F.sum("x")).first()[0] == 90
    from urllib.parse import urlparse
    path = urlparse(df.inputFiles()[0].split("/part-")[0]).path
    assert release_materialized(spark, [path]) == 1


def test_broadcast_if_small(spark):
    small = spark.range(3)
    plan = small.join(broadcast_if_small(small, 8), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan
    big = spark.range(10)
    assert broadcast_if_small(big, 8, budget=16) is big          # over budget: untouched
