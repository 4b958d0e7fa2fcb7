"""Tables that cut lineage: bounds of broadcasts, and sweeping."""

import os

from pyspark.sql import functions as F

from helixlake.durable import delete, durable, fits, forget, fresh_path, join_checked, scratch


def broadcasts(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_broadcasts_are_bounded_by_rows_and_by_bytes(spark):
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.lit("ab"), F.lit(None)).alias("a"), F.create_map(F.lit(1), F.lit(2)).alias("m"))
    assert fits(rows) and not fits(rows, max_rows=99) and not fits(rows, max_bytes=90_000) and fits(rows.limit(0), 0, 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert broadcasts(join_checked(spark.range(1000), rows, "id", "inner"))
        assert not broadcasts(join_checked(spark.range(1000), rows, "id", "inner", max_bytes=1000))
        assert join_checked(spark.range(1000), rows, "id", "inner", max_rows=10).count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scratch_sweeps_what_was_made_within(spark):
    kept = durable(spark.range(3), "kept")
    with scratch(spark) as made:
        with scratch(spark):
            inner = durable(spark.range(3), "inner")
        assert not os.path.exists(inner.durable_path.removeprefix("file://"))
        outer = durable(spark.range(4), "outer")
        assert outer.count() == 4 and len(made) == 2
    assert not os.path.exists(outer.durable_path.removeprefix("file://"))
    assert kept.count() == 3
    forget(kept)
    delete(spark, fresh_path(spark, "never-made"))
    assert not os.path.exists(kept.durable_path.removeprefix("file://"))
