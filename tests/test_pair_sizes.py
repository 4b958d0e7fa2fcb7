"""Results that grow with pairs: tasks by what they make, distances by inner products."""

import numpy as np
from pyspark.sql import functions as F

from helixlake.operators import jobs, metrics


def test_names_asked_for_often_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(jobs, "TASK_ROWS", 500)
    asked = spark.range(900).select(F.col("id").alias("request"), (F.col("id") % 3 == 0).cast("int").alias("user"), F.when(F.col("id") % 7 != 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("file_name"))
    asked = asked.unionByName(spark.createDataFrame([(901, None, "hot"), (902, 1, None)], "request long, user int, file_name string"))
    info = spark.range(40).select(F.col("id"), (F.col("id") % 2).cast("int").alias("user"), F.when(F.col("id") < 30, "hot").otherwise("7").alias("file_name"))
    got = jobs.metadata_of(asked, info).select("request", "id", "error")
    want = asked.join(info, ["user", "file_name"], "left").select("request", "id", F.when(F.col("id").isNull(), "no such file").alias("error"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0] < 3_500  # 11 000 rows of two names, 7 700 of one


def test_distances_by_products_equal_those_by_differences():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(50, 16)) + 1_000
    b = np.concatenate([a[:20], a[:20] + 1e-7, rng.normal(size=(30, 16)) * 1e3])
    want = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    np.testing.assert_allclose(metrics.squared_distances(a, b), want, rtol=1e-9, atol=0)
    with np.errstate(invalid="ignore"):
        assert np.isinf(metrics.squared_distances(np.array([[np.inf, 0.0]]), np.zeros((1, 2)))).all()
