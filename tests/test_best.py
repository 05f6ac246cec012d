"""The best rows of each group against a window over the whole table."""

import random

import pytest
from millrace.operators import best as B
from millrace.operators import repos
from pyspark.sql import Window
from pyspark.sql import functions as F


def by_window(df, by, order, k):
    return df.where(F.col(by).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def table(spark):
    """A group with two thirds of all rows, tied scores, nulls and NaN in group, score, tie and name."""
    rng = random.Random(4)
    data = [
        (rng.choice([0, 0, 0, 0, 1, 2, None]), rng.choice([None, float("nan"), 0.0, 1.5, 2.5, float(i % 40), float("inf")]), rng.choice([None, 1, 2, 3]), None if i == 7 else f"r{i}é", [i])
        for i in range(3000)
    ]
    return spark.createDataFrame(data, "bucket int, score double, tie int, repo_name string, files array<int>").repartition(7)


@pytest.mark.parametrize("k", [1, 3, 500, 5000])
def test_best_equal_the_window(spark, table, k):
    want = by_window(table, "bucket", [F.desc("score"), F.desc("tie"), F.col("repo_name")], k)
    got = repos.bucket_topk(table, k, F.col("tie"))
    assert got.schema.simpleString() == want.schema.simpleString() and rows(got) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_small_batches_and_other_orders(spark, table):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        for k in (1, 4):
            want = by_window(table, "tie", [F.col("score"), F.desc("repo_name")], k)
            assert rows(B.best(table, "tie", [("score", True), (F.col("repo_name"), False)], k, ways=2)) == rows(want)
            want = by_window(table, "bucket", [F.desc("score"), F.desc("tie"), F.col("repo_name")], k)
            assert rows(repos.bucket_topk(table, k, F.col("tie"))) == rows(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows(spark, table):
    assert repos.bucket_topk(table.where("false"), 3, F.lit(0)).count() == 0
    assert repos.bucket_topk(table.where("bucket is null"), 3, F.lit(0)).count() == 0
