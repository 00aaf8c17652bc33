from __future__ import annotations

from pyspark.sql import functions as F
from tabulon.operators.features import token_presence


def test_every_token_counts(spark):
    df = spark.range(600_000).select("id", F.array((F.col("id") % 300_000).cast("string")).alias("t"))
    assert token_presence(df, "id", "t").count() == 600_000
