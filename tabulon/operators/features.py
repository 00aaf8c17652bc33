"""Feature vectors from token arrays and numeric columns, with Spark ML stages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a token counts from this many rows on.
MIN_ROWS = 2


def vocabulary(df: DataFrame, tokens: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """(token, row_count) of the tokens that occur in at least min_rows rows."""
    return (
        df.select(F.explode(F.array_distinct(tokens)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .where(F.col("row_count") >= min_rows)
    )


def token_presence(df: DataFrame, id_column: str, tokens: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """(id, token) for each vocabulary token a row holds: the multi-hot vector in long form."""
    present = df.select(id_column, F.explode(F.array_distinct(tokens)).alias("token"))
    known = vocabulary(df, tokens, min_rows).select("token")
    return present.join(known, "token").select(id_column, "token")


def with_log_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds log_<column> = ln(1 + column)."""
    return df.withColumns({f"log_{c}": F.log1p(F.col(c)) for c in columns})


def vocabulary_list(df: DataFrame, tokens: str, min_rows: int = MIN_ROWS) -> list[str]:
    """The whole vocabulary, most frequent token first, ties by token.

    It is the dimension of the model, whose centers the driver holds anyway, so it has to fit there. The fixed
    order makes vector positions independent of how the input is partitioned.
    """
    ordered = vocabulary(df, tokens, min_rows).orderBy(F.desc("row_count"), "token")
    return [row["token"] for row in ordered.collect()]


def fit_scaler(df: DataFrame, numerics: Sequence[str]) -> PipelineModel:
    """Numeric columns as one vector column num_raw, scaled to [0, 1] as num_scaled.

    A constant column becomes 0.5; a null raises when the vectors are built.
    """
    assembler = VectorAssembler(inputCols=list(numerics), outputCol="num_raw", handleInvalid="error")
    scaler = MinMaxScaler(inputCol="num_raw", outputCol="num_scaled").fit(assembler.transform(df))
    return PipelineModel([assembler, scaler])


def min_max_scaled(df: DataFrame, id_column: str, numerics: Sequence[str]) -> DataFrame:
    """The id and the scaled numeric columns under their own names."""
    scaled = fit_scaler(df, numerics).transform(df).withColumn("_s", vector_to_array("num_scaled"))
    return scaled.select(id_column, *[F.col("_s")[i].alias(c) for i, c in enumerate(numerics)])


@dataclass(frozen=True)
class FeatureModel:
    """Fitted stages and the meaning of each position of the feature vector."""

    stages: PipelineModel
    names: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with the vector column features; what the stages make on the way is left out."""
        return self.stages.transform(df).select(*[F.col(f"`{c}`") for c in df.columns if c != "features"], "features")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the fitted stages and the names below the path, replacing what is there."""
        self.stages.write().overwrite().save(f"{path}/stages")
        rows = list(enumerate(self.names))
        spark.createDataFrame(rows, "position int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        names = spark.read.parquet(f"{path}/names").orderBy("position").collect()
        return cls(PipelineModel.load(f"{path}/stages"), tuple(r["name"] for r in names))


def fit_features(
    df: DataFrame, tokens: str, numerics: Sequence[str], min_rows: int = MIN_ROWS
) -> FeatureModel:
    """Model that adds the vector column features: scaled numerics, then one 0/1 entry per token."""
    words = vocabulary_list(df, tokens, min_rows)
    if not words:
        raise ValueError(f"no token of column {tokens!r} occurs in {min_rows} rows")
    multi_hot = CountVectorizerModel.from_vocabulary(words, inputCol=tokens, outputCol="token_vec")
    multi_hot.setBinary(True)
    scaler = fit_scaler(df, numerics)
    final = VectorAssembler(
        inputCols=["num_scaled", "token_vec"], outputCol="features", handleInvalid="error"
    )
    return FeatureModel(PipelineModel([multi_hot, *scaler.stages, final]), (*numerics, *words))


def features_long(df: DataFrame, id_column: str, model: FeatureModel) -> DataFrame:
    """(id, dim, value) of the non-zero entries of each feature vector, dim being the position's name.

    A sparse vector is read from its stored entries, so the cost follows the tokens a row has and not the
    size of the vocabulary.
    """
    spark = df.sparkSession
    names = spark.createDataFrame(list(enumerate(model.names)), "position int, dim string")
    stored = F.unwrap_udt("features")
    positions = F.coalesce(
        stored["indices"], F.sequence(F.lit(0), F.size(stored["values"]) - 1)
    )
    entries = F.arrays_zip(positions.alias("position"), stored["values"].alias("value"))
    return (
        model.transform(df)
        .select(id_column, F.inline(entries))
        .where(F.col("value") != 0.0)
        .join(names, "position")
        .select(id_column, "dim", "value")
    )
