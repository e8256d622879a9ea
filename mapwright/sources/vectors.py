"""Vector tables: (entity_id, embedding, review_count), joined by key only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "entity_id string, embedding array<float>, review_count int"


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Read a vector table; missing columns and a broken contract are errors."""
    df = spark.read.parquet(path)
    missing = {"entity_id", "embedding"} - set(df.columns)
    if missing:
        raise ValueError(f"vector table lacks {sorted(missing)}")
    enforce(vector_contract(df).first())
    return df


def enforce(facts) -> None:
    """Refuse vectors of unequal size, repeated ids and missing vectors."""
    if facts["rows"] and (facts["min_size"] != facts["max_size"] or facts["duplicate_ids"] or facts["missing"]):
        raise ValueError(f"vector table breaks its contract: {facts.asDict()}")


def vector_contract(df: DataFrame) -> DataFrame:
    """One row of facts: sizes must agree, no id twice, no vector missing."""
    per_id = df.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"),
        F.count_if(F.col("embedding").isNull()).alias("no_vector"))
    return per_id.agg(
        F.sum("n").alias("rows"), F.min("lo").alias("min_size"), F.max("hi").alias("max_size"),
        F.sum(F.col("n") - 1).alias("duplicate_ids"), F.sum("no_vector").alias("missing"))


def write_vectors(df: DataFrame, path: str, model: str) -> None:
    """Write the vectors and, beside them, one row that says what they are; vectors that break the contract are refused."""
    df.write.mode("errorifexists").parquet(f"{path}/vectors")
    stored = df.sparkSession.read.parquet(f"{path}/vectors")
    facts = vector_contract(stored).withColumn("model", F.lit(model))
    enforce(facts.first())
    facts.write.mode("errorifexists").json(f"{path}/metadata")
