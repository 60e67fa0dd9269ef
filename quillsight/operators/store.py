"""The result store: scored items as an append-only Parquet table of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

JOBS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("human", T.BooleanType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("ai_score", T.DoubleType()),
        T.StructField("detectors", T.ArrayType(T.StringType())),
        T.StructField("content_hash", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def job_id(*parts: Column) -> Column:
    """24 hex characters, the same for the same parts in every run."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256), 1, 24)


def as_jobs(scored: DataFrame, key: str, content_type: str = "text") -> DataFrame:
    """Scored items (key, human, confidence, ai_score, content_hash) as rows of the table."""
    now = F.current_timestamp()
    detectors = F.col("detectors") if "detectors" in scored.columns else F.array(F.lit("local"))
    return scored.select(
        job_id(F.col(key), F.col("content_hash")).alias("id"), F.lit(content_type).alias("content_type"), "human", "confidence", "ai_score",
        detectors.alias("detectors"), "content_hash", now.alias("created_at"), now.alias("updated_at"),
    )


class JobStore:
    def __init__(self, spark: SparkSession, path: str):
        if not path:
            raise ValueError("a path is needed")
        self.spark, self.path = spark, path

    def create(self, jobs: DataFrame) -> None:
        """Append rows, clustered by id so that a lookup reads few row groups."""
        jobs.select(*JOBS.names).sortWithinPartitions("id").write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(JOBS).parquet(self.path)

    def get(self, *ids: str) -> DataFrame:
        """The rows with these ids; none if there are none. The filter is pushed to the scan."""
        return self.all().where(F.col("id").isin(*ids))

    def ping(self) -> bool:
        return True


def response(jobs: DataFrame, detailed: bool = False) -> DataFrame:
    """Rows as the API returns them; detailed adds detectors and score."""
    out = jobs.select("id", "human", "confidence", "content_type", "created_at", "detectors", "ai_score")
    return out.select("*", F.struct("detectors", "ai_score").alias("details")).drop("detectors", "ai_score") if detailed else out.drop("detectors", "ai_score")


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def error_row(code: Column, message: Column) -> Column:
    return F.when(code.isNotNull(), F.struct(message.alias("error"), code.alias("code")))
