"""Sources and sinks of items: requests, files, labelled folders, result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import routing

REQUEST = T.StructType([T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
ITEM = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("filename", T.StringType()),
        T.StructField("content_type", T.StringType()),
    ]
)
RESULT = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("expected", T.StringType()),
        T.StructField("predicted", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("human", T.BooleanType()),
        T.StructField("processing_time_ms", T.IntegerType()),
    ]
)


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON requests {url, text}, one a line, as items; a URL counts over a text. error: the request can't be used."""
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(REQUEST).option("mode", "PERMISSIVE").json(path)
    return requests_as_items(rows)


def requests_as_items(rows: DataFrame) -> DataFrame:
    url, text = routing.url_over_text(F.col("url"), F.col("text"))
    none = F.lit(None)
    out = rows.select(url.alias("url"), text.alias("text"), none.cast("binary").alias("data"), none.cast("string").alias("filename"))
    kind = routing.content_type(F.col("text"), F.col("filename"), F.col("url"), F.col("data"))
    return out.withColumn("content_type", kind).withColumn("error", routing.validation_error(F.col("text"), F.col("url")))


def uploads_as_items(rows: DataFrame, most_bytes: int = routing.MOST_FILE) -> DataFrame:
    """Uploaded parts (filename, mime, data) as items with an error column: the type by MIME, else by name; the bytes are never looked at for it."""
    by_mime = routing.type_of_mime(F.col("mime"))
    kind = F.when(by_mime != "unknown", by_mime).otherwise(routing.type_of_filename(F.col("filename")))
    none = F.lit(None).cast("string")
    out = rows.select(none.alias("url"), none.alias("text"), F.col("data").cast("binary").alias("data"), "filename", kind.alias("content_type"))
    return out.withColumn("error", routing.validation_error(F.col("text"), F.col("url"), F.col("data"), most_bytes))


def fetched_as_items(rows: DataFrame, content_type: str | None = None) -> DataFrame:
    """What has been fetched (url, status, body) as items with an error column. Other columns pass through.

    The type is the given one, or that of the URL. Bodies are cut to the limit of their type (FETCH_LIMITS) before anything reads them; those of texts become text (cut
    characters become replacement characters), others bytes. Anything but status 200, and no body, is an error. Nothing is fetched here.
    """
    kind = F.lit(content_type) if content_type else routing.type_of_url(F.col("url"))
    limit = F.element_at(F.create_map(*[F.lit(x) for item in routing.FETCH_LIMITS.items() for x in item]), F.col("content_type"))
    fine = F.coalesce(F.col("status") == 200, F.lit(False))
    own = [c for c in rows.columns if c not in ("text", "data", "filename", "content_type", "error", "body", "status")]
    out = rows.select(*own, "status", kind.alias("content_type"), F.col("body").cast("binary").alias("body"))
    cut = F.when(fine & (F.col("content_type") != "unknown"), F.substring(F.col("body"), F.lit(1), limit))
    error = (
        F.when(~fine, F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("unknown")))).when(F.col("content_type") == "unknown", "unsupported content type: unknown")
        .when(F.coalesce(F.octet_length("body"), F.lit(0)) == 0, "no content")
    )
    text = F.when(F.col("content_type") == "text", F.make_valid_utf8(cut.cast("string")))
    return out.select(*own, text.alias("text"), F.when(F.col("content_type") != "text", cut).alias("data"), F.lit(None).cast("string").alias("filename"), "content_type", error.alias("error"))


def read_files(spark: SparkSession, path: str, content_type: str | None = None) -> DataFrame:
    """Files as items, the type by name; empty files give no rows. content_type: only files with its extensions are listed and read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if content_type is not None:
        names = ",".join(e[1:] for e in routing.EXTENSIONS[content_type])
        reader = reader.option("pathGlobFilter", f"*.{{{names}}}")
    rows = reader.load(path).select(F.lit(None).cast("string").alias("url"), F.col("path"), "length", F.col("content").alias("data"))
    name = F.element_at(F.split("path", "/"), -1)
    out = rows.select("url", F.lit(None).cast("string").alias("text"), "data", name.alias("filename"), routing.type_of_filename(name).alias("content_type"), "length")
    return out.withColumn("error", F.when(F.col("length") > routing.MOST_FILE, "file too large"))


def files_as_text(items: DataFrame, most_bytes: int = routing.FETCH_LIMITS["text"]) -> DataFrame:
    """Text items with their bytes, cut to most_bytes, as text."""
    return items.where("content_type = 'text'").withColumn("text", F.expr(f"decode(substring(data, 1, {int(most_bytes)}), 'UTF-8')"))


def read_labelled_texts(spark: SparkSession, path: str, labels: Sequence[tuple[str, str]] = (("human", "human"), ("ai_generated", "ai"))) -> DataFrame:
    """filename, text, expected of the text files in one folder per label."""
    out = None
    for folder, label in labels:
        rows = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.txt").text(f"{path}/{folder}")
        part = rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"), F.col("value").alias("text"), F.lit(label).alias("expected"))
        out = part if out is None else out.unionAll(part)
    return out


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of an evaluation; genuine: the row has a confidence, so it isn't a refused request."""
    return spark.read.schema(RESULT).option("header", True).csv(path).withColumn("genuine", F.coalesce(F.col("confidence") > 0, F.lit(False)))


def write_results(rows: DataFrame, path: str) -> None:
    rows.select(*RESULT.names).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
