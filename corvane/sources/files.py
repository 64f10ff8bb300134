"""File sources and sinks: JSON arrays and lines, feeds, captions, payloads, split publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import number_in_title


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def with_ordinal(df: DataFrame, name: str = "ord") -> DataFrame:
    """Input order as a column: rows of earlier files and splits come first."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON array of objects; a missing file is an empty table, broken JSON raises if strict."""
    if not _exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return with_ordinal(spark.createDataFrame([], schema))
    return with_ordinal(spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return with_ordinal(spark.read.schema(schema).json(path))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_requests(df: DataFrame, path: str, order: Column, body: list[str], prefix: str = "req", digits: int = 5) -> DataFrame:
    """JSON-lines batch requests and their manifest: every row gets a running id ``req-00000``.

    Numbers come from partition counts, not from one sorted partition.
    """
    from corvane.operators.aggs import dense_ids

    numbered = dense_ids(df, [order], "_n").withColumn("custom_id", F.format_string(f"{prefix}-%0{digits}d", F.col("_n"))).drop("_n")
    numbered.select(F.to_json(F.struct("custom_id", F.struct(*body).alias("body"))).alias("value")).write.mode("overwrite").text(path)
    return numbered.drop(*body)


def read_results(spark: SparkSession, path: str, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results joined to the manifest with their first reply, results of no known request)."""
    schema = "custom_id STRING, response STRUCT<body: STRUCT<choices: ARRAY<STRUCT<message: STRUCT<content: STRING>>>>>"
    rows = spark.read.schema(schema).json(path).select("custom_id", F.try_element_at("response.body.choices", F.lit(1))["message"]["content"].alias("reply"))
    return rows.join(manifest, "custom_id"), rows.join(manifest, "custom_id", "left_anti")


def completeness(results: DataFrame, manifest: DataFrame, group: str) -> DataFrame:
    """(group, expected, received, errors, status): a group is complete with all replies and no error."""
    want = manifest.groupBy(group).agg(F.count("*").alias("expected"))
    got = results.groupBy(group).agg(F.count_if(F.col("reply").isNotNull()).alias("received"), F.count_if(F.col("reply").isNull()).alias("errors"))
    out = want.join(got, group, "left").fillna(0, ["received", "errors"])
    return out.withColumn("status", F.when((F.col("errors") == 0) & (F.col("received") == F.col("expected")), "completed").otherwise("failed"))


def read_feed(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """Items of an RSS feed, one per number, newest first; a feed of fewer items than ``least`` is refused.

    A repeat ("reboot") never replaces an item of the same number; a later original does.
    """
    items = spark.read.format("xml").option("rowTag", "item").schema("title STRING, link STRING, pubDate STRING, description STRING").load(path)
    items = with_ordinal(items)
    if (n := items.count()) < least:
        raise ValueError(f"feed has {n} items, {least} expected")
    items = items.withColumn("episode_number", number_in_title("title", "link")).withColumn("date", feed_date("pubDate"))
    reboot = F.coalesce(F.lower("title").rlike("reboot"), F.lit(False))
    w = Window.partitionBy("episode_number").orderBy(reboot, F.when(reboot, F.col("ord")).otherwise(-F.col("ord")))
    once = items.where("episode_number is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.orderBy(F.col("episode_number").desc())


def feed_date(v: Column | str) -> Column:
    """ISO date of an RFC-2822 date, else the first ISO date in the text, else ''."""
    v = F.col(v) if isinstance(v, str) else v
    parts = F.regexp_extract(v, r"(\d{1,2} [A-Za-z]{3} \d{4})", 1)
    iso = F.regexp_extract(v, r"\d{4}(?:-\d\d){2}", 0)
    return F.coalesce(F.date_format(F.try_to_timestamp(parts, F.lit("d MMM yyyy")), "yyyy-MM-dd"), F.nullif(iso, F.lit("")), F.lit(""))


def payload_kind(name: Column | str, content: Column | str) -> Column:
    """Kind of a downloaded document: its extension, else its first bytes; null if unknown."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    head = F.hex(F.substring(content, 1, 4))
    return F.when(ext.isin("pdf", "docx", "doc", "vtt", "txt"), ext).when(head == "25504446", "pdf").when(head == "504B0304", "docx")


def publish_split(df: DataFrame, private: str, public: str, secret: str) -> None:
    """Full rows to the private place; the public one has the secret column's hash and length instead."""
    df.write.mode("overwrite").json(private)
    public_rows = df.withColumn(f"{secret}_sha256", F.sha2(F.col(secret), 256)).withColumn(f"{secret}_length", F.length(secret)).drop(secret)
    public_rows.write.mode("overwrite").json(public)


def guarded_write(df: DataFrame, path: str, outcome: DataFrame) -> None:
    """Write only if no new page failed and not every refresh did. ``outcome``: (is_new, ok)."""
    r = outcome.agg(F.count_if(F.col("is_new") & ~F.col("ok")).alias("new_failed"), F.count_if(~F.col("is_new")).alias("refreshed"), F.count_if(~F.col("is_new") & ~F.col("ok")).alias("failed")).first()
    if r.new_failed or (r.refreshed and r.failed == r.refreshed):
        raise RuntimeError(f"not published: {r.new_failed} new pages and {r.failed} of {r.refreshed} refreshed pages failed")
    df.write.mode("overwrite").json(path)


def read_cursor(df: DataFrame, key: str, since: int, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(rows after the cursor in order, one row with the new cursor)."""
    rows = df.where(F.col(key) > since).orderBy(key).limit(limit)
    return rows, rows.agg(F.coalesce(F.max(key), F.lit(since)).alias("cursor"))
