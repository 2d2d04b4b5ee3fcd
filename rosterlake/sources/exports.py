"""Reports in their fixed shapes, and tables in order with pages that need no global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.sources.tables import export

OPEN = ("open", "assigned")


def _named(rows: DataFrame, companies: DataFrame, ids: DataFrame | None) -> DataFrame:
    wanted = companies if ids is None else companies.join(ids.select("company_id").distinct(), "company_id", "left_semi")
    return rows.join(wanted.select("company_id", F.col("name").alias("canonical_name")), "company_id")


def monthly_series(stored: DataFrame, companies: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Months of the newest versions (stored has version_id; see `reading.latest_series`), by company name and month."""
    rows = _named(stored, companies, ids)
    return rows.select(
        "company_id", "canonical_name", "month", F.col("value_point").alias("estimated_headcount"), F.col("value_min").alias("estimated_headcount_min"), F.col("value_max").alias("estimated_headcount_max"),
        F.col("profiles").alias("public_profile_count"), "method", F.col("band").alias("confidence_band"), F.col("score").alias("confidence_score"), "needs_review", "suppression_reason",
        F.col("version_id").alias("estimate_version_id"),
    )


def anchors(rows: DataFrame, companies: DataFrame, sources: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Anchors with the source of their observation (observation_id, source_name, source_url) where there is one."""
    named = _named(rows, companies, ids)
    if sources is not None:
        named = named.drop("source_name", "source_url").join(sources.select("observation_id", "source_name", "source_url"), "observation_id", "left")
    elif "source_url" not in named.columns:
        named = named.withColumn("source_url", F.lit(None).cast("string"))
    return named.select("company_id", "canonical_name", "anchor_month", "anchor_type", "value_min", "value_point", "value_max", F.col("kind").alias("value_kind"), "confidence", "source_name", "source_url")


def review_queue(queue: DataFrame, companies: DataFrame, include_resolved: bool = False) -> DataFrame:
    """Items with their company's name; only open and assigned ones unless all are asked for."""
    rows = queue if include_resolved else queue.where(F.col("status").isin(*OPEN))
    return _named(rows, companies, None).select(
        F.col("item_id").alias("id"), "company_id", "canonical_name", F.col("reason").alias("review_reason"), "priority", "status", F.col("assignee").alias("assigned_to"),
        F.col("version_id").alias("estimate_version_id"), "detail", "updated_at",
    )


def growth_windows(windows: DataFrame, companies: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Growth windows (see `growth.growth_windows`, with version_id) of each company up to its newest month."""
    return _named(windows, companies, ids).select(
        "company_id", "canonical_name", F.col("horizon").alias("window"), "start_month", "end_month", "start_value", "end_value", (F.col("end_value") - F.col("start_value")).alias("absolute_delta"),
        F.col("growth_point").alias("percent_delta"), F.col("band").alias("confidence_band"), F.col("suppressed_reason").isNotNull().alias("suppressed"),
        F.col("suppressed_reason").alias("suppression_reason"), F.col("version_id").alias("estimate_version_id"),
    )


#: Reports by name, with the order of their rows.
SHAPES = {
    "monthly_series": (monthly_series, ["canonical_name", "company_id", "month"]),
    "anchors": (anchors, ["canonical_name", "company_id", "anchor_month"]),
    "review_queue": (review_queue, []),
    "growth_windows": (growth_windows, ["canonical_name", "company_id", "window"]),
}


def export_report(name: str, path: str, fmt: str, *tables: DataFrame, **options: object) -> DataFrame:
    """Write a report by its name as csv, json or parquet, in order; returns its rows.  ValueError for unknown names and formats."""
    if name not in SHAPES:
        raise ValueError(f"unknown report {name!r}; one of {sorted(SHAPES)}")
    shape, order = SHAPES[name]
    rows = shape(*tables, **options)
    sort = [F.desc("priority"), F.desc("updated_at"), "id"] if name == "review_queue" else order
    export(rows, path, fmt.lower(), sort)
    return rows


def write_ordered(rows: DataFrame, path: str, order: list[str], files: int) -> None:
    """Rows as Parquet files that follow each other in `order`, and an index of their first keys and places.

    Rows are range-partitioned and sorted within files, so no task sees more
    than its range; `order` should name a row (ties share a file).  The index
    has one row a file.
    """
    spark = rows.sparkSession
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{path}/rows")
    back = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    index = back.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first_key"), F.max(F.struct(*order)).alias("last_key"))
    # a row a file, so one task numbers them
    before = F.coalesce(F.sum("n").over(Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index.withColumn("start", before).write.parquet(f"{path}/index")


def read_page(spark: SparkSession, path: str, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit of an ordered table; reads only the files that hold them.  The limit is the feature."""
    hit = spark.read.parquet(f"{path}/index").where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)).select("file", "start").collect()
    if not hit:
        return spark.read.parquet(f"{path}/rows").limit(0)
    near = spark.read.parquet(*(r["file"] for r in hit))
    return near.orderBy(*order).offset(offset - min(r["start"] for r in hit)).limit(limit)


def read_after(spark: SparkSession, path: str, order: list[str], key: tuple, limit: int) -> DataFrame:
    """The next `limit` rows after a key (keyed paging): the first file that reaches beyond it, and as many more as the page needs."""
    kinds = spark.read.parquet(f"{path}/rows").schema
    after = F.struct(*(F.lit(v).cast(kinds[c].dataType).alias(c) for v, c in zip(key, order, strict=True)))
    index = spark.read.parquet(f"{path}/index").where(F.col("last_key") > after).orderBy("first_key")
    files, held = [], 0
    for r in index.select("file", "n").toLocalIterator():
        files.append(r["file"])
        # all but the first file lie beyond the key as a whole
        held += r["n"] if len(files) > 1 else 0
        if held >= limit:
            break
    rows = spark.read.parquet(*files) if files else spark.read.parquet(f"{path}/rows").limit(0)
    return rows.where(F.struct(*order) > after).orderBy(*order).limit(limit)
