"""Reading, writing and merging tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions.expressions import lookup, month_floor, natural_id

_own: dict[str, str] = {}

EMPLOYMENT_CSV = "person_source_key string, source_name string, company_id string, company_domain string, start_month string, end_month string, is_current_role string, display_name string, job_title string, profile_url string, confidence string"
FORMATS = ("csv", "json", "parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`); only a local master may do without such a setting."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='rosterlake-')}")
    return where.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the folder that all executors share."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """`df` for joins that must not broadcast it, nor what is made of it by explodes, windows and aggregates.

    Spark takes a table for as large as its files: five million company-months
    are a few MB of Parquet and hundreds in the driver.
    """
    return df.hint("merge")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New snapshot of `old` after `new`, with an action for each row: inserted, refreshed, unchanged, kept.

    new must hold one row a key; plain Parquet has no MERGE, so this is a full
    join on the (null-safe) key and a new table.
    """
    values = [c for c in old.columns if c not in keys]
    on = None
    for k in keys:
        c = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = c if on is None else on & c
    both = old.withColumn("_o", F.lit(True)).alias("o").join(new.withColumn("_n", F.lit(True)).alias("n"), on, "full")
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    action = F.when(F.col("o._o").isNull(), "inserted").when(F.col("n._n").isNull(), "kept").when(differs, "refreshed").otherwise("unchanged")
    cells = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys] + [F.when(F.col("n._n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values]
    return both.select(*cells, action.alias("action"))


def validated(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that break one with `reject_reason`); rules: name -> SQL condition, a null counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules.items())))
    judged = df.withColumn("_broken", broken)
    return judged.where(F.size("_broken") == 0).drop("_broken"), judged.where(F.size("_broken") > 0).withColumn("reject_reason", F.array_join("_broken", ",")).drop("_broken")


ANCHOR_RULES = {"interval": "value_min <= value_point and value_point <= value_max", "exact": "kind <> 'exact' or (value_min = value_point and value_point = value_max)", "positive": "value_point >= 0", "confidence": "confidence between 0 and 1"}
EMPLOYMENT_RULES = {"order": "end_month is null or end_month >= start_month", "current": "not is_current or end_month is null"}


def read_seed(spark: SparkSession, path: str, aliases: dict[str, str]) -> DataFrame:
    """Candidate sheet as CSV: headers by alias, blank names left out, domains lower-cased."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.select(*(F.col(f"`{c}`").alias(aliases.get(c.strip().lower(), c.strip().lower())) for c in raw.columns))
    return named.where(F.trim("name") != "").withColumn("domain", F.nullif(F.lower(F.trim("domain")), F.lit("")))


def load_employment(raw: DataFrame, companies: DataFrame, existing: DataFrame, default_confidence: float = 0.55) -> dict[str, DataFrame]:
    """Employment rows (text columns) -> rows, rejected (with a reason) and counts by outcome.

    The company is found by id, else by domain; repeats of (person, company,
    start) keep the first by name and title, those already there are skipped.
    """
    by_id = companies.select(F.col("company_id").cast("string").alias("company_id"), F.col("company_id").alias("c1"))
    by_domain = companies.where("domain is not null").groupBy(F.col("domain").alias("company_domain")).agg(F.min("company_id").alias("c2"))
    start, end = F.try_to_date("start_month", "yyyy-MM-dd"), F.try_to_date("end_month", "yyyy-MM-dd")
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(default_confidence))))
    rows = raw.withColumn("company_domain", F.lower(F.trim("company_domain"))).join(by_id, "company_id", "left").join(by_domain, "company_domain", "left")
    rows = rows.select(F.col("person_source_key").alias("person_id"), F.coalesce("c1", "c2").alias("company_id"), month_floor(start).alias("start_month"), month_floor(end).alias("end_month"), F.lower("is_current_role").isin("true", "1", "yes").alias("is_current"), conf.alias("confidence"), "job_title")
    reason = F.when(F.coalesce(F.trim("person_id"), F.lit("")) == "", "no_person").when(F.col("company_id").isNull(), "no_company").when(F.col("start_month").isNull(), "no_start").when(F.col("end_month") < F.col("start_month"), "inverted")
    judged = rows.withColumn("reason", reason)
    key = ["person_id", "company_id", "start_month"]
    fine = judged.where("reason is null").groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("end_month", "is_current", "confidence", "job_title")).alias("r")).select(*key, "n", "r.*")
    new = fine.join(existing.select(*key), key, "left_anti")
    counts = judged.where("reason is not null").groupBy("reason").count().unionByName(new.agg(F.lit("loaded").alias("reason"), F.count("*").alias("count")))
    return {"rows": new.drop("n"), "rejected": judged.where("reason is not null"), "counts": counts}


def load_benchmarks(sheet: DataFrame, provider: str, metrics: dict[str, str], value, keys: list[str]) -> DataFrame:
    """A provider's wide sheet -> one row a metric with its parsed value and the month it is about.

    metrics: column -> metric; value: column -> struct(value_min, value_point,
    value_max, kind), such as functions.text.size_value.
    """
    from rosterlake.config import METRIC_OFFSET

    long = sheet.select(*keys, "as_of_month", *(F.col(c).cast("string").alias(m) for c, m in metrics.items())).unpivot([*keys, "as_of_month"], list(metrics.values()), "metric", "raw_value")
    growth = F.col("metric").startswith("growth")
    pct = F.regexp_replace("raw_value", "[%\\s]", "").try_cast("double")
    parsed = value("raw_value")
    out = long.where("raw_value is not null").withColumn("v", parsed).withColumn("pct", pct)
    shifted = F.add_months(month_floor("as_of_month"), lookup(METRIC_OFFSET, "metric", 0))
    cells = [F.when(growth, F.col("pct")).otherwise(F.col(f"v.{c}")).alias(c) for c in ("value_min", "value_point", "value_max")]
    return out.select(*keys, F.lit(provider).alias("provider"), "metric", shifted.alias("as_of_month"), *cells, F.when(growth, "exact").otherwise(F.col("v.kind")).alias("kind"), "raw_value")


def archive_merge(fetched: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Page archive, one row a (url, content): first and last seen, how often, first status.

    fetched: url, body, status, fetched_at.
    """
    new = fetched.withColumn("content_hash", F.sha2(F.coalesce("body", F.lit("")), 256)).groupBy("url", "content_hash").agg(F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_seen"), F.count("*").alias("seen_count"), F.min_by("status", "fetched_at").alias("status"), F.first("body").alias("body"))
    return new if stored is None else archive_union(stored.unionByName(new))


def archive_union(rows: DataFrame) -> DataFrame:
    """Archive rows of several merges as one archive, whatever their order."""
    return rows.groupBy("url", "content_hash").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"), F.min_by("status", "first_seen").alias("status"), F.first("body").alias("body"))


def new_signals(signals: DataFrame, stored: DataFrame) -> DataFrame:
    """Signals (company_id, source_name, url, text, ...) that are not stored yet; of those with one content hash the first by all columns."""
    key = ["company_id", "source_name", "content_hash"]
    rest = [c for c in signals.columns if c not in key]
    hashed = signals.withColumn("content_hash", natural_id("url", "text"))
    once = hashed.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_first")).select(*key, "_first.*")
    return once.join(stored.select(*key), key, "left_anti")


def export(df: DataFrame, path: str, fmt: str, order: list[str] | None = None) -> None:
    """Write a report as csv, json or parquet."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {FORMATS}")
    out = df.orderBy(*order) if order else df
    writer = out.write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else getattr(writer, fmt)(path)


def remap_companies(rows: DataFrame, theirs: DataFrame, ours: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows of another snapshot with our company ids: by (name, domain), else name, else alias; unmapped ones are left out."""
    pair = ours.groupBy("name", "domain").agg(F.min("company_id").alias("m1"))
    name = ours.groupBy("name").agg(F.min("company_id").alias("m2"))
    alias = aliases.groupBy(F.col("alias").alias("name")).agg(F.min("company_id").alias("m3"))
    known = theirs.select(F.col("company_id").alias("their_id"), "name", "domain").join(pair, ["name", "domain"], "left").join(name, "name", "left").join(alias, "name", "left")
    mapped = known.select("their_id", F.coalesce("m1", "m2", "m3").alias("our_id")).where("our_id is not null")
    return rows.join(mapped, rows["company_id"] == mapped["their_id"]).withColumn("company_id", F.col("our_id")).select(rows.columns)
