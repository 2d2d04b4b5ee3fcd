"""Domain tables derived from the star-schema tables (lineitem, orders, supplier, part, pages).

Every expression is one that DuckDB evaluates alike, see `oracle.BASE`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.config import Window

WINDOW = Window("1995-01-01", "2001-11-01", "2001-11-01")
NOW = "2001-11-15 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_id() -> Column:
    """Of a lineitem row: (l_orderkey, l_linenumber) is not unique, so all columns count."""
    cents = lambda c: F.round(F.col(c) * 100).cast("int")
    parts = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd")]
    return F.md5(F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("id", row_id()).withColumn("ship_month", F.trunc("l_shipdate", "month"))


def by_flag(a: Column | str, n: Column | str, r: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(F.col("l_returnflag") == "A", lit(a)).when(F.col("l_returnflag") == "N", lit(n)).otherwise(lit(r))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.concat(F.lit("P"), (F.col("s_nationkey") % 3).cast("string"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("name"), tier.alias("tier"))


def employment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with l_suppkey % 4 = 0 have none, so that interpolation is used too."""
    part = lines(spark, sf_dir).where("l_suppkey % 4 <> 0").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    end = F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.col("ship_month"))
    rows = part.select(F.col("l_suppkey").alias("company_id"), F.col("o_custkey").alias("person_id"), F.trunc("o_orderdate", "month").alias("start_month"), end.alias("end_month"), "l_linestatus")
    return rows.withColumn("is_current", F.col("end_month").isNull() & (F.col("l_linestatus") == "O")).drop("l_linestatus")


def _interval() -> list[Column]:
    point = F.col("l_quantity") * 10
    exact = F.col("l_returnflag") == "A"
    return [
        F.when(exact, point).otherwise(point * (1 - F.col("l_discount"))).alias("value_min"),
        point.alias("value_point"),
        F.when(exact, point).otherwise(point * (1 + F.col("l_tax"))).alias("value_max"),
    ]


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_quantity") >= 48, "manual_anchor").when(F.col("l_linestatus") == "F", "historical_statement").otherwise("current_headcount_anchor")
    rows = lines(spark, sf_dir).where("l_linenumber = 1")
    return rows.select(
        F.col("l_suppkey").alias("company_id"), F.col("id").alias("anchor_id"), F.col("ship_month").alias("anchor_month"), *_interval(),
        by_flag("exact", "range", "bucket").alias("kind"), kind.alias("anchor_type"), (F.lit(0.4) + F.lit(5.0) * F.col("l_discount")).alias("confidence"), F.col("l_returnflag").alias("source_name"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).where("l_linenumber = 7 and l_quantity >= 49")
    return rows.select(
        F.col("l_suppkey").alias("company_id"), F.col("id").alias("event_id"), by_flag("acquisition", "rebrand", "layoff").alias("event_type"), F.col("ship_month").alias("event_month"),
        F.when(F.col("l_linestatus") == "O", "first_party").otherwise("press").alias("source_class"), (F.col("l_discount") * 10).alias("confidence"),
        F.when(F.col("l_tax") > 0.03, F.concat(F.lit("note "), F.col("id"))).alias("description"), F.col("l_shipdate").alias("created_at"),
    )


METRICS = ("headcount_current", "headcount_6m_ago", "headcount_1y_ago", "headcount_2y_ago", "growth_6m_pct", "growth_1y_pct", "growth_2y_pct")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.element_at(F.array(*map(F.lit, METRICS)), (F.col("l_quantity") % 7).cast("int") + 1)
    growth = metric.startswith("growth")
    rows = lines(spark, sf_dir).where("l_linenumber = 2")
    low, point, high = _interval()
    plain = rows.select(F.col("l_suppkey").alias("company_id"), F.col("id").alias("benchmark_id"), by_flag("primary", "secondary", "tertiary").alias("provider"), metric.alias("metric"), F.lit(WINDOW.as_of).cast("date").alias("as_of_month"), low, point, high, (F.col("l_quantity") - 25).alias("g"), growth.alias("is_growth"), F.col("l_partkey").alias("row_index"))
    for c in ("value_min", "value_point", "value_max"):
        plain = plain.withColumn(c, F.when(F.col("is_growth"), F.col("g")).otherwise(F.col(c)))
    return plain.drop("g", "is_growth")


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins, suppress windows of three months, synthetic events; a tenth has expired."""
    rows = lines(spark, sf_dir).where("l_linenumber = 3 and l_quantity = 50")
    point = F.col("l_quantity") * 10
    month = F.date_format("ship_month", "yyyy-MM-dd")
    pin = F.to_json(F.struct(month.alias("anchor_month"), (point * 0.9).alias("value_min"), point.alias("value_point"), (point * 1.1).alias("value_max"), F.lit(0.9).alias("confidence")))
    span = F.to_json(F.struct(month.alias("start_month"), F.date_format(F.add_months("ship_month", 2), "yyyy-MM-dd").alias("end_month")))
    event = F.to_json(F.struct(month.alias("event_month"), F.lit("merger").alias("event_type")))
    return rows.select(
        F.col("l_suppkey").alias("company_id"), F.col("id").alias("override_id"), by_flag("current_anchor", "estimate_suppress_window", "event_segment").alias("field_name"), by_flag(pin, span, event).alias("payload"),
        F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("reason"), F.when(F.col("l_discount") == 0.1, F.lit("2000-01-01 00:00:00").cast("timestamp")).alias("expires_at"), F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimate versions: one an order line of linenumber 4."""
    rows = lines(spark, sf_dir).where("l_linenumber = 4")
    return rows.select(F.col("l_suppkey").alias("company_id"), F.col("id").alias("version_id"), F.col("l_shipdate").alias("created_at"), F.col("l_returnflag").alias("run_id"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of versions: one to three each, by quantity."""
    rows = lines(spark, sf_dir).where("l_linenumber = 4")
    number = F.explode(F.sequence(F.lit(0), F.col("l_quantity").cast("int") % 3)).alias("number")
    return rows.select(F.col("id").alias("version_id"), number, F.col("l_shipdate").alias("created_at")).select("version_id", F.concat_ws("-", "version_id", "number").alias("audit_id"), F.lit("estimate").alias("action"), "created_at")


def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size statements as analysts type them, one for each part."""
    n = (F.col("p_size") * 10).cast("string")
    more = (F.col("p_size") * 10 + 49).cast("string")
    k = F.col("p_partkey") % 8
    text = F.when(k == 0, F.concat(F.lit("over "), n, F.lit(" employees"))).when(k == 1, F.concat(F.lit("about "), n)).when(k == 2, F.concat(n, F.lit("-"), more)).when(k == 3, F.concat(n, F.lit("+"))).when(k == 4, F.lit("10,001+")).when(k == 5, F.concat(F.lit("a "), n, F.lit("-person team"))).when(k == 6, F.lit("n/a")).otherwise(n)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), text.alias("value_text"))


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as analysts type them, one for each order."""
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 7
    names = F.array(*(F.lit(m) for m in ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")))
    year, name = F.year(d).cast("string"), F.element_at(names, F.month(d))
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, F.concat(name, F.lit(" "), year)).when(k == 3, F.concat(F.substring(name, 1, 3), F.lit(" "), year)).when(k == 4, F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), year)).when(k == 5, year).otherwise(F.concat(F.lit("13/"), year))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), text.alias("date_text"))
