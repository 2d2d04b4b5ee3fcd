"""Evidence: what stands behind a month of a company, and facts read from archived pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions.expressions import month_diff
from rosterlake.functions.structured import stated_employees
from rosterlake.functions.text import content_gate, exact_count, html_text, let, size_badge, size_mentions, status_gate
from rosterlake.operators.evaluation import latest_version
from rosterlake.operators.series import in_ranges


def evidence(wanted: DataFrame, stored: DataFrame, segments: DataFrame, placed: DataFrame, events: DataFrame, growth: DataFrame) -> DataFrame:
    """One nested record a (company_id, month): estimate, segment, anchors and events of the segment, growth ending there."""
    base = wanted.join(stored, ["company_id", "month"])
    seg = segments.select("company_id", "segment_no", "segment_start", "segment_end", "opening_types")
    base = base.join(seg, ["company_id", "segment_no"])
    pick = ["anchor_id", "anchor_month", "anchor_type", "value_point", "confidence"]
    anchors = placed.groupBy("company_id", "segment_no").agg(F.array_sort(F.collect_list(F.struct(*pick))).alias("anchors"))
    inside = in_ranges(events.select("company_id", "event_month", "event_type"), "event_month", seg, "segment_start", "segment_end")
    happened = inside.groupBy("company_id", "segment_no").agg(F.array_sort(F.collect_list(F.struct("event_month", "event_type"))).alias("events"))
    grown = growth.groupBy("company_id", "month").agg(F.array_sort(F.collect_list(F.struct("horizon", "growth_point"))).alias("growth"))
    full = base.join(anchors, ["company_id", "segment_no"], "left").join(happened, ["company_id", "segment_no"], "left").join(grown, ["company_id", "month"], "left")
    return full.select("company_id", "month", F.struct("value_min", "value_point", "value_max", "method", "band", "score").alias("estimate"), F.struct("segment_no", "segment_start", "segment_end", "opening_types").alias("segment"), "anchors", "events", "growth")



def evidence_tree(records: DataFrame, reconciled: DataFrame, overrides: DataFrame, versions: DataFrame, audit: DataFrame) -> DataFrame:
    """`evidence` records with what else stands behind their company: newest version, reconciled anchors, active overrides, the version's audit.

    reconciled: see `series.reconcile_anchors`; overrides: the active ones;
    versions: see `evaluation.latest_version`; audit: version_id, audit_id,
    action, created_at.
    """
    listed = lambda df, key, name, *cols: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    folded = listed(reconciled, "company_id", "reconciled", "segment_no", "anchor_month", "value_min", "value_point", "value_max")
    live = listed(overrides, "company_id", "overrides", "override_id", "field_name", "payload", "reason", "expires_at")
    newest = latest_version(versions).select("company_id", "version_id")
    logged = newest.join(listed(audit, "version_id", "audit", "created_at", "audit_id", "action"), "version_id", "left")
    out = records
    for part in (folded, live, logged):
        out = out.join(part, "company_id", "left")
    empty = {c: F.coalesce(c, F.array()) for c in ("anchors", "events", "growth", "reconciled", "overrides", "audit")}
    return out.withColumns(empty)


def json_ld(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> page_id, value_min, value_point, value_max, kind: the size that a page's JSON-LD states."""
    return pages.select("page_id", stated_employees("html").alias("s")).where("s is not null").select("page_id", "s.*")


# What a statement of a source and kind is worth, and the paths of a company's pages in the order they count.
POLICY = {
    ("company_page", "json_ld"): 0.70, ("company_page", "exact"): 0.65, ("company_page", "range"): 0.55,
    ("profile_page", "badge"): 0.45, ("profile_page", "json_ld_exact"): 0.60, ("profile_page", "json_ld_range"): 0.50, ("people_page", "exact"): 0.35,
    ("archive", "json_ld"): 0.55, ("archive", "text"): 0.45, ("filing", "fact"): 0.85, ("knowledge_base", "domain"): 0.70, ("knowledge_base", "name"): 0.55,
}
PATH_ORDER = ("/", "/about", "/about-us", "/about/company", "/company", "/team", "/our-team", "/leadership", "/people", "/careers")


def policy(spark: SparkSession) -> DataFrame:
    """POLICY as a table: source, statement, confidence."""
    return spark.createDataFrame([(*k, v) for k, v in POLICY.items()], "source string, statement string, confidence double")


def with_confidence(signals: DataFrame) -> DataFrame:
    """Signals (source, statement, ...) with the confidence of the policy; those that it does not name are dropped."""
    return signals.join(F.broadcast(policy(signals.sparkSession)), ["source", "statement"])


def profile_signals(pages: DataFrame) -> dict[str, DataFrame]:
    """The page cascade of profile pages (company_id, part: company | about | people, url, status, html).

    signals (company_id, source, statement, part, value_min, value_point,
    value_max, confidence): the JSON-LD statement of the company page, else its
    badge; else the same of the about page; with either, the exact count of the
    people page comes as a further signal.  gates (company_id, reason): companies
    without a signal whose company page, or about page after an open company
    page without a statement, is gated: by its status, a login path or a mark in
    its text.  Of several pages of a part the first by url counts.
    """
    first = pages.groupBy("company_id", "part").agg(F.min(F.struct("url", "status", "html")).alias("p")).select("company_id", "part", "p.*")
    body = F.coalesce("html", F.lit(""))
    said = let(html_text(body), lambda t: F.struct(size_badge(t).alias("badge"), exact_count(t).alias("count")))
    described = first.select("*", body.alias("body"), stated_employees("html").alias("ld"), said.alias("said")).select("*", "said.*")
    by_status, by_content = status_gate("status"), content_gate("url", "body")
    seen = described.withColumn("refused", by_status).withColumn("gate", by_content).withColumn("states", F.col("refused").isNull() & (F.col("ld").isNotNull() | F.col("badge").isNotNull()))
    of = lambda part: F.max(F.when(F.col("part") == part, F.struct("states", "refused", "gate", "ld", "badge", "count"))).alias(part)
    wide = seen.groupBy("company_id").agg(*map(of, ("company", "about", "people")))
    opened = F.coalesce(F.col("company.refused"), F.when(~F.col("company.states"), F.col("company.gate"))).isNull() & F.col("company").isNotNull()
    chosen = F.when(F.col("company.states"), F.lit("company")).when(opened & F.col("about.states"), F.lit("about"))
    from_page = wide.withColumn("part", chosen).withColumn("page", F.when(F.col("part") == "company", F.col("company")).otherwise(F.col("about")))
    stated = from_page.where("part is not null")
    exact = F.col("page.ld.value_min") == F.col("page.ld.value_max")
    statement = F.when(F.col("page.ld").isNull(), "badge").when(exact, "json_ld_exact").otherwise("json_ld_range")
    low, high = F.col("page.badge.low").cast("double"), F.col("page.badge.high").cast("double")
    value = lambda name, badge: F.coalesce(F.col(f"page.ld.{name}"), badge).alias(name)
    main = stated.select("company_id", F.lit("profile_page").alias("source"), statement.alias("statement"), "part", value("value_min", low), value("value_point", (low + high) / 2), value("value_max", high))
    n = F.col("people.count").cast("double")
    soft = F.col("people.refused").isNull() & F.col("people.gate").isNull() & n.isNotNull()
    people = stated.where(soft).select("company_id", F.lit("people_page").alias("source"), F.lit("exact").alias("statement"), F.lit("people").alias("part"), n.alias("value_min"), n.alias("value_point"), n.alias("value_max"))
    late = F.when(opened, F.coalesce(F.col("about.refused"), F.col("about.gate")))
    reason = F.coalesce(F.col("company.refused"), F.col("company.gate"), late)
    gates = from_page.where("part is null").select("company_id", reason.alias("reason")).where("reason is not null")
    return {"signals": with_confidence(main.unionByName(people)), "gates": gates}


def site_signals(pages: DataFrame, max_paths: int = 8) -> dict[str, DataFrame]:
    """The page cascade of company sites (company_id, path, status, html).

    signals (company_id, path, value_min, value_point, value_max, statement,
    confidence): the statements of the first path, in PATH_ORDER, that has any
    (its JSON-LD, else the sizes in its text); gates (company_id, reason):
    companies all of whose pages are forbidden.
    """
    rank = F.array_position(F.array(*map(F.lit, PATH_ORDER[:max_paths])), F.col("path")).cast("int")
    tried = pages.withColumn("path_rank", rank).where("path_rank > 0")
    opened = tried.where("status < 400").select(F.col("path_rank").alias("page_id"), "html", "company_id", "path", "path_rank")
    placed = page_signals(opened, badges=False, keep=("company_id", "path", "path_rank"))
    best = placed.groupBy("company_id").agg(F.min("path_rank").alias("path_rank"))
    values = ["value_min", "value_point", "value_max"]
    statement = F.when(F.col("method") == "json_ld", "json_ld").when(F.col("kind") == "exact", "exact").otherwise("range")
    rows = placed.join(best, ["company_id", "path_rank"]).select("company_id", "path", *values, F.lit("company_page").alias("source"), statement.alias("statement"))
    gates = tried.groupBy("company_id").agg(F.bool_and(F.col("status") == 403).alias("all")).where("all").select("company_id", F.lit("forbidden").alias("reason"))
    return {"signals": with_confidence(rows).drop("source"), "gates": gates}


def page_signals(pages: DataFrame, badges: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Size statements of archived pages, best method only: page_id, method, value_min, value_point, value_max, kind, confidence, and the columns to keep.

    JSON-LD comes before a size badge, which comes before statements in the
    text.  One pass, without a shuffle: each reader runs where those before it
    found nothing.
    """

    def row(method: str, low: Column, point: Column, high: Column, kind: Column) -> Column:
        exact = F.when(kind == "exact", POLICY["company_page", "exact"]).otherwise(POLICY["company_page", "range"])
        worth = F.lit(POLICY["company_page", "json_ld"]) if method == "json_ld" else exact
        return F.struct(
            F.lit(method).alias("method"), low.alias("value_min"), point.alias("value_point"), high.alias("value_max"), kind.alias("kind"), worth.cast("double").alias("confidence")
        )

    def of_badge(b: Column) -> Column:
        low, high = b.low.cast("double"), b.high.cast("double")
        return F.array(row("badge", low, (low + high) / 2, high, F.lit("bucket")))

    def of_text(t: Column) -> Column:
        mentions = F.transform(size_mentions(t), lambda m: row("text", m.value_min, m.value_point, m.value_max, m.kind))
        return let(size_badge(t), lambda b: F.when(b.isNotNull(), of_badge(b)).otherwise(mentions)) if badges else mentions

    def best(ld: Column) -> Column:
        stated = F.array(row("json_ld", ld.value_min, ld.value_point, ld.value_max, ld.kind))
        return F.when(ld.isNotNull(), stated).otherwise(let(html_text(F.coalesce("html", F.lit(""))), of_text))

    return pages.select("page_id", *keep, F.explode(let(stated_employees("html"), best)).alias("s")).select("page_id", "s.*", *keep)


def snapshot_choice(snapshots: DataFrame, as_of: Column, horizons: tuple[int, ...] = (6, 12, 24), drift: int = 12) -> DataFrame:
    """Archived snapshots (origin, snapshot_month) nearest to each horizon, not further than `drift` months, each used once.

    Of two that are equally near the earlier counts; a snapshot that serves
    several horizons is stamped with the first of `horizons`.  as_of must be one
    value an origin.  Each horizon needs the last snapshot up to it and the
    first from it on: conditional extremes of one aggregate, which combine
    before the shuffle however many snapshots an origin has.
    """
    at = "snapshot_month"
    near = []
    for i, h in enumerate(horizons):
        target = F.add_months(as_of, -h)
        near += [F.max(F.when(F.col(at) <= target, F.col(at))).alias(f"back{i}"), F.min(F.when(F.col(at) >= target, F.col(at))).alias(f"ahead{i}"), F.max(target).alias(f"target{i}")]
    ends = snapshots.where(F.col(at).isNotNull()).groupBy("origin").agg(*near)
    choice = lambda i, h, c: F.struct(F.abs(month_diff(f"{c}{i}", f"target{i}")).alias("off"), F.col(f"{c}{i}").alias(at), F.lit(i).alias("rank"), F.lit(h).alias("horizon"), F.col(f"target{i}").alias("stamped_month"))
    best = [F.array_min(F.filter(F.array(choice(i, h, "back"), choice(i, h, "ahead")), lambda c: c.off <= drift)) for i, h in enumerate(horizons)]
    rows = ends.select("origin", F.explode(F.filter(F.array(*best), lambda c: c.isNotNull())).alias("c")).select("origin", "c.*")
    used = rows.groupBy("origin", at).agg(F.min(F.struct("rank", "horizon", "stamped_month")).alias("h"))
    return used.select("origin", at, "h.horizon", "h.stamped_month")


# The concepts of filings that count employees.
CONCEPTS = ("EmployeeNumberOfEmployees", "NumberOfEmployees", "EntityNumberOfEmployees", "EmployeeEquivalentsFullTimeAndPartTimeTotalNumberOfEmployees")


def filing_facts(filings: DataFrame, concepts: tuple[str, ...] = CONCEPTS, top: int = 5) -> DataFrame:
    """filings (company_id, body JSON) -> the newest `top` headcount facts of each: concept, unit, end, value, filed."""
    schema = "struct<facts:map<string,map<string,struct<units:map<string,array<struct<end:string,val:double,filed:string>>>>>>>"
    flat = filings.select("company_id", F.explode(F.from_json("body", schema)["facts"]).alias("taxonomy", "c")).select("company_id", F.explode("c").alias("concept", "u")).where(F.col("concept").isin(*concepts))
    rows = flat.select("company_id", "concept", F.explode(F.col("u.units")).alias("unit", "f")).select("company_id", "concept", "unit", F.explode("f").alias("f")).select("company_id", "concept", "unit", F.to_date("f.end").alias("end"), F.col("f.val").alias("value"), F.to_date("f.filed").alias("filed"))
    from pyspark.sql import Window

    newest = Window.partitionBy("company_id").orderBy(F.desc("end"), F.desc("filed"), "concept")
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= top).drop("_n")


def knowledge_rows(answers: DataFrame, default_month: Column) -> DataFrame:
    """answers (company_id, body: JSON of query bindings) -> company_id, value_point, anchor_month; positive values only."""
    cell = "struct<value:string>"
    bindings = F.from_json("body", f"struct<results:struct<bindings:array<struct<company:{cell},employees:{cell},asof:{cell}>>>>")["results"]["bindings"]
    rows = answers.select("company_id", F.explode(bindings).alias("b")).select("company_id", F.col("b.employees.value").try_cast("double").alias("value_point"), F.try_to_date(F.substring("b.asof.value", 1, 10), "yyyy-MM-dd").alias("d"))
    return rows.where("value_point > 0").select("company_id", "value_point", F.coalesce(F.trunc("d", "month"), default_month).alias("anchor_month"))


def archive_url(url: Column | str) -> Column:
    """struct(snapshot_month, origin) of an archive URL such as .../web/20200131120000/https://a.org/; null parts otherwise."""
    u = F.col(url) if isinstance(url, str) else url
    stamp, origin = (F.nullif(F.regexp_extract(u, r"/web/(\d{6})\d{0,8}[a-z_]*/(.+)$", k), F.lit("")) for k in (1, 2))
    return F.struct(F.try_to_date(F.concat(stamp, F.lit("01")), "yyyyMMdd").alias("snapshot_month"), origin.alias("origin"))
