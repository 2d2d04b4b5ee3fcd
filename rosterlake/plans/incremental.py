"""Estimates again only for companies whose inputs changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.plans.estimate import Estimate
from rosterlake.sources.buckets import BucketStore, Conflict
from rosterlake.sources.tables import checkpointed, shuffled

#: Changed companies that are broadcast to pick their inputs, some 30 MB; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Buckets of a new store: a few hundred MB each at a billion company-months.
BUCKETS = 64


def _prints(part: str, rows: DataFrame) -> DataFrame:
    """company_id, part, and a print of its rows that does not depend on their order: count and sums of two hashes."""
    cells = [F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in sorted(rows.dtypes)]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)"))
    return rows.groupBy("company_id").agg(F.concat_ws(":", F.lit(part), F.count("*"), total("a"), total("b")).alias("print"))


def fingerprints(e: Estimate) -> DataFrame:
    """company_id, fingerprint of everything that a company's estimate depends on, one row a company.

    Overrides count as they are at `now`, so one that expires is a change; so
    are other windows and parameters, for all companies.
    """
    parts = {"companies": e.companies.select("company_id").distinct(), "employment": e.employment, "anchors": e.anchors, "events": e.events}
    parts |= {k: v for k, v in e.decoded.items() if k != "rejected"}
    common = F.lit(repr((e.window, e.config)))
    every = None
    for name, rows in parts.items():
        one = _prints(name, rows)
        every = one if every is None else every.unionByName(one)
    whole = every.groupBy("company_id").agg(F.array_join(F.array_sort(F.collect_list("print")), "|").alias("prints"))
    return whole.join(parts["companies"], "company_id", "left_semi").select("company_id", F.sha2(F.concat_ws("|", common, "prints"), 256).alias("fingerprint"))


def _only(e: Estimate, wanted: DataFrame) -> Estimate:
    """The estimate of some companies alone."""
    some = lambda df: df.join(wanted, "company_id", "left_semi")
    return Estimate(some(e.companies), some(e.employment), some(e.anchors), some(e.events), some(e.overrides), e.window, e.now, e.config)


def refresh(e: Estimate, series: BucketStore, prints: BucketStore, buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """Bring stored series and fingerprints up to date: `stored`, and `changed` (company_id, action: new, changed or gone).

    Companies are independent of each other, so those with the stored
    fingerprint keep their rows; the others' buckets are rewritten.  Series go
    first, so a run that dies between the two stores repeats its work and ends
    the same.
    """
    now = checkpointed(fingerprints(e))
    if prints.manifest() is None:
        if series.manifest() is None:
            series.create(e.stored, ["company_id"], buckets)
        else:
            series.replace(series.read().select("company_id").distinct(), e.stored)
        prints.create(now, ["company_id"], buckets)
        return {"stored": series.read(), "changed": now.select("company_id", F.lit("new").alias("action"))}
    both = now.alias("n").join(prints.read().alias("o"), "company_id", "full")
    action = F.when(F.col("o.fingerprint").isNull(), "new").when(F.col("n.fingerprint").isNull(), "gone").when(F.col("n.fingerprint") != F.col("o.fingerprint"), "changed")
    changed = checkpointed(both.select("company_id", action.alias("action")).where("action is not null"))
    if n := changed.count():
        ids = changed.select("company_id") if n <= MAX_BROADCAST_IDS else shuffled(changed.select("company_id"))
        series.replace(ids, checkpointed(_only(e, ids).stored))
        prints.replace(ids, now.join(ids, "company_id", "left_semi"))
    return {"stored": series.read(), "changed": changed}


def refreshed(e: Estimate, path: str, buckets: int = BUCKETS, attempts: int = 3) -> DataFrame:
    """The stored series at a path after `refresh`; again if another writer came first."""
    spark = e.companies.sparkSession
    for left in range(attempts - 1, -1, -1):
        try:
            return refresh(e, BucketStore(spark, f"{path}/series"), BucketStore(spark, f"{path}/fingerprints"), buckets)["stored"]
        except Conflict:
            if not left:
                raise
    raise AssertionError


