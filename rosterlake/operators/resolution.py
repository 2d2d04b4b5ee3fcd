"""Entity resolution and key lookups."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.text import domain_key, legal_suffix, name_key, profile_slug
from rosterlake.sources.tables import checkpointed


def keyed(df: DataFrame, id_col: str, domain: str, slug: str, name: str, more_names: str | None = None) -> DataFrame:
    """One row for each typed key of a row: id, rank (0 domain, 1 slug, 2 name, 3 other names), key."""
    kinds = [(0, domain_key(domain), "d:"), (1, profile_slug(slug), "s:"), (2, name_key(name), "n:")]
    parts = df.select(id_col, *(F.concat(F.lit(p), F.nullif(k, F.lit(""))).alias(f"k{r}") for r, k, p in kinds), *([more_names] if more_names else []))
    out = parts.select(id_col, F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), F.col(f"k{r}").alias("key")) for r, _, _ in kinds))).alias("x")).select(id_col, "x.rank", "x.key")
    if more_names:
        other = parts.select(id_col, F.explode(more_names).alias("n")).select(id_col, F.lit(3).alias("rank"), F.concat(F.lit("n:"), F.nullif(name_key("n"), F.lit(""))).alias("key"))
        out = out.unionByName(other)
    return out.where(F.col("key").isNotNull())


def lookup_first(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """For each left row the right row that its best-ranked shared key finds (then the smallest id): left_id, right_id, rank.

    left and right are `keyed` frames: an OR of several matches becomes one equi-join.
    """
    hit = left.join(right.select(right_id, "key"), "key")
    return hit.groupBy(left_id).agg(F.min(F.struct("rank", right_id)).alias("m")).select(left_id, F.col(f"m.{right_id}").alias(right_id), "m.rank")


def ordered_lookup(left: DataFrame, keys: str, entries: DataFrame, key: str, value: str) -> DataFrame:
    """First entry that a row's array of keys finds, in the order of the array; null value without one."""
    found = left.select("row_id", F.posexplode(keys).alias("pos", key)).join(entries.select(key, value), key).groupBy("row_id").agg(F.min_by(value, F.struct("pos", value)).alias(value))
    return left.join(found, "row_id", "left")


def host_suffixes(host: Column | str) -> Column:
    """a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(F.col(host) if isinstance(host, str) else host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def host_to_company(pages: DataFrame, companies: DataFrame) -> DataFrame:
    """pages (page_id, url) -> page_id, company_id of the company whose domain is the longest suffix of the host."""
    hosts = pages.select("page_id", domain_key("url").alias("host")).where(F.col("host").isNotNull())
    tried = hosts.select("page_id", F.explode(host_suffixes("host")).alias("domain"))
    hit = tried.join(companies.select("company_id", "domain"), "domain")
    return hit.groupBy("page_id").agg(F.max(F.struct(F.length("domain").alias("n"), -F.col("company_id"))).alias("m")).select("page_id", (-F.col("m.col2")).alias("company_id"))


#: Rank of the key that names a candidate's company, and of a candidate that founds one.
MATCHED_BY = {0: "domain", 1: "slug", 2: "name", 3: "new"}
#: Key rows that one task replays; more are cut into blocks by row number.
MAX_REPLAY_KEYS = 200_000

_CLAIMS = "block int, known boolean, id long, at long, rank int, key string, outcome boolean"


def _replayed(rows: pd.DataFrame) -> pd.DataFrame:
    """Greedy resolution of a block of key rows in row order, given who holds their keys before the block.

    rows: block, id, rank, key; holder_known, holder_id (null where the key is
    free) and which of domain and slug that holder has.  Returns the rows'
    outcomes (`outcome`) and the block's claims: a key that a company came to
    hold, or, without a key, a domain or slug that it took for its own.  `at`
    is the row in both.
    """
    Company = tuple[bool, int]
    holder: dict[str, Company] = {}
    single: set[tuple[Company, int]] = set()
    taken = rows[rows["holder_id"].notna()]
    for key, known, ident, domain, slug in zip(taken["key"], taken["holder_known"], taken["holder_id"].astype("int64"), taken["holder_domain"], taken["holder_slug"], strict=True):
        company = (bool(known), int(ident))
        holder[key] = company
        single.update((company, rank) for rank, has in ((0, domain), (1, slug)) if has)
    out: list[tuple] = []
    block = int(rows["block"].iloc[0])
    ordered = rows.sort_values(["id", "rank", "key"])
    nodes = zip(ordered["id"].tolist(), ordered["rank"].tolist(), ordered["key"].tolist(), strict=True)
    for ident, group in itertools.groupby(nodes, key=lambda r: r[0]):
        mine = [r[1:] for r in group]
        how, company = next(((r, holder[k]) for r, k in mine if k in holder), (3, (False, ident)))
        for rank, key in mine:
            if rank == 2 or (company, rank) not in single:
                if key not in holder:
                    holder[key] = company
                    out.append((block, *company, ident, rank, key, False))
                if rank < 2:
                    single.add((company, rank))
                    out.append((block, *company, ident, rank, None, False))
        out.append((block, *company, ident, how, None, True))
    return pd.DataFrame(out, columns=["block", "known", "id", "at", "rank", "key", "outcome"])


def _first_claims(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key -> block, holder), (holder -> block from which it has a domain, a slug): the earliest claims.

    Each company takes a domain or slug once in a block, so minima of few rows.
    """
    company = F.struct("known", "id").alias("holder")
    of = claims.where("not outcome").select("block", "at", "rank", "key", company)
    keys = of.where("key is not null").groupBy("key").agg(F.min(F.struct("block", "at", "holder")).alias("m")).select("key", F.col("m.block").alias("held_from"), "m.holder")
    first = lambda rank: F.min(F.when(F.col("rank") == rank, F.col("block")))
    own = of.where("key is null").groupBy("holder").agg(first(0).alias("domain_from"), first(1).alias("slug_from"))
    return keys, own


def resolve_by_blocks(keys: DataFrame, block_keys: int = MAX_REPLAY_KEYS) -> DataFrame:
    """Greedy resolution of key rows (node, rank, key) in row order: row_no, rank, known, id.

    Rows are cut into consecutive blocks of about `block_keys` key rows, and all
    blocks are replayed at once, each under the claims that earlier blocks made
    in the round before.  The first block is right at once, and each round
    makes right at least the next one, so there are at most as many rounds as
    blocks, however long a chain of rows that depend on each other is; rounds
    end when no claim changes.  A round is two joins on keys; what a block
    learns of a key is one row, so a key that many rows share costs no more.
    """
    given = keys.where("node.known")
    # companies that were there come first, in the order of their ids
    before = given.select(F.lit(-1).alias("block"), "node.known", "node.id", F.col("node.id").alias("at"), "rank", "key", F.lit(False).alias("outcome"))
    before = before.unionByName(before.where("rank < 2").withColumn("key", F.lit(None).cast("string")))
    rows = keys.where("not node.known").select(F.col("node.id").alias("id"), "rank", "key")
    total = rows.count()
    n = max(1, -(-total // block_keys))
    cuts = rows.approxQuantile("id", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
    number = F.size(F.filter(F.array(*(F.lit(int(c)) for c in sorted(set(cuts)))), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    blocks = checkpointed(rows.withColumn("block", number.cast("int")))
    old = None
    claims = before.limit(0)
    while True:
        held, own = _first_claims(before.unionByName(claims))
        if old is not None:
            was_held, was_own = old
            same_key = held.join(was_held.withColumnsRenamed({"held_from": "b", "holder": "h"}), "key", "full").where("not (held_from <=> b and holder <=> h)")
            same_own = own.join(was_own.withColumnsRenamed({"domain_from": "d", "slug_from": "s"}), "holder", "full").where("not (domain_from <=> d and slug_from <=> s)")
            if same_key.isEmpty() and same_own.isEmpty():
                break
        old = (held, own)
        wanted = blocks.join(held, "key", "left").withColumn("holder", F.when(F.col("held_from") < F.col("block"), F.col("holder")))
        told = wanted.join(own, "holder", "left").select(
            "block", "id", "rank", "key", F.col("holder.known").alias("holder_known"), F.col("holder.id").alias("holder_id"),
            F.coalesce(F.col("domain_from") < F.col("block"), F.lit(False)).alias("holder_domain"), F.coalesce(F.col("slug_from") < F.col("block"), F.lit(False)).alias("holder_slug"),
        )
        claims = checkpointed(told.groupBy("block").applyInPandas(_replayed, _CLAIMS))
        if not cuts:
            break
    return claims.where("outcome").select(F.col("at").alias("row_no"), "rank", "known", "id")


def resolve(candidates: DataFrame, companies: DataFrame | None = None, aliases: DataFrame | None = None, max_replay_keys: int = MAX_REPLAY_KEYS) -> DataFrame:
    """Greedy resolution in row order: row_no, company_id, company_row, matched_by.

    candidates (row_no, unique; name, domain, profile_url), companies that exist
    (company_id, name, domain, profile_url), their aliases (company_id, alias).
    A candidate joins the company that its domain, else its slug, else its name
    key names; else it founds one.  A company takes a domain or slug over from a
    candidate only while it has none; every candidate's name becomes a key.
    company_id is set for companies that existed, company_row (the founder's
    row_no) for new ones.  Without name and domain a candidate is `failed`.

    The order matters only between rows that share a key: the others found a
    company each, and the rest is replayed in blocks of `max_replay_keys` key
    rows at most (see `resolve_by_blocks`), with the same rows for any bound.
    """
    shaped = candidates.select("row_no", *_typed_keys("name", "domain", "profile_url"))
    usable = F.col("k0").isNotNull() | F.col("k2").isNotNull()
    keys = _key_rows(shaped.where(usable).select(_node(False, "row_no"), "k0", "k1", "k2"))
    if companies is not None:
        keys = keys.unionByName(_key_rows(companies.select(_node(True, "company_id"), *_typed_keys("name", "domain", "profile_url"))))
    if aliases is not None:
        keys = keys.unionByName(aliases.select(_node(True, "company_id"), F.lit(2).alias("rank"), _prefixed("n:", name_key("alias")).alias("key")).where("key is not null"))
    keys = checkpointed(keys.distinct())
    often = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    linked = keys.join(often, "key", "left_semi").select("node").distinct()
    apart = keys.where("not node.known").select("node").distinct().join(linked, "node", "left_anti")
    alone = apart.select(F.col("node.id").alias("row_no"), F.lit(3).alias("rank"), F.lit(False).alias("known"), F.col("node.id").alias("id"))
    found = alone.unionByName(resolve_by_blocks(keys.join(linked, "node", "left_semi"), max_replay_keys))
    how = F.element_at(F.create_map(*(F.lit(x) for pair in MATCHED_BY.items() for x in pair)), F.col("rank"))
    none = F.lit(None).cast("long")
    failed = shaped.where(~usable).select("row_no", none.alias("company_id"), none.alias("company_row"), F.lit("failed").alias("matched_by"))
    return found.select("row_no", F.when(F.col("known"), F.col("id")).alias("company_id"), F.when(~F.col("known"), F.col("id")).alias("company_row"), how.alias("matched_by")).unionByName(failed)


def _node(known: bool, ident: str) -> Column:
    return F.struct(F.lit(known).alias("known"), F.col(ident).cast("long").alias("id")).alias("node")


def _prefixed(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.nullif(key, F.lit("")))


def _typed_keys(name: str, domain: str, profile_url: str) -> list[Column]:
    keys = (_prefixed("d:", domain_key(domain)), _prefixed("s:", profile_slug(profile_url)), _prefixed("n:", name_key(name)))
    return [k.alias(f"k{rank}") for rank, k in enumerate(keys)]


def _key_rows(rows: DataFrame) -> DataFrame:
    """(node, k0, k1, k2) -> node, rank, key for each key that is there."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), F.col(f"k{r}").alias("key")) for r in range(3)))).alias("x")
    return rows.select("node", each).select("node", "x.rank", "x.key").where("key is not null")


def resolution_tables(candidates: DataFrame, resolved: DataFrame, companies: DataFrame, aliases: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """What a resolution adds: founded, gained, aliases, links, statuses.

    founded: company_row with its founder's name, and the first domain and
    profile URL that its rows bring; gained: the same two for companies
    (company_id, domain, profile_url) that had none, null where nothing is new.
    aliases: (company, key, alias_type: legal or dba) not yet in aliases
    (company_id, alias, alias_type), spelled as in the first row; links: the
    first profile URL of a company that is not in links (company_id).
    """
    own = candidates.select("row_no", F.trim("name").alias("name"), domain_key("domain").alias("domain"), F.nullif(F.trim("profile_url"), F.lit("")).alias("profile_url"))
    rows = resolved.where("matched_by <> 'failed'").join(own, "row_no")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("row_no", c)))[c].alias(c)
    brought = rows.groupBy("company_id", "company_row").agg(first("name"), first("domain"), first("profile_url"))
    had = companies.select("company_id", F.nullif(domain_key("domain"), F.lit("")).alias("_d"), F.nullif(F.trim("profile_url"), F.lit("")).alias("_p"))
    gained = brought.where("company_id is not null").join(had, "company_id").select("company_id", F.when(F.col("_d").isNull(), F.col("domain")).alias("domain"), F.when(F.col("_p").isNull(), F.col("profile_url")).alias("profile_url"))
    kind = F.when(legal_suffix("name").isNotNull(), "legal").otherwise("dba")
    spelled = rows.withColumn("key", name_key("name")).where("key <> ''").groupBy("company_id", "company_row", "key", kind.alias("alias_type")).agg(first("name")).withColumnRenamed("name", "alias")
    there = aliases.select("company_id", name_key("alias").alias("key"), "alias_type")
    return {
        "founded": brought.where("company_row is not null").drop("company_id"),
        "gained": gained.where("domain is not null or profile_url is not null"),
        "aliases": missing_keys(spelled, there, ["company_id", "key", "alias_type"], distinct=False),
        "links": missing_keys(brought.where("profile_url is not null").select("company_id", "company_row", "profile_url"), links, ["company_id"], distinct=False),
        "statuses": resolved.select("row_no", F.when(F.col("matched_by") == "failed", "failed").otherwise("resolved").alias("status"), "company_id", "company_row"),
    }


# Phrases before an acquirer's or a new name, the characters of a name, what ends one, and what is cut off its ends.
ACQUIRED_PHRASES = r"acquired\s+by"
RENAMED_PHRASES = r"(?:rebranded|renamed|now)\s+(?:to|as)"
RELATED_NAME = r"\s+([A-Za-z0-9][A-Za-z0-9 &\-.,'/()]+?)(?:\s+(?:in|on|during)\b|[.,;]|$)"
NAME_ENDS = r"""^[ .,;"'()]+|[ .,;"'()]+$"""


def relations(events: DataFrame, companies: DataFrame, aliases: DataFrame | None = None, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Companies named in event hints (company_id, hint_type, note): edges (parent_id, child_id, kind) and unresolved names (company_id, kind, parent_name).

    The type of the event picks the phrase: an acquisition names its acquirer
    (kind `acquired`), a rebrand the other name (`renamed`); other types name
    nobody.  A name ends at " in", " on", " during", at punctuation, or with the
    note, and is found among names (smallest id first), then aliases
    (company_id, alias).  No edge leads to itself or is in existing
    (parent_id, child_id, kind) already.
    """
    at_end = lambda phrases: F.regexp_replace(F.regexp_extract("note", rf"(?i){phrases}{RELATED_NAME}", 1), NAME_ENDS, "")
    kind = F.when(F.col("hint_type") == "acquisition", "acquired").when(F.col("hint_type") == "rebrand", "renamed")
    name = F.when(F.col("hint_type") == "acquisition", at_end(ACQUIRED_PHRASES)).when(F.col("hint_type") == "rebrand", at_end(RENAMED_PHRASES))
    found = events.select("company_id", kind.alias("kind"), name.alias("parent_name")).where("company_id is not null and parent_name <> ''")
    called = companies.select(name_key("name").alias("key"), F.lit(0).alias("r"), "company_id")
    if aliases is not None:
        called = called.unionByName(aliases.select(name_key("alias").alias("key"), F.lit(1).alias("r"), "company_id"))
    names = called.where("key <> ''").groupBy("key").agg(F.min(F.struct("r", "company_id"))["company_id"].alias("parent_id"))
    hit = found.withColumn("key", name_key("parent_name")).join(names, "key", "left")
    edges = hit.where("parent_id <> company_id").select("parent_id", F.col("company_id").alias("child_id"), "kind").distinct()
    if existing is not None:
        edges = edges.join(existing.select("parent_id", "child_id", "kind"), ["parent_id", "child_id", "kind"], "left_anti")
    return {"edges": edges, "unresolved": hit.where("parent_id is null").select("company_id", "kind", "parent_name")}


def shard(rows: DataFrame, order: list[str], n: int, m: int) -> DataFrame:
    """Every m-th row from the n-th on, in the given order; `order` should tell rows apart.

    Rows are numbered by ranges: within a range's partition, after the number of
    rows in those before it (one row a partition).
    """
    from pyspark.sql import Window

    placed = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    numbered = placed.withColumn("_n", number).join(F.broadcast(starts), "_part").withColumn("_n", F.col("_n") + F.col("_start"))
    return numbered.where(F.col("_n") % m == n - 1).drop("_n", "_part", "_start")



def missing_keys(wanted: DataFrame, existing: DataFrame, keys: list[str], distinct: bool = True) -> DataFrame:
    """Aliases or links to insert: those whose keys are not there yet, one for each (`distinct`); a null key is never there."""
    left = wanted.join(existing.select(*keys).distinct(), keys, "left_anti")
    return left.dropDuplicates(keys) if distinct else left


def event_company(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """The company of an event: its own, else that of the candidate it came from."""
    known = candidates.select("candidate_id", F.col("company_id").alias("_c"))
    return events.join(known, "candidate_id", "left").withColumn("company_id", F.coalesce("company_id", "_c")).drop("_c")


# Legal forms that a target's name may end in, each cut once in this order.
LOOSE_FORMS = ("incorporated", "inc", "llc", "ltd", "limited", "corp", "corporation", "company", "co", "gmbh", "sa", "plc")


def loose_name(text: Column | str) -> Column:
    """Match key of a target's name: lower-cased, commas, dots, brackets and quotes as spaces, legal forms cut off its end."""
    out = F.regexp_replace(F.trim(F.lower(text)), "[,.()\"']", " ")
    for form in LOOSE_FORMS:
        out = F.regexp_replace(out, rf" {form}\z", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def match_targets(targets: DataFrame, companies: DataFrame, aliases: DataFrame, key: Callable[[str], Column] = loose_name) -> DataFrame:
    """Target names (target) -> company_id by a name's key; a company's own name wins over an alias, null where nothing matches."""
    own = companies.select(key("name").alias("key"), F.lit(0).alias("rank"), "company_id")
    keys = own.unionByName(aliases.select(key("alias").alias("key"), F.lit(1).alias("rank"), "company_id")).where("key <> ''")
    best = keys.groupBy("key").agg(F.min(F.struct("rank", "company_id"))["company_id"].alias("company_id"))
    return targets.withColumn("key", key("target")).join(best, "key", "left").drop("key")


def candidate_hints(candidates: DataFrame, observations: DataFrame) -> DataFrame:
    """candidates (candidate_id, domain, ...) with the first domain and profile URL that their reference rows state.

    observations: candidate_id, load_order, domain, profile_url.  A candidate's
    own domain comes first; blank values count as missing.
    """
    first = lambda c: F.min(F.when(F.trim(c) != "", F.struct("load_order", c)))[c]
    stated = observations.groupBy("candidate_id").agg(first("domain").alias("_domain"), first("profile_url").alias("profile_url"))
    out = candidates.join(stated, "candidate_id", "left")
    return out.withColumn("domain", F.coalesce("domain", "_domain")).drop("_domain")
