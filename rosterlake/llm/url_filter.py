"""URL filter: pattern rules indexed by their rarest literal token (DataFrame operations only).

Rules use a small pattern language over `host + path + rest` of a URL:
`||example.net/en/` binds the host (and its subdomains) and a path prefix, `*`
stands for anything, `^` for a border of a run of letters, digits, `_` and `%`.  A literal token of a pattern is one that a matching URL must hold as
a whole token.  Each rule is filed under the one of its tokens that fewest URLs
hold; a URL's tokens fetch the rules filed under them, and only those run their
regular expression.  Rules without such a token are filed under the empty token,
which every URL has.  Rules are a table, compiled by column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rules up to which the index is broadcast; beyond, the join is shuffled with salted tokens.
MAX_BROADCAST_BYTES = 16 << 20
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """pattern, verdict (`allow` or `block`), and the label that the result shows (None: none)."""

    pattern: str
    verdict: str
    label: str | None = None
    rank: int = 0  # higher ranks win; the longer label or pattern wins within a rank


def host_rule(text: str, verdict: str) -> Rule:
    """A rule `host/path`: fits the host and all subdomains where the path starts with /path."""
    return Rule(f"||{text}", verdict, text, 1)


# Fixed values of the contract.
HOST_RULES = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"))
#: What decides where no host rule fits: block these, allow the rest.
PATTERN_RULES = (
    Rule("^spam^", "block"), Rule("^casino^", "block"), Rule("^porn^", "block"), Rule("^xxx^", "block"),
    Rule("^viagra^", "block"), Rule("^phishing^", "block"), Rule("^malware^", "block"), Rule("^doubleclick^", "block"), Rule("^adserver^", "block"),
    Rule(".exe^", "block"), Rule("^login^*^redirect^", "block"),
)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.pattern, r.verdict, r.label, r.rank) for r in rules], "pattern string, verdict string, label string, rank int")


def compiled(rules: DataFrame) -> DataFrame:
    """rules (pattern, verdict, label, rank) -> those, regex (Java), tokens (literal ones that a matching URL holds)."""
    bound = F.startswith("pattern", F.lit("||"))
    body = F.when(bound, F.substring("pattern", 3, 1 << 30)).otherwise(F.col("pattern"))
    border = r"(?:(?<![\w%])|(?![\w%]))"
    quoted = F.regexp_replace(body, r"([^\w*^])", r"\\$1")
    regex = F.replace(F.replace(quoted, F.lit("^"), F.lit(border)), F.lit("*"), F.lit(".*"))
    # a token ends at a border or another character on both sides, not at `*` or at an open end
    closed = F.lower(F.concat(F.when(bound, F.lit("^")).otherwise(F.lit("")), body))
    tokens = F.array_distinct(F.regexp_extract_all(closed, F.lit("(?<=[^*a-z0-9])[a-z0-9]+(?=[^*a-z0-9])"), F.lit(0)))
    whole = F.concat(F.lit("(?s)"), F.when(bound, F.lit("^(?:[^/?#]*\\.)?")).otherwise(F.lit("")), regex)
    return rules.select("pattern", "verdict", "label", "rank", whole.alias("regex"), tokens.alias("tokens"))


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, whole target) of a URL; '' where it is null or has no ://."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return host, path, F.concat(host, rest)


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(target, _UPPER, _LOWER), "[^a-z0-9]+")))


def rule_index(rules: DataFrame, exploded: DataFrame, few: bool) -> DataFrame:
    """compiled rules -> their columns without tokens, and `token`: the one of theirs that fewest rows of exploded (token) have."""
    wanted = rules.select("pattern", F.explode("tokens").alias("token"))
    # tokens are counted on the map side before any shuffle; where the rules are few, only their tokens are counted
    counted = exploded.join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi") if few else exploded
    counts = counted.groupBy("token").count()
    filed = wanted.join(counts, "token", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return rules.drop("tokens").join(filed, "pattern", "left").withColumn("token", F.coalesce("token", F.lit("")))


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """pages (page_id, url, ...) -> page_id, host, path, rule, verdict; one row per row.

    rules (pattern, verdict, label, rank): the highest rank wins, then the
    longest label or pattern, then `allow`, then the last pattern by name.
    Null and malformed URLs have empty host and path, fit no rule and get the
    default.  Repeated rows give a row each; other columns are ignored.
    """
    rules = rule_table(pages.sparkSession, HOST_RULES + PATTERN_RULES) if rules is None else rules
    # a pattern that is listed twice counts once
    rules = rules.groupBy("pattern").agg(F.max(F.struct("rank", (F.col("verdict") == "allow").alias("allow"), "verdict", "label")).alias("r")).select("pattern", "r.verdict", "r.label", "r.rank")
    host, path, target = url_parts(F.col("url"))
    parts = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path"), target.alias("target"))
    exploded = parts.select("*", F.explode(_tokens(F.col("target"))).alias("token"))
    few = (rules.agg(F.sum(F.octet_length("pattern") + 200)).first()[0] or 0) <= MAX_BROADCAST_BYTES
    index = rule_index(compiled(rules), exploded.where("target <> ''").select("token"), few)
    if few:
        met = exploded.join(F.broadcast(index), "token", "left")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = exploded.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"], "left")
    fits = F.expr("target <> '' and target rlike regex")
    order = F.struct("rank", F.length(F.coalesce("label", "pattern")), F.col("verdict") == "allow", "pattern")
    # one row each comes back from its own candidates: no join on URLs, so copies of one URL meet in no task
    best = F.max_by(F.struct("label", "verdict"), F.when(fits, order))
    won = met.groupBy("row", "page_id", "host", "path").agg(best.alias("won"))
    return won.select("page_id", "host", "path", F.col("won.label").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
