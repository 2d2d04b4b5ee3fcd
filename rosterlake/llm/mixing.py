"""Mix sources to target weights (DataFrame operations only).

The words of a source, in order of doc_id, are packed into blocks of a fixed
length, and each source gets as many output slots as its target holds blocks.
Each slot is drawn into an output shard by a seeded hash: a source's counts are a
multinomial draw over the shards, so those of a shard, given its size, are one
over the sources with the target shares, while the totals of the sources stay
exact.  A source's slots are numbered shard by shard; slot j takes the block
that the source's own index permutation of pass `j div blocks` gives, and the
join is by (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import range_shards, written

WORD = r"[^\x20\x09-\x0D]+"
# Fixed values of the contract.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0

BLOCK_WORDS = 64
#: Slots of an output shard, on average, while there are up to MAX_SHARDS; beyond, shards grow.
SLOTS_PER_SHARD = 1 << 10
MAX_SHARDS = 1 << 16
SEED = 17
#: Documents of a cell of the running sums, about.
CELL_ROWS = 4096
#: Multipliers of the index permutations: primes above any number of blocks, so always coprime to it.
PRIMES = (1000000000000000003, 1000000000000000009, 1000000000000000031, 1000000000000000079, 1000000000000000177, 1000000000000000183, 1000000000000000201)
OFFSET = 7919
_CHUNK = 4096


def permuted(index: Column, n: Column, stream: Column) -> Column:
    """Place of index in permutation number `stream` of 0 .. n - 1: (index * prime + offset) mod n, in decimals (no overflow)."""
    prime = F.element_at(F.array(*(F.lit(p) for p in PRIMES)), (F.pmod(stream, F.lit(len(PRIMES))) + 1).cast("int"))
    wide = lambda c: c.cast("decimal(19,0)")
    shift = F.pmod((stream + 1) * F.lit(OFFSET), n)
    return F.pmod((wide(index) * wide(F.pmod(prime, n)) + wide(shift)).cast("decimal(38,0)"), wide(n)).cast("long")


def sized(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", "source", *more, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """sizes (source, size) -> rank, source, source_size, target, blocks, slots.

    Water-filling: in order of cap / weight, a source is capped as long as its
    cap lies below its share of what the capped ones before it leave.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = total.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    fill = Window.orderBy("ratio", "rank")
    shaped = (
        ranked.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("whole", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("whole") - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("final", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("ratio") <= F.col("level"), F.col("cap")).otherwise(F.col("final") * F.col("weight"))
    blocks = F.ceil(F.col("source_size") / block_words)
    out = shaped.select("rank", "source", "source_size", target.alias("target"), blocks.cast("long").alias("blocks"))
    # in units of the source's mean block, as its last one may be short
    wanted = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0.0)
    slots = F.least(wanted.cast("long"), F.floor(F.col("blocks") * F.lit(float(most))).cast("long"))
    return out.withColumn("slots", slots)


def packed(sizes: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add rank, source_size, target, and `at`: the words of the source before each document.

    Running sums in two levels (ranges of doc_id of about equal row counts, a few
    thousand at most, then inside a range), so that a hot source is not one
    window partition.
    """
    keyed = sizes.join(sources.select("rank", F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    keyed, _ = range_shards(keyed, "doc_id", F.lit(1), CELL_ROWS, sizes)
    cells = keyed.groupBy("rank", "shard").agg(F.sum("size").alias("n"))
    over = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("rank", "shard", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("cell_at"))
    ties = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    within = Window.partitionBy("rank", "shard").orderBy("doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumn("in_cell", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["rank", "shard"])
    return summed.withColumn("at", F.col("cell_at") + F.col("in_cell")).drop("shard", "cell_at", "in_cell")


def shard_counts(sources: DataFrame, slots_per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """rank, shard, n (slots of the source drawn into the shard), and the columns of sources."""
    urn = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("urn"))
    shards = F.least(F.greatest(F.ceil(F.col("urn") / F.lit(slots_per_shard)), F.lit(1)), F.lit(MAX_SHARDS)).cast("long")
    chunks = sources.crossJoin(F.broadcast(urn)).where("slots > 0").withColumn("shards", shards)
    chunks = chunks.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (slots - 1) div {_CHUNK})")))
    wide = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = chunks.repartition(wide, "rank", "chunk").withColumn("draw", F.explode(F.expr(f"sequence(chunk * {_CHUNK}, least(slots, (chunk + 1) * {_CHUNK}) - 1)")))
    # 32 bits of a digest as a fraction of 2^32
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "rank", "draw")), 1, 8), 16, 10).cast("long")
    shard = F.floor(number * F.col("shards") / F.lit(1 << 32)).cast("long")
    return draws.groupBy("rank", "slots", "blocks", shard.alias("shard")).agg(F.count("*").alias("n"))


def output_slots(sources: DataFrame, slots_per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """rank, block, pass, shard, slot: the block that each slot of the mix holds."""
    over = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = shard_counts(sources, slots_per_shard, seed).withColumn("first", F.coalesce(F.sum("n").over(over), F.lit(0)))
    wide = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = counts.repartition(wide, "rank", "shard").withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
    number = F.floor(F.col("slot") / F.col("blocks")).cast("long")
    block = permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.col("rank") + number)
    return slots.select("rank", block.alias("block"), number.cast("int").alias("pass"), "shard", "slot")


def fragments(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each block that a document reaches into: block, words (from this document), skip (its words before them)."""
    b = F.lit(block_words)
    f = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})")))
    begin, end = F.greatest(F.col("at"), F.col("block") * b), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b)
    return f.withColumn("words", end - begin).withColumn("skip", begin - F.col("at"))


def taken_words(docs: DataFrame, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """docs (doc_id, text, source, ...) -> doc_id, size, source_size, target, taken, first_shard; one row per row.

    first_shard is the first output shard that takes words of the document
    (null: none does).  Null texts have size 0 and take nothing; null sources are
    one source, the last; repeated ids are separate documents; an empty table
    gives no rows.  No document is taken more than twice, as a source has two
    passes at most.
    """
    sizes = written(sized(docs), "sizes")
    sources = written(source_targets(sizes, block_words=block_words), "sources")
    placed = packed(sizes, sources, block_words)
    # merge: sizes of exploded rows are underestimated, and the slots grow with the input
    slots = output_slots(sources, slots_per_shard)
    times = slots.groupBy("rank", "block").agg(F.count("*").alias("times"), F.min("shard").alias("block_shard")).hint("merge")
    key = ["doc_id", "rank", "at", "size", "source_size", "target"]
    got = fragments(placed, block_words).select(*key, "block", "words").join(times, ["rank", "block"], "left")
    summed = got.groupBy(key).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"), F.min("block_shard").alias("first_shard"))
    none = placed.where("size = 0").select(*key, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    return summed.unionByName(none).select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """The mix as documents with the columns of docs: a row for each document and pass that takes words of it.

    A row's text is the whole text where the pass takes all its words, else the
    words taken, in order, joined by spaces; n_chars, if there is one, follows.
    Rows lie in the partition of the first output shard that takes of them, in
    order of shards and, within one, of a pseudorandom order.  Null and empty
    texts have no words to take and give no rows; null sources are a source of
    their own; rows that repeat others, or have null ids, are taken row by row;
    an empty table gives no rows.
    """
    nulls = F.concat(*(F.col(c).isNull().cast("string") for c in docs.columns))
    # two hashes of all columns name a row; equal rows are told apart by where they are packed
    keyed = docs.withColumn("_row", F.xxhash64(nulls, *docs.columns)).withColumn("_row2", F.xxhash64(F.lit(SEED), nulls, *docs.columns))
    sizes = written(sized(keyed, "_row", "_row2"), "sizes")
    sources = written(source_targets(sizes, block_words=block_words), "sources")
    placed = packed(sizes, sources, block_words).select("doc_id", "_row", "_row2", "rank", "at", "size")
    slots = output_slots(sources, slots_per_shard).select("rank", "block", "pass", "shard").hint("merge")
    parts = fragments(placed, block_words).join(slots, ["rank", "block"])
    rows = parts.groupBy("doc_id", "_row", "_row2", "rank", "at", "size", "pass").agg(
        F.sum("words").alias("_taken"), F.sort_array(F.collect_list(F.struct("skip", "words"))).alias("_parts"), F.min("shard").alias("_shard")
    )
    rows = rows.select("_row", "_row2", F.col("size").alias("_size"), "_taken", "_parts", "_shard", F.xxhash64(F.lit(SEED), "rank", "at", "pass").alias("_order"))
    texts = keyed.dropDuplicates(["_row", "_row2"])
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.expr("array_join(flatten(transform(_parts, p -> slice(_words, cast(p.skip as int) + 1, cast(p.words as int)))), ' ')")
    out = rows.join(texts, ["_row", "_row2"]).withColumn("_words", F.when(F.col("_taken") < F.col("_size"), words))
    out = out.withColumn("text", F.when(F.col("_taken") == F.col("_size"), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, "_shard", "_order").repartition("_shard").sortWithinPartitions("_shard", "_order").select(docs.columns)
