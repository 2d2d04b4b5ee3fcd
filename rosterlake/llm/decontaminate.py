"""Benchmark decontamination: containment MinHash, size-partitioned and verified (DataFrame operations only).

Items are partitioned by size, in powers of two of their shingle count.  The
MinHash sketch of an item is its k smallest shingle hashes, with k from the
largest size of its partition: at containment c, at most (1 - c) n shingles of
an item may be missing, so with k above that number a document that holds the
item meets the sketch, however long the document is.  Candidates are verified
on the shingles themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
CONTAINMENT = 0.8
#: Tables of at most this many bytes, measured, are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST_BYTES = 48 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def grams(w: Column, size: int) -> Column:
    """The runs of `size` consecutive words, as an array of structs."""
    n = F.greatest(F.size(w) - (size - 1), F.lit(0))
    return F.arrays_zip(*(F.slice(w, i + 1, n).alias(f"w{i}") for i in range(size)))


def gram_hashes(w: Column, sizes: list[int]) -> Column:
    hashed = lambda k: F.transform(grams(w, k), lambda x: F.xxhash64(F.lit(k), x))
    return F.concat(*map(hashed, sizes))


def gram_texts(w: Column, size: int) -> Column:
    return F.array_distinct(F.transform(grams(w, size), lambda x: F.concat_ws(" ", *(x[f"w{i}"] for i in range(size)))))


def item_table(items: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """items (item_id, text) -> item_id, gram (words a shingle), texts (distinct shingles), n, hashes (distinct), item.

    A row for each item_id and text; `item` numbers the rows, as ids may be null
    or repeat with other texts.  The numbers hold once the table is written.
    """
    w = items.select("item_id", "text").distinct().select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    per_size = []
    for k in range(1, shingle + 1):
        here = w.where(F.size("w") == k if k < shingle else F.size("w") >= shingle)
        per_size.append(here.select("item_id", F.lit(k).alias("gram"), gram_texts(F.col("w"), k).alias("texts"), F.array_distinct(gram_hashes(F.col("w"), [k])).alias("hashes")))
    out = per_size[0]
    for x in per_size[1:]:
        out = out.unionByName(x)
    return out.withColumn("n", F.size("texts")).withColumn("item", F.monotonically_increasing_id())


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """item_table -> item, hash, need (shingles a document must have), least (sketch hashes it must meet)."""
    need = F.ceil(F.col("n") * F.lit(containment) - F.lit(1e-9)).cast("int")
    partition = F.floor(F.log2(F.col("n"))).cast("int")
    largest = F.pow(F.lit(2.0), partition + 1) - 1
    k = F.least((largest - F.ceil(largest * F.lit(containment)) + 1).cast("int"), F.size("hashes"))
    shaped = items.withColumn("need", need).withColumn("k", k).withColumn("least", F.greatest(F.lit(1), F.col("k") - (F.col("n") - F.col("need"))))
    return shaped.select("item", "need", "least", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), F.col("k"))).alias("hash"))


def small_enough(df: DataFrame, size: Column):
    """F.broadcast where the rows of df, by their `size` in bytes, are within the bound; else no hint."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast if total <= MAX_BROADCAST_BYTES else lambda frame: frame


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def keyed_leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """`find_leaks` with the digest `key` of the document's text, and not reduced to distinct rows."""
    table = written(item_table(items, shingle), "items")
    sizes = sorted(r["gram"] for r in table.select("gram").distinct().collect()) or [shingle]  # `shingle` numbers at most
    index = written(sketches(table, containment), "sketches")
    of_index = small_enough(index, F.lit(40))
    of_table = small_enough(table, F.aggregate("texts", F.lit(100), lambda n, x: n + F.octet_length(x) + 16))
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), words(F.col("text")).alias("w"))
    probes = keyed.select("key", F.size("w").alias("n_words"), F.explode(gram_hashes(F.col("w"), sizes)).alias("hash"))
    met = probes.join(of_index(index), "hash").where(F.col("n_words") >= F.col("need")).select("key", "item", "least", "hash").distinct()
    candidates = written(met.groupBy("key", "item").agg(F.count("*").alias("met"), F.first("least").alias("least")).where("met >= least").select("key", "item"), "candidates")
    near = small_enough(candidates, F.lit(80))
    pairs = keyed.join(near(candidates), "key").join(of_table(table.select("item", "item_id", "gram", "texts", "n")), "item")
    mine = gram_texts(F.col("w"), shingle)
    for k in range(1, shingle):
        if k in sizes:
            mine = F.when(F.col("gram") == k, gram_texts(F.col("w"), k)).otherwise(mine)
    shared = pairs.select("doc_id", "key", "item_id", F.col("n").cast("long").alias("n_item"), F.size(F.array_intersect("texts", mine)).cast("long").alias("n_shared"))
    held = shared.where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(containment) - F.lit(1e-9)))
    return held.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def find_leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """docs (doc_id, text, ...), items (item_id, text, ...) -> a row for each document and item it holds.

    doc_id, item_id, n_item (distinct shingles of the item), n_shared (those
    that the document has) and their ratio, 0.8 or more.  Words are runs of
    other than space and 0x09-0x0D, lower-cased.  An item with fewer than
    `shingle` words is one shingle of all its words; null and empty texts hold
    nothing and are held by nothing.  Rows with equal or null ids but different
    texts are judged apart, in docs and in items; equal result rows are given
    once.
    """
    return keyed_leaks(docs, items, shingle, containment).drop("key").distinct()


def clean_documents(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item; rows that share an id are judged apart.

    Null and empty texts hold nothing and stay; so do all rows where items is
    empty.  Rows that repeat both id and text stay or go together.
    """
    leaks = written(keyed_leaks(docs, items, shingle, containment).select(F.col("doc_id").alias("_leak"), F.col("key").alias("_leak_key")).distinct(), "leaks")
    side = small_enough(leaks, F.lit(80))
    return docs.join(side(leaks), F.col("doc_id").eqNullSafe(F.col("_leak")) & (text_key(F.col("text")) == F.col("_leak_key")), "left_anti")
