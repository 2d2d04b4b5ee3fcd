"""MinHash near-dedup: signature-coordinate inverted join, verified on full shingle sets.

1. Documents with equal shingle sets form one class (a digest of the set); classes
   are numbered, as ids may be null or repeat with other texts.
2. A class has a MinHash signature of K coordinates.  Two sets of similarity
   0.8 agree in fewer than T of them with a chance of about 1e-7.
3. Classes are posted under their coordinate-value pairs, but only under the
   K - T + 1 rarest ones (the prefix: two signatures with T common pairs have
   one there), and pairs that one class alone has are skipped.
4. Inside a posting, collisions are counted over whole signatures, and stars over
   the pairs with T or more leave the task.  A class is in a posting of more than
   POSTING_CHUNK only if T - 1 more of its pairs are as common, so such a posting
   holds texts around one template; it becomes one star uncounted.
5. The stars' components are candidate groups.  A group's full sets meet in a
   task; a larger group's in chunks that share a few hubs.  Links are confirmed
   exactly, and again only stars leave.
6. A large group that its hubs leave in several parts is split again: its sets are
   posted under the first fifth of their shingles, those that no hub has first
   (at 0.8, two sets share one of these), and each posting is one star.  In what
   still hangs together, sets outside the largest part meet all others, chunk by
   chunk: the one step that may cost the product of two groups of sets, and only
   where neither hubs nor shingles tell them apart.

Every confirmed link between different sets lies in one candidate group, so
components of the stars are those of all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .membership import maybe_members
from .storage import drop, shuffled, slices, written
from .textscan import U64, Scan, constants, scan, segment_hash, sorted_unique_by_doc, windows, word_hash

SHINGLE = 5
#: Similarity as a ratio of integers, so that the comparison is exact.
SIMILARITY = (80, 100)
K, T = 48, 23
#: Rows of a posting, and sets of a candidate group, that one task compares; larger ones go the ways of steps 4 and 5.
POSTING_CHUNK = 512
GROUP_CHUNK = 1024
#: A group above so many bytes a set, times GROUP_CHUNK, goes to more chunks.
SET_BYTES = 16 << 10
HUBS = 8
EDGES = "a long, b long"
#: Parts that the rows of a posting above POSTING_CHUNK are dealt to.
SALTS = 32


def shingle_sets(s: Scan, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n + 1 borders) of the distinct shingles of each document; a short one is one shingle of all its words."""
    hashes = word_hash(s)
    words = np.diff(s.first)
    h, ok = windows(hashes, s.first, size)
    doc = s.doc_of_word()
    keep = np.flatnonzero(ok)
    short = np.flatnonzero((words > 0) & (words < size))
    values, owner = [h[keep]], [doc[keep]]
    for k in range(1, size):
        d = short[words[short] == k]
        if len(d):
            whole, _ = windows(hashes, s.first, k, seed=100 + k)
            values.append(whole[s.first[d]])
            owner.append(d)
    return sorted_unique_by_doc(np.concatenate(values), np.concatenate(owner), len(words))


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """n x K coordinates (uint32): the high half of the smallest a * x + b for each of K multipliers."""
    full = np.flatnonzero(first[1:] > first[:-1])
    out = np.zeros((len(first) - 1, K), np.uint32)
    a, b = constants(K, 21), constants(K, 22)
    for j in range(K):
        mixed = values * a[j] + b[j]
        mixed ^= mixed >> U64(32)
        mixed *= a[(j + 1) % K]
        if len(full):
            out[full, j] = np.minimum.reduceat(mixed, first[:-1][full]) >> U64(32)
    return out


def _described(size: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            values, first = shingle_sets(scan(b.column("text"), lower=True), size)
            sig = signatures(values, first)
            n = np.diff(first)
            keys = [hashlib.blake2b(values[x:y].tobytes(), digest_size=16).digest() if y > x else None for x, y in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(n.astype(np.int64)), pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "digest", "n_shingles", "key", "signature"])

    return describe


def stars(n: int, near) -> tuple[np.ndarray, np.ndarray]:
    """(first, other) index of each index that is not the first of its part of a similarity graph.

    near(i, rest) tells which of the indices `rest` are linked with i.  Searches
    depth first and compares with unvisited indices only: a group that hangs
    together costs about one comparison an index.
    """
    rest, heads, others = np.arange(n), [], []
    while len(rest):
        head, stack, rest = rest[0], [rest[0]], rest[1:]
        while stack and len(rest):
            hit = near(stack.pop(), rest)
            heads.append(np.full(hit.sum(), head))
            others.append(rest[hit])
            stack += rest[hit].tolist()
            rest = rest[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *heads]), np.concatenate([none, *others])


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted stream, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.array(batch.column(key).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
            if held and values[x] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = values[x]
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of a sorted stream, cut at borders between keys only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.searchsorted(values, values[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _posting_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings whose members are all near the first are settled together; the others are searched."""
    p, q = SIMILARITY
    for t in whole_groups(batches, "pair"):
        pair, ids, sizes = (t.column(c).to_numpy() for c in ("pair", "id", "n_shingles"))
        sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(-1, K)

        def near(i, j, sig=sig, sizes=sizes):
            could = q * np.minimum(sizes[i], sizes[j]) >= p * np.maximum(sizes[i], sizes[j])
            return could & ((sig[i] == sig[j]).sum(1) >= T)

        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        count = np.diff(np.append(first, len(pair)))
        head = np.repeat(first, count)
        hit = near(head, np.arange(len(pair)))
        simple = np.repeat(np.logical_and.reduceat(hit, first), count)
        at = np.flatnonzero(simple)
        yield edge_batch(ids[head[at]], ids[at])
        for x in first[~simple[first]].tolist():
            member = np.arange(x, np.searchsorted(pair, pair[x], side="right"))
            a, b = stars(len(member), lambda i, rest, m=member, near=near: near(np.full(len(rest), m[i]), m[rest]))
            yield edge_batch(ids[member[a]], ids[member[b]])


class SetGroup:
    """Exact similarities of one set with many, by counting shared members over sparse rows."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(x) for x in sets])
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        _, self.member = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(self.member.max() + 1 if len(self.member) else 1, bool)

    def near(self, i: int, rest: np.ndarray) -> np.ndarray:
        p, q = SIMILARITY
        hit = np.zeros(len(rest), bool)
        at = np.flatnonzero(q * np.minimum(self.n[rest], self.n[i]) >= p * np.maximum(self.n[rest], self.n[i]))
        if not len(at):
            return hit
        r = rest[at]
        mine = self.member[self.first[i] : self.first[i + 1]]
        self.mark[mine] = True
        lengths = self.n[r]
        ends = np.cumsum(lengths)
        place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(self.first[r], lengths)
        shared = np.add.reduceat(self.mark[self.member[place]], ends - lengths, dtype=np.int64)
        self.mark[mine] = False
        hit[at] = q * shared >= p * (lengths + self.n[i] - shared)
        return hit


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for g in grouped(batches, "task"):
        if g.num_rows < 2:
            continue
        ids, at = np.unique(g.column("id").to_numpy(), return_index=True)
        group = SetGroup([np.frombuffer(x, U64) for x in g.column("set").take(pa.array(at)).to_pylist()])
        a, b = stars(len(ids), group.near)
        yield edge_batch(ids[a], ids[b])


def _first_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix of each set: in an order that puts shingles of hubs last, as many as any similar set must meet."""
    p, q = SIMILARITY
    for g in grouped(batches, "task"):
        sets = [np.frombuffer(x, U64) for x in g.column("set").to_pylist()]
        is_hub = g.column("hub").to_pylist()
        common = np.unique(np.concatenate([np.zeros(0, U64), *(x for x, h in zip(sets, is_hub, strict=True) if h)]))
        mine = [i for i, h in enumerate(is_hub) if not h]
        first = []
        for i in mine:
            x, late = sets[i], np.isin(sets[i], common)
            first.append(np.concatenate((x[~late], x[late]))[: len(x) + 1 - -(-p * len(x) // q)])
        rows = pa.array(np.repeat(np.array(mine, np.int64), [len(x) for x in first]))
        member = np.concatenate([np.zeros(0, U64), *first]).view(np.int64)
        yield pa.RecordBatch.from_arrays([g.column(c).take(rows).combine_chunks() for c in ("grp", "id", "outside")] + [pa.array(member)], ["grp", "id", "outside", "member"])


def _sets(size: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of rows that repeat an id and its text, one in each task
        for b in slices(batches, "text"):
            rows = []
            for i, k in enumerate(zip(b.column("doc_id").to_pylist(), b.column("digest").to_pylist(), strict=True)):
                if k not in seen:
                    seen.add(k)
                    rows.append(i)
            b = b.take(pa.array(rows, pa.int64()))
            values, first = shingle_sets(scan(b.column("text"), lower=True), size)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array([values[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["doc_id", "digest", "set"])

    return build


def _tasks(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, "id")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """classes (id, n_shingles, signature) -> id, grp: groups outside of which no two classes agree in T coordinates."""
    p, q = SIMILARITY
    # below, every other set is further away than SIMILARITY
    classes = shuffled(classes.where(F.col("n_shingles") * (q - p) >= p))
    pairs = F.posexplode(F.expr(f"transform(sequence(0, {K - 1}), i -> substring(signature, 4 * i + 1, 4))"))
    posted = classes.select("id", pairs.alias("j", "v")).select("id", F.xxhash64("j", "v").alias("pair"))
    common = posted.groupBy("pair").count().where("count > 1")
    shared = posted.join(common, "pair")
    # a class's pairs that it alone has come first in the prefix; what is left of the prefix holds its rarest shared pairs
    own = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "pair"))).alias("pairs"))
    left = F.lit(K - T + 1) - (F.lit(K) - F.size("pairs"))
    prefix = shuffled(written(own.where(left > 0).select("id", F.explode(F.slice("pairs", F.lit(1), left)).alias("p")).select("id", F.col("p.pair").alias("pair")), "prefix"))
    held = shuffled(written(prefix.groupBy("pair").agg(F.count("*").alias("held"), F.min("id").alias("head")).where("held > 1"), "postings"))
    # the few large postings meet salted rows, so no task gets a whole one
    large = held.where(F.col("held") > POSTING_CHUNK).select("pair", "head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = prefix.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(large, ["pair", "salt"], "left")
    edges = dealt.where("head < id").select(F.col("head").alias("a"), F.col("id").alias("b"))
    small = dealt.where("head is null").select("pair", "id").join(held.where(F.col("held") <= POSTING_CHUNK).select("pair"), "pair").join(classes, "id")
    counted = _tasks(small.select("pair", "id", "n_shingles", "signature"), "pair").mapInArrow(_posting_stars, EDGES)
    groups = components(edges.unionByName(counted))
    drop(prefix, held)
    return groups.withColumnRenamed("component", "grp")


def class_sets(docs: DataFrame, classes: DataFrame, groups: DataFrame, size: int) -> DataFrame:
    """id, grp, n (members of the group), set of every member of a candidate group; classes (id, first) names a row of each."""
    counted = groups.join(groups.groupBy("grp").agg(F.count("*").alias("n")), "grp").join(classes.select("id", "first.doc_id", "first.digest"), "id")
    side = written(counted.select("id", "grp", "n", F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), F.xxhash64("doc_id", "digest").alias("row")), "members")
    # only texts of (nearly only) members become sets, and only sets are shuffled
    read = maybe_members(digested(docs).withColumn("row", F.xxhash64("doc_id", "digest")), "row", side.select("row")).drop("row")
    built = read.mapInArrow(_sets(size), "doc_id long, digest binary, set binary")
    sets = built.join(side, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest"))).groupBy("id", "grp", "n").agg(F.min("set").alias("set"))
    out = written(sets, "sets")
    drop(side)
    # groups whose sets are long count for more, so that chunks are bounded in bytes as well
    heavy = out.groupBy("grp").agg(_load(F.lit(0)).alias("load")).where(F.col("load") > GROUP_CHUNK)
    if heavy.isEmpty():
        return out
    weighed = out.join(heavy, "grp", "left").withColumn("n", F.greatest("n", F.coalesce("load", F.lit(0)))).drop("load")
    weighed.scratch_path = out.scratch_path
    return weighed


def _load(count: Column, where: Column | None = None) -> Column:
    """A group's number of sets, or of SET_BYTES of them where that is more."""
    size = F.octet_length("set") if where is None else F.when(where, F.octet_length("set"))
    return F.greatest(count.cast("long"), F.ceil(F.coalesce(F.sum(size), F.lit(0)) / SET_BYTES))


def with_hubs(sets: DataFrame) -> DataFrame:
    """Deal sets (id, grp, n, ...) to tasks: groups of up to GROUP_CHUNK whole, larger ones in chunks that get the same few hubs (`hub`)."""
    parts = F.ceil(F.col("n") / GROUP_CHUNK).cast("int")
    large = sets.where(F.col("n") > GROUP_CHUNK)
    nth = lambda k: F.min(F.struct(F.xxhash64("id", F.lit(k)), "id"))["id"]
    hubs = large.groupBy("grp").agg(F.array_distinct(F.array(*map(nth, range(HUBS)))).alias("hubs")).select(F.explode("hubs").alias("id"))
    spread = large.join(hubs, "id", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("hub", F.lit(True))
    own = sets.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("hub", F.lit(False))
    return own.unionByName(spread).withColumn("task", F.xxhash64("grp", "part")).drop("part")


def confirmed_links(sets: DataFrame) -> DataFrame:
    """Stars (a, b) over the exact links inside the candidate groups; sets (id, grp, n, set)."""
    return written(_tasks(with_hubs(sets).select("task", "id", "set"), "task").mapInArrow(_confirmed, EDGES), "links")


def remaining_links(sets: DataFrame, links: DataFrame) -> DataFrame:
    """`links` and stars over the exact links between the parts that they leave of groups above GROUP_CHUNK."""
    large = sets.where(F.col("n") > GROUP_CHUNK)
    if large.isEmpty():
        return links
    so_far = components(links)
    named = written(large.join(so_far, "id", "left").withColumn("component", F.coalesce("component", "id")), "named")
    main = named.groupBy("grp", "component").count().groupBy("grp").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("components")).where("components > 1")
    open_sets = named.join(main.select("grp", "main"), "grp").withColumn("outside", F.col("component") != F.col("main"))
    open_sets = written(open_sets.select("id", "grp", "n", "set", "outside"), "open")
    tasks = _tasks(with_hubs(open_sets).select("task", "grp", "id", "outside", "hub", "set"), "task")
    prefix = shuffled(written(tasks.mapInArrow(_first_members, "grp long, id long, outside boolean, member long"), "prefix"))
    heads = prefix.groupBy("grp", "member").agg(F.min("id").alias("head"), F.count("*").alias("held"), F.max("outside").alias("any")).where("any and held > 1")
    finer = components(prefix.join(heads, ["grp", "member"]).select(F.col("head").alias("a"), F.col("id").alias("b")))
    split = open_sets.drop("grp", "n").join(finer.withColumnRenamed("component", "grp"), "id")
    counts = split.groupBy("grp").agg(_load(F.count("*")).alias("n"), _load(F.sum(F.col("outside").cast("int")), F.col("outside")).alias("n_out")).where("n_out > 0")
    met = written(split.join(counts, "grp"), "met")
    parts, pieces = (F.ceil(F.col(c) / GROUP_CHUNK).cast("int") for c in ("n", "n_out"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    chunks = met.withColumn("part", mine(parts)).withColumn("piece", every(pieces))
    probes = met.where("outside").withColumn("piece", mine(pieces)).withColumn("part", every(parts))
    both = chunks.unionByName(probes).withColumn("task", F.xxhash64("grp", "part", "piece"))
    found = written(_tasks(both.select("task", "id", "set"), "task").mapInArrow(_confirmed, EDGES), "more")
    drop(so_far, named, open_sets, prefix, finer, met)
    return links.unionByName(found)


def digested(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"))


def judged(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """`near_duplicates` with the digest of each row's text."""
    described = written(digested(docs).mapInArrow(_described(size), "doc_id long, digest binary, n_shingles long, key binary, signature binary"), "described")
    # the first row of a class or component: the smallest doc_id, null ids last, then by digest
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    of_key = described.where("key is not null").groupBy("key").agg(F.min(row).alias("first"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature"))
    classes = shuffled(written(of_key.withColumn("id", F.monotonically_increasing_id()), "classes"))
    groups = candidate_groups(classes.select("id", "n_shingles", "signature"))
    sets = class_sets(docs, classes, groups, size)
    of_class = components(remaining_links(sets, confirmed_links(sets)))
    drop(sets)
    firsts = of_class.join(classes.select("id", "first"), "id").groupBy("component").agg(F.min("first").alias("linked_first"))
    named = classes.select("key", "id", "first").join(of_class.join(firsts, "component").select("id", "linked_first"), "id", "left").select("key", F.coalesce("linked_first", "first").alias("first"))
    out = described.select("doc_id", "digest", "n_shingles", "key").join(named, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept = F.col("key").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest")))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(kept, F.lit(True)).alias("kept"), "digest")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row per row.

    Words are runs of other than space and 0x09-0x0D, A-Z lower-cased; a set
    holds the distinct `size`-word shingles, or all words as one where there
    are fewer.  Rows are linked where sets are similar to 80 % or more.
    component_id is the smallest doc_id reachable, null where no row reached
    has one; kept tells whether the row is the first of its component (by
    doc_id, null ids last, then by the digest of the text).  Null and empty
    texts have no set and are linked with nothing.  Rows that repeat an id with
    another text are compared and kept apart; rows that repeat both are kept
    together.
    """
    return judged(docs, size).drop("digest")


def deduplicated(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each component, with all columns of docs; of rows that repeat an id and its text, the first by all columns.

    Rows with neither an id nor words are no repeats of each other and all stay.
    """
    rows = judged(docs, size).where("kept")
    keep = written(rows.groupBy(F.col("doc_id").alias("_kept"), F.col("digest").alias("_digest")).agg(F.count("*").alias("_n"), F.max("n_shingles").alias("_words")), "kept")
    single = (F.col("_n") == 1) | (F.col("_kept").isNull() & (F.col("_words") == 0))
    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    held = lambda side: docs.join(side, F.col("doc_id").eqNullSafe(F.col("_kept")) & (digest == F.col("_digest")), "left_semi")
    once = held(keep.where(single))
    several = keep.where(~single)
    if several.isEmpty():
        return once
    by_row = Window.partitionBy("doc_id", digest).orderBy(*(F.col(c) for c in docs.columns))
    return once.unionByName(held(several).withColumn("_row", F.row_number().over(by_row)).where("_row = 1").drop("_row"))
