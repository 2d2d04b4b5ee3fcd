"""Cases that once went wrong: colliding hashes, wide ids, clashing columns, odd secrets, many rules, broken archives."""

import hashlib
import random
import re
import string
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rosterlake.llm import mixing, near_dedup, quality_rules, secrets, storage, substring_dedup, token_store, url_filter, warc

SF = "/root/testdata/sf0.001"
WIDE = [-(2**63) + 5, 2**63 - 1, 0, 7, 2**50]


def thue_morse(n, flip=0):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 2048])
def test_words_that_collide_in_polynomials_are_told_apart(spark, n):
    x, y = thue_morse(n), thue_morse(n, 1)
    lines = spark.createDataFrame([(1, f"{x} q"), (2, f"{y} q"), (3, f"{x} z\n{y} z\n")], "doc_id long, text string")
    near = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(lines, 2).collect()}
    assert near == {1: 1, 2: 2, 3: 3}
    stats = quality_rules.document_stats(lines.toArrow().column("text").combine_chunks())[0]
    assert stats["n_dup_lines"].tolist() == [0, 0, 0]
    tail = " ".join(f"t{i}" for i in range(19))
    pair = spark.createDataFrame([(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{x} {tail}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(pair, 1).collect()} == {1: 0, 2: 0, 3: 20}


def test_tokens_of_colliding_words():
    import pyarrow as pa

    path = pytest.importorskip("public_tokenizers").path(token_store.TOKENIZER)
    texts = [f"a {thue_morse(n, flip)} b" for n in (32, 64, 512) for flip in (0, 1)]
    encoder = token_store.Encoder(path)
    ids, first = encoder.encode(pa.array(texts))
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want


def test_wide_and_outlying_ids(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 9, "s") for i in WIDE], "doc_id long, text string, source string")
    assert {r.doc_id: r.taken for r in mixing.taken_words(docs, block_words=3).collect()}.keys() == set(WIDE)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {r.page_id for r in warc.archived_pages(pages).collect()} == set(WIDE)
    path = pytest.importorskip("public_tokenizers").path(token_store.TOKENIZER)
    rows = sorted(token_store.encoded_documents(docs, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(WIDE)


def test_one_outlier_does_not_fill_a_shard(spark):
    ids = spark.range(20_000).unionByName(spark.createDataFrame([(2**50,)], "id long"))
    got, shards = storage.range_shards(ids, "id", F.lit(1), 1000)
    counts = [r["count"] for r in got.groupBy("shard").count().orderBy("shard").collect()]
    assert len(counts) == shards and max(counts) <= 3000 and sum(counts) == 20_001
    firsts = got.groupBy("shard").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("shard").collect()
    assert all(x.b < y.a for x, y in zip(firsts, firsts[1:], strict=False))


def test_mix_with_clashing_columns_and_shards(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 40)), f"s{i % 3}", i, None) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, words string")
    mixed = mixing.mixed_documents(docs, 8, 16)
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs, 8, 16).collect()}
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
    assert got == {i: n for i, n in taken.items() if n}
    sources = mixing.source_targets(mixing.sized(docs), block_words=8)
    counts, slots = mixing.shard_counts(sources, 16).collect(), {r["rank"]: r.slots for r in sources.collect()}
    for rank, n in slots.items():
        drawn = [r.n for r in counts if r["rank"] == rank]
        assert sum(drawn) == n and len(set(drawn)) > 1  # exact in total, drawn by shard
    again = mixing.shard_counts(sources, 16).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, counts))
    other = mixing.shard_counts(sources, 16, seed=18).collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, counts))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r'password = "hun\"ter2\"hunter2X"', [r"hun\"ter2\"hunter2X"]),
        ('private_key = str("Zx9abcQ81kfj3")', ["Zx9abcQ81kfj3"]),
        ("cfg['private_key'] = 'Zx9abcQ81kfj3'", ["Zx9abcQ81kfj3"]),
        ("<private_key>Zx9abcQ81kfj3</private_key>", ["Zx9abcQ81kfj3"]),
        ("key:\n  private_key: |\n    MIIEowIB\n    Zx9abcQ8\nb: 1", ["MIIEowIB\n    Zx9abcQ8"]),
        ('BASE = "Zx9abcQ81kfj3"\nprivate_key = "${BASE}tail"', ["Zx9abcQ81kfj3", "tail"]),
        ('pwd = "" + "Zx9abcQ81kfj3"', ["Zx9abcQ81kfj3"]),
        ("private_key_" + "x" * 200 + ' = "Zx9abcQ81kfj3"', ["Zx9abcQ81kfj3"]),
        ("a = b; c: d <e>f</e>", []),
    ],
)
def test_assignment_forms(text, want):
    assert [text[s:e] for s, e in secrets.literal_spans(text)] == want


def slow_base(text):
    """The contract's base spans, character by character."""
    ascii_lower = lambda c: chr(ord(c) + 32) if "A" <= c <= "Z" else c
    value, upper, hexes = set(string.ascii_letters + string.digits + "+/_.=-"), set(string.ascii_uppercase + string.digits), set("0123456789abcdef")
    low, out = "".join(map(ascii_lower, text)), []

    def run(i, chars):
        j = i
        while j < len(text) and text[j] in chars:
            j += 1
        return j

    def assign(i):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, i):
                j = i + len(word)
                j += text[j : j + 1] in ("'", '"')
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "="):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ("'", '"')
                if run(j, value) > j:
                    return run(j, value), run(j, value) - j >= 8
        return None

    finders = (assign, lambda i: (run(i + 4, upper), run(i + 4, upper) - i >= 16) if text.startswith("AKIA", i) and run(i + 4, upper) > i + 4 else None, lambda i: (run(i, hexes), run(i, hexes) - i >= 32) if text[i] in hexes else None)
    for kind, find in enumerate(finders):
        i = 0
        while i < len(text):
            hit = find(i)
            if hit and hit[1]:
                out.append((i, kind, hit[0]))
            i = hit[0] if hit else i + 1
    return sorted(out)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_base_spans_equal_a_slow_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = random.Random(3)
    pieces = ["password", "Secret", "api_key", "apikey", "token", ' = "', ": ", "=", "'", "AKIA", "ABCDEF0123456789", "deadbeef", "x", " ", "\n", "Zx9-_/+.=", "é", "ſ"]
    made = [(10**6 + i, "".join(rng.choices(pieces, k=rng.randrange(40)))) for i in range(400)] + [(10**7, None)]
    every = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    texts = dict(map(tuple, every.collect()))
    for r in secrets.scan_documents(every).collect():
        want = slow_base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(secrets.spell(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x[1] for x in want) for k in range(3))
        assert set(secrets.spell(want).split(",")) - {""} <= set(r.spans.split(","))


def test_many_rules_against_every_regex(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(60)]
    patterns = {rng.choice(("||{a}.com/{b}/", "^{a}^*^{b}^", "{a}^", "/{a}*{b}", "||{a}.org^")).format(a=rng.choice(names), b=rng.choice(names)) for _ in range(400)}
    rules = [(p, rng.choice(("allow", "block")), None, 0) for p in sorted(patterns)] + [("*n1*n2*", "block", None, 0)]
    table = spark.createDataFrame(rules, "pattern string, verdict string, label string, rank int")
    urls = [(i, f"http://{rng.choice(names)}.{rng.choice(('com', 'org'))}/{rng.choice(names)}/{rng.choice(names)}-{rng.choice(names)}.html", "c") for i in range(150)]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string, verdict string"), table).collect()}
    border = r"(?:(?<![\w%])|(?![\w%]))"
    for i, url, _ in urls:
        target, best = url.split("://")[1], None
        for pattern, verdict, _, _ in rules:
            bound = pattern.startswith("||")
            body = "".join(border if c == "^" else ".*" if c == "*" else re.escape(c) for c in pattern.removeprefix("||"))
            if re.search((r"^(?:[^/?#]*\.)?" if bound else "") + body, target, re.DOTALL | re.ASCII):
                best = max(best or (0, False, "", ""), (len(pattern), verdict == "allow", pattern, verdict))
        assert got[i] == (best[3] if best else "allow"), url


def test_archive_is_verified(spark):
    pages = spark.createDataFrame([(i, "u", "text " * i) for i in range(40)] + [(3, "u", "text text text "), (50, "v", "é" * 300_000)], "page_id long, url string, html string")
    folder, manifest = warc.write_pages(pages, file_bytes=900, shard_bytes=1 << 20)
    assert manifest.select("shard").distinct().count() == 1 and manifest.count() > 3  # rolled inside a shard
    assert warc.read_pages(folder, manifest).count() == 42
    with pytest.raises(Exception, match="manifest"):
        warc.read_pages(folder, manifest.withColumn("sha1", F.lit("0"))).count()
