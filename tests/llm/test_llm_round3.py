"""SentencePiece coding against the library, whitening against numpy, phrases against plain Python."""

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import phrases, sentence_pieces, whitening

DOCS = "doc_id long, text string, lang string, ids int, phrase string"


@pytest.fixture(scope="module")
def piece_model():
    sp = pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path(sentence_pieces.MODEL)
    return path, sp.SentencePieceProcessor(model_file=path)


ODD = [None, "", " ", "  a", "a  b ", "\n", "a\nb", "▁x", "\x00z", "<s>hi</s>", "<0x41> </s>", "é日本́", "a\xa0b", "ﬁ", " " * 17 + "x", " " * 100, "\n\n\n", "\t\ta", "😀😀 x", "x" * 5000, "word, " * 4000]


def same_as_library(encoder, decoder, sp, texts):
    ids, border = encoder.encode(pa.array(texts, pa.string()))
    want = [sp.encode(x or "", add_eos=True) for x in texts]
    assert [ids[a:b].tolist() for a, b in zip(border[:-1], border[1:], strict=True)] == want
    assert [x.decode() for x in decoder.decode(ids, border)] == [sp.decode(x) for x in want]


def test_pieces_of_odd_and_random_texts(piece_model):
    path, sp = piece_model
    model = sentence_pieces.load(path)
    encoder, decoder = sentence_pieces.Encoder(model), sentence_pieces.Decoder(model)
    same_as_library(encoder, decoder, sp, ODD)
    rnd, pieces = random.Random(5), list(model.ids)
    letters = "aabcdeinorst  ▁,.\n\té日😀A0_-=/<>()"
    for _ in range(40):
        same_as_library(encoder, decoder, sp, ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(40)])
        same_as_library(encoder, decoder, sp, ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(12))) for _ in range(40)])
        same_as_library(encoder, decoder, sp, ["".join(chr(rnd.choice([rnd.randrange(1, 0x300), rnd.randrange(0x3000, 0xD7FF)])) for _ in range(rnd.randrange(30))) for _ in range(20)])
    encoder.known.update({bytes([k]): 0 for k in range(3)})
    sentence_pieces.MEMORY, held = 10, sentence_pieces.MEMORY  # forgetting changes nothing
    try:
        same_as_library(encoder, decoder, sp, ODD)
        same_as_library(encoder, decoder, sp, ODD)
    finally:
        sentence_pieces.MEMORY = held


def test_decoding_of_any_ids(piece_model):
    path, sp = piece_model
    decoder, rnd = sentence_pieces.Decoder(sentence_pieces.load(path)), random.Random(6)
    for _ in range(800):
        ids = [rnd.choice([rnd.randrange(3, 259), rnd.randrange(0, 32000), rnd.randrange(0, 3)]) for _ in range(rnd.randrange(12))]
        assert decoder.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode() == sp.decode(ids)


def test_piece_pairs_are_those_of_merging(piece_model):
    """The compatibility test against merging the two tokens' characters."""
    path, sp = piece_model
    model = sentence_pieces.load(path)
    encoder, rnd = sentence_pieces.Encoder(model), random.Random(7)

    def merged(parts):
        while True:
            found = [(model.rank[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in model.rank]
            if not found:
                return parts
            i = min(found)[1]
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]

    short = [p for p in model.rank if len(p) < 4 and p.isascii()]
    for _ in range(4000):
        a, b = rnd.choice(short), rnd.choice(short)
        assert encoder.compatible(a, b) == (merged(list(a + b)) == [a, b]), (a, b)


def test_piece_documents(spark, piece_model):
    path, sp = piece_model
    rows = [(i, t, "en", 1, "clash") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([*rows, rows[5], (None, "no id", None, None, None)], DOCS)
    got = sentence_pieces.digests(sentence_pieces.round_trip(docs, path)).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        ids = sp.encode((ODD[r.doc_id] or "") if r.doc_id is not None else "no id", add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    coded = sentence_pieces.encode_documents(docs, path, end_id=False)
    assert {r.doc_id: r.ids for r in coded.collect()}[18] == sp.encode(ODD[18])
    back = {r.doc_id: r.text for r in sentence_pieces.decode_documents(coded.withColumn("ids", F.expr("if(doc_id = 3, null, ids)")), path).collect()}
    assert back[4] == "a  b " and back[3] == "" and back[None] == "no id"
    assert sentence_pieces.round_trip(docs.limit(0), path).count() == 0


def test_models_that_the_table_cannot_hold(tmp_path):
    (tmp_path / "x.model").write_bytes(b"")
    with pytest.raises(Exception):  # noqa: B017
        sentence_pieces.load(str(tmp_path / "x.model"))


def brute_whitening(vectors):
    """Exact sums in fractions, eigenvectors of numpy."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    z = np.array([[float(Fraction(n * r[i] - sums[i], n)) for i in range(d)] for r in x])
    values, basis = np.linalg.eigh(z.T @ z / n)
    deviation = [sum((n * r[i] - sums[i]) ** 2 for i in range(d)) for r in x]
    return z, values[::-1], basis[:, ::-1], deviation


def test_whitening(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12)) * np.linspace(0.02, 0.4, 12)
    good = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(300, 12)) @ mix + 0.3]
    good[7] = good[8]
    rows = [(i, v, i % 3) for i, v in enumerate(good)]
    odd = [(900, None, 0), (901, [None] + good[0][1:], 0), (902, [math.nan] + good[0][1:], 0), (903, [math.inf] + good[0][1:], 0), (904, [1.0], 0), (905, [], 0), (906, [1e30] + good[0][1:], 0)]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, n int").repartition(5)
    got = collections.defaultdict(dict)
    for r in whitening.whiten(table).collect():
        got[r.vec_id][r.component] = r
    z, values, basis, deviation = brute_whitening(good)
    assert got.keys() == set(range(300)) and all(set(x) == set(range(1, 9)) for x in got.values())
    w = np.array([[got[i][c].whitened for c in range(1, 9)] for i in range(300)])
    want = z @ basis[:, :8] / np.sqrt(values[:8])
    assert np.allclose(np.abs((w * want).sum(0)), (want * want).sum(0), rtol=1e-10)
    assert np.allclose(w * np.sign((w * want).sum(0)), want, atol=1e-9)
    assert [got[i][1].deviation for i in range(300)] == deviation
    assert all(abs(got[0][c].explained - values[c - 1] / values.sum()) < 1e-12 for c in range(1, 9))
    centred = w - w.mean(0)
    assert got[0][1].n == 300 and abs(got[0][1].identity_error - np.abs(centred.T @ centred / 300 - np.eye(8)).max()) < 1e-12 < 1e-4
    # null and repeated ids come row by row, the same fit in any partitioning
    twice = spark.createDataFrame([(None if i % 2 else 1, v) for i, v in enumerate(good)], "vec_id long, embedding array<double>")
    assert whitening.whiten(twice.coalesce(1), 2).count() == 600


def test_whitening_of_few_rows_and_low_rank(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])] * 9, kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [i / 4, i / 2, 1.0]) for i in range(5)], kind)).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in line)
    big = whitening.whiten(spark.createDataFrame([(i, [float(i) * 2.0**36, 1.0 * (i % 2)]) for i in range(6)], "vec_id long, embedding array<double>"), 1).collect()
    assert len(big) == 6 and all(r.deviation is None or r.deviation >= 0 for r in big) and big[0].identity_error < 1e-9


def test_components_equal_those_of_numpy():
    rng = np.random.default_rng(4)
    for d in (1, 2, 5, 33, 64):
        a = rng.normal(size=(3 * d, d)) * np.logspace(0, -4, d)
        v = a.T @ a
        values, vectors = whitening.components_of(v)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=1e-9)
        assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13)
        assert np.allclose(v @ vectors, vectors * values, atol=1e-13 * values[0])
    values, vectors = whitening.components_of(np.ones((4, 4)))
    assert len(values) == 1 and abs(values[0] - 4) < 1e-14


def brute_phrases(rows, least, longest, top, percent=50):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {p[i:j] for p, b in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * b >= percent * f[p[i:j]]}
        found = []
        for p, a in cand.items():
            if p not in dropped:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p), f[p[:k]], f[p[k:]]))
        found.sort(key=lambda x: (x[0], x[1], x[2].encode()))
        out += [(lang, i, p, -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("share", "bits", "longest", "least"), [(2, 1 << 20, 3, 3), (0, 1 << 20, 3, 3), (3, 64, 3, 2), (1, 1 << 16, 4, 2), (8, 1 << 26, 3, 10), (4, 1 << 18, 2, 3)])
def test_phrases(spark, share, bits, longest, least):
    """Samples, failures of the border and full bitmaps give the rows of plain counting."""
    rnd = random.Random(share * 7 + longest)
    common = ["the", "The", "of", "new", "york", "New", "city", "é", "日本", "x\xa0y", "a-b", "it's"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", " ! "]
    texts = [None, "", " ", "..", "new york city", "z " * 3000] + ["".join(rnd.choice(common) + rnd.choice(seps) for _ in range(rnd.randrange(60))) for _ in range(150)]
    rows = [(rnd.choice(["en", "de", None, "und", "en"]), t) for t in texts]
    rows += [("en", "in a row of words " * 2)] * 40
    docs = spark.createDataFrame([(i if i % 9 else None, t, g, i, "clash") for i, (g, t) in enumerate(rows)], DOCS).repartition(3)
    got = phrases.collocations(docs, least, longest, 25, share=share, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, longest, 25)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "one two", "en", 1, ""), (None, None, None, None, None)], DOCS)).count() == 0


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_000, 5_000_000_000_000, 7_000_000_000_000)], "a long, l long, r long")
    assert df.select(phrases._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first().s == 10**6 * 9 // 35


BASE64 = "Zx9abcQ81kfj3Qw8"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        # values are scored whole, however they are put together
        (f'pwd = "{"x" * 1100}{BASE64}"', [f"{'x' * 1100}{BASE64}"]),
        (f'a = "{"x" * 1100}"\npwd = a + "{BASE64}"', ["x" * 1100, BASE64]),
        ('a = "xxxxxxxx"\npassword = a + "xxxxxxxxxx"', []),
        # no bound on the length of a form
        (f"<{'n' * 300}_password>{BASE64}</{'n' * 300}_password>", [BASE64]),
        (f'<password {"a" * 1200}="b">{BASE64}</password>', [BASE64]),
        (f'password: Box<{"T" * 90}> = "{BASE64}"', [BASE64]),
        (f'password: {"T" * 90} = "{BASE64}"', [BASE64]),
        (f'password = a(b(c(d(e(f("{BASE64}"))))))', [BASE64]),
        # constants set further down
        (f'password = A + "tail"\nA = "{BASE64}"', ["tail", BASE64]),
        (f'password = "${{A}}tail"\nA = "{BASE64}"', ["tail", BASE64]),
        # strings of several kinds
        (f'password = """{BASE64}"""', [BASE64]),
        (f"password = '''{BASE64}'x\n'''", [f"{BASE64}'x\n"]),
        (f'a = "{BASE64}"\npassword = f"{{a}}tail{{a!r:>10}}"', [BASE64, "tail"]),
        (f'a = "{BASE64}"\npassword = rf"pre-{{a}}"', [BASE64, "pre-"]),
        ('password = "Zx9abcQ8" "1kfj3Qw8"', ["Zx9abcQ8", "1kfj3Qw8"]),
        ('password = (\n    "Zx9abcQ8"\n    "1kfj3Qw8"\n)', ["Zx9abcQ8", "1kfj3Qw8"]),
        ("$password = 'Zx9abcQ8' . '1kfj3Qw8';", ["Zx9abcQ8", "1kfj3Qw8"]),
        (f'a = "{BASE64}"\npassword = "p-%s-%d" % (a, b)', [BASE64, "p-", "-%d"]),
        (f'a = "{BASE64}"\npassword = "p-{{}}".format(a)', [BASE64, "p-"]),
        # tuples
        (f'user, password = "some-user-name", "{BASE64}"', [BASE64]),
        (f'password, user = "{BASE64}", "some-User-name1"', [BASE64]),
        # figures about secrets, and names that only hold none
        ("token_count: 1234567890123456", []),
        (f'description = "{BASE64}"', []),
    ],
)
def test_secret_forms(text, want):
    from rosterlake.llm import secrets

    assert sorted(text[s:e] for s, e in secrets.literal_spans(text)) == sorted(want)


def test_secrets_planted_in_sources():
    """Recall and precision over generated files of several syntaxes, each with known secrets among harmless pairs."""
    from rosterlake.llm import secrets

    rnd = random.Random(8)
    alphabet = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    word = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    names = ["db_password", "clientSecret", "API_KEY", "private_key", "authToken", "signing_key"]
    harmless = ["title", "color", "path", "user_name", "version", "keyboard_layout"]
    forms = ["{n} = '{v}'\n", '{n}: "{v}"\n', '"{n}": "{v}",\n', "export {n}={v}\n", "<{n}>{v}</{n}>\n", "cfg['{n}'] = \"{v}\"\n", "{n} := `x`; {n} = \"{v}\"\n", '  {n} => "{v}"\n', "X{k} = '{v}'\n{n} = X{k}\n", '{n}: str = call("{v}")\n']
    planted = told = right = 0
    for k in range(300):
        text, want = "", set()
        for i in range(12):
            secret = rnd.random() < 0.4
            v = word(20)
            text += rnd.choice(forms).format(n=rnd.choice(names if secret else harmless), v=v, k=i)
            want |= {v} if secret else set()
        got = {text[s:e] for s, e in secrets.literal_spans(text)}
        planted, told, right = planted + len(want), told + len(got), right + len(want & got)
    assert right / planted > 0.99 and right / told > 0.99


@pytest.mark.parametrize("text", ["a=b(" * 60_000 + "password", 'password="""' * 40_000, "password: a<" * 40_000, "a, " * 80_000 + 'password = "x"', "<password " * 40_000, "password" * 60_000, 'f"{' * 60_000 + "token=", "x = a + " * 60_000 + "password", "password: |\n" * 40_000, "password | a " * 40_000, '"a" ' * 60_000 + "password=", 'password = "a" ' + '"b" ' * 60_000, "a = a\n" * 50_000 + "password = a\n", 'password = ("%s" % (' * 20_000])
def test_secret_scan_is_linear(text):
    import time

    from rosterlake.llm import secrets

    began = time.process_time()
    secrets.literal_spans(text)
    assert time.process_time() - began < 5
