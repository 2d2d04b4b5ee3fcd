"""Rows that repeat, lack an id or come in an empty table, for the operators and the pipeline."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rosterlake.llm import decontaminate, mixing, quality_classifier, quality_rules, token_store, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = " ".join(f"word{i} and then" for i in range(40)) + "."


def corpus(spark):
    """Good, repeated, null and odd rows of a small corpus, and its labels."""
    good = [(i, TEXT.replace("word", f"w{i}x"), "en", f"s{i % 3}", 1) for i in range(30)]
    odd = [(None, None, None, None, None), (None, TEXT, "en", None, 5), (100, "", "de", "s1", 0), (101, None, "de", "s1", None), (102, "short", "en", "s1", 5), (103, "long " * 30_000, "en", "s2", 1), good[0], good[0]]
    labels = [(i, int(i % 2), 0) for i in range(30)] + [(None, 1, 0), (3, 1, 0)]
    return spark.createDataFrame(good + odd, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_warc_rows_that_repeat_a_page_id(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "v", "other"), (2, "w", "same"), (2, "x", "same"), (None, "y", "same"), (None, "z", "same"), (None, "q", None), (3, "q", "")]
    got = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == {(1, "revisit", 2, 4): 2, (1, "response", None, 5): 1, (2, "response", None, 4): 2, (None, "revisit", 2, 4): 2, (None, "revisit", 3, 0): 1, (3, "response", None, 0): 1}


def test_url_rows_that_repeat(spark):
    rows = [(1, "http://a.net/x"), (1, "http://a.net/x"), (None, "http://spam.com/"), (None, None), (2, "")]
    got = collections.Counter((r.page_id, r.host, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, verdict string")).collect())
    assert got == {(1, "a.net", "block"): 2, (None, "spam.com", "block"): 1, (None, "", "allow"): 1, (2, "", "allow"): 1}


def test_quality_rules_and_classifier_rows(spark):
    docs, labels = corpus(spark)
    ids = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    ruled = quality_rules.apply_rules(docs, quality_rules.train(docs, labels)).collect()
    assert sorted((r.doc_id for r in ruled), key=repr) == sorted((i for i, _ in ids), key=repr)
    assert all(not r.kept for r in ruled if r.n_words < 20) and {r.n_words for r in ruled if r.doc_id == 101} == {0}
    scored = quality_classifier.score_documents(docs, quality_classifier.train(docs, labels)).collect()
    assert sorted((r.doc_id for r in scored), key=repr) == sorted((i for i, _ in ids), key=repr)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    assert len({r.score for r in scored if r.doc_id == 0}) == 1
    for empty in (labels.limit(0), labels):
        assert quality_rules.apply_rules(docs.limit(0), quality_rules.train(docs.limit(0), empty)).count() == 0
        assert quality_classifier.score_documents(docs.limit(0), quality_classifier.train(docs.limit(0), empty)).count() == 0


def test_stages_keep_what_they_must(spark):
    docs, _ = corpus(spark)
    items = spark.createDataFrame([(1, "w3x5 and then w3x6 and then w3x7 and then"), (None, None), (2, "")], "item_id long, text string")
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns
    left = collections.Counter(r.doc_id for r in clean.collect())
    assert left[3] == 0 and left[0] == 3 and left[None] == 2 and left[101] == 1
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns and mixing.mixed_documents(docs.limit(0)).count() == 0
    sizes = {r.doc_id: len((r.text or "").split()) for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    taken = collections.Counter()
    for r in mix.where("doc_id is not null").collect():
        taken[r.doc_id] += len((r.text or "").split())
    assert all(taken[i] <= 2 * n * (3 if i == 0 else 1) for i, n in sizes.items())


def test_pipeline_on_odd_rows_and_on_nothing(spark, tmp_path):
    """Every stage on nulls, repeats, empty and very long texts, and a whole run over an empty table, against what each stage must give."""
    pytest.importorskip("public_tokenizers")
    docs, labels = corpus(spark)
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "an item of seven words in all here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        found = sorted(((r.start, r.n_tokens) for r in got.collect()))
        assert all(a + n == b for (a, n), (b, _) in zip(found, found[1:], strict=False))
        assert not found if name == "none" else found[0][0] == 0
    stage_docs = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/stage-{name}"
        stage(spark, stage_docs, f"{tmp_path}/some").write.parquet(path)
        stage_docs = spark.read.parquet(path)
        assert stage_docs.columns == docs.columns
    encoded = token_store.encoded_documents(stage_docs, corpus_pipeline.tokenizer_file())
    assert encoded.agg(F.count("*")).first()[0] == stage_docs.count()


def test_fingerprint_index_over_sessions(spark, tmp_path):
    """A later session opens what an earlier one built; a run that fails leaves the version before; results are those of one go."""
    import random

    from rosterlake.llm import substring_dedup as SD

    rnd = random.Random(11)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(6)]
    texts = [" ".join(rnd.choice([*passages, *(f"x{rnd.random()} " * 25 for _ in range(3))]) for _ in range(rnd.randrange(1, 4))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(60, texts[3]), (61, None), (62, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: tuple(r) for r in SD.remove_repeats(docs, 1).collect()}
    folder, got, cuts = f"file://{tmp_path}/index", {}, [0, 20, 35, 50, 63]
    for a, b in zip(cuts, cuts[1:], strict=False):
        session = spark.newSession()
        index = SD.FingerprintIndex(session, 2, folder)
        frame = session.createDataFrame(rows, "doc_id long, text string")
        part = index.add(frame.where(f"doc_id >= {a} and doc_id < {b}"), frame.where(f"doc_id < {a}"))
        got |= {r.doc_id: tuple(r) for r in part.collect()}
        index.close()
        if b == 35:
            broken = SD.FingerprintIndex(spark.newSession(), 2, folder)
            before = [p for _, p in broken.runs]
            with pytest.raises(Exception, match="boom"):
                broken.add(docs.where("doc_id >= 35").withColumn("text", F.raise_error(F.lit("boom")).cast("string")), docs.limit(0))
            broken.close()
            assert [p for _, p in SD.FingerprintIndex(spark.newSession(), 2, folder).runs] == before
    assert got == whole and any(r[2] for r in whole.values())
    assert SD.FingerprintIndex(spark.newSession(), 2, folder).version >= 4
