"""Joins that Spark sizes too low must not become broadcasts: explodes, and tables whose files compress well."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from rosterlake.llm import components as components_module
from rosterlake.llm import near_dedup
from rosterlake.llm.components import components


def recorded(monkeypatch, *modules):
    """The physical plans of all tables that the modules write, as (name, plan)."""
    seen = []
    for module in modules:

        def record(df, what="table", real=module.written):
            seen.append((what, df._jdf.queryExecution().executedPlan().toString()))
            return real(df, what)

        monkeypatch.setattr(module, "written", record)
    return seen


def documents(spark, n=60):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(n // 2)]
    texts += [f"{t} end" for t in texts]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_pairs_of_signatures_are_never_broadcast(spark, monkeypatch):
    """48 rows of each class: Spark takes them for a fraction of the classes' file (op5)."""
    seen = recorded(monkeypatch, near_dedup)
    rows = near_dedup.near_duplicates(documents(spark)).collect()
    assert sum(r["kept"] for r in rows) == 30
    plans = dict(seen)
    assert "Generate posexplode" in plans["prefix"]
    assert "Broadcast" not in plans["prefix"]


def test_the_pipelines_dedup_does_not_broadcast_postings(spark, monkeypatch):
    seen = recorded(monkeypatch, near_dedup)
    docs = documents(spark).withColumn("source", F.lit("s"))
    assert corpus_pipeline.dedup(spark, docs, "").count() == 30
    assert all("Broadcast" not in plan for what, plan in seen if what in ("prefix", "postings"))


def test_tables_of_edges_are_never_broadcast(spark, monkeypatch):
    """Ids compress well, so files of edges say little about their rows."""
    seen = recorded(monkeypatch, components_module)
    edges = spark.range(20).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(edges).select("component").distinct().count() == 1
    assert {"least", "up", "labels"} <= {what for what, _ in seen}
    assert all("Broadcast" not in plan for _, plan in seen)
