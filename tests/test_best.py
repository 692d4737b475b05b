"""The best texts of each query against all pairs, ranked."""

import random

import pytest
from pyspark.sql import functions as F

from glossmill.operators import best as module
from glossmill.operators import index, rank


def _corpus(spark, again):
    rng = random.Random(5)
    words = [f"w{n}" for n in range(12)]
    docs = [(n, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for n in range(300)] + [(300, None), (301, "")]
    docs += [(n, " ".join(rng.choices(words, k=3))) for n in range(0, 40, 3)] * again
    asked = [(n, " ".join(rng.choices(words, k=4)) + " w1") for n in range(25)]
    return spark.createDataFrame(asked, "q long, words string"), spark.createDataFrame(docs, "d long, text string").repartition(40)


def _pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("again", [0, 1, 2])
def test_the_best_of_a_search_are_those_of_all_pairs(spark, again):
    asked, docs = _corpus(spark, again)
    held = index.build(docs, key="d")
    names = {"query": "q", "query_text": "words", "key": "d"}
    want = index.top(index.search(asked, held, **names), 7, query="q", key="d")
    assert _pairs(index.search_top(asked, held, 7, **names), "q", "rank", "d", "score") == _pairs(want, "q", "rank", "d", "score")


def test_no_pairs_leave_a_task(spark):
    asked, docs = _corpus(spark, 0)
    terms = index.exploded(asked, "q", terms=F.array_distinct(F.split("words", " "))).withColumn("weight", F.lit(1.0))
    texts = docs.select(F.col("d").alias("key"), F.split("text", " ").alias("list"))
    found = module.best(terms, texts, query="q", key="d", k=3)
    assert 0 < found.count() <= 25 * 3 * module.TASKS * spark.sparkContext.defaultParallelism
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_equal_matches_come_by_place_and_then_by_key(spark, monkeypatch):
    monkeypatch.setattr(module, "QUERIES", 1)  # a block a query
    terms = spark.createDataFrame([("p", "a", 1.0, 1), ("p", "b", 1.0, 2), ("r", "b", 1.0, 1), ("s", "x", 1.0, 1)], "q string, term string, weight double, place int")
    rows = [("k3", ["b"]), ("k1", ["b", "b"]), ("k2", ["a"]), ("k4", ["b", "a"]), ("k1", ["b", "b"]), ("k0", None), ("k9", [])]
    texts = spark.createDataFrame(rows, "key string, list array<string>").repartition(1)
    found = module.best(terms, texts, query="q", key="d", k=3)
    assert _pairs(found, "q", "score", "least", "d") == [("p", 1.0, 1, "k2"), ("p", 1.0, 2, "k1"), ("p", 2.0, 1, "k4"), ("r", 1.0, 1, "k1"), ("r", 1.0, 1, "k3"), ("r", 1.0, 1, "k4")]


def test_a_text_put_again_is_ranked_once(spark):
    terms = spark.createDataFrame([(1, "a"), (1, "b")], "q int, term string")
    texts = spark.createDataFrame([(k, ["a", "b"]) for k in "xxyyzz"], "key string, list array<string>").repartition(6)
    assert _pairs(index.match_top(terms, texts, 3, query="q", key="d"), "d", "rank", "score") == [("x", 1, 2.0), ("y", 2, 2.0), ("z", 3, 2.0)]


def test_a_cut_off_list_needs_no_texts_behind_its_windows(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, ["tide"], "The tides."), (1, 2, 1.0, ["tide"], "Lava."), (1, 3, 0.1, ["tide"], "A tide.")], "q int, rank int, score double, own array<string>, text string")
    kept = rank.relevance_cutoff(rows.repartition(2), query="q", own_terms="own").select("q", "rank")
    assert [(r.q, r["rank"]) for r in kept.collect()] == [(1, 1)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert "regexp" not in "".join(plan[: max(n for n, line in enumerate(plan) if "Window [" in line)])
