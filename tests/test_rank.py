"""BM25, fusion, packing and grading against values computed by hand."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossmill.operators import dense, index, rank


def test_bm25_is_the_formula(spark):
    docs = spark.createDataFrame([(0, "cat sat mat"), (1, "dog sat log"), (2, "cat cat dog run"), (3, None)], "d long, text string")
    asked = spark.createDataFrame([(7, "cat"), (8, "cat cat"), (9, "zebra"), (10, None)], "q long, words string")
    got = {(r.q, r.d): r.score for r in index.bm25(asked, docs, query="q", query_text="words", key="d").collect()}
    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    mean = 10 / 4
    expected = lambda tf, n: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    assert set(got) == {(7, 0), (7, 2), (8, 0), (8, 2)}
    assert got[7, 0] == pytest.approx(expected(1, 3), abs=1e-6) and got[7, 2] == pytest.approx(expected(2, 4), abs=1e-6)
    assert got[8, 0] == pytest.approx(2 * expected(1, 3), abs=2e-6)


def test_rrf_ties_go_to_the_first_seen(spark):
    rows = [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 0, 3, "c"), (1, 1, 1, "b"), (1, 1, 2, "a"), (1, 1, 3, "c")]
    got = rank.rrf_fuse(spark.createDataFrame(rows, "q int, list_no int, rank int, i string"), query="q", item="i").orderBy("rank").collect()
    assert [r.i for r in got] == ["a", "b", "c"] and got[0].score == pytest.approx(1 / 60 + 1 / 61, abs=1e-6)


def test_diversity_cap_keeps_order(spark):
    rows = [(1, n, g) for n, g in enumerate("aabacb", 1)]
    got = rank.diversity_cap(spark.createDataFrame(rows, "q int, rank int, g string"), query="q", group="g").orderBy("rank").collect()
    assert [(r.rank, r.g) for r in got] == [(1, "a"), (2, "a"), (3, "b"), (5, "c"), (6, "b")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=12))
def test_packing_skips_and_goes_on(spark, sizes):
    df = spark.createDataFrame([(1, n, f"d{n}", s) for n, s in enumerate(sizes, 1)], "q int, rank int, d string, s long")
    got = rank.pack_budget(df, query="q", item="d", tokens="s", budget=100).collect()
    left, kept = 100, []
    for n, s in enumerate(sizes, 1):
        if s <= left:
            left -= s
            kept.append((f"S{len(kept) + 1}", f"d{n}"))
    assert [(r.label, r.d) for r in sorted(got, key=lambda r: int(r.label[1:]))] == kept


def test_cutoff_keeps_one_row_at_least(spark):
    df = spark.createDataFrame([(1, 1, 5.0, "apples here", ["pear"]), (1, 2, 4.0, "more apples", ["pear"]), (2, 1, 5.0, "a pear", ["pears"]), (2, 2, 1.0, "pears", ["pears"]), (2, 3, 4.0, "pears", ["pears"])], "q int, rank int, score double, text string, own array<string>")
    got = {(r.q, r.rank) for r in rank.relevance_cutoff(df, query="q", own_terms="own").collect()}
    assert got == {(1, 1), (2, 1), (2, 3)}


def test_coverage_floor_for_generic_titles(spark):
    df = spark.createDataFrame([(["output", "boiling", "point", "helium"], "Output", "logic gates"), (["moon"], "Planets", "It has moons."), ([], "x", "y"), (["a1"], None, None)], "own array<string>, title string, text string")
    got = [r.c for r in df.select(rank.coverage(F.col("own"), F.col("title"), F.col("text"), F.size("own")).alias("c")).collect()]
    assert [c.weak for c in got] == [True, False, True, True] and got[1].term_coverage == 1.0


def test_merged_lists_put_generic_titles_last(spark):
    lists = spark.createDataFrame([("g", 1, 1, "p1", "Foot"), ("g", 2, 1, "p1", "Foot"), ("g", 1, 2, "p2", "Square foot gardening")], "g string, list_no int, rank int, item string, title string")
    asked = spark.createDataFrame([("g", 1, ["square", "foot", "gardening"]), ("g", 2, ["square", "foot"])], "g string, list_no int, terms array<string>")
    got = rank.merge_lists(lists, asked, group="g").orderBy("place").collect()
    assert [r["item"] for r in got] == ["p2", "p1"]


def test_dense_search_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 8), (62, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = dense.dense_topk(df.filter("vec_id % 10 = 0"), df, k=3).collect()
    m = np.array([r[1] for r in rows[:60]] + [[0.0] * 8])
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for q in range(0, 60, 10):
        close = m @ m[q]
        close[q] = -9
        want = sorted(range(61), key=lambda i: (-round(close[i], 6), i))[:3]
        assert [r.other for r in sorted((r for r in got if r.vec_id == q), key=lambda r: r["rank"])] == want
    assert not [r for r in got if r.vec_id == 60]
