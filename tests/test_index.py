"""The kept index and the research pipeline on small corpora."""

from glossmill.operators import index
from glossmill.plans.research import corrected, research


def _docs(spark):
    rows = [(n, "Tides of the sea", "The tide follows the moon.", "a") for n in range(3)] + [(n, "Volcano", "A volcano erupts lava and ash.", "b") for n in range(3, 7)]
    return spark.createDataFrame([*rows, (7, None, None, "c"), (8, "", "", None)], "d long, title string, text string, src string")


def test_an_index_counts_all_texts(spark):
    held = index.build(_docs(spark), key="d")
    assert held.docs == 9 and held.mean == (3 * 3 + 4 * 4) / 9
    assert {(r.term, r.df, r.cf) for r in held.terms.filter("term IN ('tide', 'volcano')").collect()} == {("tide", 3, 3), ("volcano", 4, 4)}
    empty = index.build(_docs(spark).limit(0), key="d")
    assert empty.docs == 0 and empty.terms.collect() == []


def test_an_index_is_kept_for_the_same_query_over_the_same_files(spark, tmp_path):
    _docs(spark).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    assert index.kept(read, key="d") is index.kept(spark.read.parquet(str(tmp_path / "docs")), key="d")
    assert index.kept(read.filter("d > 3"), key="d") is not index.kept(read, key="d")


def test_only_weak_questions_are_searched_again(spark):
    asked = spark.createDataFrame([(1, "what does a tide follow"), (2, "what does a volcanno erupt"), (3, "zzzz qqqq")], "q long, words string")
    rows = research(asked, _docs(spark), query="q", text="words", key="d", group="src").collect()
    by = {q: {r.status for r in rows if r.q == q} for q in (1, 2, 3)}
    assert by[3] == {"empty"} and by[1] == {"ok"}
    again = {r.q for r in rows if r.searched_again}
    assert 1 not in again and 3 not in again


def test_questions_are_mended(spark):
    held = index.build(_docs(spark), key="d")
    asked = spark.createDataFrame([(1, "volcanno ash"), (2, "moon sea"), (3, None)], "q long, text string").selectExpr("q", "text AS t").withColumnRenamed("t", "q2")
    got = {r.k: r.q for r in corrected(asked.selectExpr("q AS k", "q2 AS q"), held, query="k").collect()}
    assert got[1].split()[:2] == ["volcano", "ash"] and 3 not in got
