"""Logs, corrections, pages, arithmetic and streams."""

import datetime as dt

from pyspark.sql import functions as F

from glossmill.operators import calc, correct, extract, logs
from glossmill.streaming import events


def test_upsert_keeps_the_first_time_and_the_newest_values(spark):
    at = lambda d: dt.datetime(2025, 1, d)
    df = spark.createDataFrame([("a", "old", at(1)), ("a", "new", at(3)), ("b", None, None), (None, "x", at(2))], "k string, v string, at timestamp")
    got = {r.k: (r.v, r["at"]) for r in logs.upsert_first_seen(df, key="k", at="at").collect()}
    assert got == {"a": ("new", at(1)), "b": (None, None)}


def test_eviction_keeps_the_newest_turn(spark):
    df = spark.createDataFrame([("l", n, 40) for n in range(4)] + [("m", 0, 500)], "g string, n int, size int")
    got = {(r.g, r.n): r.evicted for r in logs.evict_oldest(df, group="g", order=["n"], tokens="size", budget=100).collect()}
    assert got == {("l", 0): True, ("l", 1): True, ("l", 2): False, ("l", 3): False, ("m", 0): False}


def test_chains(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone")]
    got = {r.node: (r.root, r.hops, r.status) for r in logs.resolve_chain(spark.createDataFrame(links, "n string, t string"), node="n", target="t").collect()}
    assert got["a"] == ("a", 0, "ok") and got["b"] == ("a", 1, "ok") and got["c"] == ("a", 2, "ok")
    assert got["x"][2] == got["y"][2] == "cycle" and got["z"][2] == "not_found"


def test_repeated_units(spark):
    same = "The same long sentence again [S1]. "
    df = spark.createDataFrame([(1, same * 3 + "Other one here."), (2, "Short. Short. Short."), (3, None)], "k int, a string")
    assert [(r.k, r.times) for r in logs.repeated_units(df, key="k", text="a").collect()] == [(1, 3)]


def test_osa_and_spelling(spark):
    assert [correct.osa("heluim", "helium"), correct.osa("ca", "abc", 9), correct.osa("same", "same"), correct.osa("a", "abcdef")] == [1, 3, 0, 3]
    known = spark.createDataFrame([("helium", 9), ("helix", 5), ("helum", 2)], "term string, df long")
    got = correct.spelling(spark.createDataFrame([("heluim",), ("zzzz",), ("hel",)], "term string"), known).collect()
    assert [(r.term, r.best) for r in got] == [("heluim", "helium")]


def test_compounds(spark):
    vocabulary = spark.createDataFrame([("square", 300), ("foot", 250), ("squa", 900), ("refoot", 1)], "term string, df long")
    phrases = spark.createDataFrame([("square foot", 12)], "phrase string, df long")
    got = correct.compounds(spark.createDataFrame([("squarefoot",), ("tiny",)], "term string"), vocabulary, phrases).collect()
    assert [(r.term, r.halves, r.phrase_df) for r in got] == [("squarefoot", "square foot", 12)]


def test_word_forms(spark):
    words = ["garden", "erupt", "freeze", "running", "dinosaurs", "ab"]
    got = {r.w: r.f for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", correct.word_forms(F.col("w")).alias("f")).collect()}
    assert "gardening" in got["garden"] and "eruption" in got["erupt"] and "freezing" in got["freeze"]
    assert "run" in got["running"] and "dinosaur" in got["dinosaurs"] and got["ab"] == [] and max(map(len, got.values())) <= 8


def test_arithmetic_never_runs_code():
    assert [calc.compute(x) for x in ("2 + 3 * 4", "1/3", "7/2", "2^10", "sqrt(16)", "1,000 × 2", "-5 % 3")] == ["14", "0.3333333333", "3.5", "1024", "4", "2000", "1"]
    assert [calc.compute(x) for x in ("__import__('os')", "1/0", "a + 1", "", None, "9" * 300, "9**9**9", "(1).real")] == [None] * 8


def test_pages_and_links(spark):
    df = spark.createDataFrame([("A & B", "one <x>\ntwo")], "t string, x string")
    assert df.select(extract.page_text(extract.render_page(F.col("t"), F.col("x"))).alias("y")).first().y == "A & B one <x> two"
    html = '<a href="A/x">1</a><a class="e" href="https://e.org">2</a><a href="//h/y">3</a><a href="A/x">4</a><a href="#top">5</a>'
    assert spark.createDataFrame([(html,)], "h string").select(extract.internal_links(F.col("h")).alias("y")).first().y == ["A/x"]


def test_chunks_cover_all_words(spark):
    text = " ".join("word%d" % n for n in range(300)) + " " + "x" * 500
    df = spark.createDataFrame([(1, text), (2, None), (3, "  ")], "k long, t string")
    rows = sorted(extract.chunk_words(df, key="k", text="t").collect(), key=lambda r: r.start)
    assert " ".join(r.piece for r in rows).split() == text.split()
    assert all(len(r.piece) <= 400 or " " not in r.piece for r in rows) and all(text[r.start : r.end] == r.piece for r in rows)


def test_section_parents(spark):
    df = spark.createDataFrame([("a", "p", 0, 1, 0), ("a", "p", 1, 2, 5), ("a", "p", 2, 3, 9), ("a", "p", 3, 2, 12)], "archive_id string, path string, section_index int, heading_level int, start_offset long")
    got = {r.section_index: (r.end_offset, r.parent) for r in extract.section_tree(df).collect()}
    assert got == {0: (5, None), 1: (9, 0), 2: (12, 1), 3: (None, 0)}


def _stream(spark, df, folder, name, build, mode="append"):
    df.write.parquet(f"{folder}/in")
    stream = build(spark.readStream.schema(df.schema).parquet(f"{folder}/in"))
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/cp").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_stream_windows_equal_batch_windows(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = _stream(spark, rows, str(tmp_path), "tumbled", lambda s: events.tumbling(events.with_time(s)), "complete")
    want = events.tumbling(rows).collect()
    assert sorted((r.start, r.event_type, r.n) for r in got) == sorted((r.start, r.event_type, r.n) for r in want)


def test_guard_tells_once(spark, tmp_path):
    rows = [("a", "The very same sentence.", n) for n in range(6)] + [("b", "short", n) for n in range(6)] + [("c", f"Another sentence {n} of many", n) for n in range(6)]
    df = spark.createDataFrame(rows, "k string, u string, at long")
    got = _stream(spark, df, str(tmp_path), "guarded", lambda s: events.repetition_guard(s, key="k", unit="u", order="at"))
    assert [(r.k, r["at"]) for r in got] == [("a", 3)]


def test_upsert_sink_replays(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), (None, "y", 1)], "k string, v string, at long")
    write = events.upsert_sink(str(tmp_path), key="k")
    for batch in (0, 0, 1):
        write(df, batch)
    assert [(r.k, r.v) for r in events.read_upserted(spark, str(tmp_path), key="k", at="at").collect()] == [("a", "x")]


def test_chains_of_any_length_and_circles(spark):
    links = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("n40", None), ("a", "b"), ("b", "c"), ("c", "b"), ("x", "gone"), ("s", "s"), (None, "a")]
    got = {r.node: (r.root, r.hops, r.status) for r in logs.resolve_chain(spark.createDataFrame(links, "node string, target string"), node="node", target="target").collect()}
    assert got["n0"] == ("n40", 40, "too_deep") and got["n15"] == ("n40", 25, "ok") and got["n40"] == ("n40", 0, "ok")
    assert got["x"] == ("gone", 1, "not_found") and all(got[n] == (None, None, "cycle") for n in "abcs") and len(got) == 46
    assert logs.resolve_chain(spark.createDataFrame([], "node string, target string"), node="node", target="target").collect() == []


def test_logs_are_evicted_in_stages(spark):
    rows = [("a", n, 100, 80) for n in range(4)] + [("b", 0, 900, 80), ("c", 0, 10, 10), ("c", 1, 20, 0)]
    df = spark.createDataFrame(rows, "g string, n int, tokens long, passages long")
    got = {(r.g, r.n): (r.passages_gone, r.turn_gone) for r in logs.evict_in_stages(df, group="g", order=["n"], tokens="tokens", passages="passages", budget=500).collect()}
    # 720 in all: three turns' passages go, the newest keeps its own; 480 are left
    assert [got["a", n] for n in range(4)] == [(True, False)] * 3 + [(False, False)]
    assert got["b", 0] == (False, False) and got["c", 0] == (False, False)
    got = {r.n: r.turn_gone for r in logs.evict_in_stages(df.filter("g = 'a'"), group="g", order=["n"], tokens="tokens", passages="passages", budget=300).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False}
