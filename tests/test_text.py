"""Text functions against values computed by hand."""

from pyspark.sql import functions as F

from glossmill.functions import text as t


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def test_tokens_drop_stop_words_and_keep_repeats(spark):
    assert one(spark, "The cat, the CAT and a naïve_2 dog", t.tokens("x")) == ["cat", "cat", "naïve_2", "dog"]
    assert one(spark, None, t.tokens("x")) is None
    assert one(spark, "", t.tokens("x")) == []


def test_singular(spark):
    words = ["moons", "boxes", "churches", "cities", "class", "bus", "gas", "glasses"]
    rows = spark.createDataFrame([(w,) for w in words], "x string").select(t.singular(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == ["moon", "box", "church", "city", "class", "bus", "gas", "glass"]


def test_superlatives(spark):
    words = ["biggest", "forest", "rainforest", "rest", "calmest", "record", "quest"]
    rows = spark.createDataFrame([(w,) for w in words], "x string").select(t.is_superlative(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [True, False, False, False, True, True, False]


def test_instruction_is_stripped_only_where_content_is_left(spark):
    assert one(spark, "Output the boiling point", F.trim(t.strip_instruction("x"))) == "the boiling point"
    assert one(spark, "What is output?", t.strip_instruction("x")) == "What is output?"
    assert one(spark, "Can you explain tides please", F.trim(t.strip_instruction("x"))) == "tides"


def test_coverage_terms_take_the_hint_only_for_elliptical_questions(spark):
    df = spark.createDataFrame([("what about its moons?", "jupiter"), ("what is the capital of France?", "jupiter"), ("what is the longest river", None)], "q string, h string")
    rows = [sorted(r.y) for r in df.select(t.coverage_terms("q", "h").alias("y")).collect()]
    assert rows == [["jupiter", "moons"], ["capital", "france"], ["river"]]


def test_role_weights(spark):
    rows = one(spark, "the boiling point of helium in celsius, helium's mass", t.role_weights("x"))
    assert {(r.term, r.weight) for r in rows} == {("helium", 2.5), ("celsiu", 0.3)}


def test_labels_and_figures(spark):
    assert one(spark, "a [S3, S1] b [S1] c [x]", t.labels("x")) == ["S3", "S1"]
    assert sorted(one(spark, "2. It is −4.5 or 12 [S7]", t.figures("x"))) == ["-4.5", "12"]


def test_sentences_and_claims(spark):
    assert one(spark, "One. Two!\n\nThree? ", t.sentences("x")) == ["One.", "Two!", "Three?"]
    for text, no_claim in (("Is it?", True), ("Great question!", True), ("3.", True), ("[Q&A]", True), ("[S1]", False), ("Water boils.", False)):
        assert one(spark, text, t.is_no_claim("x")) is no_claim, text


def test_snippet_centres_on_the_first_query_word(spark):
    df = spark.createDataFrame([("x" * 300 + " helium rest", "absent helium"), ("short text", "none"), ("y" * 500, "z")], "t string, q string")
    got = [r.y for r in df.select(t.snippet("t", "q").alias("y")).collect()]
    assert got[0].endswith("helium rest") and len(got[0]) <= 200 and got[1] == "short text" and len(got[2]) == 200


def test_small_ones(spark):
    assert one(spark, "Héllo, World -- 2", t.slug("x")) == "h-llo-world-2"
    assert one(spark, "a" * 8, t.estimate_tokens("x")) == 3
    assert one(spark, "a <script>x</script> b", t.without_scripts("x")) == "a  b"
    assert [one(spark, v, t.reply_class("x")) for v in ("Yes!", " nah ", "maybe")] == ["yes", "no", None]
    assert [one(spark, v, t.message_class("x", ["fault"])) for v in ("thank you, lol", "a f4ult", "tides", "", None)] == ["chat", "decline", "normal", "normal", "normal"]
    assert one(spark, " ".join("abcdefghij"), t.pointer(F.lit("T"), "x")) == "(already shown above) T — a b c d e f g h…"
    assert one(spark, "How many degrees?", t.asks_for_quantity("x")) is True


def test_spans_of_a_text(spark):
    from glossmill.operators import spans

    text = "One. Two [S1] is. Three\n```\nx = 1\n```\n| a | b |\n|---|---|\n| c | d |\n- item\n\nend"
    df = spark.createDataFrame([(1, text), (2, None), (3, "```\nopen")], "k long, t string")
    numbered = spans.lines(df, key="k", text="t")
    rows = spans.kinds(spans.outside_code(numbered, key="k"), key="k").orderBy("k", "no").collect()
    assert [r.kind for r in rows] == ["paragraph", "header", "separator", "table_row", "item", "blank", "paragraph"]
    assert all(text[r.start : r.end] == r.line for r in rows)
    said = df.filter("k = 1").select(spans.sentence_around("t", F.instr("t", "[S"))).first()[0]
    assert said == "Two [S1] is."


def test_windows_are_trimmed_at_the_far_edge(spark):
    from glossmill.operators import spans

    df = spark.createDataFrame([(1000, 0, 100), (1000, 500, 600), (1000, 950, 1000)], "n long, a long, b long")
    rows = df.select(spans.window_around(F.col("n"), F.col("a"), F.col("b"), reach=200, most=250).alias("v")).select("v.*").collect()
    assert [(r.low, r.high) for r in rows] == [(0, 250), (500, 750), (750, 1000)]
