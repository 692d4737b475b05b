"""The seven problems: small cases with defined results, brute force, round trips and invariants."""

import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossmill.llm import lines, neighbours, packing, pairs, pieces, queries, residue, tokens

EXTRA = "extra string, key string, item string"


# 1. Vectors


def _vectors(spark, rows):
    rows = [(*r[:3], r[3] and list(map(float, r[3])), r[4]) for r in rows]
    return spark.createDataFrame(rows, "vec_id long, manifest_id string, row_no int, vec array<float>, model string")


def _manifests(spark):
    return spark.createDataFrame([("m", "A", 3, "x"), ("m", "A", 3, "y"), ("n", "B", 2, "x"), ("z", None, 3, "x")], "manifest_id string, embedding_model_sha256 string, dim int, vec string")


def test_only_usable_vectors_take_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "m", 0, [1.0, 0, 0], ""), (1, "m", 9, [0, 1.0, 0], ""), (2, "m", 1, [2.0, 0, 0], ""), (3, "m", 2, [0.0, 0, 0], ""), (4, "m", 3, None, ""),
        (5, "m", 4, [1.0, nan, 0], ""), (6, "m", 5, [1.0, inf, 0], ""), (7, "m", 6, [1.0, 0], ""), (8, "n", 7, [1.0, 0], ""), (9, "gone", 8, [1.0, 0, 0], ""),
        (None, "m", 10, [1.0, 0, 0], ""), (11, "z", 11, [1.0, 0, 0], ""), (12, None, 12, [1.0, 0, 0], ""),
    ]
    usable = neighbours.usable_vectors(_vectors(spark, rows), _manifests(spark))
    near = {r.vec_id: [(n.id, round(-n.far, 6)) for n in r.near] for r in neighbours.nearest(usable).collect()}
    assert near == {1: [(2, 1.0)], 2: [(1, 1.0)], 8: []}


def test_no_vectors(spark):
    usable = neighbours.usable_vectors(_vectors(spark, []), _manifests(spark))
    assert neighbours.nearest(usable).collect() == [] and neighbours.exact_nearest(usable).collect() == []


def test_many_equal_vectors_have_the_smallest_ids(spark):
    rows = [(n, "m", n, [1.0, 2.0, 3.0], "") for n in range(40)] + [(100, "m", 0, [1.0, 2.0, 2.9], "")]
    near = {r.vec_id: [n.id for n in r.near] for r in neighbours.nearest(neighbours.usable_vectors(_vectors(spark, rows), _manifests(spark))).collect()}
    assert near[30] == list(range(10)) and near[4] == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10] and near[100] == list(range(10))


def test_recall_against_brute_force(spark, sf):
    rows = queries.p1_recall(spark, sf.replace("0.001", "0.01")).collect()
    assert rows and all(r.recall >= 0.9 for r in rows)


def test_hilbert_curve_visits_neighbouring_cells():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    keys = neighbours.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# 2. Lines


def test_repeated_lines(spark):
    rows = [("a", f"p{n}", f"Share this, {n}!\r\nOwn line {'x' * n}q\n\n1234") for n in range(10)] + [("a", "p0", "Share this, 0!\r\nOwn line q\n\n1234")]
    rows += [("b", f"q{n}", "SHARE THIS") for n in range(9)] + [("b", "q0", "share-this"), (None, "r", "share this"), ("a", None, "share this"), ("a", "s", None), ("a", "t", "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "archive_id string, passage_id string, text string, form string, line_no int")
    got = {(r.passage_id, r.line_no) for r in lines.repeated_lines(df).collect()}
    assert got == {(f"p{n}", 1) for n in range(10)}
    assert lines.repeated_lines(df.limit(0)).collect() == []
    clean = {(r.passage_id, r.text) for r in lines.without_repeated(df.withColumn("created_at", df.line_no)).collect()}
    assert ("p3", "Own line xxxq\n\n1234") in clean and ("s", None) in clean and ("t", "") in clean and ("q1", "SHARE THIS") in clean


def test_lines_of_the_same_letters_share_buckets():
    texts = ["Abc-defghijkl\n\n12 x\r\nabc 1 DEFGHIJKL!", "abcdefghijkm " * 50 + "\nx"]
    text, number, forms, buckets = lines.hash_lines(texts)
    assert list(zip(text.tolist(), number.tolist(), strict=True)) == [(0, 1), (0, 3), (0, 4), (1, 1), (1, 2)]
    for a, b in ((0, 2), (1, 4)):
        assert (forms[a] == forms[b]).all() and (buckets[a] == buckets[b]).all()
    assert len({tuple(f) for f in forms.tolist()}) == 3 and len(set(buckets[[0, 1]].ravel().tolist())) == 2 * lines.BANDS


def test_similar_lines_share_a_bucket_as_often_as_they_should():
    random.seed(11)
    line = "".join(random.choice("abcdefghijklmnopqrst") for _ in range(400))
    other = [line[:200] + random.choice("uvwxyz") * 2 + line[200 + random.randrange(40) :] for _ in range(300)]
    *_, buckets = lines.hash_lines([line, *other])
    assert (buckets[1:] == buckets[0]).any(1).mean() > 0.9
    *_, apart = lines.hash_lines(["".join(random.choice("abcdefghij") for _ in range(60)) for _ in range(300)])
    assert len(set(apart.ravel().tolist())) == 300 * lines.BANDS


def test_no_line_is_found_but_through_its_buckets(spark, monkeypatch):
    df = spark.createDataFrame([("a", f"p{n}", f"Share this, {n}!") for n in range(12)], "archive_id string, passage_id string, text string")
    assert lines.repeated_lines(df).count() == 12
    hashed = lines.hashed_lines(df).withColumn("buckets", lines.F.array(lines.F.xxhash64("passage_id")))
    monkeypatch.setattr(lines, "hashed_lines", lambda snapshots: hashed)
    assert lines.repeated_lines(df).count() == 0


def test_near_duplicates_are_removed_as_one_cluster(spark):
    people = ["Ada Lovel", "Grace Hop", "Alan Turi", "Emmy Noet"]
    rows = [("a", f"p{n}", f"Own text {'xyzw'[n % 4] * (30 + n)} here\nWritten in {1900 + n} by {people[n % 4]} for the readers of this shelf, who may copy each page of it by hand as long as nobody is asked to pay for such a copy") for n in range(11)]
    rows += [("a", "typo", "Written in 1950 by Ada Lovel for the readers of this shelf, who may copy each page of it by hand as long as nobody is aksed to pay for such a copy"), ("b", "q", rows[0][2]), (None, "r", rows[0][2]), ("a", "n", None), ("a", "e", "")]
    rows += [("c", f"c{n}", f"Written in {n} by Ada Lovel for the readers of this shelf, who may copy each page of it by hand as long as nobody is asked to pay for such a copy") for n in range(9)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + rows[:3]], "archive_id string, passage_id string, text string, created_at int, bucket string")
    found = lines.similar_lines(df)
    got = {(r.passage_id, r.line_no): r.passages for r in found.collect()}
    assert set(got) == {(f"p{n}", 2) for n in range(11)} | {("typo", 1)} and set(got.values()) == {12}
    assert len({r.cluster for r in found.collect()}) == 1
    clean = {r.passage_id: r.text for r in lines.without_lines(df, found).collect()}
    assert clean["typo"] == "" and clean["p4"] == f"Own text {'x' * 34} here" and clean["q"] == rows[0][2] and clean["n"] is None
    assert lines.repeated_lines(df).count() == 0 and lines.similar_lines(df.limit(0)).collect() == []


def test_too_many_keys_are_joined_by_salt(spark, monkeypatch):
    df = spark.createDataFrame([("a", f"p{n}", "Share this!\nand that") for n in range(12)], "archive_id string, passage_id string, text string")
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    assert lines.repeated_lines(df).count() == 24 and lines.similar_lines(df).count() == 24


# 3. Pairs


@pytest.mark.parametrize(
    "question, answer, defect",
    [
        ("What is a tide?", "", "empty"), ("What is a tide?", "[S3, S4] ...", "empty"), ("What is a tide?", "​", "empty"),
        ("What is a tide?", "Your question is: What is a tide?", "copies_question"), ("What is a tide?", "What is a tide? It is a slow wave of the sea.", None),
        ("What is a tide?", "I'm sorry, but I can't discuss the tide. Please ask your teacher.", "refusal"),
        ("What is a tide?", "I cannot name every tide, however, three matter. The first is the spring tide.", None),
        ("¿Qué es la marea?", "Perdona, pero no me es posible ayudar con eso. ¿Tienes otra duda?", "refusal"),
        ("Was ist die Flut?", "Tut mir leid, ich muss diese Bitte ablehnen.", "refusal"), ("Qu'est-ce que la marée ?", "Je regrette, mais je ne peux pas répondre à cette question.", "refusal"),
        ("What is a tide and why does it matter?", "La marée est une onde de la mer, car la lune attire les eaux.", "other_language"),
        ("Translate into French: the tide is high", "La marée est haute dans la mer.", None),
        ("What is a tide?", "A tide is a slow wave. It comes when the moon", "truncated"), ("What is a tide?", "A tide is slow. It comes tw…", "truncated"),
        ("What is a tide?", "A tide is a wave. [S1] 🙂", None), ("Name some seas", "There are many.\n- Baltic\n- North Sea", None), ("How far?", "151 miles [S3, S5]", None),
        ("How far?", "A table:\n| a | b |\n|---|---|\n| x | 1 |", None), ("How far?", "A table:\n| a | b |\n|---|---|\n| x | 1", "truncated"),
        ("How far?", "The sum is:\n```\na = 2 * 3\n```", None), ("How far?", "The sum is:\n```\na = 2 *", "truncated"), ("How far?", "It follows.\n\nx = 4,441", None),
    ],
)
def test_defects(question, answer, defect):
    assert pairs.judge([question], [answer])[0][0] == defect


def test_judging_by_batch_and_singly_is_the_same():
    asked = ["What is a tide?", "Was ist die Flut?", ""]
    said = ["La marée est une onde de la mer, car la lune attire les eaux.", "Die Flut ist eine Welle.", "x"]
    assert pairs.judge(asked, said) == [pairs.judge([q], [a])[0] for q, a in zip(asked, said, strict=True)] and pairs.judge([], []) == []


def _found(spark, answers, question="What is a tide and why does it matter?"):
    rows = [(n, question, a, 1) for n, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "turn_id long, input_text string, answer_text string, logged_at long")
    return {answers[r.turn_id]: r.defect for r in pairs.defects(df).collect()}


def test_only_a_neighbour_in_the_sorted_order_tells(spark):
    alone = ["The capital of France is Paris", "A tide is about 3.", "The moon of the sea approx.", "It is deep."]
    assert _found(spark, [*alone, "Nothing begins like this one does."]) == {}
    longer = ["The capital of Spain is Madrid and has been for long.", "A tide is about 3.5 metres high.", "The moon of the sea approx. a mile off.", "It is deep. It is wide."]
    assert _found(spark, [*alone, *longer]) == dict.fromkeys(alone[:3], "truncated")
    assert _found(spark, ["Whales are very large animals 🙂", "Whales are very large animals that live in the sea"]) == {"Whales are very large animals 🙂": "truncated"}


def test_only_a_limit_of_length_tells(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("bcdfgklmnprstvz") for _ in range(n))
    cut_off = [f"{word(6).title()} {word(9)} {word(9)} {word(12)}" for _ in range(40)]
    assert set(_found(spark, cut_off).values()) == {"truncated"} and _found(spark, cut_off[:20]) == {}


def test_a_stock_answer_is_joined_by_salt(spark):
    answers = ["The whole of it is known to all"] * 300 + ["The whole of it is known to all who read."]
    rows = [(n, "What is a tide?", a, 1) for n, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "turn_id long, input_text string, answer_text string, logged_at long")
    assert sorted(r.turn_id for r in pairs.defects(df).collect()) == list(range(300))


# Pairs that none of the rules was written for.
@pytest.mark.parametrize(
    "question, answer, defect",
    [
        ("What is a tide?", "That's not a topic I'm comfortable discussing.", "refusal"), ("What is a tide?", "This request falls outside my scope.", "refusal"),
        ("What is a tide?", "I'd prefer to leave that one alone.", "refusal"), ("What is a tide?", "I could not help noticing the tide.", None),
        ("What can a bat give?", "A bat is not able to offer milk to birds.", None), ("Was kann ein Huhn?", "Ein Huhn kann nicht weit fliegen.", None),
        ("What is the capital of Portugal?", "A capital de Portugal é Lisboa, que fica na foz do rio Tejo.", "other_language"),
        ("Where does the river rise and where does it end?", "Эта река берёт начало в горах и впадает в море.", "other_language"),
        ("Where does the river rise and where does it end?", "De rivier ontspringt in de bergen en mondt uit in de zee.", "other_language"),
        ("Where does the river rise and where does it end?", "Il fiume nasce nelle montagne e sfocia nel mare.", "other_language"),
        ("Wo entspringt der Fluss und wo endet er?", "The river rises in the hills and ends in the sea.", "other_language"),
        ("Where does the river rise and where does it end?", "Wadi Sol, Quibdó, Montréal, Zürich.", None), ("How is Zürich spelt in the local tongue?", "Züri.", None),
    ],
)
def test_defects_in_other_words(question, answer, defect):
    assert pairs.judge([question], [answer])[0][0] == defect


def test_turns_are_judged_once(spark):
    rows = [(1, "What is it?", None, 1), (1, "What is it?", "It is a sea.", 2), (2, " ", None, 1), (3, None, "", 1), (None, "What is it?", "", 1), (4, "What is it?", None, 1), (4, "What is it?", None, 1)]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "turn_id long, input_text string, answer_text string, logged_at long, answer string, at_limit boolean")
    assert [(r.turn_id, r.defect) for r in pairs.defects(df).collect()] == [(4, "empty")]
    assert pairs.defects(df.limit(0)).collect() == []


def test_limits_of_length(spark):
    df = spark.createDataFrame([(83,)] * 30 + [(n,) for n in range(60, 110)], "n_chars int")
    assert {r.n_chars for r in pairs.length_limits(df).collect()} == {83}


# 4. Pieces


def _check_pieces(text, rows, limit, overlap):
    rows = sorted(rows, key=lambda r: r.piece_no)
    assert [r.piece_no for r in rows] == list(range(len(rows)))
    assert rows[0].start == 0 and rows[-1].end == len(text)
    assert all(0 < r.end - r.start <= limit and r.text == text[r.start : r.end] for r in rows)
    assert all(b.start == a.end - overlap for a, b in zip(rows, rows[1:], strict=False))


def test_pieces_of_long_and_short_texts(spark):
    random.seed(3)
    words = " ".join(random.choice(["sea", "tide.", "moon\n", "water,", "海水。"]) for _ in range(60_000))
    texts = {"long": words, "hard": "x" * 3000, "short": "y" * 1200, "one": "z" * 1201, "mixed": "a b. " * 300 + "w" * 1300 + " c" * 900, "none": None, "": ""}
    df = spark.createDataFrame([(k, v, [5, 600, 900], "clash") for k, v in texts.items()], "k string, t string, marks array<long>, item string")
    split = pieces.split_ranges(pieces.text_ranges(df, item="k", text="t", marks="marks", limit=1200, overlap=120), limit=1200, overlap=120).cache()
    rows = pieces.pieces_of(split).collect()
    assert {r["item"] for r in rows} == {"long", "hard", "one", "mixed"}
    for name in ("long", "hard", "one", "mixed"):
        _check_pieces(texts[name], [r for r in rows if r["item"] == name], 1200, 120)
    assert all(r.boundary != "hard" for r in rows if r["item"] == "long") and all(r.boundary in ("hard", "end") for r in rows if r["item"] == "hard")
    runs = {r["item"]: r.longest_run for r in pieces.longest_runs(split).collect()}
    assert runs["hard"] == 3000 and runs["one"] == 1201 and runs["mixed"] == 1300 and runs["long"] == 6


def test_runs_go_on_over_ranges(spark):
    text = "a " * 100 + "x" * (2 * pieces.RANGE) + " b"
    df = spark.createDataFrame([(1, text)], "k long, t string")
    split = pieces.split_ranges(pieces.text_ranges(df, item="k", text="t", marks=None, limit=1200, overlap=120), limit=1200, overlap=120)
    assert pieces.longest_runs(split).first().longest_run == 2 * pieces.RANGE
    _check_pieces(text, pieces.pieces_of(split).collect(), 1200, 120)


def test_files_are_cut_by_byte_ranges(spark, tmp_path):
    text = "Ein Satz über Öl. 海水。 " * 2000 + "end"
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    (tmp_path / "b.txt").write_text("")
    paths = [str(tmp_path / n) for n in ("a.txt", "b.txt")]
    ranges = pieces.file_ranges(spark, paths, limit=300, overlap=40, size=10_007)
    rows = pieces.pieces_of(pieces.split_ranges(ranges, limit=300, overlap=40)).collect()
    _check_pieces(text, rows, 300, 40)


def test_sections_are_preferred(spark):
    text = ("word " * 140 + "end.\n") + ("more " * 100 + "\n") + "rest " * 200
    rows = [(p, "a", "x", 50, 50 + len(text), text, n) for p, n in (("p", 1), ("p", 2), ("null x", 1))] + [(None, "a", None, 0, 0, text, 1), (None, "a", None, 0, 0, text, 2), (None, None, None, 0, 0, text + "!", 2)]
    snapshots = spark.createDataFrame(rows, "passage_id string, archive_id string, path string, start_offset long, end_offset long, text string, created_at int")
    sections = spark.createDataFrame([("a", "x", 50 + 705), ("a", "x", 50 + 705), ("a", "x", None), ("a", "x", 99_999), ("a", "x", 50 + 611)], "archive_id string, path string, end_offset long")
    split = pieces.split_snapshots(snapshots, sections, limit=1200, overlap=120)
    rows = pieces.pieces_of(split).select("item.*", "piece_no", "end", "boundary").collect()
    first = {(r.passage_id, r.unnamed): (r.end, r.boundary) for r in rows if r.piece_no == 0}
    assert len(first) == 4 and first[("p", None)] == first[("null x", None)] == (705, "section") and sum(p is None for p, _ in first) == 2


def test_ranges_of_a_text_twice_as_long_take_twice_the_time(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, n)], "k long, n int").selectExpr("k", "repeat('The sea is deep. ', n) AS t")
        began = time.time()
        pieces.text_ranges(df, item="k", text="t", marks=None, limit=1200, overlap=120).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(1000)
    assert seconds(1_600_000) < 3.2 * min(seconds(800_000) for _ in range(2)) + 1


def test_sizes_are_read(spark):
    specs = spark.createDataFrame([(2, "piece", 900, None), (1, "piece", 1000, 50), (0, "container", 5, 0), (None, None, None, None)], "spec_id int, used_for string, capacity int, overlap int")
    assert pieces.size_of(specs) == (1000, 50)
    with pytest.raises(ValueError):
        pieces.size_of(specs.limit(0))


# 5. Tokens


def test_ids_are_those_of_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = ["Hello  world\n\n it's", None, "", " \t\n", "naïve 海水 🙂‍", "a\x1cb \x85 c", "<|endoftext|>", "x" * 5000, "ab " * 4000, "　 é'll"]
    df = spark.createDataFrame([(n, v, "k") for n, v in enumerate(texts)] + [(0, texts[0], "k"), (None, "x", "k")], "doc_id long, text string, key string")
    public = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    got = tokens.encode(df).collect()
    assert len(got) == len(texts) + 2
    for row in got:
        assert row["ids"] == public.encode("x" if row.doc_id is None else texts[row.doc_id] or "", add_special_tokens=False).ids
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()}
    assert all(back[n] == (v or "") for n, v in enumerate(texts))
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()} == {r.doc_id: len(r["ids"]) for r in got}
    assert tokens.encode(df.limit(0)).collect() == []


# 6. Containers


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_packings_hold_everything(sizes):
    where, fills = packing.sum_of_squares(np.array(sizes, np.int64), 64)
    assert (np.bincount(where, np.array(sizes), minlength=len(fills)) == fills).all() if sizes else len(fills) == 0
    assert (fills <= 64).all() and (fills > 0).all()


def test_rows_of_one_key_are_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 100)
    df = spark.range(1000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "5 AS n_tokens")
    rows = packing.pack(df, [64]).collect()
    assert len(rows) == 1000 and len({r.container >> 32 for r in rows}) > 5


def test_every_item_is_packed_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 200)
    random.seed(5)
    sizes = [(n, random.choice([0, None, 3, 10, 31, 64, 65, 300])) for n in range(900)] + [(7, 10), (None, 5)]
    df = spark.createDataFrame([(*r, "c") for r in sizes], "doc_id long, n_tokens long, container string")
    got = packing.pack(df, [64, 256]).collect()
    for capacity in (64, 256):
        rows = [r for r in got if r.capacity == capacity]
        assert sum(r.n_tokens for r in rows) == sum(s or 0 for _, s in sizes)
        assert len(rows) == sum(max(1, -(-(s or 0) // capacity)) for _, s in sizes)
        fill = {}
        for r in rows:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        assert max(fill.values()) <= capacity
        assert sum(fill.values()) / (capacity * len(fill)) > 0.93
    assert packing.pack(df.limit(0), [64]).collect() == [] and packing.pack(df, []).collect() == []


# 7. Residue


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Author: {{ author }}", "placeholder"), ("Sound sentence here. Born in ${city}.", "placeholder"), ("Dear [INSERT name], hello", "placeholder"), ("{{标题}}始建于{{年份}}年。", "placeholder"),
        ("Born in None on null.", "unset_value"), ("It was [object Object].", "unset_value"), ("Lorem ipsum dolor sit amet consectetur.", "filler"), ("test test test test", "filler"),
        ("Title\n\nReplace this text with your own...", "instruction"), ("此处填写正文，此处填写正文。", "instruction"),
        ("Title\nError 404\nThe page could not be found. Please try again later.", "error"), ("Le serveur a rencontré une erreur interne.", "error"), ("Traceback (most recent call last):\n  File", "error"),
        ("Please enable JavaScript to view this page.", "scripts"), ("请启用JavaScript后重新加载本页。", "scripts"),
        (None, None), ("", None), (" \n", None), ("The null hypothesis says that it has no effect.", None), ("A mark such as `{{ author }}` stands for a value.", None),
        ("Readers see words such as “page not found”.", None), ("```\nconst s = `${first}`;\n```\nA sentence.", None), ("Let A = {x | x > 3} and \\frac{a}{b}, ${a}$.", None),
        ("The moving charts in this chapter need JavaScript, so switch it on in the settings if a chart stays blank; the printed figures show the same data.", None),
        ("This site can't be reached", "error"), ("Enable cookies to continue.", "scripts"), ("Checking your browser before accessing the site.", "error"), ("ERR_CONNECTION_TIMED_OUT", "error"),
        ("[TODO: add introduction here]", "placeholder"), ("Questo sito richiede JavaScript per funzionare.", "scripts"), ("Erreur\nAccès refusé à cet article.", "error"), ("Pendiente de redactar.", "instruction"),
        ("Zugriff verweigert auf diesen Artikel.", "error"), ("内容待补充", "instruction"), ("Seite im Aufbau", "instruction"), ("502 This entry was blocked. Please try again later.", "error"), ("The article could not be found.", "error"),
        ("On Windows the %PATH% variable lists folders.", None), ("Write <title> before <body> in HTML.", None), ("The canal was dug. The service was interrupted. It went on.", None),
        ("He asked for the book. The article could not be found. He left.", None), ("The <title> of this page", "placeholder"), ("Dear %FIRST_NAME%, welcome.", "placeholder"),
        ("We call it undefined.", None), ("Use <b>bold</b> and the field marked [name].", None),
    ],
)
def test_residue(text, kind):
    assert residue.Finder().kind(text) == kind


def test_residue_of_a_table(spark):
    df = spark.createDataFrame([(1, "test test test", "x"), (1, "test test test", "x"), (None, "Sound text.", "x"), (2, "Sound text. " * 50_000, "x")], "doc_id long, text string, kind string")
    assert sorted((r.doc_id or 0, r.kind or "") for r in residue.residue_kind(df).collect()) == [(0, ""), (1, "filler"), (1, "filler"), (2, "")]


# All queries against SQL


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    import os

    got = [r.asDict(True) for r in queries.QUERIES[name](spark, sf).collect()]
    if name not in queries.SQL:
        assert got or name in ("p1_recall", "p2_near")  # too few rows at this scale
        return
    duck = duckdb.connect()
    for file in os.listdir(sf):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{file}'")
    result = duck.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    plain = lambda rows: sorted(repr(sorted(r.items())) for r in rows)
    assert plain(got) == plain(dict(zip(columns, r, strict=True)) for r in result.fetchall())
