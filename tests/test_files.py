"""Readers of other files."""

import json

import numpy as np
import pytest

from glossmill.operators import logs
from glossmill.sources import files


def test_questions(spark, tmp_path):
    lines = [{"id": "a", "question": "x", "expected_paths": ["p"], "category": "direct", "split": "held"}, {"id": "b", "question": "y"}, {"question": "no id"}]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    rows = {r.id: (r.expected_paths, r.split) for r in files.questions(spark, str(tmp_path / "q.jsonl")).collect()}
    assert rows == {"a": (["p"], "held"), "b": ([], "tuning")}
    assert [r.id for r in files.questions(spark, str(tmp_path / "q.jsonl"), allowed=["p", "z"]).collect()] == ["a"]


def test_registry(spark, tmp_path):
    entry = '[[archive]]\nid = "{}"\npath = "x.zim"\ntier = {}\nkind = "qa"\nstorage = "ssd"\n'
    path = tmp_path / "r.toml"
    path.write_text(entry.format("a", 1) + entry.format("b", 3))
    assert [(r.id, r.weight, r.searchable) for r in files.registry(spark, str(path)).collect()] == [("a", 1.0, True), ("b", 1.0, True)]
    for bad in (entry.format("a", 1) * 2, entry.format("a", 7), '[[archive]]\nid = "a"\n'):
        path.write_text(bad)
        with pytest.raises(ValueError):
            files.registry(spark, str(path))


def test_catalogue_and_lists(spark, tmp_path):
    (tmp_path / "c.xml").write_text(
        '<feed><entry><name>w</name><link rel="self" href="s"/><link rel="http://opds-spec.org/acquisition" href="h/w_2024-05a.zim.meta4" length="12"/></entry>'
        '<entry><name>v</name><flavour>mini</flavour><link rel="x/acquisition" href="h/v_2023-01.zim" length="many"/></entry></feed>'
    )
    rows = {r.name: (r.length, r.fbase, r.fdate, r.flavour) for r in files.catalogue(spark, str(tmp_path / "c.xml")).collect()}
    assert rows == {"w": (12, "w", "2024-05a", ""), "v": (None, "v", "2023-01", "mini")}
    (tmp_path / "l.txt").write_text("# note\n\n  one \ntwo\n")
    assert sorted(r.name for r in files.wanted(spark, str(tmp_path / "l.txt")).collect()) == ["one", "two"]


def test_frames_and_vectors(spark, tmp_path):
    lines = [(1, 0, "event: token"), (1, 1, 'data: {"a": 1}'), (1, 2, ""), (1, 3, "event: done"), (1, 4, "data: {}"), (2, 0, "data: {}")]
    rows = files.event_frames(spark.createDataFrame(lines, "stream int, no int, line string")).collect()
    assert sorted((r.stream, r.event or "", r.data) for r in rows) == [(1, "done", "{}"), (1, "token", '{"a": 1}'), (2, "", "{}")]
    want = np.arange(12, dtype="<f2").reshape(4, 3)
    (tmp_path / "v.fp16").write_bytes(want.tobytes())
    assert [r.vector for r in files.half_float_vectors(spark, str(tmp_path / "v.fp16"), 3).orderBy("row_no").collect()] == want.tolist()


def test_cycles(spark):
    pair = "First long sentence of it [S{}]. Second long sentence of it. "
    df = spark.createDataFrame([(1, "".join(pair.format(n) for n in range(3)) + "End."), (2, pair * 2), (3, None)], "k int, a string")
    assert [(r.k, r.period, r.first_no, r.times) for r in logs.repeated_cycles(df, key="k", text="a").collect()] == [(1, 2, 0, 3)]
