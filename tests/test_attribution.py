"""Dumps of evidence and support of sentences, held against rules computed by hand."""

from pyspark.sql import functions as F

from glossmill.functions import text as t
from glossmill.operators import attribution


def _dumps(spark, answers, passages):
    held = spark.createDataFrame(passages, "turn_id long, label string, text string")
    got = attribution.dumps(spark.createDataFrame(answers, "turn_id long, a string"), held, key="turn_id", text="a", label="label", passage="text")
    return {r.turn_id: (r.most_labels, r.long, r.copied, r.dump) for r in got.collect()}


def test_answers_that_copy_their_passages_are_dumps(spark):
    passages = [(n, f"S{k}", text) for n in (1, 2, 3, 4, 5) for k, text in enumerate(("Tides follow moon gravity closely", "Magma cools into basalt columns", "Glaciers carve wide stone valleys"), 1)]
    copied = "- Tides follow moon gravity closely [S1]\n- Magma cools into basalt columns [S2]\n- Glaciers carve wide stone valleys [S3]"
    answers = [
        (1, copied),
        (2, copied.replace("[S3]", "[S9]")),  # a label without a passage
        (3, copied.replace("basalt columns", "black rock")),  # 3 of 6 terms
        (4, copied.replace("[S1]", "[S3, S1]").replace("[S2]", "[S1]")),  # a label counts once, by its own passage
        (5, "Tides [S1][S2][S3][S4]."),  # short
        (6, copied),  # no packet
        (7, "Rock of the deep sea floor is young. " * 8 + "All agree [S1][S2][S3][S4]."),  # long, no packet
    ]
    got = _dumps(spark, answers, passages)
    assert got == {
        1: (1, False, 3, True), 2: (1, False, 2, False), 3: (1, False, 2, False), 4: (2, False, 1, False),
        5: (4, False, 0, False), 6: (1, False, 0, False), 7: (4, True, 0, True),
    }


def test_a_sentence_needs_shared_terms_and_every_figure_and_name(spark):
    evidence = "The cold station Vostok recorded temperatures of -70 degrees. Anders Lund survived the winter near Maro."
    cases = {
        "Vostok recorded cold temperatures.": True,
        "A cold station recorded temperatures of -70° (-94°).": True,  # a conversion
        "A cold station recorded temperatures of -71 degrees.": False,
        "In winter Vitus Andronicus survived cold temperatures.": False,  # an invented name
        "The winter near maro was survived by LUND.": True,
        "The explorer Petra Lund survived the winter.": True,  # one word of a name will do
        "The cold winter survived near Mar.": False,  # no whole word
        "The cold winter station survived in January.": True,
        "Bees build waxen hexagons.": False,  # shares nothing, says nothing specific
    }
    rows = [(1, n, s) for n, s in enumerate(cases)] + [(2, 0, "Vostok recorded cold temperatures.")]
    sentences = spark.createDataFrame(rows, "k long, no int, sentence string").withColumn("terms", F.array_distinct(t.tokens("sentence")))
    passages = spark.createDataFrame([(1, 7, evidence), (1, 8, "Rivers freeze slowly."), (1, 9, None)], "k long, p long, text string")
    got = {(r.k, r.no): r.supported for r in attribution.supported(sentences, passages, key="k", passage="p", text="text").collect()}
    assert {s: got[1, n] for n, s in enumerate(cases)} == cases and got[2, 0] is False and len(got) == len(rows)
