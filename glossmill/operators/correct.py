"""Corrections of question terms against a vocabulary: spelling, compounds, word forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from glossmill.functions.words import DOUBLED, VOWELS

MAX_EDITS, LEAST_DF, PREFIX = 2, 3, 3
FORMS, FORM_LETTERS = 8, 3


def osa(a: str, b: str, most: int = MAX_EDITS) -> int:
    """Edits with neighbouring letters swapped counting as one; more than `most` apart in length gives most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def spelling(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, best, df): for each term of four letters or more the most frequent word within two edits and with the same first letters.

    vocabulary: (term, df). Words rarer than LEAST_DF aren't taken; equally frequent
    ones by alphabet. Candidates meet over their first PREFIX letters and their length,
    a term at each length within reach, and pass a bound in the JVM before the distance
    is computed.
    """
    asked = unknown.select("term").distinct().filter(F.length("term") >= 4).withColumn("head", F.substring("term", 1, PREFIX))
    asked = asked.withColumn("n", F.explode(F.sequence(F.length("term") - MAX_EDITS, F.length("term") + MAX_EDITS)))
    known = vocabulary.filter(F.col("df") >= LEAST_DF).select(F.col("term").alias("word"), "df", F.substring("term", 1, PREFIX).alias("head"), F.length("term").alias("n"))
    near = asked.join(known, ["head", "n"]).filter((F.levenshtein("term", "word", 2 * MAX_EDITS) >= 0) & (F.col("term") != F.col("word")))
    close = near.withColumn("edits", osa_distance("term", "word")).filter(F.col("edits") <= MAX_EDITS)
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("df"), "word"))
    return close.withColumn("place", place).filter("place = 1").select("term", F.col("word").alias("best"), "df")


def compounds(rare: DataFrame, vocabulary: DataFrame, phrases: DataFrame, *, letters: int = 4, least: int = 200) -> DataFrame:
    """(term, halves, phrase_df): terms split into two words that are both frequent, where the pair is most frequent as a phrase.

    phrases: (phrase, df) of neighbouring words. Equal splits: the first.
    """
    cuts = F.explode(F.sequence(F.lit(letters), F.length("term") - letters))
    split = rare.select("term").distinct().filter(F.length("term") >= 2 * letters).select("term", cuts.alias("at"))
    split = split.select("term", "at", F.expr("substring(term, 1, at)").alias("left"), F.expr("substring(term, at + 1)").alias("right"))
    words = vocabulary.filter(F.col("df") >= least)
    both = split.join(words.select(F.col("term").alias("left")), "left", "left_semi").join(words.select(F.col("term").alias("right")), "right", "left_semi")
    both = both.withColumn("phrase", F.concat_ws(" ", "left", "right")).join(phrases.select("phrase", F.col("df").alias("phrase_df")), "phrase", "left")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc(F.coalesce("phrase_df", F.lit(0))), "at"))
    return both.withColumn("place", place).filter("place = 1").select("term", F.col("phrase").alias("halves"), F.coalesce("phrase_df", F.lit(0)).cast("long").alias("phrase_df"))


def word_forms(term: Column) -> Column:
    """Up to eight other forms of an English word, nearest in length first: plurals, -ing, -ed, -er, -ion, -ment, -ly, both ways."""
    n = F.length(term)
    less = lambda k: F.substring(term, F.lit(1), n - k)
    add = lambda base, end: F.concat(base, F.lit(end))
    ends = lambda *xs: term.rlike(f"({'|'.join(xs)})$")
    silent = ends("e") & (n > 2)
    y = ends(f"[^{VOWELS}]y")
    short = n.between(3, 5) & term.rlike(f"[^{VOWELS}][{VOWELS}][{DOUBLED}]$")
    twice = F.concat(term, F.substring(term, -1, 1))
    forward = [
        F.when(y, add(less(1), "ies")).when(ends("s", "x", "z", "ch", "sh"), add(term, "es")).otherwise(add(term, "s")),
        F.when(silent & ~ends("ee"), add(less(1), "ing")).when(short, add(twice, "ing")).otherwise(add(term, "ing")),
        F.when(silent, add(term, "d")).when(short, add(twice, "ed")).when(y, add(less(1), "ied")).otherwise(add(term, "ed")),
        F.when(silent, add(term, "r")).otherwise(add(term, "er")),
        F.when(ends("t"), add(term, "ion")).when(silent, add(less(1), "ion")).otherwise(add(term, "ation")),
        F.when(silent & ~ends("t"), add(less(1), "ation")),
        add(term, "ment"),
        F.when(y, add(less(1), "ily")).otherwise(add(term, "ly")),
    ]

    def stems(end: str, k: int, least: int) -> list[Column]:
        doubled = term.rlike(rf"([{DOUBLED}])\1{end}$")
        on = ends(end) & (n > least)
        return [F.when(on & doubled, less(k + 1)).when(on, less(k)), F.when(on & ~doubled, add(less(k), "e"))]

    ied = ends("ied") & (n > 5)
    ed = [F.when(~ied, x) for x in stems("ed", 2, 4)]
    backward = [
        F.when(ends("ies") & (n > 4), add(less(3), "y")),
        F.when(ends("es") & (n > 4), less(2)),
        F.when(ends("s") & ~ends("ss") & (n > 3), less(1)),
        *stems("ing", 3, 5),
        F.when(ied, add(less(3), "y")),
        *ed,
        F.when(ends("er") & (n > 4), less(2)),
        F.when(ends("er") & (n > 4), less(1)),
        F.when(ends("ation") & (n > 6), add(less(3), "e")),
        F.when(ends("ation") & (n > 6), less(5)),
        F.when(ends("tion") & (n > 5), less(3)),
        F.when(ends("ion") & ~ends("tion") & (n > 4), less(3)),
        F.when(ends("ion") & ~ends("tion") & (n > 4), add(less(3), "e")),
        F.when(ends("ment") & (n > 5), less(4)),
        F.when(ends("ily") & (n > 4), add(less(3), "y")).when(ends("ly") & (n > 3), less(2)),
    ]
    forms = F.array_distinct(F.filter(F.array(*forward, *backward), lambda x: x.isNotNull() & (x != term) & (F.length(x) >= FORM_LETTERS)))
    ranked = F.array_sort(F.transform(forms, lambda x, i: F.struct(F.abs(F.length(x) - n).alias("d"), i.alias("i"), x.alias("x"))))
    return F.when(n >= FORM_LETTERS, F.transform(F.slice(ranked, 1, FORMS), lambda s: s["x"])).otherwise(F.array().cast("array<string>"))
