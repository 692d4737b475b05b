"""Which passage backs which sentence of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import text as t

SHARED, SHARE = 2, 0.30
STACKED, LONG_ANSWER, COPIED, COPIES = 4, 60, 0.80, 3


def sentence_terms(answers: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, no, sentence, terms): sentences that claim something, with their distinct terms."""
    parts = answers.select(key, F.posexplode(t.sentences(text)).alias("no", "sentence")).filter(~t.is_no_claim("sentence"))
    return parts.withColumn("terms", F.array_distinct(t.tokens("sentence"))).filter(F.size("terms") > 0)


def overlaps(sentences: DataFrame, passages: DataFrame, *, key: str, passage: str, text: str) -> DataFrame:
    """(key, no, passage, shared, own): shared terms of each sentence with each passage of its answer, by an equi-join on terms."""
    held = passages.select(key, passage, F.explode(F.array_distinct(t.tokens(text))).alias("term"))
    asked = sentences.select(key, "no", F.size("terms").alias("own"), F.explode("terms").alias("term"))
    return asked.join(held, [key, "term"]).groupBy(key, "no", passage, "own").agg(F.count("*").alias("shared"))


def best_passages(sentences: DataFrame, passages: DataFrame, *, key: str, passage: str, text: str) -> DataFrame:
    """(key, no, passage, shared): the passage that shares most with a sentence, two terms or 0.3 of its terms at least; none: nulls."""
    found = overlaps(sentences, passages, key=key, passage=passage, text=text)
    found = found.filter((F.col("shared") >= SHARED) | (F.col("shared") >= SHARE * F.col("own")))
    place = F.row_number().over(Window.partitionBy(key, "no").orderBy(F.desc("shared"), passage))
    best = found.withColumn("place", place).filter("place = 1").select(key, "no", passage, "shared")
    return sentences.select(key, "no").join(best, [key, "no"], "left")


def supported_figures(sentences: DataFrame, passages: DataFrame, *, key: str, text: str, said: Column | None = None) -> DataFrame:
    """(key, no, figures, missing): the numbers of a sentence (or those that said gives), and how many of them no passage of its answer has."""
    said = sentences.select(key, "no", F.explode_outer(t.figures("sentence") if said is None else said).alias("figure"))
    held = passages.select(key, F.explode(F.regexp_extract_all(F.regexp_replace(text, "−", "-"), F.lit(r"(-?\d+(?:\.\d+)?)"))).alias("figure")).distinct().withColumn("held", F.lit(1))
    both = said.join(held, [key, "figure"], "left")
    return both.groupBy(key, "no").agg(F.count("figure").alias("figures"), F.count_if(F.col("figure").isNotNull() & F.col("held").isNull()).alias("missing"))


def unheld_names(sentences: DataFrame, passages: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, no, names, strange): the proper names of a sentence, and how many of them have no word that a passage of its answer holds as a whole word."""
    said = sentences.select(key, "no", F.explode(t.names("sentence")).alias("name"))
    words = said.select(key, F.explode(F.array_distinct(F.split(F.lower("name"), r"\s+"))).alias("word")).distinct()
    low = passages.select(key, F.lower(text).alias("low"))
    whole = F.contains("low", "word") & F.expr(r"low RLIKE concat(r'(?<![\p{L}\p{N}_])', word, r'(?![\p{L}\p{N}_])')")
    held = words.join(low, key).filter(whole).select(key, "word").distinct().withColumn("held", F.lit(1))
    parts = said.select(key, "no", "name", F.explode(F.split(F.lower("name"), r"\s+")).alias("word")).join(held, [key, "word"], "left")
    by = parts.groupBy(key, "no", "name").agg(F.max("held").alias("held"))
    return by.groupBy(key, "no").agg(F.count("*").alias("names"), F.count_if(F.col("held").isNull()).alias("strange"))


def supported(sentences: DataFrame, passages: DataFrame, *, key: str, passage: str, text: str) -> DataFrame:
    """(key, no, passage, missing, strange, supported): whether a passage shares enough with a sentence and its answer's passages hold all its figures and names."""
    best = best_passages(sentences, passages, key=key, passage=passage, text=text)
    figures = supported_figures(sentences, passages, key=key, text=text, said=t.claimed_figures("sentence")).select(key, "no", "missing")
    names = unheld_names(sentences, passages, key=key, text=text).select(key, "no", "strange")
    both = best.join(figures, [key, "no"]).join(names, [key, "no"], "left").fillna(0, ["strange"])
    held = F.col(passage).isNotNull() & (F.col("missing") == 0) & (F.col("strange") == 0)
    return both.select(key, "no", passage, "missing", "strange", held.alias("supported"))


def copied_labels(answers: DataFrame, passages: DataFrame, *, key: str, text: str, label: str, passage: str) -> DataFrame:
    """(key, copied): how many labels of an answer are copied: their passage has 0.8 of the terms of a sentence that carries them."""
    parts = answers.select(key, F.explode(t.sentences(text)).alias("sentence"))
    said = parts.select(key, F.explode(t.labels("sentence")).alias(label), F.array_distinct(t.tokens("sentence")).alias("own")).filter(F.size("own") > 0)
    held = passages.select(key, label, F.array_distinct(t.tokens(passage)).alias("held"))
    share = F.size(F.array_intersect("own", "held")) / F.size("own")
    both = said.join(held, [key, label])
    return both.groupBy(key).agg(F.count_distinct(F.when(share >= COPIED, F.col(label))).alias("copied"))


def dumps(answers: DataFrame, passages: DataFrame, *, key: str, text: str, label: str, passage: str) -> DataFrame:
    """(key, most_labels, long, copied, dump): long answers with a sentence that carries four labels or more, and any that copy the passages of three labels."""
    parts = answers.select(key, F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("words"), F.explode(t.sentences(text)).alias("s"))
    by = parts.groupBy(key).agg(F.max(F.size(t.labels("s"))).alias("most_labels"), (F.max("words") >= LONG_ANSWER).alias("long"))
    copies = copied_labels(answers, passages, key=key, text=text, label=label, passage=passage)
    both = by.join(copies, key, "left").fillna(0, ["copied"])
    dump = (F.col("long") & (F.col("most_labels") >= STACKED)) | (F.col("copied") >= COPIES)
    return both.select(key, "most_labels", "long", "copied", dump.alias("dump"))
