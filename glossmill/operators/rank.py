"""Fusing, capping, cutting and packing of ranked lists; one row is one item of one query's list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import text as t

RRF_K = 60
DIGITS = 6


def rrf_fuse(lists: DataFrame, *, query: str, item: str, k: int = RRF_K, base: int = 0) -> DataFrame:
    """(query, item, score, rank) from rows (query, list_no, rank from 1, item): the sum of 1 / (k + rank).

    base 0 counts ranks from 0 in the sum, 1 from 1. Equal scores: the item that
    appears first, by list and then by rank.
    """
    fused = lists.groupBy(query, item).agg(
        F.round(F.sum(1.0 / (k + F.col("rank") - 1 + base)), DIGITS).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen")
    )
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "seen"))
    return fused.select(query, item, "score", rank.alias("rank"))


def diversity_cap(ranked: DataFrame, *, query: str, group: str, most: int = 2) -> DataFrame:
    """At most so many rows of a group in each list, the best ones, ranks left as they are."""
    place = F.row_number().over(Window.partitionBy(query, group).orderBy("rank"))
    return ranked.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def relevance_cutoff(ranked: DataFrame, *, query: str, own_terms: str, fraction: float = 0.25, most: int = 6) -> DataFrame:
    """Rows with a share of the best score and a term of the question, the best six; the best row where none passes."""
    whole = Window.partitionBy(query)
    best = F.max("score").over(whole)
    own = F.transform(own_terms, t.singular)
    said = ranked.withColumn("_said", F.arrays_overlap(own, t.terms("text")))  # before the windows, which needn't carry the text for it
    passes = (F.col("score") >= fraction * best) & F.col("_said")
    marked = said.withColumn("_passes", F.coalesce(passes, F.lit(False))).drop("_said")
    place = F.row_number().over(whole.orderBy(F.desc("_passes"), "rank"))
    some = F.max("_passes").over(whole)
    marked = marked.withColumn("_place", place).withColumn("_some", some)
    return marked.filter((F.col("_passes") & (F.col("_place") <= most)) | (~F.col("_some") & (F.col("_place") == 1))).drop("_passes", "_place", "_some")


def pack_budget(ranked: DataFrame, *, query: str, item: str, tokens: str, budget: int = 2000) -> DataFrame:
    """(query, label, item, tokens): rows taken in rank order while they fit the budget; one too large is skipped, later ones still count.

    A list is as long as its ranking, which callers cut; it is folded inside one row.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col(item).alias("item"), F.col(tokens).cast("long").alias("tokens"))))
    listed = ranked.groupBy(query).agg(rows.alias("rows"))
    kind = listed.schema["rows"].dataType.simpleString()
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(kind).alias("kept"))

    def step(state, row):
        fits = row["tokens"] <= state["left"]
        return F.struct(
            F.when(fits, state["left"] - row["tokens"]).otherwise(state["left"]).alias("left"),
            F.when(fits, F.concat(state["kept"], F.array(row))).otherwise(state["kept"]).alias("kept"),
        )

    packed = listed.select(query, F.posexplode(F.aggregate("rows", start, step)["kept"]).alias("at", "row"))
    return packed.select(query, F.concat(F.lit("S"), (F.col("at") + 1).cast("string")).alias("label"), F.col("row.item").alias(item), F.col("row.tokens").alias("tokens"))


def rerank(ranked: DataFrame, *keys: Column, query: str) -> DataFrame:
    """The list in the order of the keys, then as it was."""
    return ranked.withColumn("new_rank", F.row_number().over(Window.partitionBy(query).orderBy(*keys, "rank")))


def _words(text) -> Column:
    return F.filter(F.split(F.lower(t.col(text)), r"\s+"), lambda w: w != "")


def title_boost(title: str, query_text: str) -> Column:
    """A key: titles that share more words with the question come first. Words are split at white space."""
    return -F.coalesce(F.size(F.array_intersect(_words(query_text), _words(title))), F.lit(0))


def mention_penalty(text: str, query_text: str, most: int = 5) -> Column:
    """A key: texts that say the question's words more than five times come last, the most so at the end."""
    asked = _words(query_text)
    said = F.size(F.filter(_words(text), lambda w: F.array_contains(asked, w)))
    return F.when(said > most, said).otherwise(0)


def lead_first(start: str) -> Column:
    """A key: a text that begins its article comes first."""
    return F.when(F.col(start) == 0, 0).otherwise(1)


def coverage(query_terms: Column, title: Column, text: Column, own_count: Column) -> Column:
    """Struct (term_coverage, title_match, weak) of one candidate.

    Weak: neither a term in the title nor 0.6 of the terms in the text. Where the
    question has three terms or more, a title match needs 0.34 of them in the text.
    """
    asked = F.array_distinct(F.transform(query_terms, t.singular))
    share = F.when(F.size(asked) > 0, F.round(F.size(F.array_intersect(asked, t.terms(text))) / F.size(asked), DIGITS)).otherwise(0.0)
    titled = F.arrays_overlap(asked, t.terms(title)) & ~((own_count >= 3) & (share < 0.34))
    share, titled = F.coalesce(share, F.lit(0.0)), F.coalesce(titled, F.lit(False))
    return F.struct(share.alias("term_coverage"), titled.alias("title_match"), (~titled & (share < 0.6)).alias("weak"))


def merge_lists(lists: DataFrame, queries: DataFrame, *, group: str, cap: int = 8) -> DataFrame:
    """(group, item, title, place) from rows (group, list_no, rank, item, title): lists of several queries merged.

    Articles (titles) come by: not generic, lists that hold them, fused score with
    title boost and penalty, best rank, title; items of an article by their own fused
    score, best rank, item. queries: (group, list_no, terms). Generic is a title of
    one term, of a disambiguation, or that shares but one term with all the queries.
    """
    asked = queries.groupBy(group).agg(F.collect_list("terms").alias("sets")).withColumn("union", F.array_distinct(F.flatten("sets")))
    share = lambda rank: 1.0 / (RRF_K + rank)
    per_list = lists.groupBy(group, "title", "list_no").agg(F.min("rank").alias("rank"))
    articles = per_list.groupBy(group, "title").agg(F.count("*").alias("hits"), F.sum(share(F.col("rank"))).alias("rrf"), F.min("rank").alias("best"))
    terms = t.terms(F.coalesce("title", F.lit("")))
    articles = articles.join(asked, group).withColumn("terms", terms)
    within = F.exists("sets", lambda s: F.size(F.array_except("terms", s)) == 0) & (F.size("terms") > 0)
    shared = F.size(F.array_intersect("terms", "union"))
    generic = F.lower(F.coalesce("title", F.lit(""))).contains("disambiguation") | (F.size("terms") <= 1) | ((F.size(F.array_except("terms", "union")) > 0) & (shared <= 1))
    score = F.round(F.col("rrf") + F.when(within, 0.5).otherwise(0.0) - F.when(generic, 0.5).otherwise(0.0), DIGITS)
    order = Window.partitionBy(group).orderBy("generic", F.desc("hits"), F.desc("score"), "best", "title")
    articles = articles.withColumn("generic", generic).withColumn("score", score).select(group, "title", F.row_number().over(order).alias("article"))
    items = lists.groupBy(group, "item", "title").agg(F.round(F.sum(share(F.col("rank"))), DIGITS).alias("rrf"), F.min("rank").alias("best"))
    joined = items.join(articles, (items[group] == articles[group]) & items["title"].eqNullSafe(articles["title"])).select(items[group], items["item"], items["title"], "rrf", "best", "article")
    place = F.row_number().over(Window.partitionBy(group).orderBy("article", F.desc("rrf"), "best", "item"))
    return joined.withColumn("place", place).filter(F.col("place") <= cap).select(group, "item", "title", "place")
