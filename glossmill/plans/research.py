"""The whole way from questions to packed evidence, for a batch of questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import text as t
from glossmill.operators import correct, index, rank
from glossmill.session import cut

POOL, BUDGET = 20, 2000


def candidates(asked: DataFrame, docs: DataFrame, held: index.Index, *, query: str, key: str, group: str) -> DataFrame:
    """(query, key, rank, c, size) of the evidence for each question of asked (query, q, own): c is rank.coverage().

    Candidates by BM25 are fused with those by title, ordered by words shared with the
    title and then by mentions, capped by group, and cut where they stop being relevant.
    """
    by_text = index.search_top(asked, held, POOL, query=query, query_text="q", key=key)
    titles = asked.select(query, F.explode("own").alias("term")).join(docs.select(key, F.explode(F.array_distinct(t.tokens("title"))).alias("term")), "term")
    by_title = index.top(titles.groupBy(query, key).agg(F.count("*").cast("double").alias("score")), POOL, query=query, key=key)
    lists = by_text.select(query, F.lit(0).alias("list_no"), "rank", key).unionByName(by_title.select(query, F.lit(1).alias("list_no"), "rank", key))
    fused = rank.rrf_fuse(lists, query=query, item=key).filter(F.col("rank") <= POOL)
    pool = index.with_texts(cut(fused.join(asked, query)), docs.select(key, group, "title", "text"), key=key)
    ordered = rank.rerank(pool, rank.title_boost("title", "q"), rank.mention_penalty("text", "q"), query=query).drop("rank").withColumnRenamed("new_rank", "rank")
    kept = rank.relevance_cutoff(rank.diversity_cap(ordered, query=query, group=group), query=query, own_terms="own")
    graded = kept.withColumn("c", rank.coverage(F.col("own"), F.col("title"), F.col("text"), F.size("own"))).withColumn("size", t.estimate_tokens("text"))
    return cut(graded.select(query, key, "rank", "c", "size"))


def corrected(asked: DataFrame, held: index.Index, *, query: str) -> DataFrame:
    """(query, q, own): questions with terms that the corpus doesn't have as their spelling suggests, and with the form of each known term that most texts have added.

    A question that nothing is changed in has no row.
    """
    said = asked.select(query, F.posexplode(t.tokens("q")).alias("at", "term"))
    terms = said.select("term").distinct()
    known = terms.join(held.terms, "term").select("term", "df")
    mended = correct.spelling(terms.join(held.terms, "term", "left_anti"), held.terms).select("term", F.col("best").alias("other"))
    forms = known.filter("term RLIKE '^[a-z]+$'").select("term", F.explode(correct.word_forms(F.col("term"))).alias("form"))
    forms = forms.join(held.terms.select(F.col("term").alias("form"), "df"), "form").filter(F.col("df") >= correct.LEAST_DF)
    best = forms.groupBy("term").agg(F.max_by("form", F.struct("df", "form")).alias("more"))
    words = said.join(mended, "term", "left").join(best, "term", "left").select(query, "at", "term", "other", "more")
    listed = words.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("other", "term").alias("word")))).alias("w"), F.collect_set("more").alias("more"), F.max(F.coalesce("other", "more").isNotNull()).alias("changed"))
    own = F.transform("w", lambda x: x["word"])
    return listed.filter("changed").select(query, F.array_join(F.concat(own, F.array_sort("more")), " ").alias("q"), F.array_distinct(own).alias("own"))


def research(questions: DataFrame, docs: DataFrame, *, query: str, text: str, key: str, group: str) -> DataFrame:
    """(query, label, key, tokens, status, coverage, searched_again) of the evidence for each question; one row of nulls where there is none.

    Only questions whose evidence is weak, or that have none, are searched again, with
    spelling mended and word forms added; the second evidence counts where it covers
    more. What is left is packed into the budget. status: ok if a candidate covers the
    question, partial if none does, empty without candidates. docs: key, group, title, text.
    """
    held = index.kept(docs, key=key)
    asked = questions.select(F.col(query).alias("_query"), F.col(text).alias("q")).withColumn("own", t.question_terms("q"))
    docs = docs.select(F.col(key).alias("_key"), F.col(group).alias("_group"), "title", "text")
    names = {"query": "_query", "key": "_key", "group": "_group"}
    first = candidates(asked, docs, held, **names)
    weak = asked.join(_grades(first, "_query").filter("NOT weak"), "_query", "left_anti")
    second = candidates(cut(corrected(weak, held, query="_query")), docs, held, **names)
    was, now = _grades(first, "_query"), _grades(second, "_query").withColumnRenamed("coverage", "again").select("_query", "again")
    better = now.join(was, "_query", "left").filter(F.col("again") > F.coalesce("coverage", F.lit(0.0))).select("_query")
    chosen = cut(first.join(better, "_query", "left_anti").withColumn("again", F.lit(False)).unionByName(second.join(better, "_query", "left_semi").withColumn("again", F.lit(True))))
    packed = rank.pack_budget(chosen, query="_query", item="_key", tokens="size", budget=BUDGET)
    status = F.when(F.col("weak").isNull(), "empty").when(F.col("weak"), "partial").otherwise("ok")
    grade = _grades(chosen, "_query", F.max("again").alias("searched_again"))
    out = asked.select("_query").join(grade, "_query", "left").join(packed, "_query", "left")
    return out.select(F.col("_query").alias(query), "label", F.col("_key").alias(key), "tokens", status.alias("status"), "coverage", F.coalesce("searched_again", F.lit(False)).alias("searched_again"))


def _grades(graded: DataFrame, query: str, *more: Column) -> DataFrame:
    return graded.groupBy(query).agg(F.max(F.col("c.term_coverage")).alias("coverage"), F.min(F.col("c.weak")).alias("weak"), *more)
