"""Queries of retrieval, fusion, packing and grading: questions of every fiftieth turn against all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.functions import sql
from glossmill.functions import text as t
from glossmill.operators import dense, index, rank
from glossmill.operators.best import best
from glossmill.plans.text_queries import documents, questions
from glossmill.session import cut
from glossmill.sources.tables import table

POOL = 20


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set: turns whose id is divisible by 50."""
    return questions(spark, folder).filter(F.col("turn_id") % 50 == 0)


def library(spark, folder) -> index.Index:
    return index.kept(table(spark, folder, "documents", "doc_id", "text"), key="doc_id")


def searched(spark, folder, asked: DataFrame) -> DataFrame:
    """The best documents of each question of asked (turn_id, q)."""
    return index.search_top(asked, library(spark, folder), POOL, query="turn_id", query_text="q", key="doc_id").select("turn_id", "doc_id", "score", "rank")


def bm25_pool(spark, folder):
    return searched(spark, folder, _asked(spark, folder))


def bm25_topk(spark, folder):
    return bm25_pool(spark, folder).filter("rank <= 5")


def term_stats(spark, folder):
    held = library(spark, folder)
    return held.terms.select("term", "cf", "df", F.lit(held.docs).cast("long").alias("docs"), F.round(F.lit(held.mean), 6).alias("mean_len"))


def doc_freq(spark, folder):
    return library(spark, folder).terms.select("term", "df")


def _pool(spark, folder):
    """bm25_pool() with what the later steps read."""
    docs = documents(spark, folder).select("doc_id", "title", "text", "source")
    return index.with_texts(cut(bm25_pool(spark, folder).join(_asked(spark, folder), "turn_id")), docs, key="doc_id")


pool = _pool


def _title_and_text():
    return F.array_union(F.coalesce(t.terms("title"), F.array().cast("array<string>")), t.terms("text"))


def _title_ranks(spark, folder):
    """Documents by how many of the question's terms their title has."""
    asked = index.exploded(_asked(spark, folder), "turn_id", terms=F.array_distinct(t.tokens("q")))
    return index.match_top(asked, documents(spark, folder).select(F.col("doc_id").alias("key"), t.tokens("title").alias("list")), POOL, query="turn_id", key="doc_id")


def rrf_fuse(spark, folder):
    lists = bm25_pool(spark, folder).select("turn_id", F.lit(0).alias("list_no"), "rank", "doc_id")
    lists = lists.unionByName(_title_ranks(spark, folder).select("turn_id", F.lit(1).alias("list_no"), "rank", "doc_id"))
    return rank.rrf_fuse(lists, query="turn_id", item="doc_id")


def diversity_cap(spark, folder):
    pool = bm25_pool(spark, folder).join(documents(spark, folder).select("doc_id", "source"), "doc_id")
    return rank.diversity_cap(pool, query="turn_id", group="source").select("turn_id", "doc_id", "source", "rank")


def relevance_cutoff(spark, folder):
    pool = _pool(spark, folder).withColumn("own", t.question_terms("q"))
    return rank.relevance_cutoff(pool, query="turn_id", own_terms="own").select("turn_id", "doc_id", "rank")


def packets(spark, folder, asked: DataFrame) -> DataFrame:
    """(turn_id, label, doc_id, text): the passages of pack_budget for the questions of asked."""
    docs = documents(spark, folder).select("doc_id", "text")
    pool = index.with_texts(cut(searched(spark, folder, asked)), docs.select("doc_id", t.estimate_tokens("text").alias("tokens")), key="doc_id")
    packed = cut(rank.pack_budget(pool, query="turn_id", item="doc_id", tokens="tokens").select("turn_id", "label", "doc_id"))
    return index.with_texts(packed, docs, key="doc_id")


def pack_budget(spark, folder):
    pool = _pool(spark, folder).withColumn("tokens", t.estimate_tokens("text"))
    return rank.pack_budget(pool, query="turn_id", item="doc_id", tokens="tokens")


def trim_to_budget(spark, folder):
    """The longest head of each list whose texts with labels and line ends are 2,000 tokens at most."""
    chars = F.length("text") + F.length(F.col("rank").cast("string")) + 5
    running = F.sum(chars).over(Window.partitionBy("turn_id").orderBy("rank"))
    pool = _pool(spark, folder).withColumn("tokens", F.ceil(running / F.lit(3.5)))
    return pool.filter("tokens <= 2000").select("turn_id", "doc_id", "rank", F.col("tokens").cast("long").alias("tokens"))


def _reranked(spark, folder, *keys):
    return rank.rerank(_pool(spark, folder), *keys, query="turn_id").select("turn_id", "doc_id", "rank", "new_rank")


def rank_title_boost(spark, folder):
    return _reranked(spark, folder, rank.title_boost("title", "q"))


def rank_mention_penalty(spark, folder):
    return _reranked(spark, folder, rank.mention_penalty("text", "q"))


def _asked_snapshots(spark, folder):
    """Snapshots by how many of the question's terms their text has, with heading and offset."""
    rows = table(spark, folder, "snapshots", "passage_id", "heading_path", "start_offset", "text").filter("text IS NOT NULL")
    asked = index.exploded(_asked(spark, folder), "turn_id", terms=F.array_distinct(t.tokens("q")))
    hits = index.match_top(asked, rows.select(F.col("passage_id").alias("key"), t.tokens("text").alias("list")), POOL, query="turn_id", key="passage_id")
    ranked = cut(hits.join(_asked(spark, folder).select("turn_id", "q"), "turn_id"))
    return index.with_texts(ranked, rows.drop("text"), key="passage_id").dropDuplicates(["turn_id", "passage_id"])


def rank_heading_affinity(spark, folder):
    heading = F.regexp_replace("heading_path", "\x1f", " ")
    pool = _asked_snapshots(spark, folder).withColumn("heading", heading)
    return rank.rerank(pool, rank.title_boost("heading", "q"), query="turn_id").select("turn_id", "passage_id", "rank", "new_rank")


def rank_lead_first(spark, folder):
    return rank.rerank(_asked_snapshots(spark, folder), rank.lead_first("start_offset"), query="turn_id").select("turn_id", "passage_id", "rank", "new_rank")


def rarity_order(spark, folder):
    """The terms of each question by document frequency, rarest first, terms that occur nowhere left out."""
    asked = _asked(spark, folder).select("turn_id", F.posexplode(t.tokens("q")).alias("at", "term")).groupBy("turn_id", "term").agg(F.min("at").alias("at"))
    known = asked.join(doc_freq(spark, folder), "term")
    order = F.row_number().over(Window.partitionBy("turn_id").orderBy("df", "at"))
    return known.select("turn_id", "term", "df", order.alias("place"))


def coordination_rank(spark, folder):
    """Documents by how many different terms of the question they have, then by their rarest term, then id."""
    terms = rarity_order(spark, folder).select("turn_id", "term", "place")
    found = best(cut(terms.withColumn("weight", F.lit(1.0))), library(spark, folder).texts, query="turn_id", key="doc_id", k=6)
    hits = found.select("turn_id", "doc_id", F.col("score").cast("long").alias("matched"), F.col("least").alias("rarest"))
    order = F.row_number().over(Window.partitionBy("turn_id").orderBy(F.desc("matched"), "rarest", "doc_id"))
    return hits.withColumn("rank", order).filter(F.col("rank") <= 6)


def unknown_terms(spark, folder):
    """Question terms that neither the documents nor the snapshots have, by first place."""
    asked = questions(spark, folder).select("turn_id", F.posexplode(t.tokens("q")).alias("at", "term")).groupBy("turn_id", "term").agg(F.min("at").alias("at"))
    held = index.exploded(documents(spark, folder), terms=t.tokens("text"))
    held = held.unionByName(index.exploded(table(spark, folder, "snapshots", "text"), terms=t.tokens("text"))).distinct()
    return asked.join(held, "term", "left_anti").select("turn_id", "term", "at")


def score_articles(spark, folder):
    """Candidates of the pool by rarity-weighted shared terms, with a bonus for titles made of them; roles weigh terms."""
    pool = _pool(spark, folder).select("turn_id", "doc_id", "q", t.terms("title").alias("title_terms"), t.terms("text").alias("lead"))
    terms = _asked(spark, folder).select("turn_id", F.explode(F.transform(F.array_distinct(t.tokens(t.strip_instruction("q"))), t.singular)).alias("term")).distinct()
    freq = index.exploded(documents(spark, folder), terms=t.terms("text")).groupBy("term").agg(F.count("*").alias("df"))
    roles = _asked(spark, folder).select("turn_id", F.inline(t.role_weights("q"))).groupBy("turn_id", "term").agg(F.max("weight").alias("role"))
    weighed = terms.join(freq, "term", "left").join(roles, ["turn_id", "term"], "left")
    weight = F.when(F.col("df").isNull(), 0.0005).otherwise(1.0 / F.col("df")) * F.coalesce("role", F.lit(1.0))
    weighed = cut(weighed.select("turn_id", "term", weight.alias("w")))
    pairs = pool.join(F.broadcast(weighed) if weighed.count() <= index.POOL_ROWS else weighed, "turn_id")
    titled, led = F.array_contains("title_terms", F.col("term")), F.array_contains("lead", F.col("term"))
    sums = pairs.groupBy("turn_id", "doc_id").agg(
        F.sum(F.when(titled | led, F.col("w")).otherwise(0.0)).alias("coordination"),
        F.sum(F.when(titled, F.col("w")).otherwise(0.0)).alias("in_title"),
        F.count_if(titled).alias("matched"),
        F.first(F.size("title_terms")).alias("n"),
    )
    bonus = F.when(F.col("n") > 0, F.col("matched") / F.col("n") * F.col("in_title")).otherwise(0.0)
    return sums.select("turn_id", "doc_id", F.round(F.col("coordination") + bonus, 6).alias("score"))


def coverage(spark, folder):
    pool = _pool(spark, folder).filter("rank <= 3").withColumn("own", t.coverage_terms("q", "subject"))
    graded = rank.coverage(F.col("own"), F.col("title"), F.col("text"), F.size(F.array_distinct(t.tokens(t.strip_instruction("q")))))
    return pool.select("turn_id", "doc_id", "rank", graded.alias("c")).select("turn_id", "doc_id", "rank", "c.*")


def best_coverage(spark, folder):
    """The first of the three best candidates that isn't weak, else the one that covers most; none: nothing covered."""
    graded = coverage(spark, folder)
    best = graded.groupBy("turn_id").agg(F.min_by(F.struct("term_coverage", "title_match", "weak"), F.struct(F.when(F.col("weak"), 1).otherwise(0), F.when(F.col("weak"), -F.col("term_coverage")).otherwise(0.0), "rank")).alias("b"))
    asked = _asked(spark, folder).select("turn_id").join(best, "turn_id", "left")
    return asked.select("turn_id", F.coalesce("b.term_coverage", F.lit(0.0)).alias("term_coverage"), F.coalesce("b.title_match", F.lit(False)).alias("title_match"), F.coalesce("b.weak", F.lit(True)).alias("weak"))


def assess_basic(spark, folder):
    """strong, weak or empty: how much of the question's key terms the three best candidates hold together."""
    pool = _pool(spark, folder).filter("rank <= 3")
    held = pool.groupBy("turn_id").agg(F.array_distinct(F.flatten(F.collect_list(_title_and_text()))).alias("held"))
    asked = _asked(spark, folder).select("turn_id", F.array_distinct(F.transform(F.array_except(t.question_terms("q"), t.strings(t.words.QUESTION_FILLERS)), t.singular)).alias("key"))
    both = asked.join(held, "turn_id", "left")
    covered = F.when(F.size("key") > 0, F.round(F.size(F.array_intersect("key", F.coalesce("held", F.array().cast("array<string>")))) / F.size("key"), 6)).otherwise(0.0)
    level = F.when(F.col("held").isNull(), "empty").when(covered >= 0.5, "strong").otherwise("weak")
    return both.select("turn_id", covered.alias("coverage"), level.alias("level"))


def assess_full(spark, folder):
    """assess_basic(), where strong also needs the question's numbers, and for a question of measure a superlative, in the evidence."""
    pool = _pool(spark, folder).filter("rank <= 3")
    words = F.array_distinct(F.flatten(F.collect_list(F.array_union(F.coalesce(t.all_tokens("title"), F.array().cast("array<string>")), t.all_tokens("text")))))
    held = pool.groupBy("turn_id").agg(words.alias("words"))
    asked = _asked(spark, folder).select("turn_id", F.array_distinct(F.filter(t.all_tokens("q"), lambda x: x.rlike("^[0-9]+$"))).alias("numbers"), (F.size(t.modifiers("q")) > 0).alias("measure"))
    graded = assess_basic(spark, folder).join(asked, "turn_id").join(held, "turn_id", "left")
    none = F.array().cast("array<string>")
    numbers = F.size(F.array_except("numbers", F.coalesce("words", none))) == 0
    superlative = ~F.col("measure") | F.exists(F.coalesce("words", none), t.is_superlative)
    reasons = F.filter(F.array(F.when(F.col("coverage") < 0.5, "coverage"), F.when(~numbers, "number"), F.when(~superlative, "superlative")), lambda x: x.isNotNull())
    level = F.when(F.col("level") == "empty", "empty").when(F.size(reasons) == 0, "strong").otherwise("weak")
    return graded.select("turn_id", level.alias("level"), F.array_join(reasons, ",").alias("reasons"))


def drop_modifier_only(spark, folder):
    """The pool without candidates that share only measuring words with the question, unless none would be left."""
    pool = _pool(spark, folder).withColumn("mods", F.transform(t.modifiers("q"), t.singular))
    topic = F.filter(F.transform(t.question_terms("q"), t.singular), lambda x: F.length(x) > 1)
    pool = pool.withColumn("topic", topic).withColumn("both", _title_and_text())
    drop = (F.size("mods") > 0) & (F.size("topic") > 0) & ~F.coalesce(F.arrays_overlap("both", "topic"), F.lit(False)) & F.coalesce(F.arrays_overlap("both", "mods"), F.lit(False))
    pool = pool.withColumn("drop", F.coalesce(drop, F.lit(False)))
    left = F.count_if(~F.col("drop")).over(Window.partitionBy("turn_id"))
    return pool.withColumn("left", left).filter(~F.col("drop") | (F.col("left") == 0)).select("turn_id", "doc_id", "rank")


def merge_queries(spark, folder):
    """The pools of the questions of one subject merged into one list of eight."""
    pool = _pool(spark, folder).filter("subject IS NOT NULL")
    lists = pool.select("subject", F.col("turn_id").alias("list_no"), (F.col("rank")).alias("rank"), F.col("doc_id").alias("item"), "title")
    asked = _asked(spark, folder).filter("subject IS NOT NULL").select("subject", F.col("turn_id").alias("list_no"), t.terms("q").alias("terms"))
    return rank.merge_lists(lists, asked, group="subject")


def lead_with_backfill(spark, folder):
    """The five best titles, filled up from the pool to eight, no document twice."""
    lead = _title_ranks(spark, folder).filter("rank <= 5").select("turn_id", "doc_id", F.lit(0).alias("list_no"), "rank")
    fill = bm25_pool(spark, folder).select("turn_id", "doc_id", F.lit(1).alias("list_no"), "rank")
    first = lead.unionByName(fill).groupBy("turn_id", "doc_id").agg(F.min(F.struct("list_no", "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy("turn_id").orderBy("at"))
    return first.withColumn("place", place).filter("place <= 8").select("turn_id", "doc_id", "place", F.concat(F.lit("S"), F.col("place").cast("string")).alias("label"))


def eval_recall_mrr(spark, folder):
    """Known-item search: titles of every fiftieth document as questions, recall and MRR for all and by language."""
    docs = documents(spark, folder)
    asked = docs.filter("doc_id % 50 = 0 AND title IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("want"), F.col("title").alias("q"), "lang")
    found = index.bm25_top(asked, docs.select("doc_id", F.concat_ws(" ", "title", "text").alias("text")), 5, query="want", query_text="q", key="doc_id")
    hits = found.filter("want = doc_id").select("want", "rank")
    found = asked.join(hits, "want", "left")
    at = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    metrics = [F.count("*").alias("n"), at(1).alias("recall_1"), at(3).alias("recall_3"), at(5).alias("recall_5"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")]
    return found.cube("lang").agg(F.grouping("lang").cast("int").alias("all_languages"), *metrics)


def dense_topk(spark, folder):
    vectors = table(spark, folder, "embeddings", "vec_id", "embedding")
    found = dense.dense_topk(vectors.filter(F.col("vec_id") % 50 == 0), vectors, k=10)
    return found.select("vec_id", "rank", "other", F.round("cosine", 4).alias("cosine"))


QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_pool, term_stats, doc_freq, rrf_fuse, diversity_cap, relevance_cutoff, pack_budget, trim_to_budget, rank_title_boost, rank_mention_penalty,
    rank_heading_affinity, rank_lead_first, rarity_order, coordination_rank, unknown_terms, score_articles, coverage, best_coverage, assess_basic, assess_full,
    drop_modifier_only, merge_queries, lead_with_backfill, eval_recall_mrr, dense_topk,
)}

_Q = f"q AS (SELECT DISTINCT turn_id, input_text AS q, subject FROM turn_records WHERE trim(input_text) <> '' AND turn_id % 50 = 0)"


def _bm25(asked: str, text: str, pool: int, name: str = "pool") -> str:
    """CTEs of BM25: asked has (query, words); text: what of a document is searched."""
    return f"""
        d AS (SELECT doc_id, {sql.tokens(text)} AS w FROM documents),
        n AS (SELECT count(*) AS n, avg(coalesce(len(w), 0)) AS mean FROM d),
        qt AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest(words) AS term FROM {asked}) GROUP BY ALL),
        tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        sc AS (SELECT query, doc_id, round(sum(qtf * greatest(0, ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)))) * (tf * CAST(2.2 AS DOUBLE))
                      / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / mean))), 6) AS score
               FROM tf JOIN df USING (term) JOIN qt USING (term), n GROUP BY ALL),
        {name} AS (SELECT * FROM (SELECT query AS turn_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc WHERE score > 0) WHERE rank <= {pool})"""


_POOL = f"WITH RECURSIVE {_Q}, asked AS (SELECT turn_id AS query, {sql.tokens('q')} AS words FROM q), {_bm25('asked', 'text', POOL)}"
_FULL = _POOL + ", full_pool AS (SELECT pool.*, title, text, source, q, subject FROM pool JOIN documents USING (doc_id) JOIN q USING (turn_id))"
_TITLES = f"""
        tq AS (SELECT turn_id, unnest(list_distinct({sql.tokens('q')})) AS term FROM q), td AS (SELECT doc_id, unnest(list_distinct({sql.tokens('title')})) AS term FROM documents),
        th AS (SELECT turn_id, doc_id, count(*) AS score FROM tq JOIN td USING (term) GROUP BY ALL),
        titled AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM th) WHERE rank <= {POOL})"""
_WORDS = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> '')"
_OVERLAP = "len(list_filter(list_distinct({}), lambda w: list_contains({}, w)))"
_HEADING = "replace(heading_path, chr(31), ' ')"
_PASSAGES = f"""WITH {_Q},
        s AS (SELECT DISTINCT passage_id, heading_path, start_offset, text FROM snapshots WHERE text IS NOT NULL),
        pq AS (SELECT turn_id, q, unnest(list_distinct({sql.tokens('q')})) AS term FROM q), ps AS (SELECT passage_id, unnest(list_distinct({sql.tokens('text')})) AS term FROM s),
        ph AS (SELECT turn_id, q, passage_id, count(*) AS score FROM pq JOIN ps USING (term) GROUP BY ALL),
        hit AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, passage_id) AS INTEGER) AS rank FROM ph) WHERE rank <= {POOL}),
        p AS (SELECT hit.*, heading_path, start_offset FROM hit JOIN (SELECT DISTINCT passage_id, heading_path, start_offset FROM s) USING (passage_id))"""
_RARITY = f"""
        ra AS (SELECT turn_id, term, min(i) AS i FROM (SELECT turn_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM (SELECT turn_id, {sql.tokens('q')} AS w FROM q)) GROUP BY ALL),
        rd AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({sql.tokens('text')})) AS term FROM documents) GROUP BY term),
        rarity AS (SELECT turn_id, term, df, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY df, i) AS INTEGER) AS place FROM ra JOIN rd USING (term))"""
_OWN = f"list_distinct({sql.tokens('(' + sql.strip_instruction('q') + ')')})"
_SINGULAR = f"list_distinct(list_transform({{}}, lambda x: {sql.singular('x')}))"
_COVER_TERMS = (
    f"list_filter(CASE WHEN subject IS NOT NULL AND (len(list_filter({_OWN}, lambda x: x NOT IN ({sql.quoted(sql.words.CONTINUATION_FILLERS)}))) <= 1 "
    f"OR regexp_matches(q, '(?i)\\b(it|its|this|that|those|them|again)\\b')) THEN list_distinct(list_concat({_OWN}, {sql.tokens('subject')})) ELSE {_OWN} END, "
    f"lambda x: NOT list_contains({sql.modifiers('q')}, x))"
)
_COVERAGE = f"""
        cq AS (SELECT turn_id, {_SINGULAR.format(_COVER_TERMS)} AS own, len({_OWN}) AS n FROM q),
        cd AS (SELECT pool.turn_id, doc_id, rank, own, n, coalesce({sql.terms('title')}, []) AS tt, coalesce({sql.terms('text')}, []) AS xt
               FROM pool JOIN documents USING (doc_id) JOIN cq USING (turn_id) WHERE rank <= 3),
        cs AS (SELECT *, CASE WHEN len(own) > 0 THEN round(len(list_filter(own, lambda x: list_contains(xt, x))) / len(own), 6) ELSE CAST(0 AS DOUBLE) END AS share FROM cd),
        cc AS (SELECT turn_id, doc_id, rank, share AS term_coverage, len(list_filter(own, lambda x: list_contains(tt, x))) > 0 AND NOT (n >= 3 AND share < 0.34) AS title_match FROM cs),
        graded AS (SELECT *, NOT title_match AND term_coverage < 0.6 AS weak FROM cc)"""

SQL_POOL = f"{_POOL} SELECT turn_id, doc_id, score, rank FROM pool"
SQL = {
    "bm25_topk": f"{_POOL} SELECT turn_id, doc_id, score, rank FROM pool WHERE rank <= 5",
    "bm25_pool": f"{_POOL} SELECT turn_id, doc_id, score, rank FROM pool",
    "term_stats": f"""
        WITH d AS (SELECT doc_id, {sql.tokens('text')} AS w FROM documents), n AS (SELECT count(*) AS docs, round(avg(coalesce(len(w), 0)), 6) AS mean_len FROM d)
        SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df, any_value(docs) AS docs, any_value(mean_len) AS mean_len FROM (SELECT doc_id, unnest(w) AS term FROM d), n GROUP BY term""",
    "doc_freq": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({sql.tokens('text')})) AS term FROM documents) GROUP BY term",
    "rrf_fuse": f"""{_POOL}, {_TITLES},
        u AS (SELECT turn_id, doc_id, 0 AS l, rank FROM pool UNION ALL SELECT turn_id, doc_id, 1, rank FROM titled),
        f AS (SELECT turn_id, doc_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank - 1)), 6) AS score, min((l, rank)) AS seen FROM u GROUP BY ALL)
        SELECT turn_id, doc_id, score, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, seen) AS INTEGER) AS rank FROM f""",
    "diversity_cap": f"""{_POOL} SELECT turn_id, doc_id, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY turn_id, source ORDER BY rank) AS k FROM pool JOIN documents USING (doc_id)) WHERE k <= 2""",
    "relevance_cutoff": f"""{_FULL},
        m AS (SELECT *, score >= 0.25 * max(score) OVER (PARTITION BY turn_id) AND len(list_filter({_SINGULAR.format(sql.question_terms('q'))}, lambda x: list_contains({sql.terms('text')}, x))) > 0 AS ok FROM full_pool),
        k AS (SELECT *, bool_or(ok) OVER (PARTITION BY turn_id) AS found, row_number() OVER (PARTITION BY turn_id ORDER BY ok DESC, rank) AS place FROM m)
        SELECT turn_id, doc_id, rank FROM k WHERE (ok AND place <= 6) OR (NOT found AND place = 1)""",
    "pack_budget": f"""{_FULL},
        t AS (SELECT turn_id, doc_id, rank, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens FROM full_pool),
        f AS (SELECT turn_id, 0 AS rank, CAST(NULL AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS tokens, CAST(2000 AS BIGINT) AS room, 0 AS n, false AS kept FROM q
              UNION ALL
              SELECT t.turn_id, t.rank, t.doc_id, t.tokens, CASE WHEN t.tokens <= room THEN room - t.tokens ELSE room END, CASE WHEN t.tokens <= room THEN n + 1 ELSE n END, t.tokens <= room
              FROM f JOIN t ON t.turn_id = f.turn_id AND t.rank = f.rank + 1)
        SELECT turn_id, 'S' || n AS label, doc_id, tokens FROM f WHERE kept""",
    "trim_to_budget": f"""{_FULL},
        r AS (SELECT turn_id, doc_id, rank, CAST(ceil(sum(length(text) + length(CAST(rank AS VARCHAR)) + 5) OVER (PARTITION BY turn_id ORDER BY rank) / 3.5) AS BIGINT) AS tokens FROM full_pool)
        SELECT * FROM r WHERE tokens <= 2000""",
    "rank_title_boost": f"""{_FULL}
        SELECT turn_id, doc_id, rank, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY coalesce({_OVERLAP.format(_WORDS.format('q'), _WORDS.format('title'))}, 0) DESC, rank) AS INTEGER) AS new_rank FROM full_pool""",
    "rank_mention_penalty": f"""{_FULL},
        m AS (SELECT *, len(list_filter({_WORDS.format('text')}, lambda w: list_contains({_WORDS.format('q')}, w))) AS said FROM full_pool)
        SELECT turn_id, doc_id, rank, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY CASE WHEN said > 5 THEN said ELSE 0 END, rank) AS INTEGER) AS new_rank FROM m""",
    "rank_heading_affinity": f"""{_PASSAGES}
        SELECT turn_id, passage_id, rank, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY {_OVERLAP.format(_WORDS.format('q'), _WORDS.format(_HEADING))} DESC, rank) AS INTEGER) AS new_rank FROM p""",
    "rank_lead_first": f"""{_PASSAGES}
        SELECT turn_id, passage_id, rank, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY CASE WHEN start_offset = 0 THEN 0 ELSE 1 END, rank) AS INTEGER) AS new_rank FROM p""",
    "rarity_order": f"WITH {_Q}, {_RARITY} SELECT turn_id, term, df, place FROM rarity",
    "coordination_rank": f"""WITH {_Q}, {_RARITY},
        h AS (SELECT doc_id, unnest(list_distinct({sql.tokens('text')})) AS term FROM documents),
        m AS (SELECT turn_id, doc_id, count(*) AS matched, min(place) AS rarest FROM rarity JOIN h USING (term) GROUP BY ALL)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY matched DESC, rarest, doc_id) AS INTEGER) AS rank FROM m) WHERE rank <= 6""",
    "unknown_terms": f"""
        WITH q AS (SELECT DISTINCT turn_id, {sql.tokens('input_text')} AS w FROM turn_records WHERE trim(input_text) <> ''),
             a AS (SELECT turn_id, term, CAST(min(i) - 1 AS INTEGER) AS at_ FROM (SELECT turn_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM q) GROUP BY ALL),
             h AS (SELECT DISTINCT unnest({sql.tokens('text')}) AS term FROM (SELECT text FROM documents UNION ALL SELECT text FROM snapshots))
        SELECT turn_id, term, at_ AS "at" FROM a ANTI JOIN h USING (term)""",
    "score_articles": rf"""{_FULL},
        st AS (SELECT DISTINCT turn_id, unnest({_SINGULAR.format(_OWN)}) AS term FROM q),
        sd AS (SELECT term, count(*) AS df FROM (SELECT unnest({sql.terms('text')}) AS term FROM documents) GROUP BY term),
        sr AS (SELECT turn_id, term, max(weight) AS role FROM (
                 SELECT turn_id, unnest(list_transform(list_concat(regexp_extract_all(q, '(?i)\bof\s+([a-z]+)', 1), regexp_extract_all(q, '(?i)\b([a-z]+)''s\b', 1)), lambda t: {sql.singular('lower(t)')})) AS term, CAST(2.5 AS DOUBLE) AS weight FROM q
                 UNION ALL SELECT turn_id, unnest(list_transform(regexp_extract_all(q, '(?i)\bin\s+([a-z]+)\b', 1), lambda t: {sql.singular('lower(t)')})), CAST(0.3 AS DOUBLE) FROM q) GROUP BY ALL),
        sw AS (SELECT st.turn_id, st.term, CASE WHEN df IS NULL THEN CAST(0.0005 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / df END * coalesce(role, 1) AS w FROM st LEFT JOIN sd USING (term) LEFT JOIN sr USING (turn_id, term)),
        sp AS (SELECT turn_id, doc_id, coalesce({sql.terms('title')}, []) AS tt, len({sql.terms('title')}) AS n, {sql.terms('text')} AS xt FROM full_pool),
        ss AS (SELECT turn_id, doc_id, any_value(n) AS n, sum(CASE WHEN list_contains(tt, term) OR list_contains(xt, term) THEN w ELSE 0 END) AS coordination,
                      sum(CASE WHEN list_contains(tt, term) THEN w ELSE 0 END) AS in_title, count(*) FILTER (WHERE list_contains(tt, term)) AS matched FROM sp JOIN sw USING (turn_id) GROUP BY ALL)
        SELECT turn_id, doc_id, round(coordination + CASE WHEN n > 0 THEN matched / n * in_title ELSE 0 END, 6) AS score FROM ss""",
    "coverage": f"{_POOL}, {_COVERAGE} SELECT turn_id, doc_id, rank, term_coverage, title_match, weak FROM graded",
    "best_coverage": f"""{_POOL}, {_COVERAGE},
        b AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY weak, CASE WHEN weak THEN -term_coverage ELSE 0 END, rank) AS k FROM graded)
        SELECT turn_id, coalesce(term_coverage, 0) AS term_coverage, coalesce(title_match, false) AS title_match, coalesce(weak, true) AS weak FROM q LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (turn_id)""",
    "assess_basic": f"""{_FULL},
        h AS (SELECT turn_id, list_distinct(flatten(list(list_concat(coalesce({sql.terms('title')}, []), {sql.terms('text')})))) AS held FROM full_pool WHERE rank <= 3 GROUP BY turn_id),
        k AS (SELECT turn_id, {_SINGULAR.format(f"list_filter({sql.question_terms('q')}, lambda x: x NOT IN ({sql.quoted(sql.words.QUESTION_FILLERS)}))")} AS key FROM q),
        c AS (SELECT turn_id, held, CASE WHEN len(key) > 0 THEN round(coalesce(len(list_filter(key, lambda x: list_contains(held, x))), 0) / len(key), 6) ELSE CAST(0 AS DOUBLE) END AS coverage FROM k LEFT JOIN h USING (turn_id))
        SELECT turn_id, coverage, CASE WHEN held IS NULL THEN 'empty' WHEN coverage >= 0.5 THEN 'strong' ELSE 'weak' END AS level FROM c""",
    "assess_full": f"""{_FULL},
        h AS (SELECT turn_id, list_distinct(flatten(list(list_concat(coalesce({sql.terms('title')}, []), {sql.terms('text')})))) AS held,
                     list_distinct(flatten(list(list_concat(coalesce({sql.all_tokens('title')}, []), {sql.all_tokens('text')})))) AS ws FROM full_pool WHERE rank <= 3 GROUP BY turn_id),
        k AS (SELECT turn_id, {_SINGULAR.format(f"list_filter({sql.question_terms('q')}, lambda x: x NOT IN ({sql.quoted(sql.words.QUESTION_FILLERS)}))")} AS key,
                     list_filter({sql.all_tokens('q')}, lambda x: regexp_matches(x, '^[0-9]+$')) AS numbers, len({sql.modifiers('q')}) > 0 AS measure FROM q),
        c AS (SELECT turn_id, held, CASE WHEN len(key) > 0 THEN round(coalesce(len(list_filter(key, lambda x: list_contains(held, x))), 0) / len(key), 6) ELSE CAST(0 AS DOUBLE) END AS coverage,
                     len(list_filter(numbers, lambda x: NOT list_contains(coalesce(ws, []), x))) = 0 AS numbered, NOT measure OR len(list_filter(coalesce(ws, []), lambda x: {sql.is_superlative('x')})) > 0 AS superlative
              FROM k LEFT JOIN h USING (turn_id)),
        r AS (SELECT *, concat_ws(',', CASE WHEN coverage < 0.5 THEN 'coverage' END, CASE WHEN NOT numbered THEN 'number' END, CASE WHEN NOT superlative THEN 'superlative' END) AS reasons FROM c)
        SELECT turn_id, CASE WHEN held IS NULL THEN 'empty' WHEN reasons = '' THEN 'strong' ELSE 'weak' END AS level, reasons FROM r""",
    "drop_modifier_only": f"""{_FULL},
        m AS (SELECT *, {_SINGULAR.format(sql.modifiers('q'))} AS mods, list_filter({_SINGULAR.format(sql.question_terms('q'))}, lambda x: length(x) > 1) AS topic, list_concat(coalesce({sql.terms('title')}, []), {sql.terms('text')}) AS b FROM full_pool),
        x AS (SELECT *, len(mods) > 0 AND len(topic) > 0 AND NOT list_has_any(b, topic) AND list_has_any(b, mods) AS dropped FROM m),
        y AS (SELECT *, count(*) FILTER (WHERE NOT dropped) OVER (PARTITION BY turn_id) AS remaining FROM x)
        SELECT turn_id, doc_id, rank FROM y WHERE NOT dropped OR remaining = 0""",
    "lead_with_backfill": f"""{_POOL}, {_TITLES},
        u AS (SELECT turn_id, doc_id, 0 AS l, rank FROM titled WHERE rank <= 5 UNION ALL SELECT turn_id, doc_id, 1, rank FROM pool),
        f AS (SELECT turn_id, doc_id, min((l, rank)) AS seen FROM u GROUP BY ALL), p AS (SELECT turn_id, doc_id, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY seen) AS INTEGER) AS place FROM f)
        SELECT turn_id, doc_id, place, 'S' || place AS label FROM p WHERE place <= 8""",
    "eval_recall_mrr": f"""
        WITH a AS (SELECT doc_id AS want, title, lang FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL AND text IS NOT NULL),
             asked AS (SELECT want AS query, {sql.tokens('title')} AS words FROM a), {_bm25('asked', "concat_ws(' ', title, text)", 5)},
             f AS (SELECT a.*, rank FROM a LEFT JOIN pool ON want = pool.turn_id AND want = doc_id)
        SELECT lang, CAST(grouping(lang) AS INTEGER) AS all_languages, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 6) AS recall_3,
               round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS recall_5, round(avg(coalesce(CAST(1 AS DOUBLE) / rank, 0)), 6) AS mrr FROM f GROUP BY CUBE (lang)""",
    "dense_topk": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
             c AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
        SELECT vec_id, CAST(rank AS INTEGER) AS rank, other, round(s, 4) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 6) DESC, other) AS rank FROM c) WHERE rank <= 10""",
}
