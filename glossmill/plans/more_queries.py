"""Queries of pages, lead vectors, names, cycles and the remaining lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossmill.functions import sql
from glossmill.functions import text as t
from glossmill.operators import extract, index, logs
from glossmill.plans.store_queries import _turns, catalog_plan
from glossmill.plans.text_queries import A, Q, answers, questions
from glossmill.sources.tables import table

DIMS = 64


def article_pages(spark, folder):
    """A page for each article: its passages in order under the headings of their sections."""
    rows = table(spark, folder, "snapshots", "archive_id", "path", "heading_path", "start_offset", "passage_id", "text").filter("path IS NOT NULL AND text IS NOT NULL").distinct()
    parts = F.array_sort(F.collect_list(F.struct("start_offset", "passage_id", "heading_path", "text")))
    body = F.transform(parts, lambda p: F.concat(F.lit("<h2>"), extract.escape(F.regexp_replace(p["heading_path"], "\x1f", " / ")), F.lit("</h2><p>"), extract.escape(p["text"]), F.lit("</p>")))
    return rows.groupBy("archive_id", "path").agg(F.md5(F.array_join(body, "")).alias("page_md5"), F.count("*").alias("passages"), t.slug(F.first("path")).alias("slug"))


def build_lead_vectors(spark, folder):
    """A hashed bag of words for the first passage of each article, of unit length: its terms counted in 64 bins."""
    rows = table(spark, folder, "snapshots", "archive_id", "path", "start_offset", "passage_id", "text").filter("path IS NOT NULL AND text IS NOT NULL")
    leads = rows.groupBy("archive_id", "path").agg(F.min_by(F.struct("passage_id", "text"), F.struct("start_offset", "passage_id", "text")).alias("l"))
    terms = index.exploded(leads.select(F.col("l.passage_id").alias("passage_id"), F.col("l.text").alias("text")), "passage_id", terms=t.tokens("text"))
    bins = terms.groupBy("passage_id", (F.conv(F.substring(F.md5("term"), 1, 6), 16, 10).cast("long") % DIMS).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("passage_id")))
    return bins.select("passage_id", "bin", F.round(F.col("n") / norm, 6).alias("weight"))


def label_sentence(spark, folder):
    """The first sentence that carries each label of an answer."""
    parts = answers(spark, folder).select("turn_id", F.posexplode(t.sentences("a")).alias("no", "s"))
    cited = parts.select("turn_id", "no", "s", F.explode(t.labels("s")).alias("label"))
    return cited.groupBy("turn_id", "label").agg(F.min("no").alias("sentence_no"), F.md5(F.min_by("s", "no")).alias("sentence_md5"))


def repetition_cycles(spark, folder):
    """Answers in which two periods or more of two to eight sentences follow on each other; the shortest period."""
    return logs.repeated_cycles(answers(spark, folder), key="turn_id", text="a", periods=2)


def proper_names(spark, folder):
    """Names of several capitalised words in answers, labels left out, by how many answers have them."""
    bare = F.regexp_replace("a", t.LABEL_GROUP, "")
    found = answers(spark, folder).select("turn_id", F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"([A-Z][\p{L}'-]*(?: [A-Z][\p{L}'-]*)+)")))).alias("name"))
    return found.groupBy("name").agg(F.count("*").alias("answers"))


def clip_queries(spark, folder):
    """Questions cut to eight words, as a model's own queries are."""
    words = F.filter(F.split("q", r"\s+"), lambda w: w != "")
    return questions(spark, folder).select("turn_id", F.array_join(F.slice(words, 1, 8), " ").alias("clipped"))


def plan_counts(spark, folder):
    return catalog_plan(spark, folder).groupBy("action").agg(F.count("*").alias("archives"), F.min("dated").alias("oldest"))


def limit_violations(spark, folder):
    """Turns over a limit, by route: slow ones, large contexts, evictions."""
    rows = _turns(spark, folder, "route", "wall_s", "tokens_used", "eviction_events")
    return rows.groupBy("route").agg(F.count_if(F.col("wall_s") > 60).alias("slow"), F.count_if(F.col("tokens_used") > 20_000).alias("large"), F.count_if(F.col("eviction_events") > 0).alias("evicting"))


def turn_profiles(spark, folder):
    """Turns by the profile of their lesson; turns whose lesson isn't on record count under no profile."""
    lessons = table(spark, folder, "lessons", "lesson_id", "profile_id", "lang").groupBy("lesson_id").agg(F.max("profile_id").alias("profile_id"), F.max("lang").alias("lang"))
    return _turns(spark, folder, "lesson_id").join(lessons, "lesson_id", "left").groupBy("profile_id", "lang").agg(F.count("*").alias("turns"))


QUERIES = {f.__name__: f for f in (
    article_pages, build_lead_vectors, label_sentence, repetition_cycles, proper_names, clip_queries, plan_counts, limit_violations, turn_profiles,
)}

_T = "(SELECT DISTINCT {} FROM turn_records)"
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_SPLIT = r"list_filter(regexp_split_to_array(regexp_replace(a, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda s: regexp_matches(s, '[^\s\x{00A0}\x{200B}\x{3000}]'))"
_LABELS = r"list_distinct(regexp_extract_all(array_to_string(regexp_extract_all(s, '\[(S\d+(?:\s*,\s*S\d+)*)\]', 1), ','), 'S\d+'))"

SQL = {
    "article_pages": f"""
        WITH r AS (SELECT DISTINCT archive_id, path, heading_path, start_offset, passage_id, text FROM snapshots WHERE path IS NOT NULL AND text IS NOT NULL)
        SELECT archive_id, path, md5(string_agg('<h2>' || {_ESCAPED.format("replace(heading_path, chr(31), ' / ')")} || '</h2><p>' || {_ESCAPED.format('text')} || '</p>', '' ORDER BY start_offset NULLS FIRST, passage_id, heading_path, text)) AS page_md5,
               count(*) AS passages, trim(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM r GROUP BY ALL""",
    "build_lead_vectors": f"""
        WITH l AS (SELECT arg_min((passage_id, text), (start_offset, passage_id, text)) AS l FROM snapshots WHERE path IS NOT NULL AND text IS NOT NULL GROUP BY archive_id, path),
             w AS (SELECT l[1] AS passage_id, unnest({sql.tokens('l[2]')}) AS term FROM l),
             b AS (SELECT passage_id, CAST(CAST('0x' || substring(md5(term), 1, 6) AS BIGINT) % 64 AS INTEGER) AS bin, count(*) AS n FROM w GROUP BY ALL)
        SELECT passage_id, bin, round(n / sqrt(sum(n * n) OVER (PARTITION BY passage_id)), 6) AS weight FROM b""",
    "label_sentence": f"""
        WITH p AS (SELECT turn_id, unnest(x) AS s, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS no FROM (SELECT turn_id, {_SPLIT} AS x FROM {A})), c AS (SELECT turn_id, no, s, unnest({_LABELS}) AS label FROM p)
        SELECT turn_id, label, min(no) AS sentence_no, md5(arg_min(s, no)) AS sentence_md5 FROM c GROUP BY ALL""",
    "repetition_cycles": rf"""
        WITH u AS (SELECT turn_id, no, trim(regexp_replace(lower(regexp_replace(s, '\[S\d+\]', '', 'g')), '\s+', ' ', 'g'), ' ') AS unit
                   FROM (SELECT turn_id, unnest(x) AS s, generate_subscripts(x, 1) - 1 AS no FROM (SELECT turn_id, {_SPLIT} AS x FROM {A}))),
             h AS (SELECT a.turn_id, p AS period, a.no FROM u a JOIN u b USING (turn_id), range(2, 9) r(p) WHERE a.no = b.no + p AND a.unit = b.unit AND length(a.unit) >= 20),
             r AS (SELECT *, no - row_number() OVER (PARTITION BY turn_id, period ORDER BY no) AS run FROM h),
             f AS (SELECT turn_id, period, min(no) - period AS first_no, (count(*) + period) // period AS times FROM r GROUP BY turn_id, period, run HAVING count(*) >= period),
             k AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY period, first_no) AS place FROM f)
        SELECT turn_id, CAST(period AS INTEGER) AS period, CAST(first_no AS INTEGER) AS first_no, times FROM k WHERE place = 1""",
    "proper_names": r"""
        SELECT name, count(*) AS answers FROM (SELECT turn_id, unnest(list_distinct(regexp_extract_all(regexp_replace(a, '\[(S\d+(?:\s*,\s*S\d+)*)\]', '', 'g'), '([A-Z][\p{L}''-]*(?: [A-Z][\p{L}''-]*)+)', 1))) AS name FROM """
    + A
    + ") GROUP BY name",
    "clip_queries": rf"SELECT turn_id, array_to_string(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '')[1:8], ' ') AS clipped FROM {Q}",
    "plan_counts": r"""
        WITH f AS (SELECT DISTINCT archive_id, regexp_extract(path, '_(\d{4}-\d{2})[a-z]?\.zim$', 1) AS dated FROM archives), b AS (SELECT archive_id, strftime(max(created_at), '%Y-%m') AS built FROM dense_manifests GROUP BY archive_id)
        SELECT CASE WHEN built IS NULL THEN 'to_build' WHEN built = dated THEN 'up_to_date' WHEN built > dated THEN 'newer' ELSE 'to_build' END AS action, count(*) AS archives, min(dated) AS oldest FROM f LEFT JOIN b USING (archive_id) GROUP BY ALL""",
    "limit_violations": f"""SELECT route, count(*) FILTER (WHERE wall_s > 60) AS slow, count(*) FILTER (WHERE tokens_used > 20000) AS large, count(*) FILTER (WHERE eviction_events > 0) AS evicting FROM {_T.format('turn_id, route, wall_s, tokens_used, eviction_events')} GROUP BY route""",
    "turn_profiles": f"""
        WITH l AS (SELECT lesson_id, max(profile_id) AS profile_id, max(lang) AS lang FROM lessons GROUP BY lesson_id)
        SELECT profile_id, lang, count(*) AS turns FROM {_T.format('turn_id, lesson_id')} LEFT JOIN l USING (lesson_id) GROUP BY ALL""",
}
