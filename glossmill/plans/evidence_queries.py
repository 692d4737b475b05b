"""Queries over spans of answers and documents, parent chains, logs with eviction, and checks of builds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossmill.functions import sql
from glossmill.functions import text as t
from glossmill.functions import words
from glossmill.operators import extract, logs, rank, spans
from glossmill.plans import rank_queries
from glossmill.plans.text_queries import answers, documents, questions
from glossmill.sources.tables import table

BUDGET, LONGEST_VIEW, REACH = 600, 1200, 200
#: Words that count the same.
NUMBER_WORDS = {"1": "1 one first i", "2": "2 two second ii", "3": "3 three third iii", "4": "4 four fourth iv", "5": "5 five fifth v", "6": "6 six sixth vi"}


def manifest_checks(spark, folder):
    """Each build of vectors against the rows at hand: missing, of wrong length, another number than it says, or ok."""
    builds = table(spark, folder, "dense_manifests", "manifest_id", "dim", "row_count").distinct()
    rows = table(spark, folder, "dense_vectors", "vec_id", "manifest_id", "vec").join(builds.select("manifest_id", "dim").distinct(), "manifest_id")
    wrong = F.col("vec").isNull() | (F.size("vec") != F.col("dim"))
    held = rows.groupBy("manifest_id", "vec_id").agg(F.max(wrong.cast("int")).alias("wrong")).groupBy("manifest_id").agg(F.count("*").alias("held"), F.sum("wrong").alias("wrong"))
    verdict = F.when(F.col("held").isNull(), "missing").when(F.col("wrong") > 0, "wrong_length").when(F.col("held") != F.col("row_count"), "stale").otherwise("ok")
    return builds.join(held, "manifest_id", "left").select("manifest_id", "row_count", F.coalesce("held", F.lit(0)).cast("long").alias("held"), verdict.alias("verdict"))


def snapshot_read(spark, folder):
    """The newest row of each passage, with its headings taken apart."""
    rows = table(spark, folder, "snapshots", "passage_id", "heading_path", "title", "created_at").filter("passage_id IS NOT NULL")
    newest = rows.groupBy("passage_id").agg(F.max_by(F.struct("heading_path", "title"), F.struct("created_at", "heading_path", "title")).alias("s"))
    parts = F.filter(F.split("s.heading_path", "\x1f"), lambda h: h != "")
    return newest.select("passage_id", "s.title", F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("depth"), F.get(parts, F.size(parts) - 1).alias("heading"))


def elliptical_followup(spark, folder):
    """Questions that hang on the one before: hardly a word of their own, a pointing word, or a beginning like "and" or "what about"."""
    own = F.size(F.array_except(F.array_distinct(t.tokens("q")), t.strings(words.CONTINUATION_FILLERS)))
    points = F.col("q").rlike(r"(?i)\b(it|its|that|this|those|them|again)\b")
    starts = F.col("q").rlike(r"(?i)^\s*(and|but|so|what about|how about|why)\b")
    return questions(spark, folder).select("turn_id", ((own <= 1) | points | (starts & (own <= 3))).alias("elliptical"))


def factual_turns(spark, folder):
    """Turns whose evidence was retrieved before the answer, and how many were answered, by input kind."""
    rows = table(spark, folder, "turn_records", "turn_id", "route", "input_kind", "status").distinct().filter("route LIKE 'preretrieve%'")
    return rows.groupBy("input_kind").agg(F.count("*").alias("turns"), F.count_if(F.col("status") == "ok").alias("ok"))


def first_questions(spark, folder):
    """The first five questions of each subject, for a run of an evaluation."""
    place = F.row_number().over(Window.partitionBy("subject").orderBy("turn_id"))
    return questions(spark, folder).withColumn("place", place).filter("place <= 5").select("subject", "turn_id", "place")


def _spans(spark, folder):
    numbered = spans.lines(answers(spark, folder), key="turn_id", text="a")
    return spans.kinds(spans.outside_code(numbered, key="turn_id"), key="turn_id")


def answer_spans(spark, folder):
    """Lines of answers that can be backed, with offsets and kinds; code, blank lines, headers and rules of tables are left out."""
    return _spans(spark, folder).filter("kind IN ('table_row', 'item', 'paragraph')").select("turn_id", "no", "start", "end", "kind")


def code_stripped(spark, folder):
    """Answers without their fenced blocks of code."""
    kept = spans.outside_code(spans.lines(answers(spark, folder), key="turn_id", text="a"), key="turn_id")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("turn_id").agg(F.md5(whole).alias("text_md5"), F.count("*").alias("lines"))


def table_rows(spark, folder):
    """Rows of tables in documents: their cells, and those that say something joined anew."""
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    rows = spans.lines(documents(spark, folder), key="doc_id", text="text").filter("line LIKE '%|%'")
    return rows.select("doc_id", "no", F.size(cells).cast("long").alias("cells"), F.array_join(cells, " | ").alias("joined")).filter("cells > 1")


def key_facts(spark, folder):
    """Rows of tables that give a figure under a label of words, the first eight of each document."""
    label, value = (F.trim(F.get(F.split("line", r"\|"), F.lit(n))) for n in (0, 1))
    rows = spans.lines(documents(spark, folder), key="doc_id", text="text").filter("line LIKE '%|%'").withColumn("label", label).withColumn("value", value)
    facts = rows.filter(F.col("label").rlike(r"^[^\d]*\p{L}[^\d]*$") & F.col("value").rlike(r"\d"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("no"))
    return facts.withColumn("place", place).filter("place <= 8").select("doc_id", "no", "label", "value", "place")


def cited_sentences(spark, folder):
    """The sentence around the first citation of each answer."""
    at = F.instr("a", "[S")
    return answers(spark, folder).filter(at > 0).select("turn_id", at.cast("long").alias("at"), F.md5(spans.sentence_around("a", at)).alias("sentence_md5"))


def context_views(spark, folder):
    """For each snapshot the offsets of a view of it with what stands around it in its article, 1,200 characters at most."""
    rows = table(spark, folder, "snapshots", "passage_id", "archive_id", "path", "start_offset", "end_offset").distinct().filter("passage_id IS NOT NULL AND path IS NOT NULL AND end_offset >= start_offset")
    whole = rows.groupBy("archive_id", "path").agg(F.max("end_offset").alias("length"))
    view = spans.window_around(F.col("length"), F.col("start_offset"), F.col("end_offset"), reach=REACH, most=LONGEST_VIEW)
    return rows.join(whole, ["archive_id", "path"]).select("passage_id", "start_offset", "end_offset", view.alias("v")).select("passage_id", "start_offset", "end_offset", "v.low", "v.high")


def number_words(spark, folder):
    """How often documents write each small number, in whatever way."""
    known = F.create_map(*(F.lit(x) for number, said in NUMBER_WORDS.items() for word in said.split() for x in (word, number)))
    said = documents(spark, folder).select(F.explode(t.all_tokens("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return said.select(known[F.col("word")].alias("number"), "n").filter("number IS NOT NULL").groupBy("number").agg(F.sum("n").alias("times"))


def free_figures(spark, folder):
    """Figures of answers that aren't part of a citation, by offset: those of no label's span."""
    held = answers(spark, folder).select("turn_id", F.regexp_replace("a", t.LABEL_GROUP, " ").alias("a"))
    return held.select("turn_id", F.explode(F.regexp_extract_all("a", F.lit(r"(\d+(?:[.,]\d+)*)"))).alias("figure")).groupBy("turn_id", "figure").agg(F.count("*").alias("times"))


def dense_paths(spark, folder):
    """The articles that the vectors of each build lead to, once each."""
    vectors = table(spark, folder, "dense_vectors", "manifest_id", "passage_id").distinct()
    paths = table(spark, folder, "snapshots", "passage_id", "archive_id", "path").filter("path IS NOT NULL").distinct()
    return vectors.join(paths, "passage_id").groupBy("manifest_id", "archive_id", "path").agg(F.count_distinct("passage_id").alias("passages"))


def heading_paths(spark, folder):
    """The headings from the top of the article down to each section."""
    rows = table(spark, folder, "sections", "archive_id", "path", "section_index", "heading", "parent_index").filter("archive_id IS NOT NULL AND path IS NOT NULL AND section_index IS NOT NULL").distinct()
    return extract.heading_paths(rows)


def matched_all(spark, folder):
    """How many documents have both of the two rarest terms of a question, and how many either."""
    terms = rank_queries.rarity_order(spark, folder).filter("place <= 2").select("turn_id", "term", F.count("*").over(Window.partitionBy("turn_id")).alias("asked"))
    held = rank_queries.library(spark, folder).postings.select("term", F.col("key").alias("doc_id")).distinct()
    hits = terms.join(held, "term").groupBy("turn_id", "asked", "doc_id").agg(F.count("*").alias("n"))
    return hits.groupBy("turn_id").agg(F.count("*").alias("either"), F.count_if(F.col("n") == F.col("asked")).alias("both"))


def phrase_freq(spark, folder):
    """In how many documents each pair of neighbouring words of a title stands as a phrase."""
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.concat_ws(" ", F.element_at(x, i), F.element_at(x, i + 1)))
    docs = documents(spark, folder).select("doc_id", t.all_tokens("title").alias("title"), t.all_tokens("text").alias("text"))
    asked = docs.filter(F.size("title") > 1).select(F.explode(pairs(F.col("title"))).alias("phrase")).distinct()
    held = docs.filter(F.size("text") > 1).select("doc_id", F.explode(F.array_distinct(pairs(F.col("text")))).alias("phrase"))
    return held.join(asked, "phrase").groupBy("phrase").agg(F.count("*").alias("docs"))


def hinted_first(spark, folder):
    """The best six documents of each question, one of the lesson's subject that is among them brought to the front."""
    pool = rank_queries.bm25_pool(spark, folder).filter("rank <= 10").join(documents(spark, folder).select("doc_id", "source"), "doc_id")
    hint = pool.groupBy("turn_id").agg(F.min_by("doc_id", F.struct("source", "rank")).alias("hint"))
    placed = pool.join(hint, "turn_id").withColumn("order", F.when(F.col("doc_id") == F.col("hint"), -1).otherwise(F.col("rank")))
    place = F.row_number().over(Window.partitionBy("turn_id").orderBy("order"))
    return placed.withColumn("place", place).filter("place <= 6").select("turn_id", "doc_id", "place")


def key_facts_first(spark, folder):
    """The best documents of each question behind those of them that have key facts, two of these at most."""
    pool = rank_queries.bm25_topk(spark, folder)
    facts = key_facts(spark, folder).select("doc_id").distinct().withColumn("fact", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("turn_id", "fact").orderBy("rank"))
    marked = pool.join(facts, "doc_id", "left").withColumn("nth", nth).withColumn("first", F.coalesce(F.col("fact") & (F.col("nth") <= 2), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("turn_id").orderBy(F.desc("first"), "rank"))
    return marked.select("turn_id", "doc_id", "first", place.alias("place"))


def event_deltas(spark, folder):
    """The events of each user and hour put together: kinds in their order, the last value, the first time."""
    rows = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value").withColumn("hour", F.date_trunc("hour", "ts"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda e: e["event_type"])
    by = rows.groupBy("user_id", "hour").agg(F.array_join(kinds, " ").alias("kinds"), F.round(F.max_by("value", F.struct("ts", "event_id")), 6).alias("value"), F.count("*").alias("n"))
    return by.select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "kinds", "value", "n")


def _sized(spark, folder):
    rows = table(spark, folder, "turn_records", "turn_id", "lesson_id", "turn_index", "input_text", "answer_text", "cited_labels").distinct().filter("lesson_id IS NOT NULL")
    said = F.length(F.coalesce("input_text", F.lit(""))) + F.length(F.coalesce("answer_text", F.lit("")))
    return rows.select("turn_id", "lesson_id", "turn_index", "cited_labels", F.ceil(said / F.lit(3.5)).cast("long").alias("tokens"), (F.coalesce(F.size("cited_labels"), F.lit(0)) * 80).cast("long").alias("passages"))


def evict_stages(spark, folder):
    """A lesson's log over its budget: passages go first, oldest first, those of the newest turn never; then whole turns, the newest never."""
    return logs.evict_in_stages(_sized(spark, folder), group="lesson_id", order=["turn_index", "turn_id"], tokens="tokens", passages="passages", budget=BUDGET).select("turn_id", "passages_gone", "turn_gone")


def held_again(spark, folder):
    """Citations of a lesson as pointers while a turn that showed the passage is still held, and in full again after it went."""
    gone = logs.evict_in_stages(_sized(spark, folder), group="lesson_id", order=["turn_index", "turn_id"], tokens="tokens", passages="passages", budget=BUDGET)
    cited = gone.select("turn_id", "lesson_id", "turn_index", "passages_gone", F.explode(F.array_distinct("cited_labels")).alias("label"))
    before = F.max((~F.col("passages_gone")).cast("int")).over(Window.partitionBy("lesson_id", "label").orderBy("turn_index", "turn_id").rowsBetween(Window.unboundedPreceding, -1))
    return cited.select("turn_id", "label", (F.coalesce(before, F.lit(0)) == 1).alias("pointer"))


def repaired_log(spark, folder):
    """Calls of tools without an outcome get one: each turn's calls with a made outcome where no answer came."""
    rows = table(spark, folder, "turn_records", "turn_id", "research_statuses", "answer_text").distinct()
    calls = rows.select("turn_id", F.col("answer_text").isNull().alias("open"), F.posexplode("research_statuses").alias("call", "outcome"))
    last = F.max("call").over(Window.partitionBy("turn_id"))
    outcome = F.when(F.col("outcome").isNull() | (F.col("open") & (F.col("call") == last)), "interrupted").otherwise(F.col("outcome"))
    return calls.select("turn_id", "call", outcome.alias("outcome"))


def resumed_lessons(spark, folder):
    """The state that a lesson is resumed from: its last turn, the labels cited so far, the turns and tokens spent."""
    rows = table(spark, folder, "turn_records", "turn_id", "lesson_id", "turn_index", "cited_labels", "tokens_used").distinct().filter("lesson_id IS NOT NULL")
    labels = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("cited_labels", F.array().cast("array<string>")))))), " ")
    return rows.groupBy("lesson_id").agg(F.max_by("turn_id", F.struct("turn_index", "turn_id")).alias("last_turn"), labels.alias("labels"), F.count("*").alias("turns"), F.sum("tokens_used").alias("tokens"))


def best_config(spark, folder):
    """For each input kind the route with the best rate of resolved citations, then the fewest failures, then the fewest tokens."""
    rows = table(spark, folder, "turn_records", "turn_id", "route", "input_kind", "status", "citations", "citations_resolved", "tokens_used").distinct().filter("route IS NOT NULL")
    rate = F.round(F.sum("citations_resolved") / F.nullif(F.sum("citations"), F.lit(0)), 6)
    by = rows.groupBy("input_kind", "route").agg(F.coalesce(rate, F.lit(0.0)).alias("rate"), F.count_if(F.col("status") != "ok").alias("failed"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"))
    best = F.min_by(F.struct("route", "rate", "failed"), F.struct(-F.col("rate"), "failed", "tokens", "route"))
    return by.groupBy("input_kind").agg(best.alias("b")).select("input_kind", "b.route", "b.rate", "b.failed")


def tier_gate(spark, folder):
    """Whether a question's best documents of archives of the first two tiers are too weak, so that the third is asked."""
    tiers = table(spark, folder, "archives", "archive_id", "tier").filter("archive_id IS NOT NULL").groupBy("archive_id").agg(F.min("tier").alias("tier"))
    pool = rank_queries.pool(spark, folder).select("turn_id", "rank", "title", "text", "source", t.coverage_terms("q", "subject").alias("own"))
    graded = pool.join(tiers, pool["source"] == tiers["archive_id"], "left").withColumn("c", rank.coverage(F.col("own"), F.col("title"), F.col("text"), F.size("own")))
    first = F.col("tier") <= 2
    return graded.groupBy("turn_id").agg(F.count_if(first).alias("near"), (F.count_if(first & ~F.col("c.weak")) == 0).alias("ask_further"))


def wire_messages(spark, folder):
    """Each turn as the two messages that go over the wire, as JSON with sorted names."""
    rows = table(spark, folder, "turn_records", "turn_id", "input_text", "answer_text").distinct()
    user = F.struct(F.coalesce("input_text", F.lit("")).alias("content"), F.lit("user").alias("role"))
    said = F.struct(F.coalesce("answer_text", F.lit("")).alias("content"), F.lit("assistant").alias("role"))
    return rows.select("turn_id", F.md5(F.to_json(F.array(user, said))).alias("json_md5"))


QUERIES = {f.__name__: f for f in (
    manifest_checks, snapshot_read, elliptical_followup, factual_turns, first_questions, answer_spans, code_stripped, table_rows, key_facts, cited_sentences,
    context_views, number_words, free_figures, dense_paths, heading_paths, matched_all, phrase_freq, hinted_first, key_facts_first, event_deltas, evict_stages,
    held_again, repaired_log, resumed_lessons, best_config, tier_gate, wire_messages,
)}

_Q = "(SELECT DISTINCT turn_id, input_text AS q, subject FROM turn_records WHERE trim(input_text) <> '')"
_A = "(SELECT DISTINCT turn_id, answer_text AS a FROM turn_records WHERE answer_text IS NOT NULL)"
_T = "(SELECT DISTINCT {} FROM turn_records)"


def _lines(key: str, text: str, source: str) -> str:
    return f"""l0 AS (SELECT {key}, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) - 1 AS no FROM {source}),
        l AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY {key} ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l0)"""


_OUTSIDE = r"""c AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence FROM l),
        d AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY turn_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM c),
        o AS (SELECT turn_id, no, line, start FROM d WHERE NOT fence AND NOT inside)"""
_EVICTED = f"""s AS (SELECT turn_id, lesson_id, turn_index, cited_labels, CAST(ceil((length(coalesce(input_text, '')) + length(coalesce(answer_text, ''))) / 3.5) AS BIGINT) AS tokens, coalesce(len(cited_labels), 0) * 80 AS passages
             FROM {_T.format('turn_id, lesson_id, turn_index, input_text, answer_text, cited_labels')} WHERE lesson_id IS NOT NULL),
        n AS (SELECT *, sum(tokens) OVER (PARTITION BY lesson_id) AS all_tokens, sum(tokens + passages) OVER (PARTITION BY lesson_id) AS total,
                     row_number() OVER w AS newest, coalesce(sum(passages) OVER (PARTITION BY lesson_id ORDER BY turn_index NULLS FIRST, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed,
                     sum(tokens) OVER w AS kept, first_value(passages) OVER w AS last_passages
              FROM s WINDOW w AS (PARTITION BY lesson_id ORDER BY turn_index DESC NULLS LAST, turn_id DESC ROWS UNBOUNDED PRECEDING)),
        g AS (SELECT *, total - freed > {BUDGET} AND newest > 1 AND passages > 0 AS passages_gone0, kept + last_passages > {BUDGET} AND newest > 1 AS turn_gone FROM n),
        e AS (SELECT *, passages_gone0 OR turn_gone AS passages_gone FROM g)"""
_KNOWN = ", ".join(f"('{word}', '{number}')" for number, said in NUMBER_WORDS.items() for word in said.split())
_FACTS = f"""WITH {_lines('doc_id', 'text', 'documents')},
        r AS (SELECT doc_id, no, trim(string_split(line, '|')[1]) AS label, trim(string_split(line, '|')[2]) AS value FROM l WHERE line LIKE '%|%'),
        k AS (SELECT * FROM r WHERE regexp_matches(label, '^[^\\d]*\\p{{L}}[^\\d]*$') AND regexp_matches(value, '\\d'))"""

SQL = {
    "manifest_checks": """
        WITH b AS (SELECT DISTINCT manifest_id, dim, row_count FROM dense_manifests), d AS (SELECT DISTINCT manifest_id, dim FROM b),
             v AS (SELECT manifest_id, vec_id, max(CASE WHEN vec IS NULL OR len(vec) <> dim THEN 1 ELSE 0 END) AS w FROM dense_vectors JOIN d USING (manifest_id) GROUP BY ALL),
             h AS (SELECT manifest_id, count(*) AS held, sum(w) AS wrong FROM v GROUP BY ALL)
        SELECT manifest_id, row_count, coalesce(held, 0) AS held, CASE WHEN held IS NULL THEN 'missing' WHEN wrong > 0 THEN 'wrong_length' WHEN held <> row_count THEN 'stale' ELSE 'ok' END AS verdict FROM b LEFT JOIN h USING (manifest_id)""",
    "snapshot_read": """
        WITH n AS (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY created_at DESC NULLS LAST, heading_path DESC NULLS LAST, title DESC NULLS LAST) AS r FROM snapshots WHERE passage_id IS NOT NULL),
             p AS (SELECT passage_id, title, list_filter(string_split(heading_path, chr(31)), lambda h: h <> '') AS parts FROM n WHERE r = 1)
        SELECT passage_id, title, coalesce(len(parts), 0) AS depth, parts[-1] AS heading FROM p""",
    "elliptical_followup": f"""
        WITH q AS (SELECT turn_id, q, len(list_filter(list_distinct({sql.tokens('q')}), lambda x: x NOT IN ({sql.quoted(words.CONTINUATION_FILLERS)}))) AS own FROM {_Q})
        SELECT turn_id, own <= 1 OR regexp_matches(q, '(?i)\\b(it|its|that|this|those|them|again)\\b') OR (own <= 3 AND regexp_matches(q, '(?i)^\\s*(and|but|so|what about|how about|why)\\b')) AS elliptical FROM q""",
    "factual_turns": f"SELECT input_kind, count(*) AS turns, count(*) FILTER (WHERE status = 'ok') AS ok FROM {_T.format('turn_id, route, input_kind, status')} WHERE route LIKE 'preretrieve%' GROUP BY ALL",
    "first_questions": f"SELECT * FROM (SELECT subject, turn_id, CAST(row_number() OVER (PARTITION BY subject ORDER BY turn_id) AS INTEGER) AS place FROM {_Q}) WHERE place <= 5",
    "answer_spans": rf"""WITH {_lines('turn_id', 'a', _A)}, {_OUTSIDE},
        k0 AS (SELECT *, regexp_matches(line, '^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$') AND line LIKE '%|%' AS rule FROM o),
        k AS (SELECT *, coalesce(lead(rule) OVER (PARTITION BY turn_id ORDER BY no), false) AS ruled, regexp_matches(line, '^\s*\|.*\|\s*$') AS rowed FROM k0),
        x AS (SELECT turn_id, no, start, start + length(line) AS "end", CASE WHEN regexp_full_match(line, '[\s\x{{00A0}}\x{{200B}}\x{{3000}}]*') THEN 'blank' WHEN rule THEN 'separator' WHEN rowed AND ruled THEN 'header' WHEN rowed THEN 'table_row'
                     WHEN regexp_matches(line, '^\s*([-*•+]|\d+[.)])\s+\S') THEN 'item' ELSE 'paragraph' END AS kind FROM k)
        SELECT turn_id, CAST(no AS INTEGER) AS no, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", kind FROM x WHERE kind IN ('table_row', 'item', 'paragraph')""",
    "code_stripped": f"WITH {_lines('turn_id', 'a', _A)}, {_OUTSIDE} SELECT turn_id, md5(string_agg(line, chr(10) ORDER BY no)) AS text_md5, count(*) AS lines FROM o GROUP BY turn_id",
    "table_rows": f"""WITH {_lines('doc_id', 'text', 'documents')}, r AS (SELECT doc_id, no, list_filter(list_transform(string_split(line, '|'), lambda c: trim(c)), lambda c: c <> '') AS cells FROM l WHERE line LIKE '%|%')
        SELECT doc_id, CAST(no AS INTEGER) AS no, len(cells) AS cells, array_to_string(cells, ' | ') AS joined FROM r WHERE len(cells) > 1""",
    "key_facts": f"{_FACTS} SELECT * FROM (SELECT doc_id, CAST(no AS INTEGER) AS no, label, value, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) AS INTEGER) AS place FROM k) WHERE place <= 8",
    "cited_sentences": rf"""
        WITH c AS (SELECT turn_id, a, strpos(a, '[S') AS at_ FROM {_A} WHERE strpos(a, '[S') > 0)
        SELECT turn_id, at_ AS at, md5(trim(regexp_extract(left(a, at_ - 1), '([^.!?\n]*)$', 1) || regexp_extract(substr(a, at_), '^([^.!?\n]*[.!?]?)', 1))) AS sentence_md5 FROM c""",
    "context_views": f"""
        WITH r AS (SELECT DISTINCT passage_id, archive_id, path, start_offset AS s, end_offset AS e FROM snapshots WHERE passage_id IS NOT NULL AND path IS NOT NULL AND end_offset >= start_offset),
             w AS (SELECT archive_id, path, max(e) AS n FROM r GROUP BY ALL),
             v AS (SELECT passage_id, s, e, greatest(s - {REACH}, 0) AS lo, least(e + {REACH}, n) AS hi FROM r JOIN w USING (archive_id, path)),
             x AS (SELECT *, greatest(hi - lo - {LONGEST_VIEW}, 0) AS over_ FROM v),
             y AS (SELECT *, CASE WHEN s - lo >= hi - e THEN least(over_, s - lo) ELSE greatest(over_ - (hi - e), 0) END AS l FROM x)
        SELECT passage_id, s AS start_offset, e AS end_offset, lo + l AS low, hi - (over_ - l) AS high FROM y""",
    "number_words": f"WITH w AS (SELECT unnest({sql.all_tokens('text')}) AS word FROM documents), k AS (SELECT * FROM (VALUES {_KNOWN}) k(word, number)) SELECT number, count(*) AS times FROM w JOIN k USING (word) GROUP BY number",
    "free_figures": rf"""WITH f AS (SELECT turn_id, unnest(regexp_extract_all(regexp_replace(a, '\[(S\d+(?:\s*,\s*S\d+)*)\]', ' ', 'g'), '\d+(?:[.,]\d+)*')) AS figure FROM {_A}) SELECT turn_id, figure, count(*) AS times FROM f GROUP BY ALL""",
    "dense_paths": "SELECT manifest_id, archive_id, path, count(DISTINCT passage_id) AS passages FROM dense_vectors JOIN (SELECT DISTINCT passage_id, archive_id, path FROM snapshots WHERE path IS NOT NULL) s USING (passage_id) GROUP BY manifest_id, archive_id, s.path".replace("path, count", "s.path AS path, count", 1),
    "heading_paths": """
        WITH RECURSIVE r AS (SELECT DISTINCT archive_id, path, section_index AS i, heading, parent_index AS p FROM sections WHERE archive_id IS NOT NULL AND path IS NOT NULL AND section_index IS NOT NULL),
             one AS (SELECT archive_id, path, i, min(coalesce(heading, '')) AS heading, min(p) AS p FROM r GROUP BY ALL),
             c AS (SELECT archive_id, path, i, heading AS headings, p, 1 AS depth FROM one
                   UNION ALL SELECT c.archive_id, c.path, c.i, o.heading || ' > ' || c.headings, o.p, depth + 1 FROM c JOIN one o ON o.archive_id = c.archive_id AND o.path = c.path AND o.i = c.p AND c.p < c.i)
        SELECT archive_id, path, i AS section_index, arg_max(headings, depth) AS headings, CAST(max(depth) AS INTEGER) AS depth FROM c GROUP BY ALL""",
    "matched_all": f"""
        WITH {rank_queries._Q}, {rank_queries._RARITY}, a AS (SELECT turn_id, term, count(*) OVER (PARTITION BY turn_id) AS asked FROM rarity WHERE place <= 2),
             h AS (SELECT doc_id, unnest(list_distinct({sql.tokens('text')})) AS term FROM documents), m AS (SELECT turn_id, asked, doc_id, count(*) AS n FROM a JOIN h USING (term) GROUP BY ALL)
        SELECT turn_id, count(*) AS either, count(*) FILTER (WHERE n = asked) AS both FROM m GROUP BY turn_id""",
    "phrase_freq": f"""
        WITH d AS (SELECT doc_id, {sql.all_tokens('title')} AS t, {sql.all_tokens('text')} AS x FROM documents),
             q AS (SELECT DISTINCT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS phrase FROM d WHERE len(t) > 1),
             h AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]))) AS phrase FROM d WHERE len(x) > 1)
        SELECT phrase, count(*) AS docs FROM h SEMI JOIN q USING (phrase) GROUP BY phrase""",
    "hinted_first": f"""
        WITH p AS (SELECT b.*, d.source FROM ({rank_queries.SQL_POOL}) b JOIN documents d USING (doc_id) WHERE rank <= 10),
             h AS (SELECT turn_id, doc_id AS hint FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY source NULLS FIRST, rank) AS i FROM p) WHERE i = 1)
        SELECT * FROM (SELECT turn_id, doc_id, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY CASE WHEN doc_id = hint THEN -1 ELSE rank END) AS INTEGER) AS place FROM p JOIN h USING (turn_id)) WHERE place <= 6""",
    "key_facts_first": f"""
        WITH f AS (SELECT DISTINCT doc_id FROM ({_FACTS} SELECT doc_id FROM k)), p AS (SELECT b.*, f.doc_id IS NOT NULL AS fact FROM ({rank_queries.SQL_POOL}) b LEFT JOIN f USING (doc_id) WHERE rank <= 5),
             m AS (SELECT *, fact AND row_number() OVER (PARTITION BY turn_id, fact ORDER BY rank) <= 2 AS first FROM p)
        SELECT turn_id, doc_id, first, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY first DESC, rank) AS INTEGER) AS place FROM m""",
    "event_deltas": """
        SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, string_agg(event_type, ' ' ORDER BY ts, event_id) AS kinds, round(arg_max(value, (ts, event_id)), 6) AS value, count(*) AS n FROM events GROUP BY user_id, date_trunc('hour', ts)""",
    "evict_stages": f"WITH {_EVICTED} SELECT turn_id, passages_gone, turn_gone FROM e",
    "held_again": f"""
        WITH {_EVICTED}, c AS (SELECT turn_id, lesson_id, turn_index, passages_gone, unnest(list_distinct(cited_labels)) AS label FROM e)
        SELECT turn_id, label, coalesce(max((NOT passages_gone)::INT) OVER (PARTITION BY lesson_id, label ORDER BY turn_index NULLS FIRST, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS pointer FROM c""",
    "repaired_log": f"""
        WITH c AS (SELECT turn_id, answer_text IS NULL AS open, unnest(research_statuses) AS outcome, generate_subscripts(research_statuses, 1) - 1 AS call FROM {_T.format('turn_id, research_statuses, answer_text')})
        SELECT turn_id, CAST(call AS INTEGER) AS call, CASE WHEN outcome IS NULL OR (open AND call = max(call) OVER (PARTITION BY turn_id)) THEN 'interrupted' ELSE outcome END AS outcome FROM c""",
    "resumed_lessons": f"""
        WITH r AS (SELECT * FROM {_T.format('turn_id, lesson_id, turn_index, cited_labels, tokens_used')} WHERE lesson_id IS NOT NULL), l AS (SELECT lesson_id, string_agg(label, ' ' ORDER BY label) AS labels FROM (SELECT DISTINCT lesson_id, unnest(cited_labels) AS label FROM r) GROUP BY ALL),
             o AS (SELECT *, row_number() OVER (PARTITION BY lesson_id ORDER BY turn_index DESC NULLS LAST, turn_id DESC) AS i FROM r)
        SELECT lesson_id, max(turn_id) FILTER (WHERE i = 1) AS last_turn, coalesce(any_value(labels), '') AS labels, count(*) AS turns, CAST(sum(tokens_used) AS BIGINT) AS tokens FROM o LEFT JOIN l USING (lesson_id) GROUP BY lesson_id""",
    "best_config": f"""
        WITH b AS (SELECT input_kind, route, coalesce(round(sum(citations_resolved) / nullif(sum(citations), 0), 6), 0.0) AS rate, count(*) FILTER (WHERE status <> 'ok') AS failed, coalesce(sum(tokens_used), 0) AS tokens
                   FROM {_T.format('turn_id, route, input_kind, status, citations, citations_resolved, tokens_used')} WHERE route IS NOT NULL GROUP BY ALL)
        SELECT input_kind, route, rate, failed FROM (SELECT *, row_number() OVER (PARTITION BY input_kind ORDER BY rate DESC, failed, tokens, route) AS i FROM b) WHERE i = 1""",
    "wire_messages": f"""
        SELECT turn_id, md5(to_json([{{'content': coalesce(input_text, ''), 'role': 'user'}}, {{'content': coalesce(answer_text, ''), 'role': 'assistant'}}])) AS json_md5 FROM {_T.format('turn_id, input_text, answer_text')}""",
}
