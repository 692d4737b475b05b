"""Queries over stores, logs, registries, sections and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossmill.functions import text as t
from glossmill.operators import calc as arithmetic
from glossmill.operators import extract, logs
from glossmill.plans.text_queries import answers, documents
from glossmill.sources.tables import table

BUDGET = 600


def _turns(spark, folder, *columns):
    """Each turn once: logged again it is the same but for the time of logging."""
    return table(spark, folder, "turn_records", "turn_id", *columns).distinct()


def snapshot_upsert(spark, folder):
    rows = table(spark, folder, "snapshots", "passage_id", "archive_id", "start_offset", "end_offset", "text", "created_at")
    kept = logs.upsert_first_seen(rows, key="passage_id", at="created_at")
    return kept.select("passage_id", "archive_id", "start_offset", "end_offset", F.md5("text").alias("text_md5"), "created_at")


def turns_with_seq(spark, folder):
    rows = _turns(spark, folder, "lesson_id", "started_at").filter("lesson_id IS NOT NULL")
    return logs.with_sequence(rows, group="lesson_id", order=["started_at", "turn_id"])


def turn_reduce(spark, folder):
    """One record a turn: the first token's time, the last status and the largest counters."""
    rows = table(spark, folder, "turn_records", "turn_id", "ttft_s", "status", "tokens_used", "calc_calls", "logged_at")
    last = F.max_by("status", F.struct("logged_at", "status"))
    return rows.groupBy("turn_id").agg(F.min("ttft_s").alias("ttft_s"), last.alias("status"), F.max("tokens_used").alias("tokens_used"), F.max("calc_calls").alias("calc_calls"), F.max("logged_at").alias("logged_at"))


def conv_tokens(spark, folder):
    rows = _turns(spark, folder, "lesson_id", "tokens_used", "cached_tokens")
    return rows.groupBy("lesson_id").agg(F.count("*").alias("turns"), F.sum("tokens_used").alias("tokens"), F.round(F.avg(F.when(F.col("tokens_used") > 0, F.col("cached_tokens") / F.col("tokens_used"))), 6).alias("cached_share"))


def token_growth(spark, folder):
    rows = _turns(spark, folder, "lesson_id", "turn_index", "tokens_used").filter("lesson_id IS NOT NULL")
    running = Window.partitionBy("lesson_id").orderBy("turn_index", "turn_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("turn_id", F.sum("tokens_used").over(running).alias("tokens"), F.max("tokens_used").over(running).alias("largest"))


def evict_turns(spark, folder):
    rows = _turns(spark, folder, "lesson_id", "turn_index", "input_text", "answer_text").filter("lesson_id IS NOT NULL")
    sized = rows.withColumn("tokens", t.estimate_tokens(F.concat(F.coalesce("input_text", F.lit("")), F.coalesce("answer_text", F.lit("")))))
    return logs.evict_oldest(sized, group="lesson_id", order=["turn_index", "turn_id"], tokens="tokens", budget=BUDGET).select("turn_id", "tokens", "evicted")


def first_seen_vs_pointer(spark, folder):
    """Where a lesson cites a label first, and where it points back to it."""
    rows = _turns(spark, folder, "lesson_id", "turn_index", "cited_labels").filter("lesson_id IS NOT NULL")
    cited = rows.select("turn_id", "lesson_id", "turn_index", F.explode(F.array_distinct("cited_labels")).alias("label"))
    return logs.first_seen(cited, keys=["lesson_id", "label"], order=["turn_index", "turn_id"]).select("turn_id", "label", "first")


def relabel(spark, folder):
    """Labels of a lesson numbered anew in the order of their first use."""
    rows = _turns(spark, folder, "lesson_id", "turn_index", "cited_labels").filter("lesson_id IS NOT NULL")
    cited = rows.select("lesson_id", "turn_index", "turn_id", F.posexplode("cited_labels").alias("at", "label"))
    first = cited.groupBy("lesson_id", "label").agg(F.min(F.struct("turn_index", "turn_id", "at")).alias("seen"))
    number = F.row_number().over(Window.partitionBy("lesson_id").orderBy("seen"))
    return first.select("lesson_id", "label", F.concat(F.lit("S"), number.cast("string")).alias("new_label"))


def resolve_citations(spark, folder):
    """Labels in answers against the labels on record; S0 never resolves."""
    rows = _turns(spark, folder, "answer_text", "cited_labels").filter("answer_text IS NOT NULL")
    cited = rows.select("turn_id", "cited_labels", F.explode(t.labels("answer_text")).alias("label"))
    return cited.select("turn_id", "label", ((F.col("label") != "S0") & F.coalesce(F.array_contains("cited_labels", F.col("label")), F.lit(False))).alias("resolved"))


def dangling_calls(spark, folder):
    """Turns with calls of tools but no answer, by lesson."""
    rows = _turns(spark, folder, "lesson_id", "research_statuses", "calc_calls", "answer_text")
    calls = F.coalesce(F.size("research_statuses"), F.lit(0)) + F.coalesce("calc_calls", F.lit(0))
    return rows.select("lesson_id", calls.cast("long").alias("calls"), F.col("answer_text").isNull().alias("open")).groupBy("lesson_id").agg(F.sum("calls").alias("calls"), F.sum(F.when(F.col("open"), F.col("calls")).otherwise(0)).alias("dangling"))


def repetition_runs(spark, folder):
    return logs.repeated_units(answers(spark, folder), key="turn_id", text="a")


def turn_rollup(spark, folder):
    """Counts, rates and percentiles of turns for each route."""
    rows = _turns(spark, folder, "route", "status", "wall_s", "ttft_s", "citations", "citations_resolved", "uncited", "eviction_events", "tokens_used", "cached_tokens")
    ok = F.col("status") == "ok"
    return rows.groupBy("route").agg(
        F.count("*").alias("turns"),
        F.count_if(ok).alias("ok"),
        F.round(F.percentile(F.when(ok, F.col("ttft_s")), F.lit(0.5)), 6).alias("ttft_p50"),
        F.round(F.percentile("wall_s", F.lit(0.95)), 6).alias("wall_p95"),
        F.sum(F.when(ok, F.col("citations"))).alias("citations"),
        F.round(F.sum(F.when(ok, F.col("citations_resolved"))) / F.nullif(F.sum(F.when(ok, F.col("citations"))), F.lit(0)), 6).alias("resolved_rate"),
        F.round(F.avg(F.when(ok, F.col("uncited").cast("double"))), 6).alias("uncited_rate"),
        F.sum("eviction_events").alias("evictions"),
        F.max(F.when(ok, F.col("tokens_used"))).alias("most_tokens"),
        F.round(F.avg(F.when(ok & (F.col("tokens_used") > 0), F.col("cached_tokens") / F.col("tokens_used"))), 6).alias("cache_ratio"),
    )


def answer_rollup(spark, folder):
    """How questions end, by subject: answered, cited, timed out."""
    rows = _turns(spark, folder, "subject", "input_text", "answer_text", "status", "citations").filter("trim(input_text) <> ''")
    return rows.groupBy("subject").agg(F.count("*").alias("asked"), F.count_if(F.trim("answer_text") != "").alias("answered"), F.count_if(F.col("citations") > 0).alias("cited"), F.round(F.avg(F.when(F.col("status") == "timeout", 1.0).otherwise(0.0)), 6).alias("timeout_rate"))


def toolcall_summary(spark, folder):
    """Outcomes of the research calls of all turns, and whether those that failed stay under two in a hundred."""
    calls = _turns(spark, folder, "route", "research_statuses").select("route", F.explode("research_statuses").alias("outcome"))
    return calls.groupBy("route").agg(F.count("*").alias("calls"), F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "empty").alias("empty"), (F.count_if(F.col("outcome") == "error") <= 0.02 * F.count("*")).alias("passes"))


def micro_backed_rate(spark, folder):
    """Resolved over all citations, weighted by citation and not by turn, with sums for all subjects too."""
    rows = _turns(spark, folder, "subject", "citations", "citations_resolved").filter("subject IS NOT NULL")
    return rows.rollup("subject").agg(F.sum("citations").alias("citations"), F.round(F.sum("citations_resolved") / F.nullif(F.sum("citations"), F.lit(0)), 6).alias("rate"))


def percentiles(spark, folder):
    rows = _turns(spark, folder, "input_kind", "wall_s").filter("wall_s IS NOT NULL")
    return rows.groupBy("input_kind").agg(*(F.round(F.percentile("wall_s", F.lit(p)), 6).alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)))


def nearest_p95(spark, folder):
    """The value at the rank nearest to 0.95 (n - 1), halves to the even one; equal values are counted before they are ranked."""
    values = _turns(spark, folder, "route", "wall_s").filter("wall_s IS NOT NULL").groupBy("route", "wall_s").agg(F.count("*").alias("times"))
    whole = Window.partitionBy("route")
    passed = F.sum("times").over(whole.orderBy("wall_s").rowsBetween(Window.unboundedPreceding, 0))
    at = F.bround(0.95 * (F.sum("times").over(whole) - 1))
    ranked = values.withColumn("passed", passed).withColumn("at", at)
    return ranked.filter((F.col("at") < F.col("passed")) & (F.col("at") >= F.col("passed") - F.col("times"))).select("route", F.col("wall_s").alias("p95"))


def gate_verdict(spark, folder):
    """Each route against the plain baseline of all turns: passes if it is no slower and resolves no fewer citations."""
    rows = _turns(spark, folder, "route", "wall_s", "citations", "citations_resolved")
    rate = F.sum("citations_resolved") / F.nullif(F.sum("citations"), F.lit(0))
    # the row for all turns is one of the grouping sets, and is put beside each route by a window over these few rows
    by = rows.groupingSets([["route"], []], "route").agg(F.percentile("wall_s", F.lit(0.5)).alias("wall"), rate.alias("rate"), F.grouping("route").alias("all"))
    base = Window.partitionBy(F.lit(1))
    beside = by.withColumn("base_wall", F.max(F.when(F.col("all") == 1, F.col("wall"))).over(base)).withColumn("base_rate", F.coalesce(F.max(F.when(F.col("all") == 1, F.col("rate"))).over(base), F.lit(0.0)))
    passes = (F.col("wall") <= F.col("base_wall")) & (F.round("rate", 9) >= F.round("base_rate", 9))
    return beside.filter(F.col("all") == 0).select("route", F.round("wall", 6).alias("wall"), F.round("rate", 6).alias("rate"), F.when(passes, "PASS").otherwise("FAIL").alias("verdict"))


def route_sources(spark, folder):
    """The archives that a lesson's subject is searched in, in order: tier 1, tier 2, then tier 3 of that subject."""
    archives = table(spark, folder, "archives", "archive_id", "tier", "subjects", "searchable").distinct().filter("searchable")
    subjects = table(spark, folder, "lessons", "subject").filter("subject IS NOT NULL").distinct()
    special = archives.filter("tier > 2").select("archive_id", "tier", F.explode(F.array_distinct("subjects")).alias("subject")).join(subjects, "subject", "left_semi")
    # those of the first tiers serve every subject: both sides meet over the tier's number
    general = archives.filter("tier <= 2").select("archive_id", "tier")
    every = subjects.withColumn("tier", F.explode(F.array(F.lit(1), F.lit(2))))
    routed = general.join(every, "tier").select("archive_id", "tier", "subject").unionByName(special.select("archive_id", "tier", "subject"))
    return routed.select("subject", "archive_id", "tier", F.row_number().over(Window.partitionBy("subject").orderBy("tier", "archive_id")).alias("place"))


def latest_version(spark, folder):
    rows = table(spark, folder, "dense_manifests", "archive_id", "manifest_id", "manifest_version", "created_at").distinct()
    return rows.groupBy("archive_id").agg(F.max_by("manifest_id", F.struct("created_at", "manifest_version", "manifest_id")).alias("manifest_id"), F.count("*").alias("builds"))


def catalog_plan(spark, folder):
    """What to do for each archive's file: its dated name against the newest build of its vectors."""
    files = table(spark, folder, "archives", "archive_id", "path").distinct()
    files = files.select("archive_id", F.regexp_extract("path", r"([^/]+)_(\d{4}-\d{2})[a-z]?\.zim$", 1).alias("base"), F.regexp_extract("path", r"_(\d{4}-\d{2})[a-z]?\.zim$", 1).alias("dated"))
    built = table(spark, folder, "dense_manifests", "archive_id", "created_at").groupBy("archive_id").agg(F.date_format(F.max("created_at"), "yyyy-MM").alias("built"))
    action = F.when(F.col("built").isNull(), "to_build").when(F.col("built") == F.col("dated"), "up_to_date").when(F.col("built") > F.col("dated"), "newer").otherwise("to_build")
    return files.join(built, "archive_id", "left").select("archive_id", "base", "dated", "built", action.alias("action"))


def backfill_verify(spark, folder):
    """The path column of the vectors against the snapshots' paths, row by row."""
    vectors = table(spark, folder, "dense_vectors", "vec_id", "passage_id", "path").groupBy("vec_id", "passage_id").agg(F.max("path").alias("path"))
    paths = table(spark, folder, "snapshots", "passage_id", "path").filter("passage_id IS NOT NULL").groupBy("passage_id").agg(F.max("path").alias("known"))
    verdict = F.when(F.col("known").isNull(), "unknown").when(F.col("path").isNull(), "filled").when(F.col("path") == F.col("known"), "same").otherwise("differs")
    return vectors.join(paths, "passage_id", "left").select("vec_id", F.coalesce("path", "known").alias("path"), verdict.alias("verdict"))


def scan_articles(spark, folder):
    """The first passage of each article, articles in the order of their first appearance by path."""
    rows = table(spark, folder, "snapshots", "archive_id", "path", "passage_id", "start_offset").filter("path IS NOT NULL")
    return rows.groupBy("archive_id", "path").agg(F.min_by("passage_id", F.struct("start_offset", "passage_id")).alias("lead"), F.countDistinct("passage_id").alias("passages"))


def section_tree(spark, folder):
    """Sections with their end by the next one's start, and the last earlier section of a lower level as parent."""
    rows = table(spark, folder, "sections", "archive_id", "path", "section_index", "heading_level", "start_offset").distinct()
    return extract.section_tree(rows)


def resolve_redirects(spark, folder):
    """Sections followed to the top of their article over their parents."""
    name = lambda i: F.concat_ws("|", "archive_id", "path", F.col(i).cast("string"))
    rows = table(spark, folder, "sections", "archive_id", "path", "section_index", "parent_index").filter("path IS NOT NULL").distinct()
    links = rows.select(name("section_index").alias("node"), F.when(F.col("parent_index").isNotNull(), name("parent_index")).alias("target"))
    return logs.resolve_chain(links, node="node", target="target")


def key_fact_runs(spark, folder):
    """Runs of neighbouring table rows in documents: first and last line of each."""
    lines = documents(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).filter("line LIKE '%|%'")
    runs = lines.withColumn("run", F.col("no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("no")))
    return runs.groupBy("doc_id", "run").agg(F.min("no").alias("first"), F.max("no").alias("last"), F.count("*").alias("rows")).drop("run")


def chunk_passages(spark, folder):
    """Texts packed word by word into passages of 400 characters at most."""
    return extract.chunk_words(documents(spark, folder), key="doc_id", text="text").select("doc_id", "piece_no", "start", "end")


def html_text(spark, folder):
    """Snapshots rendered as pages and read back to text."""
    rows = table(spark, folder, "snapshots", "passage_id", "title", "text").filter("passage_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["passage_id"])
    page = extract.render_page(F.coalesce("title", F.lit("")), F.col("text"))
    return rows.select("passage_id", F.md5(extract.page_text(page)).alias("text_md5"))


def internal_links(spark, folder):
    """Links of a page for each document, without those that leave the site."""
    pages = table(spark, folder, "documents", "doc_id", "path", "title").filter("path IS NOT NULL")
    html = F.concat(F.lit('<p><a href="'), "path", F.lit('">x</a> <a class="e" href="https://example.org/">y</a> <a href="'), "path", F.lit('">z</a></p>'))
    return pages.select("doc_id", F.array_join(extract.internal_links(html), " ").alias("links"))


def calc(spark, folder):
    """The products that answers state as formulas, computed exactly."""
    found = answers(spark, folder).select("turn_id", F.regexp_replace(F.regexp_extract("a", r"= ([\d.,]+ \* [\d.,]*\d)", 1), ",", "").alias("expression")).filter("expression <> ''")
    return found.select("turn_id", "expression", F.round(arithmetic.evaluate("expression").cast("double"), 4).alias("value"))


def budget_scaled(spark, folder):
    """How a lesson's largest context would be divided: fixed shares, and 80 to 20 of the rest for history and margin."""
    rows = _turns(spark, folder, "lesson_id", "tokens_used").groupBy("lesson_id").agg((F.coalesce(F.max("tokens_used"), F.lit(0)) + 8000).cast("long").alias("ceiling"))
    rest = F.greatest(F.col("ceiling") - 6500, F.lit(0))
    history = F.floor(rest * F.lit(21038 / 26268)).cast("long")
    return rows.select("lesson_id", "ceiling", history.alias("history"), (rest - history).cast("long").alias("margin"))


def cycle_script(spark, folder):
    """Lessons in the order of their start dealt to the 8 routes of a script in turn: numbered by day, behind the lessons of the days before."""
    rows = table(spark, folder, "lessons", "lesson_id", "started_at").groupBy("lesson_id").agg(F.min("started_at").alias("at")).withColumn("day", F.to_date("at"))
    days = rows.groupBy("day").agg(F.count("*").alias("n"))  # a row a day: its window has no partitions
    before = F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select(F.col("day").alias("of"), before.alias("before"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("at", "lesson_id")) - 1
    numbered = rows.withColumn("place", place).join(days, F.col("day").eqNullSafe(F.col("of")))
    return numbered.select("lesson_id", ((F.col("before") + F.col("place")) % 8).cast("long").alias("slot"))


def event_checks(spark, folder):
    """The arguments of each event checked as those of a call are, by the first rule that fails."""
    known, k = ("click", "view", "purchase", "signup"), F.get_json_object("props", "$.k")
    verdict = (
        F.when(~F.coalesce(F.col("event_type").isin(*known), F.lit(False)), "unknown_name").when(F.col("props").isNull() | ~F.col("props").rlike(r"^\s*\{.*\}\s*$"), "not_an_object")
        .when(k.isNull(), "missing_k").when(~k.rlike(r"^-?\d+$"), "wrong_type").when(~k.cast("double").between(0, 50), "out_of_range").otherwise("ok")
    )
    return table(spark, folder, "events", "event_type", "props").groupBy(F.col("event_type"), verdict.alias("verdict")).agg(F.count("*").alias("n"))


def response_class(spark, folder):
    """What answers are made of: none, a call written out as text, code, a table, a list, or prose."""
    kind = (
        F.when(F.trim("a") == "", "none").when(F.col("a").rlike(r"(?s)^\s*\{.*\"(name|arguments)\".*\}\s*$"), "call").when(F.contains("a", F.lit("```")), "code")
        .when(F.col("a").rlike(r"(?m)^\|.*\|$"), "table").when(F.col("a").rlike(r"(?m)^([-*•]|\d+[.)]) "), "list").otherwise("prose")
    )
    return answers(spark, folder).groupBy(kind.alias("kind")).agg(F.count("*").alias("turns"), F.sum(F.length("a")).alias("chars"))


def json_salvage(spark, folder):
    """Event properties cut off at the end, mended by the first ending that makes them whole."""
    raw = F.expr("substring(props, 1, length(props) - 1)")
    tries = [F.get_json_object(F.concat(raw, F.lit(end)), "$.k") for end in ("", "}", '"}', "]}", "null}")]
    return table(spark, folder, "events", "event_id", "props").select("event_id", F.coalesce(*tries).cast("long").alias("k"))


def events_props_json(spark, folder):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, folder, "events", "event_type", "props", "value").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def sse_parse(spark, folder):
    """Event frames written as lines and parsed back: the name line before a data line names it."""
    rows = table(spark, folder, "events", "event_id", "event_type", "props")
    lines = rows.select("event_id", F.posexplode(F.array(F.concat(F.lit("event: "), "event_type"), F.concat(F.lit("data: "), "props"), F.lit(""))).alias("no", "line"))
    name = F.last(F.when(F.col("line").startswith("event: "), F.substring("line", 8, 100)), ignorenulls=True).over(Window.partitionBy("event_id").orderBy("no"))
    return lines.withColumn("name", name).filter("line LIKE 'data: %'").select("event_id", "name", F.get_json_object(F.substring("line", 7, 1000), "$.k").cast("long").alias("k"))


def _events(spark, folder):
    return table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")


def _seconds(ts):
    """Seconds since 1970, of a time stamp without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1e6


def events_tumbling(spark, folder):
    by = _events(spark, folder).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return by.select(_seconds(F.col("w.start")).cast("long").alias("start_s"), "event_type", "n", "value")


def events_sliding(spark, folder):
    by = _events(spark, folder).groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return by.select(_seconds(F.col("w.start")).cast("long").alias("start_s"), "event_type", "n")


def events_session(spark, folder):
    by = _events(spark, folder).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return by.select("user_id", _seconds(F.col("w.start")).alias("start_s"), _seconds(F.col("last")).alias("last_s"), "n")


QUERIES = {f.__name__: f for f in (
    snapshot_upsert, turns_with_seq, turn_reduce, conv_tokens, token_growth, evict_turns, first_seen_vs_pointer, relabel, resolve_citations, dangling_calls,
    repetition_runs, turn_rollup, answer_rollup, toolcall_summary, micro_backed_rate, percentiles, nearest_p95, gate_verdict, route_sources, latest_version,
    catalog_plan, backfill_verify, scan_articles, section_tree, resolve_redirects, key_fact_runs, chunk_passages, html_text, internal_links, calc,
    budget_scaled, cycle_script, event_checks, response_class, json_salvage, events_props_json, sse_parse, events_tumbling, events_sliding, events_session,
)}

_T = "(SELECT DISTINCT {} FROM turn_records)"
_UNIT = r"trim(regexp_replace(lower(regexp_replace(s, '\[S\d+\]', '', 'g')), '\s+', ' ', 'g'), ' ')"
_SPLIT = r"list_filter(regexp_split_to_array(regexp_replace(a, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda s: regexp_matches(s, '[^\s\x{00A0}\x{200B}\x{3000}]'))"
_EPOCH = "CAST(epoch({}) AS BIGINT)"

SQL = {
    "snapshot_upsert": """
        SELECT passage_id, v.archive_id AS archive_id, v.start_offset AS start_offset, v.end_offset AS end_offset, md5(v.text) AS text_md5, created_at FROM (
          SELECT passage_id, arg_max({archive_id: archive_id, start_offset: start_offset, end_offset: end_offset, text: text}, coalesce(created_at, TIMESTAMP '1900-01-01')) AS v, min(created_at) AS created_at
          FROM snapshots WHERE passage_id IS NOT NULL GROUP BY passage_id)""",
    "turns_with_seq": f"""SELECT turn_id, lesson_id, started_at, CAST(row_number() OVER (PARTITION BY lesson_id ORDER BY started_at NULLS FIRST, turn_id) - 1 AS INTEGER) AS seq FROM {_T.format('turn_id, lesson_id, started_at')} WHERE lesson_id IS NOT NULL""",
    "turn_reduce": """
        WITH o AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY logged_at DESC NULLS LAST, status DESC NULLS LAST) AS i FROM turn_records)
        SELECT turn_id, min(ttft_s) AS ttft_s, max(status) FILTER (WHERE i = 1) AS status, max(tokens_used) AS tokens_used, max(calc_calls) AS calc_calls, max(logged_at) AS logged_at FROM o GROUP BY turn_id""",
    "conv_tokens": f"SELECT lesson_id, count(*) AS turns, CAST(sum(tokens_used) AS BIGINT) AS tokens, round(avg(CASE WHEN tokens_used > 0 THEN cached_tokens / tokens_used END), 6) AS cached_share FROM {_T.format('turn_id, lesson_id, tokens_used, cached_tokens')} GROUP BY lesson_id",
    "token_growth": f"""SELECT turn_id, CAST(sum(tokens_used) OVER w AS BIGINT) AS tokens, max(tokens_used) OVER w AS largest FROM {_T.format('turn_id, lesson_id, turn_index, tokens_used')} WHERE lesson_id IS NOT NULL
        WINDOW w AS (PARTITION BY lesson_id ORDER BY turn_index NULLS FIRST, turn_id ROWS UNBOUNDED PRECEDING)""",
    "evict_turns": f"""
        WITH s AS (SELECT turn_id, lesson_id, turn_index, CAST(ceil(length(coalesce(input_text, '') || coalesce(answer_text, '')) / 3.5) AS BIGINT) AS tokens FROM {_T.format('turn_id, lesson_id, turn_index, input_text, answer_text')} WHERE lesson_id IS NOT NULL)
        SELECT turn_id, tokens, sum(tokens) OVER w > {BUDGET} AND row_number() OVER w > 1 AS evicted FROM s WINDOW w AS (PARTITION BY lesson_id ORDER BY turn_index DESC NULLS LAST, turn_id DESC ROWS UNBOUNDED PRECEDING)""",
    "first_seen_vs_pointer": f"""
        WITH c AS (SELECT turn_id, lesson_id, turn_index, unnest(list_distinct(cited_labels)) AS label FROM {_T.format('turn_id, lesson_id, turn_index, cited_labels')} WHERE lesson_id IS NOT NULL)
        SELECT turn_id, label, row_number() OVER (PARTITION BY lesson_id, label ORDER BY turn_index NULLS FIRST, turn_id) = 1 AS first FROM c""",
    "relabel": f"""
        WITH c AS (SELECT lesson_id, turn_index, turn_id, unnest(cited_labels) AS label, generate_subscripts(cited_labels, 1) AS i FROM {_T.format('turn_id, lesson_id, turn_index, cited_labels')} WHERE lesson_id IS NOT NULL),
             f AS (SELECT lesson_id, label, min((turn_index, turn_id, i)) AS seen FROM c GROUP BY ALL)
        SELECT lesson_id, label, 'S' || row_number() OVER (PARTITION BY lesson_id ORDER BY seen) AS new_label FROM f""",
    "resolve_citations": rf"""
        WITH l AS (SELECT turn_id, cited_labels, unnest(regexp_extract_all(array_to_string(regexp_extract_all(answer_text, '\[(S\d+(?:\s*,\s*S\d+)*)\]', 1), ','), 'S\d+')) AS label FROM {_T.format('turn_id, answer_text, cited_labels')} WHERE answer_text IS NOT NULL)
        SELECT DISTINCT turn_id, label, label <> 'S0' AND coalesce(list_contains(cited_labels, label), false) AS resolved FROM l""",
    "dangling_calls": f"""
        SELECT lesson_id, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(CASE WHEN open THEN calls ELSE 0 END) AS BIGINT) AS dangling FROM (
          SELECT lesson_id, coalesce(len(research_statuses), 0) + coalesce(calc_calls, 0) AS calls, answer_text IS NULL AS open FROM {_T.format('turn_id, lesson_id, research_statuses, calc_calls, answer_text')}) GROUP BY lesson_id""",
    "repetition_runs": f"""
        WITH u AS (SELECT turn_id, no, {_UNIT} AS unit FROM (SELECT turn_id, unnest(x) AS s, generate_subscripts(x, 1) - 1 AS no FROM (SELECT turn_id, {_SPLIT} AS x FROM (SELECT DISTINCT turn_id, answer_text AS a FROM turn_records WHERE answer_text IS NOT NULL)))),
             f AS (SELECT *, CASE WHEN unit = lag(unit) OVER (PARTITION BY turn_id ORDER BY no) THEN 0 ELSE 1 END AS fresh FROM u),
             r AS (SELECT *, sum(fresh) OVER (PARTITION BY turn_id ORDER BY no) AS run FROM f)
        SELECT turn_id, md5(any_value(unit)) AS unit_md5, CAST(min(no) AS INTEGER) AS first_no, count(*) AS times FROM r GROUP BY turn_id, run HAVING count(*) > 1 AND length(any_value(unit)) >= 20""",
    "turn_rollup": f"""
        SELECT route, count(*) AS turns, count(*) FILTER (WHERE status = 'ok') AS ok, round(quantile_cont(ttft_s, 0.5) FILTER (WHERE status = 'ok'), 6) AS ttft_p50, round(quantile_cont(wall_s, 0.95), 6) AS wall_p95,
               CAST(sum(citations) FILTER (WHERE status = 'ok') AS BIGINT) AS citations, round(sum(citations_resolved) FILTER (WHERE status = 'ok') / nullif(sum(citations) FILTER (WHERE status = 'ok'), 0), 6) AS resolved_rate,
               round(avg(CAST(uncited AS INTEGER)) FILTER (WHERE status = 'ok'), 6) AS uncited_rate, CAST(sum(eviction_events) AS BIGINT) AS evictions, max(tokens_used) FILTER (WHERE status = 'ok') AS most_tokens,
               round(avg(cached_tokens / tokens_used) FILTER (WHERE status = 'ok' AND tokens_used > 0), 6) AS cache_ratio
        FROM {_T.format('turn_id, route, status, wall_s, ttft_s, citations, citations_resolved, uncited, eviction_events, tokens_used, cached_tokens')} GROUP BY route""",
    "answer_rollup": f"""SELECT subject, count(*) AS asked, count(*) FILTER (WHERE trim(answer_text, ' ') <> '') AS answered, count(*) FILTER (WHERE citations > 0) AS cited, round(avg(CASE WHEN status = 'timeout' THEN 1 ELSE 0 END), 6) AS timeout_rate
        FROM {_T.format('turn_id, subject, input_text, answer_text, status, citations')} WHERE trim(input_text) <> '' GROUP BY subject""",
    "toolcall_summary": f"""SELECT route, count(*) AS calls, count(*) FILTER (WHERE o = 'ok') AS ok, count(*) FILTER (WHERE o = 'empty') AS empty, count(*) FILTER (WHERE o = 'error') <= 0.02 * count(*) AS passes
        FROM (SELECT route, unnest(research_statuses) AS o FROM {_T.format('turn_id, route, research_statuses')}) GROUP BY route""",
    "micro_backed_rate": f"""SELECT subject, CAST(sum(citations) AS BIGINT) AS citations, round(sum(citations_resolved) / nullif(sum(citations), 0), 6) AS rate FROM {_T.format('turn_id, subject, citations, citations_resolved')} WHERE subject IS NOT NULL GROUP BY ROLLUP (subject)""",
    "percentiles": f"""SELECT input_kind, round(quantile_cont(wall_s, 0.5), 6) AS p50, round(quantile_cont(wall_s, 0.95), 6) AS p95, round(quantile_cont(wall_s, 0.99), 6) AS p99 FROM {_T.format('turn_id, input_kind, wall_s')} WHERE wall_s IS NOT NULL GROUP BY input_kind""",
    "nearest_p95": f"""
        WITH r AS (SELECT route, wall_s, row_number() OVER (PARTITION BY route ORDER BY wall_s, turn_id) - 1 AS i, count(*) OVER (PARTITION BY route) AS n FROM {_T.format('turn_id, route, wall_s')} WHERE wall_s IS NOT NULL)
        SELECT route, wall_s AS p95 FROM r WHERE i = round_even(0.95 * (n - 1), 0)""",
    "gate_verdict": f"""
        WITH t AS (SELECT * FROM {_T.format('turn_id, route, wall_s, citations, citations_resolved')}), b AS (SELECT quantile_cont(wall_s, 0.5) AS bw, sum(citations_resolved) / nullif(sum(citations), 0) AS br FROM t),
             g AS (SELECT route, quantile_cont(wall_s, 0.5) AS wall, sum(citations_resolved) / nullif(sum(citations), 0) AS rate FROM t GROUP BY route)
        SELECT route, round(wall, 6) AS wall, round(rate, 6) AS rate, CASE WHEN wall <= bw AND round(rate, 9) >= round(br, 9) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g, b""",
    "route_sources": """
        WITH a AS (SELECT DISTINCT * FROM archives WHERE searchable), s AS (SELECT DISTINCT subject FROM lessons WHERE subject IS NOT NULL),
             u AS (SELECT subject, archive_id, tier FROM a, s WHERE tier <= 2 UNION ALL SELECT s.subject, archive_id, tier FROM (SELECT archive_id, tier, unnest(subjects) AS subject FROM a WHERE tier = 3) JOIN s USING (subject))
        SELECT *, CAST(row_number() OVER (PARTITION BY subject ORDER BY tier, archive_id) AS INTEGER) AS place FROM u""",
    "latest_version": "SELECT archive_id, arg_max(manifest_id, (created_at, manifest_version, manifest_id)) AS manifest_id, count(*) AS builds FROM (SELECT DISTINCT archive_id, manifest_id, manifest_version, created_at FROM dense_manifests) GROUP BY archive_id",
    "catalog_plan": r"""
        WITH f AS (SELECT DISTINCT archive_id, regexp_extract(path, '([^/]+)_(\d{4}-\d{2})[a-z]?\.zim$', 1) AS base, regexp_extract(path, '_(\d{4}-\d{2})[a-z]?\.zim$', 1) AS dated FROM archives),
             b AS (SELECT archive_id, strftime(max(created_at), '%Y-%m') AS built FROM dense_manifests GROUP BY archive_id)
        SELECT archive_id, base, dated, built, CASE WHEN built IS NULL THEN 'to_build' WHEN built = dated THEN 'up_to_date' WHEN built > dated THEN 'newer' ELSE 'to_build' END AS action FROM f LEFT JOIN b USING (archive_id)""",
    "backfill_verify": """
        WITH v AS (SELECT vec_id, passage_id, max(path) AS path FROM dense_vectors GROUP BY ALL), p AS (SELECT passage_id, max(path) AS known FROM snapshots WHERE passage_id IS NOT NULL GROUP BY passage_id)
        SELECT vec_id, coalesce(path, known) AS path, CASE WHEN known IS NULL THEN 'unknown' WHEN path IS NULL THEN 'filled' WHEN path = known THEN 'same' ELSE 'differs' END AS verdict FROM v LEFT JOIN p USING (passage_id)""",
    "scan_articles": "SELECT archive_id, path, arg_min(passage_id, (start_offset, passage_id)) AS lead, count(DISTINCT passage_id) AS passages FROM snapshots WHERE path IS NOT NULL GROUP BY ALL",
    "section_tree": """
        WITH s AS (SELECT DISTINCT archive_id, path, section_index, heading_level, start_offset FROM sections),
             p AS (SELECT a.archive_id, a.path, a.section_index, a.start_offset, max(b.section_index) AS parent FROM s a LEFT JOIN s b ON a.archive_id = b.archive_id AND a.path = b.path AND b.section_index < a.section_index AND b.heading_level < a.heading_level GROUP BY ALL)
        SELECT archive_id, path, section_index, start_offset, lead(start_offset) OVER (PARTITION BY archive_id, path ORDER BY section_index, start_offset) AS end_offset, parent FROM p""",
    "resolve_redirects": """
        WITH RECURSIVE s AS (SELECT DISTINCT archive_id || '|' || path || '|' || section_index AS node, archive_id || '|' || path || '|' || parent_index AS target FROM sections WHERE path IS NOT NULL),
             r AS (SELECT node, node AS at_, target, 0 AS hops FROM s UNION ALL SELECT r.node, s.node, s.target, hops + 1 FROM r JOIN s ON r.target = s.node WHERE hops < 30)
        SELECT node, at_ AS root, hops, 'ok' AS status FROM r WHERE target IS NULL""",
    "key_fact_runs": """
        WITH l AS (SELECT doc_id, line, i - 1 AS no FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE line LIKE '%|%'),
             r AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS run FROM l)
        SELECT doc_id, CAST(min(no) AS INTEGER) AS first, CAST(max(no) AS INTEGER) AS last, count(*) AS rows FROM r GROUP BY doc_id, run""",
    "html_text": r"""SELECT DISTINCT passage_id, md5(trim(regexp_replace(coalesce(title, '') || ' ' || text, '\s+', ' ', 'g'), ' ')) AS text_md5 FROM snapshots WHERE passage_id IS NOT NULL AND text IS NOT NULL""",
    "internal_links": "SELECT doc_id, path AS links FROM documents WHERE path IS NOT NULL",
    "calc": r"""
        WITH e AS (SELECT turn_id, replace(regexp_extract(a, '= ([\d.,]+ \* [\d.,]*\d)', 1), ',', '') AS expression FROM (SELECT DISTINCT turn_id, answer_text AS a FROM turn_records WHERE answer_text IS NOT NULL))
        SELECT turn_id, expression, round(CAST(string_split(expression, ' * ')[1] AS DOUBLE) * CAST(string_split(expression, ' * ')[2] AS DOUBLE), 4) AS value FROM e WHERE expression <> ''""",
    "budget_scaled": f"""
        WITH c AS (SELECT lesson_id, CAST(coalesce(max(tokens_used), 0) + 8000 AS BIGINT) AS ceiling FROM {_T.format('turn_id, lesson_id, tokens_used')} GROUP BY lesson_id),
             h AS (SELECT *, CAST(floor(greatest(ceiling - 6500, 0) * (CAST(21038 AS DOUBLE) / 26268)) AS BIGINT) AS history FROM c)
        SELECT lesson_id, ceiling, history, greatest(ceiling - 6500, 0) - history AS margin FROM h""",
    "cycle_script": """
        SELECT lesson_id, CAST((row_number() OVER (ORDER BY CAST(began AS DATE) NULLS FIRST, began NULLS FIRST, lesson_id NULLS FIRST) - 1) % 8 AS BIGINT) AS slot
        FROM (SELECT lesson_id, min(started_at) AS began FROM lessons GROUP BY lesson_id)""",
    "event_checks": r"""
        WITH e AS (SELECT event_type, props, json_extract_string(props, '$.k') AS k FROM events)
        SELECT event_type, CASE WHEN NOT coalesce(event_type IN ('click', 'view', 'purchase', 'signup'), false) THEN 'unknown_name' WHEN props IS NULL OR NOT regexp_matches(props, '^\s*\{.*\}\s*$') THEN 'not_an_object'
               WHEN k IS NULL THEN 'missing_k' WHEN NOT regexp_matches(k, '^-?\d+$') THEN 'wrong_type' WHEN NOT (CAST(k AS DOUBLE) BETWEEN 0 AND 50) THEN 'out_of_range' ELSE 'ok' END AS verdict, count(*) AS n FROM e GROUP BY ALL""",
    "response_class": r"""
        SELECT CASE WHEN trim(a, ' ') = '' THEN 'none' WHEN regexp_matches(a, '^\s*\{.*"(name|arguments)".*\}\s*$', 's') THEN 'call' WHEN contains(a, '```') THEN 'code'
                    WHEN regexp_matches(a, '(?m)^\|.*\|$') THEN 'table' WHEN regexp_matches(a, '(?m)^([-*•]|\d+[.)]) ') THEN 'list' ELSE 'prose' END AS kind, count(*) AS turns, CAST(sum(length(a)) AS BIGINT) AS chars
        FROM (SELECT DISTINCT turn_id, answer_text AS a FROM turn_records WHERE answer_text IS NOT NULL) GROUP BY ALL""",
    "json_salvage": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "events_props_json": "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "sse_parse": "SELECT event_id, event_type AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "events_tumbling": f"SELECT {_EPOCH.format("time_bucket(INTERVAL 1 HOUR, ts)")} AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "events_sliding": f"""SELECT {_EPOCH.format('start')} AS start_s, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY ALL""",
    "events_session": """
        WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
             s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
        SELECT user_id, epoch(min(ts)) AS start_s, epoch(max(ts)) AS last_s, count(*) AS n FROM s GROUP BY user_id, run""",
}
