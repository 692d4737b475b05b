"""Queries of the text functions over questions, answers and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import sql
from glossmill.functions import text as t
from glossmill.operators import index
from glossmill.sources.tables import table


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """(turn_id, q, subject): the question of each turn that has one."""
    turns = table(spark, folder, "turn_records", "turn_id", "input_text", "subject").filter("trim(input_text) <> ''")
    return turns.select("turn_id", F.col("input_text").alias("q"), "subject").dropDuplicates(["turn_id"])  # logged again, a turn is the same


def answers(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "turn_records", "turn_id", "answer_text").filter("answer_text IS NOT NULL")
    return turns.select("turn_id", F.col("answer_text").alias("a")).dropDuplicates(["turn_id"])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "title", "text", "lang", "source")


def _sorted(xs):
    return F.array_join(F.array_sort(xs), " ")


Q = "(SELECT DISTINCT turn_id, input_text AS q, subject FROM turn_records WHERE trim(input_text) <> '')"
A = "(SELECT DISTINCT turn_id, answer_text AS a FROM turn_records WHERE answer_text IS NOT NULL)"


def tokenize_counts(spark, folder):
    exploded = index.exploded(documents(spark, folder), "lang", terms=t.tokens("text"))
    return exploded.groupBy("lang", "term").agg(F.count("*").alias("n"))


def singularize_vocab(spark, folder):
    vocabulary = index.exploded(documents(spark, folder), terms=t.tokens("text")).distinct()
    return vocabulary.select("term", t.singular(F.col("term")).alias("singular"))


def strip_instruction(spark, folder):
    return questions(spark, folder).select("turn_id", F.trim(t.strip_instruction("q")).alias("stripped"))


def superlative_words(spark, folder):
    vocabulary = index.exploded(documents(spark, folder), terms=t.tokens("text")).distinct()
    return vocabulary.select("term", t.is_superlative(F.col("term")).alias("superlative"))


def question_terms(spark, folder):
    return questions(spark, folder).select("turn_id", _sorted(t.question_terms("q")).alias("terms"), _sorted(F.array_distinct(t.modifiers("q"))).alias("modifiers"))


def coverage_terms(spark, folder):
    return questions(spark, folder).select("turn_id", _sorted(t.coverage_terms("q", "subject")).alias("terms"))


def quantity_predicate(spark, folder):
    return questions(spark, folder).select("turn_id", t.asks_for_quantity("q").alias("quantity"), F.col("q").rlike(r"(?i)\bhow (do|would|can|should) (i|you|we)\b").alias("procedural"))


def role_weights(spark, folder):
    return questions(spark, folder).select("turn_id", F.inline(t.role_weights("q")))


def estimate_tokens(spark, folder):
    return documents(spark, folder).filter("text IS NOT NULL").select("doc_id", t.estimate_tokens("text").alias("tokens"))


def snippet(spark, folder):
    return documents(spark, folder).filter("text IS NOT NULL AND title IS NOT NULL").select("doc_id", F.md5(t.snippet("text", "title")).alias("snippet_md5"))


def extract_labels(spark, folder):
    return answers(spark, folder).select("turn_id", F.array_join(t.labels("a"), " ").alias("labels"))


def figures(spark, folder):
    return answers(spark, folder).select("turn_id", _sorted(t.figures("a")).alias("figures"))


def sentence_split(spark, folder):
    return answers(spark, folder).select("turn_id", F.posexplode(t.sentences("a")).alias("sentence_no", "sentence")).select("turn_id", "sentence_no", F.md5("sentence").alias("sentence_md5"))


def non_claim(spark, folder):
    parts = answers(spark, folder).select("turn_id", F.explode(t.sentences("a")).alias("s"))
    return parts.groupBy("turn_id").agg(F.count("*").alias("sentences"), F.count_if(t.is_no_claim("s")).alias("no_claims"))


def reply_class(spark, folder):
    return answers(spark, folder).select("turn_id", t.reply_class("a").alias("reply"))


def message_gate(spark, folder):
    return questions(spark, folder).select("turn_id", t.message_class("q", ["fungus", "fault"]).alias("verdict"))


def slugify(spark, folder):
    return documents(spark, folder).filter("title IS NOT NULL").select("doc_id", t.slug("title").alias("slug"))


def pointer_text(spark, folder):
    snapshots = table(spark, folder, "snapshots", "passage_id", "title", "text").filter("text IS NOT NULL AND passage_id IS NOT NULL").distinct()
    return snapshots.select("passage_id", t.pointer("title", "text").alias("pointer"))


def strip_script(spark, folder):
    wrapped = F.concat(F.lit("<p>"), F.substring("text", 1, 40), F.lit('</p><script type="x">'), "text", F.lit("</script><p>end</p>"))
    return documents(spark, folder).filter("text IS NOT NULL").select("doc_id", t.without_scripts(wrapped).alias("html"))


def bigrams(spark, folder):
    """The first two distinct pairs of neighbouring terms of each question."""
    own = questions(spark, folder).select("turn_id", t.tokens("q").alias("w"))
    pairs = F.array_distinct(F.zip_with(F.slice(F.col("w"), 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice(F.col("w"), 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b)))
    return own.filter(F.size("w") > 1).select("turn_id", F.array_join(F.slice(pairs, 1, 2), "|").alias("pairs"))


def set_ops_terms(spark, folder):
    """Terms of the documents by language: held by both en and fr, by en only, by any, and whether de's are among en's."""
    words = index.exploded(documents(spark, folder), "lang", terms=t.tokens("text"))
    by = words.filter(F.col("lang").isin("en", "fr", "de")).groupBy("term").agg(*(F.max((F.col("lang") == x).cast("int")).alias(x) for x in ("en", "fr", "de")))
    return by.agg(
        F.count_if((F.col("en") == 1) & (F.col("fr") == 1)).alias("both"),
        F.count_if((F.col("en") == 1) & (F.col("fr") == 0)).alias("en_only"),
        F.count("*").alias("any"),
        (F.count_if((F.col("de") == 1) & (F.col("en") == 0)) == 0).alias("de_within_en"),
    )


def passage_ids(spark, folder):
    rows = table(spark, folder, "snapshots", "passage_id", "fingerprint_digest", "archive_id", "path", "text", "start_offset", "end_offset").filter("passage_id IS NOT NULL AND text IS NOT NULL AND path IS NOT NULL").distinct()
    parts = [F.col(c) for c in ("fingerprint_digest", "archive_id", "path")] + [F.sha2("text", 256), F.col("start_offset").cast("string"), F.col("end_offset").cast("string")]
    return rows.select("passage_id", t.passage_id(*parts).alias("content_id"))


def fingerprint(spark, folder):
    return table(spark, folder, "archives", "archive_id", "path", "tier").distinct().select("archive_id", F.sha2(F.concat_ws("", "archive_id", "path", F.col("tier").cast("string")), 256).alias("digest"))


def relocate_span(spark, folder):
    """Where a snapshot's first line stands in its text: at the stored place, else where it first occurs."""
    rows = table(spark, folder, "snapshots", "passage_id", "text").filter("passage_id IS NOT NULL AND text IS NOT NULL").distinct()
    wanted = F.element_at(F.split("text", "\n"), -1)
    rows = rows.withColumn("wanted", wanted).filter("wanted <> ''").withColumn("stored", F.length("text") - F.length("wanted") - 1)
    here = F.substring("text", F.col("stored") + 1, F.length("wanted")) == F.col("wanted")
    start = F.when(here & (F.col("stored") >= 0), F.col("stored")).otherwise(F.instr("text", F.col("wanted")) - 1)
    return rows.select("passage_id", start.cast("long").alias("start"), (start + F.length("wanted")).cast("long").alias("end"))


def l2_normalize(spark, folder):
    vectors = table(spark, folder, "embeddings", "vec_id", "embedding")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))
    return vectors.select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 5).alias("sum"), F.round(F.array_max(unit), 5).alias("largest"))


def score_calc(spark, folder):
    """Answers that state a number near the first figure of their question: within 0.01, 0.5 % or a thousandth."""
    both = table(spark, folder, "turn_records", "turn_id", "input_text", "answer_text").filter("input_text IS NOT NULL AND answer_text IS NOT NULL").distinct()
    number = lambda c: F.transform(F.regexp_extract_all(F.regexp_replace(c, r"\[S\d+(,\s*S\d+)*\]", ""), F.lit(r"(-?\d[\d,]*(?:\.\d+)?)")), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    first = F.get(number(F.col("input_text")), F.lit(0))
    near = F.exists(number(F.col("answer_text")), lambda x: F.abs(x - F.col("wanted")) <= F.greatest(F.lit(0.01), F.abs(F.col("wanted")) * 0.005))
    return both.withColumn("wanted", first).filter("wanted IS NOT NULL").select("turn_id", "wanted", F.coalesce(near, F.lit(False)).alias("found"))


def render_evidence(spark, folder):
    """The passages of an article as labelled lines, in the order of their offsets."""
    rows = table(spark, folder, "snapshots", "archive_id", "path", "passage_id", "start_offset", "text").filter("path IS NOT NULL AND text IS NOT NULL").distinct()
    lines = F.array_sort(F.collect_list(F.struct("start_offset", "passage_id", "text")))
    body = F.transform(lines, lambda x, i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("] "), x["text"]))
    return rows.groupBy("archive_id", "path").agg(F.md5(F.array_join(body, "\n")).alias("evidence_md5"), F.count("*").alias("passages"))


def title_gate(spark, folder):
    """Subjects of lessons that are a title, or the start of one before a bracket."""
    names = table(spark, folder, "lessons", "subject").filter("subject IS NOT NULL").select(F.lower("subject").alias("name")).distinct()
    titles = documents(spark, folder).filter("title IS NOT NULL").select(F.lower(F.trim(F.regexp_replace("title", r"[,(:].*$", ""))).alias("name")).distinct()
    known = titles.withColumn("known", F.lit(True))
    return names.join(known, "name", "left").select("name", F.coalesce("known", F.lit(False)).alias("known"))


def message_lengths(spark, folder):
    """Characters and estimated tokens of questions by subject, with what is left of a scaled context budget."""
    sizes = questions(spark, folder).groupBy("subject").agg(F.count("*").alias("questions"), F.sum(t.estimate_tokens("q")).alias("tokens"))
    return sizes.select("subject", "questions", "tokens")


QUERIES = {f.__name__: f for f in (
    tokenize_counts, singularize_vocab, strip_instruction, superlative_words, question_terms, coverage_terms, quantity_predicate, role_weights,
    estimate_tokens, snippet, extract_labels, figures, sentence_split, non_claim, reply_class, message_gate, slugify, pointer_text, strip_script,
    bigrams, set_ops_terms, passage_ids, fingerprint, relocate_span, l2_normalize, score_calc, render_evidence, title_gate, message_lengths,
)}

_VOCABULARY = f"(SELECT DISTINCT unnest({sql.tokens('text')}) AS term FROM documents)"
_NUMBERS = r"list_transform(regexp_extract_all(regexp_replace({}, '\[S\d+(,\s*S\d+)*\]', '', 'g'), '-?\d[\d,]*(?:\.\d+)?'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE))"
_FIGURES = r"regexp_replace(regexp_replace(regexp_replace(a, '\[(S\d+(?:\s*,\s*S\d+)*)\]', '', 'g'), '^\s*\d+[.)](\s+|$)', ''), '−', '-', 'g')"
_SPLIT = r"list_filter(regexp_split_to_array(regexp_replace(a, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda s: regexp_matches(s, '[^\s\x{00A0}\x{200B}\x{3000}]'))"
_PLAIN = "translate(lower(q), '013457$@', 'oieastsa')"
_CHAT = f"list_filter(regexp_split_to_array(replace(replace(replace(regexp_replace({_PLAIN}, '[^a-z\\s'']', ' ', 'g'), 'thank you', 'thankyou'), 'got it', 'gotit'), 'i see', 'isee'), '\\s+'), lambda w: w <> '')"

SQL = {
    "tokenize_counts": f"SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest({sql.tokens('text')}) AS term FROM documents) GROUP BY ALL",
    "singularize_vocab": f"SELECT term, {sql.singular('term')} AS singular FROM {_VOCABULARY}",
    "strip_instruction": f"SELECT turn_id, trim({sql.strip_instruction('q')}) AS stripped FROM {Q}",
    "superlative_words": f"SELECT term, {sql.is_superlative('term')} AS superlative FROM {_VOCABULARY}",
    "question_terms": f"SELECT turn_id, {sql.joined(sql.question_terms('q'))} AS terms, {sql.joined(f'list_distinct({sql.modifiers("q")})')} AS modifiers FROM {Q}",
    "coverage_terms": f"""
        WITH o AS (SELECT *, list_distinct({sql.tokens(f"({sql.strip_instruction('q')})")}) AS own FROM {Q})
        SELECT turn_id, {sql.joined(f'''list_filter(CASE WHEN subject IS NOT NULL AND (len(list_filter(own, lambda x: x NOT IN ({sql.quoted("tell more explain elaborate continue".split())}))) <= 1
               OR regexp_matches(q, '(?i)\\b(it|its|this|that|those|them|again)\\b')) THEN list_distinct(list_concat(own, {sql.tokens("subject")})) ELSE own END,
               lambda x: NOT list_contains({sql.modifiers("q")}, x))''')} AS terms FROM o""",
    "quantity_predicate": rf"""
        SELECT turn_id, regexp_matches(q, '(?i)\bhow (many|much|long|far|fast|old|tall|hot|cold|high|deep)\b|\bdegrees?\b|\bpercent\b|%|\bnumber of\b') AS quantity,
               regexp_matches(q, '(?i)\bhow (do|would|can|should) (i|you|we)\b') AS procedural FROM {Q}""",
    "role_weights": rf"""
        WITH r AS (SELECT turn_id, unnest(list_distinct(list_transform(list_concat(regexp_extract_all(q, '(?i)\bof\s+([a-z]+)', 1), regexp_extract_all(q, '(?i)\b([a-z]+)''s\b', 1)),
                          lambda t: {sql.singular('lower(t)')}))) AS term, CAST(2.5 AS DOUBLE) AS weight FROM {Q}
                   UNION ALL
                   SELECT turn_id, unnest(list_distinct(list_transform(regexp_extract_all(q, '(?i)\bin\s+([a-z]+)\b', 1), lambda t: {sql.singular('lower(t)')}))), CAST(0.3 AS DOUBLE) FROM {Q})
        SELECT turn_id, term, max(weight) AS weight FROM r GROUP BY turn_id, term""",
    "estimate_tokens": "SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL",
    "snippet": r"""
        WITH p AS (SELECT doc_id, text, coalesce(list_filter(list_transform(list_filter(regexp_split_to_array(lower(title), '\s+'), lambda w: w <> ''),
                          lambda w: instr(lower(text), w)), lambda i: i > 0)[1], 0) AS place FROM documents WHERE text IS NOT NULL AND title IS NOT NULL)
        SELECT doc_id, md5(trim(substring(text, CASE WHEN place > 0 THEN greatest(place - 81, 0) ELSE 0 END + 1, 200), ' ')) AS snippet_md5 FROM p""",
    "extract_labels": rf"""
        WITH l AS (SELECT turn_id, list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform(regexp_extract_all(a, '\[(S\d+(?:\s*,\s*S\d+)*)\]', 1), lambda g: regexp_extract_all(g, 'S\d+'))),
                          lambda x, y: list_concat(x, list_filter(y, lambda v, i: NOT list_contains(x, v) AND list_position(y, v) = i))) AS xs FROM {A})
        SELECT turn_id, array_to_string(xs, ' ') AS labels FROM l""",
    "figures": rf"SELECT turn_id, {sql.joined(f"list_distinct(regexp_extract_all({_FIGURES}, '-?\\d+(?:\\.\\d+)?'))")} AS figures FROM {A}",
    "sentence_split": f"SELECT turn_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sentence_no, md5(unnest(s)) AS sentence_md5 FROM (SELECT turn_id, {_SPLIT} AS s FROM {A})",
    "non_claim": rf"""
        SELECT turn_id, count(*) AS sentences, count(*) FILTER (WHERE s = '' OR s LIKE '%?' OR (s LIKE '%!' AND len(regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+')) <= 4)
               OR regexp_matches(s, '^\d+[.)]\s*$') OR (regexp_matches(s, '^(\[[^\[\]]*\]\s*)+$') AND NOT regexp_matches(s, 'S\d+'))) AS no_claims
        FROM (SELECT turn_id, trim(unnest({_SPLIT}), ' ') AS s FROM {A}) GROUP BY turn_id""",
    "reply_class": rf"""
        WITH c AS (SELECT turn_id, trim(regexp_replace(regexp_replace(lower(a), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS c FROM {A})
        SELECT turn_id, CASE WHEN c IN ('yes','yeah','yep','yup','ya','y','yes please','thats it','correct','right') THEN 'yes'
                             WHEN c IN ('no','nope','nah','n','not that','no thats not it') THEN 'no' END AS reply FROM c""",
    "message_gate": f"""
        SELECT turn_id, CASE WHEN regexp_matches({_PLAIN}, '\\b(fungus|fault)\\b') THEN 'decline'
                             WHEN len({_CHAT}) > 0 AND len(list_filter({_CHAT}, lambda w: w NOT IN ({sql.quoted(sql.words.CHAT_WORDS)}))) = 0 THEN 'chat' ELSE 'normal' END AS verdict FROM {Q}""",
    "slugify": "SELECT doc_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents WHERE title IS NOT NULL",
    "pointer_text": r"""
        WITH w AS (SELECT DISTINCT passage_id, title, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM snapshots WHERE text IS NOT NULL AND passage_id IS NOT NULL)
        SELECT passage_id, trim('(already shown above) ' || coalesce(title, '') || ' — ' || array_to_string(w[1:8], ' ') || CASE WHEN len(w) > 8 THEN '…' ELSE '' END) AS pointer FROM w""",
    "strip_script": """SELECT doc_id, '<p>' || substring(text, 1, 40) || '</p><p>end</p>' AS html FROM documents WHERE text IS NOT NULL""",
    "bigrams": f"""
        WITH w AS (SELECT turn_id, {sql.tokens('q')} AS w FROM {Q}),
             p AS (SELECT turn_id, i, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT turn_id, w, unnest(range(1, len(w))) AS i FROM w)),
             f AS (SELECT turn_id, pair, min(i) AS i FROM p GROUP BY ALL)
        SELECT turn_id, array_to_string(list(pair ORDER BY i)[1:2], '|') AS pairs FROM f GROUP BY turn_id""",
    "set_ops_terms": f"""
        WITH d AS (SELECT DISTINCT lang, unnest({sql.tokens('text')}) AS term FROM documents WHERE lang IN ('en', 'fr', 'de')),
             e AS (SELECT term FROM d WHERE lang = 'en'), f AS (SELECT term FROM d WHERE lang = 'fr'), g AS (SELECT term FROM d WHERE lang = 'de')
        SELECT (SELECT count(*) FROM (SELECT * FROM e INTERSECT SELECT * FROM f)) AS both, (SELECT count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM f)) AS en_only,
               (SELECT count(DISTINCT term) FROM d) AS "any", NOT EXISTS (SELECT * FROM g EXCEPT SELECT * FROM e) AS de_within_en""",
    "passage_ids": """
        SELECT DISTINCT passage_id, substring(sha256(concat_ws(chr(31), fingerprint_digest, archive_id, path, sha256(text), CAST(start_offset AS VARCHAR), CAST(end_offset AS VARCHAR))), 1, 32) AS content_id
        FROM snapshots WHERE passage_id IS NOT NULL AND text IS NOT NULL AND path IS NOT NULL""",
    "fingerprint": "SELECT DISTINCT archive_id, sha256(archive_id || path || CAST(tier AS VARCHAR)) AS digest FROM archives",
    "relocate_span": """
        WITH w AS (SELECT DISTINCT passage_id, text, string_split(text, chr(10))[-1] AS wanted FROM snapshots WHERE passage_id IS NOT NULL AND text IS NOT NULL),
             s AS (SELECT *, length(text) - length(wanted) - 1 AS stored FROM w WHERE wanted <> ''),
             p AS (SELECT passage_id, wanted, CASE WHEN stored >= 0 AND substring(text, stored + 1, length(wanted)) = wanted THEN stored ELSE instr(text, wanted) - 1 END AS start FROM s)
        SELECT passage_id, CAST(start AS BIGINT) AS start, CAST(start + length(wanted) AS BIGINT) AS "end" FROM p""",
    "l2_normalize": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v)
        SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / n)), 5) AS sum, round(list_max(list_transform(e, lambda x: x / n)), 5) AS largest FROM n""",
    "score_calc": f"""
        WITH b AS (SELECT DISTINCT turn_id, input_text, answer_text FROM turn_records WHERE input_text IS NOT NULL AND answer_text IS NOT NULL),
             w AS (SELECT turn_id, {_NUMBERS.format('input_text')}[1] AS wanted, {_NUMBERS.format('answer_text')} AS said FROM b)
        SELECT turn_id, wanted, len(list_filter(said, lambda x: abs(x - wanted) <= greatest(CAST(0.01 AS DOUBLE), abs(wanted) * CAST(0.005 AS DOUBLE)))) > 0 AS found FROM w WHERE wanted IS NOT NULL""",
    "render_evidence": """
        WITH r AS (SELECT DISTINCT archive_id, path, passage_id, start_offset, text FROM snapshots WHERE path IS NOT NULL AND text IS NOT NULL),
             n AS (SELECT *, row_number() OVER (PARTITION BY archive_id, path ORDER BY start_offset NULLS FIRST, passage_id, text) AS k FROM r)
        SELECT archive_id, path, md5(string_agg('[S' || k || '] ' || text, chr(10) ORDER BY k)) AS evidence_md5, count(*) AS passages FROM n GROUP BY ALL""",
    "title_gate": r"""
        WITH n AS (SELECT DISTINCT lower(subject) AS name FROM lessons WHERE subject IS NOT NULL),
             t AS (SELECT DISTINCT lower(trim(regexp_replace(title, '[,(:].*$', ''))) AS name FROM documents WHERE title IS NOT NULL)
        SELECT name, name IN (SELECT name FROM t) AS known FROM n""",
    "message_lengths": f"SELECT subject, count(*) AS questions, CAST(sum(CAST(ceil(length(q) / 3.5) AS BIGINT)) AS BIGINT) AS tokens FROM {Q} GROUP BY subject",
}
