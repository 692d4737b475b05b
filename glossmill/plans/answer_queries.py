"""Queries of corrections, attribution and the whole research pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmill.functions import sql
from glossmill.functions import text as t
from glossmill.operators import attribution, correct, index
from glossmill.plans import rank_queries, research as pipeline
from glossmill.plans.text_queries import answers, documents, questions
from glossmill.session import cut
from glossmill.sources.tables import table

#: How frequent the halves of a compound must be here.
HALF_DF = 20


def _vocabulary(spark, folder):
    return rank_queries.doc_freq(spark, folder)


def title_suggest(spark, folder):
    """Titles that begin like a question term or like that term less up to four letters, by the longest beginning."""
    asked = index.exploded(questions(spark, folder), terms=t.tokens("q")).distinct().filter(F.length("term") >= 4)
    heads = asked.select("term", F.explode(F.sequence(F.greatest(F.length("term") - 4, F.lit(3)), F.length("term"))).alias("n"))
    heads = heads.select("term", "n", F.expr("substring(term, 1, n)").alias("head"))
    titles = index.exploded(documents(spark, folder).filter("title IS NOT NULL"), terms=t.tokens("title"), name="word").distinct()
    prefixes = titles.select("word", F.explode(F.sequence(F.lit(3), F.greatest(F.length("word"), F.lit(3)))).alias("n")).select("word", F.expr("substring(word, 1, n)").alias("head")).distinct()
    found = heads.join(prefixes, "head").groupBy("term", "word").agg(F.max("n").alias("n"))
    return found.groupBy("term").agg(F.max_by("word", F.struct("n", "word")).alias("word"), F.max("n").alias("letters"))


def spell_correct(spark, folder):
    asked = index.exploded(questions(spark, folder), terms=t.tokens("q")).distinct()
    vocabulary = _vocabulary(spark, folder)
    return correct.spelling(asked.join(vocabulary, "term", "left_anti"), vocabulary)


def compound_split(spark, folder):
    """Neighbouring words of titles written as one, split again."""
    titles = documents(spark, folder).select(t.tokens("title").alias("w")).filter(F.size("w") > 1)
    fused = titles.select(F.explode(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, b))).alias("term")).distinct()
    vocabulary = _vocabulary(spark, folder)
    listed = documents(spark, folder).select("doc_id", t.tokens("text").alias("w")).filter(F.size("w") > 1)
    pairs = F.array_distinct(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b)))
    phrases = listed.select(F.explode(pairs).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("df"))
    return correct.compounds(fused.join(vocabulary, "term", "left_anti"), vocabulary, phrases, least=HALF_DF)


def morph_variants(spark, folder):
    words = _vocabulary(spark, folder).filter("term RLIKE '^[a-z]+$'")
    return words.select("term", F.array_join(correct.word_forms(F.col("term")), " ").alias("forms"))


def morph_expand(spark, folder):
    """Forms of question terms that the documents have three times or more, and the most frequent of them."""
    asked = index.exploded(questions(spark, folder), terms=t.tokens("q")).distinct().filter("term RLIKE '^[a-z]+$'")
    forms = asked.select("term", F.explode(correct.word_forms(F.col("term"))).alias("form"))
    held = forms.join(_vocabulary(spark, folder).select(F.col("term").alias("form"), "df"), "form").filter(F.col("df") >= correct.LEAST_DF)
    return held.groupBy("term").agg(F.array_join(F.array_sort(F.collect_list("form")), " ").alias("forms"), F.max_by("form", F.struct("df", "form")).alias("best"))


def _evidence(spark, folder):
    """The five best documents of each question, as the passages its answer may rest on."""
    docs = documents(spark, folder).select("doc_id", "text")
    return index.with_texts(cut(rank_queries.bm25_topk(spark, folder)), docs, key="doc_id").select("turn_id", "doc_id", "text")


def _sentences(spark, folder):
    asked = answers(spark, folder).filter(F.col("turn_id") % 50 == 0)
    return attribution.sentence_terms(asked, key="turn_id", text="a")


def attribute_best(spark, folder):
    return attribution.best_passages(_sentences(spark, folder), _evidence(spark, folder), key="turn_id", passage="doc_id", text="text")


def is_supported(spark, folder):
    return attribution.supported_figures(_sentences(spark, folder), _evidence(spark, folder), key="turn_id", text="text")


def sentence_support(spark, folder):
    """Whether the evidence supports each sentence: enough shared terms, and every figure and name; is_supported is the part on figures that its SQL states."""
    return attribution.supported(_sentences(spark, folder), _evidence(spark, folder), key="turn_id", passage="doc_id", text="text")


def dump_detect(spark, folder):
    """Dumps of evidence. The packets of all turns whose answers have labels enough for the second sign are searched again, as no table holds them."""
    said = answers(spark, folder)
    labelled = said.filter(F.size(t.labels("a")) >= attribution.COPIES).select("turn_id").distinct()
    packets = rank_queries.packets(spark, folder, questions(spark, folder).join(labelled, "turn_id", "left_semi"))
    found = attribution.dumps(said, packets, key="turn_id", text="a", label="label", passage="text")
    return found.select("turn_id", "most_labels", "long", "dump")


def research(spark, folder):
    asked = questions(spark, folder).filter(F.col("turn_id") % 50 == 0)
    docs = documents(spark, folder)
    return pipeline.research(asked, docs, query="turn_id", text="q", key="doc_id", group="source")


QUERIES = {f.__name__: f for f in (
    title_suggest, spell_correct, compound_split, morph_variants, morph_expand, attribute_best, is_supported, sentence_support, dump_detect, research,
)}

_SPLIT = r"list_filter(regexp_split_to_array(regexp_replace(a, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda s: regexp_matches(s, '[^\s\x{00A0}\x{200B}\x{3000}]'))"
_S = rf"""
        an AS (SELECT DISTINCT turn_id, answer_text AS a FROM turn_records WHERE answer_text IS NOT NULL AND turn_id % 50 = 0),
        un AS (SELECT turn_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS no, trim(unnest(x), ' ') AS s, unnest(x) AS raw FROM (SELECT turn_id, {_SPLIT} AS x FROM an)),
        se AS (SELECT turn_id, no, raw, list_distinct({sql.tokens('raw')}) AS terms FROM un WHERE NOT (s = '' OR s LIKE '%?' OR (s LIKE '%!' AND len(regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+')) <= 4)
               OR regexp_matches(s, '^\d+[.)]\s*$') OR (regexp_matches(s, '^(\[[^\[\]]*\]\s*)+$') AND NOT regexp_matches(s, 'S\d+'))) AND len({sql.tokens('raw')}) > 0),
        ev AS (SELECT turn_id, doc_id, text FROM pool JOIN documents USING (doc_id) WHERE rank <= 5)"""
_VOCABULARY = f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({sql.tokens('text')})) AS term FROM documents) GROUP BY term"

SQL = {
    "title_suggest": f"""
        WITH a AS (SELECT DISTINCT term FROM (SELECT unnest({sql.tokens('input_text')}) AS term FROM turn_records WHERE trim(input_text) <> '') WHERE length(term) >= 4),
             w AS (SELECT DISTINCT unnest({sql.tokens('title')}) AS word FROM documents),
             h AS (SELECT term, n, left(term, n) AS head FROM (SELECT term, unnest(range(greatest(length(term) - 4, 3), length(term) + 1)) AS n FROM a)),
             p AS (SELECT DISTINCT word, left(word, n) AS head FROM (SELECT word, unnest(range(3, greatest(length(word), 3) + 1)) AS n FROM w)),
             f AS (SELECT term, word, max(n) AS n FROM h JOIN p USING (head) GROUP BY ALL)
        SELECT term, arg_max(word, (n, word)) AS word, CAST(max(n) AS INTEGER) AS letters FROM f GROUP BY term""",
    "compound_split": f"""
        WITH v AS ({_VOCABULARY}), d AS (SELECT {sql.tokens('text')} AS w FROM documents),
             ph AS (SELECT phrase, count(*) AS df FROM (SELECT unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS phrase FROM d WHERE len(w) > 1) GROUP BY phrase),
             c AS (SELECT term, i, left(term, i) AS l, substring(term, i + 1) AS r FROM (SELECT term, unnest(range(4, length(term) - 3)) AS i FROM (SELECT DISTINCT w[i] || w[i + 1] AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {sql.tokens('title')} AS w FROM documents) WHERE len(w) > 1))
                   WHERE term NOT IN (SELECT term FROM v) AND length(term) >= 8)),
             b AS (SELECT c.term, i, l || ' ' || r AS halves FROM c JOIN v x ON x.term = l AND x.df >= {HALF_DF} JOIN v y ON y.term = r AND y.df >= {HALF_DF}),
             k AS (SELECT b.*, coalesce(df, 0) AS phrase_df, row_number() OVER (PARTITION BY term ORDER BY coalesce(df, 0) DESC, i) AS place FROM b LEFT JOIN ph ON phrase = halves)
        SELECT term, halves, phrase_df FROM k WHERE place = 1""",
    "attribute_best": f"""{rank_queries._POOL}, {_S},
        t AS (SELECT turn_id, no, len(terms) AS own, unnest(terms) AS term FROM se), h AS (SELECT turn_id, doc_id, unnest(list_distinct({sql.tokens('text')})) AS term FROM ev),
        o AS (SELECT turn_id, no, doc_id, own, count(*) AS shared FROM t JOIN h USING (turn_id, term) GROUP BY ALL HAVING count(*) >= 2 OR count(*) >= CAST(0.3 AS DOUBLE) * own),
        b AS (SELECT *, row_number() OVER (PARTITION BY turn_id, no ORDER BY shared DESC, doc_id) AS place FROM o)
        SELECT se.turn_id, se.no, doc_id, shared FROM se LEFT JOIN (SELECT * FROM b WHERE place = 1) b ON b.turn_id = se.turn_id AND b.no = se.no""",
    "is_supported": rf"""{rank_queries._POOL}, {_S},
        f AS (SELECT turn_id, no, list_distinct(regexp_extract_all(replace(regexp_replace(regexp_replace(raw, '\[(S\d+(?:\s*,\s*S\d+)*)\]', '', 'g'), '^\s*\d+[.)](\s+|$)', ''), '−', '-'), '-?\d+(?:\.\d+)?')) AS fs FROM se),
        h AS (SELECT turn_id, list_distinct(flatten(list(regexp_extract_all(replace(text, '−', '-'), '-?\d+(?:\.\d+)?')))) AS held FROM ev GROUP BY turn_id)
        SELECT turn_id, no, CAST(len(fs) AS BIGINT) AS figures, CAST(len(list_filter(fs, lambda x: NOT list_contains(coalesce(held, []), x))) AS BIGINT) AS missing FROM f LEFT JOIN h USING (turn_id)""",
    "dump_detect": rf"""
        WITH p AS (SELECT turn_id, len(list_filter(regexp_split_to_array(a, '\s+'), lambda w: w <> '')) AS words, unnest({_SPLIT}) AS s FROM (SELECT DISTINCT turn_id, answer_text AS a FROM turn_records WHERE answer_text IS NOT NULL)),
             l AS (SELECT turn_id, words, len(list_distinct(regexp_extract_all(array_to_string(regexp_extract_all(s, '\[(S\d+(?:\s*,\s*S\d+)*)\]', 1), ','), 'S\d+'))) AS n FROM p)
        SELECT turn_id, CAST(max(n) AS INTEGER) AS most_labels, max(words) >= 60 AS long, max(words) >= 60 AND max(n) >= 4 AS dump FROM l GROUP BY turn_id""",
}
