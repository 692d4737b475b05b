"""The queries of the seven problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import lines, neighbours, packing, pairs, pieces, residue, tokens
from glossmill.session import shared_folder
from glossmill.sources.tables import table


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "dense_vectors", "vec_id", "manifest_id", "row_no", "vec")
    manifests = table(spark, folder, "dense_manifests", "manifest_id", "embedding_model_sha256", "dim")
    return neighbours.usable_vectors(vectors, manifests)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neighbours.nearest(_vectors(spark, folder)).select("vec_id", F.inline("near")).filter(F.col("far") <= -0.97)
    return pairs.select(F.least("vec_id", "id").alias("vec_id_a"), F.greatest("vec_id", "id").alias("vec_id_b")).distinct()


def p1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbours.nearest(_vectors(spark, folder)).select("vec_id", F.posexplode("near").alias("place", "n"))
    return near.select("vec_id", (F.col("place") + 1).alias("place"), F.col("n.id").alias("other"), F.round(-F.col("n.far"), 6).alias("cosine"))


def p1_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The most similar vectors of those whose id is divisible by 50, against all, by comparing them all."""
    near = neighbours.exact_nearest(_vectors(spark, folder)).select("vec_id", F.posexplode("near").alias("place", "n"))
    return near.select("vec_id", (F.col("place") + 1).alias("place"), F.col("n.id").alias("other"), F.round(-F.col("n.far"), 4).alias("cosine"))


def p1_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the exact most similar vectors of that query set which the curves find, by model."""
    vectors = _vectors(spark, folder)
    exact = neighbours.exact_nearest(vectors).select("model", "vec_id", F.col("near").alias("exact"))
    both = exact.join(neighbours.nearest(vectors), ["model", "vec_id"])
    least = F.element_at("exact", -1)["far"] + 1e-9  # equally similar ones are as good
    hits = F.size(F.filter("near", lambda x: x["far"] <= least))
    return both.groupBy("model").agg(F.count("*").alias("queries"), F.round(F.sum(F.least(hits, F.size("exact"))) / F.sum(F.size("exact")), 4).alias("recall"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return lines.repeated_lines(table(spark, folder, "snapshots", "archive_id", "passage_id", "text")).select("passage_id", "line_no")


def p2_near(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that near-duplicates of them, with numbers, dates and names masked, make frequent in their archive."""
    return lines.similar_lines(table(spark, folder, "snapshots", "archive_id", "passage_id", "text")).select("passage_id", "line_no")


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    snapshots = table(spark, folder, "snapshots", "archive_id", "passage_id", "text", "created_at")
    return lines.without_repeated(snapshots).select("passage_id", "created_at", "text")


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "turn_records", "turn_id", "input_text", "answer_text", "logged_at")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defects(_turns(spark, folder))


def p3_shortened(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that begin a longer answer, by their hash, with the length of both texts' common part."""
    answers = _turns(spark, folder).filter("answer_text <> ''").select(F.col("answer_text").alias("answer")).distinct()
    return pairs.next_longer(answers).select(F.md5("answer").alias("answer_key"), F.length("answer").cast("long").alias("n_chars"))


def _piece(spark: SparkSession, folder: str) -> tuple[int, int]:
    return pieces.size_of(table(spark, folder, "size_specs"))


def _split(spark: SparkSession, folder: str, with_text: bool) -> DataFrame:
    limit, overlap = _piece(spark, folder)
    snapshots = table(spark, folder, "snapshots", "passage_id", "archive_id", "path", "start_offset", "end_offset", "text", "created_at")
    sections = table(spark, folder, "sections", "archive_id", "path", "end_offset")
    return pieces.split_snapshots(snapshots, sections, limit=limit, overlap=overlap, with_text=with_text)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    limit, _ = _piece(spark, folder)
    runs = pieces.longest_runs(_split(spark, folder, with_text=False)).filter("item.passage_id IS NOT NULL")
    return runs.select("item.passage_id", F.when(F.col("longest_run") > limit, "hard").otherwise("soft").alias("cut"))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.pieces_of(_split(spark, folder, with_text=True)).select("item.*", "piece_no", "start", "end", "boundary", "text")


def p4_files(spark: SparkSession, folder: str) -> DataFrame:
    """All texts of an archive as files in the shared folder, cut by ranges of bytes: characters, those that the pieces cover, and pieces over the limit."""
    limit, overlap = _piece(spark, folder)
    snapshots = table(spark, folder, "snapshots", "archive_id", "text").select(F.coalesce("archive_id", F.lit("")).alias("archive_id"), "text")
    paths = pieces.write_files(snapshots, f"{shared_folder(spark)}/pieces-{uuid4().hex}", by="archive_id", text="text")
    split = pieces.split_ranges(pieces.file_ranges(spark, paths, limit=limit, overlap=overlap), limit=limit, overlap=overlap, with_text=False)
    archive = F.url_decode(F.replace(F.regexp_extract("item", "/archive_id=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    own = F.aggregate(F.transform("pieces", lambda p: p["end"] - p["start"]), F.lit(0).cast("long"), lambda a, b: a + b)
    files = split.groupBy("item").agg(
        F.sum("own").alias("n_chars"),
        (F.sum(own) - overlap * (F.sum(F.size("pieces")) - 1)).alias("covered"),
        F.sum(F.size(F.filter("pieces", lambda p: p["end"] - p["start"] > limit))).alias("too_long"),
    )
    found = files.groupBy(F.when(archive != "__HIVE_DEFAULT_PARTITION__", archive).alias("archive_id"))
    return found.agg(*(F.sum(c).alias(c) for c in ("n_chars", "covered", "too_long")))


def p5_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents", "doc_id", "text"))


def p5_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every text after encoding and decoding, as its hash and length."""
    ids = tokens.encode(table(spark, folder, "documents", "doc_id", "text"))
    back = tokens.decode(ids)
    return back.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = tokens.count_tokens(table(spark, folder, "documents", "doc_id", "text"))
    return packing.pack(sizes, packing.capacities_of(table(spark, folder, "size_specs")))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return (
        p6_containers(spark, folder)
        .groupBy("capacity", "container")
        .agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("pieces"))
        .groupBy("capacity")
        .agg(
            F.count("*").alias("containers"),
            F.sum("pieces").alias("pieces"),
            F.sum("fill").alias("tokens"),
            F.max("fill").alias("fullest"),
            F.round(F.sum("fill") / (F.count("*") * F.first("capacity")), 6).alias("fill_share"),
        )
    )


def p6_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """For each capacity the documents that are packed, containers over it, and documents divided although they would fit."""
    pieces = p6_containers(spark, folder)
    over = pieces.groupBy("capacity", "container").agg(F.sum("n_tokens").alias("fill")).groupBy("capacity").agg(F.count_if(F.col("fill") > F.col("capacity")).alias("overfull"))
    whole = pieces.groupBy("capacity", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    divided = whole.groupBy("capacity").agg(F.count("*").alias("docs"), F.count_if((F.col("n") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("divided"))
    return divided.join(over, "capacity").select("capacity", "docs", "overfull", "divided")


def p7_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_kind(table(spark, folder, "documents", "doc_id", "text")).filter("kind IS NOT NULL")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_kinds(spark, folder).select("doc_id")


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of the documents, a language."""
    documents = table(spark, folder, "documents", "doc_id", "text", "lang")
    kept = documents.join(residue.residue_kind(documents).filter("kind IS NULL").select("doc_id"), "doc_id", "left_semi")
    return kept.groupBy(F.lower(F.substring_index("lang", "-", 1)).alias("lang")).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_nearest": p1_nearest,
    "p1_exact": p1_exact,
    "p1_recall": p1_recall,
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p2_near": p2_near,
    "p3_found": p3_found,
    "p3_shortened": p3_shortened,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_files": p4_files,
    "p5_ids": p5_ids,
    "p5_round_trip": p5_round_trip,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_invariants": p6_invariants,
    "p7_found": p7_found,
    "p7_kinds": p7_kinds,
    "p7_kept": p7_kept,
}

_LINES = r"""
        l AS (SELECT archive_id, passage_id, created_at, text, u.nr AS nr, u.line AS line,
                     regexp_replace(lower(u.line), '[^\p{L}]', '', 'g') AS letters
              FROM snapshots, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line,
                                              unnest(range(1, len(string_split(text, chr(10))) + 1)) AS nr) u),
        f AS (SELECT archive_id, letters FROM l WHERE letters <> '' AND archive_id IS NOT NULL AND passage_id IS NOT NULL
              GROUP BY ALL HAVING count(DISTINCT passage_id) >= 10)"""

_USABLE = """
        m AS (SELECT DISTINCT manifest_id, embedding_model_sha256 AS model, dim FROM dense_manifests WHERE embedding_model_sha256 IS NOT NULL),
        u AS (SELECT model, vec_id, CAST(arg_min(vec, row_no) AS DOUBLE[]) AS v FROM dense_vectors JOIN m USING (manifest_id)
              WHERE len(vec) = dim AND len(list_filter(vec, lambda x: NOT isfinite(x) OR x IS NULL)) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0
              GROUP BY ALL)"""

SQL: dict[str, str] = {
    "p1_found": f"""
        WITH {_USABLE},
             c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.model = b.model AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id),
             r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS place FROM c)
        SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE place <= 10 AND s >= 0.97""",
    "p1_exact": f"""
        WITH {_USABLE},
             c AS (SELECT a.vec_id, list_cosine_similarity(a.v, b.v) AS s, b.vec_id AS o
                   FROM u a JOIN u b ON a.model = b.model AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
        SELECT vec_id, CAST(place AS INTEGER) AS place, o AS other, round(s, 4) AS cosine
        FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, o) AS place FROM c) WHERE place <= 10""",
    "p2_found": f"""
        WITH {_LINES}
        SELECT DISTINCT passage_id, CAST(nr AS INTEGER) AS line_no FROM l SEMI JOIN f USING (archive_id, letters) WHERE passage_id IS NOT NULL""",
    "p2_clean": f"""
        WITH {_LINES},
             g AS (SELECT archive_id, passage_id, list(DISTINCT nr) AS dropped FROM l SEMI JOIN f USING (archive_id, letters) GROUP BY ALL)
        SELECT s.passage_id, s.created_at,
               CASE WHEN g.dropped IS NULL THEN s.text ELSE array_to_string(list_filter(string_split(s.text, chr(10)),
                    lambda x, i: NOT list_contains(g.dropped, i)), chr(10)) END AS text
        FROM snapshots s LEFT JOIN g USING (archive_id, passage_id)""",
    "p3_shortened": """
        WITH a AS (SELECT DISTINCT answer_text AS t FROM turn_records WHERE answer_text <> ''),
             n AS (SELECT t, lead(t) OVER (ORDER BY encode(t)) AS next FROM a)
        SELECT md5(t) AS answer_key, CAST(length(t) AS BIGINT) AS n_chars FROM n WHERE starts_with(next, t)""",
    "p4_found": r"""
        SELECT passage_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[ \t\r\n.!?。！？]'), lambda x: length(x))) > 1200
                                THEN 'hard' ELSE 'soft' END AS cut
        FROM (SELECT passage_id, arg_max(text, (created_at, text)) AS text FROM snapshots
              WHERE length(text) > 1200 AND passage_id IS NOT NULL GROUP BY passage_id)""",
    "p4_files": """
        SELECT archive_id, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars, CAST(sum(length(text) + 1) AS BIGINT) AS covered, CAST(0 AS BIGINT) AS too_long
        FROM snapshots WHERE text IS NOT NULL GROUP BY archive_id""",
    "p6_invariants": """
        SELECT DISTINCT capacity, (SELECT count(*) FROM documents) AS docs, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS divided
        FROM size_specs WHERE used_for = 'container'""",
    "p5_round_trip": """
        SELECT doc_id, md5(coalesce(text, '')) AS text_md5, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars
        FROM documents""",
}
