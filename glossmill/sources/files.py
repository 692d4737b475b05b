"""Readers of files that aren't Parquet: question sets, registries, catalogues, event frames, half-float vectors."""

from __future__ import annotations

import tomllib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUESTION = "id string, question string, expected_paths array<string>, category string, split string, context string"
_ARCHIVE = "id string, path string, tier int, kind string, subjects array<string>, storage string, weight double, searchable boolean"
TIERS, KINDS, STORAGES = {1, 2, 3}, {"encyclopedia", "textbook", "qa", "howto", "viewer_only"}, {"ssd", "hdd"}
REGISTRY_MAX = 100_000


def questions(spark: SparkSession, path: str, *, allowed: list[str] | None = None) -> DataFrame:
    """JSON lines of questions; no expected path means unanswerable. allowed: only questions that expect one of these paths."""
    rows = spark.read.schema(_QUESTION).json(path).filter("id IS NOT NULL")
    rows = rows.withColumns({"expected_paths": F.coalesce("expected_paths", F.array().cast("array<string>")), "category": F.coalesce("category", F.lit("direct")), "split": F.coalesce("split", F.lit("tuning"))})
    return rows.filter(F.arrays_overlap("expected_paths", F.array(*map(F.lit, allowed)))) if allowed else rows


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The [[archive]] tables of a TOML file, a short list; missing keys, unknown values and ids that occur twice are errors."""
    with open(path, "rb") as f:
        entries = tomllib.load(f).get("archive", [])
    if len(entries) > REGISTRY_MAX:
        raise ValueError(f"more than {REGISTRY_MAX} archives")
    rows, seen = [], set()
    for e in entries:
        missing = {"id", "path", "tier", "kind", "storage"} - e.keys()
        if missing or e["tier"] not in TIERS or e["kind"] not in KINDS or e["storage"] not in STORAGES or e["id"] in seen:
            raise ValueError(f"archive {e.get('id')}: {sorted(missing) or 'a bad value, or its id twice'}")
        seen.add(e["id"])
        rows.append((e["id"], e["path"], e["tier"], e["kind"], e.get("subjects", []), e["storage"], float(e.get("weight", 1.0)), bool(e.get("searchable", True))))
    return spark.createDataFrame(rows, _ARCHIVE)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(name, flavour, href, length, fbase, fdate) of the entries of an Atom catalogue: the first acquisition link, lengths of digits only."""
    link = "array<struct<_rel:string,_href:string,_length:string>>"
    entries = spark.read.format("xml").option("rowTag", "entry").schema(f"name string, flavour string, link {link}").load(path)
    first = F.get(F.filter("link", lambda x: x["_rel"].contains("acquisition")), F.lit(0))
    rows = entries.select("name", F.coalesce("flavour", F.lit("")).alias("flavour"), first["_href"].alias("href"), first["_length"].alias("n")).filter("href IS NOT NULL")
    file = r"([^/]+)_(\d{4}-\d{2}[a-z]?)\.zim"
    return rows.select("name", "flavour", "href", F.when(F.col("n").rlike("^[0-9]+$"), F.col("n").cast("long")).alias("length"), F.regexp_extract("href", file, 1).alias("fbase"), F.regexp_extract("href", file, 2).alias("fdate"))


def wanted(spark: SparkSession, path: str) -> DataFrame:
    """The names of a text list, without blank lines and those that begin with #."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> '' AND name NOT LIKE '#%'")


def event_frames(frames: DataFrame, *, stream: str = "stream", order: str = "no", line: str = "line") -> DataFrame:
    """(stream, no, event, data) from the lines of event streams: a data line is of the event named last before it."""
    name = F.last(F.when(F.col(line).startswith("event: "), F.substring(line, 8, 1 << 20)), ignorenulls=True).over(Window.partitionBy(stream).orderBy(order))
    named = frames.withColumn("event", name).filter(F.col(line).startswith("data: "))
    return named.select(stream, order, "event", F.substring(line, 7, 1 << 30).alias("data"))


def half_float_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(row_no, vector) of a flat file of little-endian half floats, split by Spark into records; a torn last record is an error."""
    records = spark.sparkContext.binaryRecords(path, 2 * dim).zipWithIndex()
    return spark.createDataFrame(records.map(lambda r: (r[1], np.frombuffer(r[0], "<f2").astype(float).tolist())), "row_no long, vector array<float>")
