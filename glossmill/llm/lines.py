"""Problem 2: lines that come back in passage after passage of one archive.

A line is masked: numbers, dates, marks and spacing always, names on request. Each
masked line gets BANDS buckets by locality-sensitive hashing, every one of ROWS
MinHashes over its runs of letters. Buckets are counted within an archive, first by
lines, then by passages, and only lines of frequent buckets go on: they are the
clusters. In these a line is verified, either by its letters (`repeated_lines`:
lines repeat if all their letters agree) or by its similarity to the commonest line
of its bucket (`similar_lines`: near-duplicates that differ by a name or a typo).
Lines with the same letters have the same buckets, so the first loses none.

The text is read and hashed once, in one pass over Arrow batches; the shuffles
carry hashes. Counting is by (key, passage) before it is by key, and tables of
frequent keys are broadcast only up to BROADCAST_ROWS, beyond which the join is
salted by passage, so no archive, bucket or line, however frequent, makes a large
task.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.session import cut

#: Passages of an archive that must hold a line.
PASSAGES = 10
#: Letters of the runs that the MinHashes are over.
RUN = 8
#: Buckets of a line, and MinHashes that make one. Of two lines with 0.8 of their runs in common 97 % share a bucket.
BANDS, ROWS = 5, 3
#: Of a line's runs, those whose hash is divisible by this, and the least, go into the MinHashes; which ones depends on the runs only.
THINNED = 4
#: Share of common runs from which lines are near-duplicates.
SIMILAR = 0.8
#: Forms of a bucket that lead clusters in the first round; twice as many in each further one.
LEADERS = 16
#: A table of frequent keys is broadcast up to so many rows of about 50 bytes; beyond it the join is salted.
BROADCAST_ROWS, SALTS = 200_000, 32
#: Texts hashed at a time, so that the arrays stay in the processor's cache.
TEXTS = 100

_FORM = ["archive_id", "form", "form2"]
_BUCKET = ["archive_id", "bucket"]
#: Words after another; those that begin with a capital, but aren't all capitals, are taken for names.
_NAME = re.compile(r"(?<=\S )([^\W\d_][\w'’-]*)")
_ODD = [(0x9E3779B97F4A7C15 * (2 * n + 1) ^ (0xC2B2AE3D27D4EB4F << n)) & (1 << 64) - 1 | 1 for n in range(64)]


def _letters() -> np.ndarray:
    """Which code points are letters (category L; there are none above the third plane), made once a worker."""
    kept = sys.modules.setdefault("_glossmill_letters", type(sys)("_glossmill_letters"))
    if not hasattr(kept, "table"):
        table = np.zeros(0x110000, bool)
        table[:0x33480] = [unicodedata.category(chr(c))[0] == "L" for c in range(0x33480)]
        kept.table = table
    return kept.table


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def hash_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line number from 1, two hashes, BANDS buckets) of each line with a letter."""
    low = "\n".join(texts).lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    lines_of = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    text_of = np.repeat(np.arange(len(texts)), lines_of)
    number = np.arange(len(text_of)) - np.repeat(np.cumsum(lines_of) - lines_of, lines_of) + 1
    kept = _letters()[codes]
    line = np.cumsum(codes == 10)[kept]
    code = codes[kept].astype(np.uint64)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros((0, BANDS), np.int64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1])
    at = (np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))).astype(np.uint64)
    first = _mixed((code + (at << np.uint64(21))) * np.uint64(_ODD[0]))
    second = (first ^ (first >> np.uint64(32))) * np.uint64(_ODD[1])
    forms = np.stack([np.add.reduceat(first, starts), np.add.reduceat(second ^ (second >> np.uint64(29)), starts)], 1)
    runs = _mixed(code * np.uint64(_ODD[2]))
    step = 1
    while step < RUN:  # runs of 2, 4 and 8 letters, shorter at a line's end
        ahead = np.zeros_like(runs)
        np.multiply(runs[step:], line[step:] == line[:-step], out=ahead[: len(runs) - step])
        runs = runs * np.uint64(_ODD[3]) + ahead
        step *= 2
    runs = _mixed(runs)
    least = np.minimum.reduceat(runs, starts)
    some = (runs & np.uint64(THINNED - 1)) == 0
    some[np.flatnonzero(runs == np.repeat(least, np.diff(np.append(starts, len(code)))))] = True
    thin, of_thin = runs[some], line[some]
    begins = np.concatenate([[0], np.flatnonzero(np.diff(of_thin)) + 1])
    buckets = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        bucket = np.full(len(starts), band + 1, np.uint64)
        for row in range(ROWS):
            bucket = _mixed(bucket) + np.minimum.reduceat(thin * np.uint64(_ODD[4 + band * ROWS + row]), begins)
        buckets[:, band] = _mixed(bucket)
    of = line[starts]
    return text_of[of], number[of], forms.view(np.int64), buckets.view(np.int64)


def masked(text: str, names: bool) -> str:
    """The text's lines in lower case without all that isn't a letter, on request without names too."""
    if names:
        text = _NAME.sub(lambda m: "" if m.group(1)[0].isupper() and not m.group(1).isupper() else m.group(1), text)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes[_letters()[codes] | (codes == 10)].tobytes().decode("utf-32-le", "surrogatepass")


def hashed_lines(snapshots: DataFrame, *, names: bool = False) -> DataFrame:
    """(archive_id, passage_id, line_no, form, form2, buckets) of every line with a letter; with names masked also letters."""
    source = snapshots.filter("archive_id IS NOT NULL AND passage_id IS NOT NULL AND text IS NOT NULL")
    source = source.select(*(F.col(c).cast("string").alias(c) for c in ("archive_id", "passage_id", "text")))
    columns = ["archive_id", "passage_id", "line_no", "form", "form2", "buckets"] + ["letters"] * names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                part = batch.slice(first, TEXTS)
                texts = part.column(2).to_pylist()
                if names:
                    texts = [masked(t, True) for t in texts]
                text, number, forms, buckets = hash_lines(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1) * BANDS, pa.int32()), pa.array(buckets.ravel()))
                out = [part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), pa.array(number, pa.int32()), pa.array(forms[:, 0]), pa.array(forms[:, 1]), lists]
                if names:
                    split = [t.split("\n") for t in texts]
                    out.append(pa.array([split[t][n - 1] for t, n in zip(text.tolist(), number.tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, columns)

    schema = "archive_id string, passage_id string, line_no int, form long, form2 long, buckets array<long>"
    return source.mapInArrow(run, schema + ", letters string" * names)


def _within(rows: DataFrame, keys: DataFrame, on: list[str], salt: str = "passage_id") -> DataFrame:
    """rows with the columns of keys, where they are among these; salted if keys are too many to be broadcast."""
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on)
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.hash(salt), F.lit(SALTS))).join(salted, [*on, "salt"]).drop("salt")


def _held(rows: DataFrame, on: list[str], least: int) -> DataFrame:
    """(on, passages): the keys that occur in at least so many passages of their archive."""
    passages = rows.groupBy(*on, "passage_id").agg(F.lit(1).alias("one"))
    return passages.groupBy(*on).agg(F.count("*").alias("passages")).filter(F.col("passages") >= least)


def frequent_clusters(hashed: DataFrame, least: int) -> DataFrame:
    """The rows of hashed_lines(), once for each of their buckets (archive_id, bucket) that so many passages are in.

    Counts of lines, which are sums of map-side counts and never less than those of
    passages, choose the buckets whose passages are counted.
    """
    rows = hashed.withColumn("bucket", F.explode("buckets"))
    lines = rows.groupBy(*_BUCKET).agg(F.count("*").alias("lines")).filter(F.col("lines") >= least).drop("lines")
    some = cut(_within(rows if "letters" in hashed.columns else rows.drop("buckets"), cut(lines), _BUCKET))
    return _within(some, cut(_held(some, _BUCKET, least).drop("passages")), _BUCKET)


def repeated_lines(snapshots: DataFrame, *, least: int = PASSAGES) -> DataFrame:
    """(archive_id, passage_id, line_no, form, form2, passages): each place of a line that repeats in its archive.

    Lines are the same if their letters in lower case are. passages: how many passages
    of the archive hold the line. A passage counts once however often it was put or
    holds the line, and its places come out once. Null texts, archives and passages
    have no lines; lines without a letter never repeat. Columns other than archive_id,
    passage_id and text aren't read.
    """
    clusters = frequent_clusters(cut(hashed_lines(snapshots)), least)
    places = clusters.select("archive_id", "passage_id", "line_no", "form", "form2").distinct()
    return _within(places, cut(_held(places, _FORM, least)), _FORM)


def similar_lines(snapshots: DataFrame, *, least: int = PASSAGES, similar: float = SIMILAR) -> DataFrame:
    """(archive_id, passage_id, line_no, cluster, passages): each place of a line that near-duplicates of it make frequent.

    Numbers, dates, marks and names are masked. In each frequent bucket the LEADERS
    forms that most passages hold lead clusters; each form belongs to the first of
    them that it shares at least `similar` of its runs of letters with. The others are
    clustered again in the same bucket, by twice as many of the commonest of them each
    time, until no bucket has forms left that so many passages hold together: a leader
    belongs to its own cluster, so each round takes some, and no form is left out. A line in clusters of
    several buckets counts with the one that most passages hold. Nulls as in
    repeated_lines(). No pairs of lines are made, only pairs of a form and its bucket's.
    """
    rest = frequent_clusters(cut(hashed_lines(snapshots, names=True)), least)
    found, most = None, LEADERS
    while not (rest := cut(rest)).isEmpty():
        # by (bucket, form, passage), then by (bucket, form), then by bucket
        forms = rest.groupBy(*_BUCKET, "form", "form2", "passage_id").agg(F.first("letters").alias("letters"))
        forms = cut(forms.groupBy(*_BUCKET, "form", "form2").agg(F.count("*").alias("n"), F.min("letters").alias("letters")))
        place = F.row_number().over(Window.partitionBy(*_BUCKET).orderBy(F.desc("n"), "form", "form2"))
        leaders = forms.withColumn("place", place).filter(F.col("place") <= most)
        leaders = cut(leaders.select(*_BUCKET, "place", F.col("form").alias("cluster"), F.col("letters").alias("of")))
        pairs = _within(forms, leaders, _BUCKET, "form")
        alike = cut(_alike(pairs.select(*_BUCKET, "form", "form2", "cluster", "place", "letters", "of"), similar))
        keyed = _within(rest, alike, [*_BUCKET, "form", "form2"])
        held = _held(keyed, [*_BUCKET, "cluster"], least)
        part = cut(_within(keyed, cut(held), [*_BUCKET, "cluster"]).select("archive_id", "passage_id", "line_no", "cluster", "passages"))
        found = part if found is None else found.unionByName(part)
        left = rest.join(alike.drop("cluster"), [*_BUCKET, "form", "form2"], "left_anti")
        most *= 2
        rest = _within(left, cut(_held(left, _BUCKET, least).drop("passages")), _BUCKET)
    if found is None:
        return rest.select("archive_id", "passage_id", "line_no", F.col("form").alias("cluster"), F.lit(0).cast("long").alias("passages"))
    best = F.max_by(F.struct("cluster", "passages"), F.struct("passages", "cluster")).alias("c")
    return found.groupBy("archive_id", "passage_id", "line_no").agg(best).select("archive_id", "passage_id", "line_no", "c.*")


def _alike(pairs: DataFrame, similar: float) -> DataFrame:
    """(bucket, form, cluster): the first of the leaders of its bucket whose letters (of) have so large a share of runs in common with a form's."""

    def runs(text: str) -> set[str]:
        return {text[n : n + RUN] for n in range(max(1, len(text) - RUN + 1))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                a, b = (runs(one), runs(other)) if one != other else ({""}, {""})
                keep.append(len(a & b) >= similar * len(a | b))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1, 2, 3, 4, 5])

    found = pairs.mapInArrow(run, "archive_id string, bucket long, form long, form2 long, cluster long, place int")
    return found.groupBy(*_BUCKET, "form", "form2").agg(F.min_by("cluster", "place").alias("cluster"))


def without_lines(snapshots: DataFrame, found: DataFrame) -> DataFrame:
    """(passage_id, archive_id, created_at, text): each snapshot with its text less the lines found (archive_id, passage_id, line_no).

    Every row comes out, those put again too; null texts stay null, and a text of
    repeated lines only becomes empty.
    """
    dropped = found.groupBy("archive_id", "passage_id").agg(F.collect_set("line_no").alias("dropped"))
    kept = F.filter(F.split("text", "\n", -1), lambda line, at: ~F.array_contains("dropped", at + 1))
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return snapshots.join(dropped, ["archive_id", "passage_id"], "left").select("passage_id", "archive_id", "created_at", text.alias("text"))


def without_repeated(snapshots: DataFrame, *, least: int = PASSAGES) -> DataFrame:
    """without_lines() of repeated_lines()."""
    return without_lines(snapshots, repeated_lines(snapshots, least=least))
