"""Problem 4: cutting oversized texts into overlapping pieces at natural boundaries.

A text is never handled whole. It becomes ranges of RANGE characters with a halo,
each its own row, and a task sees one range: it finds the boundaries in it, and in
the halo before it the place where the range before ended its last piece, which is
a function of the last `limit` characters before the range and so comes out the
same in both tasks. Between these two places the task lays its pieces and emits
them by offset. What goes over ranges is stitched from small tables: characters
before a range (a prefix sum of lengths, for files cut by bytes), pieces before a
range, and the longest run without a place to cut.

Boundaries, best first: section, paragraph (a line end), sentence, word; where a
window has none of them the cut is hard, at the limit. The text's sections come as
offsets; one that doesn't touch a break in the text is ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters (of files: bytes) of a range.
RANGE = 1 << 16
#: How far back a boundary looks for the end of the sentence before it.
LOOK_BACK = 64
AFTER = 4
BOUNDARIES = ("hard", "word", "sentence", "paragraph", "section")

# White space at which a text may be cut, ends of sentences, closing marks behind them.
CUT_SPACE = " \t\r\n"
ENDS = ".!?。！？"
WIDE_ENDS = "。！？"
CLOSERS = "\"'”’»)]*_"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _one_of(codes: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(codes, [ord(c) for c in chars])


def boundaries(codes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a cut there is before that character) and their kinds (places in BOUNDARIES), in order."""
    n = len(codes)
    kind = np.zeros(n + 1, np.int8)
    space = _one_of(codes, CUT_SPACE)
    at = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    index = np.arange(n)
    solid = np.maximum.accumulate(np.where(space, -1, index)) if n else index
    begins = np.maximum(solid[at - 1] + 1, at - LOOK_BACK)
    feeds = np.concatenate([[0], np.cumsum(codes == 10)])
    kind[at] = 1
    last = begins - 1
    closing, ending = _one_of(codes, CLOSERS), _one_of(codes, ENDS)
    for _ in range(3):
        last = np.where((last >= 0) & closing[np.maximum(last, 0)], last - 1, last)
    kind[at[(last >= 0) & ending[np.maximum(last, 0)]]] = 2
    wide = _one_of(codes, WIDE_ENDS)
    cjk = np.flatnonzero(wide[:-1] & ~(ending | closing | space)[1:]) + 1
    kind[cjk] = np.maximum(kind[cjk], 2)
    kind[at[feeds[at] > feeds[begins]]] = 3
    marks = marks[(marks > 0) & (marks < n)]
    breaks = space | ending
    kind[marks[breaks[marks - 1] | breaks[marks]]] = 4
    positions = np.flatnonzero(kind)
    return positions, kind[positions]


def _best(positions: np.ndarray, kinds: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
    """The last of the best boundaries with low <= position <= high."""
    a, b = np.searchsorted(positions, [low, high + 1])
    if a >= b:
        return None
    k = b - 1 - int(kinds[a:b][::-1].argmax())
    return int(positions[k]), int(kinds[k])


def range_end(positions: np.ndarray, kinds: np.ndarray, end: int, limit: int) -> tuple[int, int]:
    """Where the range that ends at `end` ends its last piece; it looks at the last `limit` characters only."""
    return _best(positions, kinds, end - limit // 2, end) or _best(positions, kinds, end - limit + 1, end) or (end, 0)


def lay(positions: np.ndarray, kinds: np.ndarray, start: int, stop: tuple[int, int], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, kind of its end) of the pieces from start to stop."""
    pieces = []
    while stop[0] - start > limit:
        end = (
            _best(positions, kinds, start + max(limit // 2, overlap + 1), start + limit)
            or _best(positions, kinds, start + overlap + 1, start + limit)
            or (start + limit, 0)
        )
        pieces.append((start, *end))
        start = end[0] - overlap
    pieces.append((start, *stop))
    return pieces


def text_ranges(df: DataFrame, *, item: str, text: str, marks: str | None, limit: int, overlap: int) -> DataFrame:
    """The ranges of each text longer than limit: (item, range_no, base, own, left, chunk, marks, final).

    A text is gone through once, its ranges leave one after the other.
    """
    before = limit + overlap + LOOK_BACK + 2
    found = F.col(marks) if marks else F.array().cast("array<long>")
    chosen = df.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"), found.alias("marks")).filter(F.length("text") > limit)
    names = ["item", "range_no", "base", "own", "left", "chunk", "marks", "final"]
    types = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def batch_of(items: pa.Array) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rest = [pa.array(c, t) for c, t in zip(columns[1:], types[1:], strict=True)]
            return pa.RecordBatch.from_arrays([items.take(pa.array(columns[0])), *rest], names)

        for batch in batches:
            for n in range(batch.num_rows):
                whole, at = batch.column(1)[n].as_py(), np.sort(np.asarray(batch.column(2)[n].as_py() or [], np.int64))
                for number, base in enumerate(range(0, len(whole), RANGE)):
                    left = min(base, before)
                    near = at[np.searchsorted(at, base - left) : np.searchsorted(at, base + RANGE, "right")] - base + left
                    chunk = whole[base - left : base + RANGE + AFTER]
                    rows.append((n, number, base, min(len(whole) - base, RANGE), left, chunk, near.tolist(), base + RANGE >= len(whole)))
                    size += len(chunk)
                    if size > 16 * RANGE:
                        yield batch_of(batch.column(0))
                        rows, size = [], 0
            if rows:
                yield batch_of(batch.column(0))
                rows, size = [], 0

    kind = chosen.schema["item"].dataType.simpleString()
    return chosen.mapInArrow(run, f"item {kind}, range_no long, base long, own long, left long, chunk string, marks array<long>, final boolean")


def file_ranges(spark: SparkSession, paths: list[str], *, limit: int, overlap: int, size: int = RANGE) -> DataFrame:
    """As text_ranges(), of UTF-8 files in a folder that all workers share; each task reads its bytes only.

    A range holds the characters that begin in its bytes. Characters before it are
    counted by a prefix sum over the ranges of the file. Bytes that aren't UTF-8
    become U+FFFD; a byte order mark is a character like others. A file may be of any
    size, the driver asks only for its length. An empty file has no range.
    """
    sizes = [(p, os.path.getsize(p)) for p in paths]
    schema = "item string, length long"
    before = 4 * (limit + overlap + LOOK_BACK + 2)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for item, number, length in zip(pdf["item"], pdf["range_no"], pdf["length"], strict=True):
                start, stop = number * size, min((number + 1) * size, length)
                low, high = max(0, start - before), min(length, stop + 4 * AFTER)
                with open(item, "rb") as f:
                    f.seek(low)
                    data = f.read(high - low)
                a, b = _begin(data, start - low), _begin(data, stop - low)
                head = data[_begin(data, 0) if low else 0 : a].decode("utf-8", "replace")
                own = data[a:b].decode("utf-8", "replace")
                tail = data[b:].decode("utf-8", "replace")[:AFTER]
                rows.append((item, number, len(own), len(head), head + own + tail, stop >= length))
            yield pd.DataFrame(rows, columns=["item", "range_no", "own", "left", "chunk", "final"])

    ranges = (
        spark.createDataFrame(sizes, schema)
        .filter("length > 0")
        .withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / size) - 1)))
        .repartition(F.col("item"), F.col("range_no"))
        .mapInPandas(run, "item string, range_no long, own long, left long, chunk string, final boolean")
    )
    earlier = Window.partitionBy("item").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("base", F.coalesce(F.sum("own").over(earlier), F.lit(0))).withColumn("marks", F.array().cast("array<long>"))


def _begin(data: bytes, at: int) -> int:
    """The first place from `at` on where a character begins."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


_RANGE_ROW = (
    "item {}, range_no long, own long, head long, tail long, longest long, "
    "pieces array<struct<start:long,end:long,boundary:string,text:string>>"
)


def split_ranges(ranges: DataFrame, *, limit: int, overlap: int, with_text: bool = True) -> DataFrame:
    """For each range the pieces that it emits, and its runs without a break (head, tail, longest)."""
    if not 0 <= overlap < limit // 2 or limit + overlap + LOOK_BACK + 2 > RANGE:
        raise ValueError("overlap must be under half the limit, and both far under RANGE")
    item_type = ranges.schema["item"].dataType
    schema = _RANGE_ROW.format(item_type.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("boundary", pa.string()), ("text", pa.string())]))
        for batch in batches:
            base, own, left, final = (batch.column(n).to_pylist() for n in ("base", "own", "left", "final"))
            runs, pieces = [], []
            for k, (chunk, marks) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("marks").to_pylist(), strict=True)):
                codes = _codes(chunk)
                begin, end = left[k], left[k] + own[k]
                positions, kinds = boundaries(codes, np.asarray(marks, np.int64))
                start = range_end(positions, kinds, begin, limit)[0] - overlap if base[k] else 0
                stop = (end, 0) if final[k] else range_end(positions, kinds, end, limit)
                laid = lay(positions, kinds, start, stop, limit, overlap)
                shift = base[k] - left[k]
                pieces.append([
                    {"start": a + shift, "end": b + shift, "boundary": "end" if final[k] and b == end else BOUNDARIES[kind], "text": chunk[a:b] if with_text else None}
                    for a, b, kind in laid
                ])
                breaks = np.flatnonzero(_one_of(codes[begin:end], CUT_SPACE + ENDS))
                gaps = np.diff(breaks) - 1
                runs.append((int(breaks[0]), own[k] - 1 - int(breaks[-1]), int(gaps.max()) if len(gaps) else 0) if len(breaks) else (own[k],) * 3)
            columns = [pa.array([r[n] for r in runs], pa.int64()) for n in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), batch.column("range_no"), batch.column("own"), *columns, pa.array(pieces, piece_type)],
                ["item", "range_no", "own", "head", "tail", "longest", "pieces"],
            )

    return ranges.select("item", "range_no", "base", "own", "left", "chunk", "marks", "final").mapInArrow(run, schema)


def pieces_of(split: DataFrame) -> DataFrame:
    """(item, piece_no, start, end, boundary, text) of what split_ranges() gave, numbered from 0."""
    earlier = Window.partitionBy("item").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        split.select("item", "range_no", "pieces", F.coalesce(F.sum(F.size("pieces")).over(earlier), F.lit(0)).alias("first"))
        .select("item", "first", F.posexplode("pieces").alias("k", "piece"))
        .select("item", (F.col("first") + F.col("k")).cast("long").alias("piece_no"), "piece.*")
    )


def longest_runs(split: DataFrame) -> DataFrame:
    """(item, n_chars, n_pieces, longest_run): runs are stitched over range ends, from three numbers a range."""
    ordered = F.array_sort(F.collect_list(F.struct("range_no", "own", "head", "tail", "longest")))
    start = F.struct(F.lit(0).cast("long").alias("open"), F.lit(0).cast("long").alias("most"))

    def step(state, r):
        whole = r["head"] == r["own"]  # no break in all of the range
        return F.struct(
            F.when(whole, state["open"] + r["own"]).otherwise(r["tail"]).alias("open"),
            F.greatest(state["most"], state["open"] + r["head"], r["longest"], r["tail"]).alias("most"),
        )

    return split.groupBy("item").agg(
        F.sum("own").alias("n_chars"),
        F.sum(F.size("pieces")).cast("long").alias("n_pieces"),
        F.aggregate(ordered, start, step)["most"].alias("longest_run"),
    )


def long_snapshots(snapshots: DataFrame, sections: DataFrame, limit: int) -> DataFrame:
    """(item, text, marks): snapshots longer than limit, once each, with the section ends inside them.

    item: (passage_id, unnamed), unnamed being the hash of the text where passage_id is
    null, which are one each text, and else null. A passage put several times counts
    once, as put last (of equal times the text that sorts last). Section ends are used
    where the snapshot's offsets fit its text; null paths and offsets have none.
    Sections are few a path, as they tile it, and repeated rows count once.
    """
    item = F.struct("passage_id", F.when(F.col("passage_id").isNull(), F.sha2("text", 256)).alias("unnamed"))
    newest = F.max_by(F.struct("archive_id", "path", "start_offset", "end_offset", "text"), F.struct("created_at", "text"))
    long = snapshots.filter(F.length("text") > limit).groupBy(item.alias("item")).agg(newest.alias("s")).select("item", "s.*")
    ends = sections.filter("end_offset IS NOT NULL AND path IS NOT NULL").groupBy("archive_id", "path").agg(F.collect_set("end_offset").alias("ends"))
    fits = F.col("end_offset") - F.col("start_offset") == F.length("text")
    marks = F.when(fits, F.transform("ends", lambda e: e - F.col("start_offset")))
    return long.join(ends, ["archive_id", "path"], "left").select("item", "text", F.coalesce(marks, F.array().cast("array<long>")).alias("marks"))


def split_snapshots(snapshots: DataFrame, sections: DataFrame, *, limit: int, overlap: int, with_text: bool = True) -> DataFrame:
    """split_ranges() over long_snapshots()."""
    ranges = text_ranges(long_snapshots(snapshots, sections, limit), item="item", text="text", marks="marks", limit=limit, overlap=overlap)
    return split_ranges(ranges, limit=limit, overlap=overlap, with_text=with_text)


def size_of(specs: DataFrame, used_for: str = "piece") -> tuple[int, int]:
    """(capacity, overlap) of the pieces in a table of sizes: of its rows for them the one with the least spec_id."""
    row = specs.filter((F.col("used_for") == used_for) & (F.col("capacity") > 0)).orderBy("spec_id").select("capacity", F.coalesce("overlap", F.lit(0)).alias("overlap")).first()
    if row is None:
        raise ValueError(f"no size for a {used_for}")
    return row.capacity, row.overlap


def write_files(texts: DataFrame, folder: str, *, by: str, text: str) -> list[str]:
    """Writes the texts, a line end behind each, to text files a value of `by`, in a new folder that all workers share; gives their paths.

    Null texts are left out; a null value has a folder of its own.
    """
    texts.filter(F.col(text).isNotNull()).select(by, F.col(text).alias("value")).write.partitionBy(by).text(folder)
    local = folder.removeprefix("file:")
    return sorted(os.path.join(at, name) for at, _, names in os.walk(local) for name in names if name.startswith("part-"))
