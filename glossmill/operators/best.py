"""The best texts of each query by the sum of the weights of the terms they share, without listing the pairs.

Pairs of a query and a text that share a term grow as the square of the input, so none
leaves a task: each goes through its texts with all queries, keeps the k best of each
query by score and key, and only these are shuffled. Texts are dealt to a number of
tasks that depends on the cluster and not on the input, so what is shuffled grows as
the queries. Nothing is left out: a text that isn't among the k best of its task isn't
among the k best of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks a core, and queries that one task keeps lists of; more are dealt to further tasks over the same texts.
TASKS, QUERIES = 2, 30_000
K1, B = 1.2, 0.75
#: Scores are rounded to so many digits before they are ranked, so that the order of summing doesn't matter.
DIGITS = 6


class Asked:
    """The terms of some queries, each query's together, by falling place."""

    def __init__(self, rows: pa.Table):
        queries, known = (pc.dictionary_encode(rows.column(c).combine_chunks(), null_encoding="encode") for c in ("query", "term"))
        of, place = queries.indices.to_numpy(), rows.column("place").to_numpy()
        order = np.lexsort((-place, of))
        self.names, self.terms, self.codes = queries.dictionary, known.dictionary, known.indices.to_numpy()[order]
        self.weights, self.places = rows.column("weight").to_numpy()[order], place[order]
        self.starts = np.searchsorted(of[order], np.arange(len(self.names) + 1))
        self.beyond = float(place.max(initial=0) + 1)

    def __len__(self) -> int:
        return len(self.names)


def postings(batch: pa.RecordBatch, asked: Asked, mean: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts by term, rows, values): the texts that have each asked term.

    Values are those of BM25, from the number of times (a text whose terms have lengths
    of their own has them summed), or ones without a mean length.
    """
    listed = batch.column("list")
    n, many = batch.num_rows, pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
    flat = listed.flatten()
    code = pc.fill_null(pc.index_in(flat, value_set=asked.terms.cast(flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), many)
    kept = code >= 0
    if mean is None:
        pair = np.unique(code[kept] * n + row[kept])
        value = np.ones(len(pair))
    else:
        length = np.repeat(batch.column("doc_len").to_numpy(zero_copy_only=False).astype(np.int64), many)
        own = batch.column("lens")
        if own.null_count < n:
            length[np.repeat(own.is_valid().to_numpy(zero_copy_only=False), many)] = own.flatten().to_numpy(zero_copy_only=False)
        longest = int(length.max(initial=0)) + 1
        triple, times = np.unique((code[kept] * n + row[kept]) * longest + length[kept], return_counts=True)
        pair, value = triple // longest, times * (K1 + 1) / (times + K1 * (1 - B + B * (triple % longest) / mean))
        at = np.flatnonzero(np.diff(pair, prepend=-1))
        if len(at) < len(pair):
            pair, value = pair[at], np.add.reduceat(value, at)
    return np.searchsorted(pair, np.arange(len(asked.terms) + 1) * n), pair % max(n, 1), value


class Lists:
    """The k best of each query so far, as (what they are ranked by, less than zero, whether the key is null, key)."""

    def __init__(self, asked: Asked, k: int, mean: float | None, placed: bool):
        self.asked, self.k, self.mean, self.placed = asked, k, mean, placed
        self.best: list[list] = [[] for _ in range(len(asked))]

    def add(self, batch: pa.RecordBatch) -> None:
        asked, k, scale = self.asked, self.k, 10.0**DIGITS if self.mean else 1.0
        name = batch.column("key")
        seen = pc.index_in(name, value_set=pc.unique(name)).to_numpy(zero_copy_only=False)
        once = np.unique(seen, return_index=True)[1]
        if len(once) < batch.num_rows:  # the same text put again
            batch = batch.take(pa.array(np.sort(once)))
        starts, rows, values = postings(batch, asked, self.mean)
        names = batch.column("key").to_pylist()
        order = np.empty(len(names), np.int64)
        order[pc.sort_indices(batch.column("key")).to_numpy()] = np.arange(len(names))
        total, least = np.zeros(len(names)), np.zeros(len(names))
        some = np.flatnonzero(np.add.reduceat((np.diff(starts) > 0)[asked.codes], asked.starts[:-1])) if len(asked) else []
        for q in np.asarray(some).tolist():
            touched = []
            for at in range(asked.starts[q], asked.starts[q + 1]):
                low, high = starts[asked.codes[at]], starts[asked.codes[at] + 1]
                if low < high:
                    touched.append(rows[low:high])
                    total[rows[low:high]] += asked.weights[at] * values[low:high]
                    if self.placed:
                        least[rows[low:high]] = asked.places[at]
            where = np.concatenate(touched) if len(touched) > 1 else touched[0]
            best = self.best[q]
            floor = -best[-1][0] if len(best) == k else 0.0
            lower = floor / asked.beyond if self.placed else (floor - 0.5) / scale - 1e-9
            sums, enough = total[where], k * len(touched)  # a text is among them once for each of its terms at most
            if len(sums) > 4 * enough:
                lower = max(lower, np.partition(sums, len(sums) - enough)[len(sums) - enough] - (self.mean is not None) * 1.1 / scale)
            found = np.unique(where[sums >= lower])
            if len(found):
                score = np.floor(total[found] * scale + 0.5)
                if self.placed:
                    score = score * asked.beyond - least[found]
                passes = score >= max(floor, 0.5)
                found, score = found[passes], score[passes]
            total[where] = 0
            if not len(found):
                continue
            if len(found) > k:
                last = np.partition(score, len(score) - k)[len(score) - k]
                more, same = found[score > last], found[score == last]
                same = same[np.argsort(order[same])[: k - len(more)]]
                score = np.concatenate([score[score > last], np.full(len(same), last)])
                found = np.concatenate([more, same])
            merged = sorted(best + [(-s, names[n] is None, 0 if names[n] is None else names[n]) for s, n in zip(score.tolist(), found.tolist(), strict=True)])
            kept, held = [], set()
            for entry in merged:
                if entry[1:] not in held:
                    held.add(entry[1:])
                    kept.append(entry)
                    if len(kept) == k:
                        break
            self.best[q] = kept

    def batches(self, schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
        scale = 10.0**DIGITS if self.mean else 1.0
        for first in range(0, len(self.best), size):
            part = self.best[first : first + size]
            of = np.repeat(np.arange(first, first + len(part)), [len(x) for x in part])
            value = np.array([-e[0] for x in part for e in x])
            score = np.ceil(value / self.asked.beyond) if self.placed else value / scale
            least = score * self.asked.beyond - value if self.placed else np.zeros(len(value))
            columns = [self.asked.names.take(pa.array(of)), pa.array([None if e[1] else e[2] for x in part for e in x], schema.field("key").type), pa.array(score), pa.array(least.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def best(asked: DataFrame, texts: DataFrame, *, query: str, key: str, k: int, mean: float | None = None) -> DataFrame:
    """(query, key, score, least): for each query its k best texts of each task; the best of all are among them.

    asked: (query, term, weight) and perhaps place, from 1, each term of a query once,
    on files, as it is read several times. texts: (key, list) and, with a mean length,
    (doc_len, lens); then the score is that of BM25, otherwise the sum of the weights of
    the terms that a text has. With places, weights are ones, and of equal scores the
    text with the lower least place comes first. Equal ones then by key.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, placed = asked.sparkSession, "place" in asked.columns
    wide = ["key", "list", "doc_len", "lens"] if mean is not None else ["key", "list"]
    source = texts.select(*wide).coalesce(max(1, TASKS * spark.sparkContext.defaultParallelism))
    kind = asked.select(F.col(query).alias("query")).crossJoin(texts.select("key").limit(0)).withColumns({"score": F.lit(0.0), "least": F.lit(0)}).schema
    schema = to_arrow_schema(kind)
    n = max(1, -(-asked.select(query).distinct().count() // QUERIES))
    block = F.pmod(F.xxhash64(query), F.lit(n))
    rows = asked.select(F.col(query).alias("query"), "term", F.col("weight").cast("double").alias("weight"), (F.col("place") if placed else F.lit(0)).cast("int").alias("place"), block.alias("block"))

    def part(at: int) -> DataFrame:
        terms = Asked(rows.filter(F.col("block") == at).drop("block").toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists = Lists(terms, k, mean, placed)
            for batch in batches:
                lists.add(batch)
            yield from lists.batches(schema)

        return source.mapInArrow(run, kind)

    found = part(0)
    for at in range(1, n):
        found = found.unionByName(part(at))
    return found.select(F.col("query").alias(query), F.col("key").alias(key), "score", "least")
