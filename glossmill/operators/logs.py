"""Conversation logs and stores as tables: sequence numbers, upserts, budgets, eviction, repeated units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import text as t
from glossmill.session import cut


def upsert_first_seen(rows: DataFrame, *, key: str, at: str) -> DataFrame:
    """One row a key: the values of the newest row, but the time of the first. Null keys are left out; equal times: any column that sorts last."""
    values = [c for c in rows.columns if c not in (key, at)]
    newest = F.max_by(F.struct(*values), F.struct(at, *values))
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(newest.alias("v"), F.min(at).alias(at)).select(key, "v.*", at)


def with_sequence(rows: DataFrame, *, group: str, order: list[str], name: str = "seq") -> DataFrame:
    """Rows numbered from 0 within their group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def evict_oldest(rows: DataFrame, *, group: str, order: list[str], tokens: str, budget: int) -> DataFrame:
    """rows with evicted: the newest rows of a group whose tokens fit the budget stay, and always the newest one."""
    newest = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    running = F.sum(tokens).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("evicted", (running > budget) & (F.row_number().over(newest) > 1))


def first_seen(rows: DataFrame, *, keys: list[str], order: list[str]) -> DataFrame:
    """rows with first: whether the row is the first of its keys; later ones can point back to it."""
    return rows.withColumn("first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def repeated_units(texts: DataFrame, *, key: str, text: str, least_chars: int = 20) -> DataFrame:
    """(key, unit_md5, first_no, times): runs of the same sentence, labels and case aside; units under 20 characters never count."""
    unit = lambda s: F.trim(F.regexp_replace(F.lower(F.regexp_replace(s, r"\[S\d+\]", "")), r"\s+", " "))
    units = texts.select(key, F.posexplode(t.sentences(text)).alias("no", "s")).select(key, "no", unit(F.col("s")).alias("unit"))
    order = Window.partitionBy(key).orderBy("no")
    fresh = F.when(F.col("unit").eqNullSafe(F.lag("unit").over(order)), 0).otherwise(1)
    runs = units.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    found = runs.groupBy(key, "run").agg(F.first("unit").alias("unit"), F.min("no").alias("first_no"), F.count("*").alias("times"))
    return found.filter((F.col("times") > 1) & (F.length("unit") >= least_chars)).select(key, F.md5("unit").alias("unit_md5"), "first_no", "times")


def resolve_chain(links: DataFrame, *, node: str, target: str, most_hops: int = 25) -> DataFrame:
    """(node, root, hops, status) from rows (node, target or null): the end of each chain of links.

    status: ok, not_found where a target isn't a node (root is that target), too_deep
    beyond most_hops (root is the end all the same), cycle where a chain has no end
    (root and hops are null). Of a node in several rows the target that sorts first
    counts. Each round doubles how far pointers reach and is written, so a chain of n
    links takes log2(n) rounds; nodes left after as many rounds as the nodes' number
    allows go in circles.
    """
    nodes = links.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(target).alias("next"))
    known = nodes.select(F.col("node").alias("next"), F.lit(True).alias("known"))
    nodes = cut(nodes.join(known, "next", "left"))
    lost = F.col("next").isNotNull() & F.col("known").isNull()
    state = nodes.select("node", F.coalesce("next", "node").alias("at"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("hops"), (F.col("next").isNull() | lost).alias("ended"), lost.alias("lost"))
    rounds = max(1, nodes.count()).bit_length() + 1
    done = None
    for _ in range(rounds):
        # a pointer at an end takes on that end; one at a pointer goes on from where that points
        step = state.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"), F.col("ended").alias("end"), F.col("lost").alias("gone"))
        if done is not None:
            step = step.unionByName(done.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"), F.lit(True).alias("end"), F.col("lost").alias("gone")))
        ended = state.filter("ended").drop("ended")
        done = ended if done is None else done.unionByName(ended)
        left = state.filter("NOT ended")
        if left.isEmpty():
            break
        state = cut(left.join(step, "at").select("node", F.col("to").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), F.col("end").alias("ended"), F.col("gone").alias("lost")))
    else:
        left = state.filter("NOT ended")
        done = done.unionByName(state.filter("ended").drop("ended"))
    status = F.when(F.col("lost"), "not_found").when(F.col("hops") > most_hops, "too_deep").otherwise("ok")
    found = done.select("node", F.col("at").alias("root"), "hops", status.alias("status"))
    circles = left.select("node", F.lit(None).cast(nodes.schema["node"].dataType).alias("root"), F.lit(None).cast("long").alias("hops"), F.lit("cycle").alias("status"))
    return found.unionByName(circles)


def repeated_cycles(texts: DataFrame, *, key: str, text: str, periods: int = 3, least_chars: int = 20, longest: int = 8) -> DataFrame:
    """(key, period, first_no, times): runs of sentences that equal those a period before, for periods of 2 to 8.

    A run counts if it spans at least three periods and its sentences have 20
    characters or more; of a text the shortest period counts, then the first run.
    """
    unit = lambda s: F.trim(F.regexp_replace(F.lower(F.regexp_replace(s, r"\[S\d+\]", "")), r"\s+", " "))
    units = texts.select(key, F.posexplode(t.sentences(text)).alias("no", "s")).select(key, "no", unit(F.col("s")).alias("unit"))
    order = Window.partitionBy(key).orderBy("no")
    same = [F.struct(F.lit(p).alias("period"), (F.col("unit") == F.lag("unit", p).over(order)).alias("same")) for p in range(2, longest + 1)]
    hits = units.withColumn("flags", F.array(*same)).filter(F.length("unit") >= least_chars).select(key, "no", F.inline("flags")).filter("same")
    run = F.col("no") - F.row_number().over(Window.partitionBy(key, "period").orderBy("no"))
    runs = hits.withColumn("run", run).groupBy(key, "period", "run").agg(F.count("*").alias("n"), F.min("no").alias("at"))
    found = runs.filter(F.col("n") >= F.col("period") * (periods - 1))
    found = found.select(key, "period", (F.col("at") - F.col("period")).alias("first_no"), F.floor((F.col("n") + F.col("period")) / F.col("period")).alias("times"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("period", "first_no"))
    return found.withColumn("place", place).filter("place = 1").drop("place")


def evict_in_stages(rows: DataFrame, *, group: str, order: list[str], tokens: str, passages: str, budget: int) -> DataFrame:
    """rows with passages_gone and turn_gone, of a group's log that is over its budget.

    First the passages of the oldest turns go, as long as the log is over the budget,
    those of the newest turn never; then, where tokens alone are still too many, whole
    turns, oldest first, the newest never. A turn that goes takes its passages along.
    """
    oldest = Window.partitionBy(group).orderBy(*order)
    newest = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    freed = F.coalesce(F.sum(passages).over(oldest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.col(tokens) + F.col(passages)).over(Window.partitionBy(group))
    earlier = F.row_number().over(Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])) > 1
    turn = (F.sum(tokens).over(newest) + F.first(passages).over(newest) > budget) & earlier
    first = (total - freed > budget) & earlier & (F.col(passages) > 0)
    return rows.withColumn("turn_gone", turn).withColumn("passages_gone", first | turn)
