"""Pages, sections and passages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.session import cut

PASSAGE_CHARS = 400


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def unescape(html: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        html = F.replace(html, F.lit(name), F.lit(char))
    return html


def render_page(title: Column, text: Column) -> Column:
    """An HTML page with furniture around a heading and a paragraph for each line."""
    body = F.array_join(F.transform(F.split(escape(text), "\n"), lambda line: F.concat(F.lit("<p>"), line, F.lit("</p>"))), "")
    return F.concat(F.lit("<html><head><style>p{}</style></head><body><nav>Menu</nav><article><h1>"), escape(title), F.lit("</h1>"), body, F.lit("</article><footer>End</footer><script>var a = 1 < 2;</script></body></html>"))


def page_text(html: Column) -> Column:
    """The text of a page's main part: furniture, scripts and comments left out, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|footer|header|aside|noscript|head)\b[^>]*>.*?</\1\s*>", " ")
    spaced = F.regexp_replace(bare, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|main|body|html)\b[^>]*>", " ")
    return F.regexp_replace(F.regexp_replace(unescape(F.regexp_replace(spaced, r"<[^>]+>", "")), r"\s+", " "), "^ +| +$", "")


def internal_links(html: Column) -> Column:
    """Distinct link targets in order, without those with a scheme, a host or only a fragment."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?href="([^"]*)"'), 1)
    return F.array_distinct(F.filter(found, lambda h: ~h.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//|#)") & (h != "")))


def section_tree(sections: DataFrame) -> DataFrame:
    """(archive_id, path, section_index, start_offset, end_offset, parent): ends from the next start, null for the last section.

    The parent is the last earlier section of a lower level. Articles are groups of
    their sections, which tile a text; null paths have no article, end or parent.
    """
    order = Window.partitionBy("archive_id", "path").orderBy("section_index", "start_offset")
    earlier = Window.partitionBy("archive_id", "path").orderBy("section_index").rangeBetween(Window.unboundedPreceding, -1)
    seen = F.collect_list(F.struct("section_index", "heading_level")).over(earlier)
    above = F.filter(seen, lambda s: s["heading_level"] < F.col("heading_level"))
    parent = F.array_max(F.transform(above, lambda s: s["section_index"]))
    return sections.select("archive_id", "path", "section_index", "start_offset", F.lead("start_offset").over(order).alias("end_offset"), parent.alias("parent"))


def chunk_words(docs: DataFrame, *, key: str, text: str, most: int = PASSAGE_CHARS) -> DataFrame:
    """(key, piece_no, start, end, piece): spans of whole words, as many as fit in so many characters from the span's start.

    A longer word is a span of its own. Null and blank texts have none.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    word = re.compile(r"\S+")

    def spans(value: str) -> Iterator[tuple[int, int]]:
        start = end = None
        for match in word.finditer(value):
            if start is not None and match.end() - start > most:
                yield start, end
                start = None
            start = match.start() if start is None else start
            end = match.end()
        if start is not None:
            yield start, end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, a, b, v[a:b]) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v for n, (a, b) in enumerate(spans(v))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], batch.schema.field(0).type), *(pa.array([r[n] for r in rows], pa.int32()) for n in (1, 2, 3)), pa.array([r[4] for r in rows], pa.string())],
                ["key", "piece_no", "start", "end", "piece"],
            )

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, piece_no int, start int, end int, piece string").withColumnRenamed("key", key)


def heading_paths(sections: DataFrame) -> DataFrame:
    """(archive_id, path, section_index, headings, depth): each section's headings from the top down, joined by " > ".

    sections: archive_id, path, section_index, heading, parent_index; of a section in
    several rows the heading and parent that sort first count. A parent that doesn't
    stand before its section ends the chain, so chains end; levels are followed one
    join each, until none is left.
    """
    key = ["archive_id", "path"]
    one = cut(sections.groupBy(*key, "section_index").agg(F.min(F.coalesce("heading", F.lit(""))).alias("heading"), F.min("parent_index").alias("parent")))
    above = one.select(*key, F.col("section_index").alias("parent"), F.col("heading").alias("over"), F.col("parent").alias("next"))
    open_ones = one.select(*key, "section_index", F.col("heading").alias("headings"), "parent", F.lit(1).alias("depth"))
    done = None
    while True:
        step = cut(open_ones.join(above.filter("parent IS NOT NULL"), [*key, "parent"], "left").withColumn("goes_on", F.col("over").isNotNull() & (F.col("parent") < F.col("section_index"))))
        ended = step.filter("NOT goes_on").select(*key, "section_index", "headings", "depth")
        done = ended if done is None else done.unionByName(ended)
        on = step.filter("goes_on")
        if on.isEmpty():
            return done
        open_ones = on.select(*key, "section_index", F.concat("over", F.lit(" > "), "headings").alias("headings"), F.col("next").alias("parent"), (F.col("depth") + 1).alias("depth"))
