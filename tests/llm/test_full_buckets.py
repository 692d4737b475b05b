"""Buckets with more unlike forms than lead clusters in a few rounds."""

from pyspark.sql import functions as F

from glossmill.llm import lines

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def test_no_form_of_a_full_bucket_is_left_out(spark, monkeypatch):
    """Eighty kinds of lines with the same buckets: each is repeated in three passages, and the rarest come out as well as the commonest."""
    text = lambda n: "".join(LETTERS[(n * 7 + m * (n % 5 + 1) + m * m * n) % 26] for m in range(40))
    kinds = [(n, text(n)) for n in range(80)]
    assert len({t for _, t in kinds}) == 80
    rows = [("a", f"p{n}-{p}", 1, n, n, list(range(lines.BANDS)), letters, 0) for n, letters in kinds for p in range(3)]
    hashed = spark.createDataFrame(rows, "archive_id string, passage_id string, line_no int, form long, form2 long, buckets array<long>, letters string, bucket long")
    monkeypatch.setattr(lines, "hashed_lines", lambda snapshots, names: hashed.drop("bucket"))
    monkeypatch.setattr(lines, "frequent_clusters", lambda _, least: hashed)
    monkeypatch.setattr(lines, "LEADERS", 2)
    found = lines.similar_lines(None, least=3)
    assert found.count() == 240 and found.select("cluster").distinct().count() == 80
    assert found.filter(F.col("passages") != 3).count() == 0
