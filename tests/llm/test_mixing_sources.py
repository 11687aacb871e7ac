"""Rows that only their source, or another column, tells apart."""

from pyspark.sql import functions as F

from verdictflow.llm import mixing


def test_copies_stay_with_their_source(spark):
    rows = [(1, "one two three", s, f"r{i}") for i, s in enumerate(["a"] * 30 + ["b"] * 7 + [None] * 13)] + [(2, "x " * 40, "a", "r"), (3, "y", "b", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other string").withColumn("held", F.create_map(F.lit("k"), "other"))
    told = {r.source: r.n for r in mixing.mix(docs).where("doc_id = 1").groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    taken = mixing.mix_documents(docs)
    got = {r.source: r.n for r in taken.where("doc_id = 1").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got == {s: n for s, n in told.items() if n}
    assert taken.columns == docs.columns
    again = mixing.mix_documents(docs.repartition(5))
    key = lambda df: sorted((r.doc_id, r.source or "", r.other) for r in df.collect())
    assert key(taken) == key(again)
