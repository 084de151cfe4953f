"""Multi-hop question files: samples, the global list of documents, the retrieval set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import ids

SCHEMA = "_id string, question string, answer string, supporting_facts array<array<string>>, context array<array<string>>"


def samples(spark: SparkSession, path: str) -> DataFrame:
    """seq, id, question, answer, supporting (title, sent_ids), documents (title, sentences, text).  Mixed arrays arrive as JSON text."""
    raw = spark.read.option("multiLine", True).schema(SCHEMA).json(path).withColumn("seq", F.monotonically_increasing_id())
    docs = F.transform("context", lambda c: F.struct(F.get(c, 0).alias("title"), F.from_json(F.get(c, 1), "array<string>").alias("sentences")))
    docs = F.transform(docs, lambda d: F.struct(d["title"].alias("title"), d["sentences"].alias("sentences"), F.array_join(d["sentences"], " ").alias("text")))
    titles = F.array_distinct(F.transform("supporting_facts", lambda f: F.get(f, 0)))
    facts = F.transform(titles, lambda t: F.struct(t.alias("title"), F.transform(F.filter("supporting_facts", lambda f: F.get(f, 0) == t), lambda f: F.get(f, 1).cast("int")).alias("sent_ids")))
    return raw.select("seq", F.col("_id").alias("id"), "question", "answer", facts.alias("supporting"), docs.alias("documents"))


def documents(entries: DataFrame) -> DataFrame:
    """doc_id, title, text: one row a title, the longest trimmed text (the first of equals), ids dense by first appearance.

    entries: (seq, title, text), and pos where several share a seq.  Numbers are made of the narrow (title, first)."""
    e = entries if "pos" in entries.columns else entries.withColumn("pos", F.lit(0))
    t = e.select("seq", F.col("pos").cast("long").alias("pos"), "title", F.trim("text").alias("text"))
    best = t.groupBy("title").agg(F.max(F.struct(F.length("text").alias("n"), (-F.col("seq")).alias("back"), (-F.col("pos")).alias("back2"), "text")).alias("m"))
    first = t.groupBy("title").agg(F.min(F.struct("seq", "pos")).alias("f")).select("title", F.col("f.seq").alias("seq"), F.col("f.pos").alias("pos"))
    named = ids.dense(first, ["seq", "pos", "title"], "doc_id").select("doc_id", "title")
    return named.join(best.select("title", "m.text"), "title").select("doc_id", "title", "text")


def retrieval_set(samples_: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, questions with gold_doc_ids) of the first n samples; unknown titles are dropped."""
    s = samples_.orderBy("seq").limit(n) if n else samples_
    entries = s.select("seq", F.posexplode("documents").alias("pos", "d")).select("seq", "pos", "d.title", "d.text")
    docs = documents(entries)
    gold = s.select("id", F.explode("supporting.title").alias("title")).distinct().join(docs.select("doc_id", "title"), "title").groupBy("id").agg(F.sort_array(F.collect_set("doc_id")).alias("gold_doc_ids"))
    return docs, s.select("id", "question", "answer").join(gold, "id", "left")
