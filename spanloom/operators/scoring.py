"""Term and prototype statistics: tf, df, idf, BM25, shared-chunk weights, node and chunk weights.

All are hash aggregations with map-side combining; chunk tables of one row (corpus size, mean length) are cross-joined as scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Weight of a node by its level, the strongest first.  (fixed values)
LEVEL_WEIGHTS = (1.2, 1.0, 0.8, 0.5)


def term_frequencies(occurrences: DataFrame, term: str, chunk: str) -> DataFrame:
    return occurrences.groupBy(term, chunk).agg(F.count("*").alias("tf"))


def corpus_stats(chunks: DataFrame, length: str) -> DataFrame:
    """One row: n_chunks, avg_len."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.avg(length).alias("avg_len"))


def idf(n_chunks: Column, df: Column) -> Column:
    return F.log((n_chunks + 1) / (df + 1)) + 1


def document_frequencies(tf: DataFrame, term: str, chunk: str, stats: DataFrame) -> DataFrame:
    """Distinct chunks of each term and its idf.  tf has a row for each (term, chunk)."""
    df = tf.groupBy(term).agg(F.count_distinct(chunk).alias("df"))
    return df.crossJoin(F.broadcast(stats)).withColumn("idf", idf(F.col("n_chunks"), F.col("df"))).drop("n_chunks", "avg_len")  # stats is one row


def bm25(idf_: Column, tf: Column, length: Column, avg: Column, k1: float = K1, b: float = B) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))


def bm25_saturation(tf: Column, length: Column, avg: Column, k1: float = 1.5, b: float = B) -> Column:
    """0 for tf <= 0; a mean length <= 0 counts as the larger of 1 and the length."""
    mean = F.when(avg <= 0, F.greatest(F.lit(1.0), length)).otherwise(avg)
    return F.when(tf <= 0, F.lit(0.0)).otherwise(tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)))


def bm25_scores(tf: DataFrame, term: str, chunk: str, chunks: DataFrame, length: str) -> DataFrame:
    """term, chunk, tf, df, idf, bm25."""
    stats = corpus_stats(chunks, length)
    df = document_frequencies(tf, term, chunk, stats)
    joined = tf.join(df, term).join(chunks.select(chunk, length), chunk).crossJoin(F.broadcast(stats.select("avg_len")))
    return joined.select(term, chunk, "tf", "df", "idf", bm25(F.col("idf"), F.col("tf"), F.col(length), F.col("avg_len")).alias("bm25"))


def shared_chunk_edges(members: DataFrame, node: str, chunk: str) -> DataFrame:
    """a, b, weight: shared chunks over the root of the product of chunk counts, for the pairs that share any.

    An equi-join on the chunk makes only pairs with something in common; members are distinct (node, chunk)."""
    m = members.select(F.col(node).alias("n"), F.col(chunk).alias("c")).distinct()
    size = m.groupBy("n").agg(F.count("*").alias("k"))
    both = m.alias("x").join(m.alias("y"), F.expr("x.c = y.c AND x.n < y.n")).groupBy(F.col("x.n").alias("a"), F.col("y.n").alias("b")).agg(F.count("*").alias("shared"))
    s1, s2 = size.select(F.col("n").alias("a"), F.col("k").alias("ka")), size.select(F.col("n").alias("b"), F.col("k").alias("kb"))
    return both.join(s1, "a").join(s2, "b").select("a", "b", "shared", (F.col("shared") / F.sqrt((F.col("ka") * F.col("kb")).cast("double"))).alias("weight"))


def node_weights(edges: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """node, weight: the sum of a node's edges, times its level's weight.  levels: (node, level)."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "weight")
    w = ends.groupBy("node").agg(F.sum("weight").alias("weight"))
    if levels is None:
        return w
    by = F.element_at(F.array(*map(F.lit, LEVEL_WEIGHTS)), (F.col("level") + 1).cast("int"))
    return w.join(levels, "node").select("node", (F.col("weight") * by).alias("weight"))


def chunk_weights(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """chunk_id, weight over connected nodes.  nodes: (node, proto_id, term, weight); scores: (proto_id, chunk_id, bm25).

    For one chunk and term text only the first node counts."""
    j = nodes.join(scores, "proto_id").selectExpr("*", "row_number() OVER (PARTITION BY chunk_id, term ORDER BY node) AS nth").where("nth = 1")
    return j.groupBy("chunk_id").agg(F.sum(F.col("weight") * F.col("bm25")).alias("weight"))


def level_ranking(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """level, chunk_id, score, pos (from 1) over all nodes, connected or not.  nodes: (node, proto_id, level)."""
    s = nodes.join(scores, "proto_id").groupBy("level", "chunk_id").agg(F.sum("bm25").alias("score"))
    return s.selectExpr("*", "row_number() OVER (PARTITION BY level ORDER BY round(score, 9) DESC, chunk_id) AS pos")


def top_chunks(scores: DataFrame, k: int, score: str = "weight") -> DataFrame:
    return scores.orderBy(F.round(score, 9).desc(), "chunk_id").limit(k)
