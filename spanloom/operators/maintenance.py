"""Deletion: documents, their chunks, then whatever has nothing left; dense ids; statistics recomputed.

Prototype centres and thresholds stay as they were."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import scoring
from spanloom.operators.ids import dense


def delete_documents(chunks: DataFrame, members: DataFrame, protos: DataFrame, terms: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """chunks (chunk_id, doc_id, num_tokens), members (proto_id, chunk_id), protos (proto_id, term_id), terms (term_id); gone: (doc_id)."""
    chunks = chunks.join(gone.select("doc_id"), "doc_id", "left_anti")
    members = members.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    protos = protos.join(members.select("proto_id").distinct(), "proto_id", "left_semi")
    terms = terms.join(protos.select("term_id").distinct(), "term_id", "left_semi")
    return {"chunks": dense(chunks, "chunk_id", "new_chunk_id"), "members": members, "protos": dense(protos, "proto_id", "new_proto_id"), "terms": dense(terms, "term_id", "new_term_id")}


def rebuild(tables: dict[str, DataFrame]) -> DataFrame:
    """tf, df, idf and BM25 of what is left."""
    tf = scoring.term_frequencies(tables["members"], "proto_id", "chunk_id")
    return scoring.bm25_scores(tf, "proto_id", "chunk_id", tables["chunks"], "num_tokens")


def chunk_prototypes(members: DataFrame) -> DataFrame:
    return members.select("chunk_id", "proto_id").distinct()


def multi_sense_terms(protos: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """term_id, proto_id, occurrences for terms with at least `least` prototypes."""
    many = protos.groupBy("term_id").agg(F.count("*").alias("senses")).where(F.col("senses") >= least)
    count = members.groupBy("proto_id").agg(F.count("*").alias("occurrences"))
    return protos.select("term_id", "proto_id").join(many, "term_id").join(count, "proto_id").select("term_id", "senses", "proto_id", "occurrences")


def select_top(df: DataFrame, terms: int | None, senses: int | None, by: str = "senses", contains: str | None = None, name: str = "term_id") -> DataFrame:
    """The first terms, and the first prototypes of each by occurrences (rank from 1).

    by: `senses` (most first), `occurrences` (of all a term's prototypes, most first) or `name` (whatever its case).  contains: only terms whose
    name holds this text whatever its case.  df: (term_id, senses, proto_id, occurrences) and the name column."""
    if contains:
        df = df.where(F.lower(F.col(name).cast("string")).contains(contains.lower()))
    per = df.groupBy("term_id").agg(F.max("senses").alias("senses_"), F.sum("occurrences").alias("all_occurrences"), F.min(F.lower(F.col(name).cast("string"))).alias("name_"))
    first = {"senses": F.desc("senses_"), "occurrences": F.desc("all_occurrences"), "name": F.col("name_")}[by]
    ordered = per.orderBy(first, "term_id")
    best = (ordered if terms is None else ordered.limit(terms)).select("term_id", "all_occurrences")
    ranked = df.join(best, "term_id").selectExpr("*", "row_number() OVER (PARTITION BY term_id ORDER BY occurrences DESC, proto_id) AS rank")
    return ranked if senses is None else ranked.where(F.col("rank") <= senses)


def limit_examples(df: DataFrame, budget: int) -> DataFrame:
    """How many of each prototype's n examples a term's budget still allows, in rank order.  df: (term_id, rank, n)."""
    before = "coalesce(sum(n) OVER (PARTITION BY term_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return df.selectExpr("*", f"least(n, greatest(0, {budget} - {before})) AS allowed")


def distinct_examples(df: DataFrame, k: int = 3) -> DataFrame:
    """The first k examples of each prototype that differ whatever their case.  df: (proto_id, ord, sentence)."""
    d = df.selectExpr("*", "row_number() OVER (PARTITION BY proto_id, lower(sentence) ORDER BY ord) AS again").where("again = 1")
    return d.selectExpr("proto_id", "ord", "sentence", "row_number() OVER (PARTITION BY proto_id ORDER BY ord) AS n").where(F.col("n") <= k)
