"""Sense assignment: anchors by similarity, and candidates by four weighted features; ranking metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions import vectors as V
from spanloom.operators import encoding, vectors

#: Weights of the features.  (fixed values)
WEIGHTS = {"target_definition": 0.35, "context_definition": 0.20, "cross_alignment": 0.35, "lexical_overlap": 0.10}


def merge_weights(override: dict[str, float] | None = None) -> dict[str, float]:
    w = WEIGHTS | (override or {})
    total = sum(w.values())
    if total <= 0:
        raise ValueError("weights must add up to more than 0")
    return {k: v / total for k, v in w.items()}


def assign_anchors(records: DataFrame, anchors: DataFrame) -> DataFrame:
    """rec_id, anchor_id, sim: of all anchors the one with the greatest cosine; of equals the smallest id.

    Anchors go to the records in blocks.  A record without a direction (null or zero) has the smallest id and no sim; an anchor
    without one is only taken if no other is there."""
    directed = lambda d, v: d.where(V.norm(F.col(v)) > 0)
    pairs = vectors.nearest_of(directed(records.select("rec_id", "embed"), "embed"), directed(anchors.select(F.col("anchor_id").alias("q_id"), F.col("centre").alias("q_embed")), "q_embed"))
    best = vectors.nearest(pairs.withColumnRenamed("q_id", "anchor_id"), ["rec_id"], "anchor_id")
    first = anchors.agg(F.min("anchor_id").alias("first")).where("first IS NOT NULL")  # one row
    every = records.select("rec_id").distinct().crossJoin(F.broadcast(first)).join(best, "rec_id", "left")
    return every.select("rec_id", F.coalesce("anchor_id", "first").alias("anchor_id"), "sim")


def groups(assigned: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor_id, n: every anchor, also those without records, the largest group first."""
    g = assigned.groupBy("anchor_id").agg(F.count("*").alias("n"))
    return anchors.select("anchor_id").join(g, "anchor_id", "left").select("anchor_id", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "anchor_id")


def score(features: DataFrame, override: dict[str, float] | None = None) -> DataFrame:
    """Adds score: the weighted sum of the features."""
    total: Column = F.lit(0.0)
    for k, w in merge_weights(override).items():
        total = total + F.lit(w) * F.col(k)
    return features.withColumn("score", total)


def lexical_overlap(a: Column, b: Column) -> Column:
    return T.jaccard(T.overlap_terms(a), T.overlap_terms(b))


def overlaps(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """a, b, overlap (Jaccard) of every pair that shares a term, by an inverted-index join.  left and right: (id, terms array of distinct words)."""
    x = left.select(a, F.size("terms").alias("na"), F.explode("terms").alias("term"))
    y = right.select(b, F.size("terms").alias("nb"), F.explode("terms").alias("term"))
    both = x.join(y, "term").groupBy(a, b).agg(F.count("*").alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return both.select(a, b, (F.col("n") / (F.col("na") + F.col("nb") - F.col("n")).cast("double")).alias("overlap"))


def best(scored: DataFrame) -> DataFrame:
    """context_id, sense_id, score: the best candidate of each context."""
    m = scored.groupBy("context_id").agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("sense_id")).alias("minus"), "score")).alias("m"))
    return m.select("context_id", (-F.col("m.minus")).alias("sense_id"), "m.score")


def rank(scored: DataFrame) -> DataFrame:
    return scored.selectExpr("*", "row_number() OVER (PARTITION BY context_id ORDER BY round(score, 9) DESC, sense_id) AS rank")


def sense_profile(lemma: Column, sense: Column, synonyms: Column, definition: Column, examples: Column) -> Column:
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    return F.concat_ws("\n", line("Lemma", lemma), line("Sense ID", sense), line("Synonyms", F.when(F.size(synonyms) > 0, F.array_join(synonyms, ", ")).otherwise("(none)")), line("Definition", F.coalesce(definition, F.lit("(none)"))), F.when(F.size(examples) > 0, line("Examples", F.array_join(examples, "; "))))


def candidates(details: DataFrame, limit: int | None = None) -> DataFrame:
    """word, ord, sense_id, definition, profile of the first candidates of each word.  details: as lexkg.details() gives them."""
    d = details if limit is None else details.where(F.col("ord") <= limit)
    return d.select("word", "ord", F.col("synset").alias("sense_id"), "definition", sense_profile(F.col("word"), F.col("synset"), F.col("lemmas"), F.col("definition"), F.col("examples")).alias("profile"))


def anchors_of(candidates_: DataFrame, encoder: encoding.Encoder, whole: bool = True, subject: Column | None = None) -> DataFrame:
    """word, ord, sense_id, embed: each definition as an anchor, by its whole text or by the pooled span of its subject (the word if none is
    given); what cannot be encoded or found is left out."""
    if whole:
        return candidates_.select("word", "ord", "sense_id", encoding.text_vectors(F.col("definition"), encoder).alias("embed")).where("embed IS NOT NULL")
    d = candidates_.withColumn("span", T.subject_span(F.col("definition"), F.col("word") if subject is None else subject)).where("span IS NOT NULL")
    at = F.array(F.struct(F.col("span.start").alias("s"), F.col("span.end").alias("e")))
    return d.select("word", "ord", "sense_id", encoding.span_vectors(F.col("definition"), at, encoder)[0].alias("embed")).where("embed IS NOT NULL")


def features(contexts: DataFrame, candidates_: DataFrame, encoder: encoding.Encoder, window: int = 3) -> DataFrame:
    """context_id, sense_id and the four features of every context with every candidate of its word.

    contexts: (context_id, word, text, start, end); a span that does not hold the word is looked for again.  A context whose target is not
    found has 0 for what needs it."""
    c = contexts.withColumn("span", T.resolve_span(F.col("text"), F.col("word"), F.col("start"), F.col("end")))
    found = F.col("span").isNotNull()
    m = T.mark_target(F.col("text"), F.col("span.start"), F.col("span.end"))
    c = c.select("context_id", "word", "text", F.when(found, m["text"]).otherwise(F.col("text")).alias("marked"), F.when(found, m["start"]).alias("s"), F.when(found, m["end"]).alias("e"))
    both = c.join(candidates_.select("word", "sense_id", "profile"), "word")
    both = both.withColumn("v", encoding.joint_vectors(F.col("marked"), F.col("s"), F.col("e"), F.col("profile"), encoder, window))
    return both.select(
        "context_id", "sense_id", V.cosine_or_zero(F.col("v.target"), F.col("v.profile")).alias("target_definition"), V.cosine_or_zero(F.col("v.window"), F.col("v.profile")).alias("context_definition"),
        F.col("v.alignment").alias("cross_alignment"), lexical_overlap(F.col("text"), F.col("profile")).alias("lexical_overlap"),
    )


def assign_contexts(contexts: DataFrame, candidates_: DataFrame, encoder: encoding.Encoder, override: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(context_id, sense_id, score of the best candidate; sense_id, n of every candidate, the largest group first, empty ones too)."""
    scored = score(features(contexts, candidates_, encoder), override)
    chosen = rank(scored).where("rank = 1").select("context_id", "sense_id", "score")
    n = chosen.groupBy("sense_id").agg(F.count("*").alias("n"))
    every = candidates_.select("sense_id").distinct().join(n, "sense_id", "left").select("sense_id", F.coalesce("n", F.lit(0)).alias("n"))
    return chosen, every.orderBy(F.desc("n"), "sense_id")


def records_for(records: DataFrame, terms: DataFrame, by_document: bool = False) -> DataFrame:
    """The span records of the given terms, each once: by kind, document, span and term, or by document alone (its first).

    records: (kind, doc_id, s, e, term, ...); terms: (term)."""
    hit = records.join(terms.select("term").distinct(), "term", "left_semi")
    key = "doc_id" if by_document else "kind, doc_id, s, e, term"
    return hit.selectExpr("*", f"row_number() OVER (PARTITION BY {key} ORDER BY doc_id, s, e, kind, term) AS __n").where("__n = 1").drop("__n")


def reciprocal_rank(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """q_id, rr: 1 over the rank of the first gold title within k, else 0.  ranked: (q_id, rank, title); gold: (q_id, title)."""
    key = lambda d: d.withColumn("t", F.lower(T.squeeze(F.col("title")))).drop("title")
    hit = key(ranked).where(F.col("rank") <= k).join(key(gold).distinct(), ["q_id", "t"]).groupBy("q_id").agg(F.min("rank").alias("r"))
    return ranked.select("q_id").union(gold.select("q_id")).distinct().join(hit, "q_id", "left").select("q_id", F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("rr"))
