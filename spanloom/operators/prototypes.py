"""Prototypes (senses) of terms: training, assignment of later occurrences, anomalies.

occurrences: (term_id long, chunk_id long, occ_id long, batch_ord long, embed array)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import vectors as V
from spanloom.operators import cluster, vectors
from spanloom.operators.ids import dense
from spanloom.sources import store

BUFFER, PERCENTILE, TAU = 100, 0.9, 0.90


def training_split(occurrences: DataFrame, buffer_size: int = BUFFER) -> DataFrame:
    """Adds `full` (whether the term reaches buffer_size) and `trains`: true up to the end of the batch in which the term's count reaches buffer_size (always, if it never does).

    Running counts are over (term, batch) totals, not over occurrences, so a hot term is combined before any window."""
    per = occurrences.groupBy("term_id", "batch_ord").agg(F.count("*").alias("n"))
    run = per.selectExpr("*", "sum(n) OVER (PARTITION BY term_id ORDER BY batch_ord) AS upto")
    full = run.where(F.col("upto") >= buffer_size).groupBy("term_id").agg(F.min("batch_ord").alias("full_at"))
    o = occurrences.join(full, "term_id", "left")
    return o.withColumns({"trains": F.coalesce(F.col("batch_ord") <= F.col("full_at"), F.lit(True)), "full": F.col("full_at").isNotNull()}).drop("full_at")


def basic(occurrences: DataFrame, percentile: float = PERCENTILE) -> DataFrame:
    """One prototype a term: term_id, centre, threshold, concentration, n."""
    c = vectors.centres(occurrences, "term_id")
    sims = vectors.similarities(occurrences, c, "term_id")
    stats = sims.groupBy("term_id").agg(F.percentile("sim", F.lit(1 - percentile)).alias("threshold"), F.avg("sim").alias("concentration"), F.count("*").alias("n"))
    return c.join(stats, "term_id")


def is_semantic(protos: DataFrame, tau: float = TAU, df_ratio: float | None = None, n_chunks: int | None = None) -> DataFrame:
    """A term has senses unless its occurrences concentrate over tau, or (if asked) it is in over df_ratio of the chunks."""
    wide = F.lit(False) if df_ratio is None else F.col("df") > df_ratio * n_chunks
    return protos.withColumn("is_semantic", ~wide & (F.col("concentration") <= tau))


def senses(occurrences: DataFrame, percentile: float = PERCENTILE, min_cluster_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(prototypes, members): clusters of each term, or its basic prototype where it has none; noise goes to the nearest prototype (anomaly)."""
    labelled = occurrences.join(cluster.clusters(occurrences, "term_id", "chunk_id", "embed", min_cluster_size), ["term_id", "occ_id"])
    return from_labels(labelled, percentile)


Keep = Callable[[DataFrame], DataFrame]


def keep_or(keep: Keep | None, df: DataFrame) -> Keep:
    """keep, or a writer into a folder of the shared store: what several steps read is never computed again."""
    spark = df.sparkSession
    return keep or store.TableSet(spark, f"{store.work_dir(spark)}/steps-{uuid.uuid4().hex}").keeper()


def from_labels(labelled: DataFrame, percentile: float = PERCENTILE, keep: Keep | None = None) -> tuple[DataFrame, DataFrame]:
    """Prototypes and members of occurrences with a cluster (-1 noise); a term without any cluster has one basic prototype.

    keep: writes a table that several steps read and gives it back (a TableSet's keeper()); the result reads such tables."""
    keep = keep_or(keep, labelled)
    has = labelled.where("cluster >= 0").select("term_id").distinct().withColumn("split", F.lit(True))
    labelled = keep(labelled.join(has, "term_id", "left").withColumn("sense", F.when(F.col("split"), F.col("cluster")).otherwise(0)))
    inside = labelled.where("sense >= 0").withColumn("key", F.struct("term_id", "sense"))
    c = keep(vectors.centres(inside, "key"))
    thresholds = vectors.threshold(vectors.similarities(inside, c, "key"), "key", percentile)
    protos = keep(c.join(thresholds, "key").select("key.term_id", F.col("key.sense").cast("long").alias("sense"), "centre", "threshold"))
    named = dense(protos.select("term_id", "sense"), ["term_id", "sense"], "proto_id")  # narrow
    protos = keep(named.join(protos, ["term_id", "sense"]))
    members = inside.select("term_id", "chunk_id", "occ_id", F.col("sense").cast("long").alias("sense")).join(protos.select("term_id", "sense", "proto_id"), ["term_id", "sense"]).drop("sense")
    noise = labelled.where("sense < 0").select("term_id", "chunk_id", "occ_id", "embed")
    found = attach(noise, protos).select("term_id", "chunk_id", "occ_id", "proto_id", F.lit(True).alias("anomaly"))
    return protos, members.select("term_id", "chunk_id", "occ_id", "proto_id", F.lit(False).alias("anomaly")).unionByName(found)


def attach(occurrences: DataFrame, protos: DataFrame) -> DataFrame:
    """Each occurrence with the nearest prototype of its term: proto_id, sim, and whether it reaches that prototype's threshold."""
    pairs = occurrences.join(protos.select("term_id", "proto_id", "centre"), "term_id").withColumn("sim", V.cosine(F.col("embed"), F.col("centre")))
    best = vectors.nearest(pairs, ["term_id", "chunk_id", "occ_id"], "proto_id")
    return best.join(protos.select("proto_id", "threshold"), "proto_id").withColumn("fits", F.col("sim") >= F.col("threshold"))


def built(training: DataFrame, percentile: float = PERCENTILE, tau: float = TAU, min_cluster_size: int | None = None, keep: Keep | None = None) -> DataFrame:
    """Training occurrences with a cluster: terms that have senses are clustered, all others (cluster -1) get a basic prototype.

    training: (term_id, chunk_id, occ_id, embed), full (whether the buffer filled) and kind if there is one: a phrase is always clustered
    when its buffer fills, a token only if its occurrences do not concentrate."""
    keep = keep_or(keep, training)
    is_token = F.col("kind") == "token" if "kind" in training.columns else F.lit(True)
    full = training.where("full")
    c = keep(vectors.centres(full, "term_id"))
    conc = vectors.similarities(full.select("term_id", "embed"), c, "term_id").groupBy("term_id").agg(F.avg("sim").alias("concentration"))
    wide = is_semantic(conc, tau).where("is_semantic").select("term_id", F.lit(True).alias("wide"))
    t = training.join(keep(wide), "term_id", "left").withColumn("splits", F.col("full") & (~is_token | F.coalesce("wide", F.lit(False))))
    found = cluster.clusters(t.where("splits"), "term_id", "chunk_id", "embed", min_cluster_size)
    return t.drop("wide", "splits").join(keep(found), ["term_id", "occ_id"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def indexed(occurrences: DataFrame, buffer_size: int = BUFFER, percentile: float = PERCENTILE, tau: float = TAU, min_cluster_size: int | None = None, keep: Keep | None = None) -> tuple[DataFrame, DataFrame]:
    """Several batches: (prototypes, members).  Prototypes come from the training part, several where a full buffer has senses; later
    occurrences attach; those that do not fit are anomalies, which finalisation gives to the nearest prototype all the same (column anomaly)."""
    keep = keep_or(keep, occurrences)
    o = keep(training_split(occurrences, buffer_size))
    protos, trained = from_labels(built(o.where("trains"), percentile, tau, min_cluster_size, keep), percentile, keep)
    later = attach(o.where("NOT trains"), protos).select("term_id", "chunk_id", "occ_id", "proto_id", (~F.col("fits")).alias("anomaly"))
    return protos, trained.unionByName(later)


def settled(anomalies: DataFrame, protos: DataFrame, min_cluster_size: int = 10, percentile: float = PERCENTILE) -> tuple[DataFrame, DataFrame]:
    """Anomalies gathered so far, clustered again: (new prototypes, members).  Each cluster is a new prototype, numbered after those there are;
    what is left, and all of a term without clusters, goes to the nearest prototype, new or old."""
    labelled = keep_or(None, anomalies)(anomalies.join(cluster.clusters(anomalies, "term_id", "chunk_id", "embed", min_cluster_size), ["term_id", "occ_id"]))
    inside = labelled.where("cluster >= 0")
    new, members = from_labels(inside, percentile)
    base = protos.agg((F.coalesce(F.max("proto_id"), F.lit(-1)) + 1).alias("base"))
    shift = lambda d: d.crossJoin(F.broadcast(base)).withColumn("proto_id", F.col("proto_id") + F.col("base")).drop("base")
    new = shift(new)
    both = protos.select("term_id", "proto_id", "centre", "threshold").unionByName(new.select("term_id", "proto_id", "centre", "threshold"))
    rest = attach(labelled.where("cluster < 0").select("term_id", "chunk_id", "occ_id", "embed"), both).select("term_id", "chunk_id", "occ_id", "proto_id", F.lit(True).alias("anomaly"))
    return new, shift(members).unionByName(rest)
