"""Vector operators over tables: centres, similarity to centres, nearest prototypes, attention."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import vectors as V
from spanloom.operators import encoding


def centres(occurrences: DataFrame, key: str, embed: str = "embed") -> DataFrame:
    """key, centre: normalised mean of normalised members.  Sums run by (key, place), so a hot key combines before the shuffle."""
    unit = occurrences.select(key, F.posexplode(V.normalized(F.col(embed))).alias("i", "x"))
    mean = unit.groupBy(key, "i").agg(F.avg("x").alias("x"))
    v = mean.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p"))  # one entry a dimension
    return v.select(key, V.normalized(F.transform("p", lambda p: p["x"])).alias("centre"))


def similarities(occurrences: DataFrame, prototypes: DataFrame, key: str, embed: str = "embed", centre: str = "centre") -> DataFrame:
    """Every occurrence with its cosine to its key's prototypes."""
    return occurrences.join(prototypes, key).withColumn("sim", V.cosine(F.col(embed), F.col(centre)))


def threshold(sims: DataFrame, key: str, percentile: float = 0.9) -> DataFrame:
    """key, threshold: the (1 - percentile) quantile of similarities, interpolated."""
    return sims.groupBy(key).agg(F.percentile("sim", F.lit(1 - percentile)).alias("threshold"))


def concentration(sims: DataFrame, key: str) -> DataFrame:
    """key, concentration: mean cosine of members to their centre."""
    return sims.groupBy(key).agg(F.avg("sim").alias("concentration"))


def nearest(pairs: DataFrame, by: list[str], proto: str, sim: str = "sim") -> DataFrame:
    """The best prototype of each group; of equals (to nine places) the smallest id."""
    best = F.max_by(F.col(proto), F.struct(F.round(sim, 9), -F.col(proto)))
    return pairs.groupBy(*by).agg(best.alias(proto), F.max(sim).alias("sim"))


def top(pairs: DataFrame, by: list[str], proto: str, k: int, sim: str = "sim") -> DataFrame:
    w = f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY round({sim}, 9) DESC, {proto}) AS rank"
    return pairs.selectExpr("*", w).where(F.col("rank") <= k)


#: Bytes of query vectors that go with the tasks at a time.
BLOCK_BYTES = 16 << 20


def blocks(queries: DataFrame, id_col: str, embed: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of a stated query set, in blocks of about BLOCK_BYTES by a hash of the id, each in order of the ids."""
    n, dims = queries.agg(F.count("*"), F.max(F.size(embed))).first()
    parts = max(1, -(-n * (dims or 1) * 8 // BLOCK_BYTES))
    for part in range(parts if n else 0):
        rows = (queries if parts == 1 else queries.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == part)).select(id_col, embed).collect()
        rows.sort(key=lambda r: r[0])
        if rows:
            m = np.array([r[1] for r in rows], dtype=float)
            yield np.array([r[0] for r in rows]), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def unit_rows(embeds: pd.Series) -> np.ndarray:
    p = np.stack(embeds.to_numpy()).astype(float)
    return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)


def against(queries: DataFrame, prototypes: DataFrame, k: int | None = None) -> DataFrame:
    """A stated query set with all prototypes, by matrix products over Arrow batches: q_id, proto_id, sim.

    queries: (q_id, q_embed); prototypes: (proto_id, centre).  k: of each batch only what may be among a query's k best leaves it (ties to
    nine places included), so that what is shuffled afterwards does not grow with queries times prototypes."""
    out = prototypes.sparkSession.createDataFrame([], "q_id long, proto_id long, sim double")
    for ids, m in blocks(queries, "q_id", "q_embed"):

        def block(batches: Iterator[pd.DataFrame], ids=ids, m=m) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    s = m @ unit_rows(b["centre"]).T
                    if k is None or k >= len(b):
                        q, p = np.indices(s.shape).reshape(2, -1)
                    else:
                        r = np.round(s, 9)
                        q, p = np.nonzero(r >= -np.partition(-r, k - 1, axis=1)[:, k - 1 : k])
                    yield pd.DataFrame({"q_id": ids[q], "proto_id": b["proto_id"].to_numpy()[p], "sim": s[q, p]})

        out = out.union(prototypes.select("proto_id", "centre").mapInPandas(block, "q_id long, proto_id long, sim double"))
    return out


def nearest_of(records: DataFrame, queries: DataFrame) -> DataFrame:
    """rec_id, q_id, sim: for each record the best of each block of queries (of equals the smallest id); a row a record and block.

    records: (rec_id, embed); queries: (q_id, q_embed)."""
    out = records.sparkSession.createDataFrame([], "rec_id long, q_id long, sim double")
    for ids, m in blocks(queries, "q_id", "q_embed"):

        def block(batches: Iterator[pd.DataFrame], ids=ids, m=m) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    s = unit_rows(b["embed"]) @ m.T
                    at = np.round(s, 9).argmax(axis=1)
                    yield pd.DataFrame({"rec_id": b["rec_id"].to_numpy(), "q_id": ids[at], "sim": s[np.arange(len(b)), at]})

        out = out.union(records.select("rec_id", "embed").mapInPandas(block, "rec_id long, q_id long, sim double"))
    return out


def attention_alignment(query: Column, key: Column) -> Column:
    """Mean cosine of each query vector with its attended key vectors; 0 if either is empty.  Vectors arrive as flat Arrow buffers."""

    def matrices(col: pa.Array) -> Iterator[np.ndarray]:
        for x in col:
            own = x.values if x.is_valid else None
            yield np.zeros((0, 1)) if own is None or not len(own) else own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)

    @F.arrow_udf("double")
    def align(q: pa.Array, k: pa.Array) -> pa.Array:
        return pa.array([encoding.alignment(a, b) for a, b in zip(matrices(q), matrices(k), strict=True)], pa.float64())

    return align(query.cast("array<array<double>>"), key.cast("array<array<double>>"))


def context_window(target: Column, window: Column, last: Column) -> Column:
    """Indices of a context of `window` tokens around the target's indices, clipped to [0, last]."""
    return F.sequence(F.greatest(F.lit(0), F.array_min(target) - window), F.least(last, F.array_max(target) + window))


def salience(tokens: DataFrame, by: str, embed: str = "embed") -> DataFrame:
    """Each token's cosine to its text's mean vector.  tokens: (by, pos, embed)."""
    means = tokens.select(by, F.posexplode(V.doubles(F.col(embed))).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"))
    means = means.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    return tokens.join(means, by).withColumn("salience", V.cosine(F.col(embed), F.col("mean"))).drop("mean")


def combined_similarity(members: DataFrame, r: int = 3) -> DataFrame:
    """proto_id, chunk_id, sim: the mean of the r best similarities of a prototype's occurrences in each chunk.  members: (proto_id, chunk_id, sim)."""
    n = members.selectExpr("*", "row_number() OVER (PARTITION BY proto_id, chunk_id ORDER BY sim DESC) AS n")
    return n.where(F.col("n") <= r).groupBy("proto_id", "chunk_id").agg(F.avg("sim").alias("sim"))


def sorted_places(values: Column) -> Column:
    """Places (from 0) of an array's values in ascending order; of equals the first place first."""
    return F.transform(F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda x: x["i"])
