"""Redirect and synonym index: build, resolve, synonyms, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T


def redirect_pairs(page: DataFrame, redirect: DataFrame) -> DataFrame:
    """Inner join of redirect pages (namespace 0) with their targets.  Of several targets of a page the last (greatest seq) wins."""
    last = redirect.where("namespace = 0").groupBy("page_id").agg(F.max_by("target_title", "seq").alias("canonical"))
    return page.where("namespace = 0 AND is_redirect = 1").join(last, "page_id").select(F.col("title").alias("redirect"), "canonical")


def index_pairs(pairs: DataFrame, redirect: Column | None = None, canonical: Column | None = None) -> DataFrame:
    """Normalised pairs that an index keeps: not empty, ASCII, with a letter, not to themselves."""
    r, c = (F.col("redirect") if redirect is None else redirect), (F.col("canonical") if canonical is None else canonical)
    p = pairs.where(r.isNotNull() & c.isNotNull() & ~T.contains_non_ascii(r) & ~T.contains_non_ascii(c))
    p = p.withColumns({"r": T.ascii_title(r), "c": T.ascii_title(c)})
    return p.where(T.should_keep_title(F.col("r")) & T.should_keep_title(F.col("c")) & (F.col("r") != F.col("c")))


def redirect_map(kept: DataFrame) -> DataFrame:
    """bucket, redirect, canonical: the last pair of a redirect wins.  kept: (r, c, seq)."""
    m = kept.groupBy("r").agg(F.max_by("c", "seq").alias("canonical"))
    return m.select(T.bucket_key(F.col("r")).alias("bucket"), F.col("r").alias("redirect"), "canonical")


def canonical_map(kept: DataFrame) -> DataFrame:
    """bucket, canonical, redirects (sorted, distinct)."""
    m = kept.select("r", "c").distinct().groupBy("c").agg(F.sort_array(F.collect_list("r")).alias("redirects"))
    return m.select(T.bucket_key(F.col("c")).alias("bucket"), F.col("c").alias("canonical"), "redirects")


def resolve(titles: DataFrame, redirects: DataFrame, canonicals: DataFrame, col: str = "title") -> DataFrame:
    """title, resolved: one hop; a redirect has priority, then a canonical title itself; else null."""
    q = titles.withColumn("n", T.normalize_title(F.col(col)))
    q = q.join(redirects.select(F.col("redirect").alias("n"), F.col("canonical").alias("by_redirect")), "n", "left")
    q = q.join(canonicals.select(F.col("canonical").alias("n"), F.col("canonical").alias("itself")), "n", "left")
    return q.select(col, F.coalesce("by_redirect", "itself").alias("resolved"))


def synonyms(titles: DataFrame, redirects: DataFrame, canonicals: DataFrame, col: str = "title", include_canonical: bool = True) -> DataFrame:
    """title, synonyms: the canonical title and its redirects; unknown titles have none."""
    r = resolve(titles, redirects, canonicals, col).join(canonicals.select(F.col("canonical").alias("resolved"), "redirects"), "resolved", "left")
    own = F.concat(F.array("resolved"), F.coalesce("redirects", F.array().cast("array<string>"))) if include_canonical else F.coalesce("redirects", F.array().cast("array<string>"))
    return r.select(col, F.when(F.col("resolved").isNull(), F.array().cast("array<string>")).otherwise(own).alias("synonyms"))


def closure(redirects: DataFrame, hops: int = 10) -> DataFrame:
    """redirect, canonical followed through chains of exactly up to `hops` steps (a cycle stops where the steps end).  An option beside the one-hop rule.

    Steps of 1, 2, 4, ... are made by joining a step with itself, and those that add up to `hops` are taken one after the other."""
    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        on = second.select(F.col("redirect").alias("via"), F.col("canonical").alias("further"))
        return first.join(on, F.col("canonical") == F.col("via"), "left").select("redirect", F.coalesce("further", "canonical").alias("canonical"))

    step, out = redirects.select("redirect", "canonical"), None
    while hops > 0:
        if hops % 2:
            out = step if out is None else then(out, step)
        hops //= 2
        if hops:
            step = then(step, step)
    return redirects.select("redirect", F.col("redirect").alias("canonical")) if out is None else out


def stats(kept: DataFrame) -> DataFrame:
    """inserted (before dedup), redirects (after), canonicals: one row."""
    return kept.agg(F.count("*").alias("inserted"), F.count_distinct("r").alias("redirects"), F.count_distinct("c").alias("canonicals"))


def bucket_sizes(redirects: DataFrame) -> DataFrame:
    return redirects.groupBy("bucket").agg(F.count("*").alias("n"))
