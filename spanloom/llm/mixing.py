"""Mixing sources to target weights by hash-threshold histograms.

Every document draws 60 bits from a hash of its id.  A source that must give the share f of its words takes
the documents whose draw is at or under a threshold.  Thresholds come from histograms: words are summed by
source and the draw's next ten bits, the bucket in which the budget ends is found, and only that bucket is
refined, until few documents are left in it.  Nothing is sorted but those few, and rows are taken by a filter.

The threshold ends before the first document that would overrun the budget; a second, nested threshold
over documents of at most half the rest fills what is left, unless taking that document comes nearer.  Shares over
1 are whole repeats of a source plus a threshold for the fraction.

Defined results: null or blank texts have size 0; null source is a source of its own and ranks last; rows that
share an id share a draw and are taken or left together; an empty source or table has target 0; the same
table gives the same mix; other columns are kept as they are by mix() and ignored by plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
DRAW_BITS, LEVEL_BITS = 60, 10
#: A boundary bucket with at most this many documents is settled by their running sum.
LEAF = 512


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, DRAW_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """source, source_size, target and base (whole repeats) from (source, source_size): one row a source."""
    w = "element_at(array({}), CAST((rank - 1) % {} + 1 AS INT))".format(", ".join(map(str, weights)), len(weights))
    d = sizes.selectExpr("source", "source_size", "row_number() OVER (ORDER BY source NULLS LAST) AS rank").selectExpr("*", f"{w} AS weight")
    d = d.selectExpr("*", f"{MOST_REPEATS} * source_size AS cap", f"row_number() OVER (ORDER BY {MOST_REPEATS} * source_size / weight, rank) AS idx")
    d = d.selectExpr(
        "*",
        "(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(weight) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lam",
    )
    d = d.selectExpr("*", "min(CASE WHEN weight * lam <= cap THEN struct(idx, lam) END) OVER () AS free")
    d = d.selectExpr("source", "source_size", "CASE WHEN free IS NULL OR weight * free.lam > cap THEN CAST(cap AS DOUBLE) ELSE weight * free.lam END AS target")
    return d.selectExpr("*", "CASE WHEN source_size = 0 THEN 0L ELSE CAST(floor(target / source_size) AS BIGINT) END AS base")


def thresholds(cands: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source of budgets (source, budget): the last draw t whose documents fit, their words, and the next document.

    Returns source, t, got, next_draw, next_size (both null if all fit)."""
    state = stage(budgets.selectExpr("source", "budget", "0L AS prefix", "0L AS head", "-1L AS t"), "mix-state")
    for level in range(1, DRAW_BITS // LEVEL_BITS + 1):
        shift = DRAW_BITS - LEVEL_BITS * level
        s = small(state).alias("s")
        inside = cands.alias("c").join(s, F.expr(f"c.source <=> s.source AND shiftright(c.draw, {shift + LEVEL_BITS}) = s.head"))
        hist = inside.groupBy("c.source", F.expr(f"shiftright(c.draw, {shift})").alias("head")).agg(F.sum("c.size").alias("words"), F.count("*").alias("n"))
        cum = hist.alias("h").join(s, F.expr("h.source <=> s.source")).selectExpr("h.source", "s.budget", "h.head", "h.n", "h.words", "s.prefix + sum(h.words) OVER (PARTITION BY h.source ORDER BY h.head) AS upto")
        # Of the buckets, the first in which the budget ends; a source whose documents all fit has none and leaves.
        edge = cum.where("upto > budget").groupBy("source").agg(F.min(F.expr("struct(head, n, upto - words AS prefix, budget)")).alias("e"))
        state = stage(edge.selectExpr("source", "e.budget", "e.prefix", "e.head", f"shiftleft(e.head, {shift}) - 1 AS t", "e.n"), "mix-state")
        most = state.agg(F.max("n")).first()[0]
        if most is None or most <= LEAF:
            break
    s = small(state).alias("s")
    leaf = cands.alias("c").join(s, F.expr(f"c.source <=> s.source AND shiftright(c.draw, {shift}) = s.head")).groupBy("c.source", "budget", "prefix", "s.t", "draw").agg(F.sum("c.size").alias("words"))
    run = leaf.selectExpr("*", "prefix + sum(words) OVER (PARTITION BY source ORDER BY draw) AS upto")
    found = run.groupBy("source").agg(
        F.greatest(F.max("t"), F.max(F.expr("CASE WHEN upto <= budget THEN draw END"))).alias("t"),
        F.coalesce(F.max(F.expr("CASE WHEN upto <= budget THEN upto END")), F.max("prefix")).alias("got"),
        F.min(F.expr("CASE WHEN upto > budget THEN struct(draw, words) END")).alias("nxt"),
    )
    whole = cands.groupBy("source").agg(F.sum("size").alias("all_words"))
    return (
        budgets.alias("b").join(small(stage(found, "mix-found")).alias("f"), F.expr("b.source <=> f.source"), "left").join(small(stage(whole, "mix-whole")).alias("a"), F.expr("b.source <=> a.source"), "left")
        .selectExpr("b.source", f"CASE WHEN f.t IS NULL THEN shiftleft(1L, {DRAW_BITS}) ELSE f.t END AS t", "CASE WHEN f.t IS NULL THEN coalesce(all_words, 0L) ELSE got END AS got", "nxt.draw AS next_draw", "nxt.words AS next_size")
    )


def plan(narrow: DataFrame, weights=WEIGHTS) -> DataFrame:
    """One row a source with its target and thresholds, from staged rows (source, size, draw)."""
    per = stage(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    goal = stage(targets(per, weights), "mix-targets")
    budgets = goal.selectExpr("source", "target - base * source_size AS budget")
    first = stage(thresholds(narrow, budgets).alias("x").join(small(budgets).alias("b"), F.expr("x.source <=> b.source")).selectExpr("x.*", "budget - got AS rest"), "mix-first")
    spare = narrow.alias("c").join(small(first).alias("x"), F.expr("c.source <=> x.source AND c.draw > x.t AND 2 * c.size <= x.rest")).selectExpr("c.source", "c.size", "c.draw")
    second = stage(thresholds(stage(spare, "mix-spare"), first.where("next_draw IS NOT NULL").selectExpr("source", "rest AS budget")), "mix-second")
    return stage(
        goal.alias("g").join(first.alias("x"), F.expr("g.source <=> x.source"), "left").join(second.alias("y"), F.expr("g.source <=> y.source"), "left")
        .selectExpr(
            "g.source", "g.source_size", "g.target", "g.base", "x.t", "x.rest / 2 AS most", "x.next_draw",
            "coalesce(y.t, -1L) AS t2",
            "coalesce(x.next_size - x.rest < x.rest - coalesce(y.got, 0L), false) AS take_next",
        ),
        "mix-plan",
    )


#: How often a document is taken, from its size and draw and its source's plan.
REPEATS = "base + CASE WHEN draw <= t OR (take_next AND draw = next_draw) OR (NOT take_next AND draw > t AND size <= most AND draw <= t2) THEN 1 ELSE 0 END"


def narrow_of(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    return stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), draw_of(F.col(id_col)).alias("draw")), "mix-narrow")


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS) -> DataFrame:
    """The documents of the mix, with their own columns, each row as often as it is taken.  Texts are not shuffled."""
    p = small(plan(narrow_of(docs, id_col, text_col, source_col), weights))
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source_"), size_of(F.col(text_col)).alias("size"), draw_of(F.col(id_col)).alias("draw"))
    got = d.join(p, F.expr("source_ <=> source")).withColumn("times", F.expr(REPEATS)).where("times > 0")
    return got.select("row", F.explode(F.expr("sequence(1L, times)"))).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    n = narrow_of(docs)
    return n.alias("n").join(small(plan(n)).alias("p"), F.expr("n.source <=> p.source")).selectExpr("doc_id", "size", "source_size", "target", f"size * ({REPEATS}) AS taken")


def oracle() -> str:
    """The same mix by running sums over all documents in the order of their draws."""

    def found(cands: str, budgets: str) -> str:
        return f"""(SELECT b.source, CASE WHEN count(*) FILTER (WHERE upto > budget) = 0 THEN {1 << DRAW_BITS} ELSE coalesce(max(draw) FILTER (WHERE upto <= budget), -1) END AS t,
          coalesce(max(upto) FILTER (WHERE upto <= budget), 0) AS got, min(draw) FILTER (WHERE upto > budget) AS next_draw, arg_min(words, draw) FILTER (WHERE upto > budget) AS next_size, any_value(budget) AS budget
          FROM {budgets} b LEFT JOIN (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY draw) AS upto FROM (SELECT source, draw, sum(size) AS words FROM {cands} GROUP BY ALL)) c ON b.source IS NOT DISTINCT FROM c.source GROUP BY b.source)"""

    return rf"""WITH n AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, {DRAW_BITS // 4}))::BIGINT AS draw FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM n GROUP BY source),
    w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][CAST((rank - 1) % {len(WEIGHTS)} + 1 AS INT)] AS weight, {MOST_REPEATS} * source_size AS cap FROM s),
    i AS (SELECT *, row_number() OVER (ORDER BY cap / CAST(weight AS DOUBLE), rank) AS idx FROM w),
    l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(weight) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lam FROM i),
    f AS (SELECT arg_min(lam, idx) AS lam FROM l WHERE weight * lam <= cap),
    g AS (SELECT source, source_size, CASE WHEN f.lam IS NULL OR weight * f.lam > cap THEN CAST(cap AS DOUBLE) ELSE weight * f.lam END AS target FROM l, f),
    b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS base FROM g),
    bud AS (SELECT source, target - base * source_size AS budget FROM b),
    x AS (SELECT *, budget - got AS rest FROM {found("n", "bud")}),
    spare AS (SELECT n.source, size, draw FROM n JOIN x ON n.source IS NOT DISTINCT FROM x.source WHERE draw > t AND 2 * size <= rest),
    bud2 AS (SELECT source, rest AS budget FROM x WHERE next_draw IS NOT NULL),
    y AS {found("spare", "bud2")},
    p AS (SELECT b.*, x.t, x.rest / 2 AS most, x.next_draw, coalesce(y.t, -1) AS t2, coalesce(x.next_size - x.rest < x.rest - coalesce(y.got, 0), false) AS take_next
      FROM b LEFT JOIN x ON b.source IS NOT DISTINCT FROM x.source LEFT JOIN y ON b.source IS NOT DISTINCT FROM y.source)
    SELECT doc_id, size, source_size, target, CAST(size * ({REPEATS}) AS BIGINT) AS taken FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source"""
