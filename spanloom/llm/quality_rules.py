"""Quality rules with adaptive thresholds.

Integer metrics of every whole text are summarised by mergeable log-bucket quantile sketches (relative
error under 2 %) for each language and source; fences drawn from their quartiles replace fixed cutoffs,
and are joined back to the metrics.  All of it is DataFrame expressions; the text is read once.

A group's fences lean on its language's (the sketches merged over all its sources) by the weight of PRIOR documents, so that a group of a few
documents has nearly its language's fences, a large one its own, and no size changes them at once.

A sketch is rows (group, metric, bucket, count, largest value); two sketches merge by adding counts, so
Spark's partial aggregation merges them before any shuffle and a hot source costs no more than others.

Defined results: a null or blank text has no words, all counts 0, and fails the base rules; null lang or
source is a group of its own; repeated rows are judged alike; an empty table gives an empty result; other
columns of the input are ignored whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage, words_in

SYMBOLS = "#*$%&|<>"
GAMMA = 1.02
#: Weight, in documents, of a language's fences beside those of a group.
PRIOR = 50
#: metric -> least distance from the median to the upper fence; the lower fence exists for mean_len only.
SLACK = {"symbol": 50, "upper": 200, "repeat": 200, "dup_line": 400, "mean_len": 30}
LOWER_SLACK = {"mean_len": 20}
#: Interquartile ranges beyond the quartile.
FENCE = 4


def metrics(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """Counts for every document: the base columns, n_lines and n_upper."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    d = d.withColumn("w", words_in(F.col("t")))
    d = d.withColumn("n", F.size("w"))
    d = d.withColumn("h", F.expr("CASE WHEN n >= 3 THEN transform(sequence(0, n - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) ELSE array() END"))
    d = d.withColumn("lines", F.expr(rf"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    # Only texts in which some window repeats are sorted; equal hashes then stand side by side.
    d = d.withColumn("s", F.expr("CASE WHEN size(h) > size(array_distinct(h)) THEN sort_array(transform(h, (x, i) -> struct(x AS h, i AS i))) ELSE array() END"))
    d = d.withColumn("dup", F.expr("filter(s, (x, k) -> (k > 0 AND s[greatest(k - 1, 0)].h = x.h) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = x.h))"))
    def without(chars: str):
        return F.length(F.regexp_replace("t", f"[{chars}]+", ""))

    return d.select(
        "doc_id", "lang", "source",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - without(SYMBOLS)).cast("long").alias("n_symbols"),
        F.expr("CAST(size(lines) - size(array_distinct(lines)) AS LONG)").alias("n_dup_lines"),
        F.expr("CAST(size(array_distinct(flatten(transform(dup, x -> array(x.i, x.i + 1, x.i + 2))))) AS LONG)").alias("n_repeat_words"),
        F.expr("CAST(size(lines) AS LONG)").alias("n_lines"),
        (F.length("t") - without("A-Z")).cast("long").alias("n_upper"),
    )


#: Integer values that the fences judge: parts per thousand, and tenths of a character.
VALUES = {
    "symbol": "1000 * n_symbols div greatest(word_chars, 1)",
    "upper": "1000 * n_upper div greatest(word_chars, 1)",
    "repeat": "1000 * n_repeat_words div greatest(n_words, 1)",
    "dup_line": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "mean_len": "10 * word_chars div greatest(n_words, 1)",
}


def sketch(m: DataFrame, by: list[str]) -> DataFrame:
    """The log-bucket sketch of each metric for each group of documents that pass the base rules."""
    rows = m.where("NOT base_failed").select(*by, F.expr("stack({}, {}) AS (metric, v)".format(len(VALUES), ", ".join(f"'{k}', {v}" for k, v in VALUES.items()))))
    return rows.groupBy(*by, "metric", F.expr(f"CASE WHEN v = 0 THEN -1 ELSE CAST(ceil(ln(v) / {math.log(GAMMA)!r}) AS INT) END").alias("bucket")).agg(F.count("*").alias("n"), F.max("v").alias("top"))


def fences(sk: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group: hi_<metric> and lo_<metric>, and the documents n_docs it rests on."""
    keys = ", ".join([*by, "metric"])
    cum = sk.withColumn("below", F.expr(f"sum(n) OVER (PARTITION BY {keys} ORDER BY bucket)")).withColumn("all_n", F.expr(f"sum(n) OVER (PARTITION BY {keys})"))
    q = cum.groupBy(*by, "metric").agg(F.max("all_n").alias("n_docs"), *[F.min(F.when(F.col("below") * 4 >= F.col("all_n") * k, F.col("top"))).alias(f"q{k}") for k in (1, 2, 3)])
    out = []
    for k, slack in SLACK.items():
        hit = F.col("metric") == k
        out.append(F.max(F.when(hit, F.greatest(F.col("q3") + FENCE * (F.col("q3") - F.col("q1")), F.col("q2") + slack))).alias(f"hi_{k}"))
        if k in LOWER_SLACK:
            out.append(F.max(F.when(hit, F.least(F.col("q1") - FENCE * (F.col("q3") - F.col("q1")), F.col("q2") - LOWER_SLACK[k]))).alias(f"lo_{k}"))
    return q.groupBy(*by).agg(F.max("n_docs").alias("n_docs"), *out)


#: A fence between that of the group and that of its language, the nearer to its own the more documents it has.
BLEND = "(CAST(o.n_docs AS DOUBLE) * o.{n} + " + str(PRIOR) + " * CAST(p.{n} AS DOUBLE)) / (o.n_docs + " + str(PRIOR) + ")"


def judge(docs: DataFrame, **columns: str) -> DataFrame:
    """Every document with its metrics, base_failed, and kept (within all fences of its group)."""
    m = stage(
        metrics(docs, **columns).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")), "quality-metrics"
    )
    sk = stage(sketch(m, ["lang", "source"]), "quality-sketch")
    own = fences(sk, ["lang", "source"])
    pooled = fences(sk.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"), F.max("top").alias("top")), ["lang"])
    names = [f"hi_{k}" for k in SLACK] + [f"lo_{k}" for k in LOWER_SLACK]
    g = own.alias("o").join(pooled.alias("p"), F.expr("o.lang <=> p.lang"))
    limits = small(stage(g.selectExpr("o.lang", "o.source", *[f"{BLEND.format(n=n)} AS {n}" for n in names]), "quality-fences"))
    within = [F.expr(VALUES[k]) <= F.col(f"hi_{k}") for k in SLACK] + [F.expr(VALUES[k]) >= F.col(f"lo_{k}") for k in LOWER_SLACK]
    ok = within[0]
    for c in within[1:]:
        ok = ok & c
    joined = m.alias("m").join(limits.alias("l"), F.expr("m.lang <=> l.lang AND m.source <=> l.source"), "left")
    return joined.select("m.*", *[f"l.{n}" for n in names], (~F.col("base_failed") & F.coalesce(ok, F.lit(True))).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    vals = {k: v.replace(" div ", " // ") for k, v in VALUES.items()}
    rows = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {v} AS v FROM m WHERE NOT base_failed" for k, v in vals.items())

    def limits(by: str, src: str) -> str:
        hi = ", ".join(f"max(CASE WHEN metric = '{k}' THEN greatest(q3 + {FENCE} * (q3 - q1), q2 + {s}) END) AS hi_{k}" for k, s in SLACK.items())
        lo = ", ".join(f"max(CASE WHEN metric = '{k}' THEN least(q1 - {FENCE} * (q3 - q1), q2 - {s}) END) AS lo_{k}" for k, s in LOWER_SLACK.items())
        qs = ", ".join(f"min(CASE WHEN below * 4 >= all_n * {k} THEN top END) AS q{k}" for k in (1, 2, 3))
        return f"""SELECT {by}, max(n_docs) AS n_docs, {hi}, {lo} FROM (SELECT {by}, metric, max(all_n) AS n_docs, {qs} FROM (
            SELECT *, sum(n) OVER (PARTITION BY {by}, metric ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {by}, metric) AS all_n FROM {src})
            GROUP BY {by}, metric) GROUP BY {by}"""

    names = [f"hi_{k}" for k in SLACK] + [f"lo_{k}" for k in LOWER_SLACK]
    ok = " AND ".join([f"({vals[k]}) <= hi_{k}" for k in SLACK] + [f"({vals[k]}) >= lo_{k}" for k in LOWER_SLACK])
    return rf"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
    h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
    r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id),
    m0 AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
    m AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m0),
    sk AS (SELECT lang, source, metric, CASE WHEN v = 0 THEN -1 ELSE CAST(ceil(ln(v) / {math.log(GAMMA)!r}) AS INT) END AS bucket, count(*) AS n, max(v) AS top FROM ({rows}) GROUP BY ALL),
    own AS ({limits("lang, source", "sk")}),
    skl AS (SELECT lang, metric, bucket, sum(n) AS n, max(top) AS top FROM sk GROUP BY ALL),
    pooled AS ({limits("lang", "skl")}),
    lim AS (SELECT o.lang, o.source, {", ".join(f"{BLEND.format(n=n)} AS {n}" for n in names)} FROM own o JOIN pooled p ON o.lang IS NOT DISTINCT FROM p.lang)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND coalesce({ok}, true)) AS kept
    FROM m LEFT JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source"""
