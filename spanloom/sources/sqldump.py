"""SQL dump files: INSERT lines, value tuples, typed values.  A .gz file is one task; split dumps into several files to read them in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "array<struct<text:string,quoted:boolean>>"


def insert_values(spark: SparkSession, path: str, table: str) -> DataFrame:
    """seq, values: what follows VALUES on each INSERT line of the table, without the final semicolon."""
    start = f"INSERT INTO `{table}` VALUES "
    lines = spark.read.text(path).where(F.col("value").startswith(start))
    return lines.select(F.monotonically_increasing_id().alias("line"), F.regexp_replace(F.substring("value", len(start) + 1, 2**31 - 1), r";\s*$", "").alias("values"))


def split_values(values: str) -> list[list[tuple[str, bool]]]:
    """The tuples of a VALUES list: (text, quoted) for each value.  In quotes, \\x is x and '' is '."""
    rows: list[list[tuple[str, bool]]] = []
    row: list[tuple[str, bool]] | None = None
    buf: list[str] = []
    quoted = False
    i, n = 0, len(values)
    while i < n:
        c = values[i]
        if row is None:
            if c == "(":
                row, buf, quoted = [], [], False
        elif c == "'":
            quoted = True
            i += 1
            while i < n:
                if values[i] == "\\" and i + 1 < n:
                    i += 1
                elif values[i] == "'":
                    if values[i + 1 : i + 2] != "'":
                        break
                    i += 1
                buf.append(values[i])
                i += 1
        elif c in ",)":
            row.append(("".join(buf) if quoted else "".join(buf).strip(), quoted))
            buf, quoted = [], False
            if c == ")":
                rows.append(row)
                row = None
        else:
            buf.append(c)
        i += 1
    return rows


def tuples(lines: DataFrame) -> DataFrame:
    """line, n, row: every tuple of every line in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for line, values in zip(b["line"], b["values"], strict=True):
                rows = split_values(values or "")
                yield pd.DataFrame({"line": line, "n": range(len(rows)), "row": [[{"text": t, "quoted": q} for t, q in r] for r in rows]}, columns=["line", "n", "row"])

    return lines.select("line", "values").mapInPandas(run, f"line long, n long, row {ROW}")


def value(row: Column, i: int) -> Column:
    """The i-th value (from 0): NULL is null, underscores of text are spaces.  Quoted text is never NULL or a number, whatever it says."""
    v = F.get(row, i)
    text = F.translate(v["text"], "_", " ")
    return F.when(v.isNull() | (~v["quoted"] & (F.upper(v["text"]) == "NULL")), F.lit(None)).otherwise(text)


def number(row: Column, i: int) -> Column:
    return F.get(row, i)["text"].try_cast("long")


def pages(rows: DataFrame) -> DataFrame:
    """page_id, namespace, title, is_redirect; shorter rows are left out."""
    r = F.col("row")
    return rows.where(F.size("row") >= 4).select(number(r, 0).alias("page_id"), number(r, 1).alias("namespace"), value(r, 2).alias("title"), number(r, 3).alias("is_redirect"))


def redirects(rows: DataFrame) -> DataFrame:
    """page_id, namespace, target_title, seq; shorter rows are left out."""
    r = F.col("row")
    return rows.where(F.size("row") >= 3).select(number(r, 0).alias("page_id"), number(r, 1).alias("namespace"), value(r, 2).alias("target_title"), F.struct("line", "n").alias("seq"))
