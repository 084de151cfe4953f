"""Text functions as Column expressions (ASCII rules unless said otherwise)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Patterns of protected text.  (fixed values)
ACRONYM = r"\b[A-Z]{2,}\b"
TITLE_RUN = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
#: The symbols a title may keep beside letters, digits and spaces.  (fixed value)
TITLE_KEEPS = "[^A-Za-z0-9 '&/.-]"
ARTICLES = ("the", "a", "an")


def squeeze(c: Column) -> Column:
    """Drops line-end hyphenation, makes every run of white space one space, trims."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "-\n", ""), r"\s+", " "))


def clean_basic(c: Column) -> Column:
    return F.lower(F.regexp_replace(squeeze(c), "[\"']", ""))


#: A letter, digit or underscore of any script: what the boundaries of both patterns go by, whatever the regex engine's own \\b does.
WORD = r"[\p{L}\p{N}_]"
#: The two patterns for the JVM: repeats are possessive, which match the same here (no word can end earlier) but run as loops.  Java's
#: plain repeats of groups recurse once a repeat, and a few thousand capitalised words in a row would end the executor's stack.
JVM_ACRONYM = rf"(?<!{WORD})[A-Z]{{2,}}+(?!{WORD})"
JVM_TITLE_RUN = rf"(?<!{WORD})[A-Z][a-z]++(?:\s++[A-Z][a-z]++(?!{WORD}))++"
PROTECTED = f"{JVM_ACRONYM}|{JVM_TITLE_RUN}"


def clean_text(c: Column) -> Column:
    """Lower case without quotes, except that acronyms and runs of capitalised words stay as they are.

    The text is cut at protected spans, so a protected word never changes its like inside another word."""
    t = squeeze(c)
    plain = lambda x: F.lower(F.translate(x, "\"'", ""))
    pieces = F.zip_with(F.split(t, PROTECTED), F.regexp_extract_all(t, F.lit(PROTECTED), F.lit(0)), lambda gap, kept: F.concat(plain(gap), F.coalesce(kept, F.lit(""))))
    return F.trim(F.array_join(pieces, ""))


def acronyms(c: Column) -> Column:
    return F.regexp_extract_all(squeeze(c), F.lit(JVM_ACRONYM), F.lit(0))


def title_runs(c: Column) -> Column:
    return F.regexp_extract_all(squeeze(c), F.lit(JVM_TITLE_RUN), F.lit(0))


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def count_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def all_words_are_digits(c: Column) -> Column:
    return (F.size(words(c)) > 0) & F.forall(words(c), lambda w: w.rlike("^[0-9]+$"))


def normalize_phrase(c: Column) -> Column:
    """Drops one leading article; lowers every word that has no two capitals in a row."""
    ws = words(c)
    rest = F.when((F.size(ws) > 0) & F.lower(F.try_element_at(ws, F.lit(1))).isin(*ARTICLES), F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0)))).otherwise(ws)
    return F.array_join(F.transform(rest, lambda w: F.when(w.rlike("[A-Z]{2,}"), w).otherwise(F.lower(w))), " ")


def strip_parens(c: Column) -> Column:
    """Innermost parentheses become a space, as often as there are any: two rounds at once, more only for texts that nest deeper."""
    pair = r"\([^()]*\)|（[^（）]*）"
    c = F.regexp_replace(F.regexp_replace(c, pair, " "), pair, " ")
    opens = F.length(c) - F.length(F.translate(c, "(（", ""))
    return F.when(c.rlike(pair), F.aggregate(F.sequence(F.lit(1), opens), c, lambda a, _: F.regexp_replace(a, pair, " "))).otherwise(c)


def ascii_title(c: Column) -> Column:
    """normalize_title for ASCII titles, in built-in functions only."""
    c = strip_parens(F.lower(F.translate(F.trim(c), "_", " ")))
    return F.trim(F.regexp_replace(F.translate(F.regexp_replace(c, TITLE_KEEPS, " "), ".", " "), r"\s+", " "))


@F.arrow_udf(StringType())
def _fold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """NFKC and case folding, which Spark has no function for."""
    for col in batches:
        yield pa.array([None if t is None else unicodedata.normalize("NFKC", t.strip().replace("_", " ")).casefold() for t in col.to_pylist()], pa.string())


def normalize_title(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7F]"), ascii_title(_fold(c))).otherwise(ascii_title(c))


def should_keep_title(normalized: Column) -> Column:
    return F.coalesce(normalized.rlike("[a-z]"), F.lit(False))


def contains_non_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def bucket_key(normalized: Column) -> Column:
    """The first two letters or digits, filled up with underscores."""
    return F.rpad(F.substring(F.regexp_replace(normalized, "[^A-Za-z0-9]", ""), 1, 2), 2, "_")


def overlap_terms(c: Column) -> Column:
    """Distinct lower-case words of more than two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z0-9_\-]*"), F.lit(0)), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def subject_span(c: Column, subject: Column) -> Column:
    """(start, end) of a squeezed subject in a text whatever its case; null if it is blank or not there."""
    s = squeeze(subject)
    at = F.call_function("instr", F.lower(c), F.lower(s))
    return F.when((s != "") & (at > 0), F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(s)).cast("int").alias("end")))


def mark_target(c: Column, start: Column, end: Column, mark: str = "[TGT]") -> Column:
    """The text with the span [start, end) between marks, and the span's new place."""
    before, target, after = F.substr(c, F.lit(1), start), F.substr(c, start + 1, end - start), F.substr(c, end + 1)
    shift = len(mark) + 1
    return F.struct(F.concat(before, F.lit(f"{mark} "), target, F.lit(f" {mark}"), after).alias("text"), (start + shift).alias("start"), (end + shift).alias("end"))


def resolve_span(c: Column, target: Column, start: Column, end: Column) -> Column:
    """A given span if it holds the target, else the first occurrence, else the first whole-word one whatever its case; null if none."""
    exact = F.substr(c, start + 1, end - start) == target
    first = F.call_function("instr", c, target)
    folded = F.call_function("regexp_instr", c, F.concat(F.lit(r"(?i)(?<!\w)"), F.regexp_replace(target, r"([\\\[\](){}.*+?^$|])", r"\\$1"), F.lit(r"(?!\w)")))
    at = F.when(F.coalesce(exact, F.lit(False)), start).when(first > 0, first - 1).when(folded > 0, folded - 1)
    return F.when(at.isNotNull(), F.struct(at.cast("int").alias("start"), (at + F.length(target)).cast("int").alias("end")))


def sentence_of_span(c: Column, start: Column, end: Column) -> Column:
    """From after the last .?! before the span to the next after it; a blank result gives the whole text."""
    lead = F.regexp_extract(F.substr(c, F.lit(1), start), r"([^.?!]*)$", 1)
    tail = F.regexp_extract(F.substr(c, end + 1), r"^([^.?!]*[.?!]?)", 1)
    s = F.trim(F.concat(lead, F.substr(c, start + 1, end - start), tail))
    return F.when(s == "", F.trim(c)).otherwise(s)


def sentences(c: Column) -> Column:
    """Rule-based sentences: up to .!? with the white space after it cut off."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def sentence_with(sents: Column, term: Column, text: Column) -> Column:
    """The first sentence that holds the term whatever its case, else the first, else the text."""
    hit = F.filter(sents, lambda s: F.lower(s).contains(F.lower(term)))
    return F.coalesce(F.try_element_at(hit, F.lit(1)), F.try_element_at(sents, F.lit(1)), text)
