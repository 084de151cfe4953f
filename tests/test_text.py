"""Literal cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions import vectors as V
from spanloom.operators import lexkg, senses, spans
from spanloom.sources import sqldump


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


CASES = [
    (T.clean_text, 'The quick-\nfox  met "John Smith" at NASA\'s HQ', "the quickfox met John Smith at NASAs HQ"),
    (T.clean_text, "US and USA", "US and USA"),
    (T.normalize_phrase, "The Big NASA Probe", "big NASA probe"),
    (T.normalize_phrase, "the", ""),
    (T.normalize_title, "Mercury_(planet (inner))", "mercury"),
    (T.normalize_title, "U.S.A.", "u s a"),
    (T.bucket_key, "u s a", "us"),
    (T.bucket_key, "x", "x_"),
    (T.bucket_key, "-", "__"),
    (T.should_keep_title, "1984", False),
    (T.should_keep_title, "r2", True),
    (T.count_words, " a  b\n c ", 3),
    (T.all_words_are_digits, "12 3", True),
    (T.all_words_are_digits, " ", False),
    (lexkg.article, "hour", "An"),
    (lexkg.article, "unicorn", "A"),
    (lexkg.article, "apple", "An"),
    (lexkg.article, "film", "A"),
    (lexkg.lookup_variants, "New-York", ["New-York", "New York", "New_York", "new-york", "new york", "new_york"]),
]


@pytest.mark.parametrize("f,given,expected", CASES, ids=[f"{f.__name__}-{g[:12]}" for f, g, _ in CASES])
def test_literal(spark, f, given, expected):
    assert one(spark, f(F.col("c")), c=given) == expected


def test_sentences_and_targets(spark):
    marked = one(spark, T.mark_target(F.col("c"), F.lit(2), F.lit(10)), c="a director spoke")
    assert (marked.text, marked.start, marked.end) == ("a [TGT] director [TGT] spoke", 8, 16)
    assert one(spark, T.sentence_of_span(F.col("c"), F.lit(9), F.lit(12)), c="One. Two cat here! Three.") == "Two cat here!"
    span = one(spark, T.resolve_span(F.col("c"), F.lit("Cat"), F.lit(0), F.lit(3)), c="a cat sat")
    assert (span.start, span.end) == (2, 5)
    assert one(spark, T.resolve_span(F.col("c"), F.lit("dog"), F.lit(0), F.lit(3)), c="a cat sat") is None
    assert one(spark, lexkg.definition_sentence(F.lit("film"), F.lit("n"), F.col("c")), c="a form of entertainment") == "A film is a form of entertainment."


def test_jaccard(spark):
    assert one(spark, senses.lexical_overlap(F.col("a"), F.col("b")), a="the cat sat", b="a cat ran") == 0.25


def test_weights():
    w = senses.merge_weights({"lexical_overlap": 1.1})
    assert [round(w[k], 3) for k in senses.WEIGHTS] == [0.175, 0.1, 0.175, 0.55]
    with pytest.raises(ValueError):
        senses.merge_weights(dict.fromkeys(senses.WEIGHTS, 0))


def test_spans(spark):
    pairs = [(0, 4), (0, 10), (5, 10), (12, 14), (12, 14)]
    arr = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in pairs])
    assert [(x.s, x.e) for x in one(spark, spans.drop_contained(arr))] == [(0, 10), (12, 14)]
    offsets = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in [(0, 0), (0, 5), (5, 7), (7, 12), (12, 13)]])
    assert one(spark, V.overlapping(offsets, F.lit(5), F.lit(9))) == [2, 3]
    found = one(spark, spans.located(F.col("c"), spans.TOKEN), c="ab, c-d")
    assert [(x.s, x.e, x.text) for x in found] == [(0, 2, "ab"), (4, 7, "c-d")]


def test_dump_values():
    assert sqldump.split_values(r"(1,0,'A_B\'s',0.5),(2,0,NULL,1)") == [[("1", False), ("0", False), ("A_B's", True), ("0.5", False)], [("2", False), ("0", False), ("NULL", False), ("1", False)]]
    assert sqldump.split_values("('NULL','a''b','x,(y)')") == [[("NULL", True), ("a'b", True), ("x,(y)", True)]]


def test_quantity(spark):
    v = '{"type":"quantity","value":{"amount":"+5","unit":"http://www.wikidata.org/entity/Q11573"}}'
    assert one(spark, lexkg.decode_value(F.col("c")), c=v) == "+5 (unit=Q11573)"
