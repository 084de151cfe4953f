"""Lexical knowledge graph: synset texts and filters, relations, hypernym paths, side-by-side comparison; entity JSON decoding.

synsets: (synset, pos, definition, examples, lemmas); edges: (src, rel, dst, ord)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of parts of speech.  (fixed values)
POS = {"n": "noun", "v": "verb", "a": "adjective", "s": "adjective satellite", "r": "adverb"}
#: Relations of a synset's record, in order.  (fixed values)
RELATIONS = "hypernyms hyponyms member_holonyms part_holonyms substance_holonyms member_meronyms part_meronyms substance_meronyms attributes entailments similar_tos".split()
#: Beginnings that decide an article whatever the first letter, and endings that are no plural.  (fixed values)
AN_WORDS, A_WORDS, VOWELS = "honest honor hour heir".split(), "one uni use user euro ufo".split(), "aeiou"
NOT_PLURAL, NOT_PLURAL_WORDS = "ss us is".split(), ["news"]
MOST_DEPTH = 64


def pos_label(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in POS.items() for x in kv]), c), c)


def check_word(word: str | None) -> str:
    if word is None or not word.strip():
        raise ValueError("a word to look up must not be blank")
    return word.strip()


def check_pos(pos: str | None) -> str | None:
    if pos is not None and pos not in POS:
        raise ValueError(f"part of speech must be one of {', '.join(POS)}")
    return pos


def head_word(synset: Column) -> Column:
    return F.translate(F.substring_index(synset, ".", 1), "_", " ")


def lookup_key(c: Column) -> Column:
    return F.lower(F.trim(F.translate(c, "_", " ")))


def lookup_variants(c: Column) -> Column:
    """Spellings to look up, in order: as given, then lower case, each with _, - and spaces exchanged."""
    t = F.trim(c)
    forms = [f(x) for x in (t, F.lower(t)) for f in (lambda v: v, lambda v: F.translate(v, "_", " "), lambda v: F.translate(v, "-", " "), lambda v: F.translate(v, " ", "_"), lambda v: F.translate(v, "-", "_"), lambda v: F.translate(F.translate(v, "-", " "), " ", "_"))]
    return F.array_distinct(F.array(*forms))


def ensure_sentence(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", "").when(t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def article(word: Column) -> Column:
    w = F.lower(word)
    begins = lambda words: w.rlike(f"^({'|'.join(words)})")
    return F.when(begins(AN_WORDS), "An").when(begins(A_WORDS), "A").when(begins(VOWELS), "An").otherwise("A")


def definition_sentence(word: Column, pos: Column, gloss: Column) -> Column:
    last = F.lower(F.element_at(F.split(word, " "), -1))
    plural = last.rlike("s$") & ~last.rlike(f"({'|'.join(NOT_PLURAL)})$") & ~last.isin(NOT_PLURAL_WORDS)
    proper = word != F.lower(word)
    start = F.when(pos == "v", F.concat(F.lit("To "), word, F.lit(" is to"))).when(pos != "n", F.concat(word, F.lit(" means"))).when(plural, F.concat(word, F.lit(" are"))).when(proper, F.concat(word, F.lit(" is"))).otherwise(F.concat(article(word), F.lit(" "), word, F.lit(" is")))
    none = F.concat(word, F.lit(" has no WordNet definition."))
    return F.when(F.trim(F.coalesce(gloss, F.lit(""))) == "", none).otherwise(ensure_sentence(F.concat(start, F.lit(" "), F.trim(gloss))))


def section_sentence(label: str, items: Column) -> Column:
    """"Label are a, b." for the items left after blanks and "(none)"; null if none is."""
    left = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: (x != "") & (x != "(none)"))
    verb, joiner = ("include" if "example" in label.lower() else "are"), (", " if "lemma" in label.lower() else "; ")
    return F.when(F.size(left) > 0, ensure_sentence(F.concat(F.lit(f"{label} {verb} "), F.array_join(left, joiner))))


def summary(df: DataFrame, sections: dict[str, str]) -> Column:
    """Definition sentence and a sentence for each section column that has items."""
    return F.concat_ws(" ", definition_sentence(head_word(F.col("synset")), F.col("pos"), F.col("definition")), *[section_sentence(k, F.col(c)) for k, c in sections.items()])


def filter_synsets(synsets: DataFrame, word: Column, noun_only: bool = False, exact: bool = False) -> DataFrame:
    out = synsets.where("pos = 'n'") if noun_only else synsets
    if exact:
        w = lookup_key(word)
        out = out.where((lookup_key(head_word(F.col("synset"))) == w) & F.exists("lemmas", lambda x: lookup_key(x) == w))
    return out


def raw_synsets(words: DataFrame, lemmas: DataFrame) -> DataFrame:
    """word, synset in the order of the first spelling that finds it.  lemmas: (lemma, synset, ord)."""
    v = words.select("word", F.posexplode(lookup_variants(F.col("word"))).alias("v", "lemma"))
    hit = v.join(lemmas, "lemma").groupBy("word", "synset").agg(F.min(F.struct("v", "ord")).alias("first"))
    return hit.selectExpr("word", "synset", "row_number() OVER (PARTITION BY word ORDER BY first.v, first.ord, synset) AS ord")


def related(synsets: DataFrame, edges: DataFrame) -> DataFrame:
    """synset, rel, items: "label - definition" of each related synset, in order."""
    d = synsets.select(F.col("synset").alias("dst"), F.when(F.trim(F.coalesce("definition", F.lit(""))) != "", F.concat_ws(" - ", head_word(F.col("synset")), "definition")).otherwise(head_word(F.col("synset"))).alias("item"))
    return edges.join(d, "dst").groupBy(F.col("src").alias("synset"), "rel").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"]).alias("items"))


def details(words: DataFrame, lemmas: DataFrame, synsets: DataFrame, edges: DataFrame, pos: str | None = None, noun_only: bool = False, exact: bool = False) -> DataFrame:
    """The full record of every synset of every word, in order: word, ord, synset, pos (label), definition, examples, lemmas, and a column of
    "label - definition" items for each of RELATIONS (empty where there is none).

    lemmas: (lemma, synset, ord); a word is found under the first of its spellings.  noun_only and exact filter as filter_synsets() does."""
    check_pos(pos)
    found = raw_synsets(words, lemmas).join(synsets, "synset")
    if pos is not None:
        found = found.where(F.col("pos").isin([pos, "s"] if pos == "a" else [pos]))
    found = filter_synsets(found, F.col("word"), noun_only, exact)
    items = related(synsets, edges).groupBy("synset").pivot("rel", RELATIONS).agg(F.first("items"))
    none = F.array().cast("array<string>")
    out = found.join(items, "synset", "left")
    return out.select(
        "word", "ord", "synset", pos_label(F.col("pos")).alias("pos"), F.when(F.trim(F.coalesce("definition", F.lit(""))) == "", "(none)").otherwise(F.col("definition")).alias("definition"),
        F.coalesce("examples", none).alias("examples"), F.coalesce("lemmas", none).alias("lemmas"), *[F.coalesce(r, none).alias(r) for r in RELATIONS],
    )


def alias_text(c: Column, kind: str) -> Column:
    """Aliases as one text: a list's values that are not null, by ", "; a text as it is; null: ''."""
    return F.coalesce(F.array_join(c, ", ") if kind.startswith("array") else c.cast("string"), F.lit(""))


def hypernym_paths(synsets: DataFrame, edges: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """synset, path: every way from a root down to each synset (a, b, ..., synset).  edges: (src, dst) to the hypernym; null ends count as none.

    A recursive query; a path that would repeat a node is not followed.  A root is what is the src of no edge."""
    spark, mark = synsets.sparkSession, uuid.uuid4().hex
    own = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    views = {f"__spanloom_synsets_{mark}": synsets.select("synset"), f"__spanloom_edges_{mark}": own}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    walk = spark.sql(f"""WITH RECURSIVE walk(synset, top, path, n) MAX RECURSION LEVEL {depth} AS (
        SELECT synset, synset, array(synset), 1 FROM __spanloom_synsets_{mark}
        UNION ALL SELECT w.synset, e.dst, concat(array(e.dst), w.path), n + 1 FROM walk w JOIN __spanloom_edges_{mark} e ON w.top = e.src WHERE NOT array_contains(w.path, e.dst))
        SELECT synset, top, path FROM walk""")
    for name in views:
        spark.catalog.dropTempView(name)
    return walk.join(own.select(F.col("src").alias("top")), "top", "left_anti").select("synset", "path")


def shorten(c: Column, most: int = 58) -> Column:
    """White space squeezed; cut at a word boundary with "..." where it is longer."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    head = F.regexp_extract(F.substring(t, 1, most - 2), r"^(.*)\s\S*$", 1)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(head), F.lit("...")))


def compare(left: DataFrame, right: DataFrame, most: int = 10) -> DataFrame:
    """pos, left, right: two ordered lists (ord, item) side by side; one row at least; what is missing is "(none)"."""
    side = lambda d, n: d.selectExpr("row_number() OVER (ORDER BY ord) AS pos", f"item AS {n}").where(F.col("pos") <= most)
    one = left.sparkSession.range(1, 2).select(F.col("id").cast("int").alias("pos"))
    j = one.join(side(left, "left"), "pos", "full").join(side(right, "right"), "pos", "full")
    return j.select("pos", *[F.coalesce(shorten(F.col(c)), F.lit("(none)")).alias(c) for c in ("left", "right")])


# Entity JSON


def lang_value(m: Column, lang: str) -> Column:
    """The value in a language, else the first there is, else ''.  m: map<string, struct<value>>."""
    return F.coalesce(F.try_element_at(m, F.lit(lang))["value"], F.try_element_at(F.map_values(m), F.lit(1))["value"], F.lit(""))


def aliases(m: Column, lang: str) -> Column:
    """m: map<string, array<struct<value>>>; blank values are left out."""
    own = F.coalesce(F.try_element_at(m, F.lit(lang)), F.try_element_at(F.map_values(m), F.lit(1)))
    return F.filter(F.transform(own, lambda x: x["value"]), lambda v: F.coalesce(v, F.lit("")) != "")


def decode_value(v: Column) -> Column:
    """The text of a datavalue, a JSON string {"type", "value"}."""
    g = lambda p: F.get_json_object(v, f"$.{p}")
    unit = F.regexp_extract(g("value.unit"), r"([^/]+)$", 1)
    item = F.coalesce(g("value.id"), F.concat(F.when(g("value.entity-type") == "property", "P").otherwise("Q"), g("value.numeric-id")))
    kind = g("type")
    return (
        F.when(kind == "wikibase-entityid", F.concat(item, F.lit(" ("), F.coalesce(g("value.entity-type"), F.lit("item")), F.lit(")")))
        .when(kind == "string", g("value"))
        .when(kind == "monolingualtext", F.concat(g("value.text"), F.lit(" ["), g("value.language"), F.lit("]")))
        .when(kind == "time", F.concat(g("value.time"), F.lit(" (precision="), g("value.precision"), F.lit(")")))
        .when(kind == "quantity", F.concat(g("value.amount"), F.lit(" (unit="), F.when(unit == "", "1").otherwise(unit), F.lit(")")))
        .when(kind == "globecoordinate", F.concat(F.lit("lat="), g("value.latitude"), F.lit(", lon="), g("value.longitude"), F.lit(", precision="), F.coalesce(g("value.precision"), F.lit("None"))))
        .otherwise(F.coalesce(g("value"), v))
    )


def decode_claim(claim: Column) -> Column:
    """The text of a claim's main value; "(somevalue)" and the like for snaks without one."""
    snak = F.get_json_object(claim, "$.mainsnak")
    kind = F.get_json_object(claim, "$.mainsnak.snaktype")
    return F.when(snak.isNull(), "(missing mainsnak)").when(kind != "value", F.concat(F.lit("("), kind, F.lit(")"))).otherwise(decode_value(F.get_json_object(claim, "$.mainsnak.datavalue")))


def top_claims(claims: DataFrame, properties: int = 10, values: int = 10) -> DataFrame:
    """prop, pos, text of the first values of the first properties, and how many more each has.  claims: (entity, prop_ord, prop, pos, claim)."""
    c = claims.where((F.col("prop_ord") < properties)).selectExpr("*", "count(*) OVER (PARTITION BY entity, prop) AS n")
    return c.where(F.col("pos") < values).select("entity", "prop", "pos", decode_claim(F.col("claim")).alias("text"), F.greatest(F.col("n") - values, F.lit(0)).alias("more"))


def bindings(results: DataFrame, variables: list[str]) -> DataFrame:
    """SPARQL result rows: a column for each variable.  results: (binding map<string, struct<value>>)."""
    return results.select(*[F.try_element_at("binding", F.lit(v))["value"].alias(v) for v in variables])
