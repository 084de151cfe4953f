"""Driver queries of the engine's operators on the driver's tables, each with an oracle in plain SQL where SQL can say it.

Stand-ins: term = embeddings.label, occurrence = vec_id, chunk = vec_id % 50, batch = vec_id div 100; corpus = documents; redirects = part
names; hierarchy = region to supplier."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions import vectors as V
from spanloom import engine
from spanloom.operators import cluster, encoding, extractor, lexkg, maintenance, prototypes, redirects, retrieval, scoring, senses, spans, vectors
from spanloom.sources import hotpot, sqldump, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver's tables, and the stand-ins made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def occurrences(self) -> DataFrame:
        return self.embeddings.select(F.col("label").cast("long").alias("term_id"), (F.col("vec_id") % 50).alias("chunk_id"), F.col("vec_id").alias("occ_id"), F.expr("vec_id DIV 100").alias("batch_ord"), V.doubles(F.col("embedding")).alias("embed"))

    @property
    def chunks(self) -> DataFrame:
        """chunk_id, num_tokens: a chunk's length is its number of occurrences."""
        return self.occurrences.groupBy("chunk_id").agg(F.count("*").alias("num_tokens"))

    @property
    def protos(self) -> DataFrame:
        return prototypes.basic(self.occurrences).withColumn("proto_id", F.col("term_id"))

    @property
    def kept_protos(self) -> DataFrame:
        """An index: built once, read by several joins."""
        return tables_of(self).save("protos", self.protos)

    @property
    def proto_scores(self) -> DataFrame:
        tf = scoring.term_frequencies(self.occurrences.withColumnRenamed("term_id", "proto_id"), "proto_id", "chunk_id")
        return scoring.bm25_scores(tf, "proto_id", "chunk_id", self.chunks, "num_tokens")

    @property
    def doc_terms(self) -> DataFrame:
        """doc_id, term of every [a-z0-9]+ word of the corpus in lower case."""
        return self.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))

    @property
    def doc_lengths(self) -> DataFrame:
        return self.documents.select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("num_tokens"))


def query(sql: str | None = None) -> Callable:
    """Registers f(tables) under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def tables_of(t: Tables) -> store.TableSet:
    """A place of a query's own for tables that its result reads."""
    return store.TableSet(t.spark, f"{store.work_dir(t.spark)}/catalogue-{uuid.uuid4().hex}")


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


def joined(*cols: str):
    """Arrays as text, so that both engines hash them alike."""
    return [F.array_join(F.col(c), "|").alias(c) for c in cols]


SQUEEZED = r"trim(regexp_replace(replace(text, '-' || chr(10), ''), '\s+', ' ', 'g'))"
WORDS = r"list_filter(string_split_regex(coalesce({c}, ''), '\s+'), lambda w: w <> '')"

# Text


@query(f"SELECT doc_id, lower(regexp_replace({SQUEEZED}, '[\"'']', '', 'g')) AS cleaned FROM documents")
def clean_basic(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.clean_basic(F.col("text")).alias("cleaned"))


# DuckDB's word boundaries know ASCII only: texts are cut into words of any script and what lies between.
_PIECES = rf"regexp_extract_all({SQUEEZED}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"
_CAPITALISED = "coalesce(regexp_full_match({p}, '[A-Z][a-z]+'), false)"


@query(rf"""WITH d AS (SELECT doc_id, text, {_PIECES} AS ps FROM documents)
    SELECT doc_id, trim(array_to_string(list_transform(ps, lambda p, i: CASE WHEN regexp_full_match(p, '[A-Z]{{2,}}') OR {_CAPITALISED.format(p='p')} AND (ps[i + 1] = ' ' AND {_CAPITALISED.format(p='ps[i + 2]')} OR i > 2 AND ps[i - 1] = ' ' AND {_CAPITALISED.format(p='ps[i - 2]')})
    THEN p ELSE lower(regexp_replace(p, '["'']', '', 'g')) END), '')) AS cleaned FROM d""")
def clean_protected(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, array_to_string(list_filter({_PIECES}, lambda p: regexp_full_match(p, '[A-Z]{{2,}}')), '|') AS acronyms FROM documents")
def acronym_spans(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.acronyms(F.col("text")).alias("acronyms")).select("doc_id", *joined("acronyms"))


@query(f"""WITH d AS (SELECT doc_id, array_to_string(list_transform({_PIECES}, lambda p: CASE WHEN p = ' ' OR {_CAPITALISED.format(p='p')} THEN p ELSE '#' END), '') AS bare FROM documents)
    SELECT doc_id, array_to_string(regexp_extract_all(bare, '[A-Z][a-z]+( [A-Z][a-z]+)+'), '|') AS runs FROM d""")
def title_spans(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.title_runs(F.col("text")).alias("runs")).select("doc_id", *joined("runs"))


@query(rf"""WITH w AS (SELECT p_partkey, {WORDS.format(c="'The ' || p_name || ' NASA Probe'")} AS w FROM part)
    SELECT p_partkey, array_to_string(list_transform(CASE WHEN lower(w[1]) IN ('the', 'a', 'an') THEN w[2:] ELSE w END, lambda x: CASE WHEN regexp_matches(x, '[A-Z]{{2,}}') THEN x ELSE lower(x) END), ' ') AS phrase FROM w""")
def normalize_phrase(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.normalize_phrase(F.concat(F.lit("The "), "p_name", F.lit(" NASA Probe"))).alias("phrase"))


@query(f"SELECT doc_id, CAST(len({WORDS.format(c='text')}) AS BIGINT) AS n_words FROM documents")
def word_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.count_words(F.col("text")).alias("n_words"))


@query("""WITH d AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) || ' ' || CAST(event_id AS VARCHAR) WHEN event_id % 3 = 1 THEN event_type ELSE ' ' END AS s FROM events)
    SELECT event_id, regexp_full_match(s, '\\s*[0-9]+(\\s+[0-9]+)*\\s*') AS digits FROM d""".replace("\\\\", "\\"))
def digit_phrases(t: Tables) -> DataFrame:
    s = F.expr("CASE WHEN event_id % 3 = 0 THEN concat_ws(' ', user_id, event_id) WHEN event_id % 3 = 1 THEN event_type ELSE ' ' END")
    return t.events.select("event_id", T.all_words_are_digits(s).alias("digits"))


_TITLE = "replace(p_name, ' ', '_') || '_(' || p_brand || ' (' || p_type || '))'"
_NORM = r"""trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(replace(trim({c}), '_', ' ')), '\([^()]*\)', ' ', 'g'), '\([^()]*\)', ' ', 'g'), '[^A-Za-z0-9 ''&/.-]', ' ', 'g'), '.', ' '), '\s+', ' ', 'g'))"""
_BUCKET = "rpad(substr(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'), 1, 2), 2, '_')"


@query(f"WITH n AS (SELECT p_partkey, {_NORM.format(c=_TITLE)} AS title FROM part) SELECT p_partkey, title, {_BUCKET.format(c='title')} AS bucket, coalesce(regexp_matches(title, '[a-z]'), false) AS kept FROM n")
def title_normalize(t: Tables) -> DataFrame:
    raw = F.concat(F.translate("p_name", " ", "_"), F.lit("_("), "p_brand", F.lit(" ("), "p_type", F.lit("))"))
    n = t.part.select("p_partkey", T.normalize_title(raw).alias("title"))
    return n.select("p_partkey", "title", T.bucket_key(F.col("title")).alias("bucket"), T.should_keep_title(F.col("title")).alias("kept"))


@query(f"WITH n AS (SELECT {_NORM.format(c=_TITLE)} AS title FROM part) SELECT {_BUCKET.format(c='title')} AS bucket, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY 1")
def title_bucket_sizes(t: Tables) -> DataFrame:
    raw = F.concat(F.translate("p_name", " ", "_"), F.lit("_("), "p_brand", F.lit(" ("), "p_type", F.lit("))"))
    return redirects.bucket_sizes(t.part.select(T.bucket_key(T.normalize_title(raw)).alias("bucket")))


_SENTS = r"list_filter(list_transform(regexp_extract_all({c}, '[^.!?]+[.!?]*'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '')"


@query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s[1] AS first FROM (SELECT doc_id, {_SENTS.format(c='text')} AS s FROM documents)")
def sentence_split(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.try_element_at("s", F.lit(1)).alias("first"))


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, {_SENTS.format(c='text')} AS s FROM documents),
    g(doc_id, i, chunk, n) AS (SELECT doc_id, 1, 1, len(string_split(s[1], ' ')) FROM s WHERE len(s) > 0
      UNION ALL SELECT g.doc_id, i + 1, CASE WHEN n + len(string_split(s[i + 1], ' ')) > 60 THEN chunk + 1 ELSE chunk END, CASE WHEN n + len(string_split(s[i + 1], ' ')) > 60 THEN 0 ELSE n END + len(string_split(s[i + 1], ' '))
      FROM g JOIN s ON g.doc_id = s.doc_id WHERE i < len(s))
    SELECT g.doc_id, CAST(chunk AS BIGINT) AS chunk, string_agg(s[i], ' ' ORDER BY i) AS text FROM g JOIN s ON g.doc_id = s.doc_id GROUP BY 1, 2""")
def greedy_chunks(t: Tables) -> DataFrame:
    c = t.documents.select("doc_id", F.posexplode(spans.greedy_chunks(T.sentences(F.col("text")), 60)).alias("i", "text"))
    return c.select("doc_id", (F.col("i") + 1).cast("long").alias("chunk"), "text")


_STOP = ", ".join(f"'{w}'" for w in spans.STOP)


@query(rf"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*'), lambda w: NOT list_contains([{_STOP}], lower(w)) AND NOT regexp_full_match(w, '\d+(\.\d+)?')
    AND length(w) >= 2 AND NOT (length(w) <= 2 AND w = lower(w) AND regexp_matches(w, '[a-z]'))), '|') AS tokens FROM documents""")
def important_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", spans.important_tokens(F.col("text")).alias("tokens")).select("doc_id", *joined("tokens"))


_SPANS = "list_transform(range(1, 9), lambda i: {{'s': (doc_id * i * 7) % 40, 'e': (doc_id * i * 7) % 40 + 1 + (doc_id + i * i) % 12}})".replace("{{", "{").replace("}}", "}")


@query(f"""WITH x AS (SELECT doc_id, unnest({_SPANS}) AS x, unnest(range(0, 8)) AS i FROM documents), s AS (SELECT doc_id, x.s AS s, x.e AS e, i FROM x)
    SELECT a.doc_id, CAST(a.s AS BIGINT) AS s, CAST(a.e AS BIGINT) AS e FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.doc_id = b.doc_id AND b.s <= a.s AND a.e <= b.e AND (b.e - b.s > a.e - a.s OR b.i < a.i))""")
def drop_contained_spans(t: Tables) -> DataFrame:
    made = t.documents.select("doc_id", F.expr("transform(sequence(1, 8), i -> struct((doc_id * i * 7) % 40 AS s, (doc_id * i * 7) % 40 + 1 + (doc_id + i * i) % 12 AS e))").alias("x"))
    return made.select("doc_id", F.explode(spans.drop_contained(F.col("x"))).alias("x")).select("doc_id", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"))


@query("""WITH sub AS (SELECT vec_id % 50 AS chunk_id, (vec_id // 50) * 3 AS s, (vec_id // 50) * 3 + 3 AS e, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    span AS (SELECT DISTINCT chunk_id, (chunk_id % 7) AS a, (chunk_id % 7) + 8 AS b FROM sub),
    e AS (SELECT span.chunk_id, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM sub JOIN span ON sub.chunk_id = span.chunk_id WHERE s < b AND e > a)
    SELECT chunk_id, CAST(i AS BIGINT) AS i, round(avg(x), 6) AS x FROM e GROUP BY 1, 2""")
def span_overlap_pool(t: Tables) -> DataFrame:
    sub = t.embeddings.selectExpr("vec_id % 50 AS chunk_id", "struct(CAST((vec_id DIV 50) * 3 AS INT) AS s, CAST((vec_id DIV 50) * 3 + 3 AS INT) AS e, embedding AS v) AS o")
    g = sub.groupBy("chunk_id").agg(F.sort_array(F.collect_list("o")).alias("o"))  # the subwords of one chunk
    start = (F.col("chunk_id") % 7).cast("int")
    at = V.overlapping(F.transform("o", lambda o: F.struct(o["s"].alias("s"), o["e"].alias("e"))), start, start + 8)
    pooled = g.select("chunk_id", V.mean_at(F.transform("o", lambda o: V.doubles(o["v"])), at).alias("m"))
    return pooled.select("chunk_id", F.posexplode("m").alias("i", "x")).select("chunk_id", F.col("i").cast("long").alias("i"), r6("x"))


# Terms


_TERMS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents"
_LENS = "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS num_tokens FROM documents"
_BM = "round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * num_tokens / avg_len)), 6)"


@query(f"SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM ({_TERMS}) GROUP BY 1, 2")
def term_tf(t: Tables) -> DataFrame:
    return scoring.term_frequencies(t.doc_terms, "term", "doc_id").select("doc_id", "term", "tf")


@query(f"SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT doc_id) + 1)) + 1, 6) AS idf FROM ({_TERMS}) GROUP BY 1")
def term_df_idf(t: Tables) -> DataFrame:
    tf = scoring.term_frequencies(t.doc_terms, "term", "doc_id")
    return scoring.document_frequencies(tf, "term", "doc_id", scoring.corpus_stats(t.doc_lengths, "num_tokens")).select("term", "df", r6("idf"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS n_chunks, round(avg(num_tokens), 6) AS avg_len FROM ({_LENS})")
def avg_len(t: Tables) -> DataFrame:
    return scoring.corpus_stats(t.doc_lengths, "num_tokens").select("n_chunks", r6("avg_len"))


_SCORED = f"""tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM ({_TERMS}) GROUP BY 1, 2), len AS MATERIALIZED ({_LENS}), st AS MATERIALIZED (SELECT count(*) AS n, avg(num_tokens) AS avg_len FROM len),
    df AS MATERIALIZED (SELECT term, ln(((SELECT n FROM st) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term)"""


@query(f"WITH {_SCORED} SELECT tf.doc_id, tf.term, {_BM.replace('avg_len', '(SELECT avg_len FROM st)')} AS bm25 FROM tf JOIN df ON tf.term = df.term JOIN len ON tf.doc_id = len.doc_id")
def bm25_scores(t: Tables) -> DataFrame:
    tf = scoring.term_frequencies(t.doc_terms, "term", "doc_id")
    return scoring.bm25_scores(tf, "term", "doc_id", t.doc_lengths, "num_tokens").select("doc_id", "term", r6("bm25"))


_WANTED = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id = 0"


@query(f"""WITH {_SCORED}, q AS ({_WANTED}), s AS (SELECT tf.doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * num_tokens / avg_len))) AS w FROM tf JOIN q ON tf.term = q.term JOIN df ON tf.term = df.term JOIN len ON tf.doc_id = len.doc_id, st GROUP BY 1)
    SELECT doc_id, round(w, 6) AS score FROM s ORDER BY round(w, 9) DESC, doc_id LIMIT 10""")
def bm25_topk(t: Tables) -> DataFrame:
    """The ten best documents for the words of the first benchmark item.  Only the query's terms are scored."""
    wanted = t.benchmark.where("item_id = 0").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("term"))
    tf = scoring.term_frequencies(t.doc_terms.join(wanted, "term", "left_semi"), "term", "doc_id")
    s = scoring.bm25_scores(tf, "term", "doc_id", t.doc_lengths, "num_tokens").groupBy(F.col("doc_id").alias("chunk_id")).agg(F.sum("bm25").alias("weight"))
    return scoring.top_chunks(s, 10).select(F.col("chunk_id").alias("doc_id"), F.round("weight", 6).alias("score"))


@query(f"""WITH tf AS (SELECT doc_id, count(*) FILTER (WHERE term = 'the') AS tf FROM ({_TERMS}) GROUP BY 1), len AS ({_LENS})
    SELECT tf.doc_id, round(CASE WHEN tf <= 0 THEN 0.0 ELSE tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * num_tokens / (SELECT avg(num_tokens) FROM len))) END, 6) AS w FROM tf JOIN len ON tf.doc_id = len.doc_id""")
def bm25_saturation(t: Tables) -> DataFrame:
    tf = t.doc_terms.groupBy("doc_id").agg(F.count_if(F.col("term") == "the").alias("tf"))
    d = tf.join(t.doc_lengths, "doc_id").crossJoin(F.broadcast(scoring.corpus_stats(t.doc_lengths, "num_tokens")))  # one row
    return d.select("doc_id", F.round(scoring.bm25_saturation(F.col("tf"), F.col("num_tokens"), F.col("avg_len")), 6).alias("w"))


@query("""WITH t AS (SELECT DISTINCT p_name AS term FROM part), q AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS text FROM part)
    SELECT text, term FROM q JOIN t ON list_contains(string_split(term, ' '), text) WHERE term <> text AND len(string_split(term, ' ')) >= 2""")
def phrase_fuzzy(t: Tables) -> DataFrame:
    terms = maintenance.dense(t.part.select(F.col("p_name").alias("term")).distinct(), "term", "term_id")
    q = maintenance.dense(t.part.select(F.substring_index("p_name", " ", 1).alias("text")).distinct(), "text", "q_id")
    return retrieval.fuzzy_phrases(q, retrieval.phrase_words(terms), terms).select("text", "term")


@query("""WITH q AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'none such' ELSE p_name END AS term FROM part), t AS (SELECT p_name AS term, min(p_partkey) AS term_id FROM part GROUP BY 1)
    SELECT p_partkey, q.term, coalesce(term_id, -1) AS term_id FROM q LEFT JOIN t ON q.term = t.term""")
def dict_lookup_left(t: Tables) -> DataFrame:
    q = t.part.select("p_partkey", F.expr("CASE WHEN p_partkey % 4 = 0 THEN 'none such' ELSE p_name END").alias("term"))
    return q.join(t.part.groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("term_id")), "term", "left").select("p_partkey", "term", F.coalesce("term_id", F.lit(-1)).cast("long").alias("term_id"))


# Vectors and prototypes

_OCC = "occ AS (SELECT CAST(label AS BIGINT) AS term_id, vec_id % 50 AS chunk_id, vec_id AS occ_id, vec_id // 100 AS batch_ord, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_CENTRE = f"""{_OCC}, unit AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM occ),
    m AS (SELECT term_id, i, avg(x) AS x FROM (SELECT term_id, unnest(list_transform(v, lambda a: a / n)) AS x, unnest(range(0, len(v))) AS i FROM unit) GROUP BY 1, 2),
    c0 AS (SELECT term_id, list(x ORDER BY i) AS c FROM m GROUP BY 1), cen AS (SELECT term_id, list_transform(c, lambda a: a / sqrt(list_dot_product(c, c))) AS centre FROM c0),
    sim AS (SELECT occ.*, list_cosine_similarity(v, centre) AS sim FROM occ JOIN cen ON occ.term_id = cen.term_id)"""


@query(f"WITH {_CENTRE} SELECT term_id, CAST(i AS BIGINT) AS i, round(x, 6) AS x FROM (SELECT term_id, unnest(centre) AS x, unnest(range(0, len(centre))) AS i FROM cen)")
def centroid_by_label(t: Tables) -> DataFrame:
    c = vectors.centres(t.occurrences, "term_id").select("term_id", F.posexplode("centre").alias("i", "x"))
    return c.select("term_id", F.col("i").cast("long").alias("i"), r6("x"))


@query(f"WITH {_CENTRE} SELECT occ_id, term_id, round(sim, 6) AS sim FROM sim")
def edge_weights(t: Tables) -> DataFrame:
    return vectors.similarities(t.occurrences, vectors.centres(t.occurrences, "term_id"), "term_id").select("occ_id", "term_id", r6("sim"))


@query(f"WITH {_CENTRE} SELECT term_id, round(quantile_cont(sim, 0.1), 6) AS threshold, round(avg(sim), 6) AS concentration, avg(sim) <= 0.9 AS is_semantic FROM sim GROUP BY 1")
def anomaly_threshold(t: Tables) -> DataFrame:
    return prototypes.is_semantic(prototypes.basic(t.occurrences)).select("term_id", r6("threshold"), r6("concentration"), "is_semantic")


@query(f"""WITH {_CENTRE} SELECT occ_id, cen.term_id AS proto_id, round(list_cosine_similarity(v, centre), 6) AS sim FROM occ, cen WHERE occ_id % 20 = 0
    QUALIFY row_number() OVER (PARTITION BY occ_id ORDER BY round(list_cosine_similarity(v, centre), 9) DESC, cen.term_id) <= 2""")
def topk_prototypes(t: Tables) -> DataFrame:
    """The two best prototypes for a stated query set: every twentieth occurrence."""
    q = t.occurrences.where("occ_id % 20 = 0").select(F.col("occ_id").alias("q_id"), F.col("embed").alias("q_embed"))
    return vectors.top(vectors.against(q, t.protos, 2), ["q_id"], "proto_id", 2).select(F.col("q_id").alias("occ_id"), "proto_id", r6("sim"))


@query(f"""WITH {_CENTRE} SELECT occ_id, arg_min(cen.term_id, -round(list_cosine_similarity(v, centre), 9)) AS proto_id, round(max(list_cosine_similarity(v, centre)), 6) AS sim FROM occ, cen WHERE occ_id % 20 = 0 GROUP BY 1""")
def global_1nn(t: Tables) -> DataFrame:
    q = t.occurrences.where("occ_id % 20 = 0").select(F.col("occ_id").alias("q_id"), F.col("embed").alias("q_embed"))
    return vectors.nearest(vectors.against(q, t.protos, 1), ["q_id"], "proto_id").select(F.col("q_id").alias("occ_id"), "proto_id", r6("sim"))


@query(f"""WITH {_OCC}, per AS (SELECT term_id, batch_ord, count(*) AS n FROM occ GROUP BY 1, 2), run AS (SELECT *, sum(n) OVER (PARTITION BY term_id ORDER BY batch_ord) AS upto FROM per),
    fl AS (SELECT term_id, min(batch_ord) FILTER (WHERE upto >= 20) AS b FROM run GROUP BY 1), o AS (SELECT occ.*, coalesce(batch_ord <= b, true) AS trains, sqrt(list_dot_product(v, v)) AS n FROM occ JOIN fl ON occ.term_id = fl.term_id),
    m AS (SELECT term_id, i, avg(x) AS x FROM (SELECT term_id, unnest(list_transform(v, lambda a: a / n)) AS x, unnest(range(0, len(v))) AS i FROM o WHERE trains) GROUP BY 1, 2), cen AS (SELECT term_id, list(x ORDER BY i) AS c FROM m GROUP BY 1),
    th AS (SELECT o.term_id, quantile_cont(list_cosine_similarity(v, c), 0.1) AS t FROM o JOIN cen ON o.term_id = cen.term_id WHERE trains GROUP BY 1)
    SELECT o.occ_id, o.term_id, trains, CASE WHEN trains THEN false ELSE list_cosine_similarity(v, c) < t END AS anomaly FROM o JOIN cen ON o.term_id = cen.term_id JOIN th ON o.term_id = th.term_id""")
def assign_or_anomaly(t: Tables) -> DataFrame:
    o = prototypes.training_split(t.occurrences, 20)
    protos, members = prototypes.indexed(t.occurrences, 20, tau=-1.0, keep=tables_of(t).keeper())  # below every concentration: one prototype a term
    return members.join(o.select("occ_id", "trains"), "occ_id").select("occ_id", "term_id", "trains", "anomaly")


_PROTO = f"""{_OCC}, ch AS (SELECT chunk_id, count(*) AS num_tokens FROM occ GROUP BY 1), st AS (SELECT count(*) AS n, avg(num_tokens) AS avg_len FROM ch), tf AS (SELECT term_id AS proto_id, chunk_id, count(*) AS tf FROM occ GROUP BY 1, 2),
    df AS (SELECT proto_id, count(*) AS df, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM tf, st GROUP BY proto_id, n),
    bm AS (SELECT tf.proto_id, tf.chunk_id, tf, df, idf, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * num_tokens / avg_len)) AS bm25 FROM tf JOIN df ON tf.proto_id = df.proto_id JOIN ch ON tf.chunk_id = ch.chunk_id, st)"""


@query(f"WITH {_PROTO} SELECT proto_id, chunk_id, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf, round(bm25, 6) AS bm25 FROM bm")
def proto_bm25(t: Tables) -> DataFrame:
    return t.proto_scores.select("proto_id", "chunk_id", "tf", "df", r6("idf"), r6("bm25"))


@query("""WITH m AS (SELECT DISTINCT l_partkey % 50 AS n, l_orderkey AS c FROM lineitem), k AS (SELECT n, count(*) AS k FROM m GROUP BY 1), s AS (SELECT x.n AS a, y.n AS b, count(*) AS shared FROM m x JOIN m y ON x.c = y.c AND x.n < y.n GROUP BY 1, 2)
    SELECT a, b, CAST(shared AS BIGINT) AS shared, round(shared / sqrt(CAST(p.k * q.k AS DOUBLE)), 6) AS weight FROM s JOIN k p ON a = p.n JOIN k q ON b = q.n""")
def ochiai_edges(t: Tables) -> DataFrame:
    m = t.lineitem.select((F.col("l_partkey") % 50).alias("node"), F.col("l_orderkey").alias("chunk"))
    return scoring.shared_chunk_edges(m, "node", "chunk").select("a", "b", "shared", r6("weight"))


_GRAPH = f"""{_PROTO}, nodes AS (SELECT proto_id AS node, proto_id, 't' || CAST(proto_id % 7 AS VARCHAR) AS term, CAST(proto_id % 4 AS INT) AS level FROM df),
    mem AS (SELECT DISTINCT node, chunk_id FROM nodes JOIN bm ON nodes.proto_id = bm.proto_id), kk AS (SELECT node, count(*) AS k FROM mem GROUP BY 1),
    e AS (SELECT x.node AS a, y.node AS b, count(*) / sqrt(CAST(any_value(p.k) * any_value(q.k) AS DOUBLE)) AS w FROM mem x JOIN mem y ON x.chunk_id = y.chunk_id AND x.node < y.node JOIN kk p ON x.node = p.node JOIN kk q ON y.node = q.node GROUP BY 1, 2),
    nw AS (SELECT n.node, n.proto_id, n.term, n.level, sum(w * [1.2, 1.0, 0.8, 0.5][level + 1]) AS weight FROM (SELECT a AS node, w FROM e UNION ALL SELECT b, w FROM e) z JOIN nodes n ON z.node = n.node GROUP BY n.node, n.proto_id, n.term, n.level),
    cw AS (SELECT chunk_id, sum(weight * bm25) AS weight FROM (SELECT bm.chunk_id, weight, bm25 FROM nw JOIN bm ON nw.proto_id = bm.proto_id QUALIFY row_number() OVER (PARTITION BY bm.chunk_id, term ORDER BY node) = 1) GROUP BY 1),
    lr AS (SELECT level, chunk_id, score, row_number() OVER (PARTITION BY level ORDER BY round(score, 9) DESC, chunk_id) AS pos FROM (SELECT level, bm.chunk_id, sum(bm25) AS score FROM nodes JOIN bm ON nodes.proto_id = bm.proto_id GROUP BY 1, 2))"""


def graph_nodes(t: Tables) -> DataFrame:
    return t.protos.select(F.col("proto_id").alias("node"), "proto_id", F.expr("concat('t', proto_id % 7)").alias("term"), F.expr("CAST(proto_id % 4 AS INT)").alias("level"))


@query(f"WITH {_GRAPH} SELECT node, round(weight, 6) AS weight FROM nw")
def node_weights(t: Tables) -> DataFrame:
    n = graph_nodes(t)
    members = n.join(t.proto_scores, "proto_id").select("node", "chunk_id").distinct()
    return scoring.node_weights(scoring.shared_chunk_edges(members, "node", "chunk_id"), n.select("node", "level")).select("node", r6("weight"))


@query(f"WITH {_GRAPH} SELECT chunk_id, round(weight, 6) AS weight FROM cw")
def chunk_weights(t: Tables) -> DataFrame:
    n, s = graph_nodes(t), t.proto_scores
    members = n.join(s, "proto_id").select("node", "chunk_id").distinct()
    w = scoring.node_weights(scoring.shared_chunk_edges(members, "node", "chunk_id"), n.select("node", "level"))
    return scoring.chunk_weights(n.join(w, "node"), s).select("chunk_id", r6("weight"))


@query(f"WITH {_GRAPH} SELECT CAST(level AS BIGINT) AS level, chunk_id, round(score, 6) AS score, CAST(pos AS BIGINT) AS pos FROM lr")
def level_ranking(t: Tables) -> DataFrame:
    return scoring.level_ranking(graph_nodes(t), t.proto_scores).select(F.col("level").cast("long").alias("level"), "chunk_id", r6("score"), F.col("pos").cast("long").alias("pos"))


_LISTS = f"WITH {_GRAPH}, l AS (SELECT CAST(level AS BIGINT) AS list, CAST(pos AS BIGINT) AS pos, chunk_id AS item FROM lr WHERE chunk_id % 5 <> 0), a AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY pos) AS n FROM l)"


def ranked_lists(t: Tables) -> DataFrame:
    return scoring.level_ranking(graph_nodes(t), t.proto_scores).selectExpr("CAST(level AS BIGINT) AS list", "CAST(pos AS BIGINT) AS pos", "chunk_id AS item")


@query(f"{_LISTS} SELECT list, pos, item, CAST(row_number() OVER (ORDER BY list, pos) AS BIGINT) AS ord FROM a ORDER BY ord LIMIT 70")
def extract_sequential(t: Tables) -> DataFrame:
    excluded = t.chunks.where("chunk_id % 5 = 0").select(F.col("chunk_id").alias("item"))
    return extractor.extract(ranked_lists(t), 70, excluded).withColumn("ord", F.col("ord").cast("long"))


@query(f"{_LISTS} SELECT list, pos, item, CAST(row_number() OVER (ORDER BY (n - 1) // 2, list, pos) AS BIGINT) AS ord FROM a ORDER BY ord LIMIT 30")
def extract_round(t: Tables) -> DataFrame:
    excluded = t.chunks.where("chunk_id % 5 = 0").select(F.col("chunk_id").alias("item"))
    return extractor.extract(ranked_lists(t), 30, excluded, each=2).withColumn("ord", F.col("ord").cast("long"))


@query(f"""WITH {_GRAPH}, con AS (SELECT chunk_id, row_number() OVER (ORDER BY round(weight, 9) DESC, chunk_id) AS ord FROM cw QUALIFY ord <= 8), nc AS (SELECT count(*) AS n FROM con),
    iso AS (SELECT chunk_id, row_number() OVER (ORDER BY level, pos) AS ord FROM lr WHERE chunk_id NOT IN (SELECT chunk_id FROM con))
    SELECT CAST(ord AS BIGINT) AS ord, chunk_id, 'connected' AS part FROM con UNION ALL SELECT CAST(n + ord AS BIGINT), chunk_id, 'isolated' FROM iso, nc WHERE ord <= CASE WHEN n < 8 THEN 10 - n ELSE 2 END""")
def multi_level_query(t: Tables) -> DataFrame:
    """The flagship: the ten best chunks with every prototype as a query node, eight connected and two from the levels."""
    return retrieval.multi_level(graph_nodes(t), t.proto_scores).select(F.col("ord").cast("long").alias("ord"), "chunk_id", "part")


@query(f"""WITH {_CENTRE}, q AS (SELECT term_id AS span, 'term ' || term_id AS text, centre AS v FROM cen UNION ALL SELECT 1000 + occ_id, 'term', v FROM occ WHERE occ_id % 20 = 0 UNION ALL SELECT 1000000 + occ_id, 'unknown', v FROM occ WHERE occ_id % 20 = 1),
    p AS (SELECT q.span, q.text, cen.term_id AS proto_id, 'term ' || cen.term_id AS term, list_cosine_similarity(q.v, centre) AS sim FROM q CROSS JOIN cen),
    n AS (SELECT *, row_number() OVER (PARTITION BY span ORDER BY round(sim, 9) DESC, proto_id) AS rank FROM p)
    SELECT CAST(span AS BIGINT) AS span, text, 'exact' AS how, CAST(1 AS BIGINT) AS rank, proto_id, term, round(sim, 6) AS sim FROM p WHERE text = term
    UNION ALL SELECT span, text, 'fuzzy', rank, proto_id, term, round(sim, 6) FROM n WHERE text = 'term' AND rank <= 2
    UNION ALL SELECT span, text, 'semantic', rank, proto_id, term, round(sim, 6) FROM n WHERE text = 'unknown' AND rank = 1""")
def resolve_matches(t: Tables) -> DataFrame:
    """Every term as a span (exact); a word that all phrases hold with every twentieth vector (two fuzzy matches); an unknown word with
    others (one semantic match)."""
    protos = t.kept_protos.select("proto_id", "term_id", "centre")
    terms = protos.select("term_id", F.expr("concat('term ', term_id)").alias("term"))
    known = protos.select(F.col("term_id").alias("span"), F.lit("phrase").alias("kind"), F.expr("concat('term ', term_id)").alias("text"), F.col("centre").alias("embed"))
    word = t.occurrences.where("occ_id % 20 = 0").select((F.col("occ_id") + 1000).alias("span"), F.lit("phrase").alias("kind"), F.lit("term").alias("text"), "embed")
    other = t.occurrences.where("occ_id % 20 = 1").select((F.col("occ_id") + 1_000_000).alias("span"), F.lit("phrase").alias("kind"), F.lit("unknown").alias("text"), "embed")
    m = retrieval.resolve(known.unionByName(word).unionByName(other), terms, protos, retrieval.phrase_words(terms))
    return m.select("span", "text", "how", F.col("rank").cast("long").alias("rank"), F.col("proto_id").cast("long").alias("proto_id"), "term", r6("sim"))


@query(f"""WITH {_OCC}, o AS (SELECT * FROM occ WHERE chunk_id % 10 <> 3), ch AS (SELECT chunk_id, count(*) AS num_tokens FROM o GROUP BY 1), st AS (SELECT count(*) AS n, avg(num_tokens) AS avg_len FROM ch), tf AS (SELECT term_id AS proto_id, chunk_id, count(*) AS tf FROM o GROUP BY 1, 2),
    df AS (SELECT proto_id, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM tf, st GROUP BY proto_id, n)
    SELECT tf.proto_id, tf.chunk_id, {_BM} AS bm25 FROM tf JOIN df ON tf.proto_id = df.proto_id JOIN ch ON tf.chunk_id = ch.chunk_id, st""")
def delete_and_rebuild(t: Tables) -> DataFrame:
    """Deletes the documents (here chunk_id % 10) numbered 3 and computes the statistics of what is left."""
    chunks = t.chunks.withColumn("doc_id", F.col("chunk_id") % 10)
    members = t.occurrences.select(F.col("term_id").alias("proto_id"), "chunk_id")
    protos = t.protos.select("proto_id", "term_id")
    left = maintenance.delete_documents(chunks, members, protos, protos.select("term_id"), chunks.where("doc_id = 3").select("doc_id").distinct())
    return maintenance.rebuild(left).select("proto_id", "chunk_id", r6("bm25"))


_MULTI = f"{_OCC}, s AS (SELECT term_id, occ_id % 3 AS sense, count(*) AS n FROM occ WHERE term_id % 3 <> 1 OR occ_id % 3 = 0 GROUP BY 1, 2), g AS (SELECT term_id, count(*) AS senses FROM s GROUP BY 1 HAVING count(*) >= 2), j AS (SELECT s.term_id, senses, s.term_id * 3 + sense AS proto_id, n AS occurrences FROM s JOIN g ON s.term_id = g.term_id)"


def sense_rows(t: Tables) -> DataFrame:
    """All occurrences; every third term has one sense, the others three."""
    return t.occurrences.withColumn("proto_id", F.expr("term_id * 3 + CASE WHEN term_id % 3 = 1 THEN 0 ELSE occ_id % 3 END"))


def made_senses(t: Tables) -> DataFrame:
    o = sense_rows(t)
    return maintenance.multi_sense_terms(o.select("proto_id", "term_id").distinct(), o.select("proto_id"))


@query(f"WITH {_MULTI} SELECT term_id, CAST(senses AS BIGINT) AS senses, proto_id, CAST(occurrences AS BIGINT) AS occurrences FROM j")
def multi_sense_terms(t: Tables) -> DataFrame:
    return made_senses(t)


@query(f"""WITH {_MULTI}, b AS (SELECT DISTINCT term_id, senses FROM j ORDER BY senses DESC, term_id LIMIT 4)
    SELECT term_id, proto_id, CAST(row_number() OVER (PARTITION BY term_id ORDER BY occurrences DESC, proto_id) AS BIGINT) AS rank FROM j WHERE term_id IN (SELECT term_id FROM b) QUALIFY rank <= 2""")
def select_topn(t: Tables) -> DataFrame:
    return maintenance.select_top(made_senses(t), 4, 2).select("term_id", "proto_id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_MULTI}, r AS (SELECT term_id, proto_id, occurrences AS n, row_number() OVER (PARTITION BY term_id ORDER BY proto_id) AS rank FROM j)
    SELECT term_id, proto_id, CAST(least(n, greatest(0, 25 - coalesce(sum(n) OVER (PARTITION BY term_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS allowed FROM r""")
def budget_limit(t: Tables) -> DataFrame:
    r = made_senses(t).selectExpr("term_id", "proto_id", "occurrences AS n", "row_number() OVER (PARTITION BY term_id ORDER BY proto_id) AS rank")
    return maintenance.limit_examples(r, 25).select("term_id", "proto_id", F.col("allowed").cast("long").alias("allowed"))


@query("""WITH d AS (SELECT role, conv_id * 100 + turn AS ord, text FROM conversations), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY role, lower(text) ORDER BY ord) = 1)
    SELECT role, ord, CAST(row_number() OVER (PARTITION BY role ORDER BY ord) AS BIGINT) AS n FROM f QUALIFY n <= 3""")
def distinct_examples(t: Tables) -> DataFrame:
    d = t.conversations.selectExpr("role AS proto_id", "conv_id * 100 + turn AS ord", "text AS sentence")
    return maintenance.distinct_examples(d).select(F.col("proto_id").alias("role"), "ord", F.col("n").cast("long").alias("n"))


# Redirects

_PAIRS = f"""p AS (SELECT p_partkey AS seq, {_NORM.format(c="p_name || ' ' || p_size")} AS r, {_NORM.format(c='p_type')} AS c FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT p_partkey, {_NORM.format(c='p_type')}, {_NORM.format(c='p_type')} FROM part WHERE p_partkey % 9 = 0),
    k AS (SELECT * FROM p WHERE regexp_matches(r, '[a-z]') AND regexp_matches(c, '[a-z]') AND r <> c)"""


def kept_pairs(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("seq"), F.expr("CASE WHEN p_partkey % 9 = 0 THEN p_type ELSE concat(p_name, ' ', p_size) END").alias("redirect"), F.col("p_type").alias("canonical"))
    return redirects.index_pairs(p)


@query(f"WITH {_PAIRS} SELECT {_BUCKET.format(c='r')} AS bucket, r AS redirect, arg_max(c, seq) AS canonical FROM k GROUP BY r")
def redirect_index(t: Tables) -> DataFrame:
    return redirects.redirect_map(kept_pairs(t))


@query(f"WITH {_PAIRS} SELECT {_BUCKET.format(c='c')} AS bucket, c AS canonical, array_to_string(list(DISTINCT r ORDER BY r), '|') AS redirects FROM k GROUP BY c")
def canonical_index(t: Tables) -> DataFrame:
    return redirects.canonical_map(kept_pairs(t)).select("bucket", "canonical", *joined("redirects"))


@query(f"""WITH {_PAIRS}, m AS (SELECT r, arg_max(c, seq) AS c FROM k GROUP BY r), cs AS (SELECT DISTINCT c FROM k), q AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN p_name || ' ' || p_size ELSE p_brand END AS title FROM part), n AS (SELECT *, {_NORM.format(c='title')} AS n FROM q)
    SELECT title, coalesce(m.c, cs.c) AS resolved FROM n LEFT JOIN m ON n.n = m.r LEFT JOIN cs ON n.n = cs.c""")
def redirect_resolve(t: Tables) -> DataFrame:
    q = t.part.select(F.expr("CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN concat(p_name, ' ', p_size) ELSE p_brand END").alias("title"))
    k = kept_pairs(t)
    return redirects.resolve(q, redirects.redirect_map(k), redirects.canonical_map(k))


@query(f"""WITH {_PAIRS}, cm AS (SELECT c, list(DISTINCT r ORDER BY r) AS rs FROM k GROUP BY c), q AS (SELECT DISTINCT p_type AS title FROM part UNION ALL SELECT 'zzz')
    SELECT title, coalesce(array_to_string(list_concat([c], rs), '|'), '') AS synonyms FROM q LEFT JOIN cm ON {_NORM.format(c='title')} = c""")
def redirect_synonyms(t: Tables) -> DataFrame:
    q = t.part.select(F.col("p_type").alias("title")).distinct().union(t.spark.sql("SELECT 'zzz' AS title"))
    k = kept_pairs(t)
    return redirects.synonyms(q, redirects.redirect_map(k), redirects.canonical_map(k)).select("title", *joined("synonyms"))


@query(f"WITH {_PAIRS} SELECT CAST(count(*) AS BIGINT) AS inserted, CAST(count(DISTINCT r) AS BIGINT) AS redirects, CAST(count(DISTINCT c) AS BIGINT) AS canonicals FROM k")
def redirect_stats(t: Tables) -> DataFrame:
    return redirects.stats(kept_pairs(t))


@query("""WITH r AS (SELECT ps % 1000 AS page_id, ps AS seq, 'target ' || CAST(ps AS VARCHAR) AS target FROM (SELECT p_partkey AS ps FROM part) WHERE ps % 4 = 0), last AS (SELECT page_id, arg_max(target, seq) AS canonical FROM r GROUP BY 1)
    SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS redirect, canonical FROM part JOIN last ON p_partkey = page_id WHERE p_partkey % 2 = 0""")
def redirect_pairs_join(t: Tables) -> DataFrame:
    page = t.part.selectExpr("p_partkey AS page_id", "0L AS namespace", "concat(p_name, ' ', p_partkey) AS title", "CASE WHEN p_partkey % 2 = 0 THEN 1L ELSE 0L END AS is_redirect")
    red = t.part.where("p_partkey % 4 = 0").selectExpr("p_partkey % 1000 AS page_id", "0L AS namespace", "concat('target ', p_partkey) AS target_title", "p_partkey AS seq")
    return redirects.redirect_pairs(page, red)


@query("SELECT n_nationkey AS key, replace(n_name, '_', ' ') || '''s' AS title, 'it' AS other FROM nation")
def sql_values_parse(t: Tables) -> DataFrame:
    """Tuples of a dump line for each nation, parsed back."""
    lines = t.nation.select(F.col("n_nationkey").cast("long").alias("line"), F.concat(F.lit("("), "n_nationkey", F.lit(",'"), "n_name", F.lit("\\'s','it',NULL)")).alias("values"))
    r = sqldump.tuples(lines)
    return r.select(sqldump.number(F.col("row"), 0).cast(dict(t.nation.dtypes)["n_nationkey"]).alias("key"), sqldump.value(F.col("row"), 1).alias("title"), sqldump.value(F.col("row"), 2).alias("other"))


# Documents


@query("""WITH e AS (SELECT doc_id AS seq, source || ' ' || lang AS title, trim(text) AS text FROM documents), b AS (SELECT title, min(seq) AS first, arg_min(text, -length(text) * 100000000.0 + seq) AS text FROM e GROUP BY 1)
    SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS doc_id, title, length(text) AS n FROM b""")
def longest_doc_dedup(t: Tables) -> DataFrame:
    d = hotpot.documents(t.documents.select(F.col("doc_id").alias("seq"), F.concat_ws(" ", "source", "lang").alias("title"), "text"))
    return d.select("doc_id", "title", F.length("text").cast("long").alias("n"))


@query("""WITH e AS (SELECT source AS title, min(doc_id) AS first FROM documents GROUP BY 1), d AS (SELECT title, row_number() OVER (ORDER BY first) - 1 AS id FROM e), g AS (SELECT item_id, 'src' || CAST(item_id % 25 AS VARCHAR) AS title FROM benchmark)
    SELECT item_id, CAST(id AS BIGINT) AS gold FROM g JOIN d ON g.title = d.title""")
def gold_join(t: Tables) -> DataFrame:
    d = hotpot.documents(t.documents.select(F.col("doc_id").alias("seq"), F.col("source").alias("title"), "text"))
    return t.benchmark.select("item_id", F.expr("concat('src', item_id % 25)").alias("title")).join(d, "title").select("item_id", F.col("doc_id").alias("gold"))


@query("""SELECT CAST(count(*) AS BIGINT) AS documents, CAST(count(DISTINCT lang || ' ' || source) AS BIGINT) AS keys, CAST(count(*) FILTER (WHERE lang = 'en') AS BIGINT) AS english, CAST(count(*) FILTER (WHERE lang <> 'en') AS BIGINT) AS other FROM documents""")
def index_stats(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("documents"), F.count_distinct(F.concat_ws(" ", "lang", "source")).alias("keys"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("lang") != "en").alias("other"))


@query("""WITH r AS (SELECT source AS lookup_term, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents)
    SELECT CAST(row_number() OVER (ORDER BY lookup_term, pos) - 1 AS BIGINT) AS record_index, lookup_term, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'term ' || CAST(doc_id AS VARCHAR) END AS text, '' AS title FROM r""")
def store_upgrade(t: Tables) -> DataFrame:
    rec = F.struct("doc_id", F.expr("concat('term ', doc_id)").alias("term"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'text' END").alias("text"), F.lit(None).cast("string").alias("title"))
    old = t.documents.groupBy(F.col("source").alias("lookup_term")).agg(F.sort_array(F.collect_list(rec)).alias("records"))  # the old form: a list a term
    return store.upgrade_records(old).select("record_index", "lookup_term", "doc_id", "text", "title")


@query(r"""SELECT doc_id, CASE WHEN length(text) >= 12 THEN substr(text, 1, 5) || '[TGT] ' || substr(text, 6, 7) || ' [TGT]' || substr(text, 13) ELSE text END AS marked, CAST(CASE WHEN length(text) >= 12 THEN 11 ELSE -1 END AS BIGINT) AS s, CAST(CASE WHEN length(text) >= 12 THEN 18 ELSE -1 END AS BIGINT) AS e,
    CASE WHEN length(text) < 12 OR z = '' THEN trim(text) ELSE z END AS sentence FROM (SELECT *, trim(regexp_extract(substr(text, 1, 5), '([^.?!]*)$', 1) || substr(text, 6, 7) || regexp_extract(substr(text, 13), '^([^.?!]*[.?!]?)', 1)) AS z FROM documents)""")
def target_mark(t: Tables) -> DataFrame:
    """A text that ends before the span's end stays unmarked: -1 for its place, the whole text as sentence; a null text stays null."""
    m = t.documents.select("doc_id", "text", T.mark_target(F.col("text"), F.lit(5), F.lit(12)).alias("m"), T.sentence_of_span(F.col("text"), F.lit(5), F.lit(12)).alias("sentence"))
    held = lambda c, other: F.when(F.length("text") >= 12, c).otherwise(other)
    return m.select("doc_id", held(F.col("m.text"), F.col("text")).alias("marked"), held(F.col("m.start").cast("long"), F.lit(-1)).alias("s"), held(F.col("m.end").cast("long"), F.lit(-1)).alias("e"), held(F.col("sentence"), F.trim("text")).alias("sentence"))


_OVER = r"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z][a-z0-9_\-]*'), lambda w: length(w) > 2))"


@query(f"""WITH d AS (SELECT doc_id, {_OVER.format(c='text')} AS x FROM documents), b AS (SELECT item_id, {_OVER.format(c='text')} AS y FROM benchmark),
    p AS (SELECT doc_id, item_id, len(x) AS nx, len(y) AS ny, len(list_intersect(x, y)) AS shared FROM d CROSS JOIN b)
    SELECT doc_id, item_id, round(shared / (nx + ny - shared), 6) AS overlap FROM p WHERE shared > 0""")
def lexical_overlap(t: Tables) -> DataFrame:
    """All documents with all items, by the terms they share; pairs that share none are left out."""
    d, b = (x.select(i, T.overlap_terms(F.col("text")).alias("terms")) for x, i in ((t.documents, "doc_id"), (t.benchmark, "item_id")))
    return senses.overlaps(d, "doc_id", b, "item_id").withColumn("overlap", F.round("overlap", 6))


# Lexical graph


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN w || ' has no WordNet definition.' ELSE
    CASE WHEN n_nationkey % 3 = 1 THEN 'To ' || w || ' is to' WHEN n_nationkey % 3 = 2 THEN w || ' means' WHEN regexp_matches(w, 's$') AND NOT regexp_matches(w, '(ss|us|is)$') AND w <> 'news' THEN w || ' are'
    ELSE CASE WHEN regexp_matches(w, '^(honest|honor|hour|heir)') THEN 'An' WHEN regexp_matches(w, '^(one|uni|use|user|euro|ufo)') THEN 'A' WHEN regexp_matches(w, '^[aeiou]') THEN 'An' ELSE 'A' END || ' ' || w || ' is' END || ' part of the world.' END
    || ' Lemmas are ' || w || ', ' || w || ' land.' AS summary FROM (SELECT n_nationkey, lower(replace(n_name, '_', ' ')) AS w FROM nation)""")
def synset_summary(t: Tables) -> DataFrame:
    s = t.nation.selectExpr("n_nationkey", "concat(lower(replace(n_name, ' ', '_')), '.n.01') AS synset", "CASE n_nationkey % 3 WHEN 1 THEN 'v' WHEN 2 THEN 'a' ELSE 'n' END AS pos", "CASE WHEN n_nationkey % 4 <> 0 THEN 'part of the world' END AS definition", "array(translate(lower(n_name), '_', ' '), concat(translate(lower(n_name), '_', ' '), ' land'), '(none)') AS lemmas")
    return s.select("n_nationkey", lexkg.summary(s, {"Lemmas": "lemmas"}).alias("summary"))


@query("SELECT lower(n_name) || '.n.01' AS synset FROM nation WHERE n_nationkey % 2 = 0 AND lower(n_name) = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 4)")
def synset_filter(t: Tables) -> DataFrame:
    s = t.nation.selectExpr("concat(lower(replace(n_name, ' ', '_')), '.n.01') AS synset", "CASE WHEN n_nationkey % 2 = 0 THEN 'n' ELSE 'v' END AS pos", "array(n_name) AS lemmas")
    word = t.nation.where("n_nationkey = 4").select(F.initcap("n_name").alias("word"))
    return lexkg.filter_synsets(s.crossJoin(F.broadcast(word)), F.col("word"), noun_only=True, exact=True).select("synset")  # one row


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS pos, n_name AS x FROM nation WHERE n_regionkey = 0 QUALIFY pos <= 10), b AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS pos, r_name AS y FROM region QUALIFY pos <= 3)
    SELECT CAST(coalesce(a.pos, b.pos) AS BIGINT) AS pos, coalesce(x, '(none)') AS "left", coalesce(y, '(none)') AS "right" FROM a FULL JOIN b ON a.pos = b.pos""")
def compare_zip(t: Tables) -> DataFrame:
    left = t.nation.where("n_regionkey = 0").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("item"))
    right = t.region.where("r_regionkey < 3").select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("item"))
    return lexkg.compare(left, right).withColumn("pos", F.col("pos").cast("long"))


@query("""WITH e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
    SELECT 's' || s_suppkey AS synset, 'r' || n_regionkey || ' > n' || n_nationkey || ' > s' || s_suppkey AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def hypernym_paths(t: Tables) -> DataFrame:
    e = t.supplier.selectExpr("concat('s', s_suppkey) AS src", "concat('n', s_nationkey) AS dst").union(t.nation.selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)"))
    return lexkg.hypernym_paths(t.supplier.selectExpr("concat('s', s_suppkey) AS synset"), e).select("synset", F.array_join("path", " > ").alias("path"))


@query("""SELECT n_nationkey, string_agg(r_name || ' - ' || 'region', '|' ORDER BY r_regionkey) AS items FROM nation, region WHERE r_regionkey <= n_regionkey GROUP BY 1""")
def related_synsets(t: Tables) -> DataFrame:
    e = t.nation.join(F.broadcast(t.region), F.expr("r_regionkey <= n_regionkey")).selectExpr("n_nationkey AS src", "'hypernyms' AS rel", "concat(r_name, '.n.01') AS dst", "r_regionkey AS ord")
    s = t.region.selectExpr("concat(r_name, '.n.01') AS synset", "'region' AS definition")
    return lexkg.related(s, e).select(F.col("synset").alias("n_nationkey"), *joined("items"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Q' || user_id || ' (item)' WHEN 1 THEN event_type WHEN 2 THEN event_type || ' [en]' WHEN 3 THEN '+2000 (precision=9)' WHEN 4 THEN '+5 (unit=Q11573)' ELSE '(somevalue)' END AS text FROM events""")
def claim_decode(t: Tables) -> DataFrame:
    v = lambda kind, value: f"""'{{"mainsnak":{{"snaktype":"value","datavalue":{{"type":"{kind}","value":{value}}}}}}}'"""
    claim = F.expr(
        "CASE event_id % 6 WHEN 0 THEN replace(" + v("wikibase-entityid", '{"entity-type":"item","id":"Q@"}') + ", '@', CAST(user_id AS STRING)) WHEN 1 THEN replace(" + v("string", '"@"') + ", '@', event_type) WHEN 2 THEN replace(" + v("monolingualtext", '{"text":"@","language":"en"}') + ", '@', event_type)"
        " WHEN 3 THEN " + v("time", '{"time":"+2000","precision":9}') + " WHEN 4 THEN " + v("quantity", '{"amount":"+5","unit":"http://www.wikidata.org/entity/Q11573"}') + """ ELSE '{"mainsnak":{"snaktype":"somevalue"}}' END"""
    )
    return t.events.select("event_id", lexkg.decode_claim(claim).alias("text"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS label, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '|second' ELSE lower(n_name) END AS aliases FROM nation""")
def alias_pick(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", F.expr("CASE WHEN n_nationkey % 2 = 0 THEN map('en', named_struct('value', n_name), 'fr', named_struct('value', 'x')) ELSE map('fr', named_struct('value', lower(n_name))) END").alias("m"), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN map('en', array(named_struct('value', n_name), named_struct('value', ''), named_struct('value', 'second'))) ELSE map('fr', array(named_struct('value', lower(n_name)))) END").alias("a"))
    return n.select("n_nationkey", lexkg.lang_value(F.col("m"), "en").alias("label"), lexkg.aliases(F.col("a"), "en").alias("aliases")).select("n_nationkey", "label", *joined("aliases"))


@query("""WITH c AS (SELECT user_id % 20 AS entity, event_type AS prop, row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY event_id) - 1 AS pos, event_id, count(*) OVER (PARTITION BY user_id % 20, event_type) AS n FROM events), o AS (SELECT DISTINCT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS po FROM events)
    SELECT entity, prop, CAST(pos AS BIGINT) AS pos, 'e' || event_id AS text, CAST(greatest(n - 2, 0) AS BIGINT) AS more FROM c JOIN o ON prop = event_type WHERE po < 3 AND pos < 2""")
def top_claims(t: Tables) -> DataFrame:
    kinds = t.events.select("event_type").distinct().selectExpr("event_type AS prop", "row_number() OVER (ORDER BY event_type) - 1 AS prop_ord")
    c = t.events.selectExpr("user_id % 20 AS entity", "event_type AS prop", "row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY event_id) - 1 AS pos", """concat('{"mainsnak":{"snaktype":"value","datavalue":{"type":"string","value":"e', event_id, '"}}}') AS claim""")
    return lexkg.top_claims(c.join(F.broadcast(kinds), "prop"), 3, 2).select("entity", "prop", F.col("pos").cast("long").alias("pos"), "text", F.col("more").cast("long").alias("more"))


# Senses and metric

_FEAT = "f AS (SELECT vec_id // 5 AS context_id, vec_id % 5 AS sense_id, (vec_id * 37 % 100) / 100.0::DOUBLE AS a, (vec_id * 53 % 100) / 100.0::DOUBLE AS b, (vec_id * 71 % 100) / 100.0::DOUBLE AS c, (vec_id * 11 % 100) / 100.0::DOUBLE AS d FROM embeddings), s AS (SELECT *, 0.35 * a + 0.2 * b + 0.35 * c + 0.1 * d AS score FROM f)"


def made_features(t: Tables) -> DataFrame:
    f = [f"CAST(vec_id * {k} % 100 AS DOUBLE) / 100 AS {n}" for k, n in zip((37, 53, 71, 11), senses.WEIGHTS, strict=True)]
    return senses.score(t.embeddings.selectExpr("vec_id DIV 5 AS context_id", "vec_id % 5 AS sense_id", *f))


@query(f"WITH {_FEAT} SELECT context_id, sense_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY context_id ORDER BY round(score, 9) DESC, sense_id) AS BIGINT) AS rank FROM s")
def sense_features_rank(t: Tables) -> DataFrame:
    return senses.rank(made_features(t)).select("context_id", "sense_id", r6("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_FEAT}, b AS (SELECT context_id, sense_id FROM s QUALIFY row_number() OVER (PARTITION BY context_id ORDER BY round(score, 9) DESC, sense_id) = 1) SELECT CAST(x.i AS BIGINT) AS anchor_id, CAST(count(b.context_id) AS BIGINT) AS n FROM range(0, 7) x(i) LEFT JOIN b ON b.sense_id = x.i GROUP BY 1")
def best_sense_groups(t: Tables) -> DataFrame:
    """Groups of contexts by best sense, with the empty ones."""
    assigned = senses.best(made_features(t)).withColumnRenamed("sense_id", "anchor_id")
    return senses.groups(assigned, t.spark.range(0, 7).withColumnRenamed("id", "anchor_id"))


@query(f"""WITH {_CENTRE} SELECT occ_id AS rec_id, arg_min(cen.term_id, -round(list_cosine_similarity(v, centre), 9)) AS anchor_id FROM occ, cen GROUP BY 1""")
def anchor_assignment(t: Tables) -> DataFrame:
    anchors = t.protos.select(F.col("proto_id").alias("anchor_id"), "centre")
    return senses.assign_anchors(t.occurrences.select(F.col("occ_id").alias("rec_id"), "embed"), anchors).select("rec_id", "anchor_id")


@query("""WITH r AS (SELECT source AS q_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, 'Title  ' || CAST(doc_id AS VARCHAR) AS title, doc_id FROM documents), g AS (SELECT source AS q_id, 'title ' || CAST(d.doc_id AS VARCHAR) AS t FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 0),
    h AS (SELECT r.q_id, min(rank) AS k FROM r JOIN g ON r.q_id = g.q_id AND lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) = t WHERE rank <= 10 GROUP BY 1)
    SELECT q.q_id, round(coalesce(1.0 / k, 0.0), 6)::DOUBLE AS rr FROM (SELECT DISTINCT q_id FROM r) q LEFT JOIN h ON q.q_id = h.q_id""".replace("\\\\", "\\"))
def mrr_at_k(t: Tables) -> DataFrame:
    ranked = t.documents.selectExpr("source AS q_id", "row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank", "concat('Title  ', doc_id) AS title")
    gold = t.documents.join(t.labels.where("quality = 0"), "doc_id").selectExpr("source AS q_id", "concat('title ', doc_id) AS title")
    return senses.reciprocal_rank(ranked, gold).select("q_id", r6("rr"))


# The engine end to end


_TOKEN = "[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*"
_VALID = rf"NOT list_contains([{_STOP}], lower(w)) AND NOT regexp_full_match(w, '\d+(\.\d+)?') AND length(w) >= 2 AND NOT (length(w) <= 2 AND w = lower(w) AND regexp_matches(w, '[a-z]'))"
_BUILT = f"""d AS (SELECT doc_id, lower(regexp_replace({SQUEEZED}, '["'']', '', 'g')) AS text FROM documents), s AS MATERIALIZED (SELECT doc_id, {_SENTS.format(c="text")} AS s FROM d),
    g(doc_id, i, chunk, n) AS (SELECT doc_id, 1, 1, len(string_split(s[1], ' ')) FROM s WHERE len(s) > 0
      UNION ALL SELECT g.doc_id, i + 1, CASE WHEN n + len(string_split(s[i + 1], ' ')) > 300 THEN chunk + 1 ELSE chunk END, CASE WHEN n + len(string_split(s[i + 1], ' ')) > 300 THEN 0 ELSE n END + len(string_split(s[i + 1], ' '))
      FROM g JOIN s ON g.doc_id = s.doc_id WHERE i < len(s)),
    c AS (SELECT g.doc_id, chunk, string_agg(s[i], ' ' ORDER BY i) AS text FROM g JOIN s ON g.doc_id = s.doc_id GROUP BY 1, 2),
    ch AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, chunk) - 1 AS chunk_id, doc_id, regexp_extract_all(text, '{_TOKEN}') AS toks FROM c),
    st AS MATERIALIZED (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM ch),
    tf AS MATERIALIZED (SELECT term, chunk_id, num_tokens, count(*) AS tf FROM (SELECT chunk_id, len(toks) AS num_tokens, unnest(list_filter(toks, lambda w: {_VALID})) AS term FROM ch) GROUP BY ALL),
    df AS MATERIALIZED (SELECT term, count(*) AS df, ln(((SELECT n FROM st) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY 1),
    bm AS MATERIALIZED (SELECT tf.term, chunk_id, tf, df, idf, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * num_tokens / (SELECT avg_len FROM st))) AS bm25 FROM tf JOIN df ON tf.term = df.term)"""


def plain_words(df: DataFrame, col: str) -> DataFrame:
    """An annotator that finds words only."""
    none = F.array().cast("array<struct<s:int,e:int,text:string>>")
    return df.withColumns({"ents": none, "chunks": none, "toks": spans.placed(F.col(col), spans.TOKEN)})


def built_index(t: Tables, **options) -> engine.Index:
    """An index of all documents by plain words, with one prototype a term."""
    return engine.index(t.documents, tables_of(t), plain_words, clean=T.clean_basic, **({"buffer_size": 1 << 60} | options))


@query(f"WITH RECURSIVE {_BUILT} SELECT term, chunk_id, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf, round(bm25, 6) AS bm25 FROM bm")
def index_build(t: Tables) -> DataFrame:
    """Documents to chunks, terms, prototypes and scores: every term's score in every chunk."""
    ix = built_index(t)
    named = ix.terms.select("term_id", "term", F.col("df").alias("term_df"), F.col("idf").alias("term_idf")).join(ix.protos.select("proto_id", "term_id"), "term_id")
    return ix.scores.select("proto_id", "chunk_id", "tf", "bm25").join(named, "proto_id").select("term", "chunk_id", "tf", F.col("term_df").alias("df"), F.round("term_idf", 6).alias("idf"), r6("bm25"))


_BYTES = "list_transform(range(0, 16), lambda j: ('0x' || substr(md5({w}), 2 * CAST(j AS INT) + 1, 2))::INT / 127.5 - 1)"
_NEXT = "list_transform(range(1, 17), lambda j: v[j] + 0.25 * coalesce(l[j], 0) + 0.25 * coalesce(r[j], 0))"


@query(f"""WITH RECURSIVE {_BUILT}, w AS MATERIALIZED (SELECT w, {_BYTES.format(w='w')} AS v FROM (SELECT DISTINCT unnest(toks) AS w FROM ch)),
    o AS (SELECT chunk_id, unnest(toks) AS w, unnest(range(0, len(toks))) AS i FROM ch), ov AS MATERIALIZED (SELECT chunk_id, i, o.w, v FROM o JOIN w ON o.w = w.w),
    ctx AS (SELECT w, {_NEXT} AS v FROM (SELECT chunk_id, i, w, v, lag(v) OVER x AS l, lead(v) OVER x AS r FROM ov WINDOW x AS (PARTITION BY chunk_id ORDER BY i)) WHERE {_VALID}),
    mean AS (SELECT w, j, avg(x) AS x FROM (SELECT w, unnest(list_transform(v, lambda a: a / sqrt(list_dot_product(v, v)))) AS x, unnest(range(0, 16)) AS j FROM ctx) GROUP BY 1, 2),
    cen AS MATERIALIZED (SELECT w AS term, list(x ORDER BY j) AS c FROM mean GROUP BY 1),
    q0 AS (SELECT regexp_extract_all(lower(regexp_replace({SQUEEZED}, '["'']', '', 'g')) || ' zzqx qqzy', '{_TOKEN}') AS toks FROM benchmark WHERE item_id = 0),
    q1 AS (SELECT unnest(toks) AS w, unnest(range(0, len(toks))) AS i FROM q0), q2 AS (SELECT w, i, {_BYTES.format(w='w')} AS v FROM q1),
    q3 AS (SELECT row_number() OVER (ORDER BY i) AS span, w, v FROM (SELECT w, i, {_NEXT} AS v FROM (SELECT w, i, v, lag(v) OVER (ORDER BY i) AS l, lead(v) OVER (ORDER BY i) AS r FROM q2)) WHERE {_VALID}),
    sem AS (SELECT span, arg_min(cen.term, struct_pack(a := -round(list_cosine_similarity(v, c), 9), b := cen.term)) AS term FROM q3 CROSS JOIN cen WHERE w NOT IN (SELECT term FROM cen) GROUP BY 1),
    nodes AS MATERIALIZED (SELECT span AS node, coalesce(sem.term, w) AS term, CASE WHEN sem.term IS NULL THEN 1 ELSE 3 END AS level FROM q3 LEFT JOIN sem USING (span)),
    mem AS MATERIALIZED (SELECT node, chunk_id FROM nodes JOIN bm ON nodes.term = bm.term), kk AS (SELECT node, count(*) AS k FROM mem GROUP BY 1),
    e AS (SELECT x.node AS a, y.node AS b, count(*) / sqrt(CAST(any_value(p.k) * any_value(q.k) AS DOUBLE)) AS w FROM mem x JOIN mem y ON x.chunk_id = y.chunk_id AND x.node < y.node JOIN kk p ON x.node = p.node JOIN kk q ON y.node = q.node GROUP BY 1, 2),
    nw AS (SELECT n.node, n.term, sum(w * [1.2, 1.0, 0.8, 0.5][level + 1]) AS weight FROM (SELECT a AS node, w FROM e UNION ALL SELECT b, w FROM e) z JOIN nodes n ON z.node = n.node GROUP BY ALL),
    cw AS (SELECT chunk_id, sum(weight * bm25) AS weight FROM (SELECT bm.chunk_id, weight, bm25 FROM nw JOIN bm ON nw.term = bm.term QUALIFY row_number() OVER (PARTITION BY bm.chunk_id, nw.term ORDER BY node) = 1) GROUP BY 1),
    lr AS (SELECT level, chunk_id, row_number() OVER (PARTITION BY level ORDER BY round(score, 9) DESC, chunk_id) AS pos FROM (SELECT level, bm.chunk_id, sum(bm25) AS score FROM nodes JOIN bm ON nodes.term = bm.term GROUP BY 1, 2)),
    con AS MATERIALIZED (SELECT chunk_id, row_number() OVER (ORDER BY round(weight, 9) DESC, chunk_id) AS ord FROM cw QUALIFY ord <= 8), nc AS (SELECT count(*) AS n FROM con),
    iso AS (SELECT chunk_id, row_number() OVER (ORDER BY level, pos) AS ord FROM lr WHERE chunk_id NOT IN (SELECT chunk_id FROM con)),
    a AS (SELECT ord, chunk_id, 'connected' AS part FROM con UNION ALL SELECT n + ord, chunk_id, 'isolated' FROM iso CROSS JOIN nc WHERE ord <= CASE WHEN n < 8 THEN 10 - n ELSE 2 END)
    SELECT CAST(ord AS BIGINT) AS ord, a.chunk_id, part, doc_id FROM a JOIN ch ON a.chunk_id = ch.chunk_id""")
def multi_level_text(t: Tables) -> DataFrame:
    """The flagship from text: a benchmark item and two unknown words against an index of all documents."""
    text = t.benchmark.where("item_id = 0").first().text + " zzqx qqzy"
    got = engine.query(built_index(t), text, annotate=plain_words, clean=T.clean_basic)
    return got.select(F.col("ord").cast("long").alias("ord"), "chunk_id", "part", "doc_id")


@query()
def sense_index(t: Tables) -> DataFrame:
    """Prototypes of terms whose buffers filled: clustered where the occurrences do not concentrate, one otherwise (tests compare with NumPy)."""
    protos, members = prototypes.indexed(t.occurrences, 20, keep=tables_of(t).keeper())
    return members.select("occ_id", "term_id", "proto_id", "anomaly")


@query("""WITH m AS (SELECT CAST(label AS BIGINT) AS term_id, label * 3 + CASE WHEN label % 3 = 1 THEN 0 ELSE vec_id % 3 END AS proto_id, vec_id % 50 AS chunk_id FROM embeddings), n AS (SELECT count(DISTINCT chunk_id) AS n FROM m)
    SELECT term_id, CAST(count(DISTINCT chunk_id) AS BIGINT) AS df, round(ln(((SELECT n FROM n) + 1) / (count(DISTINCT chunk_id) + 1)) + 1, 6) AS idf FROM m GROUP BY 1""")
def term_level_idf(t: Tables) -> DataFrame:
    """A term's chunks over all its prototypes."""
    return scoring.document_frequencies(sense_rows(t).select("term_id", "chunk_id").distinct(), "term_id", "chunk_id", scoring.corpus_stats(t.chunks, "num_tokens")).select("term_id", "df", r6("idf"))


@query(f"""WITH {_CENTRE}, r AS (SELECT *, row_number() OVER (PARTITION BY term_id, chunk_id ORDER BY sim DESC) AS k FROM sim) SELECT term_id AS proto_id, chunk_id, round(avg(sim), 6) AS sim FROM r WHERE k <= 3 GROUP BY 1, 2""")
def combined_sims(t: Tables) -> DataFrame:
    s = vectors.similarities(t.occurrences, vectors.centres(t.occurrences, "term_id"), "term_id").withColumnRenamed("term_id", "proto_id")
    return vectors.combined_similarity(s).select("proto_id", "chunk_id", r6("sim"))


@query(f"""WITH {_MULTI}, b AS (SELECT term_id FROM j WHERE contains(CAST(term_id AS VARCHAR), '2') OR contains(CAST(term_id AS VARCHAR), '3') GROUP BY 1 ORDER BY sum(occurrences) DESC, term_id LIMIT 3)
    SELECT term_id, proto_id, CAST(row_number() OVER (PARTITION BY term_id ORDER BY occurrences DESC, proto_id) AS BIGINT) AS rank FROM j WHERE term_id IN (SELECT term_id FROM b)
    UNION ALL SELECT term_id, proto_id, CAST(row_number() OVER (PARTITION BY term_id ORDER BY occurrences DESC, proto_id) AS BIGINT) FROM j WHERE term_id IN (SELECT DISTINCT term_id FROM j ORDER BY lower(CAST(term_id AS VARCHAR)), term_id LIMIT 2)""")
def select_by_other_keys(t: Tables) -> DataFrame:
    """The three terms with most occurrences among those whose name holds 2 or 3; the first two by name."""
    made = made_senses(t)
    held = maintenance.select_top(made.where("contains(term_id, '2') OR contains(term_id, '3')"), 3, None, by="occurrences")
    return held.unionByName(maintenance.select_top(made, 2, None, by="name")).select("term_id", "proto_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT n_nationkey, lower(n_name) || '.n.01' AS synset, 'noun' AS pos, CASE WHEN n_nationkey % 4 = 0 THEN '(none)' ELSE 'a nation' END AS definition, n_name AS lemmas, lower(r_name) || ' - a region' AS hypernyms,
    CASE WHEN n_nationkey % 2 = 0 THEN replace(lower(n_name), '_', ' ') || ' - a nation of its own' ELSE '' END AS attributes FROM nation JOIN region ON n_regionkey = r_regionkey""")
def synset_details(t: Tables) -> DataFrame:
    """The record of every nation, looked up by its name with other spelling, with its region and, for every other one, an attribute."""
    synsets = t.nation.selectExpr("concat(lower(n_name), '.n.01') AS synset", "'n' AS pos", "CASE WHEN n_nationkey % 4 <> 0 THEN 'a nation' ELSE ' ' END AS definition", "CAST(NULL AS ARRAY<STRING>) AS examples", "array(n_name) AS lemmas")
    regions = t.region.selectExpr("concat(lower(r_name), '.n.01') AS synset", "'n' AS pos", "'a region' AS definition", "CAST(NULL AS ARRAY<STRING>) AS examples", "array(r_name) AS lemmas")
    own = t.nation.where("n_nationkey % 2 = 0").selectExpr("concat(lower(n_name), '.a.01') AS synset", "'a' AS pos", "'a nation of its own' AS definition", "CAST(NULL AS ARRAY<STRING>) AS examples", "array(n_name) AS lemmas")
    e = t.nation.join(F.broadcast(t.region), F.expr("n_regionkey = r_regionkey")).selectExpr("concat(lower(n_name), '.n.01') AS src", "'hypernyms' AS rel", "concat(lower(r_name), '.n.01') AS dst", "0 AS ord")
    e = e.union(t.nation.where("n_nationkey % 2 = 0").selectExpr("concat(lower(n_name), '.n.01')", "'attributes'", "concat(lower(n_name), '.a.01')", "0"))
    lemmas = t.nation.selectExpr("lower(n_name) AS lemma", "concat(lower(n_name), '.n.01') AS synset", "0 AS ord")
    words = t.nation.select(F.translate("n_name", "_", " ").alias("word"))
    d = lexkg.details(words, lemmas, synsets.union(regions).union(own), e, pos="n", noun_only=True, exact=True)
    n = t.nation.select("n_nationkey", F.concat(F.lower("n_name"), F.lit(".n.01")).alias("synset"))
    return d.join(n, "synset").select("n_nationkey", "synset", "pos", "definition", *joined("lemmas", "hypernyms", "attributes"))


@query("""SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS forms FROM (SELECT p_partkey, [x, replace(x, '_', ' '), replace(x, ' ', '_')] AS f, list_filter([x, replace(x, ' ', '_'), lower(x), lower(replace(x, ' ', '_'))], lambda z: true) AS l,
    CASE WHEN lower(x) = x THEN [x, replace(x, ' ', '_')] ELSE [x, replace(x, ' ', '_'), lower(x), lower(replace(x, ' ', '_'))] END AS list_distinct_ordered FROM (SELECT p_partkey, trim(CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_name || ' x' ELSE upper(p_name) || ' X ' END) AS x FROM part))""")
def lookup_spellings(t: Tables) -> DataFrame:
    """Spellings of names of two words and more, each once, in order."""
    w = F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat(' ', p_name, ' x') ELSE concat(upper(p_name), ' X ') END")
    return t.part.select("p_partkey", lexkg.lookup_variants(w).alias("forms")).select("p_partkey", *joined("forms"))


_UNIT = "list_transform({v}, lambda a: a / sqrt(list_dot_product({v}, {v})))"


@query(f"""WITH {_OCC}, u AS (SELECT chunk_id, occ_id, v, {_UNIT.format(v='v')} AS n FROM occ),
    s AS (SELECT q.chunk_id, q.occ_id, q.n AS qn, k.v AS kv, list_dot_product(q.n, k.n) / sqrt(CAST(len(q.v) AS DOUBLE)) AS s FROM u q JOIN u k ON k.chunk_id = q.chunk_id + 1),
    w AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY occ_id) AS w FROM s),
    e AS (SELECT chunk_id, occ_id, any_value(qn) AS qn, j, sum(w * x) AS x FROM (SELECT chunk_id, occ_id, qn, w, unnest(kv) AS x, unnest(range(0, len(kv))) AS j FROM w) GROUP BY chunk_id, occ_id, j),
    a AS (SELECT chunk_id, list_cosine_similarity(any_value(qn), list(x ORDER BY j)) AS c FROM e GROUP BY chunk_id, occ_id)
    SELECT o.chunk_id, coalesce(round(avg(c), 6), 0.0) AS score FROM (SELECT DISTINCT chunk_id FROM occ) o LEFT JOIN a ON o.chunk_id = a.chunk_id GROUP BY 1""")
def cross_attention_align(t: Tables) -> DataFrame:
    """Chunks against the next chunk's vectors."""
    g = t.occurrences.groupBy("chunk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("occ_id", "embed"))), lambda x: x["embed"]).alias("vs"))  # one text's vectors
    other = g.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("vs").alias("ks"))
    return g.join(other, "chunk_id", "left").select("chunk_id", F.round(vectors.attention_alignment(F.col("vs"), F.col("ks")), 6).alias("score"))


@query(f"""WITH {_OCC}, m AS (SELECT chunk_id, list(x ORDER BY i) AS mean FROM (SELECT chunk_id, i, avg(x) AS x FROM (SELECT chunk_id, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM occ) GROUP BY 1, 2) GROUP BY 1)
    SELECT occ.chunk_id, occ_id AS pos, round(list_cosine_similarity(v, mean), 6) AS salience FROM occ JOIN m ON occ.chunk_id = m.chunk_id""")
def token_salience(t: Tables) -> DataFrame:
    s = vectors.salience(t.occurrences.select("chunk_id", F.col("occ_id").alias("pos"), "embed"), "chunk_id")
    return s.select("chunk_id", "pos", r6("salience"))


# Without an oracle: tests hold them against NumPy or plain Python


@query()
def sense_scores(t: Tables) -> DataFrame:
    """Every conversation turn as a context of its first word, with three candidate senses, by the four features over vectors of its text."""
    words = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("context_id"), "text", F.regexp_extract("text", r"[A-Za-z]{2,}", 0).alias("word")).where("word <> ''")
    contexts = words.select("context_id", "word", "text", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    made = words.select("word").distinct().select("word", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("ord"))
    c = made.select("word", "ord", F.concat_ws(".", F.lower("word"), F.lit("n"), "ord").alias("sense_id"), F.element_at(F.array(F.concat(F.lit("a thing called "), F.lower("word")), F.lit("the act of doing it with others"), F.concat_ws(" ", F.lit("one who is"), "word", F.lit("and not that"))), F.col("ord")).alias("profile"))
    return senses.score(senses.features(contexts, c, encoding.HashEncoder())).select("context_id", "sense_id", *[r6(k) for k in senses.WEIGHTS], r6("score"))


@query()
def hdbscan_prototypes(t: Tables) -> DataFrame:
    return cluster.clusters(t.occurrences, "term_id", "chunk_id", "embed", merge_chunks=True)


@query()
def pca_coords(t: Tables) -> DataFrame:
    """The first two principal components of all vectors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = t.embeddings.select("vec_id", array_to_vector(V.doubles(F.col("embedding"))).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="p").fit(d).transform(d).select("vec_id", vector_to_array("p").alias("p"))
    return out.select("vec_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query()
def extracted_spans(t: Tables) -> DataFrame:
    """Index-side spans of all documents by the default annotator."""
    d = spans.extracted(t.documents.select("doc_id", T.clean_text(F.col("text")).alias("text")))
    d = d.select("doc_id", F.explode_outer("spans").alias("x"))  # before an inner explode the optimizer asks for their number, by a second run over the texts
    return d.where("x IS NOT NULL").select("doc_id", "x.kind", "x.term", "x.s", "x.e")
