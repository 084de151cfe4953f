"""Operators on small fixtures."""

import math

import numpy as np
from pyspark.sql import functions as F

from spanloom.operators import cluster, extractor, lexkg, maintenance, prototypes, redirects, scoring, senses
from spanloom.sources import hotpot, sqldump
from spanloom.sources.store import TableSet


def test_idf_bm25(spark):
    r = spark.range(1).select(scoring.idf(F.lit(3), F.lit(1)).alias("idf")).select("idf", scoring.bm25(F.col("idf"), F.lit(2), F.lit(4), F.lit(5)).alias("b")).first()
    assert (round(r.idf, 6), round(r.b, 6)) == (1.693147, 2.466837)


def test_edges(spark):
    m = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (2, 4), (3, 9)], "node long, chunk long")
    assert [(r.a, r.b, round(r.weight, 6)) for r in scoring.shared_chunk_edges(m, "node", "chunk").collect()] == [(1, 2, round(1 / math.sqrt(6), 6))]


def lists(spark, rows):
    return spark.createDataFrame([(i, p, x) for i, l in enumerate(rows) for p, x in enumerate(l)], "list long, pos long, item long")


def test_extractor(spark):
    got = lambda d: [r.item for r in d.orderBy("ord").collect()]
    l, gone = lists(spark, [[1, 2, 3], [2, 4], [], [5]]), spark.createDataFrame([(2,)], "item long")
    assert got(extractor.extract(l, 3, gone)) == [1, 3, 4]
    assert got(extractor.extract(l, 4, gone, each=1)) == [1, 4, 5, 3]
    again = lists(spark, [[1], [1]])
    assert got(extractor.extract(again, 2)) == [1, 1]
    assert got(extractor.extract(again, 2, distinct=True)) == [1]
    assert extractor.budgets(10) == (8, 2)


def test_threshold(spark):
    d = spark.createDataFrame([(1, x) for x in (0.2, 0.8, 0.9, 1.0)], "k long, sim double")
    from spanloom.operators import vectors

    assert round(vectors.threshold(d, "k").first().threshold, 6) == 0.38


def test_redirects(spark):
    p = spark.createDataFrame([(1, "USA", "United_States"), (2, "U.S.", "United_States"), (3, "usa", "USA"), (4, "1984", "Orwell")], "seq long, redirect string, canonical string")
    k = redirects.index_pairs(p)
    r, c = redirects.redirect_map(k), redirects.canonical_map(k)
    assert {(x.redirect, x.canonical) for x in r.collect()} == {("usa", "united states"), ("u s", "united states")}
    assert c.first().redirects == ["u s", "usa"]
    q = spark.createDataFrame([("USA",), ("United States",), ("zzz",)], "title string")
    assert {x.title: x.resolved for x in redirects.resolve(q, r, c).collect()} == {"USA": "united states", "United States": "united states", "zzz": None}
    assert {x.title: x.synonyms for x in redirects.synonyms(q, r, c).collect()}["USA"] == ["united states", "u s", "usa"]


def test_dump_to_pairs(spark, tmp_path):
    (tmp_path / "page.sql").write_text("INSERT INTO `page` VALUES (1,0,'USA',1,'x'),(2,0,'Other',0,'x');\nother line\n")
    (tmp_path / "redirect.sql").write_text("INSERT INTO `redirect` VALUES (1,0,'United_States','');\n")
    read = lambda n: sqldump.tuples(sqldump.insert_values(spark, str(tmp_path / f"{n}.sql"), n))
    got = redirects.redirect_pairs(sqldump.pages(read("page")), sqldump.redirects(read("redirect"))).collect()
    assert [(r.redirect, r.canonical) for r in got] == [("USA", "United States")]


def test_mrr(spark):
    ranked = spark.createDataFrame([(1, 1, "X"), (1, 2, " paris  France")], "q_id long, rank int, title string")
    gold = spark.createDataFrame([(1, "Paris France")], "q_id long, title string")
    assert senses.reciprocal_rank(ranked, gold).first().rr == 0.5


def test_every_anchor_is_compared(spark):
    anchors = spark.range(10_300).selectExpr("id AS anchor_id", "array(cos(id * 1e-4D), sin(id * 1e-4D)) AS centre").union(spark.createDataFrame([(20_000, [0.0, 0.0])], "anchor_id long, centre array<double>"))
    at = [[math.cos(i * 1e-4), math.sin(i * 1e-4)] for i in (0, 5000, 10_200)]
    records = spark.createDataFrame([*enumerate([*at, [0.0, 0.0], None, [-1.0, -1.0]])], "rec_id long, embed array<double>")
    got = {r.rec_id: (r.anchor_id, r.sim is None) for r in senses.assign_anchors(records, anchors).collect()}
    assert got == {0: (0, False), 1: (5000, False), 2: (10_200, False), 3: (0, True), 4: (0, True), 5: (0, False)}


def test_hdbscan_finds_two_groups():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (30, 3)), rng.normal(3, 0.1, (30, 3)), [[20, 20, 20]]])
    labels = cluster.hdbscan(x, 5)
    assert len(set(labels[:30])) == 1 and len(set(labels[30:60])) == 1 and labels[0] != labels[30] and labels[60] == -1


def made_occurrences(spark, n=60):
    rng = np.random.default_rng(2)
    rows = [(t, i % 7, t * n + i, i // 20, [float(v) for v in rng.normal(0, 0.05, 4) + np.eye(4)[(t + (i % 2) * 2) % 4]]) for t in range(2) for i in range(n)]
    return spark.createDataFrame(rows, "term_id long, chunk_id long, occ_id long, batch_ord long, embed array<double>")


def test_every_occurrence_has_one_prototype(spark):
    o = made_occurrences(spark)
    protos, members = prototypes.senses(o, min_cluster_size=5)
    assert protos.count() == 4 and members.count() == members.select("occ_id").distinct().count() == 120
    _, members = prototypes.indexed(o, 25)
    assert members.count() == members.select("occ_id").distinct().count() == 120


def test_delete_keeps_dense_ids_and_undoes_add(spark):
    chunks = spark.createDataFrame([(c, c // 2, 5 + c) for c in range(6)], "chunk_id long, doc_id long, num_tokens long")
    members = spark.createDataFrame([(p, c) for p in range(3) for c in range(6) if (p + c) % 3 == 0 or (p == 2 and c == 5)], "proto_id long, chunk_id long")
    protos = spark.createDataFrame([(p, p) for p in range(3)], "proto_id long, term_id long")
    gone = spark.createDataFrame([(2,)], "doc_id long")
    left = maintenance.delete_documents(chunks, members, protos, protos.select("term_id"), gone)
    assert [r.new_chunk_id for r in left["chunks"].orderBy("chunk_id").collect()] == [0, 1, 2, 3]
    small = {"chunks": chunks.where("doc_id <> 2"), "members": members.where("chunk_id < 4")}
    as_rows = lambda d: sorted((r.proto_id, r.chunk_id, round(r.bm25, 9)) for r in d.collect())
    assert as_rows(maintenance.rebuild(left)) == as_rows(maintenance.rebuild(small))


def test_hypernym_paths(spark):
    e = spark.createDataFrame([("c", "b1"), ("c", "b2"), ("b1", "a"), ("b2", "a")], "src string, dst string")
    got = lexkg.hypernym_paths(spark.createDataFrame([("c",)], "synset string"), e).collect()
    assert sorted(tuple(r.path) for r in got) == [("a", "b1", "c"), ("a", "b2", "c")]


def test_hotpot(spark, tmp_path):
    (tmp_path / "h.json").write_text('[{"_id":"q","question":"x","answer":"y","supporting_facts":[["T",0],["T",1]],"context":[["T",["a ","bb"]],["U",["c"]],["T",["longer text here"]]]}]')
    docs, q = hotpot.retrieval_set(hotpot.samples(spark, str(tmp_path / "h.json")))
    assert [(r.doc_id, r.title, r.text) for r in docs.orderBy("doc_id").collect()] == [(0, "T", "longer text here"), (1, "U", "c")]
    assert q.first().gold_doc_ids == [0]


def test_table_set(spark, tmp_path):
    s = TableSet(spark, f"file://{tmp_path}/set")
    s.save("t", spark.range(3).withColumn("bucket", F.lit("a")), by="bucket")
    s.set_metadata(k=1)
    assert s.load("t", {"extra": "1"}).where("bucket = 'a'").count() == 3 and s.metadata() == {"k": 1}
    assert s.read_or_build("t", lambda: spark.range(9)).count() == 3
    s.clear()
    assert s.metadata() == {}


def test_redirect_chains_are_followed_exactly(spark):
    rows = [(f"a{i}", f"a{i + 1}") for i in range(14)] + [("x", "y"), ("y", "x")]
    r = spark.createDataFrame(rows, "redirect string, canonical string")
    for hops in (1, 2, 3, 7, 10):
        got = {x.redirect: x.canonical for x in redirects.closure(r, hops).collect()}
        assert got["a0"] == f"a{hops}" and got["a12"] == ("a13" if hops == 1 else "a14")


def test_parens_are_stripped_however_deep(spark):
    from spanloom.functions import text as T

    deep = "a " + "(" * 13 + "x" + ")" * 13 + " b (c) ((d)"
    got = spark.createDataFrame([(deep,), ("plain",), (None,)], "t string").select(T.strip_parens(F.col("t")).alias("s")).collect()
    assert [r.s and " ".join(r.s.split()) for r in got] == ["a b (", "plain", None]


def test_contexts_of_one_sample_never_clash_with_the_next(spark):
    entries = [(0, p, f"t{p}", "x" * (p % 7)) for p in range(1500)] + [(1, 0, "t1200", "longer text"), (1, 1, "new", "y")]
    from spanloom.sources import hotpot

    got = {r.title: (r.doc_id, r.text) for r in hotpot.documents(spark.createDataFrame(entries, "seq long, pos long, title string, text string")).collect()}
    assert got["t1200"] == (1200, "longer text") and got["new"][0] == 1500 and sorted(i for i, _ in got.values()) == list(range(1501))


def test_dense_ids_in_ranges(spark):
    import random

    from spanloom.operators import ids

    r = random.Random(1)
    words = [f"{r.choice(['http://', 'ab', 'É', ''])}{r.randrange(300)}" for _ in range(500)] + [None]
    got = {x.i: x.w for x in ids.dense(spark.createDataFrame([(w,) for w in words], "w string").repartition(3), "w", "i").collect()}
    assert [got[i] for i in range(501)] == sorted(words, key=lambda w: (w is not None, (w or "").encode()))
    n = spark.createDataFrame([(i % 40, i) for i in range(300)], "k long, v long")
    out = {(x.k, x.v): x.s for x in ids.starts(n, ["k", "v"], "s", F.col("v")).collect()}
    total = 0
    for k, v in sorted((i % 40, i) for i in range(300)):
        assert out[k, v] == total
        total += v


def test_large_groups_are_clustered(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.05, (300, 3)) + e for e in np.eye(3)])[rng.permutation(900)]
    monkeypatch.setattr(cluster, "MOST", 400)
    labels = cluster.labels_of(x, np.arange(900), 20, False)
    whole = x.argmax(axis=1)
    assert len(labels) == 900 and labels.max() == 2
    assert all(len({int(c) for c in labels[whole == k] if c >= 0}) == 1 for k in range(3)) and (labels[400:] >= 0).all()


def test_engine_from_text_and_deletion_undoes_addition(spark, tmp_path):
    from spanloom import engine

    words = "apple river Stone Bridge NASA engine window Green Valley garden paper".split()
    text = lambda i: ". ".join(" ".join(words[(i * 3 + j * 5 + k) % 11] for k in range(7)) for j in range(4)) + "."
    docs = [(i, text(i)) for i in range(9)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    store = lambda n: TableSet(spark, f"file://{tmp_path}/{n}")
    small = engine.index(df(docs[:7]), store("small"), chunk_tokens=20)
    large = engine.index(df(docs), store("large"), chunk_tokens=20)
    left = engine.delete(large, df(docs[7:]).select("doc_id"), store("left"))
    rows = lambda ix: sorted((r.term, r.chunk_id, round(r.bm25, 9)) for r in ix.scores.join(ix.protos.select("proto_id", "term_id"), "proto_id").join(ix.terms.select("term_id", "term"), "term_id").collect())
    assert rows(left) == rows(small) and len(rows(small)) > 20
    got = engine.query(large, "The Green Valley garden of zzz", top_k=5).orderBy("ord").collect()
    assert [r.ord for r in got] == [1, 2, 3, 4, 5] and all(r.text for r in got) and got[0].part == "connected"
    assert engine.query(large, "garden", top_k=3, search_mode="candidates").count() == 3
    kinds = {r.text: r.kind for r in engine.prepare(spark, "The Green Valley garden of NASA").collect()}
    assert kinds["NASA"] in ("ent", "token") and "green valley" in kinds and kinds["garden"] == "token"


def test_sense_features_against_numpy(spark):
    from spanloom.operators import encoding

    e = encoding.HashEncoder()
    e.load()
    ctx = spark.createDataFrame([(1, "bank", "He sat on the Bank of the river", None, None), (2, "bank", "no such thing", None, None)], "context_id long, word string, text string, start int, end int")
    cand = spark.createDataFrame([("bank", "bank.n.01", "sloping land beside the river"), ("bank", "bank.n.02", "")], "word string, sense_id string, profile string")
    got = {(r.context_id, r.sense_id): r for r in senses.features(ctx, cand, e).collect()}
    (off, v), = e.encode(["He sat on the [TGT] Bank [TGT] of the river"])
    (_, w), = e.encode(["sloping land beside the river"])
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    r = got[1, "bank.n.01"]
    assert abs(r.target_definition - cos(v[5], w.mean(axis=0))) < 1e-9 and abs(r.context_definition - cos(v[2:9].mean(axis=0), w.mean(axis=0))) < 1e-9
    assert abs(r.cross_alignment - encoding.alignment(v[5:6], w)) < 1e-9
    assert r.lexical_overlap > 0 and got[2, "bank.n.01"].target_definition == got[2, "bank.n.01"].cross_alignment == 0.0 and got[1, "bank.n.02"].context_definition == 0.0
    chosen, groups = senses.assign_contexts(ctx, cand, e)
    total = lambda r: sum(k * getattr(r, n) for n, k in senses.WEIGHTS.items())
    best = {i: max(("bank.n.01", "bank.n.02"), key=lambda x: (round(total(got[i, x]), 9), x == "bank.n.01")) for i in (1, 2)}
    assert {x.context_id: x.sense_id for x in chosen.collect()} == best
    n = [list(best.values()).count(x) for x in ("bank.n.01", "bank.n.02")]
    assert {x.sense_id: x.n for x in groups.collect()} == dict(zip(("bank.n.01", "bank.n.02"), n, strict=True))


def test_validity_of_files_and_words(spark, tmp_path):
    import gzip

    import pytest
    from spanloom.sources import store

    (tmp_path / "good.gz").write_bytes(gzip.compress(b"x" * 100_000) + gzip.compress(b"y"))
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"x" * 100_000)[:-5])
    (tmp_path / "none.gz").write_bytes(b"plain")
    got = {r.path.rsplit("/", 1)[1]: r.valid for r in store.valid_gzip(spark, str(tmp_path)).collect()}
    assert got == {"good.gz": True, "cut.gz": False, "none.gz": False}
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in store.binary_texts(spark, str(tmp_path), lambda b: str(len(b))).collect()}
    assert texts["none.gz"] == "5"
    with pytest.raises(ValueError):
        lexkg.check_word("  ")
    assert spark.range(1).select(lexkg.alias_text(F.array(F.lit("a"), F.lit(None), F.lit("b")), "array<string>").alias("x")).first().x == "a, b"


def test_containment_by_sweep_equals_all_pairs(spark):
    """Random intervals with ties, repeats and empty ones, some over a block's length; null and empty arrays."""
    import random

    from pyspark.sql import functions as F

    from spanloom.operators import spans

    rnd = random.Random(3)
    interval = lambda wide: (lambda s: (s, s + rnd.randint(0, 6)))(rnd.randint(0, wide))
    rows = [([interval(w) for _ in range(n)], [interval(w) for _ in range(m)]) for n, m, w in [(0, 0, 5), (0, 3, 5), (3, 0, 5), *[(rnd.randint(1, 25), rnd.randint(1, 25), 20) for _ in range(60)], (700, 300, 900)]]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate([*rows, (None, None)])], "id int, x array<struct<s:int,e:int>>, y array<struct<s:int,e:int>>")
    got = {r.id: r for r in d.select("id", spans.uncovered(F.col("x"), F.col("y")).alias("u"), spans.drop_contained(F.col("x")).alias("k")).collect()}
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1]
    for i, (x, y) in enumerate(rows):
        assert [tuple(v) for v in got[i].u] == [a for a in x if not any(inside(a, b) for b in y)]
        better = lambda j, a, k, b: j != k and inside(a, b) and (b[1] - b[0] > a[1] - a[0] or k < j)
        assert [tuple(v) for v in got[i].k] == [a for j, a in enumerate(x) if not any(better(j, a, k, b) for k, b in enumerate(x))]
    assert got[len(rows)].u is None and got[len(rows)].k is None


def test_normalised_vectors(spark):
    import math

    from pyspark.sql import functions as F

    from spanloom.functions import vectors as V

    d = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), (None, [1.0])], "x array<double>, y array<double>")
    got = d.select(V.normalized(F.col("x")).alias("n"), V.cosine(F.col("x"), F.col("y")).alias("c"), V.cosine_or_zero(F.col("x"), F.col("y")).alias("z")).collect()
    assert [r.n for r in got] == [[0.6, 0.8], [0.0, 0.0], [], None]
    assert math.isclose(got[0].c, 0.96) and [r.c for r in got[1:]] == [None] * 3 and [r.z for r in got[1:]] == [0.0] * 3
