"""Every query with an oracle against DuckDB at the smallest scale."""

import os
import re

import duckdb
import pytest

from spanloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name]).df()
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)
        rows = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
        assert rows(got).equals(rows(want))
    else:
        assert len(got) > 0


def test_more_spans_than_are_broadcast(spark, duck, monkeypatch):
    monkeypatch.setattr(catalogue.retrieval, "MOST_SPANS", 9)
    test_query(spark, duck, "resolve_matches")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


SPACES = r"[ \t\n\x0b\f\r]+"
ACRONYM, TITLE_RUN = r"\b[A-Z]{2,}\b", r"\b[A-Z][a-z]+(?:[ \t\n\x0b\f\r]+[A-Z][a-z]+)+\b"


def squeezed(text):
    return re.sub(SPACES, " ", text.replace("-\n", "")).strip(" ")


def cleaned(text):
    pieces = re.findall(rf"{ACRONYM}|{TITLE_RUN}|\w+|\W+", squeezed(text))
    return "".join(p if re.fullmatch(f"{ACRONYM}|{TITLE_RUN}", p) else re.sub("[\"']", "", p).lower() for p in pieces).strip(" ")


@pytest.fixture(scope="module")
def with_odd_texts(spark, tmp_path_factory):
    """The documents, and a null, an empty and some short texts with letters beside ASCII."""
    d = tmp_path_factory.mktemp("odd")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [None, "", "École NASA et ÉTATS Grande Été Le Monde Bleu", "caféNASA NASAé \"L'Été\" New York", "Straße Von Der Höhe"]
    docs.union(spark.createDataFrame([(10**6 + i, x) for i, x in enumerate(odd)], "doc_id long, text string")).write.parquet(f"{d}/documents.parquet")
    return str(d)


WHOLE = {
    "clean_protected": lambda x: cleaned(x),
    "acronym_spans": lambda x: "|".join(re.findall(ACRONYM, squeezed(x))),
    "title_spans": lambda x: "|".join(re.findall(TITLE_RUN, squeezed(x))),
    "clean_basic": lambda x: re.sub("[\"']", "", squeezed(x)).lower(),
    "word_counts": lambda x: len([w for w in re.split(SPACES, x or "") if w]),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_documents(spark, with_odd_texts, name):
    texts = dict(spark.read.parquet(f"{with_odd_texts}/documents.parquet").collect())
    got = {r[0]: r[1] for r in catalogue.QUERIES[name](spark, with_odd_texts).collect()}
    assert len(got) == 205
    assert got == {i: None if x is None and name != "word_counts" else WHOLE[name](x) for i, x in texts.items()}


def test_a_very_long_run_of_capitalised_or_hyphenated_words(spark):
    """No pattern recurses once a word, and places are found in linear time."""
    from pyspark.sql import functions as F

    n = 6000
    d = spark.createDataFrame([("Ab " * n,), ("a-" * n,), ("NASA " * n,), ("Ab ab " * n,)], "text string")
    runs, acronyms, cleaned_ = zip(*d.select(F.size(catalogue.T.title_runs(F.col("text"))), F.size(catalogue.T.acronyms(F.col("text"))), F.length(catalogue.T.clean_text(F.col("text")))).collect(), strict=True)
    assert runs == (1, 0, 0, 0) and acronyms == (0, 0, n, 0) and cleaned_ == (3 * n - 1, 2 * n, 5 * n - 1, 6 * n - 1)
    toks = catalogue.spans.annotate(d).select("ents", "toks").collect()
    assert [len(r.ents) for r in toks] == [1, 0, n, 0] and [len(r.toks) for r in toks] == [n, 1, n, 2 * n]
    assert (toks[3].toks[-1].s, toks[3].toks[-1].e, toks[3].toks[-1].text) == (6 * n - 3, 6 * n - 1, "ab")


def test_short_texts_are_unmarked(spark, with_odd_texts):
    texts = spark.read.parquet(f"{with_odd_texts}/documents.parquet")
    rows = {r.doc_id: r for r in catalogue.QUERIES["target_mark"](spark, with_odd_texts).collect()}
    assert len(rows) == texts.count()
    assert tuple(rows[10**6])[1:] == (None, -1, -1, None) and tuple(rows[10**6 + 1])[1:] == ("", -1, -1, "")
    for r in texts.where("length(text) >= 12").collect():
        assert tuple(rows[r.doc_id])[1:4] == (f"{r.text[:5]}[TGT] {r.text[5:12]} [TGT]{r.text[12:]}", 11, 18)
    assert (rows[10**6 + 4].marked, rows[10**6 + 4].s) == ("Straß[TGT] e Von D [TGT]er Höhe", 11)


def index_spans(text):
    """(kind, term, s, e) as the index side defines them, by plain loops."""
    word = rf"(?!(?i:(?:{'|'.join(catalogue.spans.STOP)})\b)){catalogue.spans.TOKEN}"
    found = lambda p: [(m.start(), m.end(), m.group()) for m in re.finditer(p, text)]
    inside = lambda x, ys: any(y[0] <= x[0] and x[1] <= y[1] for y in ys)
    stop = set(catalogue.spans.STOP)
    every = found(f"{TITLE_RUN}|{ACRONYM}")
    phrase = lambda p: re.search(catalogue.spans.PHRASE, p) and ".." not in p and any(w.lower() not in stop for w in p.split())
    accepted = [x for x in every if not all(re.fullmatch("[0-9]+", w) for w in x[2].split())]
    accepted += [x for x in found(rf"\b{word}(?: {word})+") if phrase(x[2]) and not inside(x, every)]
    best = [x for i, x in enumerate(accepted) if not any(inside(x, [y]) and (y[1] - y[0] > x[1] - x[0] or j < i) for j, y in enumerate(accepted) if j != i)]
    valid = lambda w: w.lower() not in stop and not re.fullmatch(r"[0-9]+(\.[0-9]+)?", w) and len(w) >= 2 and not (len(w) == 2 and w == w.lower() and re.search("[a-z]", w))

    def term(p):
        ws = p.split()
        ws = ws[1:] if ws[0].lower() in ("the", "a", "an") else ws
        return " ".join(w if re.search("[A-Z]{2,}", w) else w.lower() for w in ws)

    return [("phrase", term(x[2]), x[0], x[1]) for x in best] + [("token", term(x[2]), x[0], x[1]) for x in found(catalogue.spans.TOKEN) if valid(x[2]) and not inside(x, accepted)]


def test_extracted_spans(spark, with_odd_texts):
    texts = spark.read.parquet(f"{with_odd_texts}/documents.parquet").where("length(text) < 2000").collect()
    short = {r.doc_id for r in texts}
    got = sorted(tuple(r) for r in catalogue.QUERIES["extracted_spans"](spark, with_odd_texts).collect() if r.doc_id in short)
    assert len(texts) > 100
    assert got == sorted((r.doc_id, *x) for r in texts for x in index_spans(cleaned(r.text)))


def test_extracted_spans_take_one_python_pass(spark, with_odd_texts):
    plan = catalogue.QUERIES["extracted_spans"](spark, with_odd_texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "aggregate(" not in plan


def test_spans_of_given_annotations_equal_the_single_pass(spark, with_odd_texts):
    odd = ["the a An the", "12 34 NASA 12 3.14 15 A1 a1 II ii", "x² a² foo y½ bar", "éa foo bar", "İstanbul Big iſ foo", "The Red House the red-house IBM's", None, ""]
    d = spark.createDataFrame([(10**7 + i, x) for i, x in enumerate(odd)], "doc_id long, text string").union(spark.read.parquet(f"{with_odd_texts}/documents.parquet").where("length(text) < 2000"))
    rows = lambda df: sorted((r.doc_id, r.spans) for r in df.select("doc_id", "spans").where("spans IS NOT NULL").collect())
    single = rows(catalogue.spans.extracted(d))
    assert len(single) > 100 and single == rows(catalogue.spans.index_spans(catalogue.spans.annotate(d)))
    null = d.where("text IS NULL")
    assert null.count() == 1 and not rows(catalogue.spans.extracted(null)) and not rows(catalogue.spans.index_spans(catalogue.spans.annotate(null)))


def test_an_index_encodes_texts_once_and_in_flat_pieces(spark, tmp_path):
    import numpy as np
    import pyarrow as pa

    plans = {}

    class Seen(catalogue.store.TableSet):
        def save(self, name, df, by=None):
            plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
            return super().save(name, df, by)

    docs = spark.createDataFrame([(1, "One red fox met New York foxes."), (2, None), (3, "")], "doc_id long, text string")
    catalogue.engine.index(docs, Seen(spark, str(tmp_path)))
    assert plans["spans"].count("ArrowEvalPython [run(") == 1

    e = catalogue.encoding.HashEncoder()
    e.load()
    texts = ["a bb ccc dd-e", "", "!", "x y"]
    s, t = [[0, 0, 2, 4, 20], [0], [0], [0]], [[1, 8, 4, 13, 25], [0], [1], [3]]
    got = catalogue.encoding.vectors_of(e.encode(texts), pa.array(s), pa.array(t)).to_pylist()
    for own, (off, v), starts, ends in zip(got, e.encode(texts), s, t, strict=True):
        at = [(off[:, 0] < y) & (off[:, 1] > x) for x, y in zip(starts, ends, strict=True)]
        assert [x is None for x in own] == [not x.any() for x in at]
        assert all(x is None or np.array_equal(x, v[y].mean(axis=0)) for x, y in zip(own, at, strict=True))


def test_graph_and_senses_take_all_rows(spark):
    t = catalogue.Tables(spark, SF)
    protos = t.protos.count()
    assert catalogue.graph_nodes(t).count() == protos == catalogue.QUERIES["node_weights"](spark, SF).count()
    assert catalogue.sense_rows(t).count() == t.occurrences.count()
    assert catalogue.QUERIES["anchor_assignment"](spark, SF).select("anchor_id").distinct().count() > 4


def embeddings():
    import numpy as np
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    return np.array(t["vec_id"]), np.array(t["label"]), np.array(t["embedding"], dtype=float)


def test_principal_components_equal_a_singular_value_decomposition(spark):
    import numpy as np

    vec, _, x = embeddings()
    got = {r.vec_id: (r.x, r.y) for r in catalogue.QUERIES["pca_coords"](spark, SF).collect()}
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    for k in (0, 1):
        want, own = x @ vt[k], np.array([got[i][k] for i in vec])
        assert np.allclose(own, want, atol=1e-6) or np.allclose(own, -want, atol=1e-6)


def test_clusters_of_every_term(spark):
    """Chunk means of each term, clustered apart; the definition's parts (core distances, least spanning tree) by plain loops."""
    import numpy as np

    vec, label, x = embeddings()
    got = {r.occ_id: r.cluster for r in catalogue.QUERIES["hdbscan_prototypes"](spark, SF).collect()}
    assert set(got) == set(vec.tolist())
    for t in set(label.tolist()):
        own = np.flatnonzero(label == t)
        own = own[np.argsort(vec[own])]
        same = {}
        for i in own:
            same.setdefault(int(vec[i] % 50), set()).add(got[int(vec[i])])
        assert all(len(c) == 1 for c in same.values())
    y = x[label == label[0]][:40]
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, 5]
    assert np.allclose(catalogue.cluster.core_distances(y, 5), core)
    m = np.maximum(d, np.maximum(core[:, None], core[None]))
    groups, total = {i: {i} for i in range(len(y))}, 0.0
    for w, i, j in sorted((m[i, j], i, j) for i in range(len(y)) for j in range(i)):
        if groups[i] is not groups[j]:
            groups[i] |= groups[j]
            for k in groups[j]:
                groups[k] = groups[i]
            total += w
    assert np.isclose(sum(w for w, _, _ in catalogue.cluster.spanning_tree(y, core)), total)


def test_senses_are_built_where_occurrences_do_not_concentrate(spark):
    """Training part, gate and nearest prototype by plain NumPy."""
    import numpy as np

    vec, label, x = embeddings()
    got = {r.occ_id: (r.term_id, r.proto_id) for r in catalogue.QUERIES["sense_index"](spark, SF).collect()}
    assert set(got) == set(vec.tolist()) and all(got[int(v)][0] == t for v, t in zip(vec, label, strict=True))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for t in set(label.tolist()):
        own = np.flatnonzero(label == t)
        own = own[np.argsort(vec[own])]
        seen, end = 0, None
        for b in sorted(set((vec[own] // 100).tolist())):
            seen += int((vec[own] // 100 == b).sum())
            if seen >= 20:
                end = b
                break
        trains = own[vec[own] // 100 <= end] if end is not None else own
        c = unit[trains].mean(axis=0)
        c /= np.linalg.norm(c)
        labels = np.full(len(trains), -1)
        if end is not None and (unit[trains] @ c).mean() <= 0.9:
            labels = catalogue.cluster.labels_of(x[trains], vec[trains] % 50, None, False)
        groups = [trains[labels == k] for k in range(labels.max() + 1)] or [trains]
        centres = np.stack([unit[g].mean(axis=0) / np.linalg.norm(unit[g].mean(axis=0)) for g in groups])
        ids = sorted({got[int(vec[i])][1] for i in own})
        assert len(ids) <= len(groups)
        inside = {int(vec[i]): k for k, g in enumerate(groups) for i in g}
        want = [inside.get(int(vec[i]), int(np.round(centres @ unit[i], 9).argmax())) for i in own]
        first = min(got[int(vec[i])][1] - w for i, w in zip(own, want, strict=True))
        assert [got[int(vec[i])][1] - first for i in own] == want
