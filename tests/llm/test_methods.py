"""Brute force, round trips and held-out accuracy."""

import io
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import bytetext, common, decontaminate, minhash, mixing, quality_mil, queries, sharding, token_counts, toxicity, warc

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def sets_of(rows, k):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = {}
    for i, t in rows:
        ws = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
        out[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())
    return out


def brute_components(rows, k, percent):
    s = sets_of(rows, k)
    up = {i: i for i in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), root(i)) for i in ids}


def near_copies(seed=5, groups=12, size=14):
    """Groups whose copies are near to their original but often not to one another."""
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(40, 160))]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 30))):
                t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup_against_brute_force(spark, k):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()}
    assert got == brute_components(rows, k, 80)


def test_near_dedup_of_open_groups_in_small_blocks(spark, monkeypatch):
    """A template whose fillings make many strays of several sizes, in blocks of three members or some hundred bytes."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 2000)
    r = random.Random(11)
    template = [f"t{i}" for i in range(60)]
    rows = []
    for g in range(14):
        own = template + [f"g{g}x{i}" for i in range(r.choice([9, 14, 20, 26]))]
        for _ in range(4):
            t = list(own)
            t[r.randrange(len(t))] = f"x{len(rows)}"
            rows.append((len(rows) if r.random() < 0.9 else 0, " ".join(t)))
    rows = list({i: (i, t) for i, t in rows}.values())
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == brute_components(rows, 4, 80)


def test_stars_equal_union_find(spark):
    r = random.Random(1)
    edges = common.stage(spark.createDataFrame([(a, b) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(60)) if a != b], "a long, b long"), "test-edges")
    as_set = lambda d: {(x.id, x.comp) for x in d.collect()}
    assert as_set(minhash.components(edges, few=0)) == as_set(minhash.components(edges))


def test_min_max_estimates_are_unbiased():
    r = np.random.default_rng(0)
    estimates = []
    for _ in range(30):
        h = bytetext.mix(r.integers(0, 1 << 63, 300, dtype=np.uint64))
        sig = minhash.min_max(np.concatenate([h[:270], h[30:]]), np.array([0, 270]))
        estimates.append((sig[:, 0] == sig[:, 1]).mean())
    assert abs(np.mean(estimates) - 0.8) < 0.02


def test_words_match_a_regex(monkeypatch):
    monkeypatch.setattr(bytetext, "PIECE", 64)
    r = random.Random(2)
    texts = ["".join(r.choice("abÉ \t\n\x0b") for _ in range(r.randrange(0, 300))) for _ in range(60)] + [None, "", "x" * 500]
    raw, off = bytetext.utf8(pa.array(texts))
    w = bytetext.words(raw, off, spans=True)
    want = [(i, m) for i, t in enumerate(texts) for m in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    assert [(t, raw[s:e].tobytes()) for t, s, e in zip(w.text, w.start, w.end, strict=True)] == want


def leaky(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([2, 4, 7, 15, 30])))) for i in range(25)]
    texts = []
    for _ in range(60):
        ws = [r.choice(vocab) for _ in range(r.randrange(1, 80))]
        piece = r.choice(items)[1].split()
        if len(piece) > 12 and r.random() < 0.5:
            piece = piece[1:-1]
        at = r.randrange(len(ws) + 1)
        texts.append(" ".join(ws[:at] + piece + ws[at:]))
    want = {}
    for t, text in enumerate(texts):
        ws = [w.encode() for w in text.split()]
        for i, item in items:
            iw = [w.encode() for w in item.split()]
            k, n = min(5, len(iw)), min(len(iw), len(ws))
            grams = decontaminate.word_grams(iw, k)
            for p in range(len(ws) - n + 1):
                s = decontaminate.similarity(decontaminate.word_grams(ws[p : p + n], k), grams)
                if s >= 0.8 and s > want.get((t, i), (0,))[0]:
                    want[t, i] = (s, p)
    return items, texts, {key: (round(s, 9), p) for key, (s, p) in want.items()}


def test_decontamination_against_brute_force():
    items, texts, want = leaky()
    raw, off = bytetext.utf8(pa.array(texts))
    groups = decontaminate.index(items)
    got = {(t, i): (round(s, 9), p) for t, i, s, p, _ in decontaminate.search(raw, off, decontaminate.Index([groups], decontaminate.vocabulary(groups)), 0.8)}
    assert got == want


@pytest.mark.parametrize("block_items", [2000, 4])
def test_decontamination_in_blocks_against_brute_force(spark, monkeypatch, block_items):
    """The whole operators: all items in one index file or in several."""
    items, texts, want = leaky(4)
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.word_start) for r in decontaminate.leaks(docs, bench, block_items=block_items).collect()}
    assert got == want
    kept = {r.doc_id for r in decontaminate.drop_leaks(docs, bench, block_items=block_items).collect()}
    assert kept == set(range(len(texts))) - {t for t, _ in want}


def test_index_files_are_held_up_to_a_bound(tmp_path, monkeypatch):
    import pickle

    files = []
    for n in range(5):
        groups = decontaminate.index([(n, f"one two three {n}")])
        (tmp_path / f"{n}.items").write_bytes(pickle.dumps(groups))
        (tmp_path / f"{n}.vocab").write_bytes(pickle.dumps(decontaminate.vocabulary(groups)))
        files.append((f"file://{tmp_path}/{n}.items", f"file://{tmp_path}/{n}.vocab"))
    monkeypatch.setattr(decontaminate, "HELD_BYTES", 2 * (tmp_path / "0.items").stat().st_size + 20)
    i = decontaminate.index_of(files)
    assert [b[0].ids for _ in range(2) for b in i.blocks()] == [[n] for n in range(5)] * 2 and len(i.held) == 2
    assert sum(map(len, i.vocab.values())) == 5


@pytest.mark.parametrize("n", [50, 3000])
def test_hamming_blocks_find_all_within_radius(n):
    r = np.random.default_rng(4)
    prints = r.integers(0, 1 << 16, (n, 16)).astype(np.uint16)
    g = decontaminate.Group(9, 5, list(range(n)), [b""] * n, np.zeros(0), prints)
    for _ in range(100):
        bits = np.unpackbits(prints[r.integers(n)].view(np.uint8))
        bits[r.choice(256, r.integers(0, 80), replace=False)] ^= 1
        q = np.packbits(bits).view(np.uint16)
        near = np.flatnonzero(np.unpackbits((prints ^ q).view(np.uint8).reshape(n, -1), axis=1).sum(axis=1) <= decontaminate.RADIUS)
        assert g.candidates(q).tolist() == near.tolist()


def test_similar_windows_are_within_the_radius():
    """Windows at a similarity of just 0.8: the fingerprints' distances have the mean and deviation that the docstring states."""
    r, far = random.Random(8), []
    for _ in range(1500):
        a = [r.getrandbits(64) for _ in range(36)]
        b = a[4:] + [r.getrandbits(64) for _ in range(4)]  # 32 of 40
        x, y = (decontaminate.fingerprint(np.array(v, dtype=np.uint64)) for v in (a, b))
        far.append(int(np.unpackbits((x ^ y).view(np.uint8)).sum()))
    assert max(far) <= decontaminate.RADIUS and 36 < np.mean(far) < 42 and 5 < np.std(far) < 6.6


def test_token_counts_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    r = random.Random(5)
    texts = ["".join(r.choice("ab 'é\n.,1!s<|\t中́") for _ in range(r.randrange(0, 60))) for _ in range(3000)]
    texts += ["a<|endoftext|>b <|endoftext|> z", "don't we'll 's " * 50, "ab12" * 200, " x", "x\n", "\nx", "नमस्ते दुनिया", "x" * 20_000, "word, two. three " * 9000, None, ""]
    assert token_counts.count_batch(texts, path) == [len(whole.encode(t or "", add_special_tokens=False)) for t in texts]


def archive():
    out = b""
    for i, p in enumerate([b"", b"a" * 5000, b"\r\n\r\nWARC/1.1\r\n" * 50, os.urandom(200_000)]):
        import hashlib

        out += warc.record(i, f"http://x/{i}", p, len(p), hashlib.sha1(p).digest())
    return out


def test_warc_round_trip():
    whole = archive()
    got = list(warc.read_records(io.BytesIO(whole), payloads=True))
    assert [len(r.payload) for r in got] == [0, 5000, 700, 200_000] and got[1].payload == b"a" * 5000
    one_byte = type("S", (io.BytesIO,), {"read": lambda self, n=-1: io.BytesIO.read(self, min(n, 7))})
    assert [r.payload_sha1 for r in warc.read_records(one_byte(whole))] == [r.payload_sha1 for r in got]


def test_foreign_archives_are_read(spark, tmp_path):
    import gzip
    import hashlib

    def member(kind, block, *head):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", *head, f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    body = b"<p>hello</p>"
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nX-Folded: a\r\n  b\r\nContent-Length: 999\r\n\r\n"
    whole = (
        member("warcinfo", b"software: other\r\n", "Content-Type: application/warc-fields", "WARC-Filename: x\r\n y")
        + member("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a/")
        + member("response", http + body, "Content-Type: application/http; msgtype=response", "WARC-Target-URI: http://a/", f"WARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}", "WARC-Block-Digest: md5:00")
        + member("metadata", b"fetchTimeMs: 3\r\n", "Content-Type: application/warc-fields")
        + member("resource", b"", "Content-Type: application/http; msgtype=response")
    )
    (tmp_path / "x.warc.gz").write_bytes(whole)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", 5, len(whole))], warc.MANIFEST)
    got = {r.record_type: r for r in warc.read_archives(manifest).collect()}
    assert set(got) == {"warcinfo", "request", "response", "metadata", "resource"}
    assert (got["response"].payload_bytes, got["response"].payload_digest, got["response"].page_id) == (12, hashlib.sha1(body).hexdigest(), None)
    assert got["warcinfo"].payload_bytes == 17 and got["request"].url == "http://a/"
    r = next(warc.read_records(io.BytesIO(member("response", http + body, "Content-Type: application/http;msgtype=response"))))
    assert r.http["x-folded"] == "a b"
    with pytest.raises(warc.WarcError):
        next(warc.read_records(io.BytesIO(member("resource", b"x", "WARC-Payload-Digest: sha1:" + "0" * 40))))


def test_warc_errors():
    import gzip
    import zlib

    whole = archive()
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(whole[:-10])))
    member = zlib.decompressobj(31).decompress(warc.record(1, "u", b"abc" * 900, 2700, b"0" * 20))
    for bad in (member, member.replace(b"abcabc", b"abcabd", 1), member.replace(b"Content-Length: 2", b"Content-Length: 3", 1)):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))


def test_slot_maps_are_edited():
    r = random.Random(6)
    weights = {s: r.randrange(1, 1000) for s in range(256)}
    first = sharding.first_map(weights, 8, 256)
    load = lambda m, n: [sum(w for s, w in weights.items() if m[s] == i) for i in range(n)]
    assert max(load(first, 8)) - min(load(first, 8)) <= 1000
    grown = sharding.rebalance(first, weights, 9)
    assert max(load(grown, 9)) - min(load(grown, 9)) <= 1000
    assert sum(first[s] != grown[s] for s in first) < 256 // 4
    shrunk = sharding.rebalance(first, weights, 7)
    assert set(shrunk.values()) == set(range(7))


def test_slot_map_versions(spark):
    """Placing again with the map in force changes nothing; another shard count or other bytes edit it."""
    maps = sharding.SlotMaps(spark, common.kept_path(spark, f"test-maps-{random.random()}"))
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(500)], "doc_id long, text string")
    sharding.place(docs, 4, 64, maps=maps)
    sharding.assign(docs, 4, 64, maps=maps)
    assert maps.last() == 0
    sharding.assign(docs, 5, 64, maps=maps)
    assert maps.last() == 1
    a, b = maps.mapping(0), maps.mapping(1)
    assert set(a.values()) == set(range(4)) and set(b.values()) == set(range(5)) and sum(a[s] != b[s] for s in a) < 40
    more = docs.union(spark.createDataFrame([(7, "y" * 9000)], "doc_id long, text string"))
    sharding.place(more, 5, 64, maps=maps)
    assert maps.last() == 2


def test_sharding_against_brute_force(spark):
    """Sizes, checksums, one slot an id, gapless places, even bytes; a hot id with many texts, a hot document, null ids."""
    import zlib
    from collections import Counter, defaultdict

    rows = [(i, "é" * (i % 60)) for i in range(3000)] + [(5, f"text {i}") for i in range(700)] + [(6, "same")] * 25_000 + [(None, f"n{i}") for i in range(50)] + [(None, None)]
    out = sharding.query(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    want = Counter((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter(zip(out.doc_id.fillna(-1).astype(int), out["size"], out.text_crc32, strict=True)) == want
    assert set(out.law) == {"bytes"} and out.grown_shard.isna().all()
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in out.itertuples():
        slots[r.shard].append(r.slot)
        shard_of[r.virtual_slot].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in shard_of.values())
    assert out[out.doc_id == 5].virtual_slot.nunique() == 1
    load, heavy = out.groupby("shard")["size"].sum(), out.groupby("virtual_slot")["size"].sum().max()
    assert set(load.index) == set(range(16)) and load.max() - load.min() <= heavy
    again = sharding.query(spark.createDataFrame(rows[::-1], "doc_id long, text string")).toPandas()
    key = lambda d: sorted(map(str, d.itertuples(index=False)))
    assert key(again) == key(out)


@pytest.mark.parametrize("spread", [50, 40, 0])
def test_thresholds_of_crowded_buckets(spark, spread):
    """More documents than LEAF whose draws share their first bits: the boundary bucket is refined more than once."""
    r = random.Random(spread)
    rows = [(s, r.randrange(1, 50), (7 << 50) + r.randrange(1 << spread)) for s in ("a", "b", None) for _ in range(700)] + [("c", 5, i << 50) for i in range(40)]
    words = {s: sum(x[1] for x in rows if x[0] == s) for s in ("a", "b", None, "c")}
    budgets = {"a": 0.37 * words["a"], "b": 0.0, None: 0.92 * words[None], "c": words["c"] + 1.0}
    cands, limits = spark.createDataFrame(rows, "source string, size long, draw long"), spark.createDataFrame(list(budgets.items()), "source string, budget double")
    out = {x.source: x for x in mixing.thresholds(cands, limits).collect()}
    for s, budget in budgets.items():
        size_at, upto, over = {}, 0, None
        for _, n, draw in (x for x in rows if x[0] == s):
            size_at[draw] = size_at.get(draw, 0) + n
        for draw in sorted(size_at):
            if upto + size_at[draw] > budget:
                over = draw
                break
            upto += size_at[draw]
        x = out[s]
        assert (x.got, x.next_draw, x.next_size) == (upto, over, size_at.get(over))
        assert {d for d in size_at if d <= x.t} == {d for d in size_at if over is None or d < over}


def test_scopes_delete_only_what_they_staged(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 30, "s") for i in range(50)], "doc_id long, text string, source string")
    frames = [sharding.query(docs), mixing.query(docs), minhash.query(docs)]
    with common.scope(spark):
        inside = common.stage(docs, "inside")
        sharding.query(docs).count()
        assert inside.count() == 50
    assert [f.count() for f in frames] == [50, 50, 50]
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        inside.count()


def test_broadcast_is_bound_by_bytes(spark):
    t = common.stage(spark.range(2000).selectExpr("id", "repeat('x', 1000) AS s"), "wide")
    plan = lambda d: spark.range(10).join(d, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(common.small(t)) and "strategy=broadcast" not in plan(common.small(t, 1_000_000))


@data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert plain(got[cols]) == plain(want[cols])


def plain(d):
    """Rows as sorted text, numbers as floats, missing values alike."""
    import pandas as pd

    number = lambda v: isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_))
    return sorted(str([None if pd.isna(v) else float(v) if number(v) else v for v in r]) for r in d.itertuples(index=False))


def labelled(sf):
    import pyarrow.parquet as pq

    d = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    y = {r["doc_id"]: r for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    return [(r["doc_id"], r["text"], y[r["doc_id"]]) for r in d if r["doc_id"] in y]


def bag_of(text):
    q = quality_mil.passages(*bytetext.utf8(pa.array([text])))
    return q.rates, q.words, q.pairs


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_held_out_accuracy(spark):
    import zlib

    rows = labelled("/root/testdata/sf0.1")
    rest = lambda i, folds: zlib.crc32(str(i).encode()) % folds
    train = [r for r in rows if rest(r[0], 5) != 0][:1500]
    bags = [bag_of(t) for _, t, _ in train]
    keep = [i for i, b in enumerate(bags) if len(b[1])]
    m = quality_mil.fit([bags[i] for i in keep], np.array([float(train[i][2]["quality"]) for i in keep]))
    held = [r for r in rows if rest(r[0], 5) == 0]
    s = m.score(*bytetext.utf8(pa.array([t for _, t, _ in held])))
    y = np.array([r[2]["quality"] for r in held])
    assert ((s >= 0.3) == (y == 1)).mean() > 0.97
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, labels)
    held = [r for r in rows if rest(r[0], 4) == 2]
    s = m.score(*bytetext.utf8(pa.array([t for _, t, _ in held])))
    y = np.array([r[2]["toxic"] for r in held])
    assert (s[y == 1] >= 0.3).mean() > 0.88 and (s[y == 0] >= 0.3).mean() < 0.02
    told = {r["voter"]: r for r in m.report()}
    assert told["density"]["accuracy"] > 0.9 and told["none of any"]["accuracy"] > 0.9 > 0.5 > told["capitals"]["accuracy"]


def test_gradients_by_finite_differences():
    r = random.Random(2)
    bags = [bag_of(" ".join(f"w{r.randrange(50)}{'!' * r.randrange(3)}" for _ in range(n))) for n in (3, 70, 200, 64)]
    y = np.array([1.0, 0.0, 1.0, 0.0])
    m = quality_mil.start(bags)
    x, first = m.rates(np.concatenate([b[0] for b in bags])).astype(float), np.concatenate([[0], np.cumsum([len(b[0]) for b in bags])])[:-1]
    counts = quality_mil.counts_of(bags).astype(float)
    assert np.allclose(counts.sum(axis=1), 1)

    def loss():
        p = m.forward(np.concatenate([x, counts @ m.p["E"]], axis=1), first)["y"]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    grad = m.gradient(x, counts, first, y)
    for k, g in grad.items():
        flat, own = m.p[k].reshape(-1), np.asarray(g).reshape(-1)
        for i in np.argsort(-np.abs(own))[:3].tolist() + [r.randrange(len(own))]:
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - own[i]) < 1e-6 + 1e-3 * abs(own[i]), (k, i)
    # The embeddings of training and of scoring agree.
    q = quality_mil.passages(*bytetext.utf8(pa.array(["one two three two " * 40])))
    assert np.allclose(m.embedded(q), quality_mil.counts_of([(q.rates, q.words, q.pairs)]) @ m.p["E"], atol=1e-5)


def test_long_texts_are_scored_in_segments(monkeypatch):
    """Attention over segments is the attention over all their passages, whichever slice they are worked in."""
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(300)}" for _ in range(n)) for n in (10, 900, 4000, 0, 2500)] + ["x" * 9000]
    bags = [bag_of(t) for t in texts if t]
    m = quality_mil.start(bags)
    raw, off = bytetext.utf8(pa.array(texts))
    monkeypatch.setattr(quality_mil, "SEGMENT", 3000)
    cut, owner = bytetext.segments(raw, off, 3000)
    assert b"".join(raw[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)) == raw.tobytes() and sorted(set(owner)) == list(range(6))
    parts = [quality_mil.passages(raw[a:b], np.array([0, b - a])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    want = np.zeros(6)
    for t in range(6):
        own = [q for q, o in zip(parts, owner, strict=True) if o == t and len(q.words)]
        if own:
            x = np.concatenate([np.concatenate([m.rates(q.rates), m.embedded(q)], axis=1) for q in own])
            want[t] = m.forward(x, np.array([0]))["y"][0]
    for size in (2 << 20, 5000):
        monkeypatch.setattr(quality_mil, "SLICE_BYTES", size)
        assert np.allclose(m.score(raw, off), want, atol=1e-6)


def test_label_model_against_brute_force():
    """One round of EM by plain loops gives the same tables; known accuracies are found again; a copied voter shares its weight."""
    r = np.random.default_rng(5)
    y = r.random(4000) < 0.2
    truth = [(0.9, 0.8), (0.7, 0.75), (0.5, 0.95), (0.85, 0.6)]  # how often a voter speaks, and is right
    votes = np.stack([np.where(r.random(4000) < s, np.where(r.random(4000) < a, np.where(y, 1, -1), np.where(y, -1, 1)), 0) for s, a in truth] + [np.zeros(4000)], axis=1).astype(np.int8)
    votes[:, 4] = votes[:, 0]
    m = toxicity.label_model(votes, 0.2, lead=2)
    assert np.abs(m.accuracy()[:4] - [a for _, a in truth]).max() < 0.08
    assert m.weight[0] == m.weight[4] and m.weight[0] < 0.6 < m.weight[2]
    assert ((m.posterior >= 0.5) == y).mean() > 0.88
    q = [p >= 0.5 for p in m.posterior]
    for v in range(5):
        for table, side in ((m.toxic, True), (m.clean, False)):
            own = [int(x) for x, c in zip(votes[:, v], q, strict=True) if c == side]
            assert np.allclose(table[v], [(own.count(k) + 0.5) / (len(own) + 1.5) for k in (-1, 0, 1)])
    d = 17
    evidence = sum(m.weight[v] * (np.log(m.toxic[v, votes[d, v] + 1]) - np.log(m.clean[v, votes[d, v] + 1])) for v in range(5) if votes[d, v])
    assert np.isclose(m.posterior[d], 1 / (1 + np.exp(-(np.log(0.2 / 0.8) + evidence))))


def test_forms_are_counted_as_by_hand(spark):
    rows = [(1, "you stupid fool, fool", 1), (0, "a fool of hope", 2), (1, "stupid is", 3), (0, "is", 4)]
    got = {r.h: (r.a, r.b) for r in toxicity.count_forms(spark.createDataFrame([r[:2] for r in rows], "y int, text string")).collect()}
    h = lambda w: np.array([toxicity.hash_of(w)], dtype=np.uint64).view(np.int64)[0]
    assert [got[h(w)] for w in ("fool", "stupid", "is", "hope")] == [(1, 1), (2, 0), (1, 1), (0, 1)]


def test_token_cache_is_bound_by_bytes():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, lengths = Tokenizer.from_file(path), token_counts.Lengths(path, keep_bytes=200_000)
    r = random.Random(7)
    texts = [f"Paragraph {i} of words.\n\n  \tNext  one{i}{'y' * r.randrange(90)}\r\n\x1c {'x' * r.randrange(200)}中{i}\n" * 3 for i in range(3000)]
    for k in range(0, len(texts), 100):
        own = texts[k : k + 100]
        assert lengths.of(own) == [len(whole.encode(t, add_special_tokens=False)) for t in own]
        assert max(map(len, lengths.known)) <= token_counts.SHORT
        assert lengths.held < 200_000 + 200 * 3000  # what one batch adds at most
    assert token_counts.byte_level(whole)


def test_token_counts_of_other_vocabularies():
    """Whole texts in batches, where pieces may join across spaces."""
    from pathlib import Path

    for path in sorted(Path("/opt/tokenizers").rglob("*.model"))[:2] + sorted(Path("/opt/tokenizers").rglob("*.json"))[:6]:
        texts = ["Hello  world 12ab.\n\nNext one", "", None, "ab " * 500]
        if path.suffix == ".model":
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=str(path))
            want = [len(p.encode(t or "")) for t in texts]
        else:
            from tokenizers import Tokenizer

            try:
                t_ = Tokenizer.from_file(str(path))
            except Exception:  # a file of another kind
                continue
            want = [len(t_.encode(t or "", add_special_tokens=False)) for t in texts]
        assert token_counts.count_batch(texts, str(path)) == want, path
