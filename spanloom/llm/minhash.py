"""Near-duplicate detection by min-max hashing.

For each of PERMS hash functions both the least and the greatest value over a text's shingles are kept: two unbiased
signature places for one evaluation.  BANDS bands of ROWS places each meet for a pair of similarity s with probability
1 - (1 - s**ROWS)**BANDS: 0.999995 at 0.8.

1. One pass over the texts gives set size, a 128-bit hash of the word sequence, and band keys.
2. Equal sequences form a class; its smallest id stands for it, so groups of copies cost one row afterwards.
3. Band keys that several representatives share are buckets.  The smallest id of a bucket leads it; every other member is a
   candidate with the leader only, never with all others.
4. Candidates are confirmed on full shingle sets (eight bytes a shingle, made once a document); confirmed links give components.  A
   candidate's set goes to its leader's, so a hot leader's set is read where its candidates are and never shuffled with each.
5. All members that ever met one leader form its group.  A group whose members still stand in different components is open: its strays
   (members outside the leader's component) are compared with the other members whose size allows the threshold (the same size class
   or the next), in blocks of at most BLOCK members and about BLOCK_BYTES of sets, with one byte of each signature place.  Pairs whose
   estimate reaches ESTIMATE (over four deviations under 0.8) are confirmed on the sets there and then, so that no unlinked pair
   becomes a row.  No group is capped; the blocks that meet grow as strays times members of one size class over BLOCK squared.

Components: a bounded number of links is joined by union-find in one task, more by alternating large and small stars.

Links between texts at or over the threshold are thus lost only if no band meets or the estimate fails by over four deviations.

Defined results: null, empty or blank texts have no shingles, link with nothing and are kept; a text with fewer than k
words has one shingle, the whole sequence; a row with null id gets a null component and is kept; rows that repeat an id count
as one document that has the links of each; ties go to the smallest id; a very long text is one row of eight bytes a distinct shingle (so
up to 250 million of them); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U, mix, powers, shingles, slices, utf8, words
from .common import drop, keep_ids, small, stage

ROWS, BANDS = 6, 40
PERMS = ROWS * BANDS // 2
SLICE_BYTES, SLICE_WORDS = 4 << 20, 1 << 15
BLOCK, BLOCK_BYTES, ESTIMATE = 64, 4 << 20, 0.68
#: Up to so many links (16 bytes each) may meet in one task.
FEW_LINKS = 1_000_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_R = powers(0x94D049BB133111EB, ROWS + 1)[1:]


def min_max(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signatures of consecutive non-empty sets: PERMS minima and maxima, a row for each set."""
    sig = np.empty((2 * PERMS, len(first)), dtype=U)
    for j in range(PERMS):
        v = hashes * _A[j] + _B[j]
        np.minimum.reduceat(v, first, out=sig[2 * j])
        np.maximum.reduceat(v, first, out=sig[2 * j + 1])
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS, -1)
    acc = (parts * _R[None, :, None]).sum(axis=1, dtype=U)
    return mix(acc + np.arange(1, BANDS + 1, dtype=U)[:, None] * U(0x9E3779B97F4A7C15)).T.view(np.int64)


def sequence_hashes(w, n: int) -> np.ndarray:
    """Two 64-bit hashes of each text's word sequence (0 for texts without words)."""
    count = np.bincount(w.text, minlength=n)
    start = np.concatenate([[0], np.cumsum(count)])[:-1]
    out = np.zeros((2, n), dtype=U)
    full = np.flatnonzero(count)
    if len(full):
        place = np.arange(len(w.text)) - np.repeat(start, count)
        for i, base in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            v = mix(w.hash + U(i * 0x9E3779B9 + 1)) * powers(base, int(count.max()))[place]
            out[i, full] = np.add.reduceat(v, start[full])
    return out.view(np.int64)


SIGNED = "doc_id long, n_shingles long, hi long, lo long, bands array<long>, sig binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


def sign(docs: DataFrame, k: int) -> DataFrame:
    """docs: (doc_id long, text string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            for lo, hi in slices(np.diff(off), SLICE_BYTES):
                n = hi - lo
                w = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                sh = shingles(w, n, k)
                seq, have = sequence_hashes(w, n), np.diff(sh.first)
                distinct, keys, sigs = np.zeros(n, np.int64), np.zeros((n, BANDS), np.int64), np.zeros((n, 2 * PERMS), np.uint8)
                full = np.flatnonzero(have)
                for i in full:
                    distinct[i] = len(np.unique(sh.hash[sh.first[i] : sh.first[i + 1]]))
                for p, q in slices(have[full], SLICE_WORDS):
                    own = full[p:q]
                    at, end = sh.first[own[0]], sh.first[own[-1] + 1]
                    sig = min_max(sh.hash[at:end], sh.first[own] - at)
                    keys[own], sigs[own] = band_keys(sig), mix(sig).T.astype(np.uint8)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(have > 0, BANDS, 0))]), pa.int32()), pa.array(keys[full].ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(distinct), pa.array(seq[0]), pa.array(seq[1]), lists, pa.array([x.tobytes() for x in sigs], pa.binary())], schema=_ARROW)

    return docs.mapInArrow(run, SIGNED)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (leader, id) whose full shingle sets reach the threshold, as (a, b).  sets: staged (id, set).  AQE splits hot leaders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(x) > len(y):
                    x, y = y, x
                if len(x) and 100 * len(x) >= percent * len(y):
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        ok.append(i)
            at = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["leader", "id"])

    led = sets.select(F.col("id").alias("leader"), F.col("set").alias("whole"))
    found = pairs.join(sets, "id").join(led, "leader").select("leader", "id", "set", "whole").mapInArrow(run, "leader long, id long")
    return found.select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "comp": pa.array([root(x) for x in ids], pa.int64())})


def components(edges: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(id, comp) for every id that has an edge: the smallest id of its component.  edges: staged (a, b), a <> b."""
    if edges.count() <= few:
        return stage(edges.coalesce(1).mapInArrow(union_find, "id long, comp long"), "components")
    at = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    last = None
    while True:
        both = at.union(at.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large.where("u <> v"), "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        at = stage(star, "components")
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    named = at.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return stage(named.union(at.select("v", "v").distinct()), "components")


def compare_blocks(percent: int):
    """Rows of two blocks (ids, comps, sigs, sets twice); the first confirmed link of each member with each other component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in range(len(batch)):
                (ids, comps, sigs, sets), (ids2, comps2, sigs2, sets2) = [[batch.column(c)[row].as_py() for c in range(at, at + 4)] for at in (0, 4)]
                x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1) for v in (sigs, sigs2))
                other = np.array(comps2)
                sizes = np.array([len(t) // 8 for t in sets2])
                for i in range(len(x)):
                    n = len(sets[i]) // 8
                    fits = 100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)
                    near = np.flatnonzero(fits & (other != comps[i]) & ((y == x[i]).mean(axis=1) >= ESTIMATE))
                    linked: set[int] = set()
                    if len(near):
                        own = np.frombuffer(sets[i], U)
                        whole = np.frombuffer(b"".join(sets2[j] for j in near), U)
                        at = np.minimum(np.searchsorted(own, whole), n - 1)
                        both = np.add.reduceat((own[at] == whole).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
                        for j, m in zip(near.tolist(), both.tolist(), strict=True):
                            if 100 * m >= percent * (n + int(sizes[j]) - m) and comps2[j] not in linked:
                                linked.add(comps2[j])
                                found.append((min(ids[i], ids2[j]), max(ids[i], ids2[j])))
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """id, set: the sorted distinct shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            for lo, hi in slices(np.diff(off), SLICE_BYTES):
                sh = shingles(words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), hi - lo, k)
                made = [np.unique(sh.hash[sh.first[i] : sh.first[i + 1]]).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_pydict({"id": b.column(0).slice(lo, hi - lo), "set": pa.array(made, pa.binary())})

    return texts.select("id", "text").mapInArrow(run, "id long, set binary")


def open_links(led: DataFrame, comps: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components in open groups.  led: (key, id, leader); a leader has been compared with all of its group."""
    comps = small(comps)
    rest = led.where("id <> leader").select("leader", "id").distinct().join(comps, "id", "left").withColumnRenamed("comp", "own")
    rest = rest.join(comps.select(F.col("id").alias("leader"), "comp"), "leader", "left")
    rest = stage(rest.select("leader", "id", F.coalesce("own", "id").alias("comp"), (F.coalesce("own", "id") != F.coalesce("comp", "leader")).alias("stray")), "minhash-rest")
    open_ = stage(rest.groupBy("leader").agg(F.count_if("stray").alias("s"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("s > 0 AND x <> y").select("leader"), "minhash-open")
    rows = stage(rest.join(small(open_), "leader"), "minhash-open-rows")
    ids = stage(rows.select("id").distinct(), "minhash-open-ids")
    sigs = keep_ids(signed.where("n_shingles > 0").select(F.col("doc_id").alias("id"), "sig"), "id", ids).groupBy("id").agg(F.min("sig").alias("sig"))
    # Sizes a and b can only reach the threshold if they stand in one class or in two that touch.
    kind = F.floor(F.log(F.octet_length("set") / 8) / F.log(F.lit(100 / percent)) + F.lit(1e-9)).cast("int")
    rows = stage(rows.join(sigs, "id").join(keep_ids(sets, "id", ids), "id").withColumn("kind", kind), "minhash-blocks")
    rest_, open_rows = rest, rows

    def blocks(rows: DataFrame, mark: str) -> DataFrame:
        per = rows.groupBy("leader", "kind").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("set").cast("long")) / BLOCK_BYTES)).cast("long").alias("of"))
        dealt = rows.join(small(stage(per, "minhash-kinds")), ["leader", "kind"]).withColumn("block", F.expr("pmod(xxhash64(id), of)"))
        packed = dealt.groupBy("leader", "kind", "block").agg(F.collect_list(F.struct("id", "comp", "sig", "set")).alias("m"))
        return packed.select("leader", "kind", *[F.col(f"m.{c}").alias(c + mark) for c in ("id", "comp", "sig", "set")])

    strays = blocks(open_rows.where("stray"), "").withColumn("kind", F.explode(F.array(F.col("kind") - 1, F.col("kind"), F.col("kind") + 1)))
    both = strays.join(blocks(open_rows, "2"), ["leader", "kind"]).drop("leader", "kind")
    out = stage(both.mapInArrow(compare_blocks(percent), "a long, b long").distinct(), "minhash-links")
    drop(rest_, open_, ids, open_rows)
    return out


def link(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(sign(narrow, k), "minhash-signed")
    classes = stage(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "minhash-classes")
    reps = keep_ids(signed.where("n_shingles > 0"), "doc_id", stage(classes.select("rep").distinct(), "minhash-reps"))
    rows = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    lead = rows.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").select("key", "leader")
    led = stage(rows.join(small(stage(lead, "minhash-leaders")), "key").select("key", "id", "leader"), "minhash-led")
    met = keep_ids(narrow, "doc_id", stage(led.select("id").distinct(), "minhash-ids")).select(F.col("doc_id").alias("id"), "text")
    sets = stage(shingle_sets(met, k), "minhash-sets")

    asked = led.where("id <> leader").select("leader", "id").distinct()
    edges = stage(confirm(asked, sets, percent), "minhash-links")
    comps = components(edges)
    more = open_links(led, comps, signed, sets, percent)
    if not more.isEmpty():
        comps = components(stage(edges.union(more), "minhash-links"))
    drop(led, sets)

    named = classes.join(small(comps.withColumnRenamed("id", "rep")), "rep", "left").where("copies > 1 OR comp IS NOT NULL").select("hi", "lo", F.coalesce("comp", "rep").alias("comp"))
    named = small(stage(named, "minhash-named")).alias("c")
    out = signed.select("doc_id", "n_shingles", "hi", "lo").alias("s").join(named, F.expr("s.n_shingles > 0 AND s.hi = c.hi AND s.lo = c.lo"), "left")
    comp = F.when(F.col("s.doc_id").isNotNull(), F.coalesce("c.comp", "s.doc_id"))
    return out.select("s.doc_id", "s.n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("s.doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, with all its columns; of rows that repeat a kept id and its text, one."""
    gone = stage(link(docs, k, percent, id_col, text_col).where(~F.col("kept")).select("doc_id").distinct(), "minhash-gone")
    left = keep_ids(docs, id_col, gone, "left_anti")
    again = stage(left.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "minhash-again")
    if again.isEmpty():
        return left
    once = keep_ids(left, id_col, again, "left_anti")
    return once.unionByName(keep_ids(left, id_col, again).dropDuplicates([id_col, text_col]))


def query(docs: DataFrame) -> DataFrame:
    return link(docs, k=4, percent=80)
