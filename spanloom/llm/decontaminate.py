"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Texts are words (letters and digits, A-Z and Latin-1 capitals in lower case); shingles are five words, or the whole of
a shorter item.  For an item of n words every n-word window of a document is looked at: a window that holds too few
shingles of the items of its length to reach the threshold with any of them is left out (no such window can be a match), the others are
fingerprinted with 256 bits.  Sixteen blocks of sixteen bits index the items' fingerprints: at a distance of at most RADIUS = 63 bits
some block differs in at most three, so the lists of the 697 values that near hold all fingerprints within the radius; of unlike items
one in six is on such a list.  Those within the radius are compared with the item by weighted shingle similarity (sum of least over sum
of greatest multiplicity), on the words themselves; from THRESHOLD on the document holds the item.  At similarity 0.8 the distance has
mean 38.8 and deviation 5.7, so the radius is over four deviations away.

Items are indexed by the executors, BLOCK_ITEMS at a time, as files in the shared folder.  Documents are read once, however many items
there are: each Python worker holds the items' shingle hashes (eight bytes each) and of the index files the last used up to HELD_BYTES.
Windows are only looked for where known shingles stand close, and index files only read for batches that have such places.

Defined results: null or blank texts and items match nothing; a document shorter than an item is one window; of equal
windows the first is reported; rows that repeat an id are each searched, and the best match for an item is kept; items with
equal texts are each reported; items without an id are searched too, and the best match of them all is reported with a null item_id;
a very long text is searched in one piece, some fifty bytes of memory a word; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import NOT_ALNUM, U, Words, mix, powers, shingles, slices, utf8, words
from .common import new_path, stage

K, THRESHOLD = 5, 0.8
BLOCKS, BLOCK_BITS, RADIUS = 16, 16, 63
NEAR = RADIUS // BLOCKS  # bits in which some block differs at most
BLOCK_ITEMS, HELD_BYTES = 2000, 64 << 20
SLICE_BYTES = 2 << 20
_POP = np.array([i.bit_count() for i in range(1 << BLOCK_BITS)], dtype=np.uint8)
#: Every change of at most NEAR bits of a block.
_CHANGES = np.array([sum(1 << b for b in c) for n in range(NEAR + 1) for c in combinations(range(BLOCK_BITS), n)], dtype=np.uint16)
_SEEDS = [U(0), U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03), U(0x8CB92BA72F3D8DD7)]


def fold(data: np.ndarray) -> np.ndarray:
    """Latin-1 capitals (C3 80 to C3 9E but for C3 97) in lower case; A-Z is left to words()."""
    out = data.copy()
    if len(out) > 1:
        second = out[1:]
        second[(data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return out


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a row of shingle hashes, as sixteen blocks of sixteen bits."""
    wide = np.stack([mix(hashes + seed) for seed in _SEEDS], axis=1)
    bits = np.unpackbits(wide.view(np.uint8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) >= len(hashes)).view(np.uint16)


def runs(w: Words, k: int) -> np.ndarray:
    """The hash of the k words from each word on (0 where the text ends before)."""
    n = len(w.hash)
    out = np.zeros(n, dtype=U)
    if n >= k:
        mult = powers(0xC2B2AE3D27D4EB4F, k + 1)[1:]
        acc = np.zeros(n - k + 1, dtype=U)
        for j in range(k):
            acc += w.hash[j : n - k + 1 + j] * mult[j]
        if k < K:
            acc += U(k)
        out[: n - k + 1] = np.where(w.text[: n - k + 1] == w.text[k - 1 :], mix(acc), U(0))
    return out


@dataclass
class Group:
    """Items of one length with their index: for each block of bits its values in order, and whose they are."""

    length: int
    k: int
    ids: list[int | None]
    texts: list[bytes]  # words parted by a space
    vocab: np.ndarray
    prints: np.ndarray  # [item, block]
    grams: dict[int, Counter] = field(default_factory=dict)

    def __post_init__(self):
        self.order = np.argsort(self.prints, axis=0, kind="stable").T
        self.values = np.take_along_axis(self.prints.T, self.order, axis=1)

    def candidates(self, print_: np.ndarray) -> np.ndarray:
        """Items within the radius.  Lists of near values are looked up, or all items' blocks where there are fewer items than lists."""
        if len(self.prints) <= len(_CHANGES):
            found = np.flatnonzero((_POP[self.prints ^ print_] <= NEAR).any(axis=1))
        else:
            hits = [np.zeros(0, np.int64)]
            for b in range(BLOCKS):
                near = print_[b] ^ _CHANGES
                lo, hi = np.searchsorted(self.values[b], near), np.searchsorted(self.values[b], near, side="right")
                hits += [self.order[b, i:j] for i, j in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True)]
            found = np.unique(np.concatenate(hits))
        return found[_POP[self.prints[found] ^ print_].sum(axis=1, dtype=np.int64) <= RADIUS]

    def grams_of(self, i: int) -> Counter:
        if i not in self.grams:
            self.grams[i] = word_grams(self.texts[i].split(b" "), self.k)
        return self.grams[i]


def word_grams(ws: list[bytes], k: int) -> Counter:
    return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))


def similarity(x: Counter, y: Counter) -> float:
    if not x or not y:
        return 0.0
    both = sum(min(n, y[g]) for g, n in x.items() if g in y)
    return both / (sum(x.values()) + sum(y.values()) - both)


def lowered(data: np.ndarray, w: Words, i: int, j: int) -> list[bytes]:
    return [data[w.start[p] : w.end[p]].tobytes().lower() for p in range(i, j)]


def index(items: list[tuple[int | None, str | None]]) -> list[Group]:
    by: dict[int, list[tuple[int | None, bytes, np.ndarray]]] = {}
    for item_id, text in items:
        data, off = utf8(pa.array([text], pa.string()))
        data = fold(data)
        w = words(data, off, NOT_ALNUM, spans=True)
        if n := len(w.hash):
            by.setdefault(n, []).append((item_id, b" ".join(lowered(data, w, 0, n)), shingles(w, 1, K).hash))
    return [Group(n, min(n, K), [i for i, _, _ in own], [t for _, t, _ in own], np.unique(np.concatenate([h for _, _, h in own])), np.stack([fingerprint(h) for _, _, h in own])) for n, own in sorted(by.items())]


def vocabulary(groups: list[Group]) -> dict[int, np.ndarray]:
    """The shingle hashes of all items, by shingle length."""
    return {k: np.unique(np.concatenate([g.vocab for g in groups if g.k == k])) for k in {g.k for g in groups}}


class Index:
    """All items: their shingle hashes, and blocks of groups that are read when they are needed."""

    def __init__(self, parts: list[list[Group] | str], vocab: dict[int, np.ndarray]):
        self.parts, self.vocab = parts, vocab
        self.held: OrderedDict[int, tuple[list[Group], int]] = OrderedDict()

    def blocks(self) -> Iterator[list[Group]]:
        for n, part in enumerate(self.parts):
            if not isinstance(part, str):
                yield part
                continue
            if n not in self.held:
                raw = load(part)
                self.held[n] = (pickle.loads(raw), len(raw))
                while len(self.held) > 1 and sum(b for _, b in self.held.values()) > HELD_BYTES:
                    self.held.popitem(last=False)
            self.held.move_to_end(n)
            yield self.held[n][0]


def load(uri: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()


_indexes: dict[tuple[str, ...], Index] = {}


def index_of(files: list[tuple[str, str]]) -> Index:
    """This worker's index over (block, vocabulary) files; a worker keeps the last one only."""
    key = tuple(f for f, _ in files)
    if key not in _indexes:
        vocab: dict[int, np.ndarray] = {}
        for _, f in files:
            for k, v in pickle.loads(load(f)).items():
                vocab[k] = np.union1d(vocab[k], v) if k in vocab else v
        _indexes.clear()
        _indexes[key] = Index([f for f, _ in files], vocab)
    return _indexes[key]


def members(h: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Places in h that hold a hash of vocab (sorted, not empty): a bitmap lets few others through to the search."""
    bits = np.zeros(1 << 20, dtype=bool)
    bits[(vocab >> U(44)).astype(np.int64)] = True
    at = np.flatnonzero(bits[(h >> U(44)).astype(np.int64)])
    return at[vocab[np.minimum(np.searchsorted(vocab, h[at]), len(vocab) - 1)] == h[at]]


def search(data: np.ndarray, off: np.ndarray, items: Index, threshold: float) -> Iterator[tuple[int, int | None, float, int, int]]:
    """(text, item, similarity, first word, words) of every best match in the texts."""
    data = fold(data)
    w = words(data, off, NOT_ALNUM, spans=True)
    if not len(w.hash):
        return
    n_texts = len(off) - 1
    first = np.concatenate([[0], np.cumsum(np.bincount(w.text, minlength=n_texts))])
    short = np.diff(first)
    hashes = {k: runs(w, k) for k in items.vocab}
    known = {k: members(h, items.vocab[k]) for k, h in hashes.items()}
    if not any(len(m) for m in known.values()):
        return
    best: dict[tuple[int, int | None], tuple[float, int, int]] = {}
    for g in (g for block in items.blocks() for g in block):
        h, m = hashes[g.k], known[g.k]
        m = m[g.vocab[np.minimum(np.searchsorted(g.vocab, h[m]), len(g.vocab) - 1)] == h[m]]
        size = g.length - g.k + 1  # shingles of a window
        need = int(np.ceil(threshold * size - 1e-9))
        if len(m) < need:
            continue
        # Windows with at least `need` known shingles: some `need` of them in a row lie within a window's length.
        i = np.flatnonzero(m[need - 1 :] - m[: len(m) - need + 1] < size)
        at = np.unique(np.concatenate([np.arange(max(0, b - size + 1), a + 1) for a, b in zip(m[i].tolist(), m[i + need - 1].tolist(), strict=True)])) if len(i) else i
        at = at[at + g.length <= len(h)]
        at = at[w.text[at] == w.text[at + g.length - 1]]
        spans = [(int(p), g.length) for p in at]
        lone = np.flatnonzero((short < g.length) & (short >= max(g.k, need)))
        held = np.searchsorted(m, first[lone + 1] - g.k + 1) - np.searchsorted(m, first[lone])
        spans += [(int(first[t]), int(short[t])) for t in lone[held >= need]]
        for p, length in spans:
            for i in g.candidates(fingerprint(h[p : p + length - g.k + 1])).tolist():
                key = (int(w.text[p]), g.ids[i])
                if best.get(key, (0.0,))[0] < 1.0:
                    s = similarity(word_grams(lowered(data, w, p, p + length), g.k), g.grams_of(i))
                    if s >= threshold - 1e-12 and s > best.get(key, (0.0,))[0]:
                        best[key] = (s, p - int(first[w.text[p]]), length)
    for (t, item), (s, start, n) in best.items():
        yield t, item, s, start, n


def write_index(benchmark: DataFrame, id_col: str, text_col: str, size: int = BLOCK_ITEMS) -> list[tuple[str, str]]:
    """Index files in the shared folder, of about `size` items each: (block, vocabulary).  Only tasks that Spark has committed name theirs."""
    b = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
    parts = -(-b.count() // size)
    if not parts:
        return []
    base = new_path(benchmark.sparkSession, "decontamination-index")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        rows = [(None if pd.isna(i) else int(i), t) for i, t in zip(pdf["i"], pdf["t"], strict=True)]
        groups = index(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        store, path = fs.FileSystem.from_uri(base)
        store.create_dir(path, recursive=True)
        name = uuid.uuid4().hex
        for kind, what in (("items", groups), ("vocab", vocabulary(groups))):
            with store.open_output_stream(f"{path}/{name}.{kind}") as f:
                f.write(pickle.dumps(what))
        return pd.DataFrame({"name": [name], "n": [sum(len(g.ids) for g in groups)]})

    dealt = b.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts)))
    made = stage(dealt.groupBy("part").applyInPandas(build, "name string, n long"), "decontamination-files")
    return [(f"{base}/{r.name}.items", f"{base}/{r.name}.vocab") for r in made.where("n > 0").orderBy("name").collect()]  # one row for `size` items


FOUND = "doc_id long, item_id long, similarity double, word_start long, n_words long"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, similarity, word_start, n_words."""
    files = write_index(benchmark, item_col, item_text, block_items)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not files:
        return docs.sparkSession.createDataFrame([], FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index_of(files)
        for b in batches:
            data, off = utf8(b.column(1))
            for lo, hi in slices(np.diff(off), SLICE_BYTES):
                rows = list(search(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], items, threshold))
                ids = b.column(0).slice(lo, hi - lo).take(pa.array([r[0] for r in rows], pa.int64()))
                rest = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, *rest], ["doc_id", "item_id", "similarity", "word_start", "n_words"])

    best = narrow.mapInArrow(run, FOUND).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("word_start")).alias("back"), "n_words")).alias("m"))
    return best.select("doc_id", "item_id", "m.similarity", (-F.col("m.back")).alias("word_start"), "m.n_words")


def is_clean(text: Column, files: list[tuple[str, str]], threshold: float = THRESHOLD) -> Column:
    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = index_of(files)
        for col in batches:
            data, off = utf8(col)
            ok = np.ones(len(col), dtype=bool)
            for lo, hi in slices(np.diff(off), SLICE_BYTES):
                for t, *_ in search(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], items, threshold):
                    ok[lo + t] = False
            yield pa.array(ok)

    return clean(text)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col="text", item_col="item_id", item_text="text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents that hold no item, with all their columns; texts are not shuffled."""
    files = write_index(benchmark, item_col, item_text, block_items)
    return docs.where(is_clean(F.col(text_col), files, threshold)) if files else docs


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)
