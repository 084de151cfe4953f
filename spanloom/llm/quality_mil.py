"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words.  A passage is encoded from its words: hashed words and word pairs look up
embeddings of DIMS numbers that are learned end to end, their mean stands beside rates of its surface (RATES), and a tanh layer joins
the two.  Gated attention weights, learned from document labels alone, say how much each passage counts, and a logistic layer scores
the weighted passage representation.

The model is fitted on the driver on a sample of labelled documents, bounded by train_docs documents of at most train_bytes each (the
first by a hash of doc_id), whose passages are hashed by the executors: some five bytes a word reach the driver.  Scoring covers every
passage of every text: a text over SEGMENT bytes is cut between words, its passages numbered and its repeats counted in each segment, and
attention runs over all of them by running maxima and sums.

Defined results: a null, empty or blank text scores 0; without labelled documents every other text scores 0.5; a null id is held out;
documents labelled twice take the larger label; of documents that repeat a labelled id the least text is learned from; repeated rows score
alike; an empty table gives an empty result; no column but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import SPACES, U, byte_set, mix, segments, slices, utf8, words
from .common import stage

PASSAGE = 64
TRAIN_DOCS, TRAIN_BYTES = 3000, 50_000
HIDDEN, GATE, EPOCHS, RATE, DECAY = 24, 12, 10, 0.01, 1e-4
#: Embeddings: one for each of BUCKETS hashes of words and word pairs.
BUCKET_BITS, DIMS, EMBED_DECAY = 11, 12, 1e-3
BUCKETS = 1 << BUCKET_BITS
FOLDS, HELD_OUT, CUT = 5, 0, 0.3
SLICE_BYTES, SEGMENT = 2 << 20, 1 << 20

#: Byte classes counted in each passage, for each word.
CLASSES = {
    "upper": byte_set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": byte_set(b"0123456789"), "bang": byte_set(b"!?"), "bar": byte_set(b"|"), "symbol": byte_set(b"#*$%&<>{}=_\\@~^+/"),
    "stop": byte_set(b".,;:"), "quote": byte_set(b"\"'()[]-`"), "line": byte_set(b"\n"), "space": SPACES, "high": np.arange(256) >= 0x80, "control": np.arange(256) < 9,
}
#: Rates of each passage.  again: words that start a run of three found before or later; frame: a word and the third after it, over twice.
RATES = [*CLASSES, "mean_len", "len_spread", "one_letter", "long_word", "distinct", "echo", "again", "frame", "fill", "n_words", "n_passages"]


@dataclass
class Passages:
    """Passages in order: rates, the bucket of each word and of each pair it begins (BUCKETS where the passage ends), words of each; first[t] is text t's first."""

    rates: np.ndarray
    words: np.ndarray
    pairs: np.ndarray
    sizes: np.ndarray
    first: np.ndarray


def sizes_of(n_words: int) -> np.ndarray:
    """The words of each passage of a text."""
    return np.minimum(PASSAGE, n_words - np.arange(0, n_words, PASSAGE))


def passages(data: np.ndarray, off: np.ndarray) -> Passages:
    n = len(off) - 1
    w = words(data, off, SPACES, spans=True)
    count = np.bincount(w.text, minlength=n)
    first_word = np.concatenate([[0], np.cumsum(count)])
    per = -(-count // PASSAGE)
    first = np.concatenate([[0], np.cumsum(per)])
    if not len(w.hash):
        none = np.zeros(0, np.uint16)
        return Passages(np.zeros((0, len(RATES)), np.float32), none, none, np.zeros(0, np.int64), first)
    text = np.repeat(np.arange(n), per)
    at = first_word[text] + (np.arange(first[-1]) - first[text]) * PASSAGE  # first word of each passage
    upto = np.minimum(at + PASSAGE, first_word[text + 1])
    size = (upto - at).astype(np.float64)
    byte_from, byte_to = w.start[at], np.where(upto < first_word[text + 1], w.start[np.minimum(upto, len(w.start) - 1)], off[text + 1])
    cols = []
    for table in CLASSES.values():
        c = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        cols.append((c[byte_to] - c[byte_from]) / size)

    def per_word(v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v.astype(np.float64), at) / size

    length = (w.end - w.start).astype(np.float64)
    mean = per_word(length)
    own = np.repeat(np.arange(first[-1], dtype=np.uint64), (upto - at))
    key = np.sort(w.hash ^ mix(own))  # a word and its passage; equal only for the same word again
    uniq = np.unique(key)
    distinct = np.bincount(own[np.unique(w.hash ^ mix(own), return_index=True)[1]].astype(np.int64), minlength=first[-1]) if len(uniq) < len(key) else size
    same = np.zeros(len(w.hash))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    again = np.zeros(len(w.hash))
    if len(w.hash) >= 3:
        ok = w.text[2:] == w.text[:-2]
        tri = mix(w.hash[:-2] + w.hash[1:-1] * U(3) + w.hash[2:] * U(7) + mix(w.text[2:].astype(U)))
        _, inv, cnt = np.unique(tri, return_inverse=True, return_counts=True)
        again[:-2] = (cnt[inv] > 1) & ok
    frame = np.zeros(len(w.hash))
    cols += [mean, np.sqrt(np.maximum(per_word(length**2) - mean**2, 0)), per_word(length == 1), per_word(length > 14), distinct / size, per_word(same), per_word(again)]
    if len(w.hash) >= 4:
        ok = w.text[3:] == w.text[:-3]
        quad = mix(w.hash[:-3] + w.hash[3:] * U(5) + mix(w.text[3:].astype(U)))
        _, inv, cnt = np.unique(quad, return_inverse=True, return_counts=True)
        frame[:-3] = (cnt[inv] > 2) & ok
    cols += [per_word(frame), size / PASSAGE, np.log1p(count[text]), np.log1p(per[text])]
    bucket = (w.hash >> U(64 - BUCKET_BITS)).astype(np.uint16)
    pair = np.full(len(w.hash), BUCKETS, np.uint16)
    pair[:-1] = mix(w.hash[:-1] * U(3) + w.hash[1:]) >> U(64 - BUCKET_BITS)
    pair[upto - 1] = BUCKETS
    return Passages(np.sqrt(np.abs(np.stack(cols, axis=1))).astype(np.float32), bucket, pair, upto - at, first)


@dataclass
class Model:
    """Gated attention over passages; p holds E, W, b, V, U, w, c, d."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def rates(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def embedded(self, q: Passages) -> np.ndarray:
        """The mean embedding of each passage's words and pairs."""
        table = np.concatenate([self.p["E"], np.zeros((1, DIMS))]).astype(np.float32)
        at = np.concatenate([[0], np.cumsum(q.sizes)[:-1]])
        return (np.add.reduceat(table[q.words], at, axis=0) + np.add.reduceat(table[q.pairs], at, axis=0)) / (2 * q.sizes - 1)[:, None]

    def attended(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """x: rates and mean embeddings of passages.  Their representation h and attention e before the softmax."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return {"h": h, "t": t, "s": s, "e": (t * s) @ p["w"]}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """first: the first passage of each of the bags, none empty."""
        r = self.attended(x)
        sizes = np.diff(np.append(first, len(x)))
        a = np.exp(r["e"] - np.repeat(np.maximum.reduceat(r["e"], first), sizes))
        a /= np.repeat(np.add.reduceat(a, first), sizes)
        z = np.add.reduceat(a[:, None] * r["h"], first, axis=0)
        return r | {"a": a, "z": z, "sizes": sizes, "y": self.judged(z)}

    def judged(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.p["c"] + self.p["d"], -30, 30)))

    def gradient(self, x: np.ndarray, counts: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log-loss.  x: scaled rates; counts: of each bucket in each passage, over their number."""
        p, f = self.p, x.shape[1]
        x = np.concatenate([x, counts @ p["E"].astype(counts.dtype)], axis=1)
        r = self.forward(x, first)
        dy = (r["y"] - y) / len(y)
        dz = np.repeat(dy[:, None] * p["c"][None, :], r["sizes"], axis=0)
        da = (dz * r["h"]).sum(axis=1)
        de = r["a"] * (da - np.repeat(np.add.reduceat(r["a"] * da, first), r["sizes"]))
        dt, ds = de[:, None] * p["w"] * r["s"] * (1 - r["t"] ** 2), de[:, None] * p["w"] * r["t"] * r["s"] * (1 - r["s"])
        dh = (r["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - r["h"] ** 2)
        dm = dh @ p["W"][f:].T
        return {"E": counts.T @ dm.astype(counts.dtype), "W": x.T @ dh, "b": dh.sum(axis=0), "V": r["h"].T @ dt, "U": r["h"].T @ ds, "w": (r["t"] * r["s"]).T @ de, "c": r["z"].T @ dy, "d": dy.sum()}

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A score for each text; texts without passages score 0.  Segments of one text share their attention."""
        cut, owner = segments(data, off, SEGMENT)
        peak, weight, z = np.full(len(owner), -np.inf), np.zeros(len(owner)), np.zeros((len(owner), HIDDEN))
        for lo, hi in slices(np.diff(cut), SLICE_BYTES):
            q = passages(data[cut[lo] : cut[hi]], cut[lo : hi + 1] - cut[lo])
            full = np.flatnonzero(np.diff(q.first))
            if len(full):
                first, own = q.first[full], lo + full
                r = self.attended(np.concatenate([self.rates(q.rates), self.embedded(q)], axis=1))
                peak[own] = np.maximum.reduceat(r["e"], first)
                a = np.exp(r["e"] - np.repeat(peak[own], np.diff(np.append(first, len(r["e"])))))
                weight[own], z[own] = np.add.reduceat(a, first), np.add.reduceat(a[:, None] * r["h"], first, axis=0)
        # Segments of one text stand together: their sums are brought to the greatest of their maxima.
        out, has = np.zeros(len(off) - 1), np.flatnonzero(weight > 0)
        if len(has):
            texts, first = np.unique(owner[has], return_index=True)
            scale = np.exp(peak[has] - np.repeat(np.maximum.reduceat(peak[has], first), np.diff(np.append(first, len(has)))))
            mean = np.add.reduceat(z[has] * scale[:, None], first, axis=0) / np.add.reduceat(weight[has] * scale, first)[:, None]
            out[texts] = self.judged(mean)
        return out


Bag = tuple[np.ndarray, np.ndarray, np.ndarray]  # rates, words, pairs of one document


def counts_of(bags: list[Bag]) -> np.ndarray:
    """How often each bucket occurs in each passage, over the passage's words and pairs."""
    sizes = np.concatenate([sizes_of(len(w)) for _, w, _ in bags])
    own = np.repeat(np.arange(len(sizes)), sizes) * (BUCKETS + 1)
    c = np.bincount(np.concatenate([own + np.concatenate([b[i] for b in bags]) for i in (1, 2)]), minlength=len(sizes) * (BUCKETS + 1))
    return c.reshape(len(sizes), -1)[:, :BUCKETS].astype(np.float32) / (2 * sizes - 1).astype(np.float32)[:, None]


def start(bags: list[Bag], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    everything = np.concatenate([x for x, _, _ in bags])
    f = everything.shape[1] + DIMS
    init = lambda *s: rng.normal(0, s[0] ** -0.5, s)
    p = {"E": rng.normal(0, 0.3, (BUCKETS, DIMS)), "W": init(f, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE), "c": init(HIDDEN), "d": np.zeros(())}
    return Model(everything.mean(axis=0), everything.std(axis=0) + 0.05, p)


def fit(bags: list[Bag], y: np.ndarray, seed: int = 7) -> Model | None:
    """Adam on the log-loss of the documents' labels."""
    if not bags:
        return None
    m, rng = start(bags, seed), np.random.default_rng(seed)
    first_moment = {k: np.zeros_like(v) for k, v in m.p.items()}
    second_moment = {k: np.zeros_like(v) for k, v in m.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(bags), 64):
            own = [bags[i] for i in order[lo : lo + 64]]
            first = np.concatenate([[0], np.cumsum([len(x) for x, _, _ in own])])[:-1]
            grad = m.gradient(m.rates(np.concatenate([x for x, _, _ in own])), counts_of(own), first, y[order[lo : lo + 64]])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in grad.items():
                g = g + (EMBED_DECAY if k == "E" else DECAY) * m.p[k]
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * g * g
                m.p[k] = m.p[k] - rate * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
    return m


def held_out(key: Column, folds: int = FOLDS, at: int = HELD_OUT) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == at


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, at: int, most: int, most_bytes: int, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, y, text) of at most `most` labelled documents that are not held out, the first by a hash of the id, without those over `most_bytes`.

    Only ids and labels are ordered; texts stay spread over the tasks."""
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, at)).groupBy(F.col("doc_id").alias("__sl_id")).agg(F.max(label).alias("y"))
    chosen = y.orderBy(F.xxhash64("__sl_id"), "__sl_id").limit(most)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes))
    d = d.join(F.broadcast(chosen), F.col("id") == F.col("__sl_id"))  # at most `most` narrow rows
    return d.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col="doc_id", text_col="text", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model | None:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                q = passages(*utf8(b.column(2).slice(i, 1)))
                if len(q.words):
                    yield pa.RecordBatch.from_pydict({"id": b.column(0).slice(i, 1), "y": b.column(1).slice(i, 1).cast(pa.float64()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (("x", q.rates), ("w", q.words), ("p", q.pairs))}})

    rows = training_rows(docs, labels, label, FOLDS, HELD_OUT, train_docs, train_bytes, id_col, text_col)
    rows = stage(rows.mapInArrow(encode, "id long, y double, x binary, w binary, p binary"), "quality-sample").collect()  # bounded by train_docs and train_bytes
    rows.sort(key=lambda r: r.id)
    bags = [(np.frombuffer(r.x, np.float32).reshape(-1, len(RATES)), np.frombuffer(r.w, np.uint16), np.frombuffer(r.p, np.uint16)) for r in rows]
    return fit(bags, np.array([r.y for r in rows]))


def score(text: Column, model: Model | None) -> Column:
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            data, off = utf8(col)
            if model:
                yield pa.array(model.score(data, off))
            else:
                yield pa.array(np.where(np.bincount(words(data, off, SPACES).text, minlength=len(off) - 1) > 0, 0.5, 0.0))

    return run(text)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, id_col="doc_id", text_col="text", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """The documents whose score reaches the cut, with all their columns."""
    return docs.where(score(F.col(text_col), train(docs, labels, "quality", id_col, text_col, train_docs, train_bytes)) >= cut)


def query(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    model = train(docs, labels, train_docs=train_docs, train_bytes=train_bytes)
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
