"""Toxicity by weak supervision.

Voters: lexicons of words and word beginnings, in tiers of strength, mined by log-likelihood ratio from the labels of two thirds of the
training documents; a fixed list of English insults; and surface patterns.  A voter says toxic, clean, or nothing.
On the other third a generative label model (EM over the votes alone; no label is a voter, a start or a target) estimates how
often each voter speaks and is right, and how voters that speak of the same thing are correlated; correlated voters share their weight.
Its only anchor is the share of toxic labels as prior.  A linear classifier over the voters' counts and the single mined forms learns
the posterior labels and scores every whole text.

Fitted on at most train_docs labelled documents of at most train_bytes each (the first by a hash of doc_id).  Forms are counted where
the texts are; what reaches the driver is FORMS forms, and for each document of the last third its voters' counts and its forms.

Defined results: a null, empty or blank text scores 0; without labelled documents, or with one class only, all others score the
share of toxic labels (0 if none); a null id counts as the id ''; documents labelled twice take the larger label; of documents that repeat
a labelled id the least text is learned from; repeated rows score alike; of a text over SEGMENT bytes the segments' counts are added; an
empty table gives an empty result; no column but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import NOT_ALNUM, U, byte_set, segments, slices, utf8, words
from .common import stage
from .quality_mil import held_out, training_rows

TRAIN_DOCS, TRAIN_BYTES = 9000, 200_000
FOLDS, HELD_OUT, CUT = 4, 2, 0.3
PREFIXES = (4, 5, 6, 7, 8, 10)
FORMS, LEAST_DOCS, LEAST_LLR = 600, 4, 20.0
#: Ridge on the weights of single forms, of scaled columns.
FORM_RIDGE = 300.0
#: Least share of toxic documents among those that hold a form, in the first and second tier.
TIERS = (0.97, 0.8)
#: Found words in a thousand: fewer than the first say clean, the second and more toxic.
DENSE = (5, 15)
SLICE_BYTES, SEGMENT = 2 << 20, 1 << 20
#: Distinct forms that a task counts before it passes them on.
COUNTED = 2_000_000

#: Insults that one voter looks for whatever the labels say.  (fixed values)
INSULTS = "idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting clown fool jerk ugly hate kill shut freak creep coward liar pig vermin filth".split()

BANG, UPPER, SYMBOL = byte_set(b"!"), byte_set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), byte_set(b"#*$%&@")


def text_words(data: np.ndarray, off: np.ndarray):
    return words(data, off, NOT_ALNUM, prefixes=PREFIXES)


def hash_of(word: str) -> int:
    return int(text_words(*utf8(pa.array([word]))).hash[0])


class Forms:
    """A set of hashed forms; row() gives each hash's place or -1, by a bitmap first and a search for the few it lets through."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes.astype(U))
        self.order = np.argsort(hashes.astype(U))
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[(self.sorted >> U(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that hold a form, and which form."""
        if not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(h >> U(48)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        hit = self.sorted[i] == h[at]
        return at[hit], self.order[i[hit]]


@dataclass
class Lexicon:
    forms: Forms
    voter: np.ndarray  # the voter of each form
    n_forms: int
    n_voters: int
    insults: Forms

    def raw(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: how many words each voter finds (lexicons, insults, then bytes of each pattern), which forms occur, how many words."""
        n = len(off) - 1
        w = text_words(data, off)
        total = np.bincount(w.text, minlength=n)
        by, has = np.zeros((n, self.n_voters + 4)), np.zeros((n, self.n_forms), dtype=np.float32)
        best = np.full(len(w.hash), self.n_forms)  # forms are ranked: the strongest that a word has speaks for it
        for h in (w.hash, *w.prefix):
            at, form = self.forms.find(h)
            np.minimum.at(best, at, form)
            has[w.text[at], form] = 1
        at = np.flatnonzero(best < self.n_forms)
        np.add.at(by, (w.text[at], self.voter[best[at]]), 1)
        at, _ = self.insults.find(w.hash)
        np.add.at(by, (w.text[at], self.n_voters), 1)
        for j, table in enumerate((BANG, UPPER, SYMBOL)):
            c = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
            by[:, self.n_voters + 1 + j] = c[off[1:]] - c[off[:-1]]
        return by, has, total

    def counts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """raw() of whole texts from that of their segments, with densities of the patterns."""
        cut, owner = segments(data, off, SEGMENT, NOT_ALNUM)
        parts = [self.raw(data[cut[lo] : cut[hi]], cut[lo : hi + 1] - cut[lo]) for lo, hi in slices(np.diff(cut), SLICE_BYTES)]
        if not parts:
            return np.zeros((0, self.n_voters + 4)), np.zeros((0, self.n_forms), np.float32), np.zeros(0, np.int64)
        by, has, total = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(owner) > len(off) - 1:
            first = np.unique(owner, return_index=True)[1]
            by, has, total = np.add.reduceat(by, first, axis=0), np.maximum.reduceat(has, first, axis=0), np.add.reduceat(total, first)
        by[:, self.n_voters + 1 :] /= np.maximum(total, 1)[:, None]
        return by, has, total

    def names(self) -> list[str]:
        """What each column of votes() is."""
        lex = [f"tier {i // 4 + 1} lexicon {i % 4 + 1}" for i in range(self.n_voters)] + ["insults"]
        return [*lex, *[f"{x}, twice" for x in lex], "three of any", "none of any", "density", "exclamation marks", "capitals", "symbols"]

    def votes(self, by: np.ndarray, total: np.ndarray) -> np.ndarray:
        """1 toxic, -1 clean, 0 nothing.  Each lexicon has a voter for one word and one for two, all together one for three, where what all
        find is dense enough; one says clean where none finds any; one goes by that density; a pattern only ever says toxic, at unusual density."""
        lex = by[:, : self.n_voters + 1]
        found = lex.sum(axis=1, keepdims=True)
        dense = 1000 * found / np.maximum(total, 1)[:, None]
        none = -1 * (found == 0)
        rate = np.where(found == 0, 0, np.where(dense >= DENSE[1], 1, np.where(dense < DENSE[0], -1, 0)))
        lex, found = lex * (dense >= DENSE[0]), found * (dense >= DENSE[0])
        return np.concatenate([lex >= 1, lex >= 2, found >= 3, none, rate, by[:, self.n_voters + 1 :] > np.array([0.5, 3.0, 1.0])], axis=1).astype(np.int8)


def forms_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of words and beginnings of each text, and whose they are."""
    w = text_words(data, off)
    h, t = np.concatenate([w.hash, *w.prefix]), np.tile(w.text, 1 + len(w.prefix))
    h, t = h[h != 0], t[h != 0]
    by = np.lexsort((h, t))
    h, t = h[by], t[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], t[new]


def count_forms(rows: DataFrame) -> DataFrame:
    """h, a, b: toxic and clean documents that hold each form.  rows: (y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            h, y = (np.concatenate(x) for x in zip(*held, strict=True))
            form, at = np.unique(h, return_inverse=True)
            a = np.bincount(at[y > 0], minlength=len(form))
            return pa.RecordBatch.from_arrays([pa.array(form.view(np.int64)), pa.array(a), pa.array(np.bincount(at, minlength=len(form)) - a)], ["h", "a", "b"])

        for batch in batches:
            y = np.array(batch.column(0).to_pylist())
            data, off = utf8(batch.column(1))
            for lo, hi in slices(np.diff(off), SLICE_BYTES):
                h, t = forms_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                held.append((h, y[lo + t]))
                if sum(len(x) for x, _ in held) > COUNTED:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return rows.select("y", "text").mapInArrow(run, "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def strongest(forms: DataFrame, n_a: int, n_b: int) -> list:
    """The FORMS forms of the greatest log-likelihood ratio that lean toxic, of at least LEAST_DOCS toxic documents and LEAST_LLR.  forms: (h, a, b)."""

    def part(x: str, n: int, p: str) -> str:
        return f"{x} * ln(greatest({p}, 1e-12D)) + ({n} - {x}) * ln(greatest(1 - {p}, 1e-12D))"

    both = f"(a + b) / {n_a + n_b}D"
    g = f"2 * ({part('a', n_a, f'(a / {n_a}D)')} + {part('b', n_b, f'(b / {n_b}D)')} - ({part('a', n_a, both)}) - ({part('b', n_b, both)}))"
    kept = forms.where(f"a >= {LEAST_DOCS} AND a >= b AND a * {n_b} > b * {n_a}").selectExpr("h", "a", "b", f"{g} AS g").where(f"g >= {LEAST_LLR}")
    return kept.orderBy(F.desc("g"), "h").limit(FORMS).collect()


def lexicon_of(best: list) -> Lexicon:
    """Forms rank by precision tier, then by strength; a tier's forms are dealt to four voters, so that each speaks of other words."""
    share = np.array([r.a / (r.a + r.b) for r in best])
    tier = np.where(share >= TIERS[0], 0, np.where(share >= TIERS[1], 1, 2)).astype(np.int64) if len(best) else np.zeros(0, np.int64)
    order = np.argsort(tier, kind="stable")
    form = np.array([r.h for r in best], dtype=np.int64).view(U)[order]
    return Lexicon(Forms(form), tier[order] * 4 + np.arange(len(best)) % 4, len(best), 12, Forms(np.array([hash_of(w) for w in INSULTS], dtype=U)))


@dataclass
class LabelModel:
    """What EM estimates from votes alone: P(vote | toxic) and P(vote | clean) of each voter for -1, 0, 1; correlations; posteriors."""

    toxic: np.ndarray
    clean: np.ndarray
    correlation: np.ndarray
    weight: np.ndarray
    posterior: np.ndarray
    prior: float

    def accuracy(self) -> np.ndarray:
        """How often each voter is right where it speaks."""
        right = self.prior * self.toxic[:, 2] + (1 - self.prior) * self.clean[:, 0]
        return right / (right + self.prior * self.toxic[:, 0] + (1 - self.prior) * self.clean[:, 2])


def label_model(votes: np.ndarray, prior: float, lead: int, rounds: int = 30) -> LabelModel:
    """Classification EM over P(vote | class).  It starts from what voter `lead` calls toxic; any voter that is mostly right would do.

    Correlation is what the votes of two voters share beyond the classes of the round; a voter's weight is 1 over 1 plus its correlations,
    so that many voters that speak of one thing count about once.  Saying nothing is no evidence: voters know different words."""
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # doc, voter, vote
    now, last = votes[:, lead] > 0, None
    for _ in range(rounds):
        q = now.astype(float)
        t = [(np.einsum("dvk,d->vk", onehot, x) + 0.5) / (x.sum() + 1.5) for x in (q, 1 - q)]
        spread = votes - (q[:, None] * (t[0] @ [-1, 0, 1]) + (1 - q)[:, None] * (t[1] @ [-1, 0, 1]))
        sd = spread.std(axis=0) + 1e-6
        corr = (spread.T @ spread) / len(votes) / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + np.clip(corr, 0, 1).sum(axis=1))
        told = np.log(t[0]) - np.log(t[1])
        told[:, 1] = 0
        evidence = np.einsum("dvk,vk,v->d", onehot, told, weight)
        posterior = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence, -30, 30)))
        last, now = now, posterior >= 0.5
        if (now == last).all():
            break
    return LabelModel(t[0], t[1], corr, weight, posterior, prior)


def features(by: np.ndarray, has: np.ndarray, total: np.ndarray) -> np.ndarray:
    lex = by[:, :-3]
    return np.concatenate([np.log1p(lex), (lex > 0), np.log1p(lex.sum(axis=1, keepdims=True)), np.log1p(1000 * lex.sum(axis=1, keepdims=True) / np.maximum(total, 1)[:, None]), np.minimum(by[:, -3:], 5), has], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray = 3.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Newton's method for ridge-penalised logistic regression on soft labels; columns are scaled inside."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    penalty = np.diag(np.append(np.broadcast_to(ridge, x.shape[1]), 1e-6))
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + penalty
        step = np.linalg.solve(h, z.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 10 / (np.abs(step).max() + 1e-12))
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


@dataclass
class Model:
    lexicon: Lexicon | None
    weights: np.ndarray
    bias: float
    labels: LabelModel | None = None

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.lexicon is None:
            return np.where(np.bincount(words(data, off, NOT_ALNUM).text, minlength=len(off) - 1) > 0, self.bias, 0.0)
        by, has, total = self.lexicon.counts(data, off)
        y = 1 / (1 + np.exp(-np.clip(features(by, has, total) @ self.weights + self.bias, -30, 30)))
        return np.where(total > 0, y, 0.0)

    def report(self) -> list[dict]:
        """Each voter with how often it speaks and, as estimated without labels, is right, and its weight beside correlated ones."""
        m = self.labels
        if m is None:
            return []
        speaks = 1 - m.prior * m.toxic[:, 1] - (1 - m.prior) * m.clean[:, 1]
        return [{"voter": n, "speaks": s, "accuracy": a, "weight": w} for n, s, a, w in zip(self.lexicon.names(), speaks, m.accuracy(), m.weight, strict=True)]


def fit(lexicon: Lexicon, by: np.ndarray, has: np.ndarray, total: np.ndarray, prior: float) -> Model:
    """The label model over the documents' votes, and the classifier on its posteriors."""
    labels = label_model(lexicon.votes(by, total), float(np.clip(prior, 0.01, 0.99)), lexicon.names().index("density"))
    x = features(by, has, total)
    # The voters' counts carry the score; a single form only corrects it.
    w, d = logistic(x, labels.posterior, ridge=np.where(np.arange(x.shape[1]) < x.shape[1] - lexicon.n_forms, 3.0, FORM_RIDGE))
    return Model(lexicon, w, d, labels)


COUNTS = "id long, by binary, forms binary, total long"


def count_votes(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """For each document its voters' counts and which forms it holds.  rows: (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            by, has, total = lexicon.counts(data, off)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in by], pa.binary()), pa.array([np.packbits(x > 0).tobytes() for x in has], pa.binary()), pa.array(total, pa.int64())], ["id", "by", "forms", "total"])

    return rows.select("id", "text").mapInArrow(run, COUNTS)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col="doc_id", text_col="text", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    rows = stage(training_rows(docs, labels, label, FOLDS, HELD_OUT, train_docs, train_bytes, id_col, text_col).withColumn("third", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)).cast("int")), "toxic-sample")
    n, n_toxic, n_a, n_mined = rows.agg(F.count("*"), *[F.count_if(F.expr(c)) for c in ("y > 0", "y > 0 AND third > 0", "third > 0")]).first()
    prior = n_toxic / n if n else 0.0
    if not n_a or n_a == n_mined or n_mined == n:
        return Model(None, np.zeros(0), prior)
    lexicon = lexicon_of(strongest(count_forms(rows.where("third > 0")), n_a, n_mined - n_a))
    seen = stage(count_votes(rows.where("third = 0"), lexicon), "toxic-counts").collect()  # at most train_docs rows of some hundred bytes
    seen.sort(key=lambda r: r.id)
    by = np.stack([np.frombuffer(r.by) for r in seen])
    has = np.stack([np.unpackbits(np.frombuffer(r.forms, np.uint8))[: lexicon.n_forms] for r in seen]).astype(np.float32)
    return fit(lexicon, by, has, np.array([r.total for r in seen]), prior)


def score(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            data, off = utf8(col)
            # Forms are one column each, so a batch of many short texts is scored in slices.
            out = [model.score(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in slices(np.diff(off) + 256, SLICE_BYTES)]
            yield pa.array(np.concatenate([np.zeros(0), *out]))

    return run(text)


def query(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    model = train(docs, labels, train_docs=train_docs, train_bytes=train_bytes)
    d = docs.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), score(F.col("text"), model).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
