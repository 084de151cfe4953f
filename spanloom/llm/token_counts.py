"""Token counts of whole texts: an Arrow function that returns lengths only.

Texts are grouped by bytes and cut into pieces at safe boundaries; the distinct pieces go to the tokenizer in batches of
about BATCH_BYTES, so that neither one long text nor many at once decide what a call holds.  A boundary is safe where the byte-level
pre-tokenizer ends a token whatever follows: before a run of white space, and in long pieces between ASCII letters and digits.
Merges never cross such a place and no special string holds one, so lengths add up.  A run without any safe boundary is encoded whole.

Counts of pieces of at most SHORT bytes are kept, up to KEEP_BYTES of them: words come back.  Longer pieces are counted and forgotten.

Vocabularies that are not byte-level, or whose special strings hold spaces or are mere letters, see whole texts in batches of the same bytes.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows count alike; an empty table gives an
empty result; other columns stay as they are, unless they have the names of the three that are added.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import set_python_limits

PIECE_CHARS = 32_768
BATCH_BYTES = 1 << 20
LIMIT = 512
SAFE = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """text in order, cut at the first safe boundary after each `most` characters."""
    at = 0
    while len(text) - at > most:
        m = SAFE.search(text, at + most)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


#: Where white space meets white space or stands at the start, or is neither space nor newline, a cut at each would not be safe.
CROWDED = re.compile(r"\A\s|\s\s|[^\S \n]|[\x1c-\x1f]")
#: A run of white space (without U+001C to U+001F, which are none to the tokenizer) and what follows up to the next run.
RUNS = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+\Z")
MARKS = ".,;:!?"
SHORT, KEEP_BYTES, ENTRY_BYTES = 64, 48 << 20, 120

_loaded: dict[str, "Lengths"] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Lengths:
    """Token counts of texts by one vocabulary.

    A piece that is one run of letters, with or without a space before it, is one pre-token: the vocabulary's own merge
    model counts it.  All other pieces are encoded in batches balanced by bytes."""

    def __init__(self, path: str, keep_bytes: int = KEEP_BYTES):
        set_python_limits()
        self.keep_bytes = keep_bytes
        self.forget()
        self.model = None
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self.encode = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            if byte_level(t):
                self.model, self.letters = t.model, dict(enumerate(byte_letters()))
        else:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(e) for e in p.encode(texts, num_threads=1)]

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.held = 0

    def keep(self, piece: str, n: int) -> int:
        self.known[piece] = n
        self.held += ENTRY_BYTES + len(piece.encode())
        return n

    def word(self, piece: str) -> int:
        n = self.known.get(piece)
        return self.keep(piece, len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))) if n is None else n

    def batches(self, texts: Iterable[str]) -> Iterator[list[str]]:
        """Texts in order, in batches of about BATCH_BYTES (or one that is longer)."""
        batch, held = [], 0
        for t in texts:
            n = len(t.encode())
            if batch and held + n > BATCH_BYTES:
                yield batch
                batch, held = [], 0
            batch.append(t)
            held += n
        if batch:
            yield batch

    def learn(self, new: set[str]) -> None:
        """Counts of short pieces, to be kept."""
        rest = []
        for p in new:
            bare = p[1:] if p[0] == " " else p
            if bare.isalpha():
                self.word(p)
            elif bare[-1:] in MARKS and bare[:-1].isalpha():
                self.keep(p, self.word(p[:-1]) + self.word(p[-1]))
            else:
                rest.append(p)
        for batch in self.batches(rest):
            for p, n in zip(batch, self.encode(batch), strict=True):
                self.keep(p, n)

    def of(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        for batch in self.batches(t or "" for t in texts):
            out += self.cut(batch) if self.model is not None else self.encode(batch)
        return out

    def cut(self, texts: list[str]) -> list[int]:
        if self.held > self.keep_bytes:
            self.forget()
        parts = [safe_pieces(t) for t in texts]
        distinct = set().union(*parts)
        if long := [p for p in distinct if len(p) > SHORT]:
            distinct.difference_update(long)
            cuts = {p: list(pieces(p)) for p in long}
            each = list(chain.from_iterable(cuts.values()))
            lengths = iter([n for batch in self.batches(each) for n in self.encode(batch)])
            counted = {p: sum(islice(lengths, len(c))) for p, c in cuts.items()}
        else:
            counted = {}
        self.learn(distinct.difference(self.known))
        n = self.known.__getitem__ if not long else lambda p: counted[p] if len(p) > SHORT else self.known[p]
        return [sum(map(n, p)) for p in parts]


def byte_level(t) -> bool:
    """Whether pieces of a text add up: a byte-level pre-tokenizer with its pattern, nothing before it, and special strings that no cut goes through."""
    p = t.pre_tokenizer
    plain = type(p).__name__ == "ByteLevel" and p.use_regex and not p.add_prefix_space and t.normalizer is None
    return plain and not any(re.search(r"\s", a.content) or a.content.isalnum() or a.lstrip or a.rstrip or a.single_word for a in t.get_added_tokens_decoder().values())


def safe_pieces(text: str) -> list[str]:
    """A text cut before every run of white space."""
    if not text:
        return []
    if CROWDED.search(text):
        return RUNS.findall(text)
    out: list[str] = []
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        out += ["\n", first, *[" " + p for p in rest]]
    del out[0]
    return out


def count_batch(texts: list[str | None], path: str) -> list[int]:
    if path not in _loaded:
        _loaded[path] = Lengths(path)
    return _loaded[path].of(texts)


def n_tokens(text: Column, path: str) -> Column:
    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield pa.array(count_batch(col.to_pylist(), path), pa.int64())

    return count(text)


def token_counts(df: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [c for c in df.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    counted = df.select(*keep, F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(F.col(text_col), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return token_counts(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).drop("text")
