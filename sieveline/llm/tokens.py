"""Token counts of a byte-level BPE with word ends, by rank-synchronous merging of ragged arrays.

The vocabulary file is a ``tokenizers`` JSON whose normaliser composes (NFC), turns white space into blanks and
lower-cases, and whose pre-tokens come from one pattern. Each Arrow batch is cut into pre-tokens; those not seen
before are held as one ragged numpy array of symbol ids, and in every round all sequences apply their
lowest-rank pair at once, until no sequence has a pair. A pre-token's count is its number of symbols left.

One narrow stage; a worker holds one batch, the merge table and a cache of at most ``CACHE`` pre-token counts.

Defined results: a null text counts as empty; the strings of special tokens inside a text are single tokens, as
the library's default has them; nothing is truncated; repeated rows count each by itself; only the id of the
input is kept beside the counts.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 500_000
#: Pre-tokens longer than this many bytes are not kept in the cache.
LONG = 64
VOCABULARY = "word_bpe_49k.json"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in signs):
        signs[b] = chr(256 + n)
    return [signs[b] for b in range(256)]


class Merger:
    """The merge table of one vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        patterns = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(patterns[0])
        self.space = regex.compile(r"\s+")
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        end = model["end_of_word_suffix"] or ""
        self.inner = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        self.last = np.array([vocab[s + end] for s in byte_symbols()], dtype=np.int64)
        self.base = len(vocab) + len(self.special) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.none = len(pairs)
        self.cache: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], self.none)

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word (none of them empty) after all merges."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        out = sizes.copy()
        while len(ids) > 1:
            rank = np.where(owner[:-1] == owner[1:], self.rank(ids[:-1], ids[1:]), self.none)
            if rank.min() == self.none:
                break
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, self.none], starts)
            live = lowest < self.none
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ids)]))
            hit = (rank == lowest[group[:-1]]) & (rank < self.none)
            # Of overlapping hits (as in aaa) every other one counts, from the left.
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[place % 2 == 0]
            ids[at] = self.made[rank[at]]
            stay = live[group]
            stay[at + 1] = False
            np.subtract.at(out, owner[at], 1)
            ids, owner = ids[stay], owner[stay]
        return out

    def pieces(self, text: str) -> Iterable[tuple[str, bool]]:
        """Stretches of plain text, and the special strings between them."""
        if self.split_special is None or not any(s in text for s in self.special):
            yield text, False
            return
        at = 0
        for m in self.split_special.finditer(text):
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def count(self, texts: list[str | None]) -> np.ndarray:
        found: list[list[str]] = []
        extra = np.zeros(len(texts), dtype=np.int64)
        for n, text in enumerate(texts):
            own: list[str] = []
            for part, special in self.pieces(text or ""):
                if special:
                    extra[n] += 1
                elif part:
                    part = part if part.isascii() else unicodedata.normalize("NFC", part)
                    # Case folding goes letter by letter, without the rule for a final sigma.
                    part = part.lower() if part.isascii() or "Σ" not in part else "".join(c.lower() for c in part)
                    own += self.pattern.findall(self.space.sub(" ", part))
            found.append(own)
        new = list({w for own in found for w in own if w not in self.cache})
        long_ones: dict[str, int] = {}
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            for w, n in zip(part, self.lengths([w.encode() for w in part]).tolist(), strict=True):
                (self.cache if len(w) <= LONG else long_ones)[w] = n
        get = (self.cache | long_ones).__getitem__ if long_ones else self.cache.__getitem__
        for n, own in enumerate(found):
            extra[n] += sum(map(get, own))
        if len(self.cache) > CACHE:
            self.cache.clear()
        return extra


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def vocabulary(name: str = VOCABULARY) -> str:
    """The installed vocabulary file; each executor finds it by its own installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def counts(docs: DataFrame, limit: int = 2048, path: str | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit. ``path``: a file that every executor has; else the installed vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path or vocabulary())
        for b in batches:
            size = 512  # so that the pre-tokens of very long texts don't pile up
            for k in range(0, b.num_rows, size):
                part = b.slice(k, size)
                n = m.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"))
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
