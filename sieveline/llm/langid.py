"""Language identification by rank-order profiles of character n-grams.

A profile is the ``TOP`` most frequent n-grams (one to three letters, words edged by blanks) of a language, by
rank. A document's own most frequent n-grams are compared to each profile: the out-of-place distance adds up how
far each n-gram's rank is from its rank in the profile, and TOP for one that the profile lacks.

Learning counts the n-grams of all training rows: each task folds its documents to counts, which are summed by
(language, n-gram); only TOP n-grams of each language reach the driver and, from there, the tasks: 3 MB for every
thousand languages. Prediction is one narrow stage over whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0; without training rows every
text is; ties go to the smaller n-gram and to the first language by name; a very long text is read whole, in one task's
memory; repeated rows count each by itself, in learning too; rows with a null language are not learned from, and neither
id, source nor language is an input of a prediction; other columns pass through ``predicted`` but those named as its
results; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import fresh

TOP = 400
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
#: Code points fit 21 bits, so that three of them fit one 63-bit key; absent letters are 0.
_BITS = 21


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the n-grams of a text, by key."""
    words = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(words.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    blank = c == 32
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    # N-grams don't reach across words: a blank stands first or last only.
    keys = np.concatenate([c[~blank], two[~(blank[:-1] & blank[1:])], three[~blank[1:-1]]])
    return np.unique(keys, return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent keys, in order."""
    if len(keys) > 4 * top:  # leaves all that can be among the first
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:top]]


class Profiles:
    def __init__(self, ranks: dict[str, np.ndarray]) -> None:
        self.names = sorted(ranks)
        self.known = np.unique(np.concatenate([ranks[n] for n in self.names])) if ranks else np.array([], dtype=np.int64)
        self.place = np.full((len(self.names), len(self.known) + 1), -1, dtype=np.int64)
        for i, n in enumerate(self.names):
            self.place[i, np.searchsorted(self.known, ranks[n])] = np.arange(len(ranks[n]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not _LETTER.search(text):
            return "und", 0.0
        own = ranked(*gram_counts(text))
        at = np.searchsorted(self.known, own)
        at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] != own)] = len(self.known)
        there = self.place[:, at]
        far = np.where(there < 0, TOP, np.abs(there - np.arange(len(own)))).sum(axis=1)
        best = int(far.argmin())
        return self.names[best], 1.0 - float(far[best]) / (TOP * len(own))


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The profile of each language of all the rows whose language isn't null."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        size = 0

        def merged():
            for name, parts in held.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                yield name, keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        for b in batches:
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    held[name].append(gram_counts(t))
                    size += len(held[name][-1][0])
                if size > 2_000_000:
                    held = defaultdict(list, {n: [(k, c)] for n, k, c in merged()})
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > 1_000_000:  # many scripts: let Spark add up the rest
                        for n, p in held.items():
                            yield pa.RecordBatch.from_pydict({"lang": [n] * len(p[0][0]), "gram": p[0][0], "n": p[0][1]})
                        held, size = defaultdict(list), 0
        for n, k, c in merged():
            yield pa.RecordBatch.from_pydict({"lang": [n] * len(k), "gram": k, "n": c})

    some = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sums = some.mapInArrow(fold, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Salted first, so that the rows of a language don't meet in one task before all but TOP a part are gone.
    first = Window.partitionBy("lang", "_salt").orderBy(F.desc("n"), "gram")
    last = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = sums.withColumn("_salt", F.pmod(F.col("gram"), F.lit(64))).withColumn("r", F.row_number().over(first)).where(F.col("r") <= TOP)
    best = best.withColumn("r", F.row_number().over(last)).where(F.col("r") <= TOP).select("lang", "gram", "r")
    got = best.toPandas()  # TOP rows a language
    return {n: g.sort_values("r")["gram"].to_numpy(np.int64) for n, g in got.groupby("lang")}


def predicted(docs: DataFrame, ranks: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """The documents with lang_pred and score instead of their text."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)  # TOP numbers a language
    names = [c for c in docs.columns if c.lower() not in (text.lower(), "lang_pred", "score")]
    body = fresh("_text", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Profiles(held.value)
        for b in batches:
            said = [p.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], names=[*names, "lang_pred", "score"])

    slim = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(body))
    fields = ", ".join(f"`{c}` {t}" for c, t in slim.dtypes[:-1])
    return slim.mapInArrow(run, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, fold: int = 2, folds: int = 4, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score; rows whose crc32(id) mod ``folds`` is ``fold`` are held out of learning."""
    out = F.coalesce(F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
    ranks = learn(docs.where(~out), text, lang)
    return predicted(docs.select(F.col(doc).alias("doc_id"), out.alias("held_out"), F.col(text).alias("_body")), ranks, "_body")
