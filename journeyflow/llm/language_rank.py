"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile lists the most frequent letter n-grams (1 to 3 letters, lower case, word ends count as a
letter) in order of frequency. A document goes to the language whose profile its own profile is
nearest to: the distance sums, over the document's n-grams, how far each is out of place in the
language's list (the list's length if it is missing).

A null text, or one without a letter, is ``und`` with score 0. Equal counts are ordered by n-gram,
equal distances by language. Without any labelled text everything is ``und``. A null language is
never learned. Other columns pass through; those named lang_pred, score or top_score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from journeyflow.llm.texts import chunks, column_batches

PROFILE = 400  # n-grams in a profile
UND = "und"
SLICE = 1 << 18  # bytes of text whose n-grams are held at once
_END = np.uint64(0x1FFFFF)  # fills the places of shorter n-grams
_lower: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is none."""
    global _lower
    if _lower is None:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _lower = table
    return _lower


def ngram_codes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of a chunk's texts, and at which of them each text begins.

    Text ``i`` begins at byte ``starts[i]``; texts are parted by a byte that is no letter.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[starts]
    letters = np.concatenate(([0], _letters()[points]))  # a gap stands before the first text too
    keep = np.concatenate(([True], (letters[1:] != 0) | (letters[:-1] != 0)))
    x = np.concatenate(([0], letters[keep], [0])).astype(np.uint64)
    text_at = np.cumsum(keep)[at] - 1  # each text begins with the gap before it, and ends before its last one
    before, this, after = x[:-2], x[1:-1], x[2:]
    shift = np.uint64(21), np.uint64(42)
    # at each place a letter, a letter or gap with what follows, and the three around a letter
    one = this != 0
    two = one | (after != 0)
    count = np.concatenate(([0], np.cumsum(2 * one.astype(np.int64) + two)))
    grams = np.empty(count[-1], np.uint64)
    at = count[:-1]
    grams[at[one]] = (this << shift[1] | _END << shift[0] | _END)[one]
    grams[(at + one)[two]] = (this << shift[1] | after << shift[0] | _END)[two]
    grams[(at + 2)[one]] = (before << shift[1] | this << shift[0] | after)[one]
    return grams, count[text_at]


def _counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        s = np.sort(codes)
        at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        return s[at], np.diff(np.concatenate((at, [len(s)])))
    order = np.argsort(codes, kind="stable")
    s = codes[order]
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[at], np.add.reduceat(weights[order], at)


def ngram_counts(docs: DataFrame, label: str = "lang", text: str = "text") -> DataFrame:
    """Rows (label, gram, n): n-gram counts of all texts per label, summed within each task."""

    def run(batches):
        held: dict[str, list] = {}
        for batch, c in chunks(batches, text, SLICE):
            codes, at = ngram_codes(c.data, np.concatenate((c.starts, [len(c.data)])))
            labels = batch.column(batch.schema.get_field_index(label)).to_pylist()
            by: dict[str, list[int]] = {}
            for i, one in enumerate(labels):
                by.setdefault(one, []).append(i)
            for one, rows in by.items():
                k, n = _counted(np.concatenate([codes[at[i]:at[i + 1]] for i in rows]))
                if one in held:
                    k, n = _counted(np.concatenate((held[one][0], k)), np.concatenate((held[one][1], n)))
                held[one] = (k, n)
        for one, (k, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))],
                                             names=["label", "gram", "n"])

    part = docs.where(F.col(label).isNotNull()).select(F.col(label).alias(label), text).mapInArrow(run, "label string, gram bigint, n bigint")
    return part.groupBy("label", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, label: str = "lang", text: str = "text", size: int = PROFILE) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of each language, most frequent first.

    Counts cover all rows; only the finished profiles (size x languages numbers) reach the driver.
    """
    rank = Window.partitionBy("label").orderBy(F.desc("n"), "gram")
    top = ngram_counts(docs, label, text).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= size)
    found: dict[str, list[int]] = {}
    for row in top.orderBy("label", "r").collect():
        found.setdefault(row["label"], []).append(row["gram"])
    return found


class Profiles:
    """Rank tables of the languages for vectorised distances."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size, self.names = size, sorted(profiles)
        self.grams = np.unique(np.concatenate([np.array(profiles[k], np.int64) for k in self.names] or [np.zeros(0, np.int64)]).astype(np.uint64))
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for i, k in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.grams, np.array(profiles[k], np.int64).astype(np.uint64))] = np.arange(len(profiles[k]))

    def nearest(self, codes: np.ndarray) -> tuple[str, float]:
        """Nearest language of a text's n-grams, and 1 - its distance over the largest possible one."""
        if not len(codes) or not self.names:
            return UND, 0.0
        k, n = _counted(codes)
        top = k[np.argsort(-n, kind="stable")[: self.size]]
        at = np.searchsorted(self.grams, top)
        known = (at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == top)
        rank = self.ranks[:, np.where(known, at, len(self.grams))]
        out = np.where(rank >= 0, np.abs(rank - np.arange(len(top))), self.size).sum(1)
        best = int(np.argmin(out))
        return self.names[best], 1.0 - float(out[best]) / (self.size * len(top))


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) from every whole text."""
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Profiles(profiles, size)
        for batch in column_batches(texts):
            found = []
            for _, c in chunks([batch], limit=SLICE):
                codes, at = ngram_codes(c.data, np.concatenate((c.starts, [len(c.data)])))
                found += [known.nearest(codes[at[i]:at[i + 1]]) for i in range(c.n)]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                                             ["lang_pred", "score"])

    # only the texts go to Python; not "deterministic", so that no filter above repeats the call
    call = F.arrow_udf(run, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])).asNondeterministic()
    docs = docs.drop("lang_pred", "score")
    return docs.select("*", call(F.col(text)).alias("_found")).select(*docs.columns, "_found.lang_pred", "_found.score")


def fold(modulus: int):
    """crc32 of the document id as text, modulo ``modulus``: the contract's split."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def language_digest(docs: DataFrame) -> DataFrame:
    """Learn from rows whose fold of 4 is not 2, predict all: doc_id, held_out, lang_pred, score."""
    held = F.coalesce(fold(4) == 2, F.lit(False))
    profiles = learn_profiles(docs.where(~held))
    return predict_language(docs.select("doc_id", held.alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
