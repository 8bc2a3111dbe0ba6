"""Document quality by attention-based multiple-instance learning over passages.

Every text is cut into passages of ``PASSAGE`` words (the last one may be shorter, an empty text
is one empty passage). A passage is described by shape features (symbols, repeats, word lengths,
line ends, ...) and a signed projection of its word hashes, and encoded by a trained layer. Gated
attention weighs the encoded passages, and a logistic unit scores their weighted mean. All layers
are learned together from document labels alone, on a bounded sample of labelled documents.

Texts are scored whole. Nulls are empty texts; a label without a document, or a null label, is not
used; without labels of both kinds the score is the share of good ones (0.5 if there are none).
Labels, language, source and ids are never features. Extra columns pass through `score_quality`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from journeyflow.llm.language_rank import fold
from journeyflow.llm.texts import chunks, mix, ranks_of_equal

PASSAGE = 64
HASHED = 16
SHAPE = 14
HIDDEN, GATE = 24, 16
TRAIN_DOCUMENTS = 6000  # labelled documents that the model is fitted on, at most
THRESHOLD = 0.3
_U = np.uint64

#: Byte classes whose counts per character or word are features.
_CLASSES = [b"#*$%&<>", b"|", b"0123456789", bytes(range(65, 91)), b".!?", b",;:", b"\n", b"@/_=+"]
_MEMBER = np.zeros((len(_CLASSES), 256), np.float32)
for _k, _c in enumerate(_CLASSES):
    _MEMBER[_k, list(_c)] = 1


def passage_features(c) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a chunk (float32), and the passages' count per text."""
    start, end, n_words = c.words()
    n = np.maximum(-(-n_words // PASSAGE), 1)
    passage_at = np.concatenate(([0], np.cumsum(n)))
    text_of = np.repeat(np.arange(c.n), n_words)
    word_at = np.concatenate(([0], np.cumsum(n_words)))
    of = passage_at[text_of] + (np.arange(len(start)) - word_at[text_of]) // PASSAGE
    total = int(passage_at[-1])
    words = np.bincount(of, minlength=total).astype(float)
    per = np.maximum(words, 1)
    length = (end - start).astype(float)
    hashes = c.bytes.hashes(start, end)
    out = np.zeros((total, SHAPE + HASHED), np.float32)
    # bytes of a class from each word's start to the next one's, so line ends count too
    following = np.concatenate((start[1:], [len(c.data)])) if len(start) else start
    following = np.minimum(following, c.ends[text_of])
    for k in range(len(_CLASSES)):
        sums = np.concatenate(([0], np.cumsum(_MEMBER[k][c.data], dtype=np.float64)))
        out[:, k] = np.minimum(np.bincount(of, sums[following] - sums[start], total) / per, 8)
    first = len(_CLASSES)
    mean = np.bincount(of, length, total) / per
    out[:, first] = np.minimum(mean, 40) / 10
    out[:, first + 1] = np.minimum(np.sqrt(np.maximum(np.bincount(of, length ** 2, total) / per - mean ** 2, 0)), 40) / 10
    rank, _ = ranks_of_equal(hashes ^ mix(of + 1))
    out[:, first + 2] = np.bincount(of, rank > 0, total) / per
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]))) if len(hashes) else np.zeros(0, bool)
    out[:, first + 3] = np.bincount(of, same, total) / per
    whole, _ = ranks_of_equal(hashes ^ mix(text_of + (1 << 40)))
    out[:, first + 4] = np.bincount(of, whole > 0, total) / per
    out[:, first + 5] = words / PASSAGE
    for k in range(HASHED):
        sign = ((hashes >> _U(k + 7)) & _U(1)).astype(float) * 2 - 1
        out[:, SHAPE + k] = np.bincount(of, sign, total) / np.sqrt(per) / 3
    return out, n


def _segments(n: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(n)))[:-1]


class Model:
    """Encoder, gated attention and logistic unit."""

    def __init__(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-4):
        self.share = float(y.mean()) if len(y) else 0.5
        self.fitted = len(y) > 0 and 0 < self.share < 1
        if not self.fitted:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        random = np.random.default_rng(3)
        shapes = {"W": (x.shape[1], HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": ()}
        self.p = {k: random.normal(0, 1 / np.sqrt(s[0]) if s else 0, s) for k, s in shapes.items()}
        self._fit(x, n, y, steps, rate, decay)

    def _forward(self, x: np.ndarray, n: np.ndarray) -> tuple:
        p, at = self.p, _segments(n)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * g) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, at), n))
        a /= np.repeat(np.add.reduceat(a, at), n)
        z = np.add.reduceat(h * a[:, None], at)
        return x, h, t, g, a, z, 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))

    def _fit(self, x, n, y, steps, rate, decay) -> None:
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        random, at = np.random.default_rng(4), _segments(n)
        for step in range(1, steps + 1):
            docs = np.sort(random.choice(len(n), min(512, len(n)), replace=False))
            rows = np.concatenate([np.arange(at[i], at[i] + n[i]) for i in docs])
            m = n[docs]
            xs, h, t, g, a, z, s = self._forward(x[rows], m)
            p = self.p
            ds = (s - y[docs]) / len(docs)
            dz = np.repeat(ds[:, None] * p["c"], m, 0)
            da = (dz * h).sum(1)
            da = a * (da - np.repeat(np.add.reduceat(a * da, _segments(m)), m))
            dt, dg = da[:, None] * p["w"] * g * (1 - t * t), da[:, None] * p["w"] * t * g * (1 - g)
            dh = (dz * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grads = {"W": xs.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "c": z.T @ ds, "d": ds.sum()}
            for k, v in grads.items():
                v = v + decay * p[k]
                m1, m2 = moments[k]
                m1, m2 = 0.9 * m1 + 0.1 * v, 0.999 * m2 + 0.001 * v * v
                moments[k] = m1, m2
                p[k] = p[k] - rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)

    def scores(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Score of each text from its passages' features."""
        if not self.fitted:
            return np.full(len(n), self.share)
        return self._forward(x, n)[-1] if len(n) else np.zeros(0)


def learn(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCUMENTS) -> Model:
    """Fit a model on at most ``sample`` labelled documents (least hashes of doc_id).

    ``labels`` has doc_id and quality; of several labels of a document the largest counts, of
    several rows with a doc_id the one whose text has the least hash. So at most ``sample`` rows
    are broadcast, encoded and brought to the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("l_id"), (F.col("quality") > 0).cast("int").alias("y"))

    def run(batches):
        for batch, c in chunks(batches):
            x, n = passage_features(c)
            at = np.concatenate((_segments(n), [len(x)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[at[i]:at[i + 1]].tobytes() for i in range(c.n)], pa.binary())], names=["y", "x"])

    joined = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("l_id"))
    one = joined.groupBy("l_id").agg(F.min(F.struct(F.xxhash64("text"), "y", "text")).alias("row"))  # `sample` rows at most
    taken = one.select("row.y", "row.text")
    rows = taken.mapInArrow(run, "y int, x binary").collect()
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, SHAPE + HASHED) for r in rows]
    return Model(np.concatenate(x).astype(float) if x else np.zeros((0, SHAPE + HASHED)), np.array([len(k) for k in x], np.int64), np.array([r["y"] for r in rows], float))


def score_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: better) of every whole text."""
    docs = docs.drop("score")

    def run(batches):
        for batch, c in chunks(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(*passage_features(c)), pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn outside the held-out fold of 5, score all: doc_id, held_out, score, predicted."""
    held = F.coalesce(fold(5) == 0, F.lit(False))
    model = learn(docs.select("doc_id", "text"), labels.where(~held))
    scored = score_quality(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
