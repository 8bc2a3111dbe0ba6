"""Packing of tokenised documents into fixed-length sequences by a configuration linear program.

Texts become token ids plus an end id; longer ones are cut into full sequences, a shorter piece
first. What is left to decide depends on the histogram of piece lengths alone (at most ``SIZE``
numbers, whatever the corpus): choose how often to use each configuration, a multiset of lengths
that fits a sequence, so that every length is covered and the configurations are few.

The linear program is solved by multiplicative weights: each length has a weight that shrinks as
it gets covered, a knapsack dynamic program finds the configuration of most weight, and the
average of the configurations is a nearly optimal cover. Its rounded-down counts are used, fullest
first, as far as pieces last. The pieces left over are a smaller histogram, solved and rounded
again; what is left after some passes is packed best fit, longest first, on the histogram.

The plan is a bounded table (runs of equal sequences). Pieces of a length get consecutive numbers
by a count per (length, hash bucket) and a running number inside each, so no task sees all pieces
of a common length; a join with the plan gives each piece its sequence and place.

A null text is empty, and an empty document is its end id alone. Rows may repeat: each is packed.
An empty table gives no sequences. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from journeyflow.llm.storage import materialize

SIZE = 1024
END = 2
ROUNDS = 300
PASSES = 4  # how often the linear program is solved for what rounding left
LARGE = 0.1  # how much dearer long pieces are at first, being harder to place
RATE = 20.0  # how fast a length's weight falls as it gets covered
BUCKETS = 64  # hash buckets that number the pieces of a length

_encoder = None


class Encoder:
    """Token ids of texts as the `tokenizers` file at ``path`` gives them without special tokens.

    The rank-merging library encodes the same vocabulary about five times faster with the same
    ids, so it takes the texts for which that is certain: those within the Latin blocks that do
    not spell a special token. All others go to `tokenizers` itself.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.path, self.exact = path, Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        byte_of = _byte_letters()
        ranks = {bytes(byte_of[x] for x in k): v for k, v in model["model"]["vocab"].items() if k not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = regex.compile(r"[\t\n\r -ɏ‐-‧€]*")
        self.special = tuple(special)

    def ids(self, text: str) -> np.ndarray:
        if self.plain.fullmatch(text) and not any(s in text for s in self.special):
            return np.frombuffer(self.fast.encode_to_numpy(text), np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def _byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable bytes stand for
    themselves, the others are numbered from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def encoder(path: str) -> Encoder:
    """The encoder of a file, made once in a Python worker."""
    global _encoder
    if _encoder is None or _encoder.path != path:
        _encoder = Encoder(path)
    return _encoder


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, row, piece, start, length, ids_crc32) and, with ``keep_ids``, ids: the cut documents.

    ``row`` parts rows with equal doc_id: a number per task and row.
    """
    more = ", ids array<int>" if keep_ids else ""

    def run(batches):
        from pyspark import TaskContext

        tokens, row = encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(tokens.ids(text or ""), np.uint32(end)).astype("<u4")
                cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    x = ids[a:b]
                    out.append((doc_id, row, k, a, b - a, zlib.crc32(x.tobytes()), *([x] if keep_ids else [])))
                row += 1
            columns = list(zip(*out, strict=True)) or [()] * (6 + keep_ids)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=False)], names=names[: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + more)


def best_configuration(value: np.ndarray, most: np.ndarray, size: int) -> np.ndarray:
    """Counts per length of the configuration of most value (knapsack dynamic program over space).

    ``value`` per piece of length 1..size (index 0 unused); a length is used at most ``most`` times.
    """
    # best[size - w] is the value of space w, so the rest beside each length is one slice in order
    best, last = np.zeros(size + 1), [0] * (size + 1)
    value = np.where(value > 0, value, -np.inf)
    total, top = np.empty(size), 0.0
    for w in range(1, size + 1):
        got = np.add(best[size - w + 1:], value[1:w + 1], out=total[:w])
        k = int(got.argmax())
        if got[k] >= top:
            top, last[w] = got[k], k + 1
        best[size - w] = top
    counts, w = np.zeros(size + 1, np.int64), size
    while w > 0:
        if last[w]:
            counts[last[w]] += 1
            w -= last[w]
        else:
            w -= 1
    return np.minimum(counts, most)


def solve(histogram: np.ndarray, size: int = SIZE, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, a nearly optimal cover of the histogram.

    Multiplicative weights: a length's weight starts as its share of all tokens, which makes the
    first prices those of the volume bound, and falls exponentially with how far it is covered;
    each round adds some of the best configuration at the present prices.
    """
    n = histogram.astype(float)
    some = n > 0
    if not some.any():
        return []
    lengths = np.arange(size + 1.0)
    per_round = (n * lengths).sum() / size / rounds
    used: dict[bytes, list] = {}
    covered = np.zeros(size + 1)
    done = 0.0
    while done < rounds:
        share = np.divide(covered, n, out=np.full(size + 1, np.inf), where=some)
        price = np.where(some, lengths * (1 + LARGE * lengths / size) * np.exp(np.clip(-rate * (share - done / rounds), -30, 30)), 0.0)
        counts = best_configuration(price, histogram, size)
        fill = np.flatnonzero(counts)
        amount = min(per_round, (n[fill] / counts[fill]).min())
        done += max(amount / per_round, 0.25)
        covered += amount * counts
        used.setdefault(counts.tobytes(), [counts, 0.0])[1] += amount
    return [(c, x) for c, x in used.values()]


def plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[np.ndarray, int]]:
    """Runs (counts per length, sequences): an integral packing of exactly the histogram."""
    left, runs, lengths = histogram.astype(np.int64).copy(), [], np.arange(size + 1)
    left[size] = 0
    if histogram[size]:
        full = np.zeros(size + 1, np.int64)
        full[size] = 1
        runs.append((full, int(histogram[size])))
    for _ in range(PASSES):
        before = len(runs)
        for counts, x in sorted(solve(left, size), key=lambda t: (-int(t[0] @ lengths), -t[1])):
            fill = np.flatnonzero(counts)
            times = int(min(x, (left[fill] // counts[fill]).min()))
            if times:
                runs.append((counts, times))
                left -= times * counts
        if len(runs) == before:
            break  # a further pass would find the same
    # the rest by best fit, longest first: bins with equal room are one entry
    rooms: dict[int, list] = {}  # room -> [[counts, bins], ...]
    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            fit = [r for r in rooms if r >= length]
            if fit:
                room = min(fit)
                counts, bins = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            else:
                room, counts, bins = size, np.zeros(size + 1, np.int64), -(-n // (size // length))
            each = min(room // length, max(1, n // bins))
            take = min(bins, n // each)
            if take < bins:
                rooms.setdefault(room, []).append([counts, bins - take])
                if room == size and not counts.any():
                    rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
            more = counts.copy()
            more[length] += each
            n -= take * each
            rooms.setdefault(room - each * length, []).append([more, take])
    runs += [(c, b) for entries in rooms.values() for c, b in entries]
    return runs


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """``cut`` (doc_id, row, piece, length and any more columns) with sequence_id and offset.

    ``cut`` must be a stored table: it is read for the histogram and again for the numbers.
    """
    spark = cut.sparkSession
    histogram = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most `size` rows
        histogram[r["length"]] = r["count"]
    slots, at, done = [], 0, np.zeros(size + 1, np.int64)
    for counts, times in plan(histogram, size):
        offset = 0
        for length in np.flatnonzero(counts).tolist():
            # pieces done..done + counts*times of this length; one sequence takes `counts` in a row
            slots.append((length, int(done[length]), int(done[length] + counts[length] * times), int(counts[length]), at, offset))
            done[length] += counts[length] * times
            offset += length * int(counts[length])
        at += times
    runs = spark.createDataFrame(slots, "length bigint, first bigint, until bigint, each bigint, base bigint, place bigint")
    bucket = F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(BUCKETS))
    numbered = cut.withColumn("bucket", bucket).withColumn("k", F.row_number().over(
        Window.partitionBy("length", "bucket").orderBy("doc_id", "row", "piece")) - 1)
    before = cut.groupBy("length", bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.col("k") + F.col("before")
    ranked = numbered.join(F.broadcast(before), ["length", "bucket"]).withColumn("rank", rank)  # size x BUCKETS rows at most
    # runs of a length as one array, found by position: (lengths x runs) is bounded by the plan
    lists = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "until", "each", "base", "place"))).alias("runs"))
    one = F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["until"])), 1)
    out = ranked.join(F.broadcast(lists), "length").withColumn("run", one)
    step = F.col("rank") - F.col("run.first")
    return out.withColumn("sequence_id", F.col("run.base") + F.floor(step / F.col("run.each"))).withColumn(
        "offset", F.col("run.place") + (step % F.col("run.each")) * F.col("length")).drop("bucket", "k", "before", "rank", "runs", "run")


def packing_digest(docs: DataFrame, path: str) -> DataFrame:
    """Per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(pieces(docs, path), "pieces")
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
