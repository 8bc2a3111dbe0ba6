"""Exact top-k by inner product over whole-number vectors, with a table of distances to pivots.

Every component x becomes floor(256 * x), x as double. Pivots are rows far from each other, chosen
on a bounded sample (SAMPLE rows by hash); the choice steers the work and never the result. The
pivot table holds each row's distance to every pivot, written once in blocks of BLOCK rows that
lie near each other. By the triangle inequality the distance of a query and a candidate is at
least the largest difference of their distances to a pivot, which bounds the inner product from
above: (|q|^2 + |c|^2 - distance^2) / 2. A query takes the candidates of a block in order of their
bounds and stops at the first bound below its k-th best score so far; a block whose rows' extremes
already bound it away is skipped. The pivots' own scores give each query its first threshold.
Bounds allow for the rounding of the stored distances, scores are exact.

Work is dealt out as (block of queries, stream of blocks): a block of queries holds QUERY_BLOCK
rows, its candidates come in STREAMS streams, each carries its k best along, and the streams'
lists are merged. So no task holds more than a block of queries and a batch of blocks.

Rows: null vectors and vectors with a null or non-finite component (before or after scaling) take
no part; an empty vector scores 0 with all. Vectors of unequal lengths are compared as if the
shorter one ended in zeros. A null id is a candidate, never a query, and comes last among ties. Rows that repeat an id are rows of their own: each is a query, and a candidate of
the others. Scores beyond a long are set to the nearest long. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from journeyflow.llm.storage import materialize

SCALE = 256
PIVOTS = 32
SAMPLE = 2048  # rows among which pivots are chosen; their vectors come to the driver
BLOCK = 2048  # rows in a block of the pivot table
BUFFER = 16  # blocks that a task sorts by nearness at once
QUERY_BLOCK = 4096
STREAMS = 16  # parts of the candidates that one block of queries meets at a time
STEP = 256  # candidates scored at once
SLICE = 128  # queries bounded at once
LARGE = float(1 << 23)  # rows with larger components are scored without bounds
_LONG = (1 << 63) - 1
_SLACK = 3e-7  # relative, of distances kept as 32-bit floats

_BLOCKS = "block long, n int, n_queries int, ids binary, null_ids binary, queries binary, vectors binary, distances binary"
_PACK = "qb long, n int, rows binary, ids binary, vectors binary, distances binary"


def scaled(embedding: Column) -> Column:
    """The vector as doubles of whole numbers, null where the row takes no part."""
    numbers = F.transform(embedding, lambda x: x.cast("double") * SCALE)
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(embedding.isNotNull() & fine, numbers)


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of whole doubles, zeros behind shorter vectors."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    flat = np.floor(column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()])
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Rows of ``sample`` that lie far from each other: the longest, then always the one farthest from those chosen."""
    if not len(sample):
        return sample
    chosen, near = [int(np.argmax((sample ** 2).sum(1)))], np.full(len(sample), np.inf)
    while len(chosen) < most:
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if near.max() == 0:
            break
        chosen.append(int(np.argmax(near)))
    return sample[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every row to every pivot; rows with large components get zeros, as they are never bounded."""
    squares = (vectors ** 2).sum(1)[:, None] - 2 * vectors @ pivots.T + (pivots ** 2).sum(1)
    squares[np.abs(vectors).max(1, initial=0) > LARGE] = 0
    return np.sqrt(np.maximum(squares, 0)).astype(np.float32)


def _table(pivots: np.ndarray, width: int):
    """Arrow function: rows (id, query, numbers) to blocks of the pivot table."""

    def pack(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, null, query, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
        with np.errstate(all="ignore"):
            far = distances(vectors, pivots)
        near = far.argmin(1)
        order = np.lexsort((far[np.arange(len(far)), near], near))
        for at in range(0, len(order), BLOCK):
            some = order[at:at + BLOCK]
            small = not len(some) or np.abs(vectors[some]).max(initial=0) < 1 << 31
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(some)], pa.int32()), pa.array([int(query[some].sum())], pa.int32()),
                 *[pa.array([x[some].tobytes()], pa.binary()) for x in (ids, null, query, vectors.astype(np.int32) if small else vectors, far)]],
                names=["n", "n_queries", "ids", "null_ids", "queries", "vectors", "distances"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = part.column(0)
                held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
                             part.column(1).to_numpy(zero_copy_only=False), _matrix(part.column(2), width)))
                n += part.num_rows
                if n >= BLOCK * BUFFER:
                    yield from pack(held)
                    held, n = [], 0
        if held:
            yield from pack(held)

    return run


class Rows:
    """Some rows of the table as arrays, with what bounds and scores need."""

    def __init__(self, n: int, ids: bytes, null: bytes | None, vectors: bytes, far: bytes, width: int):
        self.n, self.ids = n, np.frombuffer(ids, np.int64)
        self.null = np.zeros(n, bool) if null is None else np.frombuffer(null, bool)
        wide = width and len(vectors) == 8 * n * width
        self.vectors = np.frombuffer(vectors, np.float64 if wide else np.int32).reshape(n, width).astype(np.float64)
        self.far = np.frombuffer(far, np.float32).reshape(n, -1)
        self.most = np.abs(self.vectors).max(1, initial=0)
        with np.errstate(all="ignore"):
            self.square = np.where(self.most > LARGE, np.inf, (self.vectors ** 2).sum(1))


def scores(vectors: np.ndarray, query: np.ndarray, most: float) -> list[int] | np.ndarray:
    """Exact inner products of whole-number rows; ``most`` bounds a component of the rows."""
    if most * np.abs(query).max(initial=0) * max(len(query), 1) < 1 << 53:
        return (vectors @ query).astype(np.int64)
    whole = [int(x) for x in query]
    exact = [sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in vectors]
    return np.array([max(-_LONG, min(_LONG, x)) for x in exact], np.int64)


def bounds(queries: Rows, some: slice, block: Rows) -> np.ndarray:
    """Upper bounds of the inner products of some queries with all rows of a block."""
    q = queries.far[some]
    least = np.zeros((len(q), block.n), np.float32)
    for p in range(q.shape[1]):
        np.maximum(least, np.abs(q[:, p, None] - block.far[None, :, p]), out=least)
    rounding = _SLACK * (q.max(1, initial=0)[:, None] + block.far.max(1, initial=0)[None, :])
    least = np.maximum(least.astype(np.float64) - rounding, 0)
    total = queries.square[some, None] + block.square[None, :]
    return (total - least ** 2) / 2 * (1 + 1e-12) + 1


class Search:
    """The k best candidates of a block of queries, over a stream of blocks."""

    def __init__(self, queries: Rows, rows: np.ndarray, pivots: np.ndarray, k: int):
        self.queries, self.rows, self.k = queries, rows, k
        self.best: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * queries.n  # score, id is null, id
        self.least = np.full(queries.n, -np.inf)
        self.evaluated = 0
        if len(pivots) > k:
            with np.errstate(all="ignore"):
                own = queries.far <= 0  # a pivot's own row is no candidate of its own
                first = np.where(own | ~np.isfinite(queries.square)[:, None], -np.inf, queries.vectors @ pivots.T)
            self.least = np.sort(first, 1)[:, -k]

    def meet(self, first: int, block: Rows) -> None:
        """Take in a block whose rows are numbered from ``first``."""
        q = self.queries
        low, high = block.far.min(0, initial=np.inf), block.far.max(0, initial=0)
        apart = np.maximum(np.maximum(low - q.far, q.far - high), 0).max(1, initial=0).astype(np.float64)
        apart = np.maximum(apart - _SLACK * (q.far.max(1, initial=0) + high.max(initial=0)), 0)
        with np.errstate(all="ignore"):
            top = (q.square + block.square.max(initial=0) - apart ** 2) / 2 * (1 + 1e-12) + 1
        for at in range(0, q.n, SLICE):
            if not (top[at:at + SLICE] >= self.least[at:at + SLICE]).any():
                continue
            with np.errstate(all="ignore"):
                upper = bounds(q, slice(at, at + SLICE), block)
            for i in range(at, min(at + SLICE, q.n)):
                self._scan(i, upper[i - at], first, block)

    def _scan(self, i: int, upper: np.ndarray, first: int, block: Rows) -> None:
        left = np.flatnonzero(upper >= self.least[i])
        left = left[left + first != self.rows[i]]
        left = left[np.argsort(-upper[left], kind="stable")]
        for at in range(0, len(left), STEP):
            some = left[at:at + STEP]
            if upper[some[0]] < self.least[i]:
                break
            got = scores(block.vectors[some], self.queries.vectors[i], block.most[some].max())
            self.evaluated += len(some)
            good = got >= self.least[i]
            new = got[good], block.null[some][good], block.ids[some][good]
            score, null, id_ = (np.concatenate(x) for x in zip(self.best[i], new, strict=True))
            order = np.lexsort((id_, null, -score))[:self.k]
            self.best[i] = score[order], null[order], id_[order]
            if len(order) == self.k:
                self.least[i] = max(self.least[i], float(score[order[-1]]))


def pivot_table(rows: DataFrame, id_col: str, vector: str, is_query: Column) -> tuple[DataFrame, np.ndarray, int]:
    """The written pivot table, the pivots and the width of the vectors."""
    numbers = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), scaled(F.col(vector)).alias("v")).where("v is not null")
    width = numbers.agg(F.max(F.size("v"))).first()[0] or 0
    calm = numbers.where(F.forall("v", lambda x: F.abs(x) < LARGE)).select("id", "v").withColumn("h", F.xxhash64("id", "v"))
    sample = [r["v"] for r in calm.orderBy("h", "id").limit(SAMPLE).collect()]
    held = np.zeros((len(sample), width))
    for i, v in enumerate(sample):
        held[i, :len(v)] = np.floor(v)
    pivots = choose_pivots(held)
    if not len(pivots):
        pivots = np.zeros((1, width))  # any point bounds; without rows nothing is bounded
    schema = _BLOCKS.split(", ", 1)[1]
    blocks = numbers.mapInArrow(_table(pivots, width), schema).withColumn("block", F.monotonically_increasing_id())
    return materialize(blocks, "pivots"), pivots, width


def _packed_queries(table: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The queries in blocks numbered from 0, and how many blocks there are."""
    count = table.agg(F.sum("n_queries")).first()[0] or 0
    parts = max(1, -(-count // QUERY_BLOCK))

    def pick(batches):
        for batch in batches:
            for r in batch.to_pylist():
                some = np.flatnonzero(np.frombuffer(r["queries"], bool))
                size = len(r["vectors"]) // r["n"]
                vectors = np.frombuffer(r["vectors"], np.float64 if size == 8 * width else np.int32).reshape(r["n"], width) if width else np.zeros((r["n"], 0))
                far = np.frombuffer(r["distances"], np.float32).reshape(r["n"], -1)
                ids = np.frombuffer(r["ids"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["block"] * BLOCK + some, pa.int64()), pa.array(ids[some], pa.int64()),
                     pa.array([vectors[i].astype(np.float64).tobytes() for i in some], pa.binary()), pa.array([far[i].tobytes() for i in some], pa.binary())],
                    names=["row", "id", "vector", "distance"])

    def pack(batches):
        held: list[tuple] = []

        def close():
            qb, rows, ids, vectors, far = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([qb[0]], pa.int64()), pa.array([len(rows)], pa.int32()), pa.array([np.array(rows, np.int64).tobytes()], pa.binary()),
                 pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(vectors)], pa.binary()), pa.array([b"".join(far)], pa.binary())],
                names=["qb", "n", "rows", "ids", "vectors", "distances"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != r[0]:
                    yield close()
                    held = []
                held.append(r)
        if held:
            yield close()

    picked = table.where("n_queries > 0").mapInArrow(pick, "row long, id long, vector binary, distance binary")
    dealt = picked.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(parts)))
    dealt = dealt.select("qb", "row", "id", "vector", "distance").repartition("qb").sortWithinPartitions("qb", "row")
    return materialize(dealt.mapInArrow(pack, _PACK), "queries"), parts


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best candidates of every query, ties to the smaller id.

    Candidates are all rows that take part but the query's own; all are returned if there are
    fewer than k.
    """
    table, pivots, width = pivot_table(rows, id_col, vector, is_query)
    queries, parts = _packed_queries(table, width)
    blank = F.lit(None).cast("binary")
    asks = queries.select("qb", F.explode(_upto(STREAMS)).alias("stream"), F.lit(-1).cast("long").alias("block"),
                          "n", F.col("rows").alias("row_numbers"), "ids", blank.alias("null_ids"), "vectors", "distances")
    meets = table.select(F.explode(_upto(parts)).alias("qb"), F.pmod(F.xxhash64("block"), F.lit(STREAMS)).alias("stream"), "block",
                         "n", blank.alias("row_numbers"), "ids", "null_ids", "vectors", "distances")

    def run(batches):
        search, at = None, None

        def close():
            n = search.queries.n
            lists = [[{"s": -int(s), "x": bool(x), "id": None if x else int(j)} for s, x, j in zip(*b, strict=True)] for b in search.best]
            return pa.RecordBatch.from_arrays(
                [pa.array(search.rows, pa.int64()), pa.array(search.queries.ids, pa.int64()),
                 pa.array(lists, pa.list_(pa.struct([("s", pa.int64()), ("x", pa.bool_()), ("id", pa.int64())])))] if n else [],
                names=["row", "query_id", "best"])

        for batch in batches:
            for one in range(batch.num_rows):
                r = batch.slice(one, 1).to_pylist()[0]
                if (r["qb"], r["stream"]) != at:
                    if search:
                        yield close()
                    search, at = None, (r["qb"], r["stream"])
                if r["block"] < 0:
                    search = Search(Rows(r["n"], r["ids"], None, r["vectors"], r["distances"], width), np.frombuffer(r["row_numbers"], np.int64), pivots, k)
                elif search:  # an empty block of queries has no row of its own
                    search.meet(r["block"] * BLOCK, Rows(r["n"], r["ids"], r["null_ids"], r["vectors"], r["distances"], width))
        if search:
            yield close()

    dealt = asks.unionByName(meets).repartition("qb", "stream").sortWithinPartitions("qb", "stream", "block")
    found = dealt.mapInArrow(run, "row long, query_id long, best array<struct<s: long, x: boolean, id: long>>")
    merged = found.groupBy("row", "query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    ranked = merged.select("query_id", F.posexplode("best").alias("at", "one"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.id").alias("vec_id"), (-F.col("one.s")).alias("score"))


def topk_digest(rows: DataFrame) -> DataFrame:
    """The contract's search: rows whose vec_id 50 divides, against all, five best each."""
    return top_k(rows, F.col("vec_id") % 50 == 0)
