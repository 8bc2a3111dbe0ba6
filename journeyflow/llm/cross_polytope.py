"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Walsh-Hadamard transform; the hash is the nearest
vertex of the cross-polytope, the coordinate that is largest in size with its sign. A bucket joins
``HASHES`` of them; in each of ``TABLES`` tables a vector goes to its ``PROBES`` best buckets, the
next ones being those that give up least size. Vectors that share a bucket, label and length are
compared by cosine in double precision.

Equal vectors fold into one with a count. Buckets are split into blocks and each pair of blocks is
a group of its own, so no task holds a hot bucket; a group gives back counts and one edge per
vector, never pairs. A pair that meets in several buckets is counted in the first one of its
own; components come from the edges.

Vectors that are null or zero, or hold null or non-finite components, and rows with a null label
link with nothing and are kept. Rows with a null vec_id come back with null component_id and no
links. Repeated vec_ids are one vector each time: rows are answered by (vec_id, label, vector).
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from journeyflow.llm.components import components
from journeyflow.llm.storage import materialize
from journeyflow.llm.texts import mix

COSINE = 0.98
TABLES, HASHES, PROBES = 8, 3, 3
BLOCK = 1024


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of signs and Walsh-Hadamard transform; rows padded to a power of two."""
    size = signs.shape[-1]
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = y * s
        h = 1
        while h < size:
            y = y.reshape(len(x), size // (2 * h), 2, h)
            y = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), 2)
            h *= 2
        y = y.reshape(len(x), size) / np.sqrt(size)
    return y


def bucket_codes(x: np.ndarray, salt: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """Codes (rows x tables x probes) of each row's best buckets; ``salt`` parts labels."""
    size = 1 << max(1, int(np.ceil(np.log2(x.shape[1]))))
    random = np.random.default_rng(size)
    out = np.empty((len(x), tables, probes), np.uint64)
    for t in range(tables):
        best, second, gap = [], [], []
        for _ in range(hashes):
            y = rotate(x, random.choice([-1.0, 1.0], (3, size)))
            a = np.abs(y)
            top = np.argsort(-a, axis=1, kind="stable")[:, :2]
            vertex = top * 2 + (np.take_along_axis(y, top, 1) < 0)
            v = np.take_along_axis(a, top, 1)
            best.append(vertex[:, 0])
            second.append(vertex[:, 1])
            gap.append(v[:, 0] - v[:, 1])
        gap, best, second = np.stack(gap, 1), np.stack(best, 1), np.stack(second, 1)
        # every way to take the second vertex in some of the hashes, by the size it gives up
        ways = (np.arange(2 ** hashes)[:, None] >> np.arange(hashes)) & 1
        order = np.argsort(gap @ ways.T, axis=1, kind="stable")[:, :probes]
        vertex = np.where(ways[order] == 1, second[:, None, :], best[:, None, :])
        code = np.repeat(mix(salt ^ mix(np.array([t + 1])))[:, None], vertex.shape[1], 1)
        for k in range(hashes):
            code = mix(code + vertex[:, :, k].astype(np.uint64))
        out[:, t] = code
    return out


def _hashed(vectors: DataFrame) -> DataFrame:
    """Rows (vec, times, x, codes) of folded vectors (vec, times, label, x)."""

    def run(batches):
        for batch in batches:
            lists, label = batch.column(3), batch.column(2).to_numpy().astype(np.int64)
            dims = np.asarray(lists.value_lengths())
            flat = np.asarray(lists.flatten(), np.float64)
            at = np.concatenate(([0], np.cumsum(dims)))
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                x = flat[(at[rows][:, None] + np.arange(d))]
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                codes = bucket_codes(x, mix(label[rows].view(np.uint64) * np.uint64(1 << 16) + np.uint64(d))).reshape(len(rows), -1)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array([r.tobytes() for r in x], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.view(np.int64).ravel()))],
                    names=["vec", "times", "x", "codes"])

    return vectors.mapInArrow(run, "vec bigint, times bigint, x binary, codes array<bigint>")


def _block_labels(linked: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric link matrix: its least row."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label, len(label)).min(1, initial=len(label))
        now = np.minimum(label, least)
        now = np.minimum(now, now[now])
        if (now == label).all():
            return label
        label = now


def _links(members: DataFrame, cosine: float) -> DataFrame:
    """Rows (vec, links, root) of each pair of blocks: newly counted links, and one edge."""

    def run(group: pa.Table) -> pa.Table:
        vec, times = group["vec"].to_numpy(), group["times"].to_numpy()
        out = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(vec) > 1:
            order = np.argsort(vec, kind="stable")
            vec, times, mine = vec[order], times[order], group["mine"].to_numpy()[order]
            code, crossing = group["code"][0].as_py(), group["lo"][0].as_py() != group["hi"][0].as_py()
            xs = group["x"].to_pylist()
            x = np.stack([np.frombuffer(xs[i], np.float64) for i in order])
            codes = group["codes"].combine_chunks().flatten().to_numpy().reshape(len(vec), -1)[order]
            linked = x @ x.T >= cosine
            np.fill_diagonal(linked, False)
            if crossing:
                linked &= mine[:, None] != mine
            i, j = np.nonzero(np.triu(linked))
            # the first bucket in i's list that j has as well must be this one
            counted = np.zeros(len(i), bool)
            for k in range(0, len(i), 4096):
                a, b = codes[i[k:k + 4096]], codes[j[k:k + 4096]]
                both = (a[:, :, None] == b[:, None, :]).any(2)
                counted[k:k + 4096] = a[np.arange(len(a)), both.argmax(1)] == code
            links = np.bincount(i[counted], times[j[counted]], len(vec)) + np.bincount(j[counted], times[i[counted]], len(vec))
            root = vec[_block_labels(linked)]
            some = linked.any(1)
            out = vec[some], links[some].astype(np.int64), root[some]
        return pa.table({"vec": pa.array(out[0]), "links": pa.array(out[1]), "root": pa.array(out[2])})

    return members.groupBy("code", "lo", "hi").applyInArrow(run, "vec bigint, links bigint, root bigint")


def near_vectors(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row vec_id, n_links, component_id, kept: see the module's text."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("x", lambda v: v != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    folded = rows.where("good").groupBy("label", "x").agg(F.min("vec_id").alias("vec"), F.count_distinct("vec_id").alias("times"))
    folded = materialize(folded, "vectors")
    hashed = materialize(_hashed(folded.select("vec", "times", "label", "x")), "hashed")
    entries = hashed.select("vec", F.explode(F.array_distinct("codes")).alias("code"))
    large = entries.groupBy("code").agg(F.count("*").alias("c")).where("c > 1").select("code", F.ceil(F.col("c") / BLOCK).cast("long").alias("blocks"))
    mine = F.pmod(F.xxhash64("vec"), F.col("blocks"))
    placed = entries.join(large, "code").select("code", "vec", mine.alias("mine"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    members = placed.select("code", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "vec").join(hashed, "vec")
    found = materialize(_links(members, cosine), "found")
    component = components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")), "vectors").withColumnRenamed("node", "vec")
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    known = folded.join(links, "vec", "left").join(component, "vec", "left").select(
        F.col("label").alias("f_label"), F.col("x").alias("f_x"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce("component", "vec").alias("component_id"))
    out = rows.join(known, F.col("good") & (F.col("label") == F.col("f_label")) & (F.col("x") == F.col("f_x")), "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"),
                      component_id.eqNullSafe(F.col("vec_id")).alias("kept"))
