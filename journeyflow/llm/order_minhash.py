"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles, each labelled with how often it stood there before
(shorter texts with a word are one shingle; white space between words does not count). One sketch
takes the three labelled shingles with the least hashes and keeps them in text order, so it agrees
between two texts with a chance that falls with their edit distance and not only with their
shared shingles. There are 64 sketches; the first 12 are bucket keys, and texts in one bucket are
candidates if enough of all 64 agree.

Candidates are aligned: the most labelled shingles that can be matched in order, within the band
of diagonals that a similarity of 0.8 leaves, over all shingles of the pair. Pairs at 0.8 or more
are links; classes are the connected components, named by their least doc_id.

Copies fold into one text before pairs are sought. Large buckets are cut into blocks, and each
pair of blocks is a row group of its own. A first round sends only a best spanning forest of each
block to alignment, which joins most members of a large group; the second round sends every
candidate pair that is still in different components, so no link between components is lost.

Texts without words (null, empty, white space) are each alone. Repeated rows and repeated or null
doc_ids are fine: rows with equal word sequences share a class; a class without any doc_id is
null. One row of each class is kept: the first by doc_id (nulls last), text hash and, of equal
rows, place. Columns besides doc_id and text are not read by `near_duplicates`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from journeyflow.llm.components import components
from journeyflow.llm.storage import materialize
from journeyflow.llm.texts import Sequence, chunks, mix, ranks_of_equal

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES, KEEP, BANDS = 64, 3, 12
AGREE, AGREE_SHORT, SHORT = 18, 8, 20  # sketches that must agree; for texts of up to SHORT shingles
BLOCK = 512  # texts of a bucket that are compared within one group

_ODD = np.random.default_rng(5).integers(0, 1 << 62, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled_shingles(c) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a chunk's labelled shingles, their count per text, and two hashes of each text's words."""
    start, end, n_words = c.words()
    words = Sequence(c.bytes.hashes(start, end))
    first = np.concatenate(([0], np.cumsum(n_words)))
    size = np.minimum(n_words, SHINGLE)
    n = np.where(n_words > 0, n_words - size + 1, 0)
    text_of = np.repeat(np.arange(c.n), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[:-1][text_of]
    plain = words.hashes(at, at + size[text_of])
    before, _ = ranks_of_equal(plain ^ mix(text_of + 1))
    whole = words.hashes(first[:-1], first[1:])
    other = Sequence(mix(c.bytes.hashes(start, end) ^ np.uint64(0x5851F42D4C957F2D))).hashes(first[:-1], first[1:])
    return mix(plain + before.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), n, whole, other


def sketch_chunk(shingles: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sketches (texts x SKETCHES, 64 bits each): hash of the KEEP least shingles in text order."""
    out = np.zeros((len(n), SKETCHES), np.uint64)
    text_of = np.repeat(np.arange(len(n)), n)
    # only hashes below a limit can be among the least; texts with too few below it are done in full
    limit = np.full(len(n), 2 ** 64 - 1, np.uint64)
    limit[n > 32] = (24.0 / n[n > 32] * 2.0 ** 64).astype(np.uint64)
    per_shingle, begin = limit[text_of], np.cumsum(n) - n
    for k in range(SKETCHES):
        h = shingles * _ODD[k]
        at = np.flatnonzero(h <= per_shingle)
        got = np.bincount(text_of[at], minlength=len(n))
        short = np.flatnonzero(got < np.minimum(n, KEEP))
        if len(short):
            at = np.union1d(at, np.concatenate([np.arange(begin[i], begin[i] + n[i]) for i in short]))
        of = text_of[at]
        order = np.lexsort((h[at], of))
        place = np.arange(len(of)) - np.searchsorted(of, of)
        least = np.sort(at[order[place < KEEP]])
        of = text_of[least]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        total = np.zeros(len(n), np.uint64)
        np.add.at(total, of, mix(shingles[least] + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
        out[:, k] = mix(total)
    return out


def sketch_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (doc_id, tid, key, n, bands, sketch).

    tid: hash of the text; key: 128 bits of its word sequence, null without words; n: shingles;
    bands: the first sketches whole, as bucket keys; sketch: 16 bits of each sketch.
    """

    def run(batches):
        for batch, c in chunks(batches, text):
            shingles, n, whole, other = labelled_shingles(c)
            sketch = sketch_chunk(shingles, n)
            keys = [f"{x:016x}{y:016x}" if k else None for x, y, k in zip(whole.tolist(), other.tolist(), n.tolist(), strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                     for x in (sketch[:, :BANDS].copy().view(np.int64), sketch.astype(np.uint16).view(np.int16))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2] + [pa.array(keys, pa.string()), pa.array(n.astype(np.int64))] + lists,
                                             names=["doc_id", "tid", "key", "n", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), F.col(text).alias(text)).mapInArrow(
        run, "doc_id bigint, tid bigint, key string, n bigint, bands array<bigint>, sketch array<smallint>")


def _forest(weight: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a best spanning forest of the pairs with a positive weight (Prim's way)."""
    edges, best, link = [], np.zeros(len(weight), weight.dtype), np.zeros(len(weight), np.int64)
    for _ in range(len(weight)):
        i = int(np.argmax(best))
        if best[i] > 0:
            edges.append((int(link[i]), i))
        best[i] = -1
        better = (best >= 0) & (weight[i] > best)
        best[better], link[better] = weight[i][better], i
    return edges


def _candidates(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Agreement of all pairs of a block, and whether a pair is a candidate by it and by its sizes."""
    agree = np.zeros((len(s), len(s)), np.int16)
    for k in range(SKETCHES):
        agree += s[:, k, None] == s[None, :, k]
    most = np.maximum.outer(n, n)
    ok = agree >= np.where(most <= SHORT, AGREE_SHORT, AGREE)
    return agree, ok & (np.minimum.outer(n, n) >= SIMILARITY * most - 1e-9)


def _possible(ok: np.ndarray, n: np.ndarray, short: list[np.ndarray]) -> list[tuple[int, int]]:
    """The pairs of ``ok`` that can reach the similarity, by their shingles' 16-bit hashes: no
    more shingles can match than one text has hashes in common with the other."""
    out = []
    seen = np.zeros(1 << 16, bool)
    for i in range(len(n)):
        others = np.flatnonzero(ok[i, i + 1:]) + i + 1
        if len(others):
            seen[short[i]] = True
            common = np.add.reduceat(seen[np.concatenate([short[j] for j in others])].astype(np.int64), np.cumsum(n[others]) - n[others])
            seen[short[i]] = False
            need = SIMILARITY / (1 + SIMILARITY) * (n[i] + n[others]) - 1e-9
            out += [(i, int(j)) for j in others[common >= need]]
    return out


def _block_pairs(members: DataFrame, forest: bool) -> DataFrame:
    """Candidate pairs (a, b) of texts that share a bucket, from each pair of a bucket's blocks.

    ``members`` has band, value, blocks (of the bucket), key, comp, n, sketch, and without
    ``forest`` short. With ``forest`` the spanning forest of each group, else every pair of
    different components that its short shingles do not rule out; a pair that meets in several
    buckets is taken in its first one.
    """
    carried = ["key", "comp", "n", "sketch"] + ([] if forest else ["short"])
    mine = F.pmod(F.xxhash64("key"), F.col("blocks"))
    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    rows = members.select("band", "value", *carried, mine.alias("mine"), other).select(
        "band", "value", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", *carried)

    def run(group: pa.Table) -> pa.Table:
        keys = group["key"].to_pylist()
        pairs: list[tuple[str, str]] = []
        comps = group["comp"].to_pylist()
        if len(set(comps)) > 1:
            lo, hi, band = group["lo"][0].as_py(), group["hi"][0].as_py(), group["band"][0].as_py()
            s = group["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, SKETCHES)
            n, mine = group["n"].to_numpy(), group["mine"].to_numpy()
            _, comp = np.unique(comps, return_inverse=True)
            agree, ok = _candidates(s, n)
            ok &= comp[:, None] != comp
            if lo != hi:
                ok &= mine[:, None] != mine
            if forest:
                found = _forest(np.where(ok, agree, 0))
            else:
                for k in range(band):
                    ok &= s[:, k, None] != s[None, :, k]
                found = _possible(ok, n, [np.frombuffer(x, np.uint16) for x in group["short"].to_pylist()])
            pairs = [(min(keys[i], keys[j]), max(keys[i], keys[j])) for i, j in found]
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.string()), "b": pa.array([x for _, x in pairs], pa.string())})

    return rows.groupBy("band", "value", "lo", "hi").applyInArrow(run, "a string, b string").distinct()


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """How many labelled shingles of two texts can be matched in order inside the band.

    At the least similarity the two sides may leave out so many shingles together; a match
    further off the diagonal than that cannot be part of a good alignment. Labelled shingles are
    unique in a text, so the best alignment is a longest increasing sequence of places.
    """
    need = SIMILARITY / (1 + SIMILARITY) * (len(a) + len(b))
    band = len(a) + len(b) - 2 * need + 1e-9
    order = np.argsort(b)
    at = np.searchsorted(b, a, sorter=order)
    place = order[np.minimum(at, len(b) - 1)]
    hit = (b[place] == a) & (np.abs(place - np.arange(len(a))) <= band)
    place = place[hit]
    if len(place) < need - 1e-9 or np.all(place[1:] > place[:-1]):
        return len(place)
    from bisect import bisect_left

    tails: list[int] = []
    for p in place.tolist():
        k = bisect_left(tails, p)
        tails[k:k + 1] = [p]
    return len(tails)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether matched shingles over all shingles of both reach the similarity."""
    m = aligned(a, b)
    return m >= SIMILARITY * (len(a) + len(b) - m) - 1e-9


def _verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    side = [shingles.select(F.col("key").alias(k), F.col("shingles").alias(f"s_{k}")) for k in ("a", "b")]
    both = pairs.join(side[1], "b").join(side[0], "a").select("a", "b", "s_a", "s_b")

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            good = pa.array([similar(np.frombuffer(a[i].as_py(), np.uint64), np.frombuffer(b[i].as_py(), np.uint64))
                             for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(good)

    return both.mapInArrow(run, "a string, b string")


def _shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (key, shingles, short) for the wanted (doc_id, tid, key): each text's labelled shingles
    as bytes, 64 bits and 16 bits of each hash."""

    def run(batches):
        for batch, c in chunks(batches):
            shingles, n, whole, other = labelled_shingles(c)
            at = np.concatenate(([0], np.cumsum(n)))
            mine = pa.array([f"{x:016x}{y:016x}" for x, y in zip(whole.tolist(), other.tolist(), strict=True)], pa.string())
            sides = [pa.array([x[at[i]:at[i + 1]].tobytes() for i in range(c.n)], pa.binary()) for x in (shingles, shingles.astype(np.uint16))]
            out = pa.RecordBatch.from_arrays([batch.column(0), *sides], names=["key", "shingles", "short"])
            yield out.filter(pc.equal(mine, batch.column(0)))

    tid = F.xxhash64("text").alias("tid")
    wanted = wanted.withColumnsRenamed({"doc_id": "w_id", "tid": "w_tid"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tid, "text")
    on = rows["doc_id"].eqNullSafe(wanted["w_id"]) & (rows["tid"] == wanted["w_tid"])
    return rows.join(wanted, on).select("key", "text").mapInArrow(run, "key string, shingles binary, short binary").dropDuplicates(["key"])


def row_verdicts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, tid, key (see `sketch_texts`), class_id, kept.

    kept holds for exactly one row of a class, and for every row without words.
    """
    rows = materialize(sketch_texts(docs).withColumn("row", F.monotonically_increasing_id()), "sketches")
    texts = materialize(rows.where("key is not null").groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tid", "row")).alias("least"), F.min(F.struct("doc_id", "tid")).alias("one"), F.first("n").alias("n"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "texts")
    spread = texts.select("key", "n", "sketch", F.posexplode("bands").alias("band", "value"))
    large = spread.groupBy("band", "value").agg(F.count("*").alias("c")).where("c > 1").select(
        "band", "value", F.ceil(F.col("c") / BLOCK).cast("long").alias("blocks"))
    members = materialize(spread.join(large, ["band", "value"]), "buckets")
    pairs = materialize(_block_pairs(members.withColumn("comp", F.col("key")), forest=True), "forest")
    ends = members.select("key").distinct()
    shingles = materialize(_shingles_of(docs, texts.select("one.*", "key").join(ends, "key")), "shingles")
    links = materialize(_verified(pairs, shingles), "links")
    first = components(links, "joined")
    rest = members.join(first.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")
    open_ = rest.groupBy("band", "value").agg((F.min("comp") != F.max("comp")).alias("open")).where("open").drop("open")
    rest = rest.join(open_, ["band", "value"]).join(shingles.select("key", "short"), "key")
    more = _block_pairs(rest, forest=False).join(pairs, ["a", "b"], "left_anti")
    more = materialize(_verified(more, shingles), "more")
    classes = components(links.unionByName(more), "classes").withColumnRenamed("node", "key")
    named = texts.select("key", "least").join(classes, "key", "left").withColumn("class", F.coalesce("component", "key"))
    least = named.groupBy("class").agg(F.min("least").alias("head"))
    known = named.select("key", "class").join(least, "class").select("key", F.col("head.doc_id").alias("class_id"), F.col("head.row").alias("head"))
    worded = F.col("key").isNotNull()
    return rows.select("doc_id", "tid", "key", "row").join(known, "key", "left").select(
        "doc_id", "tid", "key", F.when(worded, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(worded, F.col("row") == F.col("head")).otherwise(True).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (least doc_id of its class), kept (it is the class's one row)."""
    return row_verdicts(docs).select("doc_id", "class_id", "kept")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Rows are told apart by doc_id and text. Of equal ones that stand for their class, the one whose
    other columns have the least hash stays.
    """
    id_, tid = F.col("doc_id").cast("long"), F.xxhash64("text")
    verdicts = row_verdicts(docs).where("key is not null").groupBy("doc_id", "tid").agg(
        F.count("*").alias("n"), F.count_if("kept").alias("n_kept")).where("n_kept < n")
    verdicts = materialize(verdicts.select(F.col("doc_id").alias("_v_id"), F.col("tid").alias("_v_tid"), "n_kept"), "dropped")
    on = id_.eqNullSafe(F.col("_v_id")) & (tid == F.col("_v_tid"))
    alone = docs.join(verdicts, on, "left_anti")
    equal = docs.join(verdicts.where("n_kept > 0"), on, "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    place = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0)
    one = equal.groupBy(id_.alias("_id"), tid.alias("_tid")).agg(F.min_by(F.struct(*docs.columns), place).alias("row"))
    return alone.select(*docs.columns).unionByName(one.select("row.*"))
