"""A Merkle manifest of a table: a digest per row, a hash tree per group, a tree over the groups.

Rows are the leaves. In each group they stand in order of their key; every two consecutive nodes
become the hash of their digests' hex text (a last one alone becomes its own hash) until one node,
the subroot, is left. The subroots, in order of their group, become the root in the same way.

Trees are cut into subtrees of ``height`` levels over aligned leaves, so one group may hold any
share of the rows. A round hashes every subtree of one layer: the sorted shuffle is the external
queue that brings a subtree's nodes in label order, and inside it time-forward processing sends
each digest to its parent through a priority queue ordered by label, then a reversed sweep sends
proof suffixes from the subtree's top to its leaves. The tops are the next round's leaves, of
which there are 2^height times fewer. Back down, each layer appends its tops' proofs by a join.

Nulls: a null value hashes as ``-``; null groups form one group, the first; null keys come first.
Rows with equal keys stand in order of their digests; equal rows each get a proof of their own
place. An empty table gives an empty manifest. Other columns play no part and their names do not
matter. Texts of any length are hashed whole, by the scan that reads them.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from journeyflow.llm.storage import materialize

HEIGHT = 10  # levels of a subtree: a task holds 2^HEIGHT nodes at once
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = ["tree", "pos", "total", "digest", "payload"]


def combine(digests: list[bytes]) -> bytes:
    """The digest of a run of nodes: the hash of their digests as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def subtree(leaves: list[bytes], levels: int) -> tuple[bytes, list[list[bytes]]]:
    """The digest over ``leaves`` after so many levels, and each leaf's proof up to there.

    A proof has one entry per level, from below: L or R (where the sibling stands) and the
    sibling's digest, or nothing where the node was alone.
    """
    # upwards: messages (level, place, side, digest) come out of the queue in order of labels
    queue = [(0, i, 0, d) for i, d in enumerate(leaves)]
    digest: dict[tuple[int, int], bytes] = {}
    while queue:
        level, place = queue[0][:2]
        got = []
        while queue and queue[0][:2] == (level, place):
            got.append(heapq.heappop(queue)[3])
        digest[level, place] = combine(got) if level else got[0]
        if level < levels:
            heapq.heappush(queue, (level + 1, place >> 1, place & 1, digest[level, place]))
    # downwards, in reversed order of labels: each node hands its own proof, its suffix, to its children
    proofs: list[list[bytes]] = [[] for _ in leaves]
    back = [(-levels, 0, [])]
    while back:
        level, place, suffix = heapq.heappop(back)
        if level == 0:
            proofs[-place] = suffix
            continue
        for child in (-2 * place, -2 * place + 1):
            if (-level - 1, child) in digest:
                sibling = digest.get((-level - 1, child ^ 1))
                side = b"L" if child & 1 else b"R"
                heapq.heappush(back, (level + 1, -child, [side + sibling if sibling else b"", *suffix]))
    return digest[levels, 0], proofs


def _sweep(height: int):
    """Arrow function over nodes sorted by (tree, pos): adds each node's proof inside its subtree and the subtree's top."""

    def run(batches):
        held: list[tuple] = []
        types = None

        def close():
            top, proofs = subtree([r[3] for r in held], min(height, (held[0][2] - 1).bit_length()))
            columns = [pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(proofs, pa.list_(pa.binary())), pa.array([top] * len(held), pa.binary())], names=[*_NODE, "path", "top"])

        for batch in batches:
            types = batch.schema.types
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][0], held[0][1] >> height) != (row[0], row[1] >> height):
                    yield close()
                    held = []
                held.append(row)
        if held:
            yield close()

    return run


def place(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with pos, the place in its tree by ``order`` from 0, and total, the tree's rows.

    Ranges of (tree, order) are dealt out and sorted; a place is the one in its range and the
    number of the tree's rows in the ranges before. Equal rows are dealt to several ranges.
    """
    keys = [F.col(tree), *[F.col(c) for c in order], F.col("_salt")]
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    dealt = materialize(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    runs = dealt.groupBy(tree, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(tree)  # a tree has as many runs as ranges at most
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col(tree).alias("_tree"), F.col("_range").alias("_run"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total"))
    on = F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_range") == F.col("_run"))
    return dealt.join(runs, on).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_tree", "_run", "_shift", "_range", "_at")


def climb(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The layers of all trees, each node with its proof inside its subtree, and (tree, digest) of the tops.

    ``nodes`` has (tree, pos, total, digest, payload). Each layer is a written table; the number
    of layers follows from the largest tree.
    """
    layers = []
    size = 1 << height
    schema = nodes.select(*_NODE).schema
    out = T.StructType([T.StructField(f.name, f.dataType) for f in schema] + [T.StructField("path", T.ArrayType(T.BinaryType())), T.StructField("top", T.BinaryType())])
    most = nodes.agg(F.max("total")).first()[0] or 1
    while True:
        dealt = nodes.select(*_NODE, F.shiftright("pos", height).alias("_sub")).repartition("tree", "_sub").sortWithinPartitions("tree", "pos")
        layers.append(materialize(dealt.select(*_NODE).mapInArrow(_sweep(height), out), "layer"))
        nodes = layers[-1].where(F.col("pos").bitwiseAND(size - 1) == 0).select(
            "tree", F.shiftright("pos", height).alias("pos"), F.shiftright(F.col("total") + (size - 1), height).alias("total"),
            F.col("top").alias("digest"), F.lit(None).cast(schema["payload"].dataType).alias("payload"))
        if most <= size:
            return layers, nodes.select("tree", "digest")
        most = (most + size - 1) >> height


def descend(layers: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The nodes of the lowest layer with whole proofs.

    ``above`` has (tree, rest, ...): the proof over each tree's top, and values that all its
    leaves get. The result has (tree, pos, digest, payload, rest, ...).
    """
    given = [c for c in above.columns if c not in ("tree", "rest")]
    above = above.select(F.col("tree").alias("_tree"), "rest", *given, F.lit(0).cast("long").alias("_over"))
    for layer in reversed(layers):
        on = F.col("tree").eqNullSafe(F.col("_tree")) & (F.shiftright("pos", height) == F.col("_over"))
        nodes = layer.join(above, on).select("tree", "pos", "digest", "payload", F.concat("path", "rest").alias("rest"), *given)
        above = nodes.select(F.col("tree").alias("_tree"), "rest", *given, F.col("pos").alias("_over"))
    return nodes


def leaf_of(*values: Column) -> Column:
    """Binary digest of a row's values: each one's UTF-8 byte count, a colon and the value, ``-`` if null."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in texts]), 256))


def manifest(docs: DataFrame, leaf: Column | None = None, carried: Column | None = None, key: str = "doc_id", group: str = "lang", height: int = HEIGHT) -> DataFrame:
    """Rows (key, leaf, subroot, root, proof, carried) with binary digests, one per row of ``docs``.

    ``leaf`` is a row's digest (by default of the contract's columns), ``carried`` any value to
    hand through. proof has one entry per level as `subtree` writes it, from the leaf to its
    subroot and on to the root.
    """
    leaf = leaf_of(*[F.col(c) for c in COLUMNS]) if leaf is None else leaf
    carried = F.lit(None).cast("binary") if carried is None else carried
    rows = materialize(docs.select(F.col(group).alias("tree"), F.col(key).alias("_key"), leaf.alias("digest"), carried.alias("_carried")), "leaves")
    rows = place(rows, "tree", ["_key", "digest"]).withColumn("payload", F.struct(F.col("_key").alias("key"), F.col("_carried").alias("carried")))
    layers, tops = climb(rows, height)
    groups = place(tops.select(F.lit(0).alias("all"), F.col("tree").alias("name"), "digest"), "all", ["name"])
    groups = groups.select(F.col("all").alias("tree"), "pos", "total", "digest", F.col("name").alias("payload"))
    top_layers, root = climb(groups, height)
    above = descend(top_layers, root.select("tree", F.array().cast("array<binary>").alias("rest"), F.col("digest").alias("root")), height)
    above = above.select(F.col("payload").alias("tree"), "rest", F.col("digest").alias("subroot"), "root")
    return descend(layers, above, height).select(F.col("payload.key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", F.col("rest").alias("proof"),
                                                 F.col("payload.carried").alias("carried"))


def text_of(digest: Column) -> Column:
    """A binary digest as lowercase hex."""
    return F.lower(F.hex(digest))


def fold(leaf: Column, proof: Column) -> Column:
    """Hex root that a leaf (binary) and a proof lead to."""

    def step(got: Column, entry: Column) -> Column:
        other = text_of(F.substring(entry, 2, 32))
        left = F.substring(entry, 1, 1) == F.lit("L").cast("binary")
        return F.sha2(F.when(F.octet_length(entry) == 0, got).when(left, F.concat(other, got)).otherwise(F.concat(got, other)), 256)

    return F.aggregate(proof, text_of(leaf), step)


def manifest_digest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The contract's columns. Rows whose key's crc32 seven divides are verified with n_chars + 1, all others as they are."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(21,0)")
    changed = F.when(tampered & F.col("n_chars").isNotNull(), leaf_of(*[more if c == "n_chars" else F.col(c) for c in COLUMNS]))
    made = manifest(docs, carried=changed, height=height)
    siblings = F.concat_ws("", F.transform("proof", lambda e: text_of(F.substring(e, 2, 32))))
    root = text_of(F.col("root"))
    out = made.select("doc_id", text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), root.alias("root"),
                      F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("carried", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
