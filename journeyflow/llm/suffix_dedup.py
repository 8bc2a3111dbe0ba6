"""Removal of repeated 100-byte strings by a column-wise suffix construction over many documents.

Candidates. Of every 100-byte string the 32-byte gram with the least hash is its anchor, so equal
strings have equal anchors at the same place, and about every 35th byte is one. Anchors whose gram
stands once in the corpus cannot lie in a repeated string; the others, with all bytes that a
string around them can hold, make a collection of 168-byte contexts, dealt out by gram.

Construction. A task sorts each collection column by column from the right: each round inserts
one symbol per context, brings the suffix order and the common prefixes of neighbours up to date
and appends the round's Burrows-Wheeler column. Columns, order and prefixes are sequential files
in the task's scratch folder, read and written once a round; a collection holds whole anchor
groups. As equal strings stand at the same column, suffixes of different lengths need no merging:
the transform is kept as one column per round. Neighbours with a common prefix of 100 or more are
equal strings, and all but the first of them in (doc_id, start) order repeat.

Copies of whole texts are found by their digest first; of those, only the first takes part.

A null text is empty; texts under 100 bytes never change. Rows with equal doc_id are ordered by a
hash of their text, equal rows count as one document, and null doc_ids come last. Strings are
judged on the input. Columns other than doc_id and text are not read by `repeated_spans`.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from journeyflow.llm.storage import materialize
from journeyflow.llm.texts import chunks, mix

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM  # bytes of a string on either side of its anchor, at most
WIDTH = 2 * REACH + GRAM
HELD = 500_000  # contexts whose first place a task remembers
COLLECTION = 100_000  # contexts sorted together, more only for one anchor group
LAST = 2 ** 63 - 1


def anchors_of(c) -> tuple[np.ndarray, np.ndarray]:
    """Byte places of a chunk's anchors, and the hash of the gram at each."""
    gram = c.bytes.windows(GRAM)
    if len(c.data) < LENGTH:
        return np.zeros(0, np.int64), gram[:0]
    low = ((gram >> np.uint64(32)) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64)
    span, width = low, 1
    while 2 * width <= REACH + 1:
        span = np.minimum(span[:-width], span[width:])
        width *= 2
    rest = REACH + 1 - width
    least = np.minimum(span[: len(span) - rest], span[rest:]) if rest else span
    inside = np.zeros(len(least) + 1, np.int64)  # strings that do not cross into the next text
    long = c.ends - c.starts >= LENGTH
    np.add.at(inside, c.starts[long], 1)
    np.add.at(inside, c.ends[long] - LENGTH + 1, -1)
    at = (least[np.cumsum(inside)[:-1] > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    return at, gram[at]


def _anchors(docs: DataFrame) -> DataFrame:
    """Rows (gram, tid, at): the anchors of every text, which its hash stands for."""

    def run(batches):
        for batch, c in chunks(batches):
            at, gram = anchors_of(c)
            of = np.searchsorted(c.starts, at, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), batch.column(0).take(pa.array(of)), pa.array((at - c.starts[of]).astype(np.int32))],
                                             names=["gram", "tid", "at"])

    return docs.select("tid", "text").mapInArrow(run, "gram bigint, tid bigint, at int")


def _contexts(docs: DataFrame) -> DataFrame:
    """Rows (gram, did, tid, at, lo, hi, context) for docs with ``ats``, the places of their anchors.

    The context is the text from REACH bytes before the anchor's place to REACH bytes behind its
    gram; lo and hi bound what of it lies in the text, the rest is zero. All strings of a context
    that equals one of an earlier place repeat: where a task knows such a place, the row goes
    without its bytes (a null context), so a common passage is sent once per task.
    """

    def run(batches):
        first: dict[tuple, tuple] = {}
        for batch, c in chunks(batches):
            lists = batch.column(3)
            n = np.asarray(lists.value_lengths())
            at = np.asarray(lists.flatten()).astype(np.int64)
            of = np.repeat(np.arange(c.n), n)
            good = (at >= 0) & (at + GRAM <= (c.ends - c.starts)[of])
            at, of = at[good], of[good]
            gram = c.bytes.windows(GRAM)[at + c.starts[of]]
            lo = np.maximum(REACH - at, 0)
            hi = np.minimum(REACH + (c.ends - c.starts)[of] - at, WIDTH)
            padded = np.concatenate((np.zeros(WIDTH, np.uint8), c.data, np.zeros(WIDTH, np.uint8)))
            begin = c.starts[of] + at - REACH
            key = c.bytes.hashes(begin + lo, begin + hi)
            check = gram ^ mix(c.bytes.hashes(c.starts[of] + at, begin + hi))
            ids = zip(*(batch.column(k).take(pa.array(of)).to_pylist() for k in (0, 1)), at.tolist(), strict=True)
            known = np.zeros(len(at), bool)
            for k, (name, place) in enumerate(zip(zip(key.tolist(), check.tolist(), lo.tolist(), hi.tolist(), strict=True), ids, strict=True)):
                known[k] = first.get(name, place) < place
                if not known[k] and (len(first) < HELD or name in first):
                    first[name] = place
            for k in range(0, len(at), 4096):
                part = slice(k, k + 4096)
                column = np.arange(WIDTH)
                x = padded[(at[part] + c.starts[of[part]] + WIDTH - REACH)[:, None] + column]
                x[(column < lo[part, None]) | (column >= hi[part, None])] = 0
                sent = ~known[part]
                ends = np.concatenate(([0], np.cumsum(sent))) * WIDTH
                bits = pa.array(sent).buffers()[1]
                context = pa.Array.from_buffers(pa.binary(), len(x), [bits, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x[sent].tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(sent, gram[part].view(np.int64), mix(gram[part] + at[part].astype(np.uint64)).view(np.int64))), batch.column(0).take(pa.array(of[part])),
                     batch.column(1).take(pa.array(of[part])), pa.array(at[part].astype(np.int32)), pa.array(lo[part].astype(np.int32)),
                     pa.array(hi[part].astype(np.int32)), context],
                    names=["gram", "did", "tid", "at", "lo", "hi", "context"])

    return docs.select("did", "tid", "text", "ats").mapInArrow(run, "gram bigint, did bigint, tid bigint, at int, lo int, hi int, context binary")


def repeated_starts(contexts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each context (row, in text order) and column: whether the LENGTH bytes from there on
    lie in the text and stand in an earlier row at the same column."""
    m, width = contexts.shape
    repeats = np.zeros((m, width - LENGTH + 1), bool)
    with tempfile.TemporaryDirectory() as scratch:
        name = {k: os.path.join(scratch, k) for k in ("columns", "order", "prefix", "bwt")}
        np.ascontiguousarray(contexts.T).tofile(name["columns"])
        np.arange(m, dtype=np.int64).tofile(name["order"])
        np.full(m + 1, 0, np.int32).tofile(name["prefix"])  # empty suffixes: nothing in common
        with open(name["columns"], "rb") as columns, open(name["bwt"], "wb") as bwt:
            for c in range(width - 1, -1, -1):
                order, prefix = np.fromfile(name["order"], np.int64), np.fromfile(name["prefix"], np.int32)
                columns.seek(c * m)
                symbols = np.fromfile(columns, np.uint8, m)[order]
                symbols.tofile(bwt)
                if c == width - 1:  # all suffixes are empty, so they agree wherever they stand
                    prefix[:] = 0
                place = np.argsort(symbols, kind="stable")
                order, symbols = order[place], symbols[place]
                shared = np.zeros(m + 1, np.int32)
                same = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
                if len(same):
                    bounds = np.empty(2 * len(same), np.int64)
                    bounds[::2], bounds[1::2] = place[same - 1] + 1, place[same] + 1
                    shared[same] = 1 + np.minimum.reduceat(prefix, bounds)[::2]
                order.tofile(name["order"])
                shared.tofile(name["prefix"])
                if c <= width - LENGTH:
                    first = np.flatnonzero(shared[:m] < LENGTH)
                    whole = (lo[order] <= c) & (hi[order] >= c + LENGTH)
                    rank = np.where(whole, order, m)
                    earliest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.concatenate((first, [m]))))
                    repeats[order, c] = whole & (order > earliest)
    return repeats


def _spans(contexts: DataFrame) -> DataFrame:
    """Rows (did, tid, begin, end): bytes of repeated strings, from contexts dealt out by gram."""

    def whole(table: pa.Table) -> pa.RecordBatch:
        at, lo, hi = (table[k].to_numpy().astype(np.int64) for k in ("at", "lo", "hi"))
        long = pa.array(hi - lo >= LENGTH)
        out = [table["did"].combine_chunks(), table["tid"].combine_chunks(), pa.array(at - REACH + lo), pa.array(at - REACH + hi)]
        return pa.RecordBatch.from_arrays(out, names=["did", "tid", "begin", "end"]).filter(long)

    def solve(table: pa.Table) -> pa.RecordBatch:
        keys = [table[k].to_numpy() for k in ("did", "tid", "at", "lo", "hi")]
        context = np.frombuffer(b"".join(table["context"].to_pylist()), np.uint8).reshape(-1, WIDTH)
        order = np.lexsort((keys[2], keys[1], keys[0]))
        here = np.stack(keys[:3])[:, order]
        order = order[np.concatenate(([True], (here[:, 1:] != here[:, :-1]).any(0)))]  # equal rows count once
        did, tid, at, lo, hi = (k[order] for k in keys)
        repeats = repeated_starts(context[order], lo, hi)
        edge = np.diff(np.pad(repeats, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        base = at[row].astype(np.int64) - REACH
        return pa.RecordBatch.from_arrays([pa.array(did[row]), pa.array(tid[row]), pa.array(base + begin), pa.array(base + end - 1 + LENGTH)],
                                          names=["did", "tid", "begin", "end"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            sent = batch.column(6).is_valid()
            if sent.false_count:
                yield whole(pa.Table.from_batches([batch.filter(pc.invert(sent))]))
                batch = batch.filter(sent)
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= COLLECTION:
                gram = batch.column(0).to_numpy()
                cut = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0
                if len(held) > 1 and cut == 0 and held[-2].column(0)[-1] == batch.column(0)[-1]:
                    continue  # one group fills this batch from the one before
                done = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                held, rows = [batch.slice(cut)], batch.num_rows - cut
                if done.num_rows:
                    yield solve(done)
        if rows:
            yield solve(pa.Table.from_batches(held))

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "did bigint, tid bigint, begin bigint, end bigint")


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64("text").alias("tid"),
                       F.coalesce("text", F.lit("")).alias("text"), *more)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Rows (did, tid, spans) for every (doc_id, text) with repeats: disjoint byte ranges to remove.

    did is doc_id (the largest long for null), tid the hash of the text.
    """
    keyed = _keyed(docs)
    facts = materialize(keyed.select("did", "tid", F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
                                     F.octet_length("text").cast("long").alias("n")).where(F.col("n") >= LENGTH).distinct(), "facts")
    owners = facts.groupBy("digest").agg(F.min(F.struct("did", "tid")).alias("owner"), F.count("*").alias("c")).where("c > 1")
    copies = materialize(facts.join(owners, "digest").where("struct(did, tid) > owner").select("did", "tid", "n"), "copies")
    unique = keyed.join(copies, ["did", "tid"], "left_anti")
    found = materialize(_anchors(unique), "anchors")
    # stored, so that the join below has two plain exchanges and a hot gram can be split
    often = materialize(found.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"), "often")
    # by text, so that rows without an id have lists of their own; two texts of one hash would only share more places
    places = materialize(found.join(often, "gram").groupBy("tid").agg(F.collect_set("at").alias("ats")), "places")
    contexts = _contexts(unique.join(places, "tid"))
    spans = materialize(_spans(contexts), "spans")
    every = spans.unionByName(copies.select("did", "tid", F.lit(0).cast("long").alias("begin"), F.col("n").alias("end")))
    return every.groupBy("did", "tid").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as maximal disjoint ranges in order."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(order) else end
    first = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1]))) if len(order) else order
    return begin[first], np.concatenate((end[first[1:] - 1], end[-1:])) if len(first) else end


def _with_spans(docs: DataFrame) -> DataFrame:
    spans = repeated_spans(docs).withColumnsRenamed({"did": "s_did", "tid": "s_tid"})
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return docs.join(spans, (did == F.col("s_did")) & (F.xxhash64("text") == F.col("s_tid")), "left").drop("s_did", "s_tid")


def removal_digest(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the bytes left."""

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                b, e = _ranges(spans.as_py())
                kept = np.concatenate(([0], e)), np.concatenate((b, [len(data)]))
                digest = hashlib.sha256()
                for i, j in zip(*(x.tolist() for x in kept), strict=True):
                    digest.update(data[i:j])
                out.append((len(data), int((e - b).sum()), len(b), digest.hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in cols[:3]], pa.array(cols[3], pa.string())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs.select("doc_id", "text")).mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _ranges(spans) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.array([(x["begin"], x["end"]) for x in spans or ()], np.int64).reshape(-1, 2)
    return merged(pairs[:, 0], pairs[:, 1])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeats cut out of each text; a character that a cut would split stays."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            text, spans = names.index("text"), names.index("spans")
            out = []
            for one, cut in zip(batch.column(text), batch.column(spans), strict=True):
                if cut.as_py() is None:
                    out.append(one.as_py())
                    continue
                data, parts, at = one.as_py().encode(), [], 0
                for b, e in zip(*(x.tolist() for x in _ranges(cut.as_py())), strict=True):
                    while b < e and data[b] & 0xC0 == 0x80:
                        b += 1
                    while e > b and e < len(data) and data[e] & 0xC0 == 0x80:
                        e -= 1
                    parts.append(data[at:b])
                    at = e
                out.append(b"".join([*parts, data[at:]]).decode())
            columns = [pa.array(out, batch.column(text).type) if i == text else batch.column(i) for i in range(len(names)) if i != spans]
            yield pa.RecordBatch.from_arrays(columns, names=[k for k in names if k != "spans"])

    docs = docs.drop("spans")
    return _with_spans(docs).mapInArrow(run, T.StructType(docs.schema.fields))
