"""SentencePiece encoding to the N best segmentations, and decoding.

A text is escaped as the model file says (a space before it, spaces as U+2581, no other
normalisation) and becomes a lattice of the file's pieces, scored as in the file; a character
without a piece is one edge, scored below every piece and spelt in byte pieces. The best score
from the start to each place (forward Viterbi) is the exact rest cost for a search from the end
(A*): it pops segmentations in order, best first, equal ones by their piece lengths from the end.

The lattice falls apart wherever two neighbouring characters stand side by side in no piece. So
each distinct segment is solved once per worker, and the N best of a text are the N cheapest sets
of changes to its segments: only the N - 1 cheapest single changes can be in them. Equal sums are
ordered by the changed segments' places, later first, then by rank.

The forward pass runs over all new segments of a batch at once and also gives each one's second
best score. A change to a segment costs at least the step to its second best, so only the N - 1
segments of a text with the least steps can change, and the backward search runs on those alone.

A null text gives null ids and no rows; an empty one has the empty segmentation. Fewer than N
segmentations give fewer rows. Decoding skips unknown ids and replaces broken UTF-8. Columns other
than doc_id and text are not read by `encode_nbest`.
"""

from __future__ import annotations

import zlib
from heapq import heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from journeyflow.llm.texts import Sequence, chunks

NBEST = 4
SPACE = "▁"
UNKNOWN = 10.0  # how far below the worst piece a character without a piece scores
HELD = 600_000  # distinct segments that a worker holds before it starts anew
LONG = 64  # characters of a segment up to which it is solved together with others
TOGETHER = 1 << 16  # characters of segments that are solved together
_LOW = 1024


class Vocabulary:
    """Pieces of a model file and the solved segments of a worker."""

    def __init__(self, path: str, nbest: int = NBEST):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.path, self.nbest = path, nbest
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown_id = sp.unk_id()
        self.ids = {p: i for i, p in enumerate(self.pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.spelling = {i: p.replace(SPACE, " ") for p, i in self.ids.items()}
        self.score = {p: float(sp.get_score(i)) for p, i in self.ids.items()}
        self.unknown = min(self.score.values()) - UNKNOWN
        #: score of every piece, None for what only begins a piece
        self.begun: dict[str, float | None] = {p[:k]: None for p in self.ids for k in range(1, len(p))}
        self.begun.update(self.score)
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.low = np.zeros((_LOW, _LOW), bool)
        high = []
        for a, b in pairs:
            a, b = (32 if x == SPACE else ord(x) for x in (a, b))
            if a < _LOW and b < _LOW:
                self.low[a, b] = True
            else:
                high.append(a << 21 | b)
        self.high = np.array(sorted(high), np.int64)
        self._number_beginnings()
        self.clear()

    def _number_beginnings(self) -> None:
        """Number the beginnings of pieces: `codes` has (number, next character), `then` the longer one's number."""
        self.longest = max(map(len, self.ids), default=1)
        number = {"": 0} | {p: k for k, p in enumerate(self.begun, 1)}
        codes = np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in self.begun], np.int64)
        order = np.argsort(codes)
        self.codes, self.then = codes[order], order + 1
        self.piece_of = np.array([-1] + [self.ids.get(p, -1) for p in self.begun], np.int64)
        self.score_of = np.array([0.0] + [self.score.get(p, 0.0) for p in self.begun])

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.names: list[str] = []
        self.decoded: list[str] = []
        self.several: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
        #: per segment: best score, step to the second best, number of ids and where they begin in `flat`
        self.best, self.step = np.zeros(0), np.zeros(0)
        self.size, self.begin, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def joined(self, points: np.ndarray) -> np.ndarray:
        """Whether neighbouring code points stand side by side in some piece."""
        a, b = points[:-1], points[1:]
        low = (a < _LOW) & (b < _LOW)
        out = self.low[np.where(low, a, 0), np.where(low, b, 0)] & low
        rest = np.flatnonzero(~low)
        if len(rest) and len(self.high):
            code = a[rest].astype(np.int64) << 21 | b[rest]
            found = np.searchsorted(self.high, code)
            out[rest] = self.high[np.minimum(found, len(self.high) - 1)] == code
        return out

    def spelt(self, character: str) -> tuple[int, ...]:
        """Ids of a character without a piece: its bytes, or the unknown id."""
        if not self.byte_ids:
            return (self.unknown_id,)
        return tuple(self.byte_ids[b] for b in character.encode())

    def segmentations(self, segment: str) -> list[tuple[float, tuple[int, ...]]]:
        """The best (score, ids) of an escaped segment, in order."""
        n, begun = len(segment), self.begun
        best = [0.0] + [-1e300] * n
        ending: list[list[tuple[float, int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            here, j = best[i], i + 1
            s = begun.get(segment[i:j])
            if s is None:
                s = self.unknown
            while True:
                if s is not None:
                    t = here + s
                    ending[j].append((-t, j - i, s))
                    if t > best[j]:
                        best[j] = t
                j += 1
                if j > n:
                    break
                s = begun.get(segment[i:j], 0)
                if s == 0 and segment[i:j] not in begun:
                    break
        # entries: (-total, lengths from the end, place, next edge, score behind); an entry stands
        # for its path with that edge and gives way to the edge after it
        for edges in ending:
            edges.sort()
        if not n:
            return [(0.0, ())]
        out: list[tuple[float, tuple[int, ...]]] = []
        first = ending[n][0]
        heap = [(first[0], (first[1],), n, 0, 0.0)]
        while heap and len(out) < self.nbest:
            cost, lengths, j, k, behind = heappop(heap)
            edges = ending[j]
            _, size, s = edges[k]
            if k + 1 < len(edges):
                t, more, _ = edges[k + 1]
                heappush(heap, (t - behind, (*lengths[:-1], more), j, k + 1, behind))
            i = j - size
            if i:
                t, more, _ = ending[i][0]
                heappush(heap, (t - behind - s, (*lengths, more), i, 0, behind + s))
            else:
                out.append((-cost, self._ids(segment, lengths)))
        return out

    def _ids(self, segment: str, lengths: tuple[int, ...]) -> tuple[int, ...]:
        ids: list[int] = []
        at = 0
        for size in reversed(lengths):
            piece = segment[at:at + size]
            known = self.ids.get(piece)
            ids += self.spelt(piece) if known is None else (known,)
            at += size
        return tuple(ids)

    def _forward(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score, second best score, number of ids and ids (in a row) of escaped segments, longest
        first, and which of them have a character without a piece (their results mean nothing)."""
        points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64)
        length = np.array([len(x) for x in names], np.int64)
        first = np.cumsum(length) - length
        left = np.repeat(first + length, length) - np.arange(len(points))
        edge = np.full((self.longest, len(points)), -np.inf)
        piece = np.full(edge.shape, -1, np.int64)
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for k in range(self.longest):
            code = node << 21 | points[at + k]
            found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            good = self.codes[found] == code
            at, node = at[good], self.then[found[good]]
            whole = self.piece_of[node] >= 0
            edge[k, at[whole]], piece[k, at[whole]] = self.score_of[node[whole]], self.piece_of[node[whole]]
            more = left[at] > k + 1
            at, node = at[more], node[more]
        strange = np.maximum.reduceat(piece[0] < 0, first)
        # place t of segment i is first[i] + i + t
        base = first + np.arange(len(names))
        best, second = np.zeros(len(points) + len(names)), np.full(len(points) + len(names), -np.inf)
        took = np.zeros(len(best), np.int64)
        for t in range(1, int(length[0]) + 1):
            m = int(np.searchsorted(-length, -t, "right"))
            back = np.arange(1, min(t, self.longest) + 1)
            before = base[:m] + t - back[:, None]
            score = edge[back[:, None] - 1, first[:m] + t - back[:, None]]
            total = best[before] + score
            choice, every = np.argmax(total, axis=0), np.arange(m)  # the shortest of equal ones
            best[base[:m] + t], took[base[:m] + t] = total[choice, every], choice + 1
            total[choice, every] = second[before[choice, every]] + score[choice, every]
            second[base[:m] + t] = total.max(axis=0)
        ids = np.full((len(names), int(length[0])), -1, np.int64)
        place, rows, column = length.copy(), np.arange(len(names)), ids.shape[1]
        while len(rows):
            column -= 1
            k = took[base[rows] + place[rows]]
            place[rows] -= k
            ids[rows, column] = piece[k - 1, first[rows] + place[rows]]
            rows = rows[place[rows] > 0]
        return best[base + length], second[base + length], (ids >= 0).sum(axis=1), ids[ids >= 0], strange

    def segments(self, texts: list[str]) -> np.ndarray:
        """Numbers of segments (with plain spaces); the new ones are solved."""
        new = sorted({x for x in texts if x not in self.at}, key=len, reverse=True)
        parts: list[tuple] = [(self.best, self.step, self.size, self.flat)]

        def add(names, best, step, size, flat):
            parts.append((best, step, size, flat))
            for name in names:
                self.at[name] = len(self.names)
                self.names.append(name)
            ends = np.cumsum(size).tolist()
            ids = flat.tolist()
            self.decoded += [self.text(ids[b - n:b]) for b, n in zip(ends, size.tolist(), strict=True)]

        def alone(name):
            found = self.segmentations(name.replace(" ", SPACE))
            self.several[len(self.names)] = found
            step = found[0][0] - found[1][0] if len(found) > 1 else np.inf
            add([name], np.array([found[0][0]]), np.array([step]), np.array([len(found[0][1])]), np.array(found[0][1], np.uint32))

        at = 0
        while at < len(new):
            if len(new[at]) > LONG or not self.ids:
                alone(new[at])
                at += 1
                continue
            names = new[at:at + max(1, TOGETHER // len(new[at]))]
            at += len(names)
            best, second, size, flat, strange = self._forward([x.replace(" ", SPACE) for x in names])
            good = np.flatnonzero(~strange)
            add([names[k] for k in good.tolist()], best[good], best[good] - second[good], size[good], flat[np.repeat(~strange, size)].astype(np.uint32))
            for k in np.flatnonzero(strange).tolist():
                alone(names[k])
        if len(parts) > 1:
            self.best, self.step, self.size, self.flat = (np.concatenate(x) for x in zip(*parts, strict=True))
            self.begin = np.cumsum(self.size) - self.size
        return np.array([self.at[x] for x in texts], np.int64)

    def nbest_of(self, number: int) -> list[tuple[float, tuple[int, ...]]]:
        """The best (score, ids) of a numbered segment, searched for when first asked."""
        found = self.several.get(number)
        if found is None:
            found = self.several[number] = self.segmentations(self.names[number].replace(" ", SPACE))
        return found

    def cheapest(self, numbers: np.ndarray) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
        """`cheapest_changes` of a text's segments, from the N - 1 segments with the least steps."""
        step, keep = self.step[numbers], self.nbest - 1
        if keep < 1 or not len(step):
            return [(0.0, ())]
        if len(step) > keep:
            at = np.flatnonzero(step <= np.partition(step, keep - 1)[keep - 1])
        else:
            at = np.arange(len(step))
        at = at[np.isfinite(step[at])]
        at = np.sort(at[np.lexsort((-at, step[at]))[:keep]])
        if not len(at):
            return [(0.0, ())]
        loss = np.full((len(at), keep), np.inf)
        for i, p in enumerate(at.tolist()):
            found = self.nbest_of(int(numbers[p]))
            loss[i, : len(found) - 1] = [found[0][0] - x for x, _ in found[1:]]
        return [(x, tuple((int(at[i]), r) for i, r in changes)) for x, changes in cheapest_changes(loss, self.nbest)]

    def text(self, ids) -> str:
        """The text that ids spell, spaces unescaped, the space before it still there."""
        try:
            return "".join([self.spelling[i] for i in ids])
        except KeyError:  # bytes or unknown ids
            parts, held = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held = bytearray()
            parts.append(self.spelling.get(i, ""))
        if held:
            parts.append(held.decode("utf-8", "replace"))
        return "".join(parts)


def cheapest_changes(loss: np.ndarray, nbest: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The cheapest sets of changes (total loss, ((segment, rank), ...)), the empty set first.

    ``loss`` (segments x ranks from 1 on) is infinite where a segment has no such rank.
    """
    flat = loss.ravel()
    width = loss.shape[1]
    if len(flat) > nbest:
        at = np.flatnonzero(flat <= np.partition(flat, nbest - 2)[nbest - 2])
    else:
        at = np.arange(len(flat))
    at = at[np.isfinite(flat[at])]
    order = np.lexsort((at % width, -(at // width), flat[at]))[: nbest - 1]
    single = [(float(flat[k]), int(k // width), int(k % width) + 1) for k in at[order]]
    sets = []
    for size in range(min(len(single), nbest - 1) + 1):
        for some in combinations(single, size):
            places = sorted((p, r) for _, p, r in some)
            if len({p for p, _ in places}) == size:
                sets.append((sum(x for x, _, _ in some), tuple((-p, r) for p, r in places)))
    sets.sort()
    return [(x, tuple((-p, r) for p, r in places)) for x, places in sets[:nbest]]


_vocabulary: Vocabulary | None = None


def vocabulary(path: str, nbest: int) -> Vocabulary:
    """The vocabulary of a file, kept by a Python worker."""
    global _vocabulary
    if _vocabulary is None or (_vocabulary.path, _vocabulary.nbest) != (path, nbest):
        _vocabulary = Vocabulary(path, nbest)
    return _vocabulary


def _chunk_segments(v: Vocabulary, c) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts of a chunk, the segment numbers of all of them in a row, and the segments' count per text."""
    raw = c.data.tobytes()
    texts = [raw[a:b].decode() for a, b in zip(c.starts.tolist(), c.ends.tolist(), strict=True)]
    escaped = "".join([" " + t for t in texts if t])
    points = np.frombuffer(escaped.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    cut = np.ones(len(points) + 1, bool)
    if len(points):
        cut[1:-1] = ~v.joined(points)
        cut[first] = True
    at = np.flatnonzero(cut) if len(points) else np.zeros(1, np.int64)
    start, end = at[:-1], at[1:]
    key = Sequence(points.astype(np.uint64) + np.uint64(1)).hashes(start, end)
    _, one, number = np.unique(key, return_index=True, return_inverse=True)
    if len(v.names) + len(one) > HELD:
        v.clear()
    known = v.segments([escaped[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)])
    return texts, known[number] if len(one) else known, np.searchsorted(start, first[1:]) - np.searchsorted(start, first[:-1])


def encode_nbest(docs: DataFrame, path: str, nbest: int = NBEST, keep_ids: bool = True) -> DataFrame:
    """Rows (doc_id, rank, score, n_pieces, ids_crc32, decoded) and, with ``keep_ids``, ids.

    One row per text and segmentation, rank from 1; ids_crc32 is over little-endian unsigned
    32-bit ids; decoded says whether the ids spell the text again.
    """
    more = ", ids array<int>" if keep_ids else ""

    def run(batches):
        v = vocabulary(path, nbest)
        for batch, c in chunks(batches):
            texts, numbers, counts = _chunk_segments(v, c)
            at = np.concatenate(([0], np.cumsum(counts)))
            out = []
            valid = batch.column(1).is_valid().to_pylist()
            for i, text in enumerate(texts):
                if not valid[i]:
                    continue
                mine = numbers[at[i]:at[i + 1]]
                n = v.size[mine]
                place = np.concatenate(([0], np.cumsum(n)))
                ids = v.flat[np.arange(place[-1]) + np.repeat(v.begin[mine] - place[:-1], n)].astype("<u4")
                total = float(v.best[mine].sum())
                spelt = "".join([v.decoded[k] for k in mine.tolist()])[1:] == text
                for rank, (lost, changes) in enumerate(v.cheapest(mine), 1):
                    parts, last, same = [], 0, spelt
                    for p, r in changes:
                        alt = v.nbest_of(int(mine[p]))[r][1]
                        parts += [ids[last:place[p]], np.array(alt, "<u4")]
                        last = place[p + 1]
                        same = same and v.text(alt) == v.decoded[mine[p]]
                    now = np.concatenate([*parts, ids[last:]]) if changes else ids
                    out.append((i, rank, total - lost, len(now), zlib.crc32(now.tobytes()), same, *([now.astype(np.int32)] if keep_ids else [])))
            columns = list(zip(*out, strict=True)) or [()] * (6 + keep_ids)
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
            names = ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "decoded", "ids"]
            arrays = [pa.array(x, t) for x, t in zip(columns, kinds, strict=False)]
            arrays[0] = batch.column(0).take(arrays[0])
            yield pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, rank int, score double, n_pieces bigint, ids_crc32 bigint, decoded boolean" + more)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text that each array of ids spells (null for null)."""
    from pyspark.sql import types as T

    rows = rows.drop(text)

    def run(batches):
        v = vocabulary(path, NBEST)
        for batch in batches:
            spelt = [None if x is None else v.text(x)[1:] for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spelt, pa.string())], names=[*batch.schema.names, text])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))
