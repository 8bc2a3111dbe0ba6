"""Cheapest repair of conversations: which turns to keep, rerole, delete or insert.

A good conversation has role initials ``(s?(ua)+)?``: perhaps a system turn, then user and
assistant in turn, or nothing at all. Keeping a turn costs 0, giving it the role user or assistant
1, deleting it 2, inserting an empty turn 5, and leaving a truncated turn in 5 more; blank and
duplicate turns must go. Among the cheapest repairs the one with the ASCII-least string of edit
initials (D, I, K, R) is taken, which fixes every edit: the role a rerole or an insertion gives
follows from the state before it.

Rows are dealt out by ranges of (conversation, turn) and sorted, so a conversation's rows follow
each other; one that is too large for a range runs on in the next one, as a further segment. Three
streaming passes carry the state of the dynamic program from row to row across Arrow batches:

1. over each segment, the least cost between every two of the four states, a min-plus matrix;
2. against the order, the least cost from every state to the end, from which each row gets a
   compact backpointer: for each state how many turns to insert and the edit, 16 bits in all. They
   are spilled to a written table, so no task keeps them, however long the conversation is;
3. with the order, the edits that the backpointers name.

Between the passes, segments of a conversation are linked by rows of a few numbers each. Memory is
a batch of rows, for any length of a conversation or text.

Order: by turn (nulls first), then the first 64 characters of role and of text, then the SHA-256 of
both; equal rows are interchangeable and may lie in several segments. Null ids are one conversation. Null roles and texts count as one
space, so such texts are blank. Turns that no edit can fit in (other initials, an empty role) are
reroled or deleted. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from journeyflow.llm.storage import materialize

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, S, U, A = range(4)
_INITIAL = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
_NEXT = {START: U, S: U, U: A, A: U}  # what an inserted or reroled turn leads to
_ROLE = {U: "user", A: "assistant"}
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"  # in ASCII order
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
TRUNCATED = 5
FAULTS = ("", "blank", "duplicate", "truncated")
_END = (0, 2 * COST[INSERT], COST[INSERT], 0)  # from each state at the end of a conversation
_FAR = 1 << 40  # more than any two costs differ by
_EDIT_CODES = (DELETE, KEEP, REROLE)


def _edits(initial: str, fault: int, state: int):
    """(edit, cost, state after) of a row in a state, in ASCII order of the edits."""
    yield DELETE, COST[DELETE], state
    if fault in (1, 2):
        return
    extra = TRUNCATED if fault == 3 else 0
    after = _INITIAL.get(initial, {}).get(state)
    if after is not None:
        yield KEEP, COST[KEEP] + extra, after
    yield REROLE, COST[REROLE] + extra, _NEXT[state]


@lru_cache(1 << 16)
def step_back(rest: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int, tuple[int, ...]]:
    """From the costs to the end after a row: those before it, its backpointer, and the state each state leads to.

    The backpointer has four bits for each state: 3 * the turns to insert first + the edit's number.
    """
    own = [min((cost + rest[after], _EDIT_CODES.index(edit), after) for edit, cost, after in _edits(initial, fault, q)) for q in range(4)]
    total = [own[q][0] for q in range(4)]
    for _ in range(2):  # more insertions lead back to the same state
        total = [min(total[q], COST[INSERT] + total[_NEXT[q]]) for q in range(4)]
    code, after = 0, []
    for q in range(4):
        at, inserted = q, 0
        while not (own[at][0] == total[at] and own[at][1] == 0) and COST[INSERT] + total[_NEXT[at]] == total[at]:
            at, inserted = _NEXT[at], inserted + 1
        code |= (3 * inserted + own[at][1]) << (4 * q)
        after.append(own[at][2])
    return tuple(total), code, tuple(after)


@lru_cache(1 << 16)
def step_on(costs: tuple[int, ...], initial: str, fault: int) -> tuple[int, ...]:
    """Least costs of being in each state after a row, given those before it."""
    before = list(costs)
    for _ in range(2):
        for q in range(4):
            before[_NEXT[q]] = min(before[_NEXT[q]], before[q] + COST[INSERT])
    out = [_FAR] * 4
    for q in range(4):
        for _, cost, after in _edits(initial, fault, q):
            out[after] = min(out[after], before[q] + cost)
    return tuple(min(x, _FAR) for x in out)


def _rows(batches):
    """The rows of all batches, as tuples, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _in_batches(rows, schema: pa.Schema, size: int = 8192):
    """Tuples as record batches."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_KEY = [("key", pa.string()), ("seg", pa.int32())]
_LONGS = pa.list_(pa.int64())


def _matrices(batches):
    """Pass 1: rows (key, seg, initial, fault) in order to one min-plus matrix per segment."""

    def run():
        at, lines, base = None, [], []
        for key, seg, initial, fault in _rows(batches):
            if at != (key, seg):
                if at:
                    yield *at, [x + b for line, b in zip(lines, base, strict=True) for x in line]
                at, base = (key, seg), [0] * 4
                lines = [tuple(0 if p == q else _FAR for p in range(4)) for q in range(4)]
            for q in range(4):
                line = step_on(lines[q], initial, fault)
                least = min(line)  # only the differences are kept, of which there are few
                lines[q] = tuple(min(x - least, _FAR) for x in line)
                base[q] += least
        if at:
            yield *at, [x + b for line, b in zip(lines, base, strict=True) for x in line]

    return _in_batches(run(), pa.schema([*_KEY, ("matrix", _LONGS)]))


def _link_back(batches):
    """Segments (key, seg, matrix) against the order: the costs to the end after each, and whether it is the last."""

    def run():
        at, rest = None, _END
        for key, seg, m in _rows(batches):
            last = key != at
            rest = _END if last else rest
            yield key, seg, list(rest), last
            at, rest = key, tuple(min(m[4 * q + p] + rest[p] for p in range(4)) for q in range(4))

    return _in_batches(run(), pa.schema([*_KEY, ("rest", _LONGS), ("last", pa.bool_())]))


def _backpointers(batches):
    """Pass 2: rows (key, seg, gid, initial, fault, rest) against the order to (key, seg, gid, code, exits).

    exits is set on a segment's first row: for each state, two bits with the state it leaves in.
    """

    def run():
        at, held, rest, exits = None, None, (), ()
        for key, seg, gid, initial, fault, end in _rows(batches):
            if at != (key, seg):
                if held:
                    yield *held, sum(x << (2 * q) for q, x in enumerate(exits))
                at, rest, exits = (key, seg), tuple(end), tuple(range(4))
            elif held:
                yield *held, None
            least = min(rest)
            rest, code, after = step_back(tuple(x - least for x in rest), initial, fault)
            exits = tuple(exits[x] for x in after)
            held = key, seg, gid, code
        if held:
            yield *held, sum(x << (2 * q) for q, x in enumerate(exits))

    return _in_batches(run(), pa.schema([*_KEY, ("gid", pa.int64()), ("code", pa.int32()), ("exits", pa.int32())]))


def _link_on(batches):
    """Segments (key, seg, exits) in order to the state each begins in."""

    def run():
        at, state = None, START
        for key, seg, exits in _rows(batches):
            state = START if key != at else state
            yield key, seg, state
            at, state = key, exits >> (2 * state) & 3

    return _in_batches(run(), pa.schema([*_KEY, ("state", pa.int32())]))


def _trace(batches):
    """Pass 3: rows (key, seg, gid, initial, code, state, last) in order to their edits.

    before and behind list the roles to insert there, edit and given are the row's edit and new role.
    """

    def run():
        at, held, state, ends = None, None, START, False

        def closed():
            roles, q = [], state
            while ends and q not in (START, A):
                q = _NEXT[q]
                roles.append(_ROLE[q])
            return *held, roles

        for key, seg, gid, initial, code, first, last in _rows(batches):
            if held:
                yield closed() if at != (key, seg) else (*held, [])
            if at != (key, seg):
                at, state, ends = (key, seg), first, last
            own, before = code >> (4 * state) & 15, []
            for _ in range(own // 3):
                state = _NEXT[state]
                before.append(_ROLE[state])
            edit = _EDIT_CODES[own % 3]
            state = {DELETE: state, KEEP: _INITIAL.get(initial, {}).get(state), REROLE: _NEXT[state]}[edit]
            held = gid, edit, _ROLE[state] if edit == REROLE else None, before
        if held:
            yield closed()

    roles = pa.list_(pa.string())
    return _in_batches(run(), pa.schema([("gid", pa.int64()), ("edit", pa.string()), ("given", pa.string()), ("before", roles), ("behind", roles)]))


def _key(conv: Column) -> Column:
    """Text that tells conversations apart, null from all others too."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def ordered_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The written rows in order: key, conv, turn, role, text, gid (rising in order), seg (the range) and fault's number."""
    role_, text_ = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    named = rows.select(_key(F.col(conv)).alias("key"), F.col(conv).alias("conv"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"))
    named = named.withColumns({"digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), "salt": F.monotonically_increasing_id()})
    order = [F.col("key"), F.col("turn"), F.left("role", F.lit(64)), F.left("text", F.lit(64)), F.col("digest"), F.col("salt")]
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.select("key", "conv", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("gid"), F.spark_partition_id().alias("seg")), "turns")
    first = dealt.groupBy("key", "digest").agg(F.min("gid").alias("gid")).select("gid", F.lit(True).alias("first"))
    stripped = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    ended = F.right(stripped, F.lit(1)).isin(".", "!", "?")
    fault = F.when(stripped == "", 1).when(F.col("first").isNull(), 2).when(~ended, 3).otherwise(0)
    return dealt.join(first, "gid", "left").select("key", "seg", "gid", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), "conv", "turn", "role", "text")


def edit_script(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repair as a table: key, conv, gid, sub (order), turn, role, text, fault, edit, given.

    A row per turn (sub 2; given is the new role of a rerole) and per insertion (sub 0, 1 before
    the turn, 3, 4 behind it; role and text are null, given is the role). The repaired
    conversation are the rows whose edit is not D, in order of (gid, sub).
    """
    turns = materialize(ordered_rows(rows, conv, turn, role, text), "faults")
    narrow = turns.select("key", "seg", "gid", "initial", "fault")
    matrices = narrow.repartition("key", "seg").sortWithinPartitions("key", "seg", "gid").select("key", "seg", "initial", "fault").mapInArrow(
        _matrices, "key string, seg int, matrix array<long>")
    back = materialize(matrices.repartition("key").sortWithinPartitions("key", F.desc("seg")).mapInArrow(
        _link_back, "key string, seg int, rest array<long>, last boolean"), "segments")
    against = narrow.join(back, ["key", "seg"]).repartition("key", "seg").sortWithinPartitions("key", "seg", F.desc("gid"))
    pointers = materialize(against.select("key", "seg", "gid", "initial", "fault", "rest").mapInArrow(
        _backpointers, "key string, seg int, gid long, code int, exits int"), "backpointers")
    begins = pointers.where("exits is not null").select("key", "seg", "exits").repartition("key").sortWithinPartitions("key", "seg").mapInArrow(
        _link_on, "key string, seg int, state int")
    begins = begins.join(back.select("key", "seg", "last"), ["key", "seg"])
    along = pointers.join(narrow.select("gid", "initial"), "gid").join(begins, ["key", "seg"]).repartition("key", "seg").sortWithinPartitions("key", "seg", "gid")
    edits = along.select("key", "seg", "gid", "initial", "code", "state", "last").mapInArrow(
        _trace, "gid long, edit string, given string, before array<string>, behind array<string>")
    steps = F.expr("""concat(transform(before, (r, i) -> named_struct('sub', i, 'edit', 'I', 'given', r)),
        array(named_struct('sub', 2, 'edit', edit, 'given', given)),
        transform(behind, (r, i) -> named_struct('sub', 3 + i, 'edit', 'I', 'given', r)))""")
    told = turns.join(edits, "gid").select("key", "conv", "gid", "turn", "role", "text", "fault", F.explode(steps).alias("step"))
    own = F.col("step.sub") == 2
    return told.select("key", "conv", "gid", "step.sub", *[F.when(own, F.col(c)).alias(c) for c in ("turn", "role", "text", "fault")], "step.edit", "step.given")


def repaired(script: DataFrame) -> DataFrame:
    """The repaired conversations: key, conv, gid, sub, role, text (rows in order of gid, sub)."""
    return script.where(F.col("edit") != DELETE).select("key", "conv", "gid", "sub", F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


_DIGEST = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digests(batches):
    """Rows (key, turn, sub, role, text, fault, edit, given) in order to one row of figures per conversation."""

    def run():
        at, n, audit, sha, turns, before = None, {}, [], None, [], None

        def told():
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            return (at, *({**n, "gaps": gaps}[k] for k in _DIGEST), "".join(audit), sha.hexdigest())

        for key, turn, sub, role, text, fault, edit, given in _rows(batches):
            if key != at:
                if at is not None:
                    yield told()
                at, n, audit, sha, turns, before = key, dict.fromkeys(_DIGEST, 0), [], hashlib.sha256(), [], None
                lines = 0
            audit.append(edit)
            n["cost"] += COST[edit]
            if sub == 2:
                if fault:
                    n[FAULTS[fault]] += 1
                    n["cost"] += TRUNCATED if fault == 3 and edit != DELETE else 0
                if before is not None and before + role[:1] not in ("su", "ua", "au"):
                    n["illegal"] += 1
                before = role[:1]
                if turn is not None:
                    turns = [turns[0], turn, turns[2] + (turn != turns[1])] if turns else [turn, turn, 1]
            if edit != DELETE:
                sha.update(("\n" * (lines > 0) + f"{given or role}:{text or ''}").encode())
                lines += 1
        if at is not None:
            yield told()

    kinds = [("key", pa.string()), *[(k, pa.int64()) for k in _DIGEST], ("audit", pa.string()), ("repaired_sha256", pa.string())]
    return _in_batches(run(), pa.schema(kinds))


def script_digest(script: DataFrame) -> DataFrame:
    """Per conversation (key): the fault counts, cost, audit and hash. The hash of a conversation needs its
    turns one after the other, so each conversation is one stream here, in the memory of a batch and the audit."""
    text = F.when(F.col("edit") != DELETE, F.col("text"))
    rows = script.select("key", "gid", "turn", "sub", "role", text.alias("text"), "fault", "edit", "given")
    dealt = rows.repartition("key").sortWithinPartitions("key", "gid", "sub").select("key", "turn", "sub", "role", "text", "fault", "edit", "given")
    return dealt.mapInArrow(_digests, "key string, " + ", ".join(f"{k} long" for k in _DIGEST) + ", audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20; nulls count as one space."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(place) % 20).alias("_kind"))
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


def repair_digest(rows: DataFrame) -> DataFrame:
    """The contract's columns for every conv_id of ``rows``, whose rows are damaged first."""
    ids = rows.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    found = script_digest(edit_script(damaged(rows)))
    none = hashlib.sha256(b"").hexdigest()
    return ids.join(found, "key", "left").select(
        "conv_id", *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in _DIGEST],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
