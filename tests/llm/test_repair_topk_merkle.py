"""Conversation repair, exact top-k and the Merkle manifest against brute force, and on awkward tables."""

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest
from harness import compare, duck
from pyspark.sql import functions as F

from journeyflow.llm import conversation_repair, merkle_manifest, pivot_topk
from journeyflow.llm.queries import ORACLES, QUERIES
from journeyflow.llm.shipping import ship

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, fault string, gid string"
VECTORS = "vec_id long, embedding array<float>, label int, rank string"
DOCS = "doc_id long, lang string, source string, n_chars long, text string, root string, pos string"


@pytest.fixture(scope="module")
def s(spark):
    """Without merging of small partitions, so that conversations and trees spread over ranges."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield ship(spark)
    spark.conf.unset(key)


def repair(rows):
    """The contract's columns by uniform-cost search over (cost, audit)."""
    by = {}
    for conv, turn, role, text in rows:
        held = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, held in by.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in held:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in held if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
        queue, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, initials, kept = heapq.heappop(queue)
            if i == len(held) and re.fullmatch("(s?(ua)+)?", initials):
                break
            if (i, initials[-1:]) in done:
                continue
            done.add((i, initials[-1:]))
            fits = [c for c in "sua" if c in {"": "su", "s": "u", "u": "a", "a": "u"}[initials[-1:]]]
            new = [c for c in fits if c != "s"]
            for c in new:
                heapq.heappush(queue, (cost + 5, audit + "I", i, initials + c, (*kept, {"u": "user:", "a": "assistant:"}[c])))
            if i < len(held):
                _, role, text = held[i]
                heapq.heappush(queue, (cost + 2, audit + "D", i + 1, initials, kept))
                if faults[i] in ("", "t"):
                    more = 5 if faults[i] else 0
                    if role[:1] in fits:
                        heapq.heappush(queue, (cost + more, audit + "K", i + 1, initials + role[0], (*kept, f"{role}:{text}")))
                    for c in new:
                        heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, initials + c, (*kept, {"u": "user:", "a": "assistant:"}[c] + text)))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def conversations(s, rows):
    return s.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


def test_repair(s):
    r = random.Random(5)

    def some(n, ids):
        return [(r.choice(ids), r.choice([None, 0, 1, 2, 3, 4, 5, 6, 9]), r.choice(["user", "user", "assistant", "assistant", "system", "tool", None, "", "ua"]),
                 r.choice(["a.", "b!", "c", "", None, " \n", "d? ", "e.", "f.", "g", "h.", "long. " * 2000])) for _ in range(n)]

    # one conversation over all ranges, one of equal rows, small ones, null ids
    large = [(7, i, r.choice(["user", "assistant", "system"]), r.choice(["a", "b", "c"]) + str(r.randint(0, 900)) + r.choice(["", ".", "!"])) for i in range(2500)]
    equal = [(3, None, "user", "x.")] * 400 + [(4, 0, "user", "only")]
    for rows in (some(700, [*range(120), None]), some(80, [1, None]), large, equal, []):
        got = conversation_repair.repair_digest(conversations(s, rows))
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        got = [tuple(x) for x in got.collect()]
        assert len(got) == len({x[0] for x in got}) and {x[0]: x[1:] for x in got} == repair(rows)
    turns = conversation_repair.ordered_rows(conversations(s, large), "conv_id", "turn", "role", "text")
    assert turns.select("seg").distinct().count() > 2  # a large conversation is cut


def test_repaired_rows(s):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "system", "Be brief."), (1, 3, "assistant", "Yes."), (2, 0, "assistant", "What?")]
    script = conversation_repair.edit_script(conversations(s, rows))
    left = conversation_repair.repaired(script).orderBy("conv", "gid", "sub").collect()
    assert [(x["conv"], x["role"], x["text"]) for x in left] == [(1, "user", "Hi."), (1, "assistant", "Yes.")]
    assert {x["edit"] for x in script.where("conv = 2").collect()} == {"D"}
    again = conversation_repair.edit_script(conversation_repair.repaired(script).select(F.col("conv").alias("conv_id"), F.col("gid").alias("turn"), "role", "text"))
    assert {x["edit"] for x in again.collect()} == {"K"}


def best(rows, k=5):
    good = [(n, i, [math.floor(256.0 * float(np.float32(x))) for x in v]) for n, (i, v, _) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    limit = (1 << 63) - 1
    out = []
    for n, i, v in good:
        if i is not None and i % 50 == 0:
            near = sorted((-max(-limit, min(limit, sum(a * b for a, b in zip(v, w, strict=False)))), j is None, j or 0) for m, j, w in good if m != n)[:k]
            out += [(i, at + 1, None if null else j, -score) for at, (score, null, j) in enumerate(near)]
    return sorted(out, key=str)


def test_topk(s):
    g = np.random.default_rng(1)
    odd = [(0, [1, 2, 3], 1), (0, [1, 2, 3], 1), (50, [1, 2], None), (None, [1, 2, 3], 0), (1, None, 0), (2, [None, 1], 0), (100, [math.nan, 1], 0), (3, [], 0),
           (150, [1e20, -1, 2], 0), (4, [math.inf], 0), (200, [], 1), (5, [1e20, 1, 1], 2), (6, [1, 2, 3], 1), (250, [0, 0, 0], 0)]
    plain = [(i, list(v), 0) for i, v in enumerate(g.normal(size=(2500, 8)))]
    close = [(i % 700, list(v), 0) for i, v in enumerate(np.repeat(g.normal(size=(30, 8)), 40, 0) + 0.01 * g.normal(size=(1200, 8)))]
    for rows in (odd, plain, close, plain[:1], []):
        rows = [(i, None if v is None else [None if x is None else float(x) for x in v], label) for i, v, label in rows]
        got = pivot_topk.topk_digest(s.createDataFrame([(*r, "x") for r in rows], VECTORS))
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == best(rows)


def test_bounds_save_work():
    g = np.random.default_rng(2)
    vectors = np.floor(256 * (np.repeat(g.normal(size=(40, 16)), 50, 0) + 0.02 * g.normal(size=(2000, 16))))
    pivots = pivot_topk.choose_pivots(vectors[:500])
    far = pivot_topk.distances(vectors, pivots)
    rows = pivot_topk.Rows(2000, np.arange(2000).tobytes(), None, vectors.astype(np.int32).tobytes(), far.tobytes(), 16)
    few = pivot_topk.Rows(20, np.arange(20).tobytes(), None, vectors[:20].astype(np.int32).tobytes(), far[:20].tobytes(), 16)
    exact = vectors[:20] @ vectors.T
    assert (pivot_topk.bounds(few, slice(0, 20), rows) >= exact).all()
    search = pivot_topk.Search(few, np.arange(20), pivots, 5)
    search.meet(0, rows)
    assert search.evaluated < 0.5 * 20 * 2000
    np.fill_diagonal(exact, -np.inf)
    assert all((search.best[i][0] == np.sort(exact[i])[::-1][:5]).all() for i in range(20))


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for proof, a in zip(proofs, at, strict=True):
            proof.append((nodes[a ^ 1], a & 1) if a ^ 1 < len(nodes) else None)
        nodes, at = [digest(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)], [a >> 1 for a in at]
    return nodes[0], proofs


def merkle(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r, digest(*(field(r[k]) for k in (0, 2, 1, 3, 4)))))
    groups = []
    for lang in sorted(by, key=lambda x: (x is not None, (x or "").encode())):
        leaves = sorted(by[lang], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        groups.append((leaves, *tree([h for _, h in leaves])))
    if not groups:
        return []
    root, over = tree([sub for _, sub, _ in groups])
    out = []
    for (leaves, sub, proofs), rest in zip(groups, over, strict=True):
        for (r, leaf), proof in zip(leaves, proofs, strict=True):
            got = leaf
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                got = digest(field(r[0]), field(r[2]), field(r[1]), field(r[3] + 1), field(r[4]))
            for step in proof + rest:
                got = digest(got) if step is None else digest(step[0], got) if step[1] else digest(got, step[0])
            out.append((r[0], leaf, sub, root, digest(*(x[0] for x in proof + rest if x)), got, got == root))
    return sorted(out, key=str)


def test_merkle(s):
    rows = [(r["doc_id"], r["lang"], r["source"], r["n_chars"], r["text"]) for r in s.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [(None, None, "s", 3, "x")] * 40 + [(None, "en", None, None, None), (5, "", None, 1, ""), (5, "é", "a", 1, "b" * 200_000), (5, "é", "a", 1, "c"),
                                              (7, "Z", None, (1 << 63) - 1, "q")] + [(900 + i, f"solo{i}", "s", i, "t") for i in range(11)]
    for some, height in ((rows + odd, 10), (rows + odd, 2), (odd, 1), (rows[:1], 10), ([], 10)):
        got = merkle_manifest.manifest_digest(s.createDataFrame([(*r, "x", "y") for r in some], DOCS), height)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted(map(tuple, got.collect()), key=str) == merkle(some)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(s, name):
    assert not compare(QUERIES[name](s, SF).toPandas(), duck(SF).execute(ORACLES[name]).df())
