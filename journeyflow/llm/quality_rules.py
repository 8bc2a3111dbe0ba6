"""Quality rules whose limits adapt to each language and source.

Every document gets integer metrics. Per (lang, source) and metric a mergeable quantile sketch is
kept: counts of log-linear buckets (exact below 64, then 32 buckets per power of two, so a
quantile is off by 1/32 at most). Bucket counts add up, so sketches merge by summing: partial
aggregates, one small shuffle, the same result for any partitioning. They merge
upwards too, to each language and to all documents, and a group's distribution is blended with
that of its parents, which a group of few documents follows. From its quartiles come a lower and
an upper fence per group and metric; documents are joined with their group's fences and kept if
no metric is outside.

Rows may hold nulls anywhere: a null text has no words, null languages and sources form a group
of their own. An empty table gives an empty result. Other columns pass through `rule_metrics`,
`quality_rules`; columns named like a metric are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from journeyflow.llm.storage import materialize
from journeyflow.llm.texts import SPACE, Sequence, chunks, column_batches, mix, ranks_of_equal, segment_sum

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: metric: (SQL over the counts, least spread beyond the quartile, whether low values are judged too)
METRICS = {
    "chars_per_100_words": ("100 * word_chars div greatest(n_words, 1)", 150, True),
    "symbols_per_100_words": ("100 * n_symbols div greatest(n_words, 1)", 20, False),
    "dup_lines_per_1000_words": ("1000 * n_dup_lines div greatest(n_words, 1)", 100, False),
    "repeats_per_1000_words": ("1000 * n_repeat_words div greatest(n_words, 1)", 300, False),
}
FENCE = 3  # quartile distances beyond the quartile
PARENT = 20  # documents that the distribution of the group above counts as

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def count_chunk(c) -> list[np.ndarray]:
    """The five counts of each text of a chunk."""
    start, end, n_words = c.words()
    points = c.per_text((~SPACE & ((np.arange(256) & 0xC0) != 0x80))[c.data])
    symbols = c.per_text(_SYMBOL[c.data])
    text_of = np.repeat(np.arange(c.n), n_words)
    text_salt = mix(np.arange(1, c.n + 1).astype(np.uint64))
    # lines that hold a word and equal an earlier line of their text
    ls, le, n_lines = c.lines()
    filled = np.searchsorted(start, le) > np.searchsorted(start, ls)
    line_text = np.repeat(np.arange(c.n), n_lines)[filled]
    rank, _ = ranks_of_equal(c.bytes.hashes(ls, le)[filled] ^ text_salt[line_text])
    dup_lines = np.bincount(line_text[rank > 0], minlength=c.n)
    # words in windows found twice or more in their text
    repeated = np.zeros(len(start) + 1, np.int64)
    windows = Sequence(c.bytes.hashes(start, end)).windows(WINDOW)
    whole = text_of[: len(windows)] == text_of[WINDOW - 1:] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    _, count = ranks_of_equal(windows[at] ^ text_salt[text_of[at]])
    at = at[count > 1]
    np.add.at(repeated, at, 1)
    np.add.at(repeated, at + WINDOW, -1)
    return [n_words, points, symbols, dup_lines, segment_sum(np.cumsum(repeated)[:-1] > 0, n_words)]


def _count_texts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in column_batches(texts):
        counts = [[np.zeros(0, np.int64)] * len(COUNTS)]
        counts += [[x.astype(np.int64) for x in count_chunk(c)] for _, c in chunks([batch])]
        yield pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*counts, strict=True)], list(COUNTS))


def rule_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five counts (long) of every whole text, replacing columns so named.

    Only the texts go to Python and only the counts come back; the rows stay where they are.
    """
    # not "deterministic", so that no filter or projection above repeats the call
    count = F.arrow_udf(_count_texts, T.StructType([T.StructField(k, T.LongType()) for k in COUNTS])).asNondeterministic()
    docs = docs.drop(*COUNTS)
    counted = docs.select("*", count(F.col(text)).alias("_counts"))
    return counted.select(*docs.columns, *[F.col(f"_counts.{k}").alias(k) for k in COUNTS])


def _bucket(v):
    """Log-linear bucket of a non-negative whole number: itself below 64, then 32 per power of two."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return shift.cast("long") * 32 + F.call_function("shiftright", v, shift).cast("long")


def _value(b):
    """Least value of a bucket."""
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - shift.cast("long") * 32, shift)


def sketches(metrics: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Bucket counts (keys, metric, bucket, n): the mergeable sketch of each group and metric.

    Only documents with a word count. Sketches of two tables merge by summing n.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), _bucket(F.expr(f"cast({sql} as bigint)")).alias("bucket"))
                                for k, (sql, _, _) in METRICS.items()])).alias("m")
    return metrics.where("n_words > 0").select(*keys, pairs).groupBy(*keys, "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def _quartiles(levels: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, int]:
    """Buckets of the lower and upper quartile of the last level's (bucket, n), blended with the levels above it."""
    b, n = levels[0]
    share = np.cumsum(n) / n.sum()
    for own, count in levels[1:]:
        run = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(own, b, "right")]  # b has the own buckets too
        share = (run + PARENT * share) / (count.sum() + PARENT)
    return tuple(int(b[min(np.searchsorted(share, k / 4 - 1e-9), len(b) - 1)]) for k in (1, 3))


def fences(sketch: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Lower and upper fence per group and metric, one row per group: columns ``<metric>_lo/_hi``.

    The sketches merge upwards, from all keys to none. A group's distribution is its own counts
    and, as PARENT more documents, the distribution of the group above it, which is blended so
    itself: few documents are judged by their parents, many by their own. Quartiles are the first
    buckets whose running share reaches a quarter or three quarters.
    """
    sketch = materialize(sketch, "sketch")
    joined = None
    for k in range(len(keys), -1, -1):
        merged = sketch.groupBy(*keys[:k], "metric", "bucket").agg(F.sum("n").alias("n"))
        level = merged.groupBy(*[F.col(x).alias(f"_{k}_{x}") for x in keys[:k]], F.col("metric").alias(f"_{k}_metric")).agg(
            F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias(f"_level_{k}"))  # as many as the sketch has buckets
        if joined is None:
            joined = level.withColumnsRenamed({f"_{k}_{x}": x for x in (*keys, "metric")})
        else:
            on = [joined[x].eqNullSafe(level[f"_{k}_{x}"]) for x in (*keys[:k], "metric")]
            joined = joined.join(level, on).drop(*[f"_{k}_{x}" for x in (*keys[:k], "metric")])
    joined = joined.select(*keys, "metric", *[f"_level_{k}" for k in range(len(keys) + 1)])

    def run(batches):
        for batch in batches:
            levels = []
            for c in batch.columns[len(keys) + 1:]:
                at, pairs = c.offsets.to_numpy(), c.values
                levels.append((at, pairs.field("bucket").to_numpy(), pairs.field("n").to_numpy()))
            q = [_quartiles([(b[at[i]:at[i + 1]], n[at[i]:at[i + 1]]) for at, b, n in levels]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(batch.columns[:len(keys) + 1] + [pa.array([x[k] for x in q], pa.int64()) for k in (0, 1)],
                                             names=[*keys, "metric", "b1", "b3"])

    schema = T.StructType([joined.schema[x] for x in (*keys, "metric")] + [T.StructField(x, T.LongType()) for x in ("b1", "b3")])
    q = joined.mapInArrow(run, schema).select(*keys, "metric", _value(F.col("b1")).alias("q1"), _value(F.col("b3")).alias("q3"))
    wide = []
    for name, (_, least, low) in METRICS.items():
        reach = FENCE * (F.col("q3") - F.col("q1")) + least
        is_it = F.col("metric") == name
        wide += [F.max(F.when(is_it, F.col("q3") + reach)).alias(f"{name}_hi")]
        wide += [F.max(F.when(is_it, F.col("q1") - reach)).alias(f"{name}_lo")] if low else []
    return q.groupBy(*keys).agg(*wide)


def judge(metrics: DataFrame, limits: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``metrics`` with base_failed and kept, joined null-safely with each group's fences.

    The fences have one row per group and join by whatever way their size allows.
    """
    limits = limits.select(*[F.col(k).alias(f"_limit_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in limits.columns if c not in keys])
    joined = metrics.join(limits, [metrics[k].eqNullSafe(limits[f"_limit_{k}"]) for k in keys], "left")
    inside = F.lit(True)
    for name, (sql, _, low) in METRICS.items():
        inside &= F.coalesce(F.expr(sql) <= F.col(f"_{name}_hi"), F.lit(True))
        if low:
            inside &= F.coalesce(F.expr(sql) >= F.col(f"_{name}_lo"), F.lit(True))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & inside).drop(*limits.columns)


def quality_rules(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``docs`` with the counts, base_failed and kept. Columns with these names are replaced.

    Two passes over the texts (one for the sketches, one for the verdicts); only bucket counts
    are shuffled.
    """
    plain = docs.drop(*COUNTS, "base_failed", "kept")
    limits = materialize(fences(sketches(rule_metrics(plain.select(*keys, text), text), keys), keys), "fences")
    return judge(rule_metrics(plain, text), limits, keys)


def quality_digest(docs: DataFrame) -> DataFrame:
    """Per document doc_id, the counts, base_failed and kept; texts are read once and never shuffled."""
    metrics = materialize(rule_metrics(docs.select("doc_id", "lang", "source", "text"), "text").drop("text"), "rules")
    limits = fences(sketches(metrics))
    return judge(metrics, limits).select("doc_id", *COUNTS, "base_failed", "kept")
