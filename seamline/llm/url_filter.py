"""URL filtering with host rules and a Bloom filter cascade over the corpus's hosts.

The cascade gives exact membership without a join: level 0 holds the listed
hosts, level 1 the unlisted hosts of the corpus that level 0 lets through,
level 2 the listed hosts that level 1 lets through, and so on until a level
lets nothing wrong through. A host of the key universe is listed if the first
level that refuses it is odd. Bits are gathered as 64-bit words by a grouped
``bit_or``, so building holds no key on the driver; only the finished bits go
there, and ``max_bytes`` bounds them. Beyond it the keys are split by hash
into shards with a cascade each. Those stay a table of words: rows are dealt
out by shard, each shard in slices of bounded size, a task reads the words of
its shard before the rows, and holds one cascade at a time; neither the driver
nor a broadcast holds bits then.

Nulls, urls without ``://``: host and path are empty strings; the empty host is
a key like any other. Repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LEVELS = 40
SLICE_ROWS = 1 << 22  # of one shard, about, that one task judges
BITS_LEAST = 1.4427  # of a Bloom filter for a key and a halving of its false positives


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict``: the longest rule that fits ``host`` and ``path``, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # a longer one overrides
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


@dataclass
class Level:
    bits: int
    probes: int
    words: np.ndarray  # uint64

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for i in range(self.probes):
            at = _position(a, b, i, self.bits)
            ok &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return ok


def _position(a: np.ndarray, b: np.ndarray, i: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((a + np.uint64(i) * (b | np.uint64(1))) >> np.uint64(1)) % np.uint64(bits)


def _hashes(level: int) -> list[Column]:
    """Two hashes of ``key``, new ones at each level, so that keys which collide at one level part at the next."""
    return [F.xxhash64("key", F.lit(2 * level + i)).alias(n) for i, n in enumerate(("a", "b"))]


def _u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _shape(n: int, rate: float) -> tuple[int, int]:
    """(bits, probes) of a level for ``n`` keys."""
    return max(64, math.ceil(n * BITS_LEAST * math.log2(1 / rate) / 64) * 64), max(1, round(math.log2(1 / rate)))


def _build(keys: DataFrame, level: int, n: int, rate: float, max_bytes: int) -> Level:
    bits, probes = _shape(n, rate)
    if bits // 8 > max_bytes:
        raise ValueError(f"a level of {bits // 8} bytes exceeds max_bytes={max_bytes}: use more shards")

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _u64(batch.column(0)), _u64(batch.column(1))
            at = np.concatenate([_position(a, b, i, bits) for i in range(probes)])
            at = np.unique(at)
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(first) else at
            yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["w", "v"])

    rows = keys.select(*_hashes(level)).mapInArrow(positions, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v"))
    got = rows.toArrow()
    words = np.zeros(bits // 64, np.uint64)
    if got.num_rows:
        words[_u64(got["w"].combine_chunks())] = _u64(got["v"].combine_chunks())
    return Level(bits, probes, words)


def _passing(keys: DataFrame, level: int, built: Level) -> DataFrame:
    """The keys that ``built`` lets through."""
    bits = keys.sparkSession.sparkContext.broadcast((built.bits, built.probes, built.words))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv = Level(*bits.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0)], names=["key"]).filter(pa.array(lv.has(_u64(batch.column(1)), _u64(batch.column(2)))))

    return keys.select("key", *_hashes(level)).mapInArrow(test, "key string")


def build_cascade(universe: DataFrame, listed: Column, rate: float = 0.25, max_bytes: int = 64 << 20) -> list[Level]:
    """Levels of a cascade over ``universe`` (distinct column ``key``) that holds the keys where ``listed`` is true."""
    keys = written(universe.select("key", listed.alias("listed")), "universe")
    inside, outside = keys.where("listed").select("key"), keys.where("NOT listed").select("key")
    levels: list[Level] = []
    while len(levels) < MAX_LEVELS:
        n = inside.count()
        if not n:
            break
        built = _build(inside, len(levels), n, rate if levels else rate / 4, max_bytes)
        # what the level wrongly lets through is what the next one must hold
        wrong = written(_passing(outside, len(levels), built), "passing")
        levels.append(built)
        inside, outside = wrong, inside
    else:
        raise RuntimeError("the cascade doesn't end: keys are not distinct")
    return levels


def with_membership(df: DataFrame, key: str, levels: list[Level], name: str = "listed") -> DataFrame:
    """Adds the boolean column ``name``; exact for every key of the universe the cascade was built over."""
    spark = df.sparkSession
    if not levels:
        return df.withColumn(name, F.lit(False))
    held = spark.sparkContext.broadcast([(lv.bits, lv.probes, lv.words) for lv in levels])

    @F.pandas_udf("boolean")
    def member(*hashes):
        import pandas as pd

        n = len(hashes[0])
        out, left = np.zeros(n, bool), np.arange(n)
        for i, lv in enumerate(Level(*x) for x in held.value):
            a, b = (h.to_numpy()[left].astype(np.int64).view(np.uint64) for h in hashes[2 * i : 2 * i + 2])
            ok = lv.has(a, b)
            out[left[~ok]] = i % 2 == 1  # refused by an odd level: listed
            left = left[ok]
        out[left] = len(held.value) % 2 == 1
        return pd.Series(out)

    seeds = [F.xxhash64(F.col(key), F.lit(s)) for s in range(2 * len(levels))]
    return df.withColumn(name, member(*seeds))


def judged(batches: Iterator[pa.RecordBatch], shapes: dict[int, dict[int, tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """(row, at): how many levels of its shard's cascade let each row through, up to the first that refuses it.

    Columns shard, slice, is_row, level, w, v, row and two hashes a level of
    ``shapes``, sorted by the first three: the words of a cascade come before
    the rows of its slice, and go when the next slice begins.
    """
    here, held = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, part, is_row = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        new = np.r_[True, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1]) | (is_row[1:] != is_row[:-1])]
        cuts = np.append(np.flatnonzero(new), batch.num_rows)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if here != (shard[lo], part[lo]):
                here, held = (shard[lo], part[lo]), {}  # let go before the next is made
                held = {lv: Level(*shape[here[0]], np.zeros(shape[here[0]][0] // 64, np.uint64)) for lv, shape in shapes.items() if here[0] in shape}
            run = batch.slice(lo, hi - lo)
            if not is_row[lo]:
                level, w, v = run.column(3).to_numpy(), _u64(run.column(4)), _u64(run.column(5))
                for lv in held:
                    held[lv].words[w[level == lv]] = v[level == lv]
                continue
            at, left = np.zeros(hi - lo, np.int32), np.arange(hi - lo)
            for i, lv in enumerate(shapes):
                if lv not in held:
                    break
                left = left[held[lv].has(*(_u64(run.column(7 + 2 * i + k))[left] for k in (0, 1)))]
                at[left] += 1
            yield pa.record_batch([run.column(6), pa.array(at)], names=["row", "at"])


def _by_shard(rows: DataFrame, words: DataFrame, shapes: dict[int, dict[int, tuple[int, int]]]) -> DataFrame:
    """``rows`` (key, shard and others) with ``at`` of ``judged``; ``words`` (shard, level, w, v) meet them task by task."""
    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(SLICE_ROWS)).cast("int").alias("n"))  # a row a shard
    row = F.struct(*rows.columns)
    blank = lambda name, kind: F.lit(None).cast(kind).alias(name)
    slices = F.broadcast(sizes)
    mine = rows.join(slices, "shard").select("shard", F.pmod(F.xxhash64(*rows.columns), F.col("n")).cast("int").alias("slice"), F.lit(1).alias("is_row"), F.lit(-1).alias("level"), blank("w", "long"), blank("v", "long"), row.alias("row"))
    theirs = words.where(F.col("level").isin(list(shapes))).join(slices, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slice"), F.lit(0).alias("is_row"), "level", "w", "v", F.lit(None).cast(mine.schema["row"].dataType).alias("row"))
    met = theirs.unionByName(mine).repartition("shard", "slice").sortWithinPartitions("shard", "slice", "is_row")
    hashes = [F.xxhash64("row.key", F.lit(2 * lv + k)).alias(f"h{lv}_{k}") for lv in shapes for k in (0, 1)]
    out = met.select("*", *hashes).mapInArrow(lambda batches: judged(batches, shapes), f"row {mine.schema['row'].dataType.simpleString()}, at int")
    return out.select("row.*", "at")


def build_sharded(universe: DataFrame, rate: float = 0.25) -> tuple[DataFrame | None, dict[int, dict[int, tuple[int, int]]]]:
    """The cascades of all shards of ``universe`` (distinct ``key``, ``shard``, ``listed``), level by level: their words (shard, level, w, v) as a table, and bits and probes by level and shard. No words where nothing is listed."""
    keys = written(universe, "universe")
    inside, outside = keys.where("listed").select("key", "shard"), keys.where("NOT listed").select("key", "shard")
    words, shapes = None, {}
    for level in range(MAX_LEVELS):
        n = {r.shard: r.n for r in inside.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row a shard
        if not n:
            return words, shapes
        shape = {s: _shape(k, rate if level else rate / 4) for s, k in n.items()}
        shapes[level] = shape

        def positions(batches: Iterator[pa.RecordBatch], shape=shape) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard, a, b = batch.column(0).to_numpy(), _u64(batch.column(1)), _u64(batch.column(2))
                for s in np.unique(shard).tolist():
                    bits, probes = shape[s]
                    at = np.unique(np.concatenate([_position(a[shard == s], b[shard == s], i, bits) for i in range(probes)]))
                    word, first = np.unique(at >> np.uint64(6), return_index=True)
                    value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                    yield pa.record_batch([pa.array(np.full(len(word), s, np.int32)), pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["shard", "w", "v"])

        got = inside.select("shard", *_hashes(level)).mapInArrow(positions, "shard int, w long, v long").groupBy("shard", "w").agg(F.bit_or("v").alias("v"))
        got = written(got.select("shard", F.lit(level).alias("level"), "w", "v"), "words")
        words = got if words is None else words.unionByName(got)
        # what the level wrongly lets through is what the next one must hold
        inside, outside = written(_by_shard(outside, got, {level: shape}).where("at = 1").select("key", "shard"), "passing"), inside
    raise RuntimeError("the cascade doesn't end: keys are not distinct")


def filter_urls(pages: DataFrame, rules: list[Rule], listed_labels: list[str], rate: float = 0.25, max_bytes: int = 64 << 20, shards: int | None = None) -> DataFrame:
    """Judges every row's ``url``: the longest fitting rule's verdict, else block where the host is listed.

    A host is listed if one of its dot-separated labels is in ``listed_labels``.
    The key universe is every distinct host of ``pages``. ``shards`` splits the
    keys by hash; by default into as many parts as keep each cascade's levels
    under ``max_bytes``. Long urls are like any other.
    """
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = written(base.groupBy(F.col("host").alias("key")).agg(F.lit(1).alias("one")).select("key"), "hosts")
    if shards is None:
        shards = max(1, math.ceil(universe.count() * BITS_LEAST * math.log2(4 / rate) / 8 / max_bytes))
    is_listed = F.arrays_overlap(F.split("key", r"\."), F.array(*[F.lit(x) for x in listed_labels])) if listed_labels else F.lit(False)
    if shards > 1:
        of = lambda c: F.pmod(F.xxhash64(c, F.lit(-1)), F.lit(shards)).cast("int").alias("shard")
        words, shapes = build_sharded(universe.select("key", of("key"), is_listed.alias("listed")), rate)
        if words is None:
            df = base.withColumn("listed", F.lit(False))
        else:
            met = _by_shard(base.select("page_id", F.col("host").alias("key"), "path", of("host")), words, shapes)
            df = met.select("page_id", F.col("key").alias("host"), "path", (F.col("at") % 2 == 1).alias("listed"))
    else:
        df = with_membership(base, "host", build_cascade(universe, is_listed, rate, max_bytes))
    df = with_rule(df, rules)
    verdict = F.coalesce("rule_verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return df.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")
