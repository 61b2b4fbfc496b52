"""Phrases of words that stand together more often than their parts would, per language.

A text, A-Z lower-cased, is cut at ``[.,;:!?]`` and line ends into pieces, a piece
at spaces and tabs into words; a null text is empty, a null language ``und``. All
counts are of a language and cover every occurrence in all rows, overlaps included.

Words are counted first. Those that occur ``least`` times are the dictionary, and
a piece is broken at every other word, as no phrase that counts can hold one.
Dictionary words get dense ids by rank, sent to all tasks: at most ``head`` of
them (28 bytes each). A phrase of up to three ids is one 63-bit key. For longer
phrases, and where the dictionary has more words, a key is one 64-bit hash a word,
of which all have been found distinct; the tail of the dictionary is told by a bit filter of fixed
size; a word that passes it by chance is dropped with its phrases when they are
counted.

Each task sorts the keys of a chunk of texts and counts runs; then keys are
range-partitioned over the cluster, sorted (Spark's radix sort, as a key is one
long) and their runs counted as they stream by. Longer phrases are looked for
only where both shorter ones inside them passed a bit filter of those that count.
What a task holds is a chunk of texts, the dictionary's head and a filter. A word,
phrase or line that holds a third of the corpus is one row a chunk in each shuffle.

Scores are exact (decimals of 38 digits). Repeated rows count each; ties in a
report are broken by the phrase. An empty table, or one without a phrase that
counts, gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm import textkit as tk
from seamline.llm.shared import written

#: Text whose words are hashed at once, and keys that a task sorts before it counts their runs.
CHUNK_BYTES, SORTED_KEYS = 1 << 20, 1 << 19
BITS = 21  # of an id, where three make a key
UND = "und"
#: Bits of a filter: 8 MB.
FILTER_BITS = 1 << 26

PIECE_END = np.zeros(256, bool)
PIECE_END[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
KEEP = ~PIECE_END
KEEP[[9, 32]] = False


def _chunks(batch: pa.RecordBatch, salt: int) -> Iterator[tuple[tk.Words, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(words, hash of each word in its language, language number of each word, whether the next word follows it in its piece, languages)."""
    langs = batch.column("lang").dictionary_encode()
    names = langs.dictionary.to_pylist()
    spice = np.array([int.from_bytes(hashlib.blake2b(f"{salt} {n}".encode(), digest_size=8).digest(), "big") for n in names], np.uint64)
    code = langs.indices.to_numpy(zero_copy_only=False)
    for lo, hi, raw, off in tk.column_chunks(batch, "text", CHUNK_BYTES):
        w = tk.Words(raw, off, keep=KEEP, table=tk.seeds(256, 100 + salt))
        doc = w.doc()
        own = code[lo:hi][doc]
        with np.errstate(over="ignore"):
            h = tk.mix64(w.hash + spice[own])
        ends = np.cumsum(PIECE_END[w.low], dtype=np.int32)[w.start]
        follows = np.zeros(len(w), bool)
        if len(w):
            follows[:-1] = (ends[1:] == ends[:-1]) & (doc[1:] == doc[:-1])
        yield w, h, own, follows, names


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit(UND)).alias("lang"), F.col("text")).where(F.col("text") != "")


def count_words(docs: DataFrame, salt: int = 0) -> DataFrame:
    """(h, lang, word, c): every word of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, h, own, _, names in _chunks(batch, salt):
                values, at, c = np.unique(h, return_index=True, return_counts=True)
                size = w.end[at] - w.start[at]
                ends = np.append(0, np.cumsum(size))
                data = w.low[np.arange(ends[-1]) + np.repeat(w.start[at] - ends[:-1], size)]
                word = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())
                lang = pa.DictionaryArray.from_arrays(pa.array(own[at].astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
                yield pa.record_batch([pa.array(values.view(np.int64)), lang, word, pa.array(c.astype(np.int64))], names=["h", "lang", "word", "c"])

    return _texts(docs).mapInArrow(run, "h long, lang string, word string, c long").groupBy("h", "lang", "word").agg(F.sum("c").alias("c"))


def distinct_words(docs: DataFrame, tries: int = 8) -> tuple[DataFrame, int]:
    """``count_words``, written, and the salt under which no two words share a hash."""
    for salt in range(tries):
        words = written(count_words(docs, salt), "words")
        if not words.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            return words, salt
    raise RuntimeError(f"words share hashes under each of {tries} salts")


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter of the column ``h``: ``bits`` bits, however many hashes."""
    at = F.shiftrightunsigned("h", 64 - (bits.bit_length() - 1))
    rows = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[rows["i"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - (len(bits).bit_length() + 5))
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


@dataclass
class Dictionary:
    """The most frequent words that count, at most as many as every task may hold, and a filter of the others."""

    h: np.ndarray  # by id - 1, of falling count
    c: np.ndarray
    lang: np.ndarray
    langs: list[str]
    tail: np.ndarray | None
    order: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.order = np.argsort(self.h)

    def at(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the head, whether the word is there)."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = self.order[np.minimum(np.searchsorted(self.h, h, sorter=self.order), len(self.h) - 1)]
        return at, self.h[at] == h

    def encoded(self, h: np.ndarray, dense: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, whether each word may count); where ids are not to be dense, they are the hashes."""
        at, hit = self.at(h)
        return (at + 1).astype(np.uint64) if dense else h, hit if self.tail is None else hit | in_filter(self.tail, h)


def dictionary(words: DataFrame, least: int, head: int, filter_bits: int) -> Dictionary:
    """Ties at the bound on the head are all left to the tail."""
    known = words.where(F.col("c") >= least)
    reach = known.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(head).toPandas()
    inside = reach["n"].cumsum() <= head
    cut = int(reach["c"][inside].min()) if inside.any() else None
    rows = (known.where(F.col("c") >= cut) if cut else known.limit(0)).select("h", "c", "lang").toArrow()
    h, c = rows["h"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    rank = np.lexsort((h, -c))
    lang = rows["lang"].combine_chunks().dictionary_encode() if len(h) else pa.array([], pa.string()).dictionary_encode()
    tail = bit_filter(known.where(F.col("c") < cut) if cut else known, filter_bits) if len(reach) and not inside.all() or len(reach) == head else None
    return Dictionary(h[rank], c[rank], lang.indices.to_numpy()[rank].astype(np.int32), lang.dictionary.to_pylist(), tail)


def _packed(ids: list[np.ndarray], narrow: bool) -> list[np.ndarray]:
    if not narrow:
        return ids
    key = ids[0].copy()
    for x in ids[1:]:
        key = key << np.uint64(BITS) | x
    return [key]


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """A hash of a phrase from those of its words."""
    out = words[0]
    with np.errstate(over="ignore"):
        for x in words[1:]:
            out = tk.mix64(out * np.uint64(0x9E3779B97F4A7C15) + x)
    return out


def count_phrases(docs: DataFrame, words: Dictionary, salt: int, length: int, least: int, shorter: np.ndarray | None) -> DataFrame:
    """(h1 .. hn, c1 .. cn, lang, a, h): phrases of ``length`` words that occur ``least`` times.

    Counts c and the language are null for words of the dictionary's tail.
    ``shorter`` is the filter of phrases one word shorter that count.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((words, shorter))
    narrow = words.tail is None and length * BITS < 64 and len(words.h) < (1 << BITS) - 1
    keys = ["k0"] if narrow else [f"k{i}" for i in range(length)]

    def keys_of(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        d, inner = held.value
        for _, h, _, follows, _ in _chunks(batch, salt):
            ids, known = d.encoded(h, narrow)
            starts = np.ones(max(0, len(h) - length + 1), bool)
            for i in range(length):
                part = slice(i, i + len(starts))
                starts &= known[part] & follows[part] if i < length - 1 else known[part]
            at = np.flatnonzero(starts)
            if inner is not None and len(at):
                for i in range(2):
                    at = at[in_filter(inner, phrase_hash([h[at + i + j] for j in range(length - 1)]))]
            yield _packed([ids[at + i] for i in range(length)], narrow)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back: list[list[np.ndarray]] = []
        for got in (k for batch in batches for k in keys_of(batch)):
            held_back.append(got)
            if sum(len(k[0]) for k in held_back) >= SORTED_KEYS:
                yield runs(held_back)
                held_back = []
        if held_back:
            yield runs(held_back)

    def runs(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        got = [np.concatenate(k) for k in zip(*parts, strict=True)]
        if narrow:
            got[0].sort()
        else:
            rank = np.lexsort(got[::-1])
            got = [k[rank] for k in got]
        new = _runs(got)
        return pa.record_batch([*(pa.array(k[new].view(np.int64)) for k in got), pa.array(np.diff(np.append(new, len(got[0]))).astype(np.int64))], names=[*keys, "a"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = held.value[0]
        kept, a = [np.empty(0, np.uint64)] * len(keys), np.empty(0, np.int64)  # the run that may go on

        def told(k: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
            often = n >= least
            k, n = [x[often] for x in k], n[often]
            if narrow:
                at = [((k[0] >> np.uint64(BITS * (length - 1 - i))) & np.uint64((1 << BITS) - 1)).astype(np.int64) - 1 for i in range(length)]
                hashes, hit = [d.h[x] for x in at], [np.ones(len(n), bool)] * length
            else:
                hashes = k
                at, hit = zip(*(d.at(x) for x in k), strict=True)
            counts = [pa.array(d.c[x] if len(d.c) else np.zeros(len(x), np.int64), mask=~y) for x, y in zip(at, hit, strict=True)]
            code = pa.array(d.lang[at[0]] if len(d.lang) else np.zeros(len(n), np.int32), mask=~hit[0])
            lang = pa.DictionaryArray.from_arrays(code, pa.array(d.langs or [""], pa.string())).cast(pa.string())
            return pa.record_batch([*(pa.array(x.view(np.int64)) for x in hashes), *counts, lang, pa.array(n), pa.array(phrase_hash(hashes).view(np.int64))], names=columns)

        for batch in batches:
            k = [np.concatenate([kept[i], batch.column(i).to_numpy().view(np.uint64)]) for i in range(len(keys))]
            n = np.concatenate([a, batch.column(len(keys)).to_numpy()])
            if len(n):
                new = _runs(k)
                n = np.add.reduceat(n, new)
                k = [x[new] for x in k]
                yield told([x[:-1] for x in k], n[:-1])
                kept, a = [x[-1:] for x in k], n[-1:]
        if len(a):
            yield told(kept, a)

    columns = [*(f"h{i + 1}" for i in range(length)), *(f"c{i + 1}" for i in range(length)), "lang", "a", "h"]
    kinds = ", ".join(f"{c} {'string' if c == 'lang' else 'long'}" for c in columns)
    # written, so that the sample for the ranges doesn't pack the texts again
    packed = written(_texts(docs).mapInArrow(pack, ", ".join(f"{k} long" for k in [*keys, "a"])), "packed")
    return packed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(count, kinds)


def _settled(phrases: DataFrame, words: DataFrame, length: int, tail: bool) -> DataFrame:
    """``count_phrases`` with the counts and language of words of the tail, which no task holds."""
    if not tail:
        return phrases
    for i in range(1, length + 1):
        missing = F.col(f"c{i}").isNull()
        more = words.select(F.col("h").alias(f"h{i}"), F.col("c").alias("_c"), F.col("lang").alias("_lang"))
        found = phrases.where(missing).join(more, f"h{i}").withColumn(f"c{i}", F.col("_c")).withColumn("lang", F.coalesce("lang", "_lang"))
        phrases = phrases.where(~missing).unionByName(found.drop("_c", "_lang"))
    return phrases


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact for counts up to 10**15."""
    wide = lambda c: c.cast("decimal(18,0)")
    top, below = F.lit(1000000).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right)
    return F.call_function("div", top, below)


def mine(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, inside_percent: int = 50, head: int = 1 << 20, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``longest`` words of each language."""
    words, salt = distinct_words(docs)
    known = dictionary(words, least, head, filter_bits)
    levels: dict[int, DataFrame] = {}
    shorter = None
    for length in range(2, longest + 1):
        found = written(count_phrases(docs, known, salt, length, least, shorter), f"phrases{length}")
        levels[length] = written(_settled(found, words, length, True), f"settled{length}") if known.tail is not None else found
        if length < longest:
            shorter = bit_filter(found.select("h"), filter_bits)
    scored = [_scored(levels, m, longest, inside_percent) for m in levels]
    every = scored[0]
    for more in scored[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    return _ranked(every, words, least, longest, top)


def _scored(levels: dict[int, DataFrame], m: int, longest: int, inside_percent: int) -> DataFrame:
    """Candidates of m words that no longer one swallows, each with its lowest cut."""
    names = lambda lo, hi: [f"h{i}" for i in range(lo, hi + 1)]
    df = levels[m].drop("h")
    cuts = []
    for k in range(1, m):
        for part, lo, hi in (("l", 1, k), ("r", k + 1, m)):
            if lo == hi:
                df = df.withColumn(f"{part}{k}", F.col(f"c{lo}"))
            else:
                counts = levels[hi - lo + 1].select(*[F.col(f"h{i - lo + 1}").alias(f"h{i}") for i in range(lo, hi + 1)], F.col("a").alias(f"{part}{k}"))
                df = df.join(counts, names(lo, hi))
        cuts.append(F.struct(exact_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    df = df.withColumn("cut", F.array_min(F.array(*cuts)))
    if m < longest:
        # a phrase inside a longer one is inside one a word longer, which occurs at least as often
        longer = levels[m + 1]
        both = [longer.select(*[F.col(f"h{i + s}").alias(f"h{i}") for i in range(1, m + 1)], F.col("a").alias("over")) for s in (0, 1)]
        over = both[0].unionByName(both[1]).groupBy(*names(1, m)).agg(F.max("over").alias("over"))
        df = df.join(over, names(1, m), "left").where(F.col("over").isNull() | (100 * F.col("over") < inside_percent * F.col("a")))
    return df.select("lang", *names(1, m), "a", "cut.l", "cut.r", "cut.score")


def _ranked(every: DataFrame, words: DataFrame, least: int, longest: int, top: int) -> DataFrame:
    """The first ``top`` of each language; tasks cut their own rows first, then some tasks' together."""
    spark = every.sparkSession
    best = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"))
    cut = every.withColumn("salt", F.spark_partition_id() % 16).withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place", "salt")
    name = "spark.sql.optimizer.windowGroupLimitThreshold"  # up to this many rows a group, each task cuts its own before the shuffle
    had = spark.conf.get(name)
    spark.conf.set(name, str(max(int(had), top)))
    try:
        cut = written(cut, "best")
    finally:
        spark.conf.set(name, had)
    for i in range(1, longest + 1):
        text = words.where(F.col("c") >= least).select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"))
        cut = cut.join(text, f"h{i}", "inner" if i < 3 else "left")
    cut = cut.withColumn("phrase", F.concat_ws(" ", *[f"w{i}" for i in range(1, longest + 1)]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    got = cut.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).join(totals, "lang")
    return got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
