"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct units (a run of spaces and the characters up to the next
space or line feed; no piece crosses a unit) are laid end to end and indexed by
a suffix array over their first characters, up to the longest piece. Every
piece is binary-searched for the range of suffixes that start with it; each
occurrence is an edge. Edges are sorted by the position where they end and
relaxed in that order.

For a unigram model relaxing keeps the best-scoring path. The model at hand is
a BPE one, whose result is no best path, so relaxing keeps the one path that
merging gives: the encoding of a prefix ends in the edge whose piece can stand
after the last piece of the prefix before it. Two pieces can stand side by side
if no merge crosses their boundary while they are built (``Merges.apart``). Any
run of such pairs is what merging gives, as a merge across a boundary would
have crossed it in the pair too. Units are cut where no edge spans a boundary;
what is longer than ``LONG`` characters even so is relaxed edge by edge.

Nothing outlives a batch of ``BATCH_BYTES`` of text (a longer text stands
alone), so memory depends on the batch. Characters outside the vocabulary
become their UTF-8 bytes' pieces. A text gets a space in front, as the model's
normaliser does; an empty or null text has no pieces. U+2581 in a text reads as
a space, as in the public encoder, so only such texts do not return unchanged
(``round_trip`` is false there). Repeated rows are encoded alike; an empty
table gives no rows; there are no ties, as merging knows none.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm import textkit as tk
from seamline.llm.shared import numbered

SPACE = "▁"
UNIT = re.compile("\n|▁+[^▁\n]*|[^▁\n]+")
BATCH_BYTES = 1 << 20
LONG = 64
STEPS = 1024  # characters of units that are read back in step
EDGE_BLOCK = 1 << 16  # edges of long units whose pairs are looked at together
NONE = -2  # no encoding ends here
NEVER = np.iinfo(np.int32).max


def merged(text: str, at: dict[str, int], scores: list[float]) -> tuple[list[str], tuple[str, str] | None]:
    """What merging makes of a text, the best-scoring adjacent pair first, the leftmost of equals; and the last merge's two sides."""
    parts: list[str | None] = list(text)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, int, str]] = []
    last = None

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (p := at.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (-scores[p], i, j, parts[i] + parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if parts[i] is None or j >= len(parts) or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
            continue
        last = (parts[i], parts[j])
        parts[i], parts[j], after[i] = both, None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in parts if p is not None], last


@dataclass
class Merges:
    """How pieces come about: rank of the merge that makes each (-1 for a character), its two sides, and all joinable pairs."""

    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray  # sorted left * size + right
    pair_rank: np.ndarray

    def joined(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the merge of ``x`` and ``y``; NEVER if there is none."""
        if not len(self.pairs):
            return np.full(len(x), NEVER, np.int32)
        key = x.astype(np.int64) * len(self.rank) + y
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of ``a`` and ``b`` gives just these two.

        Goes back in time from the finished pieces: of the two that meet at the
        boundary the one made last is taken apart. A merge across the boundary
        must not come before the next merge of either; of equal ranks the
        leftmost comes first, which is one inside ``a``, or the crossing one.
        """
        good = np.ones(len(a), bool)
        open_, x, y = np.arange(len(a)), a.astype(np.int32), b.astype(np.int32)
        limit, inside = np.full(len(a), NEVER, np.int32), np.zeros(len(a), bool)  # rank of the next merge, and whether it is in ``a``
        while len(open_):
            r = self.joined(x, y)
            bad = (r < limit) | ((r == limit) & ~inside & (r != NEVER))
            good[open_[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            more = ~bad & ((rx >= 0) | (ry >= 0))
            open_, x, y, rx, ry = open_[more], x[more], y[more], rx[more], ry[more]
            inside = rx > ry
            limit = np.where(inside, rx, ry)
            x, y = np.where(inside, self.right[x], x), np.where(inside, y, self.left[y])
        return good


@dataclass
class Vocabulary:
    pieces: list[str]
    ids: list[int]  # of the pieces that merging can give, which are matched
    merges: Merges
    byte_ids: list[int]  # of the 256 byte pieces
    unknown: int


def load_vocabulary(path: str) -> Vocabulary:
    """Reads the pieces of a SentencePiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    pieces = [m.id_to_piece(i) for i in range(n)]
    normal = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)]
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p, ok in zip(pieces, normal, strict=True) if ok):
        raise ValueError("pieces that cross spaces or lines are not supported")
    at = {p: i for i, p in enumerate(pieces)}
    return Vocabulary(pieces, *learnt(pieces, [m.get_score(i) for i in range(n)], normal), [at[f"<0x{b:02X}>"] for b in range(256)], m.unk_id())


def learnt(pieces: list[str], scores: list[float], normal: list[bool]) -> tuple[list[int], Merges]:
    """The pieces that merging can give, and how."""
    at = {p: i for i, (p, ok) in enumerate(zip(pieces, normal, strict=True)) if ok}
    order = np.unique([-s for s in scores], return_inverse=True)[1]
    rank, left, right = np.full(len(pieces), -1, np.int32), np.zeros(len(pieces), np.int32), np.zeros(len(pieces), np.int32)
    ids, keys, ranks = [], [], []
    for p, i in at.items():
        if len(p) == 1:
            ids.append(i)
            continue
        got, last = merged(p, at, scores)
        for k in range(1, len(p)):
            x, y = at.get(p[:k]), at.get(p[k:])
            if x is not None and y is not None:
                keys.append(x * len(pieces) + y)
                ranks.append(int(order[i]))
        if got == [p]:
            ids.append(i)
            rank[i], left[i], right[i] = order[i], at[last[0]], at[last[1]]
    keys, ranks = np.array(keys, np.int64), np.array(ranks, np.int32)
    by = np.argsort(keys)
    return sorted(ids), Merges(rank, left, right, keys[by], ranks[by])


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), then the same of first[1], and so on."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Codec:
    def __init__(self, vocab: Vocabulary):
        self.vocab = v = vocab
        self.raw = [p.replace(SPACE, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            self.raw[i] = bytes([b])
        self.piece_id = np.array(v.ids, np.int32)
        self.length = np.array([len(v.pieces[i]) for i in v.ids], np.int32)
        self.depth = int(self.length.max(initial=1))
        self.chars = np.zeros((len(v.ids), self.depth), np.uint32)
        for row, i in enumerate(v.ids):
            self.chars[row, : len(v.pieces[i])] = np.frombuffer(v.pieces[i].encode("utf-32-le"), np.uint32) + 1
        self.alphabet = np.unique(self.chars[self.chars > 0])

    # -- suffix array matching

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, row of the piece) of every occurrence of every piece in ``codes`` (characters plus one, 0 between units)."""
        found = np.unique(codes)
        here = found[np.isin(found, self.alphabet)]
        usable = np.flatnonzero(np.isin(self.chars, np.append(here, 0)).all(axis=1))
        if not len(here) or not len(usable):
            return (np.empty(0, np.int64),) * 3
        # characters as small numbers: 0 between units, the last for those in no piece
        bits = 8 if len(here) < 255 else 16
        per = 64 // bits
        number = np.full(len(found), len(here) + 1, np.uint64)
        number[np.isin(found, here)] = np.arange(1, len(here) + 1)
        number[found == 0] = 0
        text = np.append(number[np.searchsorted(found, codes)], np.zeros(self.depth + per, np.uint64))
        chars, length = np.where(self.chars[usable] > 0, np.searchsorted(here, self.chars[usable]) + 1, 0).astype(np.uint64), self.length[usable]
        n, words = len(codes), -(-self.depth // per)

        def packed(at) -> np.ndarray:
            out = at(0) << np.uint64(bits * (per - 1))
            for k in range(1, per):
                out |= at(k) << np.uint64(bits * (per - 1 - k))
            return out

        suffix = packed(lambda k: text[k : k + n + self.depth])  # the word of characters from each position on
        order = np.lexsort([suffix[w * per : w * per + n] for w in reversed(range(words))]).astype(np.int32)
        chars = np.hstack([chars, np.zeros((len(chars), words * per - self.depth), np.uint64)])
        first, last = np.zeros(len(chars), np.int64), np.full(len(chars), n, np.int64)
        for w in range(words):
            mine = np.flatnonzero((length > w * per) & (first < last))
            low = packed(lambda k: chars[mine, w * per + k])  # noqa: B023
            free = np.maximum(0, per - (length[mine] - w * per)).astype(np.uint64) * np.uint64(bits)
            high = low | ((np.uint64(1) << free) - np.uint64(1))
            if w == 0:
                column = suffix[order]
                first[mine], last[mine] = np.searchsorted(column, low, "left"), np.searchsorted(column, high, "right")
                continue
            lo, hi = first[mine], last[mine]
            first[mine], last[mine] = (_bisect(suffix, order, w * per, lo, hi, x, right) for x, right in ((low, False), (high, True)))
        del suffix, text
        count = np.maximum(last - first, 0)
        row = np.repeat(usable.astype(np.int32), count)
        return order[_spans(first, count)], self.length[row], row

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts): the ids of unit i are ``ids[cuts[i]:cuts[i + 1]]``."""
        size = np.array([len(u) for u in units], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        codes = np.frombuffer("\0".join(units).encode("utf-32-le"), np.uint32) + np.uint32(1)
        codes[(begin + size)[:-1]] = 0  # a text's own NUL keeps code 1
        start, length, row = self.edges(codes)
        piece = self.piece_id[row]
        # a character that is no piece is an edge of its own
        alone = codes > 0
        alone[start[length == 1]] = False
        lone = np.flatnonzero(alone)
        start = np.concatenate([start, lone]).astype(np.int32)
        length = np.concatenate([length, np.ones(len(lone), np.int32)])
        piece = np.concatenate([piece, np.full(len(lone), self.vocab.unknown, np.int32)])
        # segments: from each boundary that no edge spans to the next
        n = len(codes)
        spans = np.bincount(start + 1, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
        opens = np.cumsum(spans)[:n] == 0
        segment = np.flatnonzero(opens)
        origin = segment[np.cumsum(opens) - 1].astype(np.int32)  # the segment's first character
        end = start + length - origin[start]
        long = np.bincount(np.cumsum(opens)[start] - 1, end > LONG, len(segment)) > 0
        wave = ~long[np.cumsum(opens)[start] - 1]

        reach = np.full(n + 1, NONE, np.int32)  # last piece of the encoding that ends before this character
        back = np.zeros(n + 1, np.int32)
        if not wave.all():
            self._relax_long(opens, reach, back, start[~wave], length[~wave], piece[~wave])
            start, length, piece, end = start[wave], length[wave], piece[wave], end[wave]
        self._relax(opens, reach, back, start, length, piece, end)
        del start, length, piece, end, row, wave, spans
        # back from each unit's end, all short units in step
        short = size <= STEPS
        of = np.flatnonzero(short)
        at = (begin + size)[of]
        found = []
        while len(of):
            keep = at > begin[of]
            at, of = at[keep], of[keep]
            found.append((of, at))
            at = back[at].astype(np.int64)
        for u in np.flatnonzero(~short).tolist():
            steps, low = back[begin[u] : begin[u] + size[u] + 1].tolist(), int(begin[u])
            path, here = [], low + int(size[u])
            while here > low:
                path.append(here)
                here = steps[here - low]
            found += [(np.full(len(path), u), np.array(path)[::-1])]
        of, at = (np.concatenate([f[k] for f in reversed(found)]) for k in range(2)) if found else (np.empty(0, np.int64),) * 2
        order = np.argsort(of, kind="stable")
        of, at = of[order], at[order]
        ids, at = reach[at], back[at]
        if (ids == NONE).any():
            raise AssertionError(f"no encoding of {units[of[ids == NONE][0]]!r}")
        odd = np.flatnonzero(ids == self.vocab.unknown)
        if len(odd):
            spelt = [[self.vocab.byte_ids[b] for b in chr(codes[a] - 1).encode("utf-8", "surrogatepass")] for a in at[odd].tolist()]
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(x) for x in spelt]
            of, ids = np.repeat(of, times), np.repeat(ids, times)
            ids[ids == self.vocab.unknown] = [b for x in spelt for b in x]
        return ids, np.searchsorted(of, np.arange(len(units) + 1))

    def _relax(self, opens: np.ndarray, reach: np.ndarray, back: np.ndarray, start: np.ndarray, length: np.ndarray, piece: np.ndarray, end: np.ndarray) -> None:
        """Settles the edges of all short segments, by their ends."""
        order = np.argsort(end.astype(np.uint8), kind="stable").astype(np.int32)
        start, length, piece = start[order], length[order], piece[order]
        cuts = np.searchsorted(end[order], np.arange(1, int(end.max(initial=0)) + 2))
        size = len(self.vocab.pieces)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            s, t, ln = start[lo:hi], piece[lo:hi], length[lo:hi]
            free, prev = opens[s], reach[s]
            ok = free | (prev != NONE)
            asked = np.flatnonzero(ok & ~free)
            if len(asked):
                key, inverse = np.unique(prev[asked].astype(np.int64) * size + t[asked], return_inverse=True)
                ok[asked] = self.vocab.merges.apart(key // size, key % size)[inverse]
            s, t, e = s[ok], t[ok], s[ok] + ln[ok]
            reach[e], back[e] = t, s

    def _relax_long(self, opens: np.ndarray, reach: np.ndarray, back: np.ndarray, start: np.ndarray, length: np.ndarray, piece: np.ndarray) -> None:
        """Settles the edges of long segments one after the other; which pairs can stand is found for many edges at once."""
        size = len(self.vocab.pieces)
        stop = start + length
        order = np.argsort(stop, kind="stable")
        start, stop, piece = start[order], stop[order], piece[order]
        ends: dict[int, int] = {}
        for lo in range(0, len(order), EDGE_BLOCK):
            s, t = start[lo : lo + EDGE_BLOCK], piece[lo : lo + EDGE_BLOCK]
            first, last = np.searchsorted(stop, s, "left"), np.searchsorted(stop, s, "right")
            before = piece[_spans(first, last - first)].astype(np.int64)
            key = np.unique(before * size + np.repeat(t, last - first))
            good = set(key[self.vocab.merges.apart(key // size, key % size)].tolist())
            for x, e, p, free in zip(s.tolist(), stop[lo : lo + EDGE_BLOCK].tolist(), t.tolist(), opens[s].tolist(), strict=True):
                if free or ((prev := ends.get(x)) is not None and prev * size + p in good):
                    ends[e] = p
                    reach[e], back[e] = p, x

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts): the ids of text i are ``ids[cuts[i]:cuts[i + 1]]``."""
        index: dict[str, int] = {}
        place = index.setdefault
        many, seen = [], []
        for t in texts:
            us = UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else []
            many.append(len(us))
            seen.append(np.fromiter([place(u, len(index)) for u in us], np.int32, len(us)))
        if not index:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        flat, cuts = self.encode_units(list(index))
        unit = np.concatenate(seen)
        count = np.diff(cuts)[unit]
        ends = np.append(0, np.cumsum(count))
        return flat[_spans(cuts[unit], count)], ends[np.append(0, np.cumsum(many))]

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace")[1:]


def _bisect(suffix: np.ndarray, order: np.ndarray, shift: int, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """Where each ``x`` belongs among the suffixes ``lo`` to ``hi``, by their word ``shift`` characters on."""
    lo, hi = lo.copy(), hi.copy()
    while len(at := np.flatnonzero(lo < hi)):
        mid = (lo[at] + hi[at]) // 2
        v = suffix[order[mid] + shift]
        less = v <= x[at] if right else v < x[at]
        lo[at[less]] = mid[less] + 1
        hi[at[~less]] = mid[~less]
    return lo


_codecs: dict[str, Codec] = {}


def _codec(path: str, vocab: Vocabulary) -> Codec:
    """A worker's tables of a model, made once."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(vocab)
    return _codecs[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_column(docs: DataFrame, model_path: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` plus n_tokens long, ids array<int>, and round_trip boolean (the ids decode to the text)."""
    held = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))
    chosen, fields = numbered(docs, keep, F.col("text"))
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path, held.value)
        for batch in batches:
            _, offsets = tk.string_buffers(batch.column(len(keep)))
            for lo, hi in tk.row_chunks(offsets, BATCH_BYTES):
                texts = [t or "" for t in batch.column(len(keep)).slice(lo, hi - lo).to_pylist()]
                ids, cuts = codec.encode(texts)
                same = [codec.decode(ids[a:b].tolist()) == t if b > a else not t for a, b, t in zip(cuts, cuts[1:], texts, strict=False)]
                lists = pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(ids))
                yield pa.record_batch([*(batch.column(k).slice(lo, hi - lo) for k in range(len(keep))), pa.array(np.diff(cuts)), lists, pa.array(same, pa.bool_())], names=schema.names)

    return chosen.mapInArrow(run, schema).toDF(*keep, "n_tokens", "ids", "round_trip")


def decode_column(encoded: DataFrame, model_path: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` plus text string, decoded from ``ids``; null ids give an empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))
    chosen, fields = numbered(encoded, keep, F.col("ids"))
    schema = T.StructType([*fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path, held.value)
        for batch in batches:
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array([codec.decode(x or []) for x in batch.column(len(keep)).to_pylist()], pa.string())], names=schema.names)

    return chosen.mapInArrow(run, schema).toDF(*keep, "text")
