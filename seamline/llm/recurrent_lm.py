"""A gated recurrent language model in numpy, with exact unigram statistics of the whole corpus.

Tokens are words between ASCII white space, A-Z lower-cased, then one end per
text. Word counts cover every training text. The ``vocabulary`` most frequent
tokens are the network's; the others share one unknown token, and a word among
them has probability P(unknown | state) * (c + 1) / (N' + V' + 1) with the
counts of the words outside the vocabulary. The output softmax is factored:
P(class | state) * P(token | class, state), classes by frequency rank.

The network learns from every training row. It starts from ``sample_texts``
distinct texts (those with the least hashes, ``updates`` steps on the driver);
then each training row is learned from in one of ``rounds`` rounds: a task goes
through its rows of the round by truncated backpropagation, whose state is
carried from window to window and reset after an end, and the tasks' weights
are averaged by their tokens before the next round. What a task holds is a
chunk of texts and the weights, what the driver holds is the weights. Counts
and scores cover whole texts of all rows. Scoring runs all texts of a chunk in step,
window by window, and carries each text's state, so a long text needs no more
memory than its tokens. Null and empty texts are the single end token. Repeated
rows count and score each by itself, and alike; an empty table gives no rows,
and a model of an empty table scores by its random start. A row without doc_id
learns and is scored like any other.

Base scores are the same however the rows lie; the network's are not: which rows
a task learns from, and where a chunk of texts ends, follow the partitions, so
another partitioning gives other weights and another ``score``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm import textkit as tk
from seamline.llm.shared import numbered, written

#: Stands for the end of a text; words hash elsewhere but for one chance in 2**64.
END = np.uint64(0xE4D0F7E87)
#: Tokens of a scoring window over all its texts, and bounds of its length: few long texts get long windows.
WINDOW_TOKENS, WINDOW_LEAST, WINDOW_MOST = 1 << 16, 64, 4096
SCORE_BYTES = 8 << 20  # a chunk goes on for as many steps as its longest text has tokens
HASH_BYTES = 1 << 20
#: Rows of logits worked on at once.
ROW_BLOCK = 2048
NEVER = (1 << 63) - 1
START_BITS = 18
#: Text of a training chunk, its lanes, and tokens of a lane at least; the weights are summed up in so many parts.
TRAIN_BYTES, TRAIN_LANES, LANE_TOKENS, SUM_PARTS = 4 << 20, 512, 1024, 16


def token_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): tokens of text i are ``hashes[first[i]:first[i + 1]]``, its end last."""
    w = tk.Words(raw, offsets)
    n = len(offsets) - 1
    first = w.first + np.arange(n + 1)
    out = np.empty(len(w) + n, np.uint64)
    out[first[1:] - 1] = END
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    out[inside] = w.hash
    return out, first


def long_token_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``token_hashes`` of a larger chunk, part by part: hashing takes many times a part's bytes."""
    parts = [token_hashes(*tk.sub_buffers(raw, offsets, lo, hi)) for lo, hi in tk.row_chunks(offsets, HASH_BYTES)]
    if len(parts) < 2:
        return parts[0] if parts else token_hashes(raw, offsets)
    shift = np.cumsum([0, *(len(h) for h, _ in parts)])
    return np.concatenate([h for h, _ in parts]), np.concatenate([f[:-1] + s for (_, f), s in zip(parts, shift, strict=False)] + [shift[-1:]])


def count_tokens(texts: DataFrame) -> DataFrame:
    """(h, c) over all rows; each Arrow batch counts its tokens before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [token_hashes(raw, off)[0] for _, _, raw, off in tk.column_chunks(batch, "text")]
            h, c = np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    return texts.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


WEIGHTS = ("x", "u", "wc", "bc", "wt", "bt")


@dataclass
class Net:
    """Parameters; ``size`` tokens in classes of ``per_class``."""

    size: int
    per_class: int
    x: np.ndarray  # (3, size, hidden) input of each token to the gates z, r and n
    u: np.ndarray  # (3, hidden, hidden)
    wc: np.ndarray  # (hidden, classes)
    bc: np.ndarray
    wt: np.ndarray  # (classes, hidden, per_class)
    bt: np.ndarray

    @property
    def hidden(self) -> int:
        return self.u.shape[1]

    def params(self) -> list[np.ndarray]:
        return [getattr(self, f) for f in WEIGHTS]


def new_net(counts: np.ndarray, per_class: int, hidden: int, seed: int = 3) -> Net:
    """Random weights, with output biases that give the unigram distribution of ``counts``."""
    size = len(counts)
    classes = -(-size // per_class)
    rng = np.random.default_rng(seed)
    c = np.zeros(classes * per_class)
    c[:size] = np.maximum(counts, 0.5)
    c = c.reshape(classes, per_class)
    bt = np.where(c > 0, np.log(np.maximum(c, 1e-9) / c.sum(axis=1, keepdims=True)), -30.0)
    f32 = lambda a: np.asarray(a, np.float32)
    return Net(size, per_class, f32(rng.normal(0, 0.1, (3, size, hidden))), f32(rng.normal(0, 1 / math.sqrt(hidden), (3, hidden, hidden))), f32(rng.normal(0, 0.05, (hidden, classes))), f32(np.log(c.sum(axis=1) / c.sum())), f32(rng.normal(0, 0.05, (classes, hidden, per_class))), f32(bt))


def step(net: Net, h: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The states after reading a token each, and what the backward pass needs."""
    g, a = np.take(net.x, token, axis=1), h @ net.u
    zr, an = g[:2], a[2]
    zr += a[:2]
    np.negative(zr, out=zr)
    with np.errstate(over="ignore"):
        np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r = zr
    n = r * an
    n += g[2]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, (h, z, r, an, n)


def _advance(x: np.ndarray, u: np.ndarray, h: np.ndarray, token: np.ndarray) -> None:
    """``step`` on the states themselves, by weights whose gates z and r are negated; without what the backward pass needs."""
    g, a = x.take(token, axis=1), np.matmul(h, u)
    zr, n = g[:2], a[2]
    zr += a[:2]
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    n *= zr[1]
    n += g[2]
    np.tanh(n, out=n)
    h -= n
    h *= zr[0]
    h += n


def _blocks(n: int) -> Iterator[slice]:
    """Row ranges whose logits fit a core's cache."""
    return (slice(lo, min(lo + ROW_BLOCK, n)) for lo in range(0, n, ROW_BLOCK))


def _softmax_parts(h: np.ndarray, w: np.ndarray, b: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exponentials, their sums, logit of the target) of ``h @ w + b``; shifted by each row's greatest logit only where they would run over or under."""
    rows, ones = np.arange(len(h)), np.ones(w.shape[1], w.dtype)
    a = h @ w
    a += b
    hit = a[rows, target]
    if a.max(initial=0) < 60:
        e = np.exp(a, out=a)
        total = e @ ones
        if total.min(initial=1) > 1e-20:
            return e, total, hit
        a = h @ w + b
    a -= a.max(axis=1)[:, None]
    hit = a[rows, target]
    e = np.exp(a, out=a)
    return e, e @ ones, hit


def _order(x: np.ndarray) -> np.ndarray:
    """A stable order; small numbers sort fast."""
    return np.argsort(x.astype(np.uint16) if x.max(initial=0) < 1 << 16 else x, kind="stable")


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of rows by class, and (class, from, to) of the runs in it."""
    order = _order(cls)
    cuts = np.flatnonzero(np.r_[True, cls[order][1:] != cls[order][:-1], True]) if len(order) else np.array([0])
    return order, [(int(cls[order[lo]]), int(lo), int(hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _sum_by_token(size: int, tok: np.ndarray, d: np.ndarray, often: int = 24) -> np.ndarray:
    """(size, columns): the sums of the rows of ``d`` by token; frequent tokens run by run, the others one occurrence after the other."""
    out = np.zeros((size, d.shape[1]), d.dtype)
    order = _order(tok)
    tok, d = tok[order], d[order]
    cuts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
    count = np.diff(np.append(cuts, len(tok)))
    for at, n in zip(cuts[count > often].tolist(), count[count > often].tolist(), strict=True):
        out[tok[at]] = d[at : at + n].sum(axis=0)
    for k in range(min(often, int(count.max(initial=0)))):
        at = cuts[(count > k) & (count <= often)] + k
        out[tok[at]] += d[at]
    return out


def log_prob(net: Net, h: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Natural log probability of each token after the state in the same row."""
    cls, within = token // net.per_class, token % net.per_class
    order, runs = _by_class(cls)
    h, cls, within = h[order], cls[order], within[order]
    got = np.empty(len(h))
    for at in _blocks(len(h)):
        _, total, hit = _softmax_parts(h[at], net.wc, net.bc, cls[at])
        got[at] = hit - np.log(total)
    for c, lo, hi in runs:
        for at in _blocks(hi - lo):
            at = slice(lo + at.start, lo + at.stop)
            _, total, hit = _softmax_parts(h[at], net.wt[c], net.bt[c], within[at])
            got[at] += hit - np.log(total)
    out = np.empty(len(h))
    out[order] = got
    return out


def _loss(h: np.ndarray, w: np.ndarray, b: np.ndarray, target: np.ndarray, m: int, dh: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed loss of the softmax of ``h @ w + b``, and the gradients of w and b over ``m``; that of h is added to ``dh``.

    The exponentials stay as they are: what divides them is put on the states and on the gradient of h, which are narrower.
    """
    loss, g_w, g_b, back = 0.0, np.zeros_like(w), np.zeros_like(b), w.T
    for at in _blocks(len(h)):
        d, total, hit = _softmax_parts(h[at], w, b, target[at])
        loss += float((np.log(total) - hit).sum())
        d[np.arange(len(d)), target[at]] -= total
        share = 1 / (total * total.dtype.type(m))
        g_w += (h[at] * share[:, None]).T @ d
        g_b += share @ d
        part = d @ back
        part *= share[:, None]
        dh[at] += part
    return loss, g_w, g_b


def _grads(net: Net, h0: np.ndarray, tokens: np.ndarray, fresh: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray]:
    """Mean loss, gradients and last states of a window: tokens (steps, lanes); ``fresh`` marks a text's first token."""
    steps, lanes = tokens.shape
    k = net.hidden
    kind = net.u.dtype
    h, states, saved = h0, np.empty((steps, lanes, k), kind), []
    for t in range(steps):
        states[t] = h
        h = states[t]
        h[fresh[t]] = 0
        h, s = step(net, h, tokens[t])
        saved.append(s)
    flat, tok = states.reshape(-1, k), tokens.ravel()
    cls, within = tok // net.per_class, tok % net.per_class
    m = len(tok)
    order, runs = _by_class(cls)
    rows, within, dh_rows = flat[order], within[order], np.zeros((m, k), kind)
    loss, g_wc, g_bc = _loss(rows, net.wc, net.bc, cls[order], m, dh_rows)
    g_wt, g_bt = np.zeros_like(net.wt), np.zeros_like(net.bt)
    for c, lo, hi in runs:
        more, g_wt[c], g_bt[c] = _loss(rows[lo:hi], net.wt[c], net.bt[c], within[lo:hi], m, dh_rows[lo:hi])
        loss += more
    dh_out = np.empty_like(dh_rows)
    dh_out[order] = dh_rows
    dh_out = dh_out.reshape(steps, lanes, k)
    # gradients of n, z and r as the input sees them, and of n as the state sees it
    d = np.empty((4, steps, lanes, k), kind)
    dh, back = np.zeros((lanes, k), kind), np.ascontiguousarray(net.u.transpose(0, 2, 1))
    for t in reversed(range(steps)):
        hp, z, r, an, n = saved[t]
        dn, dz, dr, da = d[:, t]
        keep = 1 - z
        np.subtract(hp, n, out=dz)
        dz *= dh
        dz *= z
        dz *= keep
        np.multiply(dh, keep, out=dn)
        n *= n
        n *= dn
        dn -= n
        np.multiply(dn, an, out=dr)
        np.multiply(dn, r, out=da)
        dr *= r
        np.subtract(1, r, out=r)
        dr *= r
        dh *= z
        dh += dh_out[t]
        for gate in np.matmul(d[1:, t], back):
            dh += gate
        dh[fresh[t]] = 0
    g_u = np.stack([flat.T @ x.reshape(-1, k) for x in d[1:]])
    rows = np.concatenate([x.reshape(-1, k) for x in d[:3]], axis=1)
    g_x = np.ascontiguousarray(_sum_by_token(net.size, tok, rows).reshape(net.size, 3, k).transpose(1, 0, 2)[[1, 2, 0]])
    return loss / m, [g_x, g_u, g_wc, g_bc, g_wt, g_bt], h


class _Adam:
    """Steps on the parameters of ``net``, the gradient's norm cut to 1."""

    def __init__(self, net: Net):
        self.net, self.i = net, 0
        self.m, self.v = ([np.zeros_like(p) for p in net.params()] for _ in range(2))

    def step(self, grads: list[np.ndarray], rate: float) -> None:
        self.i += 1
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads))
        cut = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        scale = np.float32(rate / (1 - 0.9**self.i))
        spread = np.float32(1 / math.sqrt(1 - 0.99**self.i))
        for p, g, m, v in zip(self.net.params(), grads, self.m, self.v, strict=True):
            g *= cut
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            g *= np.float32(0.01)
            v *= np.float32(0.99)
            v += g
            np.sqrt(v, out=g)
            g *= spread
            g += np.float32(1e-7)
            np.divide(m, g, out=g)
            g *= scale
            p -= g


def train(net: Net, texts: list[np.ndarray], updates: int = 300, lanes: int = 128, steps: int = 32, rate: float = 0.01) -> Net:
    """Truncated backpropagation over ``texts`` (token ids, the end included), laid end to end in lanes."""
    if not texts:
        return net
    stream = np.concatenate(texts)
    fresh = np.zeros(len(stream), bool)
    fresh[np.cumsum([0, *map(len, texts)])[:-1]] = True
    lanes = max(1, min(lanes, len(stream) // steps))
    steps = min(steps, max(1, len(stream) // lanes))
    length = len(stream) // lanes
    stream, fresh = stream[: lanes * length].reshape(lanes, length).T, fresh[: lanes * length].reshape(lanes, length).T
    adam = _Adam(net)
    h, at = np.zeros((lanes, net.hidden), np.float32), 0
    for i in range(1, updates + 1):
        if at + steps > length:
            h, at = np.zeros_like(h), 0
        _, grads, h = _grads(net, h, stream[at : at + steps], fresh[at : at + steps])
        at += steps
        adam.step(grads, rate * min(1.0, i / 20) * (1 - 0.9 * i / updates))
    return net


def pass_over(adam: _Adam, ids: np.ndarray, first: np.ndarray, rate: float, steps: int = 32) -> None:
    """One pass over all tokens of a chunk of texts; its first tokens fill up the last lane."""
    fresh = np.zeros(len(ids), bool)
    fresh[first[:-1]] = True
    lanes = int(np.clip(len(ids) // LANE_TOKENS, 1, TRAIN_LANES))
    fill = -len(ids) % lanes
    ids, fresh = (np.append(a, a[:fill]).reshape(lanes, -1).T for a in (ids, fresh))
    h = np.zeros((lanes, adam.net.hidden), np.float32)
    for at in range(0, len(ids), steps):
        _, grads, h = _grads(adam.net, h, ids[at : at + steps], fresh[at : at + steps])
        adam.step(grads, rate * min(1.0, (adam.i + 1) / 20))


def score_texts(net: Net, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each text of a chunk, all in step, window by window with the states carried."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    out = np.zeros(len(order))
    h = np.zeros((len(order), net.hidden), np.float32)
    x, u = net.x.copy(), net.u.copy()
    np.negative(x[:2], out=x[:2])
    np.negative(u[:2], out=u[:2])
    t0, end = 0, int(size[0]) if len(size) else 0
    while t0 < end:
        width = int(np.clip(WINDOW_TOKENS // np.searchsorted(-size, -t0, "left"), WINDOW_LEAST, WINDOW_MOST))
        t = np.arange(t0, min(t0 + width, end))
        live = np.searchsorted(-size, -t, "left")  # texts longer than t
        cuts = np.r_[0, np.cumsum(live)]
        rows = np.arange(cuts[-1]) - np.repeat(cuts[:-1], live)
        tokens = ids[start[rows] + np.repeat(t, live)]
        states = np.empty((len(rows), net.hidden), np.float32)
        with np.errstate(over="ignore"):
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                now = h[: hi - lo]
                states[lo:hi] = now
                _advance(x, u, now, tokens[lo:hi])
        lp = log_prob(net, states, tokens)
        out += np.bincount(rows, lp, len(out))
        t0 += width
    back = np.empty(len(out))
    back[order] = out
    return back


@dataclass
class Model:
    net: Net
    known: np.ndarray  # sorted hashes of the most frequent tokens
    count: np.ndarray
    token: np.ndarray  # the network's token of each, its last one for unknown
    total: int
    distinct: int
    other_total: int  # of words outside the network's vocabulary
    other_distinct: int
    learned: int = 0  # tokens that the rounds over the training rows went through

    @property
    def unknown(self) -> int:
        return self.net.size - 1

    @cached_property
    def starts(self) -> np.ndarray:
        """Where the hashes with each value of the first bits begin in ``known``: a few steps from there find any hash."""
        return np.searchsorted(self.known, np.arange(1 << START_BITS, dtype=np.uint64) << np.uint64(64 - START_BITS))

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1 if not among the frequent tokens, network token)."""
        if not len(self.known):
            return np.full(len(h), -1), np.full(len(h), self.unknown, np.int32)
        last = len(self.known) - 1
        at = np.minimum(self.starts[h >> np.uint64(64 - START_BITS)], last)
        below = np.flatnonzero(self.known[at] < h)
        while len(below):
            at[below] += 1
            below = below[at[below] <= last]
            below = below[self.known[at[below]] < h[below]]
        at = np.minimum(at, last)
        hit = self.known[at] == h
        return np.where(hit, self.count[at], -1), np.where(hit, self.token[at], self.unknown).astype(np.int32)


def fit(training: DataFrame, counts: DataFrame, vocabulary: int = 4095, frequent: int = 1 << 18, per_class: int = 64, hidden: int = 32, sample_texts: int = 1500, updates: int = 300, rounds: int = 3, rate: float = 0.004) -> Model:
    """``training`` has the texts to learn from, ``counts`` is ``count_tokens`` of them, written.

    ``frequent`` bounds the tokens whose counts every task holds; tokens that
    tie at the bound are left to the join with all counts.
    """
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums.n or 0), int(sums.v)
    # the least count that at most ``frequent`` tokens reach: distinct counts are few, so no task sees more than these
    reach = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(frequent).toPandas()
    least = reach["c"][reach["n"].cumsum() <= frequent].min()
    top = counts.where(F.col("c") >= F.lit(int(least) if least == least else NEVER)).toArrow()
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    rank = np.lexsort((h, -c))
    h, c = h[rank], c[rank]
    inner = c[:vocabulary]
    token = np.minimum(np.arange(len(h)), len(inner))
    other_total = total - int(inner.sum())
    net = new_net(np.append(inner, max(1, other_total)), per_class, hidden)
    order = np.argsort(h)
    model = Model(net, h[order], c[order], token[order], total, distinct, other_total, distinct - len(inner))

    # distinct texts, so that copies neither crowd in nor keep others out
    hashed = training.select("text", F.xxhash64("text", F.lit(17)).alias("u"))
    last = hashed.select("u").distinct().orderBy("u").limit(sample_texts).agg(F.max("u")).first()[0]
    rows = hashed.where(F.col("u") <= F.lit(last)).groupBy("u").agg(F.first("text").alias("text"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, off in tk.column_chunks(batch, "text"):
                hashes, first = token_hashes(raw, off)
                yield pa.record_batch([pa.array([hashes[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())], names=["v"])

    sample = sorted(rows.select("text").mapInArrow(ids, "v binary").toArrow()["v"].to_pylist(), key=lambda v: hash_order(v))
    train(net, [model.look_up(np.frombuffer(v, np.uint64))[1] for v in sample], updates)
    for k in range(rounds):
        model.learned += learn_round(training.where(F.pmod(F.xxhash64("text", F.lit(23)), F.lit(rounds)) == k), model, rate * (1 - k / rounds))
    return model


def learn_round(rows: DataFrame, model: Model, rate: float) -> int:
    """Every task learns from all its rows, starting from the network of ``model``, which then gets the average weighted by tokens; returns the tokens."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        net = replace(m.net, **{f: getattr(m.net, f).copy() for f in WEIGHTS})
        adam, n = _Adam(net), 0
        for batch in batches:
            for _, _, raw, off in tk.column_chunks(batch, "text", TRAIN_BYTES):
                h, first = long_token_hashes(raw, off)
                if len(h):
                    pass_over(adam, m.look_up(h)[1], first, rate)
                    n += len(h)
        if n:
            parts = np.array_split(np.concatenate([p.ravel() for p in net.params()]), SUM_PARTS)
            yield pa.record_batch([pa.array(range(SUM_PARTS), pa.int32()), pa.array([n] * SUM_PARTS, pa.int64()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["part", "n", "w"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for part, n, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                had = sums.get(part, (0, 0.0))
                sums[part] = had[0] + n, had[1] + n * np.frombuffer(w, np.float32).astype(np.float64)
        yield pa.record_batch([pa.array(sums, pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([w.tobytes() for _, w in sums.values()], pa.binary())], names=["part", "n", "w"])

    # the sums of a part pass through one task, a batch at a time
    learned = rows.select("text").mapInArrow(learn, "part int, n long, w binary").repartition(SUM_PARTS, "part")
    got = sorted(learned.mapInArrow(add, "part int, n long, w binary").toArrow().to_pylist(), key=lambda r: r["part"])
    held.unpersist()
    if not got:
        return 0
    flat, at = np.concatenate([np.frombuffer(r["w"], np.float64) / r["n"] for r in got]).astype(np.float32), 0
    for p in model.net.params():
        p[...] = flat[at : at + p.size].reshape(p.shape)
        at += p.size
    return got[0]["n"]


def hash_order(v: bytes) -> tuple[int, bytes]:
    """An order of texts that does not follow their first words."""
    return int(tk.mix64(np.frombuffer(v, np.uint64).sum(keepdims=True))[0]), v


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` plus n_tokens, n_known, train_tokens, base_score and score (log10).

    Tokens among the frequent ones are settled where the text is read; the
    others, rare by construction, are folded per text and joined with the
    complete counts.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    chosen, fields = numbered(docs, keep, F.col("text"))
    source = chosen.columns[-1]
    kept = [f.name for f in fields]
    kept_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for lo, hi, raw, off in tk.column_chunks(batch, source, SCORE_BYTES):
                h, first = long_token_hashes(raw, off)
                c, tok = m.look_up(h)
                n, doc = hi - lo, np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(first))
                value = np.where(c >= 0, np.log10(np.maximum(c, 0) + 1.0), 0.0)
                outside = tok == m.unknown
                # bincount of nothing is of integers, whatever its weights
                sums = [s.astype(float) for s in (np.bincount(doc, value, n), np.bincount(doc[outside], value[outside], n), np.bincount(doc[outside], minlength=n), np.bincount(doc[c >= 0], minlength=n))]
                rare = np.flatnonzero(c < 0)
                d, x = doc[rare], h[rare]
                del h, c, value, outside, doc, rare
                net = score_texts(m.net, tok, first) / math.log(10)
                order = np.lexsort((x, d))
                d, x = d[order], x[order]
                new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])]) if len(d) else np.empty(0, np.int64)
                times = np.diff(np.append(new, len(d)))
                cuts = np.searchsorted(d[new], np.arange(n + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(x[new].view(np.int64)), pa.array(times.astype(np.int64))], names=["h", "n"])
                yield pa.record_batch([*(batch.column(k).slice(lo, hi - lo) for k in range(len(kept))), pa.array(np.diff(first).astype(np.int64)), *map(pa.array, sums), pa.array(net), pa.ListArray.from_arrays(cuts, pairs)], names=[*kept, "_n", "_all", "_out", "_outs", "_known", "_net", "_rare"])

    part = chosen.mapInArrow(run, f"{kept_ddl}, _n long, _all double, _out double, _outs double, _known double, _net double, _rare array<struct<h: long, n: long>>")
    part = written(part.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = part.select("_row", F.explode("_rare").alias("x")).select("_row", "x.h", "x.n").join(counts, "h")
    more = rare.groupBy("_row").agg(F.sum("n").alias("_more"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("_value"))
    df = part.drop("_rare").join(more, "_row", "left")
    value = F.coalesce("_value", F.lit(0.0))
    base = F.col("_all") + value - F.col("_n") * math.log10(model.total + model.distinct + 1)
    whole = F.col("_net") + F.col("_out") + value - F.col("_outs") * math.log10(model.other_total + model.other_distinct + 1)
    return df.select(*kept, F.col("_n").alias("n_tokens"), (F.col("_known").cast("long") + F.coalesce("_more", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), whole.alias("score")).toDF(*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score")
