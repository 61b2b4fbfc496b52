"""Mined phrases against plain Python."""

import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import phrases as ph

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest, least, top, percent):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall("[^\x20\x09]+", piece)
            lang = "und" if lang is None else lang
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        longer = [b for (g, q), b in f.items() if g == lang and len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= percent * a for b in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    got = []
    for lang, found in out.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            got.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(got)


def corpus(rng, n):
    words = ["the", "of", "River", "stone", "é", "naïve", "x", "New", "York", "city", "🙂", "a b", "zz" * 40]
    rows = []
    for i in range(n):
        w = [rng.choice(words[:4] if rng.random() < 0.5 else words) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randint(0, len(w)), "New York city" if rng.random() < 0.7 else "rare%d" % rng.randint(0, 40))
        rows.append(("".join(x + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "!", "\r"]) for x in w), rng.choice(["en", "de", None, "", "und"])))
    rows += [(None, "en"), ("", None), ("   \t", "en"), ("...", "en"), ("alone", "fr")]
    rows += [("copied line of words here " * 3, "en")] * (n // 2)
    rows.append(("the of " * 20000, "de"))
    return rows


def results(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(4), 300)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, 2, "x", 3) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, a int, h int, phrase string, c int").repartition(5)


@pytest.mark.parametrize("how", [{}, {"top": 7}, {"least": 3}, {"inside_percent": 101}], ids=str)
def test_against_brute_force(docs, rows, how):
    want = brute(rows, 3, how.get("least", 10), how.get("top", 2000), how.get("inside_percent", 50))
    assert len(want) > 15 and results(ph.mine(docs, **how)) == want


@pytest.mark.parametrize(("head", "longest"), [(0, 3), (4, 3), (6, 4), (1 << 20, 2), (1 << 20, 5)])
def test_a_dictionary_that_no_task_may_hold_and_other_lengths(docs, rows, head, longest):
    assert results(ph.mine(docs, longest=longest, head=head, filter_bits=1 << 10)) == brute(rows, longest, 10, 2000, 50)


def test_chunks_and_batches_do_not_matter(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(ph, "CHUNK_BYTES", 300)
    monkeypatch.setattr(ph, "SORTED_KEYS", 50)
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert results(ph.mine(docs)) == brute(rows, 3, 10, 2000, 50)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") != "2000"


def test_words_that_share_a_hash_are_told_apart(docs, rows, monkeypatch):
    whole, salts = ph.count_words, []

    def clumsy(docs, salt=0):
        salts.append(salt)
        return whole(docs, salt).withColumn("h", F.pmod("h", F.lit(9))) if salt < 2 else whole(docs, salt)

    monkeypatch.setattr(ph, "count_words", clumsy)
    assert results(ph.mine(docs)) == brute(rows, 3, 10, 2000, 50) and salts == [0, 1, 2]


def test_empty_tables(docs):
    assert ph.mine(docs.limit(0)).collect() == [] and ph.mine(docs.where("lang = 'fr'")).collect() == []
    assert ph.mine(docs.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_pass_64_bits_exactly(spark):
    rng = random.Random(2)
    rows = [(a, a + rng.randint(0, 10**k), a + rng.randint(0, 10**k)) for k in range(15) for a in (rng.randint(10, 10**15) for _ in range(20))]
    df = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", ph.exact_score(F.col("a"), F.col("l"), F.col("r")))
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in df.collect())
    assert Decimal(10**6) * 10**30 < Decimal(10**38)


def test_filter_holds_what_it_was_given(spark):
    h = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    bits = ph.bit_filter(spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long"), 1 << 16)
    assert ph.in_filter(bits, h).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 20000).astype(np.uint64) * np.uint64(2)
    assert ph.in_filter(bits, others).mean() < 0.05
