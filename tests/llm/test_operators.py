"""Each operator on small tables against plain Python, with nulls, empty, long and repeated rows, clashing columns and empty tables."""

import base64
import hashlib
import io
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import decontaminate, flac, lang_id, near_dup, pii, piece_codec, recurrent_lm, registry, toxicity, url_filter, warc
from tests.llm.test_textkit import plain_words

VOCAB = ["the", "of", "and", "river", "stone", "glass", "winter", "lamp", "copper", "meadow", "signal", "harbor", "ember", "violet", "anchor", "thread"]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


def docs_of(spark, texts, extra=True):
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "clash", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, _k string, n int")
    return df if extra else df.drop("_k", "n")


def test_url_cascade_is_exact(spark):
    rng = random.Random(1)
    urls = [f"http://{rng.choice(['a', 'B', 'spam-farm.c', 'x.cheap-pills'])}{rng.randint(0, 400)}.example.{rng.choice(['org', 'com', 'net'])}{rng.choice(['', '/', '/es/1', '/en/12', '/fr/a?x=1#y', '/de/'])}" for _ in range(800)]
    urls += [None, "", "nothing", "http://", "ftp://EXAMPLE.org/es/?q", "x://a.org?://b", urls[0]]
    urls += [f"http://spam-farm.{i}.net/" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit(2))
    got = {r.page_id: r for r in url_filter.filter_urls(df, registry.URL_RULES, registry.LISTED_LABELS).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.lower()
        best = max((r for r in registry.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.text), default=None)
        listed = any(x in registry.LISTED_LABELS for x in host.split("."))
        assert (got[i].host, got[i].path, got[i].rule, got[i].listed) == (host, path, best.text if best else None, listed)
        assert got[i].verdict == (best.verdict if best else "block" if listed else "allow")
    again = {r.page_id: r.verdict for r in url_filter.filter_urls(df, registry.URL_RULES, registry.LISTED_LABELS, shards=3).collect()}
    assert again == {i: r.verdict for i, r in got.items()}
    assert url_filter.filter_urls(df.limit(0), registry.URL_RULES, registry.LISTED_LABELS).count() == 0


def test_language_id(spark):
    rng = random.Random(2)
    sets = {"en": ["the", "and", "thing", "ing", "wh"], "de": ["sch", "und", "ung", "lich", "keit"], "fr": ["eau", "oux", "que", "tre", "ment"]}
    make = lambda lang, n: " ".join("".join(rng.choice(sets[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(lang, 40), lang) for i, lang in enumerate(list(sets) * 40)]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 !!", "de"), (1003, "日本語のテキスト" * 100, None), (1004, make("fr", 20000), None), (1005, make("de", 5), None)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(train)
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("_text", F.lit(1)).withColumn("_letter", F.lit(2))
    got = {r.doc_id: r for r in lang_id.identify(df, model, ["doc_id", "_text", "_letter"]).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) == len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1000, 1001, 1002))
    assert got[1003].rejected and got[1003].lang_pred in sets
    assert got[1004].lang_pred == "fr" and not got[1004].rejected and got[1005].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = lang_id.fit(train.limit(0))
    assert {r.lang_pred for r in lang_id.identify(df, empty, ["doc_id"]).collect()} == {"und"}
    assert lang_id.identify(df.limit(0), model, ["doc_id"]).count() == 0


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["zorp", "blik", "vrax"]
    texts, labels = [], []
    for i in range(400):
        t = prose(rng, 60).split()
        toxic = i % 5 == 0
        if toxic:
            for b in rng.sample(bad, 2):
                t[rng.randrange(60)] = b.upper() + rng.choice([",", "!", ""])
        texts.append(" ".join(t))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs = docs_of(spark, [*texts, None, "", texts[0]])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert sum(got[i].predicted == (i % 5 == 0) for i in range(400)) >= 395
    assert got[400].score == got[401].score < 0.5 and got[402].score == got[0].score
    none = toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.0}


def test_non_negative_risk_stops_overfitting():
    rng = np.random.default_rng(0)
    pos = rng.normal(1, 1, (40, 200)).astype(np.float32)
    w, b = toxicity.train_nnpu(pos, np.vstack([rng.normal(1, 1, (40, 200)), rng.normal(-1, 1, (160, 200))]).astype(np.float32), 0.2, steps=200)
    assert np.isfinite(w).all() and ((pos @ w + b) > 0).mean() > 0.9


def test_flac_round_trip_and_checks(spark):
    rng = np.random.default_rng(1)
    cases = [b"\0" * 64, b"abc", bytes(rng.integers(0, 256, 9000, dtype=np.uint8)), b"a" * 8192, (np.sin(np.arange(5000) / 9) * 90 + 128).astype(np.uint8).tobytes()]
    raw, off = np.frombuffer(b"".join(cases), np.uint8), np.cumsum([0, *map(len, cases)])
    streams = flac.encode(raw, off)
    for s, c in zip(flac.decode(streams), cases, strict=True):
        assert (s.pcm()[0] + 128).astype(np.uint8).tobytes() == c
        assert [b for b, _ in s.blocks] == list(range(0, len(c), flac.BLOCK_SIZE))
    plain = bytearray(streams[2])
    plain[5 + 37] = 0x81  # the seek table's type made padding: frames are then walked one by one
    assert (flac.decode([bytes(plain)])[0].pcm() == flac.decode([streams[2]])[0].pcm()).all()
    broken = bytearray(streams[4])
    broken[-40] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(broken)])
    df = spark.createDataFrame([(1, streams[2]), (2, None)], "id int, flac binary")
    rows = flac.decode_blocks(df, "flac", ["id"]).orderBy("block").collect()
    assert [r.sample_offset for r in rows] == list(range(0, 9000, flac.BLOCK_SIZE)) and sum(r.samples for r in rows) == 9000
    assert bytes((np.frombuffer(b"".join(r.pcm for r in rows), np.int8).astype(int) + 128).astype(np.uint8)) == cases[2]


def test_flac_checksums():
    data = bytes(range(200)) * 3
    c = 0
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = (c << 1) ^ (0x8005 if c & 0x8000 else 0)
            c &= 0xFFFF
    assert flac.crc16(np.frombuffer(data, np.uint8), np.array([0]), np.array([600]))[0] == c
    assert flac._coded_number(300) == chr(300).encode() and flac._coded_number(70000) == chr(70000).encode()


def test_audio_features(spark):
    texts = [None, "", "x" * 64, "ü" * 5000, "hello", "hello"]
    got = {r.doc_id: r for r in flac.audio_features(docs_of(spark, texts)).collect()}
    assert got == {r.doc_id: r for r in flac.audio_features(docs_of(spark, texts), store=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        x = [b - 128 for b in pad]
        turns = sum((p >= 0) != (q >= 0) for p, q in zip(x, x[1:], strict=False))
        stream = flac.encode(np.frombuffer(pad, np.uint8), np.array([0, len(pad)]))[0]
        assert (got[i].media_bytes, got[i].media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
        assert got[i].feature == f"frames={-(-len(pad) // flac.BLOCK_SIZE)};mean={sum(x) // len(x)};energy={sum(v * v for v in x) // len(x)};peak={max(map(abs, x))};crossings={turns}"
    assert got[4].media_sha256 == got[5].media_sha256 and got[4].feature == got[5].feature
    assert flac.audio_features(docs_of(spark, texts).limit(0)).count() == 0


def test_sentencepiece_matches_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = piece_codec.default_model()
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    texts = ["", " ", "Hello  world", "a\nb\n\n  c", "▁x", "é́ \t z", "\0x", "日本語 テスト", " " * 37 + "x" + " " * 20, "aaaaaaaaaaaaaaaaaaaaaaaaaaa", prose(rng, 3000), "z" * 3000]
    texts += ["".join(rng.choice("abc \n▁deéßßüñ日中\0\tTHE.,-") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    got = {r.doc_id: r for r in piece_codec.encode_column(docs_of(spark, [*texts, None, texts[2]]), path, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == m.encode(t) and got[i].n_tokens == len(got[i].ids)
        assert got[i].round_trip == ("▁" not in t)
    assert got[len(texts)].ids == [] and got[len(texts) + 1].ids == got[2].ids
    enc = spark.createDataFrame([(r.doc_id, r.ids) for r in got.values()], "doc_id long, ids array<int>")
    back = {r.doc_id: r.text for r in piece_codec.decode_column(enc, path, ["doc_id"]).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(texts))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    bench = [(i, prose(rng, n)) for i, n in enumerate([20, 30, 12, 6, 3])] + [(5, None), (6, "")]
    texts = [prose(rng, 80) for _ in range(30)]
    for k in range(12):
        words = bench[k % 3][1].split()
        for p in rng.sample(range(len(words)), k % 4):
            words[p] = "changed"
        texts[k] = prose(rng, 20) + " " + " ".join(words).upper().replace(" ", ", " if k % 2 else " ") + " " + prose(rng, 9)
    texts[12] = "so " + bench[3][1] + " on"
    texts += [None, "", texts[0], prose(rng, 9000)]
    docs, bm = docs_of(spark, texts), spark.createDataFrame(bench, "item_id long, text string").withColumn("h", F.lit(1))
    got = {(r.doc_id, r.item_id): r.overlap_words for r in decontaminate.find_overlaps(docs, bm).collect()}
    split = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    want = {}
    for (d, t), (i, b) in itertools.product(enumerate(texts), bench):
        x, y = split(t), split(b)
        if not y:
            continue
        span = min(12, len(y))
        need = 10 if len(y) >= 12 else len(y)
        by = {}
        for p in range(len(x) - span + 1):
            for q in range(len(y) - span + 1):
                if sum(u == w for u, w in zip(x[p : p + span], y[q : q + span], strict=True)) >= need:
                    by.setdefault(p - q, []).append(q)
        if by:
            want[d, i] = max(len(run) for v in by.values() for run in "".join("x" if any(q <= k < q + span for q in v) else " " for k in range(len(y))).split())
    assert got == want and len(want) > 10
    kept = {r.doc_id for r in decontaminate.clean(docs, bm).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.clean(docs, bm.limit(0)).columns == docs.columns and decontaminate.clean(docs, bm.limit(0)).count() == len(texts)


def test_recurrent_lm_base_and_gain(spark):
    rng = random.Random(7)
    texts = [("A b C d " * rng.randint(5, 60)).strip() if i % 2 else ("x Y z " * rng.randint(5, 60)).strip() for i in range(80)] + [None, "", "unseen words here", "a b c d " * 5000]
    docs = docs_of(spark, texts)
    training = docs.where("doc_id < 60").select("text")
    counts = recurrent_lm.count_tokens(training).cache()
    model = recurrent_lm.fit(training, counts, vocabulary=6, frequent=5, per_class=4, hidden=16, updates=120)
    got = {r.doc_id: r for r in recurrent_lm.score(docs, model, counts, ["doc_id", "_k"]).collect()}
    c = Counter(w for t in texts[:60] for w in [*plain_words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        words = [*plain_words(t), None]
        assert got[i].n_tokens == len(words) and got[i].n_known == sum(c[w] > 0 for w in words) and got[i].train_tokens == n
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words))
    held = [i for i in range(60, 80)]
    assert sum(got[i].score for i in held) > 0.5 * sum(got[i].base_score for i in held)
    empty = recurrent_lm.count_tokens(training.limit(0)).cache()
    assert recurrent_lm.score(docs, recurrent_lm.fit(training.limit(0), empty), empty, ["doc_id"]).count() == len(texts)


def test_recurrent_lm_is_a_distribution_and_gradients_hold():
    net = recurrent_lm.new_net(np.array([5.0, 4, 3, 2, 1, 1, 1]), 3, 5)
    for p in net.params():
        p += np.random.default_rng(0).normal(0, 0.2, p.shape).astype(np.float32)
    net.bt[-1, 1:] = -30
    h = np.random.default_rng(1).normal(size=(1, 5)).astype(np.float32)
    total = sum(float(np.exp(recurrent_lm.log_prob(net, h, np.array([k]))[0])) for k in range(7))
    assert total == pytest.approx(1, abs=1e-4)
    for i, p in enumerate(net.params()):
        net.params()[i][...] = p
    tokens, fresh = np.array([[0, 1], [2, 3], [4, 5], [6, 0]]), np.array([[True, True], [False, False], [False, True], [False, False]])
    wide = recurrent_lm.Net(net.size, net.per_class, *[p.astype(np.float64) for p in net.params()])
    zero = np.zeros((2, 5))
    _, grads, _ = recurrent_lm._grads(wide, zero, tokens, fresh)
    rng = np.random.default_rng(2)
    for p, g in zip(wide.params(), grads, strict=True):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p.shape)
            keep = p[at]
            p[at] = keep + 1e-4
            up = recurrent_lm._grads(wide, zero, tokens, fresh)[0]
            p[at] = keep - 1e-4
            down = recurrent_lm._grads(wide, zero, tokens, fresh)[0]
            p[at] = keep
            assert g[at] == pytest.approx((up - down) / 2e-4, abs=2e-4)


def test_state_is_carried_across_windows():
    net = recurrent_lm.new_net(np.arange(1.0, 9), 4, 6)
    ids = np.random.default_rng(3).integers(0, 8, 300)
    h, want = np.zeros((1, 6), np.float32), 0.0
    for t in ids:
        want += float(recurrent_lm.log_prob(net, h, np.array([t]))[0])
        h = recurrent_lm.step(net, h, np.array([t]))[0]
    got = recurrent_lm.score_texts(net, np.append(ids, [1, 2]), np.array([0, 300, 302]))
    assert got[0] == pytest.approx(want, rel=1e-4)


def brute_components(texts, percent):
    sets = []
    for t in texts:
        w = plain_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return sets, [find(i) for i in range(len(texts))]


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)  # so that the groups here are cut into blocks
    rng = random.Random(8)
    base = [prose(rng, 150).split() for _ in range(6)]
    texts = []
    for k in range(160):
        w = list(base[k % 6])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [None, "", " \n", "one two", "One  two", "one two three", "a b c d e", *[prose(rng, 60) for _ in range(30)], prose(rng, 20000)]
    docs = docs_of(spark, texts)
    for percent in (85, 80):
        sets, want = brute_components(texts, percent)
        got = {r.doc_id: r for r in near_dup.near_duplicates(docs, percent).collect()}
        for i in range(len(texts)):
            assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i)
    left = near_dup.drop_near_duplicates(docs.unionByName(docs.where("doc_id < 3")), 80)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want)) and left.columns == docs.columns
    assert near_dup.near_duplicates(docs.limit(0), 85).count() == 0


def test_odd_sketch_counts_differing_samples():
    rng = np.random.default_rng(4)
    mh = rng.integers(0, 2**32, (2, near_dup.SAMPLES), dtype=np.uint32)
    mh[1, :100] = mh[0, :100]
    sk = near_dup.odd_sketches(mh)
    odd = int(np.bitwise_count(sk[0] ^ sk[1]).sum())
    assert abs(odd - near_dup.most_odd(100 / near_dup.SAMPLES)) < 12
    assert not near_dup.odd_sketches(mh[[0, 0]])[0].tobytes() != near_dup.odd_sketches(mh[[0, 0]])[1].tobytes()


def test_pii_surrogates(spark):
    texts = [
        "Mail Ann.Lee.09@mail6.example.com or +1 (887) 555-2355, card 4111 1111 1111 1111; 4111111111111111. ip 10.2.3.4.",
        "ann.lee.09@MAIL6.example.com wrote; Mrs. Ann Lee met Dr Lee and Mr Lee. г-н Иван Петров, г-жа Анна Петров",
        None, "", 'token = "5c4a26e9bd0c2c2e356de5663481732ff8d0ec46" 123-45-6789', "1.2.3.4.5 2008 12345678901234567 no pii $& \\1 300.1.1.1", "x@y", "10.2.3.4" * 3000,
    ]
    texts += [f"user{i}@a.example.com 10.0.{i // 250}.{i % 250} {4000 + i} Mr Name{'abcdefghij'[i // 100]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i % 10]}" for i in range(400)]
    docs = docs_of(spark, [*texts, texts[1]])
    out = pii.surrogate(docs, "k")
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert len(got) == len(texts) + 1 and all(got[i] == texts[i] for i in (2, 3, 5, 6, 7))
    m = re.fullmatch(r"Mail (\S+@mail\d+\.example\.(?:com|org|net)) or (\+1 \(\d{3}\) \d{3}-\d{4}), card (\d{4} \d{4} \d{4} \d{4}); (\d{16})\. ip (\d+\.\d+\.\d+\.\d+)\.", got[0])
    assert m and m[3].replace(" ", "") == m[4] != "4111111111111111"
    luhn = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, m[4])))
    assert luhn % 10 == 0
    p = re.fullmatch(r"(\S+) wrote; Mrs\. (\w+na) (\w+) met Dr (\w+) and Mr (\w+)\. г-н (\w+н) (\w+), г-жа (\w+на) (\w+)", got[1])
    assert p and p[1] == m[1].lower() and m[1][0].isupper() and p[3] == p[4] == p[5] and p[7] == p[9] and re.fullmatch("[а-я]+", p[7].lower()) and got[len(texts)] == got[1]
    assert re.fullmatch(r'token = "[0-9a-f]{40}" \d{3}-\d{2}-\d{4}', got[4]) and "5c4a26" not in got[4]
    rows = [got[8 + i].split() for i in range(400)]
    for c in (0, 1, 4):
        assert len({r[c] for r in rows}) == 400
    assert all(r[2] == str(4000 + i) and r[3] == "Mr" for i, r in enumerate(rows))
    real = {f"10.0.{i // 250}.{i % 250}" for i in range(400)}
    assert not real & {r[1] for r in rows}
    again = {r.doc_id: r.text for r in pii.surrogate(docs, "k").collect()}
    other = {r.doc_id: r.text for r in pii.surrogate(docs, "other").collect()}
    assert again == got and other[0] != got[0]
    assert pii.surrogate(docs.limit(0), "k").count() == 0


def test_pii_collisions_are_resolved(spark):
    # three-syllable names give 4096 family names: a thousand entities must meet
    forms = [(f"family|latin", f"n{i}") for i in range(1500)]
    got = pii.assign_surrogates(spark.createDataFrame(forms, "kind string, form string"), "k").collect()
    assert len(got) == 1500 and len({r.surrogate.lower() for r in got}) == 1500


def test_warc_round_trip(spark):
    rng = random.Random(9)
    html = [prose(rng, rng.randint(1, 400)) for _ in range(60)] + [None, "", "dup", "dup", "dup", "héllo" * 50000, "\x1f\x8b\x08 magic in text"]
    rows = [(i, None if i == 3 else f"http://h/{i}\r\nX: y", h) for i, h in enumerate(html)] + [(None, "u", "dup"), (5, "u", html[5])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash")).withColumn("n", F.lit(1))
    got = warc.archive_round_trip(spark, pages, split_bytes=700).collect()
    assert len(got) == len(rows)
    want = Counter()
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", -1), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        later = i is not None and i < largest[h or ""]
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if later else "response", largest[h or ""] if later else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_warc_ranges_own_each_record_once():
    rng = random.Random(10)
    data = b"".join(warc.record(i, "u", rng.randbytes(rng.randint(0, 900)), None) for i in range(80)) + b"junk\x1f\x8b\x08junk"
    for step in (1, 37, 500, 10**6):
        got = [r.headers["warc-record-id"] for a in range(0, len(data), step) for r in warc.read_range(io.BytesIO(data), len(data), a, a + step)] if step > 1 else None
        assert got is None or (len(got) == 80 and len(set(got)) == 80)
    broken = bytearray(data)
    broken[len(data) // 2] ^= 255
    assert len(list(warc.read_range(io.BytesIO(bytes(broken)), len(data), 0, len(data)))) in (79, 80)
