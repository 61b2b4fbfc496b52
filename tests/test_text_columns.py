"""Keyed codes, templates and cleaning as Columns against plain Python."""

import base64
import hmac
import random
import re

from pyspark.sql import functions as F

from seamline.functions import text as tx


def hkdf(secret, info, size):
    prk, out, block = hmac.digest(bytes(32), secret, "sha256"), b"", b""
    while len(out) < size:
        block = hmac.digest(prk, block + info + bytes([len(out) // 32 + 1]), "sha256")
        out += block
    return out[:size]


def test_codes_of_ten_thousand_rows(spark):
    rng = random.Random(1)
    rows = [(rng.randbytes(rng.choice([0, 1, 32, 63, 64, 65, 200])), rng.randbytes(rng.randint(0, 150)), f"run{i}", f"2024-01-{i % 28 + 1:02}") for i in range(10_000)]
    df = spark.createDataFrame([(bytearray(k), bytearray(m), r, d) for k, m, r, d in rows], "key binary, message binary, run string, date string")
    for fixed in (b"", b"secret", bytes(range(90))):
        got = df.select(tx.hmac_sha256(fixed, F.col("message")).alias("m"), tx.run_token(fixed, F.col("run"), F.col("date")).alias("t")).collect()
        assert all(bytes(g.m) == hmac.digest(fixed, m, "sha256") for g, (_, m, _, _) in zip(got, rows, strict=True))
        assert all(g.t == base64.urlsafe_b64encode(hmac.digest(fixed, f"{r}|{d}".encode(), "sha256")).rstrip(b"=").decode() for g, (_, _, r, d) in zip(got, rows, strict=True))
    got = df.select(tx.hmac_sha256(F.col("key"), F.col("message")).alias("m")).collect()
    assert all(bytes(g.m) == hmac.digest(k, m, "sha256") for g, (k, m, _, _) in zip(got, rows, strict=True))
    for size in (16, 32, 80):
        days = df.select("date", tx.derive_key(b"s", F.col("date"), size).alias("k")).distinct().collect()
        assert all(bytes(r.k) == hkdf(b"s", f"seamline/{r.date}".encode(), size) for r in days)
    token = tx.run_token(b"s", F.col("run"), F.col("date"))
    ok = df.select(tx.check_token(b"s", F.col("run"), F.col("date"), token).alias("a"), tx.check_token(b"t", F.col("run"), F.col("date"), token).alias("b"), tx.check_token(b"s", F.col("run"), F.lit("x"), token).alias("c"), tx.check_token(b"s", F.col("run"), F.col("date"), F.lit(None).cast("string")).alias("d")).distinct().collect()
    assert [tuple(r) for r in ok] == [(True, False, False, False)]
    nulls = spark.range(1).select(tx.hmac_sha256(F.lit(None).cast("binary"), F.lit(b"m")).alias("a"), tx.hmac_sha256(b"k", F.lit(None).cast("binary")).alias("b")).first()
    assert nulls.a is None and nulls.b is None


def expanded(s, rounds=8):
    def one(m):
        name, *args = m[1].split("|")
        bare = lambda x: re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", x)
        return ", ".join(bare(a) for a in args if "=" not in a and bare(a)) if bare(name).lower() in tx.LIST_TEMPLATES else ""

    for _ in range(rounds):
        s = re.sub(r"\{\{([^{}]*)\}\}", one, s)
    return s


def test_templates(spark):
    rng = random.Random(2)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return "".join(rng.choice(["a", "é ", "\n", "x=1", "|", "{", "}", " b ", "$1", "\\", ""]) for _ in range(rng.randint(0, 5)))
        name = rng.choice(["ubl", "Hlist", " plainlist\n", "flag", "", "unbulleted list"])
        return made(depth - 1) + "{{" + "|".join([name, *(made(depth - 1) for _ in range(rng.randint(0, 3)))]) + "}}" + made(depth - 1)

    texts = [made(rng.randint(0, 5)) for _ in range(1500)] + ["{{ubl|{{plainlist|A|B}}|class=x|C}}{{zap}}", "", "{{", "}}", "{{}}", "{{ubl}}", "{{ubl|}}", "{{ubl|a}}" * 3000]
    texts.append("{{ubl|" * 10 + "deep" + "}}" * 10)  # deeper than the rounds
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, s string")
    got = {r.i: r.o for r in df.select("i", tx.expand_templates(F.col("s")).alias("o")).collect()}
    assert got[len(texts)] is None
    for i, t in enumerate(texts):
        assert got[i] == expanded(t), t


def test_wikitext_boxes_and_names(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "s string").select(f(F.col("s")).alias("o")).first().o
    for raw, want in [("[[Right-arm fast|fast bowler]] <ref>x</ref>", "fast bowler"), ("a \'\'\'b\'\'\' <!-- c --> d", "a b d"), ("{{flag|X}} [[Y]]<br/>z", "Yz"), ("<ref name=a/>t  u", "t u"), (None, None)]:
        assert one(tx.clean_wikitext, raw) == want
    for raw, want in [("{{Infobox\n| bowling = Right-arm fast \n| x = 1", "Right-arm fast"), ("|BOWLING=leg", "leg"), ("| bowling =\n| x = 1", ""), ("none", "")]:
        assert one(lambda c: tx.infobox_field(c, "bowling"), raw) == want
    for raw in ["  Ann\t", "  Bo　\n", "é" * 30, "a" * 23 + "éb", "a" * 22 + "éb", "a" * 30, "x\\\\y/../z", "日本 a-b_c 1", "", "\U0001f642" * 5 + "abcdefgh", " " * 40 + "z"]:
        cut = raw.strip().encode()[:24].decode("utf-8", "ignore")
        assert one(tx.clean_player, raw) == re.sub(r"[^A-Za-z0-9_\- ]", "", cut).strip(" "), raw
