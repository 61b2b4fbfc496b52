import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import piece_codec


@pytest.mark.parametrize("size", range(1, 21))
def test_pieces_of_a_table_of_one_text(spark, size):
    text = ("hello" * 4)[:size]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    row = piece_codec.encode_column(df, piece_codec.default_model(), ["doc_id"]).first()
    assert row.n_tokens == len(row.ids) > 0 and row.round_trip


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(piece_codec.load_vocabulary(piece_codec.default_model()))


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=piece_codec.default_model())


def same(codec, library, texts):
    ids, cuts = codec.encode(texts)
    for t, a, b in zip(texts, cuts, cuts[1:], strict=False):
        assert ids[a:b].tolist() == library.encode(t), t[:60]


def test_units_of_any_alphabet(codec, library):
    rng = random.Random(31)
    same(codec, library, ["".join(rng.choice("abc \n▁deéßñ日中のж\0\tTHE.,-🙂") for _ in range(rng.randint(0, 200))) for _ in range(800)])
    same(codec, library, ["🙂🙂", "\0", "", " ", "\n"])
    wide = [chr(c) for c in range(0x20, 0x3000) if chr(c) != "▁"]  # too many characters for eight bits
    same(codec, library, ["".join(rng.choice(wide) for _ in range(300)) for _ in range(40)])


def test_long_units(codec, library):
    rng = random.Random(32)
    letters = string.ascii_letters + string.digits + "+/"
    same(codec, library, ["z" * 5000, "ab" * 3000, "".join(rng.choice(letters) for _ in range(200_000)), "x" + "".join(rng.choice("日本語中文") for _ in range(20_000))])


def test_pairs_stand_apart_as_merging_says(codec):
    v, rng = codec.vocab, np.random.default_rng(33)
    at = {v.pieces[i]: i for i in v.ids}
    scores = [-float(max(r, 0)) for r in v.merges.rank.tolist()]
    a, b = (rng.choice(v.ids, 3000) for _ in range(2))
    got = v.merges.apart(a, b)
    for x, y, g in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        assert g == (piece_codec.merged(v.pieces[x] + v.pieces[y], at, scores)[0] == [v.pieces[x], v.pieces[y]])


def test_columns_with_dots_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a text", 2), (None, None, 3)], "doc_id long, text string, `a.b` int").withColumn("_text", F.lit("x"))
    rows = piece_codec.encode_column(df, piece_codec.default_model(), ["doc_id", "a.b", "_text", "text"]).collect()
    assert {(r["a.b"], r["_text"], r.round_trip) for r in rows} == {(2, "x", True), (3, "x", True)}
    assert piece_codec.encode_column(df.limit(0), piece_codec.default_model(), ["doc_id"]).count() == 0
