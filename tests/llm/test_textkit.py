import random
import re

import numpy as np
import pyarrow as pa

from seamline.llm import textkit as tk


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_match_the_plain_split():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB é\t\n\r\v.\0ßZ  ") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", " ", "x"]
    raw, off = tk.string_buffers(pa.array(texts))
    w = tk.Words(raw, off)
    for i, t in enumerate(texts):
        got = [w.low[a:b].tobytes().decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
        assert got == plain_words(t)
    hashes = {}
    for k in range(len(w)):
        assert hashes.setdefault(w.text(k), w.hash[k]) == w.hash[k]
    assert len(set(hashes.values())) == len(hashes)


def test_sliced_arrays_and_chunks():
    column = pa.array(["one two", "three", None, "four" * 50, "five"]).slice(1, 3)
    raw, off = tk.string_buffers(column)
    assert off.tolist() == [0, 5, 5, 205]
    assert list(tk.row_chunks(off, 10)) == [(0, 2), (2, 3)]
    assert list(tk.row_chunks(np.zeros(1, np.int64), 10)) == []


def test_hash_of_a_word_does_not_depend_on_its_place():
    raw, off = tk.string_buffers(pa.array(["x" * 99 + " word", "word"]))
    w = tk.Words(raw, off)
    assert w.hash[1] == w.hash[2] == tk.hash_word("word")
