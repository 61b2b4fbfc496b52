import random

from seamline.llm import decontaminate
from tests.llm.test_operators import prose


def test_a_gap_ends_a_run_and_rows_go_by_their_text(spark):
    rng = random.Random(41)
    item = prose(rng, 60).split()
    other = [f"odd{k}" for k in range(36)]
    apart = " ".join(item[:12] + other + item[48:])  # both ends of the item, on one diagonal
    changed = " ".join(w if k % 13 else "changed" for k, w in enumerate(item))  # a substitution every 13 words
    clean = prose(random.Random(42), 90)
    docs = spark.createDataFrame([(1, apart), (2, changed), (None, " ".join(item)), (None, clean), (1, clean), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.overlap_words, r.item_words) for r in decontaminate.find_overlaps(docs, bench).collect()}
    assert got == {1: (14, 60), 2: (60, 60), None: (60, 60)}  # a window may hold two other words, so a run goes on for two
    left = [(r.doc_id, r.text) for r in decontaminate.clean(docs, bench).collect()]
    assert sorted(left, key=str) == sorted([(None, clean), (1, clean), (4, None)], key=str)
    assert decontaminate.find_overlaps(docs.limit(0), bench).count() == 0


def test_two_substitutions_anywhere_are_found(spark):
    rng = random.Random(43)
    item = prose(rng, 12).split()
    texts, places = [], [(a, b) for a in range(12) for b in range(a + 1, 12)]
    for a, b in places:
        texts.append("x y " + " ".join("new" if k in (a, b) else w for k, w in enumerate(item)) + " z")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert decontaminate.find_overlaps(docs, bench).count() == len(places)
