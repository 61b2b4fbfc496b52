"""Name lookup against a product of all terms and people."""

import random

from seamline.operators import names as na

PEOPLE = [
    ("p1", "Ann Lee", ["A Lee", "Annie"]), ("p2", "Ann Lee", None), ("p3", "Bo", ["Bo Diddley", None]), ("p4", "Chloé Ünal", []), ("p5", "p1", ["x"]), ("p6", None, ["No Name"]), ("p3", "Bo", ["Bo Diddley"]), ("p7", "ann lee", ["Ann Lee Ann Lee"]), ("p8", "", ["%_"]), ("p9", "aaaaaa", None),
]


def plain(terms):
    out = {}
    for t in {t or "" for t in terms}:
        tier = {}
        for i, name, aliases in PEOPLE:
            if not t:
                continue
            hit = 1 if i == t else 2 if name == t else 3 if any(x is not None and t.lower() in x.lower() for x in [name, *(aliases or [])]) else None
            if hit:
                tier.setdefault(hit, set()).add(i)
        best = min(tier, default=0)
        ids = tier.get(best, set())
        out[t] = (best, len(ids), min(ids, default=None), "none" if not ids else "one" if len(ids) == 1 else "ambiguous")
    return out


def test_every_kind_of_term(spark):
    rng = random.Random(1)
    terms = ["p1", "Ann Lee", "ann lee", "ANN", "lee", "nn", "n", "é ü", "Bo", "bo d", "nobody", "zzz", "", None, "%", "_", "aaa", "aaaaaaa", "Lee Ann", " ", "annie", "no name", "ann zzz", "Ann Lee"]
    terms += ["".join(rng.choice("anle bo") for _ in range(rng.randint(1, 5))) for _ in range(120)]
    people = spark.createDataFrame(PEOPLE, "id string, name string, aliases array<string>")
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {r.term: (r.tier, r.hits, r.first_id, r.status) for r in na.resolve(asked, people).collect()}
    assert got == plain(terms)
    index = na.gram_index(people).cache()
    assert {r.term: (r.tier, r.hits, r.first_id, r.status) for r in na.resolve(asked, people, index).collect()} == got
    listed = {(r.term, r.id) for r in na.matches(asked, people).collect()}
    assert {i for t, i in listed if t == "Ann Lee"} == {"p1", "p2"} and {i for t, i in listed if t == "ANN"} == {"p1", "p2", "p7"}
    assert na.resolve(asked, people.limit(0)).where("hits > 0").count() == 0 and na.resolve(asked.limit(0), people).count() == 0


def test_no_product_and_few_candidates(spark, capsys):
    people = spark.range(2000).selectExpr("cast(id as string) AS id", "concat('Customer#', lpad(cast(id * 7919 % 2003 as string), 6, '0')) AS name", "cast(NULL as array<string>) AS aliases")
    terms = people.selectExpr("lower(substring(name, 5, 11)) AS term")
    df = na.matches(terms, people)
    df.explain()
    said = capsys.readouterr().out
    assert "Cartesian" not in said and "NestedLoop" not in said
    assert df.count() == 2000
