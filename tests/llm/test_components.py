"""Components against union-find, and how many links their rounds go through."""

import random

from seamline.llm import components
from seamline.llm.components import connected


def least(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def check(spark, links):
    got = connected(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == least(links)


def test_stars_chains_and_any_graph(spark):
    rng = random.Random(5)
    check(spark, [(x, 500) for x in range(60)] + [(x, 900) for x in range(901, 940)])
    check(spark, [(i, i + 1) for i in range(70)] + [(1000 - i, 1001 - i) for i in range(70)])
    check(spark, [(i, 100 + i) for i in range(40)] + [(i, 99 + i) for i in range(1, 40)])
    check(spark, [(rng.randrange(120), rng.randrange(120)) for _ in range(90)])
    check(spark, [(3, 3), (4, 5)])


def test_no_links(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_a_star_are_met_about_once(spark, monkeypatch):
    met = []

    def counted(df, name, real=components.written):
        out = real(df, name)
        if name == "edges":
            met.append(out.count())
        return out

    monkeypatch.setattr(components, "written", counted)
    links = [(x, 5000) for x in range(5000 - 100, 5100) if x != 5000]
    connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert sum(met) <= 1.75 * len(links)
