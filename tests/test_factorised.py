"""Operators that avoid listing or sorting what they add up, against the plain way."""

import random
from collections import Counter, defaultdict

import pytest

from factloom.operators import docmodel as dm
from factloom.operators import postproc as pp
from factloom.operators import repair as rp


def test_pair_sums_equal_the_listed_graph(spark):
    rng = random.Random(6)
    pairs = {(d, h, t) for d in range(3) for h in range(6) for t in range(6) if h != t and rng.random() < (1, 0.4, 0.1)[d]}
    value = {p: rng.randrange(-3, 9) for p in pairs}
    df = spark.createDataFrame([(*p, v if v else None) for p, v in value.items()], "doc long, h int, t int, v long")
    want = defaultdict(Counter)
    for directed in (False, True):
        for r in dm.pair_graph(df, directed).collect():
            if not directed or r["edge_type"] in ("succ", "pred"):
                want[r["doc"], r["h1"], r["t1"]][r["edge_type"], "n"] += 1
                want[r["doc"], r["h1"], r["t1"]][r["edge_type"], "v"] += value[r["doc"], r["h2"], r["t2"]]
    got = dm.pair_neighbour_sums(df, ["v"]).collect()
    assert {(r["doc"], r["h"], r["t"]) for r in got} == pairs and len(got) == len(pairs)
    for r in got:
        for kind in ("same_head", "same_tail", "succ", "pred", "bridge"):
            for v in ("n", "v"):
                assert r[f"{kind}_{v}"] == want[r["doc"], r["h"], r["t"]][kind, v], (r, kind, v)
    assert dm.pair_neighbour_sums(df.limit(0), ["v"]).collect() == []


@pytest.mark.parametrize("budget", [0, 1, 7, 20, 21, 45, 10_000])
def test_packs_are_asked_up_to_the_budget(spark, budget):
    rng = random.Random(2)
    rows = [(d, h, t, c, rng.choice([-0.6, -0.25, -0.1, 0.0, 0.1, 0.25, 0.25, 0.3])) for d in range(12) for h in range(4) for t in range(3) for c in (1, 2) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "doc long, h int, t int, class_id int, margin double")
    packs = []
    for d in range(12):
        near = sorted((r for r in rows if r[0] == d and abs(r[4]) < 0.5), key=lambda r: (abs(r[4]), *r[1:4]))
        packs += [(abs(near[i][4]), d, i // 5, near[i:i + 5]) for i in range(0, len(near), 5)]
    packs.sort(key=lambda p: p[:3])
    want = {(*r, p[2], i, k < budget) for k, p in enumerate(packs) for i, r in enumerate(p[3])}
    got = pp.uncertain_packs(df, 0.5, budget, per_pack=5).collect()
    assert {(r["doc"], r["h"], r["t"], r["class_id"], r["margin"], r["pack"], r["place"], r["asked"]) for r in got} == want and len(got) == len(want)


def test_value_over_narrows_to_the_exact_one(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.random(), 0.5, 1e-300, 1e9, -3.0]) for _ in range(700)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i long")
    for budget in (1, 2, 150, 350, 699, 700):
        value, below = pp.first_value_over(df, "v", budget, bins=4)
        assert value == sorted(values)[budget - 1] and below == sum(x < value for x in values)
    assert pp.first_value_over(df, "i", 250, bins=3) == (249, 249)
    assert pp.first_value_over(df, "v", 701) is None and pp.first_value_over(df.limit(0), "v", 1) is None


@pytest.mark.parametrize("hub", [1, 3, 1000])
def test_open_triangles_split_hubs(spark, hub):
    rng = random.Random(9)
    rows = {(f"n{rng.randrange(12)}", rng.choice("FSC"), f"n{rng.choice([0, 0, 0, *range(12)])}") for _ in range(160)}
    df = spark.createDataFrame(sorted(rows), "head_id string, relation_type string, tail_id string")
    want = {(a, b, c) for a, k, b in rows if k == "F" for x, j, c in rows if j == "S" and x == b and a != c and (a, "C", c) not in rows}
    got = rp.open_triangles(df, "F", "S", "C", hub).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
