"""Hierarchies from links (p3)."""

import random

import pytest

from skyloom.operators.hierarchy import BLOCK_ROWS, Forest, chase, contained, dense_index
from skyloom.storage import Scratch


def forest(spark, nodes, links, block=BLOCK_ROWS):
    n = spark.createDataFrame([(x, 1) for x in nodes], "hierarchy_node_key string, id int")
    e = spark.createDataFrame([(p, c, 0) for p, c in links], "p string, c string, key int")
    return Forest(n, e, "hierarchy_node_key", "p", "c", block)


def brute(nodes, links):
    keys = {n for n in nodes if n is not None}
    parents, children = {}, {}
    for p, c in {(p, c) for p, c in links if p in keys and c in keys}:
        parents.setdefault(c, set()).add(p)
        children.setdefault(p, set()).add(c)
    waiting = {k: len(parents.get(k, ())) for k in keys}
    todo = [k for k in keys if not waiting[k]]
    out = {k: (k, 0, k) for k in todo}
    while todo:
        k = todo.pop()
        for c in children.get(k, ()):
            waiting[c] -= 1
            if not waiting[c]:
                up = out[min(parents[c])]
                out[c] = (up[0], up[1] + 1, f"{up[2]}/{c}")
                todo.append(c)
    return {k: out.get(k, ("", -1, None)) for k in keys}


def check(spark, nodes, links, full=True, block=BLOCK_ROWS):
    f = forest(spark, nodes, links, block)
    want = brute(nodes, links)
    got = f.places.collect()
    assert sorted((r["key"], r["root"], r["depth"]) for r in got) == sorted((k, v[0], v[1]) for k, v in want.items())
    if not full:
        return
    assert {r["key"]: r["path"] for r in f.paths().collect()} == {k: v[2] for k, v in want.items()}
    good = [r for r in got if r["depth"] >= 0]
    inside = {}
    for a in good:
        inside[a["key"]] = sum(b["root"] == a["root"] and a["entry"] < b["entry"] < a["exit"] for b in good)
    below = {k: sum(v[2] is not None and v[2].startswith(want[k][2] + "/") for v in want.values()) for k in inside}
    assert inside == below
    assert {r["key"]: r["descendants"] for r in f.descendants().collect() if r["depth"] >= 0} == below
    parent = {v[2].rsplit("/", 1)[0] for v in want.values() if v[2] and "/" in v[2]}
    leaves = {k: sum(v[2] is not None and v[2] not in parent and (v[2] + "/").startswith(want[k][2] + "/") for v in want.values()) for k in inside}
    assert {r["key"]: r["n_leaves"] for r in good} == leaves
    asked = sorted(want)[::5]
    keys = spark.createDataFrame([(k,) for k in [*asked, None, "unknown"]], "k string")
    pairs = {(a, k, v[1]) for a in asked if want[a][2] for k, v in want.items() if v[2] and v[2].startswith(want[a][2] + "/")}
    got = f.descendants_of(keys).collect()
    assert {(r["key"], r["descendant"], r["depth"]) for r in got} == pairs and len(got) == len(pairs)
    above = {(k, a, i) for k in asked if want[k][2] for i, a in enumerate(want[k][2].split("/")[:-1])}
    got = f.ancestors_of(keys).collect()
    assert {(r["key"], r["ancestor"], r["depth"]) for r in got} == above and len(got) == len(above)


def test_small_cases(spark):
    nodes = ["r", "a", "b", "c", "x", "y", "z", "w", "s", "lone", "d1", None, "r", "u", "v"]
    links = [("r", "a"), ("a", "b"), ("a", "b"), ("r", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("s", "s"), ("s", "w"), ("r", "x"), ("gone", "d1"), (None, "a"), ("a", None), ("u", "v"), ("r", "v")]
    check(spark, nodes, links)


def test_deep_and_wide(spark):
    nodes = [f"n{i:04d}" for i in range(600)]
    links = [(nodes[i], nodes[i + 1]) for i in range(150)] + [(nodes[0], nodes[i]) for i in range(151, 500)] + [(nodes[500 + i], nodes[500 + (i + 1) % 90]) for i in range(90)] + [(nodes[510], nodes[595])]
    check(spark, nodes, links)
    check(spark, nodes, links, full=False, block=0)  # shuffle rounds to the end


def test_random_graph_with_cycles_and_several_parents(spark):
    rng = random.Random(4)
    nodes = [f"k{i}" for i in range(120)]
    links = [(f"k{rng.randrange(i)}", f"k{i}") for i in range(1, 100)] + [(f"k{rng.randrange(120)}", f"k{rng.randrange(120)}") for _ in range(12)]
    check(spark, nodes, links, full=False)


@pytest.mark.parametrize("nodes,links", [([], []), (["a"], []), ([], [("a", "b")]), (["a", "b"], [("a", "a"), ("b", "b")]), (["a", "b"], [("a", "b"), ("b", "a")])])
def test_edge_cases(spark, nodes, links):
    check(spark, nodes, links, full=False)


@pytest.mark.parametrize("block", [0, 3, 1000])
def test_chase(spark, block):
    rng = random.Random(block)
    nxt = {i: rng.choice([None, None, *range(i)]) if i else None for i in range(60)} | {100: 101, 101: 102, 102: 100, 103: 101}
    weight = {i: rng.randrange(9) for i in nxt}
    df = spark.createDataFrame([(i, n, weight[i]) for i, n in nxt.items()], "e long, nxt long, w int")
    want = set()
    for i in nxt:
        seen, total, k = set(), 0, i
        while k is not None and k not in seen:
            seen.add(k)
            total, last, k = total + weight[k], k, nxt[k]
        want.add((i, None, None) if k is not None else (i, last, total))
    got = chase(Scratch(spark, "t"), df, ["w"], block).collect()
    assert {(r["e"], r["tail"], None if r["tail"] is None else r["w"]) for r in got} == want and len(got) == len(nxt)


def test_contained(spark):
    rng = random.Random(9)
    spans = [("t", i, *sorted(rng.sample(range(5000), 2))) for i in range(60)] + [("t", 99, 7, 8), ("u", 98, 0, 70000), ("empty", 97, 0, 9)]
    points = [("t", rng.randrange(5000)) for _ in range(200)] + [("u", 69999), ("u", 70000), ("u", 0), ("other", 3)]
    p = spark.createDataFrame(points, "t string, at long").distinct()
    got = contained(p, spark.createDataFrame(spans, "t string, id int, low long, high long"), "t", "at", "low", "high").collect()
    want = {(t, i, at) for t, i, low, high in spans for u, at in set(points) if t == u and low < at < high}
    assert {(r["t"], r["id"], r["at"]) for r in got} == want and len(got) == len(want)


def test_dense_index(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(1000)], "a int, b int").repartition(5)
    got = dense_index(Scratch(spark, "t"), df, "a", "b").orderBy("g").collect()
    assert [r["g"] for r in got] == list(range(1000)) and [(r["a"], r["b"]) for r in got] == sorted((i % 7, i) for i in range(1000))
