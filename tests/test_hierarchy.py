import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import hierarchy as H

SCHEMA = "id string, up string, node string, parent string, doc int"


def table(spark, rows):
    return spark.createDataFrame([(a, b, "n", "p", i % 3) for i, (a, b) in enumerate(rows)], SCHEMA)


def brute(rows):
    par = {}
    for a, b in rows:
        a, b = (a or "").strip(), (b or "").strip() or None
        if a:
            par[a] = b if a not in par else min((x for x in (par[a], b) if x), default=None)
    out = {}
    for x in par:
        chain, y = [], x
        while True:
            if y not in par:
                out[x] = ("missing", y, None, None)
                break
            if y in chain:
                out[x] = ("cycle", min(chain[chain.index(y) :]), None, None)
                break
            chain.append(y)
            if par[y] is None:
                out[x] = ("root", y, len(chain) - 1, "/".join(reversed(chain)))
                break
            y = par[y]
    return out


def check(spark, rows, **kw):
    want = brute(rows)
    h = H.hierarchy(table(spark, rows), "id", "up", **kw).collect()
    assert {r.node: (r.end_kind, r.end_id, r.depth, "/".join(r.path) if r.path else None) for r in h} == want
    below = {r.node: r.descendants for r in h if r.path}
    for k, v in below.items():
        assert v == sum(1 for w in want.values() if w[3] and k in w[3].split("/")) - 1


SMALL = [
    ("a", None), ("b", " a "), ("c", "b"), ("d", ""), ("e", "nowhere"), ("f", "e"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("s", "s"), (" c", "b"), ("g", "  "), (None, "a"), ("", "a"), ("v", "w"),
]


def test_small_cases(spark):
    check(spark, SMALL)


def test_unreachable(spark):
    bad = H.unreachable(table(spark, SMALL), "id", "up").collect()
    assert {(r.node, r.end_id) for r in bad} == {(k, v[1]) for k, v in brute(SMALL).items() if v[0] != "root"}


MIXED = [*SMALL, *((f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(40)), *((f"r{i:03}", f"r{(i + 1) % 30:03}") for i in range(30)), ("t", "n039"), ("u", "r003")]


@pytest.mark.parametrize("levels", [1, 3])
def test_boundary_links_merge_in_a_tree_of_tasks(spark, levels):
    check(spark, MIXED, locality=[F.xxhash64("id"), F.substring("id", 1, 3), F.substring("id", 1, 2)][:levels])


@pytest.mark.parametrize(("n", "step"), [(100_000, 4096), (1000, None)])
def test_a_long_chain(spark, n, step):
    """No path is built. With a locality few links cross tasks, without one nearly all."""
    x = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("up"))
    near = [F.floor(F.col("id").cast("long") / k) for k in (step, 16 * step)] if step else []
    bad = H.measures(x, "id", "up", near).where(f"not (root = '0' and depth = cast(node as long) and descendants = {n - 1} - cast(node as long) and end_kind = 'root')")
    assert bad.count() == 0


def test_forest_against_walking():
    r = random.Random(3)
    for _ in range(200):
        n = r.randrange(1, 12)
        to = [r.randrange(-1, n) for _ in range(n)]
        f = H.Forest([1] * n, list(range(n)))
        for i in r.sample(range(n), n):
            if to[i] >= 0:
                f.link(i, to[i])
        for i in range(n):
            way, x = [i], i
            while to[x] >= 0 and to[x] not in way:
                x = to[x]
                way.append(x)
            t = f.find(i)
            if to[x] >= 0:
                assert f.cycle[t] == min(way[way.index(to[x]) :])
            else:
                assert t == x and t not in f.cycle and (i == x or (f.hops[i], f.low[i]) == (len(way) - 1, min(way[:-1])))


def test_random_forest(spark):
    r = random.Random(1)
    rows = [(f"k{i}", None if r.random() < 0.05 else f"k{r.randrange(130)}") for i in range(120)]
    check(spark, rows, locality=[F.substring("id", -1, 1), F.lit(1)])


def test_closure(spark):
    h = H.hierarchy(table(spark, SMALL), "id", "up")
    got = {(r.ancestor, r.node, r.distance) for r in H.descendants(h).collect()}
    assert ("a", "c", 2) in got and ("b", "c", 1) in got and ("c", "c", 0) in got and not any(a == "x" for a, _, _ in got)


def test_empty(spark):
    assert H.hierarchy(table(spark, SMALL).where("false"), "id", "up").count() == 0
    assert H.unreachable(table(spark, SMALL).where("false"), "id", "up").count() == 0
