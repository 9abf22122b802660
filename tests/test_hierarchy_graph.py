import random

import pytest

from clauseflow.operators.graph import propagate_min
from clauseflow.operators.hierarchy import descendants, hierarchy, roots_and_depths


def _expected(rows):
    par = {}
    for i, p in rows:
        if i is not None:
            p = p if p is not None and p.strip() else None
            par[i] = min(x for x in (par.get(i), p) if x is not None) if (par.get(i) or p) else None
    par = {i: (p if p in par else None) for i, p in par.items()}
    out = {}
    for i in par:
        chain, x = [], i
        while x is not None and x not in chain:
            chain.append(x)
            x = par[x]
        out[i] = (chain[-1], len(chain) - 1, tuple(reversed(chain))) if x is None else (min(chain[chain.index(x) :]), -1, None)
    return par, out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forest(spark, seed):
    r = random.Random(seed)
    ids = [f"n{k:03d}" for k in range(160)]
    rows = [(i, r.choice([None, "", "  ", "nowhere", *ids[: k + 1]])) for k, i in enumerate(ids)]
    rows += [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(30)] + [("c30", None)]  # a chain
    rows += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "x2"), ("z", "y"), ("self", "self"), ("under", "self")]
    rows += [rows[3], rows[3], (None, "n001"), (None, None)]
    df = spark.createDataFrame([(*x, 1, "n") for x in rows], "id string, parent string, depth int, n string")
    got = hierarchy(df).collect()
    par, want = _expected(rows)
    assert len(got) == len(par)
    assert {x.unit_id: (x.root_id, x.depth, tuple(x.path) if x.path is not None else None) for x in got} == want
    below = {i: sum(i in (p or ()) for _, _, p in want.values()) for i in want}
    assert all(x.subtree_size == below[x.unit_id] for x in got if x.depth >= 0)
    assert {x.unit_id for x in got if x.on_circle} == {"x1", "x2", "x3", "self"} | {i for i, (root, d, _) in want.items() if d < 0 and i.startswith("n") and par[i] and _on_circle(par, i)}
    pairs = {(x.ancestor_id, x.unit_id, x.distance) for x in descendants(hierarchy(df)).collect()}
    assert pairs == {(a, i, len(p) - 1 - k) for i, (_, _, p) in want.items() if p for k, a in enumerate(p[:-1])}


def _on_circle(par, i):
    x = par[i]
    for _ in range(len(par)):
        if x == i:
            return True
        x = par.get(x)
    return False


def test_hub_and_nothing(spark):
    df = spark.createDataFrame([("hub", None)] + [(f"k{n}", "hub") for n in range(300)], "id string, parent string")
    got = {x.unit_id: (x.root_id, x.depth, x.subtree_size) for x in hierarchy(df).collect()}
    assert got["hub"] == ("hub", 0, 301) and got["k7"] == ("hub", 1, 1)
    assert hierarchy(df.limit(0)).count() == 0
    only = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string")
    assert {(x.unit_id, x.root_id, x.depth) for x in hierarchy(only).collect()} == {("a", "a", -1), ("b", "a", -1)}


def test_propagate_min(spark):
    r = random.Random(3)
    edges = [(f"a{r.randrange(60):02d}", f"a{r.randrange(60):02d}") for _ in range(45)] + [(f"l{k:02d}", f"l{k + 1:02d}") for k in range(40)] + [("h", f"s{k}") for k in range(50)] + [("p", "p"), (None, "q"), ("q", None)]
    f = {}

    def find(x):
        while f.setdefault(x, x) != x:
            x = f[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            f[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "u string, v string")
    got = propagate_min(df).collect()
    assert len(got) == len({x.node for x in got})
    assert {x.node: x.label for x in got} == {x: find(x) for x in f}
    assert propagate_min(df.limit(0)).count() == 0


def _walked(rows):
    parent = {}
    for i, p in rows:
        if i is not None:
            parent[i] = min(filter(None, [parent.get(i), p if p and p.strip() else None]), default=None)
    out = {}
    for i in parent:
        seen, at = [], i
        while at in parent and parent[at] in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in seen:
            out[i] = (min(seen[seen.index(at) :]), -1)
        else:
            out[i] = (at, len(seen))
    return out


def test_roots_and_depths_of_random_forests(spark):
    r = random.Random(12)
    for n in (1, 2, 40, 40):
        rows = [(f"n{k:03d}", r.choice([None, "", "zz", *[f"n{r.randrange(max(1, k - r.choice((1, 3, 60)))):03d}"] * 5, f"n{r.randrange(n):03d}"])) for k in range(n)]
        rows += [(rows[0][0], rows[0][1]), (None, "n000")]
        df = spark.createDataFrame([(i, p, "x") for i, p in rows], "id string, parent string, root_id string")
        assert {x.unit_id: (x.root_id, x.depth) for x in roots_and_depths(df, rounds=2).collect()} == _walked(rows)
    assert roots_and_depths(df.limit(0)).count() == 0


def test_roots_and_depths_of_long_chains_and_circles(spark):
    n = 500
    chain = [(f"c{k:05d}", f"c{k - 1:05d}" if k else None) for k in range(n)]  # with a leaf at every node: a caterpillar
    leaves = [(f"l{k:05d}", f"c{k:05d}") for k in range(0, n, 2)]
    ring = [(f"r{k:04d}", f"r{(k + 1) % 150:04d}") for k in range(150)] + [("h0", "r0005"), ("h1", "h0"), ("h2", "h1"), ("h3", "r0100"), ("self", "self"), ("under", "self")]
    rows = chain + leaves + ring
    df = spark.createDataFrame(rows, "id string, parent string")
    got = {x.unit_id: (x.root_id, x.depth) for x in roots_and_depths(df).collect()}
    assert got == _walked(rows)
