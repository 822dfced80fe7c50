import random

from plumbline.operators.hierarchy import descendants, hierarchy, parents
from plumbline.session import cut


def brute(links):
    up = {}
    nodes = set()
    for c, p in links:
        nodes |= {c, p} - {None}
        if c is not None and p is not None:
            up[c] = min(up.get(c, p), p)
    out = {}
    reach = {v: set() for v in nodes}
    for v in nodes:
        path, x = [v], v
        while x in up and up[x] not in path:
            x = up[x]
            path.append(x)
        for y in path[1:]:
            reach[y].add(v)
        if x in up:
            cyc = path[path.index(up[x]) :]
            kind = "cycle" if v in cyc else "below_cycle"
            for y in cyc:
                reach[y].add(v)
            out[v] = (kind, "", -1, "")
        else:
            out[v] = ("tree", path[-1], len(path) - 1, " > ".join(reversed(path)))
    return {v: (*out[v], len(reach[v] - {v})) for v in nodes}


def run(spark, links):
    df = spark.createDataFrame(links, "c string, p string")
    h = cut(hierarchy(df, "c", "p"))
    pairs = [(r.node, r.descendant) for r in descendants(h).collect()]
    assert len(pairs) == len(set(pairs))
    rows = h.collect()
    for r in rows:
        below = {d for n, d in pairs if n == r.node}
        assert len(below) == r.n_descendants
        if r.node_kind == "tree":
            assert below == {x.node for x in rows if x.tour == r.tour and r.entry < x.entry and x.exit < r.exit}
    return {r.node: (r.node_kind, r.root_name, r.depth, r.path, r.n_descendants) for r in rows}


def test_forest_cycles_chain_and_star(spark):
    rng = random.Random(5)
    links = [(f"n{i}", f"n{rng.randrange(max(1, i))}") for i in range(1, 60)]
    links += [(f"d{i + 1}", f"d{i}") for i in range(37)]  # a deep chain
    links += [(f"s{i}", "star") for i in range(40)]
    links += [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("w2", "w"), ("self", "self"), ("under", "self")]
    links += links[:7]
    assert run(spark, links) == brute(links)


def test_null_ends_empty_and_no_cycles(spark):
    assert run(spark, []) == {}
    links = [("a", None), (None, "b"), ("c", "b"), (None, None)]
    assert run(spark, links) == brute(links)


def test_only_cycles(spark):
    links = [("a", "b"), ("b", "a"), ("c", "c")]
    assert run(spark, links) == brute(links)


def test_several_parents_are_listed(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "b"), ("c", "b"), ("d", None)], "c string, p string")
    assert sorted(tuple(r) for r in parents(df, "c", "p").collect()) == [("b", "a", True), ("c", "a", True), ("c", "b", False)]
