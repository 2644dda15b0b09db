import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.operators import hierarchy as H

LINKS = "child string, parent string"


def brute(links):
    par = {}
    for a, b in links:
        if a is not None and b is not None and (a not in par or b < par[a]):
            par[a] = b
    out = {}
    for n in set(par) | set(par.values()):
        seen, x = [], n
        while x in par and x not in seen:
            seen.append(x)
            x = par[x]
        out[n] = (min(seen[seen.index(x) :]), -1) if x in par else (x, len(seen))
    return out, par


def path(par, n):
    out = [n]
    while out[0] in par:
        out.insert(0, par[out[0]])
    return out


def check(h, links):
    want, par = brute(links)
    assert {r.node: (r.root, r.depth) for r in h.found().collect()} == want
    rows = h.paths().collect()
    assert all(r.path == " > ".join(path(par, r.node)) for r in rows if r.depth >= 0)
    assert all(r.path is None for r in rows if r.depth < 0)
    below = {}
    for n, (_, d) in want.items():
        if d >= 0:
            for a in path(par, n)[:-1]:
                below.setdefault(a, set()).add(n)
    got = {}
    for r in h.descendants().collect():
        got.setdefault(r.node, set()).add(r.descendant)
        assert r.distance == want[r.descendant][1] - want[r.node][1]
    assert got == below
    place = {r.node: (r.root, r.lft, r.n_descendants) for r in rows if r.depth >= 0}
    for n, (root, lft, size) in place.items():
        assert {m for m, (r, x, _) in place.items() if r == root and lft < x <= lft + size} == below.get(n, set())


def test_long_chain_star_and_circles(spark, ws):
    rnd = random.Random(1)
    links = [(f"n{i}", f"n{i - 1}") for i in range(1, 70)] + [(f"m{i}", f"m{(i + 1) % 7}") for i in range(7)] + [("t1", "m3"), ("t2", "t1"), ("self", "self"), ("u", "self")]
    links += [(f"s{i}", "n5") for i in range(60)] + [(f"k{i}", f"k{rnd.randrange(i)}" if i else "n1") for i in range(80)]
    check(H.build(spark.createDataFrame(links, LINKS), ws), links)


def test_nulls_repeats_two_parents_and_extra_columns(spark, ws):
    links = [("a", "r"), ("a", "r"), ("a", "z"), (None, "r"), ("b", None), (None, None), ("c", "a"), ("", "c")]
    df = spark.createDataFrame([(*x, 1, "q") for x in links], LINKS + ", id int, chain string")
    h = H.build(df, ws)
    check(h, links)
    assert {r.node: r.n_parents for r in h.nodes.collect()}["a"] == 2


def test_empty(spark, ws):
    h = H.build(spark.createDataFrame([], LINKS), ws)
    assert h.found().count() == h.paths().count() == h.descendants().count() == 0


def test_links_of_statements(spark):
    t = "struct<k:tinyint,v:string,dt:string,lang:string>"
    term = lambda v, k=1: (k, v, None, None)
    rows = [(term("a"), H.NS + "within", term("b")), (term("b"), H.NS + "contains", term("c", 0)), (term("x"), H.NS + "within", term("lit", 2)), (term("x"), H.NS + "near", term("y")), (None, H.NS + "within", term("b")), (term("q"), H.NS + "partOf", None)]
    got = H.links_of(spark.createDataFrame(rows, f"s {t}, p string, o {t}")).collect()
    assert {tuple(r) for r in got} == {("a", "b"), ("c", "b")}


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), min_size=1, max_size=10))
def test_any_small_graph(spark, ws, links):
    h = H.build(spark.createDataFrame(links, LINKS), ws)
    assert {r.node: (r.root, r.depth) for r in h.found().collect()} == brute(links)[0]


def check_circled(spark, ws, links):
    want, par = brute(links)
    c = H.circled(H.build(spark.createDataFrame(links, LINKS), ws), ws)
    pairs, on, ways = {}, set(), {}
    for n, (root, d) in want.items():
        if d < 0:
            way = [n]
            while par[way[-1]] not in way:
                way.append(par[way[-1]])
            on |= {n} if par[way[-1]] == n else set()
            pairs |= {(a, n): i for i, a in enumerate(way) if i}
            ways[n] = " > ".join(reversed(way[: way.index(root) + 1]))
    got = [tuple(r) for r in c.descendants().collect()]
    assert {(a, n): i for a, n, i in got} == pairs and len(got) == len(pairs)
    rows = c.paths().collect()
    assert len(rows) == len(ways) and {r.node: r.path for r in rows} == ways
    for r in rows:
        assert (r.parent, r.root, r.on_circle) == (par[r.node], want[r.node][0], r.node in on)
        assert r.steps == ways[r.node].count(" > ") and r.n_descendants == sum(a == r.node for a, _ in pairs)


def test_below_and_on_circles(spark, ws):
    links = [(f"m{i}", f"m{(i + 1) % 7}") for i in range(7)] + [("t1", "m3"), ("t2", "t1"), ("t3", "t1"), ("v", "m0"), ("self", "self"), ("u", "self"), ("lone", "lone"), ("b", "a")]
    links += [(f"x{i}", f"x{i - 1}" if i else "t2") for i in range(20)]
    check_circled(spark, ws, links)
    check_circled(spark, ws, [("b", "a")])


def test_results_come_from_chains_and_intervals(spark, ws, monkeypatch):
    links = [("b", "a"), ("c", "b"), ("d", "b"), ("e", "d"), ("f", "a"), ("y", "x"), ("o", "o")] + [(f"k{i}", f"k{i - 1}" if i else "c") for i in range(9)]
    monkeypatch.setattr(H, "PIECE", 4, raising=False)
    h = H.build(spark.createDataFrame(links, LINKS), ws)
    check(h, links)
    want = brute(links)[0]
    doubled = H.Hierarchy(h.nodes.selectExpr("* EXCEPT (root, depth)", "if(depth < 0, root, NULL) AS root", "least(depth, 0) AS depth"), h.chains)
    assert {r.node: (r.root, r.depth) for r in doubled.found().collect()} == want
    unchained = H.Hierarchy(h.nodes.withColumns({"chain": F.lit(None).cast("long"), "pos": F.lit(None).cast("long")}), h.chains.limit(0))
    assert sorted(map(tuple, unchained.descendants().collect())) == sorted(map(tuple, h.descendants().collect()))
    assert h.descendants().count() > 0
