import statistics

import numpy as np
import pytest

from quadloom.operators import setsketch as S

RNG = np.random.default_rng(3)


def ids(n):
    return RNG.integers(-(2**63), 2**63 - 1, n)


def sketch(h, c=S.Config()):
    s = S.Sketch(c)
    s.add_hashes(h)
    return s


@pytest.mark.parametrize("config", [S.Config(), S.Config(m=256, b=1.2), S.Config(m=256, b=2.0, q=62)])
def test_error_is_as_stated(config):
    for n in (2000, 30_000):
        errors = [sketch(ids(n), config).count()[0] / n - 1 for _ in range(30)]
        assert statistics.pstdev(errors) < 1.6 * config.error
        assert abs(statistics.mean(errors)) < config.error


def test_small_sets_are_exact_and_repeats_do_nothing():
    h = ids(200)
    s = sketch(np.concatenate([h, h, h]))
    assert s.count() == (200.0, 0.0)
    assert S.Sketch.load(S.Config(), s.dump()).count() == (200.0, 0.0)
    assert S.Sketch(S.Config()).count() == (0.0, 0.0)


def test_merge_is_the_sketch_of_the_union():
    h = ids(5000)
    a, b, whole = sketch(h[:3000]), sketch(h[2000:]), sketch(h)
    a.merge(b)
    assert (a.reg == whole.reg).all()
    tiny = sketch(h[:50])
    tiny.merge(S.Sketch.load(S.Config(), b.dump()))
    assert (tiny.registers() == sketch(np.concatenate([h[:50], h[2000:]])).registers()).all()


def test_joint_estimate():
    for j in (0.05, 0.4, 0.9):
        got = []
        for _ in range(15):
            u, k = ids(10_000), int(20_000 * j / (1 + j))
            got.append(S.joint(sketch(u), sketch(np.concatenate([u[:k], ids(10_000 - k)]))))
        assert abs(statistics.mean(x["jaccard"] for x in got) - j) < 0.03
        assert statistics.pstdev(x["jaccard"] for x in got) < 2.5 * got[0]["jaccard_error"] + 1e-3
    a, b = sketch(ids(100)), sketch(ids(100))
    b.merge(a)
    assert S.joint(a, b)["intersection"] == 100.0 and S.joint(a, S.Sketch(S.Config()))["jaccard"] == 0.0


def test_distributed_groups_against_exact_counts(spark):
    data = [("hot" if i % 3 == 0 else f"k{i % 11}", None if i % 7 == 0 else f"g{i % 2}", None if i % 50 == 0 else (i * 7919) % 5000) for i in range(20_000)]
    df = spark.createDataFrame(data, "a string, b string, x long").selectExpr("a", "b", "CASE WHEN x IS NOT NULL THEN xxhash64(x) END AS h", "1 AS sketch").repartition(6)
    parts = S.partials(df, ["a", "b"], "h")
    finest = S.merge(parts, salts=3)
    got = {(r.gset, r.a, r.b): r for r in S.estimates(S.roll_up(finest, ["a", "b"])).collect()}
    want = {}
    for a, b, x in data:
        if x is not None:
            for k in ((0, a, b), (1, None, b), (2, a, None), (3, None, None)):
                want.setdefault(k, set()).add(x)
    assert set(got) == set(want)
    for k, xs in want.items():
        r = got[k]
        assert r.estimate == len(xs) if r.rel_error == 0 else abs(r.estimate / len(xs) - 1) < 5 * r.rel_error
    assert S.estimates(S.merge(S.partials(df.limit(0), ["a", "b"], "h"))).count() == 0


def test_later_rows_merge(spark):
    df = spark.range(3000).selectExpr("id % 3 AS g", "xxhash64(id) AS h")
    first, late = df.where("h % 2 = 0"), df.where("h % 2 <> 0")
    both = S.merge(S.merge(S.partials(first, ["g"], "h")).union(S.partials(late, ["g"], "h")))
    assert {r.g: bytes(r.sketch) for r in both.collect()} == {r.g: bytes(r.sketch) for r in S.merge(S.partials(df, ["g"], "h")).collect()}


def test_joints_table(spark):
    df = spark.range(2000).selectExpr("1 AS g", "xxhash64(id) AS h")
    s = S.merge(S.partials(df, ["g"], "h")).selectExpr("sketch AS l", "sketch AS r").union(spark.sql("SELECT CAST(NULL AS BINARY), CAST(NULL AS BINARY)"))
    got = sorted((round(r.jaccard, 3), r.n_union) for r in S.joints(s, "l", "r").collect())
    assert got[0] == (0.0, 0.0) and got[1][0] > 0.99


def test_errors_of_union_and_intersection_hold():
    import numpy as np

    rnd, c = np.random.default_rng(5), S.Config()
    far = {"union": 0, "intersection": 0}
    for i in range(40):
        both, only = rnd.integers(0, 2**62, 4000), rnd.integers(0, 2**62, (2, 3000))
        u, v = S.Sketch(c), S.Sketch(c)
        u.add_hashes(np.concatenate([both, only[0]]))
        v.add_hashes(np.concatenate([both, only[1]]))
        got = S.joint(u, v)
        for name, true in (("union", 10_000), ("intersection", 4000)):
            assert 0 < got[f"{name}_error"] < 0.15 * true
            far[name] += abs(got[name] - true) > 2 * got[f"{name}_error"]
    assert max(far.values()) <= 6
