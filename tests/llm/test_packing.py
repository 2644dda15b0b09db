import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.llm import packing as P


def check_plan(hist, capacity):
    packs = P.plan(dict(hist), capacity)
    got = {}
    for lengths, times in packs:
        assert sum(lengths) <= capacity and times > 0
        for n in lengths:
            got[n] = got.get(n, 0) + times
    assert got == {n: c for n, c in hist.items() if c}
    return sum(t for _, t in packs)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.dictionaries(st.integers(1, 300), st.integers(0, 50), max_size=40))
def test_plan_holds_every_item_once(capacity, hist):
    hist = {n: c for n, c in hist.items() if n <= capacity}
    used = check_plan(hist, capacity)
    total = sum(n * c for n, c in hist.items())
    large = sum(c for n, c in hist.items() if 2 * n > capacity)
    assert max(-(-total // capacity), large) <= used <= max(2 * -(-total // capacity), large + 1, 1) or not total


@pytest.mark.parametrize("capacity, least_fill", [(512, 0.99), (2048, 0.99), (8192, 0.99)])
def test_little_space_is_unused(capacity, least_fill):
    rnd = random.Random(4)
    hist = {}
    for _ in range(50_000):
        n = int(min(capacity, max(1, rnd.lognormvariate(6, 1))))
        hist[n] = hist.get(n, 0) + 1
    used = check_plan(hist, capacity)
    large = sum(c for n, c in hist.items() if 2 * n > capacity)
    best = max(-(-sum(n * c for n, c in hist.items()) // capacity), large)
    assert best / used >= least_fill


def test_the_plan_does_not_grow_with_the_documents():
    rng = np.random.default_rng(0)
    rows = []
    for n in (10**6, 4 * 10**6):
        k, c = np.unique(np.minimum(2048, np.maximum(1, rng.lognormal(6, 1, n).astype(int))), return_counts=True)
        rows.append(len(P.slots(P.plan(dict(zip(k.tolist(), c.tolist())), 2048), 0)))
    assert rows[1] < 1.1 * rows[0] < 40_000


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(0)
    for _ in range(10):
        a, b = rng.random((12, 20)), rng.random(12) * 5
        x = P.nnls(a, b)
        y = np.zeros(20)
        step = 1 / np.linalg.norm(a.T @ a, 2)
        for _ in range(20_000):
            y = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-4


def test_bad_lengths():
    with pytest.raises(ValueError):
        P.plan({0: 1}, 5)
    with pytest.raises(ValueError):
        P.plan({6: 1}, 5)


@pytest.mark.parametrize("most", [10**6, 0])
def test_documents_are_whole_and_split_only_beyond_the_capacity(spark, ws, monkeypatch, most):
    monkeypatch.setattr(P, "BROADCAST_SLOTS", most)
    rnd = random.Random(9)
    docs = [(i if i % 50 else 7, rnd.choice([0, None, 3, 10, 11, 99, 100, 101, 200, 1003, rnd.randrange(1, 400)])) for i in range(600)]
    counts = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, n_tokens int, cap string")
    caps = spark.createDataFrame([("a", 10, 1), ("b", 100, 1), ("b", 100, 1), (None, 5, 1), ("c", None, 1), ("d", 0, 1)], "capacity_id string, max_tokens int, slot int")
    packed = P.pack(counts, caps, ws).cache()
    rows = packed.collect()
    for cap, size in (("a", 10), ("b", 100)):
        mine = [r for r in rows if r.capacity_id == cap]
        assert sum(r.n_tokens for r in mine) == sum(n or 0 for _, n in docs)
        by = {}
        for r in mine:
            by.setdefault(r.container, []).append(r)
        assert sorted(by) == list(range(len(by)))
        for rs in by.values():
            at = 0
            for r in sorted(rs, key=lambda r: r.pos):
                assert r.pos == at
                at += r.n_tokens
            assert at <= size
        assert sorted(r.token_from for r in mine if r.n_tokens < size and r.token_from) == sorted(n // size * size for _, n in docs if n and n > size and n % size)
        assert sum(1 for r in mine if r.n_tokens == size) == sum((n or 0) // size for _, n in docs)
    got = {r.capacity_id: r for r in P.summary(packed, caps).collect()}
    assert set(got) == {"a", "b"} and got["b"].n_containers >= got["b"].least and 0.95 < got["b"].fill <= 1
    assert P.pack(counts.limit(0), caps, ws).count() == 0 and P.pack(counts, caps.limit(0), ws).count() == 0


def test_token_counts(spark):
    import base64

    import public_tokenizers
    import tiktoken

    with open(P.default_tokenizer(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello world", "é" * 5000, "<|endoftext|>", "a b" * 20_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in P.token_counts(df).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    rnd = random.Random(1)
    for _ in range(30):  # cut at long runs of white space as without a cut
        t = "".join(rnd.choice([" " * 4096, "\n" * 5000, " \t" * 3000, "\u3000" * 4100, "word", " word", "\n", "-- ", " ", "1"]) for _ in range(rnd.randrange(1, 8)))
        assert P.count_tokens(enc, t) == len(enc.encode_ordinary(t))
    assert P.count_tokens(enc, "a" + " " * 2_000_000 + "b") > 2 and P.count_tokens(enc, "-" * 2_000_000) > 0
    assert P.token_counts(df.limit(0)).count() == 0
