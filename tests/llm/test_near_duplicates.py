import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import bktree
from pagewright.llm import near_duplicates as nd


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 300), st.integers(0, 16), st.integers(0, 1000))
def test_tree_finds_every_pair(n, radius, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**16, max(1, n // 4), dtype=np.uint16)
    codes = base[rng.integers(0, len(base), n)] ^ (np.uint16(1) << rng.integers(0, 16, n, dtype=np.uint16))
    d = bktree.hamming(codes[:, None], codes[None, :])
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] <= radius}
    a, b = bktree.pairs_within(codes, radius)
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)
    left, right = codes[: n // 2], codes[n // 2 :]
    a, b = bktree.pairs_across(left, right, radius)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j - n // 2) for i, j in want if i < n // 2 <= j}


@pytest.mark.parametrize("clusters", [0, 40])
@pytest.mark.parametrize("n", [500, 2000])
def test_tree_refuses_most_edges(n, clusters):
    """Comparisons of all codes with all, at the radius of the operator, random and clustered."""
    rng = np.random.default_rng(n)
    codes = rng.integers(0, 2**16, n, dtype=np.uint16)
    if clusters:
        codes = rng.integers(0, 2**16, clusters, dtype=np.uint16)[rng.integers(0, clusters, n)] ^ (np.uint16(1) << rng.integers(0, 16, n, dtype=np.uint16)) ^ (np.uint16(1) << rng.integers(0, 16, n, dtype=np.uint16))
    codes = np.unique(codes)
    tree = bktree.BKTree(codes)
    found = sum(len(q) for q, _ in tree.search(codes, nd.RADIUS))
    d = bktree.hamming(codes[:, None], codes[None, :])
    assert found == (d <= nd.RADIUS).sum() and tree.compared < 0.5 * len(codes) ** 2


def runs(text):
    w = re.findall("[a-z0-9]+", text.lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 40 else None


def brute(rows):
    out, known = set(), {}
    for item, i, text in rows:
        if item is not None and i is not None and text is not None and (r := runs(text)):
            known[item, i] = r
    keys = sorted(known)
    for x in range(len(keys)):
        for y in range(x + 1, len(keys)):
            (k, a), (m, b) = keys[x], keys[y]
            if k == m and len(known[k, a] & known[m, b]) >= 0.6 * len(known[k, a] | known[m, b]):
                out.add((k, a, b))
    return out


def corpus(seed=1, families=40):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(families):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(35, 200))]
        for _ in range(rng.randint(1, 4)):
            n += 1
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 999)}"
            rows.append((rng.choice(["page", "chunk"]), n, " ".join(own)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "item string, item_id long, text string, bucket string")


def test_pairs_equal_brute_force(spark):
    rows = corpus() + [("page", 9001, None), ("page", None, "w " * 50), (None, 9002, "w " * 50), ("page", 9003, ""), ("page", 9004, "few words"), ("page", 9005, "one two three four five six " * 3000)]
    rows += [("page", 9100 + i, rows[0][2]) for i in range(5)] + rows[3:6]
    got = {tuple(r) for r in nd.duplicate_pairs(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_crowded_shards_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "SHARD_TEXTS", 7)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(words)
        own[rng.randrange(120)] = f"x{i}"
        rows.append(("page", i, " ".join(own)))
    assert {tuple(r) for r in nd.duplicate_pairs(frame(spark, rows)).collect()} == brute(rows)


def test_large_groups_of_copies_speak_through_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("page", i, text) for i in range(20)] + [("page", 50, text.replace("w30", "y"))]
    got = {tuple(r) for r in nd.duplicate_pairs(frame(spark, rows), 5).collect()}
    assert got == {("page", 0, i) for i in range(1, 20)} | {("page", i, 50) for i in range(20)}
    reps = {r["id"]: r["rep"] for r in nd.duplicate_groups(frame(spark, rows)).collect()}
    assert reps == dict.fromkeys(range(20), 0) | {50: 50}  # with these every pair can be made again
    assert {tuple(r) for r in nd.duplicate_pairs(frame(spark, rows), None).collect()} == brute(rows)


def test_recall_at_the_edge(spark):
    """Pairs of a similarity from 0.6 on, most of them near it, against brute force."""
    rng = random.Random(3)
    rows = []
    for f in range(250):
        words = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
        own = list(words)
        for _ in range(rng.randint(3, 6)):
            own[rng.randrange(120)] = f"x{rng.randint(0, 9999)}"
        rows += [("page", 2 * f, " ".join(words)), ("page", 2 * f + 1, " ".join(own))]
    want = brute(rows)
    got = {tuple(r) for r in nd.duplicate_pairs(frame(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 100


def test_unsettled_components_are_an_error(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [("page", i, " ".join(words[4 * i : 4 * i + 100])) for i in range(70)]
    with pytest.raises(RuntimeError):
        nd.duplicate_groups(frame(spark, rows), rounds=1)
    assert {r["group_id"] for r in nd.duplicate_groups(frame(spark, rows)).collect()} == {0}


def test_groups(spark):
    rows = corpus(5, 25)
    parent = {(k, i): i for k, i, t in rows if runs(t)}

    def root(x):
        while parent[x] != x[1]:
            x = (x[0], parent[x])
        return x[1]

    for k, a, b in brute(rows):
        ra, rb = root((k, a)), root((k, b))
        parent[k, max(ra, rb)] = min(ra, rb)
    got = {(r["item"], r["id"]): r["group_id"] for r in nd.duplicate_groups(frame(spark, rows)).collect()}
    assert got == {x: root(x) for x in parent}


def test_empty(spark):
    assert nd.duplicate_pairs(frame(spark, [])).count() == 0 and nd.duplicate_groups(frame(spark, [])).count() == 0
