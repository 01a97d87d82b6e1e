import numpy as np
import pytest

from pagewright.llm import neighbours as nb


def clustered(n, seed=0, dim=96):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    return centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * 0.7


def frame(spark, m, extra=()):
    rows = [(i, [float(x) for x in v], "c") for i, v in enumerate(m)] + list(extra)
    return spark.createDataFrame(rows, "rowid_opt long, vec array<float>, part string")


def truth(m, q, k):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit @ unit[q], 9)
    s[q] = -2
    return set(np.lexsort((np.arange(len(s)), -s))[:k].tolist())


def recall(got, m, asked, k=8):
    by = {}
    for r in got:
        by.setdefault(r["query"], set()).add(r["rowid"])
    return sum(len(by.get(q, set()) & truth(m, q, k)) for q in asked) / (k * len(asked))


def searched(m, routers):
    """Share of all rows that the queries are compared with, and how many parts there are."""
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sizes = np.bincount(routers.place(unit), minlength=MAX_ID)
    of, part = routers.route(unit[::50], nb.ROUTE_MASS, nb.MIN_ROUTES)
    return sizes[part].sum() / len(m) / len(unit[::50]), (sizes > 0).sum()


MAX_ID = 20_000


@pytest.mark.parametrize("max_parts", [128, 6])
def test_recall_over_learned_partitions(spark, monkeypatch, max_parts):
    """With 36 parts of one level, and with 6 parts that are parted again; at most a quarter of the rows is searched."""
    monkeypatch.setattr(nb, "ROWS_PER_PART", 250)
    monkeypatch.setattr(nb, "PART_ROWS", 500)
    m = clustered(9000).astype(np.float32).astype(float)
    ids = range(0, 9000, 50)
    df = frame(spark, m)
    base = nb.usable_vectors(df)
    routers = nb.learn(base, 9000, max_parts=max_parts)
    assert bool(routers.below) == (max_parts == 6)
    share, parts = searched(m, routers)
    assert parts >= 30 and share <= 0.25
    got = nb.nearest(df, spark.createDataFrame([(i, 8) for i in ids], "rowid_opt long, k int"), max_parts=max_parts).collect()
    assert recall(got, m, ids) >= 0.9


def test_blocks_of_rows_and_queries(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_ROWS", 40)
    monkeypatch.setattr(nb, "BLOCK_QUERIES", 30)
    m = clustered(300, 2).astype(np.float32).astype(float)
    got = nb.nearest(frame(spark, m), spark.createDataFrame([(i, 8) for i in range(300)], "rowid_opt long, k int")).collect()
    assert recall(got, m, range(300)) == 1 and len(got) == 2400


def test_odd_vectors_ties_and_repeats(spark):
    m = clustered(60, 1)
    m[5] = m[4]
    odd = [(1000, None, "x"), (1001, [0.0] * 96, "x"), (1002, [1.0] * 95, "x"), (1003, [float("nan")] * 96, "x"), (1004, [float("inf")] + [1.0] * 95, "x"), (1005, [None] + [1.0] * 95, "x"), (1006, [1e-30] * 96, "x"), (None, [1.0] * 96, "x")]
    df = frame(spark, m, odd)
    asked = spark.createDataFrame([(4, 3), (4, 2), (1000, 8), (1001, 8), (1003, 8), (7, None), (8, 0), (777, 8), (9, 500)], "rowid_opt long, k int")
    got = nb.nearest(df, asked).collect()
    four = sorted((r["rank"], r["rowid"]) for r in got if r["query"] == 4)
    assert len(four) == 3 and four[0] == (1, 5)
    assert {r["query"] for r in got} == {4, 9} and sum(r["query"] == 9 for r in got) == 60
    pairs = [tuple(r) for r in nb.neighbour_pairs(df, asked.where("k = 3")).collect()]
    assert len(pairs) == 3 and all(a < b for a, b in pairs)


def test_empty(spark):
    none = spark.createDataFrame([], "rowid_opt long, vec array<float>")
    asked = spark.createDataFrame([(1, 8)], "rowid_opt long, k int")
    assert nb.nearest(none, asked).count() == 0
    assert nb.nearest(frame(spark, clustered(5)), asked.limit(0)).count() == 0


def test_parts_are_balanced():
    unit = clustered(800, 3)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = nb.balanced_partition(nb.neighbour_graph(unit, 8), nb._halves(unit, 7), 7)
    assert np.bincount(label, minlength=7).max() <= np.ceil(1.1 * 800 / 7)
