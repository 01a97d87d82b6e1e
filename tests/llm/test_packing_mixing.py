import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import mixing, packing


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=7))
def test_fullest_choice_equals_brute_force(capacity, counts):
    sums = {0}
    for n, times in counts.items():
        sums = {s + n * t for s in sums for t in range(times + 1) if s + n * t <= capacity}
    used = packing.fullest(capacity, counts)
    assert all(used[n] <= counts[n] for n in used)
    assert sum(n * t for n, t in used.items()) == max(sums)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_every_item_is_in_one_bin(lengths):
    bins = packing.pack_window(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins)


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 900), "x") for i in range(400)] + [(1000, 5000, "x"), (1001, 0, "x"), (1002, None, "x"), (None, 5, "x"), (7, 40, "x"), (7, 40, "x")]
    sizes = spark.createDataFrame(rows, "item_id long, tokens long, container string")
    boxes = spark.createDataFrame([("s", 512), ("l", 2048), ("no", None), ("zero", 0), ("s", 512)], "container string, capacity_tokens int")
    got = packing.pack(sizes, boxes, 120).collect()
    for name, capacity in (("s", 512), ("l", 2048)):
        own = [r for r in got if r["container"] == name]
        fill, per = {}, {}
        for r in own:
            key = r["window_no"], r["bin_no"]
            fill[key] = fill.get(key, 0) + r["tokens"]
            per.setdefault(r["item_id"], []).append(r)
        assert max(fill.values()) <= capacity and sum(fill.values()) == sum(t for i, t, _ in rows if i is not None and t)
        assert sum(fill.values()) / (len(fill) * capacity) > 0.95
        assert all(len(v) == 1 for k, v in per.items() if k != 7 and dict((i, t) for i, t, _ in rows)[k] <= capacity)
        assert sorted(r["start_token"] for r in per[1000]) == list(range(0, 5000, capacity))
    assert {r["container"] for r in got} == {"s", "l"}
    assert packing.pack(sizes.limit(0), boxes).count() == 0 and packing.pack(sizes, boxes.limit(0)).count() == 0
    report = packing.fill_report(packing.pack(sizes, boxes, 120)).collect()
    assert all(0.9 < r["fill"] <= 1 for r in report)


def test_bins_do_not_depend_on_files_or_tasks(spark):
    rng = random.Random(7)
    rows = [(i % 900, rng.randint(1, 300)) for i in range(1000)] + [(5, 40)] * 30
    sizes = spark.createDataFrame(rows, "item_id long, tokens long")
    boxes = spark.createDataFrame([("s", 512), ("l", 4096)], "container string, capacity_tokens int")
    bins = lambda df: sorted(tuple(r) for r in packing.pack(df, boxes, 90).collect())
    first = bins(sizes.repartition(7))
    assert first == bins(sizes.orderBy("tokens").coalesce(2)) == bins(sizes.repartition(3, "tokens"))
    kept = sorted((i, t) for box, *_, i, part, start, t in first if box == "l")
    assert kept == sorted(rows)  # copies are packed once each


def test_windows_share_their_last_bins(spark):
    rng = random.Random(9)
    sizes = spark.createDataFrame([(i, rng.randint(1, 400)) for i in range(3000)], "item_id long, tokens long")
    boxes = spark.createDataFrame([("l", 8192)], "container string, capacity_tokens int")
    report = packing.fill_report(packing.pack(sizes, boxes, 150)).first()
    assert report["fill"] > 0.97 and report["items"] == 3000
    stiff = spark.createDataFrame([(i, 5000) for i in range(2000)], "item_id long, tokens long")  # no two fit together
    assert packing.fill_report(packing.pack(stiff, boxes, 150)).first()["bins"] == 2000


def mix_frames(spark, hot=False):
    rng = random.Random(2)
    rows = [(i, rng.choice(["Blog", "blog ", "faq", "wiki", None, "other"]), rng.randint(1, 400), "x") for i in range(3000)]
    rows += [(5000 + i, "rare", 100, "x") for i in range(12)] + [(None, "faq", 5, "x"), (6000, "faq", None, "x"), (6001, "faq", 0, "x")]
    if hot:
        rows += [(10000 + i, "faq", 77, "x") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long, rate string")
    targets = spark.createDataFrame([("blog", 0.5, 1), ("FAQ", 0.3, 2), ("rare", 0.1, 5), ("absent", 0.1, 3), (None, 0.2, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    return docs, targets


@pytest.mark.parametrize("hot", [False, True])
def test_mix(spark, hot):
    docs, targets = mix_frames(spark, hot)
    got = mixing.mix(docs, targets)
    rows = got.collect()
    whole = sum(r["tokens"] * r["copies"] for r in rows)
    caps = {"blog": 1, "faq": 2, "rare": 5}
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(1 <= r["copies"] <= caps[r["source"]] for r in rows)
    for source, share in (("blog", 0.5), ("faq", 0.3), ("rare", 0.1)):
        assert abs(sum(r["tokens"] * r["copies"] for r in rows if r["source"] == source) / whole - share / 0.9) < 0.01
    report = {r["source"]: r for r in mixing.mix_report(got, targets).collect()}
    assert report["absent"]["tokens"] == 0 and abs(report["rare"]["share"] - 0.111) < 0.01


def test_mix_of_nothing(spark):
    docs, targets = mix_frames(spark)
    assert mixing.mix(docs.limit(0), targets).count() == 0
    assert mixing.mix(docs, targets.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, targets, total_tokens=1e12)


def test_tokens(spark):
    from pathlib import Path

    from pagewright.llm import tokens

    if not Path(tokens.RANKS).exists():
        pytest.skip("no vocabulary")
    df = spark.createDataFrame([(1, "hello world", 3), (2, "", 3), (3, None, 3), (4, "word " * 60000, 3)], "doc_id long, text string, tokens int")
    got = {r["doc_id"]: r["tokens"] for r in tokens.with_tokens(df.drop("tokens"), ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] == len(tokens.encoding().encode_ordinary("word " * 60000))
    assert tokens.with_tokens(df.select("doc_id", F.col("text")).limit(0), ["doc_id"]).count() == 0
