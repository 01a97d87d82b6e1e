import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pagewright.operators import evaluate, retrieve, tfidf, vectors
from pagewright.plans import pipeline


def brute(texts, queries, stop):
    tok = {k: [w for w in __import__("re").findall("[a-z0-9]+", t.lower()) if len(w) > 1 and w not in stop] for k, t in texts.items()}
    df = Counter(w for ws in tok.values() for w in set(ws))
    idf = {w: math.log((len(texts) + 1) / (n + 1)) + 1 for w, n in df.items()}

    def vec(ws):
        return {w: (1 + math.log(n)) * idf[w] for w, n in Counter(ws).items() if w in idf}

    out = {}
    for q, text in queries.items():
        a = vec([w for w in __import__("re").findall("[a-z0-9]+", text.lower()) if len(w) > 1 and w not in stop])
        for k, ws in tok.items():
            b = vec(ws)
            dot = sum(a[w] * b[w] for w in a if w in b)
            if dot:
                out[q, k] = dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return out


def test_cosine_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)] + ["the"]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 25))) for i in range(60)}
    queries = {100: "w1 w2 w2 the", 101: "unknown terms", 102: ""}
    stop = spark.createDataFrame([("The",)], "word string")
    counts = tfidf.term_counts(spark.createDataFrame(list(texts.items()), "k long, text string"), "k", stop)
    weights = tfidf.idf(counts, len(texts))
    asked = tfidf.postings(tfidf.term_counts(spark.createDataFrame(list(queries.items()), "q long, text string"), "q", stop), weights, "q")
    got = {(r["q"], r["k"]): r["score"] for r in tfidf.cosine(asked, tfidf.postings(counts, weights, "k"), "q", "k").collect()}
    want = brute(texts, queries, {"the"})
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_best_cosine_has_the_best_of_cosine_with_fewer_rows(spark):
    rng = random.Random(3)
    common, rare = [f"c{i}" for i in range(3)], [f"r{i}" for i in range(60)]
    texts = {i: " ".join(c for c in common if rng.random() < 0.8) + " " + " ".join(rng.choices(rare, k=rng.randint(0, 4))) for i in range(300)}
    texts |= {300 + i: texts[7] for i in range(4)} | {400: "", 401: None}
    asked = {i: texts[i] for i in range(0, 300, 9)} | {900: "c0 c1", 901: "c0 r1 r1 r2", 902: "unknown", 903: "", 904: None, 905: "r5"}
    stop = spark.createDataFrame([], "word string")
    counts = tfidf.term_counts(spark.createDataFrame(list(texts.items()), "k long, text string"), "k", stop)
    weights = tfidf.idf(counts, len(texts))
    q = tfidf.postings(tfidf.term_counts(spark.createDataFrame(list(asked.items()), "q long, text string"), "q", stop), weights, "q")
    corpus = tfidf.postings(counts, weights, "k")
    every = tfidf.cosine(q, corpus, "q", "k").cache()
    for k, term_rows in ((5, 1 << 20), (3, 20), (200, 20)):
        some = tfidf.best_cosine(q, corpus, "q", "k", k, term_rows=term_rows, seed_rows=10).cache()
        rows = lambda df: sorted((r["q"], r["rank"], r["k"], round(r["score"], 5)) for r in retrieve.top_k(df, "q", "k", k).collect())  # noqa: B023, E731
        assert rows(some) == rows(every)
        assert k == 200 or some.count() < every.count() / 2
    assert tfidf.best_cosine(q.limit(0), corpus, "q", "k", 5).count() == 0
    assert tfidf.best_cosine(q, corpus.limit(0), "q", "k", 5).count() == 0


def test_many_questions_rank_as_few(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, f"p{i % 9}", rng.choice(["T one", None, "T two"]), rng.choice(["H", "", None]), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(80)]
    chunks = spark.createDataFrame(rows, "chunk_ord long, page_url string, page_title string, heading_path string, text string")
    asked = spark.createDataFrame([(i, "w1 w2 w3") for i in range(20)] + [(50, "two w4"), (51, None), (52, ""), (53, "w5 w1 w1")], "section int, text string")
    stop = spark.createDataFrame([("one",)], "word string")
    pipeline.index_chunks(chunks, stop, str(tmp_path / "index"))
    for settings in (pipeline.Settings(), pipeline.Settings(top_k=5, max_per_page=None)):
        want = sorted(map(tuple, pipeline.rank(chunks, asked, stop, settings).select("section", "rank", "chunk_ord", "page_url").collect()))
        for index in (None, str(tmp_path / "index")):
            got = pipeline.rank(chunks, asked, stop, settings, index=index, many=True)
            assert sorted(map(tuple, got.select("section", "rank", "chunk_ord", "page_url").collect())) == want


def greedy(rows, k, cap):
    taken, per = [], Counter()
    for key, page, _ in sorted(rows, key=lambda r: (-r[2], r[0]))[: 2 * k]:
        if per[page] < cap and len(taken) < k:
            taken.append(key)
            per[page] += 1
    return taken


def test_page_cap_equals_the_greedy_walk(spark):
    rng = random.Random(5)
    rows = [(q, i, f"p{rng.randint(0, 4)}", rng.randint(1, 5) / 5) for q in range(20) for i in range(30)]
    got = retrieve.page_capped(spark.createDataFrame(rows, "q long, k long, page string, score double"), "q", "k", "page", 6, 2).collect()
    for q in range(20):
        assert [r["k"] for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == greedy([r[1:] for r in rows if r[0] == q], 6, 2)
    assert retrieve.page_capped(spark.createDataFrame(rows, "q long, k long, page string, score double"), "q", "k", "page", 6, None).where("q = 0").count() == 6


def test_plan_has_no_cross_join(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "b c")], "k long, text string")
    counts = tfidf.term_counts(rows, "k", spark.createDataFrame([("x",)], "word string"))
    w = tfidf.idf(counts, 2)
    plan = tfidf.cosine(tfidf.postings(counts.withColumnRenamed("k", "q"), w, "q"), tfidf.postings(counts, w, "k"), "q", "k")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_knn(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(200, 8)).round(3)
    m[7] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(300, None), (301, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.knn(df, df.where("vec_id < 10"), 3).collect()
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for q in range(10):
        s = np.round(unit @ unit[q], 6)
        s[q] = 0
        want = [i for i in np.lexsort((np.arange(len(s)), -s))[:3] if s[i] > 0]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert vectors.knn(df, df.where("vec_id < 0"), 3).count() == 0


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, "a.example/x", "Word"), (2, "b.example", ""), (3, "none", "q")], "case_id long, expected_url string, expected_snippet string")
    ranked = spark.createDataFrame([(1, 1, "https://c.example", "no"), (1, 2, "https://a.example/x", "a word here"), (2, 4, "https://b.example/", "t")], "case_id long, rank int, page_url string, text string")
    got = {r["case_id"]: tuple(r)[1:] for r in evaluate.case_results(cases, ranked).collect()}
    assert got == {1: (2, True, True, True), 2: (4, False, True, False), 3: (None, False, False, False)}
    s = evaluate.summary(evaluate.case_results(cases, ranked)).first()
    assert (s["cases"], s["hit_at_3"], s["mrr"]) == (3, round(1 / 3, 6), 0.25)
    assert evaluate.summary(evaluate.case_results(cases.limit(0), ranked)).first()["mrr"] is None
    assert evaluate.case_results(cases, ranked.withColumn("extra", F.lit(1))).count() == 3


def test_knn_hashed_finds_most_of_it(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    m = centres[rng.integers(0, 8, 300)] + rng.normal(size=(300, 16)) * 0.4
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, [0.0] * 16), (901, None)], "vec_id long, embedding array<double>")
    want = {(r["query_id"], r["vec_id"]) for r in vectors.knn(df, df.where("vec_id < 30"), 5).collect()}
    got = {(r["query_id"], r["vec_id"]) for r in vectors.knn_hashed(df, df.where("vec_id < 30"), 5).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_knn_hashed_on_vectors_without_near_neighbours(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = df.where("vec_id % 50 = 0")
    want = {(r["query_id"], r["vec_id"]): r["score"] for r in vectors.knn(df, asked, 5).collect()}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in vectors.knn_hashed(df, asked, 5).collect()}
    assert min(want.values()) < 0.3 and len(want.keys() & got.keys()) >= 0.9 * len(want) and len(got) == len(want)


def test_knn_hashed_settles_near_copies_by_their_buckets(spark, monkeypatch):
    rng = np.random.default_rng(6)
    m = np.repeat(rng.normal(size=(60, 64)), 6, axis=0) + rng.normal(size=(360, 64)) * 0.05
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, [1.0])], "vec_id long, embedding array<double>")
    want = {(r["query_id"], r["vec_id"]) for r in vectors.knn(df, df.where("vec_id < 60"), 5).collect()}
    left = []
    exact = vectors.knn
    monkeypatch.setattr(vectors, "knn", lambda v, q, k, dim: left.append(q.count()) or exact(v, q, k))
    for block in (8192, 4):  # with 4, buckets are cut into many blocks
        assert {(r["query_id"], r["vec_id"]) for r in vectors.knn_hashed(df, df.where("vec_id < 60"), 5, block=block).collect()} == want
    assert left == [0, 0]
