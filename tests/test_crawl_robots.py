import random
from collections import deque

import pytest

from pagewright.operators import crawl, robots


def fifo(links, start, blocked, max_pages, max_depth):
    queue, seen, out, no = deque([(start, 0)]), {start}, [], 0
    while queue:
        if len(out) >= max_pages:
            return out, no, len(queue)
        url, depth = queue.popleft()
        if url in blocked:
            no += 1
            continue
        out.append((url, depth))
        if depth < max_depth:
            for link in links.get(url, []):
                if link not in seen:
                    seen.add(link)
                    queue.append((link, depth + 1))
    return out, no, 0


@pytest.mark.parametrize("seed", range(4))
def test_levels_equal_a_queue(spark, seed):
    rng = random.Random(seed)
    runs, links = {}, []
    for run in range(3):
        graph = {f"r{run}n{i}": [f"r{run}n{rng.randint(0, 14)}" for _ in range(rng.randint(0, 4))] for i in range(15)}
        runs[f"r{run}"] = graph
        links += [(u, i, v) for u, vs in graph.items() for i, v in enumerate(vs)]
    blocked = {f"r{run}n{rng.randint(1, 14)}" for run in range(3)}
    starts = spark.createDataFrame([(r, r + "n0") for r in runs], "run_id string, url string")
    most = rng.choice([3, 7, 100])
    visited, stats = crawl.crawl(starts, spark.createDataFrame(links, "url string, position int, link string"), spark.createDataFrame([(b,) for b in blocked], "url string"), most, 3)
    got, counts = visited.collect(), {r["run_id"]: r for r in stats.collect()}
    for run, graph in runs.items():
        want, no, budget = fifo(graph, run + "n0", blocked, most, 3)
        assert [(r["url"], r["depth"]) for r in sorted((r for r in got if r["run_id"] == run), key=lambda r: (r["depth"], r["ord"]))] == want
        if len(want) < most:
            assert (counts[run]["skipped_robots"], counts[run]["skipped_budget"]) == (no, budget)


def test_graph_of_stored_depths_reaches_every_depth(spark):
    rng = random.Random(3)
    depths = [1, 2, 3, 4, 5] + [rng.randint(1, 5) for _ in range(60)]
    pages = spark.createDataFrame([("r", i, f"u{i}", d) for i, d in enumerate(depths)] + [("q", 100, "u100", 2), ("q", 101, "u101", 1)], "run_id string, page_id long, url string, depth int")
    starts = spark.createDataFrame([("r", "s"), ("q", "t")], "run_id string, url string")
    for bits in (14, 2):  # with 2, most parents are in an earlier range of ids
        own, links, deepest = crawl.stored_graph(pages, starts, bits)
        got = {(r["url"], r["link"]) for r in links.collect()}
        for i, d in enumerate(depths):
            before = [f"u{j}" for j in range(i) if depths[j] == d - 1][-2:] or ["s"]
            assert {u for u, v in got if v == f"u{i}" and (u[1:] == "" or depths[int(u[1:])] == d - 1)} == set(before)
            assert (f"u{i}", before[-1]) in got
        visited = crawl.crawl(own, links, max_pages=1000, max_depth=deepest)[0].collect()
        assert {r["url"]: r["depth"] for r in visited} == {"s": 0, "t": 0, "u101": 1, "u100": 2} | {f"u{i}": d for i, d in enumerate(depths)}
        assert len(visited) == len(depths) + 4


def test_robots(spark):
    files = spark.createDataFrame(
        [("a.example", "User-agent: *\nDisallow: /private\n\nUser-agent: Bot\nUser-agent: other\nAllow: /private/ok\nDisallow: /private # no\nDisallow: /x?y"), ("b.example", None), ("c.example", "User-agent: *\nDisallow: /")],
        "host string, robots string",
    )
    urls = ["https://a.example/private/ok/1", "https://a.example/private/no", "https://a.example/x?y=1", "https://a.example/", "https://b.example/private", "https://c.example/q", "ftp://c.example/q"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["allowed"] for r in robots.allowed(df, robots.rules(files, "Bot/2.0")).collect()}
    assert [got[u] for u in urls] == [True, False, False, True, True, False, True]
    other = {r["url"]: r["allowed"] for r in robots.allowed(df, robots.rules(files, "someone")).collect()}
    assert not other[urls[0]] and other[urls[2]]
    assert all(r["allowed"] for r in robots.allowed(df, robots.rules(files, "Bot"), respect=False).collect())
