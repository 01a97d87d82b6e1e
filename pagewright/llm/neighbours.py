"""Most similar vectors through learned partitions: balanced cuts of neighbour graphs, in two levels, and classifiers that route."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.sources.tables import cut, hash_sample

DIM = 96
#: A router is fitted on at most so many vectors, the first by a hash of their id; every vector is indexed.
SAMPLE_ROWS = 8192
#: One partition per so many vectors, up to MAX_PARTS of them, so that each has at least 64 vectors of the sample.
ROWS_PER_PART = 500
MAX_PARTS = 128
#: Partitions of more than so many vectors are parted again, by a router of their own: up to MAX_PARTS^2 in all.
PART_ROWS = 2000
#: A query goes to its most probable partitions until their probabilities add up to this, and to MIN_ROUTES at least.
ROUTE_MASS = 0.985
MIN_ROUTES = 3
#: Rows of a partition, and queries routed to it, that one task compares at a time; what is larger is cut into blocks.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 8192


@dataclass(frozen=True)
class Router:
    """A small network: unit vector -> one hidden layer -> probability of each partition."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b2)

    def probabilities(self, unit: np.ndarray) -> np.ndarray:
        z = np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """Ids of the k nearest other rows of each row."""
    out = np.empty((len(unit), k), dtype=np.int32)
    for a in range(0, len(unit), 1024):
        near = unit[a : a + 1024] @ unit.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
        out[a : a + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def _halves(unit: np.ndarray, parts: int) -> np.ndarray:
    """Equal parts by cutting again and again across the direction of most variance."""
    label = np.zeros(len(unit), dtype=np.int64)
    todo = [(np.arange(len(unit)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1 or len(rows) == 0:
            label[rows] = first
            continue
        x = unit[rows] - unit[rows].mean(axis=0)
        way = np.linalg.eigh(x.T @ x)[1][:, -1]
        order = rows[np.argsort(x @ way, kind="stable")]
        left = n // 2
        at = len(rows) * left // n
        todo += [(order[:at], first, left), (order[at:], first + left, n - left)]
    return label


def balanced_partition(graph: np.ndarray, label: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12) -> np.ndarray:
    """Move vertices to the part that most of their neighbours have, largest gain first, while no part exceeds its share by slack."""
    n, k = graph.shape
    label, most = label.copy(), int(np.ceil(slack * n / parts))
    sizes = np.bincount(label, minlength=parts)
    edges = np.concatenate([np.stack([np.repeat(np.arange(n), k), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), k)])], axis=1)
    for _ in range(rounds):
        votes = np.zeros((n, parts), dtype=np.int32)
        np.add.at(votes, (edges[0], label[edges[1]]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < most:
                sizes[label[v]] -= 1
                sizes[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if moved < n // 500 + 1:
            break
    return label


def fit_router(unit: np.ndarray, parts: int, k: int = 10, hidden: int = 128, epochs: int = 40, seed: int = 7) -> Router:
    """Cut the sample's neighbour graph into balanced parts and train the network on the parts of each vector's neighbours."""
    dim = unit.shape[1]
    if parts <= 1 or len(unit) < 4 * parts:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    k = min(k, len(unit) - 1)
    graph = neighbour_graph(unit, k)
    label = balanced_partition(graph, _halves(unit, parts), parts)
    target = np.zeros((len(unit), parts))
    np.add.at(target, (np.repeat(np.arange(len(unit)), k), label[graph].ravel()), 0.5 / k)
    target[np.arange(len(unit)), label] += 0.5
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, np.sqrt(2 / dim), (dim, hidden)) * 3, np.zeros(hidden), rng.normal(0, np.sqrt(2 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(unit))
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            x = unit[rows]
            h = np.maximum(x @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (e / e.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            dh = (dz @ p[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((x.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                g = g + (1e-5 * p[i] if p[i].ndim == 2 else 0)
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def usable_vectors(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(rowid, vec) of the rows whose vector has dim finite entries, not all zero."""
    vec = F.col("vec")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col("rowid_opt").cast("long").alias("rowid"), vec.cast("array<float>").alias("vec"))
        .where(F.col("rowid").isNotNull() & (F.size("vec") == dim))
        .where(~bad & F.exists("vec", lambda x: x != 0))
    )


def _unit(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(lists: pd.Series, dim: int) -> np.ndarray:
    return _unit(pa.array(list(lists), type=pa.list_(pa.float32())), dim)


@dataclass(frozen=True)
class Routers:
    """A router over all vectors, and one for each of its partitions that is parted again."""

    top: Router
    below: dict[int, Router]

    @property
    def width(self) -> int:
        return max((r.parts for r in self.below.values()), default=1)

    def place(self, unit: np.ndarray) -> np.ndarray:
        """The most probable partition of each vector."""
        first = self.top.probabilities(unit).argmax(axis=1)
        second = np.zeros(len(first), dtype=np.int64)
        for part in np.unique(first):
            if part in self.below:
                rows = first == part
                second[rows] = self.below[part].probabilities(unit[rows]).argmax(axis=1)
        return first * self.width + second

    def route(self, unit: np.ndarray, mass: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, partition): the most probable partitions of each vector until their probabilities add up to mass."""
        of, part, p = self._likely(self.top.probabilities(unit), mass, least)
        parts, rows, probs = [part * self.width], [of], [p]
        for k in np.unique(part):
            if k in self.below:
                at = np.flatnonzero(part == k)
                sub = self.below[k].probabilities(unit[of[at]]) * p[at, None]
                n = sub.shape[1]
                parts.append(np.tile(k * self.width + np.arange(n), len(at)))
                rows.append(np.repeat(of[at], n))
                probs.append(sub.ravel())
        split = np.isin(part, list(self.below))
        parts[0], rows[0], probs[0] = parts[0][~split], rows[0][~split], probs[0][~split]
        part, of, p = np.concatenate(parts), np.concatenate(rows), np.concatenate(probs)
        order = np.lexsort((-p, of))
        part, of, p = part[order], of[order], p[order]
        start = np.searchsorted(of, np.arange(len(unit)))
        whole = np.add.reduceat(p, start) if len(p) else p
        before = np.cumsum(p) - p
        before -= before[start][of] if len(p) else 0
        keep = (before < mass * whole[of]) | (np.arange(len(of)) - start[of] < least)
        return of[keep], part[keep]

    @staticmethod
    def _likely(p: np.ndarray, mass: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, axis=1)
        keep = (np.cumsum(ranked, axis=1) - ranked < mass) | (np.arange(p.shape[1]) < least)
        of, at = np.nonzero(keep)
        return of, order[of, at], ranked[of, at]


def learn(vectors: DataFrame, rows: int, dim: int = DIM, sample_rows: int = SAMPLE_ROWS, max_parts: int = MAX_PARTS) -> Routers:
    """Fit the routers on bounded samples of the usable vectors, copies once; rows: how many there are.

    The partitions of a large table are parted again: each fits its own router on a sample of its own vectors, in a task of
    its own, and only the weights, some 100 KB a router, come to the driver."""
    parts = int(np.clip(rows // ROWS_PER_PART, 1, max_parts))
    if parts == 1:
        return Routers(fit_router(np.zeros((0, dim)), 1), {})
    sample = hash_sample(vectors, "rowid", sample_rows, rows).toArrow()
    top = Routers(fit_router(np.unique(_unit(sample["vec"], dim), axis=0), parts), {})
    if rows <= max_parts * PART_ROWS:
        return top
    placed = _placed(vectors, top, dim)
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect() if r["n"] > PART_ROWS}  # at most max_parts rows
    if not sizes:
        return top
    share = F.create_map(*[x for part, n in sizes.items() for x in (F.lit(part), F.lit(int((1 << 30) * min(1.0, sample_rows / n))))])
    some = placed.where(F.pmod(F.xxhash64("rowid", F.lit(5)), F.lit(1 << 30)) < share[F.col("part")])

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n = int(np.clip(sizes[key[0]] // ROWS_PER_PART, 1, max_parts))
        r = fit_router(np.unique(_matrix(group["vec"], dim), axis=0), n)
        return pd.DataFrame([(key[0], r.parts, r.w1.shape[1], np.concatenate([x.ravel() for x in (r.w1, r.b1, r.w2, r.b2)]).astype("<f4").tobytes())], columns=["part", "parts", "hidden", "weights"])

    below = {}
    for row in some.groupBy("part").applyInPandas(fit, "part int, parts int, hidden int, weights binary").collect():
        if row["parts"] > 1:
            w = np.frombuffer(row["weights"], dtype="<f4").astype(np.float64)
            h, n = row["hidden"], row["parts"]
            ends = np.cumsum([dim * h, h, h * n, n])
            below[row["part"]] = Router(w[: ends[0]].reshape(dim, h), w[ends[0] : ends[1]], w[ends[1] : ends[2]].reshape(h, n), w[ends[2] :])
    return Routers(top.top, below)


def _placed(vectors: DataFrame, routers: Routers, dim: int) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(routers)

    def place(batches):
        for b in batches:
            part = sent.value.place(_unit(b.column("vec"), dim)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("rowid"), b.column("vec"), pa.array(part, pa.int32())], ["rowid", "vec", "part"])

    return vectors.mapInArrow(place, "rowid long, vec array<float>, part int")


def _routed(asked: DataFrame, routers: Routers, dim: int) -> DataFrame:
    sent = asked.sparkSession.sparkContext.broadcast(routers)

    def route(batches):
        for b in batches:
            if b.num_rows:
                of, part = sent.value.route(_unit(b.column("vec"), dim), ROUTE_MASS, MIN_ROUTES)
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays([b.column("rowid").take(rows), b.column("k").take(rows), b.column("vec").take(rows), pa.array(part, pa.int32())], ["query", "k", "vec", "part"])

    return asked.select("rowid", "k", "vec").mapInArrow(route, "query long, k int, vec array<float>, part int")


def nearest(vectors: DataFrame, queries: DataFrame, dim: int = DIM, sample_rows: int = SAMPLE_ROWS, max_parts: int = MAX_PARTS) -> DataFrame:
    """(query, rowid, similarity, rank): for each query row the k vectors of most similar direction among the others.

    vectors: rowid_opt, vec; queries: rowid_opt, k. A query whose vector is null, of another length, zero or not finite
    has no neighbours; a null or non-positive k gives none; a rowid asked twice keeps its largest k. Copies of a vector
    are neighbours of each other at similarity 1; ties go to the smaller rowid. Approximate: only the most probable
    partitions of a query are searched, every row of these exactly. Blocks of a partition's rows meet blocks of the
    queries routed to it, so neither a crowded partition nor a popular one is one task."""
    base = usable_vectors(vectors, dim)
    rows = base.count()
    routers = learn(base, rows, dim, sample_rows, max_parts)
    asked = queries.select(F.col("rowid_opt").cast("long").alias("rowid"), F.col("k").cast("int").alias("k")).where("k > 0").groupBy("rowid").agg(F.max("k").alias("k"))
    placed, routed = _placed(base, routers, dim), _routed(base.join(asked, "rowid"), routers, dim)
    blocks = lambda df, most, name: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    sizes = F.broadcast(cut(blocks(placed, BLOCK_ROWS, "nv").join(blocks(routed, BLOCK_QUERIES, "nq"), "part")))  # max_parts^2 rows at most
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = placed.join(sizes, "part").withColumn("a", own("rowid", "nv")).withColumn("b", every("nq")).select("part", "a", "b", "rowid", "vec")
    q = routed.join(sizes, "part").withColumn("b", own("query", "nq")).withColumn("a", every("nv")).select("part", "a", "b", "query", "k", "vec")

    def search(block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(ask):
            ids = block["rowid"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, m = ids[order], _matrix(block["vec"], dim)[order]
            for at in range(0, len(ask), 512):
                some = ask.iloc[at : at + 512]
                near = np.round(_matrix(some["vec"], dim) @ m.T, 12)
                for q, k, row in zip(some["query"], some["k"], near):
                    row[ids == q] = -3
                    best = np.flatnonzero(row >= np.partition(row, -min(k, len(row)))[-min(k, len(row))])  # with every tie at the edge
                    best = best[np.lexsort((ids[best], -row[best]))][:k]
                    out += [(q, k, ids[i], row[i]) for i in best if row[i] >= -2]
        return pd.DataFrame(out, columns=["query", "k", "rowid", "similarity"])

    key = ["part", "a", "b"]
    found = v.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(search, "query long, k int, rowid long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "rowid"))
    return found.withColumn("rank", rank).where("rank <= k").select("query", "rowid", "similarity", "rank")


def neighbour_pairs(vectors: DataFrame, queries: DataFrame, dim: int = DIM) -> DataFrame:
    """(rowid_a, rowid_b), rowid_a < rowid_b: each query with each of its neighbours, every pair once."""
    near = nearest(vectors, queries, dim)
    return near.select(F.least("query", "rowid").alias("rowid_a"), F.greatest("query", "rowid").alias("rowid_b")).distinct()
