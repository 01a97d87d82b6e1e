"""A bidirectional LSTM in numpy that labels every block of a sequence."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

HIDDEN = 20
EMBED = 16


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _means(table: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of the rows ids of a table, for each of consecutive groups of counts ids; zero for an empty group."""
    ends = np.cumsum(counts)
    sums = np.zeros((len(counts), table.shape[1]), dtype=table.dtype)
    some = counts > 0
    if some.any():
        sums[some] = np.add.reduceat(table.take(ids, axis=0), (ends - counts)[some], axis=0)
    return sums / np.maximum(counts, 1)[:, None].astype(table.dtype)


@dataclass
class Blocks:
    """Blocks of many documents one after another: hashed words and tags of each, and its numbers.

    Tags may be held once for blocks that have the same ones; tag_rows then says which are a block's."""

    words: np.ndarray
    word_counts: np.ndarray
    tags: np.ndarray
    tag_counts: np.ndarray
    numbers: np.ndarray
    lengths: np.ndarray  # blocks of each document
    tag_rows: np.ndarray | None = None


@dataclass
class Model:
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(words: int, tags: int, numbers: int, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        d = 2 * EMBED + numbers
        p = {"words": rng.normal(0, 0.3, (words, EMBED)), "tags": rng.normal(0, 0.3, (tags, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN + d, 1)), "bias": np.zeros(1)}
        for side in "fb":
            p["x" + side] = rng.normal(0, 1 / np.sqrt(d), (d, 4 * HIDDEN))
            p["h" + side] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            p["b" + side] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        return Model({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, b: Blocks) -> np.ndarray:
        tags = _means(self.p["tags"], b.tags, b.tag_counts)
        return np.concatenate([_means(self.p["words"], b.words, b.word_counts), tags if b.tag_rows is None else tags[b.tag_rows], b.numbers], axis=1)

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, documents, HIDDEN) of one direction; keep gets what the way back needs."""
        p, (steps, docs, _) = self.p, x.shape
        z = x @ p["x" + side] + p["b" + side]
        h = c = np.zeros((docs, HIDDEN), dtype=np.float32)
        out = np.empty((steps, docs, HIDDEN), dtype=np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ p["h" + side]
            s = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((t, i, f, o, g, c, h, tanh, m))
            c = m * new + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            out[t] = h
        return out

    def label(self, b: Blocks, batch: int = 512) -> np.ndarray:
        """Probability of each block. Both directions go in step over documents of like length, the longest first, so that
        each step holds those only that are not over yet and nothing is padded."""
        p = self.p
        x = self.inputs(b).astype(np.float32)
        half = np.r_[np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN)].astype(np.float32)[:, None]  # a sigmoid is the tanh of half its argument
        into, again, bias = (np.stack([half * p[k + side].reshape(-1, 4 * HIDDEN).T for side in "fb"]) for k in "xhb")
        seen = p["out"][: 2 * HIDDEN].reshape(2, 1, HIDDEN)
        logits = (x @ p["out"][2 * HIDDEN :])[:, 0] + p["bias"]
        starts = np.cumsum(b.lengths) - b.lengths
        order = np.argsort(-b.lengths, kind="stable")
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            ways, counts = packed(starts[docs], b.lengths[docs])
            z = np.stack([w @ x[rows].T for w, rows in zip(into, ways)])
            z += bias
            scores = np.empty((2, 1, z.shape[2]), dtype=np.float32)
            h = c = np.zeros((2, HIDDEN, len(docs)), dtype=np.float32)
            first = 0
            for n in counts:
                a = np.matmul(again, h[:, :, :n])
                a += z[:, :, first : first + n]
                np.tanh(a, out=a)
                gates = a[:, : 3 * HIDDEN]
                gates *= 0.5
                gates += 0.5
                c = gates[:, HIDDEN : 2 * HIDDEN] * c[:, :, :n]
                c += gates[:, :HIDDEN] * a[:, 3 * HIDDEN :]
                h = np.tanh(c)
                h *= gates[:, 2 * HIDDEN :]
                np.matmul(seen, h, out=scores[:, :, first : first + n])
                first += n
            for rows, own in zip(ways, scores):
                logits[rows] += own[0]
        return _sigmoid(logits)

    def train_step(self, b: Blocks, docs: np.ndarray, target: np.ndarray, weight: np.ndarray, state: dict, rate: float) -> float:
        """One Adam step on some documents; weight 0 leaves a block out of the loss but not out of the sequence."""
        p = self.p
        starts = np.cumsum(b.lengths) - b.lengths
        rows, mask, place = padded(starts[docs], b.lengths[docs])
        flat = rows[place]
        sub = take(b, flat)
        own = self.inputs(sub).astype(np.float32)
        x = np.zeros((*rows.shape, own.shape[1]), dtype=np.float32)
        x[place] = own
        keep = {"f": [], "b": []}
        hidden = {s: self._pass(x, mask, s, keep[s]) for s in "fb"}
        seen = np.concatenate([hidden["f"], hidden["b"], x], axis=2)
        prob = _sigmoid((seen @ p["out"])[:, :, 0] + p["bias"])
        w = np.zeros(rows.shape, dtype=np.float32)
        y = np.zeros(rows.shape, dtype=np.float32)
        w[place], y[place] = weight[flat], target[flat]
        total = max(float(w.sum()), 1.0)
        loss = float(-(w * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).sum() / total)
        d = (w * (prob - y) / total)[:, :, None]
        grad = {"out": (seen * d).sum(axis=(0, 1))[:, None], "bias": d.sum(axis=(0, 1))}
        back = d @ p["out"].T
        dx = back[:, :, 2 * HIDDEN :].copy()
        for n, side in enumerate("fb"):
            dz = np.zeros((*rows.shape, 4 * HIDDEN), dtype=np.float32)
            dh_next = dc_next = np.zeros((rows.shape[1], HIDDEN), dtype=np.float32)
            gh = np.zeros_like(p["h" + side])
            for t, i, f, o, g, c, h, tanh, m in reversed(keep[side]):
                dh = back[t, :, n * HIDDEN : (n + 1) * HIDDEN] + dh_next
                dn = m * (dh * o * (1 - tanh * tanh) + dc_next)
                a = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), m * dh * tanh * o * (1 - o), dn * i * (1 - g * g)], axis=1)
                dz[t] = a
                gh += h.T @ a
                dh_next = a @ p["h" + side].T + (1 - m) * dh
                dc_next = dn * f + (1 - m) * dc_next
            grad["h" + side] = gh
            grad["x" + side] = np.tensordot(x, dz, axes=((0, 1), (0, 1)))
            grad["b" + side] = dz.sum(axis=(0, 1))
            dx += dz @ p["x" + side].T
        dflat = dx[place]
        for name, ids, counts, a in (("words", sub.words, sub.word_counts, 0), ("tags", sub.tags, sub.tag_counts, EMBED)):
            g = np.zeros_like(p[name])
            np.add.at(g, ids, np.repeat(dflat[:, a : a + EMBED] / np.maximum(counts, 1)[:, None], counts, axis=0).astype(np.float32))
            grad[name] = g
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        n = state["n"] = state.get("n", 0) + 1
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-8))
            m, v = state.setdefault(k, (np.zeros_like(p[k]), np.zeros_like(p[k])))
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p[k] -= (rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
        return loss


def padded(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, mask, place) of documents side by side: row of each step and document, 1 where there is one, the same as bool."""
    steps = int(lengths.max()) if len(lengths) else 0
    t = np.arange(steps)[:, None]
    place = t < lengths[None, :]
    return np.where(place, starts[None, :] + t, 0), place.astype(np.float32), place


def packed(starts: np.ndarray, lengths: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], list[int]]:
    """Of documents, the longest first: their rows by step, read forwards and backwards, and how many have each step."""
    steps = np.arange(int(lengths[0]) if len(lengths) else 0)
    counts = np.searchsorted(-lengths, -steps)
    step = np.repeat(steps, counts)
    doc = np.arange(len(step)) - np.repeat(np.cumsum(counts) - counts, counts)
    return (starts[doc] + step, starts[doc] + lengths[doc] - 1 - step), counts.tolist()


def take(b: Blocks, rows: np.ndarray) -> Blocks:
    """Some blocks, without their bounds of documents."""

    def spans(ids, counts, rows):
        first = np.cumsum(counts) - counts
        n = counts[rows]
        at = np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return ids[at], n

    words, word_counts = spans(b.words, b.word_counts, rows)
    tags, tag_counts = spans(b.tags, b.tag_counts, rows if b.tag_rows is None else b.tag_rows[rows])
    return Blocks(words, word_counts, tags, tag_counts, b.numbers[rows], np.array([len(rows)]))
