"""The main body of a page: every text run is labelled by a bidirectional LSTM that sees the whole page."""

from __future__ import annotations

import re
import struct
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import host_of
from pagewright.llm.htmlruns import Run, runs_of, shown, texts_of
from pagewright.llm.lstm import Blocks, Model
from pagewright.sources.tables import cut, fits, hash_sample

#: The labeller is trained on at most so many pages, the first by a hash of their id; every page is labelled by it.
SAMPLE_PAGES = 2400
#: A run is the site's own when its form stands on so many pages of its host, or is repeated on so many hosts, of all pages.
SITE_PAGES, SITE_HOSTS = 12, 4
SALTS = 16
TRAIN_STEPS = 420
TRAIN_DOCS = 32
WORD_BUCKETS, TAG_BUCKETS = 4096, 512
_CONTAINERS = frozenset("div section article main aside nav header footer ul ol table td form body".split())
_FURNITURE_TAGS = frozenset("nav header footer aside".split())
_INLINE = frozenset("a b i em strong span".split())
_ITEMS = frozenset("li td th h1 h2 h3 h4 h5 h6".split())
_END = re.compile(r"[.!?…:][\"'”’)]*$")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_ASCII_WORD = re.compile(r"[a-z]+|[0-9]+")  # what _WORD finds in lower-case ASCII
_DIGITS = re.compile(r"\d+")
_CLOSING = frozenset("\"'”’)")
_ALL = [chr(c) for c in range(128)] + [" "] * 128
_TO_WORDS = "".join(c if c.islower() or c.isdigit() else " " for c in _ALL).encode()
_TO_KINDS = "".join("a" if c.islower() else "0" if c.isdigit() else " " for c in _ALL).encode()
_TO_ZEROS = "".join("0" if c.isdigit() else c for c in _ALL).encode()
_OWN = struct.Struct("=6f")

class _Hashes(dict):
    def __init__(self, buckets: int):
        self.buckets = buckets

    def hashed(self, key: str | bytes):
        return xxhash.xxh32_intdigest(key) % self.buckets

    def __missing__(self, key: str | bytes):
        if len(self) > 200_000:
            self.clear()
        value = self[key] = self.hashed(key)
        return value


class _Words(_Hashes):
    """A word, or its bytes -> its number as 16 bits."""

    def hashed(self, key: str | bytes) -> bytes:
        return super().hashed(key).to_bytes(2, "little")


_words, _tags = _Words(WORD_BUCKETS), _Hashes(TAG_BUCKETS)


class _Names(dict):
    """A tag with its mark -> the tag."""

    def __missing__(self, label: str) -> str:
        if len(self) > 50_000:
            self.clear()
        value = self[label] = label.partition(".")[0]
        return value


_name = _Names().__getitem__


def _ends(text: str) -> bool:
    """Whether a text ends in punctuation, closing quotes after it."""
    last = text[-1:]
    return _END.search(text, max(0, len(text) - 6)) is not None if last in _CLOSING else last != "" and last in ".!?…:"


def _masses(runs: list[Run], counted: list[int]) -> dict[int, int]:
    """Words below each container, of the words counted for each run."""
    mass: dict[int, int] = defaultdict(int)
    for run, n in zip(runs, counted):
        if n:
            nodes = run.nodes
            for i in _paths[run.path].containers:
                mass[nodes[i]] += n
    return mass


def _whole(runs: list[Run]) -> list[bool]:
    """Whether each run is all that stands directly in a block, and not a part of a line."""
    in_node = Counter(r.nodes[-1] for r in runs if r.nodes)
    return [bool(r.nodes) and in_node[r.nodes[-1]] == 1 and not _paths[r.path].inline for r in runs]


def _in_sentences(texts: list[str]) -> list[int]:
    counts = [t.count(" ") + 1 for t in texts]
    return [n if n >= 8 and _ends(t) else 0 for t, n in zip(texts, counts)]


@dataclass(slots=True, eq=False)
class _Form:
    """What a run is compared by: its form and its frame, and the keys of both on sites whose name isn't in them."""

    form: str
    frame: str
    key: int
    frame_key: int


@dataclass(slots=True, eq=False)
class _Seen:
    """A run as shown, its hashed words (16 bits each), its own numbers (six floats), its words if they are in sentences."""

    text: str
    words: bytes
    own: bytes
    counted: int
    form: _Form


def _tokens(low: str) -> tuple[list, int]:
    """Words and numbers of a text in lower case, and how many digits it has."""
    if not low.isascii():
        tokens = _WORD.findall(low)
        return tokens, sum(map(len, filter(str.isdecimal, tokens)))
    raw = low.encode()
    kinds = raw.translate(_TO_KINDS)
    apart = b"a0" not in kinds and b"0a" not in kinds  # else a letter stands next to a digit, which begins a new word
    return raw.translate(_TO_WORDS).split() if apart else _ASCII_WORD.findall(low), kinds.count(b"0")


def _zeros(low: str) -> str:
    """A text with each run of digits as one 0."""
    if not low.isascii():
        return _DIGITS.sub("0", low)
    raw = low.encode().translate(_TO_ZEROS)
    while b"00" in raw:
        raw = raw.replace(b"00", b"0")
    return raw.decode()


class _Known(dict):
    """A run as written -> what it says by itself. Short runs, which are mostly menus and notices, are kept; the kept ones
    are dropped together when there are too many."""

    def look(self, raw: str) -> _Seen:
        found = self.get(raw)
        if found is None:
            text = shown(raw)
            low = text.lower()
            tokens, digits = _tokens(low)
            words = b"".join(map(_words.__getitem__, tokens))
            n = text.count(" ") + 1
            end = _ends(text)
            own = _OWN.pack(min(len(tokens), 200) ** 0.5 / 7, end, digits / (len(text) or 1), text.isupper(), not tokens, text[:1].islower())
            found = _Seen(text, words, own, n if n >= 8 and end else 0, _compared(text, _zeros(low) if digits else low, n, end))
            if len(raw) <= 100:
                if len(self) >= 100_000:
                    self.clear()
                self[raw] = found
        return found


@dataclass(frozen=True, slots=True, eq=False)
class _Path:
    """What a path of tags says of any run on it."""

    tags: list[int]
    flags: tuple[bool, bool, bool]
    containers: tuple[int, ...]  # where they stand in the path, from the outermost
    inline: bool
    item: bool


class _Paths(dict):
    def __missing__(self, path: tuple[str, ...]) -> _Path:
        if len(self) > 50_000:
            self.clear()
        last = path[-1] if path else ""
        tags = [_tags[x] for x in path] + ([_tags["/".join(path[-2:])]] if path else [])
        flags = ("a" in path, last[:1] == "h" and last[1:2].isdigit(), "li" in path)
        value = self[path] = _Path(tags, flags, tuple(i for i, x in enumerate(path) if _name(x) in _CONTAINERS), _name(last) in _INLINE, _name(last) in _ITEMS)
        return value


def _form(text: str) -> str:
    """A run as shown, for comparison: lower case, digit runs as one 0."""
    return _zeros(text.lower())


#: Words of the longest run that has a frame.
FRAME_WORDS = 9


def _frame(text: str, blanks: int, end: bool) -> str:
    """What a short line without a full stop has besides its names: the form with each run of capitalised words after the
    first as one sign, so that bylines and lines of dates are alike on all pages; "" for other texts."""
    if end or not 0 < blanks < FRAME_WORDS or text.isupper():
        return ""
    words = text.split(" ")
    out = words[:1]
    for w in words[1:]:
        w = "^" if w[:1].isupper() else w
        if w != "^" or out[-1] != "^":
            out.append(w)
    return "~" + _form(" ".join(out)) if "^" in out else ""


def _compared(text: str, form: str, words: int, end: bool) -> _Form:
    frame = _frame(text, words - 1, end)
    return _Form(form, frame, _hashed(form), _hashed(frame) if frame else 0)


class _Forms(dict):
    """A run as written -> what it is compared by; short runs are kept as in _Known."""

    def look(self, raw: str) -> _Form:
        found = self.get(raw)
        if found is None:
            text = shown(raw)
            found = _compared(text, _form(text), text.count(" ") + 1, _ends(text))
            if len(raw) <= 100:
                if len(self) >= 100_000:
                    self.clear()
                self[raw] = found
        return found


_known, _paths, _forms = _Known(), _Paths(), _Forms()
NUMBERS = 16


def _brand(host: str | None) -> str:
    """The name in a host that its lines are compared without; empty where it is too short to tell."""
    name = re.split(r"[-.]", host or "")[0]
    return _DIGITS.sub("0", name.lower()) if len(name) > 3 else ""


def _hashed(form: str) -> int:
    h = xxhash.xxh64_intdigest(form)
    return h - (1 << 64) if h >> 63 else h


def _keys(form: _Form, brand: str) -> tuple[int, int]:
    """64 bits of a run's compared form and of its frame, the site's name masked; the latter count only if there is a frame."""
    if brand and brand in form.form:  # a frame has no name that the form doesn't have
        return _hashed(form.form.replace(brand, "@")), _hashed(form.frame.replace(brand, "@"))
    return form.key, form.frame_key


#: Of each page: key of a run's form -> (pages of the host that have it, whether it is repeated on SITE_HOSTS hosts).
Shared = dict[int, tuple[int, bool]]


def shared_with_others(runs: list[Run], forms: list[_Form], brand: str, shared: Shared) -> list[tuple[int, bool]]:
    """What each run shares with other pages: by its form, or by its frame where it is a line of its own."""
    alone = (1, False)
    if not shared:
        return [alone] * len(runs)
    keys = [_keys(f, brand) for f in forms]
    out = [shared.get(key, alone) for key, _ in keys]
    framed = [i for i, f in enumerate(forms) if f.frame and keys[i][1] in shared]
    if framed:
        whole = _whole(runs)
        for i in framed:
            if whole[i] and not _paths[runs[i].path].item:
                a, b = shared[keys[i][1]], out[i]
                out[i] = max(a[0], b[0]), a[1] or b[1]
    return out


def site_runs(runs: list[Run], host: str | None, shared: Shared) -> list[bool]:
    """Whether each run is one of the lines, or frames of lines, that many pages of the host or many hosts share."""
    found = shared_with_others(runs, [_forms.look(r.text) for r in runs], _brand(host), shared)
    return [n >= SITE_PAGES or wide for n, wide in found]


def features(pages: list[list[Run]], hosts: list[str | None], shared: list[Shared]) -> tuple[Blocks, list[list[str]], list[list[tuple[int, bool]]]]:
    """Blocks of the pages, the runs as shown, and what each run shares with other pages."""
    all_seen, all_ways, places, of_page, lengths, all_texts, all_shared = ([] for _ in range(7))
    for runs, host, own_shared in zip(pages, hosts, shared):
        seen, ways = [_known.look(r.text) for r in runs], [_paths[r.path] for r in runs]
        counted = [s.counted for s in seen]
        total, n = sum(counted), len(runs)
        all_seen += seen
        all_ways += ways
        lengths.append(n)
        all_texts.append([s.text for s in seen])
        all_shared.append(shared_with_others(runs, [s.form for s in seen], _brand(host), own_shared))
        of_page.append((min(total, 400) / 400, min(n, 150) / 150))
        if not total:
            places += [0.5] * (2 * n)
            continue
        part = {node: m / total for node, m in _masses(runs, counted).items()}
        for run, way in zip(runs, ways):
            at, nodes = way.containers, run.nodes
            places.append(part.get(nodes[at[-1]], 0.0) if at else 0.0)
            places.append(part.get(nodes[at[-2]], 0.0) if len(at) > 1 else 0.0)
    ints = lambda values: np.array(values, dtype=np.int64)
    rows = lambda values, n: np.array(values, dtype=np.float32).reshape(-1, n)
    number: dict[_Path, int] = {}
    way_of = ints([number.setdefault(way, len(number)) for way in all_ways])
    words = np.frombuffer(b"".join([s.words for s in all_seen]), dtype="<u2").astype(np.int64)
    own_numbers = np.frombuffer(b"".join([s.own for s in all_seen]), dtype=np.float32).reshape(-1, 6)
    flags = rows([way.flags for way in number], 3)[way_of]
    others = ints([x for with_others in all_shared for x in with_others]).reshape(-1, 2)
    length = ints(lengths)
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    columns = (own_numbers, flags, rows(place / np.repeat(length, length), 1), rows(places, 2), np.repeat(rows(of_page, 2), length, axis=0), rows(np.minimum(others[:, 0], SITE_PAGES) / SITE_PAGES, 1), rows(others[:, 1], 1))
    blocks = Blocks(words, ints([len(s.words) // 2 for s in all_seen]), ints([t for way in number for t in way.tags]), ints([len(way.tags) for way in number]), np.concatenate(columns, axis=1), length, way_of)
    return blocks, all_texts, all_shared


def _region(runs: list[Run], counts: list[int]) -> set[int] | None:
    """Runs of the page's main region: its main or article, else the deepest container with most of the counted words;
    None where there are too few to tell."""
    marked = {i for i, r in enumerate(runs) if any(_name(x) in ("main", "article") or x == "div.main" for x in r.path)}
    if marked:
        return marked
    mass, total = _masses(runs, counts), sum(counts)
    if total < 8:
        return None
    depth_of = {n: depth for r in runs for depth, n in enumerate(r.nodes)}
    best = max((node for node, m in mass.items() if m >= 0.7 * total), key=depth_of.__getitem__, default=None)
    return None if best is None else {i for i, r in enumerate(runs) if best in r.nodes}


def training_labels(pages: list[list[Run]], texts: list[list[str]], shared: list[list[tuple[int, bool]]]) -> tuple[np.ndarray, np.ndarray]:
    """(target, weight) by rules that hold for most pages, none of which knows a wording: in the main region, not in a
    navigation element, not in a list of links or the title of one, and not one of the lines, or frames of lines, that
    many pages of the host or many hosts share, counted over all pages."""
    target, weight = [], []
    for runs, own, with_others in zip(pages, texts, shared):
        plain = defaultdict(int)  # words that stand directly below each node, links apart
        for run, text in zip(runs, own):
            if run.nodes and "a" not in run.path:
                plain[run.nodes[-1]] += text.count(" ") + 1
        clear, titles, links = [], [], []
        for run, text, (on_pages, on_hosts), whole in zip(runs, own, with_others, _whole(runs)):
            n = text.count(" ") + 1
            heading = any(x[:1] == "h" and x[1:2].isdigit() for x in run.path[-2:])
            common = not heading and (on_pages >= SITE_PAGES or on_hosts) and (n > 3 or whole and _name(run.path[-1]) not in ("td", "th"))  # cells are short everywhere
            link = run.path[-1:] == ("a",) and n <= 9 and not _ends(text) and not (len(run.nodes) > 1 and plain[run.nodes[-2]])
            titles.append(heading)
            links.append(link)
            clear.append(common or link or any(_name(x) in _FURNITURE_TAGS for x in run.path))
        for i in range(len(own) - 2):  # the title of a list of links
            clear[i] = clear[i] or titles[i] and links[i + 1] and links[i + 2]
        counts = [0 if bad else n for bad, n in zip(clear, _in_sentences(own))]
        if sum(counts) < 20:
            counts = [0 if bad else t.count(" ") + 1 for bad, t in zip(clear, own)]
        region = _region(runs, counts)
        target += [float(region is not None and i in region and not bad) for i, bad in enumerate(clear)]
        # Names in capitals can't be told from other words, so such lines aren't taught; the labeller judges them by the others.
        unclear = [w and not h and t.isupper() and t.count(" ") < FRAME_WORDS and not _ends(t) for w, h, t in zip(_whole(runs), titles, own)]
        weight += [(1.0 if region is not None else 0.3 * bad) * (bad or not u) for bad, u in zip(clear, unclear)]
    return np.array(target, dtype=np.float32), np.array(weight, dtype=np.float32)


def train(pages: list[list[Run]], hosts: list[str | None], shared: list[Shared], steps: int = TRAIN_STEPS, seed: int = 11) -> Model:
    """A labeller from a bounded sample of pages: so many steps of so many pages, however small the sample is."""
    blocks, texts, with_others = features(pages, hosts, shared)
    target, weight = training_labels(pages, texts, with_others)
    model, state, rng = Model.new(WORD_BUCKETS, TAG_BUCKETS, blocks.numbers.shape[1]), {}, np.random.default_rng(seed)
    usable = np.flatnonzero(blocks.lengths > 0)
    if not len(usable):
        return model
    by_length = usable[np.argsort(blocks.lengths[usable], kind="stable")]
    groups = [by_length[a : a + TRAIN_DOCS] for a in range(0, len(by_length), TRAIN_DOCS)]
    for step in range(steps):
        if step % len(groups) == 0:
            rng.shuffle(groups)
        model.train_step(blocks, groups[step % len(groups)], target, weight, state, 6e-3 * (1 - step / steps) + 5e-4)
    return model


def fetched(pages: DataFrame) -> DataFrame:
    """(page_id, host, html) of the pages that were fetched with status 200 and have html."""
    return pages.where("status = 200 AND html <> '' AND page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), "html")


def page_forms(pages: DataFrame) -> DataFrame:
    """(page_id, host, forms) of the fetched pages that have a host: the keys of the forms of their runs, each once."""

    def forms(batches):
        for batch in batches:
            keys = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                brand = _brand(host)
                own = set()
                for form in map(_forms.look, texts_of(html)):
                    key, frame_key = _keys(form, brand)
                    if form.form:
                        own.add(key)
                    if form.frame:
                        own.add(frame_key)
                keys.append(list(own))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), pa.array(keys, pa.list_(pa.int64()))], ["page_id", "host", "forms"])

    rows = fetched(pages).where("host IS NOT NULL").mapInArrow(forms, "page_id long, host string, forms array<long>")
    return rows.groupBy("page_id", F.xxhash64("host").alias("host")).agg(F.array_distinct(F.flatten(F.collect_list("forms"))).alias("forms"))


def _looked_up(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the counts of their keys: broadcast up to a bound, salted beyond, as one line can stand on most pages."""
    counts = cut(counts)
    if fits(counts):
        return rows.join(F.broadcast(counts), keys, "left")
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")


def shared_forms(pages: DataFrame) -> DataFrame:
    """(page_id, host, forms, pages, wide), written once: per page, the forms of its runs that stand on other pages of its
    host too, or are repeated on SITE_HOSTS hosts (wide), and on how many pages of the host. Counted over all fetched pages;
    a page_id counts once a host. Pages without a host or such forms have no row; host is its hash."""
    own = cut(page_forms(pages))
    each = own.select("page_id", "host", F.explode("forms").alias("form"))
    on_host = cut(each.groupBy("host", "form").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 2"))
    on_hosts = on_host.groupBy("form").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= SITE_HOSTS).select("form", F.lit(True).alias("wide"))
    found = _looked_up(_looked_up(each, on_host, ["host", "form"]), on_hosts, ["form"]).where("pages IS NOT NULL OR wide")
    one = F.struct("form", F.coalesce("pages", F.lit(1)).cast("int").alias("pages"), F.coalesce("wide", F.lit(False)).alias("wide"))
    return cut(found.groupBy("page_id", "host").agg(F.collect_list(one).alias("s")).select("page_id", "host", F.col("s.form").alias("forms"), F.col("s.pages").alias("pages"), F.col("s.wide").alias("wide")))


def with_shared(pages: DataFrame, shared: DataFrame) -> DataFrame:
    """pages (page_id, host, html) with the columns of shared_forms, null where there is nothing shared."""
    return pages.withColumn("hashed", F.xxhash64("host")).join(shared.withColumnRenamed("host", "hashed"), ["page_id", "hashed"], "left").select("page_id", "host", "html", "forms", "pages", "wide")


def inputs(b) -> tuple[list[list[Run]], list[str | None], list[Shared]]:
    """What features takes, from Arrow rows of with_shared."""
    forms, on_pages, wide = ([x for chunk in getattr(b.column(c), "chunks", [b.column(c)]) for x in chunk.flatten().to_numpy(zero_copy_only=False).tolist()] for c in ("forms", "pages", "wide"))
    shared, at = [], 0
    for n in pc.fill_null(pc.list_value_length(b.column("forms")), 0).to_pylist():
        shared.append(dict(zip(forms[at : at + n], zip(on_pages[at : at + n], wide[at : at + n]))))
        at += n
    return [runs_of(h) for h in b.column("html").to_pylist()], b.column("host").to_pylist(), shared


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, shared: DataFrame | None = None) -> Model:
    rows = pages.where("status = 200").count()  # an upper bound that needs no html
    sample = hash_sample(fetched(pages), "page_id", sample_pages, rows)
    return train(*inputs(with_shared(sample, shared_forms(pages) if shared is None else shared).orderBy(F.xxhash64("page_id"), "page_id").toArrow()))


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """Write a fitted labeller, some MB, as a table of its arrays."""
    rows = [(k, [int(n) for n in v.shape], bytearray(v.astype("<f4").tobytes())) for k, v in sorted(model.p.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Model:
    return Model({r["name"]: np.frombuffer(r["data"], dtype="<f4").reshape(r["shape"]).copy() for r in spark.read.parquet(path).collect()})


def _labelled(pages: DataFrame, model: Model | None, rows, schema: str) -> DataFrame:
    """What rows makes of batches of the fetched pages, the texts of their runs, their counts and which are of the main body."""
    shared = shared_forms(pages)
    model = model or fit(pages, shared=shared)

    def label(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                blocks, texts, _ = features(*inputs(b))
                yield rows(b, texts, blocks.lengths, model.label(blocks) >= 0.5)

    return with_shared(fetched(pages), shared).mapInArrow(label, schema)


def _places(b, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The page of each run, and its number in it."""
    ids = np.repeat(b.column("page_id").to_numpy(), lengths)
    return ids, np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def labelled_runs(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, run_no, words, text, main) of every text run of the fetched pages.

    pages: page_id, url, status, html. Other statuses, null and empty html and null ids have no runs; html without a body
    tag is read from its start; unclosed and unknown tags do no harm. A repeated page_id is labelled for each row."""

    def rows(b, texts, lengths, main):
        ids, no = _places(b, lengths)
        flat = [t for own in texts for t in own]
        count = [t.count(" ") + 1 if t else 0 for t in flat]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(no, pa.int32()), pa.array(count, pa.int32()), pa.array(flat, pa.string()), pa.array(main)], ["page_id", "run_no", "words", "text", "main"])

    return _labelled(pages, model, rows, "page_id long, run_no int, words int, text string, main boolean")


def main_runs(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, run_no) of the runs of labelled_runs that are of the main body; no texts leave the labeller."""

    def rows(b, texts, lengths, main):
        ids, no = _places(b, lengths)
        return pa.RecordBatch.from_arrays([pa.array(ids[main], pa.int64()), pa.array(no[main], pa.int32())], ["page_id", "run_no"])

    return _labelled(pages, model, rows, "page_id long, run_no int")


def main_bodies(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, text, word_count, kept_ratio): the runs of the main body as lines, and their share of all shown words,
    rounded to 3 places; a page without runs has an empty text and ratio 0. One row a fetched row."""

    def rows(b, texts, lengths, main):
        out, start = [], 0
        for own in texts:
            keep = [t for t, m in zip(own, main[start : start + len(own)]) if m]
            start += len(own)
            kept, whole = sum(len(t.split()) for t in keep), sum(len(t.split()) for t in own)
            out.append(("\n".join(keep), kept, round(kept / whole, 3) if whole else 0.0))
        return pa.RecordBatch.from_arrays(
            [b.column("page_id"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.float64())], ["page_id", "text", "word_count", "kept_ratio"]
        )

    return _labelled(pages, model, rows, "page_id long, text string, word_count int, kept_ratio double")
