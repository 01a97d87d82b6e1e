"""Sections under headings, and overlapping chunks of whole sections and sentences."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.sources.tables import cut

TARGET_WORDS, OVERLAP_WORDS = 280, 45
CHUNKS = "page_id long, page_url string, page_title string, page_no int, id string, idx int, heading_path string, text string, word_count int"
_SENTENCES = re.compile(r"(?<=[.!?])\s+")
_HEADING = re.compile(r"(#{2,5})\s+(.*)")


_LEVEL = re.compile(r"(#{2,5})\s+(?=\S)", re.A)
_LINES = "page_id long, line_no int, section_no int, heading_path string, line string"


def _walk(text: str):
    """(line_no, section_no, heading_path, line) of the lines with text."""
    stack: dict[int, str] = {}
    section, path = 0, ""
    for no, line in enumerate(text.split("\n")):
        line = line.strip(" ")
        if m := _LEVEL.match(line):
            level = len(m[1])
            stack = {k: v for k, v in stack.items() if k < level} | {level: line[m.end() :].strip(" ")}
            section, path = section + 1, " > ".join(stack[k] for k in sorted(stack))
        elif line:
            yield no, section, path, line


def section_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, section_no, heading_path, line): the lines with text, each with the path of the headings above.

    A heading clears the deeper ones. Heading lines and blank lines themselves don't come out; lines of six hashes are
    text. Lines stay where their page is: nothing is shuffled."""

    def run(batches):
        for b in batches:
            rows = [(i, *found) for i, text in zip(b.column("page_id").to_pylist(), b.column("text").to_pylist()) for found in _walk(text)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], [c.split()[0] for c in _LINES.split(", ")])

    return pages.where("text IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _LINES)


def _sections(text: str) -> list[tuple[str, list[str]]]:
    stack: dict[int, str] = {}
    out: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        m = _HEADING.fullmatch(line.strip())
        if m:
            stack = {k: v for k, v in stack.items() if k < len(m[1])}
            stack[len(m[1])] = m[2].strip()
            out.append((" > ".join(stack[k] for k in sorted(stack)), []))
        elif line.strip():
            out[-1][1].append(line)
    return out if out[0][1] else out[1:]


def _pieces(lines: list[str], target: int) -> list[str]:
    """A section as it is if it fits; else its sentences packed. A sentence over the target is cut at the target, and each
    of its parts, the rest too, is a piece of its own."""
    if sum(len(x.split()) for x in lines) <= target:
        return ["\n".join(lines)]
    out, now = [], []
    for sentence in _SENTENCES.split(" ".join(lines)):
        words = sentence.split()
        if now and len(now) + len(words) > target:
            out.append(" ".join(now))
            now = []
        if len(words) > target:
            out += [" ".join(words[at : at + target]) for at in range(0, len(words), target)]
        else:
            now = now + words
    return [*out, " ".join(now)] if now else out


def chunk_text(text: str, target: int = TARGET_WORDS, overlap: int = OVERLAP_WORDS) -> list[tuple[str, str]]:
    """(heading path, text) of the chunks of one text: pieces are added while they fit; a chunk that goes on within a
    section starts with the last `overlap` words of the piece before. The path is that of the chunk's first section, which
    may be one without lines of its own."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    size, path = 0, None

    def flush():
        nonlocal parts, size, path
        if body := "\n".join(p for p in parts if p):
            out.append((path or "", body))
        parts, size, path = [], 0, None

    for heading, lines in _sections(text):
        before = ""
        for n, piece in enumerate(_pieces(lines, target)):
            words = len(piece.split())
            if size and size + words > target:
                flush()
                if n and overlap:
                    seed = before.split()[-overlap:]
                    parts, size, path = [" ".join(seed)], len(seed), heading
            if path is None:
                path = heading
            parts.append(piece)
            size += words
            before = piece
    flush()
    return out


def chunk_pages(pages: DataFrame, target: int = TARGET_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """CHUNKS of each page: page_id, url, title, text and page_no, the number of the page in its run from 0. A page is cut
    on its own, so the work spreads as the pages do. Null texts have no chunks."""
    if not 0 <= overlap < target:
        raise ValueError("the overlap must be less than the target")

    def run(batches):
        for b in batches:
            rows = []
            for page_id, url, title, no, text in zip(b["page_id"], b["url"], b["title"], b["page_no"], b["text"]):
                for i, (path, body) in enumerate(chunk_text(text, target, overlap)):
                    rows.append((page_id, url, title, no, f"p{no + 1:02d}-c{i}", i, path, body, len(body.split())))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return pages.where(F.col("text").isNotNull()).select("page_id", "url", "title", F.col("page_no").cast("int").alias("page_no"), "text").mapInPandas(run, CHUNKS)


def numbered_pages(pages: DataFrame, run: str, key: str) -> DataFrame:
    """(run, key, page_no): the number of each page within its run from 0, in order of the key.

    Only runs and keys are moved: they are range-partitioned and numbered in each partition, and a partition begins where
    those before it end, so no task holds a run."""
    parted = cut(pages.select(run, key).repartitionByRange(run, key).withColumn("part", F.spark_partition_id()))
    sums = parted.groupBy(run, "part").agg(F.count(F.lit(1)).alias("own"))
    before = Window.partitionBy(run).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(run).alias("_run"), F.col("part").alias("_part"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"))
    inside = parted.withColumn("n", F.row_number().over(Window.partitionBy("part", run).orderBy(key)) - 1)
    return inside.join(offsets, F.col(run).eqNullSafe(F.col("_run")) & (F.col("part") == F.col("_part"))).select(run, key, (F.col("offset") + F.col("n")).cast("int").alias("page_no"))
