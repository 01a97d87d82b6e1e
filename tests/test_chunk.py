import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.operators.chunk import _HEADING, _pieces, chunk_pages, chunk_text, numbered_pages, section_lines


def test_heading_paths():
    text = "before\n## A\none\n#### C\ntwo\n### B\nthree\n###### six\n## D\nfour"
    assert [h for h, _ in chunk_text(text, 1, 0)] == ["", "A", "A > C", "A > B", "A > B", "A > B", "D"]


def test_small_sections_merge_under_the_first_heading():
    assert chunk_text("## A\none two\n## B\nthree", 10, 2) == [("A", "one two\nthree")]


def test_empty_heading_owns_the_path():
    assert chunk_text("## A\n## B\nthree", 10, 2)[0][0] == "A"


def test_overlap_within_a_section():
    text = " ".join(f"w{i} x y z." for i in range(10))
    got = chunk_text(text, 12, 3)
    assert len(got) > 2
    for (_, a), (_, b) in zip(got, got[1:]):
        assert b.split()[:3] == a.split()[-3:]
    assert all(len(t.split()) <= 15 for _, t in got)


def test_no_overlap_and_run_on_sentence():
    got = [t for _, t in chunk_text("word " * 100, 30, 0)]
    assert [len(t.split()) for t in got] == [30, 30, 30, 10]


def test_the_rest_of_a_run_on_sentence_is_a_piece():
    text = " ".join(f"w{i}" for i in range(25)) + ". a b c."
    assert [len(t.split()) for _, t in chunk_text(text, 10, 0)] == [10, 10, 8]  # pieces of 10, 10, 5 and 3, packed
    assert _pieces(["x " * 25 + ". a b c."], 10)[2:] == ["x x x x x .", "a b c."]


def test_numbers_within_runs(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i) for i in rng.sample(range(10_000), 600)]
    got = {(r["run_id"], r["page_id"]): r["page_no"] for r in numbered_pages(spark.createDataFrame(rows, "run_id string, page_id long"), "run_id", "page_id").collect()}
    for run in ("a", "b", None):
        own = sorted(i for r, i in rows if r == run)
        assert [got[run, i] for i in own] == list(range(len(own)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["## H", "#### deep", "alpha beta. gamma", "", "one two three four five six seven. eight", "x" * 50]), max_size=30))
def test_without_overlap_no_word_is_lost(lines):
    text = "\n".join(lines)
    kept = [w for line in lines if not _HEADING.fullmatch(line) for w in line.split()]
    assert [w for _, t in chunk_text(text, 5, 0) for w in t.split()] == kept


def sequential(text):
    """A plain walk over the lines, to compare the windows with."""
    path, out, section = {}, [], 0
    for no, line in enumerate(text.split("\n")):
        line = line.strip()
        m = _HEADING.fullmatch(line)
        if m:
            path = {k: v for k, v in path.items() if k < len(m[1])} | {len(m[1]): m[2].strip()}
            section += 1
        elif line:
            out.append((no, section, " > ".join(path[k] for k in sorted(path)), line))
    return out


def test_section_lines_equal_a_walk(spark):
    rng = random.Random(3)
    texts = {i: "\n".join(rng.choice(["## a", "### b", "#### c", "##### d", "text", "", " more ", "#no"]) for _ in range(25)) for i in range(30)}
    got = section_lines(spark.createDataFrame(list(texts.items()), "page_id long, text string")).collect()
    for i, text in texts.items():
        assert sorted((r["line_no"], r["section_no"], r["heading_path"], r["line"]) for r in got if r["page_id"] == i) == sequential(text)


def test_pages(spark):
    rows = [(1, "u", "t", 0, "## A\none"), (2, "u", None, 99, None), (3, "u", None, 99, "one")]
    got = chunk_pages(spark.createDataFrame(rows, "page_id long, url string, title string, page_no int, text string")).orderBy("page_id").collect()
    assert [(r["page_id"], r["id"]) for r in got] == [(1, "p01-c0"), (3, "p100-c0")]
    with pytest.raises(ValueError):
        chunk_pages(spark.createDataFrame(rows, "page_id long, url string, title string, page_no int, text string"), 10, 10)
