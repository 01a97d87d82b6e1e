import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import splitting as sp

piece = st.sampled_from(["word ", "two words. ", "\n", "\n\n## Head\n", "x" * 30, "a b ", "Ende! ", "\t"])


@settings(max_examples=150, deadline=None)
@given(st.lists(piece, max_size=80).map("".join), st.integers(2, 12), st.integers(8, 60), st.integers(0, 5))
def test_pieces_are_within_limits_and_give_the_text(text, words, chars, overlap):
    overlap = min(overlap, words - 1)
    spans = sp.piece_spans(text, words, chars, overlap)
    t = sp._Text(text)
    rebuilt, at = "", 0
    for a, b in spans:
        assert a <= at <= b
        rebuilt += text[at:b]
        at = b
        assert b - a <= chars and t.words(a, b) <= words
    assert rebuilt == text


def test_overlap_and_natural_cuts():
    text = "".join(f"## Part {i}\n" + "Some words here. " * 30 + "\n" for i in range(6))
    spans = sp.piece_spans(text, 100, 4000, 10)
    for (_, b), (c, _) in zip(spans, spans[1:]):
        assert len(text[c:b].split()) == 10
        assert text[b:].startswith("##") or text[:b].rstrip()[-1] in ".!?"


def test_frames(spark):
    rows = [("page", 1, "w " * 400, "x"), ("page", 2, "short", "x"), ("page", 3, None, "x"), ("page", 4, "", "x"), ("chunk", 1, "y" * 9001, "x"), ("chunk", 1, "y" * 9001, "x"), ("page", 5, " " * 4001, "x"), ("page", 6, "w " * 326, "x"), ("page", 7, "w " * 325, "x")]
    df = spark.createDataFrame(rows, "item string, item_id long, text string, piece_no string")
    got = sp.split_oversized(df).collect()
    assert {(r["item"], r["item_id"]) for r in got} == {("page", 1), ("chunk", 1), ("page", 5), ("page", 6)}
    assert all(r["words"] <= 325 and len(r["text"]) <= 4000 for r in got)
    every = sp.pieces(df).collect()
    assert {r["item_id"] for r in every if r["item"] == "page"} == {1, 2, 4, 5, 6, 7}
    assert sp.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sp.split_oversized(df, 10, 100, 10)
