import math
import random

from pagewright.llm import textstats as ts

EN = frozenset("the of and to a in is it for with on that".split())
COMMON = {"en": EN, "de": frozenset("der die das und ist es für mit".split())}
PROSE = "The pump is in the yard and it is ready for the winter. It comes with a hose that fits on the valve."


def listed(text, common=COMMON):
    numbers = [n for n in ts.Measure(common).page(text)[-1] if n]
    return sum(n >> 2 for n in numbers if not n & 2) / sum(n >> 2 for n in numbers)


def test_statistics():
    lang, words, length, share, lines = ts.Measure(COMMON).page(PROSE)
    assert (lang, words) == ("en", len(PROSE.split())) and lines == [4 * words + 3] and 3 < length < 4
    assert share == round(sum(w.strip(".").lower() in EN for w in PROSE.split()) / words, 6)
    assert listed(PROSE) == 0 and listed("\n".join(["pump valve crate", "hose nozzle tray"] * 9)) == 1
    assert ts.Measure(COMMON).page("") == ("", 0, 0.0, 0.0, [0])
    assert ts.Measure({}).page("der die")[0] == ""


def test_character_shares():
    symbols, digits = ts.character_shares(["a1 !", "", " \n", "é\u00a0ß…🙂", "12"])
    assert symbols.tolist() == [round(1 / 3, 6), 0, 0, 0.5, 0] and digits.tolist() == [round(1 / 3, 6), 0, 0, 0, 1]


def test_lines():
    yes = [PROSE, PROSE.upper(), PROSE.replace(".", ""), "Quam assul fosque ligula gassam nunc."]
    no = ["pump valve crate tray", "x = pump(valve);", "2025-01-02T03:04:05 INFO the pump is on", "pump | the valve | 12", "wooden mast, cool rinse, mount digital", "¾sca²§©Ã©© ©Ã©¾âµ™©¤", "..."]
    assert all(listed(x) == 0 for x in yes) and all(listed(x) == 1 for x in no)


def test_exact_ranks_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b"]), rng.choice(["en", "de", ""]), float(rng.randint(0, 12)), rng.randint(1, 3)) for _ in range(400)]
    got = {(r["stat"], r["lang"], r["value"]): (r["below"], r["upto"], r["n"]) for r in ts.exact_ranks(spark.createDataFrame(rows, "stat string, lang string, value double, copies long")).collect()}
    for s, lang, v in {r[:3] for r in rows}:
        own = [(x[2], x[3]) for x in rows if x[:2] == (s, lang)]
        assert got[s, lang, v] == (sum(c for x, c in own if x < v), sum(c for x, c in own if x <= v), sum(c for _, c in own))


def test_outliers(spark):
    junk = "\n".join(["pump valve crate", "hose nozzle tray"] * 9)
    rows = [(i, PROSE * 3, "x", None) for i in range(20)] + [(50, junk, "x", None), (51, None, "x", None), (52, "", "x", None), (53, "too few words", "x", None), (50, junk, "x", None), (None, junk, "x", None), (54, PROSE * 4000, "x", None)]
    pages = spark.createDataFrame(rows, "page_id long, text string, score string, url string")
    common = spark.createDataFrame([(k, w) for k, v in COMMON.items() for w in v], "lang string, word string")
    found = ts.unlike_prose(pages, common).collect()
    assert {r["page_id"] for r in found} == {50, None}
    scores = ts.outlier_scores(ts.text_statistics(pages, common)).collect()
    assert len(scores) == len(rows) - 1 and all(math.isfinite(r["score"]) for r in scores)
    assert ts.unlike_prose(pages.limit(0), common).count() == 0
    assert ts.text_statistics(pages, common.limit(0)).count() == len(rows) - 1


def corpus(seed=5):
    """Prose, lists, and verses: lines with one common word each, but nothing else unlike prose."""
    rng = random.Random(seed)
    nouns = [a + b for a in "pa ve cro lin tem sor mar".split() for b in "mp lve nk der sto".split()]
    say = lambda: f"The {rng.choice(nouns)} is {rng.choice(['ready', 'old', 'dry'])} for the {rng.choice(nouns)} and it fits on that {' '.join(rng.choices(nouns, k=rng.randint(1, 7)))}."
    rows = [(i, "\n".join(" ".join(say() for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(2, 6)))) for i in range(300)]
    rows += [(1000 + i, "\n".join(f"{rng.choice(nouns)} {rng.choice(nouns)}; {rng.randint(1, 99)} / {rng.choice(nouns)}" for _ in range(rng.randint(9, 20)))) for i in range(30)]
    verse = lambda: " ".join(rng.sample(nouns, 3)) + " the " + " ".join(rng.sample(nouns, 4)) + "."
    rows += [(2000 + i, "\n".join(["It is on that and it is for it and that is in it."] * 4 + [verse() for _ in range(8)])) for i in range(4)]
    return rows


def test_the_score_decides(spark):
    common = spark.createDataFrame([(k, w) for k, v in COMMON.items() for w in v], "lang string, word string")
    pages = spark.createDataFrame([(i, t, None) for i, t in corpus()], "page_id long, text string, url string")
    lists = set(range(1000, 1030))
    alone = {r["page_id"] for r in ts.outlying(pages, common).collect()}
    assert lists <= alone and len(alone - lists) < 0.05 * 300  # the score alone parts prose from lists
    found = {r["page_id"] for r in ts.unlike_prose(pages, common).collect()}
    without = {r["page_id"] for r in ts.unlike_prose(pages, common, float("-inf")).collect()}
    assert lists <= found < without  # without the score other pages come out


def test_threshold_of_two_groups(spark):
    scores = spark.createDataFrame([(float(x % 7),) for x in range(90)] + [(20.0 + x % 3,) for x in range(10)], "score double")
    assert 6 < ts.score_threshold(scores) <= 20 and ts.score_threshold(scores.limit(0)) == float("inf")
    assert ts.score_threshold(scores.limit(1)) <= 0.0


def test_lines_that_the_site_repeats_count_for_neither_side(spark):
    common = spark.createDataFrame([(k, w) for k, v in COMMON.items() for w in v], "lang string, word string")
    site = "Zorb hall guild mark nine"
    rows = [(i, f"https://a.example/{i}", f"# A heading of the page\n{PROSE} Part {chr(97 + i)}.\n{site}") for i in range(12)] + [(90, "https://b.example", f"{PROSE}\n{site}")]
    got = {r["page_id"]: r for r in ts.text_statistics(spark.createDataFrame(rows, "page_id long, url string, text string"), common).collect()}
    assert all(got[i]["listed_share"] == 0 and got[i]["ended_share"] == 1 for i in range(12)) and got[90]["listed_share"] > 0
