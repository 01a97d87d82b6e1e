from pagewright.llm import personal
from pagewright.llm.mentions import mentions

GIVEN = frozenset(["anna", "omar", "jean-luc", "mark", "will"])


def found(text):
    return {(k, text[a:b]) for a, b, k, sure, *_ in mentions(text, GIVEN) if sure}


def test_emails():
    for text, mail in (("Write to a.b+c@x-y.example.", "a.b+c@x-y.example"), ("mailto:INFO@A.EXAMPLE", "INFO@A.EXAMPLE"), ("info AT mail DOT a DOT test", "info AT mail DOT a DOT test"), ("jo (at) a (dot) example", "jo (at) a (dot) example"), ("jo[at]a-b.example", "jo[at]a-b.example"), ("jo＠a.example", "jo＠a.example")):
        assert found(text) == {("email", mail)}, text
    assert found("Follow @pump for news at the dot") == set()


def test_phones_and_numbers():
    for phone in ("+49 30 23125170", "(260) 555-0178", "+44 (0)7700 900 397", "030 23125 587", "01.99.00.39.20", "0049-30-23125-116", "1-800-555-0176", "612.555.0102", "952 555 013 1"):
        assert found(f"Please call {phone} before noon.") == {("phone", phone)}, phone
    for text in ("Tracking 5630581990 shows it", "Batch 31 17 70 passed", "The range is 029 - 063 metres", "Version 27.92.26", "Order no. KXV-8563", "listens on 192.0.2.95", "Invoice 2025/6337", "Part 40-70-99 fits", "EAN 2006064941 is"):
        assert found(text) == set(), text
    assert found("passport no.: CP3790268; address") == {("id_number", "CP3790268")}
    assert found("lists 941 22 0803 as the SSN of") == {("id_number", "941 22 0803")}


def test_addresses():
    for place in ("Flat A, 165 Fuller's Yard, Obernham", "P.O. Box 18, Thornby 99066", "45 SADDLER STREET, FALSTEAD", "115 N. Juniper Blvd., Kestford 99570", "Ankerplatz 110, 99520 Linnfeld", "93 bis, chemin des Saules, 99196 Bramstead", "Calle del Olmo 162, 3.º B, 99401 Querford", "C. Cordeleros 13, 99377 Linnfeld"):
        assert ("address", place) in found(f"It is at {place}. More"), place


def test_names():
    assert found("Dear Ms Thornowski, the pump") == {("name", "Thornowski")}
    assert found("Ask Anna Wickett now") == {("name", "Anna Wickett")}
    assert found("by Wickett, Omar.") == {("name", "Wickett, Omar")}
    assert found("Will the pump fit? Mark the pump.") == set()


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kind string")


def test_contexts_find_unlisted_names_and_numbers(spark):
    rows = [(i, f"Our new planner Anna Wick{'abcdefgh'[i % 8]}er joined at noon.") for i in range(20)]
    rows += [(100, "Our new planner Zyx joined at noon."), (101, "The pump Zork works at noon.")]
    rows += [(200 + i, f"Passport no.: CP379{i:02d}88 is here.") for i in range(30)] + [(300 + i, f"She showed the paper CP11902{i}8 then.") for i in range(6)] + [(400, "She showed the paper 44-AB-1234 then.")]
    rows += [(500, None), (501, ""), (None, "Ask Anna Wicker"), (0, rows[0][1]), (502, "Ask Anna Wicker. " + "pump " * 60000)]
    df = docs(spark, rows)
    given = spark.createDataFrame([("Anna",), (None,), ("",), ("Omar",)], "given_name string")
    got = {(r["doc_id"], r["kind"], r["start_pos"]) for r in personal.find_personal(df, given).collect()}
    assert (100, "name", 16) in got and not any(d == 101 for d, *_ in got)
    assert (303, "id_number", 21) in got and (400, "id_number", 21) in got
    texts = {r["doc_id"]: r["text"] for r in personal.redact(df, personal.find_personal(df, given)).collect() if r["doc_id"] is not None}
    assert texts[100] == "Our new planner [NAME] joined at noon." and texts[500] is None and texts[501] == ""
    assert texts[502].startswith("Ask [NAME]. pump") and texts[101] == "The pump Zork works at noon."


def test_patterns_alone_find_odd_forms(spark):
    """Phones, emails and addresses are seeds too: their contexts accept forms that no grammar decides, and only there."""
    rows = [(i, f"Please ring the yard on 030 23125 {500 + i} before noon.") for i in range(12)] + [(20 + i, f"Mail the office under bo{i}@a.example today.") for i in range(6)]
    rows += [(40 + i, f"The pump was left at {10 + i} Tanner Lane, Eldby, on Monday.") for i in range(6)]
    rows += [(100, "Please ring the yard on 7 31 55 20 8 before noon."), (101, "The pump ran on 7 31 55 20 8 turns."), (102, "Mail the office under bo at a-b.example today."), (103, "We look at a-b.example pages.")]
    rows += [(104, "The pump was left at 12 Alter Kranhof, Eldby, on Monday."), (105, "The store sold 12 Alter Kranhof, Eldby crates.")]
    df = docs(spark, rows)
    sure = {(i, k) for i, t in rows for k, _ in found(t)}
    got = {(r["doc_id"], r["kind"], r["start_pos"]) for r in personal.find_personal(df, spark.createDataFrame([("Anna",)], "given_name string")).collect()}
    odd = {(100, "phone", 24), (102, "email", 22), (104, "address", 21)}
    assert odd <= got and not {(i, k) for i, k, _ in odd} & sure
    assert not any(i in (101, 103, 105) for i, k, _ in got if k != "name")


def test_long_mailboxes_and_many_places():
    box = "a" * 300
    assert found(f"Write to {box}@b.example now") == {("email", f"{box}@b.example")}
    assert len(found("\n".join(f"x{i}@b.example, 030 23125 {100 + i % 900}" for i in range(3000)))) == 3900


def test_empty(spark):
    none = docs(spark, [])
    given = spark.createDataFrame([("Anna",)], "given_name string")
    assert personal.find_personal(none, given).count() == 0
    assert personal.find_personal(docs(spark, [(1, "Ask Anna Wicker")]), given.limit(0)).count() == 0
