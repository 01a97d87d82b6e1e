import numpy as np

from pagewright.llm import lstm, main_content, residue
from pagewright.llm.htmlruns import runs_of

CONTENT = "<p>" + "The old pump in the yard is ready for the winter and comes with a new hose. " * 6 + "</p>"


def kind(body):
    return residue.residue_of(f"<html><body>{body}</body></html>", frozenset("the in is for and with a".split()))


def test_residue():
    assert kind(CONTENT) is None
    assert kind(CONTENT + "<p>The {{ pump.price }} is in the yard.</p>") == "placeholder"
    for left in ("${PUMP.NAME}", "{% pump city %}", "[[pump:id]]", "@@pump_url@@", "%PUMP_URL%", "__pump_name__", "XXPUMP-CITYXX", "{pump_title}", "[INSERT pump name HERE]", "&lt;%= pump.date %&gt;", "TODO: pump url"):
        assert kind(CONTENT + f"<p>We keep the {left} in the yard.</p>") == "placeholder", left
    assert kind(CONTENT + "<p>Dear undefined, your pump costs null euros.</p>") == "unset"
    assert kind("<h1>Your headline here</h1><p>Lorem ipsum dolor sit amet quam nunc.</p>") == "filler"
    assert kind("<p>" + "Assul vorem menta ligula quam blokka. Vorem quam assul menta ligula. " * 4 + "</p>") == "filler"
    for note in ("404 - the pump that you want is not here.", "Access denied.", "Bitte aktivieren <b>Sie JavaScript</b>, um Pumpen zu sehen.", "Die Seite Pumpe wurde leider nicht gefunden.", "Sitio en mantenimiento: volverá pronto."):
        assert kind(f"<p>{note}</p>") == "notice", note
    assert kind('<div id="app"></div><noscript>Turn on scripts to see pumps.</noscript>') == "notice"


def test_explained_is_no_residue():
    for text in ("<p>Write {{ pump }} in the mail template and the mailer fills in the name.</p>", "<p>In the script, ${pump} stands for the valve.</p>", "<pre>{{ pump.price }}</pre>", "<p>Undefined terms in a contract cost more.</p>", "<p>The guide shows how we replaced the words 'page not found' with a search.</p>"):
        assert kind(CONTENT + text) is None, text
    assert kind(CONTENT + "<noscript>Turn on scripts to see more.</noscript>") is None


def test_residue_frames(spark):
    rows = [(1, 200, "<body><p>Access denied.</p>", 0), (1, 200, "<body><p>Access denied.</p>", 0), (2, 404, "<body>Access denied.", 0), (3, 200, None, 0), (4, 200, "", 0), (5, 200, f"<body>{CONTENT}", 0), (None, 200, "<p>Access denied.", 0), (6, 200, "<body>" + CONTENT * 300, 0), (7, 200, "<<<>", 0)]
    df = spark.createDataFrame([(*r, "https://a.example/") for r in rows], "page_id long, status int, html string, residue int, url string")
    common = spark.createDataFrame([("the",)], "word string")
    assert [tuple(r) for r in residue.residue_pages(df, common).collect()] == [(1, "notice")]
    assert residue.residue_pages(df.limit(0), common.limit(0)).count() == 0
    texts = spark.createDataFrame([(1, "a"), (5, "b"), (9, "c")], "page_id long, text string")
    assert {r["page_id"] for r in residue.without_residue(texts, df, common).collect()} == {5, 9}


def test_extracted_text_is_read_too(spark):
    noise = "".join(f"<p>Our guild {w} the old hall in the yard and asks each member to bring a lamp for it.</p>" for w in ("opens", "paints", "sweeps", "guards", "heats"))
    pages = spark.createDataFrame([(1, 200, noise + "<p>Access denied.</p>", "u"), (2, 200, None, "u"), (3, 404, None, "u"), (4, 200, f"<body><pre>{{{{ pump.price }}}}</pre>{CONTENT}", "u"), (5, 200, "<body>" + CONTENT, "u")], "page_id long, status int, html string, url string")
    texts = spark.createDataFrame([(1, "Access denied."), (2, "The pump costs {{ pump.price }} now."), (3, "Access denied."), (4, "{{ pump.price }}"), (5, None), (None, "Access denied."), (77, "Access denied.")], "page_id long, text string")
    common = spark.createDataFrame([("the",), ("is",)], "word string")
    assert {tuple(r) for r in residue.residue_pages(pages, common, texts).collect()} == {(1, "notice"), (2, "placeholder")}
    assert residue.residue_pages(pages, common).count() == 0


def test_lines_that_a_site_repeats_are_no_content(spark):
    site = "".join(f"<p>Members of the guild {w} the hall on each third moon and leave a coin for the lamp in the bowl.</p>" for w in ("sweep", "guard", "paint", "heat"))
    rows = [(i, 200, f"<body>{site}<p>The lamp of part {chr(97 + i)} is in the yard and it is ready for the long winter of the hall.</p>{CONTENT}", "https://guild.example/") for i in range(14)]
    rows += [(90, 200, f"<body>{site}<p>Access denied.</p>", "https://guild.example/x"), (91, 200, f"<body>{site}<p>Access denied.</p>", "https://other.example/x")]
    found = residue.residue_pages(spark.createDataFrame(rows, "page_id long, status int, html string, url string"), spark.createDataFrame([("the",)], "word string"))
    assert {r["page_id"] for r in found.collect()} == {90}  # elsewhere these lines are content


def test_hints_let_every_grammar_through():
    for text in (
        "Error QX-12: no luck", "The server did not answer in time", "The page could not be found", "Nothing matches your filter", "No records", "Seite wurde nicht gefunden", "La page est introuvable", "Ce site n'existe pas", "No se ha encontrado la página", "Access is denied",
        "You don't have permission", "Your session has expired", "Checking your browser", "Prove you are human", "Down for maintenance", "Site under construction", "Unhandled exception", "Null pointer in row 3", "Headers already sent", "Fatal error", "cannot be displayed",
        "Default page of the server", "Gateway timeout", "Please enable cookies", "This needs JavaScript", "Scripts are off; switch them on", "JavaScript is required", "Es wird JavaScript benötigt", "Il nécessite JavaScript", "This browser blocks cookies", "Demnächst mehr",
    ):
        assert residue.MESSAGE.search(text) and residue._message(text), text
    for text in ("It costs None euros", "undefined", "NaN", "(null)", "[object Object]"):
        assert residue.UNSET.search(text) and any(h in text for h in residue._HINTS), text


def test_long_messages_and_models(spark, tmp_path):
    trace = "<p>Unhandled exception " + " ".join(f"at mod.run{i}(file.py:{i})" for i in range(300)) + "</p>"
    assert kind(trace) == "notice"
    model = lstm.Model.new(20, 10, 3)
    main_content.save_model(spark, model, str(tmp_path / "m"))
    again = main_content.load_model(spark, str(tmp_path / "m"))
    assert all(np.array_equal(model.p[k], again.p[k]) for k in model.p)


def test_runs():
    runs = runs_of("<html><head><title>no</title></head><body><!-- <p>x</p> --><script>a<b</script><ul><li>one<li>two</ul><p>a <b>b</b> c<p>d</body>")
    assert [r.text for r in runs] == ["one", "two", "a ", "b", " c", "d"]
    assert runs[1].path == ("body", "ul", "li") and runs[5].path == ("body", "p")


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    model = lstm.Model.new(20, 10, 3, seed=1)
    counts = np.array([2, 1, 0, 3, 2])
    blocks = lstm.Blocks(rng.integers(0, 20, counts.sum()), counts, rng.integers(0, 10, 5), np.ones(5, int), rng.normal(size=(5, 3)).astype(np.float32), np.array([3, 2]))
    y, w = np.array([1, 0, 1, 0, 1], np.float32), np.ones(5, np.float32)

    def loss(m):
        p = np.clip(m.label(blocks), 1e-7, 1 - 1e-7)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    first, state = loss(model), {}
    for _ in range(60):
        model.train_step(blocks, np.array([0, 1]), y, w, state, 0.02)
    assert loss(model) < 0.1 * first


def pages(spark, n=60):
    import random

    rng, rows = random.Random(1), []
    nouns = [x + y for x in "pa ve cro lin tem sor".split() for y in "mp lve nk der sto".split()]
    for i in range(n):
        a = "The " + " and the ".join(rng.sample(nouns, 6)) + " are ready for the pump."
        b = "A " + " or a ".join(rng.sample(nouns, 5)) + " is in the yard."
        rows.append((i, f"https://s{i % 6}.example/p{i}", 200, f"<html><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>Shop</a></li></ul></nav><main><h1>Title of {i}</h1><p>{a} {a}</p><p>Share this page: Mail</p><p>{b}</p></main><footer><p>© 2024 All rights reserved.</p></footer></body></html>", "z"))
    return rows


def test_main_bodies(spark):
    rows = pages(spark) + [(900, "u", 404, "<body>x", "z"), (901, "u", 200, None, "z"), (902, "u", 200, "", "z"), (903, None, 200, "<body></body>", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, status int, html string, text string")
    model = main_content.fit(df)
    got = {}
    for r in main_content.labelled_runs(df, model).collect():
        got.setdefault(r["page_id"], {})[r["run_no"]] = r["main"]
    good = sum(v == [False, False, True, True, False, True, False][n] for i in range(60) for n, v in got[i].items())
    assert good >= 0.95 * 60 * 7 and 900 not in got and 901 not in got
    bodies = {r["page_id"]: r for r in main_content.main_bodies(df, model).collect()}
    assert "pump" in bodies[3]["text"] and 0 < bodies[3]["kept_ratio"] < 1 and bodies[903]["kept_ratio"] == 0
    assert main_content.labelled_runs(df.limit(0)).count() == 0


def test_site_lines_are_counted_over_all_pages_not_the_sample(spark):
    rows, n = [], 0
    for host in range(12):
        for i in range(14):
            own = " ".join(f"The {w} of part {chr(97 + host)}{chr(97 + i)} is ready for the {w} in the yard." for w in ("pump", "valve", "hose"))
            site = f"Our old hall number {chr(97 + host) * 3} opens its door to every member of the guild."
            rows.append((n, f"https://guild{chr(97 + host)}.example/p{i}", 200, f"<html><body><main><h1>Part {i}</h1><p>{own}</p><p>{site}</p></main></body></html>"))
            n += 1
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, status int, html string")
    shared = main_content.shared_forms(df)
    assert {max(r["pages"]) for r in shared.collect()} == {14}  # the row that is there twice counts once
    model = main_content.fit(df, sample_pages=24)
    got = main_content.labelled_runs(df, model).collect()
    assert sum(r["main"] == (r["run_no"] < 2) for r in got) >= 0.98 * 3 * (n + 1)


def test_labels_need_no_padding_and_agree_with_single_steps():
    import tracemalloc

    rng = np.random.default_rng(3)
    lengths = np.array([4, 0, 3000, 1, *[2] * 120, 7, 0])
    n = int(lengths.sum())
    blocks = lstm.Blocks(rng.integers(0, 20, n), np.ones(n, int), rng.integers(0, 10, n), np.ones(n, int), rng.normal(size=(n, 3)).astype(np.float32), lengths)
    model = lstm.Model.new(20, 10, 3, seed=1)
    tracemalloc.start()
    got = model.label(blocks)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20_000_000  # side by side with the long document, the short ones would take ten times as much
    x, mask, at = model.inputs(blocks), np.ones((3000, 1), np.float32), 0
    for k in lengths:
        own = x[at : at + k][:, None]
        if k:
            seen = np.concatenate([model._pass(own, mask[:k], "f"), model._pass(own, mask[:k], "b"), own], axis=2)[:, 0] @ model.p["out"] + model.p["bias"]
            assert np.allclose(got[at : at + k], lstm._sigmoid(seen[:, 0]), atol=1e-5)
        at += k
    assert len(model.label(lstm.take(blocks, np.arange(0)))) == 0


def test_inputs_hold_tags_once_a_path_and_training_still_gets_them_all():
    pages = [runs_of("<body><main>" + "".join(f"<p>Pump no.{i} and B{i}c in 20{i}, Größe {i}m³</p>" for i in range(50)) + "</main>"), [], runs_of("<body><p>a")]
    blocks, _, _ = main_content.features(pages, ["a.example", None, None], [{}, {}, {}])
    assert len(blocks.tag_counts) == 2 and list(blocks.lengths) == [50, 0, 1]
    whole = lstm.take(blocks, np.arange(51))
    assert len(whole.tag_counts) == 51 and whole.tags[:4].tolist() == whole.tags[4:8].tolist()
    words = main_content._words
    for low in ("pump no.3 and b3c in 2003", "größe 20 m", "007 00x", "", "-- 5"):
        tokens, digits = main_content._tokens(low)
        assert [words[t] for t in tokens] == [words[t] for t in main_content._WORD.findall(low)] and digits == sum(c.isdecimal() for c in low), low
        assert main_content._zeros(low) == main_content._DIGITS.sub("0", low)


def test_main_runs_are_those_of_labelled_runs(spark):
    df = spark.createDataFrame([*pages(spark, 12), (3, "u", 200, "<body><p>The pump is in the yard.</p>", "z"), (901, "u", 200, None, "z"), (903, None, 200, "<body></body>", "z")], "page_id long, url string, status int, html string, text string")
    model = main_content.fit(df)
    found = main_content.main_runs(df, model)
    assert found.columns == ["page_id", "run_no"]
    wanted = main_content.labelled_runs(df, model).where("main").select("page_id", "run_no")
    assert wanted.count() > 20 and found.exceptAll(wanted).count() == 0 and wanted.exceptAll(found).count() == 0
    assert main_content.main_runs(df.limit(0)).count() == 0
