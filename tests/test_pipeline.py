import json
import os
import time

import pytest
from pyspark.sql import functions as F

from pagewright.plans import pipeline
from pagewright.sources import evalset, reports
from pagewright.streaming import ingest

BODY = "<body><main><h1>{0}</h1>" + "<p>The {0} costs 12 euros and every customer of the shop asks our workshop team for the price of delivery.</p>" * 6 + "</main></body>"
SCHEMA = "page_id long, run_id string, url string, status int, content_type string, html string, fetched_at timestamp, error string, depth int, source string, stored_at timestamp"


def fetched(spark, n=4):
    from datetime import datetime, timedelta

    day = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, "run", f"https://s.example/{i}", 200, "text/html", BODY.format(f"pump{i}"), day, None, 0, "http", day + timedelta(hours=i)) for i in range(n)], SCHEMA)


def test_end_to_end(spark, tmp_path):
    got = pipeline.run(fetched(spark), spark.createDataFrame([("the",)], "word string"))
    ids = {r["chunk_ord"] for r in got.chunks.collect()}
    points = got.points.collect()
    assert points and {r["chunk_ord"] for r in points} <= ids and len({r["chunk_ord"] for r in points}) == len(points)
    assert got.report.count() == 5
    assert {r["stage"]: r["items"] for r in got.counts.collect()} | {"points": 0, "retrieved": 0} == {"fetched": 4, "read": 4, "extracted": 4, "kept": 4, "chunks": 4, "retrieved": 0, "points": 0}
    assert {"extracted", "chunks", "retrieved", "points"} == set(got.seconds)
    reports.write_report(got.document, got.report, {"pages": got.pages}, str(tmp_path / "out"))
    assert sum(1 for f in os.listdir(tmp_path / "out/pages") if f.endswith(".json")) >= 1
    text = "".join(p.read_text() for p in sorted((tmp_path / "out/report").glob("part-*")))
    places = [text.index(x) for x in ("# Site report", "## Executive summary", "## Overview", "## Company", "## Pages", "| https://s.example/2 |", "## Stages", "| chunks | 4 |", "## Citations")] + [text.rindex("https://s.example/3)")]
    assert places == sorted(places)
    assert {r["section_id"] for r in spark.read.json(str(tmp_path / "out/report.json")).collect()} >= {"overview", "company"}


def test_settings_are_checked():
    with pytest.raises(ValueError):
        pipeline.Settings(target_words=100, overlap_words=100)
    with pytest.raises(ValueError):
        pipeline.Settings(top_k=0)


def test_evalset(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text(json.dumps({"query": "q", "expected_url": "u"}) + "\n\n" + json.dumps({"query": "r", "expected_url": "u", "expected_snippet": "s"}) + "\n")
    assert [tuple(r) for r in evalset.read(spark, str(tmp_path / "e.jsonl")).orderBy("query").collect()] == [("q", "u", ""), ("r", "u", "s")]


def test_stream_takes_each_page_once(spark, tmp_path):
    source = fetched(spark)
    source.write.parquet(str(tmp_path / "in"))
    source.write.mode("append").parquet(str(tmp_path / "in"))
    pages = ingest.page_stream(spark, str(tmp_path / "in"), source.schema)
    q = ingest.extract_to(pages, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(r["page_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3]


def test_stream_keeps_old_pages_after_a_late_one(spark, tmp_path):
    from datetime import datetime, timedelta

    source, day = fetched(spark, 6), datetime(2024, 1, 1)
    parts = [
        source.where("page_id = 5").withColumn("stored_at", F.lit(day + timedelta(days=300))),
        source.where("page_id IN (0, 1)"),
        source.where("page_id IN (1, 2)").withColumn("stored_at", F.lit(None).cast("timestamp")),
        source.where("page_id = 3").withColumn("status", F.lit(404)),
        source.where("page_id IN (3, 5)"),
        source.where("page_id = 4").withColumn("page_id", F.lit(None).cast("long")),
        source.where("page_id = 4").withColumn("page_id", F.lit(None).cast("long")),
    ]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)  # files are taken by their time
    for _ in range(2):
        q = ingest.extract_to(ingest.page_stream(spark, str(tmp_path / "in"), source.schema, 1), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"https://s.example/{i}" for i in range(6)]
        source.where("page_id = 2").write.mode("append").parquet(str(tmp_path / "in"))


def test_cli(spark, tmp_path):
    from pagewright import cli

    fetched(spark).write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([("the",)], "word string").write.parquet(str(tmp_path / "stop"))
    assert cli.main([str(tmp_path / "pages"), str(tmp_path / "stop"), str(tmp_path / "out")]) == 0
    assert cli.main([str(tmp_path / "none"), str(tmp_path / "stop"), str(tmp_path / "out2")]) == 1
    assert (tmp_path / "out" / "points").is_dir() and (tmp_path / "out" / "stages").is_dir()
    assert cli.main([str(tmp_path / "none"), str(tmp_path / "stop"), str(tmp_path / "out2"), "--run", "run-7"]) == 1
    text = "".join(p.read_text() for p in (tmp_path / "out2/report").glob("part-*"))
    assert "run-7" in text and "failed" in text and (tmp_path / "out2/report.json").is_dir() and not (tmp_path / "out2/points").exists()
