"""python -m pagewright.cli PAGES STOP_WORDS OUT: fetched pages (Parquet) to a report and its artifacts."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from pagewright.operators.report import failed_document
from pagewright.plans import pipeline
from pagewright.sources.reports import write_report


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("pages")
    parser.add_argument("stop_words", help="Parquet with a column word")
    parser.add_argument("out")
    parser.add_argument("--run", default=time.strftime("run-%Y%m%d-%H%M%S"), help="name of the run")
    parser.add_argument("--top-k", type=int, default=6)
    parser.add_argument("--target-words", type=int, default=280)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("pagewright").getOrCreate()
    began = time.time()
    try:
        settings = pipeline.Settings(top_k=args.top_k, target_words=args.target_words)
        stages = pipeline.run(spark.read.parquet(args.pages), spark.read.parquet(args.stop_words), settings)
        sections = stages.report.join(pipeline.sections_table(spark).select("section", "section_id", "title"), "section_id")
        write_report(stages.document, sections, {"pages": stages.pages, "chunks": stages.chunks, "points": stages.points, "stages": stages.counts}, args.out)
    except Exception as e:
        error = f"{type(e).__name__}: {e}"[:500]
        write_report(failed_document(spark, "Site report", args.run, error), None, {}, args.out)
        print(json.dumps({"ok": False, "error": error}), file=sys.stderr)
        return 1
    print(json.dumps({"ok": True, "out": args.out, "stages": stages.seconds, "seconds": round(time.time() - began, 1)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
