"""Writing reports and artifacts below one folder a run."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(document: DataFrame, sections: DataFrame | None, artifacts: dict[str, DataFrame], folder: str) -> None:
    """report: the lines of the document as text files, in order of their names; report.json: a row a section with its
    points, an empty folder for a failed run (sections None); each artifact as JSON lines. What exists is replaced."""
    document.orderBy("part", "ord").select("line").write.mode("overwrite").text(f"{folder}/report")
    spark = document.sparkSession
    (spark.createDataFrame([], "section int") if sections is None else sections).write.mode("overwrite").json(f"{folder}/report.json")
    for name, df in artifacts.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
