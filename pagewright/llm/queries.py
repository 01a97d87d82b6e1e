"""The queries of the ten training-data problems, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.llm import main_content, mixing, near_duplicates, neighbours, packing, personal, residue, site_lines, splitting, textstats, tokens
from pagewright.sources.tables import table

_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_P1 = rf"""
WITH pages AS (
  SELECT page_id, regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host,
         string_split(text, chr(10)) AS lines
  FROM extracted_pages WHERE text IS NOT NULL),
l AS (SELECT page_id, host, i - 1 AS line_no, lines[i] AS line FROM pages, unnest(generate_series(1, len(lines))) AS t(i) WHERE host <> ''),
f AS (SELECT page_id, host, line_no, trim(regexp_replace(regexp_replace(lower(line), '{_WS}', ' ', 'g'), '[0-9]+', '0', 'g')) AS form
      FROM l WHERE NOT starts_with(line, '#') AND regexp_matches(line, '\p{{L}}')),
r AS (SELECT host, form FROM f GROUP BY host, form HAVING count(DISTINCT page_id) >= 12)
"""
_P1_FOUND = _P1 + "SELECT DISTINCT page_id, CAST(line_no AS INTEGER) AS line_no FROM f JOIN r USING (host, form)"
_P1_TEXTS = _P1 + """,
gone AS (SELECT DISTINCT page_id, line_no FROM f JOIN r USING (host, form)),
kept AS (SELECT l.page_id, l.line_no, l.line FROM l LEFT JOIN gone g ON l.page_id = g.page_id AND l.line_no = g.line_no WHERE g.page_id IS NULL)
SELECT p.page_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(g.n, 0) AS INTEGER) AS lines_removed
FROM extracted_pages p
LEFT JOIN (SELECT page_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM kept GROUP BY page_id) k ON p.page_id = k.page_id
LEFT JOIN (SELECT page_id, count(*) AS n FROM gone GROUP BY page_id) g ON p.page_id = g.page_id"""


def p1_found(spark, root):
    return site_lines.repeated_lines(table(spark, root, "extracted_pages"))


def p1_texts(spark, root):
    return site_lines.without_repeated_lines(table(spark, root, "extracted_pages"))


def p2_found(spark, root):
    return neighbours.neighbour_pairs(table(spark, root, "vec_chunks"), table(spark, root, "knn_probes"))


def p2_neighbours(spark, root):
    """Every row whose id is divisible by 50 against all rows."""
    vectors = table(spark, root, "vec_chunks")
    return neighbours.nearest(vectors, vectors.where("rowid_opt % 50 = 0").select("rowid_opt", F.lit(8).alias("k")))


def _texts(spark, root):
    pages = table(spark, root, "extracted_pages").select(F.lit("page").alias("item"), F.col("page_id").alias("item_id"), "text")
    chunks = table(spark, root, "chunks").select(F.lit("chunk").alias("item"), F.col("chunk_ord").alias("item_id"), "text")
    return pages.unionByName(chunks)


def p3_found(spark, root):
    return splitting.split_oversized(_texts(spark, root)).where("piece_no = 0").select("item", "item_id")


def p3_pieces(spark, root):
    return splitting.pieces(_texts(spark, root))


_WORD = _WS.replace("[", "[^", 1)
_P3_FOUND = f"""SELECT item, item_id FROM (
  SELECT 'page' AS item, page_id AS item_id, text FROM extracted_pages UNION ALL SELECT 'chunk', chunk_ord, text FROM chunks)
WHERE length(text) > 4000 OR len(regexp_extract_all(text, '{_WORD}')) > 325"""

def _sizes(spark, root):
    return tokens.with_tokens(table(spark, root, "documents"), ["doc_id"]).withColumnRenamed("doc_id", "item_id")


def p8_packed(spark, root):
    return packing.pack(_sizes(spark, root), table(spark, root, "containers"))


def p8_fill(spark, root):
    return packing.fill_report(p8_packed(spark, root))


def _mix(spark, root):
    docs = tokens.with_tokens(table(spark, root, "documents"), ["doc_id", "source"])
    return mixing.mix(docs, table(spark, root, "mix_targets"))


def p9_mix(spark, root):
    return _mix(spark, root)


def p9_shares(spark, root):
    return mixing.mix_report(_mix(spark, root), table(spark, root, "mix_targets"))


def _personal(spark, root):
    return personal.find_personal(table(spark, root, "documents"), table(spark, root, "given_names"))


def p10_found(spark, root):
    return _personal(spark, root).select("doc_id", "kind", "start_pos").distinct()


def p10_texts(spark, root):
    return personal.redact(table(spark, root, "documents"), _personal(spark, root))


def p5_found(spark, root):
    return near_duplicates.duplicate_pairs(_texts(spark, root))


def p5_groups(spark, root):
    return near_duplicates.duplicate_groups(_texts(spark, root))


def p7_found(spark, root):
    return main_content.main_runs(table(spark, root, "fetched_pages"))


def p7_bodies(spark, root):
    return main_content.main_bodies(table(spark, root, "fetched_pages"))


def p4_found(spark, root):
    return textstats.unlike_prose(table(spark, root, "extracted_pages"), table(spark, root, "common_words")).select("page_id")


def p4_scores(spark, root):
    return textstats.outlier_scores(textstats.text_statistics(table(spark, root, "extracted_pages"), table(spark, root, "common_words")))


def p6_found(spark, root):
    return residue.residue_pages(table(spark, root, "fetched_pages"), table(spark, root, "common_words"), table(spark, root, "extracted_pages")).select("page_id").distinct()


def p6_kept(spark, root):
    pages = table(spark, root, "extracted_pages").select("page_id", "url", "title", "text")
    return residue.without_residue(pages, table(spark, root, "fetched_pages"), table(spark, root, "common_words"))


QUERIES = {"p1_found": p1_found, "p1_texts": p1_texts, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p3_found": p3_found, "p3_pieces": p3_pieces, "p4_found": p4_found, "p4_scores": p4_scores, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_kept": p6_kept, "p7_found": p7_found, "p7_bodies": p7_bodies, "p8_packed": p8_packed, "p8_fill": p8_fill, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_texts": p10_texts}
ORACLE = {"p1_found": _P1_FOUND, "p1_texts": _P1_TEXTS, "p3_found": _P3_FOUND}
