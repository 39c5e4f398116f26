"""The block structure, metadata and grouping queries and their SQL, on Markdown documents made of orders.

The SQL never parses: it states the blocks of each document straight from the order and its lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import blocks, chunks, metadata, schemas, structure
from .sources.tables import MARKDOWN_BLOCKS_SQL, MARKDOWN_LINES_SQL, markdown_orders, table, tasks_for_orders

_B = f"({MARKDOWN_BLOCKS_SQL})"
_TYPES = "CASE type WHEN 'title' THEN 'heading' WHEN 'section_break' THEN 'separator' WHEN 'code' THEN 'code' WHEN 'table' THEN 'table' ELSE 'paragraph' END"
_ELEMENTS = f"SELECT doc_id, s, block_no::BIGINT AS ord, printf('el-%04d', block_no + 1) AS element_id, {_TYPES} AS element_type, text, path FROM {_B}"


def _lines(spark, sf):
    return structure.gathered_lines(markdown_orders(spark, sf))


def _rows(spark, sf, *kinds):
    return blocks.block_rows(_lines(spark, sf), *kinds)


def _sections(spark, sf):
    """The blocks are dealt by document among as many tasks as the orders, so that the windows sort no more in a task as the tables grow."""
    return blocks.section_paths(_rows(spark, sf).repartition(tasks_for_orders(spark, sf), "doc_id"))


def _elements(spark, sf):
    return blocks.elements(_sections(spark, sf))


def _of(kinds):
    return lambda s, d: _rows(s, d, kinds).select("doc_id", "block_no", "type", "text", F.col("line_start").cast("long"), F.col("line_end").cast("long"))


def _of_sql(kinds):
    return f"SELECT doc_id, block_no, type, text, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end FROM {_B} WHERE type IN {kinds}"


def _versions(spark, sf):
    return metadata.extract_version(structure.front_matter(_elements(spark, sf)))


def _grouped(spark, sf):
    return blocks.drop_ignored(_elements(spark, sf), ("status f", "glossary"))


_GROUPED = "SELECT doc_id, ord, element_id, path, text, CASE WHEN s = 'F' AND ord >= 8 THEN 2 ELSE 1 END::BIGINT AS group_no FROM (" + _ELEMENTS + ") WHERE s <> 'F' OR ord NOT BETWEEN 2 AND 7"


def _grouped_units(spark, sf):
    rows = _grouped(spark, sf).select("doc_id", "ord", "element_id", F.array_join("section_path", " > ").alias("section"), "group_no", "text", F.lit(None).cast("int").alias("page"))
    return chunks.section_units(chunks.render_markers(rows))


SMALL = 90
# The twin goes from element to element with what its chunk holds; a chunk ends with its group.
_GROUPED_CHUNKS_SQL = f"""WITH RECURSIVE u AS MATERIALIZED (SELECT *, length('[ELEMENT: ' || element_id || ']' || chr(10) || text) AS size, sum(length('[ELEMENT: ' || element_id || ']' || chr(10) || text)) OVER (PARTITION BY doc_id, group_no, path) AS unit_size, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM ({_GROUPED})),
 f AS (SELECT doc_id, rn, ord, group_no, path, 1::BIGINT AS chunk_no, CASE WHEN unit_size > {SMALL} THEN size ELSE unit_size END AS held, unit_size > {SMALL} AS big FROM u WHERE rn = 1
 UNION ALL SELECT u.doc_id, u.rn, u.ord, u.group_no, u.path, f.chunk_no + (CASE WHEN u.group_no <> f.group_no THEN 1 WHEN u.path <> f.path THEN (f.big OR u.unit_size > {SMALL} OR f.held + u.unit_size > {SMALL})::INT ELSE (f.big AND f.held + u.size > {SMALL})::INT END),
 CASE WHEN u.group_no <> f.group_no OR u.path <> f.path THEN (CASE WHEN u.unit_size > {SMALL} THEN u.size WHEN u.group_no <> f.group_no OR f.big OR f.held + u.unit_size > {SMALL} THEN u.unit_size ELSE f.held + u.unit_size END) WHEN NOT f.big THEN f.held WHEN f.held + u.size > {SMALL} THEN u.size ELSE f.held + u.size END, u.unit_size > {SMALL}
 FROM f JOIN u ON u.doc_id = f.doc_id AND u.rn = f.rn + 1) SELECT doc_id, ord, group_no, chunk_no FROM f"""

REGISTRY = {
    "classify_lines": (lambda s, d: blocks.classified(_lines(s, d)).select("doc_id", "line_no", "body", "label", F.coalesce("level", F.lit(0)).cast("int").alias("level"), "title"), f"SELECT doc_id, line_no::BIGINT AS line_no, body, label, coalesce(level, 0)::INT AS level, title FROM ({MARKDOWN_LINES_SQL})"),
    "numbered_headings": (lambda s, d: blocks.classified(_lines(s, d)).where("label = 'heading' and not startswith(body, '#')").select("doc_id", "line_no", F.col("level").cast("int").alias("level"), "title"), f"SELECT doc_id, line_start::BIGINT AS line_no, level::INT AS level, text AS title FROM {_B} WHERE block_no = 8"),
    "fence_ranges": (lambda s, d: _rows(s, d, ["code"]).select("doc_id", "block_no", "language", "text", F.col("line_start").cast("long"), F.col("line_end").cast("long")), f"SELECT doc_id, block_no, 'sql' AS language, text, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end FROM {_B} WHERE type = 'code'"),
    "table_blocks": (_of(["table"]), _of_sql("('table')")),
    "list_blocks": (_of(["list"]), _of_sql("('list')")),
    "quote_and_paragraph_blocks": (_of(["quote", "paragraph"]), _of_sql("('quote', 'paragraph')")),
    "assemble_blocks": (lambda s, d: _rows(s, d).select("doc_id", "block_no", "type", F.coalesce("level", F.lit(0)).cast("int").alias("level"), "text", F.col("line_start").cast("long"), F.col("line_end").cast("long")), f"SELECT doc_id, block_no, type, coalesce(level, 0)::INT AS level, text, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end FROM {_B}"),
    "document_title": (lambda s, d: blocks.document_title(_lines(s, d)), f"SELECT doc_id, text AS title FROM {_B} WHERE block_no = 0"),
    "table_cells": (lambda s, d: blocks.table_cells(_lines(s, d)), f"SELECT doc_id, block_no, r AS row_no, c AS col_no, trim(string_split(trim(part, '|'), '|')[c]) AS cell FROM (SELECT doc_id, block_no, string_split(text, chr(10))[r] AS part, r, unnest(range(1, 4)) AS c FROM (SELECT doc_id, block_no, text, unnest(range(1, n + 2)) AS r FROM {_B} WHERE type = 'table'))"),
    "section_paths": (lambda s, d: _sections(s, d).select("doc_id", "block_no", F.array_join("section_path", " > ").alias("path")), f"SELECT doc_id, block_no, path FROM {_B}"),
    "map_element_types": (lambda s, d: _elements(s, d).groupBy("doc_id", "element_type").agg(F.count("*").alias("n")), f"SELECT doc_id, {_TYPES} AS element_type, count(*) AS n FROM {_B} GROUP BY ALL"),
    "block_elements": (lambda s, d: _elements(s, d).withColumn("path", F.array_join("section_path", " > ")).drop("section_path"), f"SELECT doc_id, ord, element_id, element_type, text, path FROM ({_ELEMENTS})"),
    "extract_version": (_versions, f"SELECT DISTINCT doc_id, 'v1.' || doc_id % 7 AS version FROM {_B}"),
    "fill_missing_metadata": (lambda s, d: metadata.fill_missing(markdown_orders(s, d).select("doc_id", "version"), _versions(s, d)), f"SELECT DISTINCT doc_id, CASE WHEN s = 'F' THEN 'v1.' || doc_id % 7 ELSE 'v9' END AS version FROM {_B}"),
    "drop_ignored_sections": (lambda s, d: _grouped(s, d).select("doc_id", "ord", "element_id", "group_no"), f"SELECT doc_id, ord, element_id, group_no FROM ({_GROUPED})"),
    "grouped_units": (lambda s, d: _grouped_units(s, d).where("opens").select("doc_id", "unit_no", "group_no", "section", "unit_size"), f"SELECT doc_id, unit_no::BIGINT AS unit_no, group_no, path AS section, unit_size::BIGINT AS unit_size FROM (SELECT doc_id, group_no, path, min(ord) AS o, sum(length('[ELEMENT: ' || element_id || ']' || chr(10) || text)) AS unit_size, row_number() OVER (PARTITION BY doc_id ORDER BY min(ord)) AS unit_no FROM ({_GROUPED}) GROUP BY doc_id, group_no, path)"),
    "grouped_chunks": (lambda s, d: chunks.chunk_numbers(_grouped_units(s, d), SMALL).select("doc_id", "ord", "group_no", "chunk_no"), _GROUPED_CHUNKS_SQL),
    "normalize_categories": (lambda s, d: table(s, d, "orders").select("o_orderkey", schemas.category(F.when(F.col("o_orderstatus") == "F", "　性能 ").when(F.col("o_orderstatus") == "O", " Security").when(F.col("o_custkey") % 2 == 0, "new")).alias("category")), "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'performance' WHEN 'O' THEN 'security' ELSE 'other' END AS category FROM orders"),
}
