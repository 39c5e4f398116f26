"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import evaluation_queries, layout_queries, merging_queries, record_queries, structure_queries
from .operators import catalog, chunks, inference, objects, structure
from .sources.tables import CANDIDATES_SQL, ORDER_ELEMENTS_SQL, TURNS_SQL, candidates, order_elements, table, turns

MAX_CHARS, OVERLAP = 1000, 300


def _elements(spark, sf):
    return structure.build_elements(table(spark, sf, "documents"))


def _units(spark, sf):
    return chunks.section_units(chunks.render_markers(turns(spark, sf)))


def _chunked(spark, sf):
    return chunks.chunk_numbers(_units(spark, sf), MAX_CHARS)


def _keyed(spark, sf):
    return objects.object_identity(candidates(spark, sf))


def _objects(spark, sf):
    return objects.assign_ids(objects.merge_objects(_keyed(spark, sf)))


def _named(spark, sf):
    return objects.object_evidence(_objects(spark, sf))


def _catalog(spark, sf):
    """Documents as a catalog: the type from the source, the status from the label."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "failed").otherwise("uploaded")
    kind = F.when(F.col("source") == "src0", "srs").when(F.col("source") == "src1", "api").otherwise("unknown")
    meta = F.when(F.col("quality") == 1, F.concat(F.lit('{"chars": '), F.col("n_chars").cast("string"), F.lit("}"))).when(F.col("quality") == 0, '{"chars": ')
    return table(spark, sf, "documents").join(labels, "doc_id", "left").select("doc_id", F.concat("source", F.lit(" "), "lang").alias("title"), kind.alias("doc_type"), status.alias("status"), F.col("text").alias("raw_text"), F.when(F.col("quality").isNotNull(), "{}").alias("document_ir"), F.when(F.col("quality") == 1, "{}").alias("extracted_data"), meta.alias("extraction_meta"))


_CATALOG_SQL = """SELECT d.doc_id, source || ' ' || lang AS title, CASE source WHEN 'src0' THEN 'srs' WHEN 'src1' THEN 'api' ELSE 'unknown' END AS doc_type,
 CASE quality WHEN 1 THEN 'completed' WHEN 0 THEN 'failed' ELSE 'uploaded' END AS status, text AS raw_text,
 CASE WHEN quality IS NOT NULL THEN '{}' END AS document_ir, CASE WHEN quality = 1 THEN '{}' END AS extracted_data, CASE WHEN quality = 1 THEN n_chars END AS chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
_NOT_BLANK = r"[^\s\x0B\x{85}\p{Z}]"
_LINES_SQL = f"SELECT doc_id, source, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS parts FROM documents WHERE regexp_matches(text, '{_NOT_BLANK}')"
_ELEMENTS_SQL = f"SELECT doc_id, i - 1 AS ord, printf('el-%04d', i) AS element_id, source AS section, kept[i] AS text FROM (SELECT doc_id, source, kept, unnest(range(1, len(kept) + 1)) AS i FROM (SELECT doc_id, source, list_filter(parts, lambda x: regexp_matches(x, '{_NOT_BLANK}')) AS kept FROM ({_LINES_SQL})))"
_SIZED_SQL = f"SELECT doc_id, ord, element_id, section, trim('[ELEMENT: ' || element_id || ' page=' || page || ']' || chr(10) || trim(text)) AS marked FROM ({TURNS_SQL})"
_UNITS_SQL = f"""SELECT *, sum(size) OVER (PARTITION BY doc_id, unit_no)::BIGINT AS unit_size, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM (
 SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY ord)::BIGINT AS unit_no FROM (
 SELECT doc_id, ord, element_id, section, length(marked) AS size, coalesce(section <> lag(section) OVER (PARTITION BY doc_id ORDER BY ord), true) AS opens FROM ({_SIZED_SQL})))"""
_CHUNKED_SQL = f"""u AS MATERIALIZED ({_UNITS_SQL}), f AS (
 SELECT doc_id, rn, 1::BIGINT AS chunk_no, CASE WHEN unit_size > {MAX_CHARS} THEN size ELSE unit_size END AS held, unit_size > {MAX_CHARS} AS big FROM u WHERE rn = 1 UNION ALL
 SELECT u.doc_id, u.rn, f.chunk_no + n.new::BIGINT, CASE WHEN n.new THEN (CASE WHEN n.is_big THEN u.size ELSE u.unit_size END) WHEN u.opens THEN f.held + u.unit_size WHEN f.big THEN f.held + u.size ELSE f.held END, n.is_big
 FROM f JOIN u ON u.doc_id = f.doc_id AND u.rn = f.rn + 1,
 LATERAL (SELECT CASE WHEN u.opens THEN f.big OR u.unit_size > {MAX_CHARS} OR f.held + u.unit_size > {MAX_CHARS} ELSE f.big AND f.held + u.size > {MAX_CHARS} END AS new, CASE WHEN u.opens THEN u.unit_size > {MAX_CHARS} ELSE f.big END AS is_big) n),
 c AS (SELECT u.*, f.chunk_no FROM u JOIN f USING (doc_id, rn))"""
_KEYED_SQL = f"SELECT *, slot || '::' || lower(item_type) || '::' || lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS object_key FROM ({CANDIDATES_SQL})"
_MERGED_SQL = f"SELECT doc_id, slot, object_key, min(seq) AS first_seq, arg_max(name, length(name) * 1000000 - seq) AS name, arg_max(description, length(description) * 1000000 - seq) AS description, count(*) AS candidates FROM ({_KEYED_SQL}) GROUP BY ALL"
_OBJECTS_SQL = f"SELECT *, CASE slot WHEN 'apis' THEN 'APIS' WHEN 'modules' THEN 'MOD' ELSE 'TBL' END || '-' || printf('%03d', row_number() OVER (PARTITION BY doc_id, slot ORDER BY first_seq)) AS object_id FROM ({_MERGED_SQL})"
_NAMED_SQL = f"SELECT DISTINCT doc_id, object_id, evidence_id FROM ({_KEYED_SQL}) JOIN (SELECT doc_id, object_key, object_id FROM ({_OBJECTS_SQL})) USING (doc_id, object_key)"
_BOUND_SQL = f"SELECT n.doc_id, object_id, n.evidence_id AS element_id, text AS text_span FROM ({_NAMED_SQL}) n JOIN ({ORDER_ELEMENTS_SQL}) e ON n.doc_id = e.doc_id AND n.evidence_id = e.element_id"
_PAGES_SQL = "SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_no, length(text) AS chars, count(*) OVER (PARTITION BY source) AS n FROM documents"


def _bound(spark, sf):
    return objects.bind_evidence(_named(spark, sf), order_elements(spark, sf))


def _pages(spark, sf):
    order = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf, "documents").select(F.col("source").alias("doc_id"), (F.row_number().over(order) - 1).cast("long").alias("page_no"), F.length("text").cast("long").alias("chars"))


def _log(spark, sf):
    status = F.when(F.col("event_type") == "signup", "uploaded").when(F.col("event_type") == "view", "parsing").when(F.col("event_type") == "click", "extracting").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    return table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), status.alias("status"), "ts")


_LOG_SQL = "SELECT user_id AS doc_id, CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'extracting' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, ts FROM events"


def _patches(spark, sf):
    """Two patches of failed documents, a title first and a text next; one without a field for toxic ones; ids that are unknown."""
    t = _catalog(spark, sf)
    none = F.lit(None).cast("string")
    failed = t.where("status = 'failed'").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("patch_no"), "raw_text")
    first = F.when(F.col("patch_no") == 1, "retry").otherwise(none)
    text = F.when(F.col("patch_no") == 1, F.col("raw_text")).when(F.col("doc_id") % 2 == 0, F.concat("raw_text", F.lit("!")))
    empty = table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit(3).alias("patch_no"), none.alias("title"), none.alias("raw_text"))
    unknown = t.where("status = 'completed'").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit(1).alias("patch_no"), F.lit("x").alias("title"), none.alias("raw_text"))
    return failed.select("doc_id", "patch_no", first.alias("title"), text.alias("raw_text")).unionByName(empty).unionByName(unknown)


def _patched(spark, sf):
    found, _ = catalog.apply_patches(_catalog(spark, sf), _patches(spark, sf))
    return found.select("doc_id", "title", "status", F.length("raw_text").alias("chars"), F.col("document_ir").isNotNull().alias("has_document_ir"), F.col("extracted_data").isNotNull().alias("has_extracted_data"))


def _rejected(spark, sf):
    return catalog.apply_patches(_catalog(spark, sf), _patches(spark, sf))[1].select("doc_id", "patch_no", "reason")


def _deleted(spark, sf):
    """Rows that stay of the catalog and of what hangs on a document, without those of toxic documents."""
    left = catalog.delete_documents(table(spark, sf, "labels").where("toxic = 1"), catalog=_catalog(spark, sf), elements=_elements(spark, sf), labels=table(spark, sf, "labels"))
    rows = [left[name].groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("kept"), "doc_id", "n") for name in sorted(left)]
    return rows[0].union(rows[1]).union(rows[2])


def _outline(spark, sf):
    return inference.document_outline(turns(spark, sf))


def _merged_fields(spark, sf):
    found = inference.merge_document_fields(candidates(spark, sf), "description", "name")
    return found.select("doc_id", "description", F.array_join("names", "|").alias("names"))


def _fallback(spark, sf):
    final = _objects(spark, sf).where("doc_id % 3 = 0").select("doc_id", "slot", "name", "description")
    return inference.finalizer_fallback(final, candidates(spark, sf).select("doc_id", "slot", "name", "description"))


def _patched_objects(spark, sf):
    found = _objects(spark, sf).select("doc_id", "slot", "object_id", "name", "description")
    fixed = found.where("doc_id % 4 = 1").select("doc_id", "slot", "object_id", F.concat(F.lit("fixed "), "name").alias("name"), F.lit(None).cast("string").alias("description"))
    return inference.patch_objects(found, fixed, ("name", "description"))


_REGISTRY = {
    "explode_lines": (lambda s, d: structure.explode_lines(table(s, d, "documents")), f"SELECT doc_id, i AS line_no, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM ({_LINES_SQL}))"),
    "build_elements": (_elements, _ELEMENTS_SQL),
    "front_matter": (lambda s, d: structure.front_matter_of(table(s, d, "documents")), f"SELECT doc_id, substring(string_agg(text, chr(10) ORDER BY ord), 1, 3000) AS text FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_ELEMENTS_SQL})) WHERE before < 3000 GROUP BY doc_id"),
    "admission_filter": (lambda s, d: structure.admission(_elements(s, d), 10000), f"SELECT doc_id, sum(length(text))::BIGINT AS total, sum(length(text)) <= 10000 AS accepted FROM ({_ELEMENTS_SQL}) GROUP BY doc_id"),
    "scan_quality_gate": (lambda s, d: structure.scan_quality(_pages(s, d)), f"SELECT doc_id, count(*) AS pages, sum(chars)::BIGINT AS chars, sum(chars) < 120 OR sum(chars) < 40 * count(*) OR count(*) FILTER (chars = 0) * 10 >= 6 * count(*) AS needs_ocr FROM ({_PAGES_SQL}) WHERE n <= 6 OR page_no IN (0, n - 1, round_even((n - 1) / 5.0, 0), round_even(2 * (n - 1) / 5.0, 0), round_even(3 * (n - 1) / 5.0, 0), round_even(4 * (n - 1) / 5.0, 0)) GROUP BY doc_id"),
    "render_markers": (lambda s, d: chunks.render_markers(turns(s, d)).select("doc_id", "ord", "marked", "size"), f"SELECT doc_id, ord, marked, length(marked) AS size FROM ({_SIZED_SQL})"),
    "section_units": (lambda s, d: _units(s, d).where("opens").select("doc_id", "unit_no", "section", "unit_size"), f"SELECT doc_id, unit_no, section, unit_size FROM ({_UNITS_SQL}) WHERE opens"),
    "pack_chunks": (lambda s, d: chunks.chunk_summary(_chunked(s, d)).withColumn("element_ids", F.array_join("element_ids", ",")), f"WITH RECURSIVE {_CHUNKED_SQL} SELECT doc_id, printf('chunk-%04d', chunk_no) AS chunk_id, arg_min(section, ord) AS section, count(*) AS elements, sum(size)::BIGINT AS chars, min(page) AS page_start, max(page) AS page_end, arg_min(element_id, ord) AS first_element, arg_max(element_id, ord) AS last_element, string_agg(element_id, ',' ORDER BY ord) AS element_ids, string_agg(marked, chr(10) || chr(10) ORDER BY ord) AS markdown FROM (SELECT c.*, t.page, t.marked FROM c JOIN (SELECT z.doc_id, z.ord, z.marked, y.page FROM ({_SIZED_SQL}) z JOIN ({TURNS_SQL}) y ON z.doc_id = y.doc_id AND z.ord = y.ord) t ON c.doc_id = t.doc_id AND c.ord = t.ord) GROUP BY doc_id, chunk_no"),
    "chunk_overlap": (lambda s, d: chunks.overlap(_chunked(s, d), OVERLAP), f"WITH RECURSIVE {_CHUNKED_SQL}, p AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY ord) - size AS before FROM c), s AS (SELECT doc_id, chunk_no, min(ord) AS start, min(before) AS before FROM p WHERE chunk_no > 1 GROUP BY doc_id, chunk_no) SELECT s.doc_id, s.chunk_no, p.ord FROM s JOIN p ON s.doc_id = p.doc_id AND p.ord < s.start AND s.before - p.before <= {OVERLAP}"),
    "object_identity": (lambda s, d: _keyed(s, d).select("doc_id", "seq", "object_key"), f"SELECT doc_id, seq, object_key FROM ({_KEYED_SQL})"),
    "merge_objects": (lambda s, d: objects.merge_objects(_keyed(s, d)).drop("evidence_ids"), _MERGED_SQL),
    "assign_global_ids": (lambda s, d: _objects(s, d).select("doc_id", "object_id", "name", "description"), f"SELECT doc_id, object_id, name, description FROM ({_OBJECTS_SQL})"),
    "bind_evidence": (_bound, _BOUND_SQL),
    "dangling_evidence": (lambda s, d: objects.dangling_evidence(_named(s, d), order_elements(s, d)), f"SELECT doc_id, object_id, evidence_id FROM ({_NAMED_SQL}) n WHERE NOT EXISTS (SELECT 1 FROM ({ORDER_ELEMENTS_SQL}) e WHERE e.doc_id = n.doc_id AND e.element_id = n.evidence_id)"),
    "evidence_coverage": (lambda s, d: objects.evidence_coverage(_objects(s, d), order_elements(s, d)), f"SELECT doc_id, coalesce(sum(n), 0)::BIGINT AS evidence_count, count(*) AS objects_total, count(n) AS objects_with_evidence, round(count(n) / count(*), 4) AS coverage FROM ({_OBJECTS_SQL}) LEFT JOIN (SELECT doc_id, object_id, count(*) AS n FROM ({_BOUND_SQL}) GROUP BY ALL) USING (doc_id, object_id) GROUP BY doc_id"),
    "list_documents": (lambda s, d: catalog.list_documents(_catalog(s, d)).withColumn("chars", F.coalesce(F.try_variant_get("extraction_meta", "$.chars", "long"), F.lit(-1))).drop("extraction_meta"), f"SELECT doc_id, title, doc_type, status, raw_text IS NOT NULL AS has_raw_text, document_ir IS NOT NULL AS has_document_ir, extracted_data IS NOT NULL AS has_extracted_data, coalesce(chars, -1) AS chars FROM ({_CATALOG_SQL}) ORDER BY doc_id DESC"),
    "search_documents": (lambda s, d: catalog.search_documents(_catalog(s, d), "EN", ("completed", "uploaded"), ("srs", "api")).select("doc_id", "title", "doc_type", "status"), f"SELECT doc_id, title, doc_type, status FROM ({_CATALOG_SQL}) WHERE contains(lower(title), 'en') AND status IN ('completed', 'uploaded') AND doc_type IN ('srs', 'api')"),
    "catalog_facets": (lambda s, d: catalog.facets(_catalog(s, d)), f"SELECT 'status' AS facet, status AS value, count(*) AS n FROM ({_CATALOG_SQL}) GROUP BY status UNION ALL SELECT 'doc_type', doc_type, count(*) FROM ({_CATALOG_SQL}) GROUP BY doc_type"),
    "apply_patches": (_patched, f"SELECT doc_id, CASE status WHEN 'failed' THEN 'retry' ELSE title END AS title, status, length(raw_text) + CASE WHEN status = 'failed' AND doc_id % 2 = 0 THEN 1 ELSE 0 END AS chars, document_ir IS NOT NULL AND NOT (status = 'failed' AND doc_id % 2 = 0) AS has_document_ir, extracted_data IS NOT NULL AS has_extracted_data FROM ({_CATALOG_SQL})"),
    "rejected_patches": (_rejected, f"SELECT doc_id, 3 AS patch_no, 'no field' AS reason FROM labels WHERE toxic = 1 UNION ALL SELECT -doc_id - 1, 1, 'unknown document' FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 2, 'no field' FROM labels WHERE quality = 0 AND doc_id % 2 = 1"),
    "delete_documents": (_deleted, f"SELECT * FROM (SELECT 'catalog' AS kept, doc_id, 1 AS n FROM documents UNION ALL SELECT 'labels', doc_id, 1 FROM labels UNION ALL SELECT 'elements', doc_id, count(*) FROM ({_ELEMENTS_SQL}) GROUP BY doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "latest_status": (lambda s, d: catalog.latest_status(_log(s, d)), f"SELECT doc_id, arg_max(status, ts) AS status, max(ts) AS ts, arg_max(status, ts) IN ('pending', 'uploaded', 'parsing', 'extracting') AS active FROM ({_LOG_SQL}) GROUP BY doc_id"),
    "document_outline": (lambda s, d: _outline(s, d).select("doc_id", F.array_join("sections", "|").alias("sections"), F.array_join("main_topics", "|").alias("main_topics")), f"SELECT doc_id, string_agg(section, '|' ORDER BY o) AS sections, string_agg(section, '|' ORDER BY o) AS main_topics FROM (SELECT doc_id, section, min(ord) AS o FROM ({TURNS_SQL}) GROUP BY ALL) GROUP BY doc_id"),
    "summary_inputs": (lambda s, d: inference.summary_inputs(table(s, d, "documents"), inference.document_outline(_elements(s, d))), f"SELECT d.doc_id, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 12000) AS text, CASE WHEN e.doc_id IS NOT NULL THEN '{{\"sections\":[\"' || source || '\"],\"main_topics\":[\"' || source || '\"]}}' END AS outline FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM ({_ELEMENTS_SQL})) e ON d.doc_id = e.doc_id"),
    "normalize_enums": (lambda s, d: table(s, d, "orders").select("o_orderkey", inference.normalized_enum(F.regexp_replace("o_orderpriority", r"^\d-", " "), inference.PRIORITIES, "medium").alias("priority")), "SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%-high' THEN 'high' WHEN lower(o_orderpriority) LIKE '%-low' THEN 'low' ELSE 'medium' END AS priority FROM orders"),
    "finalizer_fallback": (_fallback, f"SELECT doc_id, slot, name, description FROM ({_OBJECTS_SQL}) WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, slot, name, description FROM ({CANDIDATES_SQL}) WHERE doc_id % 3 <> 0"),
    "merge_document_fields": (_merged_fields, f"SELECT * FROM (SELECT doc_id, arg_max(description, length(description) * 1000000 - seq) AS description FROM ({CANDIDATES_SQL}) GROUP BY doc_id) JOIN (SELECT doc_id, string_agg(name, '|' ORDER BY o) AS names FROM (SELECT doc_id, name, min(seq) AS o FROM ({CANDIDATES_SQL}) GROUP BY ALL) GROUP BY doc_id) USING (doc_id)"),
    "first_evidence": (lambda s, d: inference.first_evidence(_bound(s, d)), f"SELECT doc_id, object_id, element_id, text_span FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY object_id, element_id) AS n FROM ({_BOUND_SQL})) WHERE n = 1"),
    "patch_objects": (_patched_objects, f"SELECT doc_id, slot, object_id, CASE WHEN doc_id % 4 = 1 THEN 'fixed ' || name ELSE name END AS name, description FROM ({_OBJECTS_SQL})"),
    "retry_selection": (lambda s, d: inference.retry_selection(_catalog(s, d), _elements(s, d).join(table(s, d, "labels"), "doc_id", "left_semi")), f"SELECT doc_id, doc_type, NOT (doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT doc_id FROM ({_ELEMENTS_SQL}))) AS rebuild FROM ({_CATALOG_SQL}) WHERE doc_type IN ('srs', 'api') AND trim(raw_text) <> ''"),
} | evaluation_queries.REGISTRY | structure_queries.REGISTRY | record_queries.REGISTRY | layout_queries.REGISTRY | merging_queries.REGISTRY


def queries() -> dict:
    return {name: query for name, (query, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items()}
