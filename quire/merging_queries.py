"""Queries on records of nested types: cleaning, identity and merging, and their SQL. An order is a document, a line a candidate."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import merging, objects
from .sources.tables import table, tasks_for_lines

_PAD = "　          "


def _candidates(spark, sf, by_order=False):
    """Names are padded, of another case, blank or missing; types, ids, texts and lists are missing here and there.

    by_order: records are to be merged. Where the parts are too many to be sent to every task, lines are dealt by their order
    once more after they have met them, so that records, which are many times as large, are made and merged in one place.
    """
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    tasks = tasks_for_lines(spark, sf)
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus").repartition(tasks, "l_orderkey").withColumn("seq", n.cast("long")).drop("l_suppkey")
    t = lines.join(table(spark, sf, "part").drop("p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")
    t = t.repartition(tasks, "l_orderkey") if by_order else t
    q, brand = F.col("l_quantity").cast("long"), F.col("p_brand")
    name = F.when(q % 5 == 0, F.lit(None)).when(q % 5 == 1, "\t　").when(q % 5 == 2, F.concat(F.lit(_PAD), F.upper(brand), F.lit("　\n"))).when(q % 5 == 3, F.concat(F.lit("x　\n y "), brand)).otherwise(F.concat(F.lit("X Y "), brand))
    text = F.when(q % 4 == 0, "").when(q % 4 == 1, F.concat(F.substring("p_name", 1, 5), F.lit(_PAD))).otherwise(F.col("p_name"))
    notes = F.array(F.struct(F.lit("flag").alias("key"), F.col("l_returnflag").alias("value")), F.struct(F.lit(" ").alias("key"), F.lit("").alias("value")), F.struct(F.lit("size").alias("key"), F.when(q % 3 == 0, F.col("p_size").cast("string")).alias("value")))
    detail = F.struct(F.when(q % 2 == 0, F.col("p_type")).alias("unit"), notes.alias("notes"))
    item = F.struct(
        F.when(q % 2 == 0, F.concat(F.lit("C-"), (q % 4).cast("string"))).alias("id"), name.alias("name"), F.when(F.col("l_linestatus") == "F", "Kind　F ").otherwise(" ").alias("item_type"), text.alias("description"),
        F.array(F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus")).alias("tags"), F.when(q % 7 != 0, detail).alias("detail"), F.when(q % 3 != 0, F.col("p_size")).alias("size"), F.array(F.format_string("el-%04d", "l_linenumber")).alias("evidence_element_ids"),
    )
    slot = F.when(F.col("l_returnflag") == "A", "entities").otherwise("modules")
    rows = t.select(F.col("l_orderkey").alias("doc_id"), slot.alias("slot"), "seq", item.alias("item"))
    return objects.object_identity(merging.cleaned_records(rows))


def _merged(spark, sf):
    found = merging.merge_records(_candidates(spark, sf, by_order=True), ("doc_id", "slot", "object_key"), width=3)
    notes = F.array_join(F.transform("item.detail.notes", lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return found.select("doc_id", "slot", "object_key", "first_seq", "candidates", "item.id", "item.name", "item.item_type", "item.description", F.array_join("item.tags", ",").alias("tags"), F.col("item.detail.unit").alias("unit"), notes.alias("notes"), F.coalesce("item.size", F.lit(-1)).alias("size"), F.array_join("item.evidence_element_ids", ",").alias("evidence"))


# The twin states each cleaned field from the tables and never cleans; only the raw key is put together from fields.
_FIELDS = """SELECT *, CASE q % 5 WHEN 2 THEN upper(p_brand) WHEN 3 THEN 'x　' || chr(10) || ' y ' || p_brand WHEN 4 THEN 'X Y ' || p_brand END AS name, CASE WHEN l_linestatus = 'F' THEN 'Kind　F' END AS item_type,
 CASE q % 4 WHEN 0 THEN NULL WHEN 1 THEN trim(substr(p_name, 1, 5)) ELSE p_name END AS description, CASE WHEN q % 2 = 0 THEN 'C-' || q % 4 END AS id, CASE WHEN q % 3 <> 0 THEN p_size END AS size, q % 7 <> 0 AS detailed,
 CASE WHEN q % 7 <> 0 AND q % 2 = 0 THEN p_type END AS unit, CASE WHEN l_returnflag = 'A' THEN 'entities' ELSE 'modules' END AS slot, printf('el-%04d', l_linenumber) AS evidence
 FROM (SELECT *, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq FROM lineitem) JOIN part ON l_partkey = p_partkey"""
_RAW = """'{' || concat_ws(',', '"description":"' || description || '"', CASE WHEN detailed THEN '"detail":{"notes":[{"key":"flag","value":"' || l_returnflag || '"},{"key":"size"' || coalesce(CASE WHEN q % 3 = 0 THEN ',"value":"' || p_size || '"' END, '') || '}]' || coalesce(',"unit":"' || unit || '"', '') || '}' END,
 '"evidence_element_ids":["' || evidence || '"]', '"item_type":"' || item_type || '"', '"size":' || size, '"tags":["' || l_returnflag || '","' || l_linestatus || '"]') || '}'"""
_KEYS = f"""SELECT *, l_orderkey AS doc_id, CASE WHEN name IS NOT NULL THEN (CASE WHEN slot = 'entities' THEN 'entity::::' ELSE 'modules::' || coalesce(CASE WHEN item_type IS NOT NULL THEN 'kind f' END, 'name') || '::' END) || CASE q % 5 WHEN 2 THEN lower(p_brand) ELSE 'x y ' || lower(p_brand) END
 WHEN id IS NOT NULL THEN 'id::' || lower(id) ELSE 'raw::' || {_RAW} END AS object_key FROM ({_FIELDS})"""
_NOTES = """(SELECT doc_id, slot, object_key, string_agg(note, ',' ORDER BY place) AS notes FROM (SELECT doc_id, slot, object_key, note, min(seq * 10 + i) AS place FROM (SELECT doc_id, slot, object_key, seq, unnest(['flag=' || l_returnflag, 'size' || CASE WHEN q % 3 = 0 THEN '=' || p_size ELSE '' END]) AS note, unnest([1, 2]) AS i FROM k WHERE detailed) GROUP BY ALL) GROUP BY ALL)"""
_TAGS = """(SELECT doc_id, slot, object_key, string_agg(tag, ',' ORDER BY place) AS tags FROM (SELECT doc_id, slot, object_key, tag, min(seq * 10 + i) AS place FROM (SELECT doc_id, slot, object_key, seq, unnest([l_returnflag, l_linestatus]) AS tag, unnest([1, 2]) AS i FROM k) GROUP BY ALL) GROUP BY ALL)"""
_EVIDENCE = "(SELECT doc_id, slot, object_key, string_agg(evidence, ',' ORDER BY place) AS evidence FROM (SELECT doc_id, slot, object_key, evidence, min(seq) AS place FROM k GROUP BY ALL) GROUP BY ALL)"
_MERGED_SQL = f"""WITH k AS MATERIALIZED ({_KEYS}), o AS (SELECT doc_id, slot, object_key, min(seq) AS first_seq, count(*) AS candidates, arg_max(id, length(id) * 100000 - seq) AS id, arg_max(name, length(name) * 100000 - seq) AS name, min(item_type) AS item_type, arg_max(description, length(description) * 100000 - seq) AS description, arg_max(unit, length(unit) * 100000 - seq) AS unit, coalesce(arg_min(size, seq), -1) AS size FROM k GROUP BY ALL)
 SELECT * FROM o LEFT JOIN {_NOTES} USING (doc_id, slot, object_key) JOIN {_TAGS} USING (doc_id, slot, object_key) JOIN {_EVIDENCE} USING (doc_id, slot, object_key)"""

REGISTRY = {
    "record_identity": (lambda s, d: _candidates(s, d).select("doc_id", "slot", "seq", "object_key"), f"SELECT doc_id, slot, seq, object_key FROM ({_KEYS})"),
    "merge_records": (_merged, _MERGED_SQL),
}
