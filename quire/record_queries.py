"""Queries on responses, records, evidence views, files and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .operators import chunks, inference, objects, responses, schemas, structure
from .session import scratch
from .sources import files
from .sources.tables import ORDER_ELEMENTS_SQL, TURNS_SQL, labelled_items, order_elements, table, turns
from .streaming import ingest


_TYPE_OF = {"src0": " SRS", "src1": "api", "src2": "Hld　", "src3": "tc", "src4": "dbdd", "src5": "unknown"}


def _typed(spark, sf):
    kind = F.create_map(*(F.lit(x) for pair in _TYPE_OF.items() for x in pair))[F.col("source")]
    return table(spark, sf, "documents").select("doc_id", kind.alias("doc_type"))


def _contracts(spark, sf):
    found = responses.with_contracts(_typed(spark, sf), schemas.all_schemas())
    joined = lambda c: F.coalesce(F.array_join(f"contract.{c}", ","), F.lit(""))
    return found.select("doc_id", F.coalesce("contract.doc_type", F.lit("")).alias("doc_type"), joined("target_slots").alias("slots"), joined("document_fields").alias("fields"), F.coalesce(F.size("contract.rules"), F.lit(0)).alias("rules"), joined("ignore_sections").alias("ignored"))


def _turn_chunks(spark, sf):
    """Two turns of a conversation are a chunk."""
    t = turns(spark, sf).withColumn("chunk_no", F.expr("ord DIV 2"))
    return chunks.chunk_summary(chunks.render_markers(t))


def _asked(spark, sf):
    """Conversations as documents: the outline of their roles, a summary for some, the contract of a type by their number."""
    outline = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_set("role")).alias("sections"))).alias("outline"))
    kind = F.when(F.col("doc_id") % 3 == 0, "srs").when(F.col("doc_id") % 3 == 1, "api").otherwise("unknown")
    summary = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("　about "), F.col("doc_id").cast("string"))).otherwise(" ")
    return responses.with_contracts(outline.select("doc_id", "outline", summary.alias("document_summary"), kind.alias("doc_type")), schemas.all_schemas())


_REQUEST = "outline struct<sections array<string>>, summary string, contract struct<doc_type string, target_slots array<string>, rules array<string>>, chunk struct<chunk_id string, section_path string, page_start long, page_end long, allowed_evidence_element_ids array<string>>, text string, candidates array<struct<r long>>"


def _prompts(spark, sf):
    found = responses.chunk_prompts(_turn_chunks(spark, sf), _asked(spark, sf)).withColumn("r", F.from_json("request", _REQUEST))
    return found.select("doc_id", "chunk_id", "summary", F.array_join("r.outline.sections", ",").alias("sections"), F.coalesce("r.summary", F.lit("")).alias("about"), F.coalesce("r.contract.doc_type", F.lit("")).alias("doc_type"), F.coalesce(F.array_join("r.contract.target_slots", ","), F.lit("")).alias("slots"), F.col("r.chunk.section_path").alias("section"), F.col("r.chunk.page_start").alias("page_start"), F.col("r.chunk.page_end").alias("page_end"), F.array_join("r.chunk.allowed_evidence_element_ids", ",").alias("allowed"), "r.text")


def _finalizer(spark, sf):
    t = turns(spark, sf).withColumn("chunk_no", F.expr("ord DIV 2")).groupBy("doc_id", "chunk_no").agg(F.count("*").alias("n"))
    rows = t.select("doc_id", "chunk_no", F.when(F.col("n") > 1, F.concat(F.lit('{"r": '), F.col("chunk_no").cast("string"), F.lit("}"))).otherwise("{cut").alias("response"))
    found = responses.finalizer_inputs(rows, _asked(spark, sf)).withColumn("r", F.from_json("request", _REQUEST))
    return found.select("doc_id", F.array_join(F.col("r.candidates.r").cast("array<string>"), ",").alias("results"), F.array_join("r.outline.sections", ",").alias("sections"), F.coalesce("r.summary", F.lit("")).alias("about"), F.coalesce(F.array_join("r.contract.target_slots", ","), F.lit("")).alias("slots"))


def _rule(request: str) -> str:
    if request.startswith("1"):
        raise ValueError(request)
    return request.lower()


def _inferred(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("request"))
    return responses.batch_infer(rows, _rule, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _parsed(spark, sf):
    p, kind = F.col("props"), F.col("event_type")
    said = F.when(kind == "click", F.concat(F.lit("Here:\n```JSON\n"), p, F.lit("\n```"))).when(kind == "view", F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "extra": "abc'))).when(kind == "purchase", F.replace(p, F.lit('"'), F.lit("'"))).when(kind == "error", F.lit("no json")).otherwise(F.concat(F.lit(" "), p))
    found = responses.parse_json(table(spark, sf, "events").select("event_id", said.alias("response")))
    return found.select("event_id", "outcome", F.get_json_object("parsed", "$.k").alias("k"))


def _trimmed(spark, sf):
    t, name = table(spark, sf, "part"), F.concat(F.lit("\u3000 "), "p_name", F.lit("\t\n"))
    rows = t.select("p_partkey", name.alias("name"), F.array(name, F.lit(" x ")).alias("tags"), F.struct(F.concat("p_brand", F.lit(" ")).alias("brand"), F.col("p_size").alias("size")).alias("inner"))
    return responses.trim_strings(rows).select("p_partkey", "name", F.array_join("tags", "|").alias("tags"), F.col("inner.brand").alias("brand"), F.col("inner.size").alias("size"))


def _line_items(spark, sf):
    """Chunk results: a line number of an order is a chunk, its lines are the items of apis."""
    t = table(spark, sf, "lineitem")
    name = F.when(F.col("l_quantity") < 4, " ").otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    method = F.when(F.col("l_returnflag") == "A", "GET").when(F.col("l_returnflag") == "N", "POST").otherwise("get")
    said = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("from "), F.col("l_suppkey").cast("string")))
    item = F.struct("l_partkey", "l_suppkey", F.struct(F.lit("x").alias("id"), name.alias("name"), method.alias("method"), said.alias("description"), F.array(F.lit("el-0001")).alias("evidence_element_ids")).alias("item"))
    rows = t.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_no")).agg(F.array_sort(F.collect_list(item)).alias("rows"), F.max("l_tax").alias("tax"))
    return rows.select("doc_id", "chunk_no", F.transform("rows", lambda x: x["item"]).alias("apis"), F.when(F.col("tax") > 0.065, "timeout").alias("error"), F.lit("").alias("base_url"))


def _validated(spark, sf):
    rows = _line_items(spark, sf).withColumnRenamed("apis", "items")
    return responses.validate(rows, "apis", ("base_url",)).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.coalesce("reason", F.lit("")).alias("reason"), "doc_failed")


def _candidates(spark, sf):
    return objects.collect_candidates(_line_items(spark, sf), ("apis",)).select("doc_id", "slot", "seq", F.coalesce("item.name", F.lit("")).alias("name"), F.coalesce("item.description", F.lit("")).alias("description"))


def _united(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.array("l_returnflag", "l_linestatus").alias("marks"))
    return objects.union_lists(rows, "marks").select("doc_id", F.array_join("marks", ",").alias("marks"))


def _meta(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_discount", (F.col("l_returnflag") == "R").alias("failed"))
    coverage = t.groupBy("doc_id").agg(F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 4).alias("coverage"))
    return objects.extraction_meta(coverage, t, order_elements(spark, sf).withColumn("section", F.substring("text", 1, 6)), "rules")


def _simple(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").cast("string").alias("p"), F.max("l_returnflag").alias("rf"), F.max("l_quantity").cast("long").alias("q"))
    return t.withColumn("object_id", F.concat(F.lit("O-"), F.col("n").cast("string")))


def _simple_objects(spark, sf):
    said = F.when(F.col("q") > 25, F.concat(F.repeat(F.lit("long "), 12), F.col("q").cast("string")))
    return _simple(spark, sf).select("doc_id", "object_id", F.lit("tables").alias("slot"), F.when(F.col("rf") != "R", F.concat(F.lit("part "), "p")).otherwise("").alias("name"), said.alias("description"))


def _simple_bound(spark, sf):
    rows = _simple(spark, sf)
    return rows.select("doc_id", "object_id", F.explode(F.array(F.col("n"), (F.col("q") % 3 + 1).cast("int"))).alias("e")).select("doc_id", "object_id", F.format_string("el-%04d", "e").alias("element_id")).distinct()


def _targets(spark, sf):
    evidence = _simple(spark, sf).select("doc_id", "object_id", F.when(F.col("rf") == "N", "el-9999").otherwise(F.format_string("el-%04d", "n")).alias("element_id"), F.concat(F.lit("PART  "), "p").alias("text_span"))
    return objects.resolve_targets(evidence, order_elements(spark, sf).withColumn("ord", F.substring("element_id", 4, 4).cast("int"))).select("doc_id", "object_id", F.coalesce("target", F.lit("")).alias("target"))


def _placed(spark, sf):
    """Calls, requirements and auths of an order's lines with the elements that they name, some without text, page or box."""
    t = table(spark, sf, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    q, n = F.col("l_quantity").cast("long"), F.col("n")
    slot = F.get(F.array(*map(F.lit, ("apis", "auth", "test_cases", "tables"))), (q % 4).cast("int"))
    t = t.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("O-"), n.cast("string")).alias("object_id"), slot.alias("slot"), "n", q.alias("q"), "l_suppkey", "l_returnflag", "l_linestatus")
    q = F.col("q")
    item = F.struct(F.when(q % 5 == 0, F.concat(F.lit(" n"), q.cast("string"))).otherwise("　").alias("name"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("method"), F.when(q % 3 == 0, F.concat(F.lit("/s/"), F.col("l_suppkey").cast("string"))).alias("path"), F.col("l_linestatus").alias("auth_type"), F.when(q % 2 == 0, "high").alias("priority"), F.when(q > 25, F.concat(F.repeat(F.lit("long "), 12), q.cast("string"))).alias("description"))
    objects_ = t.select("doc_id", "object_id", "slot", item.alias("item"))
    named = t.select("doc_id", "object_id", F.explode(F.array(F.col("n"), F.col("n") + 1, F.lit(1), F.lit(99))).alias("e")).select("doc_id", "object_id", F.format_string("el-%d", "e").alias("evidence_id"))
    box = F.when(q % 3 != 0, F.array(F.lit(1.0), F.lit(2.0), q.cast("double"), F.when(q % 7 != 0, F.lit(9.0)).otherwise(float("nan"))))
    elements = t.select("doc_id", F.format_string("el-%d", "n").alias("element_id"), F.when(q % 2 == 0, F.concat(F.lit(" at　 "), q.cast("string"))).otherwise(" ").alias("text"), (q % 4).alias("page"), box.alias("bbox"))
    return objects_, objects.bind_evidence(named, elements)


def _viewed(spark, sf):
    found = objects.item_view(*_placed(spark, sf))
    record = lambda x: F.concat_ws(":", x["element_id"], x["text_span"], x["page"].cast("string"), F.when(x["bbox"].isNotNull(), "box"))
    return found.select("doc_id", "object_id", "slot", "title", F.coalesce("type_label", F.lit("")).alias("type_label"), F.array_join(F.transform("evidence", record), ",").alias("evidence"))


def _first_placed(spark, sf):
    return inference.first_evidence(_placed(spark, sf)[1]).select("doc_id", "object_id", "element_id", F.coalesce("text_span", F.lit("")).alias("text_span"), "page", F.col("bbox").isNotNull().alias("boxed"))


_PLACED = """SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, l_quantity::BIGINT AS q, l_suppkey, l_returnflag AS rf, l_linestatus AS ls FROM lineitem"""
_PLACED_BOUND = f"SELECT o.doc_id, 'O-' || o.n AS object_id, 'el-' || e.n AS element_id, CASE WHEN e.q % 2 = 0 THEN 'at ' || e.q END AS text_span, e.q % 4 AS page, e.q % 3 <> 0 AND e.q % 7 <> 0 AS boxed FROM ({_PLACED}) o JOIN ({_PLACED}) e ON o.doc_id = e.doc_id AND (e.n = o.n OR e.n = o.n + 1 OR e.n = 1)"
_VIEWED_SQL = f"""SELECT o.doc_id, 'O-' || n AS object_id, ['apis', 'auth', 'test_cases', 'tables'][q % 4 + 1] AS slot, CASE WHEN q % 5 = 0 THEN 'n' || q WHEN q % 4 = 0 AND (rf <> 'R' OR q % 3 = 0) THEN concat_ws(' ', CASE WHEN rf <> 'R' THEN rf END, CASE WHEN q % 3 = 0 THEN '/s/' || l_suppkey END) WHEN q % 4 = 1 THEN ls WHEN q > 25 THEN rtrim(substring(repeat('long ', 12), 1, 48)) || '...' ELSE 'O-' || n END AS title,
 CASE WHEN q % 4 = 0 AND rf <> 'R' THEN rf WHEN q % 4 = 2 THEN 'high' ELSE '' END AS type_label, evidence FROM ({_PLACED}) o JOIN (SELECT doc_id, object_id, string_agg(concat_ws(':', element_id, text_span, page::VARCHAR, CASE WHEN boxed THEN 'box' END), ',' ORDER BY element_id) AS evidence FROM ({_PLACED_BOUND}) GROUP BY ALL) b ON b.doc_id = o.doc_id AND b.object_id = 'O-' || o.n"""
_FIRST_SQL = f"SELECT doc_id, object_id, element_id, coalesce(text_span, '') AS text_span, page, boxed FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN text_span IS NOT NULL THEN 0 WHEN page <> 0 AND boxed THEN 1 ELSE 2 END, object_id, element_id) AS r FROM ({_PLACED_BOUND})) WHERE r = 1"

_SIMPLE = "SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_partkey) AS p, max(l_returnflag) AS rf, max(l_quantity)::BIGINT AS q, 'O-' || l_linenumber AS object_id FROM lineitem GROUP BY ALL"
_SIMPLE_BOUND = f"SELECT DISTINCT doc_id, object_id, printf('el-%04d', unnest([n, q % 3 + 1])) AS element_id FROM ({_SIMPLE})"


def _json_items(spark, sf):
    path = scratch(spark, "predictions")
    labelled_items(spark, sf).select("doc_id", "slot", "item_no", "name").write.json(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("slot", T.StringType()), T.StructField("item_no", T.LongType()), T.StructField("name", T.StringType())])
    return spark.read.schema(schema).json(path)


def _saved(spark, sf):
    path = scratch(spark, "catalog")
    typed = _typed(spark, sf).withColumn("doc_type", F.coalesce(schemas.document_type(F.col("doc_type")), F.lit("unknown")))
    files.write_catalog(typed, path)
    files.write_catalog(typed.where("doc_type = 'srs'"), path)
    return spark.read.parquet(path).groupBy("doc_type").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def _report(spark, sf):
    path = scratch(spark, "report")
    items = labelled_items(spark, sf)
    files.write_report(path, slots=items.groupBy("slot").count(), documents=items.groupBy("doc_id").count())
    slots = spark.read.schema("slot string, count long").json(f"{path}/slots").select(F.lit("slot").alias("section"), F.col("slot").alias("key"), "count")
    return slots.union(spark.read.schema("doc_id long, count long").json(f"{path}/documents").select(F.lit("document"), F.col("doc_id").cast("string"), "count"))


def _manifest(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("doc_path"), F.concat(F.lit("gt/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("gt_path"))
    found = table(spark, sf, "labels").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("doc_path"), (F.col("toxic") == 1).alias("broken"))
    return files.manifest_join(docs, found)


def _refusing(request: str) -> str:
    if "the" not in request:
        raise ValueError("nothing to say")
    return str(len(request))


def _ingested(spark, sf):
    path = scratch(spark, "stream")
    ingest.stream_ingest(ingest.table_stream(spark, sf, "documents"), path, f"{path}/checkpoint", _refusing, max_chars=4000, tasks=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return path


def _streamed(spark, sf):
    return spark.read.parquet(f"{_ingested(spark, sf)}/elements").groupBy("doc_id").agg(F.count("*").alias("elements"), F.sum(F.length("text")).alias("chars"))


def _stream_ends(spark, sf):
    """Of each document the way that it went, and what its chunks answered."""
    path = _ingested(spark, sf)
    way = spark.read.parquet(f"{path}/status").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "status"))), lambda x: x["status"]), ",").alias("way"))
    wrong = spark.read.parquet(f"{path}/quarantine").select("doc_id", F.col("step").alias("stopped"))
    said = spark.read.parquet(f"{path}/responses").groupBy("doc_id").agg(F.sum(F.col("response").cast("long")).alias("answered"))
    return way.join(wrong, "doc_id", "left").join(said, "doc_id", "left").select("doc_id", "way", F.coalesce("stopped", F.lit("")).alias("stopped"), F.coalesce("answered", F.lit(0)).alias("answered"))


def _status_stream(spark, sf):
    path = scratch(spark, "status")
    ingest.stream_status(ingest.table_stream(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.when(F.col("event_type") == "signup", "uploaded").otherwise(F.col("event_type")).alias("status"), "ts"), f"{path}/latest", f"{path}/checkpoint")
    return ingest.current_status(spark, f"{path}/latest")


_LINE_SAID = "SELECT l_orderkey AS doc_id, l_linenumber AS chunk_no, l_partkey, l_suppkey, CASE WHEN l_quantity < 4 THEN '' ELSE 'part ' || l_partkey END AS name, CASE l_linestatus WHEN 'O' THEN 'from ' || l_suppkey ELSE '' END AS description, l_returnflag, l_tax FROM lineitem"
_SLOTS = {t: ",".join(slots) for t, (_, slots) in schemas.TYPES.items()}
_CASES = " ".join(f"WHEN '{s}' THEN '{t.strip().lower()}'" for s, t in _TYPE_OF.items() if t != "unknown")
_CHUNKS = """SELECT doc_id, ord // 2 AS chunk_no, printf('chunk-%04d', ord // 2) AS chunk_id, arg_min(section, ord) AS section, min(page) AS page_start, max(page) AS page_end, count(*) AS n, string_agg(element_id, ',' ORDER BY ord) AS allowed,
 string_agg('[ELEMENT: ' || element_id || ' page=' || page || ']' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY ord) AS text FROM (""" + TURNS_SQL + ") GROUP BY ALL"
_ASKED = f"SELECT conv_id AS doc_id, string_agg(DISTINCT role, ',' ORDER BY role) AS sections, CASE WHEN conv_id % 2 = 0 THEN 'about ' || conv_id ELSE '' END AS about, CASE conv_id % 3 WHEN 0 THEN 'srs' WHEN 1 THEN 'api' ELSE '' END AS doc_type, CASE conv_id % 3 WHEN 0 THEN '{_SLOTS['srs']}' WHEN 1 THEN 'apis' ELSE '' END AS slots FROM conversations GROUP BY conv_id"
_KEPT_LINES = r"SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '[^\s\x0B\x{85}\p{Z}]'))) AS line FROM documents"

# A document is one section, so its lines fill chunks one after the other; over the limit the section is cut between lines.
_STREAM_ENDS = rf"""WITH RECURSIVE e AS (SELECT doc_id, i, '[ELEMENT: ' || printf('el-%04d', i) || ']' || chr(10) || trim(kept[i], chr(32) || chr(9) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(160) || chr(8195) || chr(12288)) AS marked FROM (SELECT doc_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '[^\s\x0B\x{{85}}\p{{Z}}]')) AS kept FROM documents))),
 u AS (SELECT *, length(marked) AS size, sum(length(marked)) OVER (PARTITION BY doc_id) > 4000 AS big FROM e),
 f AS (SELECT doc_id, i, 1 AS chunk, size AS held FROM u WHERE i = 1 UNION ALL SELECT u.doc_id, u.i, f.chunk + (u.big AND f.held + u.size > 4000)::INT, CASE WHEN u.big AND f.held + u.size > 4000 THEN u.size ELSE f.held + u.size END FROM f JOIN u ON u.doc_id = f.doc_id AND u.i = f.i + 1),
 c AS (SELECT doc_id, chunk, string_agg(marked, chr(10) || chr(10) ORDER BY i) AS text FROM u JOIN f USING (doc_id, i) GROUP BY ALL),
 d AS (SELECT doc_id, bool_and(contains(text, 'the')) AS good, sum(length(text))::BIGINT AS answered FROM c GROUP BY doc_id)
 SELECT o.doc_id, CASE WHEN d.doc_id IS NULL THEN 'uploaded,parsing,failed' WHEN good THEN 'uploaded,parsing,extracting,completed' ELSE 'uploaded,parsing,extracting,failed' END AS way, CASE WHEN d.doc_id IS NULL THEN 'parsing' WHEN good THEN '' ELSE 'extracting' END AS stopped, CASE WHEN good THEN answered ELSE 0 END AS answered FROM documents o LEFT JOIN d ON o.doc_id = d.doc_id"""

REGISTRY = {
    "object_view": (_viewed, _VIEWED_SQL),
    "first_positioned_evidence": (_first_placed, _FIRST_SQL),
    "stream_ends": (_stream_ends, _STREAM_ENDS),
    "extraction_contracts": (_contracts, "SELECT doc_id, doc_type, slots, CASE doc_type WHEN 'srs' THEN 'system_name,target_users' WHEN 'hld' THEN 'architecture_style,technology_stack' WHEN 'api' THEN 'base_url' WHEN 'tc' THEN 'test_scope' WHEN 'dbdd' THEN 'db_name,db_type' ELSE '' END AS fields, CASE WHEN doc_type = '' THEN 0 ELSE 5 END AS rules, CASE WHEN doc_type = '' THEN '' ELSE '术语表,术语定义,参考资料,参考文献,附录,references,glossary' END AS ignored FROM (SELECT doc_id, doc_type, CASE doc_type WHEN 'srs' THEN 'functional_requirements,non_functional_requirements,business_flows' WHEN 'hld' THEN 'modules,core_flows,design_decisions' WHEN 'api' THEN 'apis' WHEN 'tc' THEN 'test_cases' WHEN 'dbdd' THEN 'tables' ELSE '' END AS slots FROM (SELECT doc_id, CASE source " + _CASES + " ELSE '' END AS doc_type FROM documents))"),
    "chunk_prompts": (_prompts, f"SELECT doc_id, chunk_id, chunk_id || ' [' || section || '] pages ' || page_start || CASE WHEN page_end <> page_start THEN '-' || page_end ELSE '' END || ' ' || n || ' elements ' || length(text) || ' characters' AS summary, sections, about, doc_type, slots, section, page_start, page_end, allowed, text FROM ({_CHUNKS}) JOIN ({_ASKED}) USING (doc_id)"),
    "finalizer_inputs": (_finalizer, f"SELECT * FROM (SELECT doc_id, string_agg(chunk_no, ',' ORDER BY chunk_no) AS results FROM ({_CHUNKS}) WHERE n > 1 GROUP BY doc_id) JOIN (SELECT doc_id, sections, about, slots FROM ({_ASKED})) USING (doc_id)"),
    "batch_infer": (_inferred, "SELECT o_orderkey AS doc_id, o_orderpriority AS request, CASE WHEN o_orderpriority NOT LIKE '1%' THEN lower(o_orderpriority) END AS response, CASE WHEN o_orderpriority LIKE '1%' THEN 'ValueError: ' || o_orderpriority END AS error FROM orders"),
    "parse_llm_json": (_parsed, "SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'repaired' WHEN 'purchase' THEN 'repaired' ELSE 'parsed' END AS outcome, CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS k FROM events"),
    "trim_strings": (_trimmed, "SELECT p_partkey, p_name AS name, p_name || '|x' AS tags, p_brand AS brand, p_size AS size FROM part"),
    "validate_chunk_results": (_validated, f"SELECT *, bool_and(reason <> '') OVER (PARTITION BY doc_id) AS doc_failed FROM (SELECT doc_id, chunk_no::BIGINT AS chunk_no, CASE WHEN max(l_tax) > 0.065 THEN 'call failed' WHEN bool_or(name = '') THEN 'item without a name' WHEN bool_or(l_returnflag = 'R') THEN 'unknown method' ELSE '' END AS reason FROM ({_LINE_SAID}) GROUP BY ALL)"),
    "collect_candidates": (_candidates, f"SELECT doc_id, 'apis' AS slot, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no, l_partkey, l_suppkey) AS seq, name, description FROM ({_LINE_SAID})"),
    "union_lists": (_united, "SELECT doc_id, string_agg(value, ',' ORDER BY place, value) AS marks FROM (SELECT doc_id, value, min(place) AS place FROM (SELECT l_orderkey AS doc_id, l_returnflag AS value, 2 * l_linenumber AS place FROM lineitem UNION ALL SELECT l_orderkey, l_linestatus, 2 * l_linenumber + 1 FROM lineitem) GROUP BY ALL) GROUP BY doc_id"),
    "extraction_meta": (_meta, f"SELECT e.doc_id, 'rules' AS llm_model, element_count, section_count, chunk_count, failed_chunks, confidence FROM (SELECT doc_id, count(*) AS element_count, count(DISTINCT substring(text, 1, 6)) AS section_count FROM ({ORDER_ELEMENTS_SQL}) GROUP BY doc_id) e JOIN (SELECT l_orderkey AS doc_id, count(*) AS chunk_count, count(*) FILTER (l_returnflag = 'R') AS failed_chunks, round(avg((l_discount > 0.05)::INT), 4) AS confidence FROM lineitem GROUP BY ALL) c ON e.doc_id = c.doc_id"),
    "item_view": (lambda s, d: objects.item_view(_simple_objects(s, d), _simple_bound(s, d)).withColumn("evidence", F.array_join("evidence.element_id", ",")).drop("type_label"), f"SELECT doc_id, object_id, 'tables' AS slot, CASE WHEN rf <> 'R' THEN 'part ' || p WHEN q > 25 THEN rtrim(substring(repeat('long ', 12), 1, 48)) || '...' ELSE object_id END AS title, evidence FROM ({_SIMPLE}) JOIN (SELECT doc_id, object_id, string_agg(element_id, ',' ORDER BY element_id) AS evidence FROM ({_SIMPLE_BOUND}) GROUP BY ALL) USING (doc_id, object_id)"),
    "resolve_evidence_target": (_targets, f"SELECT s.doc_id, s.object_id, coalesce(max(e.element_id) FILTER (rf <> 'N' AND e.element_id = printf('el-%04d', n)), min(e.element_id) FILTER (contains(e.text, 'part ' || p)), '') AS target FROM ({_SIMPLE}) s LEFT JOIN ({ORDER_ELEMENTS_SQL}) e ON s.doc_id = e.doc_id GROUP BY ALL"),
    "targets_by_element": (lambda s, d: objects.targets_by_element(_simple_bound(s, d)).withColumn("objects", F.array_join("objects", ",")), f"SELECT doc_id, element_id, string_agg(object_id, ',' ORDER BY object_id) AS objects FROM ({_SIMPLE_BOUND}) GROUP BY ALL"),
    "route_by_extension": (lambda s, d: files.route_by_extension(table(s, d, "pages").select("page_id", "url"), "url").select("page_id", "extension", F.coalesce("source_type", F.lit("")).alias("source_type"), F.coalesce("message", F.lit("")).alias("message")), "SELECT page_id, e AS extension, CASE e WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.md' THEN 'markdown' WHEN '.txt' THEN 'text' ELSE '' END AS source_type, CASE WHEN e IN ('.pdf', '.docx', '.md', '.txt') THEN '' ELSE 'unsupported file type: ' || e END AS message FROM (SELECT page_id, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS e FROM pages)"),
    "read_typed_json": (_json_items, "SELECT p_partkey // 8 AS doc_id, CASE p_partkey % 2 WHEN 0 THEN 'modules' ELSE 'tables' END AS slot, p_partkey AS item_no, p_name AS name FROM part"),
    "manifest_join": (_manifest, "SELECT 'docs/' || d.doc_id || '.md' AS doc_path, 'gt/' || d.doc_id || '.json' AS gt_path, CASE WHEN toxic = 1 THEN 'failed' ELSE 'ok' END AS status FROM documents d JOIN labels l ON d.doc_id = l.doc_id"),
    "write_catalog": (_saved, "SELECT CASE source " + _CASES + " ELSE 'unknown' END AS doc_type, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1"),
    "write_eval_report": (_report, "SELECT 'slot' AS section, CASE p_partkey % 2 WHEN 0 THEN 'modules' ELSE 'tables' END AS key, count(*) AS count FROM part GROUP BY ALL UNION ALL SELECT 'document', (p_partkey // 8)::VARCHAR, count(*) FROM part GROUP BY ALL"),
    "stream_ingest": (_streamed, f"SELECT doc_id, count(*) AS elements, sum(length(line))::BIGINT AS chars FROM ({_KEPT_LINES}) GROUP BY doc_id"),
    "stream_status": (_status_stream, "SELECT doc_id, arg_max(status, ts) AS status, max(ts) AS ts, arg_max(status, ts) IN ('pending', 'uploaded', 'parsing', 'extracting') AS active FROM (SELECT user_id AS doc_id, CASE event_type WHEN 'signup' THEN 'uploaded' ELSE event_type END AS status, ts FROM events) GROUP BY doc_id"),
}
