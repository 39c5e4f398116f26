"""Queries on layout elements and rendered blocks, and their SQL. The layout of an order is made of its lines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import layout, render
from .sources.tables import table


def _lines(spark, sf):
    """Line items by order with ord (dense, from 0)."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return table(spark, sf, "lineitem").withColumn("ord", (n - 1).cast("long"))


_LINES_SQL = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS ord FROM lineitem"


# Paragraphs


def _visual_lines(spark, sf):
    """Turns of a conversation as visual lines: a text that goes on, one that ends, a label with a colon, an item, a title or a short word."""
    t = table(spark, sf, "conversations")
    said = F.when(F.col("turn") % 4 == 1, F.concat("text", F.lit("."))).when(F.col("turn") % 4 == 2, "label：").when(F.col("turn") % 9 == 3, "- one item of a longer list").otherwise(F.concat(F.lit(" "), F.regexp_replace("text", r"[.!?]+\s*$", ""), F.lit("　")))
    label = F.when((F.col("turn") % 4 == 2) & (F.col("role") == "system"), "Section_Header").otherwise("text")
    return t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), label.alias("label"), said.alias("text"), F.when(F.col("turn") % 5 != 4, F.expr("turn DIV 6")).alias("page"))


# The twin walks each conversation row by row with the run so far as its state.
_VISUAL_SQL = r"""SELECT conv_id AS doc_id, turn AS ord, CASE WHEN turn % 4 = 2 AND role = 'system' THEN 'Section_Header' ELSE 'text' END AS label,
 CASE WHEN turn % 4 = 1 THEN text || '.' WHEN turn % 4 = 2 THEN 'label：' WHEN turn % 9 = 3 THEN '- one item of a longer list' ELSE ' ' || regexp_replace(text, '[.!?]+\s*$', '') || chr(12288) END AS text,
 CASE WHEN turn % 5 <> 4 THEN turn // 6 END AS page FROM conversations"""
_MERGED_SQL = rf"""WITH RECURSIVE v AS ({_VISUAL_SQL}), s AS (SELECT *, trim(text, ' ' || chr(12288) || chr(9) || chr(10) || chr(13)) AS body, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM v),
 w AS (SELECT doc_id, n, ord AS first, label, text, body, page, body AS run, 1::INTEGER AS merged FROM s WHERE n = 1
 UNION ALL SELECT w.doc_id, s.n, CASE WHEN j THEN w.first ELSE s.ord END, CASE WHEN j THEN w.label ELSE s.label END,
 CASE WHEN j THEN rtrim(w.text, ' ' || chr(12288) || chr(9) || chr(10) || chr(13)) || sep || s.body ELSE s.text END, s.body, CASE WHEN j THEN w.page ELSE s.page END, CASE WHEN j THEN w.run || sep || s.body ELSE s.body END, CASE WHEN j THEN w.merged + 1 ELSE 1 END
 FROM w JOIN s ON s.doc_id = w.doc_id AND s.n = w.n + 1,
 LATERAL (SELECT w.label = 'text' AND s.label = 'text' AND w.run <> '' AND s.body <> '' AND (w.page IS NULL OR s.page IS NULL OR w.page = s.page) AND NOT (length(s.body) > 15 AND regexp_matches(s.body, '^([-+*]|\d+\.)\s+\S|^#{{1,6}}\s+\S|^\|.*\|$'))
 AND (right(w.run, 1) IN (':', '：') OR left(s.body, 1) IN (':', '：') OR (right(w.run, 1) NOT IN ('。', '.', '！', '!', '？', '?', '；', ';') AND length(w.run) >= 5)) AS j,
 CASE WHEN left(s.body, 1) IN (':', '：', '。', '.', '，', ',', '）', ')', '；', ';', '、', '？', '?', '！', '!') OR (unicode(left(s.body, 1)) > 127 AND unicode(right(w.run, 1)) > 127) THEN '' ELSE ' ' END AS sep) x)
 SELECT doc_id, first AS ord, arg_max(label, n) AS label, arg_max(text, n) AS text, arg_max(page, n) AS page, max(merged)::INTEGER AS merged FROM w GROUP BY doc_id, first"""


# Levels


def _nodes(spark, sf):
    """A heading for each line of an order: its parent is the line of half its place, or one that is not there."""
    place = F.col("ord") + 1
    text = F.when(place % 3 == 0, F.concat(F.lit("1.2."), F.col("l_linenumber").cast("string"), F.lit(". Part"))).otherwise(F.concat(F.lit("Part "), F.col("l_partkey").cast("string")))
    own = F.when(F.col("l_returnflag") == "A", F.col("l_quantity").cast("long").cast("string")).when(F.col("l_returnflag") == "R", "deep")
    markdown = F.when(F.col("l_linestatus") == "F", F.concat(F.repeat(F.lit("#"), F.col("l_linenumber")), F.lit(" Part"))).otherwise(text)
    parent = F.when(F.col("l_suppkey") % 10 == 0, F.lit(99)).otherwise(F.expr("(ord + 1) DIV 2"))
    return _lines(spark, sf).select(F.col("l_orderkey").alias("doc_id"), place.alias("node_id"), parent.cast("long").alias("parent_id"), text.alias("text"), markdown.alias("markdown"), own.alias("own"))


def _levels(spark, sf):
    nodes = _nodes(spark, sf)
    placed = nodes.join(layout.traversal_levels(nodes), ["doc_id", "node_id"])
    return placed.select("doc_id", "node_id", F.col("level").alias("traversal"), layout.heading_level(F.col("text"), F.col("markdown"), F.col("own"), F.col("level")).alias("level"))


_LEVELS_SQL = f"""WITH RECURSIVE n AS (SELECT l_orderkey AS doc_id, ord + 1 AS node_id, CASE WHEN l_suppkey % 10 = 0 THEN 99 ELSE (ord + 1) // 2 END AS parent_id, l_linenumber, l_linestatus, l_returnflag, l_quantity FROM ({_LINES_SQL})),
 t AS (SELECT n.doc_id, n.node_id, 1::BIGINT AS traversal FROM n WHERE NOT EXISTS (SELECT 1 FROM n p WHERE p.doc_id = n.doc_id AND p.node_id = n.parent_id) UNION ALL SELECT n.doc_id, n.node_id, t.traversal + 1 FROM n JOIN t ON n.doc_id = t.doc_id AND n.parent_id = t.node_id)
 SELECT doc_id, node_id, traversal, (CASE WHEN node_id % 3 = 0 THEN 4 WHEN l_linestatus = 'F' AND l_linenumber <= 6 THEN l_linenumber WHEN l_returnflag = 'A' THEN greatest(1, least(6, l_quantity::BIGINT)) ELSE least(6, traversal) END)::INTEGER AS level FROM n JOIN t USING (doc_id, node_id)"""


# Boxes


def _boxes(spark, sf):
    """A raw box for each line: its numbers give the sides; some sides are missing or no number, some boxes have no area."""
    side = F.when(F.col("l_linenumber") == 5, "NaN").when(F.col("l_linenumber") == 6, "left").when(F.col("l_linenumber") == 4, F.lit(None)).otherwise(F.col("l_quantity").cast("string"))
    return _lines(spark, sf).select(F.col("l_orderkey").alias("doc_id"), "ord", F.expr("l_suppkey % 3").alias("page"), side.alias("l"), (F.col("l_discount") * 100).alias("t"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(F.col("l_quantity") + 10.5).alias("r"), F.when(F.col("l_linestatus") == "F", F.lit(None)).otherwise(F.col("l_tax") * 100).alias("b"))


def _normalized(spark, sf):
    box = layout.bbox(*map(F.col, "ltrb"))
    return _boxes(spark, sf).select("doc_id", "ord", *(F.get(box, k).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))))


_SIDES_SQL = f"""SELECT l_orderkey AS doc_id, ord, l_suppkey % 3 AS page, l_linenumber IN (5, 6) AS odd, CASE WHEN l_linenumber = 4 THEN 0 ELSE l_quantity END AS x0, CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_tax * 100 END AS y0,
 CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE l_quantity + 10.5 END AS x1, l_discount * 100 AS y1 FROM ({_LINES_SQL})"""
_NORMALIZED_SQL = f"SELECT doc_id, ord, CASE WHEN NOT odd THEN x0::DOUBLE END AS x0, CASE WHEN NOT odd THEN y0::DOUBLE END AS y0, CASE WHEN NOT odd THEN x1::DOUBLE END AS x1, CASE WHEN NOT odd THEN y1::DOUBLE END AS y1 FROM ({_SIDES_SQL})"


def _by_box(spark, sf):
    """The boxes of a supplier's lines, by their order's priority in place of single documents: many objects share a place."""
    rows = _boxes(spark, sf).select((F.col("doc_id") % 50).alias("doc_id"), F.concat(F.lit("O-"), F.col("doc_id").cast("string")).alias("object_id"), "page", layout.bbox(*map(F.col, "ltrb")).alias("bbox"))
    found = layout.targets_by_box(rows, 0.5)
    return found.withColumn("objects", F.array_join("objects", ","))


_BY_BOX_SQL = f"""SELECT doc_id % 50 AS doc_id, page, floor(least(x0, x1) * 0.5 + 0.5)::BIGINT AS "left", floor(least(y0, y1) * 0.5 + 0.5)::BIGINT AS top, floor(abs(x1 * 0.5 - x0 * 0.5) + 0.5)::BIGINT AS width, floor(abs(y1 * 0.5 - y0 * 0.5) + 0.5)::BIGINT AS height,
 string_agg(DISTINCT 'O-' || doc_id, ',' ORDER BY 'O-' || doc_id) AS objects FROM ({_SIDES_SQL}) WHERE page <> 0 AND NOT odd AND x0 <> x1 AND y0 <> y1 GROUP BY ALL"""


# Rendering


def _typed_blocks(spark, sf):
    """Blocks of every type for each order with lines."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("x"))
    o = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    key = F.col("o_orderkey").cast("string")
    items = F.transform("x", lambda r: F.when(r.q % 7 == 0, F.lit("　")).otherwise(F.concat(F.lit(" part "), r.l_partkey.cast("string"), F.when(r.q % 3 == 0, F.lit("\nmore  ")).otherwise(""))))
    cell = lambda r: F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("a|<"), r.l_suppkey.cast("string"))).otherwise(r.l_suppkey.cast("string"))
    body = F.transform("x", lambda r: F.array(F.concat(F.lit(" "), r.l_partkey.cast("string")), F.when(r.q > 0, cell(r))))
    rows = F.concat(F.array(F.array(F.lit("part"), F.lit("from"))), body)
    n, s, a, r = (F.lit(None).cast(t) for t in ("int", "string", "array<string>", "array<array<string>>"))

    def block(no, kind, text=s, level=n, items=a, rows=r, language=s, src=s, ordered=False):
        return F.struct(F.lit(no).alias("block_no"), F.lit(kind).alias("type"), text.alias("text"), level.alias("level"), items.alias("items"), rows.alias("rows"), language.alias("language"), src.alias("src"), F.lit(ordered).alias("ordered"))

    every = F.array(
        block(6, "section_break"), block(0, "title", F.concat(F.lit(" Order "), key), level=(F.col("o_orderkey") % 9).cast("int")), block(1, "list", items=items), block(2, "list", items=items, ordered=True), block(3, "table", rows=rows),
        block(4, "quote", F.concat(F.lit("by  \n\n"), "o_orderpriority")), block(5, "code", F.concat(F.lit("SELECT "), key, F.lit("\n\n")), language=F.lit("sql ")), block(7, "image", F.lit("shown"), src=F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("of/"), key))), block(8, "unknown", F.lit(" \n")),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), F.explode(every).alias("b")).select("doc_id", "b.*")


_RENDERED_SQL = r"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 a AS (SELECT l_orderkey AS k, any_value(o_orderstatus) AS s, any_value(o_orderpriority) AS p, any_value(o_custkey) AS c, string_agg('- part ' || l_partkey || CASE WHEN l_quantity % 3 = 0 THEN chr(10) || '  more' ELSE '' END, chr(10) ORDER BY n) FILTER (l_quantity % 7 <> 0) AS dashes,
 string_agg(n || '. part ' || l_partkey || CASE WHEN l_quantity % 3 = 0 THEN chr(10) || '  more' ELSE '' END, chr(10) ORDER BY n) FILTER (l_quantity % 7 <> 0) AS numbers, string_agg('| ' || l_partkey || ' | ' || l_suppkey || ' |', chr(10) ORDER BY n) AS pipes,
 string_agg('  <tr>' || chr(10) || '    <td>' || l_partkey || '</td>' || chr(10) || '    <td>a|&lt;' || l_suppkey || '</td>' || chr(10) || '  </tr>', chr(10) ORDER BY n) AS html FROM l GROUP BY l_orderkey)
 SELECT k AS doc_id, concat_ws(chr(10) || chr(10), repeat('#', greatest(1, least(6, k % 9))::BIGINT) || ' Order ' || k, dashes, numbers,
 CASE s WHEN 'P' THEN '<table>' || chr(10) || '  <tr>' || chr(10) || '    <th>part</th>' || chr(10) || '    <th>from</th>' || chr(10) || '  </tr>' || chr(10) || html || chr(10) || '</table>' ELSE '| part | from |' || chr(10) || '| --- | --- |' || chr(10) || pipes END,
 '> by' || chr(10) || '> ' || p, '```sql' || chr(10) || 'SELECT ' || k || chr(10) || '```', '---', CASE WHEN c % 2 = 0 THEN '![](of/' || k || ')' ELSE 'shown' END) AS markdown FROM a"""


_LABELS = (" Section_Header", "title", "text", "TABLE", "picture", "figure　", "code_block", "list_item", "formula", None, "")


def _labelled(spark, sf):
    label = F.get(F.array(*map(F.lit, _LABELS)), (F.col("l_partkey") % len(_LABELS)).cast("int"))
    return _lines(spark, sf).select(F.col("l_orderkey").alias("doc_id"), "ord", layout.block_type(label).alias("block_type"), layout.element_type(label).alias("element_type"))


REGISTRY = {
    "map_layout_labels": (_labelled, f"SELECT l_orderkey AS doc_id, ord, ['title', 'title', 'paragraph', 'table', 'image', 'image', 'code', 'list', 'paragraph', 'paragraph', 'paragraph'][l_partkey % 11 + 1] AS block_type, ['heading', 'heading', 'paragraph', 'table', 'image', 'image', 'code', 'paragraph', 'paragraph', 'paragraph', 'paragraph'][l_partkey % 11 + 1] AS element_type FROM ({_LINES_SQL})"),
    "merge_adjacent_paragraphs": (lambda s, d: layout.merge_adjacent_paragraphs(_visual_lines(s, d)), _MERGED_SQL),
    "infer_heading_level": (_levels, _LEVELS_SQL),
    "normalize_bbox": (_normalized, _NORMALIZED_SQL),
    "targets_by_box": (_by_box, _BY_BOX_SQL),
    "render_blocks": (lambda s, d: render.render_blocks(_typed_blocks(s, d)), _RENDERED_SQL),
}
