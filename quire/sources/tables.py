"""Elements, candidates and labelled items from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, element_id, section, page, text: a conversation is a document, a turn an element, its role the section."""
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.format_string("el-%04d", F.col("turn") + 1).alias("element_id"), F.col("role").alias("section"), F.col("turn").alias("page"), "text")


TURNS_SQL = "SELECT conv_id AS doc_id, turn AS ord, printf('el-%04d', turn + 1) AS element_id, role AS section, turn AS page, text FROM conversations"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, seq, name, item_type, description, evidence_id: an order is a document, a line a candidate."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    slot = F.when(F.col("l_returnflag") == "A", "apis").when(F.col("l_returnflag") == "N", "modules").otherwise("tables")
    numbered = line.select("l_orderkey", "l_partkey", "l_linenumber", "l_linestatus", slot.alias("slot"), seq.cast("long").alias("seq"))
    return numbered.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc_id"), "slot", "seq", F.col("p_brand").alias("name"), F.col("l_linestatus").alias("item_type"), F.col("p_name").alias("description"), F.format_string("el-%04d", "l_linenumber").alias("evidence_id"))


CANDIDATES_SQL = """SELECT l_orderkey AS doc_id, CASE l_returnflag WHEN 'A' THEN 'apis' WHEN 'N' THEN 'modules' ELSE 'tables' END AS slot, seq,
 p_brand AS name, l_linestatus AS item_type, p_name AS description, printf('el-%04d', l_linenumber) AS evidence_id
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem) JOIN part ON l_partkey = p_partkey"""


def order_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, element_id, text: one element for each line number of an order that has a quantity over 8."""
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 8")
    return line.groupBy(F.col("l_orderkey").alias("doc_id"), "l_linenumber").agg(F.min("l_partkey").alias("p")).select("doc_id", F.format_string("el-%04d", "l_linenumber").alias("element_id"), F.concat(F.lit("part "), F.col("p").cast("string")).alias("text"))


ORDER_ELEMENTS_SQL = "SELECT l_orderkey AS doc_id, printf('el-%04d', l_linenumber) AS element_id, 'part ' || min(l_partkey) AS text FROM lineitem WHERE l_quantity > 8 GROUP BY l_orderkey, l_linenumber"


def labelled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, item_no, name, kind, description: eight parts are a document, each a labelled item."""
    slot = F.when(F.col("p_partkey") % 2 == 0, "modules").otherwise("tables")
    return table(spark, sf_dir, "part").select(F.expr("p_partkey DIV 8").alias("doc_id"), slot.alias("slot"), F.col("p_partkey").alias("item_no"), F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("description"))


def predicted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As labelled_items, those of a size of 10 and more, with changed names and kinds and fewer descriptions, and n_evidence."""
    key, name = F.col("p_partkey"), F.col("p_name")
    slot = F.when(key % 2 == 0, "modules").otherwise("tables")
    said = F.when(key % 3 == 0, F.concat(name, F.lit(" (P-1)"))).when(key % 3 == 1, F.upper(name)).otherwise(name)
    kind = F.when(key % 7 == 0, "Brand#0").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").where("p_size >= 10").select(F.expr("p_partkey DIV 8").alias("doc_id"), slot.alias("slot"), key.alias("item_no"), said.alias("name"), kind.alias("kind"), F.when(F.col("p_size") > 20, F.col("p_type")).alias("description"), (F.col("p_size") % 4).alias("n_evidence"))


LABELLED_SQL = "SELECT p_partkey // 8 AS doc_id, CASE p_partkey % 2 WHEN 0 THEN 'modules' ELSE 'tables' END AS slot, p_partkey AS item_no, p_name AS name, p_brand AS kind, CASE WHEN p_size > 10 THEN p_type END AS description FROM part"
PREDICTED_SQL = """SELECT p_partkey // 8 AS doc_id, CASE p_partkey % 2 WHEN 0 THEN 'modules' ELSE 'tables' END AS slot, p_partkey AS item_no,
 CASE p_partkey % 3 WHEN 0 THEN p_name || ' (P-1)' WHEN 1 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 7 = 0 THEN 'Brand#0' ELSE p_brand END AS kind,
 CASE WHEN p_size > 20 THEN p_type END AS description, p_size % 4 AS n_evidence FROM part WHERE p_size >= 10"""


#: Orders, or lines of them, of a task, about: what a task sorts then does not grow with the tables.
ORDERS_A_TASK, LINES_A_TASK = 25_000, 100_000


def tasks_for_orders(spark: SparkSession, sf_dir: str) -> int:
    """Tasks among which the orders and their lines are dealt, by the rows that the files say they have."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "orders").count() // ORDERS_A_TASK))


def tasks_for_lines(spark: SparkSession, sf_dir: str) -> int:
    """The same where only the lines of orders are read."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // LINES_A_TASK))


def markdown_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a Markdown document for each order with lines: titles, a version row, a table, a list, code, a quote.

    Lines are dealt by their order before they are gathered; to gather them where they are read would sort a whole file there.
    """
    n = tasks_for_orders(spark, sf_dir)
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").cast("string").alias("quantity"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    key = F.col("o_orderkey").cast("string")
    rows = F.transform("rows", lambda x: F.concat(F.lit("| "), x.l_linenumber.cast("string"), F.lit(" | "), x.l_partkey.cast("string"), F.lit("|"), x.quantity, F.lit(" |")))
    items = F.transform("rows", lambda x: F.concat(F.lit("- part "), x.l_partkey.cast("string")))
    text = [F.concat(F.lit("# Order "), key), F.lit(""), F.concat(F.lit("| Document  Version | **v1."), (F.col("o_orderkey") % 7).cast("string"), F.lit("** |")), F.lit("\u3000"), F.concat(F.lit("## Status "), "o_orderstatus", F.lit(" ")), F.lit(""), F.lit("| line | part | quantity |"), F.lit("| --- |:---:| --- |"), F.array_join(rows, "\r\n"), F.lit(""), F.lit("### 1.1 Parts"), F.array_join(items, "\n"), F.lit("  continued"), F.lit(""), F.lit("```sql"), F.concat(F.lit("SELECT "), key), F.lit("# not a title"), F.lit("````"), F.concat(F.lit("> priority "), "o_orderpriority"), F.lit(">clerk"), F.lit(""), F.lit("2.1 Totals"), F.concat(F.lit("total "), key), F.lit(" second line"), F.lit("---")]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").repartition(n, "o_orderkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("doc_id"), F.concat_ws("\n", *text).alias("text"), F.when(F.col("o_orderstatus") != "F", F.lit("v9")).alias("version"))


_ORDERS_SQL = """SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, n, rows, items FROM orders JOIN (SELECT l_orderkey, count(*) AS n,
 string_agg('| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_quantity::BIGINT || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT::VARCHAR) AS rows,
 string_agg('part ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""
#: The blocks of those documents, straight from the tables: no text is parsed.
MARKDOWN_BLOCKS_SQL = f"""SELECT k AS doc_id, n, s, unnest([
 {{'block_no': 0, 'type': 'title', 'level': 1, 'text': 'Order ' || k, 'line_start': 1, 'line_end': 1, 'path': 'Order ' || k}},
 {{'block_no': 1, 'type': 'paragraph', 'level': NULL, 'text': '| Document  Version | **v1.' || k % 7 || '** |', 'line_start': 3, 'line_end': 4, 'path': 'Order ' || k}},
 {{'block_no': 2, 'type': 'title', 'level': 2, 'text': 'Status ' || s, 'line_start': 5, 'line_end': 5, 'path': 'Order ' || k || ' > Status ' || s}},
 {{'block_no': 3, 'type': 'table', 'level': NULL, 'text': '| line | part | quantity |' || chr(10) || rows, 'line_start': 7, 'line_end': 8 + n, 'path': 'Order ' || k || ' > Status ' || s}},
 {{'block_no': 4, 'type': 'title', 'level': 3, 'text': '1.1 Parts', 'line_start': 10 + n, 'line_end': 10 + n, 'path': 'Order ' || k || ' > Status ' || s || ' > 1.1 Parts'}},
 {{'block_no': 5, 'type': 'list', 'level': NULL, 'text': items || chr(10) || 'continued', 'line_start': 11 + n, 'line_end': 12 + 2 * n, 'path': 'Order ' || k || ' > Status ' || s || ' > 1.1 Parts'}},
 {{'block_no': 6, 'type': 'code', 'level': NULL, 'text': 'SELECT ' || k || chr(10) || '# not a title', 'line_start': 13 + 2 * n, 'line_end': 16 + 2 * n, 'path': 'Order ' || k || ' > Status ' || s || ' > 1.1 Parts'}},
 {{'block_no': 7, 'type': 'quote', 'level': NULL, 'text': 'priority ' || p || chr(10) || 'clerk', 'line_start': 17 + 2 * n, 'line_end': 18 + 2 * n, 'path': 'Order ' || k || ' > Status ' || s || ' > 1.1 Parts'}},
 {{'block_no': 8, 'type': 'title', 'level': 2, 'text': '2.1 Totals', 'line_start': 20 + 2 * n, 'line_end': 20 + 2 * n, 'path': 'Order ' || k || ' > 2.1 Totals'}},
 {{'block_no': 9, 'type': 'paragraph', 'level': NULL, 'text': 'total ' || k || chr(10) || 'second line', 'line_start': 21 + 2 * n, 'line_end': 22 + 2 * n, 'path': 'Order ' || k || ' > 2.1 Totals'}},
 {{'block_no': 10, 'type': 'section_break', 'level': NULL, 'text': '---', 'line_start': 23 + 2 * n, 'line_end': 23 + 2 * n, 'path': 'Order ' || k || ' > 2.1 Totals'}}], max_depth := 2) FROM ({_ORDERS_SQL})"""
#: The lines of those documents, stripped, with what each is, likewise: those that every document has, then its rows, then its items.
MARKDOWN_LINES_SQL = f"""WITH o AS MATERIALIZED ({_ORDERS_SQL}), l AS MATERIALIZED (SELECT k, n, i, l_linenumber, l_partkey, quantity FROM o JOIN (SELECT *, l_quantity::BIGINT AS quantity,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT::VARCHAR) AS i FROM lineitem) ON k = l_orderkey) SELECT k AS doc_id, unnest([
 {{'line_no': 1, 'body': '# Order ' || k, 'label': 'heading', 'level': 1, 'title': 'Order ' || k}},
 {{'line_no': 2, 'body': '', 'label': 'blank', 'level': NULL, 'title': NULL}},
 {{'line_no': 3, 'body': '| Document  Version | **v1.' || k % 7 || '** |', 'label': 'text', 'level': NULL, 'title': NULL}},
 {{'line_no': 4, 'body': '', 'label': 'blank', 'level': NULL, 'title': NULL}},
 {{'line_no': 5, 'body': '## Status ' || s, 'label': 'heading', 'level': 2, 'title': 'Status ' || s}},
 {{'line_no': 6, 'body': '', 'label': 'blank', 'level': NULL, 'title': NULL}},
 {{'line_no': 7, 'body': '| line | part | quantity |', 'label': 'table', 'level': NULL, 'title': NULL}},
 {{'line_no': 8, 'body': '| --- |:---:| --- |', 'label': 'text', 'level': NULL, 'title': NULL}},
 {{'line_no': 9 + n, 'body': '', 'label': 'blank', 'level': NULL, 'title': NULL}},
 {{'line_no': 10 + n, 'body': '### 1.1 Parts', 'label': 'heading', 'level': 3, 'title': '1.1 Parts'}},
 {{'line_no': 11 + 2 * n, 'body': 'continued', 'label': 'text', 'level': NULL, 'title': NULL}},
 {{'line_no': 12 + 2 * n, 'body': '', 'label': 'blank', 'level': NULL, 'title': NULL}},
 {{'line_no': 13 + 2 * n, 'body': '```sql', 'label': 'fence', 'level': NULL, 'title': NULL}},
 {{'line_no': 14 + 2 * n, 'body': 'SELECT ' || k, 'label': 'text', 'level': NULL, 'title': NULL}},
 {{'line_no': 15 + 2 * n, 'body': '# not a title', 'label': 'heading', 'level': 1, 'title': 'not a title'}},
 {{'line_no': 16 + 2 * n, 'body': '````', 'label': 'fence', 'level': NULL, 'title': NULL}},
 {{'line_no': 17 + 2 * n, 'body': '> priority ' || p, 'label': 'quote', 'level': NULL, 'title': NULL}},
 {{'line_no': 18 + 2 * n, 'body': '>clerk', 'label': 'quote', 'level': NULL, 'title': NULL}},
 {{'line_no': 19 + 2 * n, 'body': '', 'label': 'blank', 'level': NULL, 'title': NULL}},
 {{'line_no': 20 + 2 * n, 'body': '2.1 Totals', 'label': 'heading', 'level': 2, 'title': '2.1 Totals'}},
 {{'line_no': 21 + 2 * n, 'body': 'total ' || k, 'label': 'text', 'level': NULL, 'title': NULL}},
 {{'line_no': 22 + 2 * n, 'body': 'second line', 'label': 'text', 'level': NULL, 'title': NULL}},
 {{'line_no': 23 + 2 * n, 'body': '---', 'label': 'break', 'level': NULL, 'title': NULL}}], max_depth := 2) FROM o
 UNION ALL SELECT k, 8 + i, '| ' || l_linenumber || ' | ' || l_partkey || '|' || quantity || ' |', 'text', NULL, NULL FROM l
 UNION ALL SELECT k, 10 + n + i, '- part ' || l_partkey, 'item', NULL, NULL FROM l"""
