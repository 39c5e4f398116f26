"""The evaluation queries and their SQL, on parts as labelled and predicted items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .operators import evaluation as ev
from .session import scratch
from .sources import files
from .sources.tables import LABELLED_SQL, PREDICTED_SQL, labelled_items, predicted_items, table

_PREPARED = """SELECT *, regexp_replace(translate(lower(clean), '（）', '()'), '\\s+', '', 'g') AS plain, list_distinct(list_concat(
 list_transform(range(1, greatest(length(clean), 1)), lambda i: substr(clean, i, 2)), list_transform(range(1, greatest(len(words), 1)), lambda i: words[i] || '_' || words[i + 1]))) AS grams
 FROM (SELECT *, list_filter(regexp_split_to_array(clean, '\\s+'), lambda w: w <> '') AS words FROM (SELECT *, trim(regexp_replace(name, '\\s*[（(][A-Za-z0-9_-]+[)）]\\s*$', '')) AS clean FROM ({items})))"""
_P, _G = _PREPARED.format(items=PREDICTED_SQL), _PREPARED.format(items=LABELLED_SQL)
_PAIRS_SQL = f"""SELECT * FROM (SELECT doc_id, slot, p.item_no AS pred_no, g.item_no AS gold_no, (CASE WHEN p.plain = g.plain AND p.plain <> '' THEN 1.0::DOUBLE
 WHEN length(p.plain) >= 3 AND length(g.plain) >= 3 AND (contains(p.plain, g.plain) OR contains(g.plain, p.plain)) THEN 0.95::DOUBLE
 WHEN len(p.grams) + len(g.grams) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(p.grams, g.grams)) / (len(p.grams) + len(g.grams) - len(list_intersect(p.grams, g.grams))) END)
 * CASE WHEN p.kind <> g.kind THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS similarity FROM ({_P}) p JOIN ({_G}) g USING (doc_id, slot)) WHERE similarity >= 0.3"""
_MATCHED = f"""r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, slot ORDER BY similarity DESC, pred_no, gold_no) AS rn FROM ({_PAIRS_SQL})),
 f AS (SELECT doc_id, slot, rn, pred_no, gold_no, similarity, true AS taken, [pred_no] AS ps, [gold_no] AS gs FROM r WHERE rn = 1 UNION ALL
 SELECT r.doc_id, r.slot, r.rn, r.pred_no, r.gold_no, r.similarity, n.free, CASE WHEN n.free THEN list_append(f.ps, r.pred_no) ELSE f.ps END, CASE WHEN n.free THEN list_append(f.gs, r.gold_no) ELSE f.gs END
 FROM f JOIN r ON r.doc_id = f.doc_id AND r.slot = f.slot AND r.rn = f.rn + 1, LATERAL (SELECT NOT list_contains(f.ps, r.pred_no) AND NOT list_contains(f.gs, r.gold_no) AS free) n),
 m AS MATERIALIZED (SELECT doc_id, slot, pred_no, gold_no, similarity FROM f WHERE taken), p AS MATERIALIZED ({PREDICTED_SQL}), g AS MATERIALIZED ({LABELLED_SQL}),
 c AS (SELECT doc_id, slot, sum(b)::BIGINT AS tp, sum(x - b)::BIGINT AS fp, sum(y - b)::BIGINT AS fn FROM (SELECT doc_id, slot, 1 AS x, 0 AS y, 0 AS b FROM p UNION ALL SELECT doc_id, slot, 0, 1, 0 FROM g UNION ALL SELECT doc_id, slot, 0, 0, 1 FROM m) GROUP BY ALL)"""
_SCORES = "CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) ELSE 0 END AS f1"


def _given(side: str, field: str) -> str:
    return f"coalesce(trim({side}.{field}) <> '', false)"


_FILLED = " + ".join(f"({_given('p', f)} AND {_given('g', f)})::INT" for f in ev.FIELDS)
_EXPECTED = " + ".join(f"{_given('g', f)}::INT" for f in ev.FIELDS)


def _free(items: str, number: str, side: str) -> str:
    return f"""SELECT doc_id, slot, '{side}' AS side, item_no, name AS label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, slot ORDER BY item_no) AS n FROM {items} i
 WHERE NOT EXISTS (SELECT 1 FROM m JOIN {items} h ON m.doc_id = h.doc_id AND m.slot = h.slot AND m.{number} = h.item_no WHERE h.doc_id = i.doc_id AND h.slot = i.slot AND h.name = i.name)) WHERE n <= 5"""


_SLOTS = f"""{_MATCHED}, k AS (SELECT m.doc_id, m.slot, sum({_FILLED})::BIGINT AS filled, sum({_EXPECTED})::BIGINT AS expected FROM m JOIN p ON m.doc_id = p.doc_id AND m.slot = p.slot AND m.pred_no = p.item_no JOIN g ON m.doc_id = g.doc_id AND m.slot = g.slot AND m.gold_no = g.item_no GROUP BY ALL),
 e AS (SELECT doc_id, slot, round(count(*) FILTER (n_evidence > 0) / count(*), 4) AS coverage FROM p GROUP BY ALL),
 s AS MATERIALIZED (SELECT *, {_SCORES} FROM (SELECT doc_id, slot, slot = 'tables' AS ignored, tp + fp AS pred_count, CASE WHEN slot = 'tables' THEN 0 ELSE tp END AS tp, CASE WHEN slot = 'tables' THEN 0 ELSE fp END AS fp, CASE WHEN slot = 'tables' THEN 0 ELSE fn END AS fn,
 CASE WHEN slot = 'tables' THEN 0 ELSE coalesce(filled, 0) END AS filled, CASE WHEN slot = 'tables' THEN 0 ELSE coalesce(expected, 0) END AS expected, CASE WHEN slot = 'tables' THEN 0 ELSE coalesce(coverage, 0) END AS coverage FROM c LEFT JOIN k USING (doc_id, slot) LEFT JOIN e USING (doc_id, slot))),
 d AS (SELECT *, {_SCORES}, CASE WHEN expected > 0 THEN round(filled / expected, 4) ELSE 0 END AS completeness FROM (SELECT doc_id, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(filled)::BIGINT AS filled, sum(expected)::BIGINT AS expected, coalesce(round(avg(coverage) FILTER (pred_count > 0), 4), 0) AS coverage FROM s GROUP BY doc_id))"""


def _slots(spark, sf):
    matched, both = _matched(spark, sf), _both(spark, sf)
    return ev.slot_metrics(ev.slot_counts(*both, matched), ev.field_completeness(matched, *both), ev.evidence_share(both[0]), ("tables",))


def _documents(spark, sf):
    return ev.document_metrics(_slots(spark, sf))


def _both(spark, sf):
    return predicted_items(spark, sf), labelled_items(spark, sf)


def _matched(spark, sf):
    return ev.greedy_match(ev.candidate_pairs(*_both(spark, sf)))


def _counts(spark, sf):
    return ev.slot_counts(*_both(spark, sf), _matched(spark, sf))


def _runs(spark, sf):
    """The documents of three models; every fifth has failed, some took longer or gave no JSON."""
    rows = _documents(spark, sf)
    return rows.withColumns({"model": F.concat(F.lit("model "), (F.col("doc_id") % 3).cast("string")), "status": F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("ok"), "json_valid": F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("doc_id") % 4 != 0), "elapsed": (F.col("doc_id") % 10) / 4})


_RUNS = f"""SELECT *, {_SCORES} FROM (SELECT 'model ' || doc_id % 3 AS model, sum(tp) FILTER (doc_id % 5 <> 0)::BIGINT AS tp, sum(fp) FILTER (doc_id % 5 <> 0)::BIGINT AS fp, sum(fn) FILTER (doc_id % 5 <> 0)::BIGINT AS fn, round(avg(completeness) FILTER (doc_id % 5 <> 0), 4) AS completeness,
 round(avg(coverage) FILTER (doc_id % 5 <> 0), 4) AS coverage, round(avg(doc_id % 10 / 4) FILTER (doc_id % 5 <> 0), 3) AS elapsed, round(avg((doc_id % 7 <> 0 AND doc_id % 4 <> 0)::INT), 4) AS json_valid_rate FROM d GROUP BY 1)"""


def _reported(spark, sf):
    """Rows and matches of each section of the report, read back from its files."""
    path = scratch(spark, "report")
    found = ev.report(ev.run_metrics(_runs(spark, sf)), _documents(spark, sf), _slots(spark, sf), ev.unmatched_examples(*_both(spark, sf), _matched(spark, sf)))
    files.write_report(path, **found)
    sections = [spark.read.schema(frame.schema).json(f"{path}/{name}").select(F.lit(name).alias("section"), (F.col("tp") if "tp" in frame.columns else F.lit(0)).cast("long").alias("tp")) for name, frame in sorted(found.items())]
    every = reduce(lambda a, b: a.union(b), sections)
    return every.groupBy("section").agg(F.count("*").alias("n"), F.sum("tp").alias("tp"))


def _typed_items(spark, sf):
    """Predicted and labelled items of slots with rules of their own; a supplier of parts is a document."""
    t, key = table(spark, sf, "part"), F.col("p_partkey")
    slot = F.get(F.array(*map(F.lit, ("apis", "auth", "non_functional_requirements", "interfaces", "modules"))), (key % 5).cast("int"))
    at = F.concat(F.lit("/v/"), (key % 11).cast("string"))

    def side(name, kind, method, path, text):
        return t.select(F.expr("p_partkey DIV 40").alias("doc_id"), slot.alias("slot"), key.alias("item_no"), name.alias("name"), kind.alias("kind"), method.alias("method"), path.alias("path"), F.lit("http").alias("interface_type"), path.alias("endpoint"), F.when(key % 3 == 0, F.col("p_brand")).alias("auth_type"), text.alias("description"), F.lit("").alias("summary"))

    gold = side(F.col("p_name"), F.when(key % 4 == 0, "system").when(key % 4 == 1, "HTTP "), F.when(key % 2 == 0, "GET").otherwise("POST"), at, F.col("p_type"))
    predicted = side(F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("　"), F.upper("p_name"), F.lit("（A_1-2）"))), F.when(key % 4 == 0, "data").when(key % 4 == 1, "rpc").otherwise("new"), F.when(key % 2 == 0, " get").otherwise("PUT"), F.when(key % 7 != 0, at), F.when(key % 2 == 0, F.col("p_type")))
    return predicted, gold


# The twin states the normalized texts of both sides from the table, and each slot's rule as a case.
_SIMILAR_SQL = """WITH b AS (SELECT *, p_partkey // 40 AS doc_id, ['apis', 'auth', 'non_functional_requirements', 'interfaces', 'modules'][p_partkey % 5 + 1] AS slot, '/v/' || p_partkey % 11 AS at FROM part),
 p AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'data' WHEN 1 THEN 'rpc' ELSE 'new' END AS kind, list_filter([CASE WHEN p_partkey % 6 <> 0 THEN upper(p_name) END, CASE WHEN slot = 'auth' AND p_partkey % 3 = 0 THEN p_brand END, CASE WHEN slot IN ('auth', 'non_functional_requirements') AND p_partkey % 2 = 0 THEN p_type END], lambda x: x IS NOT NULL) AS said FROM b),
 g AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'system' WHEN 1 THEN 'http' ELSE '' END AS kind, list_filter([p_name, CASE WHEN slot = 'auth' AND p_partkey % 3 = 0 THEN p_brand END, CASE WHEN slot IN ('auth', 'non_functional_requirements') THEN p_type END], lambda x: x IS NOT NULL) AS said FROM b),
 t AS (SELECT DISTINCT x, replace(lower(x), ' ', '') AS plain, list_distinct(list_concat(list_transform(range(1, greatest(length(x), 1)), lambda i: substr(x, i, 2)), list_transform(range(1, len(string_split(x, ' '))), lambda i: string_split(x, ' ')[i] || '_' || string_split(x, ' ')[i + 1]))) AS grams FROM (SELECT unnest(said) AS x FROM p UNION ALL SELECT unnest(said) FROM g UNION ALL SELECT '')),
 pt AS (SELECT p_partkey, t.* FROM (SELECT p_partkey, unnest(CASE WHEN len(said) > 0 THEN said ELSE [''] END) AS x FROM p) JOIN t USING (x)), gt AS (SELECT p_partkey, t.* FROM (SELECT p_partkey, unnest(said) AS x FROM g) JOIN t USING (x)),
 pairs AS (SELECT p.doc_id, p.slot, p.p_partkey AS pred_no, g.p_partkey AS gold_no, CASE WHEN p.kind = g.kind OR g.kind = '' THEN 1.0 WHEN p.kind = 'data' AND g.kind = 'system' THEN 0.7 WHEN p.kind = 'rpc' AND g.kind = 'http' THEN 0.6 ELSE 0.5 END::DOUBLE AS weight,
 CASE p.slot WHEN 'apis' THEN p.p_partkey % 2 = 0 AND g.p_partkey % 2 = 0 AND p.p_partkey % 7 <> 0 AND p.at = g.at WHEN 'interfaces' THEN p.p_partkey % 7 <> 0 AND p.at = g.at WHEN 'auth' THEN p.p_partkey % 3 = 0 AND g.p_partkey % 3 = 0 AND p.p_brand = g.p_brand ELSE false END AS same FROM p JOIN g USING (doc_id, slot)),
 best AS (SELECT pred_no, gold_no, max(CASE WHEN a.plain = c.plain AND a.plain <> '' THEN 1.0::DOUBLE WHEN length(a.plain) >= 3 AND length(c.plain) >= 3 AND (contains(a.plain, c.plain) OR contains(c.plain, a.plain)) THEN 0.95::DOUBLE WHEN len(a.grams) + len(c.grams) = 0 THEN 1.0::DOUBLE
 ELSE len(list_intersect(a.grams, c.grams)) / (len(a.grams) + len(c.grams) - len(list_intersect(a.grams, c.grams))) END) AS text FROM pairs JOIN pt a ON a.p_partkey = pred_no JOIN gt c ON c.p_partkey = gold_no GROUP BY ALL)
 SELECT * FROM (SELECT doc_id, slot, pred_no, gold_no, CASE WHEN same THEN 1.0::DOUBLE WHEN slot = 'apis' THEN 0 ELSE text * weight END AS similarity FROM pairs JOIN best USING (pred_no, gold_no)) WHERE similarity >= 0.3"""


REGISTRY = {
    "eval_slots": (lambda s, d: ev.eval_slots(*_both(s, d)), f"SELECT DISTINCT doc_id, slot FROM (SELECT doc_id, slot FROM ({PREDICTED_SQL}) UNION ALL SELECT doc_id, slot FROM ({LABELLED_SQL}))"),
    "slot_metrics": (_slots, f"WITH RECURSIVE {_SLOTS} SELECT * FROM s"),
    "document_metrics": (_documents, f"WITH RECURSIVE {_SLOTS} SELECT * FROM d"),
    "compare_models": (lambda s, d: ev.compare_models(ev.run_metrics(_runs(s, d))), f"WITH RECURSIVE {_SLOTS} SELECT *, row_number() OVER (ORDER BY f1 DESC, completeness DESC, coverage DESC, json_valid_rate DESC, elapsed, model) AS place FROM ({_RUNS})"),
    "run_metrics": (lambda s, d: ev.run_metrics(_runs(s, d)), f"WITH RECURSIVE {_SLOTS} {_RUNS}"),
    "slot_similarity": (lambda s, d: ev.candidate_pairs(*_typed_items(s, d)), _SIMILAR_SQL),
    "eval_report": (_reported, f"WITH RECURSIVE {_SLOTS} SELECT 'documents' AS section, count(*) AS n, sum(tp)::BIGINT AS tp FROM d UNION ALL SELECT 'overall', 3, sum(tp) FILTER (doc_id % 5 <> 0)::BIGINT FROM d UNION ALL SELECT 'slots', count(*), sum(tp)::BIGINT FROM s UNION ALL SELECT 'samples', (SELECT count(*) FROM s WHERE ignored) + (SELECT count(*) FROM (SELECT DISTINCT doc_id, slot, side FROM ({_free('p', 'pred_no', 'false_positive')} UNION ALL {_free('g', 'gold_no', 'false_negative')}) WHERE slot <> 'tables')), 0"),
    "clean_names": (lambda s, d: ev.prepared(predicted_items(s, d)).select("item_no", "plain"), f"SELECT item_no, plain FROM ({_P})"),
    "candidate_pairs": (lambda s, d: ev.candidate_pairs(*_both(s, d)), _PAIRS_SQL),
    "greedy_match": (_matched, f"WITH RECURSIVE {_MATCHED} SELECT * FROM m"),
    "precision_recall_f1": (lambda s, d: ev.scores(_counts(s, d)), f"WITH RECURSIVE {_MATCHED} SELECT *, {_SCORES} FROM c"),
    "overall_metrics": (lambda s, d: ev.overall(_counts(s, d)), f"WITH RECURSIVE {_MATCHED} SELECT *, {_SCORES} FROM (SELECT slot, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY GROUPING SETS ((slot), ()))"),
    "field_completeness": (lambda s, d: ev.field_completeness(_matched(s, d), *_both(s, d)), f"WITH RECURSIVE {_MATCHED} SELECT *, CASE WHEN expected > 0 THEN round(filled / expected, 4) ELSE 0 END AS completeness FROM (SELECT m.doc_id, m.slot, sum({_FILLED})::BIGINT AS filled, sum({_EXPECTED})::BIGINT AS expected FROM m JOIN p ON m.doc_id = p.doc_id AND m.slot = p.slot AND m.pred_no = p.item_no JOIN g ON m.doc_id = g.doc_id AND m.slot = g.slot AND m.gold_no = g.item_no GROUP BY ALL)"),
    "pred_evidence_coverage": (lambda s, d: ev.evidence_share(predicted_items(s, d)), f"SELECT doc_id, slot, round(count(*) FILTER (n_evidence > 0) / count(*), 4) AS coverage FROM ({PREDICTED_SQL}) GROUP BY doc_id, slot"),
    "unmatched_examples": (lambda s, d: ev.unmatched_examples(*_both(s, d), _matched(s, d)), f"WITH RECURSIVE {_MATCHED} {_free('p', 'pred_no', 'false_positive')} UNION ALL {_free('g', 'gold_no', 'false_negative')}"),
}
