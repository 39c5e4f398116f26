"""Predicted items against labelled ones: similarity, one-to-one matches, scores.

Items have doc_id, slot, item_no, name, kind and description. Pairs meet within one document and slot.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .blocks import stripped

CODE = r"(?U)\s*[（(][A-Za-z0-9_-]+[)）]\s*$"
FIELDS = ("name", "kind", "description")
# Fields that name an item beside its name and summary, by slot; fields that make two items the same, by slot.
ALSO_KNOWN_BY = ((("test_steps", "reproduction_steps"), ("action", "expected", "actual")), (("non_functional_requirements",), ("description", "category")), (("auth",), ("auth_type", "description")))
SAME_BY = (("endpoints", ("http_method", "path")), ("apis", ("method", "path")), ("interfaces", ("interface_type", "http_method", "endpoint")), ("interfaces", ("interface_type", "endpoint")), ("auth", ("auth_type",)))
ONLY_BY_KEY = ("apis",)
# How alike two types are that are often confused.
ALIKE = {("system", "data"): 0.7, ("data", "system"): 0.7, ("actor", "system"): 0.5, ("system", "actor"): 0.5, ("functional", "non_functional"): 0.6, ("non_functional", "functional"): 0.6, ("http", "rpc"): 0.6, ("rpc", "http"): 0.6, ("database", "file"): 0.5, ("file", "database"): 0.5}


def cleaned(name: Column) -> Column:
    """The name without a code in brackets at its end."""
    return stripped(F.regexp_replace(stripped(name), CODE, ""))


def squeezed(text: Column) -> Column:
    """In lower case, with plain brackets and no white space."""
    return F.regexp_replace(F.translate(F.lower(text), "（）", "()"), r"(?U)\s+", "")


def normalized(name: Column) -> Column:
    """The cleaned name, squeezed."""
    return squeezed(cleaned(name))


def bigrams(text: Column) -> Column:
    """The set of character bigrams and of neighbouring words joined by an underscore."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")

    def pairs(n: Column, make) -> Column:
        return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), make)).otherwise(F.array().cast("array<string>"))

    characters = pairs(F.length(text), lambda i: F.substring(text, i, 2))
    return F.array_union(characters, pairs(F.size(words), lambda i: F.concat_ws("_", F.get(words, i - 1), F.get(words, i))))


def jaccard(a: Column, b: Column) -> Column:
    """The share of common members of two sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def _text(value: Column) -> Column:
    return F.struct(normalized(value).alias("plain"), bigrams(cleaned(value)).alias("grams"))


def prepared(items: DataFrame) -> DataFrame:
    """Adds plain (the normalized name), texts (what an item may be known by, of the columns that the items have) and keys.

    Done once for each item and not for each pair. texts are the name and summary and what the slot adds; an item without
    any has its empty name. keys are the normalized fields by which a slot's items are the same, one record for each rule.
    """
    def given(field: str) -> Column:
        return F.nullif(F.col(field).cast("string"), F.lit("")) if field in items.columns else F.lit(None).cast("string")

    found = [given(f) for f in ("name", "summary")]
    found += [F.when(F.col("slot").isin(*slots), given(f)) for slots, fields in ALSO_KNOWN_BY for f in fields]
    said = F.filter(F.array(*found), lambda x: x.isNotNull())
    texts = F.transform(F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(""))), _text)

    def key(fields: tuple[str, ...]) -> Column:
        parts = [F.nullif(squeezed(given(f)), F.lit("")) for f in fields]
        return F.when(reduce(lambda a, b: a & b, (p.isNotNull() for p in parts)), F.concat_ws("\x00", *parts))

    keys = F.array(*(F.when(F.col("slot") == slot, F.when(key(fields).isNotNull(), F.concat_ws("\x00", F.lit(str(k)), key(fields)))) for k, (slot, fields) in enumerate(SAME_BY)))
    kind = F.lower(stripped(F.coalesce(given("kind"), F.lit(""))))
    return items.withColumns({"plain": normalized(F.col("name")), "texts": texts, "keys": F.filter(keys, lambda x: x.isNotNull()), "type": kind})


def text_similarity(a: Column, b: Column) -> Column:
    """Equal texts count 1, of three characters and more that contain one another 0.95, others the Jaccard similarity of their bigrams."""
    p, g = a["plain"], b["plain"]
    inside = (F.length(p) >= 3) & (F.length(g) >= 3) & (F.contains(p, g) | F.contains(g, p))
    return F.when((p == g) & (p != ""), 1.0).when(inside, 0.95).otherwise(jaccard(a["grams"], b["grams"]))


def type_weight(a: Column, b: Column) -> Column:
    """1 for equal types and where one is not given, else what is known of the two, else a half."""
    known = F.create_map(*(F.lit(x) for (one, other), w in ALIKE.items() for x in (f"{one} {other}", w)))
    return F.when((a == b) | (a == "") | (b == ""), 1.0).otherwise(F.coalesce(known[F.concat_ws(" ", a, b)], F.lit(0.5)))


def candidate_pairs(predicted: DataFrame, labelled: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, slot, pred_no, gold_no, similarity of at least `least`, of predicted and labelled items of one document and slot.

    Items that have a key of the slot in common count 1, and in the slot apis others count 0. Else the best two of their
    texts count, weighted by their types.
    """
    p = prepared(predicted).select("doc_id", "slot", F.col("item_no").alias("pred_no"), F.col("texts").alias("p"), F.col("keys").alias("p_keys"), F.col("type").alias("p_type"))
    g = prepared(labelled).select("doc_id", "slot", F.col("item_no").alias("gold_no"), F.col("texts").alias("g"), F.col("keys").alias("g_keys"), F.col("type").alias("g_type"))
    best = F.array_max(F.flatten(F.transform("p", lambda a: F.transform("g", lambda b: text_similarity(a, b)))))
    similarity = F.when(F.arrays_overlap("p_keys", "g_keys"), 1.0).when(F.col("slot").isin(*ONLY_BY_KEY), 0.0).otherwise(best * type_weight(F.col("p_type"), F.col("g_type")))
    return p.join(g, ["doc_id", "slot"]).select("doc_id", "slot", "pred_no", "gold_no", similarity.alias("similarity")).where(F.col("similarity") >= least)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _taken(predicted: pd.Series, labelled: pd.Series) -> pd.Series:
    """Of pairs in order, whether both ends are free when their turn comes."""
    out = []
    for ps, gs in zip(predicted, labelled, strict=True):
        held, named, flags = set(), set(), []
        for p, g in zip(ps, gs, strict=True):
            free = p not in held and g not in named
            flags.append(free)
            if free:
                held.add(p), named.add(g)
        out.append(flags)
    return pd.Series(out)


def greedy_match(pairs: DataFrame) -> DataFrame:
    """The pairs taken in falling similarity (then by numbers) while both ends are free: one to one in a document and slot."""
    row = F.struct((-F.col("similarity")).alias("cost"), "pred_no", "gold_no")
    listed = pairs.groupBy("doc_id", "slot").agg(F.array_sort(F.collect_list(row)).alias("x"))
    taken = listed.select("doc_id", "slot", F.explode(F.arrays_zip("x", _taken(F.col("x.pred_no"), F.col("x.gold_no")).alias("free"))).alias("y")).where("y.free")
    return taken.select("doc_id", "slot", "y.x.pred_no", "y.x.gold_no", (-F.col("y.x.cost")).alias("similarity"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(0.0)


def scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 (four decimals; 0 without a denominator) to tp, fp and fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", _share(tp, tp + fp)).withColumn("recall", _share(tp, tp + fn)).withColumn("f1", _share(2 * tp, 2 * tp + fp + fn))


def slot_counts(predicted: DataFrame, labelled: DataFrame, matched: DataFrame) -> DataFrame:
    """doc_id, slot, tp, fp, fn: one aggregation over the three tables' keys."""
    def ones(frame: DataFrame, n_pred: int, n_gold: int, n_both: int) -> DataFrame:
        return frame.select("doc_id", "slot", F.lit(n_pred).alias("p"), F.lit(n_gold).alias("g"), F.lit(n_both).alias("m"))

    sums = ones(predicted, 1, 0, 0).union(ones(labelled, 0, 1, 0)).union(ones(matched, 0, 0, 1)).groupBy("doc_id", "slot").agg(F.sum("p").alias("p"), F.sum("g").alias("g"), F.sum("m").alias("tp"))
    return sums.select("doc_id", "slot", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))


def overall(counts: DataFrame) -> DataFrame:
    """Micro scores for each slot and for all (slot NULL)."""
    return scores(counts.groupingSets([["slot"], []], "slot").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def field_completeness(matched: DataFrame, predicted: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, slot, filled, expected, completeness: the labelled fields of matched items that the prediction fills too."""
    def given(prefix: str) -> dict:
        return {f: F.coalesce(F.trim(F.col(f"{prefix}.{f}")) != "", F.lit(False)) for f in FIELDS}

    p, g = given("p"), given("g")
    joined = matched.alias("m").join(predicted.alias("p"), F.expr("m.doc_id = p.doc_id AND m.slot = p.slot AND m.pred_no = p.item_no")).join(labelled.alias("g"), F.expr("m.doc_id = g.doc_id AND m.slot = g.slot AND m.gold_no = g.item_no"))
    filled = sum((p[f] & g[f]).cast("long") for f in FIELDS)
    expected = sum(g[f].cast("long") for f in FIELDS)
    sums = joined.groupBy(F.col("m.doc_id").alias("doc_id"), F.col("m.slot").alias("slot")).agg(F.sum(filled).alias("filled"), F.sum(expected).alias("expected"))
    return sums.withColumn("completeness", _share(F.col("filled"), F.col("expected")))


def evidence_share(predicted: DataFrame) -> DataFrame:
    """doc_id, slot, coverage: the share of predictions with evidence."""
    return predicted.groupBy("doc_id", "slot").agg(F.round(F.count_if(F.col("n_evidence") > 0) / F.count("*"), 4).alias("coverage"))


def _label(items: DataFrame) -> Column:
    """What an item is shown by: its name, else what else it says first, else itself as JSON, cut to 80 characters."""
    said = [F.nullif(F.col(f).cast("string"), F.lit("")) for f in ("name", "summary", "path", "action", "description") if f in items.columns]
    return F.coalesce(*said, F.substring(F.to_json(F.struct(*items.columns)), 1, 80))


def unmatched_examples(predicted: DataFrame, labelled: DataFrame, matched: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, slot, side, item_no, label: the first five items of each side whose name no match holds (a report's limit)."""
    def side(items: DataFrame, number: str, name: str) -> DataFrame:
        held = matched.select("doc_id", "slot", F.col(number).alias("item_no")).join(items.select("doc_id", "slot", "item_no", "name"), ["doc_id", "slot", "item_no"]).select("doc_id", "slot", "name")
        free = items.join(held, ["doc_id", "slot", "name"], "left_anti")
        n = F.row_number().over(Window.partitionBy("doc_id", "slot").orderBy("item_no"))
        return free.withColumn("n", n).where(F.col("n") <= most).select("doc_id", "slot", F.lit(name).alias("side"), "item_no", _label(items).alias("label"))

    return side(predicted, "pred_no", "false_positive").union(side(labelled, "gold_no", "false_negative"))


def eval_slots(predicted: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, slot: the slots that either side has."""
    return predicted.select("doc_id", "slot").union(labelled.select("doc_id", "slot")).distinct()


def slot_metrics(counts: DataFrame, completeness: DataFrame, coverage: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """The scores, field counts and coverage of every document and slot; an ignored slot counts 0, 0, 0 and is flagged."""
    flag = F.col("slot").isin(*ignored) if ignored else F.lit(False)
    rows = counts.withColumns({"ignored": flag, "pred_count": F.col("tp") + F.col("fp")}).withColumns({c: F.when(F.col("ignored"), 0).otherwise(F.col(c)).cast("long") for c in ("tp", "fp", "fn")})
    rows = rows.join(completeness.select("doc_id", "slot", "filled", "expected"), ["doc_id", "slot"], "left").join(coverage, ["doc_id", "slot"], "left")
    zero = {c: F.when(F.col("ignored"), 0).otherwise(F.coalesce(c, F.lit(0))) for c in ("filled", "expected")}
    return scores(rows.withColumns(zero)).withColumn("coverage", F.when(F.col("ignored"), 0.0).otherwise(F.coalesce("coverage", F.lit(0.0))))


def document_metrics(slots: DataFrame) -> DataFrame:
    """doc_id, the sums and scores of its slots, completeness, and the mean coverage of slots with predictions."""
    sums = slots.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "filled", "expected")), F.coalesce(F.round(F.avg(F.when(F.col("pred_count") > 0, F.col("coverage"))), 4), F.lit(0.0)).alias("coverage"))
    return scores(sums).withColumn("completeness", _share(F.col("filled"), F.col("expected")))


def run_metrics(documents: DataFrame) -> DataFrame:
    """One row for each model of a run: micro scores, and the means of completeness, coverage, elapsed seconds and valid JSON.

    documents has model, status, json_valid, elapsed and the metrics of a document. Means are over documents whose status
    is ok, the share of valid JSON over all; without any they are 0.
    """
    ok = F.col("status") == "ok"

    def mean(column: Column, digits: int) -> Column:
        return F.coalesce(F.round(F.avg(F.when(ok, column)), digits), F.lit(0.0))

    sums = documents.groupBy("model").agg(*(F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")), mean(F.col("completeness"), 4).alias("completeness"), mean(F.col("coverage"), 4).alias("coverage"), mean(F.col("elapsed"), 3).alias("elapsed"), F.round(F.avg(F.coalesce(F.col("json_valid"), F.lit(False)).cast("int")), 4).alias("json_valid_rate"))
    return scores(sums)


def compare_models(runs: DataFrame) -> DataFrame:
    """The rows of run_metrics with place: by f1, completeness, coverage and valid JSON, falling, then elapsed seconds, rising.

    There is a row for each model, so one task orders them.
    """
    order = Window.orderBy(F.desc("f1"), F.desc("completeness"), F.desc("coverage"), F.desc("json_valid_rate"), "elapsed", "model")
    return runs.withColumn("place", F.row_number().over(order).cast("long"))


def report(runs: DataFrame, documents: DataFrame, slots: DataFrame, examples: DataFrame) -> dict[str, DataFrame]:
    """The sections of an evaluation report for files.write_report: overall, documents, slots (with a note) and samples.

    Samples have a line for each document, slot and side with what was not matched; ignored slots have only their count.
    """
    noted = slots.withColumn("note", F.when(F.col("ignored"), "ignored").otherwise(""))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "label"))), lambda x: x["label"]), "；")
    kept = examples.join(slots.where(~F.col("ignored")).select("doc_id", "slot"), ["doc_id", "slot"], "left_semi").groupBy("doc_id", "slot", "side").agg(rows.alias("labels"))
    skipped = slots.where("ignored").select("doc_id", "slot", F.lit("ignored").alias("side"), F.concat(F.col("pred_count").cast("string"), F.lit(" predictions")).alias("labels"))
    return {"overall": runs, "documents": documents, "slots": noted, "samples": kept.unionByName(skipped)}
