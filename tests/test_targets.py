"""Spans find their elements the same way whether a document has few of them or many."""

from quire.operators import objects


def _plain(text):
    return " ".join((text or "").lower().split())


def test_few_and_many_spans_find_the_same(spark):
    words = ["alpha", "beta", "gamma delta", "x", "epsilon zeta eta theta", "Q 1"]
    texts = [f"{words[k % 6]}  {k} {words[(k * 5 + 1) % 6].upper()} end" for k in range(40)]
    spans = [f"{words[k % 6]} {k}" for k in range(30)] + ["q", "", None, "ETA  theta", "nowhere", "zeta eta theta 10 q", "7", "z"] * 5
    elements = [(d, k, f"el-{k}", t) for d in (1, 2) for k, t in enumerate(texts)] + [(3, 0, "el-0", "alone")]
    asked = [(d, f"O-{k}", f"gone-{k}", s) for d, some in ((1, spans), (2, spans[:60])) for k, s in enumerate(some)] + [(2, "O-0", "gone-0", spans[0]), (3, "O-0", "el-0", "x"), (4, "O-0", "e", "x")]
    assert len([s for s in spans if s]) <= objects.FEW
    want = {(d, o): e if (d, e) == (3, "el-0") else next((f"el-{k}" for x, k, f, t in elements if x == d and s and _plain(s) in _plain(t)), None) for d, o, e, s in asked}
    evidence, table = spark.createDataFrame(asked, "doc_id long, object_id string, element_id string, text_span string"), spark.createDataFrame(elements, "doc_id long, ord long, element_id string, text string")
    few, limit = objects.resolve_targets(evidence, table), objects.FEW
    try:
        objects.FEW = 0
        many = objects.resolve_targets(evidence, table)
    finally:
        objects.FEW = limit
    for found in (few, many):
        rows = found.collect()
        assert len(rows) == len(asked) and {(r.doc_id, r.object_id): r.target for r in rows} == want


def test_elements_of_documents_with_few_spans_go_to_no_python(spark):
    rows = spark.createDataFrame([(1, "O", "gone", "a")], "doc_id long, object_id string, element_id string, text_span string")
    plan = objects.resolve_targets(rows, spark.createDataFrame([(1, 0, "el", "a b")], "doc_id long, ord long, element_id string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2
