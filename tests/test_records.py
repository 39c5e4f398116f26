"""Records, names and chunks on hostile values, against plain folds."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import chunks, evaluation, inference, merging, objects

ITEM = "struct<id string, name string, kind_type string, text string, n int, tags array<string>, detail struct<unit string, notes array<struct<k string, v string>>>, evidence_element_ids array<string>>"


def clean(x):
    if isinstance(x, str):
        return x.strip() or None
    if isinstance(x, dict):
        return {k: v for k, v in ((k, clean(v)) for k, v in x.items()) if v is not None} or None
    if isinstance(x, list):
        return [v for v in map(clean, x) if v is not None] or None
    return x


def fold(a, b):
    """b merged into a, both cleaned."""
    out = dict(a)
    for k, v in b.items():
        if k not in out:
            out[k] = v
        elif isinstance(v, dict):
            out[k] = fold(out[k], v)
        elif isinstance(v, list):
            both = out[k] + v
            out[k] = [x for i, x in enumerate(both) if x not in both[:i]]
        elif isinstance(v, str) and len(v) > len(out[k]):
            out[k] = v
    return out


def key(slot, x):
    said = lambda v: " ".join(str(v or "").split()).lower()
    if said(x.get("name")):
        return f"entity::::{said(x['name'])}" if slot == "entities" else f"{slot}::{said(x.get('kind_type')) or 'name'}::{said(x['name'])}"
    return f"id::{said(x['id'])}" if said(x.get("id")) else "raw::" + json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def random_items(seed, n):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", " ", "　", "a", "a  ", "bb", "bb　b", "ab" + " " * 10, "short", "A"])
    note = lambda: rng.choice([None, {"k": text(), "v": text()}])
    return [{"id": rng.choice([None, "X-1", " x-1 "]), "name": rng.choice([None, "登录　页", "登录 页", " Login", "login ", " ", ""]), "kind_type": rng.choice([None, " ", "T", "t"]), "text": text(), "n": rng.choice([None, 0, 1, 2]), "tags": rng.choice([None, [], [text() for _ in range(3)]]), "detail": rng.choice([None, {"unit": text(), "notes": rng.choice([None, [note() for _ in range(3)]])}]), "evidence_element_ids": rng.choice([None, ["el-1"], ["el-2", "el-1"]])} for _ in range(n)]


def as_row(x):
    return None if x is None else tuple(as_row(v) if isinstance(v, dict) else [as_row(y) if isinstance(y, dict) else y for y in v] if isinstance(v, list) else v for v in x.values())


@pytest.mark.parametrize("width", [2, 1000])
def test_records_merge_as_a_fold_does(spark, width):
    rows = [(d, s, k, x) for d in (1, None) for s in ("modules", "entities") for k, x in enumerate(random_items(width + len(s), 120))]
    frame = spark.createDataFrame([(d, s, k, as_row(x)) for d, s, k, x in rows], f"doc_id long, slot string, seq long, item {ITEM}")
    kind = frame.schema["item"].dataType
    cleaned = frame.withColumn("item", merging.cleaned(F.col("item"), kind)).where(merging.says_something(F.col("item"), kind))
    keyed = objects.object_identity(cleaned)
    want, places = {}, {}
    for d, s, k, x in rows:
        x = clean(x)
        if not x or not set(x) - set(merging.BESIDES):
            continue
        at = (d, s, key(s, x))
        want[at] = fold(want[at], x) if at in want else x
        places.setdefault(at, []).append(k)
    got = merging.merge_records(keyed.withColumn("range", F.lit("clash")), ("doc_id", "slot", "object_key"), width=width).collect()
    assert {(r["doc_id"], r["slot"], r["object_key"]): clean(r["item"].asDict(True)) for r in got} == want
    assert {(r["doc_id"], r["slot"], r["object_key"]): (r["first_seq"], r["candidates"]) for r in got} == {k: (min(v), len(v)) for k, v in places.items()}


def test_no_records(spark):
    frame = spark.createDataFrame([], f"doc_id long, slot string, seq long, item {ITEM}")
    assert merging.merge_records(objects.object_identity(frame), ("doc_id", "slot", "object_key")).collect() == []


def test_flat_candidates(spark):
    rows = [(1, "apis", 1, None, None, "one"), (1, "apis", 2, " ", None, "two"), (1, "apis", 3, None, None, "one"), (1, "apis", 4, "登录　页", "T", "ab" + " " * 10), (1, "apis", 5, "登录 页", "t", "short"), (1, "apis", 6, "登录 页", "T", "other")]
    keyed = objects.object_identity(spark.createDataFrame(rows, "doc_id long, slot string, seq long, name string, item_type string, description string"))
    merged = {r["first_seq"]: (r["candidates"], r["description"]) for r in objects.merge_objects(keyed).collect()}
    assert merged == {1: (2, "one"), 2: (1, "two"), 4: (3, "short")}


@pytest.mark.parametrize("name,plain", [("用户注册（SRS-USER-001）", "用户注册"), ("登录 (api_3)", "登录"), ("Log　In (A-1)　", "login"), ("f(x) y", "f(x)y"), ("（A）", ""), ("a（b c）", "a(bc)"), ("x (A-1", "x(a-1"), (None, None)])
def test_names(spark, name, plain):
    assert spark.createDataFrame([(name,)], "n string").select(evaluation.normalized(F.col("n"))).first()[0] == plain


def chunked(spark, rows, limit):
    frame = spark.createDataFrame(rows, "doc_id long, ord long, element_id string, section string, group_no long, page int, text string")
    return chunks.chunk_numbers(chunks.section_units(chunks.render_markers(frame)), limit)


def test_a_chunk_ends_with_its_group(spark):
    rows = [(1, k, f"el-{k:04d}", f"s{k}", 1 if k < 2 else 2, None, "x") for k in range(4)]
    assert [r["chunk_no"] for r in chunked(spark, rows, 1000).orderBy("ord").collect()] == [1, 1, 2, 2]


@pytest.mark.parametrize("seed", range(3))
def test_chunks_fit_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = [(d, k, f"el-{k:04d}", f"s{k // rng.choice([1, 2, 5])}", k // 17, k // 9, "y" * rng.choice([1, 30, 80])) for d in range(12) for k in range(rng.choice([1, 5, 60]))]
    got = sorted((r["doc_id"], r["ord"], r["chunk_no"]) for r in chunked(spark, rows, 150).collect())
    want = []
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        units = []
        for r in own:
            size = len(f"[ELEMENT: {r[2]} page={r[5]}]\n{r[6]}")
            if not units or units[-1][0] != (r[3], r[4]):
                units.append(((r[3], r[4]), []))
            units[-1][1].append((r[1], size))
        number, held, group = 0, None, None
        for (_, g), parts in units:
            total = sum(s for _, s in parts)
            if total > 150:
                held = None
                for o, s in parts:
                    if held is None or held + s > 150:
                        number, held = number + 1, 0
                    held += s
                    want.append((d, o, number))
                held = None
            else:
                if held is None or g != group or held + total > 150:
                    number, held = number + 1, 0
                held += total
                want += [(d, o, number) for o, _ in parts]
            group = g
    assert got == sorted(want)


def test_summary_goes_by_order_and_not_by_text(spark):
    rows = [(1, k, f"el-{k:04d}", "s", 1, (5, None, 3)[k % 3], "x") for k in range(9998, 10002)]
    r = chunks.chunk_summary(chunked(spark, rows, 1000)).first()
    assert (r["first_element"], r["last_element"], r["page_start"], r["page_end"], r["element_ids"]) == ("el-9998", "el-10001", 3, 5, ["el-9998", "el-9999", "el-10000", "el-10001"])
    assert r["markdown"].startswith("[ELEMENT: el-9998 page=3]\nx\n\n[ELEMENT: el-9999 page=5]")


def test_a_long_document_packs_in_seconds(spark):
    frame = spark.range(60_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("ord"), F.format_string("el-%04d", "id").alias("element_id"), F.lit("s").alias("section"), F.lit(None).cast("int").alias("page"), F.lit("some text").alias("text"))
    rows = chunks.chunk_numbers(chunks.section_units(chunks.render_markers(frame)), 5000)
    assert rows.agg(F.count("*"), F.max("chunk_no")).first()[0] == 60_000
    assert chunks.overlap(rows, 300).groupBy("chunk_no").count().agg(F.max("count")).first()[0] <= 12


def test_unicode_blanks_around_prompts_and_values(spark):
    frame = spark.createDataFrame([(1, "　a　 b\t")], "doc_id long, text string")
    outline = spark.createDataFrame([], "doc_id long, sections array<string>, main_topics array<string>")
    assert inference.summary_inputs(frame, outline).first()["text"] == "a b"
    assert frame.select(inference.normalized_enum(F.lit("　HIGH "), inference.PRIORITIES, "low")).first()[0] == "high"
