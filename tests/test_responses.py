"""Responses: repair of JSON cut at every place, and calls in bounded pools."""

from __future__ import annotations

import json
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import responses
from quire.operators.json_repair import closed, repaired

NESTED = '{"a\\"b": [1, -2.5e3, {"k": "x, y] } \\\\", "u": "\\u4e2d中", "e": {}, "l": []}, true, null], "c": {"d": {"e": [[["deep"]]]}} , "z": false}'


def longest_that_closes(text):
    """The longest prefix that closing brackets make JSON, found by trying each."""
    for end in range(len(text), 0, -1):
        if re.search(r"\d$", text[:end]) and re.match(r"[\d.eE]", text[end:]):
            continue  # inside a number
        prefix = text[:end]
        outside = re.sub(r'"(?:[^"\\]|\\.)*"', '""', prefix)
        if outside.replace('""', "").count('"'):
            continue
        opened = []
        for c in outside:
            if c in "{[":
                opened.append("}" if c == "{" else "]")
            elif c in "]}":
                opened.pop()
        whole = prefix + "".join(reversed(opened))
        try:
            if json.loads(whole) is not None and whole.lstrip()[0] in "{[":
                return json.loads(whole)
        except ValueError:
            continue
    return None


@pytest.mark.parametrize("text", [NESTED, json.dumps(json.loads(NESTED), indent=2), '[["a", "b\\\\"], "c,d", {"e": "f:g"}]', '{"key": "value with \\"quotes\\" and , [ { } ] : "}'])
def test_every_cut_keeps_all_whole_values(text):
    assert json.loads(repaired(text)) == json.loads(text)
    for k in range(1, len(text)):
        got = repaired(text[:k])
        want = longest_that_closes(text[:k])
        assert (None if got is None else json.loads(got)) == want, text[:k]


@pytest.mark.parametrize("text,want", [("{'a': 'it''s', 'b': None}", '{"a": "its", "b": null}'), ("['a']", None), ("", None), (None, None), ("no json", None), ('{"a": 1} tail', None), ('{"a" 1', None), ('{"a": tru', "{}"), ('{"a": 1, "b', '{"a": 1}'), ('{"a": 1, "b": -', '{"a": 1}'), ('[1, 2.', "[1]"), ('[1}', None), ('{"a": 01', None), ("[[[", "[[[]]]"), ("12", None), ('"cut', None), ('{"a": "\\', "{}"), ('{"a": "\\u12', "{}"), ('{"a": "\n"', None)])
def test_odd_texts(text, want):
    assert repaired(text) == want


def test_one_pass_over_long_texts():
    started = time.perf_counter()
    whole = closed('{"a": [' + ", ".join(f'{{"n": {k}, "s": "x,y"}}' for k in range(100_000)) + ', {"n": "cut')
    assert whole.endswith('"x,y"}, {}]}') and time.perf_counter() - started < 10


def test_outcomes_and_previews(spark):
    rows = [(1, '```json\n{"a": 1}\n```'), (2, '{"a": [1, "b'), (3, "x" * 300), (4, None), (5, ""), (6, "　[1]\n"), (7, "{'a': 1}")]
    frame = spark.createDataFrame(rows, "id int, response string").withColumn("parsed", F.lit("clash"))
    got = {r["id"]: (r["outcome"], r["parsed"], r["preview"]) for r in responses.parse_json(frame).collect()}
    assert got[1][:2] == ("parsed", '{"a": 1}') and got[2] == ("repaired", '{"a": [1]}', None) and got[3] == ("failed", None, "x" * 200 + "...") and got[4] == got[5] == ("failed", None, "") and got[6][:2] == ("parsed", "[1]") and got[7][:2] == ("repaired", '{"a": 1}')


def test_pool_keeps_order_and_its_bound():
    running, most, lock = 0, 0, threading.Lock()

    def call(request):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.002 * (int(request) % 3))
        with lock:
            running -= 1
        return request * 2

    pool = responses._Pool(call, 3, None, 0, 0.0)
    assert pool.answers([str(k) for k in range(20)]) == [(str(k) * 2, None) for k in range(20)] and most <= 3
    pool.close()


def test_pool_retries_and_gives_up_in_time():
    tries = {}

    def call(request):
        tries[request] = tries.get(request, 0) + 1
        if request == "slow":
            time.sleep(2)
        if request == "never" or (request == "second" and tries[request] < 2):
            raise ValueError("no")
        return request

    pool = responses._Pool(call, 2, 0.5, 1, 0.01)
    assert pool.answers(["second", "never", "slow", "fine", None, "fine"]) == [("second", None), (None, "ValueError: no"), (None, "no answer in 0.5 s"), ("fine", None), (None, "no request"), ("fine", None)]
    assert tries["second"] == tries["never"] == 2
    pool.close()


def test_failing_chunks_are_rows_with_their_summary(spark):
    def call(request):
        if request == "bad":
            raise KeyError("x")
        return request.upper()

    rows = [(k, "bad" if k % 3 == 0 else None if k % 3 == 1 else f"r{k}", f"chunk-{k}") for k in range(30)]
    got = {r["id"]: (r["response"], r["error"]) for r in responses.batch_infer(spark.createDataFrame(rows, "id int, request string, summary string"), call, 3, pool=2).collect()}
    assert got == {k: (None, f"chunk failed: {s}: KeyError: 'x'") if r == "bad" else (None, f"chunk failed: {s}: no request") if r is None else (r.upper(), None) for k, r, s in rows}
    assert responses.batch_infer(spark.createDataFrame([], "id int, request string"), call, 2).collect() == []


def test_depth_beyond_the_parser_is_no_crash():
    assert repaired("[" * 300_000) is None
