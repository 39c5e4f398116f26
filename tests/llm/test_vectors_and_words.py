"""Whitening, spelling variants and cap filters against brute force, with the edge cases of each."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import caps, charpoly, variants, whitening

VECTORS = "vec_id long, embedding array<float>"


def whole(vector) -> bool:
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector)


# Whitening


def test_polynomial_is_exact():
    rng = np.random.default_rng(3)
    half = rng.integers(-50, 50, (6, 6)).astype(object)
    matrix = half @ half.T
    primes = charpoly.primes_for(charpoly.coefficient_bits(int(np.trace(matrix)), 6))
    poly = charpoly.combined(charpoly.residues(matrix, primes).tolist(), primes)
    # Leverrier's recursion in exact integers.
    want, power = [1], np.zeros((6, 6), object)
    for k in range(1, 7):
        power = matrix @ (power + np.eye(6, dtype=int).astype(object) * want[-1])
        want.append(-int(np.trace(power)) // k)
    assert poly == want


def test_polynomial_needs_pivots_and_handles_zero_columns():
    matrix = np.array([[2, 0, 1, 0], [0, 3, 0, 0], [1, 0, 2, 0], [0, 0, 0, 0]], object)
    primes = charpoly.primes_for(charpoly.coefficient_bits(7, 4))
    poly = charpoly.combined(charpoly.residues(matrix, primes).tolist(), primes)
    assert poly == [1, -7, 15, -9, 0]  # x (x - 3)^2 (x - 1)
    found = charpoly.roots(poly, 7, 4)
    assert [m for _, _, m in found] == [2, 1, 1]
    assert [round(r / 2**s, 12) for r, s, _ in found] == [3, 1, 0]
    double = charpoly.eigenvectors(matrix, *found[0])
    assert np.allclose(double @ double.T, np.eye(2), atol=1e-15) and np.allclose(double @ matrix.astype(float), 3 * double, atol=1e-14)


def checked_whitening(frame, components=32):
    rows = [(r["vec_id"], r["embedding"]) for r in frame.select("vec_id", "embedding").collect() if whole(r["embedding"])]
    got = whitening.whitened(frame, components=components).collect()
    if not rows:
        assert got == []
        return got
    common = Counter(len(v) for _, v in rows)
    size = max(common, key=lambda s: (common[s], s))
    rows = [(i, v) for i, v in rows if len(v) == size]
    n, want = len(rows), min(components, size)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(col) for col in zip(*x)]
    centred = [[n * a - s for a, s in zip(row, sums)] for row in x]
    deviation = Counter((i, sum(a * a for a in row)) for (i, _), row in zip(rows, centred))
    assert len(got) == n * want
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == deviation
    assert {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, want + 1))
    y = np.array(centred, float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:want], vectors[:, ::-1][:, :want]
    for r in got:
        e = values[r["component"] - 1]
        if values.max() > 0:
            assert r["explained"] == pytest.approx(e / np.trace(y.T @ y / n), rel=1e-9, abs=1e-12)
            assert r["identity_error"] <= 1e-4
    apart = all(abs(a - b) > 1e-6 * values[0] for a, b in zip(values, values[1:]))
    if apart and values[-1] > 1e-9 * values[0]:
        projected = y @ vectors / np.sqrt(values)
        own = defaultdict(list)
        for r in got:
            own[r["component"]].append((r["deviation"], r["whitened"]))
        for k in range(want):
            expected = sorted(zip((sum(a * a for a in row) for row in centred), projected[:, k]))
            mine = sorted(own[k + 1])
            assert np.allclose(np.abs([w for _, w in mine]), np.abs([w for _, w in expected]), atol=1e-8) or Counter(d for d, _ in mine).most_common(1)[0][1] > 1
            products = [a[1] * b[1] for a, b in zip(mine, expected) if abs(b[1]) > 1e-6]
            assert len({p > 0 for p in products}) <= 1 or Counter(d for d, _ in mine).most_common(1)[0][1] > 1
    return got


def test_whitening_of_the_table(spark, sf_dir):
    checked_whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [])], [(1, [1.0, 2.0])], [(1, [0.5, 2.0])] * 3, [(1, [1.0, 2.0, 0.0]), (None, [3.0, 1.0, 0.0]), (3, [0.25, 1.0, 7.0]), (3, None), (4, [float("nan"), 1.0, 1.0]), (5, [1.0, None, 1.0]), (6, [1.0]), (7, [float("inf"), 0.0, 0.0])]], ids=["empty", "unusable", "one", "equal", "mixed"])
def test_whitening_edges(spark, rows):
    frame = spark.createDataFrame(rows, VECTORS).withColumn("n", F.lit("clash")).withColumn("component", F.lit(1))
    checked_whitening(frame)


def test_whitening_of_equal_eigenvalues_and_rank_loss(spark):
    frame = spark.createDataFrame([(k, [float(k % 2), float(k // 2 % 2), float(k // 4 % 2), 1.0]) for k in range(8)], VECTORS)
    got = checked_whitening(frame)
    assert all((r["whitened"] is None) == (r["component"] == 4) for r in got)
    columns = np.array([[r["whitened"] for r in sorted(got, key=lambda r: r["vec_id"]) if r["component"] == k] for k in (1, 2, 3)])
    assert np.allclose(columns @ columns.T / 8, np.eye(3), atol=1e-12)


def test_whitening_of_large_entries_is_exact(spark):
    frame = spark.createDataFrame([(k, [1e6 * k * k, 3.0 + k, -2e9 * (k % 3)]) for k in range(20)], "vec_id long, embedding array<double>")
    got = whitening.whitened(frame).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    x = [[math.floor(64 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    exact = {i: sum((20 * a - s) ** 2 for a, s in zip(row, sums)) for (i, _), row in zip(rows, x)}
    for r in got:
        value = exact[r["vec_id"]]
        assert (r["deviation"], r["deviation_exact"]) == ((value, None) if value < 2**63 else (None, str(value)))


# Spelling variants


def brute_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def checked_variants(frame):
    want = brute_variants([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
    assert sorted(map(tuple, variants.variants(frame).collect()), key=lambda r: r[0]) == want
    return want


def test_variants_of_edited_words(spark):
    rng = np.random.default_rng(11)
    letters = list("abcdeéàÿstn")
    texts = []
    for k in range(120):
        stem = "".join(rng.choice(letters, rng.integers(4, 8)))
        for _ in range(int(rng.integers(1, 6))):
            at, kind = int(rng.integers(0, len(stem))), int(rng.integers(0, 3))
            word = (stem[:at] + stem[at + 1 :], stem[:at] + rng.choice(letters) + stem[at + 1 :], stem[:at] + rng.choice(letters) + stem[at:])[kind]
            texts += [(k, " ".join([word] * int(rng.integers(2, 9))))]
        texts += [(k, (stem.upper() + ", ") * int(rng.integers(3, 30)))]
    texts += [(1000 + k, "gabecd") for k in range(40)] + [(2000 + k, "gabecdt") for k in range(12)] + [(3000 + k, "gabecdts") for k in range(4)]
    want = checked_variants(spark.createDataFrame([(int(i), str(t)) for i, t in texts], "doc_id long, text string"))
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)


def test_variants_edges(spark):
    rows = [(None, "Häuser häuser hÄuser Häuserx " * 3), (1, None), (2, ""), (3, "vowel,vowels/vowel;vowels\tvowels\x00vowel ×÷× naïve-naive naïve naive naive naïve naive " * 2), (3, "vowel"), (4, "1234 ßßßßßß éééééé " * 4), (5, "a" * 70_000 + " " + "ab" * 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    checked_variants(frame)
    assert variants.variants(frame.where("doc_id = 2")).collect() == []
    assert variants.variants(frame.where("false")).collect() == []


def test_variants_of_the_table(spark, sf_dir):
    got = sorted(map(tuple, variants.variants(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()), key=lambda r: r[0])
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == brute_variants([(r["doc_id"], r["text"]) for r in rows])


def test_hot_subtrie_is_cut_and_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 7)
    monkeypatch.setattr(variants, "VISITS", 11)
    words = sorted({"".join(p) for p in np.random.default_rng(2).permuted(np.tile(list("abcde"), (60, 1)), axis=1)} | {"abcdef", "abcd"})
    pairs = {(r["a"], r["b"]) for r in variants.near_words(spark.createDataFrame([(w, 3) for w in words + ["abcee", "bbcde"]], "word string, n long")).collect()}
    everything = words + ["abcee", "bbcde"]
    assert pairs == {(a, b) for a in everything for b in everything if variants.one_edit(a, b) and (len(a) < len(b) or a < b)}


# Cap filters


def brute_links(rows, cosine=0.9):
    """n_links and component_id by row number."""
    linked = [k for k, (_, v) in enumerate(rows) if whole(v) and any(v)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    units = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in linked}
    for a in linked:
        for b in linked:
            if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine:
                links[a], links[b] = links[a] + 1, links[b] + 1
                parent[top(a)] = top(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[top(k)].append(i)
    smallest = {t: min((i for i in ids if i is not None), default=None) for t, ids in least.items()}
    return Counter((i, links[k], smallest[top(k)], i == smallest[top(k)]) for k, (i, _) in enumerate(rows))


def test_caps_edges(spark):
    rows = [(1, [1.0, 2.0]), (None, [2.0, 4.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [1.0, 2.0, 0.0]), (7, [1.0]), (8, [2.0]), (9, [-1.0]), (10, [1.0, None]), (11, [1e-30, 2e-30]), (12, [float("inf"), 1.0]), (None, None), (13, [-0.0, 3.0]), (14, [0.0, 3.0])]
    frame = spark.createDataFrame(rows, VECTORS).withColumn("key", F.lit("clash")).withColumn("n", F.lit(0))
    assert Counter(map(tuple, caps.near_duplicates(frame).collect())) == brute_links(rows)
    assert caps.near_duplicates(frame.where("false")).collect() == []


def clusters(seed=5, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((25, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    noise = rng.standard_normal((25, 24, 32))
    noise /= np.linalg.norm(noise, axis=2)[:, :, None]
    found = (centres[:, None] + noise * rng.uniform(0.02, spread, (25, 24, 1))).reshape(-1, 32)
    found[40:60] = found[40]
    return [(int(k), [float(np.float32(x)) for x in v]) for k, v in enumerate(found)]


def test_caps_find_what_brute_force_finds_and_nothing_else(spark):
    rows = clusters()
    got = sorted(map(tuple, caps.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()))
    want = sorted(brute_links(rows))
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)


def test_caps_balls_in_blocks_count_whole(spark, monkeypatch):
    monkeypatch.setattr(caps, "MEMBERS", 5)
    rows = clusters(9, 0.12)
    assert Counter(map(tuple, caps.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())) == brute_links(rows)


def test_filters_are_those_above_the_bound():
    code = caps.Code(12, 300, 0.9, 8.0, 1.0)
    unit = np.random.default_rng(1).standard_normal((40, 12))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    row, number = code.passed(unit)
    want = set()
    for k, blocks in enumerate(code.codes):
        first, second, third = (unit @ b for b in blocks)
        total = first[:, :, None, None] + second[:, None, :, None] + third[:, None, None, :]
        for r, a, b, c in np.argwhere(total >= code.bound):
            want.add((int(r), int(((a * code.words + b) * code.words + c) + k * code.words**3)))
    assert set(zip(row.tolist(), number.tolist())) == want and len(row) == len(want)
