"""Near-duplicates against brute force, and the pipeline's stages on edge cases."""

import random

from pyspark.sql import functions as F

from quire.llm import minhash

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_components(rows, percent, words=5):
    """component of each row number: the smallest doc_id reachable over links of full shingle sets."""
    sets = []
    for _, text in rows:
        w = (text or "").translate(LOWER).split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [least.get(root(i)) for i in range(len(rows))], [len(s) for s in sets]


def copies(seed, groups, size, most_edits):
    """Groups of near copies with 0 to most_edits changed words, some of them copies of copies, and loners that share a passage."""
    rng = random.Random(seed)
    fresh = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage = [fresh() for _ in range(60)]
    texts = []
    for _ in range(groups):
        made = [[fresh() for _ in range(rng.randint(60, 160))]]
        for _ in range(size):
            w = list(rng.choice(made[:6]))
            for _ in range(rng.randint(0, most_edits)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 2)] = [fresh()]
            made.append(w)
        texts += made
    texts += [[fresh() for _ in range(20)] + passage for _ in range(30)]
    texts += [["one", "two"], ["One", "TWO"], []]
    rng.shuffle(texts)
    return [(i * 3 % 1009, " ".join(w)) for i, w in enumerate(texts)] + [(None, " ".join(texts[0])), (5000, None), (5001, "  \t\n")]


def test_components_equal_brute_force(spark):
    for seed, percent in ((1, 85), (2, 80)):
        rows = copies(seed, 4, 60, 6)
        want, sizes = brute_components(rows, percent)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == sorted(((i, n, c, i is None or i == c) for (i, _), c, n in zip(rows, want, sizes, strict=True)), key=repr)


def test_open_pairs_leave_no_link_out(spark):
    """Members far from their centre but near one another: every pair that the bounds rule out is no link."""
    rows = copies(3, 1, 90, 8)
    docs = spark.createDataFrame([(i, t) for i, (d, t) in enumerate(rows) if d is not None and t and t.split()], "doc_id long, text string")
    signed = minhash.signatures(docs, 12)
    classes = signed.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    sets = minhash.sets_of(classes.join(docs, "doc_id").select(F.col("h1").alias("c"), F.col("n_shingles").alias("n"), "h2", "text")).cache()
    full = {r.c: set(r["items"]) for r in sets.collect()}
    centre = min(full)
    members = spark.createDataFrame([(centre, c, c) for c in full], "v long, u long, component long")
    pairs = {(r.u, r.v) for r in minhash._open_pairs(members, sets, 85).collect()}
    links = {(a, b) for a in full for b in full if a < b and 100 * len(full[a] & full[b]) >= 85 * len(full[a] | full[b])}
    assert links and links <= pairs and len(pairs) < len(full) * (len(full) - 1) / 2
