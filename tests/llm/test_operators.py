"""The corpus operators against brute force, on rows with every defined edge case."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import byte_bpe, components, fingerprints, hamming, lattice, minhash, packing, quality, suffix_dedup, surrogates, token_shards
from quire.llm.common import held_out
from quire.llm.queries import BYTE_RANKS, END_ID, PIECES, WORD_BPE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def by_id(frame, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in frame.collect()), key=repr)


def word_ids(text):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_shards(docs, none, rows):
    want = sorted(((r[0], len(word_ids(r[1])), crc(word_ids(r[1]))) for r in rows), key=repr)
    assert by_id(token_shards.token_shards(docs, WORD_BPE, END_ID), "n_tokens", "ids_crc32") == want
    assert token_shards.token_shards(none, WORD_BPE, END_ID).count() == 0


def test_quality(spark, docs, none, rows):
    labels = spark.createDataFrame([(4, 0), (5, 1), (6, 1), (8, 0)], "doc_id long, quality int")
    out = quality.scored(docs, labels, held_out(F.col("doc_id"), 4, 2)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert quality.scored(none, labels, held_out(F.col("doc_id"), 4, 2)).count() == 0
    assert set(quality.kept(docs, labels, held_out(F.col("doc_id"), 4, 2)).columns) == set(docs.columns)


def test_pairs_rank_a_separable_set():
    x = np.random.default_rng(1).normal(size=(200, 5))
    w = quality.fit_pairs(x[x[:, 0] > 0], x[x[:, 0] <= 0])
    assert ((x @ w)[x[:, 0] > 0].min()) > ((x @ w)[x[:, 0] < -0.2].max())


def test_repeated_passages(docs, none, rows):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[s : s + 200] for _, b in data for s in range(len(b) - 199))
    want = []
    for i, b in data:
        cover = bytearray(len(b))
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                cover[s : s + 200] = b"\1" * 200
        spans = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        want.append((i, len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest()))
    assert by_id(suffix_dedup.removed(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert suffix_dedup.removed(none).count() == 0


def test_first_copy_stays(docs):
    out = suffix_dedup.without_later_copies(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = [r.text or "" for r in out.collect()]
    assert sum("word7 of the shared passage" in t for t in texts) == 1


def test_the_smallest_id_keeps_the_passage(spark):
    one, two, three = (" ".join(f"{k}{i} words of a passage" for i in range(20)) for k in "xyz")
    rows = [(None, one), (9, "tail " + one), (5, one), (5, one), (2, "head " + one), (8, two), (8, two), (None, three), (None, three), (None, three)] + [(100 + i, f"row {i}") for i in range(50)]
    out = suffix_dedup.without_later_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    found = {}
    for r in out:
        found.setdefault(r.doc_id, []).append(r.text)
    assert found[2] == ["head " + one] and found[5] == ["", ""] and found[9] == ["tail"]
    assert sorted(found[8]) == ["", two] and sorted(found[None]) == ["", "", "", three] and len(out) == len(rows)


def test_fingerprints(docs, none, rows):
    out = fingerprints.edited_pairs(docs).collect()
    assert len(out) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    order = [r for r in sorted(((r[0], r[1] or "") for r in rows if r[0] is not None), reverse=True)]
    got = {(r.doc_id, r.edited_sha256) for r in out}
    for (i, t), (_, after) in zip(order, order[1:], strict=False):
        half = len(t) // 2
        assert (i, hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()) in got
    assert fingerprints.edited_pairs(none).count() == 0


def test_collision_rate_is_jaccard(spark):
    a, b = "x " * 6 + "y " * 3 + "z u v w", "x " * 3 + "y " * 3 + "z u q r"
    found = fingerprints.signatures(spark.createDataFrame([(1, a), (2, b)], "k int, t string"), ["k"], "t", 200).orderBy("k").collect()
    rate = np.mean(np.array(found[0].sig) == np.array(found[1].sig))
    assert abs(rate - 8 / 15) < 0.12


def test_packing(docs, none, rows):
    out = packing.packed(docs, WORD_BPE, END_ID).toPandas()
    want = Counter(crc(word_ids(r[1])) for r in rows if len(word_ids(r[1])) <= 4096)
    assert Counter(out[out.doc_tokens <= 4096].ids_crc32) == want
    assert out.length.sum() == sum(len(word_ids(r[1])) for r in rows)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert packing.packed(none, WORD_BPE, END_ID).count() == 0


def test_patterns_cover_demand():
    demand = {3: 50, 5: 41, 9: 20, 16: 7}
    got = Counter()
    for held, copies in packing.patterns_for(demand, 16):
        assert sum(s * n for s, n in held.items()) <= 16
        for s, n in held.items():
            got[s] += n * copies
    assert all(got[s] >= n for s, n in demand.items())


def test_byte_bpe(docs, none, rows):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((r[0], hashlib.sha256(",".join(map(str, enc.encode_ordinary(r[1] or ""))).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows), key=repr)
    assert by_id(byte_bpe.round_trip(docs, BYTE_RANKS, P.PATTERN), "ids_sha256", "decoded_sha256") == want
    assert byte_bpe.round_trip(none, BYTE_RANKS, P.PATTERN).count() == 0


def test_surrogates(docs, none):
    out = {r.doc_id: r for r in surrogates.replaced(docs).collect() if r.doc_id}
    nine, ten = out[9].text, out[10].text
    for private in ("Ana.Lee", "555-7713", "4637089055456426", "97.51.17.173", "Anna Berg", "04dbebab"):
        assert private not in nine and private.lower() not in ten
    assert set(out[9].entity_types) == {"email", "phone", "card", "ip", "name", "token"}
    mail, card = re.search(r"\S+@\S+", nine).group(), re.search(r"\d{16}", nine).group()
    assert mail in ten and card in ten and "Frau " in nine and out[1].text is None and out[4].text == "one two"
    assert surrogates.replaced(none).count() == 0


def test_numbers_stay_distinct(spark):
    cards = spark.range(3000).select(F.lpad(F.col("id").cast("string"), 16, "1").alias("e"))
    assert cards.select(surrogates.surrogate(F.col("e"), "k")).distinct().count() == cards.distinct().count()


def test_each_type_is_found_alone(spark):
    """Each entity in a text of its own, in the groupings that its pattern takes."""
    alone = {
        "email": ["a@b.c", "Ana.Lee+x@mail.example.com"],
        "token": ["0123456789abcdef" * 2, "abcdefab" * 4, "ABCDEFAB" * 16, "1" * 32, "0123456789abcdef" * 20],
        "ip": ["1.2.3.4", "255.249.199.10"],
        "phone": [f"+{c}{x}{a}{y}{m}{z}{e}" for c in ("1", "33", "420") for x in ("", " ", ".", "-") for a in ("61", "612", "(61)", "(6123)") for y in ("", " ", ".", "-") for m in ("345",) for z in ("", " ", ".", "-") for e in ("678", "6789")] + ["(888) 555-6841", "(888)555-6841", "555-123-4567", "555.123.4567"],
        "card": [sep.join(("1234567890123456789"[:n])[i : i + k] for i in range(0, n, k)) for n in range(13, 20) for k in (1, 2, 3, 4, 5, 19) for sep in (" ", "-")],
        "ssn": ["123-45-6789"],
        "iban": ["GB29NWBKABCDEFGHIJKLMN", "GB29 NWBK ABCD EFGH", "GB29 NWBK ABCD EFGH IJKL MNOP QRST UVWX YZA", "DE89 ABCD 0440 ABCD 0130 AB"],
        "name": [f"{t}{dot} {n}" for t in surrogates.TITLES.split("|") for dot in ("", ".") for n in ("Lee", "Ana Lee", "Ольга")],
    }
    rows = [(kind, e) for kind, found in alone.items() for e in found]
    table = spark.createDataFrame(rows, "kind string, text string").select("kind", "text", surrogates.entities(F.concat(F.lit("so "), "text", F.lit(", so"))).alias("found"), surrogates.type_of(F.col("text")).alias("type"))
    out = table.collect()
    assert [(r.kind, r.text) for r in out if r.found != [r.text]] == []
    assert [(r.kind, r.text, r.type) for r in out if r.type != r.kind] == []


def test_names_keep_title_gender_script_and_person(spark):
    """One person with and without a given name, under every title; two persons never become one."""
    people = [f"{t} {n}" for t in surrogates.TITLES.split("|") for n in ("Berg", "Adam Berg", "Anna Berg", "Vera Lee", "Иван Петров", "Анна Петров")]
    rows = [(i, f"with {p}, so") for i, p in enumerate(people)] + [(1000, "Mrs Berg and Mr Berg")]
    out = {r.doc_id: r.text for r in surrogates.replaced(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    parts = {}
    for i, p in enumerate(people):
        old, new = p.split(" "), re.fullmatch("with (.*), so", out[i]).group(1).split(" ")
        assert old[0] == new[0] and len(old) == len(new) and not set(old[1:]) & set(new[1:])
        assert all(bool(re.search("[а-я]", a)) == bool(re.search("[а-я]", b)) for a, b in zip(old[1:], new[1:], strict=True))
        assert parts.setdefault(old[-1], new[-1]) == new[-1]
        if len(old) == 3:
            female = old[0] in surrogates.FEMALE_TITLES.split("|") or (old[0] in surrogates.OTHER_TITLES.split("|") and old[1][-1] in "aа")
            assert parts.setdefault((old[1], female), new[1]) == new[1] and (new[1][-1] in "aа") == female
    assert len(set(parts.values())) == len(parts)
    assert out[1000] == f"Mrs {parts['Berg']} and Mr {parts['Berg']}"


def test_one_phone_and_one_domain_whatever_the_spelling(spark):
    rows = [(1, "+15551234567 x +1 555 123 4567 x +1 (555) 123-4567"), (2, "ann.lee@Corp.example.com x bob@corp.example.com x Ann.Lee@corp.example.com")]
    out = {r.doc_id: r.text.split(" x ") for r in surrogates.replaced(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({re.sub(r"\D", "", p) for p in out[1]}) == 1 and [re.sub(r"\d", "0", p) for p in out[1]] == ["+00000000000", "+0 000 000 0000", "+0 (000) 000-0000"]
    one, two, three = out[2]
    assert one == three and one != two and one.split("@")[1] == two.split("@")[1] and "." in one.split("@")[0]


def test_many_numbers_of_one_kind(spark):
    """So many numbers that some surrogate is another's number: only those take the next keys."""
    table = spark.range(0, 120_000, 1, 8).select("id", F.concat_ws("-", F.lpad((F.col("id") * 7919 % 1000).cast("string"), 3, "0"), F.lpad((F.col("id") % 97).cast("string"), 2, "0"), F.lpad((F.col("id") * 31 % 10000).cast("string"), 4, "0")).alias("text"))
    out = surrogates.replaced(table).select("id", "text")
    both = out.join(table.withColumnRenamed("text", "old"), "id")
    n = table.select("text").distinct().count()
    assert both.select("text").distinct().count() == n and both.select("text").intersect(both.select("old")).count() == 0


def test_collisions_are_resolved_for_each_entity(spark):
    """Numbers so dense that no key is free for all of them."""
    numbers = [f"+999{i * 7919 % 10**6:06d}" for i in range(3000)]
    table = spark.createDataFrame([(i, " and ".join(numbers[i * 10 : i * 10 + 10]), i) for i in range(300)] + [(None, numbers[5], 1), (300, "none", 4), (301, None, None)], "doc_id long, text string, found long")
    out = {r.doc_id: r for r in surrogates.replaced(table).collect()}
    new = [x for i in range(300) for x in out[i].text.split(" and ")]
    assert len(set(new)) == len(new) == 3000 and not set(new) & set(numbers) and {len(x) for x in new} == {10}
    assert out[None].text == new[5] and out[300].text == "none" and out[301].text is None and len(out) == 303 and out[7].found == 7


def test_colliding_numbers_get_longer_at_last(spark):
    numbers = spark.range(0, 120_000, 1, 8).select(F.concat_ws("-", F.lpad((F.col("id") * 7919 % 1000).cast("string"), 3, "0"), F.lpad((F.col("id") % 97).cast("string"), 2, "0"), F.lpad((F.col("id") * 31 % 10000).cast("string"), 4, "0")).alias("text"))
    moved = surrogates.exceptions(numbers, "k", 0).collect()
    assert moved and all(len(r.surrogate) > 11 and len(r.entity) == 11 for r in moved) and len({r.surrogate for r in moved}) == len(moved)


def word_score(word, counts, n, kinds):
    """log10 of a word's whole and spelled probability, by the plain recursion over one word."""
    if not word:
        return math.log10(counts[""] / n)
    found = lattice.lattice(PIECES)
    spelled = lattice.forward(word, found.slot, found.byte_slots, found.longest, found.weights)[0][-1] + found.weights[-1]
    whole = math.log((counts[word] - lattice.DISCOUNT) / n) if counts[word] else -math.inf
    return np.logaddexp(whole, spelled + math.log(lattice.DISCOUNT * kinds / n)) / math.log(10)


def test_lattice(docs, none, rows):
    side = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows}
    counts = Counter()
    for r in rows:
        if not side[r[0]]:
            counts.update([*WORD.findall((r[1] or "").translate(LOWER)), ""])
    n, v = sum(counts.values()), len(counts)
    for r in lattice.scored(docs, PIECES, held_out(F.col("doc_id"), 5, 1)).collect():
        texts = {x[1] or "" for x in rows if x[0] == r.doc_id}
        tokens = [*WORD.findall(texts.pop().translate(LOWER)), ""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
        assert r.score == pytest.approx(sum(word_score(t, counts, n, v - 1) for t in tokens))
    assert lattice.scored(none, PIECES, held_out(F.col("doc_id"), 5, 1)).count() == 0


def test_forward_sums_all_segmentations():
    slot = {"▁a": 0, "b": 1, "▁": 2, "a": 3, "ab": 4, "▁ab": 5}
    weights = [math.log(x) for x in (0.1, 0.2, 0.3, 0.15, 0.05, 0.2)]
    alpha, _ = lattice.forward("ab", slot, [], 3, weights)
    assert math.exp(alpha[-1]) == pytest.approx(0.2 + 0.1 * 0.2 + 0.3 * 0.05 + 0.3 * 0.15 * 0.2)


def test_words_go_together_as_alone():
    """The recursion over many words gives what it gives for each word, with pieces, bytes, long words and repeats."""
    found = lattice.lattice(PIECES)
    words = ["the", "a", "", "Zürich", "привет", "\U0001f600x", "internationalisation", "q" * 40, "ab" * 200, "the", "\ue000\ue001"]
    alone = [lattice.forward(w, found.slot, found.byte_slots, found.longest, found.weights)[0][-1] + found.weights[-1] for w in words]
    assert found.spelled(words) == pytest.approx(alone) and found.spelled([]).shape == (0,)
    one = [lattice.MARK, *"ab", lattice.MARK + "a", "ab"]
    small = lattice.Lattice({p: k for k, p in enumerate(one)}, [5] * 256, np.log([0.1, 0.2, 0.1, 0.2, 0.1, 0.1, 0.2]))
    assert math.exp(small.spelled(["ab"])[0]) == pytest.approx((0.1 * 0.2 * 0.1 + 0.2 * 0.1 + 0.1 * 0.1) * 0.2)


def test_minhash(docs, none, rows):
    out = minhash.near_duplicates(docs, 85).collect()
    assert len(out) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    one = {r.doc_id: r.component_id for r in out}
    assert one[2] == 2 and one[5] == 5
    assert minhash.near_duplicates(none, 85).count() == 0


def test_rows_that_share_an_id(spark):
    """Each id below 20 has two unlike texts with a near copy each; each id from 500 on has a text of its own and a near copy."""
    text = lambda k, i, end="end": " ".join(f"{k}{i}w{j}" for j in range(60)) + " " + end
    kept = [(i, text(k, i)) for i in range(20) for k in "ab"] + [(500 + i, text("d", i)) for i in range(20)]
    rows = kept + [(i, text("a", i)) for i in range(5)] + [(n + i, text(k, i, "other")) for i in range(20) for n, k in ((100, "a"), (200, "b"), (500, "a"))] + [(7, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert out == sorted((i, i % 100 if t and t[0] in "ab" else i) for i, t in rows)
    left = [(r.doc_id, r.text) for r in minhash.without_near_duplicates(docs).collect()]
    assert sorted(x for x in left if x[1]) == sorted(kept) and sum(not t for _, t in left) == 1


def test_components_do_not_stop_early(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "u long, v long")
    with pytest.raises(RuntimeError):
        components.components(edges, 1)
    assert {r.component for r in components.components(edges).collect()} == {0}


@pytest.mark.parametrize("n, probe", [(300, 1e9), (900, 1 / 4), (900, 0)])
def test_hamming(spark, monkeypatch, n, probe):
    """All radii, the usual switch and the comparison of all codes alone; ties at rank k, repeated ids, clashing columns, nulls."""
    monkeypatch.setattr(hamming, "PROBE_SHARE", probe)
    monkeypatch.setattr(hamming, "BLOCK", 4)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 16))
    x[100:160] = x[7]
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5, x[5].tolist(), 2), (999, None, 3), (None, [1.0] * 16, 4), (1000, [], 5)], "vec_id long, embedding array<double>, code int")
    rows = hamming.codes(table, "vec_id", "embedding").cache()
    codes = {r.id: r.code for r in rows.collect()}
    got = {}
    for r in hamming.top_k(rows, rows.where("id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.id))
    assert got == {q: sorted((((codes[q] ^ c) & (2**64 - 1)).bit_count(), i) for i, c in codes.items() if i != q)[:10] for q in range(0, n, 100)}


def test_hamming_of_nothing(spark):
    rows = spark.createDataFrame([], "id long, code long")
    assert hamming.top_k(rows, rows).count() == 0
    assert hamming.top_k(spark.createDataFrame([(1, 5), (2, 5)], "id long, code long"), rows).count() == 0
