"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced letter.

Letters are dealt to groups of about equal frequency, and a word's vector has the count of each group. An edit adds one to
at most one count (surplus) and takes one from at most one (deficit). The trie of all words arranges them by one count after
the other. Its first levels, as many as the number of words asks for, are keys of a Spark join, which sends each word to
those subtries that the budget of one surplus and one deficit reaches; below, a task builds a block's subtrie and a
depth-first search spends what is left of the budget; the words of the leaves are verified. Subtries of many words and the
many words that visit one are cut into blocks, so no task holds a whole subtrie.

Texts are read whole; a null text has no runs, and a null doc_id counts as an empty one. Rows are counted as they come, equal
ones too. Code points outside the run pattern only separate. Words of equal n are told apart by code-point order. An empty
table gives an empty result. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Groups of letters; the most frequent letters that are dealt to them (others count in no group, which the budget allows).
GROUPS, LETTERS = 12, 256
#: Digits that stand for counts, and the next and the one before of each.
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
UP, DOWN = dict(zip(DIGITS, DIGITS[1:])), dict(zip(DIGITS[1:], DIGITS))
#: Words of a subtrie, and words that visit it, in one task; words that a subtrie should hold at the usual spread of counts.
BLOCK, VISITS, USUAL = 4096, 32_768, 2048


def words(docs: DataFrame, every: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word and n. One run in `every`, chosen by the crc32 of document and run, loses a letter first."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    found = runs.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))
    return found.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _counts(vocabulary: DataFrame) -> Column:
    """A word's count of each group of letters, as one digit of DIGITS each; greater ones, which differ by no more then, as the last."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count()
    groups = [[0, g, ""] for g in range(GROUPS)]
    for r in letters.orderBy(F.desc("count"), "letter").limit(LETTERS).collect():
        lightest = min(groups)
        lightest[0] += r["count"]
        lightest[2] += r["letter"]
    marks = [chr(0xE000 + g) for g in range(GROUPS)]
    marked = F.translate("word", "".join(g[2] for g in groups), "".join(m * len(g[2]) for g, m in zip(groups, marks, strict=True)))
    counts = (F.length(marked) - F.length(F.replace(marked, F.lit(m), F.lit(""))) for m in marks)
    return F.concat(*(F.substring(F.lit(DIGITS), F.least(c + 1, F.lit(len(DIGITS))), F.lit(1)) for c in counts))


def _reached(top: Column, levels: int) -> Column:
    """What the budget allows on the first levels: the counts, and what is left (2: all, 1: the deficit, 0: nothing).

    Two words meet once: the surplus is spent on an earlier level than the deficit.
    """
    steps = [((), 2)] + [(((g, UP),), 1) for g in range(levels)] + [(((g, UP), (h, DOWN)), 0) for g, h in combinations(range(levels), 2)]

    def moved(step) -> Column:
        places = dict(step)
        parts = [F.substring(top, g + 1, 1) for g in range(levels)]
        return F.concat(*(F.create_map(*(F.lit(x) for pair in places[g].items() for x in pair))[c] if g in places else c for g, c in enumerate(parts)))

    return F.explode(F.array(*(F.struct(moved(s).alias("to"), F.lit(left).alias("left")) for s, left in steps)))


def _inserted(trie: dict, counts: str, word: str, n: int) -> None:
    for count in counts[:-1]:
        trie = trie.setdefault(count, {})
    trie.setdefault(counts[-1], []).append((word, n))


def _leaves(node: dict, counts: str, depth: int, left: int, found: list) -> None:
    """Adds to found the leaves below node that the counts from depth on reach, and what is left of the budget there; depth first."""
    while depth < len(counts):
        own = counts[depth]
        other = node.get((UP if left == 2 else DOWN).get(own)) if left else None
        depth += 1
        if other is not None:
            if depth == len(counts):
                found.append((other, left - 1))
            else:
                _leaves(other, counts, depth, left - 1, found)
        node = node.get(own)
        if node is None:
            return
    found.append((node, left))


def one_edit(a: str, b: str) -> bool:
    """b is a with one letter replaced, or one inserted."""
    if len(b) - len(a) not in (0, 1) or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def _searched(key, held: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
    trie, out = {}, []
    for word, n, rest in zip(held["word"].tolist(), held["n"].tolist(), held["rest"].tolist()):
        _inserted(trie, rest, word, n)
    for word, n, rest, budget in zip(visits["visitor"].tolist(), visits["times"].tolist(), visits["path"].tolist(), visits["left"].tolist()):
        found = []
        _leaves(trie, rest, 0, budget, found)
        half = len(word) // 2
        head, tail = word[:half], word[len(word) - half :]  # an edit leaves one of them
        for leaf, left in found:
            for other, m in leaf:
                if not (other.startswith(head) or other.endswith(tail)):
                    continue
                # Of two words with equal counts the smaller finds the other, unless one is shorter: that one does.
                if (left < 2 or len(other) > len(word) or word < other) and one_edit(word, other):
                    out.append((word, n, other, m))
    return pd.DataFrame(out, columns=["a", "n_a", "b", "n_b"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """a, n_a, b, n_b for every two words (word, n) at one edit, once."""
    total = vocabulary.count()
    levels = next(t for t in range(2, GROUPS) if t == GROUPS - 1 or 3**t * USUAL >= total)
    counted = vocabulary.select("word", "n", _counts(vocabulary).alias("counts"))
    counted = written(counted.select("word", "n", F.substring("counts", 1, levels).alias("top"), F.substring("counts", levels + 1, GROUPS).alias("rest")), "counted-words")
    tops = written(counted.groupBy("top").agg(F.count("*").alias("held")), "subtries")
    # Which subtries the words of one visit, and how many visits each has, follow from the subtries alone.
    visited = tops.select("top", "held", _reached(F.col("top"), levels).alias("x")).select("top", "held", F.col("x.to").alias("to"), F.col("x.left").alias("left")).where("to is not null")
    sizes = tops.select(F.col("top").alias("to"), F.ceil(F.col("held") / BLOCK).alias("blocks"))
    sizes = sizes.join(visited.groupBy("to").agg(F.ceil(F.sum("held") / VISITS).alias("parts")), "to")
    ways = written(visited.drop("held").join(sizes, "to"), "visited-subtries")

    def one_of(parts: str) -> Column:
        return F.pmod(F.xxhash64("word"), F.col(parts))

    def each(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))

    held = counted.withColumnRenamed("top", "to").join(sizes, "to").select("to", one_of("blocks").alias("block"), "word", "n", "rest", each("parts").alias("part"))
    visits = counted.join(ways, "top").select("to", F.col("word").alias("visitor"), F.col("n").alias("times"), F.col("rest").alias("path"), "left", one_of("parts").alias("part"), each("blocks").alias("block"))
    keys = ["to", "block", "part"]
    return held.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(_searched, "a string, n_a long, b string, n_b long")


def _roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """word, root of words (word, form) whose forms have greater n: each round doubles how far a word has been followed."""
    spark = forms.sparkSession
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(spark, now)
        now = then
        if now.where("moved").isEmpty():
            return now.select("word", "root")
    raise RuntimeError(f"forms not followed to their ends in {max_rounds} rounds")


def variants(docs: DataFrame, every: int = 97, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents.

    form is the near word of largest n (of equal ones the smallest), where that is at least ratio times the word's own.
    """
    vocabulary = written(words(docs, every, least_length, least_count), "words")
    near = written(near_words(vocabulary), "near-words")
    both = near.union(near.select("b", "n_b", "a", "n_a"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("minus"), F.col("b").alias("form"))).alias("best"))
    known = vocabulary.join(best, "word", "left")
    taken = -F.col("best.minus") >= ratio * F.col("n")
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.minus")).cast("long").alias("form_n")), "forms")
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
