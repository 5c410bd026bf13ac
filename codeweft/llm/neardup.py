"""Near-duplicate texts by a token-group matrix (problem 4).

Texts are sets of hashed word shingles. The join is exact for the Jaccard threshold; no pair is sampled or dropped.

1. Byte-identical texts are folded into one class.
2. Shingles are ordered: those in few texts first, frequent ones last. Two sets that reach the threshold must share at
   least ``MATCHES`` shingles among the first ``n - ceil(t * n) + MATCHES`` of each, so only these "heads" are matched.
   Any order gives the same result; a good one keeps frequent shingles out of the heads.
3. Texts with the same first shingle form a group, so similar texts tend to be together. The matrix has one entry per
   (shingle, group): the union of the heads of the group's texts.
4. The overlap of a query's head with a group's union bounds its overlap with every text inside; groups that cannot
   reach ``MATCHES``, or whose sizes rule the threshold out, stay closed.
5. Texts of the groups that were opened are compared exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.tokens import spread
from codeweft.plans.materialize import materialize, materialize_bucketed

THRESHOLD = 0.55
SHINGLE = 3
LEAST_WORDS = 40
#: Matches that the heads of a pair must share.
MATCHES = 10
#: A shingle is frequent from this share of the texts on. There are at most (mean set size / FREQUENT) such shingles.
FREQUENT = 1 / 10_000
#: A frequent shingle in this many texts is dealt into parts of about so many, MOST_SALTS at most.
SALT_TEXTS, MOST_SALTS = 4096, 64

_WORD = re.compile(rb"[A-Za-z0-9_]+")
_MASK = np.uint64((1 << 48) - 1)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str, size: int = SHINGLE, least_words: int = LEAST_WORDS, known: dict[bytes, int] | None = None) -> np.ndarray | None:
    """Sorted distinct 48-bit hashes of all runs of ``size`` words; None with fewer than ``least_words`` words.

    A word is a maximal run of ASCII letters, digits and underscores in lower case; other characters only separate.
    """
    import xxhash

    words = _WORD.findall(text.encode("utf-8").lower())  # bytes.lower() changes ASCII only
    if len(words) < max(least_words, size):
        return None
    known = {} if known is None else known
    if len(known) > 500_000:
        known.clear()
    w = np.empty(len(words), np.uint64)
    for i, x in enumerate(words):
        h = known.get(x)
        if h is None:
            h = known[x] = xxhash.xxh64_intdigest(x)
        w[i] = h
    with np.errstate(over="ignore"):
        s = w[: len(w) - size + 1].copy()
        for k in range(1, size):
            s = (s ^ (s >> np.uint64(29))) * _P1 + w[k : len(w) - size + 1 + k] * _P2
        s ^= s >> np.uint64(32)
        s = (s * _P1) >> np.uint64(16)
    return np.unique(s & _MASK)


def _sets(df: DataFrame, size: int, least_words: int) -> DataFrame:
    """``node``, ``n``, ``grams`` of every distinct text with enough words; ``node`` is the hash of its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for pdf in batches:
            keys, sizes, grams = [], [], []
            for node, text in zip(pdf["node"].to_numpy(), pdf["text"]):
                s = shingles(text, size, least_words, known)
                if s is not None:
                    keys.append(node)
                    sizes.append(len(s))
                    grams.append(s.astype(np.int64))
            yield pd.DataFrame({"node": np.array(keys, np.int64), "n": np.array(sizes, np.int32), "grams": grams})

    return df.mapInPandas(run, "node long, n int, grams array<long>")


def _frequent(sets: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that may be in ``share`` of the texts or more, the most frequent last, and how many texts they are in.

    A shingle with that share overall has it in some task. So each task names those that reach half the share of its own
    texts (at most 2 x mean size / share of them), and only these travel. Counted over all texts; the result orders shingles, it
    drops none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, held = 0, None
        for pdf in batches:
            if not len(pdf):
                continue
            texts += len(pdf)
            v, c = np.unique(np.concatenate([np.asarray(g, np.int64) for g in pdf["grams"]]), return_counts=True)
            if held is not None:
                v, at = np.unique(np.concatenate([held[0], v]), return_inverse=True)
                c = np.bincount(at, np.concatenate([held[1], c])).astype(np.int64)
            if len(v) > 4_000_000:  # lossy counting: what stayed behind the share so far can be let go, and is made up for
                keep = c >= max(2, share * texts / 2)
                v, c = v[keep], c[keep]
            held = (v, c)
        if held is not None:
            keep = held[1] >= max(2, share * texts / 2)
            yield pd.DataFrame({"gram": held[0][keep], "c": held[1][keep]})

    found = sets.select("grams").mapInPandas(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    least = max(2.0, share * sets.count())
    rows = found.where(F.col("c") >= least).orderBy("c", "gram").select("gram", "c").toPandas()
    return rows["gram"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)


def _heads(sets: DataFrame, frequent: tuple[np.ndarray, np.ndarray], threshold: float, matches: int) -> DataFrame:
    """``gram``, ``node``, ``n``, ``group``, ``salt``, ``salts``: the head of every set, one row per shingle. A shingle that
    may be in a third of the texts gets a ``salt`` of 1..``salts`` by the text; both are 0 for all but such shingles."""
    order = np.argsort(frequent[0])
    parts = np.minimum(frequent[1] // SALT_TEXTS, MOST_SALTS).astype(np.int8)
    shared = sets.sparkSession.sparkContext.broadcast((frequent[0][order], order, parts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, ranks, parts = shared.value
        for pdf in batches:
            out, sizes, dealt = [], [], []
            groups = []
            for n, g in zip(pdf["n"].to_numpy(), pdf["grams"]):
                g = np.asarray(g, np.int64)
                length = min(n, n - math.ceil(threshold * n - 1e-9) + matches)
                salts = np.zeros(length, np.int8)
                if len(values):
                    at = np.searchsorted(values, g)
                    at[at == len(values)] = 0
                    often = values[at] == g
                    if often.any():
                        rare = g[~often]
                        if len(rare) < length:
                            r = ranks[at[often]]
                            last = np.argsort(r, kind="stable")[: length - len(rare)]
                            salts[len(rare) :] = parts[r[last]]
                            rare = np.concatenate([rare, g[often][last]])
                        g = rare
                head = g[:length]
                dealt.append(salts)
                out.append(head)
                sizes.append(len(head))
                groups.append(head[0])
            if not out:
                continue
            rep = np.array(sizes)
            nodes, salts = np.repeat(pdf["node"].to_numpy(np.int64), rep), np.concatenate(dealt)
            salt = np.where(salts > 0, 1 + nodes % np.maximum(salts, 1), 0).astype(np.int8)
            yield pd.DataFrame({"gram": np.concatenate(out), "node": nodes, "n": np.repeat(pdf["n"].to_numpy(np.int32), rep), "group": np.repeat(np.array(groups, np.int64), rep), "salt": salt, "salts": salts})

    return sets.select("node", "n", "grams").mapInPandas(run, "gram long, node long, n int, group long, salt int, salts int")


def fold(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(``node``, ``id``: every key and the class of its text; ``node``, ``text``: one row per class).

    Null texts and keys are left out. Exact repeats of a row count once. A hot class is combined in each task before the
    shuffle. ``node`` is a 64-bit hash of the text's bytes: among 10^8 different texts a chance collision has a
    probability of 3 in 10,000.
    """
    rows = df.select(df[key].cast("long").alias("id"), df[text].cast("string").alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("node", F.xxhash64("text"))
    members = rows.select("node", "id").distinct()
    return members, rows.groupBy("node").agg(F.first("text").alias("text"))


def class_pairs(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, size: int = SHINGLE, least_words: int = LEAST_WORDS, matches: int = MATCHES) -> tuple[DataFrame, DataFrame]:
    """(``node``, ``id``; ``node_a``, ``node_b``, ``jaccard``): the members of the classes, and each pair of classes that
    reaches the threshold, once.

    Texts that are null or have fewer than ``least_words`` words are in no pair. An empty table gives empty results.
    Extra columns are ignored.
    """
    spark = df.sparkSession
    least_bytes = 2 * least_words - 1  # a word and a separator each
    members, texts = fold(df.where(F.octet_length(df[text]) >= least_bytes), key, text)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sets = materialize_bucketed(_sets(texts, size, least_words), "sets", "node", parts)
    frequent = _frequent(sets, FREQUENT)
    heads = _heads(spread(sets), frequent, threshold, matches).repartition(parts, "gram", "salt")
    # shingles of one text only cannot match; counted in place, after the one exchange. Frequent ones are in several texts by
    # definition, so salted parts need no count, and what meets in a window is in few texts
    rows = heads.withColumn("__c", F.count(F.lit(1)).over(Window.partitionBy("gram", "salt"))).where("salt > 0 OR __c > 1").drop("__c")
    rows = materialize(rows, "heads")
    matrix = rows.groupBy("gram", "group").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("salts").alias("salts"))
    salts = F.when(F.col("salts") > 0, F.sequence(F.lit(1), F.col("salts"))).otherwise(F.array(F.lit(0)))
    matrix = matrix.select("gram", F.col("group").alias("open"), "lo", "hi", F.explode(salts).alias("salt"))
    # the larger text of a pair asks; the smaller one needs at least threshold times its size
    q = rows.select("gram", "salt", "node", "n")
    t = F.lit(threshold)
    bound = q.join(matrix, ["gram", "salt"]).where((F.col("lo") <= F.col("n")) & (F.col("hi") >= t * F.col("n") - F.lit(1e-9)))
    opened = bound.groupBy("node", "n", "open").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= F.least(F.lit(matches), F.ceil(t * F.col("n")))).select("node", "n", "open")
    inside = rows.select(F.col("group").alias("open"), F.col("node").alias("other"), F.col("n").alias("m")).distinct()
    pairs = opened.join(inside, "open").where((F.col("m") >= t * F.col("n") - F.lit(1e-9)) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("node")))))
    a = sets.select(F.col("node"), F.col("grams").alias("ga"))
    b = sets.select(F.col("node").alias("other"), F.col("grams").alias("gb"))
    full = pairs.select("node", "other", "n", "m").join(a, "node").join(b, "other")
    common = F.size(F.array_intersect("ga", "gb"))
    scored = full.select("node", "other", (common / (F.col("n") + F.col("m") - common)).alias("jaccard"))
    hits = scored.where(F.col("jaccard") >= t).select(F.least("node", "other").alias("node_a"), F.greatest("node", "other").alias("node_b"), "jaccard")
    return members, hits


def id_pairs(members: DataFrame, hits: DataFrame) -> DataFrame:
    """``id_a`` < ``id_b``, ``jaccard``: the pairs of classes spelt out in ids. Identical texts are in no pair."""
    left = members.select(F.col("node").alias("node_a"), F.col("id").alias("x"))
    right = members.select(F.col("node").alias("node_b"), F.col("id").alias("y"))
    both = hits.join(left, "node_a").join(right, "node_b").where(F.col("x") != F.col("y"))
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "jaccard").distinct()


def groups(members: DataFrame, hits: DataFrame) -> DataFrame:
    """``id``, ``group_id``, ``n_links``: one row per id that has a near or exact copy.

    ``group_id`` is the smallest class of the connected group; ``n_links`` counts the linked classes. Labels spread by
    minimum along links with pointer jumping, so the rounds grow with the logarithm of a group's width. Only classes with
    links take part; nothing is gathered on the driver but one count per round.
    """
    links = hits.select("node_a", "node_b").union(hits.select(F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b")))
    links = materialize(links, "links")
    label = links.groupBy("node_a").agg(F.least(F.min("node_b"), F.col("node_a")).alias("label")).select(F.col("node_a").alias("node"), "label")
    label = materialize(label, "label")
    while True:
        over = label.select(F.col("node").alias("node_b"), F.col("label").alias("l"))
        nearest = links.join(over, "node_b").groupBy(F.col("node_a").alias("node")).agg(F.min("l").alias("l"))
        step = label.join(nearest, "node").select("node", F.least("label", "l").alias("mid"), F.col("label").alias("old"))
        jump = label.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        nxt = materialize(step.join(jump, "mid").select("node", F.least("mid", "far").alias("label"), "old"), "label")
        moved = nxt.where(F.col("label") != F.col("old")).limit(1).count()
        label = nxt.select("node", "label")
        if not moved:
            break
    degree = links.groupBy(F.col("node_a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
    copies = members.groupBy("node").agg(F.count(F.lit(1)).alias("__n"))
    known = label.join(degree, "node")
    rows = members.join(copies, "node").join(known, "node", "left").where((F.col("__n") > 1) | F.col("label").isNotNull())
    return rows.select("id", F.coalesce("label", "node").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
