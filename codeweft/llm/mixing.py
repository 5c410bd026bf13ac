"""Mixing sources to target weights (problem 8).

1. Every document's text is encoded; per source the tokens are laid end to end, documents in the order of a hash of their
   key, and cut into blocks of ``block`` tokens (the last one of a source is shorter). A document thus lies in one or more
   blocks, a block may hold several documents. A source has a part for every PART_TOKENS of its tokens; offsets come from a
   prefix sum over the parts and a running count inside each, so no source is brought into one task. Blocks are cut from
   the sorted stream; only pieces at the ends of parts are brought together.
2. The size of the mixture is the largest at which every source with documents can give its share without using a block
   more than ``max_repeats`` times (or a size that is asked for); sources without documents give nothing. Exact block
   quotas per source follow by largest remainders.
3. Quotas are dealt to output shards by multinomial draws given the totals, so each shard is a draw of the mixture and
   the totals are met exactly. All draws are functions of the seed.
4. A source's slot j is block ``permute(j mod n)`` of round ``j div n``: a pseudorandom permutation of the block numbers,
   another one each round. No block comes an extra time before all others have come as often.
5. Slots are joined with blocks by (source, block number).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.tokens import VOCAB, encode_column
from codeweft.plans.materialize import materialize
from codeweft.sources.tables import canonical_source

BLOCK_TOKENS = 512
#: Output shards: at least so many, and one for every SHARD_BLOCKS of the mixture.
SHARDS = 16
SHARD_BLOCKS = 1 << 20
SEED = 20_240_501
#: Tokens of a source that are laid out in one stream.
PART_TOKENS = 1 << 22


def targets_of(mix: DataFrame) -> list[tuple[str, float, int]]:
    """(source, share, max_repeats) by source name; the table has one row per source and is small by nature.

    Null sources and shares that are null or not positive are left out, a null or smaller ``max_repeats`` counts as 1,
    repeated sources add their shares and keep the smallest cap. Shares are divided by their sum.
    """
    rows = mix.select(canonical_source(F.col("source")).alias("s"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("r")).where("s IS NOT NULL AND w > 0 AND NOT isnan(w)").groupBy("s").agg(F.sum("w").alias("w"), F.min("r").alias("r")).collect()
    total = sum(x.w for x in rows)
    return sorted((x.s, x.w / total, max(1, x.r or 1)) for x in rows)


def encoded(docs: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """``source``, ``doc_id``, ``ids``, ``n``, ``h`` of the documents, written to the shared folder.

    Documents with an empty or null text or a null source take no part.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_source(F.col("source")).alias("source"), F.col("text").cast("string").alias("text")).where("source IS NOT NULL AND source <> '' AND length(text) > 0")
    keyed = known.select(F.struct("source", "doc_id").alias("k"), "text")
    ids = encode_column(keyed, "k", "text", vocab)
    return materialize(ids.select(F.col("k.source").alias("source"), F.col("k.doc_id").alias("doc_id"), "ids", F.size("ids").cast("long").alias("n"), F.xxhash64("k.doc_id", "ids").alias("h")), "encoded")


def totals(rows: DataFrame) -> dict[str, int]:
    """Tokens by source: one number for every source, of which there are few by nature."""
    return {r.source: int(r.t) for r in rows.groupBy("source").agg(F.sum("n").alias("t")).collect()}


def pack(docs: DataFrame, block: int = BLOCK_TOKENS, vocab: str = VOCAB, part_tokens: int = PART_TOKENS) -> DataFrame:
    """``source``, ``doc_id``, ``ids``, ``start``: the encoded documents and where they begin in their source's line, each
    part of a source in order.

    Documents with an empty or null text or a null source take no part. Repeated keys are laid one after the other.
    """
    rows = encoded(docs, vocab)
    return laid(rows, totals(rows), part_tokens)


def laid(rows: DataFrame, sizes: dict[str, int], part_tokens: int = PART_TOKENS) -> DataFrame:
    """:func:`pack` of :func:`encoded` rows whose sources have these sizes."""
    spark = rows.sparkSession
    parts = spark.createDataFrame([(s, max(1, -(-t // part_tokens))) for s, t in sorted(sizes.items())] or [("", 1)], "source string, parts long")
    rows = rows.join(F.broadcast(parts), "source").withColumn("part", F.pmod("h", "parts")).drop("parts")  # one row per source
    sums = rows.groupBy("source", "part").agg(F.sum("n").alias("t"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # numbers only, one per part
    base = sums.select("source", "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    # a part's offset travels as its first row, so the documents move once and nothing is broadcast
    heads = base.select("source", "part", F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("array<int>").alias("ids"), "base")
    lines = rows.select("source", "part", "h", "doc_id", "ids", F.lit(None).cast("long").alias("base")).unionByName(heads)
    lines = lines.repartition("source", "part").sortWithinPartitions("source", "part", F.col("h").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("base").desc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = 0
        for b in batches:
            ids, base = b.column("ids"), b.column("base").to_pylist()
            sizes = np.diff(ids.offsets.to_numpy())
            start, keep = np.zeros(len(base), np.int64), np.ones(len(base), bool)
            for i, at in enumerate(base):
                if at is not None:
                    pos, keep[i] = at, False
                else:
                    start[i] = pos
                    pos += int(sizes[i])
            out = pa.RecordBatch.from_arrays([b.column("source"), b.column("doc_id"), ids, pa.array(start)], ["source", "doc_id", "ids", "start"])
            yield out.filter(pa.array(keep))

    return lines.mapInArrow(run, "source string, doc_id long, ids array<int>, start long")


def blocks_of(packed: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """``source``, ``block``, ``doc_ids``, ``ids``: the blocks. A block is bounded, whatever its documents are.

    Documents that follow one another in the stream are cut together; what is not a whole block then (the ends of parts)
    is brought together by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, at, docs, cuts = None, 0, [], []  # the open piece: where it begins, its documents and slices
        size = 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal docs, cuts, size
            if size:
                out.append((source, at // block, at, docs, np.concatenate(cuts), size == block))
            docs, cuts, size = [], [], 0

        def sent() -> pa.RecordBatch:
            s, n, a, d, i, w = zip(*out)
            flat = lambda x, t: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([np.asarray(y, t) for y in x]), pa.from_numpy_dtype(t)))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(n, pa.int64()), pa.array(a, pa.int64()), flat(d, np.int64), flat(i, np.int32), pa.array(w, pa.bool_())], ["source", "block", "at", "doc_ids", "ids", "whole"])

        for b in batches:
            ids = b.column("ids")
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            for k, (s, d, start) in enumerate(zip(b.column("source").to_pylist(), b.column("doc_id").to_pylist(), b.column("start").to_pylist())):
                if s != source or start != at + size:
                    close()
                    source, at = s, start
                lo, hi = int(offsets[k]), int(offsets[k + 1])
                while lo < hi:
                    room = block - (at + size) % block
                    n = min(room, hi - lo)
                    docs.append(d)
                    cuts.append(values[lo : lo + n].copy())
                    size += n
                    lo += n
                    if n == room:
                        close()
                        at = start + lo - int(offsets[k])
                    if len(out) >= 1024:
                        yield sent()
        close()
        if out:
            yield sent()

    cut = materialize(packed.select("source", "doc_id", "ids", "start").mapInArrow(run, "source string, block long, at long, doc_ids array<long>, ids array<int>, whole boolean"), "cut")
    p = F.array_sort(F.collect_list(F.struct("at", "doc_ids", "ids")))
    ends = cut.where("NOT whole").groupBy("source", "block").agg(p.alias("p")).select("source", "block", F.flatten(F.col("p.doc_ids")).alias("doc_ids"), F.flatten(F.col("p.ids")).alias("ids"))
    return cut.where("whole").select("source", "block", "doc_ids", "ids").unionByName(ends)


def quotas(targets: list[tuple[str, float, int]], available: dict[str, int], block: int, tokens: int | None = None) -> dict[str, int]:
    """Full blocks that each source gives. ``available``: tokens per source.

    Without ``tokens`` the mixture is as large as it can be with all shares met by the sources that have a full block; a
    larger size that is asked for is met as far as the caps allow, and the report shows the shares that were reached.
    """
    whole = {s: available.get(s, 0) // block for s, _, _ in targets}
    live = [(s, w, r) for s, w, r in targets if whole[s] > 0]
    if not live:
        return {}
    caps = {s: whole[s] * r for s, _, r in live}
    total = math.floor(min(caps[s] / w for s, w, _ in live) * sum(w for _, w, _ in live)) if tokens is None else max(0, tokens // block)
    weight = sum(w for _, w, _ in live)
    exact = {s: total * w / weight for s, w, _ in live}
    out = {s: min(math.floor(x), caps[s]) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s)):
        if sum(out.values()) < total and out[s] < caps[s] and out[s] <= exact[s]:
            out[s] += 1
    return out


def deal(quota: dict[str, int], shards: int, seed: int = SEED) -> dict[tuple[str, int], tuple[int, int]]:
    """(source, shard) -> (first slot, slots): multinomial draws with equal chances of the shards, given the totals.

    Shard sizes are equal up to one block; a shard's counts are drawn from what the sources have left, which is the
    multinomial draw conditional on the totals.
    """
    names = sorted(quota)
    left = np.array([quota[s] for s in names], np.int64)
    used = np.zeros(len(names), np.int64)
    rng, total, out = np.random.default_rng(seed), int(left.sum()), {}
    for k in range(shards):
        size = total * (k + 1) // shards - total * k // shards
        got, rest, want = np.zeros(len(names), np.int64), int(left.sum()), size
        for i in range(len(names)):  # one source after the other: the conditional draws of a multivariate draw
            rest -= int(left[i])
            got[i] = _draw(rng, int(left[i]), rest, want)
            want -= int(got[i])
        for i, s in enumerate(names):
            out[s, k] = (int(used[i]), int(got[i]))
        used += got
        left -= got
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Of ``n`` draws without replacement from ``good`` and ``bad`` ones, how many are good: one uniform number through the
    inverse distribution. Chances are followed from the mode outward to where they are below 1e-18 of it."""
    lo, hi = max(0, n - bad), min(n, good)
    if n <= 0 or good <= 0 or lo >= hi:
        return max(0, lo if n > 0 else 0)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), lo), hi)
    width = 64 + int(10 * math.sqrt(n * (good / (good + bad)) * (bad / (good + bad)) * max(0.0, (good + bad - n) / (good + bad - 1)))) if good + bad > 1 else 64
    a, b = max(lo, mode - width), min(hi, mode + width)
    k = np.arange(a, b, dtype=np.float64)  # log of the chance of k + 1 over that of k
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.exp(logs - logs.max())
    return a + int(min(np.searchsorted(np.cumsum(chance), rng.random() * chance.sum(), "right"), b - a))


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permute(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at j: a four-round Feistel network, walked until it is inside the range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = _mix64(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & (2**64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (_mix64(right ^ k) & mask)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(j, np.uint64))
    while True:
        far = out >= np.uint64(n)
        if not far.any():
            return out.astype(np.int64)
        out[far] = once(out[far])


def source_key(source: str, turn: int, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{seed}/{turn}/{source}")


def slots(spark, quota: dict[str, int], available: dict[str, int], block: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``shard``, ``slot``, ``source``, ``turn``, ``block``: what stands where in the mixture.

    The driver keeps (sources x shards) numbers; the slots themselves are made on the executors.
    """
    plan = deal(quota, shards, seed)
    runs, place = [], {}
    for (s, k), (first, n) in sorted(plan.items(), key=lambda x: (x[0][1], x[0][0])):
        if n:
            runs.append((s, k, first, n, place.get(k, 0), available[s] // block))
            place[k] = place.get(k, 0) + n
    sizes = place
    chunk = 65_536
    pieces = [(s, k, first + a, min(chunk, n - a), at + a, whole, sizes[k]) for s, k, first, n, at, whole in runs for a in range(0, n, chunk)]
    frame = spark.createDataFrame(pieces or [("", 0, 0, 0, 0, 1, 1)], "source string, shard int, first long, n long, at long, whole long, size long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if not r.n:
                    continue
                j = np.arange(r.first, r.first + r.n)
                turn = j // r.whole
                number = np.empty(len(j), np.int64)
                for t in np.unique(turn):
                    here = turn == t
                    number[here] = permute(j[here] % r.whole, int(r.whole), source_key(r.source, int(t), seed))
                slot = permute(np.arange(r.at, r.at + r.n), int(r.size), source_key("slot", r.shard, seed))  # sources interleave
                yield pd.DataFrame({"shard": np.int32(r.shard), "slot": slot, "source": r.source, "turn": turn.astype(np.int32), "block": number})

    return frame.repartition(max(1, min(len(pieces), 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "shard int, slot long, source string, turn int, block long")


def mixture(docs: DataFrame, mix: DataFrame, tokens: int | None = None, block: int = BLOCK_TOKENS, shards: int | None = None, seed: int = SEED, vocab: str = VOCAB) -> tuple[DataFrame, DataFrame]:
    """(the mixture, the report of shares).

    Mixture: ``shard``, ``slot``, ``source``, ``turn`` (0 for the first use), ``block``, ``doc_ids``, ``ids``. Report: one
    row per source of ``mix``: ``target_share``, ``max_repeats``, ``available_tokens``, ``tokens``, ``share`` (of the
    mixture), ``most_uses``, ``left_tokens`` (those behind the last full block, which never come).

    Only full blocks enter, so every slot has the same size; the rest of a source (less than a block) stays out.
    Documents of sources that are not listed stay out. Tables may be empty; extra columns are ignored. ``shards`` is
    derived from the size of the mixture if it is not given.
    """
    spark = docs.sparkSession
    targets = targets_of(mix)
    wanted = spark.createDataFrame([(s,) for s, _, _ in targets] or [("",)], "source string")
    listed = docs.withColumn("__s", canonical_source(F.col("source"))).join(F.broadcast(wanted.select(F.col("source").alias("__s"))), "__s", "left_semi")  # one row per listed source
    rows = encoded(listed, vocab)
    available = totals(rows)
    quota = quotas(targets, available, block, tokens)
    total = sum(quota.values())
    where = slots(spark, quota, available, block, shards or max(SHARDS, -(-total // SHARD_BLOCKS)), seed)
    mixed = where.join(blocks_of(laid(rows, available), block), ["source", "block"]).select("shard", "slot", "source", "turn", "block", "doc_ids", "ids")
    lines = [(s, w, r, available.get(s, 0), quota.get(s, 0) * block, quota.get(s, 0) / total if total else 0.0, -(-quota.get(s, 0) // max(1, available.get(s, 0) // block)), available.get(s, 0) % block) for s, w, r in targets]
    report = spark.createDataFrame(lines, "source string, target_share double, max_repeats int, available_tokens long, tokens long, share double, most_uses int, left_tokens long")
    return mixed, report
