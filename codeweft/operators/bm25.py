"""Full-text search over symbols (R2, R3): BM25 per field, for many queries in one job.

Tokens are maximal alphanumeric runs in lower case of at most 40 bytes. k1 = 1.2, b = 0.75, idf = ln(1 + (N - n + 0.5) / (n + 0.5)); the
score of a symbol is the sum over fields and distinct query words, any word may match.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.plans.materialize import materialize

K1, B = 1.2, 0.75
FIELDS = ("name", "signature", "docstring", "body")
POOL = 50
#: Symbols and queries of a block; every block of the one meets every block of the other.
SYMBOL_BLOCK, QUERY_BLOCK = 16_384, 4096
#: Word frequencies are broadcast up to this many rows, beyond it they are joined.
MOST_BROADCAST = 1_000_000
#: Up to so many words are named to the scan of the postings.
MOST_LISTED = 200
#: Up to so many queries the blocks of symbols are as large as they may be.
ALONE = 8


def terms(text: Column) -> Column:
    """The tokens of a text, repeats included."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & (F.octet_length(x) <= 40))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id``, ``term``: the distinct words of each query's ``task``."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("task")))).alias("term"))


def postings(symbols: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``field``, ``id``, ``dl`` (tokens of the field), ``term``, ``tf``."""
    per_field = [symbols.select("id", F.lit(f).alias("field"), terms(F.col(f)).alias("t")) for f in fields]
    rows = per_field[0]
    for r in per_field[1:]:
        rows = rows.unionByName(r)
    rows = rows.where(F.size("t") > 0)
    return rows.select("field", "id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("field", "id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


@dataclass
class Postings:
    """What searching needs of the symbols, built once: all postings in the order of their words, the mean field lengths, and how
    many symbols there are."""

    table: DataFrame
    stats: DataFrame
    n_docs: int

    @classmethod
    def build(cls, symbols: DataFrame, fields: tuple[str, ...] = FIELDS) -> Postings:
        """Sorted by word, so a search reads the parts of the table that hold its words."""
        table = materialize(postings(symbols, fields).repartitionByRange("term").sortWithinPartitions("term"), "postings")
        stats = materialize(table.select("field", "id", "dl").distinct().groupBy("field").agg(F.avg("dl").alias("avgdl")), "lengths")
        return cls(table, stats, symbols.select("id").count())


def weights(symbols: DataFrame, asked: DataFrame, fields: tuple[str, ...] = FIELDS, built: Postings | None = None) -> DataFrame:
    """``id``, ``term``, ``w``: the weight of each asked word (``term``) in each symbol, summed over the fields.

    A symbol's text is split once; words are counted inside the row, so a common word does not gather anywhere."""
    n_asked = asked.count()
    few = F.broadcast(asked) if n_asked <= MOST_BROADCAST else asked
    if built is not None:
        post = built.table
        if n_asked <= MOST_LISTED:  # the words reach the scan
            post = post.where(F.col("term").isin([r.term for r in asked.collect()]))
        return _weighed(post.join(few, "term", "left_semi"), built.stats, F.lit(built.n_docs), n_asked * len(fields))
    rows = symbols.select("id", *fields).select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("t")) for f in fields])).alias("x")).select("id", "x.field", "x.t").where(F.size("t") > 0)
    stats = rows.groupBy("field").agg(F.avg(F.size("t")).alias("avgdl"))
    total = symbols.agg(F.count(F.lit(1)).alias("n_docs"))
    tokens = rows.select("field", "id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    post = materialize(tokens.join(few, "term", "left_semi").groupBy("field", "id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    return _weighed(post, stats, F.lit(total.first()[0]), n_asked * len(fields))


def _weighed(post: DataFrame, stats: DataFrame, n_docs: Column, most_words: int) -> DataFrame:
    df = post.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    df = F.broadcast(df) if most_words <= MOST_BROADCAST else df
    w = post.join(df, ["field", "term"]).join(F.broadcast(stats), "field")  # one row per field
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return w.select("id", "term", weight.alias("w")).groupBy("id", "term").agg(F.sum("w").alias("w"))


def search(symbols: DataFrame, queries: DataFrame, limit: int = POOL, fields: tuple[str, ...] = FIELDS, built: Postings | None = None) -> DataFrame:
    """R2: ``query_id``, ``id``, ``rank`` (from 1), ``score``: the best symbols of each query; ties by id.

    Only words that are asked for are kept. Then a block of symbols meets a block of queries in one task, adds up the
    weights of each query's words in an array, and passes on the best of the block; nothing is made per (query, symbol).
    """
    q = materialize(query_terms(queries), "asked")
    w = weights(symbols, q.select("term").distinct(), fields, built)
    n_symbols, n_queries = built.n_docs if built else symbols.select("id").count(), queries.select("query_id").count()
    spark = symbols.sparkSession
    n_blocks = max(spark.sparkContext.defaultParallelism if n_queries > ALONE else 1, -(-n_symbols // SYMBOL_BLOCK))
    n_asks = max(1, -(-n_queries // QUERY_BLOCK))
    key = F.xxhash64("term").alias("key")
    posts = w.select("id", key, "w", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))).alias("b"))
    asks = q.groupBy("query_id").agg(F.collect_set(F.xxhash64("term")).alias("keys"))
    asks = asks.select("query_id", "keys", F.pmod(F.xxhash64("query_id"), F.lit(n_asks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("a"))
    kinds = queries.schema["query_id"].dataType.simpleString(), symbols.schema["id"].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, at = np.unique(left["id"].to_numpy(), return_inverse=True)
            order = np.argsort(left["key"].to_numpy(), kind="stable")
            at, value = at[order], left["w"].to_numpy()[order]
            keys, starts = np.unique(left["key"].to_numpy()[order], return_index=True)
            where = dict(zip(keys.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(at)])))
            for query, words in zip(right["query_id"], right["keys"]):
                score = np.zeros(len(ids))
                for a, b in sorted(where[x] for x in words.tolist() if x in where):
                    score[at[a:b]] += value[a:b]
                hit = np.flatnonzero(score > 0)
                if len(hit) > limit:  # equal ones after rounding stay
                    least = np.partition(score[hit], len(hit) - limit)[len(hit) - limit]
                    hit = hit[score[hit] >= least - 2e-6]
                if len(hit):
                    out.append(pd.DataFrame({"query_id": query, "id": ids[hit], "score": score[hit]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    met = posts.groupBy("a", "b").cogroup(asks.groupBy("a", "b")).applyInPandas(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    scored = met.select("query_id", "id", F.round("score", 6).alias("score"))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= limit).select("query_id", "id", "rank", "score")


def search_name(symbols: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """``query_id``, ``id``, ``rank``: symbols whose name holds the words of the query side by side, shortest first.

    Candidates are joined by the query's first word, so names are not compared with every query.
    """
    q = queries.select("query_id", terms(F.col("task")).alias("q")).where(F.size("q") > 0).select("query_id", F.col("q")[0].alias("term"), F.concat(F.lit(" "), F.array_join("q", " "), F.lit(" ")).alias("phrase"))
    names = symbols.select("id", terms(F.col("name")).alias("t")).select("id", F.size("t").alias("n"), F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")).alias("text"), F.explode(F.array_distinct("t")).alias("term"))
    hits = names.join(q, "term").where(F.col("text").contains(F.col("phrase")))
    w = Window.partitionBy("query_id").orderBy("n", "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "id", "rank")
