"""Observation memory."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators import blocks
from codeweft.plans.materialize import materialize

#: Kinds of observations that are made by the engine itself.
AUTOMATIC = ("passive", "dead_end", "file_thrash", "auto")
#: Days until an observation expires, by kind; other kinds do not.
TTL_DAYS = {"manual": 7, "passive": 7, "dead_end": 7, "file_thrash": 7, "insight": 90, "auto": 90}
#: Categories of change in the order of their weight.
CATEGORIES = ("new_symbol", "deleted_symbol", "signature_change", "dependency_added", "body_change")
COMPRESS_FROM = 3
THRASH_EDITS, THRASH_SECONDS = 4, 300
SIMILAR, LEAST_SIMILAR = 20, 0.3
#: Words that a search by words compares with all observations at once.
MOST_WORDS = 100_000


def live(obs: DataFrame, now: dt.datetime) -> DataFrame:
    """not expired at ``now``."""
    return obs.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))


def prune(obs: DataFrame, now: dt.datetime) -> DataFrame:
    """M8: what a pruning at ``now`` removes."""
    return obs.where(F.col("expires_at") <= F.lit(now))


def with_ttl(obs: DataFrame, auto_days: int = 7, manual_days: int | None = None) -> DataFrame:
    """M1: ``expires_at`` by kind: automatic kinds after ``auto_days``, manual and insight after ``manual_days`` (never if
    None), summaries and consolidations after ``manual_days`` or 90."""
    days = F.when(F.col("kind").isin(*AUTOMATIC), F.lit(auto_days)).when(F.col("kind").isin("manual", "insight"), F.lit(manual_days).cast("int")).otherwise(F.lit(manual_days if manual_days is not None else 90))
    return obs.withColumn("expires_at", F.when(days.isNotNull(), F.col("created_at") + F.make_dt_interval(days)))


def delete(obs: DataFrame, keys: DataFrame) -> DataFrame:
    """The observations without those of the ids ``keys`` (``id``)."""
    return obs.join(keys.select("id").distinct(), "id", "left_anti").select(*obs.columns)


def mark_stale(obs: DataFrame, symbols: DataFrame) -> DataFrame:
    """M4: ``obs`` with ``is_stale`` set where the stored hash is not the hash of any symbol of that name. Null hashes and
    unknown symbols stay as they are."""
    now = symbols.where("fqn IS NOT NULL AND content_hash IS NOT NULL").select(F.col("fqn").alias("__f"), F.lower("content_hash").alias("__h")).distinct()
    known = now.select("__f").distinct().withColumn("__known", F.lit(True))
    same = now.withColumn("__same", F.lit(True))
    j = obs.join(known, F.col("symbol_fqn") == F.col("__f"), "left").drop("__f").join(same, (F.col("symbol_fqn") == F.col("__f")) & (F.lower("symbol_hash") == F.col("__h")), "left")
    stale = F.coalesce("is_stale", F.lit(False)) | (F.coalesce("__known", F.lit(False)) & F.col("symbol_hash").isNotNull() & F.col("__same").isNull())
    return j.withColumn("is_stale", stale).drop("__f", "__h", "__known", "__same")


def staleness(obs: DataFrame, now: dt.datetime) -> DataFrame:
    """Percentage of stale among live observations, 0 if there are none."""
    return live(obs, now).agg(F.count(F.lit(1)).alias("n_live"), F.coalesce(F.round(100.0 * F.avg(F.coalesce("is_stale", F.lit(False)).cast("int")), 4), F.lit(0.0)).alias("stale_pct"))


def to_compress(obs: DataFrame, now: dt.datetime, least: int = COMPRESS_FROM) -> DataFrame:
    """A10: symbols with at least three live observations that are neither summaries nor consolidations."""
    return live(obs, now).where("symbol_fqn IS NOT NULL AND kind NOT IN ('summary', 'consolidated')").groupBy("symbol_fqn").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def compress(obs: DataFrame, now: dt.datetime, least: int = COMPRESS_FROM) -> DataFrame:
    """M9: ``symbol_fqn``, ``n``, ``content``, ``symbol_hash``: the summaries that replace the live observations of the symbols
    of A10 (all but summaries). Popular symbols are combined on the map side: only the latest row and a count travel."""
    due = to_compress(obs, now, least).select("symbol_fqn")
    rows = live(obs, now).where("symbol_fqn IS NOT NULL AND kind <> 'summary'")
    key = F.struct("created_at", "id")
    g = rows.groupBy("symbol_fqn").agg(F.count(F.lit(1)).alias("n"), F.max_by("content", key).alias("last"), F.max_by("symbol_hash", key).alias("symbol_hash")).where(F.col("n") >= least)
    text = F.concat(F.lit("[summary of "), F.col("n").cast("string"), F.lit(" observations] "), F.coalesce("last", F.lit("")))
    return g.join(due, "symbol_fqn", "left_semi").select("symbol_fqn", "n", text.alias("content"), "symbol_hash")


def recent(obs: DataFrame, now: dt.datetime, limit: int = 50) -> DataFrame:
    """The latest live observations (a top-k report)."""
    return live(obs, now).orderBy(F.desc("created_at"), "id").limit(limit)


def per_session(obs: DataFrame, now: dt.datetime) -> DataFrame:
    """Live and stale observations per session and the latest time."""
    return live(obs, now).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("is_stale", F.lit(False)).cast("long")).alias("n_stale"), F.max("created_at").alias("last_at"))


def search(obs: DataFrame, queries: DataFrame, now: dt.datetime, limit: int = 10) -> DataFrame:
    """``query_id``, ``place``, ``id``, ``score``: observations by the number of query words in content or symbol name.

    Words match anywhere, in any case; observations without a match are left out. The words of all queries are compared with
    every observation, MOST_WORDS at most (more raise an error); each task keeps its best per query.
    """
    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "")
    q = materialize(queries.select("query_id", F.explode(words).alias("word")), "words")
    if q.limit(MOST_WORDS + 1).count() > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    text = live(obs, now).select("id", "created_at", F.lower(F.coalesce("content", F.lit(""))).alias("c"), F.lower(F.coalesce("symbol_fqn", F.lit(""))).alias("f"))
    hits = text.join(F.broadcast(q), F.col("c").contains(F.col("word")) | F.col("f").contains(F.col("word")))  # typed words only
    scored = hits.groupBy("query_id", "id", "created_at").agg(F.count(F.lit(1)).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("created_at"), "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query_id", "place", "id", "score")


def thrash(edits: DataFrame, least: int = THRASH_EDITS, seconds: int = THRASH_SECONDS) -> DataFrame:
    """M5: the edits (``path``, ``ts``) that are at least the fourth of their path within five minutes: ``path``, ``ts``, ``n``.

    A path edited by a third of all rows is one window partition; the frame needs its order, and rows pass it as a stream.
    """
    w = Window.partitionBy("path").orderBy(F.col("us")).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    e = edits.where("path IS NOT NULL AND ts IS NOT NULL").select("path", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= least).select("path", "ts", "n")


def dead_ends(changes: DataFrame) -> DataFrame:
    """M6: ``session_id``, ``fqn``, ``added_at``, ``removed_at``: symbols added and later removed in one session.

    ``changes`` has ``session_id``, ``fqn``, ``action`` (add, remove), ``ts``. The first addition and the first removal after it
    count, found by one aggregation instead of a self-join."""
    first = changes.where("action = 'add'").groupBy("session_id", "fqn").agg(F.min("ts").alias("added_at"))
    gone = changes.where("action = 'remove'").select("session_id", "fqn", "ts")
    return first.join(gone, ["session_id", "fqn"]).where(F.col("ts") > F.col("added_at")).groupBy("session_id", "fqn", "added_at").agg(F.min("ts").alias("removed_at"))


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """M2: ``file_path``, ``fqn``, ``category`` of every symbol that differs between two states of a table.

    Of several rows with one fqn the last (by id) counts."""
    one = lambda df: df.where("fqn IS NOT NULL").groupBy("fqn").agg(F.max_by(F.struct("file_path", "kind", "signature", "body"), "id").alias("s"))
    j = one(old).withColumnRenamed("s", "o").join(one(new).withColumnRenamed("s", "n"), "fqn", "full_outer")
    kind = (
        F.when(F.col("o").isNull() & (F.col("n.kind") == "import"), "dependency_added")
        .when(F.col("o").isNull(), "new_symbol")
        .when(F.col("n").isNull(), "deleted_symbol")
        .when(~F.col("o.signature").eqNullSafe(F.col("n.signature")), "signature_change")
        .when(~F.col("o.body").eqNullSafe(F.col("n.body")), "body_change")
    )
    return j.select(F.coalesce("n.file_path", "o.file_path").alias("file_path"), "fqn", kind.alias("category")).where("category IS NOT NULL")


def passive_notes(diff: DataFrame) -> DataFrame:
    """M3: ``file_path``, ``category``, ``n``, ``content``: one note per file, of its weightiest category.

    Up to three names are listed, else the first two and how many there are. Only the three smallest names of a file and
    category and a count travel, so a file with very many changes is no problem."""
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(CATEGORIES) for x in (c, i)])
    w = Window.partitionBy("file_path", "category").orderBy("fqn")
    top = diff.withColumn("r", F.row_number().over(w)).where("r <= 3")
    names = top.groupBy("file_path", "category").agg(F.array_sort(F.collect_list("fqn")).alias("names"))
    counts = diff.groupBy("file_path", "category").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("file_path").agg(F.min_by("category", rank[F.col("category")]).alias("category"))
    j = counts.join(best, ["file_path", "category"]).join(names, ["file_path", "category"])
    listed = F.when(F.col("n") <= 3, F.array_join("names", ", ")).otherwise(F.concat(F.array_join(F.slice("names", 1, 2), ", "), F.lit(", … ("), F.col("n").cast("string"), F.lit(" total)")))
    return j.select("file_path", "category", "n", F.concat(F.col("category"), F.lit(" in "), F.col("file_path"), F.lit(": "), listed).alias("content"))


def suppress_repeats(log: DataFrame, minutes: int = 30) -> DataFrame:
    """M7: ``task``, ``id`` of the rows that are recorded when a task is skipped within 30 minutes of its last *recorded* row.

    Greedy and in order: the rows of a partition are sorted by task and time and pass as a stream, of which one time per task
    is held, so a task with very many runs is never a row or a group in memory."""
    gap = minutes * 60 * 1_000_000
    rows = log.where("task IS NOT NULL AND timestamp IS NOT NULL").select("task", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("t"), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, last = None, 0
        for pdf in batches:
            keep = []
            for name, t in zip(pdf["task"], pdf["t"].to_numpy()):
                fresh = name != task or t - last >= gap
                task, last = name, t if fresh else last
                keep.append(fresh)
            yield pdf.loc[keep, ["task", "id"]]

    kind = log.schema["id"].dataType.simpleString()
    return rows.repartition("task").sortWithinPartitions("task", "t", "id").mapInPandas(run, f"task string, id {kind}")


def rank_similar(obs: DataFrame, limit: int = SIMILAR, least: float = LEAST_SIMILAR) -> DataFrame:
    """``query_id``, ``place``, ``id``, ``similarity`` of observations with ``query_id`` and ``similarity``: at least
    ``least``, best first."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return obs.where(F.col("similarity") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query_id", "place", "id", "similarity")


def pool(obs: DataFrame, now: dt.datetime, limit: int = SIMILAR) -> DataFrame:
    """The live observations that are compared with a task: the latest ``3 * limit``, 30 at least (a top-k report)."""
    return recent(obs, now, max(3 * limit, 30))


def for_tasks(obs: DataFrame, queries: DataFrame, now: dt.datetime, limit: int = SIMILAR, similarity: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``place`` and the columns of the observations that go with each task: by ``similarity`` (``query_id``, ``id``,
    ``similarity``) if there is one, else the latest ``limit`` for every task."""
    cols = ["id", "content", "created_at", "symbol_fqn", "is_stale"]
    if similarity is not None:
        return rank_similar(similarity, limit).join(live(obs, now).select(*cols), "id").select("query_id", "place", *cols)
    last = recent(obs, now, limit).select(*cols).withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")))  # limit rows
    return queries.select("query_id").crossJoin(F.broadcast(last)).select("query_id", "place", *cols)


def session_lines(obs: DataFrame, detail: str = "L2", symbols: DataFrame | None = None) -> DataFrame:
    """``id``, ``line``: an observation as text. L1: headline of 80 characters; L2: kind and the whole text; L3: also the
    symbol, with its signature and first 20 lines if ``symbols`` are given."""
    if detail == "L3" and symbols is not None:
        text = F.array_join(F.slice(F.split("body", "\n"), 1, 20), "\n")
        snippet = F.concat(F.lit("\n"), F.trim("signature"), F.lit("\n"), text)
        first = symbols.where("fqn IS NOT NULL AND body IS NOT NULL").groupBy("fqn").agg(F.min_by(F.struct(F.coalesce("signature", F.lit("")).alias("signature"), "body"), "id").alias("s"))
        known = first.select(F.col("fqn").alias("symbol_fqn"), "s.*").select("symbol_fqn", snippet.alias("snippet"))
        plain = session_lines(obs, "L3")
        more = obs.select("id", "symbol_fqn").join(known, "symbol_fqn").select("id", "snippet")
        return plain.join(more, "id", "left").select("id", F.concat("line", F.coalesce("snippet", F.lit(""))).alias("line"))
    body = F.coalesce("content", F.lit(""))
    head = F.when(F.octet_length(body) > 80, F.concat(F.left(body, F.lit(80)), F.lit("…"))).otherwise(body)
    flag = F.when(F.coalesce("is_stale", F.lit(False)), F.lit(" [stale]")).otherwise(F.lit(""))
    full = F.concat(F.lit("["), F.coalesce("kind", F.lit("manual")), F.lit("] "), body, flag)
    line = {"L1": head, "L2": full, "L3": F.concat(full, F.when(F.col("symbol_fqn").isNotNull(), F.concat(F.lit(" @ "), F.col("symbol_fqn"))).otherwise(F.lit("")))}[detail]
    return obs.select("id", line.alias("line"))


CLUSTERS = "leader string, n int, members array<string>, content string"


def merge_texts(contents: list[str]) -> str:
    """One text for a cluster: the distinct queries and pivots of ``Agent queried: "q" — pivots: a, b`` rows in order; other rows
    whole."""
    import re

    queries, pivots, rest = {}, {}, {}
    for c in contents:
        m = re.match(r'Agent queried: "(.*)" — pivots: (.*)$', c or "", re.S)
        if m:
            queries[m.group(1)] = True
            pivots.update({p.strip(): True for p in m.group(2).split(",") if p.strip()})
        elif c:
            rest[c] = True
    out = []
    if queries:
        out.append("Agent queried: " + "; ".join(f'"{q}"' for q in queries) + (" — pivots: " + ", ".join(pivots) if pivots else ""))
    return "\n".join([*out, *rest])


def consolidate(obs: DataFrame, now: dt.datetime, threshold: float = 0.92) -> DataFrame:
    """``leader``, ``n``, ``members``, ``content``: clusters of live automatic observations (``id``, ``session_id``, ``content``,
    ``created_at``, ``kind``, ``expires_at``, ``embedding``) by greedy leaders in the order of time; clusters of one stay out.

    Observations of all sessions meet in blocks. Rows with the same vector are one node, the earliest of them: they have the same links, so
    they share a cluster. A node without an earlier link is a leader and takes what it links to; what is left is decided in the next
    round. Then every other row goes to the earliest leader that it links to.
    """
    late = F.lit(2**63 - 1)
    rows = live(obs, now).where("kind IN ('auto', 'passive') AND embedding IS NOT NULL").select("id", "content", F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), late).alias("t"), "embedding")
    rows = materialize(rows.where(F.exists("embedding", lambda x: x != 0)), "rows")
    node = materialize(rows.groupBy("embedding").agg(F.min(F.struct("t", "id")).alias("x")).select("x.t", "x.id", "embedding"), "node")
    link = materialize(blocks.links(node, threshold), "links")
    open_, members = link, node.select("id").where("false")
    while not open_.isEmpty():
        lead = open_.select(F.col("a").alias("id")).distinct().join(open_.select(F.col("b").alias("id")), "id", "left_anti")
        taken = materialize(open_.join(lead, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct(), "taken")
        members = members.unionByName(taken)
        rest = open_.join(taken, F.col("a") == F.col("id"), "left_anti").join(taken, F.col("b") == F.col("id"), "left_anti")
        open_ = materialize(rest, "open")
    # who was not taken leads, also where the last of its links fell to a leader that was known sooner
    order = node.select(F.col("id").alias("a"), F.struct("t", "id").alias("x"))
    to = link.join(members, F.col("a") == F.col("id"), "left_anti").join(order, "a").groupBy(F.col("b").alias("id")).agg(F.min("x").alias("x")).select("id", F.col("x.id").alias("leader"))
    own = node.select("id").join(to, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))
    placed = rows.join(node.select("embedding", F.col("id").alias("node")), "embedding").join(own.withColumnRenamed("id", "node"), "node")
    merged = F.udf(merge_texts, "string", useArrow=False)
    g = placed.groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("t", "id", "content"))).alias("m")).where(F.size("m") > 1)
    return g.select("leader", F.size("m").alias("n"), F.col("m.id").alias("members"), merged("m.content").alias("content"))
