"""Change streams (T1-T6): file changes and edits as Structured Streaming, with event time so that results can be repeated.

A change is ``path``, ``kind`` (created, modified, removed), ``ts``, ``content``.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeweft.operators import edges, memory, store
from codeweft.operators.memory import THRASH_EDITS, THRASH_SECONDS
from codeweft.plans.materialize import materialize
from codeweft.sources.extract import SKIPPED

CHANGES = "path string, kind string, ts timestamp, content string"
#: Extensions that are watched.
WATCHED = ("py", "ts", "tsx", "js", "jsx", "mjs", "cjs", "sh", "bash", "zsh", "html", "rs", "swift", "sql", "md", "mdx", "pyi")


def watched(path: Column) -> Column:
    """whether changes of a path count: no hidden part, no build or package folder, a known extension."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED))
    return ~bad & F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*WATCHED)


def read_changes(spark: SparkSession, folder: str, fmt: str = "json", per_batch: int = 1000) -> DataFrame:
    """A stream of change records that a watcher drops as files."""
    return spark.readStream.format(fmt).schema(CHANGES).option("maxFilesPerTrigger", per_batch).load(folder).where(watched(F.col("path")))


def last_per_path(batch: DataFrame) -> DataFrame:
    """The last change of each path in a micro-batch."""
    return batch.groupBy("path").agg(F.max_by(F.struct("kind", "ts", "content"), F.struct("ts", "kind")).alias("s")).select("path", "s.*")


def start(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = "500 milliseconds"):
    """Run ``apply`` on the folded changes of every micro-batch; without ``interval`` what is there now, then stop."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: apply(last_per_path(df), n))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def reindex(symbols: DataFrame, changes: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """T4: (the symbol table after the changes, the symbols of the changed files before). Removed paths lose their rows."""
    touched = changes.select(F.col("path").alias("file_path")).distinct()
    before = symbols.join(touched, "file_path", "left_semi")
    fresh = extract(changes.where("kind <> 'removed' AND content IS NOT NULL").select("path", "content"))
    return symbols.join(touched, "file_path", "left_anti").unionByName(fresh, allowMissingColumns=True), before


def notes_of(kind: str, rows: DataFrame, days: int) -> DataFrame:
    """Observations (``id``, ``content``, ``kind``, ``created_at``, ``expires_at``, ``change_category``, ``is_stale``) of rows with
    ``content``, ``ts`` and ``category``; the id is a function of content and time, so a batch that is run twice writes them once."""
    new = rows.select("content", F.col("ts").cast("timestamp_ntz").alias("created_at"), F.col("category").alias("change_category"))
    new = new.withColumns({"kind": F.lit(kind), "is_stale": F.lit(False), "session_id": F.lit("watch")})
    return memory.with_ttl(new.withColumn("id", F.sha2(F.concat_ws("/", "kind", F.col("created_at").cast("string"), "content"), 256)), days)


def reindex_all(symbols: DataFrame, files: DataFrame, obs: DataFrame, changes: DataFrame, extract: Callable[[DataFrame], DataFrame], edits: DataFrame | None = None, auto_days: int = 7) -> dict[str, DataFrame]:
    """T4 as a whole: ``symbols``, ``edges``, ``files`` and ``observations`` after the folded ``changes`` of a batch.

    Symbols of changed files are read again and compared with what was there (M2); notes say per file what changed (M3) and which
    files are edited again and again (M5, from ``edits``: ``path``, ``ts``); observations whose symbols look different now are stale
    (M4); edges are extracted anew, so links between files that changed at different times stay. A removed file loses its symbols
    and its state, without a note.
    """
    now, before = reindex(symbols, changes, extract)
    now, before = materialize(now, "symbols"), materialize(before, "before")
    live = changes.where("kind <> 'removed'").select(F.col("path").alias("file_path"), "ts").distinct()
    after = now.join(live.select("file_path"), "file_path", "left_semi")
    found = memory.passive_notes(memory.symbol_diff(before.join(live.select("file_path"), "file_path", "left_semi"), after))
    notes = notes_of("passive", found.join(live, "file_path"), auto_days)
    if edits is not None:
        busy = memory.thrash(edits.join(live.select(F.col("file_path").alias("path")), "path", "left_semi")).groupBy("path").agg(F.max("ts").alias("ts"), F.max("n").alias("n"))
        said = F.concat(F.col("path"), F.lit(" was edited "), F.col("n").cast("string"), F.lit(" times within five minutes"))
        notes = notes.unionByName(notes_of("file_thrash", busy.select(said.alias("content"), "ts", F.lit(None).cast("string").alias("category")), auto_days))
    kept = memory.mark_stale(obs, now)
    state = changes.where("kind <> 'removed' AND content IS NOT NULL").select("path", F.sha2("content", 256).alias("content_hash"), F.col("ts").cast("timestamp_ntz").alias("indexed_at"))
    rest = files.join(changes.select("path").distinct(), "path", "left_anti").select("path", "content_hash", "indexed_at")
    missing = {c: F.lit(None).cast(obs.schema[c].dataType) for c in obs.columns if c not in notes.columns}
    return {"symbols": now, "edges": edges.extract(now), "files": rest.unionByName(state), "observations": store.upsert(kept, notes.withColumns(missing).select(*obs.columns), ["id"])}


def thrash_stream(edits: DataFrame, least: int = THRASH_EDITS, seconds: int = THRASH_SECONDS, late: str = "10 minutes") -> DataFrame:
    """T5: ``path``, ``ts``, ``n`` for every edit that is at least the fourth of its path within five minutes.

    State per path: the times of the last five minutes before the newest edit, nothing else; it is dropped when the watermark passes.
    Edits of a path are taken in the order of time within a micro-batch; one that is older than an earlier batch counts at its own time
    among what is still held.
    """
    span = pd.Timedelta(seconds=seconds)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [pd.Timestamp(t) for t in state.get[0]] if state.exists else []
        fresh = sorted(pd.Timestamp(t) for pdf in batches for t in pdf["ts"])
        out = []
        held = sorted(held)
        for t in fresh:  # in order, so a binary search finds what is within the span
            at = bisect.bisect_right(held, t)
            held.insert(at, t)
            n = at + 1 - bisect.bisect_right(held, t - span)
            if n >= least:
                out.append((key[0], t, n))
        newest = held[-1]
        held = sorted(h for h in held if h > newest - span)
        state.update(([h.to_pydatetime() for h in held],))
        state.setTimeoutTimestamp(max(int((newest + span).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["path", "ts", "n"])

    marked = edits.where("path IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy("path").applyInPandasWithState(step, "path string, ts timestamp, n long", "times array<timestamp>", "append", GroupStateTimeout.EventTimeTimeout)


def suppress_stream(log: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """``task``, ``ts`` of the rows that are recorded when a task is skipped within 30 minutes of its last recorded row. State per
    task: that row's time."""
    gap = pd.Timedelta(minutes=minutes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0]) if state.exists else None
        out = []
        for t in sorted(pd.Timestamp(t) for pdf in batches for t in pdf["ts"]):
            if last is None or t - last >= gap:
                last = t
                out.append((key[0], t))
        state.update((last.to_pydatetime(),))
        state.setTimeoutTimestamp(max(int((last + gap).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["task", "ts"])

    marked = log.where("task IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy("task").applyInPandasWithState(step, "task string, ts timestamp", "last timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def fold_batch(changes: DataFrame) -> DataFrame:
    """The batch form of T3 with the number of changes that were folded."""
    return changes.groupBy("path").agg(F.max_by("kind", F.struct("ts", "kind")).alias("kind"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
