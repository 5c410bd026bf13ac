"""The engine as one object: every call takes tables in and gives a lazy DataFrame (or text where a person reads it)."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft import config as settings
from codeweft.functions import anchors as A
from codeweft.functions.text import embedding_text
from codeweft.operators import blocks, capsule, diff, enrich, graph, memory, ranking, stats, store
from codeweft.plans import pipeline
from codeweft.plans.materialize import materialize
from codeweft.sources import extract as X
from codeweft.sources import tables as T
from codeweft.streaming import changes as C

_TABLES = ("symbols", "edges", "library_symbols", "files", "observations", "query_log")


class Engine:
    """A workspace: its tables in a folder of Parquet tables, its settings, and the index over them."""

    def __init__(self, spark: SparkSession, folder: str, conf: settings.Config | None = None, embedder: enrich.Embedder | None = None) -> None:
        self.spark, self.folder, self.conf, self.embedder = spark, folder.rstrip("/"), conf or settings.load(folder), embedder
        self._index: pipeline.Index | None = None
        self._vectors: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        if name not in _TABLES:
            raise ValueError(f"no table {name}")
        return T.table(self.spark, self.folder, name)

    @property
    def symbols(self) -> DataFrame:
        return T.symbols(self.spark, self.folder)

    @property
    def nodes(self) -> DataFrame:
        return T.nodes(self.spark, self.folder)

    @property
    def index(self) -> pipeline.Index:
        """Links, centrality and families of the current state; built on first use."""
        if self._index is None:
            self._index = pipeline.Index.build(self.symbols, self.nodes, self.table("edges"), postings=True)
        return self._index

    @property
    def vectors(self) -> DataFrame:
        """``id``, ``embedding`` of all symbols, made on first use and kept until :meth:`refresh`. Needs an embedder."""
        if self.embedder is None:
            raise ValueError("no embedder")
        if self._vectors is None:
            c = F.col
            texts = self.symbols.where("kind IS NOT NULL AND NOT is_stub").select("id", embedding_text(c("kind"), c("language"), c("name"), c("signature"), c("docstring"), c("body")).alias("text"))
            self._vectors = materialize(enrich.embed(texts, "id", "text", self.embedder), "vectors")
        return self._vectors

    def refresh(self) -> None:
        """Forget what was built of the tables, after they were written."""
        self._index = self._vectors = None

    def save(self, **tables: DataFrame) -> None:
        """Write tables of the engine's folder by name; the index is built anew on the next use."""
        for name, df in tables.items():
            if name not in _TABLES:
                raise ValueError(f"no table {name}")
            store.save(df, self.folder, name)
        self.refresh()

    # ---- indexing

    def index_workspace(self, root: str, force: bool = False, write: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(symbols, edges, files) of a source tree. Files whose hash is known are not read again; edges are extracted anew over all
        symbols, so none is lost between runs. With ``write`` they take the place of the engine's tables."""
        from codeweft.operators import edges

        scan = materialize(X.scan(self.spark, root), "scan")
        old = self.symbols
        tracked = T.last_row(self.table("files"), "path", "indexed_at")
        stubs = X.scan_stubs(self.spark, root).select("path", "content", "content_hash")  # always read
        fresh = X.extract(store.to_read(scan, tracked, force).select("path", "content")).unionByName(X.extract(stubs.select("path", "content")).withColumn("is_stub", F.lit(True)))
        scan = scan.select("path", "content_hash").unionByName(stubs.select("path", "content_hash"))
        gone = store.gone(scan, tracked)
        kept = old.join(fresh.select("file_path").distinct(), "file_path", "left_anti").join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_anti")
        now = kept.unionByName(fresh, allowMissingColumns=True)
        if not write:
            return now, edges.extract(now), scan.select("path", "content_hash")
        files = scan.select("path", "content_hash").withColumn("indexed_at", F.current_timestamp().cast("timestamp_ntz"))
        now = materialize(now, "symbols")
        self.save(symbols=now, edges=edges.extract(now), files=files)
        return self.symbols, self.table("edges"), self.table("files")

    def submit_lsp_edges(self, pushed: DataFrame, write: bool = False) -> DataFrame:
        """The pushed edges with the ids of their names; with ``write`` those that are known join the edges, where the first of a
        pair and kind stays."""
        found = store.resolve_pushed(pushed, self.nodes)
        if write:
            found = materialize(found, "pushed")
            new = found.where("from_id IS NOT NULL AND to_id IS NOT NULL").select("from_id", "to_id", "kind", F.lit("pushed").alias("label"))
            self.save(edges=store.upsert(self.table("edges"), new, ["from_id", "to_id", "kind"], first_wins=True))
        return found

    def index_status(self) -> DataFrame:
        return stats.index_status(self.symbols, self.index.link, self.table("files").select("path").distinct(), T.observations(self.spark, self.folder))

    def apply_changes(self, changes: DataFrame, edits: DataFrame | None = None) -> None:
        """T4: put the changes of a batch (``path``, ``kind``, ``ts``, ``content``, one row per path) into the tables."""
        done = C.reindex_all(self.symbols, T.last_row(self.table("files"), "path", "indexed_at"), T.observations(self.spark, self.folder), changes, X.extract, edits, self.conf.auto_ttl_days)
        self.save(**{name: materialize(df, name) for name, df in done.items()})

    def watch(self, folder: str, checkpoint: str, interval: str | None = None):
        """Follow the change records in a folder; without ``interval`` what is there now. Returns the running query."""
        stream = C.read_changes(self.spark, folder)

        def batch(df: DataFrame, _: int) -> None:
            raw = materialize(df, "changes")  # read once, used as edits and as changes
            if not raw.isEmpty():
                self.apply_changes(C.last_per_path(raw), raw.select("path", F.col("ts").cast("timestamp_ntz").alias("ts")))

        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

    # ---- retrieval

    def _tasks(self, tasks: DataFrame | str, **filters: object) -> DataFrame:
        if not isinstance(tasks, str):
            return tasks
        row = {"query_id": 1, "task": tasks} | {k: v for k, v in filters.items() if v is not None}
        kinds = {"query_id": "bigint", "task": "string", "context": "string", "budget": "int", "language": "string", "file_hint": "string", "min_score": "double"}
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[k]}" for k in row))

    def select(self, tasks: DataFrame | str, **filters: object) -> pipeline.Selection:
        return pipeline.select(self.index, self._tasks(tasks, **filters), max_pivots=self.conf.max_pivots)

    def run_pipeline(self, tasks: DataFrame | str, context: str | None = None, budget: int | None = None, language: str | None = None, file_hint: str | None = None, min_score: float | None = None, now: dt.datetime | None = None, max_pivots: int | None = None) -> DataFrame:
        """``query_id``, ``markdown``: the capsule of each task. Observations expire at ``now``, the present by default."""
        q = pipeline.prepared(self._tasks(tasks, context=context, budget=budget, language=language, file_hint=file_hint, min_score=min_score))
        sel = pipeline.select(self.index, q, self._semantic(q), max_pivots=max_pivots or self.conf.max_pivots)
        full = materialize(capsule.pack_pivots(sel.pivots, self.index.symbols, q, self.conf.budget), "packed")
        brief = capsule.pack_adjacents(full, sel.adjacents, self.index.symbols, q, self.conf.budget)
        return capsule.render(full, brief, self.index.symbols, q, capsule.pack_memories(self._memories(q, now), q, self.conf.budget))

    def _semantic(self, q: DataFrame) -> DataFrame | None:
        """The best symbols of each task by the embedder, if there is one."""
        if self.embedder is None:
            return None
        asked = enrich.embed(q.select("query_id", "task"), "query_id", "task", self.embedder)
        return materialize(ranking.semantic_topk(self.vectors, asked), "semantic")

    def _memories(self, q: DataFrame, now: dt.datetime | None, limit: int = memory.SIMILAR) -> DataFrame:
        """Observations for each task. Without ``now`` none has expired."""
        obs, now = T.observations(self.spark, self.folder), now or dt.datetime.now()
        if self.embedder is None:
            return memory.for_tasks(obs, q, now, limit)
        a = enrich.embed(q.select("query_id", "task"), "query_id", "task", self.embedder)
        b = enrich.embed(memory.pool(obs, now, limit).select("id", "content"), "id", "content", self.embedder)
        return memory.for_tasks(obs, q, now, limit, blocks.nearest(b, a, limit, memory.LEAST_SIMILAR))

    get_context_capsule = run_pipeline

    def get_impact_graph(self, fqn: str, max_depth: int = 5, max_results: int = 100, include_tests: bool = True) -> DataFrame:
        """G7; raises LookupError with suggestions for an unknown name."""
        seed = self.nodes.where(F.col("fqn") == fqn).groupBy("fqn").agg(F.min("id").alias("id")).select("id")
        if not seed.limit(1).count():
            near = graph.suggestions(self.nodes, self.spark.createDataFrame([(fqn.split("::")[-1],)], "query string"))
            raise LookupError(f"no symbol {fqn}; similar: {', '.join(r.fqn for r in near.orderBy('place').collect())}")
        return graph.impact(self.index.link, self.nodes, self.index.cent, seed, max_depth, max_results, include_tests)

    def impact_text(self, fqn: str, **options: object) -> str:
        """:meth:`get_impact_graph` as text."""
        rows = capsule.render_impact(self.get_impact_graph(fqn, **options), self.index.symbols).collect()
        return "\n\n".join(r.markdown for r in rows) or f"## Impact graph: {fqn}\n\nTotal affected: 0"

    def get_skeleton(self, file_path: str, max_depth: int | None = None) -> DataFrame:
        return capsule.file_skeleton(self.symbols.where(F.col("file_path") == file_path), max_depth)

    def search_logic_flow(self, from_fqn: str, to_fqn: str) -> DataFrame:
        ids = self.nodes.where("fqn IS NOT NULL").groupBy("fqn").agg(F.min("id").alias("id"))
        a = ids.where(F.col("fqn") == from_fqn).select(F.col("id").alias("from_id"))
        b = ids.where(F.col("fqn") == to_fqn).select(F.col("id").alias("to_id"))
        return graph.shortest_paths(self.index.link, a.crossJoin(F.broadcast(b)))  # one row each

    def get_diff_capsule(self, text: str) -> DataFrame:
        hunk = diff.hunks(self.spark.createDataFrame([(1, text)], "diff_id int, diff string"))
        return diff.impact(diff.touched(hunk, self.index.symbols), self.index.link, self.index.symbols)

    def diff_capsule(self, text: str, now: dt.datetime | None = None, budget: int | None = None) -> DataFrame:
        """``query_id``, ``markdown``: what a diff changes, packed: changed symbols as they are, their callers and tests as outlines,
        and observations that mention the changed names."""
        roles = materialize(self.get_diff_capsule(text), "roles")
        return diff.packed(roles, self.index.symbols, T.observations(self.spark, self.folder), now or dt.datetime.now(), budget or self.conf.budget)

    def extract_anchors(self, text: str) -> DataFrame:
        t = F.col("text")
        return self.spark.createDataFrame([(text,)], "text string").select(A.anchors(t).alias("names"), A.module_paths(t).alias("modules"), A.frames(t).alias("frames"))

    # ---- memory and reports

    def get_session_context(self, now: dt.datetime, detail: str = "L2") -> DataFrame:
        return memory.session_lines(memory.recent(T.observations(self.spark, self.folder), now), detail)

    def search_memory(self, query: str, now: dt.datetime, max_results: int = 10) -> DataFrame:
        q = self.spark.createDataFrame([(1, query)], "query_id int, query string")
        return memory.search(T.observations(self.spark, self.folder), q, now, max_results)

    def save_observation(self, content: str, session_id: str, now: dt.datetime, symbol_fqn: str | None = None, kind: str = "manual", write: bool = False) -> DataFrame:
        """M1: the observations with a new row, of a key made of session, time and content; with ``write`` they are stored."""
        new = self.spark.createDataFrame([(content, session_id, now, symbol_fqn, kind)], "content string, session_id string, created_at timestamp_ntz, symbol_fqn string, kind string")
        new = new.withColumns({"id": F.sha2(F.concat_ws("/", "session_id", F.col("created_at").cast("string"), "content"), 256), "is_stale": F.lit(False)})
        new = memory.with_ttl(new, self.conf.auto_ttl_days, self.conf.manual_ttl_days)
        now_ = store.upsert(T.observations(self.spark, self.folder), new.withColumns({c: F.lit(None).cast("string") for c in ("agent_id", "symbol_hash", "change_category")}), ["id"])
        if not write:
            return now_
        self.save(observations=now_)
        return T.observations(self.spark, self.folder)

    def delete_observation(self, key: str) -> DataFrame:
        return T.observations(self.spark, self.folder).where(F.col("id") != key)

    def get_stats(self, now: dt.datetime, days: int = 30) -> dict[str, DataFrame]:
        log = stats.since(T.query_log(self.spark, self.folder), now, days)
        return {"usage": stats.usage(log, self.conf.token_usd_per_million), "latency": stats.latency(log), "intents": stats.shares(log, "intent"), "languages": stats.languages(log), "workspace": stats.workspace_savings(log, self.symbols)}

    def generate_module_docs(self, write_to: str | None = None) -> DataFrame:
        """A8; with ``write_to`` also one text file per directory below that folder (S19), written by the executors."""
        docs = stats.module_docs(self.symbols)
        if write_to:

            def write(rows) -> None:
                for r in rows:
                    os.makedirs(os.path.join(write_to, r.dir), exist_ok=True)
                    with open(os.path.join(write_to, r.dir, "MODULE.md"), "w", encoding="utf-8") as f:
                        f.write(f"# {r.dir}\n\n## Types\n{r.types}\n\n## Functions\n{r.functions}\n")

            docs.foreachPartition(write)
        return docs
