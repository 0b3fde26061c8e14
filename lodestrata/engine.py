"""The engine's verbs over a store: ingest, ask, list, delete."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .functions import text
from .operators import chunking, context, facts, ground, library, rank, routing, structure
from .operators.postings import Postings
from .plugins import Plugins
from .scope import Scope
from .sources.shared import forget, settled
from .sources.store import Store

# What a table has before anything is written to it.
EMPTY = {
    "chunks": "chunk_id string, user_id string, source string, page int, page_end int, chunk_index int, parent_id string, section_title string, text string, has_table boolean, tokens int, prev_id string, next_id string, embedding array<double>",
    "parents": "parent_id string, user_id string, source string, page int, page_end int, parent_index int, section_title string, text string, has_table boolean, tokens int",
    "hashes": "user_id string, source string, content_hash string",
    "sessions": "session_id string, user_id string, title string, summary string, last_document string, created_at timestamp",
    "messages": "user_id string, session_id string, seq int, role string, content string, created_at timestamp",
    "runs": "user_id string, run_id string, id string, category string, similarity double, passed boolean",
}

# Fixed value: what is said where the documents hold no answer.
REFUSAL = "I don't know based on the available documents."


class Engine:
    """All reads and writes of one user. Every verb takes and gives DataFrames; questions come in batches."""

    def __init__(self, spark: SparkSession, root: str, user_id: str, config: EngineConfig | None = None, plugins: Plugins | None = None):
        self.spark, self.store, self.scope = spark, Store(spark, root), Scope(user_id)
        self.config, self.plugins = config or EngineConfig(), plugins or Plugins()
        # an index of this user's chunks alone: nobody else's rows, counts or lengths are in it
        self.index = Postings(spark, f"{self.store.root}/_postings/{hashlib.sha256(user_id.encode()).hexdigest()}")

    def _table(self, name: str) -> DataFrame | None:
        df = self.store.read(name)
        return None if df is None else self.scope.apply(df)

    def _present(self, name: str) -> DataFrame:
        """The table, without rows before its first write."""
        df = self._table(name)
        return self.spark.createDataFrame([], EMPTY[name]) if df is None else df

    def chunk(self, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Parents and chunks of pages (source, page, text): sections by headings, packed to the token limits, linked."""
        lines = pages.select("source", "page", F.posexplode(F.split(text.clean_text(F.col("text")), "\n")).alias("line_no", "line")).filter(text.strip(F.col("line")) != "")
        lines = lines.select("source", "page", "line", (F.col("page").cast("long") * 1_000_000 + F.col("line_no")).alias("block_no"))
        marked = structure.carry_forward(lines, "source", "block_no", text.is_heading(F.col("line")), F.struct(F.col("block_no").alias("at"), F.col("line").alias("title")))
        keyed = marked.select("source", "page", "block_no", "line", F.coalesce("section.at", F.lit(-1).cast("long")).alias("section_no"), F.coalesce("section.title", F.lit("")).alias("section_title"))
        titles = keyed.groupBy("source", "section_no").agg(F.first("section_title").alias("section_title"))
        cfg = self.config
        parents, children = chunking.chunks(chunking.blocks_of(keyed, "source", "block_no"), "source", "section_no", "block_no", cfg.child_tokens, cfg.child_overlap, cfg.parent_tokens)
        mine = F.lit(self.scope.user_id)
        parent_id = F.sha2(F.concat_ws("|", mine, "source", F.lit("parent"), "parent_index"), 256)
        index_id = lambda c: F.when(F.col(c).isNotNull(), F.sha2(F.concat_ws("|", mine, "source", c), 256))
        parents = parents.join(titles, ["source", "section_no"]).select(parent_id.alias("parent_id"), mine.alias("user_id"), "source", "page", "page_end", "parent_index", "section_title", "text", "has_table", "tokens")
        children = children.join(titles, ["source", "section_no"]).select(
            index_id("chunk_index").alias("chunk_id"), mine.alias("user_id"), "source", "page", "page_end", "chunk_index", parent_id.alias("parent_id"), "section_title", "text", "has_table", "tokens",
            index_id("prev_index").alias("prev_id"), index_id("next_index").alias("next_id"),
        )
        return parents, children

    def ingest(self, pages: DataFrame) -> DataFrame:
        """Takes in pages (source, page, text); unchanged sources are skipped. Gives source and status of all that were taken in."""
        whole = pages.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\f").alias("text"))
        hashed = library.content_hash(whole).select("source", "content_hash").withColumn("user_id", F.lit(self.scope.user_id))
        known = self._table("hashes")
        fresh = hashed if known is None else hashed.join(known.select("source", "content_hash"), ["source", "content_hash"], "left_anti")
        fresh = fresh.persist()
        try:
            if fresh.take(1):
                parents, new = self.chunk(pages.join(fresh.select("source"), "source", "left_semi"))
                crumb = chunking.breadcrumb(F.lit(None).cast("string"), F.col("section_title"))
                new = settled(new.withColumn("embedding", self.plugins.embed(F.concat_ws("\n\n", F.nullif(crumb, F.lit("")), "text"))))
                old = settled(self._present("chunks").join(fresh.select("source"), "source", "left_semi").select("source", "chunk_id", "text", "section_title"))
                gone = fresh.select("user_id", "source")
                self.store.replace("parents", parents, ["user_id", "source"], also=gone)
                self.store.replace("chunks", new, ["user_id", "source"], also=gone)
                self.index.update(new, old, labels=["section_title"])
                forget(new, old)
                self.store.replace("hashes", fresh, ["user_id", "source"])
        finally:
            fresh.unpersist()
        # versions of a table don't change, so what was taken in is read from the two, whatever is written later
        now = self._table("hashes")
        if now is None:
            return self.spark.createDataFrame([], "source string, status string")
        taken = now if known is None else now.join(known.select("source", "content_hash"), ["source", "content_hash"], "left_anti")
        return taken.select("source", F.lit("ingested").alias("status"))

    def ingest_table(self, rows: DataFrame, table_id: str, entity: str, columns: dict[str, str], order: str, title: str) -> None:
        cells = facts.cells(rows, table_id, entity, columns, order, title, self.config.cell_cap).withColumn("user_id", F.lit(self.scope.user_id))
        self.store.replace("cells", cells, ["user_id", "table_id"], also=self.spark.createDataFrame([(self.scope.user_id, table_id)], "user_id string, table_id string"))

    def retrieve(self, questions: DataFrame, k: int = 20) -> DataFrame:
        """query_id, chunk_id, fused and where it stands in both lists, from the documents that questions are routed to."""
        chunks = self._table("chunks")
        asked = questions.withColumn("vector", self.plugins.embed(F.col("text")))
        dense = rank.knn(chunks, asked.select("query_id", "vector"), "chunk_id", self.config.routing_sample).select("query_id", F.lit("dense").alias("list"), "chunk_id", "rank")
        keyword = self.index.search(questions, self.config.routing_sample).select("query_id", F.lit("keyword").alias("list"), "chunk_id", "rank")
        pool = rank.fuse(dense.unionByName(keyword), "chunk_id", self.config.rrf_k).join(chunks.select("chunk_id", "source"), "chunk_id")
        chosen = rank.gate(rank.score_documents(pool, "chunk_id", top_chunks=self.config.routing_top_chunks), self.config.gate_ratio)
        inside = pool.join(chosen.select("query_id", "source"), ["query_id", "source"], "left_semi")
        spare = rank.reserve(pool, chosen, "chunk_id", self.config.reserve_slots)
        return rank.top(inside.unionByName(spare.drop("rank")), ["query_id"], [F.desc("fused"), "chunk_id"], k)

    def plan(self, questions: DataFrame) -> DataFrame:
        """Kind and retrieval profile of each question."""
        return routing.plans(questions)

    def ask(self, questions: DataFrame, k: int = 4) -> DataFrame:
        """query_id, fact, answer, action, citations for questions (query_id, text).

        Figures and codes of an answer must stand in what it is based on: units that hold others
        are pruned, or named in a note where pruning would lose what is supported, and an answer of
        which nothing is left is withdrawn (``action`` says which).
        """
        if not self.index.exists():
            nothing = "array<struct<citation_no:int,source:string,page:int,section:string,snippet:string>>"
            return questions.select("query_id", F.lit(None).cast("string").alias("fact"), F.lit(REFUSAL).alias("answer"), F.lit("refused").alias("action"), F.lit(None).cast(nothing).alias("citations"))
        chunks, cells = self._table("chunks"), self._table("cells")
        hits = self.retrieve(questions, k).join(chunks.select("chunk_id", "page", "section_title", "text", "tokens"), "chunk_id")
        kept = context.fill(hits, "query_id", "rank", "tokens", self.config.context_tokens)
        asked = questions.select("query_id", F.col("text").alias("question"))
        used = settled(kept.join(asked, "query_id").withColumn("relevance", self.plugins.rerank(F.col("question"), F.col("text"))).filter("relevance > 0"))
        quoted = ground.citations(used.withColumnRenamed("section_title", "section"), "query_id", "rank")
        gathered = quoted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation_no", "source", "page", "section", "snippet"))).alias("citations"))
        out = asked.join(gathered, "query_id", "left")
        if cells is not None:
            found = facts.ask(questions, cells, self.config.fact_fire, self.config.fact_trust, self.config.filter_cap)
            said = F.when(F.col("verdict") == "confident", F.concat_ws(" — ", "entity", "column", "value"))
            out = out.join(found.select("query_id", said.alias("fact")), "query_id", "left")
        else:
            out = out.withColumn("fact", F.lit(None).cast("string"))
        answer = self.plugins.generate(F.col("fact"), F.transform(F.coalesce("citations", F.array()), lambda c: c["snippet"]))
        out = settled(out)
        said = out.select("query_id", "fact", F.when(F.length(answer) > 0, answer).otherwise(F.lit(REFUSAL)).alias("text"), "citations")
        sources = used.select("query_id", "text").unionByName(out.filter("fact IS NOT NULL").select("query_id", F.col("fact").alias("text")))
        bad = ground.unsupported(said.select("query_id", "text"), sources, "query_id").groupBy("query_id").agg(F.array_sort(F.collect_set("claim")).alias("claims"))
        verdicts = ground.verdicts(said.select("query_id", "text"), sources, "query_id", judged=bad)
        final = ground.enforce(said.select("query_id", "text"), sources, verdicts, "query_id", REFUSAL).select("query_id", F.col("text").alias("answer"), "action")
        return said.select("query_id", "fact", "citations").join(final, "query_id").select("query_id", "fact", "answer", "action", "citations")

    def documents(self) -> DataFrame:
        return library.document_list(self._present("hashes").select("source"), self._present("chunks"), "source")

    def delete(self, sources: list[str]) -> None:
        gone = self.spark.createDataFrame([(self.scope.user_id, s) for s in sources], "user_id string, source string")
        if self.index.exists():
            old = settled(self._present("chunks").join(gone.select("source"), "source", "left_semi").select("source", "chunk_id", "text", "section_title"))
            self.index.update(old.limit(0), old, labels=["section_title"])
            forget(old)
        self.store.delete_document(["chunks", "parents", "hashes"], gone, ["user_id", "source"])

    # ------------------------------------------------------------ sessions

    def start_session(self, title: str = "") -> str:
        """A new session's id."""
        session = uuid.uuid4().hex
        row = self.spark.range(1).select(F.lit(session).alias("session_id"), F.lit(self.scope.user_id).alias("user_id"), F.lit(title).alias("title"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("last_document"), F.date_trunc("second", F.current_timestamp()).alias("created_at"))
        self.store.replace("sessions", row, ["user_id", "session_id"])
        return session

    def say(self, messages: DataFrame) -> None:
        """Appends messages (session_id, seq, role, content) to sessions of this user; others' are left out."""
        own = self._table("sessions")
        if own is None:
            return
        new = messages.withColumn("user_id", F.lit(self.scope.user_id)).withColumn("created_at", F.date_trunc("second", F.current_timestamp()))
        allowed = new.join(own.select("session_id"), "session_id", "left_semi").select("user_id", "session_id", "seq", "role", "content", "created_at")
        self.store.replace("messages", allowed, ["user_id", "session_id", "seq"])

    def sessions(self, most: int | None = None) -> DataFrame:
        """Sessions of this user, the last active first."""
        own, said = self._present("sessions"), self._present("messages")
        return library.sessions(own, said, most)

    def messages(self, session: str) -> DataFrame:
        """A session's messages in order."""
        own, said = self._present("sessions").filter(F.col("session_id") == session), self._present("messages")
        return library.session_messages(said, own, self.scope.user_id)

    def remember(self, session: str, summary: str | None = None, last_document: str | None = None) -> None:
        """Sets what is given of a session's memory and leaves the rest."""
        own = self._present("sessions").filter(F.col("session_id") == session)
        change = own.select("session_id", "user_id", F.lit(summary).cast("string").alias("summary"), F.lit(last_document).cast("string").alias("last_document"))
        changed = library.update_sessions(own, change, ["summary", "last_document"])
        self.store.replace("sessions", changed, ["user_id", "session_id"])

    def end_session(self, session: str) -> None:
        """Deletes a session with its messages."""
        gone = self._present("sessions").filter(F.col("session_id") == session).select("user_id", "session_id")
        said = self._table("messages")
        if said is not None:
            self.store.delete("messages", said.join(gone, ["user_id", "session_id"], "left_semi").select("user_id", "session_id", "seq"), ["user_id", "session_id", "seq"])
        self.store.delete("sessions", gone, ["user_id", "session_id"])

    # ------------------------------------------------------------ evaluation

    def record_run(self, results: DataFrame, modes: DataFrame, threshold: float = 0.75) -> str:
        """Scores results (see ``library.scored``), keeps them as a run and gives its id."""
        run = self.spark.range(1).select(library.run_id(F.current_timestamp()).alias("r")).first()["r"] + "-" + uuid.uuid4().hex[:6]
        rows = library.scored(results, modes, threshold).withColumn("user_id", F.lit(self.scope.user_id)).withColumn("run_id", F.lit(run))
        self.store.replace("runs", rows, ["user_id", "run_id"])
        return run

    def runs(self) -> DataFrame:
        """Totals of every run of this user, the newest first."""
        return library.summary(self._present("runs"), ["run_id"]).orderBy(F.desc("run_id"))

    def run_results(self, run: str | None = None) -> DataFrame:
        """Results of a run, of the latest one if none is named."""
        rows = self._present("runs")
        wanted = library.latest_runs(rows.select("user_id", "run_id").distinct()).select("run_id") if run is None else self.spark.createDataFrame([(run,)], "run_id string")
        return rows.join(wanted, "run_id", "left_semi")

    def by_category(self, run: str | None = None) -> DataFrame:
        return library.weakest_first(library.summary(self.run_results(run), ["category"]))

    def failures(self, run: str | None = None) -> DataFrame:
        return self.run_results(run).filter(~F.col("passed"))

    def calibration(self, run: str | None = None) -> DataFrame:
        return library.calibration(self.run_results(run), "passed")

    def delete_run(self, run: str) -> None:
        self.store.delete("runs", self.spark.createDataFrame([(self.scope.user_id, run)], "user_id string, run_id string"), ["user_id", "run_id"])

    def stats(self) -> DataFrame:
        return library.collection_stats(self._present("chunks"))

