"""The engine as one object: ingestion into tables, search, parents, conversations with evaluation, latency export.

Tables are Parquet under one folder that all executors share: ``documents``
(stem, version, path, format, text), ``parents``, ``children``, ``versions`` (which
version of a stem holds since when), ``stems`` (each version's checksum, dealt into buckets: what a batch brings is looked up in its stems' buckets only), ``tags``, ``registry`` (what became of each file), ``messages`` (conversations by thread), ``evaluations``. Each ingestion
writes one batch folder of each, parents before children and documents last, so
a batch that fails midway leaves documents that are tried again, and a stem
that is there is skipped. Files are read and parsed one by one: what is missing,
of an unknown format or can't be parsed is noted in the registry and skipped.
"""

from __future__ import annotations

import logging
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import config
from corvane.functions import text as T
from corvane.operators import chunking, dialogue, evaluation, retrieval
from corvane.operators import latency as L
from corvane.operators.index import HybridIndex
from corvane.operators.latency import Tracker, export_csv, export_json
from corvane.sources import documents as D
from corvane.sources import parsers
from corvane.storage import batches_of, cut, small

SCHEMAS = {
    "documents": "stem string, version int, path string, format string, text string, batch string",
    "parents": "parent_id string, stem string, version int, content string, metadata map<string,string>, batch string",
    "children": "id long, parent_id string, stem string, version int, child_idx int, content string, metadata map<string,string>, batch string",
    "versions": "stem string, version int, at timestamp, batch string",
    "stems": "stem string, version int, sha string, bucket int, batch string",
    "tags": "stem string, tag string, value string, at timestamp, batch string",
    "registry": "path string, stem string, format string, status string, error string, at timestamp, batch string",
    "messages": "thread_id string, seq long, role string, content string, bucket int, batch string",
    "evaluations": "timestamp string, question string, answer string, documents string, groundedness boolean, relevance boolean, retrieval_accuracy boolean, overall_score double, batch string",
}

#: Folders that stems, and threads, are dealt into by a hash.
BUCKETS = 16
#: Bytes of a file that is parsed; larger ones fail.
MOST_FILE_BYTES = 128 << 20
#: Files that a worker is handed at once.
FILES_AT_ONCE = 8

Grader = Callable[[Column, Column, Column], Column]
#: Hears which share of an ingestion is done, and what comes next.
Progress = Callable[[float, str], None]

#: Offline stand-ins: a column of question, answer and joined documents to a boolean for each metric.
GRADERS: dict[str, Grader] = {
    "groundedness": lambda q, a, d: evaluation.overlap_grade(a, d),
    "relevance": lambda q, a, d: evaluation.overlap_grade(q, a, 0.2),
    "retrieval_accuracy": lambda q, a, d: evaluation.overlap_grade(q, d),
}


def _bucket(stem: Column) -> Column:
    return F.pmod(F.crc32(stem), F.lit(BUCKETS)).cast("int")


def bucket_of(key: str) -> int:
    return zlib.crc32(key.encode()) % BUCKETS


def beginning(question: Column, content: Column) -> Column:
    """Offline stand-in for a language model: the best parent's beginning."""
    return T.cut_to(content, 200)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for path, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if content is None:
                out.append((path, name, None, f"more than {MOST_FILE_BYTES} bytes"))
                continue
            try:
                kind, text = parsers.parse(content, name)
                out.append((path, kind, text.encode("utf-8", "ignore").decode(), None))
            except ValueError as e:
                out.append((path, name, None, str(e)[:500]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 4, ["path", "format", "text", "error"])


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        graders: dict[str, Grader] | None = None,
        answer: Callable[[Column, Column], Column] = beginning,
        analysis: dialogue.Analysis | None = None,
        embed: retrieval.Embed = retrieval.hashed,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.graders, self.answer, self.analysis = graders or GRADERS, answer, analysis
        self.tracker = Tracker(spark, f"{self.root}/_latency")
        self.index = HybridIndex(spark, f"{self.root}/_index", embed)
        self.clear_session()

    # tables

    def table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def _add(self, name: str, rows: DataFrame, batch: str) -> None:
        """Writes a batch; one that is written again takes the place of the former."""
        parts = [c for c in ("bucket", "batch") if f"{c} " in SCHEMAS[name]]
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.root}/{name}")

    def current(self, name: str) -> DataFrame:
        """The rows of ``documents``, ``parents`` or ``children`` whose version holds."""
        holds, rows = self._holds(), self.table(name)
        return rows.join(holds, (rows["stem"] == F.col("__stem")) & (rows["version"] == F.col("__version")), "left_semi")

    def _holds(self, but: str | None = None) -> DataFrame:
        """``__stem, __version``: the version of each stem that holds, as far as batches other than ``but`` tell."""
        versions = self.table("versions")
        versions = versions if but is None else versions.filter(F.col("batch") != but)
        return versions.groupBy(F.col("stem").alias("__stem")).agg(F.max_by("version", F.struct("at", "batch")).alias("__version"))

    def create_collection(self) -> None:
        """Makes the table of children, empty, if it isn't there."""
        if not self._exists(f"{self.root}/children"):
            self.spark.createDataFrame([], SCHEMAS["children"]).write.parquet(f"{self.root}/children")

    def delete_collection(self) -> None:
        """Empties the table of children; documents and parents stay."""
        self.spark.createDataFrame([], SCHEMAS["children"]).write.mode("overwrite").parquet(f"{self.root}/children")
        self.index.clear()

    def rebuild_collection(self) -> None:
        """Makes all children, and their index, anew from the parents; their ids are what they were."""
        self.delete_collection()
        batch = uuid.uuid4().hex
        self._add("children", self._children(self.table("parents")), batch)
        self._index(batch)

    def _index(self, batch: str) -> None:
        """Adds a batch's children to the index; a batch that is added again replaces itself."""
        self.index.add(self.table("children").filter(F.col("batch") == batch).select("id", F.col("content").alias("text")), batch)

    def _superseded(self) -> DataFrame | None:
        """``id`` of children whose version doesn't hold, or nothing if each stem has one version."""
        versions = self.table("versions")
        several = versions.groupBy(F.col("stem").alias("__several")).agg(F.count_distinct("version").alias("__n")).filter("__n > 1").select("__several")
        if not several.limit(1).count():
            return None
        own = self.table("children").join(several, F.col("stem") == F.col("__several"), "left_semi")
        return own.join(self.current("children").select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_anti").select("id")

    def candidates(self, queries: DataFrame, k: int) -> DataFrame:
        """What the index finds for ``queries`` (``qid, text``) among children whose version holds."""
        return self.index.candidates(queries, k, self._superseded())

    @staticmethod
    def _children(parents: DataFrame) -> DataFrame:
        made = chunking.child_chunks(parents, keep=("stem", "version"))
        return made.select(F.xxhash64("parent_id", "child_idx", "version").alias("id"), "parent_id", "stem", "version", "child_idx", "content", "metadata")

    def clear_all(self) -> None:
        """Empties all tables."""
        for name, schema in SCHEMAS.items():
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.index.clear()

    # ingestion

    def add(self, files: DataFrame, batch: str | None = None) -> tuple[int, int]:
        """Ingests ``path, text`` rows: ``(added, skipped)``. HTML becomes text; stems that are there, repeated stems and empty texts are skipped."""
        kind = D.detect_format(F.col("path"), F.col("text"))
        text = F.when(kind == "html", T.html_to_markdown(F.col("text"))).otherwise(F.col("text"))
        return self._ingest(files.select("path", kind.alias("format"), T.valid_utf8(text).alias("text"), F.lit(None).cast("string").alias("error")), batch=batch)

    def _ingest(self, read: DataFrame, update: bool = False, batch: str | None = None, progress: Progress | None = None) -> tuple[int, int]:
        """``(added, skipped)`` of rows ``path, format, text, error``; each row's fate goes to the registry.

        With ``update``, a stem that is there gets another version if its text has changed. A batch that failed, at whatever
        step, can be ingested again under its name: what it wrote before doesn't count, and is overwritten.
        """
        if batch is not None:
            return self._ingested(read, update, batch, progress)
        batch = uuid.uuid4().hex
        try:
            return self._ingested(read, update, batch, progress)
        except Exception:
            self._drop(batch)  # nobody will ingest it again under this name
            raise

    def _drop(self, batch: str) -> None:
        """Deletes what a batch has written."""
        for name in SCHEMAS:
            for folder in (f"{self.root}/{name}/batch={batch}", f"{self.root}/{name}/bucket=*/batch={batch}"):
                own = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                system = own.getFileSystem(self.spark._jsc.hadoopConfiguration())
                for found in system.globStatus(own) or []:
                    system.delete(found.getPath(), True)
        for part in (self.index.postings, self.index.vectors):
            if batch in part.segments.names():
                part.segments.commit([n for n in part.segments.names() if n != batch])

    def _ingested(self, read: DataFrame, update: bool, batch: str, progress: Progress | None) -> tuple[int, int]:
        step = progress or (lambda done, what: None)
        with self.tracker.measure("document_ingestion"):
            step(0.0, "reading and parsing")
            # files are parsed, and what is new decided, once
            with batches_of(self.spark, FILES_AT_ONCE):
                rows = cut(read.withColumn("stem", T.stem_of(F.col("path"))), "staged")
            full = rows.filter(F.length(T.strip(F.coalesce("text", F.lit("")))) > 0)
            first = full.groupBy("stem").agg(F.min_by(F.struct("path", "format", "text"), F.struct("path", "text")).alias("d")).select("stem", _bucket(F.col("stem")).alias("bucket"), "d.*")
            met = [r["bucket"] for r in full.select(_bucket(F.col("stem")).alias("bucket")).distinct().collect()]  # BUCKETS at most
            stems = self.table("stems").filter(F.col("bucket").isin(met) & (F.col("batch") != batch))
            there = stems.groupBy(F.col("bucket").alias("__bucket"), F.col("stem").alias("__stem")).agg(F.max("version").alias("__last"), F.map_from_entries(F.collect_set(F.struct("version", "sha"))).alias("__shas"))
            known = first.join(there, (F.col("bucket") == F.col("__bucket")) & (F.col("stem") == F.col("__stem")), "left")
            fresh = F.col("__last").isNull()
            if update:
                holds = self._holds(batch).select(F.col("__stem").alias("__held"), F.col("__version").alias("__v"))
                known = known.join(holds, F.col("stem") == F.col("__held"), "left")
                fresh = fresh | ~F.sha2("text", 256).eqNullSafe(F.col("__shas")[F.col("__v")])
            new = cut(known.filter(fresh).select("stem", "path", "format", "text", "bucket", (F.coalesce("__last", F.lit(0)) + 1).alias("version")), "new")
            step(0.3, "chunking")
            with self.tracker.measure("document_chunking"):
                parents = chunking.parent_chunks(new, "version", "text", F.col("stem"))
                self._add("parents", parents.select("parent_id", F.regexp_replace("parent_id", r"_parent_\d+$", "").alias("stem"), F.col("version").cast("int").alias("version"), "content", "metadata"), batch)
            own = self.table("parents").filter(F.col("batch") == batch)
            step(0.5, "indexing")
            with self.tracker.measure("vector_insertion"):
                self._add("children", self._children(own), batch)
                self._index(batch)
            self._add("documents", new.select("stem", "version", "path", "format", "text"), batch)
            self._add("versions", new.select("stem", "version", F.current_timestamp().alias("at")), batch)
            taken = new.select(F.col("stem").alias("__stem"), F.col("path").alias("__path"))
            empty = F.length(T.strip(F.coalesce("text", F.lit("")))) == 0
            status = F.when(F.col("error").isNotNull(), "failed").when(empty, "empty").when(F.col("__path").isNotNull(), "added").otherwise("exists")
            noted = rows.join(taken, (F.col("stem") == F.col("__stem")) & (F.col("path") == F.col("__path")), "left")
            self._add("registry", noted.select("path", "stem", "format", status.alias("status"), "error", F.current_timestamp().alias("at")), batch)
            # the last table: with its stems there, a batch is whole, and what has them is skipped
            self._add("stems", new.select("stem", "version", F.sha2("text", 256).alias("sha"), "bucket"), batch)
            self.last_batch = batch
            added = new.count()
            step(1.0, f"{added} added")
            return added, rows.count() - added

    def add_documents(self, paths: str | list[str], progress: Progress | None = None) -> tuple[int, int]:
        """Files of all formats that have a parser; paths that don't exist are left out, as if they hadn't been given. ``progress`` hears of each step."""
        paths = [p for p in ([paths] if isinstance(paths, str) else paths) if p and self._exists(p)]
        return self._ingest(self._files(paths), progress=progress) if paths else (0, 0)

    def update_documents(self, paths: str | list[str]) -> tuple[int, int]:
        """Like ``add_documents``, but a stem whose text has changed gets another version, which holds from now on."""
        paths = [p for p in ([paths] if isinstance(paths, str) else paths) if p and self._exists(p)]
        return self._ingest(self._files(paths), update=True) if paths else (0, 0)

    def rollback(self, stem: str, version: int) -> None:
        """Lets an earlier version of a document, with its chunks, hold again."""
        if not self.table("documents").filter((F.col("stem") == stem) & (F.col("version") == version)).limit(1).count():
            raise KeyError(f"no version {version} of {stem}")
        row = self.spark.createDataFrame([(stem, version)], "stem string, version int").withColumn("at", F.current_timestamp())
        self._add("versions", row, uuid.uuid4().hex)

    def history(self, stem: str) -> DataFrame:
        """``version, at``: which versions of a document held from when on."""
        return self.table("versions").filter(F.col("stem") == stem).select("version", "at").orderBy("at")

    def tag(self, stem: str, **tags: str) -> None:
        """Adds tags to a document; a tag's last value counts."""
        rows = self.spark.createDataFrame([(stem, t, str(v)) for t, v in tags.items()], "stem string, tag string, value string")
        self._add("tags", rows.withColumn("at", F.current_timestamp()), uuid.uuid4().hex)

    def find(self, format: str | None = None, **tags: str) -> DataFrame:
        """``stem, version, path, format, n_chars, tags`` of documents of a format and with all of these tags."""
        last = self.table("tags").groupBy("stem", "tag").agg(F.max_by("value", F.struct("at", "batch")).alias("value"))
        by = last.groupBy(F.col("stem").alias("__stem")).agg(F.map_from_entries(F.collect_list(F.struct("tag", "value"))).alias("tags"))
        rows = self.current("documents").join(by, F.col("stem") == F.col("__stem"), "left")
        for t, v in tags.items():
            rows = rows.filter(F.col("tags")[t] == str(v))
        rows = rows if format is None else rows.filter(F.col("format") == format)
        return rows.select("stem", "version", "path", "format", F.length("text").alias("n_chars"), "tags")

    def add_directory(self, path: str, recursive: bool = True) -> tuple[int, int, dict[str, Any]]:
        """``(added, skipped, statistics)``: files by format and by status, and the files that failed."""
        if not self._exists(path):
            return 0, 0, {"error": f"{path} doesn't exist"}
        added, skipped = self._ingest(self._files([path], recursive))
        own = self.table("registry").filter(F.col("batch") == self.last_batch)
        counts = lambda c: {r[0]: r["n"] for r in own.groupBy(c).agg(F.count(F.lit(1)).alias("n")).collect()}
        return added, skipped, {"total": added + skipped, "by_format": counts("format"), "by_status": counts("status"), "errors": [(r["path"], r["error"]) for r in own.filter("status = 'failed'").orderBy("path").limit(100).collect()]}

    def _exists(self, path: str) -> bool:
        """Whether a path, or anything that a pattern fits, is there, by Spark's own file systems."""
        own = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(own.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(own))

    def _files(self, paths: list[str], recursive: bool = False) -> DataFrame:
        """``path, format, text, error`` of files, parsed one by one."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
        name = D.detect_format(F.col("path")).alias("name")
        content = found.filter(F.col("length") <= MOST_FILE_BYTES).select("path", name, "content")
        large = found.filter(F.col("length") > MOST_FILE_BYTES).select("path", name, F.lit(None).cast("binary").alias("content"))
        return content.unionByName(large).mapInArrow(_parsed, "path string, format string, text string, error string")

    def add_web_page(self, url: str, html: str, metadata: dict[str, str] | None = None) -> tuple[bool, str]:
        """Ingests a page; its metadata, and where it is from, become tags."""
        path = f"{url.rstrip('/')}.html"
        page = self.spark.createDataFrame([(path, html)], "path string, text string")
        added, _ = self.add(page)
        if added:
            self.tag(page.select(T.stem_of(F.col("path"))).first()[0], **{"url": url, **(metadata or {})})
        return bool(added), "added" if added else "there already, or without text"

    @staticmethod
    def supported_formats() -> list[str]:
        """Extensions of files that have a parser."""
        return sorted(e for e, f in D.FORMATS.items() if f in parsers.PARSERS)

    def documents(self) -> DataFrame:
        return self.table("documents").select("stem").distinct().orderBy("stem")

    def statistics(self) -> DataFrame:
        return self.current("documents").groupBy("format").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.length("text")).alias("n_chars"))

    def registry(self) -> DataFrame:
        """The last status of each path, with how often it was met and how often it failed."""
        last = F.max_by(F.struct("stem", "format", "status", "error", "at"), F.struct("at", "batch")).alias("__last")
        seen = self.table("registry").groupBy("path").agg(last, F.count(F.lit(1)).alias("n_seen"), F.count(F.when(F.col("status") == "failed", 1)).alias("n_failed"))
        return seen.select("path", "__last.*", "n_seen", "n_failed")

    # search

    def search(self, question: str, k: int = 3, score_threshold: float = config.SCORE_THRESHOLD, threshold_stage: str = "fused") -> DataFrame:
        """``rank, score, parent_id, source, content`` of the best children."""
        with self.tracker.measure("vector_retrieval", {"k": k, "score_threshold": score_threshold}):
            asked = self.spark.createDataFrame([(0, question)], "qid long, text string")
            found = retrieval.hybrid(None, asked, k, score_threshold, threshold_stage=threshold_stage, search=self.candidates)
            best = self.spark.createDataFrame(found.select("id", "rank", "score").collect(), "id long, rank int, score double")  # at most k rows
            # the ids are pushed down to the files, so that no other child is read
            units = self.table("children").filter(F.col("id").isin([r["id"] for r in best.collect()])).dropDuplicates(["id"])
            return units.join(F.broadcast(best), "id").select("rank", "score", "parent_id", F.col("metadata")["source"].alias("source"), "content").orderBy("rank")

    def search_child_chunks(self, question: str, limit: int = 3, threshold_stage: str = "fused") -> str:
        try:
            text = retrieval.formatted(F.col("parent_id"), F.col("source"), F.col("content"))
            rows = [r["t"] for r in self.search(question, limit, threshold_stage=threshold_stage).select(text.alias("t")).collect()]
        except Exception as e:  # the caller is a model, which reads what went wrong
            return f"{config.RETRIEVAL_ERROR}{e}"
        return "\n\n".join(rows) or config.NO_CHUNKS

    def load_parents(self, ids: list[str]) -> list[dict[str, Any]]:
        """``content, parent_id, metadata`` of parents, each once, in the order of their number; an id that isn't there raises ``KeyError``."""
        asked = self.spark.createDataFrame([(i,) for i in ids], "asked string").select(D.parent_key(F.col("asked")).alias("parent_id"))
        with self.tracker.measure("parent_store_operations"):
            wanted = retrieval.parents_sorted(asked)
            found = self.current("parents").join(small(wanted), "parent_id").orderBy("sort_key", "parent_id").collect()
        if missing := {r["parent_id"] for r in wanted.collect()} - {r["parent_id"] for r in found}:
            raise KeyError(f"no parent {min(missing)}")
        return [{"content": r["content"], "parent_id": r["parent_id"], "metadata": r["metadata"]} for r in found]

    def retrieve_parents(self, ids: str | list[str]) -> str:
        """Whole parents as one text; one that is missing fails the call."""
        ids = [ids] if isinstance(ids, str) else list(ids)
        if not ids:
            return config.NO_PARENTS
        try:
            rows = self.load_parents(ids)
        except Exception as e:  # as above
            return f"{config.PARENT_ERROR}{e}"
        return "\n\n".join(f"Parent ID: {r['parent_id']}\nFile Name: {(r['metadata'] or {}).get('source', 'unknown')}\nContent: {(r['content'] or '').strip()}" for r in rows)

    # conversations

    def _thread(self, thread_id: str) -> DataFrame:
        """All messages of a thread, read from its bucket."""
        return self.table("messages").filter((F.col("bucket") == bucket_of(thread_id)) & (F.col("thread_id") == thread_id))

    def messages(self, thread_id: str | None = None) -> DataFrame:
        """``seq, role, content`` of a thread since it was last cleared."""
        own = self._thread(thread_id or self.thread_id)
        cleared = own.filter("role = 'cleared'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("__from"))
        return own.join(small(cleared)).filter("seq > __from").select("seq", "role", "content")

    def _say(self, *said: tuple[str, str]) -> None:
        rows = [(self.thread_id, self._seq + i, role, content, bucket_of(self.thread_id)) for i, (role, content) in enumerate(said)]
        self._seq += len(rows)
        self._add("messages", self.spark.createDataFrame(rows, "thread_id string, seq long, role string, content string, bucket int").coalesce(1), uuid.uuid4().hex)

    def reset_thread(self) -> None:
        """Forgets the conversation and begins another."""
        if self._seq:
            self._say(("cleared", ""))
        self.thread_id, self._seq = uuid.uuid4().hex, 0

    def resume(self, thread_id: str) -> None:
        """Goes on with a thread that is kept in the table."""
        self.thread_id = thread_id
        self._seq = self._thread(thread_id).agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]

    def _ask(self, question: str, k: int, threshold_stage: str) -> tuple[str, str]:
        """Status and text of the graph's answer; the conversation is brought up to date."""
        self._say(("user", question))
        said = self.messages().select(F.lit(0).alias("conv_id"), F.col("seq").alias("turn"), "role", F.col("content").alias("text"))
        asked = self.spark.createDataFrame([(0, question)], "key long, query string").join(dialogue.history_window(said), F.col("key") == F.col("conv_id"), "left").select("key", "query", "history")
        units = self.current("children").select("id", "parent_id", F.col("content").alias("text"))
        parents = self.current("parents").select("parent_id", "content")
        found = dialogue.answer_all(asked, units, parents, k, self.analysis, self.answer, threshold_stage, self.candidates).first()
        if found["status"] == "answered":  # a clear query ends what was said before
            self._say(("cleared", ""), ("assistant", found["text"]))
        else:
            self._say(("assistant", found["text"]))
        return found["status"], found["text"]

    def query(self, question: str, k: int = 3, threshold_stage: str = "none") -> dict[str, Any]:
        """``answer``, ``status`` (``answered`` or ``needs_input``), ``documents``, ``evaluation`` and ``latency_metrics``; the evaluation is also kept as a row."""
        with self.tracker.measure_query(question, k):
            with self.tracker.measure("agent_graph_execution", {"question_length": len(question), "expected_retrieval_count": k}):
                status, answer = self._ask(question.strip(), k, threshold_stage)
            documents = [r["content"] for r in self.search(question.strip(), k, threshold_stage=threshold_stage).collect()]
            graded = self.evaluate(question, answer, documents)
        return {"answer": answer, "status": status, "documents": documents, "evaluation": graded, "latency_metrics": {r["operation"]: r.asDict() for r in L.stats(self.latency()).collect()}}

    def chat(self, message: str, history: Any = None) -> str:
        """The answer, or what went wrong; the question, answer and found chunks are kept for ``evaluate_last``."""
        try:
            question = message.strip()
            _, answer = self._ask(question, 3, "none")
            self.last_question, self.last_answer = question, answer
            self.last_chunks = [r.asDict() for r in self.search(question, 3, threshold_stage="none").collect()]
            return answer
        except Exception as e:  # shown to the user
            return f"Error: {e}"

    def evaluate_last(self) -> bool:
        """Whether there was a chat to evaluate; its results are in ``last_evaluation``."""
        if not self.last_question or not self.last_answer:
            return False
        self.last_evaluation = self.evaluate(self.last_question, self.last_answer, [c["content"] for c in self.last_chunks])
        return True

    def clear_session(self) -> None:
        if getattr(self, "_seq", 0):
            self.reset_thread()
        self.thread_id, self._seq = uuid.uuid4().hex, 0
        self.last_question = self.last_answer = self.last_evaluation = None
        self.last_chunks: list[dict[str, Any]] = []

    def evaluate(self, question: str, answer: str, documents: list[str]) -> dict[str, Any]:
        """Statuses and overall score; kept as a row of ``evaluations`` and of its CSV form."""
        with self.tracker.measure("evaluation_pipeline"):
            row = self.spark.createDataFrame([(question, answer, documents)], "question string, answer string, docs array<string>").withColumn("documents", evaluation.safe_join(F.col("docs")))
            grades = row.select("question", "answer", "documents", *(g(F.col("question"), F.col("answer"), F.col("documents")).alias(m) for m, g in self.graders.items()))
            graded = grades.withColumns({"overall_score": evaluation.overall_of(grades), "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")})
            batch = uuid.uuid4().hex
            self._add("evaluations", graded, batch)
            own = self.table("evaluations").filter(F.col("batch") == batch)
            try:
                evaluation.csv_rows(own).write.mode("append").option("header", True).option("escape", '"').csv(f"{self.root}/evaluations_csv")
            except Exception:  # a lost line of the report doesn't undo the answer
                logging.getLogger(__name__).exception("the evaluation wasn't added to the CSV")
            result = own.first()
        return {m: evaluation_status(result[m]) for m in self.graders} | {"overall_score": result["overall_score"]}

    # latency

    def latency(self) -> DataFrame:
        return self.tracker.frame(self.spark)

    def export_latency(self, path: str, kind: str = "csv") -> None:
        if kind == "csv":
            export_csv(self.latency(), path)
        elif kind == "json":
            export_json(self.latency()).write.json(path)
        else:
            raise ValueError(f"unknown format {kind!r}")


def evaluation_status(score: bool | None) -> str:
    return "ERROR" if score is None else "PASS" if score else "FAIL"
