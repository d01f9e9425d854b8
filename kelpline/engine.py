"""The engine's calls over one store: ingest, search, walk, sessions, status and maintenance."""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpline.functions.text import content_hash
from kelpline.operators import batch as M
from kelpline.operators import containers as C
from kelpline.operators import contextual as U
from kelpline.operators import postings as I
from kelpline.operators import quantised as Q
from kelpline.operators import search as S
from kelpline.plans import predicates as P
from kelpline.sources import jsonl, local, resume
from kelpline.sources.store import Store, scratch

Embedder = Callable[[list[str]], list[list[float]]]
PARSER_VERSION = "1"
QUERY_RUNES = 2000
#: Columns that a vector index has beside the vectors, so that filters reach its scan.
_FILTERS = ("source", "host", "container_id", "container_kind", "project", "author_id", "kind", "message_id")
_META = ("source", "host", "container_id", "container_kind", "container_title", "project", "author_id", "author_name", "kind", "reply_to", "attrs")
RECORD = "id string, text string, " + ", ".join(f"{c} string" for c in _META) + ", timestamp long, vector array<float>"


class Engine:
    """``embedder`` gives vectors of ``dims`` numbers; without one, records and queries bring their own. Prefixes go before the texts it is given.

    ``english``: words are stems and stop words don't count, in the keyword index and in queries; an index that was made otherwise isn't used.
    """

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, dims: int = 384, query_prefix: str = "", doc_prefix: str = "", english: bool = False):
        self.english = english
        self.spark, self.store, self.embedder, self.dims = spark, Store(spark, root), embedder, dims
        self.query_prefix, self.doc_prefix = query_prefix, doc_prefix
        self._known: dict[tuple, object] = {}  # one-row tables and counts of versions seen

    # Reading

    def _table(self, name: str) -> DataFrame:
        found = self.store.read(name)
        if found is None:
            raise LookupError(f"the store has no {name} yet")
        return found

    def ready(self) -> bool:
        """Whether a search of one row runs."""
        return self.store.read("chunks") is not None and len(self._keywords("ready", F.lit(True), False, 1).collect()) <= 1

    def warm(self) -> None:
        """Read a row and run a search, so that listings and code are there for the first caller."""
        if self.store.read("chunks") is not None:
            self._table("chunks").limit(1).collect()
            self.ready()

    def _only(self, table: str):
        """The row of a table that has one, or None."""
        v = self.store.version(table)
        if v is None:
            return None
        if (table, v.base) not in self._known:
            self._known[table, v.base] = self.store.read(table, v.n).first()
        return self._known[table, v.base]

    def _since(self, version: int) -> tuple[DataFrame | None, int]:
        """Chunks written after ``version`` and their number; None if an index of that version can't be brought up to date with them."""
        now = self.store.version("chunks")
        key = ("since", version, now)
        if key not in self._known:
            tail = self.store.since("chunks", version)
            self._known[key] = tail, tail.count() if tail is not None and now.n != version else 0
        return self._known[key]

    def _keywords(self, text: str, keep: Column, narrowed: bool, k: int) -> DataFrame:
        """The ``k`` best BM25 scores of the chunks that ``keep`` holds for, by the index and the chunks written since; without an index by a scan."""
        found = self._postings()
        if found is None and not self.english:
            return S.bm25(self._table("chunks"), text, keep=keep).orderBy(F.desc("score"), "id").limit(k)
        postings, n, total = found or self._unindexed()
        kept, peaks = self._table("chunks").where(keep).select("id") if narrowed else None, self._peaks() if found else None
        if peaks is not None:
            return I.top(postings, peaks, n, total / max(n, 1), text, k, kept, self.english).hits
        hits = I.bm25(postings, n, total / max(n, 1), text, self.english)
        return (hits.join(kept, "id", "left_semi") if narrowed else hits).orderBy(F.desc("score"), "id").limit(k)

    def _unindexed(self) -> tuple[DataFrame, int, int]:
        chunks = self._table("chunks")
        total = I.stats(chunks, english=self.english).first()
        return I.build(chunks, english=self.english, n=total.n), total.n, total.total

    def _postings(self) -> tuple[DataFrame, int, int] | None:
        """The index's postings with those of the chunks written since, and the numbers of chunks and of their tokens; None without an index."""
        made = self._only("index_stats")
        if made and ("english" in made and made.english) != self.english:
            return None
        tail, added = self._since(made.chunks) if made else (None, 0)
        if tail is None:
            return None
        n, total, postings = made.n, made.total, self.store.read("postings", made.postings)
        if added:
            ids = tail.select("id")
            key = ("tokens", made.chunks, self.store.version("chunks"))
            if key not in self._known:
                old = I.stats(self.store.read("chunks", made.chunks).join(ids, "id", "left_semi"), english=self.english).first()
                new = I.stats(tail, english=self.english).first()
                self._known[key] = new.n - old.n, new.total - old.total
            more = self._known[key]
            n, total = n + more[0], total + more[1]
            postings = postings.join(ids, "id", "left_anti").unionByName(I.build(tail, english=self.english, blocks=made.shares if "shares" in made else None, n=added))
        return postings, n, total

    def _peaks(self) -> DataFrame | None:
        """The index's peaks with those of the chunks written since, less those of the chunks that these replace; None for an index without any."""
        made = self._only("index_stats")
        if "peaks" not in made:
            return None
        peaks, (tail, added) = self.store.read("peaks", made.peaks), self._since(made.chunks)
        if added:
            replaced = self.store.read("chunks", made.chunks).join(tail.select("id"), "id", "left_semi")
            late, gone = (I.peaks(I.build(rows, english=self.english, blocks=made.shares, n=added), rare=0) for rows in (tail, replaced))
            peaks = peaks.unionByName(late).unionByName(gone.withColumn("n", -F.col("n")))
        return peaks

    def _near(self, vector: list[float], k: int, exact: bool, probes: int, refine: int, **filters: str) -> DataFrame:
        """(id, distance, score) of the nearest chunks: by the vector index, if there is one, and the chunks written since, else by a scan."""
        keep, made = P.eq_all(**filters), None if exact else self._only("vector_index")
        made = made if made and "measures" in made else None  # an index of an older kind waits for its rebuild
        tail, added = self._since(made.chunks) if made else (None, 0)
        if tail is None:
            return S.vector_search(self._table("chunks").where(keep).select("id", "vector"), vector, k).select("id", "distance", "score")
        index = self.store.read("vector_codes", made.codes).where(keep)
        if added:
            index = index.join(tail.select("id"), "id", "left_anti")
        near = Q.search(index, Q.Codebook.of(made.lists, made.parts, made.measures), vector, k, probes, refine).select("id", "distance", "score")
        if not added:
            return near
        late = S.vector_search(tail.where(keep).select("id", "vector"), vector, k).select("id", "distance", "score")
        return near.unionByName(late).orderBy("distance", "id").limit(k)

    def search(self, text: str = "", vector: list[float] | None = None, limit: int = 5, embed: bool | None = None, exact: bool = False, probes: int = 0, refine: int = 4, **filters: str) -> DataFrame:
        """(rank, id, score, matched_chunk_id, text, ...) of at most ``limit`` messages.

        With a text and a vector, or with ``embed``, both lists are fused; ``embed=False`` drops the vector. A vector of
        another length is replaced by one of the text where there is an embedder, else it is an error. Indexes are used where the store has them;
        ``exact`` passes the vector index by, ``probes`` and ``refine`` are its own; with no ``probes`` all its lists are searched that can hold a result.
        """
        text, limit = text.strip(), limit if limit > 0 else 5
        vector = None if embed is False else vector
        stale = embed is None and vector and len(vector) != self.dims
        if text and self.embedder and (embed or stale):
            vector = self.embedder([self.query_prefix + (text if len(text) <= QUERY_RUNES else text[:QUERY_RUNES] + "…")])[0]
        if not vector and not text:
            raise ValueError("a query needs a text or a vector")
        if vector and len(vector) != self.dims:
            raise ValueError(f"the vector has {len(vector)} numbers, not {self.dims}")
        keep, k = P.eq_all(**filters), S.fetch_size(limit)
        rows = self._table("chunks").where(keep)
        lists = []
        if vector:
            lists.append(S.ranked(self._near(vector, k, exact, probes, refine, **filters), "distance", "id"))
        if text:
            lists.append(S.ranked(self._keywords(text, keep, any(filters.values()), k), F.desc("score"), "id"))
        hits = lists[0].select("id", "score", "rank")
        if len(lists) == 2:
            hits = S.ranked(S.fuse(*lists).orderBy(F.desc("score"), "id").limit(2 * k), F.desc("score"), "id")
        best = hits.select("id", "score", "rank").collect()  # twice ``k`` at most; their ids reach the scan of the wide rows
        hits = F.broadcast(self.spark.createDataFrame(best, "id string, score double, rank int"))
        found = rows.where(F.col("id").isin([r.id for r in best])).drop("vector").join(hits, "id")
        narrow = found.select("rank", "id", "message_id", "content_hash", F.concat_ws("/", "source", "container_id").alias("container_id"), "timestamp", F.col("source").isin(*jsonl.CHATS).alias("chat"))
        kept = S.collapse(narrow, U.LEAD_GAP, limit).select("rank")
        return found.withColumnRenamed("id", "matched_chunk_id").join(F.broadcast(kept), "rank").withColumn("id", F.coalesce(F.nullif("message_id", F.lit("")), "matched_chunk_id")).orderBy("rank")

    def search_many(self, queries: DataFrame, limit: int = 5, **filters: str) -> DataFrame:
        """``search`` for a table of queries (query_id, text, vector) in one job, over all vectors: (query_id, rank, id, score, matched_chunk_id, text, ...), at most ``limit`` messages for each.

        A query with a text and a vector has both lists fused, one with neither finds nothing; vectors have to be of the engine's length.
        """
        chunks, keep, k = self._table("chunks"), P.eq_all(**filters), S.fetch_size(limit)
        rows = chunks.where(keep)
        postings, n, tokens = self._postings() or self._unindexed()
        words = M.bm25(postings, n, tokens / max(n, 1), queries, k, rows.select("id") if any(filters.values()) else None, self.english)
        near = M.nearest(rows.select("id", "vector"), queries, k, self.dims).withColumn("score", 1 / (1 + F.col("distance")))
        words, near = (self._written(x, scratch(self.spark, "many")) for x in (words, near))  # ``k`` rows for each query, used twice
        both = queries.where((F.size("vector") > 0) & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("query_id")
        fields = ("query_id", "id", "score", "rank")
        alone = words.select(*fields).unionByName(near.select(*fields)).join(both, "query_id", "left_anti")
        hits = alone.unionByName(M.fuse(2 * k, words.join(both, "query_id", "left_semi"), near.join(both, "query_id", "left_semi")).select(*fields))
        narrow = rows.join(hits, "id").select("query_id", "rank", "id", "message_id", "content_hash", F.concat_ws("/", "source", "container_id").alias("container_id"), "timestamp", F.col("source").isin(*jsonl.CHATS).alias("chat"))
        kept = M.collapse(narrow, U.LEAD_GAP, limit).select("query_id", "rank", "id").join(hits.select("query_id", "id", "score"), ["query_id", "id"])
        found = rows.drop("vector").join(kept, "id")  # texts meet the hits that are left
        return found.withColumnRenamed("id", "matched_chunk_id").withColumn("id", F.coalesce(F.nullif("message_id", F.lit("")), "matched_chunk_id"))

    def walk(self, container_id: str, after_ts: int = 0, after_id: str = "", include: str = "", limit: int = 50, raw: str = "", **filters: str) -> DataFrame:
        """A page of a container; ``include`` names the kinds of rows: messages unless titles, todos, tasks or state.

        With ``raw``, the root of the raw objects, rows come from those that hold the container, and from the table only if none has any.
        """
        if not container_id.strip():
            raise ValueError("container_id required")
        kinds, limit = P.kinds(include), limit if limit > 0 else 50
        if raw:
            objects = self.raw_objects(raw, container_id.strip(), **filters)
            found = jsonl.parse(objects, kinds != {"message"}, jsonl.sources_of(objects)).select(*jsonl.COLUMNS)
            page = C.walk(found, container_id.strip(), after_ts, after_id, kinds, limit, **filters)
            if rows := page.collect():  # ``limit`` rows
                return self.spark.createDataFrame(rows, page.schema)
        return C.walk(self._table("messages"), container_id.strip(), after_ts, after_id, kinds, limit, **filters)

    def raw_objects(self, root: str, container_id: str, host: str = "", source: str = "", **_: str) -> DataFrame:
        """The raw objects that hold a container: those that the registry has indexed with it, else those whose key has the container's id, or a topic's chat, in it."""
        registry = self.store.read("registry")
        if registry is not None:
            mine = jsonl.identify(registry.drop("source")).where(P.eq_all(host=host, source=source))
            keys = [r.key for r in mine.where((F.col("status") == "indexed") & F.array_contains("container_ids", container_id)).select("key").collect()]  # a container's files
            if keys:
                return jsonl.listed(self.spark, root, keys)
        all = jsonl.listed(self.spark, root)
        return jsonl.identify(all).where(P.eq_all(host=host, source=source) & F.col("key").contains(container_id.split(":")[0])).drop("host", "source")

    def scan(self, limit: int = 10, **filters: str) -> DataFrame:
        """The first chunks that fit the filters, without a search."""
        return C.scan(self._table("chunks"), limit, **filters)

    def sessions(self, since: int, until: int = 0, **filters: str) -> DataFrame:
        if since <= 0:
            raise ValueError("since must be positive")
        return C.sessions(self._table("messages"), since, until, **filters)

    def raw_status(self) -> DataFrame:
        return C.status_counts(self._table("registry"))

    # Writing

    def _fresh(self, units: DataFrame, key: str) -> DataFrame:
        """Units not seen before. Repeated ids keep their last place."""
        place = [F.desc(c) for c in jsonl.PLACE]
        one = U.keyed(units, key).withColumn("_n", F.row_number().over(W.partitionBy("dedup_key").orderBy(*place))).where("_n = 1").drop("_n")
        return U.pending(one, self.store.read("dedup"), key)

    def _flush(self, new: DataFrame, chunks: DataFrame) -> None:
        self.store.flush(new.select(*jsonl.COLUMNS), chunks.drop(*jsonl.PLACE), new.select("dedup_key", "content_hash"))

    def _write(self, units: DataFrame, key: str) -> int:
        """Embed and store units not seen before; how many there were."""
        new = self._fresh(units, key).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = new.count()
            if n:
                chunks = U.chunks(new)
                if self.embedder:
                    chunks = U.embed(chunks, self.embedder, self.dims, prefix=self.doc_prefix)
                self._flush(new, chunks)
            return n
        finally:
            new.unpersist()

    def _write_apart(self, units: DataFrame, part: str) -> tuple[int, DataFrame]:
        """Like ``_write``, but an object with a text that can't be embedded is left out whole: units stored, and (key, error) of such objects.

        What was embedded is written below ``part`` before anything is stored, so that a lost executor can't turn a vector into an error.
        """
        new = self._written(self._fresh(units, "|unit"), part)
        chunks = U.chunks(new)
        chunks = U.embed_apart(chunks, self.embedder, self.dims, prefix=self.doc_prefix) if self.embedder else chunks.withColumn("error", F.lit(None).cast("string"))
        chunks = self._written(chunks, part)
        failed = self._written(chunks.where("error IS NOT NULL").groupBy("key").agg(F.min("error").alias("error")), part)
        if not failed.isEmpty():
            new, chunks = (x.join(failed.select("key"), "key", "left_anti") for x in (new, chunks))
        n = new.count()
        if n:
            self._flush(new, chunks.drop("error"))
        return n, failed

    def ingest_objects(self, objects: DataFrame) -> int:
        """Parse, contextualise and store raw objects (key, content); what was seen with the same unit is left out."""
        sources = jsonl.sources_of(objects)
        return self._write(U.units(jsonl.parse(objects, sources=sources), sources=sources), "|unit")

    def poll(self, objects: DataFrame, now: int | None = None) -> dict[str, int]:
        """Ingest the objects (key, etag, size, content) that are due, and keep their registry. An object with a text that can't be embedded fails alone, and waits."""
        now = int(time.time()) if now is None else now
        registry = self.store.read("registry")
        if registry is None:
            registry = self.spark.createDataFrame([], "key string, source string, etag string, size long, status string, attempts long, updated_at long, parser_version string, error string, container_ids array<string>")
        listed = jsonl.identify(objects)
        same = (F.col("old_etag") == F.col("etag")) & (F.col("old_size") == F.col("size")) & (F.col("parser_version") == PARSER_VERSION)
        due = C.due(listed.select("key", "source", "etag", "size"), registry.drop("source"), now, PARSER_VERSION).withColumn("same_version", F.coalesce(same, F.lit(False)))
        started = C.advance(due, "processing", now, PARSER_VERSION).drop("same_version", "old_etag", "old_size").withColumn("container_ids", F.coalesce("container_ids", F.array().cast("array<string>")))
        if not started.take(1):
            return {"due": 0, "written": 0}
        self.store.upsert("registry", started, "key")
        running = self._table("registry").where((F.col("status") == "processing") & (F.col("updated_at") == now)).persist(StorageLevel.MEMORY_AND_DISK)
        todo = listed.join(running.select("key"), "key", "left_semi").select("key", "size", "content")
        sources = jsonl.sources_of(running)
        rows = jsonl.parse(todo, sources=sources).persist(StorageLevel.MEMORY_AND_DISK)
        part = f"{self.store.root}/_poll-{uuid.uuid4().hex}"
        try:
            n = running.count()
            written, left_out = self._write_apart(U.units(rows, sources=sources), part)
            failed = jsonl.failures(todo).unionByName(left_out).groupBy("key").agg(F.min("error").alias("error"))
            containers = rows.groupBy("key").agg(F.array_sort(F.collect_set(F.nullif("container_id", F.lit("")))).alias("container_ids"))
            done = running.drop("error", "container_ids").join(failed, "key", "left").join(containers, "key", "left").withColumns({
                "status": F.when(F.col("error").isNull(), "indexed").otherwise("failed"), "error": F.coalesce("error", F.lit("")), "container_ids": F.coalesce("container_ids", F.array().cast("array<string>")),
            })
            self.store.upsert("registry", done, "key")
            return {"due": n, "written": written}
        except Exception as e:  # of the job, not of one object: all wait as failed ones do
            self.store.upsert("registry", running.withColumns({"status": F.lit("failed"), "error": F.lit(str(e)[: U.ERROR])}), "key")
            raise
        finally:
            rows.unpersist()
            running.unpersist()
            self.store.drop(part.rsplit("/", 1)[1])

    def run(self, root: str, interval: float = 30.0, rounds: int = 0) -> None:
        """Poll the raw objects under ``root`` again and again, ``rounds`` times or for good. A poll that fails is told and tried again."""
        done = 0
        while True:
            try:
                self.poll(jsonl.listed(self.spark, root))
            except Exception as e:
                print(f"poll: {e}", file=sys.stderr)
            done += 1
            if done == rounds:
                return
            time.sleep(interval)

    def _written(self, df: DataFrame, folder: str) -> DataFrame:
        """``df`` written below ``folder`` and read again, so that the plans that use it several times stay small."""
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _grown(self, found: DataFrame, new: DataFrame, source: str, part: str) -> tuple[DataFrame, DataFrame]:
        """(units, state by path) of what sessions have grown by, parsed from their new lines. An object whose state isn't known is parsed whole, and one with a new title, since that is in the header of all
        its units. What is made on the way is written below ``part``."""
        progress = self.store.read("progress")
        state = progress if progress is not None else self.spark.createDataFrame([], f"path string, offset long, {resume.STATE}")
        known = new.where("start > 0").select("path", "key", F.col("start").alias("offset")).join(state, ["path", "offset"])
        tails = new.join(known.select("path"), "path", "left_semi").unionByName(new.where("start = 0"))
        objects = self._written(resume.continued(tails, known.drop("path", "offset")), part)
        rows = self._written(resume.rows(objects, [source]), part)
        retitled = rows.where("kind = 'title'").join(known, "key", "left_semi").select("key").distinct()
        again = new.join(tails.select("path"), "path", "left_anti").unionByName(new.join(retitled, "key", "left_semi")).select("path", "key", "offset")
        again = self._written(again, part)
        parts = [(objects.join(again, "key", "left_anti"), rows.join(again, "key", "left_anti"))]
        if not again.isEmpty():
            texts = local.whole(found, again).join(again.select("path", "key"), "path")
            complete = self._written(resume.continued(texts, None), part)
            parts.append((complete, self._written(resume.rows(complete, [source]), part)))
        units, states = [resume.units(*p) for p in parts], [resume.state(*p) for p in parts]
        return reduce(DataFrame.unionByName, units), reduce(DataFrame.unionByName, states).join(new.select("path", "key", "offset"), "key").select("path", "offset", *resume.FIELDS)

    def sync(self, root: str, source: str, host: str, dry_run: bool = False, limit: int = 0) -> dict[str, int]:
        """Ingest files under ``root`` that have grown since their cursors, up to their last complete line.

        Of sessions only the new bytes are read and parsed, with the state that the last sync has left; exports of chats are parsed whole, since a line may edit an earlier one. What the store has seen is not
        written or embedded again. Cursors move after the rows are stored, so a crash in between only repeats work. With a ``limit``, at most so many rows are taken, in the order of the
        files, and the cursor of a file that is cut short stays.
        """
        found, key = local.files(self.spark, root), F.concat_ws("/", F.lit(host), F.lit(source), "rel")
        new = local.grown(found, self.store.read("cursor")).withColumn("key", key).persist(StorageLevel.MEMORY_AND_DISK)
        part = f"{self.store.root}/_sync-{uuid.uuid4().hex}"
        try:
            n = new.count()
            if not n or dry_run:
                return {"files": n, "accepted": 0}
            state = None
            if source in resume.GROWING:
                rows, state = self._grown(found, new, source, part)
                rows, state = self._written(rows, part), self._written(state, part)
            else:
                rows = U.units(jsonl.parse(local.whole(found, new).withColumn("key", key).select("key", "content"), sources=[source]))
            done = new
            if limit > 0:
                rows = U.pending(rows, self.store.read("dedup")).drop("dedup_key").persist(StorageLevel.MEMORY_AND_DISK)
                some = rows.orderBy(*jsonl.PLACE).limit(limit)
                cut = rows.groupBy("key").agg(F.count("*").alias("all")).join(some.groupBy("key").agg(F.count("*").alias("n")), "key", "left").where("n IS NULL OR n < all")
                done = new.join(cut.select("key"), "key", "left_anti")
                done = self.spark.createDataFrame(done.select("path", "offset").collect(), local.CURSOR)  # before the rows are stored
                rows = some
            accepted = self._write(rows, "|unit")
            if state is not None:
                self.store.upsert("progress", state.join(done.select("path"), "path", "left_semi"), "path")
            self.store.upsert("cursor", done.select("path", "offset"), "path")
            return {"files": n, "accepted": accepted}
        finally:
            new.unpersist()
            self.store.drop(part.rsplit("/", 1)[1])

    def ingest(self, records: DataFrame) -> tuple[dict[str, int], DataFrame]:
        """Store records (``RECORD``'s columns; absent ones count as empty): counts, and (id, error) of those refused.

        A record with a vector is one chunk as it stands; one without is embedded as a unit where there is an embedder. A column that records don't have is an error.
        """
        names = {f.split()[0]: f.split()[1] for f in RECORD.split(", ")}
        if unknown := sorted(set(records.columns) - set(names)):
            raise ValueError(f"unknown fields: {', '.join(unknown)}")
        full = records.select(*[(F.col(c) if c in records.columns else F.lit(None)).cast(t).alias(c) for c, t in names.items()])
        full = full.fillna("", [c for c, t in names.items() if t == "string"]).withColumn("kind", F.when(F.col("kind") == "", "message").otherwise(F.col("kind")))
        given = F.coalesce(F.size("vector"), F.lit(0))
        given = F.when(given > 0, given).otherwise(0)
        here = (given == 0) & F.lit(self.embedder is not None)
        error = (
            F.when(F.col("id") == "", "id required")
            .when(~here & (given != self.dims), F.concat(F.lit("vector dimensions="), given.cast("string"), F.lit(f" want={self.dims}")))
            .when(F.col("text") == "", "text required")
            .when(F.col("source") == "", "metadata.source required")
            .when(F.col("container_id") == "", "metadata.container_id required")
            .when(F.coalesce("timestamp", F.lit(0)) == 0, "metadata.timestamp required")
        )
        checked = full.withColumns({"error": error, "here": here, "content_hash": content_hash(F.col("text"))}).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good = checked.where("error IS NULL")
            own = good.where("NOT here").drop("error", "here")
            state = self.store.read("dedup")
            fresh = own if state is None else own.join(state.select(F.col("dedup_key").alias("id"), "content_hash").distinct(), ["id", "content_hash"], "left_anti")
            first = fresh.groupBy("id").agg(F.min("content_hash").alias("first"))
            told = fresh.join(first, "id")
            conflicts = told.where("content_hash <> first").select("id", F.concat(F.lit('id "'), "id", F.lit('" has conflicting content')).alias("error"))
            kept = told.where("content_hash = first").drop("first").dropDuplicates(["id"])
            refused = checked.where("error IS NOT NULL").select("id", "error").unionByName(conflicts).collect()  # the caller's batch
            accepted, placed = kept.count(), kept.select("*", F.lit(1).cast("long").alias("chunk_count"))
            if accepted:
                chunks = placed.select(F.concat("id", F.lit("#0")).alias("id"), F.col("id").alias("message_id"), F.lit(0).cast("long").alias("chunk_index"), "chunk_count", "text", "content_hash", *_META, "timestamp", "vector")
                self.store.flush(kept.select(*jsonl.COLUMNS), chunks, kept.select(F.col("id").alias("dedup_key"), "content_hash"))
            units = good.where("here").select(*jsonl.COLUMNS, F.lit("").alias("key"), F.col("timestamp").alias("at"), F.lit(0).alias("sub"), F.xxhash64("id").alias("line_no"))
            accepted += self._write(U.units(units), "") if units.take(1) else 0
            total = checked.count()
        finally:
            checked.unpersist()
        errors = self.spark.createDataFrame([tuple(r) for r in refused], "id string, error string")
        return {"accepted": accepted, "skipped": total - accepted - len(refused), "errors": len(refused)}, errors

    # Maintenance

    def optimize(self, files: int = 8, threshold: int = 0, prune: bool = False) -> bool:
        """Merge each table into ``files`` files and index it, if a table has more than ``threshold`` files; whether that was so. Messages are ordered by their container and chunks
        by id, so that reading one skips most files. A table that someone writes meanwhile raises ``Conflict``.

        With ``prune``, older snapshots are deleted; no one may be reading them then.
        """
        if max(self.fragment_counts().values(), default=0) <= threshold:
            return False
        self.store.optimize("messages", files, "container_id", "timestamp", "id")
        self.store.optimize("chunks", files, "id")
        for t in ("dedup", "registry", "cursor", "progress"):
            self.store.optimize(t, files)
        self.build_index()
        if self._only("vector_index"):
            self.create_vector_index()
        if prune:
            for t in ("messages", "chunks", "dedup", "registry", "cursor", "progress", "postings", "peaks", "index_stats", "vector_codes", "vector_index"):
                self.store.prune(t)
        return True

    def build_index(self) -> None:
        """Index the chunks' words. Searches use it from then on, beside the chunks written since. The statistics name the versions they are of and come last."""
        of = self.store.version("chunks").n
        chunks = self.store.read("chunks", of)
        n = chunks.count()
        shares = I.shares(n)
        made = self.store.write("postings", I.build(chunks, english=self.english, blocks=shares, n=n))
        peaks = self.store.write("peaks", I.peaks(self.store.read("postings", made)))
        about = {"chunks": of, "postings": made, "peaks": peaks, "shares": shares, "english": self.english}
        self.store.write("index_stats", I.stats(chunks, english=self.english).withColumns({k: F.lit(v) for k, v in about.items()}))

    def create_vector_index(self, lists: int | None = None, parts: int | None = None, codes: int = 256) -> None:
        """Build the quantised index of the chunks' vectors, or build it anew with the settings it had: unless told otherwise a list for each 1,000 chunks, 256 at most, and up to 96 parts."""
        had = self._only("vector_index")
        parts = parts or (len(had.parts) if had else max(p for p in range(1, min(96, self.dims) + 1) if self.dims % p == 0))
        of = self.store.version("chunks").n
        chunks = self.store.read("chunks", of)
        lists = lists or (len(had.lists) if had else min(256, 1 + chunks.count() // 1000))
        book = Q.train(chunks, self.dims, lists, parts, codes)
        coded = Q.encode(chunks.select("id", "vector", *_FILTERS), book)
        made = self.store.write("vector_codes", coded.repartitionByRange("list", "radius", "id").sortWithinPartitions("list", "radius", "id"))
        book = book.measured(self.store.read("vector_codes", made))
        row = [(book.lists.tolist(), book.parts.tolist(), book.measures.tolist(), of, made)]
        kind = "lists array<array<double>>, parts array<array<array<double>>>, measures array<array<double>>, chunks int, codes int"
        self.store.write("vector_index", self.spark.createDataFrame(row, kind))

    def drop_vector_index(self) -> None:
        """Vector searches scan from then on. Without an index nothing happens."""
        self.store.drop("vector_index", "vector_codes")

    def audit_duplicates(self) -> DataFrame:
        """(table, id, copies) of ids that stand more than once."""
        parts = [C.duplicates(self._table(t).select(F.lit(t).alias("table"), "id"), "table", "id") for t in ("messages", "chunks")]
        return parts[0].unionByName(parts[1])

    def delete_host(self, host: str) -> int:
        """Drop a host's rows and state; how many messages and chunks there were."""
        gone = self.store.delete_host(host, "messages", "chunks")
        for t, key in (("dedup", "dedup_key"), ("registry", "key")):
            v, rows = self.store.version(t), self.store.read(t)
            if rows is not None:
                self.store.write(t, rows.where(~F.col(key).startswith(host + "/")), key, v)
        return gone

    def fragment_counts(self) -> dict[str, int]:
        return {t: len(rows.inputFiles()) for t in ("messages", "chunks") if (rows := self.store.read(t)) is not None}
