"""Queries over the driver's tables and their SQL. Conversations stand in for messages, documents for the keyword corpus,
embeddings for vectors, events for containers over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import stems
from kelpline.functions import text as X
from kelpline.operators import containers as C
from kelpline.operators import ivf as V
from kelpline.operators import postings as I
from kelpline.operators import quantised as Q
from kelpline.operators import search as S
from kelpline.plans import predicates as P
from kelpline.sources import migrate as M
from kelpline.sources.store import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERY = "of stand ner"
#: A fixed query vector of 64 numbers.
VECTOR = [((i * 37) % 17 - 8) / 16 for i in range(64)]
DAY = 86_400


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def messages(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "conversations")
    return c.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("id"),
        F.when(F.col("conv_id") % 2 == 0, "mac").otherwise("box").alias("host"),
        F.lit("pi").alias("source"),
        F.col("conv_id").cast("string").alias("container_id"),
        F.col("role").alias("author_id"),
        F.concat(F.lit("Talk "), F.col("conv_id") % 7).alias("container_title"),
        F.concat(F.lit("p"), F.col("turn") % 3).alias("project"),
        F.when(F.col("role") == "system", "title").otherwise("message").alias("kind"),
        (F.col("conv_id") * 3600 + F.col("turn") * 60).alias("timestamp"),
        "text",
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.col("user_id").cast("string").alias("container_id"),
        F.col("event_type").alias("kind"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        "value",
        "event_id",
    )


MESSAGES = """(SELECT concat_ws('/', CAST(conv_id AS VARCHAR), lpad(CAST(turn AS VARCHAR), 6, '0')) AS id, CASE WHEN conv_id % 2 = 0 THEN 'mac' ELSE 'box' END AS host,
 'pi' AS source, CAST(conv_id AS VARCHAR) AS container_id, role AS author_id, 'Talk ' || conv_id % 7 AS container_title, 'p' || turn % 3 AS project, CASE WHEN role = 'system' THEN 'title' ELSE 'message' END AS kind,
 conv_id * 3600 + turn * 60 AS timestamp, text FROM conversations)"""
EVENTS = """(SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, CAST(user_id AS VARCHAR) AS container_id, event_type AS kind,
 CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, value, event_id FROM events)"""
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')"
T0 = 1_704_499_200
_KIND = "CASE event_type WHEN 'purchase' THEN 'title' WHEN 'signup' THEN 'todo' WHEN 'view' THEN 'task' WHEN 'click' THEN 'tool' ELSE 'message' END"

_registry: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _registry[f.__name__] = (f, sql)
        return f

    return add


@query(f"SELECT id, value FROM {EVENTS} WHERE kind = 'view' AND container_id = '7'")
def filter_eq_and(s, d):
    return events(s, d).where(P.eq_all(kind="view", container_id="7")).select("id", "value")


@query(f"SELECT id FROM {EVENTS} WHERE kind = 'error'")
def filter_unknown_field_ignored(s, d):
    return events(s, d).where(P.conj([P.eq("kind", "error"), P.eq("value", "1")])).select("id")


@query(f"SELECT id, timestamp FROM {EVENTS} WHERE timestamp >= {T0} ORDER BY timestamp, id LIMIT 50")
def cursor_ts_inclusive(s, d):
    return events(s, d).where(P.cursor(T0)).select("id", "timestamp").orderBy("timestamp", "id").limit(50)


@query(f"SELECT id, timestamp FROM {EVENTS} WHERE timestamp > {T0} OR (timestamp = {T0} AND id > '000000000100') ORDER BY timestamp, id LIMIT 50")
def cursor_ts_id(s, d):
    return events(s, d).where(P.cursor(T0, "000000000100")).select("id", "timestamp").orderBy("timestamp", "id").limit(50)


@query(f"SELECT id, timestamp FROM {EVENTS} WHERE id > '000000000500'")
def cursor_id_only(s, d):
    return events(s, d).where(P.cursor(0, "000000000500")).select("id", "timestamp")


@query(f"SELECT id FROM {EVENTS} WHERE timestamp < {T0}")
def before_bound(s, d):
    return events(s, d).where(P.before(T0)).select("id")


@query(f"SELECT id, kind FROM {EVENTS.replace('event_type AS', _KIND + ' AS')} WHERE kind IN ('title', 'todo', 'task')")
def include_kinds(s, d):
    """The rows of a walk that asks for the state."""
    return events(s, d).withColumn("kind", F.expr(_KIND.replace("event_type", "kind"))).where(P.of_kinds(P.kinds(" State "))).select("id", "kind")


@query(f"SELECT id, timestamp, author_id FROM {MESSAGES} WHERE container_id = '3' ORDER BY timestamp, id LIMIT 3")
def container_walk_page1(s, d):
    return C.walk(messages(s, d), "3", limit=3).select("id", "timestamp", "author_id")


@query(f"SELECT id, timestamp, author_id FROM {MESSAGES} WHERE container_id = '3' AND (timestamp > 10920 OR (timestamp = 10920 AND id > '3/000002')) ORDER BY timestamp, id LIMIT 3")
def container_walk_page2(s, d):
    return C.walk(messages(s, d), "3", 10_920, "3/000002", limit=3).select("id", "timestamp", "author_id")


@query(f"""SELECT host, source, container_id, min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(*) AS messages,
 coalesce(CASE WHEN length(p) > 300 THEN left(p, 300) || '…' ELSE p END, '') AS first_prompt, arg_min(container_title, (timestamp, id)) AS container_title, arg_min(project, (timestamp, id)) AS project FROM
 (SELECT *, coalesce(arg_min(text, (timestamp, id)) FILTER (author_id = 'user' AND text <> '') OVER w, arg_min(text, (timestamp, id)) FILTER (text <> '') OVER w) AS p
  FROM {MESSAGES} WHERE kind = 'message' AND timestamp >= 36000 AND timestamp < 180000 WINDOW w AS (PARTITION BY host, source, container_id)) GROUP BY host, source, container_id, p""")
def sessions_window(s, d):
    return C.sessions(messages(s, d), 36_000, 180_000)


@query(f"""SELECT host, source, container_id, min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(*) AS messages,
 coalesce(CASE WHEN length(p) > 300 THEN left(p, 300) || '…' ELSE p END, '') AS first_prompt, arg_min(container_title, (timestamp, id)) AS container_title, arg_min(project, (timestamp, id)) AS project FROM
 (SELECT *, coalesce(arg_min(text, (timestamp, id)) FILTER (author_id = 'user' AND text <> '') OVER w, arg_min(text, (timestamp, id)) FILTER (text <> '') OVER w) AS p
  FROM {MESSAGES} WHERE kind = 'message' WINDOW w AS (PARTITION BY host, source, container_id)) GROUP BY host, source, container_id, p""")
def sessions_first_prompt(s, d):
    """All sessions of the table, from time 0 on and without an end."""
    return C.sessions(messages(s, d), 0)


@query(f"""SELECT source, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'processing') AS processing, count(*) AS total
 FROM (SELECT container_id AS source, CASE kind WHEN 'error' THEN 'failed' WHEN 'view' THEN 'processing' ELSE 'indexed' END AS status FROM {EVENTS}) GROUP BY ROLLUP (source)""")
def raw_status_counts(s, d):
    status = F.when(F.col("kind") == "error", "failed").when(F.col("kind") == "view", "processing").otherwise("indexed")
    return C.status_counts(events(s, d).select(F.col("container_id").alias("source"), status.alias("status")))



@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, array_to_string(t, ' ') AS line FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def tokenize(s, d):
    t = X.tokens(F.col("text"))
    return _table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("line"))


_TF = "(SELECT doc_id, text, " + ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(QUERY.split())) + f", len(t) AS len FROM (SELECT doc_id, text, {TOKENS} AS t FROM documents))"
_KEYWORD = " + ".join(f"CASE WHEN f{i} > 0 THEN 1 + ln(1 + f{i}) ELSE 0 END" for i in range(3))
_SUM = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / a))" for i in range(3))
_BM25 = f"(SELECT doc_id, {_SUM} AS score FROM {_TF}, (SELECT count(*) AS n, avg(len) AS a, " + ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(3)) + f" FROM {_TF}))"


@query(f"SELECT doc_id, round({_KEYWORD}, 6) AS score FROM {_TF}")
def keyword_score(s, d):
    return _table(s, d, "documents").select("doc_id", F.round(S.keyword_score(F.col("text"), QUERY), 6).alias("score"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, {_KEYWORD} AS score FROM {_TF}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def keyword_topk(s, d):
    return S.keyword_search(_table(s, d, "documents"), QUERY, 20, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id AS id, round(score, 6) AS score FROM {_BM25} WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
def bm25_topk(s, d):
    return S.bm25(_table(s, d, "documents"), QUERY, "doc_id").orderBy(F.desc("score"), "id").limit(20).withColumn("score", F.round("score", 6))


_DIST = f"sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(embedding[i] - CAST({VECTOR} AS FLOAT[])[i] AS DOUBLE), 2))))"


@query(f"SELECT vec_id, round({_DIST}, 6) AS distance FROM embeddings ORDER BY {_DIST}, vec_id LIMIT 20")
def vector_topk(s, d):
    return S.vector_search(_table(s, d, "embeddings"), VECTOR, 20, "vec_id", "embedding").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round({_DIST}, 6) AS distance FROM embeddings WHERE label = 3 ORDER BY {_DIST}, vec_id LIMIT 10")
def vector_topk_filtered(s, d):
    return S.vector_search(_table(s, d, "embeddings").where("label = 3"), VECTOR, 10, "vec_id", "embedding").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round(1 / (1 + {_DIST}), 6) AS score FROM embeddings")
def vector_score(s, d):
    return _table(s, d, "embeddings").select("vec_id", F.round(1 / (1 + S.l2(F.col("embedding"), VECTOR)), 6).alias("score"))


_LISTS = f"""SELECT id, row_number() OVER (ORDER BY {_DIST}, id) AS rank FROM (SELECT vec_id AS id, embedding FROM embeddings) QUALIFY rank <= 50
 UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {_BM25} WHERE score > 0 QUALIFY rank <= 50"""


def _fused(s, d):
    vectors = S.vector_search(_table(s, d, "embeddings"), VECTOR, 50, "vec_id", "embedding").withColumnRenamed("vec_id", "id")
    words = S.bm25(_table(s, d, "documents"), QUERY, "doc_id").orderBy(F.desc("score"), "id").limit(50)
    return S.fuse(S.ranked(vectors, "distance", "id"), S.ranked(words, F.desc("score"), "id"))


@query(f"SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM ({_LISTS}) GROUP BY id")
def rrf_fusion(s, d):
    return _fused(s, d).withColumn("score", F.round("score", 9))


@query(f"SELECT id, round(score, 9) AS score, substr(text, 1, 40) AS text FROM (SELECT id, sum(1.0 / (60 + rank)) AS score FROM ({_LISTS}) GROUP BY id ORDER BY score DESC, id LIMIT 10) JOIN documents ON id = doc_id")
def hybrid_topk(s, d):
    """Ranks are narrow; only the ten hits left meet the wide rows."""
    top = _fused(s, d).orderBy(F.desc("score"), "id").limit(10)
    docs = _table(s, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("text"))
    return docs.join(F.broadcast(top), "id").select("id", F.round("score", 9).alias("score"), "text")



@query(f"""WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY value DESC, event_id) AS rk, event_id, container_id AS u, timestamp AS t FROM {EVENTS} QUALIFY rk <= 60),
 s AS (SELECT CAST(0 AS BIGINT) AS rk, CAST([] AS STRUCT(e BIGINT, u VARCHAR, t BIGINT)[]) AS kept UNION ALL
 SELECT r.rk, CASE WHEN len(list_filter(kept, lambda k: k.u = r.u AND abs(k.t - r.t) <= {5 * DAY})) > 0 THEN kept ELSE list_append(kept, {{'e': event_id, 'u': u, 't': t}}) END FROM s JOIN r ON r.rk = s.rk + 1)
 SELECT k.e AS event_id FROM (SELECT unnest(kept) AS k FROM s WHERE rk = (SELECT max(rk) FROM s))""")
def collapse_hits(s, d):
    top = S.ranked(events(s, d).orderBy(F.desc("value"), "event_id").limit(60), F.desc("value"), "event_id")
    hits = top.withColumns({"message_id": F.col("id"), "content_hash": F.lit(""), "chat": F.lit(True)})
    return S.collapse(hits, 5 * DAY).select(F.col("id").cast("long").alias("event_id"))







@query(r"SELECT doc_id, CASE WHEN length(l) > 60 THEN left(l, 60) || '…' ELSE l END AS line FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS l FROM documents)")
def clip_line(s, d):
    return _table(s, d, "documents").select("doc_id", X.clip_line(F.col("text"), 60).alias("line"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '…' ELSE text END AS head FROM documents")
def clip_runes(s, d):
    return _table(s, d, "documents").select("doc_id", X.clip_runes(F.col("text"), 100).alias("head"))


@query(f"SELECT id FROM {MESSAGES} WHERE author_id IN ('user', 'assistant') AND strlen(text) >= 8 AND NOT (author_id = 'user' AND starts_with(ltrim(text, E' \\t\\r\\n'), 'The'))")
def indexable_filter(s, d):
    return messages(s, d).where(X.indexable(F.col("author_id"), F.col("text"), ("The",))).select("id")









_NOW = T0 + 20 * DAY


@query(f"""SELECT id AS key FROM {EVENTS} WHERE kind = 'signup' OR (kind = 'error' AND event_id % 2 = 1) OR (kind = 'error' AND {_NOW} - timestamp >= least(3600, 30 * pow(2, greatest(event_id % 8 - 1, 0))))
 OR (kind NOT IN ('signup', 'error') AND event_id % 2 = 1 AND {_NOW} - timestamp >= 300)""")
def due_objects(s, d):
    e = events(s, d)
    objects = e.select(F.col("id").alias("key"), F.lit("b").alias("etag"), F.lit(1).alias("size"))
    status = F.when(F.col("kind") == "error", "failed").otherwise("indexed")
    known = e.where("kind <> 'signup'").select(F.col("id").alias("key"), F.when(F.col("event_id") % 2 == 1, "a").otherwise("b").alias("etag"), F.lit(1).alias("size"), status.alias("status"), F.lit(1).alias("parser_version"), (F.col("event_id") % 8).alias("attempts"), F.col("timestamp").alias("updated_at"))
    return C.due(objects, known, _NOW).select("key")


@query(f"""SELECT store, rank, id FROM (SELECT CASE WHEN host = 'mac' THEN 0 ELSE 1 END AS store, row_number() OVER (PARTITION BY host ORDER BY timestamp, id) AS rank, id FROM {MESSAGES}) ORDER BY rank, store LIMIT 25""")
def interleave_stores(s, d):
    m = messages(s, d)
    return C.interleave([m.where("host = 'mac'"), m.where("host = 'box'")], ["timestamp", "id"], 25).select("store", "rank", "id")





@query(f"SELECT id, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS minute FROM {EVENTS}")
def when_format(s, d):
    return events(s, d).select("id", X.when_format(F.col("timestamp")).alias("minute"))


@query(f"SELECT doc_id AS id, round(score, 6) AS score FROM {_BM25} WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
def bm25_indexed(s, d):
    """Through postings, built here; a store keeps them."""
    docs = _table(s, d, "documents")
    n, total = I.stats(docs).first()
    hits = I.bm25(I.build(docs, "doc_id", n=n), n, total / n, QUERY)
    return hits.orderBy(F.desc("score"), "id").limit(20).withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id AS id, round(score, 6) AS score FROM {_BM25} WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
def bm25_blocks(s, d):
    """The best by bounds of blocks, from written postings."""
    docs, folder = _table(s, d, "documents"), scratch(s, "blocks")
    n, total = I.stats(docs).first()
    I.build(docs, "doc_id", blocks=I.shares(n), n=n).write.parquet(f"{folder}/postings")
    postings = s.read.parquet(f"{folder}/postings")
    I.peaks(postings).write.parquet(f"{folder}/peaks")
    hits = I.top(postings, s.read.parquet(f"{folder}/peaks"), n, total / n, QUERY, 20, direct=0).hits
    return hits.withColumn("score", F.round("score", 6))


def _stem_sql(word: str, source: str) -> str:
    """``source`` with ``word`` stemmed: a subquery for each step of the rules."""
    sql = f"SELECT *, regexp_replace({word}, '([aeiouy])y', '\\1Y', 'g') AS w_ FROM {source}"
    for rules in stems.STEPS:
        cases = " ".join(f"WHEN regexp_matches(w_, '{find}') THEN CASE WHEN {' AND '.join(f"regexp_matches(w_, '{h}')" for h in holds) or 'true'} THEN regexp_replace(w_, '{cut}', '{to}') ELSE w_ END" for find, holds, cut, to in rules)
        sql = f"SELECT * REPLACE (CASE {cases} ELSE w_ END AS w_) FROM ({sql})"
    fixed = " ".join(f"WHEN {word} = '{w}' THEN '{t}'" for w, t in stems.FIXED.items())
    return f"SELECT * EXCLUDE (w_) REPLACE (CASE WHEN length({word}) < 3 THEN {word} {fixed} ELSE lower(w_) END AS {word}) FROM ({sql})"


ENGLISH = "the things of ering from"
_ENGLISH_TERMS = f"(SELECT doc_id, list_filter(t, lambda x: x NOT IN {stems.STOP}) AS t FROM (SELECT doc_id, {TOKENS} AS t FROM documents))"
_ENGLISH_TF = f"(SELECT doc_id, len, term, count(*) AS tf FROM ({_stem_sql('term', f'(SELECT doc_id, len(t) AS len, unnest(t) AS term FROM {_ENGLISH_TERMS})')}) GROUP BY ALL)"


@query(f"""WITH p AS MATERIALIZED (SELECT * FROM {_ENGLISH_TF} WHERE term IN ('thing', 'ere', 'from')), d AS (SELECT term, count(*) AS df FROM p GROUP BY term), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM {_ENGLISH_TERMS})
 SELECT doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM p JOIN d USING (term), s GROUP BY doc_id""")
def bm25_english(s, d):
    """All matches by stems, stop words aside."""
    docs = _table(s, d, "documents")
    n, total = I.stats(docs, english=True).first()
    return I.bm25(I.build(docs, "doc_id", english=True, n=n), n, total / n, ENGLISH, english=True).withColumn("score", F.round("score", 6))


@query(f"SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM {_ENGLISH_TF} GROUP BY term")
def stems_counts(s, d):
    return I.build(_table(s, d, "documents"), "doc_id", english=True).groupBy("term").agg(F.sum("tf").alias("n"))


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def postings_counts(s, d):
    return I.build(_table(s, d, "documents"), "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


_OLDER = "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat_ws('/', 'h', 'pi', user_id, 'message', event_id) WHEN 2 THEN concat_ws('/', 'h', 'pi', user_id, event_type, event_id) ELSE concat_ws('/', 'h', 'pi', user_id, event_id) END"


@query(f"""SELECT event_id, CASE WHEN p = '' THEN CAST(event_id AS VARCHAR) WHEN event_id % 4 = 1 THEN replace(p, '/message/', '/') ELSE p END AS id,
 CASE WHEN event_id % 4 = 2 THEN event_type ELSE 'message' END AS kind FROM (SELECT *, {_OLDER} AS p FROM events)""")
def older_identity(s, d):
    id, kind = M.identity(F.col("p"), F.col("event_id").cast("string"))
    return _table(s, d, "events").withColumn("p", F.expr(_OLDER)).select("event_id", id.alias("id"), kind.alias("kind"))


@query(f"SELECT vec_id, round({_DIST}, 6) AS distance FROM embeddings ORDER BY {_DIST}, vec_id LIMIT 10")
def pq_search(s, d):
    """By a written index over all its lists, which gives what a scan does."""
    rows, folder = _table(s, d, "embeddings"), scratch(s, "pq")
    book = Q.train(rows, 64, lists=16, parts=16, codes=64, id="vec_id", vector="embedding")
    Q.encode(rows, book, "embedding").repartitionByRange("list", "radius").sortWithinPartitions("list", "radius").write.parquet(folder)
    index = s.read.parquet(folder)
    hits = Q.search(index, book.measured(index), VECTOR, 10, 0, 8, "vec_id", "embedding")
    return hits.select("vec_id", F.round("distance", 6).alias("distance"))


@query()
def ivf_search(s, d):
    """The ten nearest of every twentieth vector."""
    rows = _table(s, d, "embeddings").select("vec_id", "embedding")
    index = V.build(rows, 64, 16, id="vec_id", vector="embedding")
    hits = V.search(index, rows.where("vec_id % 20 = 0"), 10, V.probes_for(s, index, 10), "vec_id", "embedding")
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


def entry(spark: SparkSession) -> DataFrame:
    """Keyword search over the smallest conversations, as hits."""
    hits = S.keyword_search(messages(spark, "/root/testdata/sf0.001"), "the of", 50)
    return hits.select("id", "score", "container_id", "author_id", "timestamp", "text")


def queries() -> dict[str, Query]:
    from kelpline import scenarios  # noqa: F401, its queries register themselves

    return {k: f for k, (f, _) in _registry.items()}


def oracle_sql() -> dict[str, str]:
    from kelpline import scenarios  # noqa: F401

    return {k: q for k, (_, q) in _registry.items() if q}
