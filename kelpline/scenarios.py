"""Queries that run the parsers, the units and the engine over raw objects made of the driver's tables, and their SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline import federation as Fed
from kelpline.catalogue import _BM25, _DIST, DAY, EVENTS, MESSAGES, QUERY, VECTOR, _table, events, messages, query
from kelpline.engine import Engine
from kelpline.functions import text as X
from kelpline.operators import containers as C
from kelpline.operators import contextual as U
from kelpline.operators import search as S
from kelpline.sources import jsonl, local, resume
from kelpline.sources import migrate as M
from kelpline.sources.store import Store, scratch

#: Added to small times so that they read as seconds of this century.
ERA = 1_700_000_000
TS = "(conv_id * 3600 + turn * 60)"
TEXT = r"trim(text, E' \t\n\r')"
SAID = f"role IN ('user', 'assistant') AND strlen({TEXT}) >= 8"


def _ts() -> Column:
    return F.col("conv_id") * 3600 + F.col("turn") * 60


def _part(kind: str, **fields: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in fields.items()])


def _str(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _objects(spark: SparkSession, d: str, folder: str, name: str, line: Column, first: Column | None = None) -> DataFrame:
    """(key, etag, size, content): one object for each conversation; ``line`` is a turn's JSON (or several), ``first`` a line before them."""
    c = _table(spark, d, "conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("l"))
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("body"))
    body = F.concat_ws("\n", first, "body") if first is not None else F.col("body")
    key = F.concat(F.lit(folder), F.col("conv_id").cast("string"), F.lit(name))
    return whole.select(key.alias("key"), F.lit("a").alias("etag"), F.octet_length(body).cast("long").alias("size"), F.encode(body, "UTF-8").alias("content"))


def _parse(objects: DataFrame, state: bool = True) -> DataFrame:
    return jsonl.parse(objects, state, jsonl.sources_of(objects))


def _pi(spark: SparkSession, d: str) -> DataFrame:
    """A header, a title in even conversations, messages with a thought before each text, and the system's turns as to-do lists."""
    spoken = F.to_json(F.struct(F.lit("message").alias("type"), _str("m", "turn").alias("id"), _ts().alias("timestamp"), F.struct(
        F.col("role").alias("role"), F.array(_part("thinking", text=F.lit("hm")), _part("text", text=F.col("text"))).alias("content")).alias("message")))
    todo = F.to_json(F.struct(F.lit("message").alias("type"), _str("m", "turn").alias("id"), _ts().alias("timestamp"), F.struct(
        F.lit("toolResult").alias("role"), F.lit("todo").alias("toolName"), F.struct(F.array("turn").alias("phases")).alias("details")).alias("message")))
    head = F.to_json(F.struct(F.lit("session").alias("type"), _str("c", "conv_id").alias("id"), F.concat(F.lit("/w/p"), F.col("conv_id") % 5, F.lit("/")).alias("cwd")))
    title = F.to_json(F.struct(F.lit("title").alias("type"), F.lit("t").alias("id"), _str("About ", "conv_id").alias("title"), F.lit(ERA).alias("timestamp")))
    first = F.concat_ws("\n", head, F.when(F.col("conv_id") % 2 == 0, title))
    return _objects(spark, d, "h/pi/a/", ".jsonl", F.when(F.col("role") == "system", todo).otherwise(spoken), first)


PI = f"""(SELECT 'h/pi/c' || conv_id || CASE WHEN role = 'system' THEN '/todo/m' ELSE '/m' END || turn AS id,
  CASE WHEN role = 'system' THEN 'TODO todo:' || chr(10) || '[' || turn || ']' ELSE {TEXT} END AS text, 'c' || conv_id AS container_id, 'p' || conv_id % 5 AS project,
  CASE WHEN role = 'system' THEN 'toolResult' ELSE role END AS author_id, CASE WHEN role = 'system' THEN 'todo' ELSE 'message' END AS kind, greatest({TS}, 1) AS timestamp, turn + 9 AS place
 FROM conversations WHERE role = 'system' OR {SAID} UNION ALL
 SELECT DISTINCT 'h/pi/c' || conv_id || '/title/t', 'TITLE title: About ' || conv_id, 'c' || conv_id, 'p' || conv_id % 5, 'system', 'title', {ERA}, 1 FROM conversations WHERE conv_id % 2 = 0)"""
_FIELDS = ("id", "text", "container_id", "project", "author_id", "kind", "timestamp")


@query(f"SELECT {', '.join(_FIELDS)}, sha256(text) AS content_hash FROM {PI}")
def raw_pi(s, d):
    return _parse(_pi(s, d)).select(*_FIELDS, "content_hash")


@query(f"SELECT {', '.join(_FIELDS)}, sha256(text) AS content_hash FROM {PI}")
def raw_resumed(s, d):
    """Each object in two parts, the second parsed with the state that the first has left."""
    body, n = F.split(F.decode("content", "UTF-8"), "\n"), F.octet_length("key") % 4 + 1
    part = lambda first, size: _pi(s, d).select("key", F.encode(F.concat(F.array_join(F.slice(body, first, size), "\n"), F.lit("\n")), "UTF-8").alias("content"))
    begun = resume.continued(part(F.lit(1), n), None)
    rows = resume.rows(begun, ["pi"])
    grown = resume.continued(part(n + 1, F.size(body)), resume.state(begun, rows))
    return rows.unionByName(resume.rows(grown, ["pi"])).select(*_FIELDS, "content_hash")


@query(f"SELECT id, text FROM {PI} WHERE kind = 'message'")
def raw_messages_only(s, d):
    return _parse(_pi(s, d), state=False).select("id", "text")


def _claude(spark: SparkSession, d: str) -> DataFrame:
    """Summaries for the system's turns; assistants run a command and start a task, of which the next turn's user brings the result, and one that no one asked for."""
    when = F.date_format(F.timestamp_seconds(_ts()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts = "array<struct<type:string,text:string,id:string,name:string,input:struct<description:string,command:string>,tool_use_id:string,content:string>>"
    text = F.to_json(F.array(_part("text", text=F.col("text"))))
    work = F.to_json(F.array(
        F.struct(F.lit("tool_use").alias("type"), _str("b", "turn").alias("id"), F.lit("Bash").alias("name"), F.struct(_str("List ", "turn").alias("description"), _str("ls ", "turn").alias("command")).alias("input")),
        F.struct(F.lit("tool_use").alias("type"), _str("t", "turn").alias("id"), F.lit("Task").alias("name"), F.struct(F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("command")).alias("input")),
    ))
    brought = F.to_json(F.array(*[_part("tool_result", tool_use_id=F.concat(F.lit(p), (F.col("turn") - 1).cast("string")), content=_str("done by ", "turn")) for p in ("t", "z")]))
    content = F.concat(F.from_json(text, parts), F.from_json(F.when(F.col("role") == "assistant", work).otherwise(brought), parts))
    said = F.to_json(F.struct(F.col("role").alias("type"), _str("u", "turn").alias("uuid"), F.lit("/w/boat").alias("cwd"), when.alias("timestamp"), F.struct(F.col("role").alias("role"), content.alias("content")).alias("message")))
    return _objects(spark, d, "h/claude/p/s", ".jsonl", F.when(F.col("role") == "system", F.to_json(F.struct(F.lit("summary").alias("type"), F.col("text").alias("summary")))).otherwise(said))


@query(f"""WITH c AS (SELECT *, {TEXT} AS t, {TS} AS ts, 'h/claude/s' || conv_id || '/' AS base FROM conversations),
 title AS (SELECT base || 'title/title-' || left(sha256('TITLE summary: ' || t), 16) AS id, 'TITLE summary: ' || t AS text, 'title' AS kind, 'system' AS author_id,
   greatest(coalesce((SELECT max(b.ts) FROM c b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.role <> 'system'), 1), 1) AS timestamp
   FROM (SELECT * FROM c WHERE role = 'system' AND t <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, t ORDER BY turn) = 1) a WHERE EXISTS (SELECT 1 FROM c b WHERE b.conv_id = a.conv_id AND b.role <> 'system'))
 SELECT id, text, kind, author_id, timestamp FROM title UNION ALL
 SELECT base || 'u' || turn, t, 'message', role, greatest(ts, 1) FROM c WHERE role IN ('user', 'assistant') AND strlen(t) >= 8 UNION ALL
 SELECT base || 'tool/b' || turn, 'Ran: List ' || turn || chr(10) || '$ ls ' || turn, 'tool', role, greatest(ts, 1) FROM c WHERE role = 'assistant' UNION ALL
 SELECT a.base || 'task/t' || b.turn, 'TOOL task RESULT:' || chr(10) || 'done by ' || a.turn, 'task', 'toolResult', greatest(a.ts, 1) FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 AND b.role = 'assistant' WHERE a.role = 'user'""")  # fmt: skip
def raw_claude(s, d):
    return _parse(_claude(s, d)).select("id", "text", "kind", "author_id", "timestamp")


def _codex(spark: SparkSession, d: str) -> DataFrame:
    """Every line twice; odd turns have no id."""
    payload = F.struct(F.lit("message").alias("type"), F.col("role").alias("role"), F.when(F.col("turn") % 2 == 0, _str("i", "turn")).alias("id"), F.array(F.struct("text")).alias("content"))
    line = F.to_json(F.struct(F.lit("response_item").alias("type"), (_ts() + ERA).alias("timestamp"), payload.alias("payload")))
    head = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(_str("x", "conv_id").alias("id"), F.lit("/w/y").alias("cwd")).alias("payload")))
    return _objects(spark, d, "h/codex/a/", ".jsonl", F.concat_ws("\n", line, line), head)


@query(f"""SELECT 'h/codex/x' || conv_id || '/' || CASE WHEN turn % 2 = 0 THEN 'i' || turn ELSE 'line-' || (2 * k - 1) END AS id, t AS text, role AS author_id, {TS} + {ERA} AS timestamp
 FROM (SELECT *, {TEXT} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE {SAID}
 QUALIFY row_number() OVER (PARTITION BY conv_id, CASE WHEN turn % 2 = 0 THEN 'i' || turn ELSE 'legacy-' || left(sha256(t), 16) END ORDER BY turn) = 1""")
def raw_codex(s, d):
    return _parse(_codex(s, d)).select("id", "text", "author_id", "timestamp")


@query(f"""SELECT id, text, author_id, project, timestamp FROM {PI} WHERE kind = 'message' UNION ALL
 SELECT 'h/codex/x' || conv_id || '/' || CASE WHEN turn % 2 = 0 THEN 'i' || turn ELSE left(sha256(t), 16) END, t, role, 'y', {TS} + {ERA} FROM (SELECT *, {TEXT} AS t FROM conversations) WHERE {SAID}
 QUALIFY row_number() OVER (PARTITION BY conv_id, CASE WHEN turn % 2 = 0 THEN 'i' || turn ELSE left(sha256(t), 16) END ORDER BY turn) = 1""")
def raw_turns(s, d):
    both = _pi(s, d).unionByName(_codex(s, d))
    return jsonl.parse_turns(jsonl.lines(jsonl.identify(both))).select("id", "text", "author_id", "project", "timestamp")


def _grok(spark: SparkSession, d: str) -> DataFrame:
    what = F.when(F.col("role") == "user", "user_message_chunk").when(F.col("role") == "assistant", "agent_message_chunk").otherwise("plan")
    meta = F.struct(_str("e", "turn").alias("eventId"), ((_ts() + ERA) * 1000 + 999).alias("agentTimestampMs"))
    params = F.struct(_str("g", "conv_id").alias("sessionId"), F.struct(what.alias("sessionUpdate"), F.struct("text").alias("content")).alias("update"), meta.alias("_meta"))
    return _objects(spark, d, "h/grok/%2Fw%2Fsea+side/", "/updates.jsonl", F.to_json(F.struct(F.lit("session/update").alias("method"), params.alias("params"))))


@query(f"SELECT 'h/grok/g' || conv_id || '/e' || turn AS id, {TEXT} AS text, 'sea+side' AS project, {TS} + {ERA} AS timestamp FROM conversations WHERE {SAID}")
def raw_grok(s, d):
    return _parse(_grok(s, d)).select("id", "text", "project", "timestamp")


def _chat(spark: SparkSession, d: str) -> DataFrame:
    """Gaps that grow with the turn; every fourth message answers the one two before; every fifth is edited, every seventh emptied; a line with a number for an id comes with each."""
    when = F.col("conv_id") * 3600 + F.col("turn") * F.col("turn") * 60
    same = [F.col("turn").cast("string").alias("id"), F.col("conv_id").cast("string").alias("chat_id"), F.lit("group").alias("chat_type"), _str("Talk ", "conv_id").alias("chat_title"), when.alias("date"),
            F.col("role").alias("sender_id"), F.when(F.col("role") == "user", "Ann").alias("sender_name"), F.when(F.col("turn") % 4 == 3, (F.col("turn") - 2).cast("string")).alias("reply_to")]
    line = F.to_json(F.struct(*same, "text"))
    after = F.when(F.col("turn") % 7 == 6, F.lit(" ")).when(F.col("turn") % 5 == 4, F.concat(F.lit("edited "), F.col("text")))
    edited = F.when(after.isNotNull(), F.to_json(F.struct(*same, (when + 5).alias("edit_date"), after.alias("text"))))
    return _objects(spark, d, "h/telegram/c/", ".jsonl", F.concat_ws("\n", line, edited, F.to_json(F.struct(F.col("turn").alias("id"), F.lit("1").alias("chat_id"), F.lit("x").alias("text")))))


CHAT = f"""(SELECT 'h/telegram/' || conv_id || '/' || turn AS id, CASE WHEN turn % 5 = 4 THEN trim('edited ' || text, E' \\t\\n\\r') ELSE {TEXT} END AS text, conv_id::VARCHAR AS container_id, 'Talk ' || conv_id AS container_title,
  CASE WHEN role = 'user' THEN 'Ann' ELSE '' END AS author_name, role AS author_id, CASE WHEN turn % 4 = 3 THEN 'h/telegram/' || conv_id || '/' || (turn - 2) ELSE '' END AS reply_to,
  CASE WHEN turn % 5 = 4 THEN '{{"edit_date":' || (conv_id * 3600 + turn * turn * 60 + 5) || '}}' ELSE '' END AS attrs, greatest(conv_id * 3600 + turn * turn * 60, 1) AS timestamp
 FROM conversations WHERE turn % 7 <> 6 AND {TEXT} <> '')"""
_CHAT_FIELDS = ("id", "text", "container_id", "container_title", "author_id", "author_name", "reply_to", "attrs", "timestamp")


@query(f"SELECT {', '.join(_CHAT_FIELDS)} FROM {CHAT}")
def raw_chat(s, d):
    return _parse(_chat(s, d)).select(*_CHAT_FIELDS)


@query("SELECT DISTINCT 'h/' || k || conv_id || CASE WHEN k LIKE 'grok%' THEN '/updates.jsonl' ELSE '.jsonl' END AS key, split_part(k, '/', 1) AS source FROM conversations, (VALUES ('pi/a/'), ('codex/a/'), ('claude/p/s'), ('grok/%2Fw%2Fsea+side/'), ('telegram/c/')) v(k)")
def raw_identity(s, d):
    """Keys of other shapes are left out."""
    parts = [f(s, d).select("key") for f in (_pi, _codex, _claude, _grok, _chat)]
    odd = parts[0].select(F.concat(F.col("key"), F.lit(".txt")).alias("key")).unionByName(parts[0].select(F.substring_index("key", "/", -2).alias("key")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]).unionByName(odd)
    return jsonl.identify(every).select("key", "source")


# Units: a header and the lines that a message follows or answers

LINE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _clip(c: str, n: int) -> str:
    line = LINE.format(c)
    return f"CASE WHEN length({line}) > {n} THEN left({line}, {n}) || '…' ELSE {line} END"


_PI_UNIT = f"""(SELECT *, 'Pi session' || CASE WHEN container_title <> '' THEN ' "' || container_title || '"' ELSE '' END || ' in ' || project AS header,
  CASE WHEN kind = 'message' AND author_id = 'assistant' AND asked <> '' THEN 'Re: ' || asked || chr(10) || text ELSE text END AS body
 FROM (SELECT p.*, CASE WHEN substr(container_id, 2)::BIGINT % 2 = 0 THEN 'About ' || substr(container_id, 2) ELSE '' END AS container_title,
   last_value(CASE WHEN kind = 'message' AND author_id = 'user' THEN {_clip("text", 300)} END IGNORE NULLS) OVER (PARTITION BY container_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM {PI} p))"""


def _pi_units(s, d) -> DataFrame:
    return U.units(_parse(_pi(s, d)), sources=["pi"])


@query(f"SELECT id, header FROM {_PI_UNIT} UNION ALL SELECT id, 'Telegram group \"' || container_title || '\"' FROM {CHAT}")
def context_header(s, d):
    return U.units(_parse(_pi(s, d).unionByName(_chat(s, d)))).select("id", "header")


@query(f"SELECT id, container_title FROM {_PI_UNIT}")
def title_backfill(s, d):
    return _pi_units(s, d).select("id", "container_title")


@query(f"SELECT id, body FROM {_PI_UNIT}")
def question_carry(s, d):
    return _pi_units(s, d).select("id", "body")


@query(f"SELECT id, sha256(header || chr(10) || body) AS content_hash FROM {_PI_UNIT}")
def session_unit_hash(s, d):
    return _pi_units(s, d).select("id", "content_hash")


_CHAT_UNIT = f"""(WITH m AS (SELECT *, CASE WHEN author_name <> '' THEN author_name ELSE author_id END || ': ' || text AS line FROM {CHAT}),
 l AS (SELECT *, CASE WHEN timestamp - lag(timestamp, 1) OVER w <= 600 THEN lag(id, 1) OVER w END AS id1, CASE WHEN timestamp - lag(timestamp, 2) OVER w <= 600 THEN lag(id, 2) OVER w END AS id2,
   lag(line, 1) OVER w AS line1, lag(line, 2) OVER w AS line2 FROM m WINDOW w AS (PARTITION BY container_id ORDER BY timestamp))
 SELECT l.id, l.reply_to, CASE WHEN l.reply_to <> '' AND p.timestamp < l.timestamp AND coalesce(l.reply_to <> l.id1, true) AND coalesce(l.reply_to <> l.id2, true) THEN '> ' || {_clip("p.line", 200)} END AS parent,
  CASE WHEN l.id2 IS NOT NULL THEN {_clip("l.line2", 200)} END AS lead2, CASE WHEN l.id1 IS NOT NULL THEN {_clip("l.line1", 200)} END AS lead1, l.line FROM l LEFT JOIN m p ON l.reply_to = p.id)"""


@query(f"SELECT id, concat_ws(chr(10), lead2, lead1, line) AS body FROM {_CHAT_UNIT} WHERE reply_to = ''")
def lead_in_lines(s, d):
    return U.units(_parse(_chat(s, d))).where("reply_to = ''").select("id", "body")


@query(f"SELECT id, concat_ws(chr(10), parent, lead2, lead1, line) AS body FROM {_CHAT_UNIT} WHERE reply_to <> ''")
def reply_quote(s, d):
    return U.units(_parse(_chat(s, d))).where("reply_to <> ''").select("id", "body")


@query(f"SELECT id FROM {_PI_UNIT} WHERE substr(container_id, 2)::BIGINT % 3 <> 0 OR kind = 'title'")
def dedup_anti_join(s, d):
    """Units not in the state, which has two thirds of the conversations' titles with another hash and all else of every third."""
    units = _pi_units(s, d)
    third = F.substring("container_id", 2, 20).cast("long") % 3 == 0
    known = units.where(third).select(F.concat("id", F.lit("|unit")).alias("dedup_key"), F.when(F.col("kind") == "title", "other").otherwise(F.col("content_hash")).alias("content_hash"))
    return U.pending(units, known).select("id")


@query(f"SELECT id || '#0' AS id, text, CAST(1 AS BIGINT) AS chunk_count FROM (SELECT id, header || chr(10) || body AS text, body FROM {_PI_UNIT}) WHERE len(string_split_regex(trim(regexp_replace(body, '\\s+', ' ', 'g')), ' ')) <= 128")
def chunk_text(s, d):
    """The units that fit one chunk whatever their header."""
    units = _pi_units(s, d)
    return U.chunks(units.where(F.size(F.split(F.trim(F.regexp_replace("body", r"\s+", " ")), " ")) <= 128)).select("id", "text", "chunk_count")


@query()
def chunk_windows(s, d):
    """Every document in windows of tokens."""
    docs = _table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("").alias("header"), F.col("text").alias("body"), "text", F.lit("").alias("content_hash"))
    return U.chunks(docs).select("message_id", "chunk_index", "chunk_count", "text")


# The engine and its store


def _engine(s: SparkSession, dims: int = 4, embed: bool = True) -> Engine:
    return Engine(s, scratch(s, "engine"), U.hashed_vectors(dims) if embed else None, dims)


def _at_rest(s: SparkSession, objects: DataFrame) -> DataFrame:
    """``objects`` as they lie in a raw store: written once, so that a poll reads what it needs of them and makes none anew."""
    path = scratch(s, "objects")
    objects.write.parquet(path)
    return s.read.schema(objects.schema).parquet(path)


@query("""SELECT 'h/pi/a/' || conv_id || '.jsonl' AS key, 'indexed' AS status, CAST(CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS attempts, 'c' || conv_id AS containers FROM conversations GROUP BY conv_id""")
def poll_registry(s, d):
    """Indexed once; every third object changes and is indexed again when that is due, and no object a third time."""
    e, objects = _engine(s), _at_rest(s, _pi(s, d))
    e.poll(objects, now=1000)
    changed = objects.withColumn("etag", F.when(F.regexp_extract("key", r"(\d+)\.", 1).cast("long") % 3 == 0, "b").otherwise("a"))
    e.poll(changed, now=1100)
    e.poll(changed, now=1400)
    e.poll(changed, now=9000)
    # an object's new version begins its count of attempts anew; 2 stands for it
    rows = e.store.read("registry")
    return rows.select("key", "status", (F.col("attempts") + (F.col("etag") == "b").cast("long")).alias("attempts"), F.array_join("container_ids", ",").alias("containers"))


@query(f"SELECT id, text, kind FROM {PI}")
def poll_messages(s, d):
    """What two polls of the same objects store."""
    e, objects = _engine(s), _at_rest(s, _pi(s, d))
    e.poll(objects, now=1000)
    e.poll(objects.withColumn("etag", F.lit("b")), now=9000)
    return e.store.read("messages").select("id", "text", "kind")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'new' ELSE 'old' END AS version FROM orders UNION ALL SELECT o_orderkey + 100000000, 'new' FROM orders WHERE o_orderkey % 10 = 0")
def upsert_merge(s, d):
    store, o = Store(s, scratch(s, "store")), _table(s, d, "orders").select("o_orderkey")
    some = o.where("o_orderkey % 10 = 0")
    store.write("t", o.withColumn("version", F.lit("old")), "o_orderkey")
    store.upsert("t", some.withColumn("version", F.lit("between")), "o_orderkey")
    store.upsert("t", some.unionByName(some.select((F.col("o_orderkey") + 100_000_000).alias("o_orderkey"))).withColumn("version", F.lit("new")), "o_orderkey")
    return store.read("t").select("o_orderkey", "version")


@query("SELECT o_orderkey, 'old' AS version FROM orders")
def store_time_travel(s, d):
    store, o = Store(s, scratch(s, "store")), _table(s, d, "orders").select("o_orderkey")
    first = store.write("t", o.withColumn("version", F.lit("old")), "o_orderkey")
    store.upsert("t", o.where("o_orderkey % 10 = 0").withColumn("version", F.lit("new")), "o_orderkey")
    store.optimize("t", 2, "o_orderkey")
    return store.read("t", first).select("o_orderkey", "version")


@query("SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS host, (SELECT count(*) FROM customer WHERE c_nationkey = 7) AS gone FROM customer WHERE c_nationkey <> 7")
def delete_host(s, d):
    store = Store(s, scratch(s, "store"))
    store.write("t", _table(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("host")), "c_custkey")
    gone = store.delete_host("7", "t")
    return store.read("t").withColumn("gone", F.lit(gone).cast("long"))


_RECORDS = """(SELECT CASE WHEN doc_id % 50 = 1 THEN '' ELSE 'd' || doc_id % 700 END AS id, CASE WHEN doc_id % 50 = 2 THEN '' ELSE text END AS text, CASE WHEN doc_id % 50 = 3 THEN '' ELSE 'crm' END AS source,
 CASE WHEN doc_id % 50 = 4 THEN '' ELSE lang END AS container_id, CASE WHEN doc_id % 50 = 5 THEN 0 ELSE doc_id + 1 END AS timestamp, CASE WHEN doc_id % 50 = 6 THEN 3 ELSE 4 END AS dims FROM documents)"""


@query(f"""WITH r AS (SELECT *, sha256(text) AS h, CASE WHEN id = '' THEN 'id required' WHEN dims <> 4 THEN 'vector dimensions=' || dims || ' want=4' WHEN text = '' THEN 'text required' WHEN source = '' THEN 'metadata.source required'
  WHEN container_id = '' THEN 'metadata.container_id required' WHEN timestamp = 0 THEN 'metadata.timestamp required' END AS e FROM {_RECORDS}),
 g AS (SELECT id, h, h = min(h) OVER (PARTITION BY id) AS first FROM r WHERE e IS NULL)
 SELECT 'accepted' AS outcome, count(DISTINCT id) AS n FROM g UNION ALL SELECT 'skipped', count(*) FILTER (first) - count(DISTINCT id) FROM g
 UNION ALL SELECT 'conflicting content', count(*) FROM g WHERE NOT first HAVING count(*) > 0 UNION ALL SELECT e, count(*) FROM r WHERE e IS NOT NULL GROUP BY e""")
def ingest_classify(s, d):
    doc = F.col("doc_id")
    odd = lambda i, c, other: F.when(doc % 50 == i, other).otherwise(c)
    records = _table(s, d, "documents").select(
        odd(1, F.concat(F.lit("d"), (doc % 700).cast("string")), "").alias("id"), odd(2, F.col("text"), "").alias("text"), odd(3, F.lit("crm"), "").alias("source"), odd(4, F.col("lang"), "").alias("container_id"),
        odd(5, doc + 1, 0).alias("timestamp"), F.transform(F.sequence(F.lit(1), odd(6, F.lit(4), 3)), lambda i: i.cast("float")).alias("vector"),
    )
    counts, errors = _engine(s, embed=False).ingest(records)
    told = errors.select(F.when(F.col("error").endswith("conflicting content"), "conflicting content").otherwise(F.col("error")).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))
    return told.unionByName(s.createDataFrame([(k, counts[k]) for k in ("accepted", "skipped")], "outcome string, n long"))


def _chunks(docs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    id = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    named = docs.select("doc_id", id.alias("id"), id.alias("message_id"), F.lit(0).cast("long").alias("chunk_index"), F.lit(1).cast("long").alias("chunk_count"), "text", X.content_hash(F.col("text")).alias("content_hash"),
                        F.lit("crm").alias("source"), F.lit("h").alias("host"), F.col("lang").alias("container_id"), *[F.lit("").alias(c) for c in ("container_kind", "container_title", "project", "author_id", "author_name", "reply_to", "attrs")],
                        F.lit("message").alias("kind"), F.col("doc_id").alias("timestamp"))
    return named.drop("doc_id") if vectors is None else named.join(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id").drop("doc_id")


def _indexed(s: SparkSession, d: str) -> Engine:
    """A store of all documents with an index of nine tenths of them, some of these with another text; the rest comes after it."""
    e, docs = Engine(s, scratch(s, "engine")), _table(s, d, "documents")
    e.store.upsert("chunks", _chunks(docs.where("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 1, QUERY).otherwise(F.col("text")))))
    e.build_index()
    e.store.upsert("chunks", _chunks(docs.where("doc_id % 10 < 2")))
    return e


_ID = "lpad(CAST(doc_id AS VARCHAR), 9, '0')"


@query(f"""SELECT {_ID} AS id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT b.doc_id, score, text FROM {_BM25} b JOIN documents USING (doc_id)) WHERE score > 0 QUALIFY rank <= 160)
 QUALIFY row_number() OVER (PARTITION BY text ORDER BY rank) = 1 ORDER BY rank LIMIT 20""")
def engine_keywords(s, d):
    """By an index, and the chunks written after it."""
    return _indexed(s, d).search(QUERY, limit=20).select("id", F.round("score", 6).alias("score"))


@query(f"""SELECT {_ID} AS id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT b.doc_id, score, text FROM {_BM25} b JOIN documents USING (doc_id) WHERE lang = 'de') WHERE score > 0 QUALIFY rank <= 160)
 QUALIFY row_number() OVER (PARTITION BY text ORDER BY rank) = 1 ORDER BY rank LIMIT 20""")
def engine_keywords_filtered(s, d):
    return _indexed(s, d).search(QUERY, limit=20, container_id="de").select("id", F.round("score", 6).alias("score"))


def _vector_engine(s: SparkSession, d: str) -> Engine:
    e, v = Engine(s, scratch(s, "engine"), dims=64), _table(s, d, "embeddings")
    rows = _chunks(v.select(F.col("vec_id").alias("doc_id"), F.col("vec_id").cast("string").alias("text"), F.col("label").cast("string").alias("lang")), v)
    e.store.upsert("chunks", rows.where("timestamp % 10 > 0"))
    e.create_vector_index(codes=16)
    e.store.upsert("chunks", rows.where("timestamp % 10 < 2"))
    return e


def _nearest_sql(where: str, k: int) -> str:
    return f"SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS id, round(1 / (1 + {_DIST}), 6) AS score FROM embeddings {where} ORDER BY {_DIST}, vec_id LIMIT {k}"


@query(_nearest_sql("", 20))
def engine_vectors(s, d):
    """By the vector index, and the chunks written after it."""
    return _vector_engine(s, d).search(vector=VECTOR, limit=20).select("id", F.round("score", 6).alias("score"))


@query(_nearest_sql("WHERE label = 3", 40))
def engine_vectors_filtered(s, d):
    """A filter that leaves the index fewer rows than are asked for."""
    return _vector_engine(s, d).search(vector=VECTOR, limit=40, container_id="3").select("id", F.round("score", 6).alias("score"))


@query(f"""WITH both_ AS (SELECT doc_id, text, embedding FROM documents JOIN embeddings ON doc_id = vec_id),
 t AS (SELECT doc_id, text, {", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(QUERY.split()))}, len(t) AS len FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '') AS t FROM both_)),
 b AS (SELECT doc_id, {" + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / a))" for i in range(3))} AS s FROM t, (SELECT count(*) AS n, avg(len) AS a, {", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(3))} FROM t)),
 l AS (SELECT doc_id, row_number() OVER (ORDER BY {_DIST}, doc_id) AS rank FROM both_ QUALIFY rank <= 50 UNION ALL SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM b WHERE s > 0 QUALIFY rank <= 50),
 f AS (SELECT doc_id, sum(1.0 / (60 + rank)) AS score, row_number() OVER (ORDER BY sum(1.0 / (60 + rank)) DESC, doc_id) AS rank FROM l GROUP BY doc_id)
 SELECT {_ID} AS id, round(score, 9) AS score FROM f JOIN both_ USING (doc_id) QUALIFY row_number() OVER (PARTITION BY text ORDER BY rank) = 1 ORDER BY rank LIMIT 5""")
def engine_hybrid(s, d):
    e = Engine(s, scratch(s, "engine"), dims=64)
    e.store.upsert("chunks", _chunks(_table(s, d, "documents"), _table(s, d, "embeddings")))
    e.build_index()
    e.create_vector_index(codes=16)
    return e.search(QUERY, VECTOR).select("id", F.round("score", 9).alias("score"))


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')"


@query(rf"""WITH q AS (SELECT conv_id AS query_id, text, embedding FROM conversations JOIN embeddings ON vec_id = conv_id WHERE turn = 1),
 c AS (SELECT doc_id, text, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
 tf AS (SELECT doc_id, t, count(*) AS f FROM (SELECT doc_id, unnest({_WORDS}) AS t FROM c) GROUP BY ALL), size AS (SELECT doc_id, len({_WORDS}) AS l FROM c),
 whole AS (SELECT count(*) AS n, avg(l) AS a FROM size), df AS (SELECT t, count(*) AS d FROM tf GROUP BY t), qt AS (SELECT DISTINCT query_id, unnest({_WORDS}) AS t FROM q),
 s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))), 10) AS s FROM qt JOIN tf USING (t) JOIN df USING (t) JOIN size USING (doc_id), whole GROUP BY ALL),
 v AS (SELECT query_id, doc_id, list_distance(q.embedding, c.embedding) AS x FROM q, c),
 l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM s QUALIFY rank <= 50 UNION ALL
       SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY x, doc_id) AS rank FROM v QUALIFY rank <= 50),
 f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 15) AS score FROM l GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f),
 o AS (SELECT query_id, rank, doc_id, score FROM r JOIN c USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY rank) = 1)
 SELECT query_id, CAST(rank AS INTEGER) AS rank, {_ID} AS id, round(score, 9) AS score FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5""")
def batch_hybrid(s, d):
    """One job for the first turns of all conversations, each with a vector."""
    e, v = Engine(s, scratch(s, "engine"), dims=64), _table(s, d, "embeddings")
    e.store.upsert("chunks", _chunks(_table(s, d, "documents"), v))
    e.build_index()
    asked = _table(s, d, "conversations").where("turn = 1").join(v, F.col("conv_id") == F.col("vec_id")).select(F.col("conv_id").alias("query_id"), "text", F.col("embedding").alias("vector"))
    return e.search_many(asked).select("query_id", "rank", "id", F.round("score", 9).alias("score"))


@query("SELECT l_orderkey || '-' || l_partkey AS id, count(*) AS copies, t AS name FROM lineitem, (VALUES ('messages'), ('chunks')) v(t) GROUP BY ALL HAVING count(*) > 1")
def audit_duplicates(s, d):
    e = Engine(s, scratch(s, "engine"))
    rows = _table(s, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("id"))
    e.store.write("messages", rows)
    e.store.write("chunks", rows)
    return e.audit_duplicates().withColumnRenamed("table", "name")


def _two_stores(s: SparkSession, d: str) -> Fed.Federation:
    out = []
    for host in ("mac", "box"):
        e = Engine(s, scratch(s, "engine"))
        e.store.upsert("messages", messages(s, d).where(F.col("host") == host))
        out.append(Fed.Named(host, e.store.root))
    return Fed.Federation(s, [*out, Fed.Named("gone", scratch(s, "engine"))])


@query(f"""SELECT host AS store, container_id, min(timestamp) AS first_ts, count(*) AS messages FROM {MESSAGES} WHERE kind = 'message' AND timestamp >= 1 GROUP BY host, container_id""")
def federated_sessions(s, d):
    """Of three stores, one of which isn't there."""
    listed, errors = _two_stores(s, d).sessions(1)
    assert list(errors) == ["gone"]
    return listed.select("store", "container_id", "first_ts", "messages")


@query(f"SELECT host AS store, id, timestamp FROM {MESSAGES} WHERE container_id = '4' AND kind = 'message' ORDER BY timestamp, id LIMIT 50")
def federated_walk(s, d):
    page, _ = _two_stores(s, d).walk("4")
    return page.select("store", "id", "timestamp")


@query(f"SELECT id, timestamp, CAST(timestamp AS DOUBLE) AS score FROM {EVENTS} WHERE kind = 'view' ORDER BY timestamp, id LIMIT 10")
def table_scan(s, d):
    return C.scan(events(s, d), 0, kind="view").select("id", "timestamp", "score")


@query(f"SELECT event_id, CAST(least(3600, 30 * pow(2, greatest(event_id % 12 - 1, 0))) AS DOUBLE) AS wait FROM {EVENTS}")
def backoff_delay(s, d):
    return events(s, d).select("event_id", C.backoff(F.col("event_id") % 12).alias("wait"))


@query("SELECT event_id, regexp_extract(n, '[^_]*$') AS pi, CASE WHEN event_id % 2 = 0 THEN 'b-c-d-e-f' || event_id ELSE n END AS other FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'x_a-b-c-d-e-f' || event_id ELSE 's_' || event_id END AS n FROM events)")
def guess_container(s, d):
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("x_a-b-c-d-e-f"), "event_id")).otherwise(F.concat(F.lit("s_"), "event_id"))
    path = F.concat(F.lit("/r/"), name, F.lit(".jsonl"))
    return _table(s, d, "events").select("event_id", X.guess_container(path, F.lit("pi")).alias("pi"), X.guess_container(path, F.lit("codex")).alias("other"))


@query("SELECT doc_id, left(text, 90) AS head FROM documents")
def clip_chars(s, d):
    return _table(s, d, "documents").select("doc_id", X.clip_chars(F.col("text"), 90).alias("head"))


@query("SELECT o_orderkey AS key, CAST(o_custkey AS BIGINT) AS size FROM orders WHERE o_custkey % 3 = 0")
def upload_differences(s, d):
    """Objects without a remote one of their key and size."""
    here = _table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("long").alias("size"))
    return local.differences(here, here.withColumn("size", F.when(F.col("size") % 3 == 0, -1).otherwise(F.col("size"))))


_OLD = "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'h/pi/u/message/' || event_id WHEN 2 THEN 'h/pi/u/' || event_type || '/' || event_id ELSE 'h/pi/u/' || CASE WHEN event_id % 8 = 3 THEN event_id - 2 ELSE event_id END END"


@query(f"""WITH o AS (SELECT event_id, event_type, {_OLD} AS p FROM events) SELECT CASE WHEN p = '' THEN CAST(event_id AS VARCHAR) ELSE replace(p, '/message/', '/') END AS id,
 CASE WHEN event_id % 4 = 2 THEN event_type ELSE 'message' END AS kind FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.event_id % 4 = 1 AND replace(b.p, '/message/', '/') = a.p)""")
def shadow_anti_join(s, d):
    e = _table(s, d, "events")
    fixed = {c: F.lit("") for c in ("forward_content", "harness", "host", "session_id", "project_name", "role", "file_hash")}
    old = e.withColumn("file_path", F.expr(_OLD)).select(F.col("event_id").cast("string").alias("id"), "file_path", *[c.alias(n) for n, c in fixed.items()], F.lit(5).alias("timestamp"), F.lit(1).alias("chunk_count"))
    return M.converted(old, old, False).select("id", "kind")


@query(f"SELECT event_id AS id, message_id FROM (SELECT event_id, 'u' || user_id AS message_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def collapse_message(s, d):
    hits = _table(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("message_id"), "value")
    return S.best_of_message(hits, "message_id", F.desc("value"), "id").select("id", "message_id")


@query(f"SELECT event_id, strftime(ts, '%Y-%m') AS month, CAST({DAY} AS BIGINT) AS day FROM events")
def month_partition(s, d):
    return events(s, d).select("event_id", X.month_format(F.col("timestamp")).alias("month"), F.lit(DAY).cast("long").alias("day"))
