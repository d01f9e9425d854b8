"""Raw transcript objects: keys, lines, and parsers of sessions and chat exports into message rows.

Running state (session, project, pending titles) is a window over one object's lines. An object is bounded by
``LARGEST``, so no window partition outgrows it. Each parser gives rows placed by (at, sub, line_no) in their object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from kelpline.functions import variants as V
from kelpline.functions.text import RESTATING, content_hash, guess_container, indexable, indexed, project_from_cwd, record_id, trim_space

SOURCES = ("pi", "codex", "omp", "claude", "grok", "grokbot", "telegram", "x")
CHATS = ("telegram", "x")
LARGEST, LONGEST_LINE = 128 << 20, 64 << 20
COLUMNS = ("id", "text", "source", "host", "container_id", "container_kind", "container_title", "project", "author_id", "author_name", "kind", "reply_to", "attrs", "content_hash", "timestamp")
PLACE = ("key", "at", "sub", "line_no")


def _so_far() -> WindowSpec:
    return W.partitionBy("key").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)


def _after() -> WindowSpec:
    return W.partitionBy("key").orderBy("line_no").rowsBetween(1, W.unboundedFollowing)


def identify(objects: DataFrame, key: str = "key") -> DataFrame:
    """``objects`` whose key is ``<host>/<source>/.../*.jsonl`` with a known source, with host and source."""
    parts = F.split(F.regexp_replace(key, "^/", ""), "/")
    ok = (F.size(parts) >= 3) & (parts[0] != "") & parts[1].isin(*SOURCES) & F.lower(key).endswith(".jsonl")
    return objects.where(ok).withColumns({"host": parts[0], "source": parts[1]})


def object_key(root: str, path: str = "path") -> Column:
    """What follows ``root`` in a file's path."""
    return F.element_at(F.split(path, r"\Q" + root.split("://")[-1].strip("/") + r"/\E", 2), -1)


def listed(spark: SparkSession, root: str, keys: list[str] | None = None) -> DataFrame:
    """(key, etag, size, content) of the recognised objects under ``root``, or of those named, sorted by key; content is read only where it is used.

    The etag is made of a file's time and size. Objects that are too large have null content and are never read. A missing root has none, and one that goes after the listing is passed over.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    empty = spark.createDataFrame([], "key string, etag string, size long, content binary")
    if keys is not None and not keys or not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return empty
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    if keys is None:
        files = files.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]").load(root)
    else:
        special = str.maketrans({c: "\\" + c for c in "\\{}[]*?^"})
        files = files.load([f"{root.rstrip('/')}/{k.translate(special)}" for k in keys])
    named = files.select(object_key(root).alias("key"), F.concat_ws("-", F.unix_millis("modificationTime"), "length").alias("etag"), F.col("length").alias("size"), "content")
    fit = named.where(F.col("size") <= LARGEST).unionByName(named.where(F.col("size") > LARGEST).withColumn("content", F.lit(None).cast("binary"))) if keys is None else named
    return identify(fit).drop("host", "source").orderBy("key")


def failures(objects: DataFrame) -> DataFrame:
    """(key, error) of recognised objects that are too large or have a line that is too long."""
    long_line = (F.octet_length("content") > LONGEST_LINE) & F.exists(F.split(F.col("content").cast("string"), "\n"), lambda t: F.octet_length(t) > LONGEST_LINE)
    size = F.col("size") if "size" in objects.columns else F.octet_length("content")
    error = F.when(size > LARGEST, "object too large").when(long_line, "line too long")
    return identify(objects).select("key", error.alias("error")).where(F.col("error").isNotNull())


def lines(objects: DataFrame) -> DataFrame:
    """(key, host, source, line_no, line): non-blank lines of each object's ``content``, numbered from 1 as they stand.

    Where ``content`` is what an object has grown by, ``old`` says what held before it and ``pending`` has earlier lines that still wait (see ``sources.resume``).
    Objects named by ``failures`` give no lines.
    """
    split = F.split(F.make_valid_utf8(F.col("content").cast("string")), "\n")  # what is no UTF-8 becomes U+FFFD
    short = F.octet_length("content") <= LONGEST_LINE // 3  # a byte that is no UTF-8 becomes three
    fit = objects.where(F.octet_length("content") <= LARGEST).where(short | ~F.exists(split, lambda t: F.octet_length(t) > LONGEST_LINE))
    old = [c for c in ("old",) if c in objects.columns]
    each = fit.select("key", "host", "source", *old, F.posexplode(split).alias("n", "raw")).where(F.col("raw").rlike(r"(?U)\S"))
    passed = F.coalesce("old.lines", F.lit(0).cast("long")) if old else F.lit(0)
    own = each.select("key", "host", "source", *old, (F.col("n") + 1 + passed).cast("int").alias("line_no"), trim_space(F.col("raw")).alias("line"))
    return own.withColumn("then", F.lit(None).cast("long")).unionByName(fit.select("key", "host", "source", *old, F.inline("pending"))) if old else own


def entries(rows: DataFrame) -> DataFrame:
    """Lines that hold a JSON object, as ``v`` with its ``type``."""
    more = [c for c in ("old", "line", "then") if "old" in rows.columns]
    object = F.filter(F.array(F.try_parse_json("line")), lambda v: F.schema_of_variant(v).startswith("OBJECT"))  # a filter on ``v`` itself would parse each line twice
    return rows.select("key", "host", "source", "line_no", *more, F.explode(object).alias("v")).withColumn("type", V.string(F.col("v"), "$.type"))


def _stem() -> Column:
    return F.regexp_replace(F.element_at(F.split("key", "/"), -1), r"\.[^.]*$", "")


def _old(rows: DataFrame, field: str, default: Column) -> Column:
    """What held before the first of these lines."""
    return F.coalesce(F.col("old")[field], default) if "old" in rows.columns else default


def _told(rows: DataFrame, seen: DataFrame | None, mark: Column) -> DataFrame:
    """``rows`` with ``told``: whether an earlier part of the object has ``mark``, one of ``seen`` (key, mark)."""
    if seen is None:
        return rows.withColumn("told", F.lit(False))
    return rows.withColumn("mark", mark).join(seen.withColumn("told", F.lit(True)), ["key", "mark"], "left").withColumn("told", F.coalesce("told", F.lit(False))).drop("mark")


def _latest(value: Column, default: Column | str) -> Column:
    return F.coalesce(F.last(value, ignorenulls=True).over(_so_far()), F.lit(default) if isinstance(default, str) else default)


def _record(kind: Column | str, turn: Column, role: Column | str, text: Column, when: Column, sub: Column | int = 1, name: str = "", waits: Column | None = None, ref: Column | None = None) -> Column:
    """A candidate row. ``waits``: it takes session, project and place of the next header; ``ref``: the call it answers."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(kind).alias("kind"), turn.alias("turn"), lit(role).alias("role"), text.alias("text"), when.cast("long").alias("when"), lit(sub).cast("int").alias("sub"),
        F.lit(name).alias("name"), (waits if waits is not None else F.lit(False)).alias("waits"), (ref if ref is not None else F.lit(None).cast("string")).alias("ref"),
    )


def _emit(rows: DataFrame, found: Column) -> DataFrame:
    """Explode the candidates ``found`` of each line; those without a text go."""
    keep = [c for c in ("key", "host", "source", "line_no", "session", "project", "header")]
    made = rows.select(*keep, found.alias("found"))  # ahead of the generator, whose own expressions are interpreted
    r = made.select(*keep, F.explode(F.filter("found", lambda r: r.isNotNull() & (r["text"] != ""))).alias("r")).where(~F.col("r.waits") | F.col("header").isNotNull())
    waits = F.col("r.waits")
    session = F.when(waits, F.col("header.session")).otherwise(F.col("session"))
    part = F.when(F.col("r.kind") == "message", F.col("r.turn")).otherwise(F.concat_ws("/", "r.kind", "r.turn"))
    return r.select(
        record_id(F.col("host"), F.col("source"), session, part).alias("id"), F.col("r.text").alias("text"), "source", "host", session.alias("container_id"),
        F.lit("agent_session").alias("container_kind"), F.lit("").alias("container_title"), F.when(waits, F.col("header.project")).otherwise(F.col("project")).alias("project"),
        F.col("r.role").alias("author_id"), F.col("r.name").alias("author_name"), F.col("r.kind").alias("kind"), F.lit("").alias("reply_to"), F.lit("").alias("attrs"),
        content_hash(F.col("r.text")).alias("content_hash"), F.when(F.col("r.when") == 0, 1).otherwise(F.col("r.when")).cast("long").alias("timestamp"),
        "key", F.when(waits, F.col("header.at")).otherwise(F.col("line_no")).cast("long").alias("at"), F.when(waits, 0).otherwise(F.col("r.sub")).alias("sub"), F.col("line_no").cast("long").alias("line_no"), F.col("r.ref").alias("ref"),
    )


def _state(rows: DataFrame, session: Column, project: Column, heads: Column) -> DataFrame:
    """The running session and project, and the next line for which ``heads`` holds, as ``header``."""
    known = rows.withColumns({"session": session, "project": project})
    return known.withColumn("header", F.first(F.when(heads, F.struct("session", "project", F.col("line_no").alias("at"))), ignorenulls=True).over(_after()))


def parse_pi(rows: DataFrame) -> DataFrame:
    """Sessions of pi, omp and grokbot: a ``session`` line sets container and project of what follows."""
    e, v = entries(rows), F.col("v")
    head, own, kind = F.col("type") == "session", V.string(v, "$.id"), F.col("type")
    e = _state(e, _latest(F.when(head, F.nullif(own, F.lit(""))), _old(e, "session", _stem())), _latest(F.when(head, project_from_cwd(V.string(v, "$.cwd"))), _old(e, "project", F.lit("unknown"))), head)
    e = e.withColumns({"own": own, "role": V.string(v, "$.message.role")})  # used several times
    own, role = F.col("own"), F.col("role")
    turn = F.when(own != "", own).otherwise(F.concat(F.lit("line-"), F.col("line_no").cast("string")))
    named, changed, sent = V.moment(v, "$.updatedAt", "$.timestamp"), V.moment(v, "$.timestamp"), V.moment(v, "$.timestamp", "$.message.timestamp")
    tool, text, voice = V.string(v, "$.message.toolName"), V.spoken(v, "$.message.content"), V.spoken(v, "$.content")
    custom = V.string(v, "$.customType")
    record = (
        F.when(head, _record("title", F.concat(turn, F.lit("-session")), "system", V.title(v, "session"), named))
        .when(kind.isin("title", "title_change"), _record("title", turn, "system", V.title(v, kind), named, waits=F.col("project") == "unknown"))
        .when((kind == "custom") & (custom == "user_todo_edit"), _record("todo", turn, "user_todo_edit", V.todo(v, "user_todo_edit"), changed))
        .when((kind == "custom_message") & (custom == "live-delegation"), _record("message", turn, "user", indexed(F.lit("user"), voice), changed, name="user (voice)"))
        .when((kind == "message") & (role == "toolResult") & (tool == "todo"), _record("todo", turn, role, V.todo(v, "todo", "$.message"), sent))
        .when((kind == "message") & (role == "toolResult") & (tool == "task"), _record("task", turn, role, V.tool_result(v, "task", "$.message"), sent))
        .when(kind == "message", _record("message", turn, role, indexed(role, text), sent))
    )
    return _emit(e, F.array(record)).drop("ref")


def clock(e: DataFrame) -> Column:
    """The last time told so far; a line that still waits brings the one of its place."""
    now = F.nullif(V.moment(F.col("v"), "$.timestamp"), F.lit(0).cast("long"))
    if "old" not in e.columns:
        return _latest(now, F.lit(0).cast("long"))
    earlier = F.col("line_no") <= F.coalesce("old.lines", F.lit(0))
    return F.when(earlier, F.coalesce("then", F.lit(0).cast("long"))).otherwise(_latest(F.when(~earlier, now), F.coalesce("old.clock", F.lit(0).cast("long"))))


def title_mark(title: Column) -> Column:
    return F.concat(F.lit("t:"), content_hash(title))


def call_mark(ref: Column) -> Column:
    return F.concat(F.lit("c:"), ref)


def is_call(p: Column) -> Column:
    """Whether a part of a message starts a task."""
    return (V.string(p, "$.type") == "tool_use") & V.string(p, "$.name").isin("Agent", "Task")


def parts_of(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))


def parse_claude(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Sessions named by their file; the project is the first known working directory; tool calls are rows of their own."""
    e, v = entries(rows), F.col("v")
    cwd, kind, text = V.string(v, "$.cwd"), F.col("type"), V.spoken(v, "$.message.content")
    project = F.coalesce(F.nullif(_old(e, "project", F.lit(None)), F.lit("unknown")), F.first(F.nullif(project_from_cwd(cwd), F.lit("unknown")), ignorenulls=True).over(_so_far()), F.lit("unknown"))
    now = V.moment(v, "$.timestamp")
    e = _state(e, _stem(), project, cwd != "").withColumn("clock", clock(e))
    e = e.withColumn("title", F.when(kind.isin("ai-title", "custom-title", "summary"), F.nullif(V.title(v, kind), F.lit(""))))
    e = _told(e, seen, title_mark(F.col("title")))
    e = e.withColumn("once", (F.row_number().over(W.partitionBy("key", "title").orderBy("line_no")) == 1) & ~(F.col("told") & (F.col("line_no") > _old(e, "lines", F.lit(0)))))
    role, uuid = V.string(v, "$.message.role"), V.string(v, "$.uuid")
    title = F.when(
        F.col("title").isNotNull() & F.col("once"),
        _record("title", F.concat(F.lit("title-"), F.left(content_hash(F.col("title")), F.lit(16))), "system", F.col("title"), F.col("clock"), waits=F.col("project") == "unknown"),
    )
    message = F.when(indexable(role, text) & (uuid != "") & ~text.startswith("<local-command-stdout>"), _record("message", uuid, role, text, now, sub=2**31 - 1))
    async_start = V.is_true(v, "$.toolUseResult.isAsync")

    def part(p: Column, i: Column) -> Column:
        what, name, own, answers = V.string(p, "$.type"), V.string(p, "$.name"), V.string(p, "$.id"), V.string(p, "$.tool_use_id")
        use = what == "tool_use"
        return (
            F.when(use & (name == "TodoWrite"), _record("todo", own, role, V.todo(p, "TodoWrite", "$.input"), now, i + 1))
            .when(is_call(p), _record("call", own, role, F.lit("call"), now, i + 1, ref=own))
            .when(use & (name == "Bash"), _record("tool", own, role, V.command(p, "$.input"), now, i + 1))
            .when((what == "tool_result") & ~async_start, _record("task", answers, "toolResult", V.tool_result(p, "task"), now, i + 1, ref=answers))
        )

    parts = F.transform(parts_of(v), part)
    said = kind.isin("user", "assistant") & ~V.is_true(v, "$.isMeta")
    out = _emit(e, F.when(said, F.concat(parts, F.array(message))).otherwise(F.array(title)))
    called = F.min(F.when(F.col("kind") == "call", F.struct("at", "sub"))).over(W.partitionBy("key", "ref"))
    out = _told(out.withColumn("called", called), seen, call_mark(F.col("ref")))
    known = F.col("told") | F.coalesce(F.col("called") < F.struct("at", "sub"), F.lit(False))
    return out.where((F.col("kind") != "call") & ((F.col("kind") != "task") | known)).drop("called", "ref", "told")


def codex_said(v: Column) -> Column:
    """What tells a message of codex from others, null for lines that are none."""
    own, role, text = trim_space(V.string(v, "$.payload.id")), V.string(v, "$.payload.role"), V.spoken(v, "$.payload.content")
    said = (V.string(v, "$.type") == "response_item") & (V.string(v, "$.payload.type") == "message") & indexable(role, text)
    return F.when(said, F.when(own != "", own).otherwise(F.concat(F.lit("legacy-"), F.left(content_hash(text), F.lit(16)))))


def said_mark(same: Column) -> Column:
    return F.concat(F.lit("k:"), same)


def parse_codex(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Sessions with a ``session_meta`` line; messages are told apart by their id, or by their text where they have none."""
    e, v = entries(rows), F.col("v")
    head, own = F.col("type") == "session_meta", trim_space(V.string(v, "$.payload.id"))
    named = V.string(v, "$.payload.id")
    session = _latest(F.when(head, F.nullif(named, F.lit(""))), _old(e, "session", _stem()))
    e = _state(e, session, _latest(F.when(head, project_from_cwd(V.string(v, "$.payload.cwd"))), _old(e, "project", F.lit("unknown"))), head)
    role, text, now = V.string(v, "$.payload.role"), V.spoken(v, "$.payload.content"), V.moment(v, "$.timestamp")
    e = _told(e.withColumn("same", codex_said(v)), seen, said_mark(F.col("same")))
    e = e.withColumn("once", (F.row_number().over(W.partitionBy("key", "same").orderBy("line_no")) == 1) & ~F.col("told"))
    turn = F.when(own != "", own).otherwise(F.concat(F.lit("line-"), (F.col("line_no") - 1).cast("string")))
    record = F.when(head, _record("title", F.concat(named, F.lit("-session")), "system", V.title(v, "session", "$.payload"), now)).when(
        F.col("same").isNotNull() & F.col("once"), _record("message", turn, role, text, now)
    )
    return _emit(e, F.array(record)).drop("ref")


def parse_turns(rows: DataFrame) -> DataFrame:
    """Messages of pi, omp and codex as the older local sync read them: the session is guessed from the file's name until a header names it, the project stays where a header has none,
    a message of pi without an id is left out, and one of codex without an id has the start of its text's hash for one."""
    e, v = entries(rows), F.col("v")
    codex, own, kind = F.col("source") == "codex", V.string(v, "$.id"), F.col("type")
    head = F.when(codex, kind == "session_meta").otherwise(kind == "session")
    field = lambda name: F.when(codex, V.string(v, f"$.payload.{name}")).otherwise(V.string(v, f"$.{name}"))
    cwd = F.when(head, F.nullif(field("cwd"), F.lit("")))
    e = _state(e, _latest(F.when(head, F.nullif(field("id"), F.lit(""))), guess_container(F.col("key"), F.col("source"))), _latest(F.when(cwd.isNotNull(), project_from_cwd(cwd)), "unknown"), F.lit(False))
    voice = (kind == "custom_message") & (V.string(v, "$.customType") == "live-delegation")
    said = F.when(codex, (kind == "response_item") & (V.string(v, "$.payload.type") == "message")).otherwise(voice | (kind == "message"))
    role = F.when(codex, V.string(v, "$.payload.role")).when(voice, "user").otherwise(V.string(v, "$.message.role"))
    text = F.when(codex, V.spoken(v, "$.payload.content")).when(voice, V.spoken(v, "$.content")).otherwise(V.spoken(v, "$.message.content"))
    e = e.withColumns({"role": role, "said": F.when(said, text), "when": F.when(codex | voice, V.moment(v, "$.timestamp")).otherwise(V.moment(v, "$.timestamp", "$.message.timestamp"))})
    named = F.nullif(trim_space(V.string(v, "$.payload.id")), F.lit(""))
    turn = F.when(codex, F.coalesce(named, F.left(content_hash(F.col("said")), F.lit(16)))).otherwise(F.nullif(own, F.lit("")))
    e = e.where(indexable(F.col("role"), F.col("said"))).withColumn("turn", turn).where("turn IS NOT NULL")
    e = e.withColumn("once", ~codex | (F.row_number().over(W.partitionBy("key", "turn").orderBy("line_no")) == 1))
    return _emit(e.where("once"), F.array(_record("message", F.col("turn"), F.col("role"), F.col("said"), F.col("when")))).drop("ref")


def grok_said(v: Column) -> tuple[Column, Column, Column]:
    """(whether an update is kept, its role, its text)."""
    u = "$.params.update"
    what, text = V.string(v, f"{u}.sessionUpdate"), trim_space(V.string(v, f"{u}.content.text"))
    role = F.when(what == "user_message_chunk", "user").when(what == "agent_message_chunk", "assistant").otherwise("")
    return (V.string(v, "$.method") == "session/update") & ~text.startswith("<runtime_info>") & indexable(role, text), role, text


def parse_grok(rows: DataFrame) -> DataFrame:
    """Session updates; the project is in the path, the session in the updates that are kept."""
    m = "$.params._meta"
    e, v = entries(rows), F.col("v")
    kept, role, text = grok_said(v)
    e = e.where(kept)
    folder = F.coalesce(F.try_element_at(F.split("key", "/"), F.lit(-3)), F.lit(""))
    project = F.coalesce(project_from_cwd(F.try_url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))), F.lit("unknown"))
    e = _state(e, _latest(F.nullif(V.string(v, "$.params.sessionId"), F.lit("")), _old(e, "session", _stem())), project, F.lit(False))
    event = V.string(v, f"{m}.eventId")
    turn = F.when(event != "", event).otherwise(F.concat(F.lit("line-"), F.col("line_no").cast("string")))
    return _emit(e, F.array(_record("message", turn, role, text, V.moment(v, f"{m}.agentTimestampMs", "$.timestamp")))).drop("ref")


def parse_chat(rows: DataFrame) -> DataFrame:
    """Messages of chat exports: the last version of an id wins and keeps the first one's place; emptied messages go.

    A line with a field of the wrong type goes; the loose extra fields may be of any type.
    """
    v = F.col("v")
    texts = ("id", "chat_id", "chat_type", "chat_title", "topic_id", "sender_id", "sender_name", "reply_to", "fwd_from", "media", "text")
    numbers = ("date", "edit_date")
    ok = F.lit(True)
    for name in texts:
        ok = ok & V.type_of(V.at(v, f"$.{name}")).isin("STRING", "VOID")
    for name in numbers:
        ok = ok & V.type_of(V.at(v, f"$.{name}")).isin("BIGINT", "VOID")
    extra = {k: V.present(V.at(v, f"$.{k}")) for k in ("encrypted", "message_id", "sender_handle", "source_account", "verified")}
    given = lambda k: F.nullif(V.string(v, f"$.{k}"), F.lit(""))
    number = lambda k: F.nullif(F.coalesce(F.try_variant_get(v, f"$.{k}", "long"), F.lit(0)), F.lit(0).cast("long"))
    attrs = F.to_json(F.struct(number("edit_date").alias("edit_date"), extra["encrypted"].alias("encrypted"), given("fwd_from").alias("fwd_from"), given("media").alias("media"),
                               *[extra[k].alias(k) for k in ("message_id", "sender_handle", "source_account", "verified")]))
    read = entries(rows).where(ok).select(
        "key", "host", "source", "line_no", *[V.string(v, f"$.{k}").alias(k) for k in texts], F.coalesce(number("date"), F.lit(1)).cast("long").alias("timestamp"), F.when(attrs == "{}", "").otherwise(attrs).alias("attrs"),
    ).where("id <> '' AND chat_id <> ''").withColumn("container_id", F.concat_ws(":", "chat_id", F.nullif("topic_id", F.lit(""))))
    last = read.groupBy("key", "host", "source", "container_id", "id").agg(
        F.max_by(F.struct("chat_type", "chat_title", "sender_id", "sender_name", "reply_to", "text", "timestamp", "attrs"), "line_no").alias("m"), F.min("line_no").cast("long").alias("line_no")
    )
    full = lambda c: record_id(F.col("host"), F.col("source"), F.col("container_id"), c)
    text = trim_space(F.col("m.text"))
    return last.where(text != "").select(
        full(F.col("id")).alias("id"), text.alias("text"), "source", "host", "container_id", F.col("m.chat_type").alias("container_kind"), F.col("m.chat_title").alias("container_title"),
        F.lit("").alias("project"), F.col("m.sender_id").alias("author_id"), F.col("m.sender_name").alias("author_name"), F.lit("message").alias("kind"),
        F.when(F.col("m.reply_to") != "", full(F.col("m.reply_to"))).otherwise("").alias("reply_to"), "m.attrs", content_hash(text).alias("content_hash"), "m.timestamp",
        "key", F.col("m.timestamp").alias("at"), F.lit(0).alias("sub"), "line_no",
    )


def restates() -> tuple[Column, Column]:
    """(whether a row is a user's message, whether it opens with a restating prompt)."""
    opens = F.lit(False)
    for p in RESTATING:
        opens = opens | F.regexp_replace("text", r"(?U)^\s+", "").startswith(p)
    return (F.col("kind") == "message") & (F.col("author_id") == "user"), opens


def drop_restating(rows: DataFrame) -> DataFrame:
    """Without the objects whose first user message opens with a restating prompt."""
    user, opens = restates()
    w = W.partitionBy("key").orderBy("at", "sub", "line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.withColumn("_skip", F.coalesce(F.first(F.when(user, opens), ignorenulls=True).over(w), F.lit(False))).where("NOT _skip").drop("_skip")


def sources_of(objects: DataFrame) -> list[str]:
    """The sources that the objects are of; ``parse`` then plans no others."""
    return [r.source for r in identify(objects).select("source").distinct().collect()]  # eight at most


def parse(objects: DataFrame, state: bool = True, sources: list[str] | None = None, seen: DataFrame | None = None, restating: bool = False) -> DataFrame:
    """Message rows of all recognised objects (key, content), with their place; without titles, todos, tasks and tools unless ``state``.

    Objects of other than ``sources`` are passed over. Each parser that is needed reads the objects once. With ``restating``, objects that open with a restating prompt stay.
    ``seen`` (key, mark) is what earlier parts of the objects have had.
    """
    rows = lines(identify(objects))
    want = SOURCES if sources is None else sources
    parsers = ((parse_pi, ("pi", "omp", "grokbot")), (parse_claude, ("claude",)), (parse_codex, ("codex",)), (parse_grok, ("grok",)), (parse_chat, CHATS))
    out = None
    for f, names in parsers:
        if mine := [n for n in names if n in want]:
            own = rows.where(F.col("source").isin(*mine))
            part = f(own, seen) if f in (parse_claude, parse_codex) else f(own)
            part = part if f is parse_chat or restating else drop_restating(part)
            out = part if out is None else out.unionByName(part)
    out = parse_chat(rows.limit(0)) if out is None else out
    return out if state else out.where("kind = 'message'")
