"""Parsing what sessions have grown by: a parser's state is kept for each object, so that only new lines are read.

State: how many lines there were, the running session, project and clock, whether the object opens with a restating prompt, titles
that still wait for a header, with the clock of their place, marks of what counts once in an object (messages of codex, titles and calls of claude), and each container's last title and question. All of it is made by
aggregates over the new lines and the state before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.functions import variants as V
from kelpline.functions.text import project_from_cwd
from kelpline.operators import contextual as U
from kelpline.sources import jsonl

#: Sources whose objects only ever grow at their end; in exports of chats a later line can edit an earlier message, so they are parsed whole.
GROWING = tuple(s for s in jsonl.SOURCES if s not in jsonl.CHATS)
STATE = (
    "lines long, session string, project string, clock long, skip boolean, pending array<struct<line_no:int,line:string,then:long>>, seen array<string>, "
    "containers array<struct<container_id:string,title:string,asked:string>>"
)
FIELDS = ("lines", "session", "project", "clock", "skip", "pending", "seen", "containers")
_SCALARS = ("lines", "session", "project", "clock", "skip")


def continued(objects: DataFrame, before: DataFrame | None) -> DataFrame:
    """``objects`` (key, content: new lines) with ``old`` and the other fields of their state ``before`` them (key and ``STATE``); null for those without one."""
    known = objects.sparkSession.createDataFrame([], f"key string, {STATE}") if before is None else before
    joined = jsonl.identify(objects.select("key", "content")).where(F.col("source").isin(*GROWING)).join(known, "key", "left")
    none = F.array().cast("array<struct<line_no:int,line:string,then:long>>")
    return joined.select("key", "content", F.struct(*_SCALARS).alias("old"), F.coalesce("pending", none).alias("pending"), F.coalesce("seen", F.array().cast("array<string>")).alias("seen"), "containers")


def rows(objects: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Rows of the new lines of ``continued`` objects, as a parse of the whole objects has them; those of objects that restate are there too."""
    open_ = objects.where(~F.coalesce("old.skip", F.lit(False)))
    seen = objects.select("key", F.explode("seen").alias("mark"))
    return jsonl.parse(open_, sources=[s for s in sources or GROWING if s in GROWING], seen=seen, restating=True)


def restating(objects: DataFrame, found: DataFrame) -> DataFrame:
    """(key, skip): whether an object's first user message opens with a restating prompt; null as long as there is none."""
    user, opens = jsonl.restates()
    first = found.where(user).groupBy("key").agg(F.min_by(opens, F.struct("at", "sub", "line_no")).alias("now"))
    return objects.select("key", "old.skip").join(first, "key", "left").select("key", F.coalesce("skip", "now").alias("skip"))


def units(objects: DataFrame, found: DataFrame) -> DataFrame:
    """The units of ``rows``, without those of objects that restate."""
    gone = restating(objects, found).where("skip").select("key")
    before = objects.where("containers IS NOT NULL").select("key", F.inline("containers"))
    return U.units(found.join(gone, "key", "left_anti"), before, list(GROWING))


def state(objects: DataFrame, found: DataFrame) -> DataFrame:
    """(key and ``STATE``) after the new lines."""
    source, v = F.col("source"), F.col("v")
    e = jsonl.entries(jsonl.lines(jsonl.identify(objects)))
    claude, codex, grok = source == "claude", source == "codex", source == "grok"
    head = F.when(codex, F.col("type") == "session_meta").when(claude | grok, False).otherwise(F.col("type") == "session")
    given = lambda path: F.nullif(V.string(v, path), F.lit(""))
    session = F.when(grok, F.when(jsonl.grok_said(v)[0], given("$.params.sessionId"))).when(head, F.when(codex, given("$.payload.id")).otherwise(given("$.id")))
    cwd = F.when(codex, V.string(v, "$.payload.cwd")).otherwise(V.string(v, "$.cwd"))
    project = F.when(claude, F.nullif(project_from_cwd(cwd), F.lit("unknown"))).when(head, project_from_cwd(cwd))
    title = F.when(claude, F.col("type").isin("ai-title", "custom-title", "summary") & (V.title(v, F.col("type")) != "")).when(codex | grok, False).otherwise(F.col("type").isin("title", "title_change"))
    said = F.col("type").isin("user", "assistant") & ~V.is_true(v, "$.isMeta")
    calls = F.transform(F.filter(jsonl.parts_of(v), jsonl.is_call), lambda p: jsonl.call_mark(V.string(p, "$.id")))
    none = F.array().cast("array<string>")
    marks = (
        F.when(codex, F.array_compact(F.array(jsonl.said_mark(jsonl.codex_said(v)))))
        .when(claude & title, F.array(jsonl.title_mark(V.title(v, F.col("type")))))
        .when(claude & said, calls)
        .otherwise(none)
    )
    line = F.col("line_no")
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), line))
    each = e.select("key", "line_no", "line", claude.alias("claude"), session.alias("session"), project.alias("project"), F.when(claude, cwd != "").otherwise(head).alias("head"), F.coalesce(title, F.lit(False)).alias("title"), F.when(claude, jsonl.clock(e)).alias("clock"), marks.alias("marks"))
    new = each.groupBy("key").agg(
        last(F.col("session")).alias("n_session"),
        F.when(F.any_value("claude"), F.min_by("project", F.when(F.col("project").isNotNull(), line))).otherwise(last(F.col("project"))).alias("n_project"),
        F.max_by("clock", line).alias("n_clock"), F.max(F.when(F.col("head"), line)).alias("n_head"),
        F.collect_list(F.when(F.col("title"), F.struct(line, "line", F.col("clock").alias("then")))).alias("titles"), F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks"), F.any_value("claude").alias("claude"),
    )
    held = U.carried(found, objects.where("containers IS NOT NULL").select("key", F.inline("containers")))
    containers = held.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("container_id", "title", "asked"))).alias("containers"))
    breaks = F.size(F.split(F.make_valid_utf8(F.col("content").cast("string")), "\n")) - 1
    all = objects.select("key", "old", "seen", breaks.alias("breaks")).join(new, "key", "left").join(containers, "key", "left").join(restating(objects, found), "key", "left")
    kept = F.coalesce(F.nullif(F.when(F.col("claude"), F.col("old.project")), F.lit("unknown")), "n_project", "old.project")
    waits = F.filter("titles", lambda t: t["line_no"] > F.coalesce("n_head", F.lit(0)))
    return all.select(
        "key", (F.coalesce("old.lines", F.lit(0).cast("long")) + F.col("breaks")).alias("lines"), F.coalesce("n_session", "old.session").alias("session"), kept.alias("project"), F.coalesce("n_clock", "old.clock").alias("clock"), "skip",
        F.when(F.coalesce(kept, F.lit("unknown")) == "unknown", F.coalesce(waits, F.array())).otherwise(F.array()).cast("array<struct<line_no:int,line:string,then:long>>").alias("pending"),
        F.array_distinct(F.concat("seen", F.coalesce("marks", none))).alias("seen"), F.coalesce("containers", F.array().cast("array<struct<container_id:string,title:string,asked:string>>")).alias("containers"),
    )
