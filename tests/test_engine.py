import json
import random

import pytest
from pyspark.sql import functions as F

from kelpline import scenarios
from kelpline.engine import Engine
from kelpline.functions.text import trim_space
from kelpline.operators import containers as C
from kelpline.operators import contextual as U
from kelpline.sources import jsonl
from kelpline.streaming import ingest

T = "2024-01-01T00:00:00Z"
NOON = 1704067200


def _said(role, content, **more):
    return {"timestamp": T, "message": {"role": role, "content": content}} | more


OBJECTS = {
    "h/pi/a/f.jsonl": [
        {"type": "title", "id": "t", "title": "Early", "timestamp": 7},
        {"type": "session", "id": "s1", "cwd": "/home/me/boat/"},
        _said("user", [{"type": "text", "text": " please mend the boat "}], type="message", id="u1"),
        {"type": "message", "timestamp": 1704067260000, "message": {"role": "assistant", "content": [{"type": "thinking", "text": "hm"}, {"type": "text", "text": "the boat is mended"}]}},
        {"type": "message", "id": "td", "message": {"role": "toolResult", "toolName": "todo", "details": {"phases": [1, 2]}}},
        {"type": "custom_message", "customType": "live-delegation", "id": "v", "content": "say it aloud please"},
        _said("user", "# AGENTS.md and the like", type="message", id="skip"),
    ],
    "h/pi/a/never.jsonl": [{"type": "title", "id": "t", "title": "No header follows", "timestamp": 7}],
    "h/pi/a/restates.jsonl": [_said("user", 'Summarize the relationship with "Bo" now', type="message", id="m"), _said("assistant", "a summary of it all", type="message", id="n")],
    "h/claude/p/s.jsonl": [
        {"type": "summary", "summary": "Boat work"},
        {"type": "summary", "summary": "Boat work"},
        _said("user", "please mend the boat", type="user", uuid="u1", cwd="/x/boat"),
        _said("assistant", [{"type": "text", "text": "mending it now"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls", "description": "List"}}, {"type": "tool_use", "id": "t2", "name": "Task"}, {"type": "tool_use", "id": "t3", "name": "TodoWrite", "input": {"todos": [{"b": "<x>", "a": 1}]}}], type="assistant", uuid="a1"),
        _said("user", [{"type": "tool_result", "tool_use_id": "t2", "content": "done it"}, {"type": "tool_result", "tool_use_id": "t9", "content": "unasked"}], type="user", uuid="u2"),
        _said("user", "meta lines are left out", type="user", uuid="u3", isMeta=True),
    ],
    "h/codex/a/r.jsonl": [
        {"type": "session_meta", "timestamp": T, "payload": {"id": "c1", "cwd": "/x/y"}},
        *2 * [{"type": "response_item", "timestamp": T, "payload": {"type": "message", "role": "user", "content": [{"text": "hello there you"}]}}],
    ],
    "h/grok/%2Fhome%2Fsea+x/g1/updates.jsonl": [
        {"method": "session/update", "timestamp": 5, "params": {"sessionId": "g1", "update": {"sessionUpdate": "user_message_chunk", "content": {"text": "what is the tide"}}, "_meta": {"eventId": "e1", "agentTimestampMs": 1704067260123}}}
    ],
    "h/telegram/c/2024.JSONL": [
        {"id": "1", "chat_id": "9", "chat_type": "group", "chat_title": 'The "Crew"', "date": 50, "sender_id": "3", "text": "first"},
        {"id": "2", "chat_id": "9", "chat_type": "group", "chat_title": 'The "Crew"', "date": 100, "sender_name": "Ann", "text": "second"},
        {"id": "3", "chat_id": "9", "chat_type": "group", "date": 900, "sender_name": "Bo", "text": "third", "reply_to": "1"},
        {"id": "4", "chat_id": "9", "chat_type": "group", "date": 950, "text": " ", "reply_to": "1"},
        {"id": "1", "chat_id": "9", "chat_type": "group", "chat_title": 'The "Crew"', "date": 50, "sender_id": "3", "text": "edited", "media": "photo", "verified": True},
        {"id": 5, "chat_id": "9", "text": "a number is no id"},
    ],
    "h/notes/a/x.jsonl": [{"type": "session"}],
    "pi/a.jsonl": [{"type": "session"}],
}


def _objects(spark, objects=OBJECTS, etag="a"):
    rows = [(k, etag, len(v), bytearray("\n".join(map(json.dumps, v)).encode() + b"\n\nnot json\n[1]\n")) for k, v in objects.items()]
    return spark.createDataFrame(rows, "key string, etag string, size long, content binary")


def test_parsers(spark):
    rows = {r.id: r for r in jsonl.parse(_objects(spark)).collect()}
    texts = {
        "h/pi/s1/title/t": "TITLE title: Early", "h/pi/s1/u1": "please mend the boat", "h/pi/s1/line-4": "the boat is mended", "h/pi/s1/todo/td": "TODO todo:\n[1,2]", "h/pi/s1/v": "say it aloud please",
        "h/claude/s/title/title-5be0b56b2d221635": "TITLE summary: Boat work", "h/claude/s/u1": "please mend the boat", "h/claude/s/a1": "mending it now", "h/claude/s/tool/t1": "Ran: List\n$ ls",
        "h/claude/s/todo/t3": 'TODO TodoWrite:\n[{"a":1,"b":"\\u003cx\\u003e"}]', "h/claude/s/task/t2": "TOOL task RESULT:\ndone it", "h/codex/c1/line-1": "hello there you", "h/grok/g1/e1": "what is the tide",
        "h/telegram/9/1": "edited", "h/telegram/9/2": "second", "h/telegram/9/3": "third",
    }
    assert {k: r.text for k, r in rows.items()} == texts
    assert rows["h/pi/s1/title/t"].project == rows["h/pi/s1/u1"].project == rows["h/claude/s/title/title-5be0b56b2d221635"].project == "boat"
    assert rows["h/grok/g1/e1"].project == "sea+x" and rows["h/grok/g1/e1"].timestamp == rows["h/pi/s1/line-4"].timestamp == NOON + 60
    assert rows["h/pi/s1/v"].author_name == "user (voice)" and rows["h/pi/s1/todo/td"].timestamp == 1
    assert rows["h/telegram/9/3"].reply_to == "h/telegram/9/1" and json.loads(rows["h/telegram/9/1"].attrs) == {"media": "photo", "verified": True}
    assert {r.kind for r in jsonl.parse(_objects(spark), state=False).collect()} == {"message"}


def test_parsers_take_empty_objects(spark):
    empty = spark.createDataFrame([("h/claude/a/x.jsonl", bytearray(b"")), ("h/x/a/y.jsonl", None)], "key string, content binary")
    assert jsonl.parse(empty).count() == 0 and jsonl.parse(empty.limit(0)).count() == 0


def test_bytes_that_are_no_text_are_replaced(spark):
    line = b'{"type":"message","id":"m","timestamp":5,"message":{"role":"user","content":"a broken \xff byte"}}\n'
    rows = jsonl.parse(spark.createDataFrame([("h/pi/a/x.jsonl", bytearray(line))], "key string, content binary"), sources=["pi"]).collect()
    assert [r.text for r in rows] == ["a broken \ufffd byte"]


def test_units(spark):
    units = {r.id: r for r in U.units(jsonl.parse(_objects(spark))).collect()}
    assert units["h/pi/s1/line-4"].header == 'Pi session "Early" in boat' and units["h/pi/s1/line-4"].body == "Re: please mend the boat\nthe boat is mended"
    assert units["h/telegram/9/2"].header == 'Telegram group "The \\"Crew\\""' and units["h/telegram/9/2"].body == "3: edited\nAnn: second"
    assert units["h/telegram/9/3"].body == "> 3: edited\nBo: third"
    changed = dict(OBJECTS)
    changed["h/telegram/c/2024.JSONL"] = OBJECTS["h/telegram/c/2024.JSONL"][:4]
    after = {r.id: r for r in U.units(jsonl.parse(_objects(spark, changed))).collect()}
    assert {k for k in units if units[k].content_hash != after[k].content_hash} == {"h/telegram/9/1", "h/telegram/9/2", "h/telegram/9/3"}


def _split(text, most, overlap):
    """Every end and start is tried."""
    count, out, start = U.words, [], 0
    while count(text[start:]) > most:
        end = max([e for e in range(start + 1, len(text) + 1) if count(text[start:e]) <= most])
        breaks = [i for i in range(start + (end - start) * 3 // 4, end) if text[i] == "\n"]
        end = breaks[-1] + 1 if breaks else end
        out.append(text[start:end])
        back = min(m for m in range(start, end + 1) if count(text[m:end]) <= overlap)
        start = back if back > start else end
    return [*out, text[start:]]


def test_splits_equal_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("ab  \n") for _ in range(rng.randint(0, 400)))
        most = rng.randint(4, 40)
        overlap = rng.randint(1, most // 2)
        assert U.split_tokens(text, most, U.words, overlap) == _split(text, most, overlap)


def test_due_and_back_off(spark):
    known = [("changed", "x", "indexed", 1, 400), ("fresh", "x", "indexed", 1, 100), ("same", "a", "indexed", 1, 400), ("failed1", "a", "failed", 1, 30), ("failed3", "a", "failed", 3, 119), ("failed3b", "a", "failed", 3, 120), ("stuck", "a", "processing", 1, 0), ("failed changed", "x", "failed", 9, 0)]
    registry = spark.createDataFrame([(k, e, 1, s, n, 1000 - age, 1) for k, e, s, n, age in known], "key string, etag string, size int, status string, attempts int, updated_at long, parser_version int")
    objects = spark.createDataFrame([(k, "a", 1) for k in ["new", *[r[0] for r in known]]], "key string, etag string, size int")
    assert {r.key for r in C.due(objects, registry, 1000).collect()} == {"new", "changed", "failed1", "failed3b", "stuck", "failed changed"}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}", U.hashed_vectors(16), 16)
    assert e.poll(_objects(spark), now=NOON) == {"due": 7, "written": 16}
    return e


def test_polling_again_changes_nothing(spark, engine):
    assert engine.poll(_objects(spark), now=NOON + 10) == {"due": 0, "written": 0}
    assert engine.poll(_objects(spark, etag="b"), now=NOON + 10) == {"due": 0, "written": 0}  # indexed a moment ago
    assert engine.poll(_objects(spark, etag="b"), now=NOON + 400) == {"due": 7, "written": 0}
    total = {r.source: r.total for r in engine.raw_status().collect()}
    assert total == {None: 7, "pi": 3, "claude": 1, "codex": 1, "grok": 1, "telegram": 1}
    assert engine.audit_duplicates().count() == 0 and engine.ready()


def test_search_walk_and_sessions(spark, engine):
    hits = engine.search("tide").collect()
    assert [h.id for h in hits] == ["h/grok/g1/e1"] and hits[0].matched_chunk_id == "h/grok/g1/e1#0"
    both = engine.search("mend the boat", embed=True, source="claude").collect()
    assert {h.source for h in both} == {"claude"} and len({h.id for h in both}) == len(both) <= 5 and [h.rank for h in both] == sorted(h.rank for h in both)
    # the first message is of the second one's moment; the third, which quotes it, is of a later one
    assert {h.id for h in engine.search("edited second", source="telegram").collect()} == {"h/telegram/9/2", "h/telegram/9/3"}
    with pytest.raises(ValueError):
        engine.search()
    with pytest.raises(ValueError):
        engine.search(vector=[1.0])
    assert [r.id for r in engine.walk("s", include="titles").collect()] == ["h/claude/s/title/title-5be0b56b2d221635"]
    assert {r.kind for r in engine.walk("s").collect()} == {"message"}
    assert {r.container_id for r in engine.sessions(NOON - 10).collect()} == {"s1", "s", "c1", "g1"}


def test_ingest_records(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", U.hashed_vectors(4), 4)
    rows = [("a", "one text", "crm", "c", 5, [1.0] * 4), ("a", "one text", "crm", "c", 5, [1.0] * 4), ("b", "x", "crm", "c", 5, [1.0]), ("", "x", "crm", "c", 5, None), ("d", "", "crm", "c", 5, None), ("e", "made here", "crm", "c", 5, None), ("f", "x", "crm", "c", None, None), ("g", "p", "crm", "c", 5, [1.0] * 4), ("g", "q", "crm", "c", 5, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id string, text string, source string, container_id string, timestamp long, vector array<float>")
    counts, errors = e.ingest(df)
    assert counts == {"accepted": 3, "skipped": 1, "errors": 5}
    assert {r.error for r in errors.collect()} == {"vector dimensions=1 want=4", "id required", "text required", "metadata.timestamp required", 'id "g" has conflicting content'}
    assert e.ingest(df.where("id IN ('a', 'e')"))[0] == {"accepted": 0, "skipped": 3, "errors": 0}
    assert {r.text for r in e.store.read("chunks").collect() if r.message_id == "e"} == {'CRM notes on "c"\nmade here'}


def test_stream_and_delete(spark, tmp_path):
    for key, body in OBJECTS.items():
        path = tmp_path / "raw" / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(map(json.dumps, body)))
    e = Engine(spark, f"file://{tmp_path}/s", U.hashed_vectors(4), 4)
    ingest.start(spark, f"file://{tmp_path}/raw", e, f"file://{tmp_path}/ck").awaitTermination()
    assert e.store.read("messages").where(F.col("source") != "telegram").count() == 13 and e.fragment_counts()["messages"] > 0
    assert e.delete_host("hh") == 0 and e.delete_host("h") > 0 and e.store.read("dedup").count() == 0


def test_walks_of_the_raw_objects(spark, tmp_path):
    root = tmp_path / "raw (a+b)"
    for key, body in OBJECTS.items():
        path = root / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(map(json.dumps, body)) + "\n")
    e = Engine(spark, f"file://{tmp_path}/s", U.hashed_vectors(4), 4)
    listed = jsonl.listed(spark, f"file://{root}")
    assert [r.key for r in listed.collect()] == sorted(k for k in OBJECTS if not k.startswith(("h/notes", "pi/")))
    e.run(f"file://{root}", rounds=1)
    assert e.raw_status().where("source IS NULL").first().indexed == 7
    raw = f"file://{root}"
    assert [r.id for r in e.walk("s1", raw=raw).collect()] == [r.id for r in e.walk("s1").collect()] == ["h/pi/s1/v", "h/pi/s1/u1", "h/pi/s1/line-4"]
    assert [r.id for r in e.walk("s1", raw=raw, include="todos").collect()] == ["h/pi/s1/todo/td"]
    e.store.drop("registry")
    assert [r.id for r in e.walk("s", raw=raw, source="claude").collect()] == ["h/claude/s/a1", "h/claude/s/u1"]  # by the key
    assert [r.id for r in e.walk("c1", raw=raw, limit=0).collect()] == ["h/codex/c1/line-1"]  # from the table: no key has it
    for blank in ("", " "):
        with pytest.raises(ValueError):
            e.walk(blank)


def test_an_object_that_fails_is_marked_and_waits(spark, tmp_path):
    good = U.hashed_vectors(4)

    def picky(texts):
        if any("tide" in t for t in texts):
            raise RuntimeError("no vectors for tides")
        return good(texts)

    e = Engine(spark, f"file://{tmp_path}/s", picky, 4)
    state = lambda: {r.key: r for r in e.store.read("registry").collect()}
    some = _objects(spark, {k: v for k, v in OBJECTS.items() if k.startswith(("h/grok", "h/codex"))})
    assert e.poll(some, now=NOON) == {"due": 2, "written": 1}
    bad = next(k for k in OBJECTS if k.startswith("h/grok"))
    assert "no vectors for tides" in state()[bad].error and state()[bad].status == "failed" and state()[bad].attempts == 1
    assert sum(r.status == "indexed" for r in state().values()) == 1
    assert e.poll(some, now=NOON + 20) == {"due": 0, "written": 0}  # it waits 30 seconds
    e.embedder = good
    assert e.poll(some, now=NOON + 31) == {"due": 1, "written": 1}
    assert state()[bad].status == "indexed" and state()[bad].error == "" and e.search("tide").count() == 1


def test_one_bad_object_among_a_thousand_fails_alone(spark, tmp_path):
    bodies = {f"h/pi/{i}.jsonl": [{"type": "session", "id": f"s{i}"}, _said("user", f"boats {i} of the harbour", type="message", id="u")] for i in range(1000)}
    bad = "h/pi/417.jsonl"
    bodies[bad].append(_said("user", "a poisoned text stands here", type="message", id="w"))
    calls, good = spark.sparkContext.accumulator(0), U.hashed_vectors(4)

    def picky(texts):
        calls.add(1)
        if any("poisoned" in t for t in texts):
            raise RuntimeError("no vector")
        return good(texts)

    e = Engine(spark, f"file://{tmp_path}/s", picky, 4)
    assert e.poll(_objects(spark, bodies), now=NOON) == {"due": 1000, "written": 999}
    state = {r.key: r for r in e.store.read("registry").collect()}
    assert [k for k, r in state.items() if r.status != "indexed"] == [bad] and state[bad].error == "no vector"
    assert e.store.read("chunks").where("vector IS NULL OR size(vector) <> 4").isEmpty() and e.store.read("chunks").where("container_id = 's417'").isEmpty()  # not the object's good text either
    assert calls.value < 200  # batches, not texts
    rows = spark.createDataFrame([("a",), (None,), ("poisoned",)], "text string")
    got = [(r.vector is None, r.error) for r in U.embed_apart(rows.coalesce(1), picky, 4, batch=3).collect()]
    assert got == [(False, None), (False, None), (True, "no vector")] and U.embed_apart(rows, good, 5).where("error LIKE '%vector of 5 numbers%'").count() == 3


def test_a_job_that_fails_marks_its_objects(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/s", U.hashed_vectors(4), 4)
    some = _objects(spark, {k: v for k, v in OBJECTS.items() if k.startswith("h/codex")})
    with monkeypatch.context() as m:
        m.setattr(e.store, "flush", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            e.poll(some, now=NOON)
    row = e.store.read("registry").first()
    assert (row.status, row.error, row.attempts) == ("failed", "division by zero", 1)
    assert e.poll(some, now=NOON + 20)["due"] == 0 and e.poll(some, now=NOON + 31) == {"due": 1, "written": 1}
    assert not [p for p in (tmp_path / "s").iterdir() if p.name.startswith("_poll")]


def test_unknown_fields_are_refused(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", None, 4)
    with pytest.raises(ValueError, match="unknown fields: colour"):
        e.ingest(spark.createDataFrame([("a", "b")], "id string, colour string"))


def test_prefixes_and_clips(spark, tmp_path):
    class Letters:
        def tokenize(self, text):
            return list(map(ord, text))

        def detokenize(self, ids):
            return "".join(map(chr, ids))

    assert U.clip_tokens("abcdef", 3, Letters()) == "abc" and U.clip_tokens("ab", 3, Letters()) == "ab" and U.counter(Letters())("abc") == 3
    told = []

    def heard(texts):
        told.extend(texts)
        return U.hashed_vectors(4)(texts)

    e = Engine(spark, f"file://{tmp_path}/s", U.hashed_vectors(4), 4, query_prefix="find: ")
    e.ingest(spark.createDataFrame([("a", "boats", "crm", "c", 5)], "id string, text string, source string, container_id string, timestamp long"))
    e.embedder = heard
    e.search("boats", embed=True).collect()
    assert told == ["find: boats"]
    df = spark.createDataFrame([("a b c d",)], "text string")
    assert U.embed(df, U.hashed_vectors(4), 4, clip=3).first().vector == U.embed(spark.createDataFrame([("a b",)], "text string"), U.hashed_vectors(4), 4).first().vector
    assert df.select(U.quoted(F.lit('a"\x01\x0b\n'))).first()[0] == '"a\\"\\x01\\v\\n"'


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_poll_makes_its_rows_once(spark, tmp_path):
    """objects are made and lines parsed once, sessions are joined with no chats, and units that lie by their key are not shuffled again."""
    some = _objects(spark, {k: v for k, v in OBJECTS.items() if k.startswith("h/pi")})
    rows = jsonl.parse(some, sources=["pi"])
    assert _plan(rows).count("parseJson") == 1
    rows = rows.persist()  # as a poll does, so that its sources aren't told by the plan
    units = U.units(rows, sources=["pi"])
    assert "Join" in _plan(U.units(rows)) and "Join" not in _plan(units)
    assert sorted(units.collect(), key=repr) == sorted(U.units(rows).collect(), key=repr) != []
    e = Engine(spark, f"file://{tmp_path}/s", U.hashed_vectors(4), 4)
    assert e.poll(some, now=NOON)["written"] == units.count()
    few = spark.createDataFrame([(r.id, h, "k", i, 0, 1) for i, r in enumerate(units.collect()) for h in (r.content_hash, "other", None)], "id string, content_hash string, key string, at long, sub int, line_no long")
    assert {(r.id, r.content_hash) for r in U.pending(few, e.store.read("dedup")).collect()} == {(r.id, r.content_hash) for r in few.where("content_hash = 'other' OR content_hash IS NULL").collect()}
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert _plan(e._fresh(few, "|unit")).count("Exchange hashpartitioning") == 2  # the units and the state
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    made = scenarios._pi(spark, "/root/testdata/sf0.001")
    kept = scenarios._at_rest(spark, made)
    assert "Aggregate" in _plan(made) and "Aggregate" not in _plan(kept) and sorted(kept.collect()) == sorted(made.collect())


def test_white_space_is_trimmed_at_both_ends(spark):
    rng, signs = random.Random(3), [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ᠎     　​﻿aé😀{", "\r\n"]
    df = spark.createDataFrame([("".join(rng.choice(signs) for _ in range(rng.randrange(9))),) for _ in range(5000)] + [(None,)], "t string")
    want = F.regexp_replace(F.regexp_replace("t", r"(?U)^\s+", ""), r"(?U)\s+$", "")
    assert df.where(~want.eqNullSafe(trim_space(F.col("t"))) | ~(want != "").eqNullSafe(F.col("t").rlike(r"(?U)\S"))).isEmpty()
    long = spark.createDataFrame([("a" + " " * 300_000 + "b ",), (" " * 300_000,)], "t string")  # took a time in the square of its length
    assert [len(r[0]) for r in long.select(trim_space(F.col("t"))).collect()] == [300_002, 0]
