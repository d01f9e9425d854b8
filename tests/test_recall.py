from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kelpline import catalogue
from kelpline.functions import stems
from kelpline.functions import text as X
from kelpline.operators import containers as C
from kelpline.operators import ivf as V
from kelpline.operators import postings as I
from kelpline.operators import search as S
from kelpline.plans import predicates as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def _rows(rows):
    return sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)


#: Two or more polls each; tests/test_engine.py polls too.
SLOW = {"poll_messages", "poll_registry"}


@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) - SLOW))
def test_catalogue(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"select {', '.join(cols)} from ({catalogue.oracle_sql()[name]})").fetchall()
    assert _rows(map(tuple, df.select(*cols).collect())) == _rows(want)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_all_sessions_are_listed(spark, sf):
    table = f"/root/testdata/{sf}/conversations.parquet"
    want = duckdb.sql(f"select cast(conv_id as varchar), count(*) from '{table}' where role <> 'system' group by conv_id").fetchall()
    got = catalogue.queries()["sessions_first_prompt"](spark, f"/root/testdata/{sf}").select("container_id", "messages").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{table}'")
    names = "host, source, container_id, first_ts, last_ts, messages, first_prompt, container_title, project"
    want = c.sql(f"select {names} from ({catalogue.oracle_sql()['sessions_first_prompt']})").fetchall()
    assert _rows(map(tuple, catalogue.queries()["sessions_first_prompt"](spark, f"/root/testdata/{sf}").select(*names.split(", ")).collect())) == _rows(want)


def test_hostile_values_match_literally(spark):
    df = spark.createDataFrame([("a\\b'c",), ("s'1",)], "container_id string")
    assert df.where(P.eq_all(container_id="a\\b'c")).count() == 1
    assert df.where(P.eq("text", "x")).count() == 2


def test_pages_make_the_whole_walk(spark):
    rows = [(f"i{i:02d}", "c", 10 + i // 3, "message") for i in range(10)]
    df = spark.createDataFrame(rows, "id string, container_id string, timestamp long, kind string")
    got, ts, last = [], 0, ""
    while page := C.walk(df, "c", ts, last, limit=3).collect():
        got += [r.id for r in page]
        ts, last = page[-1].timestamp, page[-1].id
    assert got == [r[0] for r in rows]


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    once = C.upsert(base, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, C.upsert(once, new).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_fusion_and_collapse(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, rank int")
    assert S.fuse(a, b).orderBy(F.desc("score"), "id").first().id == "y"
    # near the first; another container; near the second only, which is gone; without a message of their own; the same message; the same words
    hits = [(1, "p", "p", "h1", 5000, "k"), (2, "q", "q", "h2", 4500, "k"), (3, "r", "r", "h3", 4500, "l"), (4, "s", "s", "h4", 4000, "k"), (5, "t", "", "", 9000, "k"), (6, "u", "", "", 20000, "k"), (7, "v", "r", "h7", 50000, "l"), (8, "w", "w", "h1", 90000, "k")]
    df = spark.createDataFrame([(n, i, m, h, True, c, t) for n, i, m, h, t, c in hits], "rank int, id string, message_id string, content_hash string, chat boolean, container_id string, timestamp long")
    assert [r.id for r in S.collapse(df).collect()] == ["p", "r", "s", "t", "u"]
    assert [r.id for r in S.collapse(df, limit=2).collect()] == ["p", "r"]


def test_query_terms_are_those_of_texts(spark):
    text = "Ab²c Ⅷx é１ ٣_z"
    df = spark.createDataFrame([(text,)], "t string").select(X.tokens(F.col("t")).alias("t"))
    assert S.query_terms(text) == df.first().t


#: Published pairs of the stemmer's description and sample vocabulary.
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol
consonant conson consort consort consorted consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir constable constabl constancy constanc constant constant
knack knack knackeries knackeri knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel knew knew knick knick knif knif knife knife knight knight knightly knight knights knight
knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knopp knopp knots knot
caresses caress ponies poni ties tie cries cri gas gas this this gaps gap kiwis kiwi luxuriated luxuri hopping hop hoping hope cry cri by by say say dying die news news inning inning proceed proceed
generate generat general general communism communism arsenal arsenal rational ration adoption adopt controlling control beautiful beauti yes yes rate rate sky sky agreed agre feed feed""".split()


def test_stems_are_the_published_ones(spark):
    want = dict(zip(STEMS[::2], STEMS[1::2]))
    rows = spark.createDataFrame([(w,) for w in want], "word string")
    got = dict(map(tuple, rows.select("word", stems.stem(F.col("word"))).collect()))
    assert {w: s for w, s in got.items() if s != want[w]} == {}
    assert I.terms_of(spark, "The standing of ships, and THE ship", True) == ["ship", "stand"] and I.terms_of(spark, "of the", True) == []


def test_timestamps_and_trims(spark):
    df = spark.createDataFrame([("1700000000000",), ("1700000000",), ("2023-11-14T22:13:20Z",), ("2023-11-14",), (None,)], "v string")
    assert [r[0] for r in df.select(X.raw_timestamp(F.col("v"))).collect()] == [1700000000, 1700000000, 1700000000, 0, 0]
    assert spark.createDataFrame([("  a\n",)], "v string").select(X.trim_space(F.col("v"))).first()[0] == "a"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_ivf_recall_against_brute_force(spark, sf):
    table = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    ids, points = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), dtype=np.float64)
    got = {}
    for r in catalogue.queries()["ivf_search"](spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[asked].tolist())
    found = [len(got[ids[i]] & set(ids[np.lexsort((ids, ((points - points[i]) ** 2).sum(1)))[:10]].tolist())) for i in asked]
    assert np.mean(found) / 10 >= 0.9


def test_ivf_of_all_lists_is_exact(spark):
    rng = np.random.default_rng(1)
    points = np.round(rng.normal(size=(300, 4)), 1)
    points[100:140] = points[100]  # copies are told apart by id
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(900, None), (901, [1.0])], "id long, vector array<float>")
    points = points.astype(np.float32).astype(np.float64)
    index = V.build(rows, 4, 8)
    for probes, queries in ((8, rows), (1, rows.where("id = 5"))):
        got = {}
        for r in V.search(index, queries, 60 if probes == 1 else 5, probes).orderBy("query_id", "distance", "id").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for i, ids in got.items():
            d = np.sqrt(((points - points[i]) ** 2).sum(1))
            assert ids == np.lexsort((np.arange(300), d))[: len(ids)].tolist()
            assert len(ids) == (60 if probes == 1 else 5)
        assert len(got) == (1 if probes == 1 else 300)
