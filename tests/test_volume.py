"""What is shuffled, sent to Python or told by a task stays in proportion to the input."""

from collections import Counter

from pyspark.sql import functions as F

from kelpline.functions import stems
from kelpline.functions.text import tokens
from kelpline.operators import batch
from kelpline.operators import contextual as U
from kelpline.operators import postings as I


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_worker_stems_words_as_the_expression_does(spark):
    ends = ("", "s", "ies", "ing", "edly", "ational", "y", "eed", "ll", "ement", "ion", "biliti", "*")
    words = [w + e for w in ("run", "hop", "gener", "commun", "arsen", "say", "ayy", "sk", "luxuri", "über", "x", "at", "пре", "b12") for e in ends] + list(stems.FIXED) + list(stems.KEPT)
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", stems.stem(F.col("w")).alias("s")).collect()
    assert [(r.w, stems.stem_of(r.w)) for r in rows] == [(r.w, r.s) for r in rows]


def test_english_postings_are_stemmed_by_the_word(spark):
    """Not by an expression for each place that a word stands in, which took 722 CPU seconds for 0.1 GB and then failed."""
    docs = spark.createDataFrame([(1, "Running runs the skies"), (2, None), (3, ""), (4, "the of"), (1, "generous things")], "id long, text string")
    made = I.build(docs, english=True)
    assert "rlike" not in plan(made).lower()
    assert sorted(map(tuple, made.collect())) == [("generous", 1, 1, 2), ("run", 1, 2, 3), ("sky", 1, 1, 3), ("thing", 1, 1, 2)]


def test_postings_move_once(spark):
    docs = spark.range(3000).select("id", F.concat(F.lit("a b"), F.col("id") % 7, F.lit(" a c"), "id").alias("text"))
    made = I.build(docs, blocks=2)
    assert "hashpartitioning(term" not in plan(made) and "rangepartitioning(term" in plan(made)
    got = made.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    want = docs.select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.countDistinct("id").alias("df"), F.count("*").alias("tf"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_peaks_gather_no_term_in_one_task(spark):
    rows = [("often", i % 3, i, 1 + i % 2, 5 + i) for i in range(9)] + [("rare", 1, 1, 4, 5), ("rare", 2, 2, 4, 9)]
    made = I.peaks(spark.createDataFrame(rows, "term string, block int, id long, tf long, len int"), rare=3)
    assert "Window" not in plan(made)
    want = [("rare", None, None, None, 2)]
    for (block, tf), n in Counter((r[1], r[3]) for r in rows[:9]).items():
        want.append(("often", block, tf, min(r[4] for r in rows[:9] if (r[1], r[3]) == (block, tf)), n))
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, want))


def test_chunks_and_vectors_are_made_in_small_batches(spark):
    def sizes() -> tuple[int, str]:
        return int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    docs = spark.createDataFrame([("a", "", "x y", "x y", "")], "id string, header string, body string, text string, content_hash string")
    for make in (U.chunks, lambda d: U.embed(d, U.hashed_vectors(4), 4), lambda d: U.embed_apart(d, U.hashed_vectors(4), 4)):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        assert make(docs).count() == 1 and sizes() == (U.ROWS, U.BYTES)


def test_pairs_of_queries_and_texts_are_no_rows(spark, monkeypatch):
    """A word that all queries and texts hold: each pass tells its best alone, equal scores by id."""
    monkeypatch.setattr(batch, "ASKED", 3), monkeypatch.setattr(batch, "TEXTS", 16), monkeypatch.setattr(batch, "HELD", 50)
    texts = spark.range(300).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("id"), F.concat(F.lit("all w"), F.col("id") % 30, F.when(F.col("id") % 4 == 0, " w3").otherwise("")).alias("text"))
    queries = spark.range(8).select(F.col("id").alias("query_id"), F.concat(F.lit("All all w"), "id").alias("text"))
    n, total = I.stats(texts).first()
    for keep in (None, texts.where("id % 2 = 0").select("id")):
        got = batch.bm25(I.build(texts), n, total / n, queries, 5, keep)
        assert "hashpartitioning(query_id#" in plan(got) and "id#" not in plan(got).split("hashpartitioning(query_id#")[1].split(")")[0]
        want = []
        for q in range(8):
            hits = I.bm25(I.build(texts), n, total / n, f"all w{q}").withColumn("score", F.round("score", 10))
            hits = hits if keep is None else hits.join(keep, "id", "left_semi")
            want += [(q, r.id, r.score, i) for i, r in enumerate(hits.orderBy(F.desc("score"), "id").limit(5).collect(), 1)]
        assert sorted(map(tuple, got.collect())) == sorted(want)
