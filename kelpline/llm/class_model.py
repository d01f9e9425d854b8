"""Language-model scores by Brown class-based n-grams: words fall into classes, and classes follow one another.

Method: texts are encoded once, batch by batch, as numbers of a batch's own words. Words meet by a shuffle of (word, batch) rows, which brings each word its count and
how often it follows each context; a context is the word before, told by itself if short and by its ending if long. Exchange clustering starts from each word's most
telling context, and in every round each word moves to the class in which the likelihood of classes after contexts is highest, its own counts being
taken out of its present class first; a round reads the words' counts, not the corpus, and needs the contexts' counts by class, a matrix of fixed size, in which a task keeps its
own moves. A round that doesn't raise the likelihood is dropped. The classes go back to the
batches by a join, class bigrams are counted over all learned texts, and a text's score adds log10 of P(class | class before) P(word | class).

Smoothing: a class's words give up d = n1 / (n1 + 2 n2) of a count each, which is the class's share of unknown words, so the probabilities of all V known words and one unknown add up
to 1 after any context; transitions are interpolated with the shares of the classes by the number of different followers; after an unknown word the followers of words seen once stand in.

Defined cases: a null or empty text is its end token; a null id counts as an empty string; rows that repeat an id or a text are learned and scored each. With nothing to learn from every
token is unknown with probability 1 and all scores are 0. A text is cut in pieces at white space that carry the word before, so long texts are scored as one; a
batch has some 3,000,000 tokens at most, which bounds every task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpline.llm.common import bounded_batches, cut, fresh

CLASSES, ROUNDS, BATCH, PIECE = 32, 3, 3_000_000, 1 << 20
#: Contexts, in nine bits beside a count; words up to ``SHORT`` bytes are contexts of their own, the others by their last ``ENDING``.
BITS = 9
CONTEXTS, SHORT, ENDING = 1 << BITS, 4, 2
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: The empty word is the end of a text, and what stands before the first.
END = b""


def learned_from(doc_id: Column) -> Column:
    """Whether the model learns from a document; the others are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def pieces_of(text: bytes, size: int = PIECE) -> Iterator[tuple[bytes, bool]]:
    """(piece, whether it is the last), cut at white space."""
    pos = 0
    while len(text) - pos > size and (m := _BLANK.search(text, pos + size)):
        yield text[pos : m.start()], False
        pos = m.end()
    yield text[pos:], True


def context_of(word: bytes) -> int:
    return zlib.crc32(word if len(word) <= SHORT else b"\0" + word[-ENDING:]) % CONTEXTS


class _Numbers(dict):
    """Words to numbers in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _pack(ids: np.ndarray) -> bytes:
    """Numbers under 2^24, byte plane by byte plane."""
    return pa.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3].tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 3 * n, "zstd"), np.uint8).reshape(3, n).astype(np.int32)
    return planes[0] | planes[1] << 8 | planes[2] << 16


_PIECES = "batch long, row long, learned boolean, size int, ids binary"
_WORDS = "word binary, at int, n long, ctx array<int>, totals array<array<long>>"


def _lists(starts: np.ndarray, values: np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    """Lists that begin at ``starts``."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


_TOTALS = pa.list_(pa.list_(pa.int64()))


def _totals(matrix: np.ndarray) -> pa.Array:
    """One row that holds a matrix."""
    rows, columns = matrix.shape
    return _lists(np.zeros(1, np.int64), _lists(np.arange(rows) * columns, matrix.ravel().astype(np.int64), pa.int64()), _TOTALS.value_type)


def encode(docs: DataFrame, learn: Column, drop: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """One written table of pieces (their columns and ``rest``), of the batches' words and of the contexts' totals, each kind with nulls in the others' columns; and the kept names."""
    kept = [c for c in docs.columns if c not in drop]
    (mark,) = fresh(docs, "mark")
    read = docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(learn, F.lit(False)).alias("learned"), F.col("text").cast("binary").alias("text"), F.struct(F.lit(None).cast("int").alias(mark), *[F.col(f"`{c}`") for c in kept]).alias("rest")
    )
    schema = T._parse_datatype_string(f"{_PIECES}, {_WORDS}").add("rest", read.schema["rest"].dataType, True)
    arrow = pa.schema([("batch", pa.int64()), ("row", pa.int64()), ("learned", pa.bool_()), ("size", pa.int32()), ("ids", pa.binary())])
    arrow_words = [("word", pa.binary()), ("at", pa.int32()), ("n", pa.int64()), ("ctx", pa.list_(pa.int32())), ("totals", _TOTALS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ordinal, tokens = _Numbers(), TaskContext.get().partitionId() << 32, 0
        number[END]
        held: list[tuple] = []  # row, learned, ids with the one before, rest
        kind = None

        def record(count: int, **columns: pa.Array) -> pa.RecordBatch:
            fields = [*arrow, *[pa.field(*x) for x in arrow_words], pa.field("rest", kind)]
            return pa.record_batch([columns.get(f.name, None) if f.name in columns else pa.nulls(count, f.type) for f in fields], names=[f.name for f in fields])

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([x[2] for x in held])
            sizes = np.array([len(x[2]) for x in held])
            own = np.ones(len(ids), bool)
            own[np.cumsum(sizes) - sizes] = False
            mine = own & np.repeat(np.array([x[1] for x in held], bool), sizes)
            order = np.argsort(-np.bincount(ids, minlength=len(number)), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            ids = rank[ids]
            words = list(number)
            words = [words[i] for i in order.tolist()]
            at = np.flatnonzero(mine)
            context = np.fromiter(map(context_of, words), np.int64, len(words))
            key = np.sort(ids[at].astype(np.int64) << BITS | context[ids[at - 1]])
            first = _runs(key)
            times = np.diff(np.append(first, len(key)))
            key = key[first]
            starts = np.searchsorted(key >> BITS, np.arange(len(words)))
            n = np.bincount(ids[at], minlength=len(words))
            yield record(1, batch=pa.array([ordinal]), totals=_totals(np.bincount(key & (CONTEXTS - 1), times, CONTEXTS).reshape(-1, 32)))
            lists = _lists(starts, times << BITS | key & (CONTEXTS - 1), pa.int32())
            for lo in range(0, len(words), 50_000):
                hi = min(len(words), lo + 50_000)
                yield record(hi - lo, batch=pa.array(np.full(hi - lo, ordinal)), word=pa.array(words[lo:hi], pa.binary()), at=pa.array(np.arange(lo, hi), pa.int32()), n=pa.array(n[lo:hi], pa.int64()), ctx=lists[lo:hi])
            ends = np.cumsum(sizes)
            for lo in range(0, len(held), 500):
                part = held[lo : lo + 500]
                packed = [_pack(ids[e - s : e]) for e, s in zip(ends[lo : lo + 500].tolist(), sizes[lo : lo + 500].tolist())]
                columns = {"row": pa.array([x[0] for x in part]), "learned": pa.array([x[1] for x in part]), "size": pa.array(sizes[lo : lo + 500], pa.int32()), "ids": pa.array(packed, pa.binary())}
                yield record(len(part), batch=pa.array(np.full(len(part), ordinal)), rest=pa.concat_arrays([x[3] for x in part]), **columns)

        for batch in batches:
            kind = batch.column(3).type
            for i, (row, learned, text) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(3)])):
                before, rest = END, batch.column(3).slice(i, 1)
                for piece, last in pieces_of(text or b""):
                    words = piece.lower().split()
                    ids = [number[before], *map(number.__getitem__, words), *[number[END]] * last]
                    held.append((row, learned, np.array(ids, np.int32), rest))
                    before = words[-1] if words else before
                    rest, tokens = pa.nulls(1, kind), tokens + len(ids)
                    if tokens > BATCH:
                        yield from flush()
                        number, held, tokens, ordinal = _Numbers(), [], 0, ordinal + 1
                        number[END]
        if held:
            yield from flush()

    return cut(read.mapInArrow(run, schema), "encoded"), kept


def _tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches gathered to ``rows`` or more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _merged(table: pa.Table) -> pa.Table:
    """Rows of one word, which stand together, added up."""
    words = table.column("word").combine_chunks()
    changed = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate([[True], changed]))
    group = np.cumsum(np.concatenate([[0], changed.astype(np.int64)]))
    ctx = table.column("ctx").combine_chunks()
    sizes = np.diff(ctx.offsets.to_numpy())
    values = ctx.flatten().to_numpy().astype(np.int64)
    key = np.repeat(group, sizes) << BITS | values & (CONTEXTS - 1)
    order = np.argsort(key, kind="stable")
    key, times = key[order], (values >> BITS)[order]
    first = _runs(key)
    times, key = np.add.reduceat(times, first) if len(first) else times, key[first]
    lists = _lists(np.searchsorted(key >> BITS, np.arange(len(starts))), times << BITS | key & (CONTEXTS - 1), pa.int64())
    return pa.table({"word": words.take(pa.array(starts)), "n": np.add.reduceat(table.column("n").to_numpy(), starts), "ctx": lists})


_STATE = "word binary, n long, ctx array<long>, cls int, totals array<array<long>>"


class _Clusters:
    """Classes of words from how often they follow each context; ``by`` has the contexts' counts by class."""

    def __init__(self, classes: int):
        self.classes = classes
        self.totals = np.zeros((CONTEXTS, classes + 1), np.int64)

    def _parts(self, table: pa.Table) -> tuple[np.ndarray, ...]:
        ctx = table.column("ctx").combine_chunks()
        offsets, values = ctx.offsets.to_numpy(), ctx.flatten().to_numpy()
        return offsets[:-1] - offsets[0], np.diff(offsets), values & (CONTEXTS - 1), values >> BITS

    def emit(self, table: pa.Table, classes: np.ndarray) -> pa.RecordBatch:
        """The rows with their classes; the end of texts keeps a class of its own."""
        classes = np.where(pc.equal(pc.binary_length(table.column("word")), 0).to_numpy(zero_copy_only=False), self.classes, classes)
        _, sizes, context, times = self._parts(table)
        self.totals += np.bincount(context * (self.classes + 1) + np.repeat(classes, sizes), times, self.totals.size).astype(np.int64).reshape(self.totals.shape)
        columns = [table.column(c).combine_chunks() for c in ("word", "n", "ctx")]
        return pa.record_batch([*columns, pa.array(classes, pa.int32()), pa.nulls(table.num_rows, _TOTALS)], names=["word", "n", "ctx", "cls", "totals"])

    def last(self) -> pa.RecordBatch:
        """A row with what this task has counted."""
        empty = [pa.nulls(1, k) for k in (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int32())]
        return pa.record_batch([*empty, _totals(self.totals)], names=["word", "n", "ctx", "cls", "totals"])

    def first_classes(self, table: pa.Table, shares: np.ndarray) -> np.ndarray:
        """By the context that is most frequent for the word, measured by the root of the context's own count."""
        starts, sizes, context, times = self._parts(table)
        value = times / np.sqrt(np.maximum(1, shares))[context]
        word = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((value, word))
        return context[order[starts + sizes - 1]] % self.classes

    def exchanged(self, table: pa.Table, by: np.ndarray) -> np.ndarray:
        """Each word's best class, were it alone to move; ``by`` then has these moves, so that the words after them see them."""
        starts, sizes, context, times = self._parts(table)
        now, n = table.column("cls").to_numpy(), table.column("n").to_numpy().astype(float)
        value = np.empty((len(context), self.classes))
        gains = np.stack([_xlogx(by[:, : self.classes] + k) - _xlogx(by[:, : self.classes]) for k in range(1, 9)])
        few = times <= len(gains)
        value[few] = gains[times[few] - 1, context[few]]
        rows, more = by[context[~few], : self.classes], times[~few, None]
        value[~few] = _xlogx(rows + more) - _xlogx(rows)
        total = by[:, : self.classes].sum(axis=0)
        gain = np.add.reduceat(value, starts, axis=0) - (_xlogx(total + n[:, None]) - _xlogx(total))
        # in its own class a word's counts are there already; the end of texts has none of these classes
        mine = np.flatnonzero(now < self.classes)
        cell = by[context, np.minimum(np.repeat(now, sizes), self.classes)]
        own = np.add.reduceat(_xlogx(cell) - _xlogx(cell - times), starts)[mine]
        whole = total[now[mine]]
        gain[mine, now[mine]] = own - (_xlogx(whole) - _xlogx(whole - n[mine]))
        best = np.where(now < self.classes, gain.argmax(axis=1), now)
        for classes, sign in ((now, -1), (best, 1)):
            np.add.at(by, (context, np.repeat(classes, sizes)), sign * times)
        return best


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _likelihood(by: np.ndarray) -> float:
    """Of the classes after their contexts and of the words in their classes, but for what no move changes."""
    return float(_xlogx(by.astype(float)).sum() - _xlogx(by.sum(axis=0).astype(float)).sum())


def _sum_totals(df: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The sum of the matrices in ``totals``; a matrix becomes a row for each of its own rows."""
    out = np.zeros((rows, columns), np.int64)
    each = df.where(F.col("totals").isNotNull()).select(F.posexplode("totals").alias("i", "x"))
    for r in each.groupBy("i").agg(*[F.sum(F.col("x")[j]).alias(f"n{j}") for j in range(columns)]).collect():
        out[r[0]] = r[1:]
    return out


def cluster(encoded: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """(word, n, cls) of all words that are learned, by exchange."""
    spark = encoded.sparkSession
    shares = spark.sparkContext.broadcast(_sum_totals(encoded, CONTEXTS // 32, 32).ravel())

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters, carried = _Clusters(classes), []
        for table in _tables(batches, 50_000):
            own = pa.table([table.column(0), table.column(1), table.column(2).cast(pa.list_(pa.int64()))], names=["word", "n", "ctx"])
            table = _merged(pa.concat_tables([*carried, own]))
            carried = [table.slice(table.num_rows - 1)]  # more of the last word may follow
            if table.num_rows > 1:
                done = table.slice(0, table.num_rows - 1)
                yield clusters.emit(done, clusters.first_classes(done, shares.value))
        for table in carried:
            yield clusters.emit(table, clusters.first_classes(table, shares.value))
        yield clusters.last()

    met = encoded.where("n > 0").select("word", "n", "ctx").repartition("word").sortWithinPartitions("word")
    state = cut(met.mapInArrow(begin, _STATE), "classes")
    by = _sum_totals(state, CONTEXTS, classes + 1)
    for _ in range(rounds):
        matrix = spark.sparkContext.broadcast(by)

        def move(batches: Iterator[pa.RecordBatch], matrix=matrix) -> Iterator[pa.RecordBatch]:
            clusters, by, size = _Clusters(classes), matrix.value.astype(float), 16
            for table in _tables(batches, 5_000):
                at = 0
                while at < table.num_rows:
                    some = table.slice(at, size).combine_chunks()
                    yield clusters.emit(some, clusters.exchanged(some, by))
                    at, size = at + size, min(5_000, 2 * size)
            yield clusters.last()

        moved = cut(state.where("word is not null").select("word", "n", "ctx", "cls").mapInArrow(move, _STATE), "classes")
        after = _sum_totals(moved, CONTEXTS, classes + 1)
        if _likelihood(after) <= _likelihood(by):  # tasks that move words at once may go too far; then the classes stay
            break
        state, by = moved, after
    return state.where("word is not null").select("word", "n", "cls")


class Smoothed:
    """Probabilities from counts: ``n`` tokens and ``v`` words of each class, of which the last is the end of texts, and followers by class and of words seen once."""

    def __init__(self, n: np.ndarray, v: np.ndarray, discount: float):
        self.n, self.discount = n.astype(float), discount
        self.unknown = np.where(n > 0, discount * v / np.maximum(1, n), 0.0)
        self.unknown[-1] = 0.0
        self.ends = len(n) - 1

    def emission(self, times: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """P(word | its class) of known words; the end of texts is all that its class has."""
        return np.where(cls == self.ends, 1.0, (times - self.discount) / np.maximum(1.0, self.n[cls]))

    def transitions(self, counts: np.ndarray) -> np.ndarray:
        """P(class | context); rows are the classes and, last, unknown words; a last column is the probability of an unknown word."""
        share = self.n / max(1.0, self.n.sum())
        total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        p = np.where(total > 0, (counts + kinds * share) / np.maximum(1, total + kinds), share)
        out = np.hstack([p, (p @ self.unknown)[:, None]])
        return out if self.n.sum() else np.hstack([np.zeros_like(p), np.ones((len(p), 1))])


def score_texts(docs: DataFrame, learn: Column, classes: int = CLASSES, rounds: int = ROUNDS, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (text and others, without ``drop``) with learned, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score, which replace columns of the same names."""
    spark = docs.sparkSession
    bounded_batches(spark, rows=5_000)
    added = ("learned", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    encoded, kept = encode(docs, learn, tuple(c for c in docs.columns if c in drop or c.lower() in added))
    words = cluster(encoded, classes, rounds)
    unknown, width = classes + 1, classes + 2
    n, v, once, twice = np.zeros(classes + 1, np.int64), np.zeros(classes + 1, np.int64), 0, 0
    for r in words.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect():
        n[r["cls"]], v[r["cls"]] = r["n"], r["v"]
        once, twice = once + r["n1"], twice + r["n2"]
    known, distinct = int(n.sum()), int(v.sum())
    model = Smoothed(n, v, once / (once + 2 * twice) if once else 0.5)
    sums = "n_tokens long, n_known long, plus_one double, emitted double"
    schema = T._parse_datatype_string(f"row long, learned boolean, {sums}, classes binary, totals array<array<long>>").add("rest", encoded.schema["rest"].dataType, True)

    def classed(pieces: pa.Table, own: pa.Table) -> pa.Table:
        """A batch's pieces with the classes of their words, and its class bigrams."""
        at = own.column("at").to_numpy()
        times, cls = np.zeros(len(at), np.int64), np.full(len(at), unknown)
        seen = own.column("n").is_valid().to_numpy()
        times[at[seen]], cls[at[seen]] = own.column("n").drop_null().to_numpy(), own.column("cls").drop_null().to_numpy()
        plus_one = np.log10(times + 1.0)
        emitted = np.zeros(len(at))
        emitted[times > 0] = np.log10(model.emission(times[times > 0], cls[times > 0]))
        out, counts = [], np.zeros(width * width, np.int64)
        for row, learned, size, ids in zip(*[pieces.column(c).to_pylist() for c in ("row", "learned", "size", "ids")]):
            ids = _unpack(ids, size)
            c, mine = cls[ids], ids[1:]
            out.append((row, learned, len(mine), int((times[mine] > 0).sum()), plus_one[mine].sum(), emitted[mine].sum(), _pack(c)))
            if learned:
                counts += np.bincount(c[:-1] * width + c[1:], minlength=width * width)
                counts += np.bincount(unknown * width + c[1:][times[ids[:-1]] == 1], minlength=width * width)
        columns = [pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()))]
        names = ["row", "learned", "n_tokens", "n_known", "plus_one", "emitted", "classes"]
        one = [pa.nulls(1, c.type) for c in columns]
        columns = [pa.chunked_array([c, o]) for c, o in zip(columns, one)]
        totals = pa.chunked_array([pa.nulls(len(out), _TOTALS), _totals(counts.reshape(width, width))])
        other = pieces.column("rest")
        return pa.table([*columns, totals, pa.chunked_array([*other.chunks, pa.nulls(1, other.type)])], names=[*names, "totals", "rest"])

    ours = encoded.where("word is not null").select(F.col("batch").alias("of"), "at", "word").join(words, "word", "left").select("of", "at", "n", "cls")
    pieces = encoded.where("row is not null").select("batch", "row", "learned", "size", "ids", "rest")
    parts = cut(pieces.groupBy("batch").cogroup(ours.groupBy("of")).applyInArrow(classed, schema), "classed")
    counts = _sum_totals(parts, width, width)
    with np.errstate(divide="ignore"):
        table = spark.sparkContext.broadcast(np.log10(model.transitions(counts[:, : classes + 1])))

    def transit(column: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for data, n in zip(column.to_pylist(), sizes.to_pylist()):
            c = _unpack(data, n + 1)
            out.append(float(table.value[c[:-1], c[1:]].sum()))
        return pa.array(out, pa.float64())

    scored = parts.where("row is not null").withColumn("moved", F.arrow_udf(transit, "double")(F.col("classes"), F.col("n_tokens")))
    total = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "plus_one", "emitted", "moved")]
    whole = scored.groupBy("row").agg(F.first("rest", ignorenulls=True).alias("rest"), F.first("learned").alias("learned"), *total)
    return whole.select(
        *[F.col("rest")[c].alias(c) for c in kept], "learned", "n_tokens", "n_known", F.lit(known).cast("long").alias("train_tokens"),
        (F.col("plus_one") - F.col("n_tokens") * float(np.log10(known + distinct + 1))).alias("base_score"), (F.col("emitted") + F.col("moved")).alias("score"),
    )
