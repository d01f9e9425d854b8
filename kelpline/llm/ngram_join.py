"""N-gram Jaccard join: texts whose sets of five-word shingles have a similarity of 0.8 or more.

Method: MinHash LSH forest with exact verification. A text has in each of ``trees`` trees a label of ``depth`` minimum hashes.

1. Equal texts become one node, by digest; copies never meet again.
2. The labels of each tree are sorted; texts with a common prefix are neighbours then, and a prefix of a trie is a run of labels. One pass over the
   sorted labels finds each text's longest matched prefix; trees in which it is shorter than the floor have no partner for the text.
   The floor is the prefix length at which, taken in all trees, pairs at the threshold meet with the target recall.
3. Prefixes start at full length and are shortened to the floor, the least crowded tree first, until what a pair at the threshold
   can still miss is within 1 - recall: a tree whose node is crowded may keep its full length as long as all trees together allow it. Half of what
   may be missed is each text's own to spend, so that the bound holds for every pair. A text stands at its prefix and at all longer ones.
4. Within a node, split into blocks and block pairs so that no task holds an unbounded group, signatures
   estimate similarities; pairs more than six deviations below the threshold go. Only spanning edges leave: of two blocks one for each of their
   own components that meet, since what connects a block's texts leaves its pair with itself.
5. Connected texts form families; only their texts are read again. Within a family, again by block pairs, every pair is
   verified on its exact shingles. Numbers of links and spanning edges leave, never the pairs.
6. Components of the verified links are the classes.

Defined cases: texts with fewer than five words have one shingle, all their words; texts without words (null, empty) link to
nothing, each text by itself a class with its exact copies. class_id is the smallest doc_id of the class (null only if all are
null). n_links counts the other rows that are linked to a row, exact copies included. Repeated rows count each; ``keep_one`` keeps of rows equal in
id and text the one whose columns have the smallest hash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpline.llm.common import WORD_RE, bounded_batches, cut, fresh, text_key
from kelpline.llm.components import components

SHINGLE, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 36, 6, 1 - 1e-7
#: Members of a block, and bytes of text in a block, that meet in one task. Groups of over 64 blocks have larger blocks, of up to ``WIDEST`` times as many members, so
#: that a text is copied less often. A node with more members than ``BLOCK`` is crowded.
BLOCK, WIDEST, BLOCK_BYTES = 256, 8, 8 << 20
MARGIN = 6
_WORD = re.compile(WORD_RE)
_LOWER = {i: i + 32 for i in range(65, 91)}
#: Words whose hashes a worker process remembers, and their largest length: at most 25 MB or so.
_CACHE, _CACHED_LENGTH = 200_000, 24
_hashed: dict[str, int] = {}


def floor_length(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair of similarity ``threshold`` meets in one of the trees with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def spared_trees(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, depth: int = DEPTH) -> int:
    """In how many trees a text may keep its full prefix: half of the trees that a pair can do without, so that those of both its texts together are allowed."""
    floor = floor_length(threshold, trees, recall, depth)
    missed = lambda n: math.log(1 - threshold**n) if threshold < 1 else -math.inf
    if floor == depth or missed(floor) == -math.inf:
        return 0
    spare = math.log(1 - recall) - trees * missed(floor)
    return max(0, int(spare / 2 / (missed(depth) - missed(floor))))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER) if text and not text.isascii() else (text or "").lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Signer:
    def __init__(self, values: int):
        rng = np.random.default_rng(20240607)
        self.factors = rng.integers(0, 1 << 31, values, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.weights = rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def shingles(self, text: str | None) -> np.ndarray:
        """64-bit hashes of a text's shingles, in order."""
        words = words_of(text)
        known = _hashed
        if len(known) > _CACHE:
            known.clear()
        long = {}
        for w in words:
            if w not in known:
                (known if len(w) <= _CACHED_LENGTH else long)[w] = xxhash.xxh64_intdigest(w)
        at = known if not long else known | long
        a = np.fromiter([at[w] for w in words], np.uint64, len(words))
        if not len(a):
            return a
        n = max(1, len(a) - SHINGLE + 1)
        h = np.full(n, min(len(a), SHINGLE), np.uint64)
        for k in range(min(SHINGLE, len(a))):
            h += a[k : k + n] * self.weights[k]
        return _mix(h)

    def sign(self, texts: list[str | None]) -> list[bytes | None]:
        """16 bits of each text's minimum hashes as bytes, in an order that sorts as numbers do; None for texts without words. Texts share the passes."""
        out: list[bytes | None] = [None] * len(texts)
        rows, parts, size = [], [], 0
        for i, t in enumerate(texts):
            h = self.shingles(t)
            if len(h):
                rows.append(i)
                parts.append(h)
                size += len(h)
            if parts and (size > 100_000 or i == len(texts) - 1):
                self._sign(rows, parts, out)
                rows, parts, size = [], [], 0
        if parts:
            self._sign(rows, parts, out)
        return out

    def _sign(self, rows: list[int], parts: list[np.ndarray], out: list[bytes | None]) -> None:
        h = (np.concatenate(parts) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
        sig = np.empty((len(parts), len(self.factors)), ">u2")
        buf = np.empty_like(h)
        for k, f in enumerate(self.factors):
            np.multiply(h, f, out=buf)
            least = np.minimum.reduceat(buf, starts)
            sig[:, k] = (least ^ least >> np.uint32(16)) & np.uint32(0xFFFF)
        for i, s in zip(rows, sig):
            out[i] = s.tobytes()


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``keys`` columns, from sorted batches."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1 if batch.num_rows > 1 else np.array([], int)
        bounds = [0, *edges.tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            key = tuple(c[lo] for c in cols)
            if rest and key != last:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(lo, hi - lo))
            last = key
    if rest:
        yield pa.Table.from_batches(rest)


def roots(adjacent: np.ndarray) -> np.ndarray:
    """Smallest index of each row's component in a symmetric boolean matrix."""
    n = len(adjacent)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            front = np.zeros(n, bool)
            front[i] = True
            seen = front.copy()
            while front.any():
                front = adjacent[front].any(0) & ~seen
                seen |= front
            label[seen] = i
    return label


def _paired(i: np.ndarray, j: np.ndarray, side: np.ndarray) -> np.ndarray | None:
    """Which pairs a group is for: all of a block with itself, only those across for two blocks."""
    if i[0] == j[0]:
        return None
    return side[:, None] != side[None, :]


def _likely(threshold: float, values: int):
    least = threshold - MARGIN * (threshold * (1 - threshold) / values) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in grouped(batches, 3):
            if t.num_rows < 2:
                continue
            ids = t.column("id").to_pylist()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(ids), values)
            same = np.zeros((len(ids), len(ids)), np.uint16)
            for k in range(values):
                same += sig[:, k, None] == sig[None, :, k]
            near = same >= least * values
            across = _paired(*(t.column(c).to_numpy() for c in ("i", "j", "side")))
            own = None
            if across is not None:
                own = roots(near & ~across)  # what each block's pair with itself connects; its edges aren't told again
            for x, r in enumerate(roots(near)):
                if x != r and (own is None or own[x] == x):
                    a.append(ids[x])
                    b.append(ids[r])
            if len(a) > 20_000:
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        if a:
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def similar(texts: list[str], threshold: float) -> np.ndarray:
    """Exact boolean matrix of pairs with a Jaccard similarity of ``threshold`` or more over distinct shingles."""
    number: dict[str, int] = {}
    windows = []
    for t in texts:
        w = np.array([number.setdefault(x, len(number)) for x in words_of(t)], np.int32)
        if len(w) < SHINGLE:
            w = np.concatenate([w, np.full(SHINGLE - len(w), -1, np.int32)])
        windows.append(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(w, SHINGLE)))
    rows = np.concatenate([np.full(len(w), i) for i, w in enumerate(windows)])
    flat = np.ascontiguousarray(np.concatenate(windows)).view(np.dtype((np.void, 4 * SHINGLE))).ravel()
    _, ids = np.unique(flat, return_inverse=True)
    pairs = np.unique(ids.astype(np.int64) * len(texts) + rows)  # each shingle of a text once, by shingle
    shingle, owner = np.divmod(pairs, len(texts))
    size = np.bincount(owner, minlength=len(texts))
    shared = np.bincount(shingle)[shingle] > 1
    shingle, owner = shingle[shared], owner[shared]
    both = np.zeros((len(texts), len(texts)), np.float32)
    if len(shingle):
        _, column = np.unique(shingle, return_inverse=True)
        for lo in range(0, int(column[-1]) + 1, 2048):
            k = slice(*np.searchsorted(column, [lo, lo + 2048]))
            m = np.zeros((len(texts), 2048), np.float32)
            m[owner[k], column[k] - lo] = 1
            both += m @ m.T
    return both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            if t.num_rows < 2:
                continue
            ids = t.column("id").to_pylist()
            near = similar(t.column("text").to_pylist(), threshold)
            np.fill_diagonal(near, False)
            across = _paired(*(t.column(c).to_numpy() for c in ("i", "j", "side")))
            if across is not None:
                near &= across
            links = near @ t.column("copies").to_numpy()
            root = roots(near)
            linked = np.flatnonzero(near.any(1))
            if len(linked):
                yield pa.record_batch({"id": pa.array([ids[x] for x in linked], pa.int64()), "root": pa.array([ids[root[x]] for x in linked], pa.int64()), "links": pa.array(links[linked], pa.int64())})

    return run


def _blocks(n: Column) -> Column:
    return n / F.least(F.greatest(n / 64, F.lit(BLOCK)), F.lit(BLOCK * WIDEST))


def _block_pairs(df: DataFrame, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in: i <= j, and side, its own."""
    own = F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    return (
        df.withColumn("side", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
        .withColumn("i", F.least("side", "other"))
        .withColumn("j", F.greatest("side", "other"))
        .drop("other", blocks)
    )


def _tasks(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(docs: DataFrame, values: int) -> DataFrame:
    """(id, key, first, copies, size, sig): one row for each distinct text; first is its smallest doc_id, id a number of this table."""
    signer = Signer(values)

    def sign(column: pa.Array) -> pa.Array:
        return pa.array(signer.sign(column.to_pylist()), pa.binary())

    text = F.coalesce("text", F.lit(""))
    signed = docs.select(text_key(text).alias("key"), "doc_id", F.octet_length(text).cast("long").alias("size"), F.arrow_udf(sign, "binary")(F.col("text")).alias("sig"))
    once = signed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    return once.withColumn("id", F.monotonically_increasing_id())


def _matched(floor: int, depth: int):
    """Of sorted (label, id) those with a neighbour that shares the tree and ``floor`` values or more. A partition's first and last row have a neighbour elsewhere and stay."""
    width = 1 + 2 * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row whose right neighbour isn't known yet
        before = floor  # prefix that it shares with its left one
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            column = rows.column("label")
            begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
            labels = np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, begin).reshape(-1, width)
            same = labels[1:] == labels[:-1]
            values = same[:, 1::2] & same[:, 2::2] & same[:, :1]
            shared = np.logical_and.accumulate(values, axis=1).sum(1)
            longest = np.maximum(np.concatenate([[before], shared[:-1]]), shared) if len(shared) else shared
            keep = np.flatnonzero(longest >= floor)
            if len(keep):
                yield rows.take(pa.array(keep))
            last, before = rows.slice(rows.num_rows - 1), int(shared[-1]) if len(shared) else before
        if last is not None:
            yield last

    return run


def forest_nodes(signed: DataFrame, trees: int, depth: int, floor: int, spared: int) -> DataFrame:
    """(node, id, long): the nodes of the tries, by hash, in which a text looks for partners; ``long`` unless the text has looked for partners at a shorter prefix already."""
    width = 2 * depth
    labels = [F.concat(F.lit(bytes([t])), F.substring("sig", t * width + 1, width)) for t in range(trees)]
    places = signed.select(F.explode(F.array(*labels)).alias("label"), "id")
    order = places.repartitionByRange(_tasks(signed.sparkSession), "label", "id").sortWithinPartitions("label", "id")
    held = cut(order.mapInArrow(_matched(floor, depth), "label binary, id long").withColumn("node", F.substring("label", 1, 1 + 2 * floor)), "tries")
    crowds = held.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    known = held.join(cut(crowds, "crowds"), "node", "left")
    loose = known.where("n IS NULL").select(F.xxhash64("node").alias("node"), "id", F.lit(True).alias("long"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), "label"))  # a text has a row for each tree at most
    dense = known.where("n IS NOT NULL").withColumn("long", rank <= spared)
    at = dense.withColumn("d", F.explode(F.sequence(F.when(F.col("long"), depth).otherwise(floor), F.lit(depth))))
    return loose.unionByName(at.select(F.xxhash64(F.expr("substring(label, 1, 1 + 2 * d)")).alias("node"), "id", (F.col("long") | (F.col("d") == floor)).alias("long")))


def families(texts: DataFrame, threshold: float, trees: int, depth: int, recall: float) -> DataFrame:
    """(id, label): texts that the forest and the signatures connect."""
    signed = texts.where(F.col("sig").isNotNull()).select("id", "sig")
    floor = floor_length(threshold, trees, recall, depth)
    held = cut(forest_nodes(signed, trees, depth, floor, spared_trees(threshold, trees, recall, depth)), "nodes")
    # nodes of one text go, and longer ones in which all texts have met at the floor; of nodes that hold the same texts one is enough
    filled = (
        held.groupBy("node")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"), F.min("id").alias("lo"), F.max("long").alias("long"))
        .where((F.col("n") > 1) & F.col("long"))
        .groupBy("n", "x", "y", "lo")
        .agg(F.min("node").alias("node"))
        .select("node", F.ceil(_blocks(F.col("n"))).cast("int").alias("blocks"))
    )
    members = held.select("node", "id").join(cut(filled, "filled"), "node").join(signed, "id")
    pairs = _block_pairs(members, "blocks").select("node", "i", "j", "side", "id", "sig")
    dealt = pairs.repartition(_tasks(texts.sparkSession), "node", "i", "j").sortWithinPartitions("node", "i", "j")
    return components(dealt.mapInArrow(_likely(threshold, trees * depth), "a long, b long"))


def verified_links(docs: DataFrame, texts: DataFrame, family: DataFrame, threshold: float) -> DataFrame:
    """(id, root, links): for each text its exact links in a block pair of its family, and a text it is connected with there."""
    known = cut(family.join(texts.select("id", "key", "copies", "size"), "id"), "members")
    blocks = known.groupBy("label").agg(F.ceil(F.greatest(_blocks(F.count("*")), F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    narrow = known.join(cut(blocks, "blocks"), "label").drop("size")
    once = docs.select(text_key(F.coalesce("text", F.lit(""))).alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    pairs = _block_pairs(once.join(narrow, "key"), "blocks").select("label", "i", "j", "side", "id", "copies", "text")
    dealt = pairs.repartition(_tasks(docs.sparkSession), "label", "i", "j").sortWithinPartitions("label", "i", "j")
    return dealt.mapInArrow(_exact(threshold), "id long, root long, links long")


def classes(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, depth: int = DEPTH) -> DataFrame:
    """(key, class_id, rep, n_links) for each distinct text: rep is the key of the class's text that holds class_id."""
    bounded_batches(docs.sparkSession)
    texts = cut(texts_of(docs.select("doc_id", "text"), trees * depth), "texts")
    family = families(texts, threshold, trees, depth, recall)
    links = cut(verified_links(docs, texts, family, threshold), "links")
    label = components(links.select(F.col("id").alias("a"), F.col("root").alias("b"))).select("id", "label")
    count = links.groupBy("id").agg(F.sum("links").alias("links"))
    linked = label.join(count, "id")
    full = texts.select("id", "key", "first", "copies").join(cut(linked, "linked"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    full = cut(full, "classes")
    rep = full.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key")).alias("r"))
    return full.join(cut(rep, "reps"), "label").select(
        "key", F.col("r.first").alias("class_id"), F.col("r.key").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )


def join_near(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """``docs`` with class_id and n_links, which replace same-named columns."""
    k, v = fresh(docs, "key", "class")
    found = cut(classes(docs, threshold, trees, recall), "joined").select(F.col("key").alias(k), F.struct("class_id", "n_links").alias(v))
    return docs.withColumn(k, text_key(F.coalesce("text", F.lit("")))).join(found, k, "left").withColumns({c: F.col(v)[c] for c in ("class_id", "n_links")}).drop(k, v)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of near-duplicates: the one with the smallest doc_id; columns stay. Texts without words are classes by their exact text."""
    k, v = fresh(docs, "key", "class")
    found = cut(classes(docs, threshold), "kept").where(F.col("key") == F.col("rep")).select(F.col("key").alias(k), F.struct("class_id").alias(v))
    key = text_key(F.coalesce("text", F.lit("")))
    kept = docs.withColumn(k, key).join(found, k).where(F.col("doc_id").eqNullSafe(F.col(v)["class_id"]))
    same = docs.select(key.alias(k), "doc_id").groupBy(k, "doc_id").agg(F.count("*").alias("n"))
    if not same.where(F.col("n") > 1).isEmpty():  # rows equal in id and text: one of them
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        kept = kept.groupBy(k).agg(F.min_by(row, F.xxhash64(row)).alias(v)).select(f"{v}.*")
    return kept.select(*docs.columns)
