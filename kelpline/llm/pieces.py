"""SentencePiece encoding and decoding, for byte-pair models with byte fallback.

Method: exact merge-type encoding by backtracking. For a part of a text an Aho-Corasick automaton of the vocabulary's pieces lists the
matches at each position, longest first. Encoding walks left to right with the longest match that is compatible with the piece
before it; two pieces are compatible if merging their joined text again would give them back, which is
found by taking both apart in the reverse order of their merges. Where no match fits, the position is marked
as failed in a bitfield and the walk steps back. The result is what merging by score gives, at one pass over the text.

A text is parted at spaces and new lines first: no piece has a space mark behind another character, nor a new line.
Runs of space marks merge among themselves with equal scores, leftmost first; they are merged by that rule.

Defined cases: a null or empty text has begin and end ids alone; characters that no piece has become byte pieces; decoding is
the library's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import bounded_batches, fresh

MARK = "▁"
#: Entries of a memory's younger half; when it is full it becomes the older half, and what is asked for again moves over. Longer parts than ``CACHED_LENGTH`` aren't
#: remembered, so a half has at most 40 MB or so.
CACHE, PAIRS, CACHED_LENGTH = 150_000, 300_000, 32


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kind = proto.normalizer_spec, proto.trainer_spec
        if kind.model_type != 2 or not kind.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only byte-pair models with byte fallback, identity normalisation and a dummy prefix")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = kind.bos_id, kind.eos_id
        # merges are ordered by score; equal scores share a rank and go left to right
        own = [(i, p) for i, p in enumerate(proto.pieces) if p.type == 1]
        ranks = {s: r for r, s in enumerate(sorted({p.score for _, p in own}, reverse=True))}
        self.id = {p.piece: i for i, p in own}
        self.text = {i: p.piece for i, p in own}
        self.rank = {i: ranks[p.score] for i, p in own}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        if any(MARK in p[1:] and p.strip(MARK) or "\n" in p or " " in p for p in self.id):
            raise ValueError("a piece has a space mark or a new line inside")
        self.parts = {i: self._take_apart(p) for p, i in self.id.items() if len(p) > 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.old_pairs: dict[int, bool] = {}
        self.after_mark: dict[str, bytes] = {}
        self.old_after: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.mark_id = self.id[MARK]
        self.mark_bytes = self._pack([self.mark_id])

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def merge(self, symbols: list[str]) -> list[str]:
        """Merging by definition: the best pair first, the leftmost of equals."""
        s = list(symbols)
        while True:
            best = min(((self.rank[t], i) for i in range(len(s) - 1) if (t := self.id.get(s[i] + s[i + 1])) is not None), default=None)
            if best is None:
                return s
            s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]

    def _take_apart(self, piece: str) -> tuple[int, int] | None:
        """The two pieces whose merge makes ``piece``; None if merging its characters never does."""
        s = list(piece)
        while len(s) > 2:
            best = min(((self.rank[t], i) for i in range(len(s) - 1) if (t := self.id.get(s[i] + s[i + 1])) is not None), default=None)
            if best is None:
                return None
            s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]
        a, b = (self.id.get(x) for x in (s if len(s) == 2 else ("", "")))
        return None if a is None or b is None else (a, b)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both again ends with just these two."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.old_pairs, self.pairs = self.pairs, {}
            known = self.old_pairs.get(key)
            known = self.pairs[key] = self._remerge(left, right) if known is None else known
        return known

    def _remerge(self, left: int, right: int) -> bool:
        # Undo merges, the last one first. Before each undoing, a merge across the border must not have come earlier: on the
        # left side of the border it would have to be strictly better, being further right; on the right side an equal one wins.
        bound: float = float("inf")
        while True:
            joint = self.id.get(self.text[left] + self.text[right])
            if joint is not None and self.rank[joint] < bound:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            ra = self.rank[left] if a else -1
            rb = self.rank[right] if b else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                bound, left = ra, a[1]
            else:
                bound, right = rb + 0.5, b[0]

    def _known(self, part: str) -> list[int]:
        """Ids of a stretch of characters that are all pieces."""
        n = len(part)
        at: list[list[int]] = [[] for _ in range(n)]
        for stop, (size, i) in self.automaton.iter(part):
            if size == 1 or self.parts[i]:
                at[stop - size + 1].append(i)  # grows with the stop, so shortest first
        failed = 0  # bit p: no way on from position p for the piece that led there
        out: list[int] = []
        choice: list[int] = []
        p, k = 0, None
        while p < n:
            found = at[p]
            k = len(found) - 1 if k is None else k
            while k >= 0:
                i = found[k]
                stop = p + len(self.text[i])
                if not failed >> stop & 1 and (not out or self.compatible(out[-1], i)):
                    break
                k -= 1
            if k >= 0:
                out.append(i)
                choice.append(k)
                p, k = stop, None
            else:
                if not out:
                    raise ValueError(f"no encoding of {part!r}")
                failed |= 1 << p
                p -= len(self.text[out.pop()])
                k = choice.pop() - 1
        return out

    def part_ids(self, part: str) -> list[int]:
        """Ids of a text without new lines, spaces, or marks but at its start."""
        out: list[int] = []
        begin = 0
        for j, c in enumerate(part):
            if c not in self.id:
                if begin < j:
                    out += self._known(part[begin:j])
                out += [self.byte[b] for b in c.encode("utf-8", "replace")]
                begin = j + 1
        return out + self._known(part[begin:]) if begin < len(part) else out

    def _marks(self, n: int) -> bytes:
        """Ids of ``n`` space marks in a row; whole runs of the longest piece are stable, so long runs cost no more."""
        widest = max(len(p) for p in self.id if not p.strip(MARK))
        whole, rest = divmod(n, widest) if n > 4 * widest and self._periodic(widest) else (0, n)
        return self._pack([self.id[MARK * widest]] * whole + [self.id[x] for x in self.merge([MARK] * rest)])

    def _periodic(self, widest: int) -> bool:
        return all(self.merge([MARK] * (k * widest + r))[:k] == [MARK * widest] * k for k in (2, 3) for r in range(widest))

    def encode(self, text: str) -> bytes:
        """Ids with begin and end as little-endian unsigned 32-bit integers."""
        out = [self._pack([self.begin])]
        if text:
            if len(self.after_mark) > CACHE:
                self.old_after, self.after_mark = self.after_mark, {}
            if len(self.plain) > CACHE:
                self.plain.clear()
            after, plain = self.after_mark, self.plain
            newline = self._pack([self.byte[10]])
            if MARK in text:
                text = text.replace(MARK, " ")
            for k, line in enumerate(text.split("\n")):
                if k:
                    out.append(newline)
                    chunks = line.split(" ")
                    head = chunks[0]
                    if head:
                        ids = plain.get(head)
                        if ids is None:
                            ids = self._pack(self.part_ids(head))
                            if len(head) <= CACHED_LENGTH:
                                plain[head] = ids
                        out.append(ids)
                    chunks = chunks[1:]
                else:
                    chunks = line.split(" ")
                run = 0
                for w in chunks:
                    if not w:
                        run += 1
                        continue
                    ids = after.get(w)
                    if ids is None:
                        ids = self.old_after.get(w)
                        ids = self._pack(self.part_ids(MARK + w)) if ids is None else ids
                        if len(w) <= CACHED_LENGTH:
                            after[w] = ids
                    if run:
                        if ids.startswith(self.mark_bytes):
                            out += [self._marks(run + 1), ids[4:]]
                        else:
                            out += [self._marks(run), ids]
                        run = 0
                    else:
                        out.append(ids)
                if run:
                    out.append(self._marks(run))
        out.append(self._pack([self.end]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model for each worker process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (binary, little-endian unsigned 32-bit, begin and end included), n_tokens, decoded, ids_sha256, decoded_sha256."""
    names = ["ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256"]

    def run(column: pa.Array) -> pa.Array:
        m = model(path)
        ids = [m.encode(t or "") for t in column.to_pylist()]
        back = [m.decode(b) for b in ids]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        arrays = [pa.array(ids, pa.binary()), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(back, pa.string()), pa.array(map(sha, ids), pa.string()), pa.array([sha(t.encode()) for t in back], pa.string())]
        return pa.StructArray.from_arrays(arrays, names)

    bounded_batches(docs.sparkSession)
    (c,) = fresh(docs, "v")
    kind = "ids binary, n_tokens long, decoded string, ids_sha256 string, decoded_sha256 string"
    return docs.withColumn(c, F.arrow_udf(run, kind)(F.col(text))).withColumns({n: F.col(c)[n] for n in names}).drop(c)
