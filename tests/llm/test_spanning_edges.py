"""Edges that leave a node of near copies: one for each pair of blocks beside those within blocks."""

import numpy as np
import pyarrow as pa

from kelpline.llm import ngram_join


def test_two_blocks_of_near_copies_tell_one_edge():
    values, n = 216, 50
    sig = np.zeros(values, np.uint16).tobytes()
    other = np.arange(1, values + 1, dtype=np.uint16).tobytes()

    def batch(i: int, j: int, members: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        side, id, sigs = zip(*members)
        return pa.record_batch({"node": pa.array([7] * len(id), pa.int64()), "i": pa.array([i] * len(id), pa.int32()), "j": pa.array([j] * len(id), pa.int32()), "side": pa.array(side, pa.int32()), "id": pa.array(id, pa.int64()), "sig": pa.array(sigs, pa.binary())})

    first, second = [(0, k, sig) for k in range(n)], [(1, n + k, sig) for k in range(n)] + [(1, 2 * n, other)]
    edges = lambda b: [e for out in ngram_join._likely(0.8, values)(iter([b])) for e in zip(out.column("a").to_pylist(), out.column("b").to_pylist())]
    own, across = edges(batch(0, 0, first)) + edges(batch(1, 1, second)), edges(batch(0, 1, first + second))
    assert len(own) == 2 * (n - 1) and len(across) == 1
    label = list(range(2 * n + 1))  # what the edges connect
    for _ in range(3):
        for a, b in own + across:
            label[a] = label[b] = min(label[a], label[b])
    assert set(label[: 2 * n]) == {0} and label[2 * n] == 2 * n
