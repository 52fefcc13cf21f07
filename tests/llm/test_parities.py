"""Sets that share lists but differ in more shingles than a link allows are no candidates; those that link stay."""

import random

import numpy as np
import pyarrow as pa

from drayage.llm import jaccard as J


def _pairs(texts):
    ids = np.arange(len(texts))
    bits = pa.Table.from_batches(J._parities(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], ["doc_id", "text"])])))
    n = pa.array([len(t.split()) - 4 for t in texts], pa.int32())
    cols = {"h": pa.array(np.zeros(len(ids), np.int64)), "n": n, "rep": pa.array(ids), "lists": pa.array(np.full(len(ids), 99)), **{k: pa.array(ids) for k in J._GROUPS}, **{k: bits.column(k).combine_chunks() for k in J._PARITIES}}
    return {(x, y) for b in J._candidates(iter([pa.RecordBatch.from_pydict(cols)])) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())}


def test_candidates_by_parities():
    r = random.Random(7)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(60)]
    assert not _pairs(texts[:20]) and not _pairs(texts)
    near = [*texts[:40], *(t.rsplit(" ", 2)[0] + " x y" for t in texts[:40])]
    assert _pairs(near) == {(i, i + 40) for i in range(40)}


def test_links_at_the_bound_stay():
    r = random.Random(8)
    texts = [[f"w{r.randrange(10**6)}" for _ in range(104)] for _ in range(200)]
    # 11 of 100 shingles replaced on each side: 89 of 111 in common
    texts = [" ".join(t) for t in texts] + [" ".join([*t[:-11], *(f"v{i}" for i in range(11))]) for t in texts]
    assert {(i, i + 200) for i in range(200)} <= _pairs(texts)
