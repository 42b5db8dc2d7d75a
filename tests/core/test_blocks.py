"""The search of one block in another: its memory, ties, and scores that are not finite."""

import tracemalloc

import numpy as np
import pyarrow as pa

from terraloom.operators.retrieval import best_of_two


def _block(key: str, ids, vectors, **more) -> pa.Table:
    lists = pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1], pa.array(vectors.ravel()))
    return pa.table({key: pa.array(ids), "embedding": lists} | {name: pa.array(x) for name, x in more.items()})


def _want(items, sources, vectors, ids, asked, k):
    want = []
    for q, v in zip(ids, asked.astype(float), strict=True):
        for s in dict.fromkeys(sources):
            with np.errstate(all="ignore"):
                scored = [(-round(float(v @ w), 9), i) for i, t, w in zip(items, sources, vectors.astype(float), strict=True) if t == s and i != q and np.isfinite(v @ w)]
            want += [(q, s, i) for _, i in sorted(scored)[:k]]
    return sorted(want)


def _got(t: pa.Table):
    return sorted(zip(*(t[c].to_pylist() for c in ("query_id", "source", "item_id")), strict=True))


def test_a_block_is_not_held_as_doubles_and_tiles_are_small():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(40000, 64)).astype(np.float32)
    index = _block("item_id", np.arange(40000), vectors, source=["a"] * 40000)
    queries = _block("query_id", np.arange(2048) * 7, vectors[np.arange(2048) * 7])
    tracemalloc.start()
    found = best_of_two(index, queries, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 20480
    assert peak < 40 << 20  # the block as doubles, and a tile with its copies, were 150 MB


def test_ties_itself_and_numbers_that_are_not_finite():
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(3000, 3)), 0).astype(np.float32)  # a few hundred different ones
    items, sources = rng.permutation(3000) + 5, [f"s{i % 2}" for i in range(3000)]
    ids, asked = items[:40], vectors[:40]
    got = best_of_two(_block("item_id", items, vectors, source=sources), _block("query_id", ids, asked), 7)
    assert _got(got) == _want(items, sources, vectors, ids, asked, 7)
    vectors[10] = [np.inf, 0, 1]
    got = best_of_two(_block("item_id", items[:900], vectors[:900], source=sources[:900]), _block("query_id", ids, asked), 500)
    assert _got(got) == _want(items[:900], sources[:900], vectors[:900], ids, asked, 500)


def test_vectors_without_dimensions_and_empty_blocks():
    index = _block("item_id", [3, 1], np.zeros((2, 0)), source=["a", "a"])
    queries = _block("query_id", [1], np.zeros((1, 0)))
    assert _got(best_of_two(index, queries, 2)) == [(1, "a", 3)]
    assert len(best_of_two(index.slice(0, 0), queries, 2)) == 0 == len(best_of_two(index, queries.slice(0, 0), 2))
