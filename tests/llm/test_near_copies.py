import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_near_duplicates import union
from tracelake.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, block string"


def shingles(text, k=5):
    table = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    words = (text or "").translate(table).split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def alike(a, b):
    return a == b if not a or not b else len(a & b) / len(a | b)


def brute_kept(rows, similarity=0.8):
    """Rows (id, text) that stay: the least (id, place) of each group."""
    sets = [shingles(t) for _, t in rows]
    named = [i for i, r in enumerate(rows) if r[0] is not None]
    pairs = [(i, j) for i in named for j in named if i < j and alike(sets[i], sets[j]) >= similarity]
    top = union(len(rows), pairs)
    best = {}
    for i in named:
        best[top[i]] = min(best.get(top[i], (rows[i][0], i)), (rows[i][0], i))
    return [r for i, r in enumerate(rows) if r[0] is None or best[top[i]] == (r[0], i)]


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return words


def corpus(seed, n=160):
    r = random.Random(seed)
    base = [[f"w{r.randrange(400)}" for _ in range(r.choice([3, 6, 40, 200, 900]))] for _ in range(14)]
    rows = []
    for i in range(n):
        own = r.choice(base)
        rows.append(((i * 37) % 1009, r.choice([" ", "\n", "  "]).join(edited(r, own, r.choice([0, 0, 1, 2, 4, len(own) // 60, len(own) // 30])))))
    rows += [(2000, None), (2001, ""), (2002, " \t"), (None, rows[0][1]), (None, None), (rows[3][0], "quite another text of this very id"), rows[5], rows[5]]
    rows += [(3000, rows[2][1].upper()), (3001, "x " * 40_000), (3002, "x " * 41_000)]
    return rows


@pytest.mark.parametrize(("seed", "cap"), [(1, 1024), (2, 7)])
def test_equal_brute_force(spark, seed, cap):
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, "en", "b") for x in rows], SCHEMA).coalesce(1)
    out = near_copies.without_near_copies(df, cap=cap)
    assert out.schema == df.schema
    key = lambda x: str((x[0], x[1] or "", x[1] is None))
    want = brute_kept(rows)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key) == sorted(want, key=key)
    assert 20 < len(want) < len(rows) - 40
    assert near_copies.without_near_copies(df.limit(0)).count() == 0


def test_bands_share_as_predicted():
    rng = np.random.default_rng(0)
    shared = 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 800, dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, 100, dtype=np.uint64)]) for _ in range(2))
        assert near_copies.jaccard(np.unique(a), np.unique(b)) == 0.8
        shared += bool((near_copies.bands_of(a) == near_copies.bands_of(b)).any())
    assert shared >= 299


def test_neighbours_cross_batches():
    rows = [(0, 5, 1), (0, 5, 2), (0, 6, 3), (1, 6, 4), (1, 6, 5), (1, 6, 9), (2, 0, 7)]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)]
    whole = pa.RecordBatch.from_arrays(columns, names=["band", "h", "node"])
    for step in (1, 2, 3, 10):
        found = near_copies.neighbours(whole.slice(i, step) for i in range(0, len(rows), step))
        assert [tuple(x.values()) for b in found for x in b.to_pylist()] == [(1, 2), (4, 5), (4, 9)]
