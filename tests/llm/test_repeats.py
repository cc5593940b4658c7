import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.harness import same
from tracelake.llm import windows
from tracelake.llm.blocks import spread, squeeze
from tracelake.llm.registry import ORACLES, QUERIES
from tracelake.llm.substring_dedup import Automaton, remove_reference, remove_repeated, without_repeated
from tracelake.llm.suffix_array_dedup import merge, remove_earlier, transform

SF = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def brute_bytes(docs, width):
    first = {}
    raws = [(d, (t or "").encode()) for d, t in docs]
    for d, raw in raws:
        for i in range(len(raw) - width + 1 if d is not None else 0):
            s = raw[i : i + width]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, raw in raws:
        gone = [False] * len(raw)
        for i in range(len(raw) - width + 1 if d is not None else 0):
            if first[raw[i : i + width]] < d:
                gone[i : i + width] = [True] * width
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), len(raw) - len(kept), spans, sha(kept)))
    return sorted(out, key=str)


def brute_words(docs, width):
    counts = {}
    lists = [(d, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for d, t in docs]
    for _, w in lists:
        for i in range(len(w) - width + 1):
            counts[tuple(w[i : i + width])] = counts.get(tuple(w[i : i + width]), 0) + 1
    out = []
    for d, w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if counts[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return sorted(out, key=str)


def rows_of(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


BYTES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
WORDS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def passages(seed, n=60):
    """Documents that share passages, with copies, loops and edits."""
    r = random.Random(seed)
    vocabulary = ["a", "bb", "é", "the", "of", "x" * 9, "漢字", "word", "z"]
    pool = [[r.choice(vocabulary) for _ in range(r.randint(5, 90))] for _ in range(12)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 4)):
            words += r.choice(pool) if r.random() < 0.6 else [r.choice(vocabulary) + str(r.randint(0, 99)) for _ in range(r.randint(1, 40))]
        if r.random() < 0.3 and words:
            words[r.randrange(len(words))] = "edit"
        docs.append((i * 3 % 101, r.choice([" ", "\n", " \t"]).join(words)))
    docs += [(200, "ab " * 300), (201, "ab " * 310), (202, "q" * 400), (203, None), (204, ""), (205, docs[0][1]), (205, docs[0][1]), (None, docs[1][1])]
    return docs


@pytest.mark.parametrize("frequent", [windows.FREQUENT, 6])
def test_bytes_equal_brute_force(spark, frequent):
    docs = passages(frequent)
    df = spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, text string, block string").repartition(5)
    assert rows_of(remove_earlier(df, 50, 24, frequent=frequent), BYTES) == brute_bytes(docs, 50)


@pytest.mark.parametrize("frequent", [windows.FREQUENT, 6])
def test_words_equal_brute_force(spark, frequent):
    docs = passages(frequent + 1)
    df = spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, text string, payload string").repartition(5)
    assert rows_of(remove_repeated(df, 35, 16, frequent=frequent), WORDS) == brute_words(docs, 35)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for part in (df.limit(0), df, df.where("doc_id > 5")):
        n = part.count()
        assert remove_earlier(part).count() == remove_repeated(part).count() == without_repeated(part).count() == n
        assert remove_reference(part, df.limit(0)).count() == n


def test_byte_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(QUERIES["op6_suffix_array_dedup"](spark, SF), BYTES) == brute_bytes(docs, 50)
    same(QUERIES["op6_suffix_array_dedup"](spark, SF), ORACLES["op6_suffix_array_dedup"], SF)


def test_word_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(QUERIES["op4_substring_dedup"](spark, SF), WORDS) == brute_words(docs, 35)
    same(QUERIES["op4_substring_dedup"](spark, SF), ORACLES["op4_substring_dedup"], SF)


def test_without_repeated_keeps_columns(spark):
    docs = passages(9)
    df = spark.createDataFrame([(*d, len(d[1] or ""), "s") for d in docs], "doc_id long, text string, n_chars long, source string")
    out = without_repeated(df)
    assert out.schema == df.schema
    want = {(d, s) for d, _, _, s in brute_words(docs, 35)}
    rows = out.collect()
    assert {(r["doc_id"], sha(b" ".join((r["text"] or "").encode().split()))) for r in rows} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows)


def test_reference(spark):
    reference = spark.createDataFrame([("p q r s t u",), (None,)], "text string")
    docs = spark.createDataFrame([(1, "x p q r s y"), (2, "p q r z q r s t u"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_reference(docs, reference, 4).collect()}
    assert got == {1: (6, 4, sha(b"x y")), 2: (9, 5, sha(b"p q r z")), 3: (0, 0, sha(b""))}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=12), max_size=5), st.text("abc", max_size=12), st.integers(1, 3))
def test_matching_statistics(texts, probe, least):
    automaton = Automaton()
    for t in texts:
        automaton.add(t)
    automaton.settle()

    def occurs(s):
        return sum(t.startswith(s, i) for t in texts for i in range(len(t) - len(s) + 1))

    want = [max(n for n in range(e + 2) if n == 0 or occurs(probe[e + 1 - n : e + 1]) >= least) for e in range(len(probe))]
    assert automaton.statistics(probe, least) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=20), min_size=1, max_size=4, unique=True), st.integers(1, 6))
def test_merged_transforms_sort_rotations(texts, depth):
    raws = [np.frombuffer(t.encode() + b"\xff", np.uint8) for t in texts]
    parts = [transform(r) for r in raws]
    entries, shared = merge(parts, depth)
    places = [(k, int(p)) for k, part in enumerate(parts) for p in part[2]]

    def prefix(entry):
        k, p = places[entry]
        return (raws[k].tobytes() * (depth + 2))[p : p + depth]

    found = [prefix(e) for e in entries.tolist()]
    assert sorted(entries.tolist()) == list(range(len(places)))
    assert found == sorted(prefix(e) for e in range(len(places)))
    assert shared.tolist() == [sorted(set(found)).index(f) for f in found]


def test_texts_longer_than_a_block_and_frequent_anchors(spark):
    """A text of over 4 MB, and over 2,000 contexts of one anchor."""
    r = random.Random(8)
    shared = " ".join(f"s{k}" for k in range(20))
    rows = [(i, f"a{i} b{i} {'c' * r.randint(1, 9)} {shared} d{i} e{i % 40} " + " ".join(f"t{(i % 40) * k}" for k in range(30))) for i in range(2_600)]
    long = " ".join(f"w{k * k % 90_001}" for k in range(700_000))
    rows += [(9_000, long), (9_001, long[1_000_000:1_004_000]), (9_002, None)]
    assert len(long) > windows.SPAN and len(long.encode()) > 4 << 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(remove_repeated(df, 35, 16), WORDS) == brute_words(rows, 35)
    rows = [x for x in rows if x[0] != 9_000] + [(8_999, long[990_000:1_030_000])]
    df = spark.createDataFrame([*rows, (1, "")], "doc_id long, text string").repartition(3)
    assert rows_of(remove_earlier(df, 50, 24), BYTES) == brute_bytes([*rows, (1, "")], 50)


def test_tables_of_blocks_leave_the_catalog(spark):
    before = spark.catalog.listTables()
    assert remove_repeated(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count() == 1
    assert spark.catalog.listTables() == before


@pytest.mark.parametrize("arrays", [[np.zeros(0, np.int64)], [np.arange(5, dtype=np.uint8), np.array([-1, 2**40])], [np.arange(10**5, dtype=np.uint64) << np.uint64(40)]])
def test_squeezed_arrays_come_back(arrays):
    back = spread(squeeze(*arrays))
    assert len(back) == len(arrays) and all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, back, strict=True))
