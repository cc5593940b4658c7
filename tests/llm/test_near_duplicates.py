import numpy as np
import pytest
import xxhash

from tests.harness import same
from tracelake.llm import embedding_dedup, simhash
from tracelake.llm.components import components
from tracelake.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def union(n, pairs):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(199, i) for i in range(170, 199)]
    pairs += [tuple(map(int, p)) for p in rng.integers(200, 400, (90, 2))] + [(7, 7)]
    want = {i: c for i, c in enumerate(union(400, pairs)) if any(i in p for p in pairs)}
    edges = spark.createDataFrame([*pairs, *pairs, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and {k for k, v in want.items() if v != k} <= got.keys()
    assert components(edges.limit(0)).count() == 0


def plain_fingerprint(text):
    table = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(table)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A b C d", "É À b c d e", "x " * 5000, "a\x0bb\x0cc\rd e\x85f g"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def brute_classes(fps, distance):
    n = len(fps)
    pairs = [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance]
    return union(n, pairs)


def test_embedding_is_a_lower_bound(spark):
    rng = np.random.default_rng(0)
    values = [int(x) - (1 << 63) for x in rng.integers(0, 2**63, 200)] + [0, -1, 1 << 62]
    df = spark.createDataFrame([(v,) for v in values], "fp long").select("fp", simhash.embedding(simhash.F.col("fp")).alias("e"))
    rows = df.collect()

    def counts(v):
        return [(v >> (2 * s) & 3).bit_count() for s in range(32)]

    for r in rows:
        u = r["e"] & (1 << 64) - 1
        assert counts(u) == counts(r["fp"] & (1 << 64) - 1)
    for a, b in zip(rows, rows[1:], strict=False):
        manhattan = sum(abs(x - y) for x, y in zip(counts(a["fp"]), counts(b["fp"]), strict=True))
        assert manhattan == ((a["e"] ^ b["e"]) & (1 << 64) - 1).bit_count() <= ((a["fp"] ^ b["fp"]) & (1 << 64) - 1).bit_count()


@pytest.mark.parametrize(("blocks", "cap"), [(5, 4096), (6, 10), (7, 50)])
def test_links_connect_what_brute_force_connects(spark, blocks, cap):
    rng = np.random.default_rng(blocks)
    fps = []
    for center in rng.integers(0, 2**63, 25).tolist():
        for _ in range(int(rng.integers(1, 12))):
            x = center
            for bit in rng.integers(0, 64, int(rng.integers(0, 6))).tolist():
                x ^= 1 << bit
            fps.append(x)
    dense = int(rng.integers(0, 2**63))
    fps += [dense ^ (1 << a) ^ (1 << b) for a in range(0, 40) for b in range(a)]
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long")
    found = [(r["a"], r["b"]) for r in simhash.links(df, 4, blocks, cap).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in found)
    assert union(len(fps), found) == brute_classes(fps, 4)


def test_simhash_query(spark):
    rows = QUERIES["op1_simhash_near_dedup"](spark, SF).collect()
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    fps = [plain_fingerprint(t) for _, t in docs]
    classes = brute_classes(fps, 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows}
    assert len(rows) == len(docs)
    assert got == {d: (f"{f:016x}", docs[c][0]) for (d, _), f, c in zip(docs, fps, classes, strict=True)}


def test_simhash_edge_rows(spark):
    rows = [(5, None, 1), (3, " ", 2), (9, "a b", 3), (9, "a b", 3), (8, "A  B", 4), (None, "a b", 5), (2, "q r s t u v", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, None), (2, 2), (3, 3), (5, 3), (8, 8), (9, 8), (9, 8)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def brute_rows(rows, distance=4):
    """Components of rows (id, text): by fingerprints, and by equal ids."""
    fps = [plain_fingerprint(t) for _, t in rows]
    named = [i for i, r in enumerate(rows) if r[0] is not None]
    pairs = [(i, j) for i in named for j in named if rows[i][0] == rows[j][0] or (fps[i] ^ fps[j]).bit_count() <= distance]
    top = union(len(rows), pairs)
    least = {}
    for i in named:
        least[top[i]] = min(least.get(top[i], rows[i][0]), rows[i][0])
    return sorted(((r[0], f"{f:016x}", None if r[0] is None else least[t]) for r, f, t in zip(rows, fps, top, strict=True)), key=str)


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_simhash_with_repeated_ids(spark, kind):
    import datetime

    texts = ["p q", "zz yy xx ww vv", "a b c d e f", None, "p q", "one two three four five", "  p   Q "]
    ids = [1, 5, 7, 9, 5, 7, 30, None, 4, 4, 12]
    rows = [(i, texts[k % len(texts)]) for k, i in enumerate(ids * 2)]
    as_kind = {"long": lambda i: i, "string": lambda i: f"id{i}", "date": lambda i: datetime.date(2024, 1, i)}[kind]
    rows = [(None if i is None else as_kind(i), t) for i, t in rows]
    df = spark.createDataFrame([(*r, "x") for r in rows], f"doc_id {kind}, text string, least string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == brute_rows(rows)


def test_blocks_balance_copies_and_candidates():
    assert [simhash.choose_blocks(10**k, 4) for k in (0, 3, 6)] == [5, 5, 6]
    for n in (10**8, 10**9, 10**10):
        assert len(simhash.grids(simhash.choose_blocks(n, 4), 4)) <= 400


def test_embedding_query_equals_its_sql(spark):
    same(QUERIES["op10_embedding_near_dedup"](spark, SF), ORACLES["op10_embedding_near_dedup"], SF)


@pytest.mark.parametrize(("cap", "sketches", "large"), [(1024, 2048, 1 << 16), (16, 13, 40), (16, 2048, 2)])
def test_embedding_links(spark, cap, sketches, large):
    rng = np.random.default_rng(cap)
    base = rng.standard_normal((30, 24))
    rows = [base[i % 30] + rng.standard_normal(24) * rng.choice([0.0, 0.05, 0.2, 0.3]) for i in range(260)]
    vectors = [(i, v.tolist(), "x") for i, v in enumerate(rows)]
    unit = np.array([v / np.linalg.norm(v) for v in rows])
    hit = unit @ unit.T >= 0.9
    vectors += [(300, None, ""), (301, [0.0] * 24, ""), (302, [float("nan")] * 24, ""), (303, [None] * 24, ""), (304, [], ""), (305, [1.0, 2.0], "")]
    vectors += [(306, [1e-200, 2e-200], ""), (307, [1e200, 2e200], ""), (None, [1.0, 2.0], "")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, n string")
    out = embedding_dedup.near_duplicates(df, cap=cap, sketches_cap=sketches, large=large).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    classes = union(260, [(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True)])
    want = {i: (int(hit[i].sum()) - 1, c, i == c) for i, c in enumerate(classes)}
    want |= {i: (0, i, True) for i in range(300, 305)} | {None: (0, None, False)}
    want |= {305: (2, 305, True), 306: (2, 305, False), 307: (2, 305, False)}
    assert len(out) == len(vectors)
    assert got == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_string_ids_and_copies_of_vectors(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.1]), ("c", [1.0, 0.0]), ("d", [0.0, 1.0]), ("d", [0.0, 1.0]), (None, [1.0, 0.0]), ("e", None)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id string, embedding array<float>")).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out), key=str)
    assert got == sorted([("a", 2, "a", True), ("b", 2, "a", False), ("c", 2, "a", False), ("d", 1, "d", True), ("d", 1, "d", True), (None, 0, None, False), ("e", 0, "e", True)], key=str)


def pairs_at(rng, n, cosine, spread):
    """Pairs of 64 dimensions at a cosine; ``spread`` makes components unlike."""
    a = rng.standard_normal((n, 64)) * np.exp(spread * rng.standard_normal((n, 64)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    c = rng.standard_normal((n, 64)) * np.exp(spread * rng.standard_normal((n, 64)))
    c -= (c * a).sum(axis=1, keepdims=True) * a
    return a, cosine * a + np.sqrt(1 - cosine**2) * c / np.linalg.norm(c, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [10_000, 1_000_000])
def test_pairs_at_the_threshold_share_a_bucket(n):
    a, b = pairs_at(np.random.default_rng(1), 2_000, 0.9, 0.0)
    chosen = (*embedding_dedup.plan(n, 0.9, 1e-4), 7)
    shared = (embedding_dedup.buckets(a, *chosen) == embedding_dedup.buckets(b, *chosen)).any(axis=1)
    assert shared.sum() >= 1_998


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.0])
def test_sketches_let_pairs_at_the_threshold_pass(spread):
    def passes(a, b):
        (x, off_x), (y, off_y) = (embedding_dedup.sketched(embedding_dedup.sketches(v)) for v in (a, b))
        return (x * y).sum(axis=1) >= embedding_dedup.lowest(off_x, off_y, 64, 0.9)

    rng = np.random.default_rng(2)
    assert passes(*pairs_at(rng, 20_000, 0.9, spread)).all()
    assert passes(*pairs_at(rng, 5_000, 0.6 - 0.1 * spread, spread)).mean() < 0.05
    one = embedding_dedup.sketches(np.array([[0.6, 0.0, -0.8]]))
    assert np.allclose(embedding_dedup.sketched(one)[0][0, :3], [0.6, 0, -0.8], atol=0.05) and one.shape == (1, 6)
