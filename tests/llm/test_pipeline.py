import re

import corpus_pipeline
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_repeats import brute_words, sha
from tests.llm.test_tokens import check_packing
from tracelake.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in quality.classify(docs, labels).where("keep").collect()}
    rows = [r for r in docs.collect() if r["doc_id"] in kept]
    assert 0 < len(rows) < docs.count()
    stage = dict(corpus_pipeline.STAGES)
    first = stage["quality_classifier"](spark, docs, SF)
    assert sorted(first.collect()) == sorted(rows)

    alone = {d for d, _ in brute_kept([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r for r in rows if r["doc_id"] in alone]
    second = stage["simhash_near_dedup"](spark, first, SF)
    assert second.columns == docs.columns
    assert sorted(second.collect()) == sorted(rows)

    third = stage["substring_dedup"](spark, second, SF)
    assert third.schema == docs.schema
    want = {(d, s) for d, _, _, s in brute_words([(r["doc_id"], r["text"]) for r in rows], 35)}
    out = third.collect()
    words = {r["doc_id"]: " ".join(w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w) for r in out}
    assert {(d, sha(w.encode())) for d, w in words.items()} == want

    packed = corpus_pipeline.run(spark, SF).collect()
    n, bound = check_packing(packed, {r["doc_id"]: r["text"] or "" for r in out}, 2048)
    assert n <= bound * 1.02 + 1


def test_edge_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "q r", "xx", "s", 3)]
    rows += [(5, "p q", "en", "s", 3), (4, "p q", "en", "s", 3), (5, "zz yy xx ww vv", "en", "s", 14), (5, "zz yy xx ww vv", "en", "s", 14)]
    want = [(1, None), (None, "a b c"), (3, "q r"), (4, "p q"), (5, "zz yy xx ww vv")]
    docs = spark.createDataFrame(rows, schema)
    for part in (docs, docs.limit(0)):
        out = part
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == docs.columns
        found = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert sorted(found, key=str) == (sorted(want, key=str) if part is docs else [])
        assert corpus_pipeline.STAGES[-1][1](spark, out, SF).count() == out.count()


def test_clashing_columns_and_long_texts(spark):
    """Extra columns with the names that stages use inside stay as they are,
    and a text longer than a block goes through whole."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, block long, row int, id string, c string, payload binary, keep boolean"
    long = " ".join(f"w{i * i % 100_003}" for i in range(900_000))
    rest = (7, 8, "i", "c", b"p", False)
    rows = [(1, long, "en", "s", len(long), *rest), (2, long, "en", "s", len(long), *rest), (3, "one short text", None, None, None, *rest)]
    docs = spark.createDataFrame(rows, schema)
    assert len(long) > 5 << 20
    stage = dict(corpus_pipeline.STAGES)
    first = stage["quality_classifier"](spark, docs, SF)
    assert first.schema == docs.schema
    second = stage["simhash_near_dedup"](spark, docs, SF)
    assert second.schema == docs.schema and sorted(r["doc_id"] for r in second.collect()) == [1, 3]
    third = stage["substring_dedup"](spark, docs, SF)
    assert third.schema == docs.schema
    assert sorted((r["doc_id"], len(r["text"]), r["payload"]) for r in third.collect()) == [(1, 0, b"p"), (2, 0, b"p"), (3, 14, b"p")]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    check_packing(packed.collect(), {1: long, 2: long, 3: "one short text"}, 2048)
