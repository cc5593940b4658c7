import math
from collections import Counter

import numpy as np
import pytest

from tracelake.llm import quality
from tracelake.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney, straight from its definition."""
    grams = [None] * (order + 1)
    grams[order] = Counter()
    for t in texts:
        s = quality.START * (order - 1) + t
        grams[order].update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s)))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    cuts = [None] * (order + 1)
    for n in range(1, order + 1):
        c = Counter(grams[n].values())
        n1, n2, n3, n4 = (c[k] for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        cuts[n] = [min(max(d, 0.0), k + 1) for k, d in enumerate(raw)]

    def chance(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(grams[1]) + 1)
        own = {g: c for g, c in grams[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return chance(gram[1:])
        total = sum(own.values())
        cut = {g: min(cuts[n][min(c, 3) - 1], c) for g, c in own.items()}
        left = sum(cut.values()) / total
        return (own.get(gram, 0) - cut.get(gram, 0)) / total + left * chance(gram[1:])

    def mean(t):
        s = quality.START * (order - 1) + t
        logs = [math.log(chance(s[i - order + 1 : i + 1])) for i in range(order - 1, len(s))]
        return -sum(logs) / len(logs) if logs else None

    mean.chance = chance
    return mean


@pytest.mark.parametrize("order", [1, 3])
def test_perplexity_equals_brute_force(spark, order):
    rng = np.random.default_rng(order)
    good = ["".join(rng.choice(list("aab c"), int(rng.integers(1, 30)))) for _ in range(40)]
    rows = [(i, t, "en", 1) for i, t in enumerate(good)] + [(50, "zz漢字 a\x02b", "en", 1), (51, "", "fr", 1), (52, None, None, 1), (None, "abc", "en", 1), (3, good[3], "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, keep int").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(50, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    held = {r["id"] for r in quality.trusted(labels, "doc_id").where("calibrates").collect()}
    mean = brute_model([t for i, t, _, _ in rows if i is not None and i < 40 and i not in held], order)
    out = quality.classify(docs, labels, order).collect()
    assert len(out) == len(rows)
    texts = {i: t for i, t, _, _ in rows}
    for r in out:
        want = mean(texts[r["doc_id"]] or "")
        assert (r["perplexity"] is None) == (want is None)
        if want is not None:
            assert math.log(r["perplexity"]) == pytest.approx(want, rel=1e-4)
        else:
            assert r["keep"]


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(9, 0, None)], "doc_id long, quality int, toxic int")
    assert [r["keep"] for r in quality.classify(docs, labels).collect()] == [True, True]
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.accepted(docs, labels).count() == 2


def test_query_separates_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = QUERIES["op5_quality_classifier"](spark, sf).join(labels, "doc_id", "left").collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    good = [r["keep"] for r in out if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["keep"] for r in out if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.15


def test_measures_equal_brute_force():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab c"), n)) for n in (0, 3, 900, 0, 8, 7, 40, 0)]
    grams = quality.Grams(texts, 4)
    losses = rng.random(int(grams.sizes.sum()))
    spans, shares = quality.worst_spans(losses, grams), quality.repeated_share(grams)
    for i, t in enumerate(texts):
        own = losses[grams.doc_start[i] : grams.doc_start[i] + len(t)]
        width = min(quality.SPAN, len(t))
        assert spans[i] == pytest.approx(max((own[k : k + width].mean() for k in range(len(t) - width + 1) if width), default=0.0))
        s = quality.START * 3 + t
        ends = [s[k : k + 4] for k in range(len(t))]
        again = [ends[k] in ends[max(k - quality.RECENT, 0) : k] for k in range(len(t))]
        assert shares[i] == pytest.approx(np.mean(again) if t else 0.0)
    assert len(quality.worst_spans(np.zeros(0), quality.Grams([""], 4))) == 1
    assert quality.repeated_share(quality.Grams([], 4)).shape == (0,)


def test_repeated_words_and_insults_are_rejected(spark):
    """Kinds whose mean perplexity is ordinary."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("etaoin"), int(rng.integers(2, 7)))) for _ in range(300)]
    texts = [" ".join(rng.choice(words, int(rng.integers(60, 400)))) for _ in range(300)]
    insulted = [f"{t} zzgrumpf {t}" for t in texts[:5]]
    repeated = [" ".join([w] * 200) for w in words[:5]]
    rows = [(i, t, "en") for i, t in enumerate(texts + insulted + repeated)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    keep = {r["doc_id"]: r["keep"] for r in quality.classify(docs, labels).collect()}
    assert np.mean([keep[i] for i in range(300)]) > 0.98
    assert not any(keep[i] for i in range(300, 310))


def test_rare_and_unknown_languages_have_limits(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("etaoin"), int(rng.integers(2, 7)))) for _ in range(300)]
    texts = [" ".join(rng.choice(words, int(rng.integers(60, 400)))) for _ in range(330)]
    junk = ["%&$ #@! " * 2 + "".join(rng.choice(list("%&$#@!*+ "), 300)) for _ in range(9)]
    lang = ["en"] * 300 + ["es", "xx", None] * 10
    rows = [(i, t, g) for i, (t, g) in enumerate(zip(texts, lang, strict=True))]
    rows += [(400 + i, t, ("es", "xx", None)[i % 3]) for i, t in enumerate(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(300), 300, 303]], "doc_id long, quality int, toxic int")
    keep = {r["doc_id"]: r["keep"] for r in quality.classify(docs, labels).collect()}
    assert not any(keep[i] for i in range(400, 409))
    assert np.mean([keep[i] for i in range(300, 330)]) > 0.9


def test_every_trusted_text_is_held_out_once(spark):
    rows = [(i, f"ab{i} cab ba", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    part = {r["id"]: r["part"] for r in quality.trusted(labels, "doc_id").collect()}
    out = quality.scores(quality.blocks(docs, "text"), labels, 3, "doc_id", "text", "lang", "bigint").collect()
    assert sorted(r["id"] for r in out if r["judged"]) == list(range(40))
    held = [r for r in out if r["calibrates"]]
    assert sorted(r["id"] for r in held) == list(range(40))
    for m in range(quality.HELD_OUT):
        mean = brute_model([t for i, t, _ in rows if part[i] != m], 3)
        for r in held:
            if part[r["id"]] == m:
                assert r["model"] == m
                assert r["log_perplexity"] == pytest.approx(mean(rows[r["id"]][1]), rel=1e-4)


def test_accepted_keeps_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in quality.classify(docs, labels).where("keep").collect()}
    out = quality.accepted(docs, labels)
    assert out.schema == docs.schema
    assert sorted(out.collect()) == sorted(r for r in docs.collect() if r["doc_id"] in kept)


def plain_limits(rows):
    """keep and limits of judged rows, from all rows of ``scores``, by the
    definitions of ``judged`` on plain lists."""

    def quantile(values, p):
        values = sorted(values)
        return values[max(0, math.ceil(p * len(values) - 1e-9) - 1)] if values else None

    held = [r for r in rows if r["calibrates"] and r["n"] > 0]
    langs = sorted({r["lang"] or "" for r in held})
    own = {g: [r for r in held if (r["lang"] or "") == g] for g in langs}
    drift = {quality.MEASURES[0]: 0.0}
    for m in quality.MEASURES[1:]:
        up = down = 0.0
        for g in langs:
            x = [math.log(r["n"]) for r in own[g]]
            y = [r[m] for r in own[g]]
            mx, my = sum(x) / len(x), sum(y) / len(y)
            up += sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True))
            down += sum((a - mx) ** 2 for a in x)
        drift[m] = up / down if down else 0.0
    out = {}
    for m in quality.MEASURES:

        def level(r, m=m):
            return r[m] - drift[m] * math.log(r["n"])

        def spread(r, m=m):
            return math.sqrt(1 + quality.SETTLED / r["n"]) if m == quality.MEASURES[0] else 1.0

        center = quantile([level(r) for r in held], 0.5)
        known = {g: len(own[g]) / (len(own[g]) + quality.ALIKE) for g in langs}
        middle = {g: known[g] * quantile([level(r) for r in own[g]], 0.5) + (1 - known[g]) * center for g in langs}
        within = quantile([(level(r) - middle[r["lang"] or ""]) / spread(r) for r in held], quality.QUANTILE)
        across = quantile([(level(r) - center) / spread(r) for r in held], quality.QUANTILE)
        for k, r in enumerate(rows):
            if r["judged"] and r["n"] > 0 and held:
                g = r["lang"] or ""
                n, w = len(own.get(g, [])), known.get(g, 0.0)
                share = min(1.0, n * (1 - quality.QUANTILE))
                top = quantile([(level(x) - middle[g]) / spread(x) for x in own[g]], quality.QUANTILE) if n else 0.0
                most = share * top + (1 - share) * (w * within + (1 - w) * across)
                limit = middle.get(g, center) + drift[m] * math.log(r["n"]) + most * spread(r)
                out.setdefault(k, []).append((limit, r[m] <= limit + quality.ROUNDING))
    return out


def test_limits_and_keep_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.scores(quality.blocks(docs.select("doc_id", "text", "lang"), "text"), labels, 4, "doc_id", "text", "lang", "bigint")
    scored = quality.written(scored, "scored")
    rows = scored.collect()
    want = plain_limits(rows)
    found = {(r["block"], r["row"]): r for r in quality.judged(scored).collect()}
    assert len(found) == docs.count() and len(want) > 900
    kept = 0
    for k, limits in want.items():
        r = found[rows[k]["block"], rows[k]["row"]]
        for m, (limit, _) in zip(quality.MEASURES, limits, strict=True):
            assert r[f"limit_{m}"] == pytest.approx(limit, rel=1e-9)
        assert r["keep"] == all(ok for _, ok in limits)
        kept += r["keep"]
    assert 0 < kept < len(want)


def test_texts_longer_than_a_block(spark):
    rng = np.random.default_rng(9)
    good = ["".join(rng.choice(list("aab c"), 30)) for _ in range(40)]
    long = "".join(rng.choice(list("aab cd"), 4_500_000))
    docs = spark.createDataFrame([*[(i, t, "en") for i, t in enumerate(good)], (99, long, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    held = {r["id"] for r in quality.trusted(labels, "doc_id").where("calibrates").collect()}
    mean = brute_model([t for i, t in enumerate(good) if i not in held], 3)
    s = quality.START * 2 + long
    grams = Counter(s[i : i + 3] for i in range(len(long)))
    (row,) = quality.classify(docs, labels, 3).where("doc_id = 99").collect()
    want = -sum(n * math.log(mean.chance(g)) for g, n in grams.items()) / len(long)
    assert row["n_scored"] == len(long)
    assert math.log(row["perplexity"]) == pytest.approx(want, rel=1e-4)
