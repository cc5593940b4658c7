"""A quality classifier: perplexity under a modified Kneser-Ney model.

The model is over n-grams of characters, interpolated, with three discounts
per order. Its counts come from all trusted texts but a part that is held out.
Limits are cross-fitted: there is a model without each part, that the part's
texts are measured under, so that every trusted text is held out once; the
first of the models measures all documents.
Counting, the model's tables and the lookups are joins sharded by n-gram: a
block of documents asks every shard for its distinct n-grams and gets their
terms back, so that nothing is broadcast and what is moved follows the input.

A document has three measures: its log perplexity, that of its worst span of a
few characters, and the share of its characters that end an n-gram which stood
shortly before. The first tells foreign text, the second a few foreign words
in a long text, the third words repeated over and over. It is rejected if one
measure exceeds its language's limit: a quantile over the held-out trusted
texts of the language. Means over few characters scatter more, so their
excesses are scaled by the expected spread at the document's length before
quantiles are taken; the other measures drift with the logarithm of the length,
which is taken out.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.blocks import answered, blocks, each_block, spread, squeeze, with_steps
from tracelake.llm.shared import written
from tracelake.llm.windows import shard_of

#: Stands before a text's first character.
START = "\x02"
#: Parts of the trusted texts, each held out from one model.
HELD_OUT = 5
#: The quantile of held-out excesses that is a measure's limit.
QUANTILE = 0.9975
#: What a document is judged by.
MEASURES = ("log_perplexity", "span", "repeated")
#: Characters of a span, and how far back an n-gram counts as repeated.
SPAN, RECENT = 8, 256
#: Characters that are scored at a time.
CHUNK = 1 << 18
#: Size of direct tables for codes; beyond it codes are sorted.
DIRECT = 1 << 23


def dense(codes: np.ndarray, bound: int) -> tuple[np.ndarray, int]:
    """Codes below ``bound`` as numbers from 0 without gaps, and how many."""
    if bound <= DIRECT:
        seen = np.zeros(bound, bool)
        seen[codes] = True
        number = np.cumsum(seen, dtype=np.int32) - 1
        return number[codes], int(number[-1]) + 1
    values, number = np.unique(codes, return_inverse=True)
    return number.astype(np.int32), len(values)


class Grams:
    """The n-grams of a block's texts, n up to ``order``. ``ids[n][i]`` is the
    number of the n-gram that ends at place i; texts are laid out one after
    another, each behind order - 1 START characters."""

    def __init__(self, texts: list[str], order: int) -> None:
        pad = START * (order - 1)
        self.order, self.text = order, "".join(pad + t for t in texts)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(self.sizes + order - 1)
        self.real = np.ones(len(points), bool)
        starts = ends - self.sizes
        for k in range(1, order):
            self.real[starts - k] = False
        self.doc_start = np.cumsum(self.sizes) - self.sizes
        self.ids: list[np.ndarray] = [np.zeros(len(points), np.int32)]
        self.count = [1]
        if not len(points):
            return
        symbol, alphabet = dense(points, 0x110000)
        for _ in range(order):
            bound = self.count[-1] * alphabet
            code = np.zeros(len(points), np.int32 if bound < 1 << 31 else np.int64)
            code[1:] = self.ids[-1][:-1]
            code *= alphabet
            code += symbol
            ids, count = dense(code, bound)
            self.ids.append(ids)
            self.count.append(count)

    def places(self, mask: np.ndarray) -> Iterator[np.ndarray]:
        """Marked places, some at a time."""
        for at in range(0, len(mask), CHUNK):
            yield at + np.flatnonzero(mask[at : at + CHUNK])

    def keys(self, n: int, mask: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct n-grams that end at marked places: texts, numbers,
        counts."""
        if n == 0:
            return [""], np.zeros(1, np.int64), np.array([np.count_nonzero(mask)])
        counts, last = np.zeros(self.count[n], np.int64), np.zeros(self.count[n], np.int64)
        for place in self.places(mask):
            own = self.ids[n][place]
            counts += np.bincount(own, minlength=len(counts))
            last[own] = place
        numbers = np.flatnonzero(counts)
        text = self.text
        return [text[e - n + 1 : e + 1] for e in last[numbers].tolist()], numbers, counts[numbers]


def hashed(texts: list[str]) -> np.ndarray:
    """What Spark's xxhash64 gives for the texts, unsigned."""
    return np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42) for t in texts), np.uint64, len(texts))


def requested(grams: Grams) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct hashes that a block asks for, and for each n the
    numbers asked for and their places among the hashes."""
    context = grams.real.copy()  # contexts end just before a character
    context[:-1] |= grams.real[1:]
    numbers, own = [], []
    for n in range(grams.order + 1):
        texts, ids, _ = grams.keys(n, context if 0 < n < grams.order else grams.real)
        numbers.append(ids)
        own.append(hashed(texts))
    keys = np.unique(np.concatenate(own))
    return keys, numbers, [np.searchsorted(keys, h) for h in own]


def needed(grams: Grams, numbers: list[np.ndarray], where: list[np.ndarray], size: int, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``size`` hashes asked for, as bits, the models after the
    first that are asked, too: those whose held-out texts have the n-gram; and
    the part of each place, -1 where there is no character."""
    of_place = np.full(len(grams.real), -1, np.int8)
    of_place[grams.real] = np.repeat(part.astype(np.int8), grams.sizes)
    models = np.zeros(size, np.uint8)
    for m in range(1, HELD_OUT):
        own = of_place == m
        if not own.any():
            continue
        context = own.copy()
        context[:-1] |= own[1:]
        for n in range(grams.order + 1):
            seen = np.zeros(grams.count[n], bool)
            seen[grams.ids[n][context if 0 < n < grams.order else own]] = True
            models[where[n][seen[numbers[n]]]] |= 1 << m
    return models, of_place


def cut_by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1)).tolist()
    return [(s, cuts[s], cuts[s + 1]) for s in range(shards) if cuts[s + 1] > cuts[s]]


def log_probabilities(grams: Grams, numbers: list[np.ndarray], where: list[np.ndarray], alpha: np.ndarray, gamma: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Log probabilities of the characters at marked places, orders
    interpolated upwards."""

    def table(values: np.ndarray, n: int, default: float) -> np.ndarray:
        out = np.full(grams.count[n], default)
        out[numbers[n]] = values[where[n]]
        return out

    share = [table(alpha, n, 0.0) for n in range(grams.order + 1)]
    weight = [table(gamma, n, 1.0) for n in range(grams.order)]
    out = np.empty(np.count_nonzero(mask))
    at = 0
    for place in grams.places(mask):
        p = np.full(len(place), share[0][0])
        for n in range(1, grams.order + 1):
            context = grams.ids[n - 1][place - 1] if n > 1 else 0
            p = share[n][grams.ids[n][place]] + weight[n - 1][context] * p
        out[at : at + len(place)] = np.log(np.maximum(p, 1e-300))
        at += len(place)
    return out


def text_means(values: np.ndarray, grams: Grams) -> np.ndarray:
    """Each text's mean of its characters' values, zero for an empty one."""
    out, some = np.zeros(len(grams.sizes)), grams.sizes > 0
    if len(values):
        out[some] = np.add.reduceat(values, grams.doc_start[some], dtype=np.float64)
    return out / np.maximum(grams.sizes, 1)


def text_runs(grams: Grams) -> Iterator[tuple[slice, slice]]:
    """Some texts at a time, of about CHUNK characters: their numbers, and the
    places of their characters among all."""
    ends = np.concatenate([[0], np.cumsum(grams.sizes)])
    a = 0
    while a < len(grams.sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK, "right")) - 1)
        yield slice(a, b), slice(int(ends[a]), int(ends[b]))
        a = b


def worst_spans(losses: np.ndarray, grams: Grams) -> np.ndarray:
    """Each text's greatest mean over SPAN characters in a row; the mean of a
    shorter text."""
    out = text_means(losses, grams)
    for texts, places in text_runs(grams):
        own, sizes = losses[places], grams.sizes[texts]
        if len(own) < SPAN:
            continue
        sums = np.concatenate([[0.0], np.cumsum(own)])
        means = np.full(len(own), -np.inf)
        means[: len(own) - SPAN + 1] = (sums[SPAN:] - sums[:-SPAN]) / SPAN
        some, starts = sizes > 0, np.cumsum(sizes) - sizes
        for k in range(1, SPAN):  # spans that leave the text
            means[np.maximum((starts + sizes)[some] - k, 0)] = -np.inf
        most = np.full(len(sizes), -np.inf)
        most[some] = np.maximum.reduceat(means, starts[some])
        out[texts] = np.where(sizes >= SPAN, most, out[texts])
    return out


def repeated_share(grams: Grams) -> np.ndarray:
    """Each text's share of characters that end an n-gram, of the highest
    order, which ends at one of the RECENT characters before, too."""
    seen = np.zeros(int(grams.sizes.sum()), np.int8)
    ids = grams.ids[-1][grams.real]
    for texts, places in text_runs(grams):
        own = ids[places].astype(np.int64)
        key = np.sort((own << 32) | np.arange(len(own)))
        place = key & 0xFFFFFFFF
        text = np.repeat(np.arange(texts.stop - texts.start, dtype=np.int32), grams.sizes[texts])[place]
        again = (key[1:] >> 32 == key[:-1] >> 32) & (place[1:] - place[:-1] <= RECENT) & (text[1:] == text[:-1])
        seen[places.start + place[1:][again]] = 1
    return text_means(seen, grams)


def model(counts: DataFrame, order: int) -> DataFrame:
    """Rows (gram, alpha0.., gamma0..) from rows (gram, c0..) of the highest
    order, a column for each of HELD_OUT models.

    alpha is the discounted share of a gram in its context, gamma the weight
    that it as a context leaves to the lower order. Lower orders count distinct
    characters to the left. The empty gram's alpha is the uniform chance of a
    character, one unseen included.
    """
    tables: list[DataFrame] = []
    grams = counts
    models = range(HELD_OUT)
    nothing = F.lit(None).cast("float")
    alphabet: list[int] = []
    for n in range(order, 0, -1):
        if n < order:
            left = [F.count(F.when(F.col(f"c{m}") > 0, 1)).alias(f"c{m}") for m in models]
            grams = written(grams.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(*left), f"grams{n}")
        freq = grams.agg(*[F.count(F.when(F.col(f"c{m}") == k, 1)).alias(f"n{m}_{k}") for m in models for k in (1, 2, 3, 4)]).first()
        rows = grams.withColumn("context", F.expr(f"substring(gram, 1, {n - 1})"))
        for m in models:
            n1, n2, n3, n4 = (freq[f"n{m}_{k}"] for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 else 0.0
            discount = [min(max(d, 0.0), k) for k, d in ((1, 1 - 2 * y * n2 / n1 if n1 else 0.5), (2, 2 - 3 * y * n3 / n2 if n2 else 1.0), (3, 3 - 4 * y * n4 / n3 if n3 else 1.5))]
            c = F.col(f"c{m}")
            rows = rows.withColumn(f"d{m}", F.when(c == 0, 0.0).when(c == 1, float(discount[0])).when(c == 2, float(discount[1])).otherwise(float(discount[2])))
        sums = [F.sum(f"{x}{m}").alias(f"{y}{m}") for m in models for x, y in (("c", "total"), ("d", "left"))]
        totals = rows.groupBy("context").agg(*sums)
        share = [F.when(F.col(f"c{m}") > 0, ((F.col(f"c{m}") - F.col(f"d{m}")) / F.col(f"total{m}")).cast("float")).alias(f"alpha{m}") for m in models]
        rest = [F.when(F.col(f"total{m}") > 0, (F.col(f"left{m}") / F.col(f"total{m}")).cast("float")).alias(f"gamma{m}") for m in models]
        tables.append(rows.join(totals, "context").select("gram", *share, *[nothing.alias(f"gamma{m}") for m in models]))
        tables.append(totals.select(F.col("context").alias("gram"), *[nothing.alias(f"alpha{m}") for m in models], *rest))
        if n == 1:
            seen = grams.agg(*[F.count(F.when(F.col(f"c{m}") > 0, 1)).alias(f"a{m}") for m in models]).first()
            alphabet = [seen[f"a{m}"] for m in models]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    uniform = [F.lit(1.0 / (alphabet[m] + 1)).cast("float").alias(f"alpha{m}") for m in models]
    base = counts.sparkSession.range(1).select(F.lit("").alias("gram"), *uniform, *[nothing.alias(f"gamma{m}") for m in models])
    terms = [(f"{x}{m}", default) for x, default in (("alpha", 0.0), ("gamma", 1.0)) for m in models]
    out = out.unionByName(base).groupBy("gram").agg(*[F.max(name).alias(name) for name, _ in terms])
    return out.select("gram", *[F.coalesce(name, F.lit(default).cast("float")).alias(name) for name, default in terms])


def rounded(x: np.ndarray) -> np.ndarray:
    """Floats with 16 bits after the first, which is 1e-5 of the value: their
    last byte is zero, so that it costs nothing when compressed."""
    bits = x.astype(np.float32).view(np.uint32)
    return ((bits + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view(np.float32)


def _answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """A shard's terms for the keys that blocks asked for: of the first model
    for all keys, of each other for those whose bit is set."""
    keys = known["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    tables = [[rounded(known[f"{x}{m}"].to_numpy())[order] for x in ("alpha", "gamma")] for m in range(HELD_OUT)]
    data = []
    for x in asked["data"]:
        steps, models = spread(x)
        all_keys = np.cumsum(steps, dtype=np.uint64)
        out = []
        for m, (shares, weights) in enumerate(tables):
            own = all_keys[models >> m & 1 == 1] if m else all_keys
            at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            a, g = np.zeros(len(own), np.float32), np.ones(len(own), np.float32)
            a[hit], g[hit] = shares[at[hit]], weights[at[hit]]
            out += [a.view(np.int32), g.view(np.int32)]
        data.append(squeeze(*out))
    return pd.DataFrame({"block": asked["block"], "shard": asked["shard"], "data": data})


def trusted(labels: DataFrame, id_col: str) -> DataFrame:
    """Rows (id, part, calibrates) of documents that every label of theirs
    calls good and not toxic. A hash of the id chooses the model that the text
    is held out from; calibrates tells those held out from the first."""
    per = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    good = F.coalesce(F.min(F.coalesce("quality", F.lit(0))) == 1, F.lit(False)) & (F.max(F.coalesce("toxic", F.lit(1))) == 0)
    part = F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)).cast("int")
    return per.agg(good.alias("good")).where("good").select("id", part.alias("part"), (part == 0).alias("calibrates"))


SCORES = "block long, row int, id {kind}, lang string, n long, log_perplexity double, span double, repeated double, model int, judged boolean, calibrates boolean"


def scores(
    held: DataFrame, labels: DataFrame, order: int, id_col: str, text_col: str, lang_col: str, kind: str
) -> DataFrame:
    """Rows SCORES: for every row of the blocks one that is judged, under the
    first model, and for a trusted row of another part one more under the model
    that it is held out from. Held-out rows calibrate, unless their model has no
    texts. An empty text has no measures."""
    shards = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_part = [f"c{m}" for m in range(HELD_OUT)]

    def identities(block: int, rows: pa.Table, _) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        arrays = [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), rows.column(id_col).combine_chunks()]
        yield pa.RecordBatch.from_arrays(arrays, names=["block", "row", "id"])

    def parts(rows: pa.Table, trusted_rows: list[tuple[int, bytes]]) -> np.ndarray:
        """The part of each row, -1 if it isn't trusted."""
        out = np.full(rows.num_rows, -1)
        for i, part in trusted_rows:
            out[i] = int(part)
        return out

    def counting(block: int, rows: pa.Table, answers) -> Iterator[pa.RecordBatch]:
        part = parts(rows, answers)
        own = np.flatnonzero(part >= 0)
        texts = rows.column(text_col).take(pa.array(own)).to_pylist()
        grams = Grams([t or "" for t in texts], order)
        if not grams.real.any():
            return
        found, numbers, _ = grams.keys(order, grams.real)
        place, of_place = np.flatnonzero(grams.real), np.repeat(part[own], grams.sizes)
        counts = [np.bincount(grams.ids[order][place[of_place == m]], minlength=grams.count[order])[numbers] for m in range(HELD_OUT)]
        arrays = [pa.array(found, pa.string()), *(pa.array(c.astype(np.int64)) for c in counts)]
        yield pa.RecordBatch.from_arrays(arrays, names=["gram", *by_part])

    def asking(block: int, rows: pa.Table, answers) -> Iterator[pa.RecordBatch]:
        grams = Grams([t or "" for t in rows.column(text_col).to_pylist()], order)
        keys, numbers, where = requested(grams)
        models, _ = needed(grams, numbers, where, len(keys), parts(rows, answers))
        cuts = cut_by_shard(keys, shards)
        data = [squeeze(with_steps(keys[a:b]), models[a:b]) for _, a, b in cuts]
        arrays = [pa.array([s for s, _, _ in cuts], pa.int32()), pa.array([block] * len(cuts), pa.int64()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["shard", "block", "data"])

    def scoring(block: int, rows: pa.Table, answers) -> Iterator[pa.RecordBatch]:
        part = parts(rows, [(-1 - s, x) for s, x in answers if s < 0])
        grams = Grams([t or "" for t in rows.column(text_col).to_pylist()], order)
        keys, numbers, where = requested(grams)
        models, of_place = needed(grams, numbers, where, len(keys), part)
        terms = [spread(x) for s, x in answers if s >= 0]

        def losses(m: int, mask: np.ndarray) -> np.ndarray:
            values = []
            for k, default in ((2 * m, 0.0), (2 * m + 1, 1.0)):
                full = np.full(len(keys), default)
                full[models >> m & 1 == 1 if m else slice(None)] = np.concatenate([t[k] for t in terms]).view(np.float32)
                values.append(full)
            found = log_probabilities(grams, numbers, where, *values, mask)
            return np.negative(found, out=found)

        n, repeated = grams.sizes, repeated_share(grams)

        def rows_of(own: np.ndarray, values: np.ndarray, model: np.ndarray, first: bool) -> pa.RecordBatch:
            measures = (text_means(values, grams), worst_spans(values, grams), repeated)
            arrays = [
                pa.array(np.full(len(own), block)),
                pa.array(own.astype(np.int32)),
                rows.column(id_col).combine_chunks().take(pa.array(own)),
                rows.column(lang_col).combine_chunks().take(pa.array(own)),
                pa.array(n[own]),
                *(pa.array(x[own], mask=n[own] == 0) for x in measures),
                pa.array(model.astype(np.int32)),
                pa.array(np.full(len(own), first)),
                pa.array((part[own] == model) & np.isin(model, usable)),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "row", "id", "lang", "n", *MEASURES, "model", "judged", "calibrates"])

        values = losses(0, grams.real)
        yield rows_of(np.arange(len(n)), values, np.zeros(len(n)), True)
        own = np.flatnonzero(part > 0)
        if len(own):
            for m in np.unique(part[own]).tolist():
                values[of_place[grams.real] == m] = losses(m, of_place == m)
            yield rows_of(own, values, part[own], False)

    own = each_block(held, f"block long, row int, id {kind}", identities)
    teachers = own.join(trusted(labels, id_col), "id")
    teachers = written(teachers.select("block", F.col("row").alias("shard"), F.col("part").cast("string").cast("binary").alias("data")), "teachers")
    taught = answered(held, teachers)
    counted = each_block(taught.where("answers is not null"), "gram string, " + ", ".join(f"{c} long" for c in by_part), counting)
    counted = counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in by_part])
    every = sum(map(F.col, by_part))
    counts = written(counted.select("gram", *[(every - F.col(c)).alias(c) for c in by_part]), "grams")
    some = counts.agg(*[F.max(c).alias(c) for c in by_part]).first()
    usable = [m for m, c in enumerate(by_part) if some[c]]
    terms = [f"{x}{m}" for x in ("alpha", "gamma") for m in range(HELD_OUT)]
    rows = written(model(counts, order).select(F.xxhash64("gram").alias("key"), *terms), "model")
    place = F.shiftrightunsigned(F.shiftrightunsigned("key", 32) * F.lit(shards).cast("long"), 32).cast("int")
    known = rows.select(place.alias("shard"), "key", *terms)
    asked = each_block(taught, "shard int, block long, data binary", asking)
    replies = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(_answer, "block long, shard int, data binary")
    replies = replies.unionByName(teachers.select("block", (-1 - F.col("shard")).alias("shard"), "data"))
    return each_block(answered(held, replies), SCORES.format(kind=kind), scoring)


#: Languages up to which their limits are joined as a broadcast.
LANGUAGES = 10_000
#: Characters after which a mean's scatter is that of documents, not of length.
SETTLED = 400.0
#: Texts of its own from which a language's median counts as much as that of all.
ALIKE = 1.0
#: What a measure may lose in sums and differences.
ROUNDING = 1e-9


def drifts(held: DataFrame) -> dict[str, float]:
    """For each measure but the first how much it grows with the logarithm of
    the length, within languages."""
    per = [F.covar_pop(m, F.ln("n")).alias(m) for m in MEASURES[1:]]
    per = held.groupBy("lang_").agg(F.count("*").alias("texts"), F.var_pop(F.ln("n")).alias("var"), *per)
    (row,) = per.agg(*[(F.sum(F.col("texts") * F.col(m)) / F.nullif(F.sum(F.col("texts") * F.col("var")), F.lit(0.0))).alias(m) for m in MEASURES[1:]]).collect()
    return {MEASURES[0]: 0.0} | {m: row[m] or 0.0 for m in MEASURES[1:]}


def judged(scored: DataFrame) -> DataFrame:
    """The judged rows with every measure's limit (for the document) and keep.

    The excess of a measure over the language's median held-out text, the
    log perplexity's divided by sqrt(1 + SETTLED / n), may be the QUANTILE of
    held-out excesses at most. Medians and quantiles of a language with few
    held-out texts are shrunk to those over all languages; one without any (a
    null language is one of its own) is held to what all texts together show,
    whatever their language. Documents without text are kept, and all are where
    no text is held out.
    """
    scored = scored.withColumn("lang_", F.coalesce("lang", F.lit("")))
    held = scored.where("calibrates and n > 0")
    drift = drifts(held)
    spread_of = {m: F.lit(1.0) for m in MEASURES} | {MEASURES[0]: F.sqrt(1 + F.lit(SETTLED) / F.col("n"))}
    trend = {m: F.ln("n") * drift[m] for m in MEASURES}

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    def quantile(value: Column, at: float) -> Column:
        return F.percentile_approx(value, at, 10_000)

    def number(value: float | None) -> Column:
        return F.lit(value).cast("double")

    level = {m: F.col(m) - trend[m] for m in MEASURES}
    (center,) = held.agg(*[quantile(level[m], 0.5).alias(m) for m in MEASURES]).collect()
    middle = held.groupBy("lang_").agg(F.count("*").alias("texts"), *[quantile(level[m], 0.5).alias(m) for m in MEASURES])
    known = F.col("texts") / (F.col("texts") + ALIKE)
    middle = middle.select("lang_", "texts", *[(known * F.col(m) + (1 - known) * number(center[m])).alias(f"middle_{m}") for m in MEASURES])
    middle = written(middle, "middle")
    few = middle.count() <= LANGUAGES
    excess = {m: (level[m] - F.col(f"middle_{m}")) / spread_of[m] for m in MEASURES}
    placed = held.join(small(middle), "lang_")
    within = [quantile(excess[m], QUANTILE).alias(f"within_{m}") for m in MEASURES]
    across = [quantile((level[m] - number(center[m])) / spread_of[m], QUANTILE).alias(f"across_{m}") for m in MEASURES]
    (general,) = placed.agg(*within, *across).collect()
    top = placed.groupBy("lang_").agg(*[quantile(excess[m], QUANTILE).alias(f"top_{m}") for m in MEASURES])
    out = scored.where("judged").join(small(middle.join(top, "lang_")), "lang_", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    own = F.least(F.lit(1.0), F.col("texts") * (1 - QUANTILE))
    limit = {}
    for m in MEASURES:
        others = known * number(general[f"within_{m}"]) + (1 - known) * number(general[f"across_{m}"])
        most = own * F.coalesce(f"top_{m}", F.lit(0.0)) + (1 - own) * others
        limit[m] = F.coalesce(f"middle_{m}", number(center[m])) + trend[m] + most * spread_of[m]
    keep = F.lit(True)
    for m in MEASURES:
        keep &= F.coalesce(F.col(m) <= limit[m] + ROUNDING, F.lit(True))
    shown = [F.when(F.col("n") > 0, limit[m]).alias(f"limit_{m}") for m in MEASURES]
    return out.select("block", "row", "id", "lang", "n", *MEASURES, *shown, keep.alias("keep"))


def classify(
    docs: DataFrame, labels: DataFrame, order: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Rows (id, lang, n_scored, perplexity, threshold, keep, span_perplexity,
    span_threshold, repeated, repeated_threshold), one per row.

    ``labels`` has the id, quality and toxic: texts labelled good and not toxic
    are the trusted ones. Empty and null texts have null measures and are kept; repeated rows have equal results; rows with a null id are scored.
    Without trusted texts everything is kept. Other columns aren't read.
    """
    df = docs.select(id_col, text_col, lang_col)
    scored = scores(blocks(df, text_col), labels, order, id_col, text_col, lang_col, df.schema[id_col].dataType.simpleString())
    found = judged(written(scored, "scores"))
    shown = {"perplexity": F.exp("log_perplexity"), "threshold": F.exp("limit_log_perplexity"), "keep": F.col("keep")}
    shown |= {"span_perplexity": F.exp("span"), "span_threshold": F.exp("limit_span")}
    shown |= {"repeated": F.col("repeated"), "repeated_threshold": F.col("limit_repeated")}
    return found.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), F.col("n").alias("n_scored"), *[c.alias(k) for k, c in shown.items()])


def accepted(docs: DataFrame, labels: DataFrame, order: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all columns."""
    held = blocks(docs, text_col)
    scored = scores(held, labels, order, id_col, text_col, lang_col, docs.schema[id_col].dataType.simpleString())
    gone = judged(written(scored, "scores")).where("not keep")
    gone = gone.select("block", F.col("row").alias("shard"), F.lit(b"").alias("data"))

    def kept(block: int, rows: pa.Table, answers) -> Iterator[pa.RecordBatch]:
        stays = np.ones(rows.num_rows, bool)
        stays[[i for i, _ in answers]] = False
        yield from rows.filter(pa.array(stays)).combine_chunks().to_batches()

    return each_block(answered(held, gone), docs.schema, kept)
