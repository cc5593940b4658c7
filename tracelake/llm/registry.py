"""The subpackage's named queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import chat, embedding_dedup, quality, simhash
from tracelake.llm.audio import media_columns
from tracelake.llm.packing import pack
from tracelake.llm.sentencepiece_codec import encode_documents
from tracelake.llm.substring_dedup import remove_repeated
from tracelake.llm.suffix_array_dedup import remove_earlier
from tracelake.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, shingle=4, seed=42)


@query("op2_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2048)


@query("op3_audio_media")
def audio_media(spark, sf_dir):
    return media_columns(table(spark, sf_dir, "documents"))


@query(
    "op4_substring_dedup",
    """WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS n FROM starts) WHERE n > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS g FROM hits GROUP BY doc_id),
kept AS (SELECT doc_id, w, coalesce(len(g), 0) AS n_removed,
    CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(g, k)) END AS k FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w) AS n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept""",
)
def substring_dedup(spark, sf_dir):
    return remove_repeated(table(spark, sf_dir, "documents"), width=35, with_text=False)


@query("op5_quality_classifier")
def quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), order=4)


@query(
    "op6_suffix_array_dedup",
    """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(1, octet_length(b) - 48), lambda i: struct_pack(i := i, s := array_slice(b, i, i + 49)))) AS x FROM d),
first AS (SELECT x.s AS s, min(doc_id) AS least FROM w GROUP BY x.s),
hit AS (SELECT doc_id, x.i AS i FROM w JOIN first ON w.x.s = first.s WHERE least < doc_id),
marked AS (SELECT doc_id, i, CAST(coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS INTEGER) AS new FROM hit),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM numbered GROUP BY doc_id, g),
parts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed, max(z) AS last,
    string_agg(hex(array_slice(b, before + 1, a - 1)), '' ORDER BY a) AS head FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || hex(array_slice(b, coalesce(last, 0) + 1, octet_length(b))))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)""",
)
def suffix_array_dedup(spark, sf_dir):
    return remove_earlier(table(spark, sf_dir, "documents"), width=50, with_text=False)


@query("op7_token_counts")
def counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 512)


@query("op8_chat_formatting")
def chat_formatting(spark, sf_dir):
    """The roles of transcripts in several styles, without the role column."""
    shown = chat.transcripts(table(spark, sf_dir, "conversations"))
    return chat.parse(shown.drop("role"), chat.fit(shown))


@query("op9_sentencepiece_dropout")
def sentencepiece_dropout(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", dropout=0.1, seed=1)


@query(
    "op10_embedding_near_dedup",
    """WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.ok AND b.ok AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM low LEFT JOIN degree USING (vec_id)""",
)
def embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)
