"""The corpus operators as named queries over the test tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    collocations,
    exact_dedup,
    language,
    licenses,
    ngram_join,
    norm_buckets,
    packing,
    quality_classifier,
    quality_rules,
    token_counts,
    toxicity,
    warc,
)
from ..session import scratch_dir, staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_packing(spark, sf_dir):
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("token_ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query
def op2_exact_dedup(spark, sf_dir):
    found = exact_dedup.new_index(spark).deduplicate(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLES["op2_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""


@query
def op6_byte_bpe(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN)
    digests = ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(byte_bpe.ids_text(), 256).alias("ids_sha256"),
        "ids",
    )
    return byte_bpe.decode(digests, vocabulary).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


def share(divisor: int) -> Column:
    """Remainder of the CRC-32 of ``doc_id`` as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def held_out(apart: Column) -> Column:
    """Rows without ``doc_id`` are never learnt from, so they are held out."""
    return F.coalesce(apart, F.lit(True)).alias("held_out")


@query
def op5_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(share(4) != 2)
    network = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, network)
    return scored.select(
        "doc_id",
        held_out(share(4) == 2),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op7_quality_rules(spark, sf_dir):
    return quality_rules.judge(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "posterior",
    )


@query
def op9_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    dictionaries = language.fit(docs.where(share(5) != 0))
    return language.identify(docs, dictionaries).select(
        "doc_id", held_out(share(5) == 0), "lang_pred", "score", "accepted"
    )


@query
def op3_ngram_join(spark, sf_dir):
    return ngram_join.near_copies(documents(spark, sf_dir))


@query
def op4_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(documents(spark, sf_dir)).withColumn(
        "predicted", F.col("kept").cast("int")
    )


@query
def op8_licenses(spark, sf_dir):
    found = licenses.scan_licenses(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("licenses.license")), ",").alias("licenses"),
        F.array_max("licenses.score").alias("best_score"),
        F.array_min("licenses.start").alias("first_start"),
    )


@query
def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(
        documents(spark, sf_dir),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@query
def op11_norm_buckets(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return norm_buckets.rank(documents(spark, sf_dir), items)


#: Lower-cases A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op11_norm_buckets"] = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS nd, CAST(sum(len(terms)) AS BIGINT) AS nt FROM d),
t AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w, nd, nt
  FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt))) AS impact
  FROM f JOIN w USING (term)),
r AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER o AS INT) AS rank, doc_id, score FROM r WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 50"""


@query
def op12_collocations(spark, sf_dir):
    return collocations.collocations(documents(spark, sf_dir))


ORACLES["op12_collocations"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM g, (VALUES (1), (2), (3), (4), (5)) AS v(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
u AS (SELECT lang, phrase, k, a, ws, unnest(range(1, k)) AS j FROM c),
h AS (SELECT u.lang, u.phrase, u.a, j, x.f AS l, y.f AS r, n,
    CAST((1000::HUGEINT * u.a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM u JOIN n USING (lang)
    JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(ws[:j], ' ')
    JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(ws[j + 1:], ' ')),
m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
z AS (SELECT lang, a, ws, s, unnest(range(1, k - s + 2)) AS i
  FROM (SELECT lang, a, ws, k, unnest(range(2, k)) AS s FROM c)),
b AS (SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS cover FROM z GROUP BY ALL)
SELECT m.lang, CAST(row_number() OVER o AS INT) AS rank, m.phrase, m.a, l, r, n, score
FROM m LEFT JOIN b USING (lang, phrase) WHERE cover IS NULL OR cover < m.a
WINDOW o AS (PARTITION BY m.lang ORDER BY score DESC, m.a DESC, encode(m.phrase))
QUALIFY row_number() OVER o <= 2000"""


@query
def op13_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = warc.write_archives(pages, scratch_dir(spark, "warc"))
    records = warc.with_referred_page(staged(warc.read_archives(archives), "records"))
    whole = F.when(F.col("error").isNull(), F.col("page_id")).otherwise(
        F.raise_error(F.concat_ws(": ", "path", "error"))
    )
    return records.select(
        whole.cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to_page").cast("long").alias("refers_to"),
    )


ORACLES["op13_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""
