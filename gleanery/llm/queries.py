"""The operators as queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, embedding_dedup, exact_dedup, language_id, license_scan, merkle, packing, simhash, toxicity, url_filter, warc, wavelet
from .common import new_path, read_table

BYTE_RANKS = "byte_bpe_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
LICENCE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WINDOW = 4096
PACK_END, FILE_END = 2, 1


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(read_table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), PACK_END, WINDOW)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = new_path(spark, "tokens")
    wavelet.write_tokens(read_table(spark, sf_dir, "documents"), to, public_tokenizers.path(WORD_VOCABULARY), FILE_END)
    return wavelet.read_tokens(spark, to).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read_table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"), LICENCE_PHRASES)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_byte_bpe, op3_exact_dedup, op4_simhash_dedup, op5_url_filter, op6_packing, op7_token_files, op8_warc, op9_license_scan, op10_embedding_dedup, op11_phrases, op12_merkle_manifest, op13_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": """
            WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents)
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, text_sha256
            FROM d WINDOW same AS (PARTITION BY body)
        """,
        "op11_phrases": """
            WITH pieces AS (
                SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                FROM documents),
            lists AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
            totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
            places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
            found AS (SELECT lang, d, array_to_string(w[i : i + d - 1], ' ') AS phrase, count(*) AS f FROM places, (SELECT unnest([1, 2, 3, 4]) AS d) WHERE i + d - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
            split AS (SELECT *, string_split(phrase, ' ') AS w FROM found),
            cuts AS (
                SELECT s.lang, s.phrase, s.d, s.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * s.f) // (x.f + y.f) AS score
                FROM (SELECT *, unnest(range(1, d)) AS k FROM split WHERE d > 1) s
                JOIN found x ON x.lang = s.lang AND x.phrase = array_to_string(s.w[1:k], ' ')
                JOIN found y ON y.lang = s.lang AND y.phrase = array_to_string(s.w[k + 1:], ' ')),
            lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
            inner_parts AS (SELECT lang, f, w, d, unnest(range(2, d)) AS m FROM split WHERE d > 2),
            inside AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(f) AS most FROM (SELECT *, unnest(range(1, d - m + 2)) AS i FROM inner_parts) GROUP BY ALL),
            left_over AS (SELECT c.* FROM lowest c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.most IS NULL OR 100::HUGEINT * i.most < 80::HUGEINT * c.a)
            SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
            FROM left_over o JOIN totals t ON t.lang = o.lang
            QUALIFY row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) <= 2000
        """,
    }
