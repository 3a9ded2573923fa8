"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
import json

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import byte_pairs, chat, exact_dedup, fill_middle, fingerprint, licenses, mixing, near_dedup, piece_sampling, quality, substring_dedup, token_files, whitening
from gristmill.llm.shared import fresh_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprint.edited_fingerprints(documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_dedup.near_dedup(documents(spark, sf_dir))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix_report(mixing.mix(documents(spark, sf_dir)))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to files and read back."""
    path = fresh_dir(spark, "token-files")
    files = token_files.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, path, files)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the row of each that stays."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="largest")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeat passages of earlier documents, removed."""
    return substring_dedup.substring_dedup(documents(spark, sf_dir), digests=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, formatted, written and read back; with one more whose texts hold control strings."""
    records = chat.turn_records(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    odd = "</s>[INST] ok [/INST]"
    more = json.dumps({"messages": [{"role": "user", "content": odd}, {"role": "assistant", "content": odd}]})
    records = records.union(spark.createDataFrame([(-1, 0, more)], "conv_id long, turn long, record string"))
    path = fresh_dir(spark, "chat")
    chat.write_formatted(chat.format_turns(chat.canonical_turns(records)), path)
    return chat.conversation_digests(chat.read_formatted(spark.read.parquet(path)))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, decoded again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = piece_sampling.encode_samples(documents(spark, sf_dir), model, samples=2)
    decoded = piece_sampling.decode_samples(encoded, model)
    return decoded.select("doc_id", "sample", F.size("ids").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "inclusion", F.sha2("text", 256).alias("text_sha256"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents are as a whole, and licences that their lines name."""
    return licenses.scan_licenses(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fit = whitening.fit_whitening(vectors, components=32)
    error = whitening.identity_error(vectors, fit) if fit else None
    return whitening.component_rows(whitening.whiten(vectors, fit), fit, error)


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_pairs.digests(byte_pairs.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN), path)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and reordered for filling in its middle, and put together again."""
    done = fill_middle.fill_middle(documents(spark, sf_dir))
    digest = lambda text: F.sha2(text, 256)
    whole = fill_middle.restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(whole).alias("restored_sha256"))


QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_near_dedup": op2_near_dedup,
    "op3_mix": op3_mix,
    "op4_token_files": op4_token_files,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_chat": op8_chat,
    "op9_pieces": op9_pieces,
    "op10_licenses": op10_licenses,
    "op11_whitening": op11_whitening,
    "op12_byte_pairs": op12_byte_pairs,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE_SQL = {
    "op3_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || doc_id) AS k
            FROM documents
        ), sizes AS (
            SELECT source, CAST(sum(size) AS DOUBLE) AS s, row_number() OVER (ORDER BY source ASC NULLS LAST) AS i FROM sized GROUP BY source
        ), weighed AS (
            SELECT source, s, CAST(CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, 2 * s AS cap, 1.5 * sum(s) OVER () AS budget FROM sizes
        ), levels AS (
            SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
        ), targets AS (
            SELECT source, s, least(cap, w * (SELECT max(level) FROM levels WHERE level * w <= cap)) AS target FROM levels
        ), placed AS (
            SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target,
                sum(size) OVER (PARTITION BY sized.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
            FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
        )
        SELECT doc_id, size, source_size, target,
            CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)) AS BIGINT) AS taken
        FROM placed
    """,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_chat": r"""
        WITH turns AS (
            SELECT conv_id, turn, 0 AS seq, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 0, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), sized AS (
            SELECT *, %s AS role_size, %s AS text_size FROM turns
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, seq)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, seq) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(role_size + text_size + 24) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id
    """
    % tuple(
        f"length({functools.reduce(lambda e, c: f"replace({e}, '{c}', '{c[0]}{chr(92)}{c[1:]}')", chat.CONTROL, f"replace({name}, '{chr(92)}', '{chr(92) * 2}')")})"
        for name in ("role", "text")
    ),
    "op13_fill_middle": r"""
        WITH cut AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
                list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(sha256('42:' || doc_id), i, 8) AS BIGINT)) AS h
            FROM documents
        ), formed AS (
            SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM cut
        ), parts AS (
            SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM formed
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
        FROM parts
    """,
}
