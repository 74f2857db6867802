"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontamination, divergence, language_id, line_dedup, media, packing, prefix_trie, simhash, substrings, token_files, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    # a response is measured by what was read; a revisit has no payload but what its header says
    size, digest = (F.coalesce(x, F.col(c)) for x, c in ((F.octet_length("payload").cast("long"), "payload_bytes"), (F.sha1("payload"), "payload_digest")))
    return records.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs, vocabulary("piece_bpe_32k.model")))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary())
    read = token_files.read_token_files(manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judged(pages, spark.createDataFrame(URL_RULES, "host string, path string, action string"), urls.stand_in_list(pages))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = common.written(media.stored(table(spark, sf_dir, "documents")), "media", "zstd")
    ranges = F.array_join(F.transform("clips", lambda c: F.format_string("%.2f-%.2f", c["start_s"], c["end_s"])), ",")
    return media.decoded(kept).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.format_string("frames=%d shots=%s", "frames", ranges).alias("feature"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.judged(decontamination.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.substring_deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), vocabulary()), vocabulary())
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = prefix_trie.trie(table(spark, sf_dir, "conversations"))
    none = F.sha2(F.lit(b""), 256)
    return nodes.join(prefix_trie.ends_digests(ends), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


WARC_ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT *, octet_length(b) AS n, max(page_id) OVER (PARTITION BY digest) AS kept FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM m
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_token_files": op5_token_files,
    "op6_urls": op6_urls,
    "op7_simhash": op7_simhash,
    "op8_media": op8_media,
    "op9_decontamination": op9_decontamination,
    "op10_substrings": op10_substrings,
    "op11_bpe": op11_bpe,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_divergence": op13_divergence,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op3_warc": WARC_ORACLE,
    "op6_urls": urls.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
    "op10_substrings": substrings.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
