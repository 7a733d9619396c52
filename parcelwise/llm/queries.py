"""The queries of this subpackage, each with production parameters over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import AUDIT_SQL
from .lines import DROP_BOILERPLATE_SQL
from .topk import EXACT_TOP_K_SQL

VOCAB = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def vocab_path(name: str = VOCAB) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key):
    """Every fifth key by its checksum: rows whose labels are never learnt from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(documents, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    scored = toxicity.score(documents, net)
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocab_path())
    return bpe.digest(encoded, vocab_path())


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    return topk.exact_top_k(rows, F.col("vec_id") % 50 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    pieces = packing.pack(table(spark, sf_dir, "documents"), vocab_path(), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lines

    cleaned = lines.cleaned(table(spark, sf_dir, "documents"))
    return cleaned.select("row.doc_id", "n_lines", "n_dropped", "row.text")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    cleaned = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.summary(pii.detect(table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html

    return html.main_text(table(spark, sf_dir, "pages"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pqdedup

    return pqdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import audit

    return audit.audit(audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import transducer

    return transducer.round_trip(table(spark, sf_dir, "documents"), vocab_path(RANKS))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_pii": op7_pii,
    "op8_simhash": op8_simhash,
    "op9_html_main_text": op9_html_main_text,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_transducer_bpe": op12_transducer_bpe,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {"op3_exact_top_k": EXACT_TOP_K_SQL, "op5_line_dedup": DROP_BOILERPLATE_SQL, "op11_filter_audit": AUDIT_SQL}
