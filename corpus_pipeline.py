"""Corpus preparation in five stages; each works on all that its predecessor kept.

Toxic documents go; lines that frame a source's pages go; of near-duplicate documents one stays; personal data and what
discloses it is replaced; what is left is packed into sequences. All stages but the last return the columns of
``documents``; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import common, lines, packing, pii, simhash, toxicity
from parcelwise.llm.queries import held_out, table, vocab_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; labels are learnt from as in op1."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return toxicity.score(docs, net, out="_toxicity").where("_toxicity < 0.5").drop("_toxicity")


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that frame their source's pages, as op5; null texts stay, all rows are kept."""
    return lines.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: SimHash over shingles of five words, similarity 0.8 or more. Texts without words, null ones too, are one group."""
    return simhash.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, terms that disclose it generalised or removed; null texts stay, all rows are kept."""
    return pii.sanitised(pii.detect(docs)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids, as op4; a null text is the closing id alone."""
    pieces = packing.pack(docs, vocab_path(), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate_lines), ("simhash_dedup", drop_near_duplicates), ("pii", sanitise), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # what a stage kept on its way goes once its rows are written
        with common.released(spark) as kept:
            docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(common.last_written())
    return STAGES[-1][1](spark, docs, sf_dir)
