"""The corpus pipeline: five stages over documents, each a function (spark, docs, sf_dir) -> DataFrame.

All stages but the last return the columns of documents, which may have any further columns. Their decisions take effect:
rejected documents and further copies go, secrets are masked in the text, and the mix orders the rows and repeats sources
that fall short of their weight. The table written from the mix holds its order by file and row, and the last stage gives
both with each row, so epochs of a document are told apart and the order of the mix is that of its result's
(mix_part, mix_row). Each stage works on every row it is given.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import bpe, mixing, quality, secrets, simhash
from wayfare.llm.common import materialize, quoted, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table."""
    return quality.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest id, and of rows with this id the one of the least text hash."""
    names, inner = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[quoted(c).alias(i) for c, i in zip(names, inner)], quoted("doc_id").alias("id"), F.xxhash64(quoted("text")).alias("h"), quoted("text").alias("t"))
    g = simhash.groups(rows.select(F.struct("id", "h").alias("key"), "t"), "key", "t")
    keep = g.where("id = component").select(F.col("id.id").alias("id2"), F.col("id.h").alias("h2")).distinct()
    kept = rows.join(keep, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left_semi").dropDuplicates(["id", "h"])
    return kept.select(*[F.col(i).alias(c) for c, i in zip(names, inner)])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, sources that fall short of their weight repeated."""
    mixed = mixing.mix(docs)
    return mixed.orderBy(quoted(mixed.columns[-1])["position"]).select(*map(quoted, docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, and its place in the mix: file and row of the table, null where docs are no files."""
    import public_tokenizers

    place = [F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("int"), F.col("_metadata.row_index")]
    try:
        docs.select(*place)
    except AnalysisException:  # rows that come from no file
        place = [F.lit(None).cast("int"), F.lit(None).cast("long")]
    rows = docs.select(F.struct(quoted("doc_id").alias("doc_id"), place[0].alias("mix_part"), place[1].alias("mix_row")).alias("key"), quoted("text").alias("t"))
    got = bpe.encode_decode(rows, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "key", "t")
    return got.select("id.*", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("secret scans", secret_scan), ("mixing sources to target weights", mix_sources), ("byte-level BPE encoding and decoding", encode)]

#: Fingerprints, the field and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
