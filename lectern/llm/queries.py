"""The ``opN_*`` queries: each operator over the whole documents table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, exact_dedup, language_id, licenses, line_dedup, mixing, near_dedup, packing, pii, quality, runs, secrets
from .common import small_batches
from .oracle import ORACLES


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer file used by the queries; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def training_fold(id_col: str = "doc_id"):
    """Rows that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string")) % 3 != 1


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs, training_fold())
    found = language_id.identify(docs, model)
    return found.select("doc_id", (~F.coalesce(training_fold(), F.lit(True))).alias("held_out"), "lang_pred", "score", "rejected")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), tokenizer_path(), texts=False)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The history is what came from the first half of the ids' hash range, the rest arrives later.
    history = F.xxhash64("doc_id") < 0
    return exact_dedup.mark(documents(spark, sf_dir), history)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Half of the documents come first; a 64th of these come again with the second half and replace themselves.
    hashed = F.xxhash64("doc_id")
    return line_dedup.dedup_lines(documents(spark, sf_dir), later=F.pmod(hashed, F.lit(2)) == 1, again=F.pmod(hashed, F.lit(64)) == 0, texts=False)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), groups=False)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(documents(spark, sf_dir), loop=F.crc32(F.col("doc_id").cast("string")), texts=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_language_id, op2_bpe, op3_licenses, op4_exact_dedup, op5_mixing, op6_pii, op7_line_dedup, op8_secrets, op9_quality, op10_near_dedup, op11_alignment, op12_packing, op13_runs)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
