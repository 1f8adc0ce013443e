"""Queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import canonical, chunking, credentials, generated_files, mixing, packing, pair_defects

#: Probability from which the forest's word is taken.
FOREST_THRESHOLD = 0.5


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "function_metadata")


def _limits(spark: SparkSession, sf: str, unit: str, prefix: str) -> list[tuple[str, str, int, int]]:
    """Rows of size_limit, a fixed table of four rows."""
    rows = table(spark, sf, "size_limit").where((F.col("unit") == unit) & F.col("limit_name").startswith(prefix)).orderBy("limit_name").collect()
    return [(r["limit_name"], r["unit"], r["max_size"], r["overlap_size"]) for r in rows]


def p1_files(spark: SparkSession, sf: str) -> DataFrame:
    return generated_files.not_handwritten(_files(spark, sf), "file_path", "file_content", threshold=FOREST_THRESHOLD)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_files(spark, sf).select("file_path").distinct()


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.text_pieces(_files(spark, sf), "file_path", "file_content", _limits(spark, sf, "characters", "chunk"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    limits = [x for x in _limits(spark, sf, "characters", "chunk") if x[0] == "chunk_chars"]
    return chunking.text_pieces(_files(spark, sf), "file_path", "file_content", limits, with_text=False).select("file_path").distinct()


def p4_defects(spark: SparkSession, sf: str) -> DataFrame:
    return pair_defects.pair_defects(table(spark, sf, "generation_result"), "response_id", "prompt", "response", "language", "model")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_defects(spark, sf).select("response_id", "defect")


def p5_credentials(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.credentials(_files(spark, sf), "file_path", "file_content")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_credentials(spark, sf).select("file_path", "line_no").distinct()


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.credentials(_files(spark, sf), "file_path", "file_content", redacted=True)


def p5_focal_credentials(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.credentials(_files(spark, sf), "record_id", "focal_code")


def p5_focal_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.credentials(_files(spark, sf), "record_id", "focal_code", redacted=True)


def _containers(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, int]]:
    limits = {name: most for name, _, most, _ in _limits(spark, sf, "tokens", "container")}
    return packing.containers(table(spark, sf, "documents"), "doc_id", "text", limits), limits


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _containers(spark, sf)[0]


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(*_containers(spark, sf))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_target"), "doc_id", "text", "source")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(p7_mixture(spark, sf), table(spark, sf, "mix_target"))


def p8_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.canonical_text(table(spark, sf, "documents"), "text", "canonical", keep=["doc_id"])


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.lookalike_pairs(table(spark, sf, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.lookalike_classes(table(spark, sf, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_files, p3_found, p3_pieces, p4_found, p4_defects, p5_found, p5_credentials, p5_redacted, p5_focal_credentials, p5_focal_redacted, p6_containers, p6_fill, p7_mixture, p7_shares, p8_found, p8_canonical, p8_classes)
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": "SELECT DISTINCT file_path FROM function_metadata WHERE length(file_content) > (SELECT max_size FROM size_limit WHERE limit_name = 'chunk_chars')",
    }
