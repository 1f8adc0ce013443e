"""JSON-lines sources and sinks, and scans of source files.

A schema is always given: inference reads the data twice and widens ids that are numbers in one line and text in another.
Blank lines are no records in any mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import is_source_path


def read_strict(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Fails on a broken line (SRC-01, SRC-03)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Leaves out broken lines (SRC-02)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_tolerant(df: DataFrame, line: str, schema: str) -> DataFrame:
    """Records of a text column with column ``record``; blank, broken and null lines, and lines that are no object, are left out (SRC-02)."""
    parsed = df.where(F.trim(F.regexp_replace(line, r"\s", " ")) != "").withColumn("record", F.from_json(line, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    return parsed.where(F.col("record").isNotNull() & F.col("record._broken").isNull() & F.startswith(F.ltrim(line), F.lit("{")))


def path_part(from_right: int, path: Column | None = None) -> Column:
    """A folder of the file that a row was read from, counted from the right: 0 is the file's name (SRC-07, SRC-10, SRC-11)."""
    parts = F.split(F.regexp_replace(F.input_file_name() if path is None else path, "^[a-z]+:/*", "/"), "/", -1)
    return F.get(parts, F.size(parts) - 1 - from_right)


def read_results(spark: SparkSession, root: str, schema: StructType | str, file_name: str = "detailed_results.jsonl") -> DataFrame:
    """Result files at ``root/language/mode/model/`` with these three as columns (SRC-10); broken lines are left out."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{root.rstrip('/')}/*/*/*/{file_name}")
    return df.select("*", path_part(3).alias("language"), path_part(2).alias("mode"), path_part(1).alias("model"))


def discover(df: DataFrame, modes: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    """Distinct ``mode, model`` under optional filters (SRC-12); the caller decides what an empty result means."""
    out = df.select("mode", "model").distinct()
    out = out.where(F.col("mode").isin(modes)) if modes else out
    return out.where(F.col("model").isin(models)) if models else out


def read_code(spark: SparkSession, path: str, recursive: bool = True, undecodable: str = "latin-1") -> DataFrame:
    """Source files as ``path, content`` (SRC-04, SRC-06): UTF-8, else Latin-1, or (``undecodable="drop"``) without the bytes
    that are no UTF-8 (SRC-05); pruned folders and other endings are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    relative = F.regexp_replace("path", "^[a-z]+:/*", "/")
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    if undecodable == "drop":  # the mark for a bad byte must not be in the text already
        text = F.when(F.is_valid_utf8("content"), text).otherwise(F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")))
    return files.where(is_source_path(relative)).select(relative.alias("path"), text.alias("content"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None, keep_nulls: bool = True) -> None:
    """JSON lines, UTF-8 as it is (SNK-01, SNK-03), optionally in a folder for each value (SNK-02, SNK-07)."""
    writer = df.write.mode(mode).option("ignoreNullFields", str(not keep_nulls).lower())
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_csv(df: DataFrame, path: str, decimals: int = 3) -> None:
    """CSV with doubles rounded to ``decimals`` (SNK-06)."""
    columns = [F.format_number(c, decimals).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*[F.regexp_replace(c, ",", "") if t in ("double", "float") else c for c, (_, t) in zip(columns, df.dtypes, strict=True)]).toDF(*df.columns).write.mode("overwrite").option("header", "true").csv(path)


def replace_path(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write beside the target and rename (SNK-04), so that a reader finds the old or the new table; also where ``df`` reads the old one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    fs = target.getFileSystem(conf)
    df.write.mode("overwrite").json(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)
