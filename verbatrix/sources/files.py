"""Trees of text files, catalogs and case files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatrix.errors import EngineError
from verbatrix.operators import codeintel

CATALOG = "name string, selector string, source_type string, ecosystem string, canonical_url string, description string, versions array<string>, trust_score double, benchmark_score double, confidence double"
CASES = "id string, profile string, corpus string, question string, required_points array<string>, acceptable_citations array<string>, forbidden_claims array<string>, max_context_tokens int"
SOURCE_MANIFEST = (
    "schema_version string, library string, source_type string, provider string, selector string, canonical_url string, requested_ref string, resolved_ref string, integrity string, fetched_at string, snapshot_dir string, "
    "docs_dir string, files_copied int, total_bytes bigint, trust_signals struct<suspicious_count: int, suspicious_files: array<struct<path: string, patterns: array<string>>>>"
)


def tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(rel_path, content) of the files under ``root`` whose name matches ``glob``."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return read.select(F.substring(path, len(base) + 1, 1 << 30).alias("rel_path"), F.decode("content", "UTF-8").alias("content"))


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files under ``root``; raises if there is none."""
    found = tree(spark, root, "*.[mM][dD]")
    if found.select("rel_path").isEmpty():
        raise EngineError("INVALID_ARGS", f"no markdown files under {root}", "point at a folder with .md files, or derive docs from code")
    return found


def code_tree(spark: SparkSession, root: str) -> DataFrame:
    """Source files and build files under ``root``: source_path, extension, content."""
    return codeintel.code_files(tree(spark, root))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of discovery candidates."""
    return spark.read.schema(CATALOG).option("multiLine", True).json(path)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases, one JSON object on a line."""
    return spark.read.schema(CASES).json(path)


def source_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SOURCE_MANIFEST).option("multiLine", True).json(path)


def write_text(df: DataFrame, path: str) -> None:
    """The column ``content`` as text files, one for each task."""
    df.select("content").write.mode("overwrite").option("lineSep", "\n").text(path)
