"""File corpora and JSON datasets as DataFrames, and JSON results as files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.sources import schemas
from quarry.sources.work import delete, filesystem

# Directories that are passed over and extensions that are read.
IGNORED = (".git", "__pycache__", ".mypy_cache", ".pytest_cache", "venv", ".venv", "build", "dist", "egg-info")
EXTENSIONS = (".py", ".md", ".markdown", ".txt", ".rst", ".json", ".yaml", ".yml", ".toml", ".c", ".cpp", ".h", ".hpp", ".cu")


def supported(path: Column) -> Column:
    """Is no part of the path ignored, and its last suffix (of a name that has more than it) supported?"""
    parts = F.split(path, "/")
    suffix = F.lower(F.regexp_extract(F.element_at(parts, -1), r"(?s).(\.[^.]+)$", 1))
    return ~F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED))) & suffix.isin(*EXTENSIONS)


def relative(path: Column, root: str | None) -> Column:
    """A path without scheme, and without the root it lies under."""
    bare = F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?(?=/)", "")
    if not root:
        return bare
    lead = root.rstrip("/") + "/"
    return F.when(F.startswith(bare, F.lit(lead)), F.substring(bare, F.lit(len(lead) + 1), F.length(bare))).otherwise(bare)


def scan_files(spark: SparkSession, raw_dir: str, root: str | None = None) -> DataFrame:
    """file_path, raw: supported files below raw_dir. Paths are tested before bytes are read. A missing directory raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(raw_dir)
    return files.filter(supported(F.col("path"))).select(relative(F.col("path"), root).alias("file_path"), F.col("content").alias("raw"))


def text_of(raw: Column) -> Column:
    """UTF-8 with U+FFFD for what is malformed; CRLF and CR become LF before any offset is taken."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\r\n?", "\n")


def read_documents(spark: SparkSession, raw_dir: str, root: str | None = None) -> DataFrame:
    """file_path, content."""
    return scan_files(spark, raw_dir, root).select("file_path", text_of(F.col("raw")).alias("content"))


def manifest_of(files: DataFrame) -> DataFrame:
    """file_path, sha256 of the bytes, from file_path, raw."""
    return files.select("file_path", F.sha2("raw", 256).alias("sha256"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, sources, answer, pos of a dataset: an object with rag_questions, or a list. Malformed files have no rows; missing ids are drawn."""
    either = StructType([*schemas.DATASET, *schemas.ANSWERED_QUESTION])
    both = spark.read.schema(either).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    one = F.struct("question_id", "question", "sources", "answer")
    rows = both.withColumn("at", F.monotonically_increasing_id()).select("at", F.posexplode(F.coalesce("rag_questions", F.when(F.col("question").isNotNull(), F.array(one)), F.array().cast(schemas.DATASET["rag_questions"].dataType))))
    return rows.select(F.coalesce("col.question_id", F.uuid()).alias("question_id"), "col.question", "col.sources", "col.answer", F.struct("at", "pos").alias("pos"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, retrieved_sources, k, pos of a results file; a malformed one raises."""
    rows = spark.read.schema(schemas.RESULTS).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return rows.select("k", F.posexplode("search_results").alias("pos", "r")).select("r.question_id", "r.question", "r.retrieved_sources", "k", "pos")


def write_results(results: DataFrame, path: str, k: int, order: str = "pos") -> str:
    """One JSON document {search_results, k} in the file `path`; results are one row a question.

    The format asks for one file in one order, so one task writes it, row by row from
    a sort that can spill; its part file is then given the name.
    """
    spark = results.sparkSession
    own = [c for c in ("question_id", "question", "retrieved_sources", "answer") if c in results.columns]
    first = F.row_number().over(Window.orderBy(order)) == 1
    one = F.to_json(F.struct(*[F.coalesce(F.col(c), F.array().cast(results.schema[c].dataType)).alias(c) if c == "retrieved_sources" else F.col(c) for c in own]), {"ignoreNullFields": "false"})
    rows = results.select(F.lit(1).alias("at"), F.col(order).alias("by"), F.concat(F.when(first, "").otherwise(","), one).alias("value"))
    ends = spark.createDataFrame([(0, '{"search_results": ['), (2, f'], "k": {int(k)}}}')], "at int, value string").withColumn("by", F.lit(None).cast(results.schema[order].dataType))
    rows.unionByName(ends).coalesce(1).sortWithinPartitions("at", "by").select("value").write.mode("overwrite").text(f"{path}.parts")
    fs, target = filesystem(spark, path)
    fs.delete(target, True)
    (part,) = [f.getPath() for f in fs.listStatus(filesystem(spark, f"{path}.parts")[1]) if f.getPath().getName().startswith("part-")]
    fs.rename(part, target)
    delete(spark, f"{path}.parts")
    # A checksum written beside an earlier file of this name would no longer fit.
    delete(spark, f"{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}.crc" if "/" in path else f".{path}.crc")
    return path


def output_name(save_directory: str, dataset_path: str) -> str:
    return f"{save_directory.rstrip('/')}/{dataset_path.rstrip('/').rsplit('/', 1)[-1]}"


def dump(results: DataFrame, k: int) -> str:
    """The same document as text, for a caller that prints it; one row a question."""
    return json.dumps({"search_results": [r.asDict(recursive=True) for r in results.toLocalIterator()], "k": k}, indent=2)
