"""Reading and writing corpora of Markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import dates as D
from turnmill.functions.lexicon import YEARS
from turnmill.functions.text import stripped


def markdown(spark: SparkSession, path: str, years: tuple[int, int] | None = YEARS, pattern: str = "*.md") -> DataFrame:
    """(source_file, path, body) of all files under ``path``; names out of scope are dropped before any body is read.

    Bytes that aren't UTF-8 become replacement characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    files = files.withColumn("source_file", F.substring_index("path", "/", -1))
    if years:
        files = files.where(D.file_meta(F.col("source_file"), years)["include"])
    return files.select("source_file", "path", F.regexp_replace(F.decode("content", "UTF-8"), "\r\n", "\n").alias("body"))


def by_name(files: DataFrame, name: str = "source_file", path: str = "path") -> DataFrame:
    """One path for each name: of several the greatest."""
    return files.groupBy(name).agg(F.max(path).alias(path))


def paths_of(manifest: DataFrame, files: DataFrame, folders: list[str]) -> DataFrame:
    """The manifest (doc_id, source_file, ...) with the path of each file, of the first folder that has it; null if none has."""
    place = F.coalesce(*[F.when(F.col("path").startswith(f), i) for i, f in enumerate(folders)], F.lit(len(folders)))
    found = files.select("source_file", F.struct(place.alias("place"), "path").alias("at")).groupBy("source_file").agg(F.min("at").alias("at"))
    return manifest.join(found.where(F.col("at.place") < len(folders)).select("source_file", F.col("at.path").alias("path")), "source_file", "left")


def content_hashes(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, md5) of binary files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.md5("content").alias("md5"))


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """(day): the ISO dates of a text file, other lines dropped; empty where there is no file."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "day date")
    return lines.select(D.parse_iso(F.trim("value")).alias("day")).where("day IS NOT NULL").distinct()


def with_header(docs: DataFrame) -> DataFrame:
    """(name, value): each document as Markdown with its origin in four comment lines."""
    line = lambda k: F.concat(F.lit(f"<!-- {k}: "), F.coalesce(F.col(k).cast("string"), F.lit("")), F.lit(" -->"))
    return docs.select(F.concat("doc_id", F.lit(".md")).alias("name"), F.concat_ws("\n", line("doc_id"), line("source_pdf"), line("engine"), line("sitting_date"), F.lit(""), "body").alias("value"))


def queued_stems(lines: DataFrame, value: str = "value") -> DataFrame:
    """(stem): the files that a queue names, one a line, without folder and last suffix; blank lines and comments are none."""
    line = stripped(F.col(value))
    named = lines.select(line.alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    base = F.substring_index("line", "/", -1)
    return named.select(F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "").alias("stem")).distinct()


def write_named_markdown(docs: DataFrame, path: str) -> None:
    """Each document of ``with_header`` as a file of its name under the URI ``path``, all at once or none."""
    from turnmill.sources.named_files import write_named

    write_named(with_header(docs), path)


def write_markdown(docs: DataFrame, path: str) -> None:
    """Each document of ``with_header`` as a file of its own, in a folder of its name under ``path``."""
    with_header(docs).withColumn("name", F.regexp_replace("name", r"\.md$", "")).write.partitionBy("name").option("lineSep", "\n").text(path)
