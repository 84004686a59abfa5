"""CSV and JSON in and out, with the fixed schemas of the pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: headers of the exchanged files
#: The columns of a turn table, in order.
TURN_FIELDS = (
    "speech_id", "source_file", "document_id", "speech_index", "year_start", "year_end", "inferred_date", "legislature_period", "start_line", "end_line",
    "speaker_target_raw", "speaker_target_clean", "speaker_type", "speaker_role", "mp_id", "mp_name_ar", "mp_name_transliterated", "mp_party_ar", "mp_district_ar",
    "assignment_method", "assignment_confidence", "needs_review", "evidence_line", "evidence_text", "window_strategy", "block_type", "char_count", "word_count", "text",
)
#: Roster headers as they are spelled in the files, and the names used here.
ROSTER = {
    "M.P. ID Number": "mp_id", "Name (Arabic)": "name", "Name (transliterated)": "name_transliterated", "Gender": "gender",
    "Parliamentary Period": "period", "Politcal Party (Arabic)": "party", "Electoral District (Arabic)": "district",
}


def csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as strings; quoted fields may hold line breaks and be of any length."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(path)
    return rows.select([F.col(f"`{c}`") if c in rows.columns else F.lit("").alias(c) for c in columns]) if columns else rows


def roster(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path).select([F.trim(F.coalesce(F.col(f"`{k}`"), F.lit(""))).alias(v) for k, v in ROSTER.items()])


def write_csv(rows: DataFrame, path: str, columns: list[str], gzip: bool = False) -> None:
    """The given columns in order, missing ones empty, nulls as empty strings."""
    out = rows.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns])
    out.write.option("header", True).option("escape", '"').option("emptyValue", "").option("compression", "gzip" if gzip else "none").csv(path)


def strings_of(body: Column) -> Column:
    """The entries of a JSON object whose values are strings, as a map; what isn't an object has none."""
    whole = F.from_json(body, "map<string,variant>", {"mode": "PERMISSIVE"})
    texts = F.transform_values(F.map_filter(whole, lambda k, v: F.schema_of_variant(v) == "STRING"), lambda k, v: F.try_variant_get(v, "$", "string"))
    return F.coalesce(texts, F.create_map().cast("map<string,string>"))


def line_cache(files: DataFrame) -> DataFrame:
    """(source_file, line, text) of JSON caches (source_file, body); a broken one has no lines, and what isn't a string isn't a text."""
    return files.select("source_file", F.explode(strings_of(F.col("body"))).alias("k", "text")).select("source_file", F.col("k").try_cast("int").alias("line"), "text")


def cache_text(lines: DataFrame) -> DataFrame:
    """(source_file, body): the lines (source_file, line, text) as JSON caches, as ``line_cache`` reads them; of several texts of a line the greatest."""
    one = lines.groupBy("source_file", F.col("line").cast("string").alias("line")).agg(F.max("text").alias("text"))
    return one.groupBy("source_file").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("line", "text"))))).alias("body"))


def parsed(column: Column, schema: str) -> Column:
    """JSON text by a schema; what is broken is null."""
    return F.from_json(column, schema, {"mode": "PERMISSIVE"})


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
