"""Review decisions, translation caches and the views that a review service reads, as data frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import LINE_BREAK, first_filled, stripped
from turnmill.operators import joins
from turnmill.sources.tables import strings_of

REVIEW = "struct<sourceFile:string,decisions:map<string,string>,additionalHandoffs:array<struct<line:int,note:string,text:string,createdAt:string>>>"
DECISIONS = ("accepted", "rejected")


def reviews(files: DataFrame) -> DataFrame:
    """(source_file, decisions, additional): the fenced JSON of each review text; empty where it is missing or broken."""
    fenced = F.regexp_extract("body", r"(?s)```json\s*\n(.*?)\n?```", 1)
    r = F.from_json(fenced, REVIEW, {"mode": "PERMISSIVE"})
    known = F.map_filter(F.coalesce(r["decisions"], F.create_map().cast("map<string,string>")), lambda k, v: v.isin(*DECISIONS))
    return files.select("source_file", known.alias("decisions"), F.coalesce(r["additionalHandoffs"], F.array().cast("array<struct<line:int,note:string,text:string,createdAt:string>>")).alias("additional"))


def review_text(rows: DataFrame) -> DataFrame:
    """(source_file, body): counts and the fenced JSON, as ``reviews`` reads them."""
    n = lambda v: F.size(F.map_filter("decisions", lambda k, x: x == v))
    body = F.to_json(F.struct(F.col("source_file").alias("sourceFile"), "decisions", F.col("additional").alias("additionalHandoffs")), {"pretty": "true"})
    head = F.format_string("# Review: %s\n\naccepted: %d\nrejected: %d\nadditional: %d\n\n", "source_file", n("accepted"), n("rejected"), F.size("additional"))
    return rows.select("source_file", F.concat(head, F.lit("```json\n"), body, F.lit("\n```\n")).alias("body"))


def decided(events: DataFrame, found: DataFrame) -> DataFrame:
    """``events`` (source_file, line, ...) with the decision on their line, if there is one."""
    each = found.select("source_file", F.explode("decisions").alias("at", "decision")).select("source_file", F.col("at").cast("int").alias("line"), "decision")
    return events.join(each, ["source_file", "line"], "left")


def quality(events: DataFrame, found: DataFrame) -> DataFrame:
    """(source_file, accepted, rejected, missed, precision, recall) from decisions and lines added by hand."""
    marks = decided(events, found).groupBy("source_file").agg(F.count_if(F.col("decision") == "accepted").alias("accepted"), F.count_if(F.col("decision") == "rejected").alias("rejected"))
    missed = found.select("source_file", F.size("additional").cast("long").alias("missed"))
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b))
    out = marks.join(missed, "source_file", "left").withColumn("missed", F.coalesce("missed", F.lit(0).cast("long")))
    return out.withColumn("precision", ratio(F.col("accepted"), F.col("rejected"))).withColumn("recall", ratio(F.col("accepted"), F.col("missed")))


def with_decision(decisions: Column, line: Column, value: Column) -> Column:
    """The map with the decision set, or taken away if it was the same."""
    rest = F.map_filter(decisions, lambda k, v: k != line)
    return F.when(F.try_element_at(decisions, line) == value, rest).otherwise(F.map_concat(rest, F.create_map(line, value)))


def with_addition(additional: Column, entry: Column) -> Column:
    """The list with ``entry`` appended unless its line has one."""
    return F.when(F.exists(additional, lambda x: x["line"] == entry["line"]), additional).otherwise(F.concat(additional, F.array(entry)))


def without_addition(additional: Column, line: Column) -> Column:
    """The list without the entry of that line."""
    return F.filter(additional, lambda x: x["line"] != line)


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys aren't among ``done``."""
    return rows.join(done.select(*keys), keys, "left_anti")


def translated_counts(pars: DataFrame, cached: DataFrame) -> DataFrame:
    """(source_file, paragraphs, translated): how many paragraphs (source_file, start_line) have a cached text that isn't blank."""
    have = cached.where(F.trim("text") != "").select("source_file", F.col("line").alias("start_line"), F.lit(1).alias("done")).distinct()
    return pars.join(have, ["source_file", "start_line"], "left").groupBy("source_file").agg(F.count("*").alias("paragraphs"), F.count("done").alias("translated"))


def sample_rows(turns: DataFrame, n: int = 50, seed: str = "20260704", least_words: int = 20) -> DataFrame:
    """``n`` turns of at least ``least_words`` words and with text, drawn by a hash of seed and id, in order of date and id."""
    fit = turns.where((F.coalesce(F.col("word_count").try_cast("int"), F.lit(0)) >= least_words) & (F.trim("text") != ""))
    drawn = fit.orderBy(F.md5(F.concat(F.col("speech_id"), F.lit(f"-{seed}")).cast("binary")), "speech_id").limit(n)
    return drawn.orderBy("inferred_date", "speech_id")


#: Lines that one asked range covers at most.
RANGE_MAX_LINES = 300
#: Digits of other scripts that number lines, as ASCII ones.
_DIGITS, _PLAIN = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"


def translation_ranges(pars: DataFrame, wanted: DataFrame, cached: DataFrame, most_lines: int = RANGE_MAX_LINES, width: int = 200) -> DataFrame:
    """Paragraphs (source_file, start_line, end_line, text) that touch ``wanted`` (source_file, lo, hi) and aren't in ``cached`` (source_file, line).

    A range begins at line 1 at least and is cut after ``most_lines`` lines. Both sides meet in cells of ``width`` lines;
    a paragraph of several ranges comes once.
    """
    ranges = wanted.select("source_file", F.greatest("lo", F.lit(1)).alias("lo"), "hi").select("source_file", "lo", F.least("hi", F.col("lo") + (most_lines - 1)).alias("hi")).where("lo <= hi")
    spans = pars.select("source_file", "start_line", "end_line", F.col("start_line").alias("r_lo"), F.col("end_line").alias("r_hi"))
    near = joins.overlapping(ranges, spans, ["source_file"], width).select("source_file", "start_line").distinct()
    return pending(pars.join(near, ["source_file", "start_line"]), cached.withColumnRenamed("line", "start_line"), ["source_file", "start_line"])


def reply_lines(reply: DataFrame, expected: DataFrame) -> DataFrame:
    """(source_file, line, text): numbered lines of a reply, put to the expected lines; missing ones are empty.

    A number is followed by a tab, bar, colon, full stop or hyphen. Of several lines of one number the last counts. Of several
    replies of a file the greatest text does, as rows have no order.
    """
    numbered = r"(?U)^[\s\x1c-\x1f]*(\d+)[\s\x1c-\x1f]*[\t|:.\-][\s\x1c-\x1f]*(.*)$"
    rows = reply.select("source_file", F.posexplode(F.split("reply", LINE_BREAK)).alias("pos", "row"))
    got = rows.select("source_file", "pos", F.translate(F.regexp_extract("row", numbered, 1), _DIGITS, _PLAIN).try_cast("int").alias("line"), stripped(F.regexp_extract("row", numbered, 2)).alias("text"))
    last = got.where("line IS NOT NULL").groupBy("source_file", "line").agg(F.max_by("text", F.struct("pos", "text")).alias("text"))
    return expected.join(last, ["source_file", "line"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def reply_object(payload: Column, keys: list[str]) -> Column:
    """The stripped string values of the asked keys in a JSON reply, code fences removed; other keys and kinds are dropped."""
    bare = F.regexp_replace(stripped(payload), r"(?s)^```(?:json)?\s*|\s*```$", "")
    return F.transform_values(F.map_filter(strings_of(bare), lambda k, v: k.isin(*keys)), lambda k, v: stripped(v))


def response_text(payload: Column) -> Column:
    """The direct text of a model's response, else the text parts of its outputs joined by line breaks."""
    kind = "struct<output_text:string,output:array<struct<content:array<struct<type:string,text:string>>>>>"
    r = F.from_json(payload, kind)
    parts = F.filter(F.flatten(F.transform(r["output"], lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>")))), lambda c: c["type"].isin("output_text", "text"))
    return F.coalesce(F.nullif(r["output_text"], F.lit("")), F.array_join(F.transform(parts, lambda c: c["text"]), "\n"), F.lit(""))


def translated(chunks: DataFrame, translate, columns: str) -> DataFrame:
    """``chunks`` through ``translate``, a function from and to an iterator of pandas frames that the caller supplies."""
    return chunks.mapInPandas(translate, columns)


def events_view(turns: DataFrame) -> DataFrame:
    """What a reviewer sees of each hand-off."""
    return turns.select("source_file", F.coalesce(F.col("evidence_line").try_cast("int"), F.lit(0)).alias("line"), "speech_id", "speaker_target_raw", "speaker_target_clean", "speaker_type", "mp_name_ar", "assignment_method", "assignment_confidence", "evidence_text")


def speeches_view(turns: DataFrame) -> DataFrame:
    """What a reader sees of each speech, with a speaker's label."""
    label = first_filled(F.col("mp_name_transliterated"), F.col("mp_name_ar"), F.col("speaker_target_clean"), F.lit("(unknown)"))
    return turns.select("source_file", "speech_id", "start_line", "end_line", label.alias("speaker"), "block_type", "word_count", "text")


def either(primary: DataFrame, legacy: DataFrame) -> DataFrame:
    """``primary``, or ``legacy`` with its missing columns empty if that has no rows."""
    return primary if not primary.isEmpty() else primary.unionByName(legacy, allowMissingColumns=True)


def manifest(files: DataFrame, events: DataFrame, translations: DataFrame) -> DataFrame:
    """(source_file, events, has_translation) of every file, 0 and false where there is none."""
    n = events.groupBy("source_file").agg(F.count("*").alias("events"))
    rows = files.select("source_file").join(n, "source_file", "left").join(translations.select("source_file", F.lit(True).alias("t")).distinct(), "source_file", "left")
    return rows.select("source_file", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("t", F.lit(False)).alias("has_translation"))


def speech_containing(speeches: DataFrame, points: DataFrame, width: int = 200) -> DataFrame:
    """``points`` (source_file, line) with the first speech whose lines hold the point; of those that start together the least id.

    Both sides meet in cells of ``width`` lines, so a long file isn't held against all its speeches.
    """
    at = points.select("source_file", "line", F.col("line").alias("lo"), F.col("line").alias("hi")).distinct()
    spans = speeches.select("source_file", "speech_id", F.col("start_line").alias("r_lo"), F.col("end_line").alias("r_hi"))
    inside = joins.overlapping(at, spans, ["source_file"], width)
    return inside.groupBy("source_file", "line").agg(F.min(F.struct("r_lo", "speech_id")).alias("first")).select("source_file", "line", F.col("first.speech_id").alias("speech_id"))


def first_with_events(rows: DataFrame) -> DataFrame:
    """The first file with events, else the first file."""
    return rows.orderBy(F.when(F.col("events") > 0, 0).otherwise(1), "source_file").limit(1)
