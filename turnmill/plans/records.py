"""Queries on files, names, labels and replies, over texts made from the tables so that SQL knows what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import dates as D
from turnmill.functions import lexicon as L
from turnmill.functions import text as T
from turnmill.functions.lexicon import ENGLISH
from turnmill.operators import review, turns
from turnmill.registry import query, table
from turnmill.sources import corpus, tables
from turnmill.storage import fresh_path, spread


@query("SELECT conv_id || '-' || turn AS speech_id, text, role AS speaker_role, '' AS mp_id FROM conversations")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn table with all its columns as CSV and back; what isn't there is empty."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("speech_id"), "text", F.col("role").alias("speaker_role"))
    path = fresh_path(spark, "csv")
    tables.write_csv(rows, path, list(tables.TURN_FIELDS))
    back = tables.csv(spark, path, list(tables.TURN_FIELDS))
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("speech_id", "text", "speaker_role", "mp_id")])


@query("SELECT CAST(doc_id AS VARCHAR) AS speech_id, text FROM documents")
def gzip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as fields of a compressed CSV and back."""
    path = fresh_path(spark, "gzip")
    tables.write_csv(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("speech_id"), "text"), path, ["speech_id", "text"], gzip=True)
    return tables.csv(spark, path).select("speech_id", F.coalesce("text", F.lit("")).alias("text"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as lines of JSON and back."""
    rows, path = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), fresh_path(spark, "json")
    tables.write_json(rows, path)
    schema = rows.schema.simpleString()
    return spark.read.text(path).select(tables.parsed(F.col("value"), schema).alias("r")).select("r.*")


@query("""SELECT CAST(conv_id AS VARCHAR) AS source_file, conv_id || '-' || turn AS speech_id, CASE turn % 4 WHEN 0 THEN 'T' || conv_id WHEN 1 THEN 'A' || conv_id WHEN 2 THEN role ELSE '(unknown)' END AS speaker FROM conversations""")
def speaker_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees as a speech's speaker: the first of three names that isn't empty, else unknown."""
    k = F.col("turn") % 4
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("source_file"), F.concat_ws("-", "conv_id", "turn").alias("speech_id"), F.col("turn").alias("start_line"), F.col("turn").alias("end_line"), F.lit("speech").alias("block_type"), F.lit(1).alias("word_count"), "text",
        F.when(k == 0, F.concat(F.lit("T"), "conv_id")).when(k == 1, "").alias("mp_name_transliterated"), F.when(k < 2, F.concat(F.lit("A"), "conv_id")).otherwise("").alias("mp_name_ar"), F.when(k == 3, "").otherwise(F.col("role")).alias("speaker_target_clean"),
    )
    return review.speeches_view(rows).select("source_file", "speech_id", "speaker")


@query("SELECT p_partkey, p_partkey % 5 < 2 AS office, p_name AS clean, p_name AS bare FROM part")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are captured, cleaned and without honorifics, and which of them are offices, by a word or by a pattern."""
    k = F.col("p_partkey") % 5
    said = F.concat(F.lit(" ,;  #"), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit("  now please do go on,"))
    office = F.concat(F.col("p_name"), F.when(k == 0, " speaker").when(k == 1, " Committee").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", said.alias("said"), office.alias("candidate"))
    return rows.select("p_partkey", T.is_office(F.col("candidate"), ENGLISH).alias("office"), T.clean_candidate(F.col("said"), ENGLISH).alias("clean"), T.strip_honorifics(F.concat(F.lit("mr dr "), "p_name"), ENGLISH).alias("bare"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 22 YEAR AS DATE) AS d FROM orders)
SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS date, 'PV_plenary' || CASE WHEN o_orderkey % 2 = 0 THEN '_' || o_orderkey ELSE '' END AS tag, CASE WHEN day(d) < 28 THEN strftime(d, '%Y-%m-%d') END AS first_day, CASE WHEN day(d) < 28 THEN 'N' || o_orderkey END AS session FROM d""")
def dates_in_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the date of a file's name in both orders, its tag without date and copy mark, and the first of two days."""
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL '22' YEAR")).cast("date").alias("d"))
    date = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("d", "d.M.yyyy")).otherwise(F.date_format("d", "yyyy-MM-dd"))
    name = F.concat(F.lit("x/PV "), date, F.lit("-plenary"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("_N "), F.col("o_orderkey"))).otherwise(""), F.lit(".md"))
    stem = T.file_stem(name)
    days = F.concat(F.date_format("d", "yyyy-MM-"), F.lpad((F.dayofmonth("d") + 1).cast("string"), 2, "0"), F.lit("_"), F.date_format("d", "dd"), F.lit("_N_"), F.col("o_orderkey"))
    two = D.two_day_sitting(F.when(F.dayofmonth("d") < 28, days).otherwise("none"))
    return rows.select("o_orderkey", D.date_in_name(stem).alias("date"), D.source_tag(stem).alias("tag"), two["date"].alias("first_day"), two["session"].alias("session"))


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 22 YEAR, '%Y-%m-%d') AS banner FROM orders""")
def banner_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the date of an opening banner in Arabic, with Arabic digits or vowel signs, behind another date where a weekday is named."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL '22' YEAR")).alias("d"))
    month = F.element_at(F.array(*map(F.lit, L.BANNER_MONTHS)), F.month("d"))
    day = F.when(F.col("o_orderkey") % 2 == 0, F.translate(F.dayofmonth("d").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")).otherwise(F.dayofmonth("d").cast("string"))
    date = F.concat(day, F.lit(" "), F.concat(F.left(month, F.lit(1)), F.lit("\u064e"), F.substring(month, 2, F.lit(99))), F.lit(" "), F.year("d"))
    strict = F.concat(F.lit("بتاريخ 1 ماي 2001 عقدت يوم الاثنين "), date)
    return rows.select("o_orderkey", D.banner_date(F.when(F.col("o_orderkey") % 3 == 0, strict).otherwise(F.concat(F.lit("جلسة "), date))).alias("banner"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role || turn WHEN 1 THEN role || chr(10) || turn ELSE '' END AS reply, role || chr(10) || ' end' AS bare FROM conversations""")
def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the text of a model's response, direct or in parts, and a text without page marks and images."""
    rows, k = table(spark, sf_dir, "conversations"), F.col("turn") % 3
    part = lambda kind, c: F.concat(F.lit(f'{{"type": "{kind}", "text": "'), c, F.lit('"}'))
    parts = F.concat(F.lit('{"output_text": "", "output": [{"id": 1}, {"content": ['), part("output_text", F.col("role")), F.lit(", "), part("image", F.lit("no")), F.lit(']}, {"content": ['), part("output_text", F.col("turn").cast("string")), F.lit("]}]}"))
    direct = F.concat(F.lit('{"output_text": "'), "role", F.col("turn").cast("string"), F.lit('", "output": []}'))
    payload = F.when(k == 0, direct).when(k == 1, parts).otherwise('{"output": []}')
    marked = F.concat("role", F.lit("<!-- page "), F.col("turn").cast("string"), F.lit(" col R -->![a picture](x/y.png) end"))
    return rows.select("conv_id", "turn", review.response_text(payload).alias("reply"), T.without_marks(marked).alias("bare"))


@query("""WITH e AS (SELECT conv_id, turn, role FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'gone' WHEN turn % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS decision,
CASE WHEN turn % 2 = 0 THEN 1 ELSE 2 END AS n_notes, CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END AS n_left FROM e""")
def review_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision made twice is taken back, another one replaces it; a line is added once and can be taken away."""
    line, kind = F.col("turn").cast("string"), "struct<line:int,note:string,text:string,createdAt:string>"
    before = F.create_map(line, F.lit("accepted"), F.lit("x"), F.lit("rejected"))
    value = F.when((F.col("turn") % 2 == 0) | (F.col("turn") % 3 != 0), "accepted").otherwise("rejected")
    twice = review.with_decision(before, line, value)
    after = F.when(F.col("turn") % 2 == 0, twice).otherwise(F.when(value == "accepted", review.with_decision(twice, line, value)).otherwise(twice))
    entry = lambda n: F.struct(n.cast("int").alias("line"), F.col("role").alias("note"), F.lit("").alias("text"), F.lit("").alias("createdAt")).cast(kind)
    notes = review.with_addition(F.array(entry(F.lit(7))), entry(F.when(F.col("turn") % 2 == 0, 7).otherwise(8)))
    left = review.without_addition(notes, F.lit(7))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.try_element_at(after, line), F.lit("gone")).alias("decision"), F.size(notes).alias("n_notes"), F.size(left).alias("n_left"))


@query("SELECT CAST(conv_id AS VARCHAR) AS source_file, count(*) AS paragraphs, count(*) FILTER (turn % 3 = 0) AS translated FROM conversations GROUP BY 1")
def translation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paragraphs of each file have a translation that isn't blank."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source_file"), F.col("turn").cast("int").alias("start_line"))
    cached = rows.where("start_line % 3 < 2").select("source_file", F.col("start_line").alias("line"), F.when(F.col("start_line") % 3 == 0, "text").otherwise("  ").alias("text"))
    return review.translated_counts(rows, cached)


@query("SELECT source AS source_file, count(*) FILTER (lang = 'fr') AS events FROM documents GROUP BY source QUALIFY row_number() OVER (ORDER BY CASE WHEN count(*) FILTER (lang = 'fr') > 0 THEN 0 ELSE 1 END, source) = 1")
def first_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file with events, else the first."""
    return review.first_with_events(table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_file")).agg(F.count_if(F.col("lang") == "fr").alias("events")))


@query("SELECT CAST(doc_id AS VARCHAR) || '.md' AS source_file, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'one/' ELSE 'two/' END || CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id || '.md' END AS path FROM documents")
def paths_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of each file in the first folder that has it."""
    names = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"))
    at = lambda folder, some: names.where(some).select("source_file", F.concat(F.lit(folder), "source_file").alias("path"))
    files = at("two/", "doc_id % 3 <> 0").unionByName(at("one/", "doc_id % 3 <> 0 AND doc_id % 2 = 0")).unionByName(at("elsewhere/", "doc_id % 5 = 0"))
    return corpus.paths_of(names.select("source_file"), files, ["one/", "two/"])


KINDS = ("Article 5 ", "The sitting resumed ", "12 votes in favour ", "(The sitting was adjourned) ", "We now vote on ", "Mr Smith: ", "Thank you ", "## ", "", "Report of the committee ", "   ")


@query(f"""WITH l AS (SELECT conv_id, turn, CAST((conv_id + turn) % {len(KINDS)} AS INTEGER) AS k, string_split(text, chr(10))[1] AS line FROM conversations),
c AS (SELECT *, trim(regexp_replace(CASE k {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(KINDS))} END || line, '\\s+', ' ', 'g')) AS c FROM l),
b AS (SELECT *, c = '' OR k IN (0, 1, 2, 3, 4, 7, 9) AS boundary FROM c)
SELECT conv_id, turn, boundary, c <> '' AND (k IN (5, 6) OR (len(regexp_extract_all(c, '\\S+')) >= 10 AND NOT boundary)) AS starts FROM b""")
def speech_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines behind eleven beginnings: which are boundaries, and which start a speech."""
    begin = F.element_at(F.array(*map(F.lit, KINDS)), ((F.col("conv_id") + F.col("turn")) % len(KINDS) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(begin, F.split("text", "\\n")[0]).alias("line"))
    boundary = T.is_plain_boundary(F.col("line"), ENGLISH)
    return rows.select("conv_id", "turn", boundary.alias("boundary"), turns.starts_speech(F.col("line"), boundary, ENGLISH).alias("starts"))
