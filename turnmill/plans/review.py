"""Queries on review decisions, intervals and JSON, over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.operators import joins, paragraphs, review
from turnmill.registry import query, table
from turnmill.sources import corpus, tables


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON column."""
    return table(spark, sf_dir, "events").select("event_id", tables.parsed(F.col("props"), "k long")["k"].alias("k"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY conv_id")
def listagg_turn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A10: a conversation's turns as one text."""
    rows = table(spark, sf_dir, "conversations").withColumn("part", F.concat_ws(": ", "role", "text"))
    return rows.groupBy("conv_id").agg(paragraphs.joined("conv_id", "turn", "part", "\n\n").alias("text"), F.count("*").alias("n"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, lo, hi): from each sign-up to the user's next event, in seconds."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("hi", F.unix_timestamp(F.lead("ts").over(w))).where("event_type = 'signup' AND hi IS NOT NULL")
    return rows.select("user_id", F.col("event_id").alias("span"), F.unix_timestamp("ts").alias("lo"), "hi")


SPANS = """WITH e AS (SELECT *, CAST(floor(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) AS hi, CAST(floor(epoch(ts)) AS BIGINT) AS lo FROM events),
s AS (SELECT user_id, event_id AS span, lo, hi FROM e WHERE event_type = 'signup' AND hi IS NOT NULL)"""


@query(SPANS + " SELECT a.span AS a, b.span AS b FROM s a JOIN s b ON a.user_id <> b.user_id AND a.user_id % 10 = b.user_id % 10 AND b.hi >= a.lo AND b.lo <= a.hi AND a.span < b.span")
def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-up spans of different users of one group that overlap."""
    rows = spans(spark, sf_dir).select((F.col("user_id") % 10).alias("g"), F.col("user_id").alias("owner"), "span", "lo", "hi")
    return joins.overlapping_pairs(rows, ["g"], 86_400)


@query(SPANS + " SELECT e.event_id, min(struct_pack(lo := s.lo, span := s.span)).span AS span FROM e JOIN s ON e.user_id = s.user_id AND e.lo BETWEEN s.lo AND s.hi WHERE e.event_type = 'click' GROUP BY 1")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first span of its user that holds a click."""
    points = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", "event_id", F.unix_timestamp("ts").alias("at"))
    speeches = spans(spark, sf_dir).select(F.col("user_id").alias("source_file"), F.col("span").alias("speech_id"), F.col("lo").alias("start_line"), F.col("hi").alias("end_line"))
    points = points.withColumnsRenamed({"user_id": "source_file", "at": "line"})
    found = review.speech_containing(speeches, points, width=86_400)
    return points.join(found, ["source_file", "line"]).select("event_id", F.col("speech_id").alias("span"))


@query("""WITH d AS (SELECT user_id, event_id AS line, CASE WHEN value > 50 THEN 'accepted' ELSE 'rejected' END AS decision FROM events WHERE event_type = 'purchase')
SELECT e.user_id AS source_file, count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision = 'rejected') AS rejected FROM events e LEFT JOIN d ON e.user_id = d.user_id AND e.event_id = d.line GROUP BY 1""")
def review_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-R, J17, A22: decisions joined to events and counted."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_file"), F.col("event_id").cast("int").alias("line"), "event_type", "value")
    bought = events.where("event_type = 'purchase'")
    entry = F.struct(F.col("line").cast("string"), F.when(F.col("value") > 50, "accepted").otherwise("rejected"))
    found = bought.groupBy("source_file").agg(F.map_from_entries(F.collect_list(entry)).alias("decisions")).withColumn("additional", F.array().cast("array<int>"))
    return review.quality(events.select("source_file", "line"), found).select("source_file", "accepted", "rejected")


@query("SELECT source AS source_file, count(*) AS events, bool_or(lang = 'fr') AS has_translation FROM documents GROUP BY 1")
def review_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the number of their events and whether they have a translation."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), "lang")
    return review.manifest(docs.select("source_file").distinct(), docs, docs.where("lang = 'fr'"))


def spoken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, word): the first run of plain letters of each turn, empty where there is none."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), F.regexp_extract("text", "[A-Za-z]+", 0).alias("word"))


@query("""SELECT conv_id AS source_file, CAST(turn AS INTEGER) AS line, CASE WHEN turn % 3 = 0 THEN 'again' WHEN (conv_id + turn) % 6 = 5 THEN '' ELSE regexp_extract(text, '[A-Za-z]+') END AS text FROM conversations
UNION ALL SELECT DISTINCT conv_id, 99, '' FROM conversations""")
def reply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """numbered lines of replies made from conversations, with five separators and one that isn't, some numbers twice, one line missing."""
    words = spoken_words(spark, sf_dir)
    marks = F.element_at(F.array(*map(F.lit, ["\t", " | ", ":", ". ", " -", ") "])), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    row = F.concat(F.lit(" "), F.col("turn").cast("string"), marks, F.col("word"), F.lit("  "), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\n"), F.col("turn").cast("string"), F.lit(": again"))).otherwise(""))
    replies = words.withColumn("row", row).groupBy(F.col("conv_id").alias("source_file")).agg(paragraphs.joined("conv_id", "turn", "row", "\r\n").alias("reply"))
    asked = words.select(F.col("conv_id").alias("source_file"), F.col("turn").alias("line"))
    return review.reply_lines(replies, asked.unionByName(asked.select("source_file", F.lit(99).alias("line")).distinct()))


@query("SELECT conv_id AS source_file, CAST(turn AS VARCHAR) AS key, regexp_extract(text, '[A-Za-z]+') AS text FROM conversations WHERE turn IN (0, 1, 3) AND (conv_id + turn) % 4 < 2")
def reply_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON replies made from conversations, some fenced; numbers, objects and keys that weren't asked for stay out."""
    words = spoken_words(spark, sf_dir)
    kind = (F.col("conv_id") + F.col("turn")) % 4
    value = F.when(kind < 2, F.concat(F.lit('" '), F.col("word"), F.lit(' "'))).when(kind == 2, F.col("turn").cast("string")).otherwise(F.concat(F.lit('{"a": "'), F.col("word"), F.lit('"}')))
    pair = words.withColumn("pair", F.concat(F.lit('"'), F.col("turn").cast("string"), F.lit('": '), value))
    replies = pair.groupBy("conv_id").agg(paragraphs.joined("conv_id", "turn", "pair", ", ").alias("body"))
    body = F.concat(F.lit("{"), F.col("body"), F.lit("}"))
    fenced = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return replies.select(F.col("conv_id").alias("source_file"), F.explode(review.reply_object(fenced, ["0", "1", "3"])).alias("key", "text"))


@query("SELECT user_id, max(ts) AS last_ts, max_by(event_id, ts) AS event_id FROM (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2) GROUP BY user_id")
def latest_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later entries of a name overwrite earlier ones, the same way each time."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"))
    last = corpus.by_name(rows.select("user_id", F.struct("ts", "event_id").alias("at")), "user_id", "at")
    return last.select("user_id", F.col("at.ts").alias("last_ts"), F.col("at.event_id").alias("event_id"))
