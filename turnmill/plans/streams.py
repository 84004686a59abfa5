"""Queries that run a stream to its end."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.registry import query, table
from turnmill.storage import fresh_path
from turnmill.streaming import fill, turns


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def settings(spark: SparkSession, some: dict[str, str]) -> Iterator[None]:
    """The session's settings, changed for as long as the block lasts."""
    before = {k: spark.conf.get(k, None) for k in some}
    for k, v in some.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives for what is there now, through Parquet in the shared folder."""
    spark = stream.sparkSession
    path = fresh_path(spark, "stream")
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("""WITH o AS (SELECT *, sum(CASE WHEN event_type IN ('signup', 'error') THEN 1 ELSE 0 END) OVER w AS seg, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT user_id, seg FROM o WHERE event_type = 'signup') SELECT o.user_id, CAST(o.turn AS BIGINT) AS turn, o.event_id FROM o JOIN s ON o.user_id = s.user_id AND o.seg = s.seg WHERE event_type NOT IN ('signup', 'error')""")
def stream_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users' events, kept as state while a stream is read."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return drained(turns.open_turns(source), "append")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour and type under a watermark: the hours that are over when the stream ends."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return drained(turns.hourly_counts(source), "append").select(F.col("hour"), "event_type", "n")


#: Milliseconds by which a row may come after later ones, the number of batches that the shuffled rows come in, rows of one
#: of a batch's files, and users of one bucket of the state.
LATE_MS, BATCHES, FILE_ROWS, BUCKET_USERS = 6 * 3_600_000, 4, 250_000, 64


def shuffled_arrivals(spark: SparkSession, events: DataFrame, batches: int = BATCHES, late_ms: int = LATE_MS) -> tuple[str, int]:
    """A folder with the events in ``batches`` folders, in order of an arrival that is up to ``late_ms`` after their time, and the number of files of each folder."""
    arrival = F.unix_millis(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(late_ms))
    rows = events.withColumn("arrival", arrival)
    cuts, n = rows.agg(F.percentile_approx("arrival", [k / batches for k in range(1, batches)]), F.count("*")).first()
    cuts = cuts or []
    files = max(1, round(n / batches / FILE_ROWS))
    path = fresh_path(spark, "arrivals")
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = rows.where((F.lit(True) if low is None else F.col("arrival") > low) & (F.lit(True) if high is None else F.col("arrival") <= high))
        part.drop("arrival").repartition(files).write.mode("append").parquet(f"{path}/{k}")
    return path, files


@query(f"""WITH o AS (SELECT *, sum(CASE WHEN event_type IN ('signup', 'error') THEN 1 ELSE 0 END) OVER w AS seg, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT user_id, seg, event_id AS cue_id FROM o WHERE event_type = 'signup') SELECT o.user_id, CAST(o.turn AS BIGINT) AS turn, s.cue_id, o.event_id FROM o JOIN s ON o.user_id = s.user_id AND o.seg = s.seg
WHERE event_type NOT IN ('signup', 'error') AND epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) FROM events) - {LATE_MS}""")
def stream_turns_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by the time of events that arrive out of order, file by file: those that the watermark has passed at the end."""
    events = table(spark, sf_dir, "events")
    path, files = shuffled_arrivals(spark, events)
    buckets = -(-(events.agg(F.approx_count_distinct("user_id")).first()[0] or 1) // BUCKET_USERS)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")
    # each partition of the state is a Python process in each batch: one for each core is enough
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, spark.sparkContext.defaultParallelism))
    with settings(spark, ROCKSDB | {"spark.sql.shuffle.partitions": str(parts)}):
        return drained(turns.ordered_turns(source, f"{LATE_MS} milliseconds", buckets=max(parts, buckets)), "append")


def in_english(rows: list[tuple[int, str]]) -> dict[int, str]:
    """Stands for a translation service: marks each text, and leaves out those without letters."""
    return {line: f"[en] {text}" for line, text in rows if any(c.isalpha() for c in text)}


@query("""SELECT CAST(conv_id AS VARCHAR) AS source_file, CAST(turn * 3 + 1 AS INTEGER) AS line, '[en] ' || text AS text FROM conversations WHERE regexp_matches(text, '\\p{L}')
UNION ALL SELECT CAST(conv_id AS VARCHAR), CAST(turn * 3 + 2 AS INTEGER), '' FROM conversations WHERE regexp_matches(text, '\\p{L}')""")
def cache_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as paragraphs that come in three files, some of them in two; the stream is started, stopped after a file and started again."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    line = (F.col("turn") * 3 + 1).cast("int")
    pars = rows.select(F.col("conv_id").cast("string").alias("source_file"), line.alias("start_line"), (line + 1).alias("end_line"), "text")
    path = fresh_path(spark, "fill")
    part = F.pmod(F.xxhash64("source_file", "start_line"), F.lit(3))
    for k in range(3):
        pars.where((part == k) | ((part == 0) & F.lit(k == 2))).coalesce(1).write.parquet(f"{path}/in/{k}")
        if k != 1:  # the second run finds two new files
            source = spark.readStream.schema(pars.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
            fill.fill(source, f"{path}/cache", f"{path}/state", in_english).awaitTermination()
    return fill.entries(spark, f"{path}/cache")
