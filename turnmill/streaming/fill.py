"""A translation cache that a stream fills: each paragraph is translated once, a batch that runs twice writes once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnmill.operators.turns import greedy_chunks
from turnmill.storage import saved

#: Characters of one call of the translating function, and what each paragraph adds to its own.
MOST_CHARS, EACH = 9_000, 12
ENTRY = "source_file string, line int, text string, version long"
#: From the lines and texts of a chunk to the texts of those that were translated.
Translate = Callable[[list[tuple[int, str]]], dict[int, str]]


def written(spark: SparkSession, path: str) -> bool:
    """Whether a batch's folder is there as a whole: the committer leaves its mark last."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def versions(spark: SparkSession, cache: str) -> DataFrame:
    """All rows that any batch has written: (source_file, line, text, version)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("recursiveFileLookup", True).parquet(cache)


def entries(spark: SparkSession, cache: str) -> DataFrame:
    """(source_file, line, text): the cache as it stands. A text goes before the blank of a continuation line, then the latest version counts."""
    rank = F.struct(F.col("text") != "", "version", "text")
    return versions(spark, cache).groupBy("source_file", "line").agg(F.max_by("text", rank).alias("text"))


def translated_chunks(pars: DataFrame, translate: Translate, most: int = MOST_CHARS) -> DataFrame:
    """(source_file, line, text): translations of paragraphs (source_file, start_line, end_line, text) by chunks of at most ``most`` characters.

    What the function leaves out or leaves empty isn't there. The lines that a translated paragraph goes on over have empty texts,
    so that they are never asked for.
    """
    rows = pars.select("source_file", "start_line", "end_line", "text")
    packed = rows.join(greedy_chunks(rows, "source_file", "start_line", F.length("text") + EACH, most).select("source_file", "start_line", "chunk"), ["source_file", "start_line"])
    chunks = packed.groupBy("source_file", "chunk").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "text"))).alias("rows"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, some in zip(frame["source_file"], frame["rows"], strict=True):
                got = translate([(int(r["start_line"]), r["text"]) for r in some])
                for r in some:
                    text = got.get(int(r["start_line"]))
                    if text:
                        out.append((name, int(r["start_line"]), text))
                        out += [(name, line, "") for line in range(int(r["start_line"]) + 1, int(r["end_line"]) + 1)]
            yield pd.DataFrame(out, columns=["source_file", "line", "text"])

    return chunks.mapInPandas(run, "source_file string, line int, text string")


def fill_batch(pars: DataFrame, batch: int, cache: str, translate: Translate, most: int = MOST_CHARS) -> None:
    """Translates the paragraphs of a batch that the cache doesn't have, and writes them as version ``batch`` of their lines.

    A batch whose folder is whole has been written before the stream was stopped: it does nothing again. A folder
    that was left half is written anew.
    """
    spark, path = pars.sparkSession, f"{cache}/batch={batch}"
    if written(spark, path):
        return
    whole = pars.where("source_file IS NOT NULL AND start_line IS NOT NULL AND trim(text) <> ''").groupBy("source_file", "start_line").agg(F.max(F.struct("end_line", "text")).alias("p"))
    known = versions(spark, cache).where(F.col("version") != batch).select("source_file", F.col("line").alias("start_line")).distinct()
    pending = saved(whole.join(known, ["source_file", "start_line"], "left_anti").select("source_file", "start_line", "p.end_line", "p.text"), "pending")
    translated_chunks(pending, translate, most).withColumn("version", F.lit(batch).cast("long")).write.mode("overwrite").parquet(path)


def fill(stream: DataFrame, cache: str, checkpoint: str, translate: Translate, most: int = MOST_CHARS) -> StreamingQuery:
    """Starts filling ``cache`` from a stream of paragraphs (source_file, start_line, end_line, text) until what is there now is read.

    Started again with the same ``checkpoint`` and ``cache`` it goes on where it was stopped: a paragraph whose batch was
    written isn't translated again, also if it comes once more in a later batch. A batch that fails before it is written is
    translated anew, so small batches lose little.
    """
    return stream.writeStream.foreachBatch(lambda rows, batch: fill_batch(rows, batch, cache, translate, most)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(pars: DataFrame, cache: str) -> DataFrame:
    """(source_file, paragraphs, translated, done) of paragraphs (source_file, start_line)."""
    have = entries(pars.sparkSession, cache).where("text <> ''").select("source_file", F.col("line").alias("start_line"), F.lit(1).alias("there"))
    out = pars.select("source_file", "start_line").distinct().join(have, ["source_file", "start_line"], "left").groupBy("source_file").agg(F.count("*").alias("paragraphs"), F.count("there").alias("translated"))
    return out.withColumn("done", F.col("paragraphs") == F.col("translated"))
