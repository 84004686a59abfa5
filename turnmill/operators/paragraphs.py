"""Documents to lines, lines to paragraphs, paragraphs stitched over dangling ends: window operations by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import text as T
from turnmill.functions.lexicon import ARABIC, Lexicon


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line), numbered from 1."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def joined(parts: str, order: str, value: str, sep: str) -> Column:
    """Strings put together in order, whatever order the rows came in."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), sep)


def islands(rows: DataFrame, key: str, order: str, starts: Column, name: str = "island") -> DataFrame:
    """Numbers each row by how many ``starts`` rows there have been up to it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(starts.cast("int")).over(w))


def paragraphs(all_lines: DataFrame, key: str = "doc_id", sep: str = "\n", strip: str = "right") -> DataFrame:
    """(key, par, start_line, end_line, text): runs of lines that aren't blank, joined by ``sep``, numbered from 1.

    Lines are stripped on the right, or with ``strip="both"`` at both ends, as a translation wants them in one line.
    """
    if strip not in ("right", "both"):
        raise ValueError(f"strip is right or both, not {strip}")
    blank = F.trim(F.regexp_replace("line", r"(?U)\s+", " ")) == ""
    runs = islands(all_lines.withColumn("blank", blank), key, "line_no", F.col("blank")).where(~F.col("blank"))
    runs = runs.withColumn("line", T.stripped(F.col("line")) if strip == "both" else F.regexp_replace("line", r"(?U)\s+$", ""))
    grouped = runs.groupBy(key, "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), joined(key, "line_no", "line", sep).alias("text"))
    return grouped.withColumn("par", F.row_number().over(Window.partitionBy(key).orderBy("island"))).select(key, "par", "start_line", "end_line", "text")


def stitched(pars: DataFrame, key: str = "doc_id", lex: Lexicon = ARABIC) -> DataFrame:
    """Noise dropped; a paragraph that ends in a connector takes in the next one, and so on.

    The end of a merged text is the end of its last member, so a paragraph starts a new one unless the one
    before it dangles.
    """
    w = Window.partitionBy(key).orderBy("par")
    clean = pars.where(~T.is_noise(F.col("text"), lex)).withColumn("dangles", T.matches(F.col("text"), lex.dangling, lex))
    marked = islands(clean.withColumn("starts", ~F.coalesce(F.lag("dangles").over(w), F.lit(False))), key, "par", F.col("starts"))
    merged = marked.groupBy(key, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), joined(key, "par", "text", " ").alias("text"))
    return merged.select(key, F.col("island").alias("par"), "start_line", "end_line", "text")
