"""Building a corpus: copies collapsed, ids made unique, streams split, broken blocks healed."""

from __future__ import annotations

import random
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.storage import saved


def best_of_copies(rows: DataFrame, content: Column, best: list[Column], keep: list[str]) -> DataFrame:
    """One row for each content, the least by ``best``, with the number of copies dropped.

    The digest is grouped with a partial aggregation, so many copies of one text meet as one row a task.
    """
    picked = rows.select(F.md5(content.cast("binary")).alias("md5"), F.struct(*[b.alias(f"k{i}") for i, b in enumerate(best)]).alias("rank"), F.struct(*keep).alias("row"))
    return picked.groupBy("md5").agg(F.min_by("row", "rank").alias("row"), (F.count("*") - 1).alias("n_dropped")).select("md5", "row.*", "n_dropped")


def unique_ids(rows: DataFrame, name: str, order: list[str], suffix: str = "_b") -> DataFrame:
    """``name`` with the suffix once for each earlier row of the same name."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return rows.withColumn("n", n).withColumn("unique_id", F.concat(F.col(name), F.repeat(F.lit(suffix), F.col("n") - 1))).drop("n")


def carried_forward(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null, of this row or of those before it."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def _heals(before: str, after: str, heading, shortest: int, single: int) -> bool:
    last = before.rsplit("\n", 1)[-1].rstrip()
    first = after.lstrip()
    lone = "\n" not in after and len(after.strip()) < single
    return len(last) >= shortest and last[-1:].isalpha() and first[:1].isalpha() and not heading(first) and not lone


def healed(docs: DataFrame, key: str = "doc_id", text: str = "text", heading: str = r"^(?:#|\d+[.)])", scan: int = 60, gap: int = 2, least: int = 2, imprint: str | None = None, furniture: str | None = None, shortest: int = 60, single: int = 30) -> DataFrame:
    """(key, text, n_blocks): blocks (between blank lines) that break off in mid-sentence are joined with the next.

    Blocks that ``furniture`` matches go first. ``imprint`` then cuts a tail of printer's lines: found backwards over
    ``scan`` blocks at most, ``gap`` others apart, ``least`` of them, blocks of under 4 characters counting too. A
    block goes on if its last line has ``shortest`` characters, ends in a letter without a stop, and the next begins
    with a letter and is neither heading nor one line of under ``single`` characters. A fold by document, in Arrow
    batches.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        is_heading, is_imprint, is_furniture = (re.compile(p).search if p else None for p in (heading, imprint, furniture))
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(1):
                out: list[str] = []
                blocks = [b for b in re.split(r"\n\s*\n", t.as_py() or "") if b.strip() and not (is_furniture and is_furniture(b))]
                if is_imprint:
                    blocks = without_imprint(blocks, lambda b: len(b.strip()) < 4 or is_imprint(b), scan, gap, least)
                for block in blocks:
                    if out and _heals(out[-1], block, is_heading, shortest, single):
                        out[-1] += " " + block.lstrip()
                    else:
                        out.append(block)
                texts.append("\n\n".join(out))
                counts.append(len(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], [key, text, "n_blocks"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {text} string, n_blocks long")


def without_imprint(blocks: list[str], matches, scan: int = 60, gap: int = 2, least: int = 2) -> list[str]:
    cut, hits, misses = len(blocks), 0, 0
    for i in range(len(blocks) - 1, max(-1, len(blocks) - 1 - scan), -1):
        if matches(blocks[i]):
            cut, hits, misses = i, hits + 1, 0
        else:
            misses += 1
            if misses > gap:
                break
    return blocks[:cut] if hits >= least else blocks


def running_totals(rows: DataFrame, key: str, value: str, ranges: int = 512) -> DataFrame:
    """Adds ``earlier``: the sum of ``value`` over the rows of smaller ``key`` (unique, a number).

    Keys are cut into ranges at their quantiles; each range is summed on its own, and only one sum a range, of at
    most ``ranges``, stands in global order.
    """
    cuts = sorted(set(rows.stat.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    ranged = rows.withColumn("range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key).cast("double"))) if cuts else F.lit(0))
    sums = ranged.groupBy("range").agg(F.sum(value).alias("of_range"))
    sums = sums.select("range", F.coalesce(F.sum("of_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("within", within).join(F.broadcast(sums), "range").withColumn("earlier", F.col("before") + F.col("within")).drop("range", "within", "before")


def ordinals(rows: DataFrame, order: list, name: str = "ordinal") -> DataFrame:
    """Adds the gapless place (from 0) of each row in ``order``, which should tell rows apart; equal rows are placed by chance.

    Rows are sorted by ranges over all tasks and written; a place is that within the range plus the sizes of the ranges
    before, of which there is one row each.
    """
    placed = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()), "ordinals")
    part = F.shiftright("at_", 33)
    sizes = placed.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))
    sizes = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    return placed.withColumn("part_", part).join(F.broadcast(sizes), "part_").withColumn(name, F.col("before_") + F.col("at_") - F.shiftleft(F.col("part_"), 33)).drop("part_", "at_", "before_")


def drawn(rows: DataFrame, order: list, n: int, seed: int) -> DataFrame:
    """The ``n`` rows (all, if there are fewer) that the standard library's generator of this seed draws from the rows in ``order``, with ``draw``, their place in its sample.

    The generator gives ``n`` places for the number of rows; the rows at these places are found by their ordinals.
    """
    placed = saved(ordinals(rows, order), "population")
    total = placed.count()
    places = random.Random(seed).sample(range(total), min(n, total))
    picks = rows.sparkSession.createDataFrame(list(enumerate(places)), "draw long, ordinal long")
    return placed.join(F.broadcast(picks), "ordinal").drop("ordinal")


def shuffled(rows: DataFrame, order: list, seed: int) -> DataFrame:
    """``rows`` with ``place``: where each stands after the standard library's shuffle of this seed of the rows in ``order``.

    A shuffle is one chain of swaps, so its places are made by one task that holds a number for each row; rows, whatever
    they carry, are joined to their places and never brought together.
    """
    placed = saved(ordinals(rows, order), "population")
    total = placed.count()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            at = array("q", range(total))
            random.Random(seed).shuffle(at)
            for k in range(0, total, 100_000):
                some = at[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(range(k, k + len(some)), pa.int64()), pa.array(some, pa.int64())], ["place", "ordinal"])

    picks = rows.sparkSession.range(1, numPartitions=1).mapInArrow(places, "place long, ordinal long")
    return placed.join(picks, "ordinal").drop("ordinal")


def stream_segments(docs: DataFrame, mark: str, date: Column, order: str = "file_no", text: str = "text", name: str = "stem") -> DataFrame:
    """(segment, date, parts, text, start): one continuous stream of files cut before each ``mark``.

    ``docs`` has a unique number ``order`` in which files follow each other, a ``name`` and a ``text``. What stands before a
    file's first mark goes on the segment that is open; a file without a mark goes on it as a whole; front matter before the
    very first mark is dropped, and so is a blank text before a mark. ``date`` is an expression over a piece's ``text``
    that begins with the mark; a segment without one has the last known date. ``parts`` are the names of its files in order,
    ``start`` the offset of its mark in the first of them. Segments are numbered from 0. A mark is a pattern that doesn't overlap with itself.

    Marks are found in one scan of each text. Running numbers over the whole stream are sums of ranges of files, so no task
    sees more than its range and the texts of the segments that it puts together.
    """
    cut = docs.select(F.col(order).alias("file"), F.col(name).alias("part"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), f"(?={mark})")).alias("pos", "text"))
    within = Window.partitionBy("file").orderBy("pos")
    cut = cut.withColumn("opens", F.col("text").rlike(f"^(?:{mark})")).withColumn("n_pieces", F.count("*").over(Window.partitionBy("file")))
    cut = cut.withColumn("start", F.coalesce(F.sum(F.length("text")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = saved(cut.withColumn("n_opens", F.sum(F.col("opens").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, 0))), "pieces")
    earlier = running_totals(cut.groupBy("file").agg(F.sum(F.col("opens").cast("long")).alias("opened"), F.max(F.col("opens")).alias("marked")), "file", "opened").select("file", "earlier", "marked")
    pieces = cut.join(earlier, "file").withColumn("segment", F.col("n_opens") + F.col("earlier") - 1)
    blank = F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) == ""
    pieces = pieces.where((F.col("segment") >= 0) & (F.col("opens") | ~F.col("marked") | ~blank))
    body = F.array_sort(F.collect_list(F.struct("file", "pos", "part", "text")))
    first = F.min(F.when(F.col("opens"), F.struct(date.alias("date"), F.col("start"))))
    whole = pieces.groupBy("segment").agg(first.alias("first"), body.alias("body"))
    whole = saved(whole.select("segment", "first.date", "first.start", F.array_distinct(F.transform("body", lambda x: x["part"])).alias("parts"), F.array_join(F.transform("body", lambda x: x["text"]), "").alias("text")), "segments")
    # the last known date: the k-th dated segment's, k being how many there are up to here
    dated = running_totals(whole.select("segment", F.col("date").isNotNull().cast("long").alias("one"), F.col("date").alias("own")), "segment", "one").withColumn("k", F.col("earlier") + F.col("one"))
    known = dated.where("one = 1").select("k", F.col("own").alias("date"))
    return whole.drop("date").join(dated.select("segment", "k"), "segment").join(known, "k", "left").select("segment", "date", "parts", "text", "start")
