"""Hand-off cues and the turns that they open."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from turnmill.functions import dates as D
from turnmill.functions import text as T
from turnmill.functions.lexicon import ARABIC, Lexicon
from turnmill.operators.paragraphs import joined
from turnmill.operators.review import speech_containing
from turnmill.storage import saved

CUE = "struct<raw:string,clean:string,start:int,end:int,method:string>"
_SPACES = re.compile(r"\s+")


class CueFinder:
    """Finds the last usable cue of a text. Offsets of all matches of all patterns are needed, so this is Python."""

    def __init__(self, lex: Lexicon) -> None:
        self.lex, self.cues = lex, lex.compiled()
        self.stop, self.filler = re.compile(lex.stop_after), re.compile(lex.filler)
        self.fold, self.spell = str.maketrans(lex.fold_from, lex.fold_to), str.maketrans(lex.spell_from, lex.spell_to)
        self.marks, self.foreign = (re.compile(p) if p else None for p in (lex.diacritics, lex.foreign))
        self.honorifics = re.compile(rf"^(?:(?:{lex.folded_honorifics()}) +)+", 0 if lex is ARABIC else re.IGNORECASE)

    def clean(self, name: str) -> str:
        strip = lambda s: _SPACES.sub(" ", s).strip(self.lex.strip)
        name = strip(name.replace("#", " "))
        end = self.stop.search(name.translate(self.spell))  # a letter for a letter: places are the same
        return strip(self.filler.sub(" ", name[: end.start()] if end else name))

    def bare(self, name: str) -> str:
        s = (self.marks.sub("", name) if self.marks else name).translate(self.fold)
        s = _SPACES.sub(" ", self.foreign.sub(" ", s) if self.foreign else s).strip()
        return self.honorifics.sub("", s).strip()

    def named(self, raw: str) -> tuple[str, bool]:
        """The clean name, and whether it can be one."""
        clean = self.clean(raw)
        bare = self.bare(clean)
        return clean, bool(clean) and bare not in self.lex.no_names and not bare.startswith(self.lex.no_name_starts) and 2 <= len(bare) and len(bare.split()) <= 7

    def every(self, text: str) -> Iterator[tuple]:
        """(pattern, start, end, name, clean, usable) of all matches, pattern by pattern."""
        folded = text.translate(self.spell)
        for i, p in enumerate(self.cues):
            for m in p.finditer(folded):
                raw = text[slice(*m.span("name"))]
                yield i, m.start(), m.end(), raw.strip(), *self.named(raw)

    def last(self, text: str) -> tuple | None:
        """Of the usable matches the one that starts last; of those that start together the lowest pattern."""
        folded = text.translate(self.spell) if self.spell else text
        found = [(m.start(), -i, m) for i, p in enumerate(self.cues) for m in p.finditer(folded)]
        for _, i, m in sorted(found, key=lambda x: x[:2], reverse=True):
            raw = text[slice(*m.span("name"))]
            clean, usable = self.named(raw)
            if usable:
                return raw.strip(), clean, m.start(), m.end(), f"handoff_window:p{-i}"
        return None


@lru_cache(maxsize=8)
def finder(lex: Lexicon) -> CueFinder:
    return CueFinder(lex)


def with_cues(rows: DataFrame, text: str = "text", lex: Lexicon = ARABIC) -> DataFrame:
    """Adds ``cue`` (of the text), ``cue_inside`` (of the text with blanks squeezed) and ``tail``: one pass in Arrow batches."""
    @F.pandas_udf("cue struct<raw:string,clean:string,start:int,end:int,method:string>, inside boolean, tail_inside boolean, tail string")
    def cues(texts: pd.Series) -> pd.DataFrame:
        f = finder(lex)
        out = []
        for t in texts.fillna(""):
            c = f.last(t)
            tail = t[c[3]:].strip(lex.strip + "\n") if c else None
            even = " ".join(t.split())
            out.append((dict(zip(("raw", "clean", "start", "end", "method"), c, strict=True)) if c else None, (c if even == t else f.last(even)) is not None,
                        f.last(" ".join(tail.split())) is not None if tail else False, tail))
        return pd.DataFrame(out, columns=["cue", "inside", "tail_inside", "tail"])

    found = rows.withColumn("found", cues(text))
    return found.select("*", "found.cue", F.col("found.inside").alias("cue_inside"), "found.tail", "found.tail_inside").drop("found")


def starts_speech(text: Column, boundary: Column, lex: Lexicon = ARABIC) -> Column:
    c = T.compact(text)
    return (c != "") & (T.matches(c, lex.openers, lex) | T.matches(c, lex.titled_start, lex) | ((T.word_count(c) >= 10) & ~boundary))


def turn_members(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The rows that belong to turns, with ``turn`` (1, 2, ... by key), ``cue_at`` and ``from_tail``.

    ``rows`` has boolean cue, tail (the cue's row itself goes on as speech), tadj (that tail ends the sitting), sub
    (substantive), bnd (boundary) and adj (ends the sitting); every cue must be a boundary. A cue opens a turn
    unless it was passed over: rows that aren't substantive between a cue without tail and its first
    substantive row are consumed. The turn runs over substantive rows up to the next boundary or through the
    row that ends the sitting. All of it is window functions by key; what is to come is looked up in falling order,
    in which frames grow instead of being computed anew for each row.
    """
    w, falling = Window.partitionBy(key).orderBy(order), Window.partitionBy(key).orderBy(F.desc(order))
    after, onward = falling.rowsBetween(Window.unboundedPreceding, -1), falling.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("grp", F.sum(F.col("sub").cast("int")).over(before))
    in_group = Window.partitionBy(key, "grp").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("passed", F.coalesce(F.max(F.col("cue") & ~F.col("tail")).over(in_group), F.lit(False)))
    rows = rows.withColumn("opens", F.col("cue") & (F.col("sub") | ~F.col("passed")))
    rows = rows.withColumn("stop", F.min(F.when(F.col("bnd"), F.col(order))).over(after)).withColumn("end", F.min(F.when(F.col("sub") & F.col("adj"), F.col(order))).over(onward))
    nxt = F.struct(F.col(order).alias("at"), "bnd", "stop", "end")
    rows = rows.withColumn("nxt", F.min(F.when(F.col("sub"), nxt)).over(after))
    own = F.struct(F.col(order).alias("cue_at"), F.col(order).alias("start"), F.col("stop").alias("stop"), F.when(F.col("tadj"), F.col(order)).otherwise(F.col("nxt.end")).alias("end"), F.lit(True).alias("from_tail"))
    other = F.struct(F.col(order).alias("cue_at"), F.col("nxt.at").alias("start"), F.col("nxt.stop").alias("stop"), F.col("nxt.end").alias("end"), F.lit(False).alias("from_tail"))
    rows = rows.withColumn("opened", F.when(F.col("opens") & F.col("tail"), own).when(F.col("opens") & F.col("nxt").isNotNull() & ~F.col("nxt.bnd"), other))
    rows = rows.withColumn("turn", F.count("opened").over(before)).withColumn("o", F.last("opened", ignorenulls=True).over(before))
    at = F.col(order)
    member = ((at == F.col("o.start")) | (F.col("sub") & (at > F.col("o.start")))) & (at < F.coalesce(F.when(F.col("o.from_tail") | (at > F.col("o.start")), F.col("o.stop")), at + 1)) & (at <= F.coalesce("o.end", at))
    return rows.where(member).withColumn("cue_at", F.col("o.cue_at")).withColumn("from_tail", F.col("o.from_tail") & (at == F.col("o.start"))).drop("grp", "passed", "opens", "stop", "end", "nxt", "opened", "o")


def fold_members(flags: list[dict]) -> list[tuple[int, int, int, bool]]:
    """(position, turn, position of the cue, from tail) for one key, row by row: for keys where a cue isn't a boundary."""
    out, used, turn, i, n = [], set(), 0, 0, len(flags)
    for i in range(n):
        f = flags[i]
        if i in used or not f["cue"]:
            continue
        parts, done, j = [], False, i + 1
        if f["tail"]:
            parts, done = [(i, True)], f["tadj"]
            used.add(i)
        else:
            while j < n and not flags[j]["sub"]:
                used.add(j)
                j += 1
            if j < n and not flags[j]["bnd"]:
                parts, done = [(j, False)], flags[j]["adj"]
                used.add(j)
                j += 1
        while parts and not done and j < n and not flags[j]["bnd"]:
            if flags[j]["sub"]:
                parts.append((j, False))
                used.add(j)
                done = flags[j]["adj"]
            j += 1
        if parts:
            turn += 1
            out += [(at, turn, i, tail) for at, tail in parts]
    return out


FLAGS = ["cue", "tail", "tadj", "sub", "bnd", "adj"]


def members(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, turn, cue_at, from_tail): windows for keys whose cues are all boundaries, the fold for the rest."""
    odd = rows.groupBy(key).agg(F.max(F.col("cue") & ~F.col("bnd")).alias("odd"))
    slim = rows.select(key, order, *FLAGS).join(odd, key)
    cols = [key, order, "turn", "cue_at", "from_tail"]
    plain = turn_members(slim.where(~F.col("odd")), key, order).select(cols)
    kind, num = rows.schema[key].dataType.simpleString(), rows.schema[order].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        at = pdf[order].tolist()
        found = [(pdf[key].iloc[0], at[p], t, at[c], tail) for p, t, c, tail in fold_members(pdf[FLAGS].to_dict("records"))]
        return pd.DataFrame(found, columns=cols)

    folded = slim.where("odd").groupBy(key).applyInPandas(fold, f"{key} {kind}, {order} {num}, turn long, cue_at {num}, from_tail boolean")
    return plain.unionByName(folded)


def extract_turns(pars: DataFrame, files: DataFrame, lex: Lexicon = ARABIC) -> DataFrame:
    """The turns of paragraphs (source_file, par, start_line, end_line, text) without linking.

    speech_id, source_file, speech_index, start_line, end_line, the raw and the clean name, method, evidence,
    window_strategy, block_type, char_count, word_count, text and the file's own columns.
    """
    found = with_cues(pars, lex=lex)
    tail_bnd = T.is_plain_boundary(F.col("tail"), lex) | F.col("tail_inside")
    adj = F.lit(T.java(lex.adjourn.removeprefix(r"\(?\s*")))  # found in the same texts with or without what may come before it, and faster without
    flagged = found.select(
        "source_file", "par", "start_line", "end_line", "text", "tail", F.col("cue").alias("c"), F.col("cue").isNotNull().alias("cue"),
        F.coalesce(F.col("cue").isNotNull() & starts_speech(F.col("tail"), tail_bnd, lex), F.lit(False)).alias("starts"),
        F.coalesce(F.regexp_like(T.folded(F.col("tail"), lex), adj), F.lit(False)).alias("tadj"), T.is_substantive(F.col("text"), lex).alias("sub"),
        (T.is_plain_boundary(F.col("text"), lex) | F.col("cue_inside")).alias("bnd"), F.regexp_like(T.folded(F.col("text"), lex), adj).alias("adj"),
    )
    flagged = saved(flagged, "cues")  # used four times below; the patterns run once
    rows = members(flagged.withColumn("body_tail", F.col("tail")).withColumn("tail", F.col("starts")), "source_file", "par")
    body = flagged.select("source_file", "par", "start_line", "end_line", "text", F.col("tail").alias("tail_text"), "adj", "tadj")
    whole, ends = (F.when(F.col("from_tail"), F.col(a)).otherwise(F.col(b)) for a, b in (("tail_text", "text"), ("tadj", "adj")))
    parts = rows.join(body, ["source_file", "par"]).withColumn("part", F.when(ends, T.truncate_at(whole, T.java(lex.adjourn), lex)).otherwise(whole))
    turns = parts.groupBy("source_file", "turn", "cue_at").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("from_tail").alias("from_tail"), joined("source_file", "par", "part", "\n\n").alias("text")
    )
    cues = flagged.where("cue").select("source_file", F.col("par").alias("cue_at"), F.col("start_line").alias("evidence_line"), F.col("text").alias("evidence_text"), "c")
    meta = files.select("source_file", *[v.alias(k) for k, v in D.file_meta(F.col("source_file")).items()])
    out = turns.join(cues.join(meta, "source_file"), ["source_file", "cue_at"])  # the long texts move once
    return out.select(
        F.format_string("%s__win_%04d", "document_id", "turn").alias("speech_id"), "source_file", "document_id", F.col("turn").alias("speech_index"), "year_start", "year_end", "inferred_date",
        D.legislature(F.col("inferred_date"), F.col("year_start")).alias("legislature_period"), "start_line", "end_line", F.col("c.raw").alias("speaker_target_raw"), F.col("c.clean").alias("speaker_target_clean"),
        F.col("c.method").alias("assignment_method"), "evidence_line", "evidence_text", F.when(F.col("from_tail"), "same_paragraph_tail").otherwise("next_substantive_paragraph").alias("window_strategy"),
        T.block_type(F.col("text"), lex).alias("block_type"), F.length("text").alias("char_count"), T.word_count(F.col("text")).alias("word_count"), "text",
    )


def coverage(pars: DataFrame, turns: DataFrame, lex: Lexicon = ARABIC, width: int = 200) -> DataFrame:
    """(source_file, substantive, covered, openers, openers_covered) of paragraphs (source_file, start_line, end_line, text).

    A paragraph is covered if a turn's lines hold its first line. The shares of covered substantive paragraphs and
    of covered openers (those that start as speeches do) are what an audit reads.
    """
    text = F.col("text")
    marked = pars.select("source_file", "start_line", T.is_substantive(text, lex).alias("sub"), T.matches(T.stripped(text), lex.openers, lex).alias("opener"))
    held = speech_containing(turns, marked.select("source_file", F.col("start_line").alias("line")), width)
    seen = marked.join(held.select("source_file", F.col("line").alias("start_line"), F.lit(True).alias("held")), ["source_file", "start_line"], "left")
    inside = F.col("held").isNotNull()
    return seen.groupBy("source_file").agg(
        F.count_if(F.col("sub")).alias("substantive"), F.count_if(F.col("sub") & inside).alias("covered"), F.count_if(F.col("opener")).alias("openers"), F.count_if(F.col("opener") & inside).alias("openers_covered")
    )


def longest_run(rows: DataFrame, keys: list[str], order: list[str], value: str, least: int = 1) -> DataFrame:
    """``rows`` with ``on``: whether a row lies on the longest run of values that never fall, in order.

    Of equally long runs the one that ends first, and in it the earliest predecessor of each row. Null where the value is
    null, and in a group of fewer than ``least`` values. No window function keeps such a state, so a task folds the
    sorted groups of its partition one after another and holds the batches of one group; rows without a value
    belong to none and are spread over all tasks.
    """
    spread = F.when(F.col(value).isNull(), F.xxhash64(*order)).otherwise(F.lit(0).cast("long"))
    names, apart = list(rows.columns), "spread_"
    while apart in names:
        apart += "_"
    sorted_rows = rows.withColumn(apart, spread).repartition(*keys, apart).sortWithinPartitions(*keys, apart, *order)
    by, at = [names.index(k) for k in keys] + [len(names)], names.index(value)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, list]] = []
        group, values, places = None, [], []

        def close() -> None:
            if len(values) >= least:
                for (marks, i), on in zip(places, backbone(values), strict=True):
                    marks[i] = on
            values.clear()
            places.clear()

        def done() -> Iterator[pa.RecordBatch]:
            while held and not (places and held[0][1] is places[0][0]):
                batch, marks = held.pop(0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks, pa.bool_())], [*names, "on"])

        for batch in batches:
            marks: list[bool | None] = [None] * batch.num_rows
            groups = zip(*[batch.column(k).to_pylist() for k in by], strict=True)
            for i, (k, v) in enumerate(zip(groups, batch.column(at).to_pylist(), strict=True)):
                if k != group:
                    close()
                    group = k
                if v is not None:
                    values.append(v)
                    places.append((marks, i))
            held.append((batch, marks))
            yield from done()
        close()
        yield from done()

    return sorted_rows.mapInArrow(fold, StructType([*rows.schema.fields, StructField("on", BooleanType())]))


def backbone(values: list) -> list[bool]:
    """Which values lie on the run, in n log n steps.

    Rows whose best runs are equally long have falling values, so the earliest possible predecessor is found by
    bisection among the rows of the length before.
    """
    of_length: list[tuple[list, list[int]]] = []  # for each length its values and rows
    prev = [-1] * len(values)
    for i, v in enumerate(values):
        low, high = 0, len(of_length)
        while low < high:  # lengths whose last value, their least, isn't above v
            mid = (low + high) // 2
            low, high = (mid + 1, high) if of_length[mid][0][-1] <= v else (low, mid)
        if low:
            seen, rows = of_length[low - 1]
            first, last = 0, len(seen) - 1
            while first < last:
                mid = (first + last) // 2
                first, last = (first, mid) if seen[mid] <= v else (mid + 1, last)
            prev[i] = rows[first]
        if low == len(of_length):
            of_length.append(([], []))
        of_length[low][0].append(v)
        of_length[low][1].append(i)
    on = [False] * len(values)
    k = of_length[-1][1][0] if of_length else -1
    while k != -1:
        on[k] = True
        k = prev[k]
    return on


def greedy_chunks(rows: DataFrame, key: str, order: str, size: Column, most: int) -> DataFrame:
    """Adds ``chunk`` (from 0): rows in order fill a chunk until the next would not fit; one that is too large stands alone."""
    kind, num = rows.schema[key].dataType.simpleString(), rows.schema[order].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, used = object(), 0, 0
        for batch in batches:
            out = []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != now:
                    now, chunk, used = k, 0, 0
                elif used and used + n > most:
                    chunk, used = chunk + 1, 0
                used += n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.int32())], [key, order, "size", "chunk"])

    slim = rows.select(key, order, size.cast("long").alias("size")).repartition(key).sortWithinPartitions(key, order)
    return slim.mapInArrow(fold, f"{key} {kind}, {order} {num}, size long, chunk int")
