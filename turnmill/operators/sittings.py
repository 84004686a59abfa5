"""Dates of sittings cross-checked by sequence, calendar and text, as one chain of data frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import dates as D
from turnmill.functions import lexicon as L
from turnmill.operators.turns import longest_run

GATES = ("weekday", "hijri", "recurrence", "marsad", "sequence", "collision")
#: Gates whose failure is a conflict; the others' may be an error of reading.
HARD = ("recurrence", "sequence", "collision")
VERDICTS = ("confirmed", "single_witness", "unverifiable", "soft_flag", "conflict", "no_date")


def usable(calendar: DataFrame | None) -> bool:
    """An empty calendar is none."""
    return calendar is not None and not calendar.isEmpty()


def covered(date: Column) -> Column:
    return F.coalesce(date.between(F.lit(L.CALENDAR_FROM).cast("date"), F.lit(L.CALENDAR_TO).cast("date")), F.lit(False))


def in_order(rows: DataFrame) -> DataFrame:
    """With ``row_no``, the place of a row in its table: its own column, else the place in which it is read."""
    return rows if "row_no" in rows.columns else rows.withColumn("row_no", F.monotonically_increasing_id())


def numbered(manifest: DataFrame) -> DataFrame:
    """The manifest (doc_id, md_file, sitting_date, date_source[, row_no]) with period, seq, series and dates parsed."""
    parts = D.stem_parts(F.col("doc_id"))
    return in_order(manifest).select("row_no", "doc_id", F.substring_index("md_file", "/", -1).alias("source_file"), F.col("sitting_date").alias("date_raw"), "date_source", *[v.alias(k) for k, v in parts.items()]).withColumn("date", D.parse_iso(F.col("date_raw")))


def on_backbone(rows: DataFrame, date: str, least: int = 1) -> DataFrame:
    """Adds ``seq_ok``: on the longest run of dates of its period and series; null where there is no number or date. Each row stays one row."""
    fit = F.col("seq").isNotNull() & (F.col("period") != "")
    runs = longest_run(rows.withColumn("run_value", F.when(fit, F.unix_date(date))), ["period", "series"], ["seq", "doc_id", "row_no"], "run_value", least)
    return runs.drop("run_value").withColumnRenamed("on", "seq_ok")


def anchored(rows: DataFrame, keys: list[str], order: str, anchor: Column) -> DataFrame:
    """Adds ``window_lo`` and ``window_hi``: the greatest anchor of strictly smaller and the least of strictly greater numbers.

    The latter is taken in falling order: a frame that starts before all rows grows, one that ends after all is computed anew for each row.
    """
    before = lambda *by: Window.partitionBy(*keys).orderBy(*by).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("window_lo", F.max(anchor).over(before(order))).withColumn("window_hi", F.min(anchor).over(before(F.desc(order))))


def on_calendar(rows: DataFrame, date: str, calendar: DataFrame) -> DataFrame:
    """The rows whose date is a day of the calendar."""
    return rows.join(calendar.select(F.col("day").alias(date)).distinct(), date, "left_semi")


def crowded(rows: DataFrame, date: str, most: int = L.MOST_SITTINGS, counted: DataFrame | None = None) -> DataFrame:
    """Adds ``collision``: fail where more than ``most`` rows share the date, else pass; na without one.

    Rows are counted by date before they meet the counts, so that a crowded date is no single task's group. ``counted``
    has the dates to count where they can be read more cheaply than by computing ``rows`` twice.
    """
    days = (rows if counted is None else counted).where(F.col(date).isNotNull()).groupBy(F.col(date).alias("crowded_day")).agg(F.count("*").alias("same_day"))
    marked = rows.join(days, F.col(date) == F.col("crowded_day"), "left")
    return marked.withColumn("collision", F.when(F.col("same_day").isNull(), "na").when(F.col("same_day") > most, "fail").otherwise("pass")).drop("crowded_day", "same_day")


def gate_states(rows: DataFrame, keys: list[str], gates: list[str]) -> DataFrame:
    """(gate, pass, fail, na): how many rows each gate has in each state."""
    return rows.unpivot(keys, gates, "gate", "state").groupBy("gate").pivot("state", ["pass", "fail", "na"]).count().fillna(0)


def triangulated(manifest: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Each sitting with its backbone, the dates between which its number puts it, and a flag.

    ok, ok_unverifiable, repaired_year, soft:..., or conflict:.... A date counts as off the calendar only within the days
    that it covers. A year is repaired if the same day of one of the period's two years (the earlier first) is
    another date, on the calendar and within the window, ends included.
    """
    rows = on_backbone(numbered(manifest), "date")
    numbered_row = F.col("seq").isNotNull() & (F.col("period") != "")
    rows = anchored(rows, ["period", "series"], "seq", F.when(F.col("seq_ok"), F.col("date")))
    rows = rows.withColumns({c: F.when(numbered_row, F.col(c)) for c in ("window_lo", "window_hi")})
    low, high = D.year_bounds(F.when(F.col("period") != "", F.col("period")))
    rows = rows.withColumn("in_bounds", F.when((F.col("period") != "") & F.col("date").isNotNull(), F.col("date").between(low, high)))
    years = [F.left("period", F.lit(4)).cast("int"), F.substring("period", 6, 4).cast("int")]
    tries = [F.when(F.col("period") != "", D.safe_date(y, F.month("date"), F.day("date"))) for y in years]
    rows = rows.withColumn("try1", tries[0]).withColumn("try2", tries[1])
    if usable(calendar):
        days = calendar.select("day").distinct()
        for c in ("date", "try1", "try2"):
            rows = rows.join(days.select(F.col("day").alias(f"{c}_day")), F.col(c) == F.col(f"{c}_day"), "left").withColumn(f"{c}_in", F.col(f"{c}_day").isNotNull()).drop(f"{c}_day")
        rows = rows.withColumn("in_marsad", F.when(covered(F.col("date")), F.col("date_in")))
    else:
        rows = rows.withColumns({"try1_in": F.lit(False), "try2_in": F.lit(False), "in_marsad": F.lit(None).cast("boolean")})
    seq_break, outside = F.coalesce(~F.col("seq_ok"), F.lit(False)), F.coalesce(~F.col("in_bounds"), F.lit(False))
    problems = F.array_join(F.filter(F.array(F.when(seq_break, "seq_break"), F.when(outside, "out_of_period")), lambda x: x.isNotNull()), "+")
    rows = rows.withColumn("problems", problems)
    fits = lambda c: F.col(f"{c}_in") & (F.col(c) != F.col("date")) & (F.col("window_lo").isNull() | (F.col(c) >= F.col("window_lo"))) & (F.col("window_hi").isNull() | (F.col(c) <= F.col("window_hi")))
    repaired = F.when(fits("try1"), F.col("try1")).when(fits("try2"), F.col("try2"))
    named = F.coalesce(F.col("date") == F.col("stem_date"), F.lit(False))
    flag = (
        F.when(F.col("date").isNull(), "conflict:no_date")
        .when((F.col("problems") != "") & named, F.concat(F.lit("soft:"), "problems"))
        .when((F.col("problems") == "") & ~F.col("in_marsad"), "soft:not_marsad_plenary")
        .when((F.col("problems") != "") & repaired.isNotNull(), "repaired_year")
        .when(F.col("problems") != "", F.concat(F.lit("conflict:"), "problems"))
        .when(F.col("in_marsad").isNull() & F.col("seq_ok").isNull(), "ok_unverifiable").otherwise("ok")
    )
    out = rows.withColumn("date_flag", flag).withColumn("suggested_date", F.when(F.col("date_flag") == "repaired_year", repaired))
    final = F.when(F.col("date_flag") == "repaired_year", F.col("suggested_date")).when(~F.col("date_flag").startswith("conflict"), F.col("date"))
    return out.select("doc_id", "source_file", "date_raw", "date_source", "period", "series", "seq", "in_marsad", "seq_ok", "in_bounds", "date_flag", final.alias("final_date"), "suggested_date", "window_lo", "window_hi", "row_no")


def header_dates(bodies: DataFrame, most_lines: int = L.HEADER_LINES) -> DataFrame:
    """(doc_id, line_no, pos, date) of all dates in the first lines of each body."""
    head = bodies.select("doc_id", F.posexplode(F.slice(F.split(F.substring_index("body", "\n", most_lines), "\n"), 1, most_lines)).alias("line_no", "line"))
    return head.select("doc_id", "line_no", F.posexplode(D.dates_in_line(D.fold(F.col("line")))).alias("pos", "date"))


def most_common(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value, n), of equally frequent values the first seen."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, value, "n")


def resolved(tri: DataFrame, bodies: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """(doc_id, date_raw, date_flag, window_lo, window_hi, resolved_date, resolution, in_marsad, candidates) of the conflicts.

    The window is the sequence's, narrowed by the period's bounds. Tried in turn: the most common header date within
    a window with both ends; a window of the sequence's of one day; the only calendar day of the window other than
    the sequence's ends. Days and windows meet by month, so that no row is held against all days.
    """
    low, high = D.year_bounds(F.when(F.col("period") != "", F.col("period")))
    open_rows = tri.where(F.col("date_flag").startswith("conflict")).select("row_no", "doc_id", "date_raw", "date_flag", "window_lo", "window_hi", F.greatest("window_lo", low).alias("lo"), F.least("window_hi", high).alias("hi"))
    bound = open_rows.where("lo IS NOT NULL AND hi IS NOT NULL")
    seen = header_dates(bodies.join(bound.select("doc_id"), "doc_id", "left_semi")).join(bound, "doc_id").where("date BETWEEN lo AND hi")
    of_text = seen.groupBy("row_no").agg(F.array_join(F.array_sort(F.collect_set(F.date_format("date", "yyyy-MM-dd"))), ";").alias("text_days"))
    by_text = most_common(seen, "row_no", "date", ["line_no", "pos"]).select("row_no", F.col("date").alias("text_date"), F.format_string("text_window(n=%d)", "n").alias("text_how"))
    out = open_rows.join(by_text, "row_no", "left").join(of_text, "row_no", "left")
    squeezed = F.when(F.col("window_lo") == F.col("window_hi"), F.col("window_lo"))
    if usable(calendar):
        days = calendar.select("day", F.trunc("day", "MM").alias("month")).distinct()
        months = bound.where("lo <= hi").select("row_no", "window_lo", "window_hi", "lo", "hi", F.explode(F.sequence(F.trunc("lo", "MM"), F.trunc("hi", "MM"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
        inside = months.join(days, "month").where("day BETWEEN lo AND hi AND NOT day <=> window_lo AND NOT day <=> window_hi")
        found = inside.groupBy("row_no").agg(F.count("*").alias("k"), F.min("day").alias("first_day"), F.array_join(F.array_sort(F.collect_set(F.date_format("day", "yyyy-MM-dd"))), ";").alias("calendar_days"))
        out = out.join(found, "row_no", "left").withColumn("only_day", F.when(F.col("k") == 1, F.col("first_day")))
    else:
        out = out.withColumns({"only_day": F.lit(None).cast("date"), "calendar_days": F.lit(None).cast("string")})
    date = F.coalesce("text_date", squeezed, "only_day")
    how = F.when(F.col("text_date").isNotNull(), F.col("text_how")).when(squeezed.isNotNull(), "squeeze").when(F.col("only_day").isNotNull(), "marsad_unique").otherwise("")
    days_read = F.when(F.col("text_date").isNotNull(), F.col("text_days")).when(squeezed.isNull(), F.col("calendar_days"))
    out = out.select("doc_id", "date_raw", "date_flag", "window_lo", "window_hi", date.alias("resolved_date"), how.alias("resolution"), F.coalesce(days_read, F.lit("")).alias("candidates"), "row_no")
    if not usable(calendar):
        return out.withColumn("in_marsad", F.lit(None).cast("boolean"))
    known = calendar.select(F.col("day").alias("resolved_date"), F.lit(True).alias("known")).distinct()
    return out.join(known, "resolved_date", "left").withColumn("in_marsad", F.when(F.col("resolved_date").isNotNull(), F.coalesce("known", F.lit(False)))).drop("known")


def merged(tri: DataFrame, res: DataFrame) -> DataFrame:
    """(doc_id, source_file, final_date, date_source, period, series, seq, date_flag, flag_raw).

    A resolved conflict and a repaired year are ``repaired``, with what repaired them as the source; other
    conflicts are ``conflict:unresolved`` without a date; all others keep their date. date_flag leaves most soft flags
    out; flag_raw has them. Of several rows of one id the last stays.
    """
    rows = tri.join(res.select("row_no", "resolved_date", "resolution"), "row_no", "left")
    flag, found = F.col("date_flag"), F.col("resolved_date").isNotNull()
    conflict = flag.startswith("conflict")
    out_flag = F.when(conflict & found, "repaired").when(flag == "repaired_year", "repaired").when(conflict, "conflict:unresolved").when(flag == "ok", "verified_marsad").when(flag == "soft:not_marsad_plenary", flag).otherwise("")
    source = F.when(conflict & found, F.substring_index("resolution", "(", 1)).when(flag == "repaired_year", flag).otherwise(F.col("date_source"))
    final = F.when(conflict, F.col("resolved_date")).otherwise(F.col("final_date"))
    out = rows.select("row_no", "doc_id", "source_file", final.alias("final_date"), source.alias("date_source"), "period", "series", "seq", out_flag.alias("date_flag"), flag.alias("flag_raw"))
    last = out.groupBy("doc_id").agg(F.max_by(F.struct(*out.columns), "row_no").alias("row"))
    return last.select(*[f"row.{c}" for c in out.columns if c != "row_no"])


def with_text_gates(final: DataFrame, bodies: DataFrame) -> DataFrame:
    """``final`` with weekday, hijri, recurrence, suggested_date and evidence: pass, fail or na from what the documents say themselves.

    The first weekday of the header counts if a date stands wholly within the characters after it. evidence tells
    what was read. Each row of ``final`` stays one row; ``bodies`` has a row for each id.
    """
    weekday_names, weekday_no = D._words(L.WEEKDAYS)
    hijri_names, hijri_no = D._words(L.HIJRI_MONTHS)
    months = "|".join(sorted([*L.HIJRI_MONTHS, *L.GREGORIAN_MONTHS], key=len, reverse=True))
    head = F.replace(F.substring_index(D.fold(F.col("body")), "\n", L.HEADER_LINES), F.lit("\n"), F.lit("\n "))
    signal = rf"\d{{1,2}}\s+(?:{months})|1[34]\d{{2}}|(?:19|20)\d{{2}}"
    final = in_order(final)
    read_rows = final.join(bodies.select("doc_id", "body"), "doc_id", "left").withColumn("band", D.year_band(F.concat_ws(" ", "doc_id", "source_file")))
    rows = read_rows.withColumn("head", F.coalesce(head, F.lit("")))
    first = rf"(?s)^.*?يوم\s+({weekday_names})"
    said, upto = F.regexp_extract("head", first, 1), F.length(F.regexp_extract("head", first, 0))
    counts = (said != "") & F.substring(F.col("head"), upto + 1, F.lit(L.SIGNAL_WITHIN)).rlike(signal)
    weekday = F.when(~counts, "na").when(F.try_element_at(weekday_no, said) == F.weekday("final_date"), "pass").otherwise("fail")
    hijri_at = rf"(\d{{1,2}})\s+({hijri_names})\s+(1[34]\d{{2}})"
    part = lambda g: F.nullif(F.regexp_extract("head", hijri_at, g), F.lit(""))
    greg = D.hijri_to_gregorian(part(3).cast("int"), F.try_element_at(hijri_no, part(2)), part(1).cast("int"))
    in_band = F.col("band").isNull() | F.year(greg).between(F.col("band.low"), F.col("band.high"))
    hijri = F.when(greg.isNull() | ~in_band, "na").when(F.abs(F.datediff(greg, "final_date")) <= L.HIJRI_DAYS, "pass").otherwise("fail")
    read = [F.when(counts, F.concat(F.lit("weekday:"), said)), F.when(hijri != "na", F.concat(F.lit("hijri:"), F.concat_ws(" ", part(1), part(2), part(3)), F.lit("->"), F.date_format(greg, "yyyy-MM-dd")))]
    own = rows.select(*final.columns, weekday.alias("weekday"), hijri.alias("hijri"), F.array(*read).alias("read"))
    # all dates of a body: counted by document and date, then by document, on the partitions of the join above
    lines = read_rows.select("doc_id", "row_no", "final_date", "band", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", "row_no", "final_date", "band", "line_no", F.posexplode(D.dates_in_line(D.fold(F.col("line")))).alias("pos", "date"))
    lines = lines.where(F.col("band").isNull() | F.year("date").between(F.col("band.low"), F.col("band.high")))
    counts = lines.groupBy("doc_id", "row_no", "final_date", "date").agg(F.count("*").alias("n"), F.min(F.struct("line_no", "pos")).alias("first"))
    earliest = F.struct("n", -F.col("first.line_no"), -F.col("first.pos"))
    top = counts.groupBy("doc_id", "row_no").agg(F.max_by("date", earliest).alias("top_date"), F.max("n").alias("top_n"), F.max(F.when(F.col("date") == F.col("final_date"), F.col("n"))).alias("own_n"))
    out = own.join(top.drop("doc_id"), "row_no", "left").withColumn("own_n", F.coalesce("own_n", F.lit(0)))
    agrees = (F.col("top_date") == F.col("final_date")) | (F.col("own_n") >= F.greatest(F.lit(2), F.col("top_n") - 1))
    recurrence = F.when(F.coalesce("top_n", F.lit(0)) < 2, "na").when(agrees, "pass").when((F.col("top_n") >= 3) & (F.col("own_n") == 0), "fail").otherwise("na")
    mode = F.when(F.col("top_n") >= 2, F.concat(F.lit("recurrence:mode="), F.date_format("top_date", "yyyy-MM-dd"), F.lit("x"), F.col("top_n").cast("string")))
    evidence = F.array_join(F.concat("read", F.array(mode)), "; ")
    out = out.withColumn("recurrence", recurrence)
    return out.select(*final.columns, "weekday", "hijri", "recurrence", F.when(F.col("recurrence") == "fail", F.col("top_date")).alias("suggested_date"), evidence.alias("evidence"))


def text_gates(final: DataFrame, bodies: DataFrame) -> DataFrame:
    """(doc_id, weekday, hijri, recurrence, suggested_date, evidence) of each row of ``final``."""
    return with_text_gates(final, bodies).select("doc_id", "weekday", "hijri", "recurrence", "suggested_date", "evidence")


def verdict(date: Column, gates: dict[str, Column]) -> Column:
    """no_date, conflict, soft_flag, confirmed, single_witness or unverifiable from the states of the gates.

    A hard gate's failure is a conflict. A soft one's is a flag if any gate passes, hard or soft, else a conflict.
    """
    n = lambda names, state: sum((F.coalesce(gates[g] == state, F.lit(False)).cast("int") for g in names), F.lit(0))
    passes, hard, soft = n(GATES, "pass"), n(HARD, "fail"), n([g for g in GATES if g not in HARD], "fail")
    return (
        F.when(date.isNull(), "no_date").when(hard > 0, "conflict").when((soft > 0) & (passes > 0), "soft_flag").when(soft > 0, "conflict")
        .when(passes >= 2, "confirmed").when(passes == 1, "single_witness").otherwise("unverifiable")
    )


def gated(final: DataFrame, bodies: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """``final`` with the six gates, how many pass and fail, the verdict, a suggested date and the evidence."""
    rows = with_text_gates(final, bodies)
    if usable(calendar):
        days = calendar.select("day").distinct()
        rows = rows.join(days, F.col("final_date") == F.col("day"), "left")
        rows = rows.withColumn("marsad", F.when(~covered(F.col("final_date")), "na").when(F.col("day").isNotNull(), "pass").otherwise("fail")).drop("day")
    else:
        rows = rows.withColumn("marsad", F.lit("na"))
    rows = on_backbone(rows, "final_date", least=3)
    rows = rows.withColumn("sequence", F.when(F.col("seq_ok").isNull(), "na").when(F.col("seq_ok"), "pass").otherwise("fail"))
    rows = crowded(rows, "final_date", counted=final.select("final_date"))
    gates = {g: F.when(F.col("final_date").isNull(), "na").otherwise(F.coalesce(g, F.lit("na"))) for g in GATES}
    count = lambda state: sum((g == state).cast("int") for g in gates.values())
    dated = F.col("final_date").isNotNull()
    return rows.select("doc_id", "source_file", "final_date", "date_source", *[v.alias(k) for k, v in gates.items()], count("pass").alias("n_pass"), count("fail").alias("n_fail"), verdict(F.col("final_date"), gates).alias("verdict"),
                       F.when(dated, F.col("suggested_date")).alias("suggested_date"), F.when(dated, F.coalesce("evidence", F.lit(""))).otherwise("").alias("evidence"))


def flagged(rows: DataFrame) -> DataFrame:
    """The sittings in conflict, then those with a soft flag, each by id; the order is the report's."""
    return rows.where(F.col("verdict").isin("conflict", "soft_flag")).orderBy(F.when(F.col("verdict") == "conflict", 0).otherwise(1), "doc_id")


def report_lines(rows: DataFrame) -> DataFrame:
    """(part, at, line): the lines of a Markdown report, in the order of part and at.

    Verdicts in their own order with the total, the gates' states, and a line for each flagged sitting. Only
    counts are brought together; the flagged lines stay rows.
    """
    mark = lambda g: F.when(F.col(g) == "pass", "✓").when(F.col(g) == "fail", "✗").otherwise("·")
    cell = lambda *cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))
    text = lambda c: c.cast("string")
    spark = rows.sparkSession
    order = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    total = rows.agg(F.count("*").alias("n")).select(F.lit(0).alias("part"), F.lit("0").alias("at"), F.concat(F.lit("Total sittings: **"), text(F.col("n")), F.lit("**")).alias("line"))
    verdicts = rows.groupBy("verdict").agg(F.count("*").alias("n")).select(F.lit(1).alias("part"), text(order).alias("at"), cell(F.col("verdict"), text(F.col("n"))).alias("line"))
    states = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(g).alias("gate"), F.col(g).alias("state")) for i, g in enumerate(GATES)])).alias("s"))
    n = lambda state: text(F.count_if(F.col("s.state") == state))
    gates = states.groupBy("s.at", "s.gate").agg(n("pass").alias("p"), n("fail").alias("f"), n("na").alias("na")).select(F.lit(2).alias("part"), text(F.col("at")).alias("at"), cell(F.col("gate"), F.col("p"), F.col("f"), F.col("na")).alias("line"))
    filled = lambda c, other="": F.coalesce(text(F.col(c)), F.lit(other))
    each = flagged(rows).select(F.lit(3).alias("part"), F.concat(F.when(F.col("verdict") == "conflict", "0 ").otherwise("1 "), "doc_id").alias("at"), cell(F.col("doc_id"), filled("final_date", "—"), filled("date_source"), *map(mark, GATES), F.col("verdict"), filled("suggested_date"), filled("evidence")).alias("line"))
    heads = [(0, "", "# Sitting dates: gates"), (1, "", "| verdict | n |"), (2, "", "| gate | pass | fail | na |"), (3, "", "| sitting | date | source | " + " | ".join(GATES) + " | verdict | suggested | evidence |")]
    return spark.createDataFrame(heads, "part int, at string, line string").unionByName(total).unionByName(verdicts).unionByName(gates).unionByName(each).orderBy("part", "at")


def report(rows: DataFrame) -> str:
    """The report's heads and counts as text; ``report_lines`` has the flagged sittings too, as rows to be written."""
    return "\n".join(r.line for r in report_lines(rows).where("part < 3").orderBy("part", "at").collect()) + "\n"
