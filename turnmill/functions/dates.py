"""Date expressions: file names, calendars, parliamentary years, dates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnmill.functions import lexicon as L

_INT = "int"


def fold(text: Column) -> Column:
    """Arabic text as the calendar words are spelled: marks dropped, digits Latin, five letters folded."""
    bare = F.regexp_replace(text, "[ؐ-ًؚ-ٰٟۖ-ۭ]", "")
    return F.translate(bare, "٠١٢٣٤٥٦٧٨٩أإآىة", "0123456789ااايه")


def parse_iso(text: Column) -> Column:
    """A real calendar date or null."""
    return F.when(text.rlike(r"^\s*\d{1,4}-\d{1,2}-\d{1,2}\s*$"), safe_date(F.split(text, "-")[0], F.split(text, "-")[1], F.split(text, "-")[2]))


def safe_date(y: Column, m: Column, d: Column) -> Column:
    parts = [F.trim(c.cast("string")).try_cast("int") for c in (y, m, d)]
    text = F.concat_ws("-", F.lpad(parts[0].cast("string"), 4, "0"), F.lpad(parts[1].cast("string"), 2, "0"), F.lpad(parts[2].cast("string"), 2, "0"))
    return F.when(parts[0].isNotNull() & parts[1].between(1, 12) & parts[2].between(1, 31), F.try_to_date(text, "yyyy-MM-dd"))


def loose_date(y: Column, m: Column, d: Column) -> Column:
    """An ISO string when month and day are in range at all, even if the month has no such day."""
    ok = m.cast(_INT).between(1, 12) & d.cast(_INT).between(1, 31)
    year, month, day = (c.cast(_INT).cast("string") for c in (y, m, d))
    return F.when(ok, F.concat_ws("-", F.lpad(year, F.greatest(F.length(year), F.lit(4)), F.lit("0")), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def hijri_to_gregorian(y: Column, m: Column, d: Column) -> Column:
    """The tabular calendar, by integer arithmetic; within two days of the observed date."""
    div = lambda a, b: F.floor(a / b).cast("long")
    day = div(11 * y + 3, 30) + 354 * y + 30 * m - div(m - 1, 2) + d + 1948440 - 385
    return F.date_add(F.lit("1970-01-01").cast("date"), (day - 2440588).cast(_INT))


def parliamentary_year(date: Column) -> Column:
    """YYYY-YYYY of the year from September to August."""
    first = F.year(date) - F.when(F.month(date) >= 9, 0).otherwise(1)
    return F.concat_ws("-", first.cast("string"), (first + 1).cast("string"))


def year_bounds(period: Column) -> tuple[Column, Column]:
    return F.make_date(F.left(period, F.lit(4)).cast(_INT), F.lit(9), F.lit(1)), F.make_date(F.substring(period, 6, 4).cast(_INT), F.lit(8), F.lit(31))


def legislature(date: Column, year: Column) -> Column:
    """The period whose half-open span holds the date (as ISO text), or by the starting year where there is none."""
    by_date = F.lit(L.LAST_PERIOD)
    for cut, name in reversed(L.PERIOD_CUTS):
        by_date = F.when(date < cut, name).otherwise(by_date)
    by_year = F.lit(L.LAST_PERIOD)
    for last, name in reversed(L.PERIOD_YEARS):
        by_year = F.when(year <= last, name).otherwise(by_year)
    return F.when(F.coalesce(date, F.lit("")) != "", by_date).when(year.isNull(), "").otherwise(by_year)


def stem_parts(stem: Column) -> dict[str, Column]:
    """period, seq and series of a document name: an undated range, or a date with an optional number."""
    part = lambda p, g: F.nullif(F.regexp_extract(stem, p, g), F.lit(""))
    spans, dated = r"^(\d{4})-(\d{4})__(\d+)$", r"^(\d{4})-(\d{2})-(\d{2})__(seg)?(\d+)?"
    is_span, is_dated = stem.rlike(spans), stem.rlike(dated)
    y, m = part(dated, 1).cast(_INT), part(dated, 2).cast(_INT)
    first = F.when(m >= 9, y).otherwise(y - 1)
    return {
        "period": F.when(is_span, F.concat_ws("-", part(spans, 1), part(spans, 2))).when(is_dated, F.concat_ws("-", first.cast("string"), (first + 1).cast("string"))).otherwise(""),
        "seq": F.when(is_span, part(spans, 3).cast(_INT)).when(is_dated, part(dated, 5).cast(_INT)),
        "series": F.when(is_span, "num").when(is_dated & part(dated, 4).isNotNull(), "seg").when(is_dated & m.isin(8, 9), "ext").when(is_dated, "num").otherwise(""),
        "stem_date": F.when(is_dated, safe_date(part(dated, 1), part(dated, 2), part(dated, 3))),
    }


def year_band(text: Column) -> Column:
    """(low, high): the four-digit years in the text, one year wider; null without any."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(19\d{2}|20\d{2})"), 1), lambda y: y.cast(_INT))
    return F.when(F.size(years) > 0, F.struct((F.array_min(years) - 1).alias("low"), (F.array_max(years) + 1).alias("high")))


def file_meta(name: Column, years: tuple[int, int] = L.YEARS) -> dict[str, Column]:
    """document_id, years, date, include and reason of a corpus file, by the first rule that fits its name."""
    part = lambda p, g: F.nullif(F.regexp_extract(name, p, g), F.lit(""))
    lead, packed = r"^(20\d{2}|19\d{2})[-_](\d{1,2})[-_](\d{1,2})", r"^(20\d{2}|19\d{2})(\d{2})(\d{2})"
    span, bulletin = r"^(20\d{2})-(20\d{2})_", r"(?i)bulletin_officiel_.*?[-_](\d{1,2})[-_](\d{1,2})[-_](20\d{2})"
    special = name.rlike(r"^2011_Mudawalat_2011_")
    start = F.coalesce(part(lead, 1), part(packed, 1), part(span, 1), part(bulletin, 3)).cast(_INT)
    end = F.coalesce(part(lead, 1), part(packed, 1), part(span, 2), part(bulletin, 3)).cast(_INT)
    iso = (
        F.when(name.rlike(lead), loose_date(part(lead, 1), part(lead, 2), part(lead, 3)))
        .when(name.rlike(packed), loose_date(part(packed, 1), part(packed, 2), part(packed, 3)))
        .when(name.rlike(span), None).otherwise(loose_date(part(bulletin, 3), part(bulletin, 2), part(bulletin, 1)))
    )
    fits = F.coalesce((start <= years[1]) & (end >= years[0]), F.lit(False))
    return {
        "document_id": F.regexp_replace(F.regexp_replace(name, r"\.md$", ""), "_cleaned_clean$", ""),
        "year_start": F.when(special, 2011).otherwise(start), "year_end": F.when(special, 2014).otherwise(end),
        "inferred_date": F.when(~special, iso), "include": special | fits,
        "reason": F.when(special, "2011_mudawalat").when(fits, "in_scope_year").otherwise(f"outside_{years[0]}_{years[1]}_or_unknown_date"),
    }


def _words(table: dict[str, int]) -> tuple[str, Column]:
    longest_first = sorted(table, key=len, reverse=True)
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return "|".join(longest_first), F.create_map(*pairs)


def dates_in_line(line: Column, months: dict[str, int] = L.GREGORIAN_MONTHS) -> Column:
    """All real dates of one folded line: first those with month names, then numeric ones, each in D-M-Y order."""
    names, number = _words(months)
    worded, numeric = rf"(\d{{1,2}})\s+({names})\s+(\d{{4}})", r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"

    def found(pattern: str, month) -> Column:
        each = F.regexp_extract_all(line, F.lit(pattern), 0)
        take = lambda x, g: F.regexp_extract(x, pattern, g)
        return F.transform(each, lambda x: safe_date(take(x, 3), month(take(x, 2)), take(x, 1)))

    both = F.concat(found(worded, lambda m: F.try_element_at(number, m).cast("string")), found(numeric, lambda m: m))
    return F.filter(both, lambda x: x.isNotNull())


def _found(text: Column, pattern: str, *groups: int) -> list[Column]:
    return [F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups]


def date_in_name(stem: Column) -> Column:
    """The ISO date in a file's name: year first, else day first; null where neither has a month and a day in range."""
    first, last = (F.split(F.nullif(F.regexp_extract(stem, p, 0), F.lit("")), "[-_.]") for p in (r"20\d{2}[-_.]\d{1,2}[-_.]\d{1,2}", r"\d{1,2}[-_.]\d{1,2}[-_.]20\d{2}"))
    return F.coalesce(loose_date(F.get(first, 0), F.get(first, 1), F.get(first, 2)), loose_date(F.get(last, 2), F.get(last, 1), F.get(last, 0)))


def two_day_sitting(stem: Column) -> Column:
    """(date, session, source) of a name that carries both days of a sitting and its number, dated by the first day; else null."""
    year_first = stem.rlike(r"^\d{4}-\d{2}-_?\d{1,2}[-_]+\d{1,2}_N[-_]+\d+$")
    year_last = stem.rlike(r"^\d{1,2}[-_]+\d{1,2}_\d{2}-\d{4}_N[-_]+\d+$")
    part = F.split(stem, "[-_]+")
    y, m, a, b = (F.when(year_first, F.get(part, i)).otherwise(F.get(part, j)) for i, j in ((0, 3), (1, 2), (2, 0), (3, 1)))
    first = F.least(a.try_cast(_INT), b.try_cast(_INT))
    date = F.concat_ws("-", y, m, F.lpad(first.cast("string"), 2, "0"))
    return F.when(year_first | year_last, F.struct(date.alias("date"), F.concat(F.lit("N"), F.get(part, 5)).alias("session"), F.lit("multiday_first_day_min").alias("source")))


def source_tag(stem: Column) -> Column:
    """A file's name without its dates, and without copy marks (N, n or No before a number); words joined by underscores."""
    bare = F.regexp_replace(F.regexp_replace(stem, r"20\d{2}[-_.]\d{1,2}[-_.]\d{1,2}", " "), r"\d{1,2}[-_.]\d{1,2}[-_.]20\d{2}", " ")
    words = F.btrim(F.regexp_replace(bare, r"[^0-9A-Za-z]+", "_"), F.lit("_"))
    return F.regexp_replace(words, r"(?<![0-9A-Za-z])(?:N|n|No)_(?=[0-9]+(?:_|$))", "")


def banner_date(body: Column) -> Column:
    """The ISO date of a sitting's opening banner: after the word for day and a weekday, else the first day, month name and year at all."""
    names, number = _words({m: n for m, n in L.GREGORIAN_MONTHS.items() if m in L.BANNER_MONTHS})
    text, date = fold(body), rf"(\d{{1,2}})\s+({names})\s+(20\d\d)"
    strict, loose = (_found(text, p, 1, 2, 3) for p in (rf"يوم\s+\S+\s+{date}", date))
    d, m, y = (F.when(strict[0].isNotNull(), a).otherwise(b) for a, b in zip(strict, loose, strict=True))
    return loose_date(y, F.try_element_at(number, m).cast("string"), d)
