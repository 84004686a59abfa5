"""Text expressions over columns, steered by a lexicon. Python's Unicode classes are kept with the (?U) flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnmill.functions.lexicon import ARABIC, Lexicon


def java(pattern: str) -> str:
    """A Python pattern for Java's engine: Unicode classes, and groups named the Java way."""
    return "(?U)" + pattern.replace("(?P<", "(?<")


#: White space as Python has it, for Java: the Unicode class and the four separators that it lacks.
BLANKS = r"(?U)[\s\x1c-\x1f]"


#: Runs of white space but for a single space, which stays as it is.
_UNEVEN = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _UNEVEN, " "))


#: The same characters one by one.
_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_CHARS))


def folded(text: Column, lex: Lexicon) -> Column:
    """The text as the lexicon's patterns have it, letter for letter."""
    return F.translate(text, lex.spell_from, lex.spell_to) if lex.spell_from else text


def matches(text: Column, pattern: str, lex: Lexicon) -> Column:
    return folded(text, lex).rlike(java(pattern))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def normalize(text: Column, lex: Lexicon = ARABIC) -> Column:
    """Diacritics dropped, letters folded, everything foreign to the script a space, spaces squeezed."""
    folded = F.translate(F.regexp_replace(text, lex.diacritics, ""), lex.fold_from, lex.fold_to)
    return F.trim(F.regexp_replace(F.regexp_replace(folded, lex.foreign, " "), r"(?U)\s+", " "))


def strip_honorifics(text: Column, lex: Lexicon = ARABIC) -> Column:
    """The normalised text without any leading honorifics; one that is the whole text stays."""
    flag = "(?i)" if lex is not ARABIC else ""
    return F.trim(F.regexp_replace(normalize(text, lex), f"{flag}^(?:(?:{lex.folded_honorifics()}) +)+", ""))


def clean_candidate(text: Column, lex: Lexicon = ARABIC) -> Column:
    """A name as captured: stripped, cut at the first stop word, without filler words."""
    strip = lambda c: F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(lex.strip))
    name = strip(F.replace(text, F.lit("#"), F.lit(" ")))
    cut = F.left(name, F.length(F.split(folded(name, lex), java(lex.stop_after), 2)[0]))
    return strip(F.regexp_replace(cut, java(lex.filler), " "))


def is_office(text: Column, lex: Lexicon = ARABIC) -> Column:
    words = F.split(F.lower(strip_honorifics(text, lex)), " ")
    return matches(text, lex.office, lex) | F.arrays_overlap(words, F.array(*map(F.lit, lex.title_words)))


#: Where Python splits lines, and texts that are short or numbers however they are spaced.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_SHORT = r"(?U)^(?:[\s\x1c-\x1f]*[^\s\x1c-\x1f]{0,2}[\s\x1c-\x1f]*|[\d\s\x1c-\x1f/\u2011\u0640-]+)$"
def first_line(text: Column) -> Column:
    """The first line that isn't blank, cut at each kind of break: a pattern with all of them took most of the time of ``is_noise``."""
    line = F.ltrim(text, F.lit(_CHARS))
    for c in map(chr, (*range(10, 14), *range(28, 31), 0x85, 0x2028, 0x2029)):
        line = F.substring_index(line, c, 1)
    return line


def is_noise(text: Column, lex: Lexicon = ARABIC) -> Column:
    """Shorter than 3 characters, nothing but digits, slashes, hyphens and stretches, or furniture on every line that isn't blank.

    Lines are only split where the first one is furniture.
    """
    furniture = lambda line: matches(stripped(line), lex.noise_line, lex)
    all_lines = F.forall(F.split(text, LINE_BREAK), lambda x: (stripped(x) == "") | furniture(x))
    return text.rlike(_SHORT) | F.when(furniture(first_line(text)), all_lines).otherwise(False)


def is_substantive(text: Column, lex: Lexicon = ARABIC) -> Column:
    three_words = text.rlike(r"(?U)\S\s+\S+\s+\S")  # ends at the third word, where a count reads the whole text
    return ~is_noise(text, lex) & (three_words | matches(stripped(text), lex.openers, lex))


def is_plain_boundary(text: Column, lex: Lexicon = ARABIC) -> Column:
    """A boundary by its own form; a usable cue, the other kind, is found by the cue detector."""
    c = folded(compact(text), lex)
    return (
        (c == "") | c.rlike(java(lex.section)) | F.left(c, F.lit(250)).rlike(java(lex.report)) | c.rlike(java(lex.vote_start))
        | c.rlike(java(r"^\s*" + lex.adjourn)) | c.rlike(java(lex.resume)) | c.rlike(java(lex.vote_result))
    )


def is_procedural(text: Column, lex: Lexicon = ARABIC) -> Column:
    c = compact(text)
    seen, words = folded(c, lex), word_count(c)
    few = (words <= 30) | ((words <= 60) & (F.regexp_count(seen, F.lit(java(lex.procedural))) >= 3))
    return F.when(seen.rlike(java(lex.procedural)), few).otherwise(False)


def block_type(text: Column, lex: Lexicon = ARABIC) -> Column:
    c = folded(compact(text), lex)
    return (
        F.when(F.left(c, F.lit(350)).rlike(java(lex.report)), "committee_report_or_rapporteur")
        .when(F.left(c, F.lit(300)).rlike(java(lex.vote_or_article)), "vote_or_article")
        .when(c.rlike(java(lex.openers)), "speech").when(is_procedural(text, lex), "procedural").otherwise("speech_like")
    )


def truncate_at(text: Column, marker: str, lex: Lexicon | None = None) -> Column:
    """Cut at the end of the line in which ``marker`` first matches, trailing blanks dropped; without a match as it is."""
    seen = folded(text, lex) if lex else text
    upto = F.length(F.regexp_extract(seen, rf"(?s)^(.*?(?:{marker})[^\n]*)", 1))
    return F.when(seen.rlike(marker), F.regexp_replace(F.left(text, upto), r"(?U)[\s\x1c-\x1f]+$", "")).otherwise(text)


def ellipsis(text: Column, most: int = 130) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(name, "/", -1), r"\.md$", "")


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def without_marks(text: Column) -> Column:
    """Without the page marks and images that text recognition leaves."""
    return F.regexp_replace(F.regexp_replace(text, r"<!--\s*page\s+\d+\s+col\s+[RLS]\s*-->", "\n"), r"!\[[^\]]*\]\([^)]*\)", "")
