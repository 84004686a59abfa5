"""Table functions for SQL: all hand-offs of a text, paragraphs of a body, turns of an ordered table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import UserDefinedTableFunction

from turnmill.functions.lexicon import ARABIC, ENGLISH, Lexicon
from turnmill.operators.turns import FLAGS, finder, fold_members

LEXICONS = {"arabic": ARABIC, "english": ENGLISH}


def cues(lexicons: dict[str, Lexicon] | None = None) -> UserDefinedTableFunction:
    """``cues(text, lexicon)``: (pattern, start, end, name, clean, usable) of every match of every pattern of the named lexicon.

    Offsets are code points of the text, ``end`` is behind the match; ``clean`` is the name without titles and what follows
    it, ``usable`` whether it can be a name. Of the usable rows the one of the greatest start, and of the lowest pattern
    among these, is the cue that ``with_cues`` takes. A null text or an unknown lexicon has no rows.
    """
    known = LEXICONS if lexicons is None else lexicons

    @udtf(returnType="pattern int, start int, end int, name string, clean string, usable boolean", useArrow=True)
    class Cues:
        def eval(self, text: str, lexicon: str) -> Iterator[tuple]:
            if text is not None and lexicon in known:
                yield from finder(known[lexicon]).every(text)

    return Cues


@udtf(returnType="par int, start_line int, end_line int, text string", useArrow=True)
class Paragraphs:
    """``paragraphs(body)``: runs of lines that aren't blank, each right-stripped and joined by line breaks, numbered from 1."""

    def eval(self, body: str) -> Iterator[tuple]:
        held: list[str] = []
        n = 0
        lines = [] if body is None else body.split("\n")
        for number, line in enumerate([*lines, ""], start=1):
            if line.strip():
                held.append(line.rstrip())
            elif held:
                n += 1
                yield n, number - len(held), number - 1, "\n".join(held)
                held = []


@udtf(returnType="key string, at long, turn long, cue_at long, from_tail boolean", useArrow=False)
class Turns:
    """``turns(TABLE(flags) PARTITION BY key ORDER BY at)``: the rows that belong to turns, for a table with ``key``, ``at`` and the flags of ``fold_members``.

    A key's flags are held until its rows are all there: six marks and a number a row.
    """

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.key: str | None = None

    def eval(self, row: Row) -> None:
        self.key = None if row["key"] is None else str(row["key"])
        self.rows.append({"at": row["at"], **{k: row[k] for k in FLAGS}})

    def terminate(self) -> Iterator[tuple]:
        for place, turn, cue, tail in fold_members(self.rows):
            yield self.key, self.rows[place]["at"], turn, self.rows[cue]["at"], tail


def register(spark: SparkSession, lexicons: dict[str, Lexicon] | None = None) -> None:
    """Makes ``cues``, ``paragraphs`` and ``turns`` known to the session's SQL."""
    for name, function in (("cues", cues(lexicons)), ("paragraphs", Paragraphs), ("turns", Turns)):
        spark.udtf.register(name, function)
