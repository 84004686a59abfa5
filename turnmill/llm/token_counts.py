"""Operator 1: word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark at a word's start in the vocabulary's pieces.
START = "▁"
REMEMBER = 200_000


class LongestMatch:
    """A trie over the pieces whose failure links carry the number of pieces that they pop.

    At a node that stands for s, ``fail`` is the node of what is left of s after its greedy longest pieces are
    taken off, the longest such rest that the trie knows, and ``pops`` their number. Reading a character follows
    links until the trie goes on, adding the pops, so a word costs time in proportion to its length and no piece
    is built.
    """

    def __init__(self, pieces: list[str]) -> None:
        #: What a string counts when taken off: 1 for a piece; its bytes for a character that is no piece by itself.
        taken = {c: len(c.encode("utf-8", "replace")) for piece in pieces for c in piece} | {piece: 1 for piece in pieces if piece}
        self.next: list[dict[str, int]] = [{}]
        whole = [0]
        for piece, n in taken.items():
            at = 0
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    whole.append(0)
                at = to
            whole[at] = n
        self.fail: list[int] = [0] * len(self.next)
        self.pops: list[int] = [0] * len(self.next)
        queue = deque([0])
        while queue:  # breadth first: a link leads to a shorter string, which is done
            at = queue.popleft()
            for c, to in self.next[at].items():
                queue.append(to)
                if whole[to]:
                    self.pops[to] = whole[to]
                    continue
                z, pops = self.fail[at], self.pops[at]
                while c not in self.next[z]:  # ends: every character of a piece goes on from the root
                    z, pops = self.fail[z], pops + self.pops[z]
                self.fail[to], self.pops[to] = self.next[z][c], pops

    def count(self, word: str) -> int:
        """Pieces of the greedy longest match; a character that no piece takes counts its UTF-8 bytes."""
        total = at = 0
        follow, fail, pops = self.next, self.fail, self.pops
        for c in word:
            while c not in follow[at]:
                if not at:
                    total += len(c.encode("utf-8", "replace"))
                    break
                total += pops[at]
                at = fail[at]
            else:
                at = follow[at][c]
        while at:
            total += pops[at]
            at = fail[at]
        return total


@lru_cache(maxsize=2)
def automaton(model_path: str) -> LongestMatch:
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return LongestMatch([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))])


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every whole text: one pass, no shuffle.

    Words are what stands between Unicode white space, each with the start mark before it; n_tokens is the number
    of pieces of the greedy longest match over the vocabulary's pieces, characters that none can take counting
    one for each UTF-8 byte. Nulls: a null text counts as empty, with 0 of both. Null ids stay null, repeated
    rows repeat, other columns are ignored, an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = automaton(model_path).count

        class Lengths(dict):
            def __missing__(self, word: str) -> int:
                n = self[word] = count(START + word)
                return n

        known = Lengths()
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                cut = text.as_py().split()
                words.append(len(cut))
                tokens.append(sum(map(known.__getitem__, cut)))
                if len(known) > REMEMBER:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
