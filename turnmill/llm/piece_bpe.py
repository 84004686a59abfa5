"""Operator 13: a sentencepiece BPE model's ids by a table of each prefix's last token, recovered backwards."""

from __future__ import annotations

import hashlib
import re
import struct
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands for a space in pieces.
SPACE = "▁"
#: Words whose ids a task remembers before it starts afresh, the longest of them, and pairs of tokens that are remembered.
REMEMBER, LONGEST, PAIRS = 150_000, 64, 2_000_000


class Words(dict):
    """Remembers the packed ids of short words. Once there are REMEMBER, those asked for again pass to the next generation, the rest go."""

    def __init__(self, table: PrefixTable) -> None:
        self.table, self.older = table, {}

    def turn(self) -> None:
        if len(self) > REMEMBER:
            self.older = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.table.word(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


class PrefixTable:
    """Encodes by last tokens of prefixes, and decodes by the pieces' bytes.

    A text's encoding is the one sequence of tokens whose neighbours are all compatible: two tokens are, if merging
    the characters of both together ends with just these two. Every prefix has an encoding of its own, so it has
    exactly one last token: of the tokens that an automaton finds to end there, the one that is compatible with the
    last token of the prefix before it. The table of last tokens is filled from left to right, and the ids are read
    from its end backwards.

    Tokens are the model's pieces and the single characters that pieces are made of; a character of the latter that
    is no piece, and one that no piece has, is written as the pieces of its UTF-8 bytes.
    """

    def __init__(self, model_path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(model_path, "rb") as f:
            m.ParseFromString(f.read())
        kinds, norm = pb.ModelProto.SentencePiece, m.normalizer_spec
        if m.trainer_spec.model_type != pb.TrainerSpec.BPE or not m.trainer_spec.byte_fallback or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in m.pieces):
            raise ValueError("a BPE model with byte fallback and without user-defined or unused pieces is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model whose only normalisation is the mark for spaces is needed")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.begin, self.end = (struct.pack("<I", i) for i in (m.trainer_spec.bos_id, m.trainer_spec.eos_id))
        self.size = len(m.pieces)
        self.score = {p.piece: p.score for p in m.pieces if p.type == kinds.NORMAL}
        ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == kinds.NORMAL}
        of_byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        #: The packed ids of each byte, and of each token by its number: numbers from ``size`` on are bare characters.
        self.byte_ids = [struct.pack("<I", of_byte[b]) for b in range(256)]
        bare = sorted({c for p in self.score for c in p} - ids.keys())
        self.strings = [p.piece if p.type == kinds.NORMAL else "" for p in m.pieces] + bare
        self.packed = [struct.pack("<I", i) for i in range(self.size)] + [self.in_bytes(c) for c in bare]
        tokens = ids | {c: self.size + k for k, c in enumerate(bare)}
        self.build(tokens)
        #: Where no piece reaches over the left side of a space that follows something else, words are encoded one by one.
        #: No piece reaches over a line break or tab that it can't hold.
        apart = not any(SPACE in p.lstrip(SPACE) for p in ids)
        hard = "".join(c for c in "\n\r\t" if not any(c in p for p in tokens)) or "\n"
        self.words = re.compile(f"{SPACE}*[^{SPACE}{hard}]+|{SPACE}+|[{hard}]+" if apart else r"(?s).+").findall
        self.steps: dict[int, tuple] = {}
        self.fits: dict[int, bool] = {}
        flat = [bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else b"" for p in m.pieces]
        self.flat = np.frombuffer(b"".join(flat), np.uint8)
        self.lengths = np.array([len(x) for x in flat], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.leading = np.array([p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in m.pieces])

    def build(self, tokens: dict[str, int]) -> None:
        """The automaton: for each state its next ones, that of its longest proper end, and the tokens that end there, longest first."""
        self.next: list[dict[str, int]] = [{}]
        own: list[tuple] = [()]
        for piece, number in tokens.items():
            at = 0
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    own.append(())
                at = to
            own[at] = ((number, len(piece)),)
        self.fail, self.ends = [0] * len(own), own
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for c, to in self.next[at].items():
                queue.append(to)
                if at:
                    z = self.fail[at]
                    while z and c not in self.next[z]:
                        z = self.fail[z]
                    self.fail[to] = self.next[z].get(c, 0)
                self.ends[to] = own[to] + self.ends[self.fail[to]]

    def in_bytes(self, char: str) -> bytes:
        return b"".join([self.byte_ids[b] for b in char.encode("utf-8", "replace")])

    def merges(self, token: int) -> tuple[list[float], list[str], list[str], bool]:
        """Scores of the merges that build a token, the first and the last symbol before each and at the end, and whether it comes out whole."""
        found = self.steps.get(token)
        if found is None:
            symbols, scores = list(self.strings[token]), []
            first, last = [symbols[0]], [symbols[-1]]
            while len(symbols) > 1:
                joined = [(self.score[a + b], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.score]
                if not joined:
                    break
                best = max(joined)
                i = -best[1]
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                scores.append(best[0])
                first.append(symbols[0])
                last.append(symbols[-1])
            found = self.steps[token] = (scores, first, last, len(symbols) == 1)
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' characters, best score first and leftmost of equal ones, never join them."""
        a, _, edge, whole_a = self.merges(left)
        b, start, _, whole_b = self.merges(right)
        if not (whole_a and whole_b):
            return False
        i = j = 0
        while True:
            across = self.score.get(edge[i] + start[j])
            mine, other = a[i] if i < len(a) else None, b[j] if j < len(b) else None
            # of equal scores the leftmost merge comes first: the left token's, then the one across, then the right token's
            if across is not None and (mine is None or across > mine) and (other is None or across >= other):
                return False
            if mine is None and other is None:
                return True
            if other is None or (mine is not None and mine >= other):
                i += 1
            else:
                j += 1

    def word(self, text: str) -> bytes:
        """The packed ids of one word: last tokens of all its prefixes, then backwards."""
        size, fits, follow, fail, ends = len(self.strings), self.fits, self.next, self.fail, self.ends
        last, length = [-1], [0]  # -1: nothing, or a character that no piece has
        at = end = 0
        for c in text:
            to = follow[at].get(c)
            while to is None and at:
                at = fail[at]
                to = follow[at].get(c)
            at = to or 0
            end += 1
            for token, k in ends[at]:
                one = last[end - k]
                if one < 0:
                    fit = self.merges(token)[3]
                else:
                    pair = one * size + token
                    fit = fits.get(pair)
                    if fit is None:
                        if len(fits) > PAIRS:
                            fits.clear()
                        fit = fits[pair] = self.compatible(one, token)
                if fit:
                    last.append(token)
                    length.append(k)
                    break
            else:
                last.append(-1)
                length.append(1)
        out, packed = [], self.packed
        while end:
            out.append(packed[last[end]] if last[end] >= 0 else self.in_bytes(text[end - 1]))
            end -= length[end]
        return b"".join(reversed(out))

    def encode(self, text: str, known: Words) -> bytes:
        """Little-endian unsigned 32-bit ids with the begin and end ids. ``known`` remembers words; the caller owns it."""
        known.turn()
        words = self.words(self.prefix + text.replace(" ", SPACE)) if text else []
        return b"".join([self.begin, *map(known.__getitem__, words), self.end])

    def decode(self, ids: bytes) -> bytes:
        """The pieces' bytes in a row; the first piece loses the space that encoding puts before a text."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        n = self.lengths[at]
        ends = np.cumsum(n)
        out = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - ends + n, n)].tobytes()
        shown = np.flatnonzero(n)
        return out[1:] if self.prefix and len(shown) and self.leading[at[shown[0]]] else out


@lru_cache(maxsize=2)
def prefix_table(model_path: str) -> PrefixTable:
    return PrefixTable(model_path)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]) of every row: one pass, no shuffle.

    Ids are those of the model with its begin and end ids, found by ``PrefixTable``; all of them are then decoded.
    ``with_ids`` adds the ids, ``with_text`` the decoded text.

    Nulls: a null text counts as empty; an empty text has the begin and the end id alone. Ids of any type become
    longs; null ids stay null. Repeated rows give repeated results; other columns are ignored; an empty table gives
    no rows. A text of any length is encoded whole; memory follows the longest text.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model_path)
        known = Words(table)  # what is remembered goes when the task ends
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n", "i", "d", "ids", "text")}
            for text in batch.column(1):
                ids = table.encode(text.as_py(), known)
                back = table.decode(ids)
                rows["n"].append(len(ids) // 4)
                rows["i"].append(hashlib.sha256(ids).hexdigest())
                rows["d"].append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    rows["ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
                if with_text:
                    rows["text"].append(back.decode("utf-8", "replace"))
            out = [batch.column(0), pa.array(rows["n"], pa.int64()), pa.array(rows["i"], pa.string()), pa.array(rows["d"], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.array(rows["ids"], pa.list_(pa.int32())))
                names.append("ids")
            if with_text:
                out.append(pa.array(rows["text"], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)
