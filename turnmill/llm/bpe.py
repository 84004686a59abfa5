"""Operator 7: byte-level BPE by a sentencepiece model that is serialised from the rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A space between two characters that aren't blank: pre-tokens never reach over its left side, so texts may be cut there.
CUT = regex.compile(r"(?<=\S) (?=\S)")
#: Words whose ids a task remembers before it starts afresh, and the longest of them (characters): some 40 MB.
REMEMBER, LONGEST = 200_000, 64


def byte_letters() -> list[str]:
    """A visible letter for each byte: printable Latin-1 stands for itself, the rest for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return [chr(other.get(b, b)) for b in range(256)]


def sentencepiece_model(ranks_path: str) -> tuple[bytes, list[bytes]]:
    """The serialised model and each id's bytes. Piece 0 is the unknown piece that the format asks for; piece r + 1 is rank r."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters = byte_letters()
    with open(ranks_path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, f))
    assert [r for r, _ in ranked] == list(range(len(ranked))), "ranks must be gapless from 0"
    m = pb.ModelProto()
    m.trainer_spec.model_type = pb.TrainerSpec.BPE
    m.trainer_spec.vocab_size = len(ranked) + 1
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = 0, -1, -1, -1
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.remove_extra_whitespaces = m.normalizer_spec.escape_whitespaces = False
    m.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for rank, piece in ranked:
        m.pieces.add(piece="".join(letters[b] for b in piece), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    return m.SerializeToString(), [piece for _, piece in ranked]


class Codec:
    """Encodes and decodes texts. ``known`` remembers the ids of words between single spaces; the caller owns it."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        model, pieces = sentencepiece_model(ranks_path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.packed = [b"", *(np.arange(len(pieces), dtype="<u4")[:, None].view("V4").ravel().tolist())]
        self.find = regex.compile(pattern).findall
        self.letters = dict(enumerate(byte_letters()))
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Each pre-token of each word by itself, in one call of the model, as little-endian unsigned 32-bit ids."""
        cut = [self.find(w) for w in words]
        mapped = "\0".join(["\0".join(pres) for pres in cut]).encode("utf-8").decode("latin-1").translate(self.letters).split(self.letters[0])
        if len(mapped) != sum(map(len, cut)):  # a text with zero bytes in it
            mapped = [pre.encode("utf-8").decode("latin-1").translate(self.letters) for pres in cut for pre in pres]
        ids = iter(self.model.encode(mapped if any(cut) else [], num_threads=1))
        packed = self.packed
        return [b"".join([packed[i] for _ in pres for i in next(ids)]) for pres in cut]

    def encode(self, text: str, known: dict[str, bytes]) -> bytes:
        words = text.split(" ")
        words[1:] = [" " + w for w in words[1:]]
        new = list({w for w in words if w not in known})
        if any(w[-1:].isspace() or w[1:2].isspace() or not w.strip() for w in new):
            # blanks beside the spaces: cut at single spaces only, and remember nothing
            first, *rest = CUT.split(text)
            return b"".join(self.ids_of([first, *[" " + w for w in rest]]))
        if new:
            found = dict(zip(new, self.ids_of(new), strict=True))
            ids = b"".join([found[w] if w in found else known[w] for w in words])
            if len(known) > REMEMBER:
                known.clear()
            known.update((w, i) for w, i in found.items() if len(w) <= LONGEST)
            return ids
        return b"".join([known[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        n = self.lengths[at]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - ends + n, n)].tobytes()


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]) of every row: one pass, no shuffle.

    Each match of ``pattern`` is encoded by itself, without special tokens, through a sentencepiece BPE model made
    from the rank file (byte-mapped pieces, score minus rank, identity normalisation); the ids are decoded by the
    inverse mapping. ``with_ids`` adds the ids, ``with_text`` the decoded text.

    Nulls: a null text counts as empty; an empty text has 0 tokens. Ids of any type become longs; null ids stay
    null. Repeated rows give repeated results; other columns are ignored; an empty table gives no rows. A text
    of any length is encoded whole; memory follows the longest text.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, known = codec(ranks_path, pattern), {}  # what is remembered goes when the task ends
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n", "i", "d", "ids", "text")}
            for text in batch.column(1):
                ids = c.encode(text.as_py(), known)
                back = c.decode(ids)
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
