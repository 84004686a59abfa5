"""Conversation repair, resampling towards a target and piece encoding against brute force and the library, with odd and empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tests.llm.test_operators import PIECES, documents, odd_texts
from turnmill.llm import conversations, decontaminate, piece_bpe, target_resample

TURNS = "conv_id long, turn long, role string, text string, copies int, audit string, state int, n int"


# conversations


def plain_repair(rows):
    """The cheapest audit of (role, text) rows by trying states step by step with whole strings, faults first."""
    seen, marked = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    best = {"": (0, "", ())}

    def inserted(found):
        out = dict(found)
        for _ in range(3):
            for state, (cost, audit, lines) in list(out.items()):
                name = "assistant" if state == "u" else "user"
                here = (cost + 3, audit + "I", (*lines, f"{name}:"))
                if name[0] not in out or here < out[name[0]]:
                    out[name[0]] = here
        return out

    for role, text, fault in marked:
        new = {}
        for state, (cost, audit, lines) in best.items():
            new[state] = min(new.get(state, (math.inf,)), (cost + 4, audit + "D", lines))
        if fault not in ("b", "d"):
            for state, (cost, audit, lines) in inserted(best).items():
                for q, name, price, edit in ((role[:1], role, 0, "K"), ("u", "user", 3, "R"), ("a", "assistant", 3, "R")):
                    if q and state + q in ("s", "u", "su", "ua", "au") and (edit == "K" or q != role[:1]):
                        new[q] = min(new.get(q, (math.inf,)), (cost + price + 3 * (fault == "t"), audit + edit, (*lines, f"{name}:{text}")))
        best = new
    cost, audit, lines = min(v for k, v in inserted(best).items() if k in ("", "a"))
    marks = [r[:1] for r, *_ in marked]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
    return [*(sum(f == k for *_, f in marked) for k in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()]


def random_turns(rng, n):
    text = lambda: rng.choice(["Yes.", "No.", "cut off", "", " \t", f"Say {rng.randrange(9)}!", f"open {rng.randrange(50)}"])
    return [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", " "]), text()) for _ in range(n)]


def expected(turns):
    """Of {conv_id: [(turn, role, text)]}."""
    out = {}
    for conv, rows in turns.items():
        known = {t for t, *_ in rows if t is not None}
        out[conv] = [max(known) - min(known) + 1 - len(known) if known else 0, *plain_repair([(r, x) for _, r, x in rows])]
    return out


@pytest.mark.parametrize("piece", [conversations.PIECE, 3])
def test_repair_is_that_of_plain_states(spark, monkeypatch, piece):
    """Also with conversations cut into pieces of three turns, and with repeated turns as one row."""
    monkeypatch.setattr(conversations, "PIECE", piece)
    rng = random.Random(5)
    turns = {c: [(t, *x) for t, x in enumerate(random_turns(rng, rng.randint(1, 14)))] for c in range(250)}
    turns |= {1000: [(t, *x) for t, x in enumerate(random_turns(rng, 400))], 1001: [(t * 7, "user", "the same text") for t in range(50)]}
    rows = [(c, t, r, x, 1, "x", 1, 1) for c, some in turns.items() for t, r, x in some]
    found = {r.conv_id: list(r)[1:] for r in conversations.repair(spark.createDataFrame(rows, TURNS)).collect()}
    assert found == expected(turns)
    thrice = {c: [row for row in some for _ in range(3)] for c, some in turns.items() if c < 60}
    found = {r.conv_id: list(r)[1:] for r in conversations.repair(spark.createDataFrame([(*r[:4], 3, *r[5:]) for r in rows if r[0] < 60], TURNS)).collect()}
    assert found == expected(thrice)


def test_repaired_turns_have_the_digest_and_follow_the_pattern(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(c, t, *x, 1, "x", 1, 1) for c in range(40) for t, x in enumerate(random_turns(rng, 9))], TURNS)
    found = collections.defaultdict(list)
    for r in sorted(conversations.repaired_turns(rows).collect()):
        found[r.conv_id].append(r)
    for r in conversations.repair(rows).collect():
        turns = found[r.conv_id]
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns))
        assert "".join(t.edit for t in turns) == r.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == r.repaired_sha256


def test_damage_and_repair_of_odd_rows(spark):
    """Null ids, turns, roles and texts, an empty role, equal rows, a conversation that loses all rows, columns with other operators' names."""
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(None, None, None, None), (None, 3, "user", None), (7, None, "user", "Hello."), (7, None, "", "odd."), (7, 2, "assistant", "x" * 200_000 + "."), (8, 1, "user", "a."), (8, 1, "user", "a."), (lost, 0, "user", "gone.")]
    df = spark.createDataFrame([(*r, 1, "x", 1, 1) for r in rows], TURNS)
    damaged = collections.defaultdict(list)
    for c, t, r, x in rows:
        word = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{word(c)}:{word(t)}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", word(x)) if fault == 2 else word(x)
        some = damaged[c]
        some += [(t, "user" if fault == 4 else word(r), text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    by_turn = {c: sorted(some, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for c, some in damaged.items()}
    found = {r.conv_id: list(r)[1:] for r in conversations.repair(conversations.damage(df)).collect()}
    assert found == expected(by_turn)
    assert found[lost] == [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]
    assert conversations.repair(conversations.damage(df.limit(0))).count() == 0


# resampling


def plain_resample(rows, target, low=1, high=1, bins=target_resample.BINS, min_words=20, percent=10):
    small = str.maketrans(target_resample.CAPITALS, target_resample.SMALL)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(small))
    runs = lambda t: [zlib.crc32(" ".join(w[i : i + k]).encode()) % bins for w in [words(t)] for k in range(low, high + 1) for i in range(len(w) - k + 1)]
    s, t = collections.Counter(b for _, x in rows for b in runs(x)), collections.Counter(b for x in target for b in runs(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + bins) / ((s[b] + 1) * (t.total() + bins))))
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, runs(x)))
        out.append((i, len(runs(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= min_words))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: len(fit) * percent // 100]
    return collections.Counter((*r[:4], None) for r in [x for x in out if not x[4]] + fit[len(drawn) :]) + collections.Counter((*r[:4], k) for k, r in enumerate(drawn, 1))


@pytest.mark.parametrize("runs", [(1, 1), (1, 3)])
def test_resampling_towards_a_target_is_that_of_plain_counts(spark, runs):
    """Capitals, other scripts, nulls, repeated rows and ids; ties are settled by the smaller id."""
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["Word", "éÉ", "ÀB", "x9", "日本", "ſ", "K", "a-b", "the", "\x00"]) + str(rng.randrange(30)) for _ in range(n))
    texts = [prose(rng.randint(0, 60)) for _ in range(300)] + odd_texts()
    docs = documents(spark, texts)
    again = docs.where("doc_id IN (3, 8, 120)")
    nameless = docs.where("doc_id = 5").selectExpr("CAST(NULL AS bigint) AS doc_id", *docs.columns[1:])
    rows = [*enumerate(texts), (3, texts[3]), (8, texts[8]), (120, texts[120]), (None, texts[5])]
    target = [prose(40), None, "", "the the the"]
    found = target_resample.resample(docs.unionByName(again).unionByName(nameless), spark.createDataFrame(list(enumerate(target)), "item_id long, text string"), *runs)
    assert collections.Counter(tuple(r) for r in found.collect()) == plain_resample(rows, target, *runs)


def test_resampling_of_empty_tables(spark):
    docs, items = documents(spark, ["a b " * 15, None]), spark.createDataFrame([], "item_id long, text string")
    assert target_resample.resample(docs.limit(0), items).count() == 0
    assert collections.Counter(tuple(r) for r in target_resample.resample(docs, items, percent=100).collect()) == plain_resample([(0, "a b " * 15), (1, None)], [], percent=100)


# decontamination: the share of near-threshold windows within the radius of their fingerprints


def test_leaks_near_the_threshold_are_found(spark):
    """Items of 40 to 60 words, each in a document of its own with edits that leave a similarity of 0.80 to 0.85: at least 97 % are found."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(30_000)}"
    shingles = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    items, texts = [], []
    while len(items) < 500:
        item = [word() for _ in range(rng.randint(40, 60))]
        window = list(item)
        for _ in range(rng.randint(1, 5)):  # near the ends an edit spoils fewer shingles
            window[rng.choice([0, 1, 2, 3, -1, -2, -3, -4, rng.randrange(len(item))])] = word()
        a, b = shingles(item), shingles(window)
        if 0.80 <= (a & b).total() / (a | b).total() <= 0.85:
            items.append(" ".join(item))
            texts.append(" ".join([*(word() for _ in range(30)), *window, *(word() for _ in range(30))]))
    docs, bench = documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).select("doc_id", "item_id").collect()}
    assert found <= {(i, i) for i in range(500)}
    assert len(found) >= 0.97 * 500


# pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def texts_for_pieces(table):
    rng = random.Random(1)
    pieces = [p for p in table.strings if p]
    alphabets = ["abcdefghijklmnopqrstuvwxyz ", "etaoin ", "  a", "аеионст ", "中文字日本 ", "éèà üß", "0123456789,. ", "\x00\x01 ab▁😀क्षि", " \n\t\r.x"]
    yield from odd_texts()[1:]
    yield from (" " * k + end for k in range(40) for end in ("", "the", "\n", "▁"))
    yield from ("".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randint(1, 8))) for _ in range(4000))
    yield from ("".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 60))) for _ in range(4000))
    for a in alphabets:
        yield from ("".join(rng.choice(a) for _ in range(rng.randint(1, 60))) for _ in range(500))
    yield from ("<s></s><unk><0x41>", "".join(rng.choice("abc") for _ in range(50_000)), "ﬁ ﷺ ́a　b")


@pytest.mark.parametrize("remember", [piece_bpe.REMEMBER, 50])
def test_pieces_are_those_of_the_library(library, monkeypatch, remember):
    monkeypatch.setattr(piece_bpe, "REMEMBER", remember)
    monkeypatch.setattr(piece_bpe, "PAIRS", 40 * remember)
    table = piece_bpe.PrefixTable(PIECES)
    known = piece_bpe.Words(table)
    for text in texts_for_pieces(table):
        ids = library.encode(text, add_bos=True, add_eos=True)
        packed = table.encode(text, known)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert table.decode(packed) == library.decode(ids).encode()


def test_every_prefix_has_one_last_token(library):
    """The table's claim itself: of the tokens that end at a place just one fits what stands before it."""
    table, rng = piece_bpe.PrefixTable(PIECES), random.Random(2)
    tokens = {s: k for k, s in enumerate(table.strings) if s}
    for _ in range(300):
        text = "▁" + "".join(rng.choice("etaoinshr▁▁") for _ in range(rng.randint(1, 25)))
        last = [-1]
        for end in range(1, len(text) + 1):
            fit = [(t, k) for k in range(1, min(end, 16) + 1) if (t := tokens.get(text[end - k : end])) is not None and (table.compatible(last[end - k], t) if end > k else table.merges(t)[3])]
            assert len(fit) == 1
            last.append(fit[0][0])


def test_piece_query_of_odd_rows(spark, library):
    docs = documents(spark, odd_texts())
    docs = docs.unionByName(docs.where("doc_id IN (4, 10)"))
    found = piece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True, with_text=True).collect()
    assert len(found) == docs.count()
    for r in found:
        text = odd_texts()[r.doc_id] or ""
        ids = library.encode(text, add_bos=True, add_eos=True)
        packed = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, list(r.ids), r.ids_sha256) == (len(ids), ids, hashlib.sha256(packed).hexdigest())
        assert (r.decoded, r.decoded_sha256) == (library.decode(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert piece_bpe.encode_decode(docs.limit(0), PIECES).count() == 0
