"""The ten operators against brute force, round trips and held-out accuracy, with nulls, ties, copies and empty tables."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from turnmill.llm import bpe, common, decontaminate, line_dedup, merkle, ngram_join, quality, sharding, token_counts, toxicity, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Columns whose names clash with those that operators make inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, n int, uid string"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def documents(spark, texts, sources=("s0", "s1", "s2")):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or ""), 7, 0.5, 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    return [None, "", " ", "\n\n", "a", "A a\tA", "tie tie tie tie tie tie", "x" * 300_000, "é" * 7, "\x00\x1c zero ", "the same text twice here now", "the same text twice here now", "line\r\nline  two   wide"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, two rows that repeat an id, and a row without id, source and text."""
    docs = documents(spark, odd_texts())
    return docs.unionByName(docs.where("doc_id IN (4, 10)")).unionByName(spark.createDataFrame([(None, None, None, None, None, None, None, None, None)], SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def pages(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.example/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("html"), "source")


def benchmark(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def every(docs, spark):
    item = benchmark(spark, ["the same text twice here now", "", None, "a"])
    return {
        "token_counts": token_counts.token_counts(docs, PIECES), "ngram_join": ngram_join.connected(docs), "leaks": decontaminate.find_leaks(docs, item), "warc": warc.archive_pages(pages(docs)),
        "quality": quality.resample(docs, labels(spark, [(10, 1, 0)])), "merkle": merkle.fingerprints(docs), "bpe": bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN),
        "sharding": sharding.interleave(docs), "toxicity": toxicity.toxicity_scores(docs, labels(spark, [(10, 1, 1), (None, 0, 1), (5, None, None)])), "line_dedup": line_dedup.dedup_lines(docs),
    }


def test_odd_rows_all_come_back(odd, spark):
    n = odd.count()
    found = {k: v.count() for k, v in every(odd, spark).items()}
    leaks = found.pop("leaks")
    assert found == dict.fromkeys(found, n)
    assert leaks == 4  # items 0 in documents 10 and 11, "a" in 4 and 5


def test_empty_tables_give_no_rows(empty, spark):
    assert set({k: v.count() for k, v in every(empty, spark).items()}.values()) == {0}
    assert decontaminate.find_leaks(documents(spark, ["a b"]), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_longest_match_counts_are_those_of_the_greedy_split():
    rng = random.Random(1)
    for _ in range(2000):
        vocab = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 8))}
        m = token_counts.LongestMatch(sorted(vocab))
        for _ in range(5):
            word, n, i = "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 12))), 0, 0
            while i < len(word):
                k = next((k for k in range(5, 0, -1) if word[i : i + k] in vocab and len(word[i : i + k]) == k), 0)
                n, i = (n + 1, i + k) if k else (n + len(word[i].encode()), i + 1)
            assert m.count(word) == n


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 700])
def test_ngram_join_finds_the_components_of_all_pairs(spark, block, monkeypatch):
    """Near copies in a large group of edited texts, common passages, short texts; also with groups cut into blocks."""
    rng = random.Random(3)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    base, passage = prose(rng, 120, 4000).split(), prose(rng, 60, 4000)
    texts = [prose(rng, rng.randint(1, 60), 6) for _ in range(150)] + odd_texts()
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(99)}"
        texts += [" ".join(copy), f"{prose(rng, rng.randint(5, 70), 4000)} {passage}"]
    want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.connected(documents(spark, texts).repartition(5)).collect()}
    assert got == want
    kept = [r.doc_id for r in ngram_join.one_of_each(documents(spark, texts)).collect()]
    assert sorted(kept) == sorted({c for _, c in want.values()})


def test_one_of_each_component_stays_whatever_its_ids(spark):
    """Null and repeated ids: different texts stay, near copies go, the clean text under a copy's id too stays."""
    rng = random.Random(10)
    base = [prose(rng, 60, 4000) for _ in range(8)]
    near = [f"{b} tail" for b in base]
    pairs = [(None, base[0]), (None, base[1]), (None, near[1]), (None, base[2]), (3, base[3]), (7, near[3]), (7, base[4]), (8, base[5]), (8, base[6]), (None, near[6]), (9, base[7]), (9, base[7]), (None, None), (5, ""), (6, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 0.5, 1, "x") for i, t in pairs], SCHEMA).repartition(3)
    rows = [(r.doc_id, r.text) for r in ngram_join.one_of_each(docs).collect()]
    want = [(None, base[0]), (None, base[2]), (3, base[3]), (7, base[4]), (8, base[5]), (8, base[6]), (9, base[7]), (None, None), (5, ""), (6, " ")]
    assert sorted((r for r in rows if r[1] not in (base[1], near[1])), key=repr) == sorted(want, key=repr)
    assert len(rows) == len(want) + 1  # and one of the two near copies without an id


def test_frequent_tokens_of_one_task_are_known_everywhere(spark):
    """More sets than FREQUENT share their counted tokens: pairs are found by combinations alone."""
    rng = random.Random(9)
    base = prose(rng, 200, 9000).split()
    texts = []
    for _ in range(90):
        copy = list(base)
        copy[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = ngram_join.connected(documents(spark, texts).coalesce(1)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: c for i, (_, c) in brute_components(texts).items()}


def test_leaks_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(5)
    items = [prose(rng, n, 3000) for n in (14, 36, 59, 36, 3)]
    edited = items[2].split()
    edited[30] = "changed"
    cut = " ".join(items[1].split()[:18])
    texts = [f"{prose(rng, 80, 3000)} {items[0].upper()} {prose(rng, 5, 3000)}", items[1], f"{prose(rng, 9, 3000)} {' '.join(edited)} end", f"before {cut} after", prose(rng, 500, 3000), f"x {items[4]} y"]
    got = {(r.doc_id, r.item_id): (r.start, r.inter, r.union) for r in decontaminate.find_leaks(documents(spark, texts), benchmark(spark, items)).collect()}
    assert got == {(0, 0): (80, 10, 10), (1, 1): (0, 32, 32), (2, 2): (9, 50, 60), (5, 4): (1, 1, 1)}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(documents(spark, texts), benchmark(spark, items)).collect()) == [3, 4]


def test_leaks_without_an_id_are_found_and_their_clean_neighbours_stay(spark):
    rng = random.Random(15)
    items = [prose(rng, 20, 3000), prose(rng, 30, 3000)]
    clean = [prose(rng, 50, 3000) for _ in range(2)]
    rows = [(None, f"x {items[0]} y"), (None, f"{items[1]} z"), (None, f"two words {items[1]}"), (None, clean[0]), (4, f"x y {items[0]}"), (4, clean[1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.item_id, r.start, r.inter, r.union) for r in decontaminate.find_leaks(docs, benchmark(spark, items)).collect()]
    assert sorted(got, key=repr) == sorted([(None, 0, 1, 16, 16), (None, 1, 0, 26, 26), (None, 1, 2, 26, 26), (4, 0, 2, 16, 16)], key=repr)
    kept = [(r.doc_id, r.text) for r in decontaminate.drop_leaks(docs, benchmark(spark, items)).collect()]
    assert sorted(kept, key=repr) == sorted([(None, clean[0]), (4, clean[1]), (None, None)], key=repr)


def test_leaks_by_brute_force_over_all_windows(spark):
    """Every window whose bag is similar enough and whose fingerprint is within the radius, from plain loops."""
    rng = random.Random(6)
    items = [prose(rng, 30, 500) for _ in range(6)]
    texts = []
    for _ in range(60):
        w = rng.choice(items).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zz"
        texts.append(f"{prose(rng, 20, 500)} {' '.join(w)} {prose(rng, 20, 500)}")
    bags = lambda w: [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
    want = set()
    for d, t in enumerate(texts):
        w = t.split()
        for k, item in enumerate(items):
            b = bags(item.split())
            for s in range(len(w) - 29):
                a = bags(w[s : s + 30])
                same = sum(min(a.count(x), b.count(x)) for x in set(a))
                if 100 * same >= 80 * (len(a) + len(b) - same):
                    want.add((d, k))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(documents(spark, texts), benchmark(spark, items)).collect()}
    assert got <= want
    assert len(got) >= 0.97 * len(want)


def test_very_long_items_are_found(spark):
    """Items of 100,000 words, one of a single word over and over: the counts of bits don't run over."""
    rng = random.Random(16)
    mixed, same = prose(rng, 100_000, 50_000), " ".join(["tie"] * 100_000)
    texts = [f"before it {mixed} after it", same, f"{same} tie", prose(rng, 200, 50_000), " ".join(mixed.split()[:60_000])]
    got = {(r.doc_id, r.item_id): (r.start, r.inter, r.union) for r in decontaminate.find_leaks(documents(spark, texts), benchmark(spark, [mixed, same])).collect()}
    n = 100_000 - 4
    assert got == {(0, 0): (2, n, n), (1, 1): (0, n, n), (2, 1): (0, n, n)}


CLASHES = "keep_id long, keep_key long, mine_key long, leak_id long, leak_tk long, drop_id long, drop_key long, drop_at long, h1 long, first int, text_key string"


def test_stages_keep_columns_whose_names_they_use(spark):
    """Columns with the names of inner ones come through, null and repeated ids with different texts stay apart."""
    rng = random.Random(17)
    item, line = prose(rng, 30, 3000), "a line of five words"
    texts = [f"{prose(rng, 40, 3000)}\n{line}", f"{prose(rng, 40, 3000)}\n{line}", item, prose(rng, 40, 3000), None, ""]
    rows = [(i, t, f"s{k}", *range(10), "x") for k, (i, t) in enumerate(zip((None, None, 4, 4, 5, 5), texts, strict=True))]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {CLASHES}").repartition(3)
    lines = line_dedup.dedup_lines(docs)
    assert lines.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted((r.text or "").count(line) for r in lines.collect()) == [0, 0, 0, 0, 0, 1]
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    clean = decontaminate.drop_leaks(docs, benchmark(spark, [item]))
    assert clean.columns == docs.columns
    assert sorted(repr(r.text) for r in clean.collect()) == sorted(repr(t) for t in texts if t != item)


def test_simhash_is_the_majority_of_the_bits(spark):
    hashes = [random.Random(k).getrandbits(64) - (1 << 63) for k in range(7)]
    df = spark.createDataFrame([(1, h) for h in hashes] + [(2, hashes[0])], "k int, h long")
    got = {r.k: r.fp % (1 << 64) for r in decontaminate.fingerprints(df, ["k"]).collect()}
    assert got[1] == sum(1 << b for b in range(64) if sum((h >> b) & 1 for h in hashes) * 2 > 7)
    assert got[2] == hashes[0] % (1 << 64)


def test_archives_come_back_in_order(spark, odd):
    rows = warc.archive_pages(pages(odd)).collect()
    by_payload = {}
    for i, t in enumerate(odd_texts()):
        by_payload.setdefault(t or "", []).append(i)
    for r in rows:
        if r.page_id is None:
            assert (r.record_type, r.refers_to) == ("revisit", 0)
            continue
        data = (odd_texts()[r.page_id] or "").encode()
        first = by_payload[data.decode()][0]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
    ordered = sorted(rows, key=lambda r: (r.index_part, r.index_pos))
    assert [r.url_key for r in ordered] == sorted(r.url_key for r in rows)


def test_loser_tree_merges():
    rng = random.Random(0)
    for _ in range(500):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(8))]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)
    assert warc.url_key("https://www.Ab.example.com:443/X?q=1#f") == "com,example,ab)/x?q=1"


def test_resampling_prefers_text_like_the_target(spark):
    rng = random.Random(2)
    texts = [prose(rng, 80, 300) if i % 4 else " ".join(f"junk{rng.randrange(300)}" for _ in range(80)) for i in range(400)]
    marks = [(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)]
    rows = quality.resample(documents(spark, texts), labels(spark, marks), share=0.7).collect()
    assert sum(r.kept for r in rows) == 280
    assert sum(r.kept for r in rows if r.doc_id % 4 == 0) < 10
    keys = spark.createDataFrame([(float(k % 5), k) for k in range(50)], "key double, id long")
    assert quality.kth_largest(keys, 13, most=3) == (3.0, 38)


def test_resampling_is_that_of_plain_counts(spark):
    """Weights, noise and the cut from their definitions, over all n-grams."""
    import xxhash

    rng = random.Random(18)
    texts = [prose(rng, rng.randint(0, 40), 60) for _ in range(70)] + [None, ""]
    marks = [(i, int(i % 3 == 0), 0) for i in range(0, 60, 2)]
    bins, share, seed, wrap = 50, 0.6, 11, 1 << 64
    docs = documents(spark, texts)

    def grams(t):
        h = [xxhash.xxh3_64_intdigest(w.encode()) for w in (t or "").lower().split()]
        pairs = [(a * 0x9E3779B97F4A7C15 + b) % wrap for a, b in zip(h, h[1:], strict=False)]
        return [x % bins for x in h] + [(p ^ (p >> 29)) % bins for p in pairs]

    good, raw, target = {i for i, q, _ in marks if q}, [1] * bins, [1] * bins
    for i, t in enumerate(texts):
        for g in grams(t):
            raw[g] += 1
            target[g] += i in good
    weight = {i: sum(math.log(target[g] / sum(target)) - math.log(raw[g] / sum(raw)) for g in grams(t)) for i, t in enumerate(texts)}
    noise = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h")).collect()}
    key = {i: w - math.log(-math.log((noise[i] % (1 << 52) + 0.5) / (1 << 52))) for i, w in weight.items()}
    rows = {r.doc_id: r for r in quality.resample(docs, labels(spark, marks), share=share, seed=seed, bins=bins).collect()}
    assert all(abs(rows[i].log_weight - w) < 1e-9 for i, w in weight.items())
    assert all(abs(rows[i].gumbel_key - k) < 1e-9 for i, k in key.items())
    assert {i for i, r in rows.items() if r.kept} == set(sorted(key, key=lambda i: (-key[i], -i))[: round(share * len(texts))])


def plain_likeness(a, b):
    """Twice the characters of the spans that both have, over the characters of both; spans end at words by their letters."""
    def spans(text):
        out = collections.Counter()
        for line in text.split("\n"):
            words, span = line.split(" "), []
            for i, w in enumerate(words):
                span.append(w)
                if (sum(ord(c) for c in w[-3:]) + 7 * len(w)) % merkle.SPAN == 0 or i == len(words) - 1:
                    out[" ".join(span)] += len(" ".join(span)) + 1
                    span = []
        return out

    x, y = spans(a), spans(b)
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def test_likeness_is_the_share_of_common_spans(spark):
    rng = random.Random(19)
    texts = [prose(rng, rng.randint(0, 60), 30).replace("w1 ", "w1\n") for _ in range(40)]
    rows = {r.doc_id: r for r in merkle.fingerprints(documents(spark, texts), per_bucket=4).collect()}
    for i, t in enumerate(texts):
        nxt = texts[i - 1]
        n = len(t) // 3
        assert abs(rows[i].near_next - plain_likeness(t, nxt)) < 1e-12
        assert abs(rows[i].near_edited - plain_likeness(t, t[: len(t) - n] + nxt[:n])) < 1e-12


def test_neighbours_of_repeated_and_missing_ids(spark):
    """Rows of one id or without one are parted by their texts: each row's edit comes from the row after it."""
    rng = random.Random(20)
    rows = [(rng.choice([None, 3, 3, 7]), prose(rng, 9)) for _ in range(90)] + [(5, "same text here")] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = []
    for k, r in enumerate(order):
        n = len(r.text) // 3
        want.append((r.doc_id, hashlib.sha256((r.text[: len(r.text) - n] + order[(k + 1) % len(order)].text[:n]).encode()).hexdigest()))
    got = [(r.doc_id, r.edited_sha256) for r in merkle.fingerprints(docs, per_bucket=3).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_fingerprints_follow_the_neighbour(spark, odd):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 90)).replace("w1 ", "w1\n") for _ in range(57)] + odd_texts()
    rows = {r.doc_id: r for r in merkle.fingerprints(documents(spark, texts).repartition(7), per_bucket=9).collect()}
    roots = {}
    for i, t in enumerate(texts):
        t = t or ""
        nxt = texts[(i - 1) % len(texts)] or ""
        n = len(t) // 3
        changed = t[: len(t) - n] + nxt[:n]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert roots.setdefault(r.fingerprint, t) == t
        assert (r.fingerprint == r.edited_fingerprint) == (changed == t)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    long = [r for r in rows.values() if 300 < r.n_chars < 1000]
    assert np.mean([r.near_edited for r in long]) > 0.5 > 0.2 > np.mean([r.near_next for r in long])
    a, b = merkle.tree("one\ntwo\nthree"), merkle.tree("one\n2\nthree")
    assert a.differing(b) == [1]
    assert a.differing(a) == []


def test_bpe_is_that_of_the_rank_library(spark, odd):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    letters = " \t\n\r\x0b\x1c\x85\xa0 ab'sS'12½é漢\U0001f600.,!<|endoftext|>﻿\x00　"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [t for t in odd_texts() if len(t or "") < 9999]
    for r in bpe.encode_decode(documents(spark, texts), RANKS, public_tokenizers.PATTERN, with_ids=True, with_text=True).collect():
        t = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), t)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_of_very_long_words(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(21)
    texts = ["x" * 60_000, "".join(rng.choice("abcdeé漢") for _ in range(60_000)), " " * 5_000 + "!" * 5_000, "ab " * 20_000]
    for r in bpe.encode_decode(documents(spark, texts), RANKS, public_tokenizers.PATTERN).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_remembered_words_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    codec, known = bpe.Codec(RANKS, public_tokenizers.PATTERN), {}
    rng = random.Random(22)
    for _ in range(50):
        t = prose(rng, 12, 9) + "y" * rng.choice([0, 99])
        assert codec.encode(t, known) == codec.encode(t, {})
        assert all(len(w) <= bpe.LONGEST for w in known)


def test_token_counts_of_the_real_vocabulary(spark):
    """The query over a whole table against a greedy split that looks every piece up."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    longest, known = max(map(len, pieces)), {}

    def count(word):
        n = i = 0
        while i < len(word):
            k = next((k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in pieces), 0)
            n, i = (n + 1, i + k) if k else (n + len(word[i].encode()), i + 1)
        return n

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {}
    for r in docs.collect():
        words = (r.text or "").split()
        want[r.doc_id] = (len(words), sum(known[w] if w in known else known.setdefault(w, count("▁" + w)) for w in words))
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.token_counts(docs, PIECES).collect()} == want


@pytest.mark.parametrize("n", [5, 16, 500])
def test_shards_are_even_and_match_the_mixture(spark, n):
    rng = random.Random(8)
    texts = [prose(rng, 3) for _ in range(n)]
    docs = documents(spark, texts, sources=("hot", "hot", "b", None, "hot", "c"))
    rows = sharding.interleave(docs, per_bucket=16).collect()
    sizes = {k: sorted(r.slot for r in rows if r.shard == k) for k in range(16)}
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(v == list(range(len(v))) for v in sizes.values())
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in rows)
    for s in ("hot", "b", None, "c"):
        each = [sum(r.source == s and r.shard == k for r in rows) for k in range(16)]
        assert max(each) - min(each) <= 3
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.interleave(docs.repartition(3), per_bucket=1000).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(11)
    bad = [f"insult{k}" for k in range(8)]
    texts, marks = [], []
    for i in range(1200):
        toxic = rng.random() < 0.15
        words = prose(rng, rng.randint(20, 90)).split()
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        if i % 2:
            marks.append((i, 1, int(toxic)))
    truth = {i for i, t in enumerate(texts) if "insult" in t}
    rows = toxicity.toxicity_scores(documents(spark, texts), labels(spark, marks)).collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == (r.doc_id in truth) for r in out]) > 0.97
    kept = {r.doc_id for r in toxicity.drop_toxic(documents(spark, texts), labels(spark, marks)).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}


@pytest.mark.parametrize(("n", "every_nth"), [(12_000, 200), (40_000, 1_000)])
def test_rare_toxic_class_is_learnt(spark, n, every_nth):
    """0.5 % and 0.1 % toxic rows: the penalty and the choice of words follow the prior."""
    rng = random.Random(12)
    bad = [f"insult{k}" for k in range(30)]
    texts = [f"{prose(rng, 12)} {' '.join(rng.sample(bad, 4)) if i % every_nth == 7 else ''}" for i in range(n)]
    truth = {i for i in range(n) if i % every_nth == 7}
    rows = toxicity.toxicity_scores(documents(spark, texts), labels(spark, [(i, 1, int(i in truth)) for i in range(n)])).collect()
    caught = {r.doc_id for r in rows if r.predicted}
    assert len(caught & truth) >= 0.9 * len(truth)
    assert len(caught - truth) <= 0.1 * len(truth)
    assert {r.doc_id for r in rows if r.held_out and r.predicted} & truth


@pytest.mark.parametrize("max_toxic", [60, 6_000])
def test_scores_are_shares_whatever_the_number_of_toxic_rows(spark, max_toxic):
    """A word of 80 % of the toxic and 20 % of the clean documents at a prior of 0.3 means 24 of 38."""
    rng = random.Random(13)
    toxic = [rng.random() < 0.3 for _ in range(4000)]
    texts = [f"plain {'maybe' if rng.random() < (0.8 if t else 0.2) else 'text'}" for t in toxic]
    model = toxicity.train(documents(spark, texts), labels(spark, [(i, 1, int(t)) for i, t in enumerate(toxic)]), max_toxic=max_toxic)
    assert abs(model.score("plain maybe") - 24 / 38) < 0.12


def plain_nnpu(toxic, other, n_words, prior, prior_error, epochs, rate, l1, l2):
    """The learner from its definition: dense rows, one word and one row at a time."""
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    loss = lambda z: max(z, 0) + math.log1p(math.exp(-abs(z)))
    mean = lambda x: sum(x) / len(x)
    spread = lambda x: sum((a - mean(x)) ** 2 for a in x) / len(x)
    w, m, v, best = [0.0] * n_words, [0.0] * n_words, [0.0] * n_words, (math.inf, None, None)
    for t in range(1, epochs + 1):
        s_p, s_u = ([sum(w[k] for k in row) for row in side] for side in (toxic, other))
        low, high = -60.0, 60.0
        for _ in range(100):
            b = (low + high) / 2
            low, high = (b, high) if mean([sigmoid(s + b) for s in s_u]) < prior else (low, b)
        lost_p, lost_u = [loss(s + b) for s in s_p], [loss(s + b) for s in s_u]
        negative = mean(lost_u) - prior * mean(lost_p)
        error = math.sqrt(spread(lost_u) / len(other) + prior**2 * spread(lost_p) / len(toxic) + (mean(lost_p) * prior_error) ** 2)
        sound = negative >= -toxicity.ERRORS * error
        risk = prior * mean([loss(-s - b) for s in s_p]) + negative + prior * (l1 * sum(w) + l2 / 2 * sum(x * x for x in w))
        if sound and risk < best[0]:
            best = (risk, list(w), b)
        for k in range(n_words):
            rise = sum(sigmoid(s + b) for row, s in zip(other, s_u, strict=True) if k in row) / len(other) - prior * sum(sigmoid(s + b) for row, s in zip(toxic, s_p, strict=True) if k in row) / len(toxic)
            g = rise + prior * sum(sigmoid(s + b) - 1 for row, s in zip(toxic, s_p, strict=True) if k in row) / len(toxic) + prior * (l1 + l2 * w[k]) if sound else -rise
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = min(max(w[k] - rate * m[k] / (1 - 0.9**t) / (math.sqrt(v[k] / (1 - 0.999**t)) + 1e-8 * prior), 0), toxicity.MOST_ODDS - math.log(prior / (1 - prior)))
    return best[1], best[2]


def test_learner_is_that_of_its_plain_form():
    rng = random.Random(14)
    row = lambda p: sorted({k for k in range(6) if rng.random() < p[k]})
    toxic = [row([0.7, 0.5, 0.1, 0.3, 0.0, 0.4]) for _ in range(30)]
    other = [row([0.7, 0.5, 0.1, 0.3, 0.0, 0.4] if rng.random() < 0.1 else [0.0, 0.05, 0.1, 0.3, 0.2, 0.0]) for _ in range(150)]
    side = lambda rows: (np.array([k for r in rows for k in r], np.int64), np.cumsum([0, *map(len, rows)]))
    for prior, error, l1, l2 in ((0.12, 0.02, 0.0, 1e-3), (0.3, 0.0, 9e-3, 0.0)):
        w, b = toxicity.nnpu(side(toxic), side(other), 6, prior, error, epochs=60, l1=l1, l2=l2)
        want_w, want_b = plain_nnpu(toxic, other, 6, prior, error, 60, 0.1, l1, l2)
        assert np.allclose(w, want_w, atol=1e-6)
        assert abs(b - want_b) < 1e-6
        assert b <= math.log(prior / (1 - prior))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ten_toxic_rows_leave_clean_documents_alone(spark, seed):
    """Few toxic rows: the empty text scores the prior at most, and clean rows aren't flagged for words met by chance."""
    rng = random.Random(seed)
    bad = [f"insult{k}" for k in range(6)]
    texts = [f"{prose(rng, rng.randint(5, 300), 3000)} {' '.join(rng.sample(bad, 3)) if i % 10 == 3 else ''}" for i in range(240)]
    marks = [(i, 1, int(i % 10 == 3)) for i in range(124)]
    docs = documents(spark, [*texts, "", None])
    rows = toxicity.toxicity_scores(docs, labels(spark, marks)).collect()
    clean = [r for r in rows if r.doc_id % 10 != 3 or r.doc_id >= 240]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert [r.predicted for r in rows if r.doc_id in (240, 241)] == [0, 0]
    assert sum(r.predicted for r in rows if r.doc_id % 10 == 3 and r.doc_id < 240) >= 18
    assert toxicity.drop_toxic(docs, labels(spark, marks)).columns == docs.columns


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_clean_rows_of_the_tables_stay(spark, sf):
    docs, marks = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_scores(docs, marks).join(marks, "doc_id").where("toxic = 0").collect()
    for side in (True, False):
        of_side = [r.predicted for r in rows if r.held_out == side]
        assert sum(of_side) <= 0.05 * len(of_side)


def test_held_out_labels_are_never_learnt(spark):
    texts = [f"w{i} w{i % 7} badword" if i % 3 == 0 else f"w{i} w{i % 7} fine" for i in range(300)]
    marks = [(i, 1, int(i % 3 == 0)) for i in range(300)]
    flipped = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in marks]
    docs = documents(spark, texts)
    assert toxicity.train(docs, labels(spark, marks)) == toxicity.train(docs, labels(spark, flipped))


def test_lines_of_several_sites_stay_once(spark):
    texts = ["keep this only line\ncopied over many sites here\nshort one", "copied over  many sites here\nanother own line of text", "copied over many sites here", None, "short one\nlocal line that one site has\nlocal line that one site has"]
    rows = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert rows == {0: (texts[0], 3, 0), 1: ("another own line of text", 2, 1), 2: ("", 1, 1), 3: (None, 0, 0), 4: (texts[4], 3, 0)}


def test_spread_near_the_threshold_is_exact(spark):
    rows = [(f"line number {k} with {n} sites", s) for k, n in enumerate([1, 2, 18, 19, 20, 21, 22, 40, 300]) for s in range(n)]
    docs = documents(spark, [r[0] for r in rows]).drop("source").join(spark.createDataFrame([(i, f"site{r[1]}") for i, r in enumerate(rows)], "doc_id long, source string"), "doc_id")
    found = line_dedup.site_spread(line_dedup.lines_of(docs, 4), 20)
    assert found.count() == 5


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
