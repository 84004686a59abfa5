"""Operator 2: n-gram Jaccard join by token-combination prefixes, and its connected documents."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import components, free_names, saved, small_or_shuffled

WORDS, LEAST = 5, 80
#: Tokens (shingles) whose hash is in this first share of the hash space have their documents counted and stand
#: first in the global order; those of more than FREQUENT documents, and all uncounted ones, enter as combinations.
COUNTED, FREQUENT = 0.3, 16
#: Shingles of one block of a group; larger groups are compared block against block.
BLOCK = 500_000
#: Sets that one set links at once before they leave the index together.
MANY = 32
REMEMBER = 200_000
M1, M2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby numbers become unrelated."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words

        class Hashes(dict):
            def __missing__(self, word: bytes) -> int:
                h = self[word] = xxhash.xxh3_64_intdigest(word)
                return h

        self.known = Hashes()

    def of(self, text: str) -> np.ndarray:
        # bytes: lower() changes A-Z alone, split() cuts at x20 and x09 to x0D alone
        words = text.encode("utf-8", "surrogatepass").lower().split()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        if len(self.known) > REMEMBER:
            self.known.clear()
        k = min(self.words, len(h))
        if not k:
            return h
        total = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            total = mixed(total * STEP + h[i : len(h) - k + 1 + i])
        return np.unique(total)


def longs(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tk): tk, the hash of the text, names a row together with its id, which may be null or repeat."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tk"))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, n, cid, low, hot, uid): each row's shingle count, the id of its set, and its counted tokens.

    A set that the same task has met before gets no tokens again: a copy is counted and searched once. hot has the
    tokens that more than FREQUENT sets of one task hold: they are frequent for sure, so a task sends a token's
    documents on only while they are few, and a very common token meets in no task. A task keeps its tokens, 2.4
    bytes a word of its input split.
    """
    top = np.uint64(int(COUNTED * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met = Shingler(), set()
        rows: list[tuple] = []
        lows: list[np.ndarray] = []
        for batch in batches:
            for doc_id, text, tk in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                s = shingler.of(text.as_py())
                cid = set_id(s)
                again = cid in met or len(s) < 2
                met.add(cid)
                rows.append((doc_id, tk, len(s), cid, again))
                lows.append(s[:0] if again else s[: np.searchsorted(s, top)])
        every, count = np.unique(np.concatenate(lows) if lows else np.array([], np.uint64), return_counts=True)
        common = every[count > FREQUENT]
        for i in range(0, len(rows), 2000):
            part, parts = rows[i : i + 2000], lows[i : i + 2000]
            hot = [np.isin(x, common, kind="sort") if len(common) else np.zeros(len(x), bool) for x in parts]
            yield pa.RecordBatch.from_arrays([
                *[pa.array([r[k] for r in part], pa.int64()) for k in range(4)],
                pa.array([None if r[4] else longs(x[~h]) for r, x, h in zip(part, parts, hot, strict=True)], pa.list_(pa.int64())),
                pa.array([longs(x[h]) for x, h in zip(parts, hot, strict=True)], pa.list_(pa.int64())),
            ], ["doc_id", "tk", "n", "cid", "low", "hot"])

    return texts_of(docs).mapInArrow(run, "doc_id long, tk long, n long, cid long, low array<long>, hot array<long>").withColumn("uid", F.monotonically_increasing_id())


def shared_tokens(rows: DataFrame) -> DataFrame:
    """(uid, token, often): the counted tokens of more than one set, and whether they are frequent."""
    tokens = rows.where("low IS NOT NULL").select("uid", F.explode("low").alias("token"))
    marks = rows.select(F.explode("hot").alias("token")).distinct().select(F.lit(None).cast("long").alias("uid"), "token")

    def settled(uid: np.ndarray, key: np.ndarray, is_row: np.ndarray, sure: bool = False) -> pa.RecordBatch:
        """The rows of whole groups, of which ``sure`` ones are frequent whatever is seen of them here."""
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        often = np.add.reduceat(~is_row, first) > 0 if len(first) else np.zeros(0, bool)
        at = np.flatnonzero(is_row & np.repeat((count > 1) | sure, count))
        return pa.RecordBatch.from_arrays([pa.array(uid[at]), pa.array(key[at]), pa.array(np.repeat(often | (count > FREQUENT) | sure, count)[at])], ["uid", "token", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the sorted rows only those of the last token wait for the next batch, and only while it may be rare."""
        wait, hot = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)), None
        for batch in batches:
            is_row = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            rows = tuple(np.concatenate(x) for x in zip(wait, (batch.column(0).fill_null(-1).to_numpy(), batch.column(1).to_numpy(), is_row), strict=True))
            if not len(rows[1]):
                continue
            goes_on = np.searchsorted(rows[1], hot, "right") if hot is not None else 0
            yield settled(*(x[:goes_on] for x in rows), sure=True)
            rows = tuple(x[goes_on:] for x in rows)
            if not len(rows[1]):
                continue
            cut = np.searchsorted(rows[1], rows[1][-1], "left")
            yield settled(*(x[:cut] for x in rows))
            wait, hot = tuple(x[cut:] for x in rows), None
            if len(wait[1]) > FREQUENT:
                yield settled(*wait)
                wait, hot = tuple(x[:0] for x in wait), rows[1][-1]
        yield settled(*wait)

    return tokens.unionByName(marks).repartition("token").sortWithinPartitions("token").mapInArrow(run, "uid long, token long, often boolean")


def survivors(rows: DataFrame) -> DataFrame:
    """(cid, doc_id, tk, mid, often): the sets that may have a partner, with their counted tokens of several documents.

    In the global order the tokens of one document come first. A set with more of them than it may miss of a
    partner, n - ceil(0.8 n), has no partner and is left out here.
    """
    shared = shared_tokens(rows).groupBy("uid").agg(F.collect_list(F.when(~F.col("often"), F.col("token"))).alias("mid"), F.collect_list(F.when(F.col("often"), F.col("token"))).alias("often"))
    own = rows.where("low IS NOT NULL").select("uid", "cid", "doc_id", "tk", "n", F.size("low").alias("n_low"), "hot")
    may_miss = F.col("n") - F.floor((F.col("n") * LEAST + 99) / 100)
    empty = F.array().cast("array<long>")
    alive = own.join(shared, "uid", "left").withColumns({"mid": F.coalesce("mid", empty), "often": F.coalesce("often", empty)})
    alive = alive.where(F.col("n_low") - F.size("mid") - F.size("often") < may_miss + 1)
    first = F.min_by(F.struct("doc_id", "tk", "mid", F.concat("often", "hot").alias("often")), "uid")
    return alive.groupBy("cid").agg(first.alias("x")).select("cid", "x.doc_id", "x.tk", "x.mid", "x.often")


def signatures(s: np.ndarray, mid: np.ndarray, often: np.ndarray, counted: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens, combinations, tokens after them): keys of which any two sets with Jaccard similarity of 0.8 share one.

    The order is: tokens of one document, rarer counted tokens, frequent counted ones, the uncounted, each by
    hash. The prefix is extended until the tokens that a partner must lack exceed those it may lack: a single
    token of the first two classes must be lacking whole, of the c tokens of a part of the others all but one.
    Rarer tokens are indexed by themselves, the others by pairs within their part. The number of parts hangs on
    the size's band, and a set near the upper end of its band is indexed for the next one too.
    """
    n, own = len(s), counted - len(mid) - len(often)
    need = n - -(-n * LEAST // 100) + 1 - own
    mid = np.sort(mid)
    if need <= 0 or n < 2:
        return s[:0], s[:0], n
    if len(mid) >= need:
        return mid[:need], s[:0], n - own - need
    need -= len(mid)
    rest = np.concatenate([np.sort(often), s[counted:]])
    keys = [s[:0]]
    for band in {int(math.log2(n)), int(math.log2(n * 100 // LEAST))}:
        parts = np.uint64(1 << max(0, band - 4))
        part = (rest & (parts - np.uint64(1))).astype(np.int64)
        seen, score, end = set(), 0, 0
        for p in part.tolist():
            if score >= need:
                break
            score += p in seen
            seen.add(p)
            end += 1
        order = np.argsort(part[:end], kind="stable")
        tokens, at = rest[:end][order], part[:end][order]
        cuts = np.flatnonzero(np.diff(at)) + 1
        for group in np.split(tokens, cuts):
            if len(group) > 1:
                i, j = np.triu_indices(len(group), 1)
                a, b = np.minimum(group[i], group[j]), np.maximum(group[i], group[j])
                keys.append(mixed(mixed(a + np.uint64(band + 1)) * STEP + b))
    return mid, np.unique(np.concatenate(keys)), n - own - len(mid)


def those_of(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The texts of ``named`` (cid, doc_id, tk, ...): ids and text hashes choose the rows, so that only chosen texts are moved."""
    ids = small_or_shuffled(named.select(F.col("doc_id").alias("id"), F.col("tk").alias("id_tk")).distinct())
    named = named.withColumnsRenamed({"doc_id": "of", "tk": "of_tk"})
    chosen = texts_of(docs).join(ids, (F.col("tk") == F.col("id_tk")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    return chosen.join(named, (F.col("tk") == F.col("of_tk")) & F.col("doc_id").eqNullSafe(F.col("of"))).drop("doc_id", "of_tk")


def indexed(docs: DataFrame, alive: DataFrame) -> DataFrame:
    """(cid, doc_id, tk, n, rest, single, pairs) of the surviving sets, from their texts."""
    top = np.uint64(int(COUNTED * 2**64))
    schema = "cid long, doc_id long, tk long, n long, rest long, single array<long>, pairs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met = Shingler(), set()
        for batch in batches:
            out: list[tuple] = []
            for text, cid, doc_id, tk, mid, often in zip(*batch.columns, strict=True):
                cid = cid.as_py()
                s = shingler.of(text.as_py())
                if cid not in met and set_id(s) == cid:
                    met.add(cid)
                    mid, often = (np.array(x.as_py(), np.int64).view(np.uint64) for x in (mid, often))
                    single, pairs, rest = signatures(s, mid, often, int(np.searchsorted(s, top)))
                    out.append((cid, doc_id.as_py(), tk.as_py(), len(s), rest, longs(single), longs(pairs)))
            kinds = [*[pa.int64()] * 5, *[pa.list_(pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["cid", "doc_id", "tk", "n", "rest", "single", "pairs"])

    return those_of(docs, alive).select("text", "cid", F.col("of").alias("doc_id"), "tk", "mid", "often").mapInArrow(run, schema)


def candidates(index: DataFrame) -> DataFrame:
    """(a, b): edges that connect any two sets which may be similar enough.

    Two sets that share rarer tokens are met pair by pair: at most FREQUENT sets hold such a token. What they share
    up to the end of one's indexed tokens, and all that is left of it, bounds their overlap; pairs that can't reach
    4/9 of both sizes, which is a similarity of 0.8, are dropped. Sets that share a combination are joined by a
    star to the smallest, whatever their number.
    """
    met = index.select("cid", F.explode("single").alias("token")).groupBy("token").agg(F.array_sort(F.collect_set("cid")).alias("ids")).where(F.size("ids") > 1)
    later = lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = met.select(F.inline(F.flatten(F.transform("ids", later)))).groupBy("a", "b").agg(F.count("*").alias("common"))
    sizes = small_or_shuffled(index.select("cid", "n", "rest"))
    side = lambda c: sizes.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("rest").alias(f"rest_{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where("9 * (common + greatest(rest_a, rest_b)) >= 4 * (n_a + n_b)")
    pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * LEAST)
    keys = index.select("cid", F.explode("pairs").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("cid").alias("hub"), F.count("*").alias("m")).where("m > 1").drop("m")
    stars = keys.join(hubs, "key").where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct()
    return pairs.select("a", "b").unionByName(stars)


def members(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(root, blocks, cid, s): the shingle sets of ``groups`` (cid, doc_id, tk, root, blocks), from their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met = Shingler(), set()
        for batch in batches:
            out: list[tuple] = []
            for text, cid, root, blocks in zip(*batch.columns, strict=True):
                s = shingler.of(text.as_py())
                if cid.as_py() not in met and set_id(s) == cid.as_py():
                    met.add(cid.as_py())
                    out.append((root.as_py(), blocks.as_py(), cid.as_py(), longs(s)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["root", "blocks", "cid", "s"])

    return those_of(docs, groups).select("text", "cid", "root", "blocks").mapInArrow(run, "root long, blocks long, cid long, s array<long>")


def compare(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None) -> list[tuple[int, int]]:
    """(set, root) that join the sets of ``left`` (with those of ``right``) into the same components as all links do.

    An index from shingles to sets counts each set's overlaps with all others at once. Where a set links ``MANY``
    others, these need no links among each other: each is compared with the sets outside their component alone,
    and all of them leave the index. So a group of near copies costs time with its size, not with its square.
    """
    sets = left + (right or [])
    n_left, sizes = len(left), np.array([len(s) for _, s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, token = np.unique(np.concatenate([s for _, s in sets]), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    by_token = np.argsort(token, kind="stable")
    parent = list(range(len(sets)))
    there = np.ones(len(sets), bool)  # in the index

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def index(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = by_token[of[owner[by_token]]]
        return owner[order], np.concatenate([[0], np.cumsum(np.bincount(token[order], minlength=len(values)))])

    def like(i: int, posts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The sets of the index that link with set i."""
        mine = token[begin[i] : begin[i + 1]]
        first, count = starts[mine], starts[mine + 1] - starts[mine]
        ends = np.cumsum(count)
        overlap = np.bincount(posts[np.arange(ends[-1]) + np.repeat(first - ends + count, count)], minlength=len(sets))
        found = (overlap > 0) & (100 * overlap >= LEAST * (sizes[i] + sizes - overlap))
        found[i] = False
        return found

    def join(i: int, others: np.ndarray) -> None:
        for j in np.flatnonzero(others).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a

    full = index(there)
    for i in range(len(sets) if right is None else n_left):
        if not there[i]:
            continue
        met = like(i, *full)
        join(i, met)
        if met.sum() >= MANY:
            rest = there & ~met
            rest[i] = False
            if rest.any():
                outside = index(rest)
                for j in np.flatnonzero(met).tolist():
                    join(j, like(j, *outside))
            there, full = rest, outside if rest.any() else full
        else:
            there[i] = False  # compared with all; it may stay in ``full`` until that is next made
    least: dict[int, int] = {}
    for i in range(len(sets)):
        least[root(i)] = min(sets[i][0], least.get(root(i), sets[i][0]))
    return [(cid, least[root(i)]) for i, (cid, _) in enumerate(sets) if root(i) != i or least[root(i)] != cid]


def linked(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(node, root): the components of the sets with links; a set without links is absent or its own root.

    Sets that candidates connect, directly or through others, form a group. A group is compared whole, large ones
    block against block, so no pair of candidates is missed. A group of one block is settled where it is
    compared; the blocks of larger ones are joined by their links.
    """
    grouped = small_or_shuffled(saved(components(candidates(index)).withColumnRenamed("node", "cid"), "grouped"))
    groups = saved(index.select("cid", "doc_id", "tk", "n").join(grouped, "cid"), "groups")
    sizes = saved(groups.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks")), "sizes")
    groups = groups.join(small_or_shuffled(sizes), "root").select("cid", "doc_id", "tk", "root", "blocks")
    found = members(docs, groups).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    meet = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = found.select("root", "blocks", "cid", "s", "block", meet).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "s", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, alone = None, ([], []), True

        def done() -> pa.RecordBatch:
            left, right = sides
            found = compare(left, None if now[1] == now[2] else right) if len(left) + len(right) > 1 and left else []
            return pa.RecordBatch.from_arrays([*[pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], pa.array([alone] * len(found), pa.bool_())], ["a", "b", "last"])

        for batch in batches:
            flat = batch.column(5).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            bounds = np.concatenate([[0], np.cumsum(batch.column(5).value_lengths().to_numpy(zero_copy_only=False))])
            for k, (root, i, j, block, cid, blocks) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 6)), strict=True)):
                if (root, i, j) != now:
                    if now is not None:
                        yield done()
                    now, sides, alone = (root, i, j), ([], []), blocks == 1
                sides[block != i].append((cid, flat[bounds[k] : bounds[k + 1]]))
        if now is not None:
            yield done()

    pairs = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "a long, b long, last boolean")
    pairs = saved(pairs, "links")
    settled = pairs.where("last").select(F.col("a").alias("node"), F.col("b").alias("root"))
    return settled.unionByName(components(pairs.where("NOT last")))


def connected(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, text_key, root_id): every row with its component of the 0.8 join.

    A text's set is its distinct 5-word shingles (A-Z lower-cased; words between blanks x20 and x09 to x0D), of
    fewer words the whole sequence. Documents link when 100 * intersection >= 80 * union; component_id is the
    smallest doc_id that links reach, the document's own included. Copies share a class_id and are joined once.
    root_id is a component's own key, which no other one has, whatever ids its members have; it is null for texts
    without words. text_key is the text's hash.

    Nulls: a null or wordless text has 0 shingles and no link; a null doc_id never is a component's id unless no
    member has one. Rows that repeat an id are nodes of their own and may lie in different components. Other
    columns are ignored; an empty table gives no rows. All pairs of similar sets are found, whatever a token's or
    group's size: no limit on partners, candidates or group size.
    """
    rows = saved(described(docs), "sets")
    alive = saved(survivors(rows), "alive")
    index = saved(indexed(docs, alive), "index")
    found = small_or_shuffled(saved(linked(docs, index).withColumnRenamed("node", "cid"), "components"))
    classes = saved(rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least")).join(found, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "classes")
    label = saved(classes.groupBy("root").agg(F.min("least").alias("label"), F.count("*").alias("k")).where("k > 1").drop("k"), "labels")
    classes = classes.join(small_or_shuffled(label), "root", "left").select("cid", "root", F.coalesce("label", "least").alias("label"))
    own = rows.select("doc_id", "tk", F.col("n").alias("n_shingles"), "cid")
    out = own.join(classes, "cid", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id")).alias("component_id"), F.col("cid").alias("class_id"), F.col("tk").alias("text_key"), F.col("root").alias("root_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest (doc_id, text hash), null ids last.

    Components are told apart by their own key, not by ids: different texts under one id, or without an id, stay
    if they lie in different components. Identical rows with words are one component; rows without words have no
    partner and all stay.
    """
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    keep_id, keep_key, mine_key = free_names(docs, "keep_id", "keep_key", "mine_key")
    keep = connected(docs).where("n_shingles > 0").groupBy("root_id").agg(order.alias("x")).select(F.col("x.doc_id").alias(keep_id), F.col("x.text_key").alias(keep_key))
    text = F.coalesce("text", F.lit(""))
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    mine = docs.where(worded).withColumn(mine_key, F.xxhash64(text))
    mine = mine.join(keep, (F.col(mine_key) == F.col(keep_key)) & F.col("doc_id").eqNullSafe(F.col(keep_id)), "left_semi")
    return mine.dropDuplicates(["doc_id", mine_key]).drop(mine_key).unionByName(docs.where(~worded))


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])) END AS s FROM words),
tok AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS t FROM sets),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM tok a JOIN tok b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter WHERE 100 * i >= 80 * (na + nb - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id
FROM sets s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON s.doc_id = m.a
"""
