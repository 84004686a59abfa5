"""Operator 3 [native]: documents that hold a benchmark item, by SimHash windows, Hamming blocks and exact shingle bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import free_names, saved, small_or_shuffled

#: Words of a shingle, the least similarity in hundredths, bits of a fingerprint, of a block, and the radius:
#: of 8 blocks of 8 bits, two fingerprints that differ in 15 bits share one to within one bit.
WORDS, LEAST, BLOCKS, WIDTH = 5, 80, 8, 8
RADIUS = 2 * BLOCKS - 1
#: Two counts of bits in one sum, of 32 bits each.
LANE = 0x0000000100000001


def words_of(text: str) -> Column:
    """Lower-cased words between runs of the blanks x20 and x09 to x0D."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(words: str, k: Column | int) -> Column:
    """Hashes of the runs of ``k`` words, in order."""
    if isinstance(k, int):
        one = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
        return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), one)).otherwise(F.array().cast("array<long>"))
    cases = F.when(k == 1, shingles(words, 1))
    for n in range(2, WORDS + 1):
        cases = cases.when(k == n, shingles(words, n))
    return cases


def fingerprints(rows: DataFrame, keys: list[str], h: str = "h") -> DataFrame:
    """(keys, n, fp): the SimHash of the bag of hashes ``h`` of each key.

    A bit is set where more than half of the hashes have it. 32 sums hold the 64 counts in lanes of 32 bits, enough
    for two thousand million hashes of a key.
    """
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned(h, j).bitwiseAND(LANE)).alias(f"s{j}") for j in range(32)])
    fp = F.lit(0).cast("long")
    for j in range(32):
        for lane in range(2):
            on = F.shiftrightunsigned(f"s{j}", 32 * lane).bitwiseAND(0xFFFFFFFF) * 2 > F.col("n")
            bit = 1 << (32 * lane + j)
            fp = fp.bitwiseOR(F.when(on, F.lit(bit - (1 << 64) if bit >> 63 else bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, "n", fp.alias("fp"))


def block_values(fp: str) -> Column:
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fp, WIDTH * b).bitwiseAND((1 << WIDTH) - 1).alias("value")) for b in range(BLOCKS)])


def find_leaks(docs: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, start, n_words, inter, union): the best window of each document and benchmark item that leaks.

    A window has as many words as the item (the whole document if that is shorter). It leaks the item if their
    bags of 5-word shingles (of whole sequences, for items of fewer words) have 100 * intersection >= 80 * union
    and their 64-bit SimHashes are within 15 bits. Windows are fingerprinted wherever they share a shingle with an
    item of their size, which any such window must; fingerprints meet in one of eight blocks, to within a bit,
    so no pair within the radius is lost; the bags then decide. start counts words from 0; of equally good windows
    the first is given.

    Nulls: documents or items without words leak nothing. A null doc_id is a document of its own for each text; rows
    that repeat an id are searched one by one and reported once for each id. Items with one id are one item for each
    text. Other columns are ignored; empty tables give no rows. Only built-in expressions run on the rows.
    """
    leaks = window_leaks(docs, items, least)
    best = F.max_by(F.struct("start", "len", "inter", "union"), F.struct(F.col("inter") / F.col("union"), -F.col("start")))
    leaks = leaks.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("tk")).alias("own"), "item_id").agg(best.alias("b"))
    return leaks.select("doc_id", "item_id", F.col("b.start").alias("start"), F.col("b.len").alias("n_words"), F.col("b.inter").alias("inter"), F.col("b.union").alias("union"))


def window_leaks(docs: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, tk, item_id, start, len, inter, union) of all windows that leak; tk is the hash of the text."""
    its = items.select("item_id", words_of("text").alias("w")).where(F.size("w") > 0).distinct().select(F.monotonically_increasing_id().alias("item"), "item_id", "w", F.size("w").alias("len"))
    its = saved(its.withColumn("k", F.least("len", F.lit(WORDS))), "items")
    sizes = sorted(r.k for r in its.select("k").distinct().collect())  # 5 values at most
    bags = its.select("item", "item_id", "len", "k", F.explode(shingles("w", F.col("k"))).alias("h"))
    marks = bags.select("k", "h", "len").distinct()

    texts = docs.select("doc_id", F.xxhash64("text").alias("tk"), words_of("text").alias("w"))
    parts = [texts.select("doc_id", "tk", F.size("w").alias("words"), F.lit(k).alias("k"), F.posexplode(shingles("w", k)).alias("p", "h")) for k in sizes]
    if not parts:
        return spark_empty(docs)
    seen = parts[0]
    for more in parts[1:]:
        seen = seen.unionByName(more)
    hits = seen.join(small_or_shuffled(marks), ["k", "h"])
    at = lambda p: F.greatest(F.lit(0), F.least(p, F.col("words") - F.col("len")))
    reach = lambda p: F.sequence(at(p - F.col("len") + F.col("k")), at(p))
    starts = hits.groupBy("doc_id", "tk", "len", "k", "words").agg(F.collect_set("p").alias("ps"))
    starts = starts.select("doc_id", "tk", "len", "k", F.array_distinct(F.flatten(F.transform("ps", reach))).alias("starts"))
    starts = saved(starts, "starts")

    near = small_or_shuffled(starts.withColumnsRenamed({"doc_id": "hit_id", "tk": "hit_tk"}))
    found = texts.join(near, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("tk") == F.col("hit_tk"))).drop("hit_id", "hit_tk")
    found = found.withColumn("h", shingles("w", F.col("k"))).select("doc_id", "tk", "len", "k", "h", F.explode("starts").alias("start"))
    windows = saved(found.select("doc_id", "tk", "len", "start", F.slice("h", F.col("start") + 1, F.col("len") - F.col("k") + 1).alias("hs")).dropDuplicates(["doc_id", "tk", "len", "start"]).withColumn("win", F.monotonically_increasing_id()), "windows")

    key = ["win", "len"]  # joins on the nullable doc_id would lose the documents without one
    prints = fingerprints(windows.select(*key, F.explode("hs").alias("h")), key)
    flips = [0, *[1 << b for b in range(WIDTH)]]
    probes = fingerprints(bags, ["item", "item_id", "len"]).select("item", "item_id", "len", F.col("n").alias("item_n"), F.col("fp").alias("item_fp"), F.inline(block_values("fp")))
    flipped = F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda f: F.col("value").bitwiseXOR(f))
    probes = probes.select("item", "item_id", "len", "item_n", "item_fp", "block", F.explode(flipped).alias("value"))
    met = prints.select(*key, "n", "fp", F.inline(block_values("fp"))).join(small_or_shuffled(probes), ["len", "block", "value"])
    met = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select(*key, "n", "item", "item_id", "item_n").distinct()

    counts = bags.groupBy("item", "h").agg(F.count("*").alias("of_item"))
    bag = windows.select(*key, "hs").join(met, key).select(*key, "n", "item", "item_id", "item_n", F.explode("hs").alias("h")).groupBy(*key, "n", "item", "item_id", "item_n", "h").agg(F.count("*").alias("of_window"))
    same = bag.join(small_or_shuffled(counts), ["item", "h"]).groupBy(*key, "n", "item", "item_id", "item_n").agg(F.sum(F.least("of_item", "of_window")).alias("inter"))
    union = F.col("n") + F.col("item_n") - F.col("inter")
    leaks = same.withColumn("union", union).where(F.col("inter") * 100 >= F.col("union") * least)
    return windows.select("win", "doc_id", "tk", "start").join(small_or_shuffled(leaks.select("win", "item_id", "len", "inter", "union")), "win").drop("win")


def spark_empty(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], "doc_id long, tk long, item_id long, start int, len int, inter long, union long")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak an item; other texts under the same id, or without one, stay."""
    leak_id, leak_tk = free_names(docs, "leak_id", "leak_tk")
    leaked = window_leaks(docs, items).select(F.col("doc_id").alias(leak_id), F.col("tk").alias(leak_tk)).distinct()
    return docs.join(small_or_shuffled(leaked), (F.xxhash64("text") == F.col(leak_tk)) & F.col("doc_id").eqNullSafe(F.col(leak_id)), "left_anti")
