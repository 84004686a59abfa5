"""Tests of what reviews found."""

import dataclasses
import datetime
import random
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from tests.checking import SF, same
from turnmill import registry
from turnmill.functions import dates
from turnmill.functions import text as T
from turnmill.functions.lexicon import ARABIC, ENGLISH
from turnmill.operators import joins, linking, table_functions, turns
from turnmill.plans import linking as plans
from turnmill.plans import streams
from turnmill.session import ship_package
from turnmill.storage import saved, spread


def test_last_cue_may_begin_inside_the_last_match(spark, tmp_path):
    """" the the the" holds its last cue twice, and the second place counts."""
    texts = ["in the the the, end", "on the the them", "a the the cat", "of the cat and the cat sat", "none", "é the über", "with the tab\t, end"]
    rows = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    rows.toPandas().to_parquet(f"{tmp_path}/conversations.parquet")
    same(spark, registry.queries()["last_cue_offset"], registry.oracle_sql()["last_cue_offset"], str(tmp_path))


def test_a_file_of_one_row_group_is_spread(spark, tmp_path):
    """such a file is cut into many partitions, but one of them has all rows."""
    pd.DataFrame({"n": range(20_000), "text": [str(i) * 20 for i in range(20_000)]}).to_parquet(f"{tmp_path}/one.parquet", row_group_size=20_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = spread(spark.read.parquet(f"{tmp_path}/one.parquet"))
        assert rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 10_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_dates_in_names_are_compiled(spark):
    """no lambda and no formatter, which are interpreted row by row."""
    plan = registry.queries()["dates_in_names"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "format_string" not in plan


def test_copy_marks_and_days_of_names(spark):
    rows = spark.createDataFrame([("a_N_5",), ("N_n_5",), ("x No 12 y",), ("No-1",), ("N",), ("aN 5",), ("N 5a",), ("",)], "stem string")
    assert [r[0] for r in rows.select(dates.source_tag(F.col("stem"))).collect()] == ["a_5", "N_5", "x_12_y", "1", "N", "aN_5", "N_5a", ""]
    rows = spark.createDataFrame([("2020-01-_5__4_N-7",), ("5_4_01-2020_N_7",), ("2020-01-5_4_M_7",), (None,)], "stem string")
    assert [r[0] and tuple(r[0])[:2] for r in rows.select(dates.two_day_sitting(F.col("stem"))).collect()] == [("2020-01-04", "N7")] * 2 + [None] * 2
    rows = spark.createDataFrame([("x 2020.1.5",), ("5_1-2020",), ("2020-13-05",), ("no",), (None,)], "stem string")
    assert [r[0] for r in rows.select(dates.date_in_name(F.col("stem"))).collect()] == ["2020-01-05", "2020-01-05", None, None, None]


def test_turns_of_a_key_cost_no_arrow_batch():
    """F8: each key would be a batch of its own, of a few rows."""
    assert table_functions.Turns.evalType == PythonEvalType.SQL_TABLE_UDF


def test_batches_for_python_are_bounded_in_bytes(spark):
    """The pipeline's memory: 3,000 texts of 10,000 characters were one batch of 30 MB."""
    ship_package(spark)
    rows = spark.range(3_000, numPartitions=1).select(F.repeat(F.lit("x"), F.lit(10_000)).alias("text"))
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert max(r.n for r in sizes) <= 3 << 20 and sum(r.n for r in sizes) >= 30_000_000


def test_late_turns_by_buckets_and_files(spark, tmp_path, monkeypatch):
    """users share state by buckets, and a batch may be several files; a few rows a file here."""
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    monkeypatch.setattr(streams, "BUCKET_USERS", 5)
    assert streams.shuffled_arrivals(spark, registry.table(spark, SF, "events"))[1] > 1
    same(spark, registry.queries()["stream_turns_late"], registry.oracle_sql()["stream_turns_late"])


def test_first_lines_take_no_pattern(spark):
    """every character but surrogates, before, in and after a word, as the pattern had it."""
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    t = F.col("t")
    rows = spark.range(1, 0x110000).where("id < 55296 OR id > 57343").select(F.explode(F.array(c, F.concat(F.lit("a"), c, F.lit("b")), F.concat(c, F.lit(" a "), c, F.lit("\r\nb"), c))).alias("t"))
    was = [F.regexp_replace(t, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.regexp_extract(t, r"(?U)^[\s\x1c-\x1f]*([^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*)", 1)]
    now = [T.stripped(t), T.first_line(t)]
    assert rows.where(~F.struct(*was).eqNullSafe(F.struct(*now))).count() == 0
    assert not any("regexp" in str(x) for x in now)


def test_pairs_of_overlapping_spans_are_all_found_once(spark):
    """many blocks in a cell, spans over many cells, equal starts, spans that touch, repeated ids and rows, negative times, nulls."""
    rng = random.Random(3)
    rows = [(rng.randrange(2), rng.randrange(6), rng.randrange(150), lo := rng.randrange(-40, 60), lo + rng.choice([0, 0, 1, 3, 25])) for _ in range(160)]
    rows += rows[:5] + [(None, 1, 900, 0, 9), (0, None, 901, 0, 9), (0, 1, None, 0, 9), (0, 1, 902, None, 9), (0, 1, 903, 0, None)]
    whole = [r for r in rows if None not in r]
    want = Counter((x[2], y[2]) for x in whole for y in whole if x[0] == y[0] and x[1] != y[1] and y[4] >= x[3] and y[3] <= x[4] and x[2] < y[2])
    spans = spark.createDataFrame(rows, "g long, owner long, span long, lo long, hi long")
    for block, width in ((3, 10), (512, 10), (2, 1000)):
        assert Counter((r.a, r.b) for r in joins.overlapping_pairs(spans, ["g"], width, block).collect()) == want


def test_pairs_of_one_day_come_from_several_tasks(spark, tmp_path):
    """one group's 1,300 sign-ups of one hour were joined in one task, whatever the number of cores."""
    base = datetime.datetime(2024, 1, 1)
    made = [(2 * u + k, base + datetime.timedelta(seconds=u + 600 * k), 10 * u, "signup" if k == 0 else "click") for u in range(1300) for k in (0, 1)]
    events = spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1)
    events.write.parquet(f"{tmp_path}/events.parquet")
    pairs = registry.queries()["range_overlap"](spark, str(tmp_path))
    tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert sum(tasks) == sum(min(600, 1299 - u) for u in range(1300)) and len(tasks) > 1


def test_names_of_few_syllables_meet_few_others(spark):
    """such names have much the same letters, so the pairs that were compared grew with the square of the table; now by parts in their places."""
    rng = random.Random(5)
    syllables = ["th", "er", "on", "an", "in", "re", "ed", "ble", "tion", "the", "ing", "\U0001f600é", "st"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    names = [*dict.fromkeys(f"{word()} {word()}" for _ in range(700)), "a", "ab", "aaaaaaaaaaaa", "x" * 60, "\U0001f600" * 9, ""]
    spoiled = ["".join(c for c in rng.choice(names) if rng.random() > 0.06) + rng.choice(["", "", "x", "\U0001f600"]) for _ in range(250)]
    texts = [*spoiled, *rng.sample(names, 30), "a", "aaaaaaaaaaa", "x" * 55 + "yy", "\U0001f600" * 8 + "\U0001f601", "", "q"]
    cands = spark.createDataFrame([(i, n, f"p{i % 2}") for i, n in enumerate(texts)] + [(900, None, "p0"), (901, "ab", None)], "cand_id long, cand_norm string, period string")
    dim = spark.createDataFrame([(i, f"p{k}", n) for i, n in enumerate(names) for k in (0, 1)] + [(9000, "p0", None), (9001, None, "ab"), (0, "p0", names[0])], "mp_id long, roster_period string, name_norm string")
    for least in (0.82, 0.6):
        pairs = linking.similar_pairs(cands, dim, least)
        assert sorted(pairs.columns) == sorted([*cands.columns, *dim.columns])
        found = Counter((r.cand_id, r.mp_id, r.cand_norm, r.name_norm) for r in pairs.collect())
        match = Counter((i, j, c, n) for i, c in enumerate(texts) for j, n in enumerate(names) if c and n and SequenceMatcher(None, c, n).ratio() >= least)
        match += Counter({k: 1 for k in match if k[1] == 0 and k[0] % 2 == 0})  # a name that the dimension has twice
        assert match == Counter({k: v for k, v in found.items() if k in match}) and len(match) > 200
        assert least < 0.8 or sum(found.values()) <= 2 * sum(match.values())


def test_words_in_order_meet_by_their_ends(spark):
    """repeated words, one name that holds a text in two ways, texts of one word and of more words than the name."""
    rng = random.Random(6)
    phrase = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    names, texts = [*{phrase(rng.randint(1, 6)) for _ in range(60)}, ""], [*{phrase(rng.randint(1, 5)) for _ in range(120)}, ""]

    def inside(small, big):
        rest = iter(big)
        return all(w in rest for w in small)

    hits = {c: [j for j, n in enumerate(names) if inside(c.split(" "), n.split(" "))] for c in texts if " " in c}
    dim = spark.createDataFrame([(j, "p", n) for j, n in enumerate(names)], "mp_id long, roster_period string, name_norm string")
    cands = spark.createDataFrame([(i, c, "p") for i, c in enumerate(texts)], "cand_id long, cand_norm string, period string")
    got = {texts[r.cand_id]: r.mp_id for r in linking.subsequence_match(cands, dim, "m", 0.9).collect()}
    assert got == {c: js[0] for c, js in hits.items() if len(js) == 1} and got


def test_documents_without_a_hand_off_are_not_cut_into_lines(spark, tmp_path, monkeypatch):
    """they have no turns; one that shares its id with another that hands over, or has none, still counts."""
    said = "some words are said here\nand some more of them"
    texts = {1: f"The big house\n{said}", 2: f"{said}\nthe small house", 3: f"x\r\nEl gran señor\t\n{said}", 4: f"The\nbig house\n{said}", 5: None, 6: f"Der ½ xy\n{said}", None: f"Le petit chat\n{said}"}
    rows = [*texts.items(), (1, f"{said}\nfrom another text"), (8, ""), (None, said)]
    pd.DataFrame({"doc_id": pd.array([k for k, _ in rows], "Int64"), "text": [v for _, v in rows]}).to_parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    monkeypatch.setattr(plans, "saved", lambda df, label: kept.setdefault(label, saved(df, label)))
    got = registry.queries()["turns_linked"](spark, str(tmp_path))
    files = {r[0].split("__")[1] for r in kept["paragraphs"].select("source_file").distinct().collect()}
    assert files == {"1.md", "3.md", "6.md", "null.md"}
    pars, names, people, lex = plans.spoken(spark, str(tmp_path))
    want = linking.linked_turns(turns.extract_turns(pars, names, lex), people, lex=lex)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and {r.source_file.split("__")[1] for r in want.collect()} == files


def test_three_words_and_adjournments_without_reading_on(spark):
    """as the count of words had it, and as the whole pattern finds it."""
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "é", "\U0001f600", " ", "\t", "\n", "\x1c", "\x85", "\xa0", " ", "​"]) for _ in range(rng.randint(0, 9))) for _ in range(800)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t, lex = F.col("t"), dataclasses.replace(ENGLISH, openers="^never")
    was = ~T.is_noise(t, lex) & (T.word_count(t) >= 3)
    assert rows.where(~T.is_substantive(t, lex).eqNullSafe(was)).count() == 0 and 0 < rows.where(was).count() < 800
    for lex in (ARABIC, ENGLISH):
        assert lex.adjourn.startswith(r"\(?\s*")
