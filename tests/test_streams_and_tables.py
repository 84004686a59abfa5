"""Late rows, cache filling, table functions, the stream splitter, exact samples and the factor test."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.checking import SF
from turnmill.functions.lexicon import ENGLISH
from turnmill.operators import curation, paragraphs, statistics, table_functions, turns
from turnmill.plans.streams import ROCKSDB, settings
from turnmill.sources import corpus, named_files
from turnmill.streaming import fill
from turnmill.streaming import turns as streaming_turns

EVENT = "event_id long, user_id long, ts timestamp, event_type string"


@pytest.mark.parametrize("idle", [None, 3_600_000])
def test_late_rows_are_put_in_order_once_and_idle_state_ends(spark, tmp_path, idle):
    """Two users; the first one's rows come out of order over two files, then only the second one goes on."""
    minute = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    files = [
        [(1, 1, 10, "click"), (2, 1, 5, "signup"), (3, 2, 12, "signup"), (4, 1, 31, "click")],
        [(5, 1, 20, "click"), (6, 1, 25, "error"), (7, 2, 14, "view"), (8, 1, 27, "signup")],
        [(9, 2, 400, "click")],
        [(10, 2, 900, "click"), (11, 1, 0, "click")],  # 11 comes too late
    ]
    for k, rows in enumerate(files):
        df = spark.createDataFrame([(i, u, minute(m), kind) for i, u, m, kind in rows], "event_id long, user_id long, ts string, event_type string")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    with settings(spark, ROCKSDB | {"spark.sql.shuffle.partitions": "2"}):
        out = streaming_turns.ordered_turns(source, "30 minutes", idle)
        out.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "known").load()
        users = {r.key.user_id for r in state.select("key").collect()}
    got = sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())
    # 400 is given with the same turn, or after an idle hour with none
    assert got == [(1, 1, 2, 1), (1, 1, 2, 5), (1, 2, 8, 4), (2, 1, 3, 7)] + ([(2, 1, 3, 9)] if idle is None else [])
    assert users == ({1, 2} if idle is None else set())


def test_a_stopped_fill_goes_on_and_asks_once(spark, tmp_path):
    """A call that fails in the second file; started again, no paragraph of the first file is asked for a second time."""
    rows = [("a", 1, 3, "one"), ("a", 5, 5, "two"), ("b", 1, 1, " "), ("b", 2, 2, "three"), ("c", 1, 2, "stop"), ("a", 1, 3, "one"), ("c", 4, 4, "untranslated")]
    for k, some in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(some, "source_file string, start_line int, end_line int, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    calls = f"{tmp_path}/calls"
    asked = lambda: sorted(open(calls).read().split("\n")[:-1])  # noqa: E731, SIM115

    def translate(some, broken):
        with open(calls, "a") as f:
            f.writelines(f"{text}\n" for _, text in some)
        if broken and any(text == "stop" for _, text in some):
            raise RuntimeError("the service is away")
        return {line: text.upper() for line, text in some if text != "untranslated"}

    def start(broken):
        source = spark.readStream.schema("source_file string, start_line int, end_line int, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        return fill.fill(source, f"{tmp_path}/cache", f"{tmp_path}/state", lambda some: translate(some, broken))

    with pytest.raises(StreamingQueryException):
        start(True).awaitTermination()
    assert "one" in asked() and "stop" in asked()
    start(False).awaitTermination()
    assert asked().count("one") == asked().count("two") == asked().count("three") == 1
    got = sorted(tuple(r) for r in fill.entries(spark, f"{tmp_path}/cache").collect())
    assert got == [("a", 1, "ONE"), ("a", 2, ""), ("a", 3, ""), ("a", 5, "TWO"), ("b", 2, "THREE"), ("c", 1, "STOP"), ("c", 2, "")]
    pars = spark.createDataFrame(rows, "source_file string, start_line int, end_line int, text string")
    done = {r.source_file: (r.paragraphs, r.translated, r.done) for r in fill.progress(pars, f"{tmp_path}/cache").collect()}
    assert done == {"a": (2, 2, True), "b": (2, 1, False), "c": (2, 1, False)}
    before = asked()
    fill.fill_batch(pars.where("source_file = 'c'"), 1, f"{tmp_path}/cache", lambda some: translate(some, False))  # a batch that runs twice
    assert asked() == before


def test_all_cues_hold_the_one_that_is_taken(spark):
    table_functions.register(spark)
    texts = ["The floor goes to Mr. Smith. We now hear Dr Jones, please, Mr Brown.", "nothing", None, "", "Please, Mr you. We hear Ms Lee"]
    spark.createDataFrame(list(enumerate(texts)), "id int, text string").createOrReplaceTempView("cue_texts")
    every = spark.sql("SELECT id, c.* FROM cue_texts, LATERAL cues(text, 'english') c").collect()
    assert {r.name for r in every if r.id == 0} == {"Smith", "Jones", "Brown"}
    assert all(texts[r.id][r.start : r.end].endswith(r.name) for r in every)
    best = {}
    for r in sorted(every, key=lambda r: (r.start, -r.pattern)):
        if r.usable:
            best[r.id] = (r.name, r.clean, r.start, r.end, f"handoff_window:p{r.pattern}")
    taken = {r.id: tuple(r.cue) for r in turns.with_cues(spark.table("cue_texts"), lex=ENGLISH).collect() if r.cue}
    assert taken == best
    assert spark.sql("SELECT * FROM cue_texts, LATERAL cues(text, 'no such')").count() == 0


def test_paragraph_and_turn_functions_are_those_of_the_operators(spark):
    table_functions.register(spark)
    bodies = ["one\ntwo  \n\n \nthree\n", "", "\n\n", "last", None, " a\n\tb\n\nc\n\n"]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id int, text string")
    docs.createOrReplaceTempView("bodies")
    found = {tuple(r) for r in spark.sql("SELECT doc_id, p.* FROM bodies, LATERAL paragraphs(text) p").collect()}
    assert found == {tuple(r) for r in paragraphs.paragraphs(paragraphs.lines(docs)).collect()}
    rng = random.Random(9)
    flags = [(d, i, *[rng.random() < p for p in (0.3, 0.2, 0.1, 0.7, 0.3, 0.1)]) for d in range(60) for i in range(12)]
    df = spark.createDataFrame(flags, "key int, at long, cue boolean, tail boolean, tadj boolean, sub boolean, bnd boolean, adj boolean")
    df.createOrReplaceTempView("flags")
    got = {(int(r.key), r.at, r.turn, r.cue_at, r.from_tail) for r in spark.sql("SELECT * FROM turns(TABLE(flags) PARTITION BY key ORDER BY at)").collect()}
    assert got == {tuple(r) for r in turns.members(df, "key", "at").collect()}


def plain_split(files, mark):
    out, date = [], None
    for name, text in files:
        at = [m.start() for m in re.finditer(mark, text)]
        if not at:
            if out:
                out[-1][1].append(name)
                out[-1][2].append(text)
            continue
        if out and text[: at[0]].strip():
            out[-1][2].append(text[: at[0]])
            if name not in out[-1][1]:
                out[-1][1].append(name)
        for a, b in itertools.pairwise([*at, len(text)]):
            day = re.match(r"SITTING (\d+)", text[a:b])
            date = day[1] if day else date
            out.append([date, [name], [text[a:b]], a])
    return [(k, date, parts, "".join(text), start) for k, (date, parts, text, start) in enumerate(out)]


@pytest.mark.parametrize("seed", range(3))
def test_the_splitter_goes_on_over_files(spark, seed):
    """Files without a mark, a mark at offset 0, two marks in one line, front matter, blank beginnings, dates carried on."""
    rng = random.Random(seed)
    bits = ["SITTING", "SITTING 5 ", "SITTING 77", "words ", "\n", " \n ", "more\n", "دورة "]
    files = [("front", "front matter\n"), ("a", "SITTINGSITTING 3 x"), ("b", "no mark here"), ("c", " \n SITTING"), ("d", ""), ("e", "SITTING 4\nSITTING y SITTING z")]
    files += [(f"f{k:02d}", "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for k in range(40)]
    df = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(files)], "file_no long, stem string, text string").repartition(5)
    got = curation.stream_segments(df, "SITTING", F.nullif(F.regexp_extract("text", r"^SITTING (\d+)", 1), F.lit("")))
    assert sorted((r.segment, r.date, list(r.parts), r.text, r.start) for r in got.collect()) == plain_split(files, "SITTING")
    assert curation.stream_segments(df.limit(0), "SITTING", F.lit(None).cast("string")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_samples_are_those_of_the_standard_generator(spark, sf):
    docs = spark.read.parquet(f"{SF.removesuffix('sf0.001')}{sf}/documents.parquet").select("doc_id")
    ids = sorted(r.doc_id for r in docs.collect())
    picked = random.Random(7).sample(ids, 50)
    assert [r.doc_id for r in curation.drawn(docs, [F.col("doc_id")], 50, 7).orderBy("draw").collect()] == picked
    random.Random(8).shuffle(ids)
    assert [r.doc_id for r in curation.shuffled(docs, [F.col("doc_id")], 8).orderBy("place").collect()] == ids
    assert curation.drawn(docs.limit(3), [F.col("doc_id")], 50, 7).count() == 3
    assert curation.drawn(docs.limit(0), [F.col("doc_id")], 50, 7).count() == 0


def test_ordinals_have_no_gaps(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = [r.id for r in curation.ordinals(df, [F.col("k").desc()]).orderBy("ordinal").collect()]
    assert got == [r.id for r in df.orderBy(F.desc("k")).collect()]
    assert curation.ordinals(df, ["k"]).agg(F.min("ordinal"), F.max("ordinal"), F.count_distinct("ordinal")).first()[:] == (0, 999, 1000)


def test_too_few_factors_are_rejected_and_enough_are_not():
    rng = np.random.default_rng(5)
    n, load = 4000, np.zeros((9, 3))
    load[:3, 0], load[3:6, 1], load[6:, 2] = (0.8, 0.7, 0.6), (0.9, 0.7, 0.5), (0.8, 0.6, 0.7)
    x = rng.normal(size=(n, 3)) @ load.T + rng.normal(size=(n, 9)) * np.sqrt(1 - (load**2).sum(axis=1))
    r = np.corrcoef(x.T)
    enough, few = statistics.factor_test(r, 3, n), statistics.factor_test(r, 2, n)
    assert (enough["df"], few["df"]) == (12, 19)
    assert enough["p_value"] > 0.01 > 1e-6 > few["p_value"]
    exact = load @ load.T + np.diag(1 - (load**2).sum(axis=1))
    assert abs(statistics.factor_test(exact, 3, n)["fit"]) < 1e-5
    with pytest.raises(ValueError):
        statistics.factor_test(np.eye(3), 2, 100)


def test_gamma_tail_is_that_of_tables():
    for df, x, p in ((1, 3.841459, 0.05), (2, 5.991465, 0.05), (10, 18.307038, 0.05), (12, 26.216967, 0.01), (100, 124.342113, 0.05)):
        assert abs(statistics.gamma_tail(df / 2, x / 2) - p) < 1e-6
    assert statistics.gamma_tail(3, 0) == 1 and math.isclose(statistics.gamma_tail(1, 2), math.exp(-2))


def test_named_files_are_there_at_once_or_not_at_all(spark, tmp_path):
    docs = spark.createDataFrame([(f"2015-10-{k:02d}__{k}", f"{k}.pdf", "ocr", None, f"body {k}\né") for k in range(1, 31)], "doc_id string, source_pdf string, engine string, sitting_date string, body string").repartition(4)
    corpus.write_named_markdown(docs, f"file://{tmp_path}/out")
    written = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    assert written == {r.name: r.value for r in corpus.with_header(docs).collect()} and len(written) == 30
    back = corpus.markdown(spark, f"{tmp_path}/out")
    assert {r.source_file for r in back.collect()} == {f"{r.doc_id}.md" for r in docs.collect()}
    rows = spark.createDataFrame([(f"{k}.md", None if k else "x") for k in range(20)], "name string, value string").repartition(4)
    named_files.write_named(rows, f"file://{tmp_path}/more")
    assert len(list((tmp_path / "more").iterdir())) == 20
    for broken in (rows.unionByName(rows.limit(1)), rows.withColumn("name", F.when(F.col("name") == "7.md", "a/b").otherwise(F.col("name"))), rows.withColumn("name", F.when(F.col("name") != "3.md", F.col("name")))):
        with pytest.raises(Exception, match="names|no name"):
            named_files.write_named(broken, f"file://{tmp_path}/none")
        assert sorted(p.name for p in tmp_path.iterdir()) == ["more", "out"]
    with pytest.raises(Exception, match="there already"):
        named_files.write_named(rows, f"file://{tmp_path}/out")


def test_queues_name_stems(spark):
    lines = spark.createDataFrame([(x,) for x in ("a/b/one.pdf", "  two ", "# three.pdf", "", "four.v2.md", ".five", None, "one.pdf")], "value string")
    assert sorted(r.stem for r in corpus.queued_stems(lines).collect()) == [".five", "four.v2", "one", "two"]


def test_levels_follow_the_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", None), ("d", 5.0), (None, 9.0)], "f string, v double")
    assert {r.f: r.level for r in statistics.levels(df, "f", F.col("v")).collect()} == {"a": 1, "b": 2, "d": 3, "c": 4}
    assert {r.f: r.level for r in statistics.levels(df, "f", F.col("v"), descending=True).collect()} == {"d": 1, "a": 2, "b": 3, "c": 4}
