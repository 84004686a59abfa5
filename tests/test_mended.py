"""Replies, paragraphs for translation, repeated sittings, tests without spread, fuzzy pairs: cases told by hand."""

import datetime
import math
import random
from difflib import SequenceMatcher

import pytest

from turnmill.functions.lexicon import FUZZY_LEAST, FUZZY_RULES
from turnmill.operators import linking, paragraphs, review, sittings, statistics
from turnmill.plans import linking as plans
from turnmill.sources import tables

DAY = datetime.date


def test_reply_lines_take_five_marks_strip_and_the_last_of_a_number(spark):
    reply = "1| first\n2- second \n3) third\n4\tfourth\r\n5.fifth\n6 : sixth\n7: one\n7: two\n\u0668: eighth\nx9: no\n10:\n"
    expected = spark.createDataFrame([("a.md", n) for n in (*range(1, 9), 10)], "source_file string, line int")
    got = review.reply_lines(spark.createDataFrame([("a.md", reply), ("b.md", None)], "source_file string, reply string"), expected)
    assert {r.line: r.text for r in got.collect()} == {1: "first", 2: "second", 3: "", 4: "fourth", 5: "fifth", 6: "sixth", 7: "two", 8: "eighth", 10: ""}


def test_reply_objects_keep_strings_alone(spark):
    df = spark.createDataFrame([('{"1": 5, "2": " x ", "3": {"a": 1}, "4": "", "5": null, "6": "no"}',), ("[1]",), ("broken",), (None,)], "p string")
    asked = ["1", "2", "3", "4", "5"]
    assert [r.m for r in df.select(review.reply_object(df.p, asked).alias("m")).collect()] == [{"2": "x", "4": ""}, {}, {}, {}]
    cache = spark.createDataFrame([("a", '{"1": "x", "2": 3, "y": "z"}'), ("b", "{")], "source_file string, body string")
    assert [tuple(r) for r in tables.line_cache(cache).orderBy("line").collect()] == [("a", None, "z"), ("a", 1, "x")]


def test_paragraphs_for_translation_are_stripped_at_both_ends(spark):
    docs = spark.createDataFrame([("a", "  one  \n\ttwo\n \t\n three")], "doc_id string, text string")
    got = paragraphs.paragraphs(paragraphs.lines(docs), sep=" ", strip="both").orderBy("par").collect()
    assert [(r.start_line, r.end_line, r.text) for r in got] == [(1, 2, "one two"), (4, 4, "three")]
    with pytest.raises(ValueError):
        paragraphs.paragraphs(paragraphs.lines(docs), strip="left")


def test_ranges_for_translation_are_cut_and_paragraphs_come_once(spark):
    pars = spark.createDataFrame([("a", n, n + 1, f"t{n}") for n in range(1, 1000, 3)], "source_file string, start_line int, end_line int, text string")
    wanted = spark.createDataFrame([("a", -5, 4), ("a", 2, 6), ("a", 500, 5000), ("a", 9, 8), ("b", 1, 9)], "source_file string, lo int, hi int")
    cached = spark.createDataFrame([("a", 4)], "source_file string, line int")
    got = sorted(r.start_line for r in review.translation_ranges(pars, wanted, cached).collect())
    assert got == [n for n in range(1, 1000, 3) if n != 4 and (n <= 6 or n + 1 >= 500 and n <= 799)]


def test_repeated_stems_stay_their_own_rows_and_the_last_is_merged(spark):
    """Two rows of one stem each keep their row in the chain; the merged table has the later one."""
    stems = [f"2015-2016__{k:02d}" for k in range(1, 9)]
    days = [f"2015-10-{k + 1:02d}" for k in range(1, 9)]
    rows = [(k, s, f"{s}.md", d, "name") for k, (s, d) in enumerate(zip(stems, days, strict=True))]
    rows += [(8, stems[2], f"{stems[2]}.md", "2015-10-20", "later"), (9, stems[5], f"{stems[5]}.md", days[5], "same")]
    manifest = spark.createDataFrame(rows, "row_no long, doc_id string, md_file string, sitting_date string, date_source string")
    tri = sittings.triangulated(manifest)
    assert tri.count() == 10
    assert sittings.triangulated(manifest.drop("row_no")).count() == 10
    assert {(r.row_no, r.seq_ok) for r in tri.collect()} == {(k, k != 8) for k in range(10)}
    bodies = spark.createDataFrame([(s, f"{s} of 5/10/2015") for s in stems], "doc_id string, body string")
    final = sittings.merged(tri, sittings.resolved(tri, bodies))
    got = {r.doc_id: r for r in final.collect()}
    assert final.count() == 8 and got[stems[5]].date_source == "same" and got[stems[5]].final_date == DAY(2015, 10, 7)
    assert got[stems[2]].flag_raw == "conflict:seq_break"
    assert sittings.gated(final, bodies).count() == 8


def test_quantiles_are_those_of_tables():
    for p, df, value in ((0.975, 1, 12.7062047364), (0.975, 2, 4.3026527297), (0.995, 5, 4.0321429836), (0.975, 10, 2.2281388520), (0.95, 30, 1.6972608866), (0.975, 1000, 1.9623390808), (0.025, 10, -2.2281388520), (0.5, 3, 0.0)):
        assert abs(statistics.t_quantile(p, df) - value) < 1e-8 * max(1, abs(value))
    for df in (0.5, 1, 3.7, 40, 1e4):
        for p in (0.001, 0.2, 0.6, 0.999999):
            assert math.isclose(statistics.t_two_sided(statistics.t_quantile(p, df), df), 2 * min(p, 1 - p), rel_tol=1e-6)


def test_welch_without_a_variance_says_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), ("b", None), (None, 4.0)], "g string, v double")
    assert statistics.welch(df, "v", "g") == {"t": None, "df": None, "p_value": None, "low": None, "high": None, "mean_1": 1.0, "mean_2": 2.5}
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    assert statistics.welch(flat, "v", "g")["p_value"] is None
    rows = [("a", v) for v in (3.1, 2.7, 4.4, 3.9)] + [("b", v) for v in (1.2, 2.8, 2.1, 1.7, 2.2)]
    got = statistics.welch(spark.createDataFrame(rows, "g string, v double"), "v", "g", 0.9)
    assert math.isclose((got["low"] + got["high"]) / 2, got["mean_1"] - got["mean_2"])
    assert statistics.t_two_sided((got["high"] - got["low"]) / 2 / ((got["mean_1"] - got["mean_2"]) / got["t"]), got["df"]) == pytest.approx(0.1)
    for values in (["a"], ["a", "b", "c"]):
        with pytest.raises(ValueError):
            statistics.welch(spark.createDataFrame([(g, 1.0) for g in values], "g string, v double"), "v", "g")


def test_any_level_has_its_interval(spark):
    rows = spark.createDataFrame([("x", 2.0, 0.5)], "term string, estimate double, std_error double")
    got = statistics.with_intervals(rows, (95, 80), df=10).first()
    assert got.high_95 == pytest.approx(2 + 0.5 * 2.2281388520) and got.low_80 == pytest.approx(2 - 0.5 * 1.3721836411)


def test_similar_pairs_lose_no_match_and_compare_few(spark):
    """All pairs of a ratio of the least or more are among them, and they are a tenth of all pairs at most."""
    rng = random.Random(3)
    parts = [["".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(3, 8))) for _ in range(60)] for _ in range(2)]
    names = [f"{rng.choice(parts[0])} {rng.choice(parts[1])}" for _ in range(150)]
    spoiled = ["".join(c for c in rng.choice(names) if rng.random() > 0.08) + rng.choice(["", "x", " b"]) for _ in range(150)]
    cands = spark.createDataFrame([(i, n, f"p{i % 2}") for i, n in enumerate([*spoiled, "", "q"])], "cand_id long, cand_norm string, period string")
    dim = spark.createDataFrame([(i, f"p{i % 2}", n) for i, n in enumerate(names)], "mp_id long, roster_period string, name_norm string")
    found = {(r.cand_id, r.mp_id) for r in linking.similar_pairs(cands, dim).collect()}
    every = [(i, j) for i in range(152) for j in range(150) if i % 2 == j % 2]
    match = {(i, j) for i, j in every if SequenceMatcher(None, [*spoiled, "", "q"][i], names[j]).ratio() >= FUZZY_LEAST}
    assert match <= found and len(match) > 50
    assert len(found) * 10 <= len(every)
    assert linking.similar_pairs(cands, dim).count() == len(found)


def test_contained_names_are_found_by_their_first_letters(spark):
    cands = spark.createDataFrame([(1, "the name ab cd here", "p"), (2, "xab cdx", "p"), (3, "ab cd", "q"), (4, "z", "p"), (5, "", "p"), (6, "both ab cd and zz", "p")], "cand_id long, cand_norm string, period string")
    dim = spark.createDataFrame([(10, "p", "ab cd"), (11, "p", "zz"), (12, "p", ""), (13, "q", "abcd"), (14, "p", "z the")], "mp_id long, roster_period string, name_norm string")
    assert sorted((r.cand_id, r.mp_id) for r in linking.contained_match(cands, dim, "m", 0.9).collect()) == [(1, 10), (2, 10)]


def test_fuzzy_query_is_that_of_all_pairs(spark):
    """Every row of ``fuzzy_link`` at the smallest scale against all pairs of a brand, and at most a tenth of the pairs of similar length compared."""
    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size").collect()
    dim = {}
    for r in parts:
        if r.p_size <= 10:
            key = (r.p_brand, r.p_name)
            dim[key] = min(dim.get(key, r.p_partkey), r.p_partkey)
    want, n_pairs = set(), 0
    for r in parts:
        if r.p_size > 10:
            names = [(n, k) for (b, n), k in dim.items() if b == r.p_brand]
            n_pairs += sum(2 * min(len(r.p_name), len(n)) >= FUZZY_LEAST * (len(r.p_name) + len(n)) for n, _ in names)
            scored = sorted(((SequenceMatcher(None, r.p_name, n).ratio(), k) for n, k in names), key=lambda x: (-x[0], x[1]))
            scored = [x for x in scored if x[0] >= FUZZY_LEAST]
            if scored:
                best, second = scored[0][0], scored[1][0] if len(scored) > 1 else 0.0
                sure = next((c for low, margin, c in FUZZY_RULES if best >= low and best - second >= margin), None)
                if sure:
                    want.add((r.p_partkey, scored[0][1], sure))
    got = {(r.cand_id, r.mp_id, r.confidence) for r in plans.fuzzy_link(spark, sf).collect()}
    assert got == want and got
    compared = linking.similar_pairs(plans.candidates(spark, sf), plans.dimension(spark, sf)).count()
    assert compared * 10 <= n_pairs
