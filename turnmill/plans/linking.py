"""Queries that link part names to a dimension of brands' first names, and other joins of that kind."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import dates as D
from turnmill.functions import text as T
from turnmill.functions.lexicon import ENGLISH, Lexicon
from turnmill.operators import joins, linking, review, sittings, turns
from turnmill.registry import query, table
from turnmill.storage import saved, spread

DIM = "dim AS (SELECT p_brand AS roster_period, p_name AS name, count(*) AS n, min(p_partkey) AS mp_id FROM part WHERE p_size <= 10 GROUP BY 1, 2)"


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension from the small parts: (mp_id, name, period), one row for each brand and name."""
    return table(spark, sf_dir, "part").where("p_size <= 10").groupBy(F.col("p_brand").alias("period"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("mp_id"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("cand_id"), F.col("p_name").alias("cand_norm"), F.col("p_brand").alias("period"))


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.sized(roster(spark, sf_dir).select("mp_id", F.col("period").alias("roster_period"), F.col("name").alias("name_norm")))


@query(f"""WITH {DIM} SELECT p.p_partkey AS cand_id, min(mp_id) AS mp_id FROM part p JOIN dim ON p_brand = roster_period AND p_name = name WHERE p_size > 10 GROUP BY 1 HAVING count(*) = 1""")
def unique_exact_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that exactly one row of the same brand has."""
    c, d = candidates(spark, sf_dir), dimension(spark, sf_dir)
    return linking.unique_match(c, d, c.cand_norm == d.name_norm, "exact", 1.0).select("cand_id", "mp_id")


@query("""WITH dim AS (SELECT p_brand AS b, string_split(p_name, ' ')[1] AS name, min(p_partkey) AS mp_id FROM part WHERE p_size <= 10 GROUP BY 1, 2)
SELECT p.p_partkey AS cand_id, min(mp_id) AS mp_id FROM part p JOIN dim ON p_brand = b AND contains(p_name, name) WHERE p_size > 10 GROUP BY 1 HAVING count(*) = 1""")
def contains_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold exactly one of their brand's first words."""
    c = candidates(spark, sf_dir)
    d = table(spark, sf_dir, "part").where("p_size <= 10").groupBy(F.col("p_brand").alias("roster_period"), F.split("p_name", " ")[0].alias("name_norm")).agg(F.min("p_partkey").alias("mp_id"))
    d = linking.sized(d)
    return linking.contained_match(c, d, "contained", 0.9).select("cand_id", "mp_id")


@query("""WITH dim AS (SELECT DISTINCT p_type || ' ' || p_name AS t FROM part), c AS (SELECT DISTINCT p_type AS a, string_split(p_name, ' ')[-1] AS b FROM part)
SELECT a || ' ' || b AS words, count(*) AS n FROM c JOIN dim ON regexp_matches(t, '(^| )' || a || ' (.* )?' || b || '( |$)') GROUP BY 1""")
def subsequence_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full names whose words hold the given ones, a type and a last word, in their order."""
    parts = table(spark, sf_dir, "part")
    names = parts.select(F.split(F.concat_ws(" ", "p_type", "p_name"), " ").alias("t")).distinct()
    words = parts.select(F.array(F.col("p_type"), F.element_at(F.split("p_name", " "), -1)).alias("w")).distinct()
    by_word = names.select("t", F.explode(F.array_distinct("t")).alias("word"))  # a name that holds the words has the first
    return words.join(by_word, (F.col("w")[0] == F.col("word")) & linking.subsequence(F.col("w"), F.col("t"))).groupBy(F.array_join("w", " ").alias("words")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS cand_id, n_nationkey AS mp_id FROM supplier JOIN (SELECT n_nationkey, upper(n_name) AS variant FROM nation) a ON a.n_nationkey = s_nationkey
JOIN (SELECT r_regionkey FROM region WHERE r_regionkey < 3) p ON p.r_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = s_nationkey)""")
def alias_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by alias to a nation, if that nation sits in one of the periods (here regions 0 to 2)."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    named = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("cand_id"), F.upper("n_name").alias("cand_norm"), F.lit("r").alias("period"))
    known = n.select(F.upper("n_name").alias("variant_norm"), F.col("n_nationkey").alias("mp_id"))
    people = n.where("n_regionkey < 3").select(F.col("n_nationkey").alias("mp_id"), F.lit("r").alias("roster_period"))
    return linking.alias_match(named, known, people).select("cand_id", "mp_id")


@query()
def fuzzy_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best name of the brand by ratio, if it leads by a margin."""
    return linking.fuzzy_match(candidates(spark, sf_dir), dimension(spark, sf_dir))


@query()
def cascade_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers in turn, the first that fits."""
    names = table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", F.col("p_name").alias("candidate"), F.col("p_brand").alias("period"))
    return linking.link(names, roster(spark, sf_dir), lex=ENGLISH)


def spoken(spark: SparkSession, sf_dir: str, cued: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, Lexicon]:
    """Lines of all documents as paragraphs of dated files, the files, a roster, and a lexicon in which a line's first article hands over to the two words after it.

    With ``cued`` without the documents in which no line begins so: they have no turns and no names. Those that share
    their id with another are one file with it, and stay.
    """
    lex = replace(ENGLISH, cues=(r"^(?:The|Der|Le|El) (?P<name>\w+ \w+)",), openers=r"^(?:Of|Is|Et|Des|Las)\b")
    name = F.format_string("%d-03-01__%d.md", (2010 + F.col("doc_id") % 14).cast("int"), "doc_id")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    if cued:
        ids = table(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("id")).agg((F.count("*") > 1).alias("shared")).where("shared")
        ids = linking.sized(ids)
        marked = F.col("text").rlike(r"(?m)^(?:The|Der|Le|El) [^ \n]+ [^ \n]")
        docs = docs.join(ids, docs.doc_id.eqNullSafe(ids.id), "left").where(marked | F.col("shared"))
    rows = docs.select(name.alias("source_file"), "text")
    pars = rows.select("source_file", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("source_file", (F.col("pos") + 1).alias("par"), (F.col("pos") + 1).alias("start_line"), (F.col("pos") + 1).alias("end_line"), "text")
    pars = saved(pars.where(~T.is_noise(F.col("text"), lex)), "paragraphs")
    word = F.regexp_extract("text", r"(?U)^(?:The|Der|Le|El) (\w+ \w+)", 1)
    meta = D.file_meta(F.col("source_file"))
    people = pars.select(word.alias("name"), D.legislature(meta["inferred_date"], meta["year_start"]).alias("period")).where("name <> ''").distinct()
    people = people.where(F.md5("name") < "c").select(F.xxhash64("name").alias("mp_id"), "name", "period", F.upper("name").alias("name_transliterated"))
    return pars, pars.select("source_file").distinct(), people, lex


@query()
def turns_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn table with its speakers, all of its columns."""
    pars, files, people, lex = spoken(spark, sf_dir, cued=True)
    people = saved(people, "roster")  # used twice
    return linking.linked_turns(turns.extract_turns(pars, files, lex), people, lex=lex)


@query()
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-C: how many substantive lines and speech openers the turns of each file hold."""
    pars, files, _, lex = spoken(spark, sf_dir)
    return turns.coverage(pars, turns.extract_turns(pars, files, lex).select("source_file", "speech_id", "start_line", "end_line"), lex)


@query("""WITH w AS (SELECT source, unnest(string_split(text, ' ')) AS word FROM documents)
SELECT word, min(source) AS source FROM w GROUP BY word HAVING count(DISTINCT source) = 1""")
def sole_owner_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that one source alone uses."""
    words = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", " ")).alias("word"))
    return linking.sole_owners(words, "word", "source")


@query("""SELECT o.o_orderkey, CASE WHEN l.toxic IS NOT NULL THEN 'labels' WHEN c.c_acctbal > 0 THEN 'customer' ELSE 'none' END AS origin, coalesce(CAST(l.toxic AS DOUBLE), CASE WHEN c.c_acctbal > 0 THEN c.c_acctbal END) AS value
FROM orders o LEFT JOIN labels l ON o.o_orderkey = l.doc_id LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def left_merge_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outer joins, the first that has a value wins."""
    o, labels, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "labels"), table(spark, sf_dir, "customer")
    rich = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    rows = o.join(labels, o.o_orderkey == labels.doc_id, "left").join(c, o.o_custkey == c.c_custkey, "left")
    return rows.select("o_orderkey", *joins.first_of({"labels": F.col("toxic").cast("double"), "customer": rich}))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity >= 50)")
def calendar_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on a day of the calendar."""
    days = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.to_date("l_shipdate").alias("day")).distinct()
    return sittings.on_calendar(table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")), "day", days).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    return review.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])
