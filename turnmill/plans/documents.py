"""Queries over the document table: lines, predicates, block types, copies, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import text as T
from turnmill.functions.lexicon import ENGLISH
from turnmill.operators import curation, paragraphs, review
from turnmill.registry import query, table
from turnmill.sources import corpus
from turnmill.storage import spread

LINES = "SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents"
NOISE = r"(len(trim(regexp_replace(line, '\s+', ' ', 'g'))) < 3 OR regexp_full_match(trim(regexp_replace(line, '\s+', ' ', 'g')), '[\d\s/\x{2011}\x{0640}-]+') OR regexp_matches(trim(line), '^([Pp]age\s+\d+|\d{3,}|##\s+)\s*$'))"
WORDS = r"len(regexp_extract_all({}, '\S+'))"


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "lang", "line", (F.col("pos") + 1).alias("line_no"))


@query(f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM ({LINES})")
def lines_posexplode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of every document."""
    return document_lines(spark, sf_dir).select("doc_id", "line_no", "line")


@query(f"SELECT doc_id, count(*) FILTER (WHERE {NOISE}) AS n_noise, count(*) AS n_lines FROM ({LINES}) GROUP BY doc_id")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are furniture, by document."""
    noisy = T.is_noise(F.col("line"), ENGLISH)
    return document_lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(noisy).alias("n_noise"), F.count("*").alias("n_lines"))


@query(rf"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM ({LINES}) WHERE NOT {NOISE} AND ({WORDS.format('line')} >= 3 OR regexp_matches(line, '^(Thank|Thanks|Good morning|Colleagues|Dear)'))")
def substantive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that carry speech."""
    return document_lines(spark, sf_dir).where(T.is_substantive(F.col("line"), ENGLISH)).select("doc_id", "line_no")


@query(rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(translate(text, '{ENGLISH.fold_from}', '{ENGLISH.fold_to}'), '[^A-Za-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS folded FROM documents""")
def normalize_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accents folded, foreign characters dropped, blanks squeezed."""
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text"), ENGLISH).alias("folded"))


@query(rf"""WITH l AS (SELECT lang, trim(regexp_replace(line, '\s+', ' ', 'g')) AS c FROM ({LINES}) WHERE NOT {NOISE})
SELECT lang, CASE WHEN regexp_matches(left(c, 350), '[Rr]eport of the committee|[Oo]n the draft (law|budget)') THEN 'committee_report_or_rapporteur'
 WHEN regexp_matches(left(c, 300), 'put to the vote|was adopted|Article\s*\d|draft law') THEN 'vote_or_article'
 WHEN regexp_matches(c, '^(Thank|Thanks|Good morning|Colleagues|Dear)') THEN 'speech'
 WHEN (len(regexp_extract_all(c, 'quorum|show of hands|in favour|against|unanimously|any objections?')) >= 1 AND {WORDS.format('c')} <= 30)
   OR (len(regexp_extract_all(c, 'quorum|show of hands|in favour|against|unanimously|any objections?')) >= 3 AND {WORDS.format('c')} <= 60) THEN 'procedural'
 ELSE 'speech_like' END AS block_type, count(*) AS n FROM l GROUP BY ALL""")
def block_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of blocks, by language."""
    rows = document_lines(spark, sf_dir).where(~T.is_noise(F.col("line"), ENGLISH))
    return rows.groupBy("lang", T.block_type(F.col("line"), ENGLISH).alias("block_type")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CAST(len(text) AS INTEGER) AS n_chars, CAST({WORDS.format('text')} AS INTEGER) AS n_words FROM documents")
def wordcount_charcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code points and words."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n_chars"), T.word_count(F.col("text")).alias("n_words"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, ' tion') THEN rtrim(regexp_extract(text, '(?s)^(.*?(?: tion)[^\n]*)', 1)) ELSE text END AS cut, regexp_matches(text, ' tion') AS stopped FROM documents")
def truncate_at_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text up to the end of the line with the first marker."""
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_at(F.col("text"), " tion").alias("cut"), F.col("text").rlike(" tion").alias("stopped"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\.\n', '.' || chr(10) || chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\.\n', '.' || chr(10) || chr(10), 'g'), chr(10)), 1) AS n FROM documents),
g AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM l),
p AS (SELECT doc_id, island, min(n) AS start_line, max(n) AS end_line, string_agg(rtrim(line), chr(10) ORDER BY n) AS text FROM g WHERE trim(line) <> '' GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) AS INTEGER) AS par, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, text FROM p""")
def paragraph_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs between blank lines, here one after each sentence that ends a line."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("text", F.regexp_replace("text", r"\.\n", ".\n\n"))
    return paragraphs.paragraphs(paragraphs.lines(docs))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\.\n', '.' || chr(10) || ' ' || chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\.\n', '.' || chr(10) || ' ' || chr(10), 'g'), chr(10)), 1) AS n FROM documents),
g AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare, sum(CASE WHEN regexp_full_match(line, '\s*') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) AS INTEGER) AS par, CAST(min(n) AS INTEGER) AS start_line, CAST(max(n) AS INTEGER) AS end_line, string_agg(bare, ' ' ORDER BY n) AS text FROM g WHERE bare <> '' GROUP BY doc_id, island""")
def spoken_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, second form: paragraphs as a translation takes them, lines stripped at both ends and joined by a space."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("text", F.regexp_replace("text", r"\.\n", ".\n \n"))
    return paragraphs.paragraphs(paragraphs.lines(docs), sep=" ", strip="both")


@query(rf"""WITH l AS (SELECT doc_id, line_no, line FROM ({LINES}) WHERE NOT {NOISE}),
s AS (SELECT *, coalesce(lag(regexp_matches(line, 'es\.$')) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS goes_on FROM l),
g AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM s)
SELECT doc_id, CAST(island AS BIGINT) AS par, CAST(min(line_no) AS INTEGER) AS start_line, CAST(max(line_no) AS INTEGER) AS end_line, string_agg(line, ' ' ORDER BY line_no) AS text FROM g GROUP BY doc_id, island""")
def stitched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end in a connector (here "es.") take in the next."""
    from dataclasses import replace

    pars = document_lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("par"), F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.col("line").alias("text"))
    return paragraphs.stitched(pars, lex=replace(ENGLISH, dangling=r"es\.$"))


@query("SELECT md5(text) AS md5, min(doc_id) AS doc_id, count(*) - 1 AS n_dropped FROM documents GROUP BY 1")
def dedupe_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each text, the one of the least id."""
    return curation.best_of_copies(table(spark, sf_dir, "documents"), F.col("text"), [F.col("doc_id")], ["doc_id"])


@query("""SELECT doc_id, name || repeat('_b', CAST(row_number() OVER (PARTITION BY name ORDER BY doc_id) - 1 AS INTEGER)) AS unique_id
FROM (SELECT doc_id, lang || '_' || n_chars AS name FROM documents)""")
def suffixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made unique by a suffix."""
    named = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", "lang", F.col("n_chars").cast("string")).alias("name"))
    return curation.unique_ids(named, "name", ["doc_id"]).select("doc_id", "unique_id")


@query(rf"SELECT doc_id, source FROM documents WHERE {WORDS.format('text')} >= 20 AND trim(text) <> '' ORDER BY md5(CAST(doc_id AS VARCHAR) || '-20260704'), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 50 of at least 20 words that hangs on the seed alone."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.col("doc_id").cast("string").alias("speech_id"), F.col("lang").alias("inferred_date"), T.word_count(F.col("text")).alias("word_count"))
    return review.sample_rows(rows).select("doc_id", "source")


@query()
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that the standard generator draws from those of at least 20 words, in order of their ids, and their place in its sample."""
    rows = table(spark, sf_dir, "documents").where((T.word_count(F.col("text")) >= 20) & (F.trim("text") != "")).select("doc_id", "source")
    return curation.drawn(rows, [F.col("doc_id")], 50, 20260704)


@query()
def exact_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document stands after the standard generator's shuffle of them in order of their ids."""
    return curation.shuffled(table(spark, sf_dir, "documents").select("doc_id", "source"), [F.col("doc_id")], 20260702)


@query("SELECT doc_id, lang FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 7 <> 0)")
def queue_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose file isn't in a queue, in which some lines are comments and some are blank."""
    docs = table(spark, sf_dir, "documents").withColumn("stem", F.concat(F.lit("doc.v"), F.col("doc_id").cast("string")))
    line = F.concat(F.when(F.col("doc_id") % 7 == 0, " # ").otherwise(" todo/"), F.col("stem"), F.lit(".pdf "))
    queue = docs.where("doc_id % 3 = 0").select(F.explode(F.array(line, F.lit("  "))).alias("value"))
    return review.pending(docs, corpus.queued_stems(queue), ["stem"]).select("doc_id", "lang")


@query("SELECT doc_id, source, CASE WHEN len(text) > 130 THEN left(text, 127) || '...' ELSE text END AS short FROM documents WHERE contains(lower(source), 'rc1')")
def short_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that hold a string, texts cut with an ellipsis."""
    rows = table(spark, sf_dir, "documents").where(F.contains(F.lower("source"), F.lit("rc1")))
    return rows.select("doc_id", "source", T.ellipsis(F.col("text")).alias("short"))


@query("""SELECT d.doc_id, coalesce(l.n, 0) AS n_labels, coalesce(c.n, 0) AS n_turns FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c ON d.doc_id = c.conv_id""")
def manifest_left_default0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two other tables, 0 where there are none."""
    n = lambda name, key: table(spark, sf_dir, name).groupBy(F.col(key).alias("doc_id")).agg(F.count("*").alias(name))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(n("labels", "doc_id"), "doc_id", "left").join(n("conversations", "conv_id"), "doc_id", "left")
    return docs.select("doc_id", F.coalesce("labels", F.lit(0)).alias("n_labels"), F.coalesce("conversations", F.lit(0)).alias("n_turns"))
