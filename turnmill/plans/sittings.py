"""Queries on dates, calendars and gates, over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import dates as D
from turnmill.operators import sittings
from turnmill.registry import query, table
from turnmill.storage import saved


@query("""SELECT o_orderkey, CASE WHEN isodow(o_orderdate) - 1 < 5 THEN 'pass' ELSE 'fail' END AS weekday, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_no FROM orders""")
def weekday_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weekdays from Monday, 0."""
    day = F.weekday("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(day < 5, "pass").otherwise("fail").alias("weekday"), day.alias("day_no"))


@query("""SELECT o_orderkey, CASE WHEN d < '2011-02-01' THEN '2009-2011' WHEN d < '2014-11-15' THEN '2011-2014' WHEN d < '2019-11-13' THEN '2014-2019' WHEN d < '2022-06-01' THEN '2019-2024' ELSE '2023-2027' END AS period,
CASE WHEN y <= 2010 THEN '2009-2011' WHEN y <= 2013 THEN '2011-2014' WHEN y <= 2018 THEN '2014-2019' WHEN y <= 2021 THEN '2019-2024' ELSE '2023-2027' END AS period_by_year
FROM (SELECT o_orderkey, strftime(o_orderdate + INTERVAL 18 YEAR, '%Y-%m-%d') AS d, year(o_orderdate + INTERVAL 18 YEAR) AS y FROM orders)""")
def period_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open periods by date, and by year where there is no date."""
    moved = F.col("o_orderdate") + F.expr("INTERVAL '18' YEAR")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(moved, "yyyy-MM-dd").alias("d"), F.year(moved).alias("y"))
    return rows.select("o_orderkey", D.legislature(F.col("d"), F.col("y")).alias("period"), D.legislature(F.lit(None).cast("string"), F.col("y")).alias("period_by_year"))


@query("""SELECT o_orderkey, y || '-' || (y + 1) AS period, make_date(y, 9, 1) AS first_day, make_date(y + 1, 8, 31) AS last_day FROM (SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 9 THEN 0 ELSE 1 END AS INTEGER) AS y FROM orders)""")
def parl_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year from September to August, and its bounds."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", D.parliamentary_year(F.col("o_orderdate")).alias("period"))
    low, high = D.year_bounds(F.col("period"))
    return rows.select("o_orderkey", "period", low.alias("first_day"), high.alias("last_day"))


@query("""WITH h AS (SELECT o_orderkey, CAST(1350 + o_orderkey % 100 AS BIGINT) AS y, CAST(1 + o_orderkey % 12 AS BIGINT) AS m, CAST(1 + o_orderkey % 29 AS BIGINT) AS d FROM orders)
SELECT o_orderkey, DATE '1970-01-01' + CAST((11 * y + 3) // 30 + 354 * y + 30 * m - (m - 1) // 2 + d + 1948440 - 385 - 2440588 AS INTEGER) AS greg FROM h""")
def hijri_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tabular Hijri dates made from order numbers."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.hijri_to_gregorian(1350 + k % 100, 1 + k % 12, 1 + k % 29).alias("greg"))


@query("""WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, o_orderkey FROM orders), c AS (SELECT o_custkey, date, count(*) AS n, min(o_orderkey) AS first FROM d GROUP BY 1, 2)
SELECT o_custkey, date, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first) AS r FROM c) WHERE r = 1""")
def scan_dates_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates scanned from text; the most common of a customer, the first seen of equals."""
    text = F.concat_ws(" ", F.lit("order"), F.date_format("o_orderdate", "d/M/yyyy"), F.lit("for 99/99/2020"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.explode(D.dates_in_line(text)).alias("date"))
    return sittings.most_common(rows, "o_custkey", "date", ["o_orderkey"])


STATES = """WITH g AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'pass' WHEN l_returnflag = 'R' THEN 'fail' ELSE 'na' END AS weekday, CASE WHEN l_linestatus = 'F' THEN 'pass' WHEN l_quantity > 45 THEN 'fail' ELSE 'na' END AS sequence,
CASE WHEN l_quantity < 10 THEN 'fail' WHEN l_quantity < 30 THEN 'pass' ELSE 'na' END AS recurrence, CASE WHEN l_discount > 0.08 THEN 'fail' WHEN l_discount > 0.04 THEN 'pass' ELSE 'na' END AS collision, CASE WHEN l_tax > 0.04 THEN 'pass' ELSE 'fail' END AS marsad FROM lineitem)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, q = F.col("l_returnflag"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(f == "A", "pass").when(f == "R", "fail").otherwise("na").alias("weekday"), F.when(F.col("l_linestatus") == "F", "pass").when(q > 45, "fail").otherwise("na").alias("sequence"),
        F.when(q < 10, "fail").when(q < 30, "pass").otherwise("na").alias("recurrence"), F.when(F.col("l_discount") > 0.08, "fail").when(F.col("l_discount") > 0.04, "pass").otherwise("na").alias("collision"), F.when(F.col("l_tax") > 0.04, "pass").otherwise("fail").alias("marsad"),
    )


@query(STATES + """ SELECT gate, count(*) FILTER (state = 'pass') AS pass, count(*) FILTER (state = 'fail') AS fail, count(*) FILTER (state = 'na') AS na
FROM (UNPIVOT g ON weekday, sequence, recurrence, collision, marsad INTO NAME gate VALUE state) GROUP BY gate""")
def pivot_gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: gates by state."""
    return sittings.gate_states(states(spark, sf_dir), ["l_orderkey", "l_linenumber"], ["weekday", "sequence", "recurrence", "collision", "marsad"])


@query(STATES + """ , n AS (SELECT *, (weekday = 'pass')::INT + (sequence = 'pass')::INT + (recurrence = 'pass')::INT + (collision = 'pass')::INT + (marsad = 'pass')::INT AS p, (recurrence = 'fail')::INT + (sequence = 'fail')::INT + (collision = 'fail')::INT AS hard, (weekday = 'fail')::INT + (marsad = 'fail')::INT AS soft FROM g)
SELECT l_orderkey, l_linenumber, CASE WHEN hard > 0 THEN 'conflict' WHEN soft > 0 AND p > 0 THEN 'soft_flag' WHEN soft > 0 THEN 'conflict' WHEN p >= 2 THEN 'confirmed' WHEN p = 1 THEN 'single_witness' ELSE 'unverifiable' END AS verdict FROM n""")
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, Q-G: the verdict of each row's gates."""
    gates = {g: F.col(g) for g in ("weekday", "sequence", "recurrence", "collision", "marsad")} | {"hijri": F.lit("na")}
    return states(spark, sf_dir).select("l_orderkey", "l_linenumber", sittings.verdict(F.lit("2020-01-01").cast("date"), gates).alias("verdict"))


@query(r"""SELECT o_orderkey, CAST(nullif(regexp_extract(stem, '__(\d+)$', 1), '') AS INTEGER) AS seq, CASE WHEN month(o_orderdate) IN (8, 9) THEN 'ext' ELSE 'num' END AS series, CAST(o_orderdate AS DATE) AS stem_date, CAST(year(o_orderdate) - 1 AS INTEGER) AS band_low
FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') || '__' || lpad(CAST(o_orderkey % 40 AS VARCHAR), 2, '0') AS stem FROM orders)""")
def stem_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, series, date and year band of names made from orders."""
    stem = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("__"), F.lpad((F.col("o_orderkey") % 40).cast("string"), 2, "0"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", stem.alias("stem"))
    parts = D.stem_parts(F.col("stem"))
    return rows.select("o_orderkey", parts["seq"].alias("seq"), parts["series"].alias("series"), parts["stem_date"].alias("stem_date"), D.year_band(F.col("stem"))["low"].alias("band_low"))


@query(r"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '_x' AS document_id, CAST(year(o_orderdate) AS INTEGER) AS year_start, strftime(o_orderdate, '%Y-%m-%d') AS inferred_date, year(o_orderdate) BETWEEN 1993 AND 1996 AS include FROM orders""")
def file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file's name says of its date."""
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_x_cleaned_clean.md"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))
    meta = D.file_meta(F.col("name"), (1993, 1996))
    return rows.select("o_orderkey", *[meta[k].alias(k) for k in ("document_id", "year_start", "inferred_date", "include")])


@query("""WITH RECURSIVE m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') || '__' || CAST(o_orderkey % 997 AS VARCHAR) AS doc_id, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 997 AS INTEGER) AS seq FROM orders),
s AS (SELECT *, (year(d) - CASE WHEN month(d) >= 9 THEN 0 ELSE 1 END) * 2 + CASE WHEN month(d) IN (8, 9) THEN 1 ELSE 0 END AS batch FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY seq, doc_id) AS i, count(*) OVER (PARTITION BY batch) AS k FROM s),
dp AS (SELECT batch, i, 1 AS best, [d] AS tails FROM o WHERE i = 1 UNION ALL
SELECT dp.batch, o.i, 1 + CAST(len(list_filter(tails, lambda t: t <= o.d)) AS INTEGER), list_concat(list_append(list_filter(tails, lambda t: t <= o.d), o.d), list_filter(tails, lambda t: t > o.d)[2:]) FROM dp JOIN o ON o.batch = dp.batch AND o.i = dp.i + 1),
b AS (SELECT o.batch, o.i, o.d, dp.best FROM dp JOIN o ON o.batch = dp.batch AND o.i = dp.i),
p AS (SELECT x.batch, x.i, min(y.i) AS prev FROM b x JOIN b y ON x.batch = y.batch AND y.best = x.best - 1 AND y.i < x.i AND y.d <= x.d GROUP BY 1, 2),
back AS (SELECT batch, min(i) AS i FROM b WHERE best = (SELECT max(best) FROM b z WHERE z.batch = b.batch) GROUP BY batch UNION ALL SELECT p.batch, p.prev FROM back JOIN p ON p.batch = back.batch AND p.i = back.i),
g AS (SELECT o.*, CASE WHEN k < 3 THEN 'na' WHEN back.i IS NULL THEN 'fail' ELSE 'pass' END AS sequence, CASE WHEN count(*) OVER (PARTITION BY d) > 3 THEN 'fail' ELSE 'pass' END AS collision FROM o LEFT JOIN back ON back.batch = o.batch AND back.i = o.i)
SELECT doc_id, doc_id || '.md' AS source_file, d AS final_date, 'name' AS date_source, 'na' AS weekday, 'na' AS hijri, 'pass' AS recurrence, 'na' AS marsad, sequence, collision,
1 + (sequence = 'pass')::INT + (collision = 'pass')::INT AS n_pass, (sequence = 'fail')::INT + (collision = 'fail')::INT AS n_fail,
CASE WHEN sequence = 'fail' OR collision = 'fail' THEN 'conflict' WHEN sequence = 'pass' OR collision = 'pass' THEN 'confirmed' ELSE 'single_witness' END AS verdict,
CAST(NULL AS DATE) AS suggested_date, 'recurrence:mode=' || strftime(d, '%Y-%m-%d') || 'x2' AS evidence FROM g""")
def date_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-G, J8, J11: the whole chain from manifest to verdict, over sittings made from all orders.

    Each date is its file's own and stands twice in the body, so the gates of sequence and collision decide.
    """
    rows = table(spark, sf_dir, "orders")
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("__"), (F.col("o_orderkey") % 997).cast("string"))
    manifest = rows.groupBy(name.alias("doc_id")).agg(F.min("o_orderdate").alias("d")).select("doc_id", F.concat("doc_id", F.lit(".md")).alias("md_file"), F.date_format("d", "yyyy-MM-dd").alias("sitting_date"), F.lit("name").alias("date_source"))
    bodies = manifest.select("doc_id", F.concat_ws("\n", F.lit("sitting of"), F.date_format("sitting_date", "d/M/yyyy"), F.date_format("sitting_date", "d-M-yyyy")).alias("body"))
    manifest, bodies = saved(manifest, "manifest"), saved(bodies, "bodies")
    tri = saved(sittings.triangulated(manifest), "triangulated")  # each stage is read several times by the next
    return sittings.gated(saved(sittings.merged(tri, sittings.resolved(tri, bodies)), "final"), bodies)


#: Weekdays from Monday and Hijri months from the first, as bodies name them.
DAYS = ("الاثنين", "الثلاثاء", "الاربعاء", "الخميس", "الجمعه", "السبت", "الاحد")
MONTHS = ("محرم", "صفر", "ربيع الاول", "ربيع الثاني", "جمادي الاولي", "جمادي الثانيه", "رجب", "شعبان", "رمضان", "شوال", "ذو القعده", "ذو الحجه")


def one_of(names: tuple[str, ...], number: str) -> str:
    """The SQL for the name with that number, from 1; the same in both engines."""
    return f"CASE {number} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names, 1)) + " END"


def hijri_parts(day: str) -> str:
    """SQL columns hy, hm, hd from ``day``, days since 1970, by the tabular calendar; ``//`` is whole division."""
    return f"""SELECT *, 30 * h1 + h3 - 30 AS hy, (24 * h4) // 709 AS hm, h4 - (709 * ((24 * h4) // 709)) // 24 AS hd FROM (
SELECT *, h2 - ((30 - h3) // 15) * ((17719 * h3) // 50) - (h3 // 16) * ((15238 * h3) // 43) + 29 AS h4 FROM (
SELECT *, ((10985 - h2) // 5316) * ((50 * h2) // 17719) + (h2 // 5670) * ((43 * h2) // 15238) AS h3 FROM (
SELECT *, h0 - 10631 * h1 + 354 AS h2 FROM (SELECT *, (h0 - 1) // 10631 AS h1 FROM (SELECT *, {day} + 2440588 - 1948440 + 10632 AS h0 FROM m)))))"""


#: What is said in the body of a sitting by its number: its weekday or another, its Hijri date or a month later, its date and the next day so many times.
SAID = f"""SELECT *, CASE seq % 3 WHEN 0 THEN {one_of(DAYS, 'wd')} WHEN 1 THEN {one_of(DAYS, '(wd % 7 + 1)')} END AS said, CASE seq % 4 WHEN 0 THEN hm WHEN 1 THEN hm % 12 + 1 END AS sm,
CASE seq % 5 WHEN 0 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 3 ELSE 0 END AS own, CASE seq % 5 WHEN 1 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 0 END AS other"""


@query("""WITH RECURSIVE m AS (SELECT DISTINCT strftime(o_orderdate + INTERVAL 22 YEAR, '%Y-%m-%d') || '__' || CAST(o_orderkey % 997 AS VARCHAR) AS doc_id, CAST(o_orderdate + INTERVAL 22 YEAR AS DATE) AS d, CAST(o_orderkey % 997 AS INTEGER) AS seq FROM orders),
s AS (SELECT *, (year(d) - CASE WHEN month(d) >= 9 THEN 0 ELSE 1 END) * 2 + CASE WHEN month(d) IN (8, 9) THEN 1 ELSE 0 END AS batch FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY seq, doc_id) AS i, count(*) OVER (PARTITION BY batch) AS k FROM s),
dp AS (SELECT batch, i, 1 AS best, [d] AS tails FROM o WHERE i = 1 UNION ALL
SELECT dp.batch, o.i, 1 + CAST(len(list_filter(tails, lambda t: t <= o.d)) AS INTEGER), list_concat(list_append(list_filter(tails, lambda t: t <= o.d), o.d), list_filter(tails, lambda t: t > o.d)[2:]) FROM dp JOIN o ON o.batch = dp.batch AND o.i = dp.i + 1),
b AS (SELECT o.batch, o.i, o.d, dp.best FROM dp JOIN o ON o.batch = dp.batch AND o.i = dp.i),
p AS (SELECT x.batch, x.i, min(y.i) AS prev FROM b x JOIN b y ON x.batch = y.batch AND y.best = x.best - 1 AND y.i < x.i AND y.d <= x.d GROUP BY 1, 2),
back AS (SELECT batch, min(i) AS i FROM b WHERE best = (SELECT max(best) FROM b z WHERE z.batch = b.batch) GROUP BY batch UNION ALL SELECT p.batch, p.prev FROM back JOIN p ON p.batch = back.batch AND p.i = back.i),
g0 AS (SELECT o.*, CASE WHEN k < 3 THEN 'na' WHEN back.i IS NULL THEN 'fail' ELSE 'pass' END AS sequence, CASE WHEN count(*) OVER (PARTITION BY d) > 3 THEN 'fail' ELSE 'pass' END AS collision FROM o LEFT JOIN back ON back.batch = o.batch AND back.i = o.i),
m2 AS (SELECT *, CAST(isodow(d) AS INTEGER) AS wd, CAST(d - DATE '1970-01-01' AS BIGINT) AS days FROM g0),
h AS (""" + hijri_parts("days").replace("FROM m)", "FROM m2)") + """),
t AS (""" + SAID + """ FROM h),
n AS (SELECT *, own + CASE WHEN said IS NULL THEN 0 ELSE 1 END AS own_n, CASE WHEN year(d + 1) <= year(d) + 1 THEN other ELSE 0 END AS other_n, DATE '1970-01-01' + CAST((11 * hy + 3) // 30 + 354 * hy + 30 * sm - (sm - 1) // 2 + hd + 1948440 - 385 - 2440588 AS INTEGER) AS greg FROM t),
r AS (SELECT *, greatest(own_n, other_n) AS top_n, own_n >= other_n AS own_first FROM n),
q AS (SELECT *, CASE WHEN said IS NULL THEN 'na' WHEN seq % 3 = 0 THEN 'pass' ELSE 'fail' END AS weekday, CASE WHEN sm IS NULL OR year(greg) NOT BETWEEN year(d) - 1 AND year(d) + 1 THEN 'na' WHEN abs(greg - d) <= 2 THEN 'pass' ELSE 'fail' END AS hijri,
CASE WHEN top_n < 2 THEN 'na' WHEN own_first OR own_n >= greatest(2, top_n - 1) THEN 'pass' WHEN top_n >= 3 AND own_n = 0 THEN 'fail' ELSE 'na' END AS recurrence,
CASE WHEN d NOT BETWEEN DATE '2014-12-01' AND DATE '2021-07-31' THEN 'na' WHEN d IN (SELECT CAST(l_shipdate + INTERVAL 22 YEAR AS DATE) FROM lineitem WHERE l_quantity >= 50) THEN 'pass' ELSE 'fail' END AS marsad FROM r),
v AS (SELECT *, (weekday = 'pass')::INT + (hijri = 'pass')::INT + (recurrence = 'pass')::INT + (marsad = 'pass')::INT + (sequence = 'pass')::INT + (collision = 'pass')::INT AS n_pass, (weekday = 'fail')::INT + (hijri = 'fail')::INT + (marsad = 'fail')::INT AS soft,
(recurrence = 'fail')::INT + (sequence = 'fail')::INT + (collision = 'fail')::INT AS hard FROM q)
SELECT doc_id, doc_id || '.md' AS source_file, d AS final_date, 'name' AS date_source, weekday, hijri, recurrence, marsad, sequence, collision, n_pass, soft + hard AS n_fail,
CASE WHEN hard > 0 THEN 'conflict' WHEN soft > 0 AND n_pass > 0 THEN 'soft_flag' WHEN soft > 0 THEN 'conflict' WHEN n_pass >= 2 THEN 'confirmed' WHEN n_pass = 1 THEN 'single_witness' ELSE 'unverifiable' END AS verdict,
CASE WHEN recurrence = 'fail' THEN d + 1 END AS suggested_date,
concat_ws('; ', CASE WHEN said IS NOT NULL THEN 'weekday:' || said END, CASE WHEN hijri <> 'na' THEN 'hijri:' || hd || ' ' || """ + one_of(MONTHS, "sm") + """ || ' ' || hy || '->' || strftime(greg, '%Y-%m-%d') END,
CASE WHEN top_n >= 2 THEN 'recurrence:mode=' || strftime(CASE WHEN own_first THEN d ELSE d + 1 END, '%Y-%m-%d') || 'x' || top_n END) AS evidence FROM v""")
def date_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-G with all six gates: the chain over sittings made from orders of the calendar's years, with bodies that differ and days of line items as the calendar."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderdate") + F.expr("INTERVAL '22' YEAR")).cast("date").alias("d"), (F.col("o_orderkey") % 997).cast("int").alias("seq"))
    m = rows.select(F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit("__"), F.col("seq").cast("string")).alias("doc_id"), "d", "seq").distinct()
    m = m.withColumn("wd", F.weekday("d") + 1).withColumn("days", F.unix_date("d").cast("long"))
    told = spark.sql(SAID + f" FROM ({hijri_parts('days').replace('//', 'div').replace('FROM m)', 'FROM {m})')})", m=m)
    date = lambda day: F.date_format(day, "d/M/yyyy")
    lines = F.array(
        F.lit("sitting of"), F.when(F.col("said").isNotNull(), F.concat(F.lit("يوم "), "said", F.lit(" "), date(F.col("d")))),
        F.when(F.col("sm").isNotNull(), F.concat(F.col("hd").cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, MONTHS)), F.col("sm").cast("int")), F.lit(" "), F.col("hy").cast("string"))),
        F.nullif(F.repeat(F.concat(date(F.col("d")), F.lit("\n")), F.col("own")), F.lit("")), F.nullif(F.repeat(F.concat(date(F.date_add("d", 1)), F.lit(" ")), F.col("other")), F.lit("")),
    )
    told = saved(told.withColumn("body", F.array_join(lines, "\n")), "told")
    manifest = told.select("doc_id", F.concat("doc_id", F.lit(".md")).alias("md_file"), F.date_format("d", "yyyy-MM-dd").alias("sitting_date"), F.lit("name").alias("date_source"))
    calendar = saved(table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select((F.col("l_shipdate") + F.expr("INTERVAL '22' YEAR")).cast("date").alias("day")).distinct(), "calendar")
    bodies = told.select("doc_id", "body")
    tri = saved(sittings.triangulated(manifest, calendar), "triangulated")
    return sittings.gated(saved(sittings.merged(tri, sittings.resolved(tri, bodies, calendar)), "final"), bodies, calendar)
