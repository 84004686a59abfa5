"""Names linked to a dimension table, tier by tier; each tier sees only what the earlier ones left."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import text as T
from turnmill.functions.lexicon import ARABIC, FUZZY_LEAST, FUZZY_RULES, Lexicon
from turnmill.sources.tables import TURN_FIELDS
from turnmill.storage import saved

#: Characters by which contained names and the texts around them meet.
GRAM = 8
#: Members linked with less confidence are to be reviewed.
REVIEW_BELOW = 0.78
#: Dimensions of at most this many counted bytes are broadcast; larger ones are joined by a shuffle.
ROSTER_BYTES = 24 << 20


def sized(dim: DataFrame, limit: int = ROSTER_BYTES) -> DataFrame:
    """``dim``, written once and counted: with the hint to broadcast it if its strings and 16 bytes a column are within ``limit``."""
    kept = saved(dim, "dimension")
    lengths = [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)) for f in kept.schema if f.dataType.simpleString() == "string"]
    size = kept.select(sum(lengths, F.count("*") * 16 * len(kept.columns))).first()[0]
    return F.broadcast(kept) if size <= limit else kept


def subsequence(small: Column, big: Column) -> Column:
    """Whether all words of ``small`` occur in ``big`` in their order: a fold that moves one pointer."""
    return F.aggregate(big, F.lit(0), lambda at, w: F.when(F.get(small, at) == w, at + 1).otherwise(at)) >= F.size(small)


def unique_match(cands: DataFrame, dim: DataFrame, on: Column, method: str, confidence: Column | float) -> DataFrame:
    """(cand_id, mp_id, method, confidence) of the candidates that exactly one row of ``dim`` matches."""
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    hits = cands.join(dim, (cands.period == dim.roster_period) & on).groupBy("cand_id").agg(F.count("*").alias("n"), F.min("mp_id").alias("mp_id"), F.min(conf).alias("confidence"))
    return hits.where("n = 1").select("cand_id", "mp_id", F.lit(method).alias("method"), "confidence")


def subsequence_match(cands: DataFrame, dim: DataFrame, method: str, confidence: float) -> DataFrame:
    """As ``unique_match``, for candidates of two words or more that a name holds in their order.

    A name that holds them has the first and, behind it, the last of them, so both sides meet by period and these two.
    """
    words = lambda c: F.split(F.col(c), " ")
    after = lambda w, i: F.transform(F.slice(words("name_norm"), i + 2, F.size(words("name_norm"))), lambda v: F.concat(w, F.lit(" "), v))
    named = dim.select("*", F.explode(F.array_distinct(F.flatten(F.transform(words("name_norm"), after)))).alias("name_ends"))
    many = cands.where(F.size(words("cand_norm")) >= 2)
    ends = F.col("name_ends") == F.concat(words("cand_norm")[0], F.lit(" "), F.element_at(words("cand_norm"), -1))
    return unique_match(many, named, ends & subsequence(words("cand_norm"), words("name_norm")), method, confidence)


def contained_match(cands: DataFrame, dim: DataFrame, method: str, confidence: float) -> DataFrame:
    """As ``unique_match``, for candidates whose text holds a name anywhere.

    A text that holds a name holds the name's first ``GRAM`` characters, so both sides meet by period and these.
    """
    begun = dim.where("name_norm <> ''").withColumn("name_gram", F.left("name_norm", F.lit(GRAM)))
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.length("cand_norm") - (k - 1)), lambda i: F.substring(F.col("cand_norm"), i, F.lit(k)))
    grams = F.array_distinct(F.concat(*[F.when(F.length("cand_norm") >= k, runs(k)).otherwise(F.array().cast("array<string>")) for k in range(1, GRAM + 1)]))
    near = cands.select("*", F.explode(grams).alias("gram"))
    return unique_match(near, begun, (F.col("gram") == F.col("name_gram")) & F.contains("cand_norm", "name_norm"), method, confidence)


def alias_match(cands: DataFrame, aliases: DataFrame, dim: DataFrame) -> DataFrame:
    """(cand_id, mp_id, method, confidence): candidates by their alias, if its person has one row in the candidate's period."""
    known = sized(aliases.groupBy("variant_norm").agg(F.min("mp_id").alias("alias_mp")))
    return unique_match(cands.join(known, cands.cand_norm == known.variant_norm), dim, F.col("alias_mp") == F.col("mp_id"), "alias_table", 0.9)


def leaders(rows: DataFrame, key: str, score: str, order: list) -> DataFrame:
    """The row of the greatest score of each key, with ``second``, the next score, 0 if there is none."""
    w = Window.partitionBy(key).orderBy(F.desc(score), *order)
    return rows.withColumn("second", F.coalesce(F.lead(score).over(w), F.lit(0).cast(rows.schema[score].dataType))).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def dominant(votes: DataFrame, key: str, value: str, first: str, factor: float) -> DataFrame:
    """(key, value, n): of the counted votes (key, value, n, first) the winner, if it is alone or leads the next by a factor; the first seen of equals."""
    top = leaders(votes, key, "n", [first])
    return top.where((F.col("second") == 0) | (F.col("n") >= factor * F.col("second"))).select(key, value, "n")


def ratio(a: str, b: str) -> Column:
    """The share of matching characters in longest-common-block order, as the standard library counts it."""
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)])

    return of(a, b)


def letter_bits(text: Column) -> Column:
    """64 bits, one set for each character with its number so far: a bit that another text lacks is a character that has no match there."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    numbered = F.transform(chars, lambda c, i: F.struct(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c))))
    return F.aggregate(numbered, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))


def similar_pairs(cands: DataFrame, dim: DataFrame, least: float = FUZZY_LEAST) -> DataFrame:
    """The pairs of one period whose texts are near enough to reach a ratio of ``least``.

    Texts of n and m characters reach it with ``both`` matched characters at least, in equal order on both sides, so that
    at most ``apart`` = n + m - 2 * both of theirs aren't matched. Of as many parts of the name and one more, some part k is
    in the candidate, with up to k unmatched characters before it and up to apart - k after it, which bounds its place
    there. Pairs meet by period, both lengths, k and that part, as distinct texts; then their letters and ``apart`` as the
    most that their distance can be decide.
    """
    share = least / (2 - least)
    n, m, both, apart, k, begin, end = map(F.col, ("n", "m", "both", "apart", "k", "begin", "end"))

    def with_parts(rows: DataFrame, period: str, text: str, own: str, other: str) -> DataFrame:
        """The distinct texts by the lengths of what is similar to them and by the name's parts, which begin and end at these places of the name."""
        texts = rows.select(period, text).distinct().withColumn(own, F.length(text)).where(F.col(own) > 0).withColumn("bits", letter_bits(F.col(text)))
        lengths = F.sequence(F.ceil(F.col(own) * share - 1e-9), F.floor(F.col(own) / share + 1e-9)).cast("array<int>")
        near = texts.select("*", F.explode(lengths).alias(other)).withColumn("both", F.ceil((n + m) * (least / 2) - 1e-9).cast("int"))
        near = near.where(both <= F.least(n, m)).withColumn("apart", n + m - 2 * both)
        cut = lambda i: F.floor(m * i / (apart + 1) + 1e-9).cast("int")
        return near.select("*", F.explode(F.sequence(F.lit(0), apart)).alias("k")).select("*", cut(k).alias("begin"), cut(k + 1).alias("end"))

    part = lambda period, text, at: F.xxhash64(period, n, m, k, F.substring(F.col(text), at + 1, end - begin)).alias("part")
    names = with_parts(dim, "roster_period", "name_norm", "m", "n").select("roster_period", "name_norm", F.col("bits").alias("name_bits"), part("roster_period", "name_norm", begin))
    names = names.hint("merge")  # these are more rows than ``dim``, which may have the hint to broadcast it
    low, high = F.greatest(both - m, -k, n - m + k - apart, -begin), F.least(n - both, k, n - m + apart - k, n - end)
    texts = with_parts(cands, "period", "cand_norm", "n", "m").where(low <= high).select("*", F.explode(F.sequence(low, high)).alias("shift"))
    texts = texts.select("period", "cand_norm", "bits", (n - both).alias("over"), (m - both).alias("lacking"), "apart", part("period", "cand_norm", begin + F.col("shift")))
    alike = F.expr("bit_count(bits & ~name_bits) <= over AND bit_count(name_bits & ~bits) <= lacking AND levenshtein(cand_norm, name_norm, apart) >= 0")
    pairs = texts.join(names, (texts.period == names.roster_period) & (texts.part == names.part) & alike).select("period", "cand_norm", "name_norm").distinct()
    found = cands.join(pairs, ["period", "cand_norm"]).withColumn("roster_period", F.col("period"))
    return found.join(dim, ["roster_period", "name_norm"])


def fuzzy_match(cands: DataFrame, dim: DataFrame, rules=FUZZY_RULES, least: float = FUZZY_LEAST) -> DataFrame:
    """(cand_id, mp_id, method, confidence): the best name of the period, if it leads the second by the rule's margin.

    Only ``similar_pairs`` are compared.
    """
    scored = similar_pairs(cands, dim, least).withColumn("ratio", ratio("cand_norm", "name_norm")).where(F.col("ratio") >= least)
    top = leaders(scored, "cand_id", "ratio", ["mp_id"])
    conf = F.lit(None).cast("double")
    for low, margin, c in reversed(rules):
        conf = F.when((F.col("ratio") >= low) & (F.col("ratio") - F.col("second") >= margin), c).otherwise(conf)
    named = F.concat(F.lit("fuzzy_period_roster:"), F.format_string("%.2f", F.bround("ratio", 2)))
    return top.withColumn("confidence", conf).where("confidence IS NOT NULL").select("cand_id", "mp_id", named.alias("method"), "confidence")


def link(candidates: DataFrame, roster: DataFrame, aliases: DataFrame | None = None, lex: Lexicon = ARABIC) -> DataFrame:
    """``candidates`` (candidate, period) with speaker_type, assignment_method, assignment_confidence and mp_id.

    Tiers: exact name, name contained, words in order, alias, fuzzy; then office or unmatched. Work is done on
    the distinct (candidate, period) and on what earlier tiers left; the results are joined back.
    ``roster``: mp_id, name, period. ``aliases``: variant_norm, mp_id.
    """
    norm = T.strip_honorifics(F.col("candidate"), lex)
    cands = candidates.select("candidate", "period").distinct().withColumn("cand_norm", norm).withColumn("cand_id", F.xxhash64("candidate", "period"))
    cands = cands.withColumn("full_norm", T.normalize(F.col("candidate"), lex))
    dim = roster.select("mp_id", F.col("period").alias("roster_period"), T.normalize(F.col("name"), lex).alias("name_norm")).where("name_norm <> ''")
    dim = sized(dim)
    cands = saved(cands, "candidates")
    tiers = [
        lambda c: unique_match(c, dim, c.cand_norm == dim.name_norm, "exact_period_roster", F.when(F.col("cand_norm") == F.col("full_norm"), 1.0).otherwise(0.95)),
        lambda c: contained_match(c, dim, "roster_name_contained_in_candidate", 0.9),
        lambda c: subsequence_match(c, dim, "candidate_tokens_in_roster_name", 0.9),
    ]
    if aliases is not None:
        tiers.append(lambda c: alias_match(c, aliases, dim))
    tiers.append(lambda c: fuzzy_match(c, dim))
    todo, found = cands.where("cand_norm <> ''"), None
    for tier in tiers:  # each tier's hits are written, so that none is computed again for those after it
        hit = saved(tier(todo), "tier")
        found = hit if found is None else found.unionByName(hit)
        todo = todo.join(hit.select("cand_id"), "cand_id", "left_anti")
    out = cands.join(found, "cand_id", "left")
    office = T.is_office(F.col("candidate"), lex)
    kind = F.when(F.col("cand_norm") == "", "unassigned").when(F.col("mp_id").isNotNull(), "mp").when(office, "office_or_role").otherwise("unmatched_candidate")
    method = F.when(F.col("cand_norm") == "", "empty_candidate").when(F.col("mp_id").isNotNull(), F.col("method")).when(office, "office_or_role_not_mp").otherwise("no_period_roster_match")
    conf = F.when(F.col("mp_id").isNotNull(), F.col("confidence")).when((F.col("cand_norm") != "") & office, 0.5).otherwise(0.0)
    linked = out.select(F.col("candidate").alias("c"), F.col("period").alias("p"), kind.alias("speaker_type"), method.alias("assignment_method"), conf.alias("assignment_confidence"), "mp_id")
    same = F.col("candidate").eqNullSafe(F.col("c")) & F.col("period").eqNullSafe(F.col("p"))
    return candidates.join(linked, same, "left").drop("c", "p")


def sole_owners(rows: DataFrame, token: str, owner: str) -> DataFrame:
    """(token, owner) of the tokens that one owner alone has."""
    return rows.groupBy(token).agg(F.count_distinct(owner).alias("n"), F.min(owner).alias(owner)).where("n = 1").drop("n")


def mined_aliases(linked: DataFrame, roster: DataFrame, order: str, lex: Lexicon = ARABIC) -> DataFrame:
    """(variant_norm, mp_id, roster_name, n_occurrences, source), learnt from ``linked`` candidates.

    An anchor is a name of two words or more that was resolved to one person, or three times as often to one as
    to the next. A name without a link takes the person of its distinctive words, if they belong to one.
    """
    norm = T.strip_honorifics(F.col("candidate"), lex)
    names = linked.withColumn("variant_norm", norm).where((F.size(F.split("variant_norm", " ")) >= 2) & ~T.is_office(F.col("candidate"), lex))
    votes = names.where("speaker_type = 'mp'").groupBy("variant_norm", "mp_id").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    anchors = dominant(votes, "variant_norm", "mp_id", "first", 3).select("variant_norm", "mp_id", F.col("n").alias("n_occurrences"), F.lit("anchor").alias("source"))
    period = names.groupBy("variant_norm").agg(F.min_by("period", order).alias("period"), F.count("*").alias("n_occurrences"))
    owned = roster.select("mp_id", "period", F.explode(F.array_distinct(F.split(T.normalize(F.col("name"), lex), " "))).alias("word")).where(F.length("word") >= 3)
    owners = owned.groupBy("period", "word").agg(F.count_distinct("mp_id").alias("k"), F.min("mp_id").alias("mp_id")).where("k = 1").drop("k")
    free = period.join(anchors.select("variant_norm"), "variant_norm", "left_anti")
    by_word = free.select("*", F.explode(F.array_distinct(F.split("variant_norm", " "))).alias("word")).join(owners, ["period", "word"])
    mined = by_word.groupBy("variant_norm").agg(F.count_distinct("mp_id").alias("k"), F.min("mp_id").alias("mp_id"), F.min("n_occurrences").alias("n_occurrences")).where("k = 1")
    both = anchors.unionByName(mined.select("variant_norm", "mp_id", "n_occurrences", F.lit("distinctive_token").alias("source")))
    names_of = roster.groupBy("mp_id").agg(F.min("name").alias("roster_name"))
    return both.join(names_of, "mp_id", "left").select("variant_norm", "mp_id", "roster_name", "n_occurrences", "source")


def alias_rows(aliases: DataFrame, order: str = "variant_norm") -> DataFrame:
    """The alias table as it is written: the most frequent first, then by ``order``."""
    return aliases.orderBy(F.desc("n_occurrences"), order)


def linked_turns(turns: DataFrame, roster: DataFrame, aliases: DataFrame | None = None, lex: Lexicon = ARABIC) -> DataFrame:
    """The turns of ``extract_turns`` with their speakers: all columns of ``TURN_FIELDS``, in order.

    ``roster``: mp_id, name, period, and name_transliterated, party and district where there are any. What isn't known
    is an empty string, as in the files; assignment_method is cue and tier, assignment_confidence text with two
    decimals, needs_review "1" unless the speaker is a member with a confidence of 0.78 or more.
    """
    extra = {"name": "mp_name_ar", "name_transliterated": "mp_name_transliterated", "party": "mp_party_ar", "district": "mp_district_ar"}
    have = [c for c in extra if c in roster.columns]
    people = roster.groupBy(F.col("mp_id").alias("person"), F.col("period").alias("person_period")).agg(F.min(F.struct(*have)).alias("about"))
    cues = saved(turns, "found-turns").withColumnsRenamed({"speaker_target_clean": "candidate", "legislature_period": "period", "assignment_method": "cue_method"})
    rows = link(cues, roster, aliases, lex)
    rows = rows.join(sized(people), (F.col("mp_id") == F.col("person")) & (F.col("period") == F.col("person_period")), "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sure = (F.col("speaker_type") == "mp") & (F.col("assignment_confidence") >= REVIEW_BELOW)
    made = {
        "legislature_period": text("period"), "speaker_target_clean": F.col("candidate"), "mp_id": text("mp_id"), "year_start": text("year_start"), "year_end": text("year_end"), "inferred_date": text("inferred_date"),
        "speaker_role": F.when(F.col("speaker_type") == "office_or_role", F.col("candidate")).otherwise(""), "assignment_method": F.concat_ws(":", "cue_method", "assignment_method"),
        "assignment_confidence": F.format_string("%.2f", "assignment_confidence"), "needs_review": F.when(sure, "").otherwise("1"),
    } | {v: text(f"about.{k}") if k in have else F.lit("") for k, v in extra.items()}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in TURN_FIELDS])


def speech_only(turns: DataFrame) -> DataFrame:
    """The turns that are speech, by their block type."""
    return turns.where(F.col("block_type").isin("speech", "speech_like"))
