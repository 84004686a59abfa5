"""Operator 11: conversations repaired by the cheapest edits, a dynamic programme over the turns that stay."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import saved

#: Costs of the edits; a truncated turn that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns of one piece of a conversation: pieces are solved apart and then put together.
PIECE = 5_000
BLANKS = " \t\n\x0b\f\r"
#: What the repaired conversation ends with so far: nothing, or a role's initial.
STATES = ["", "s", "u", "a"]
#: Turns to insert between a state and the next turn that stays, and after the last one.
BETWEEN = {"": {"s": 0, "u": 0, "a": 1}, "s": {"u": 0, "a": 1}, "u": {"u": 1, "a": 0}, "a": {"u": 0, "a": 1}}
AT_END = {"": 0, "s": 2, "u": 1, "a": 0}
NAMES = {"u": "user", "a": "assistant"}
ORDER = ["conv_id", "has_turn", "turn", "role", "h"]
#: A piece's own figures, and those of a whole conversation.
FIGURES = "n long, low long, high long, turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, first string, last string"
WHOLE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows with planted faults by the checksum of ``conv_id:turn`` modulo 20.

    0 drops a row (copies 0), 1 empties its text, 2 takes its sentence ends away, 3 repeats it (copies 2), 4 makes it
    the user's. Nulls count as one space, in the checksum and as role and text.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def keyed(rows: DataFrame) -> DataFrame:
    """With the order of turns as columns without nulls: null turns first, then by turn, role and digest of role and text."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    spaced = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies"))
    h = F.md5(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    return spaced.select("conv_id", F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), "role", h.alias("h"), "text", "copies")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, has_turn, turn, role, h, initial, fault, copies) without texts, equal rows of one turn as one.

    A row is a duplicate unless its turn is the first of the conversation that has its role and text. First turns are an
    aggregation that starts in each task, and rows look theirs up by conversation, turn and digest at once: no key is hot.
    """
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", "b").when(~end.isin(".", "!", "?"), "t").otherwise("")
    marked = rows.where("copies > 0").select(*ORDER, fault.alias("fault"), "copies").groupBy(*ORDER, "fault").agg(F.sum("copies").alias("copies"))
    marked = saved(marked, "turns")
    firsts = marked.where("fault <> 'b'").groupBy("conv_id", "h").agg(F.min(F.struct("has_turn", "turn")).alias("t"))
    firsts = firsts.select(F.col("conv_id").alias("c_"), F.col("h").alias("h_"), F.col("t.has_turn").alias("has_"), F.col("t.turn").alias("t_"))
    on = F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("h") == F.col("h_")) & (F.col("has_turn") == F.col("has_")) & (F.col("turn") == F.col("t_"))
    kind = F.when((F.col("fault") == "b") | F.col("h_").isNotNull(), F.col("fault")).otherwise("d")
    return marked.join(firsts, on, "left").select(*ORDER, F.substring("role", 1, 1).alias("initial"), kind.alias("fault"), "copies")


def solve(turns: list[tuple[str, str, int]]) -> tuple[list[int | None], list[str | None]]:
    """Least costs and their audits of (initial, fault, copies) turns, for each state before (row) and after (column).

    Backwards over the turns that may stay, as what they are or with another role: what comes after one is another that
    stays or the end, and what lies between is deleted, which sums of deletions before each turn price. So for each
    role the least of (cost from a later turn on plus the deletions before it) is all that a turn needs of those after it.
    Of equal costs the audit that is least by its letters wins: deletions sort first, so the later next turn wins; then
    more insertions; then to keep before to rerole.
    """
    before, total = [], 0
    for _, _, copies in turns:
        before.append(total)
        total += DELETE * copies
    costs: list[int | None] = [None] * 16
    audits: list[str | None] = [None] * 16
    for x, after in enumerate(STATES):
        #: Of each role the least (cost from a turn on plus the deletions before it), and minus that turn's place.
        least: dict[str, tuple[int, int]] = {}
        way: dict[tuple[int, str], tuple[int, str] | None] = {}

        def follow(state: str, gone: int, after: str = after, least: dict = least) -> tuple[int, tuple[int, str] | None] | None:
            """The least cost after ``state`` when all deletions up to ``gone`` are paid, and the next turn with its role."""
            found = (total - gone, -len(turns), 0, "", None) if state == after else None
            for q, extra in BETWEEN[state].items():
                if q in least:
                    cost, place = least[q]
                    here = (cost - gone + INSERT * extra, place, -extra, "K" if turns[-place][0] == q else "R", (-place, q))
                    if found is None or here < found:
                        found = here
            return found and (found[0], found[4])

        for j in range(len(turns) - 1, -1, -1):
            initial, fault, _ = turns[j]
            if fault in ("b", "d"):
                continue
            new = []
            for q in ("s", "u", "a"):
                if q != initial and q == "s":
                    continue
                ahead = follow(q, before[j] + DELETE)
                if ahead:
                    own = (0 if q == initial else REROLE) + (TRUNCATED if fault == "t" else 0)
                    way[j, q] = ahead[1]
                    new.append((q, (own + ahead[0] + before[j], -j)))
            for q, here in new:
                if q not in least or here[0] < least[q][0]:
                    least[q] = here
        for e, state in enumerate(STATES):
            found = follow(state, 0)
            if found is None:
                continue
            out, at, step = [], 0, found[1]
            while step is not None:
                j, q = step
                out.append("D" * ((before[j] - at) // DELETE) + "I" * BETWEEN[state][q] + ("K" if turns[j][0] == q else "R"))
                at, state, step = before[j] + DELETE, q, way[j, q]
            out.append("D" * ((total - at) // DELETE))
            costs[4 * e + x], audits[4 * e + x] = found[0], "".join(out)
    return costs, audits


def pieces(rows: DataFrame) -> DataFrame:
    """One row for each run of at most PIECE turns of a conversation: its figures, costs and audits from state to state."""
    schema = f"conv_id long, has_turn boolean, turn long, role string, h string, {FIGURES}, costs array<long>, audits array<string>"
    kinds = [*["conv_id", "has_turn", "turn", "role", "h"], *[f.split()[0] for f in FIGURES.split(", ")], "costs", "audits"]

    def piece(run: list[tuple]) -> dict:
        turns = [r[2] for r in run if r[1]]
        faults = lambda k: sum(r[7] if k == "b" else 1 for r in run if r[6] == k)  # noqa: E731
        again = sum(r[7] - 1 for r in run if r[6] in ("", "t")) + sum(r[7] for r in run if r[6] == "d")
        marks = [r[5] for r in run]
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False)) + sum(r[7] - 1 for r in run)
        costs, audits = solve([r[5:8] for r in run])
        own = [sum(r[7] for r in run), min(turns, default=None), max(turns, default=None), len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None, faults("b"), again, faults("t"), wrong, marks[0], marks[-1]]
        return dict(zip(kinds, [*run[0][:5], *own, costs, audits], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_arrow = pa.schema([
            ("conv_id", pa.int64()), ("has_turn", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("h", pa.string()), *[(k, pa.string() if k in ("first", "last") else pa.int64()) for k in kinds[5:17]],
            ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
        ])  # fmt: skip
        held: list[tuple] = []
        for batch in batches:
            out = []
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (held[0][0] != r[0] or len(held) == PIECE):
                    out.append(piece(held))
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, to_arrow)
        if held:
            yield pa.RecordBatch.from_pylist([piece(held)], to_arrow)

    return rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(run, schema)


def settle(found: list[dict]) -> tuple[dict, list[tuple[int, str, int]]]:
    """A conversation's figures, and of each of its pieces the way taken (4 * state before + state after), the state before and the turns inserted after it."""
    lows, highs = [p["low"] for p in found if p["low"] is not None], [p["high"] for p in found if p["high"] is not None]
    turns, wrong, last_turn = 0, 0, None
    for i, p in enumerate(found):
        turns += p["turns"] - (p["turns"] > 0 and p["first_turn"] == last_turn)
        last_turn = p["last_turn"] if p["turns"] else last_turn
        wrong += p["illegal"] + (i > 0 and found[i - 1]["last"] + p["first"] not in ("su", "ua", "au"))
    ahead: list[tuple[int, int] | None] = [(INSERT * AT_END[s], -1) for s in STATES]
    ways = []
    for p in reversed(found):
        best: list[tuple[int, int] | None] = []
        for e in range(4):
            # pieces of one length: of two audits neither begins the other, so the rest doesn't decide between them
            here = [(p["costs"][4 * e + x] + ahead[x][0], p["ranks"][4 * e + x], x) for x in range(4) if p["costs"][4 * e + x] is not None and ahead[x] is not None]
            best.append(min(here)[::2] if here else None)
        ways.append(best)
        ahead = best
    taken, state = [], 0
    for best in reversed(ways):
        to = best[state][1]
        taken.append((4 * state + to, STATES[state], 0))
        state = to
    taken[-1] = (*taken[-1][:2], AT_END[STATES[state]])
    gaps = min(highs and max(highs) - min(lows) + 1 - turns or 0, (1 << 63) - 1)
    return {"gaps": gaps, **{k: sum(p[k] for p in found) for k in ("blank", "duplicate", "truncated")}, "illegal": wrong, "cost": ahead[0][0]}, taken


def audited(rows: DataFrame) -> DataFrame:
    """(conv_id, has_turn, turn, role, h, audit, state, more, figures): each piece's share of its conversation's audit.

    ``state`` is the last role's initial before the piece, ``more`` the turns inserted at the conversation's end. The
    conversation's figures stand in its first piece.
    """
    all_pieces = saved(pieces(saved(faults(rows), "faults")).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    # of the audits only their order is needed to choose
    rank = F.transform("audits", lambda a: F.when(a.isNotNull(), F.array_position(F.array_sort(F.array_distinct("audits")), a)).cast("long"))
    light = all_pieces.withColumn("ranks", rank).drop("audits")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_arrow = pa.schema([("piece", pa.int64()), ("way", pa.int32()), ("state", pa.string()), ("more", pa.int32()), ("figures", pa.struct([(k, pa.int64()) for k in names]))])

        def rows_of(found: list[dict]) -> list[dict]:
            figures, taken = settle(found)
            return [{"piece": p["piece"], "way": w, "state": s, "more": more, "figures": None if i else figures} for i, (p, (w, s, more)) in enumerate(zip(found, taken, strict=True))]

        held: list[dict] = []
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                if held and held[0]["conv_id"] != p["conv_id"]:
                    out += rows_of(held)
                    held = []
                held.append(p)
            if out:
                yield pa.RecordBatch.from_pylist(out, to_arrow)
        if held:
            yield pa.RecordBatch.from_pylist(rows_of(held), to_arrow)

    chosen = light.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(run, f"piece long, way int, state string, more int, figures struct<{WHOLE.replace(' ', ':').replace(',:', ',')}>")
    return all_pieces.join(chosen, "piece").select(*ORDER, F.element_at("audits", F.col("way") + 1).alias("audit"), "state", "more", "figures")


def streamed(rows: DataFrame) -> DataFrame:
    """Pieces and turns of each conversation in one stream: a piece stands before its first turn. One shuffle moves the texts."""
    piece = saved(audited(rows), "audits").select(*ORDER, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), "audit", "state", "more", "figures")
    turn = rows.select(*ORDER, F.lit(1).alias("kind"), "text", "copies")
    for c in ("audit", "state", "more", "figures"):
        turn = turn.withColumn(c, F.lit(None).cast(piece.schema[c].dataType))
    both = piece.unionByName(turn.withColumn("text", F.when(F.col("copies") > 0, F.col("text"))))
    return both.repartition("conv_id").sortWithinPartitions(*ORDER, "kind")


class Reader:
    """Follows the audit of one conversation along its turns."""

    def __init__(self) -> None:
        self.audit, self.at, self.state, self.more, self.figures = "", 0, "", 0, None

    def piece(self, audit: str, state: str, more: int, figures: dict | None) -> None:
        self.audit, self.at, self.state, self.more = audit, 0, state, more
        self.figures = self.figures or figures

    def next_role(self) -> str:
        return "assistant" if self.state == "u" else "user"

    def inserted(self) -> tuple[str, str, str]:
        role = self.next_role()
        self.state = role[:1]
        return "I", role, ""

    def turn(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what is put before a turn and what it becomes; nothing if it is deleted."""
        for _ in range(copies):
            while self.audit[self.at] == "I":
                self.at += 1
                yield self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                name = role if edit == "K" else self.next_role()
                self.state = name[:1]
                yield edit, name, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        for _ in range(self.more):
            yield self.inserted()


def events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, object]]:
    """Of a stream: ("start", conv_id), ("audit", piece), ("turn", (edit, role, text)), ("end", figures), ("batch", None) after each batch."""
    reader, now = None, None
    for batch in batches:
        for conv, _, _, role, _, kind, text, copies, audit, state, more, figures in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if reader is None or conv != now:
                if reader:
                    yield from (("turn", t) for t in reader.end())
                    yield "end", reader.figures
                reader, now = Reader(), conv
                yield "start", conv
            if kind == 0:
                reader.piece(audit, state, more, figures)
                yield "audit", audit + "I" * more
            else:
                yield from (("turn", t) for t in reader.turn(role, text, copies))
        yield "batch", None
    if reader:
        yield from (("turn", t) for t in reader.end())
        yield "end", reader.figures
        yield "batch", None


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``rows`` has conv_id, turn, role, text and perhaps copies, how often a row stands there (0: only its conversation is
    known). A row that is blank, the repeat of an earlier one in role and text, or cut off before a sentence's end has
    that fault, the first that fits. Turns are kept, get another role (3), are deleted (4; blank and repeated ones must
    be), empty ones are inserted (3) until roles read ``(s?(ua)+)?`` by their initials; a cut-off turn that stays adds 3.
    The audit has the cheapest edits in order, of equal costs the least by its letters; the digest is that of the
    repaired turns ``role:text``, joined by line breaks.

    Turns are solved in pieces of PIECE rows, so a conversation of any length is spread over tasks; pieces are put
    together from their costs, and one stream, sorted by conversation and turn, applies the audit and takes the digest,
    which has to be taken in order: it holds the audit and one batch of turns.

    Nulls: a null role or text is one space; a null turn comes first; null ids are one conversation. Rows of one turn are
    ordered by role and digest of the text. An empty role has no initial and can't be kept. A conversation without rows
    has zeros, an empty audit and the digest of nothing. Other columns are ignored; an empty table gives no rows.
    """
    figures = [f.split()[0] for f in WHOLE.split(", ")]
    to_arrow = pa.schema([("conv_id", pa.int64()), *[(k, pa.int64()) for k in figures], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for what, x in events(batches):
            if what == "start":
                conv, audit, digest, lines = x, [], hashlib.sha256(), 0
            elif what == "audit":
                audit.append(x)
            elif what == "turn":
                digest.update(f"{chr(10) if lines else ''}{x[1]}:{x[2]}".encode("utf-8", "replace"))
                lines += 1
            elif what == "end":
                out.append({"conv_id": conv, **(x or dict.fromkeys(figures, 0)), "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
            elif out:
                yield pa.RecordBatch.from_pylist(out, to_arrow)
                out = []

    return streamed(keyed(rows)).mapInArrow(run, f"conv_id long, {WHOLE}, audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations themselves, inserted turns with empty texts."""
    to_arrow = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for what, x in events(batches):
            if what == "start":
                conv, place = x, 0
            elif what == "turn":
                out.append({"conv_id": conv, "place": place, "edit": x[0], "role": x[1], "text": x[2]})
                place += 1
            elif what == "batch" and out:
                yield pa.RecordBatch.from_pylist(out, to_arrow)
                out = []

    return streamed(keyed(rows)).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


#: Step by step over all conversations: the cheapest (cost, audit) of each state, a turn after another.
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT keyed.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS f FROM keyed, bits),
damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, rtrim(text, E' 	
') AS bare FROM damaged),
rows AS (SELECT *, left(role, 1) AS q, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p, CASE WHEN bare = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
states(state, q, k, filled) AS (VALUES ('', 's', 0, ''), ('', 'u', 0, ''), ('', 'a', 1, chr(10) || 'user:'), ('s', 'u', 0, ''), ('s', 'a', 1, chr(10) || 'user:'), ('u', 'a', 0, ''), ('u', 'u', 1, chr(10) || 'assistant:'), ('a', 'u', 0, ''), ('a', 'a', 1, chr(10) || 'user:')),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS state, struct_pack(cost := 0::BIGINT, audit := '', lines := '') AS best FROM (SELECT DISTINCT conv_id FROM rows)
  UNION ALL
  SELECT conv_id, i, state, min(best) FROM (
    SELECT s.conv_id, r.i, s.state, struct_pack(cost := s.best.cost + 4, audit := s.best.audit || 'D', lines := s.best.lines) AS best FROM steps s JOIN rows r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = s.i + 1
    UNION ALL
    SELECT s.conv_id, r.i, m.q, struct_pack(cost := s.best.cost + 3 * m.k + CASE WHEN m.q = r.q THEN 0 ELSE 3 END + CASE r.fault WHEN 't' THEN 3 ELSE 0 END, audit := s.best.audit || repeat('I', m.k) || CASE WHEN m.q = r.q THEN 'K' ELSE 'R' END,
      lines := s.best.lines || m.filled || chr(10) || CASE WHEN m.q = r.q THEN r.role WHEN m.q = 'u' THEN 'user' ELSE 'assistant' END || ':' || r.text)
    FROM steps s JOIN rows r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = s.i + 1 JOIN states m ON m.state = s.state AND (m.q = r.q OR m.q <> 's') WHERE r.fault NOT IN ('b', 'd')
  ) GROUP BY conv_id, i, state),
last AS (SELECT conv_id, max(i) AS i FROM rows GROUP BY conv_id),
ended AS (SELECT s.conv_id, min(struct_pack(cost := s.best.cost + CASE s.state WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END, audit := s.best.audit || CASE s.state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
    lines := s.best.lines || CASE s.state WHEN 's' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 'u' THEN chr(10) || 'assistant:' ELSE '' END)) AS best
  FROM steps s JOIN last l ON s.conv_id IS NOT DISTINCT FROM l.conv_id AND s.i = l.i GROUP BY s.conv_id),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (p || q NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
  coalesce(best.audit, '') AS audit, sha256(substr(coalesce(best.lines, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""
