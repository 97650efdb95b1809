"""Structure repair of conversations: faults, and the cheapest edits that give legal roles, by iterative-deepening A*.

Edits of a row are Delete, Insert before it, Keep, Rerole, tried in this order, that of their initials. A depth-first search under
a cost bound prunes by what is surely still to pay; states (row, role state) that failed keep the cost that they surely need,
so that a later search, under a higher bound, enters them only if the bound allows it. The first path that is accepted under
the first bound that accepts any is the cheapest one, and of equals the least in ASCII order.

A long conversation is cut into pieces of at most PIECE rows, which are searched on their own, from each role state to each. An insert
always stands before a row of its piece, so of two edit strings of a piece none begins the other: the order of whole
strings is that of their first different piece, and a piece is chosen by cost, the rank of what stands before, and its own string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import schema, staged, table

PIECE_BITS = 10
BLANKS = " \t\n\x0b\f\r"
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5  # costs; CUT_OFF for a truncated row that stays
START, SYSTEM, USER, ASSISTANT, ACCEPTED = range(5)  # role states by the last role; ACCEPTED is the end of a conversation
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})  # state and initial to state
NEXT = (USER, USER, ASSISTANT, USER)  # state after an inserted or changed role
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}


def damaged(turns: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after damage by crc32 of conv_id:turn, modulo 20. Nulls read as one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def named(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def placed(turns: DataFrame) -> DataFrame:
    """Rows in order of conversation and turn, each with its place: sorted over ranges, so that a conversation may span tasks."""
    rows = turns.select(
        named(F.col("conv_id")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "turns")


def with_faults(rows: DataFrame) -> DataFrame:
    """Of each placed row: conv, place, initial of the role, fault: b(lank), d(uplicate), t(runcated) or empty."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    told = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    seen = rows.select("conv", "place", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"), told.alias("told"))
    firsts = seen.groupBy("conv", "told").agg(F.min("place").alias("first"), F.count("*").alias("many")).where("many > 1").select("conv", "told", "first")
    fault = F.when(F.col("blank"), "b").when(F.col("place") > F.col("first"), "d").when(F.col("open"), "t").otherwise("")
    return seen.join(firsts, ["conv", "told"], "left").select("conv", "place", "initial", fault.alias("fault"))


class Search:
    """The edits of a sequence of rows, given by role initials and faults, that lead to one goal state."""

    def __init__(self, initials: list[str], faults: list[str], goal: int) -> None:
        self.rows, self.goal = list(zip(initials, faults, strict=True)), goal
        self.failed: dict[tuple[int, int], int] = {}  # what a state surely costs, learned from failures
        self.rest = [0]
        for initial, fault in reversed(self.rows):
            self.rest.append(self.rest[-1] + (DELETE if fault else 0 if initial in ("s", "u", "a") else REROLE))
        self.rest.reverse()

    def reachable(self, start: int) -> bool:
        """Whether any edits lead there: roles never go back to the start, and a system row comes first."""
        if self.goal == SYSTEM:
            return start == SYSTEM or start == START and any(initial == "s" and fault not in ("b", "d") for initial, fault in self.rows)
        return self.goal != START or start == START

    def least(self, at: int, state: int) -> int:
        return self.failed.get((at, state), self.rest[at])

    def edits(self, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(initial, cost, next row, next state), in ASCII order."""
        if at == len(self.rows):
            if self.goal == ACCEPTED:
                yield "I", INSERT, at, NEXT[state]
            return
        initial, fault = self.rows[at]
        yield "D", DELETE, at + 1, state
        yield "I", INSERT, at, NEXT[state]
        if fault not in ("b", "d"):
            cut = CUT_OFF if fault else 0
            if initial in AFTER[state]:
                yield "K", cut, at + 1, AFTER[state][initial]
            yield "R", REROLE + cut, at + 1, NEXT[state]

    def reached(self, at: int, state: int) -> bool:
        return at == len(self.rows) and (state in (START, ASSISTANT) if self.goal == ACCEPTED else state == self.goal)

    def cheapest(self, start: int) -> tuple[int, str]:
        """(cost, edits); the goal must be reachable."""
        while True:
            bound = self.least(0, start)
            path = self._within(start, bound)
            if path is not None:
                return bound, path

    def _within(self, start: int, bound: int) -> str | None:
        """The first path of at most this cost; None raises what the start surely costs."""
        if self.reached(0, start):
            return ""
        stack = [[0, start, bound, self.edits(0, start), 1 << 60, 0]]  # row, state, budget, edits left, least cost found too high, cost of the edit taken
        path: list[str] = []
        while stack:
            frame = stack[-1]
            at, state, budget, edits = frame[:4]
            for letter, cost, row, following in edits:
                need = cost + self.least(row, following)
                if need > budget:
                    frame[4] = min(frame[4], need)
                    continue
                path.append(letter)
                if self.reached(row, following):
                    return "".join(path)
                frame[5] = cost
                stack.append([row, following, budget - cost, self.edits(row, following), 1 << 60, 0])
                break
            else:
                self.failed[at, state] = max(self.least(at, state), frame[4])
                stack.pop()
                if stack:
                    path.pop()
                    stack[-1][4] = min(stack[-1][4], stack[-1][5] + self.failed[at, state])
        return None


def searched(pieces: DataFrame) -> DataFrame:
    """Pieces (conv, block, initials, faults, opens, closes) with their ways (entry, exit, cost, audit) and counts of faults.

    A piece that opens a conversation has the start as its only entry, one that closes it has acceptance as its only exit.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv, block, initials, faults, opens, closes in frame.itertuples(index=False):
                initials, faults, ways = list(initials), list(faults), []
                for goal in [ACCEPTED] if closes else range(4):
                    search = Search(initials, faults, goal)
                    for entry in [START] if opens else range(4):
                        if search.reachable(entry):
                            ways.append((entry, goal, *search.cheapest(entry)))
                illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
                out.append((conv, block, initials[0], initials[-1], illegal, faults.count("b"), faults.count("d"), faults.count("t"), [dict(zip(("entry", "exit", "cost", "audit"), w, strict=True)) for w in ways]))
            yield pd.DataFrame(out, columns=list(SEARCHED))

    return pieces.mapInPandas(run, schema(**SEARCHED))


SEARCHED = {
    "conv": "string", "block": "bigint", "head": "string", "tail": "string", "illegal": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint",
    "ways": "array<struct<entry:int,exit:int,cost:bigint,audit:string>>",
}


def _chained(pieces: DataFrame) -> DataFrame:
    """The way of each piece, (conv, block, entry, exit, border): border is 1 where the roles around its beginning are illegal.

    Pieces of a conversation come in order; of each only the choice for every state is held.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, live, taken, tail = None, {START: (0, 0)}, [], None  # live: state to (cost, rank of its edits so far)
        done: list[tuple] = []

        def close() -> None:
            state = ACCEPTED
            for block, entries, border in reversed(taken):
                done.append((conv, block, entries[state], state, border))
                state = entries[state]

        for frame in frames:
            for name, block, head, last, ways in frame[["conv", "block", "head", "tail", "ways"]].itertuples(index=False):
                if name != conv:
                    close()
                    conv, live, taken, tail = name, {START: (0, 0)}, [], None
                best: dict[int, tuple] = {}
                for way in ways:
                    if way["entry"] in live:
                        cost, rank = live[way["entry"]]
                        best[way["exit"]] = min(best.get(way["exit"], (1 << 62,)), (cost + way["cost"], rank, way["audit"], way["entry"]))
                order = sorted({b[1:3] for b in best.values()})
                live = {state: (b[0], order.index(b[1:3])) for state, b in best.items()}
                taken.append((block, {state: b[3] for state, b in best.items()}, int(tail is not None and tail + head not in LEGAL)))
                tail = last
            yield pd.DataFrame(done, columns=["conv", "block", "entry", "exit", "border"])
            done = []
        close()
        yield pd.DataFrame(done, columns=["conv", "block", "entry", "exit", "border"])

    return pieces.repartition("conv").sortWithinPartitions("conv", "block").mapInPandas(run, schema(conv="string", block="bigint", entry="int", exit="int", border="bigint"))


def _repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Repaired rows (conv, line, role, text) from placed rows and the edits (conv, block, audit) of their pieces.

    The rows of a conversation come together and in order, through one task, which holds the edits of one piece. Inserted and
    changed roles follow from the roles before them.
    """
    block = F.shiftright("place", PIECE_BITS)
    parts = edits.select("conv", "block", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = parts.unionByName(rows.select("conv", block.alias("block"), "place", "role", "text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, line, letters = None, START, 0, iter("")
        done: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal line, state
            done.append((conv, line, role, text))
            line, state = line + 1, AFTER[state][role[0]]

        def walk(role: str, text: str) -> None:
            """Edits up to the one that takes the row, or all that are left where none does."""
            for letter in letters:
                if letter == "I":
                    put(ROLES[NEXT[state]], "")
                    continue
                if letter != "D":
                    put(role if letter == "K" else ROLES[NEXT[state]], text)
                return

        for frame in frames:
            for name, place, role, text in frame[["conv", "place", "role", "text"]].itertuples(index=False):
                if name != conv:
                    walk("", "")
                    conv, state, line, letters = name, START, 0, iter("")
                if place < 0:
                    letters = iter(text)
                else:
                    walk(role, text)
            yield pd.DataFrame(done, columns=["conv", "line", "role", "text"])
            done = []
        walk("", "")
        yield pd.DataFrame(done, columns=["conv", "line", "role", "text"])

    return both.repartition("conv").sortWithinPartitions("conv", "block", "place").mapInPandas(run, schema(conv="string", line="bigint", role="string", text="string"))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of repaired rows, each as role:text, joined by line feeds; rows of a conversation together and in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, digest = None, hashlib.sha256()
        for frame in frames:
            done = []
            for name, line, role, text in frame.itertuples(index=False):
                if line == 0:
                    if conv is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = name, hashlib.sha256()
                digest.update(f"{chr(10) if line else ''}{role}:{text}".encode("utf-8", "replace"))
            yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
        if conv is not None:
            yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv", "repaired_sha256"])

    return repaired.mapInPandas(run, schema(conv="string", repaired_sha256="string"))


class Repair:
    """The staged tables of one run over rows (conv_id, turn, role, text).

    rows: (conv, turn, role, text, place), in order; conv is the id as text, a space for null.
    edits: (conv, block, audit, cost, illegal, blank, duplicate, truncated) of each piece of PIECE rows.
    """

    def __init__(self, turns: DataFrame) -> None:
        self.rows = placed(turns)
        marks = with_faults(self.rows)
        row = F.struct("place", "initial", "fault")
        pieces = marks.groupBy("conv", F.shiftright("place", PIECE_BITS).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
        pieces = staged(pieces.select("conv", "block", F.col("rows.initial").alias("initials"), F.col("rows.fault").alias("faults")), "pieces")
        ends = pieces.groupBy("conv").agg(F.min("block").alias("first"), F.max("block").alias("last"))
        pieces = pieces.join(ends, "conv").select("conv", "block", "initials", "faults", (F.col("block") == F.col("first")).alias("opens"), (F.col("block") == F.col("last")).alias("closes"))
        ways = staged(searched(pieces), "ways")
        way = F.filter("ways", lambda w: (w.entry == F.col("entry")) & (w.exit == F.col("exit")))[0]
        found = ways.join(_chained(ways), ["conv", "block"]).withColumn("way", way)
        self.edits = staged(found.select("conv", "block", "way.audit", "way.cost", (F.col("illegal") + F.col("border")).alias("illegal"), "blank", "duplicate", "truncated"), "edits")

    def report(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows."""
        turns = self.rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
        audit = F.concat_ws("", F.sort_array(F.collect_list(F.struct("block", "audit")))["audit"]).alias("audit")
        return turns.join(self.edits.groupBy("conv").agg(*[F.sum(c).alias(c) for c in COUNTS[1:]], audit), "conv")

    def repaired(self) -> DataFrame:
        """The repaired conversations, (conv, line, role, text); one that is repaired to nothing has no row."""
        return _repaired(self.rows, self.edits.select("conv", "block", "audit"))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_conversations(turns: DataFrame) -> Repair:
    """Repair of rows (conv_id, turn, role, text), in order of turn (null first), then role and text.

    A null role or text is one space, so a null text is blank; null ids are one conversation, named by a space. Repeated rows are
    duplicates of the first. An empty table gives no rows. Other columns are not read.
    """
    return Repair(turns)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair_conversations(damaged(given))
    every = given.select("conv_id", named(F.col("conv_id")).alias("conv")).distinct()
    whole = every.join(found.report(), "conv", "left").join(digests(found.repaired()), "conv", "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


OP12_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS conv,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS told FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_transform(string_split(told, ''), lambda x: ascii(x)::BIGINT), lambda crc, b: list_reduce(range(8), lambda c, _: xor(c >> 1, (c & 1) * 3988292384), xor(crc, b)), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM given
), damaged AS (
  SELECT conv, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) WHERE kind <> 0
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
ended AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, role[1:1] AS initial,
    row_number() OVER (PARTITION BY conv, role, text ORDER BY n) AS nth, lag(role) OVER (PARTITION BY conv ORDER BY n) AS before FROM placed
), marked AS (
  SELECT conv, turn, n, role, text, initial, CASE WHEN body = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    before IS NOT NULL AND before[1:1] || initial NOT IN ('su', 'ua', 'au') AS illegal FROM ended
), talks AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE illegal) AS illegal, max(n) AS last FROM marked GROUP BY conv
), inserts AS (  -- state before (0 start, 1 system, 2 user, 3 assistant), number of inserts, state after, and what is inserted
  SELECT s, k, CASE WHEN k = 0 THEN s WHEN (s = 2) = (k % 2 = 1) THEN 3 ELSE 2 END AS after,
    list_slice(CASE WHEN s = 2 THEN ['assistant:', 'user:', 'assistant:'] ELSE ['user:', 'assistant:', 'user:'] END, 1, k) AS lines
  FROM range(4) a(s), range(4) b(k)
), ways AS (
  SELECT conv, 0::BIGINT AS n, 0::BIGINT AS s, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS best FROM talks
  UNION ALL
  SELECT conv, n, s, min(best) FROM (
    SELECT m.conv, m.n, CASE e WHEN 'D' THEN i.after WHEN 'R' THEN CASE WHEN i.after = 2 THEN 3 ELSE 2 END
        ELSE CASE WHEN m.initial = 's' AND i.after = 0 THEN 1 WHEN m.initial = 'u' AND i.after <> 2 THEN 2 WHEN m.initial = 'a' AND i.after = 2 THEN 3 END END::BIGINT AS s,
      {'c': (w.best.c + 5 * i.k + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e <> 'D' AND m.fault = 't' THEN 5 ELSE 0 END)::BIGINT, 'a': w.best.a || repeat('I', i.k) || e,
       't': list_concat(w.best.t, i.lines, CASE e WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [m.role || ':' || m.text] ELSE [CASE WHEN i.after = 2 THEN 'assistant:' ELSE 'user:' END || m.text] END)} AS best
    FROM ways w JOIN marked m ON m.conv = w.conv AND m.n = w.n + 1 JOIN inserts i ON i.s = w.s, unnest(['D', 'K', 'R']) t(e) WHERE e = 'D' OR m.fault NOT IN ('b', 'd')
  ) WHERE s IS NOT NULL GROUP BY conv, n, s
), ends AS (
  SELECT conv, min({'c': best.c + 5 * i.k, 'a': best.a || repeat('I', i.k), 't': list_concat(best.t, i.lines)}) AS best
  FROM ways w JOIN talks USING (conv) JOIN inserts i ON i.s = w.s WHERE n = last AND i.after IN (0, 3) GROUP BY conv
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM given) LEFT JOIN talks USING (conv) LEFT JOIN ends USING (conv)
"""
