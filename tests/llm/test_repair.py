import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import repair
from barloom.llm.shared import table

COLUMNS = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def damaged(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            yield from [row] * (2 if kind == 3 else 1)


def cheapest(rows):
    """(cost, audit, repaired lines) by uniform-cost search over (cost, audit); rows are (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, last, lines = heapq.heappop(heap)
        if (at, last) in seen:
            continue
        seen.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit, lines
        due = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", at, due[0], (*lines, f"{due}:")))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, last, lines))
        if fault not in ("blank", "duplicate"):
            cut = 5 * (fault == "truncated")
            if role[:1] == due[0] or (role[:1] == "s" and last == ""):
                heapq.heappush(heap, (cost + cut, audit + "K", at + 1, role[0], (*lines, f"{role}:{text}")))
            heapq.heappush(heap, (cost + cut + 1, audit + "R", at + 1, due[0], (*lines, f"{due}:{text}")))


def plain(rows, damage=True):
    talks = defaultdict(list)
    for conv, turn, role, text in damaged(rows) if damage else rows:
        talks[conv].append((turn is not None, turn or 0, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for conv in {r[0] for r in rows}:
        seen, marked = set(), []
        for _, _, role, text in sorted(talks[conv]):
            body = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if BLANK.fullmatch(text) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for known, t, _, _ in talks[conv] if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = cheapest(marked)
        counts = [sum(f == kind for _, _, f in marked) for kind in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, rows, tmp_path, monkeypatch):
    frame = spark.createDataFrame(rows, COLUMNS)
    for name in ("conv", "place", "block", "initial", "_kind", "audit"):
        frame = frame.withColumn(name, F.lit("x"))
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    result = repair.op12_structure_repair(spark, str(tmp_path)).collect()
    assert len({r.conv_id for r in result}) == len(result)
    return {r[0]: tuple(r)[1:] for r in result}


def talk(rnd, conv, size, legal):
    rows = []
    for turn in range(size):
        role = ("user", "assistant")[turn % 2] if rnd.random() < legal else rnd.choice(["system", "user", "assistant", "assistant", "tool", None, "", "usher"])
        text = rnd.choice(["Yes.", "Why?", "so it goes", "Well...  \n", None, "", " \t", "No!", f"text {turn}.", f"é{turn}?"])
        rows.append((conv, rnd.choice([turn, turn, turn, turn + 7]) if rnd.random() < 0.98 else None, role, text))
    return rows


@pytest.mark.parametrize("bits", [10, 2])
def test_equals_uniform_cost_search(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(repair, "PIECE_BITS", bits)
    rnd, rows = random.Random(11), []
    for conv in range(220):
        rows += talk(rnd, conv, rnd.choice([1, 2, 3, 5, 8]), rnd.choice([0.2, 0.9, 1]))
    rows += talk(rnd, 900, 90, 0.95) + talk(rnd, 901, 60, 0.1) + talk(rnd, None, 7, 0.9)
    rows += [(950, 1, "user", "a."), (950, 1, "user", "a."), (950, None, "assistant", None), (951, 4, "system", "Rule."), (952, 0, "user", "x" * 300_000 + ".")]
    assert found(spark, rows, tmp_path, monkeypatch) == plain(rows)


def test_search_is_least_in_ascii_order():
    """Against all edit strings of up to three rows, in order of cost and then of ASCII."""
    kinds = list(itertools.product(["s", "u", "a", "t", ""], ["", "b", "t"]))
    for size in range(4):
        for rows in itertools.product(kinds, repeat=size) if size < 3 else random.Random(1).sample(list(itertools.product(kinds, repeat=3)), 400):
            search = repair.Search([i for i, _ in rows], [f for _, f in rows], repair.ACCEPTED)
            words = {"b": "blank", "t": "truncated", "": ""}
            assert search.cheapest(repair.START) == cheapest([(i, "", words[f]) for i, f in rows])[:2]


def test_failed_states_keep_the_search_short():
    """A long run of rows of one role: states entered grow with rows times bounds, not with the number of paths."""
    search = repair.Search(["a"] * 300, [""] * 300, repair.ACCEPTED)
    entered, edits = [0], search.edits
    search.edits = lambda *x: entered.__setitem__(0, entered[0] + 1) or edits(*x)
    cost, audit = search.cheapest(repair.START)
    assert (cost, len(audit)) == (150, 300) and entered[0] < 300 * 4 * 150


def test_pieces_join_to_the_repaired_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_BITS", 2)
    rows = [(1, i, "user", f"q{i}.") for i in range(9)] + [(2, 0, "assistant", "")]
    repaired = repair.repair_conversations(spark.createDataFrame(rows, COLUMNS)).repaired().orderBy("conv", "line").collect()
    wanted = plain(rows, damage=False)
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in repaired).encode()).hexdigest() == wanted[1][-1]
    assert [r.role for r in repaired] == ["user", "assistant"] * (len(repaired) // 2) and {r.conv for r in repaired} == {"1"}


def test_empty_table(spark):
    frame = spark.createDataFrame([], COLUMNS)
    found = repair.repair_conversations(repair.damaged(frame))
    assert found.report().count() == found.repaired().count() == 0


def test_given_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in repair.op12_structure_repair(spark, sf).collect()} == plain(rows)
