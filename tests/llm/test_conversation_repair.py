"""Audits against all edit sequences, and the whole query against plain loops."""

import hashlib
import itertools
import random
import re
import zlib

from vitrine.llm import conversation_repair, edit_lattice

LEGAL = re.compile("(s?(ua)+)?")
INITIAL = {0: "x", 1: "s", 2: "u", 3: "a"}


def brute(codes):
    """Least (cost, audit) by dynamic programming on whole lists of (cost, audit, initials), forwards only."""
    now = {"": (0, "")}  # what matters of the initials: the last one

    def put(table, key, label):
        if key not in table or label < table[key]:
            table[key] = label

    def inserted(table):
        for _ in range(4):
            for last, (cost, audit) in list(table.items()):
                for c in "ua":
                    if follows(last, c):
                        put(table, c, (cost + 5, audit + "I"))
        return table

    def follows(last, c):
        return last + c in ("s", "u", "su", "ua", "au")

    now = inserted(now)
    for code in codes:
        nxt = {}
        for last, (cost, audit) in now.items():
            put(nxt, last, (cost + 2, audit + "D"))
            if code & 12 != edit_lattice.DELETE:
                cost += 5 * (code & 12 == edit_lattice.TRUNCATED)
                if follows(last, INITIAL[code & 3]):
                    put(nxt, INITIAL[code & 3], (cost, audit + "K"))
                for c in "ua":
                    if follows(last, c):
                        put(nxt, c, (cost + 1, audit + "R"))
        now = inserted(nxt)
    return min(v for k, v in now.items() if k in ("", "a"))


def sequences(codes):
    """Least (cost, audit) by trying every sequence of edits with at most two inserts, for very short conversations."""
    best = None
    for letters in itertools.product("DKR", repeat=len(codes)):
        for where in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(len(codes) + 1), n) for n in range(3)):
            audit = "".join("I" * where.count(i) + x for i, x in enumerate(letters)) + "I" * where.count(len(codes))
            free = [INITIAL[codes[i] & 3] if x == "K" else "?" for i, x in enumerate(letters) if x != "D"]
            at, slots = 0, []
            for x in audit:
                if x == "I":
                    slots.append("?")
                elif x != "D":
                    slots.append(free[at])
                    at += 1
            if any(codes[i] & 12 == edit_lattice.DELETE and x != "D" for i, x in enumerate(letters)):
                continue
            if not any(LEGAL.fullmatch("".join(p)) for p in itertools.product(*("ua" if s == "?" else s for s in slots))):
                continue
            cost = 5 * len(where) + sum({"D": 2, "K": 0, "R": 1}[x] + 5 * (x != "D" and codes[i] & 12 == edit_lattice.TRUNCATED) for i, x in enumerate(letters))
            best = min(best or (10**9, ""), (cost, audit))
    return best


def test_the_search_against_all_sequences():
    for n in range(4):
        for codes in itertools.product(range(12), repeat=n):
            if n < 3 or sum(codes) % 5 == 0:
                assert edit_lattice.cheapest(bytes(codes)) == sequences(codes) == brute(codes), codes


def test_blocks_meet_without_a_seam():
    rng = random.Random(3)
    for n in [*range(30)] * 12 + [700, 1500]:
        codes = bytes(rng.choice([1, 2, 2, 3, 3, 2, 3, 0, 4, 6, 10, 11]) for _ in range(n))
        want = brute(codes)
        assert edit_lattice.cheapest(codes) == want
        for block in (1, 2, 3, 7):
            assert edit_lattice.cheapest(codes, block) == want, (codes, block)


def expected(rows):
    """Columns of the query for the original rows of one conversation."""
    turns = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        turns += [(turn, "user" if way == 4 else role, text)] * {0: 0, 3: 2}.get(way, 1)
    turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
    n, codes, seen = dict.fromkeys(("blank", "duplicate", "truncated"), 0), [], set()
    for _, role, text in turns:
        stripped = text.strip(" \t\n\r\x0b\x0c")
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + {None: 0, "truncated": 8}.get(fault, 4))
    numbers = [t[0] for t in turns if t[0] is not None]
    cost, audit = brute(codes)
    out, kept = [], iter(turns)
    for x in audit:
        _, role, text = next(kept) if x != "I" else (None, None, "")
        if x != "D":
            out.append((role if x == "K" else None, text))
    odd = len(out) % 2
    lines = [f"{role if role is not None else ('user', 'assistant')[(i - odd) % 2]}:{text}" for i, (role, text) in enumerate(out)]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def test_repair_against_loops(spark):
    rng = random.Random(4)
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \n", None, "Ends.\t", "a.b", "é中。", "Is it?"]
    rows = []
    for conv in [*range(120), 2**60 + 1, None]:
        turns = [*range(rng.randrange(9))] or [0]
        for i, turn in enumerate(turns):
            role = "system" if i == 0 and rng.random() < 0.4 else rng.choice(["user", "assistant", ("user", "assistant")[i % 2], ("user", "assistant")[i % 2], "tool", "", None])
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice((1, 1, 1, 3)), role, rng.choice(texts), "x"))
    rows += [(777, t, ("user", "assistant")[t % 2], f"Turn {t}{'.' * (t % 11 > 0)}", "x") for t in range(3000)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string")
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r[:4])
    turns = conversation_repair.damaged(df)
    plans = conversation_repair.plan(turns, df)
    out = {r.conv_id: tuple(r)[1:] for r in conversation_repair.report(turns, plans).collect()}
    assert set(out) == set(groups)
    for conv, own in groups.items():
        assert out[conv] == expected(own)[0], conv
    back = {}
    for r in conversation_repair.repaired(turns, plans).orderBy("conv_id", "place").collect():
        back.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    for conv, own in groups.items():
        lines = expected(own)[1]
        assert [t for _, t in back.get(conv, [])] == lines and [p for p, _ in back.get(conv, [])] == list(range(len(lines)))


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.report(none, conversation_repair.plan(none)).count() == 0
    alone = conversation_repair.plan(none, spark.range(2).withColumnRenamed("id", "conv_id"))
    assert [tuple(r)[1:] for r in conversation_repair.report(none, alone).collect()] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * 2
