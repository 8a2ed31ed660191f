import functools
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidewire.llm import dialogue, queries

from .data import SF

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\f\r"
AHEAD = {0: "su", 1: "u", 2: "a", 3: "u"}
TO = {"s": 1, "u": 2, "a": 3}


def cheapest(rows):
    """(cost, audit) by looking at every edit at every row and state."""

    @functools.cache
    def best(k, state, inserts):
        options = []
        if k == len(rows):
            options += [(0, "")] if state in (0, 3) else []
        else:
            initial, fault = rows[k]
            cut = fault == "truncated"

            def add(cost, letter, after):
                if after is not None:
                    options.append((cost + after[0], letter + after[1]))

            add(3, "D", best(k + 1, state, 3))
            if fault not in ("blank", "duplicate"):
                if initial and initial in AHEAD[state]:
                    add(cut, "K", best(k + 1, TO[initial], 3))
                for to in "ua":
                    if to in AHEAD[state]:
                        add(2 + cut, "R", best(k + 1, TO[to], 3))
        if inserts:
            for to in "ua":
                if to in AHEAD[state] and (after := best(k, TO[to], inserts - 1)):
                    options.append((2 + after[0], "I" + after[1]))
        return min(options) if options else None

    for k in range(len(rows), -1, -200):
        best(k, 0, 3)
    return best(0, 0, 3)


def brute(table, damage=True):
    text_of = lambda v: " " if v is None else str(v)
    after = defaultdict(list)
    for conv, turn, role, text in table:
        role, text, h = text_of(role), text_of(text), zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        h = h if damage else 9
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        role = "user" if h == 4 else role
        after[conv] += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = {}
    for conv, rows in after.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(BLANKS)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit = cheapest([(r[1][:1], f) for r, f in zip(rows, faults)])
        lines, state, k = [], 0, 0
        for letter in audit:
            if letter == "I":
                to = "a" if state == 2 else "u"
                lines.append({"u": "user", "a": "assistant"}[to] + ":")
                state = TO[to]
                continue
            _, role, text = rows[k]
            k += 1
            if letter == "R":
                role = "assistant" if state == 2 else "user"
            if letter != "D":
                lines.append(f"{role}:{text}")
                state = TO[role[0]]
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def table(seed, convs=40, most=12):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "ubot"]
    texts = ["Fine.", "Well!", "and then", "", " \n", None, "é?", "so.\t", "x" * 50]
    rows = []
    for conv in range(convs):
        for turn in range(r.randrange(1, most)):
            good = "user" if turn % 2 == 0 else "assistant"
            rows.append((conv, turn if r.random() < 0.9 else r.choice([None, 3]), good if r.random() < 0.6 else r.choice(roles), f"Turn {turn}." if r.random() < 0.6 else r.choice(texts)))
    return rows


@pytest.mark.parametrize("chunk", [dialogue.CHUNK, 5, 1])
def test_brute_force(spark, chunk):
    rows = table(chunk) + [(None, k, "user", "Yes.") for k in range(4)] + [(None, None, None, None)] * 3 + [(99, None, "assistant", "Only this")]
    assert result(dialogue.repair(spark.createDataFrame(rows, SCHEMA), damage=True, chunk=chunk)) == brute(rows)


@pytest.mark.parametrize("kind", ["mixed", "unknown roles", "blank", "one text"])
def test_one_long_conversation(spark, kind):
    r = random.Random(4)
    made = {
        "mixed": lambda k: (r.choice(["user", "assistant", "tool", "system"]), f"Turn {k}" + r.choice([".", "", "!"])),
        "unknown roles": lambda k: ("tool", f"Turn {k}."), "blank": lambda k: ("user", " " * (k % 3)), "one text": lambda k: ("user", "Hello."),
    }[kind]
    rows = [(7, k, *made(k)) for k in range(400)] + table(1, convs=5)
    got = result(dialogue.repair(spark.createDataFrame(rows, SCHEMA), chunk=16))
    assert got == brute(rows, damage=False)


def test_all_rows_dropped(spark):
    rows = [(c, 0, "user", "Hi.") for c in range(60)]
    expected = brute(rows)
    gone = [c for c, v in expected.items() if v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert gone and result(dialogue.repair(spark.createDataFrame(rows, SCHEMA), damage=True)) == expected


def test_long_text_empty_and_clashing(spark):
    assert dialogue.repair(spark.createDataFrame([], SCHEMA), damage=True).count() == 0
    rows = [(1, 0, "user", "word " * 200_000 + "?"), (1, 1, "assistant", "." * 300_000 + " " * 300_000), *table(3, convs=6)]
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as pos", "2 as code", "'x' as edit", "3 as content", "4 as copies", "5 as piece")
    assert result(dialogue.repair(clash, damage=True)) == brute(rows)


def test_fix_up_stops_where_vectors_are_parallel():
    r = random.Random(8)
    for _ in range(300):
        codes = [r.choice([0, 1, 2, 3, 4, 9, 17, 18, 19]) for _ in range(r.randrange(1, 30))]
        used, end = (dialogue.closed(tuple(r.randrange(9) for _ in range(4))) for _ in range(2))
        again = dialogue.rerun(codes, used, end, dialogue.backward(codes, used)[0])
        assert again == dialogue.backward(codes, end)[0]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.QUERIES["op13_conversation_repair"](spark, SF)) == brute(rows)
