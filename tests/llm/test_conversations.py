"""Structure repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from hrefsieve.llm import conversations as c

AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {"u": "user", "a": "assistant"}


def plain_repair(rows):
    """(cost, audit, lines) of the cheapest edits of rows (role, text, fault), ties to the ASCII-least audit."""
    @cache
    def best(i, state, inserted):
        found = []
        if i == len(rows):
            if state in (0, 3):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            found.append((3 + cost, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in AFTER[state]:
                    cost, audit, lines = best(i + 1, AFTER[state][role[:1]], 0)
                    found.append((more + cost, "K" + audit, (f"{role}:{text}", *lines)))
                for initial in "ua":
                    if initial in AFTER[state]:
                        cost, audit, lines = best(i + 1, AFTER[state][initial], 0)
                        found.append((2 + more + cost, "R" + audit, (f"{NAMES[initial]}:{text}", *lines)))
        if inserted < 3:
            for initial in "ua":
                if initial in AFTER[state]:
                    cost, audit, lines = best(i, AFTER[state][initial], inserted + 1)
                    found.append((2 + cost, "I" + audit, (f"{NAMES[initial]}:", *lines)))
        return min(found, default=(10**6, "", ()), key=lambda x: x[:2])

    return best(0, 0, 0)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def plain_result(table):
    out = {}
    left = plain_damage(table)
    for conv in {r[0] for r in table}:
        mine = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, rows = set(), []
        for _, _, role, text in mine:
            body = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not body.strip(" \t\n\x0b\f\r") else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            rows.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = plain_repair(tuple(rows)) if rows else (0, "", ())
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(r[2] == f for r in rows) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def random_table(seed, convs, longest):
    r = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(r.randrange(longest + 1)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sage"])
            text = r.choice(["Yes.", "No", "Why?", "", " \t", None, "é!", f"Text {r.randrange(9)}.", f"Open {r.randrange(9)}", "a. \n"])
            rows.append((conv if r.random() > 0.02 else None, r.choice([turn, turn, turn, turn + 1, None]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def result(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", place int, symbol string").repartition(parts)
    got = [tuple(r) for r in c.repair(c.damaged(frame)).collect()]
    assert len(got) == len({g[0] for g in got})
    return {g[0]: g[1:] for g in got}


def test_repair_equals_a_plain_search(spark):
    rows = random_table(1, 150, 9)
    assert result(spark, rows) == plain_result(rows)


@pytest.mark.parametrize("piece", [1, 3, 8])
def test_pieces_compose(spark, monkeypatch, piece):
    monkeypatch.setattr(c, "PIECE", piece)
    rows = random_table(2, 12, 24) + [(99, t, "assistant" if t % 3 else "user", f"line {t}.") for t in range(70)]
    want = plain_result([r for r in rows if r[0] != 99])
    got = result(spark, rows)
    assert {k: v for k, v in got.items() if k != 99} == want
    monkeypatch.setattr(c, "PIECE", 4096)
    assert got[99] == result(spark, rows)[99]


def test_empty_tables_and_conversations_without_rows(spark):
    assert result(spark, []) == {}
    dropped = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    assert result(spark, [(dropped, 0, "user", "a.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_block_tables_equal_single_steps():
    vectors, to, add, block_to, block_add = c.tables()
    assert len(vectors) < 200 and block_to.shape == (len(vectors), c.SYMBOLS**c.BLOCK)
    r = random.Random(3)
    for _ in range(300):
        block, v = [r.randrange(c.SYMBOLS) for _ in range(c.BLOCK)], r.randrange(len(vectors))
        code, at, cost = int("".join(map(str, block))), v, 0
        for symbol in reversed(block):
            cost, at = cost + add[at, symbol], to[at, symbol]
        assert (block_to[v, code], block_add[v, code]) == (at, cost)


def test_long_texts(spark):
    rows = [(1, 0, "user", "word " * 300_000 + "?"), (1, 1, "assistant", "y" * 1_000_000 + ".")]
    assert result(spark, rows) == plain_result(rows)
