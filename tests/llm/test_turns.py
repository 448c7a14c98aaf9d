import functools
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from gridhead.llm import turns
from tests.llm.helpers import clashing

ROWS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def by_hand(rows):
    """The report of one conversation, from its rows (turn, role, text), by the definition."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @functools.cache
    def best(i, state, inserted=0):
        """Cheapest cost, edits and turns from row i, where the roles so far end in `state` ('', s, u, a)."""
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for r in nexts.replace("s", ""):
                c, e, t = best(i, r, inserted + 1)
                options.append((c + 5, "I" + e, ((("user" if r == "u" else "assistant"), ""), *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, e, t = best(i + 1, state)
            options.append((c + 2, "D" + e, t))
            if faults[i] not in ("blank", "duplicate"):
                late = 5 if faults[i] == "truncated" else 0
                if role and role[0] in nexts:
                    c, e, t = best(i + 1, role[0])
                    options.append((c + late, "K" + e, ((role, text), *t)))
                for r in nexts.replace("s", ""):
                    c, e, t = best(i + 1, r)
                    options.append((c + late + 1, "R" + e, (("user" if r == "u" else "assistant", text), *t)))
        return min(options) if options else (10**9, "", ())

    cost, audit, left = best(0, "")
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    assert LEGAL.fullmatch("".join(r[0] for r, _ in left))
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), left


def random_conversation(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "u", "", None, "éa", "User"]
    texts = ["Hi.", "So?", "yes", "no", " ", "", None, "\n\t", "a.\n", "b \v", "c!", "é", *(f"t{k}." for k in range(n))]
    return [(rng.choice([k, k, rng.randrange(9), None]), rng.choice(roles), rng.choice(texts)) for k in range(n)]


def frame(spark, conversations):
    rows = [(k, *r) for k, rows in conversations.items() for r in rows]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, ROWS).repartition(5)


def shape(rows):
    return {r.conv_id: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_repair_equals_the_definition(spark, block):
    rng = random.Random(block)
    conversations = {k: random_conversation(rng, rng.randrange(1, 14)) for k in [*range(60), None]}
    rows = clashing(frame(spark, conversations)).withColumns({"gone": F.lit("x"), "a.b": F.lit(2), "Audit": F.lit("x")})
    want = {k: by_hand(v) for k, v in conversations.items()}
    assert shape(turns.repair(rows, block).collect()) == {k: v[0] for k, v in want.items()}
    left = {}
    for r in turns.repaired_turns(rows, block).orderBy("conv_id", "part", "place").collect():
        left.setdefault(r.conv_id, []).append((r.role, r.text))
    assert left == {k: list(v[1]) for k, v in want.items() if v[1]}


def test_long_conversation_with_equal_rows(spark):
    """One conversation holds nearly all rows, and one row of it comes hundreds of times."""
    rng = random.Random(8)
    hot = random_conversation(rng, 400) + [(None, "user", "Same.")] * 300 + [(7, "assistant", "cut")] * 50
    conversations = {1: hot, 2: random_conversation(rng, 5)}
    got = shape(turns.repair(frame(spark, conversations), 32).collect())
    import sys

    sys.setrecursionlimit(20_000)
    assert got == {k: by_hand(v)[0] for k, v in conversations.items()}


def test_vectors_of_checkpoints_give_the_same_walk():
    """Walks over blocks of any size, put together, are the walk over the whole."""
    rng = random.Random(2)
    for _ in range(200):
        codes = bytes(rng.randrange(12) for _ in range(rng.randrange(60)))
        costs, ((whole, end),) = turns.walks(codes, turns._FINAL, [turns.START])
        cut = rng.randrange(len(codes) + 1)
        table = turns.transfer(codes[cut:])
        middle = [min(table[a][b] + turns._FINAL[b] for b in range(4)) for a in range(4)]
        first, ((front, state),) = turns.walks(codes[:cut], middle, [turns.START])
        behind = turns.walks(codes[cut:], turns._FINAL, range(4))[1][state]
        assert first[turns.START] == costs[turns.START] and (front + behind[0], behind[1]) == (whole, end)


def test_odd_rows(spark):
    none = turns.repair(frame(spark, {1: []}))
    assert none.isEmpty()
    wrong = spark.sql("select 1L conv_id, 1L turn, cast(x'75ff' as string) role, cast(x'ff2e' as string) text union all select 1L, 2L, 'assistant', repeat('long ', 500000) || '.'")
    (row,) = turns.repair(wrong).collect()
    assert (row.cost, row.audit) == (0, "KK")
    gone = spark.createDataFrame([(1, 0, "user", "a.", True), (2, 0, "user", "a.", True), (2, 1, "user", "b.", False)], f"{ROWS}, gone boolean")
    got = shape(turns.repair(gone, absent="gone").collect())
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2][5:7] == (2, "D")
