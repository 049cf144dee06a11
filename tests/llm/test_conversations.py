"""Repair of conversations against all sequences of edits, a plain forward search, and SQL."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.llm import conversations as C
from tests.conftest import same_rows

ROWS = "conv_id long, turn long, role string, text string"


def told(rows):
    """(role, text, fault) in order, of (turn, role, text)."""
    out, seen = [], set()
    for _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def options(role, text, fault):
    yield "D", 2, ()
    if fault not in ("blank", "duplicate"):
        more = 5 if fault == "truncated" else 0
        yield "K", more, ((role, text),)
        for other in ("user", "assistant"):
            yield "R", 1 + more, ((other, text),)


def exhaustive(rows):
    gaps = [("I" * n, 5 * n, tuple((r, "") for r in roles)) for n in range(3) for roles in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for parts in itertools.product(*[x for r in rows for x in (gaps, list(options(*r)))], gaps):
        turns = [t for p in parts for t in p[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(t[0][:1] or "-" for t in turns)):
            found = (sum(p[1] for p in parts), "".join(p[0] for p in parts), "\n".join(f"{r}:{x}" for r, x in turns))
            best = found if best is None else min(best, found)
    return best


def forward(rows):
    """The cheapest edits by a search from the front, state by state."""
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def put(into, state, x):
        if state not in into or x < into[state]:
            into[state] = x

    def insertions(now):
        for _ in range(2):
            for s, (c, a, t) in list(now.items()):
                role = "assistant" if s == 2 else "user"
                put(now, step[role[0]][s], (c + 5, a + "I", (*t, f"{role}:")))
        return now

    now = {0: (0, "", ())}
    for role, text, fault in rows:
        now, old = {}, insertions(now)
        for s, (c, a, t) in old.items():
            for letter, cost, turns in options(role, text, fault):
                to = s if not turns else step.get(turns[0][0][:1], {}).get(s)
                if to is not None:
                    put(now, to, (c + cost, a + letter, (*t, *[f"{r}:{x}" for r, x in turns])))
    c, a, t = min(x for s, x in insertions(now).items() if s in (0, 3))
    return c, a, "\n".join(t)


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        faults, turns = told(own), [r[0] for r in own if r[0] is not None]
        cost, audit, text = forward(faults)
        initials = [f[0][:1] for f in faults]
        count = [sum(f[2] == k for f in faults) for k in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((None if conv is None else str(conv), gaps, *count, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_search_is_exhaustive():
    kinds = [("system", "x."), ("user", "x."), ("assistant", "x."), ("tool", "x."), ("user", ""), ("user", "x"), ("system", "x"), ("assistant", "x"), ("", "y!")]
    judge = lambda p: [(role, text, "blank" if not text else "" if text[-1] in ".!" else "truncated") for role, text in p]
    cases = [p for n in (0, 1, 2) for p in itertools.product(kinds, repeat=n)] + random.Random(1).sample(list(itertools.product(kinds, repeat=3)), 25)
    for case in map(judge, cases):
        assert forward(case) == exhaustive(case)


def some(r, n, conv):
    return [(conv, r.choice([None, *range(12)]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(["a.", "b", " \n", None, "c! ", "d?"])) for _ in range(n)]


@pytest.mark.parametrize("block,fan", [(1 << 20, 4096), (100, 3)])
def test_against_search(spark, monkeypatch, block, fan):
    # Small blocks, so that carries go over blocks and levels.
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "FAN", fan)
    r = random.Random(5)
    rows = [x for conv in [None, -1, *range(25)] for x in some(r, r.randrange(1, 12), conv)] + some(r, 150, 90)
    rows += [(91, i, "user" if i % 2 == 0 else "assistant", f"text {i}{r.choice(['.', '.', ''])}") for i in range(120) if r.random() < 0.9] + [(92, 1, "user", "same.")] * 60
    got = C.summaries(C.edits(spark.createDataFrame(rows, ROWS))).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_powers():
    for symbol in [("u", ""), ("s", "truncated"), C.GONE, ("t", "")]:
        for n in (1, 2, 5, 13):
            one = C.END[:4]
            for _ in range(n):
                one = C.advanced(symbol, 1, one)
            assert C.advanced(symbol, n, C.END[:4]) == one
            assert C._applied(C.transition([(symbol, [(0, n)])]), C.END[:4]) == one


def test_edits_and_edges(spark):
    df = spark.createDataFrame([(1, 0, "system", "be kind."), (1, 1, "user", "hi."), (1, 2, "user", "hi."), (1, 3, "tool", "yes."), (1, 9, "user", "cut off")], ROWS)
    done = C.edits(df.withColumn("key", F.lit(1)).withColumn("fault", F.lit("x")).withColumn("place", F.lit("y"))).orderBy("place").collect()
    assert [(r.fault, r.letters, [tuple(b) for b in r.becomes]) for r in done] == [
        ("", "K", [("system", "be kind.")]), ("", "K", [("user", "hi.")]), ("duplicate", "D", []), ("", "R", [("assistant", "yes.")]), ("truncated", "D", [])
    ]
    assert C.summaries(C.edits(df.limit(0))).collect() == []
    none = C.summaries(C.edits(df.limit(1).withColumn("copies", F.lit(0)))).first()
    assert tuple(none) == ("1", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    long_ = spark.createDataFrame([(1, 0, "user", "word " * 200_000 + "."), (1, 1, "assistant", "ok.")], ROWS)
    assert C.summaries(C.edits(long_)).first().audit == "KK"


def test_query(spark, duck, sf_dir):
    same_rows(C.op12_conversations(spark, sf_dir).toPandas(), duck.sql(C.OP12_SQL).df())
