"""Free names against placing one file after the other."""

import random

import pytest

from paperloom.operators.collisions import free_names

ROWS = "batch_id string, ord int, folder string, name string"


def one_by_one(rows):
    taken, out = set(), {}
    for batch, ord_, folder, name in sorted(rows, key=lambda r: r[1]):
        dot = name.rfind(".")
        head, tail = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
        at, i = name, 1
        while (batch, folder, at) in taken:
            at, i = f"{head}__{i}{tail}", i + 1
        taken.add((batch, folder, at))
        out[batch, ord_] = at
    return out


def check(spark, rows):
    got = {(r.batch_id, r.ord): r.placed for r in free_names(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == one_by_one(rows)


@pytest.mark.parametrize("seed", range(3))
def test_any_order(spark, seed):
    # Few names with few numbers, so that given numbers meet names that come earlier and later, on several levels.
    r = random.Random(seed)
    name = lambda: "a" + "".join(f"__{r.choice([1, 1, 2, 2, 3, 4, '01', 10])}" for _ in range(r.choice([0, 0, 0, 1, 1, 2]))) + r.choice([".pdf", ".pdf", ""])
    check(spark, [(r.choice("bc"), i, r.choice("xy"), name()) for i in range(400)])


def test_edges(spark):
    odd = ["__1.pdf", ".pdf", ".pdf", "__1.pdf", "a.__1.pdf", "a..pdf", "a..pdf", "__1", "__1", "b__1__1", "b__1", "b", "b", "b", "b__1", "é.x", "é.x", "é__1.x"]
    check(spark, [("b", i, "f", n) for i, n in enumerate(odd)])
    assert free_names(spark.createDataFrame([], ROWS)).count() == 0
    # One name for a third of the files, half of its numbers taken at some time.
    many = [("b", 3 * i, "f", "scan.pdf") for i in range(200)] + [("b", 3 * ((i * 37) % 200) + 1, "f", f"scan__{2 * i + 1}.pdf") for i in range(100)]
    check(spark, many)
