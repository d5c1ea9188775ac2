import random

import pytest

from postlake.operators import folders


def brute(rows):
    """(path, depth) of each folder by walking up from it; None where the walk meets no root."""
    first = {}
    for i, parent, name in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")):
        if i is not None:
            first.setdefault(i, (parent, name or ""))
    out = {}
    for i in first:
        at, names, seen = i, [], set()
        while at is not None and at in first and at not in seen:
            seen.add(at)
            names.append(first[at][1])
            at = first[at][0]
        out[i] = ("/".join(reversed(names)), len(names) - 1) if at is None else (None, None)
    return out


def found(spark, rows):
    return {r["folder_id"]: (r["path"], r["depth"]) for r in folders.tree(spark.createDataFrame(rows, "folder_id long, parent_id long, name string")).collect()}


CASES = {
    "chain": [(i, i - 1 if i else None, f"f{i}") for i in range(37)],
    "cycles": [(1, None, "root"), (2, 1, "a"), (3, 4, "b"), (4, 3, "c"), (5, 3, "d"), (6, 6, "self"), (7, 99, "lost"), (8, 7, "under lost"), (9, 5, "deep")],
    "odd": [(1, None, None), (2, 1, ""), (2, 1, "again"), (None, 1, "no id"), (3, 2, "x/y"), (4, None, "second root"), (5, 4, "é")],
    "only a cycle": [(1, 2, "a"), (2, 1, "b")],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_trees(spark, case):
    assert found(spark, CASES[case]) == brute(CASES[case])


def test_random_trees(spark):
    rng = random.Random(1)
    rows = [(i, None if rng.random() < 0.02 else rng.choice([rng.randrange(max(1, i)), rng.randrange(400)]), f"n{i}") for i in range(300)]
    assert found(spark, rows) == brute(rows)


def test_orphans_and_totals(spark):
    paths = folders.tree(spark.createDataFrame(CASES["cycles"], "folder_id long, parent_id long, name string"))
    mail = spark.createDataFrame([(1, 1, 10), (2, 2, 5), (3, 4, 7), (4, 99, 1), (5, None, 2), (6, 2, 3)], "nid long, folder_id long, size long")
    assert {r["nid"] for r in folders.orphans(mail, paths).collect()} == {3, 4, 5}
    assert {r["nid"]: r["folder"] for r in folders.with_orphans(mail, paths).collect()} == {1: "root", 2: "root/a", 6: "root/a", **dict.fromkeys((3, 4, 5), folders.ORPHANS)}
    assert {r["folder"]: (r["messages"], r["size"]) for r in folders.totals(mail, paths).collect()} == {"root": (3, 18), "root/a": (2, 8), folders.ORPHANS: (3, 10)}
