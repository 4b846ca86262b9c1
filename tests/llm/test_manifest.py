from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quirefold.llm import manifest
from quirefold.llm.manifest import append_log, build_manifest, height, log_of, position, prove, sibling_runs
from tests.llm.helpers import AWKWARD, documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, idx int, _q1 int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join(parts))


def climb(nodes, at):
    """(root, siblings, steps) of the node at `at`, by plain lists."""
    siblings, steps = [], []
    while len(nodes) > 1:
        run = nodes[at - at % 16 : at - at % 16 + 16]
        siblings += run[: at % 16] + run[at % 16 + 1 :]
        steps.append((run[: at % 16], run[at % 16 + 1 :]))
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at //= 16
    return nodes[0], siblings, steps


def brute(rows, tampered):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault("" if r[1] is None else "=" + r[1], []).append(r)
    order = sorted(trees, key=lambda t: t.encode())
    leaves = {t: sorted((r[0] is not None, r[0] or 0, leaf_of(*r), r) for r in trees[t]) for t in order}
    roots = {t: climb([x[2] for x in leaves[t]], 0)[0] for t in order}
    out = []
    for place, t in enumerate(order):
        root, top_siblings, top_steps = climb([roots[x] for x in order], place)
        for at, (_, _, leaf, r) in enumerate(leaves[t]):
            _, siblings, steps = climb([x[2] for x in leaves[t]], at)
            lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            now = leaf_of(*r[:4], None if r[4] is None else r[4].translate(lower)) if tampered(r[0]) else leaf
            for left, right in steps + top_steps:
                now = sha("".join([*left, now, *right]))
            out.append((r[0], leaf, roots[t], root, sha("".join(siblings + top_siblings)), now, now == root))
    return sorted(out, key=repr)


def table(spark, rows):
    full = [(r[0], r[4], r[2], r[1], r[3], "t", 1, 2) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def made(sizes, draw):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, source, draw.choice(["en", None]), draw.choice([3, None]), f"Text {i} É\n" * draw.randrange(3)))
            i += 1
    return rows


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 255, 256, 257, 300])
def test_positions_of_the_log(n):
    """The closed form finds every node where the builder wrote it."""
    leaves = [bytes([i % 256]) * 32 for i in range(n)]
    log, top, nodes = append_log(leaves), height(n), leaves
    for level in range(top + 1):
        for i, node in enumerate(nodes):
            assert log[position(level, min((i + 1) * 16**level, n), top)] == node
        nodes = [manifest.joined(nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    runs = sibling_runs(b"".join(log), n - 1, n, top)
    assert all(run[at] in log for run, at in runs) and len(runs) == top


@pytest.mark.parametrize("levels", [1, 2])
def test_equals_brute_force(spark, levels):
    """With builders of 16 leaves, logs take several rounds, and so does the tree over the sources."""
    draw = random.Random(3)
    sizes = {None: 5, "b": 1, "é": 16, "a": 17, "hot": 530, "": 3} | {f"s{i:02}": 1 + i % 3 for i in range(20)}
    rows = made(sizes, draw)
    found = prove(build_manifest(table(spark, rows), F.col("doc_id") % 5 == 0, levels))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, lambda d: d is not None and d % 5 == 0)


def test_awkward_rows(spark):
    rows = [(1, "x" * 2_000_000), *[(i, f"Row {i}") for i in range(2, 40)]]
    docs = documents(spark, rows)
    found = sorted(map(tuple, prove(build_manifest(docs, F.col("doc_id") % 5 == 0)).collect()), key=repr)
    full = [(d, None, "en", len(t or ""), t) for d, t in rows + AWKWARD]
    assert found == brute(full, lambda d: d is not None and d % 5 == 0)


def test_any_change_shows(spark):
    rows = made({"a": 40, "b": 3}, random.Random(1))
    first = build_manifest(table(spark, rows)).root
    assert first == build_manifest(table(spark, rows[::-1])).root
    for at, column in ((0, 4), (41, 1), (20, 0)):
        changed = [list(r) for r in rows]
        changed[at][column] = 999 if column == 0 else "changed"
        assert build_manifest(table(spark, changed)).root != first
    assert all(r["verified"] for r in prove(build_manifest(table(spark, rows))).collect())


def test_log_is_whole(spark):
    log = log_of(build_manifest(table(spark, made({"a": 300}, random.Random(2)))))
    assert log.where("round = 0").count() == 300 + 19 + 2


def test_empty_table_and_one_row(spark):
    assert prove(build_manifest(table(spark, []))).count() == 0
    [row] = prove(build_manifest(table(spark, [(1, "s", "en", 1, "a")]))).collect()
    assert row["leaf"] == row["root"] == row["subroot"] and row["proof_sha256"] == sha("") and row["verified"]
