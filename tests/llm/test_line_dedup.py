from __future__ import annotations

import hashlib
import random

from quirefold.llm.line_dedup import dedup_lines
from tests.llm.helpers import AWKWARD, documents, own_columns_stay

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs):
    where = {}
    for doc_id, text in set(rows):
        for line in (text or "").split("\n"):
            where.setdefault(line.strip(SPACE).translate(LOWER), set()).add((doc_id, text))
    bad = {k for k, v in where.items() if k and len(v) >= min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if x.strip(SPACE).translate(LOWER) not in bad]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    draw = random.Random(1)
    lines = ["Header", " HEADER\t", "É", "é", "", "  ", "footer\r", "Footer", *[f"line {i}" for i in range(40)]]
    rows = [(i, "\n".join(draw.choices(lines, k=draw.randrange(1, 12)))) for i in range(60)]
    got = dedup_lines(documents(spark, rows), min_docs=4)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and own_columns_stay(got)
    found = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()]
    assert sorted(found, key=repr) == brute(rows + AWKWARD, 4)


def test_a_line_repeated_in_one_document_counts_once(spark):
    got = dedup_lines(documents(spark, [(1, "x\nx\nx"), (2, "x")], awkward=False), min_docs=3)
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(1, "x\nx\nx"), (2, "x")}


def test_all_lines_dropped_leaves_the_empty_text(spark):
    got = dedup_lines(documents(spark, [(i, "same\nsame") for i in range(10)], awkward=False))
    assert {(r["n_dropped"], r["text"]) for r in got.collect()} == {(2, "")}


def test_very_long_document(spark):
    text = "\n".join(["often"] * 50_000 + ["once"])
    got = dedup_lines(documents(spark, [(1, text), (2, "often")], awkward=False), min_docs=2)
    assert {(r["doc_id"], r["n_dropped"], r["text"]) for r in got.collect()} == {(1, 50_000, "once"), (2, 1, "")}


def test_empty_table(spark):
    got = dedup_lines(documents(spark, [], awkward=False))
    assert got.count() == 0 and {"n_lines", "n_dropped"} <= set(got.columns)


def test_only_native_operators(spark):
    plan = dedup_lines(documents(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert hashlib  # the digest itself is checked by the SQL of the query
