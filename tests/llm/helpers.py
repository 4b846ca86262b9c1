"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, _q9 int, word string, h1 int, _q1 string, _Q2 int, _qfp long"

AWKWARD = [
    (901, None),
    (902, ""),
    (903, " \n\t\n"),
    (904, "..."),
    (None, "a row without an id"),
    (905, "the same row twice"),
    (905, "the same row twice"),
    (906, "the same row twice"),
    (907, "naïve ÉCOLE Straße 東京 \U0001f600 " * 3),
]


def documents(spark, rows, awkward=True, lang="en"):
    """Rows of (doc_id, text) or (doc_id, text, lang) with extra columns whose names clash with results."""
    rows = list(rows) + (AWKWARD if awkward else [])
    full = [(r[0], r[1], r[2] if len(r) > 2 else lang, None, len(r[1] or ""), "s", 9, "w", 1, "own", 2, 3) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def passage_distance(item, words):
    """Least edit distance of the item to any passage of the words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        last, row = row, [i]
        for j, y in enumerate(words, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def own_columns_stay(df):
    """Values of input columns that are named like internal ones."""
    return all((r["_q1"], r["_Q2"], r["_qfp"], r["_q9"]) == ("own", 2, 3, 9) for r in df.select("_q1", "_Q2", "_qfp", "_q9").collect())
