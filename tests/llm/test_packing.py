from __future__ import annotations

import random
from itertools import combinations

from quirefold.llm.packing import best_boundaries, pack_documents, token_counts
from tests.llm.helpers import AWKWARD, documents

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())


def test_boundaries_are_optimal():
    draw = random.Random(4)
    for _ in range(40):
        histogram = {x: draw.randrange(1, 30) for x in draw.sample(range(1, 40), draw.randrange(1, 9))}
        k = draw.randrange(1, 5)
        ends = best_boundaries(histogram, k)
        top = max(histogram)
        best = min(
            padding(histogram, [*c, top]) for n in range(min(k, len(histogram))) for c in combinations(sorted(histogram), n)
        )
        assert padding(histogram, ends) == best and len(ends) <= k and ends[-1] == top and ends == sorted(ends)
    assert best_boundaries({}, 3) == []


def check(rows, got, counts, max_tokens, budget, n_buckets):
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["n_tokens"]))
    want = {}
    for doc_id, n in counts:
        want.setdefault(doc_id, []).extend(
            (i, i * max_tokens, min(max_tokens, n - i * max_tokens)) for i in range((n + max_tokens - 1) // max_tokens)
        )
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    histogram = {}
    for r in got:
        histogram[r["n_tokens"]] = histogram.get(r["n_tokens"], 0) + 1
    ends = best_boundaries(histogram, n_buckets)
    batches = {}
    for r in got:
        assert r["boundary"] == min(e for e in ends if e >= r["n_tokens"])
        batches.setdefault((r["boundary"], r["batch"]), []).append(r["place"])
    for (boundary, batch), places in batches.items():
        size = max(budget // boundary, 1)
        last = batch == max(b for e, b in batches if e == boundary)
        assert sorted(places) == list(range(len(places))) and (len(places) == size or last and len(places) <= size)
        assert (boundary, batch - 1) in batches or batch == 0


def test_every_token_is_packed_once(spark):
    draw = random.Random(3)
    rows = [(i, "w " * draw.randrange(0, 70)) for i in range(300)] + [(1000, "w " * 5000)]
    got = pack_documents(documents(spark, rows), max_tokens=32, budget=100, n_buckets=4).collect()
    counts = [(d, len((t or "").split()) + 1) for d, t in rows + AWKWARD]
    check(rows, got, counts, 32, 100, 4)


def test_tokenizer_counts_equal_those_of_whole_texts(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    rows = [(1, "Hello, world!\nIt's 2024…"), (2, "<|endoftext|> naïve   x"), (3, "eine Straße " * 50)]
    got = {r["doc_id"]: r["n"] for r in token_counts(documents(spark, rows, awkward=False), TOKENIZER).collect()}
    assert got == {d: len(tokenizer.encode(t, add_special_tokens=False)) + 1 for d, t in rows}


def test_empty_table(spark):
    assert pack_documents(documents(spark, [], awkward=False)).count() == 0


def test_a_text_without_spaces_is_as_long_as_it_is(spark):
    docs = documents(spark, [(1, "x" * 1_000_000), (2, "é" * 16), (3, "é" * 17 + " a")], awkward=False)
    assert {r["doc_id"]: r["n"] for r in token_counts(docs).collect()} == {1: 62_501, 2: 2, 3: 4}
    sizes = {}
    for r in pack_documents(docs, max_tokens=512, budget=2048).collect():
        sizes.setdefault((r["boundary"], r["batch"]), []).append(r["n_tokens"])
    assert all(len(v) * boundary <= 2048 for (boundary, _), v in sizes.items())
