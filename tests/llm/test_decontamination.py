from __future__ import annotations

import random

import numpy as np
import pytest

from quirefold.llm import decontamination
from quirefold.llm.decontamination import (
    EFFORTS, Walk, _WordIds, best_passage, calibrated_efforts, drop_contaminated, find_contamination, simulated_recall, window_size,
    word_ids,
)
from tests.llm.helpers import documents, edit_distance, own_columns_stay, passage_distance

ITEMS = "item_id long, text string, distance int"


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)


def words(text):
    return [w.strip(decontamination.MARKS) for w in text.lower().split() if w.strip(decontamination.MARKS)]


def corpus(seed=1):
    draw = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice((8, 9, 15, 16, 30, 33, 70, 150))))) for i in range(30)]
    docs = []
    for i in range(60):
        body = draw.choices(vocabulary, k=draw.randrange(0, 150))
        if i % 2:
            passage = items[draw.randrange(30)][1].split()
            for _ in range(draw.randrange(0, len(passage) // 10 + 1)):
                at, kind = draw.randrange(len(passage)), draw.randrange(3)
                passage[at : at + (kind != 0)] = [] if kind == 1 else [draw.choice(vocabulary)]
            at = draw.randrange(len(body) + 1)
            body[at:at] = passage
        docs.append((i, " ".join(body)))
    return docs, items


def brute(docs, items, similarity=0.8):
    out = set()
    for doc_id, text in docs:
        for item_id, item in items:
            w = words(item)
            distance = passage_distance(w, words(text or ""))
            if len(w) >= 8 and distance <= int((1 - similarity) * len(w) + 1e-9):
                out.add((doc_id, item_id, distance))
    return out


def test_passage_distance_is_exact():
    draw = random.Random(3)
    for _ in range(200):
        item = [draw.randrange(5) + 1 for _ in range(draw.randrange(1, 90))]
        text = [draw.randrange(5) + 1 for _ in range(draw.randrange(0, 120))]
        masks = {}
        for i, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << i
        assert best_passage(item, masks, np.array(text, dtype=np.int64))[0] == passage_distance(item, text)
    assert edit_distance("kitten", "sitting") == 3


def test_finds_planted_passages_with_exact_distances_and_nothing_else(spark):
    docs, items = corpus()
    want = brute(docs, items)
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in find_contamination(documents(spark, docs), benchmark(spark, items)).collect()}
    assert len(want) >= 25 and got <= want and len(got) >= 0.95 * len(want)
    exact = {w for w in want if w[2] == 0}
    assert exact <= got


def test_recall_is_reached_at_all_allowed_distances():
    draw = random.Random(9)
    items = [[draw.getrandbits(40) for _ in range(n)] for n in (8, 14, 20, 40, 59, 120) for _ in range(20)]
    assert simulated_recall(items, 0.8, calibrated_efforts(items, 0.8, 0.95)) >= 0.95


def test_a_recall_out_of_reach_is_an_error(monkeypatch):
    items = [[i * 100 + j for j in range(30)] for i in range(20)]
    monkeypatch.setattr(decontamination, "EFFORTS", ((1, 1),))
    with pytest.raises(ValueError, match="out of reach"):
        calibrated_efforts(items, 0.5, 0.999)


def test_walks_stay_in_their_windows_and_do_not_depend_on_what_is_around():
    draw = np.random.default_rng(1)
    words = draw.integers(1, 1 << 40, 500)
    walk = Walk(13, 0, 4)
    whole = walk.hashes(words, 0, 400)
    for at in (0, 17, 399):
        window = np.concatenate([words[at : at + 13], draw.integers(1, 1 << 40, 40)])
        assert (walk.hashes(window, 0, 1)[:, 0] == whole[:, at]).all()


def test_case_punctuation_and_blocks(spark, monkeypatch):
    item = "One two three four five six seven eight nine ten."
    docs = [(1, f"(one TWO, three; four five six seven eight nine - ten!)"), (2, "one two three four five")]
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 10)
    items = [(7, item), (7, item), (8, item + " x"), (None, item), (9, "one two three"), (10, None), (11, "")]
    got = find_contamination(documents(spark, docs), benchmark(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == {(1, 7, 0), (1, 8, 1), (1, None, 0)}


def test_passage_at_the_ends_and_in_a_very_long_text(spark):
    item = " ".join(f"k{i}" for i in range(20))
    filler = " ".join(f"f{i % 977}" for i in range(60_000))
    docs = [(1, item), (2, f"{item} {filler}"), (3, f"{filler} {item}"), (4, filler), (5, f"{filler} {item} {filler} {item}")]
    got = find_contamination(documents(spark, docs), benchmark(spark, [(0, item)])).collect()
    assert {(r["doc_id"], r["start"]) for r in got} == {(1, 0), (2, 0), (3, 60_000), (5, 60_000)}


def test_clean_rows_stay_with_their_columns(spark):
    docs, items = corpus(2)
    table = documents(spark, docs)
    got = drop_contaminated(table, benchmark(spark, items))
    assert got.columns == table.columns and own_columns_stay(got)
    hit = {d for d, _, _ in brute(docs, items)}
    ids = [r["doc_id"] for r in got.collect()]
    assert {d for d, _ in docs} - hit <= set(ids) and None in ids and ids.count(905) == 2
    assert not {d for d, _, distance in brute(docs, items) if distance == 0} & set(ids)


def test_empty_tables(spark):
    none = benchmark(spark, [])
    assert find_contamination(documents(spark, [(1, "a")]), none).count() == 0
    assert find_contamination(documents(spark, [], awkward=False), benchmark(spark, [(1, "a b c d e f g h")])).count() == 0
    assert drop_contaminated(documents(spark, [(1, "a")], awkward=False), none).count() == 1


def test_words():
    assert len(word_ids("A, a 'a' -- b", _WordIds())) == 4


@pytest.mark.parametrize("n", [8, 9, 10, 15, 16, 17, 20, 25, 31, 32, 33, 40, 50, 63, 64, 65, 100, 300])
def test_recall_at_the_largest_distance_of_every_length(n):
    """Calibrated on some items, measured on others, each with as many edits as are allowed."""
    draw = random.Random(n)
    items, others = [[[draw.getrandbits(40) for _ in range(n)] for _ in range(100)] for _ in range(2)]
    assert simulated_recall(others, 0.8, calibrated_efforts(items, 0.8, 0.99), 400) >= 0.95


def test_all_passages_of_few_words_equal_brute_force():
    """Words repeat so often that nearly every place shares a hash with an item; sequences border on each other."""
    draw = random.Random(7)
    items = [(i, draw.choices(range(1, 9), k=draw.choice((8, 10, 16, 32)))) for i in range(20)]
    sequences = [draw.choices(range(1, 9), k=draw.randrange(0, 120)) for _ in range(30)]
    for i in range(0, 30, 2):
        passage = list(items[draw.randrange(20)][1])
        for _ in range(len(passage) // 5):
            passage[draw.randrange(len(passage))] = draw.randrange(1, 9)
        sequences[i] = passage + sequences[i] if i % 4 else sequences[i] + passage
    want = set()
    for s, words_ in enumerate(sequences):
        for i, item in items:
            distance = passage_distance(item, words_)
            if distance <= len(item) // 5:
                want.add((s, i, distance))
    index = decontamination.ItemIndex(items, 0.8, {window_size(len(w)): EFFORTS[-1] for _, w in items})
    got = {(s, i, distance) for s, i, distance, _ in index.search([np.array(s, dtype=np.int64) for s in sequences])}
    assert len(want) >= 15 and got == want


def test_short_items_are_found_and_the_least_length_is_the_callers(spark):
    items = [(1, "who wrote the red book"), (2, "name the seven oldest cities here now"), (3, "what is rain"), (4, "why")]
    docs = [(1, "q: Who wrote the red book? a"), (2, "name the seven oldest towns here now"), (3, "so what is rain"), (4, "who wrote a book")]

    def found(**options):
        rows = find_contamination(documents(spark, docs, awkward=False), benchmark(spark, items), **options).collect()
        return {(r["doc_id"], r["item_id"], r["distance"]) for r in rows}

    assert found() == {(1, 1, 0), (2, 2, 1)}
    assert found(min_words=8) == set()
    assert found(min_words=3) == {(1, 1, 0), (2, 2, 1), (3, 3, 0)}
