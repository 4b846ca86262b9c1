from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from quirefold.llm import lm_score
from quirefold.llm.common import remainder as crc
from quirefold.llm.lm_score import END, LN10, VOCABULARY, Lattice, LatticeBlocks, read_pieces, score_texts
from tests.llm.helpers import AWKWARD, documents, remainder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.translate(LOWER).split(" ") if w]


def small_lattice():
    pieces = [END, "▁", "▁a", "a", "b", "ab", "▁ab", "ba", *[f"<0x{i:02X}>" for i in range(256)]]
    numbers = {p: i for i, p in enumerate(pieces)}
    weights = np.arange(1.0, len(pieces) + 1)
    return numbers, weights / weights.sum()


def all_segmentations(text, numbers, probabilities):
    """(pieces, probability) of every way to write the text."""
    if not text:
        return [((), 1.0)]
    out = []
    for j in range(1, len(text) + 1):
        head = (text[:j],) if text[:j] in numbers else tuple(f"<0x{b:02X}>" for b in text[:j].encode()) if j == 1 else None
        if head:
            p = math.prod(probabilities[numbers[x]] for x in head)
            out += [(head + rest, p * q) for rest, q in all_segmentations(text[j:], numbers, probabilities)]
    return out


@pytest.mark.parametrize("word", ["", "a", "ab", "abab", "baba", "aéb", "zz"])
def test_lattice_equals_the_sum_over_all_segmentations(word):
    numbers, probabilities = small_lattice()
    lattice = Lattice(numbers, probabilities)
    ways = all_segmentations("▁" + word, numbers, probabilities)
    total = sum(p for _, p in ways)
    assert lattice.log_probability(word) == pytest.approx(math.log(total))
    counts = np.zeros(len(numbers))
    lattice.expect(word, 3.0, counts)
    want = Counter()
    for pieces, p in ways:
        for x in pieces:
            want[numbers[x]] += 3 * p / total
    assert counts == pytest.approx([want.get(i, 0.0) for i in range(len(numbers))])


def test_very_long_words_do_not_underflow():
    lattice = Lattice(*small_lattice())
    assert -math.inf < lattice.log_probability("ab" * 20_000) < -20_000


@pytest.mark.parametrize("length", [1, 7, 64, 4096])
def test_slices_of_a_long_word_change_nothing(monkeypatch, length):
    lattice = Lattice(*small_lattice())
    word = "abbaéab" * 40
    whole, want = lattice.log_probability(word), np.zeros(len(lattice.octets) + 99)
    lattice.expect(word, 2.0, want)
    monkeypatch.setattr(lm_score, "SLICE", length)
    got = np.zeros(len(want))
    lattice.expect(word, 2.0, got)
    assert lattice.log_probability(word) == whole and got == pytest.approx(want)


def test_vocabulary():
    numbers, prior = read_pieces(VOCABULARY)
    assert len(numbers) > 25_000 and prior.sum() == pytest.approx(1) and (prior > 0).all()
    assert END in numbers and "▁the" in numbers and prior[numbers["▁the"]] > prior[numbers["▁zero"]]


@pytest.mark.parametrize("frequent", [1, 40, 10_000])
def test_scores_equal_brute_force(spark, monkeypatch, frequent):
    """Whatever share of the words is sent to the tasks, the sums are the same."""
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    rows = [(i, f"The {'very ' * (i % 5)}common words {i % 7} and RARE{i}\n{'É' * (i % 3)}") for i in range(60)]
    docs = documents(spark, rows)
    everything = rows + AWKWARD
    train = [t for d, t in everything if d is not None and remainder(d, 10) != 0]
    counts = Counter(w for t in train for w in [*tokens(t or ""), END])
    n, v = sum(counts.values()), len(counts)
    got = score_texts(docs, crc(10) != 0).collect()
    assert len(got) == len(everything)
    found = sorted(((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr)
    want = []
    for d, t in everything:
        words = [*tokens(t or ""), END]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want.append((d is None, d, len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    assert found == sorted(want, key=repr)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    assert by_id[905] == [pytest.approx(by_id[906][0])] * 2
    assert by_id[901] == by_id[902] == by_id[903] and all(s <= 0 for x in by_id.values() for s in x)


def test_score_is_the_product_over_words(spark):
    """The score of a text is that of its words and one end."""
    docs = documents(spark, [(i, "alpha beta gamma") for i in range(20)] + [(30, "alpha"), (31, "alpha alpha"), (32, "")], awkward=False)
    score = {r["doc_id"]: r["score"] for r in score_texts(docs, crc(10) != 0).collect()}
    assert score[31] - score[30] == pytest.approx(score[30] - score[32])
    assert LN10 > 0


def test_empty_table(spark):
    assert score_texts(documents(spark, [], awkward=False), crc(10) != 0).count() == 0


def test_many_words_at_once_equal_one_by_one():
    numbers, prior = read_pieces(VOCABULARY)
    blocks = LatticeBlocks(numbers, prior)
    words = ["", "a", "the", "thereof", "naïve", "東京", "\U0001f600x", "\x00b", "\x00", "a" * 63, "a" * 64, "b" * 90, "é日本" * 5, "the"]
    single = [blocks.single.log_probability(w) for w in words]
    assert blocks.log_probabilities(words) == pytest.approx(single)
    counts = np.arange(1.0, len(words) + 1)
    want, got = np.zeros(len(prior)), np.zeros(len(prior))
    for word, c in zip(words, counts):
        blocks.single.expect(word, c, want)
    blocks.expect(words, counts, got)
    assert got == pytest.approx(want)
    assert len(blocks.log_probabilities([])) == 0


@pytest.mark.parametrize("frequent", [1, 10_000])
def test_every_round_learns_from_every_training_word(spark, monkeypatch, frequent):
    """Scores are those of re-estimations on all training words; held-out texts change none of them."""
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    rows = [(i, f"quixotic zephyr{i % 9} gleams{i} while {'common ' * (i % 4)}marmots whistle") for i in range(40)]
    train = [t for d, t in rows if remainder(d, 10) != 0]
    counts = Counter(w for t in train for w in tokens(t))
    numbers, prior = read_pieces(VOCABULARY)
    probabilities = prior
    for _ in range(4):
        sums = lm_score.PRIOR_TOKENS * prior
        LatticeBlocks(numbers, probabilities).expect(list(counts), np.array(list(counts.values()), dtype=float), sums)
        sums[numbers[END]] += len(train)
        probabilities = sums / sums.sum()
    lattice = Lattice(numbers, probabilities)
    held = [(d, f"{t} {'marmots gleams1 ' * 50}") for d, t in rows if remainder(d, 10) == 0]
    for docs in (rows, [x for x in rows if remainder(x[0], 10) != 0] + held):
        texts = dict(docs)
        for row in score_texts(documents(spark, docs, awkward=False), crc(10) != 0).collect():
            logs = sum(lattice.log_probability(w) for w in tokens(texts[row["doc_id"]])) + lattice.end
            assert row["score"] == pytest.approx(logs / LN10)


def test_weight_of_the_vocabulary(spark):
    """A weight beyond all training words leaves the vocabulary's own scores; a small one follows the words."""
    docs = documents(spark, [(i, "quixotic marmots gleam") for i in range(30)], awkward=False)
    numbers, prior = read_pieces(VOCABULARY)
    lattice = Lattice(numbers, prior)
    plain = (sum(lattice.log_probability(w) for w in ("quixotic", "marmots", "gleam")) + lattice.end) / LN10
    heavy, light = (score_texts(docs, crc(10) != 0, prior_tokens=t).first()["score"] for t in (1e12, 10.0))
    assert heavy == pytest.approx(plain, rel=1e-4) and light > plain + 1
