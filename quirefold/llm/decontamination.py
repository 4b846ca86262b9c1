"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Distances count words. The CGK embedding walks through a word sequence with random bits: at every step it emits
the word it stands on, and moves on if a bit drawn from the step and the word says so. Sequences close in edit
distance thereby emit strings close in Hamming distance. A few steps of a walk, drawn at random, are hashed; windows
of a document that share a hash with a window of an item are candidates. Windows are up to half the item long, so
that every item has many of them, and some with few of the edits.

How many walks and how many hashes a walk are needed is calibrated per window size, at the largest distance that is
allowed, until the target recall is reached; a target out of reach is an error. A candidate stays if enough words
around it belong to the item, and is verified by the exact edit distance of the whole item to the best passage
around.

The items of a block (bounded in words) are the stated query set, sent to all tasks; documents never move.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quirefold.llm.common import KEY, content_key, keeps_columns, texts_of
from quirefold.session import stage

BLOCK_WORDS = 1 << 17
CHUNK = 1 << 14
CACHE_WORDS = 1 << 19
TABLE_BITS = 20
WINDOW_SHARE = 0.5  # of an item's words, at most, are a window
WINDOWS = (3, 4, 6, 9, 13, 19, 28, 42, 63)
EFFORTS = ((1, 1), (1, 2), (1, 4), (1, 6), (1, 8), (1, 12), (2, 6), (2, 8), (3, 8), (4, 8), (6, 8), (8, 8), (8, 16), (16, 16), (16, 32))
TRIALS, LENGTHS = 300, 36  # edited copies per length that a calibration step looks for; lengths per window size
CELLS = 1 << 20  # words around candidates that are counted at a time
SMALLEST = 5
MARKS = ".,;:!?\"'`()[]{}<>|*_-–—“”‘’«»¡¿…"
_MIX = np.int64(0x1E3779B97F4A7C15)


class _WordIds(dict):
    """A number per word, without case and punctuation at the ends; 0 for a word that is only punctuation."""

    def __missing__(self, word: str) -> int:
        bare = word.strip(MARKS)
        if len(self) > CACHE_WORDS:
            self.clear()
        number = (xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass")) >> 1 or 1) if bare else 0
        self[word] = number
        return number


def word_ids(text: str, ids: _WordIds) -> np.ndarray:
    words = text.lower().split()
    found = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))
    return found[found != 0]


def window_size(n_words: int) -> int:
    """The largest window that is at most `WINDOW_SHARE` of the item, but no less than the smallest."""
    return max([w for w in WINDOWS if w <= max(WINDOW_SHARE * n_words, WINDOWS[0])])


class Walk:
    """One random walk of `size` steps, and `samples` hashes over a few of its steps each.

    It makes as many steps as its window has words, so it cannot leave it. Words are turned by a multiplier of the
    walk; the bit of a step and a word is a bit of the turned word.
    """

    def __init__(self, size: int, number: int, samples: int):
        draw = random.Random(f"{size}/{number}")
        self.size, self.samples = size, samples
        self.turn = np.int64(draw.getrandbits(62) | 1)
        self.bit = draw.sample(range(63), size)
        count = 2 if size < 4 else 3 if size < 19 else 4
        strata = [size * i // count for i in range(count + 1)]
        self.at: list[list[int]] = [[] for _ in range(size)]
        for sample in range(samples):
            for low, high in zip(strata, strata[1:]):
                self.at[draw.randrange(low, high)].append(sample)
        self.last = max(step for step, users in enumerate(self.at) if users)

    def hashes(self, words: np.ndarray, low: int, high: int) -> np.ndarray:
        """(samples, starts from `low` to `high`); the last word stands for those beyond the end of `words`."""
        turned = words[low : high + self.size] * self.turn
        # The low bits of a product depend on few bits of the word; mixed in from above, all bits are alike.
        turned ^= turned >> 32
        out = np.zeros((self.samples, high - low), dtype=np.int64)
        at, seen = np.arange(high - low), np.empty(high - low, np.int64)
        for step in range(self.last + 1):
            turned.take(at, out=seen, mode="clip")
            for sample in self.at[step]:
                row = out[sample]
                row *= _MIX
                row += seen
            if step < self.last:
                np.right_shift(seen, self.bit[step], out=seen)
                np.bitwise_and(seen, 1, out=seen)
                at += seen
        return out


def _mixed(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The upper `bits` bits of the hashes, once more multiplied, as an index."""
    return ((hashes * _MIX).view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)


def best_passage(item: list[int], masks: dict[int, int], words: np.ndarray) -> tuple[int, int]:
    """(edit distance, end) of the passage of `words` nearest to the item: the bit-vector recurrence of Myers."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for j, word in enumerate(words.tolist()):
        equal = masks.get(word, 0)
        down = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (~(across | plus) & full)
        dn = plus & across
        if up & high:
            score += 1
        elif dn & high:
            score -= 1
        up, dn = (up << 1) & full, (dn << 1) & full
        plus, minus = dn | (~(down | up) & full), up & down
        if score < best[0]:
            best = (score, j + 1)
    return best


class ItemIndex:
    """The hashes of all item windows of a block, and the search of word sequences against them."""

    def __init__(self, items: list[tuple[object, list[int]]], similarity: float, efforts: dict[int, tuple[int, int]]):
        """`efforts` says per window size how many walks there are and how many hashes each."""
        if not 0 < similarity <= 1:
            raise ValueError("similarity must be above 0 and at most 1")
        self.items = items
        self.most = [allowed_edits(len(w), similarity) for _, w in items]
        self.masks: list[dict[int, int]] = []
        for _, words in items:
            masks: dict[int, int] = {}
            for i, word in enumerate(words):
                masks[word] = masks.get(word, 0) | 1 << i
            self.masks.append(masks)
        self.sizes, self.reach = np.array([len(w) for _, w in items], dtype=np.int64), np.array(self.most, dtype=np.int64)
        by_size: dict[int, list[int]] = {}
        for number, (_, words) in enumerate(items):
            by_size.setdefault(window_size(len(words)), []).append(number)
        self.walks: list[tuple[Walk, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = []
        for size, numbers in sorted(by_size.items()):
            flat, starts, places = [], [], []
            for number in numbers:
                words = items[number][1]
                for offset in range(max(len(words) - size, 0) + 1):
                    starts.append(len(flat) + offset)
                    places.append((number, offset))
                flat += words + [0] * size  # a walk past the end of its item meets nothing
            walks, samples = efforts[size]
            for walk in (Walk(size, i, samples) for i in range(walks)):
                tables = []
                for row in walk.hashes(np.array(flat, dtype=np.int64), 0, len(flat)):
                    row = row[starts]
                    order = np.argsort(row, kind="stable")
                    bits = np.zeros(1 << TABLE_BITS, dtype=bool)
                    bits[_mixed(row, TABLE_BITS)] = True
                    tables.append((bits, row[order], np.array(places, dtype=np.int64)[order]))
                self.walks.append((walk, tables))
        # Words of items, as one bit each: a wrong bit lets a candidate pass to the exact distance, never drops one.
        self.member_bits = max(16, min(26, (8 * int(self.sizes.sum())).bit_length()))
        self.members = np.zeros(1 << self.member_bits, dtype=bool)
        for number, (_, words) in enumerate(items):
            self.members[self._member(np.array(words, dtype=np.int64), np.int64(number))] = True

    def _member(self, words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return _mixed(words * _MIX + numbers, self.member_bits)

    def candidates(self, words: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (sequence, item, where its first word would stand) of windows that share a hash, in bounded parts.

        `ends` are the ends of the sequences in `words`.
        """
        for low in range(0, len(words), CHUNK):
            for walk, tables in self.walks:
                for hashes, (bits, keys, places) in zip(walk.hashes(words, low, min(low + CHUNK, len(words))), tables):
                    hits = np.flatnonzero(bits.take(_mixed(hashes, TABLE_BITS)))
                    first = np.searchsorted(keys, hashes[hits], "left")
                    count = np.searchsorted(keys, hashes[hits], "right") - first
                    hits, first, count = hits[count > 0], first[count > 0], count[count > 0]
                    owners = np.searchsorted(ends, hits + low, "right")
                    parts = np.cumsum(count) // CELLS
                    for part in np.unique(parts):
                        here = parts == part
                        n = count[here]
                        rows = np.repeat(first[here] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        begins = np.repeat(hits[here] + low, n) - places[rows, 1]
                        yield np.unique(np.stack([np.repeat(owners[here], n), places[rows, 0], begins], axis=1), axis=0)

    def likely(self, words: np.ndarray, ends: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The rows (sequence, item, start) with enough words of the item around: all words but the edits."""
        owners, numbers, starts = found.T
        low = np.maximum(starts - self.reach[numbers], np.where(owners > 0, ends[owners - 1], 0))
        high = np.minimum(starts + self.sizes[numbers] + self.reach[numbers], ends[owners])
        lengths = high - low
        keep = np.zeros(len(found), dtype=bool)
        parts = np.cumsum(lengths) // CELLS
        for part in np.unique(parts):
            here = np.flatnonzero(parts == part)
            n = lengths[here]
            begins = np.cumsum(n) - n
            around = words[np.repeat(low[here] - begins, n) + np.arange(n.sum())]
            member = self.members.take(self._member(around, np.repeat(numbers[here], n)))
            known = np.add.reduceat(member.astype(np.int64), begins)
            keep[here] = known >= (self.sizes - self.reach)[numbers[here]]
        return found[keep]

    def search(self, sequences: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(sequence, item, distance, start) for every item within reach of a sequence; its best passage."""
        ends = np.cumsum([len(s) for s in sequences], dtype=np.int64)
        if not len(ends) or not ends[-1] or not self.items:
            return
        words = np.concatenate(sequences)
        found = [self.likely(words, ends, c) for c in self.candidates(words, ends)]
        if not found:
            return
        best: dict[tuple[int, int], tuple[int, int]] = {}

        def verify(owner: int, number: int, a: int, b: int) -> None:
            distance, end = best_passage(self.items[number][1], self.masks[number], words[a:b])
            if distance <= self.most[number]:
                start = max(a + end - len(self.items[number][1]) - int(ends[owner]) + len(sequences[owner]), 0)
                best[owner, number] = min(best.get((owner, number), (1 << 60, 0)), (distance, start))

        # Regions that overlap are one: a sequence is read once per item at most, however often pieces are met.
        last: tuple[int, int, int, int] | None = None
        for owner, number, start in np.unique(np.concatenate(found), axis=0).tolist():
            most = self.most[number]
            a = max(start - most, int(ends[owner]) - len(sequences[owner]))
            b = min(start + len(self.items[number][1]) + most, int(ends[owner]))
            if last and last[:2] == (owner, number) and a <= last[3]:
                last = (*last[:3], max(b, last[3]))
                continue
            if last:
                verify(*last)
            last = (owner, number, a, b)
        if last:
            verify(*last)
        for (owner, number), (distance, start) in sorted(best.items()):
            yield owner, number, distance, start


def allowed_edits(n_words: int, similarity: float) -> int:
    return int((1 - similarity) * n_words + 1e-9)


def simulated_recall(
    items: list[list[int]], similarity: float, efforts: dict[int, tuple[int, int]], trials: int = TRIALS
) -> float:
    """Share of edited items that the index finds among other words, each with as many edits as are allowed."""
    draw = random.Random(1)
    index = ItemIndex(list(enumerate(items)), similarity, efforts)
    sequences, numbers = [], []
    for _ in range(-(-trials // len(items))):
        for number, words in enumerate(items):
            edited = list(words)
            for _ in range(index.most[number]):
                at, kind = draw.randrange(len(edited)), draw.randrange(3)
                edited[at : at + (kind != 0)] = [] if kind == 1 else [draw.getrandbits(62) | 1]
            context = [draw.getrandbits(62) | 1 for _ in range(20)]
            sequences.append(np.array(context + edited + context, dtype=np.int64))
            numbers.append(number)
    found = {(s, n) for s, n, _, _ in index.search(sequences)}
    return sum(pair in found for pair in enumerate(numbers)) / len(numbers)


def calibrated_efforts(items: list[list[int]], similarity: float, target: float) -> dict[int, tuple[int, int]]:
    """Walks and hashes per window size with which the simulated recall reaches `target` at the largest distance.

    It has to be reached by every length by itself, so that easy lengths do not hide hard ones; of the lengths of a
    window size, the `LENGTHS` shortest are looked at, which have the fewest windows.
    """
    by_size: dict[int, dict[int, list[list[int]]]] = {}
    for words in sorted(items, key=len):
        own = by_size.setdefault(window_size(len(words)), {}).setdefault(len(words), [])
        if len(own) < TRIALS:
            own.append(words)
    efforts = {}
    for size, lengths in by_size.items():
        todo, tries = list(lengths)[:LENGTHS], iter(EFFORTS)
        effort = next(tries)
        while todo:  # a length that is reached with little effort is reached with more
            if simulated_recall(lengths[todo[0]], similarity, {size: effort}) >= target:
                todo.pop(0)
                continue
            effort = next(tries, None)
            if effort is None:
                raise ValueError(f"recall {target} is out of reach for items of {todo[0]} words at similarity {similarity}")
        efforts[size] = effort
    return efforts


def item_blocks(benchmark: DataFrame, min_words: int) -> Iterator[list[tuple[object, list[int]]]]:
    """Items with at least `min_words` words, in blocks of a bounded number of words."""
    ids, block, size = _WordIds(), [], 0
    for row in benchmark.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        words = word_ids(row["text"] or "", ids).tolist()
        if len(words) < min_words:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], words))
        size += len(words)
    if block:
        yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, target_recall: float = 0.98, min_words: int = SMALLEST
) -> DataFrame:
    """doc_id, item_id, distance, item_words, start, _q1, _q2: items found in documents, one row per row and item.

    An item of w words is found where some passage is within (1 - `similarity`) * w word edits. Words are
    compared in lower case without punctuation at their ends; `start` counts such words. Items under
    `min_words` words (any number from 1) say nothing and are not searched. Walks are calibrated to find
    `target_recall` of the items at the largest distance, more at smaller ones, and exact copies always; what is
    found has its exact distance. A very long text is searched whole, in parts. _q1 and _q2 are the content key of the row. Null and empty texts hold no item;
    repeated rows are found alike; empty tables give no rows. Other columns are not returned.
    """
    spark = docs.sparkSession
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, item_words int, start long, _q1 long, _q2 long"
    out = None
    for block in item_blocks(benchmark, max(min_words, 1)):
        efforts = calibrated_efforts([w for _, w in block], similarity, target_recall)
        sent = spark.sparkContext.broadcast((block, efforts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, efforts = sent.value
            index, ids = ItemIndex(items, similarity, efforts), _WordIds()
            for batch in batches:
                rows = list(index.search([word_ids(t, ids) for t in texts_of(batch)]))
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(at),
                        pa.array([items[r[1]][0] for r in rows], target),
                        pa.array([r[2] for r in rows], pa.int32()),
                        pa.array([len(items[r[1]][1]) for r in rows], pa.int32()),
                        pa.array([r[3] for r in rows], pa.int64()),
                        *[batch.column(c).take(at) for c in KEY],
                    ],
                    names=["doc_id", "item_id", "distance", "item_words", "start", *KEY],
                )

        target = _arrow_type(benchmark, "item_id")
        found = docs.select("doc_id", "text", *content_key("doc_id", "text")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


@keeps_columns
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with the columns of `docs`; see `find_contamination`.

    Repeated rows stay or go together, rows without a text stay, an empty benchmark takes nothing out.
    """
    # Written first, so that its size is known and a small list is sent to the documents instead of moving them.
    hit = stage(find_contamination(docs, benchmark, **options).select(*KEY).distinct(), "contaminated")
    rows = docs.withColumns(dict(zip(KEY, content_key("doc_id", "text"))))
    return rows.join(hit, KEY, "left_anti").select(*docs.columns)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
