"""LM scoring: the probability of a text under a unigram model of subwords, over all its segmentations.

The pieces come from an existing public vocabulary; its scores are the prior weights of the pieces. Training
words add expected piece counts to them, taken over all segmentations by the forward-backward recursion. A
text is a sequence of words and one end; no piece crosses a word start, so the probability of a text is the
product over its words of the sum over the word's segmentations, found by a forward recursion in logarithms.
That sum is needed once per distinct word.

The word table, with counts over all training documents, is what the model gathers: it grows with the corpus
and stays distributed. Texts meet it in two ways. Words that make up at least one of `FREQUENT` tokens number
at most `FREQUENT`; they are sent to the tasks, which add them up at once. Other words travel as (text, word,
count) rows and are joined; their counts per word are bounded by the same rule, so no join key is hot.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quirefold.llm.common import KEY, content_key, keeps_columns, partition_sum
from quirefold.session import stage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT = 200_000
FLUSH_WORDS = 300_000
PRIOR_TOKENS = 1_000.0
ROUNDS = 4
SLICE = 4096  # characters of a very long word whose arcs are held at a time
END = "</s>"
LN10 = math.log(10)


def read_pieces(path: str) -> tuple[dict[str, int], np.ndarray]:
    """Pieces that start with a word mark or hold none, byte pieces and the end, numbered, with prior shares.

    The scores of the file are log weights if it is a unigram vocabulary; those of a merge vocabulary are
    ranks, which stand for weights falling as 1 / rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    numbers: dict[str, int] = {}
    scores = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        plain = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        if (plain and "▁" not in piece[1:]) or piece == END:
            numbers[piece] = len(scores)
            scores.append(model.get_score(i))
    weights = np.array(scores)
    ranked = weights.min() < -1000  # log weights of a vocabulary of this size are far above
    weights = 1 / (2.7 + np.maximum(-weights, 0)) if ranked else np.exp(weights - weights.max())
    return numbers, weights / weights.sum()


class Lattice:
    """Segmentations of a word into pieces, with the logarithm of each piece's probability."""

    def __init__(self, numbers: dict[str, int], probabilities: np.ndarray):
        logs = np.log(probabilities)
        self.edges = {p: (i, float(logs[i])) for p, i in numbers.items() if p != END and not p.startswith("<0x")}
        self.octets = [(numbers[f"<0x{b:02X}>"], float(logs[numbers[f"<0x{b:02X}>"]])) for b in range(256)]
        self.end = float(logs[numbers[END]])
        self.longest = max(map(len, self.edges))

    def arcs(self, text: str, after: int = 0, last: int | None = None) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For every end position behind `after` up to `last`, (start, piece numbers, log probability) of what may come last.

        A character that is no piece by itself is spelt in bytes.
        """
        out, get, longest = [], self.edges.get, self.longest
        for j in range(after + 1, (len(text) if last is None else last) + 1):
            here = []
            for i in range(max(0, j - longest), j):
                edge = get(text[i:j])
                if edge is not None:
                    here.append((i, edge[:1], edge[1]))
            if not here or here[-1][0] != j - 1:
                spelt = [self.octets[b] for b in text[j - 1].encode("utf-8", "surrogatepass")]
                here.append((j - 1, tuple(n for n, _ in spelt), sum(x for _, x in spelt)))
            out.append(here)
        return out

    @staticmethod
    def forward(arcs: list, alpha: array | None = None) -> array:
        """Log probability of every prefix, summed over its segmentations; goes on behind the prefixes of `alpha`."""
        alpha = array("d", [0.0]) if alpha is None else alpha
        for here in arcs:
            terms = [alpha[i] + x for i, _, x in here]
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)) if len(terms) > 1 else top)
        return alpha

    def prefixes(self, text: str) -> array:
        """`forward` over the whole text. Arcs are held for one slice at a time, so a character costs eight bytes."""
        alpha = array("d", [0.0])
        for after in range(0, len(text), SLICE):
            self.forward(self.arcs(text, after, min(after + SLICE, len(text))), alpha)
        return alpha

    def log_probability(self, word: str) -> float:
        return self.prefixes("▁" + word)[-1]

    def expect(self, word: str, count: float, into: np.ndarray) -> None:
        """Add the expected numbers of the pieces in `count` occurrences of the word."""
        text = "▁" + word
        alpha = self.prefixes(text)
        beta = array("d", [-math.inf]) * len(alpha)
        beta[-1], total = 0.0, alpha[-1]
        for after in reversed(range(0, len(text), SLICE)):  # the slices of `prefixes` once more, from the end
            arcs = self.arcs(text, after, min(after + SLICE, len(text)))
            for j in range(after + len(arcs), after, -1):
                if beta[j] == -math.inf:
                    continue
                for i, pieces, x in arcs[j - after - 1]:
                    weight = count * math.exp(alpha[i] + x + beta[j] - total)
                    for p in pieces:
                        into[p] += weight
                    high, low = max(beta[i], x + beta[j]), min(beta[i], x + beta[j])
                    beta[i] = high if low == -math.inf else high + math.log1p(math.exp(low - high))


class LatticeBlocks:
    """The recursions of `Lattice` for many words at once: words of one length are the columns of a matrix.

    Pieces are found by a rolling hash of the code points in two tables of slots. Very long words, which are
    few, take the recursions one by one.
    """

    LONGEST_WORD, CELLS, SLOT_BITS = 64, 1 << 16, 20
    _BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, numbers: dict[str, int], probabilities: np.ndarray):
        self.single = Lattice(numbers, probabilities)
        self.size = len(probabilities)
        pieces = list(self.single.edges.items())
        self.keys = np.array([self._hash(p) for p, _ in pieces] + [0], dtype=np.uint64)
        self.logs = np.array([x for _, (_, x) in pieces] + [-math.inf])
        self.numbers = np.array([n for _, (n, _) in pieces] + [0])
        left, self.tables = np.arange(len(pieces)), []
        while len(left):  # every piece gets a slot of its own in one of the tables
            factor = self._STEP + np.uint64(2 * len(self.tables))
            slots = np.full(1 << self.SLOT_BITS, -1, dtype=np.int32)
            at = self._slot(self.keys[left], factor)
            slots[at[::-1]] = left[::-1]
            self.tables.append((factor, slots))
            left = left[slots[at] != left]
        self.powers = np.cumprod(np.full(self.single.longest + 1, self._BASE), dtype=np.uint64)

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self._BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _hashes(self, codes: np.ndarray) -> list[np.ndarray]:
        """Hash of every prefix of the rows; the first is that of the empty prefix."""
        out = [np.zeros(len(codes), dtype=np.uint64)]
        for column in codes.T:
            out.append(out[-1] * self._BASE + column + np.uint64(1))
        return out

    def _slot(self, hashes: np.ndarray, factor: np.uint64) -> np.ndarray:
        mixed = hashes * factor
        return ((mixed ^ (mixed >> np.uint64(29))) * factor >> np.uint64(64 - self.SLOT_BITS)).view(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1, which stands for a log probability of minus infinity.

        A later table holds only pieces whose slot in all earlier ones is taken, so an empty slot ends the search.
        """
        flat = hashes.ravel()
        factor, slots = self.tables[0]
        found = slots.take(self._slot(flat, factor))
        open_ = np.flatnonzero(found >= 0)
        open_ = open_[self.keys.take(found[open_]) != flat[open_]]
        found[open_] = -1
        for factor, slots in self.tables[1:]:
            here = slots.take(self._slot(flat[open_], factor))
            same = (here >= 0) & (self.keys.take(here) == flat[open_])
            found[open_[same]] = here[same]
            open_ = open_[(here >= 0) & ~same]
        return found.reshape(hashes.shape)

    def _spelt(self, code: int) -> tuple[list[int], float]:
        octets = [self.single.octets[b] for b in chr(code).encode("utf-8", "surrogatepass")]
        return [n for n, _ in octets], sum(x for _, x in octets)

    def _forward(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        """alpha (positions, words) and, per end position, (first start, pieces, log probabilities)."""
        n, length = codes.shape
        hashes = self._hashes(codes)
        alpha, steps = np.zeros((length + 1, n)), []
        for j in range(1, length + 1):
            low = max(0, j - self.single.longest)
            heads = np.stack(hashes[low:j]) * self.powers[j - low - 1 :: -1][: j - low, None]
            pieces = self._find(hashes[j] - heads)
            logs = self.logs.take(pieces)
            for code in np.unique(codes[pieces[-1] < 0, j - 1]):
                logs[-1, (pieces[-1] < 0) & (codes[:, j - 1] == code)] = self._spelt(int(code))[1]
            terms = alpha[low:j] + logs
            top = terms.max(axis=0)
            alpha[j] = top + np.log(np.exp(terms - top).sum(axis=0))
            steps.append((low, pieces, logs))
        return alpha, steps

    def _blocks(self, words: list[str]):
        """(positions, code matrix) of words of one length, then (positions, None) for the long ones."""
        marked = ["▁" + w for w in words]
        lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
        order = np.argsort(lengths, kind="stable")
        for length in np.unique(lengths):
            at = order[np.searchsorted(lengths[order], length) : np.searchsorted(lengths[order], length, "right")]
            if length > self.LONGEST_WORD:
                yield at, None
                continue
            step = max(1, self.CELLS // int(length))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                data = "".join([marked[i] for i in part]).encode("utf-32-le", "surrogatepass")
                yield part, np.frombuffer(data, dtype=np.uint32).reshape(len(part), length)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for at, codes in self._blocks(words):
            if codes is None:
                out[at] = [self.single.log_probability(words[i]) for i in at]
            else:
                out[at] = self._forward(codes)[0][-1]
        return out

    def expect(self, words: list[str], counts: np.ndarray, into: np.ndarray) -> None:
        for at, codes in self._blocks(words):
            if codes is None:
                for i in at:
                    self.single.expect(words[i], float(counts[i]), into)
                continue
            alpha, steps = self._forward(codes)
            beta = np.full(alpha.shape, -math.inf)
            beta[-1] = 0
            for j in range(len(steps), 0, -1):
                low, pieces, logs = steps[j - 1]
                tails = logs + beta[j]
                weights = np.exp(alpha[low:j] + tails - alpha[-1]) * counts[at]
                known = pieces >= 0
                into += np.bincount(self.numbers.take(pieces[known]), weights=weights[known], minlength=self.size)
                for code in np.unique(codes[~known[-1], j - 1]):
                    share = weights[-1, ~known[-1] & (codes[:, j - 1] == code)].sum()
                    for number in self._spelt(int(code))[0]:
                        into[number] += share
                beta[low:j] = np.logaddexp(beta[low:j], tails)


def words_of(text: str | None) -> list[bytes]:
    """`[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_table(docs: DataFrame, learn: Column) -> DataFrame:
    """(word, n, c): occurrences over all documents and over those where `learn` holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, learnt in zip(batch.column("text").to_pylist(), batch.column("learnt").to_pylist()):
                counts[learnt].update(words_of(text))
            if len(counts[0]) + len(counts[1]) > FLUSH_WORDS:
                yield from _rows(counts)
                counts = (Counter(), Counter())
        yield from _rows(counts)

    rows = docs.select("text", F.coalesce(learn, F.lit(False)).alias("learnt"))
    counted = rows.mapInArrow(count, "word binary, n long, learnt boolean")
    learnt = F.when(F.col("learnt"), F.col("n")).otherwise(0)
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum(learnt).alias("c"))


def _rows(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
    for learnt in (0, 1):
        if counts[learnt]:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(counts[learnt].keys(), pa.binary()),
                    pa.array(counts[learnt].values(), pa.int64()),
                    pa.array([bool(learnt)] * len(counts[learnt])),
                ],
                names=["word", "n", "learnt"],
            )


def piece_probabilities(
    words: DataFrame,
    numbers: dict[str, int],
    prior: np.ndarray,
    weights: np.ndarray,
    end_count: int,
    prior_tokens: float = PRIOR_TOKENS,
) -> np.ndarray:
    """One re-estimation: the prior as `prior_tokens` pieces, and the pieces expected in the training words.

    `weights` are the probabilities of the round before.
    """
    sent = words.sparkSession.sparkContext.broadcast((numbers, weights))
    built: dict[str, LatticeBlocks] = {}  # each task gets its own copy of the empty dictionary

    def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        if not built:
            built["blocks"] = LatticeBlocks(*sent.value)
        blocks = built["blocks"]
        words = [w.decode("utf-8", "surrogatepass") for w in batch.column("word").to_pylist()]
        blocks.expect(words, np.asarray(batch.column("c"), dtype=float), sums)

    counts = partition_sum(words.where("c > 0").select("word", "c"), add, len(prior)) + prior_tokens * prior
    counts[numbers[END]] += end_count
    return counts / counts.sum()


@keeps_columns
def score_texts(
    docs: DataFrame, learn: Column, vocabulary: str = VOCABULARY, prior_tokens: float = PRIOR_TOKENS
) -> DataFrame:
    """doc_id, _qmark (the value of `learn`), n_tokens, n_known, train_tokens, base_score, score per row.

    Texts are lower-cased in A-Z; tokens are the words between ASCII white space and one end per text; null is
    the empty text, which is its end alone. Learning rows are those where `learn` holds (null: not learnt).
    `base_score` sums log10((c + 0.1) / (N + 0.1 * (V + 1))) over tokens, with c the training count, N all and V
    the distinct training tokens; `n_known` counts tokens with c > 0. `score` is the log10 probability of the
    text under the subword model, in which the vocabulary's own weights count as `prior_tokens` pieces. Repeated rows get equal values and stay separate; an empty table gives none.
    """
    spark = docs.sparkSession
    numbers, prior = read_pieces(vocabulary)
    words = stage(word_table(docs, learn), "words")
    ends = docs.where(learn).count()
    seen = words.agg(F.sum("n"), F.sum("c"), F.count_if(F.col("c") > 0)).first()
    tokens, train = (seen[0] or 0), (seen[1] or 0) + ends
    distinct = (seen[2] or 0) + (ends > 0)
    often = max(tokens // FREQUENT, 1)  # at most FREQUENT words reach `often` occurrences among `tokens`
    probabilities = prior
    for _ in range(ROUNDS):
        probabilities = piece_probabilities(words, numbers, prior, probabilities, ends, prior_tokens)
    model = spark.sparkContext.broadcast((numbers, probabilities))
    spread = train + 0.1 * (distinct + 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = LatticeBlocks(*model.value)
        for batch in batches:
            names = [w.decode("utf-8", "surrogatepass") for w in batch.column("word").to_pylist()]
            logs = blocks.log_probabilities(names) / LN10
            counts = np.asarray(batch.column("c"), dtype=float)
            base = np.log10((counts + 0.1) / spread)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), batch.column("c"), pa.array(base), pa.array(logs, pa.float64())],
                names=["word", "n", "c", "base", "log10p"],
            )

    judged = stage(words.mapInArrow(judge, "word binary, n long, c long, base double, log10p double"), "judged-words")
    frequent = _frequent(judged, often)
    sent = spark.sparkContext.broadcast(frequent)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sums = "m boolean, n_tokens long, n_known long, base double, log10p double"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            known, base, logs, sizes, rare, rare_counts, offsets = [], [], [], [], [], [], [0]
            for text in batch.column("text").to_pylist():
                counts = Counter(words_of(text))
                k, b, s, n = 0, 0.0, 0.0, 0
                for word, c in counts.items():
                    n += c
                    found = get(word)
                    if found is None:
                        rare.append(word)
                        rare_counts.append(c)
                    else:
                        k += c * found[0]
                        b += c * found[1]
                        s += c * found[2]
                known.append(k), base.append(b), logs.append(s), sizes.append(n + 1), offsets.append(len(rare))
            items = pa.StructArray.from_arrays(
                [pa.array(rare, pa.binary()), pa.array(rare_counts, pa.int64())], names=["word", "times"]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in ("doc_id", *KEY, "m")]
                + [pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(logs)]
                + [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)],
                names=["doc_id", *KEY, "m", "n_tokens", "n_known", "base", "log10p", "rare"],
            )

    rows = docs.select("doc_id", "text", *content_key("doc_id", "text"), learn.alias("m")).mapInArrow(
        split, f"doc_id {kind}, _q1 long, _q2 long, {sums}, rare array<struct<word binary, times bigint>>"
    )
    # Repeated rows share a content key: their parts are added up, divided by their number and repeated again.
    rows = stage(rows, "frequent-parts")
    rest = rows.select(*KEY, F.inline("rare")).join(judged.where(F.col("n") <= often), "word")
    rest = rest.select(
        *KEY,
        (F.col("times") * (F.col("c") > 0).cast("long")).alias("n_known"),
        (F.col("times") * F.col("base")).alias("base"),
        (F.col("times") * F.col("log10p")).alias("log10p"),
    )
    rest = rest.groupBy(*KEY).agg(*[F.sum(x).alias(f"r_{x}") for x in ("n_known", "base", "log10p")])
    copies = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("copies"),
        *[F.first(x).alias(x) for x in ("doc_id", "m", "n_tokens", "n_known", "base", "log10p")],
    )
    end_known, end_base = int(ends > 0), math.log10((ends + 0.1) / spread)
    end_log = math.log10(float(probabilities[numbers[END]]))

    def whole(name: str) -> Column:
        return F.col(name) + F.coalesce(F.col(f"r_{name}") / F.col("copies"), F.lit(0))

    out = copies.join(rest, KEY, "left").withColumn("_qcopy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        "doc_id",
        F.col("m").alias("_qmark"),
        "n_tokens",
        (whole("n_known") + end_known).cast("long").alias("n_known"),
        F.lit(int(train)).cast("long").alias("train_tokens"),
        (whole("base") + end_base).alias("base_score"),
        (whole("log10p") + end_log).alias("score"),
    )


def _frequent(judged: DataFrame, often: int) -> dict[bytes, tuple[int, float, float]]:
    found = judged.where(F.col("n") > often).select("word", "c", "base", "log10p").toArrow()
    columns = [found.column(x).to_pylist() for x in found.column_names]
    return {w: (int(c > 0), b, s) for w, c, b, s in zip(*columns)}
