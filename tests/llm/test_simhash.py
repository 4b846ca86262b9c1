from __future__ import annotations

import random

import xxhash

from quirefold.llm.components import components
from quirefold.llm.simhash import drop_near_copies, fingerprint, near_links, simhash_groups
from tests.llm.helpers import AWKWARD, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text, shingle=3):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.translate(LOWER).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, max_bits=2):
    prints = [brute_fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(12):
        words = draw.choices(vocabulary, k=120)
        for copy in range(draw.randrange(1, 9)):
            changed = list(words)
            for _ in range(copy % 3):
                changed[draw.randrange(len(changed))] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(changed).replace("w1", "W1")))
    return rows + [(500 + i, "x y") for i in range(3)]


def test_fingerprint():
    for text in ("", "One", "one TWO", "a b c", "É é a\tb\nc d", "x " * 500):
        assert fingerprint(text, 3) == brute_fingerprint(text)


def test_equals_brute_force(spark):
    rows = corpus()
    got = simhash_groups(documents(spark, rows)).collect()
    found = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr)
    assert found == brute_components(rows + AWKWARD)


def test_no_link_is_lost_and_none_is_added(spark):
    draw = random.Random(2)
    base = [draw.getrandbits(64) for _ in range(40)]
    marks = set(base)
    for b in base:
        for _ in range(6):
            marks.add(b ^ sum(1 << i for i in draw.sample(range(64), draw.randrange(1, 5))))
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in marks]
    got = {(r["a"], r["b"]) for r in near_links(spark.createDataFrame(signed, "_qfp long"), 2).collect()}
    whole = (1 << 64) - 1
    want = {
        (a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & whole).bit_count() <= 2
    }
    assert got == want and want


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(5, 5), (None, 3), (201, 200), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)} | {200: 200, 201: 200}
    assert got == want


def test_one_of_each_group_stays(spark):
    rows = corpus()
    docs = documents(spark, rows)
    got = drop_near_copies(docs)
    assert got.columns == docs.columns
    groups = {}
    for doc_id, _, component in brute_components(rows + AWKWARD):
        groups.setdefault(component if component is not None else "none", set()).add(doc_id)
    ids = sorted((r["doc_id"] for r in got.collect()), key=repr)
    assert ids == sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=repr)


def test_empty_table(spark):
    docs = documents(spark, [], awkward=False)
    assert simhash_groups(docs).count() == 0 and drop_near_copies(docs).count() == 0
