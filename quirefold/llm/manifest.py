"""Merkle manifest of a dataset, kept as an append log in postorder.

Per source, leaves stand in the order of doc_id under a tree of `FAN` children a node; the roots of all sources
are the leaves of one more tree. Builders work on aligned blocks of leaves (whole subtrees of `LEVELS` levels), so
they need nothing from each other: each appends its nodes to its page of the log the moment they are complete, children
before parents. Roots of pages are the leaves of the next round, until one node is left.

Nothing but digests is stored: where a node stands in the log follows from its level and the end of its leaves
by a closed form, as every subtree to its left has a known size. A proof reads the siblings of a leaf, level by
level, from those positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quirefold.llm.common import LOWER, UPPER, in_order_within
from quirefold.session import stage

FAN, LEVELS = 16, 2  # children of a node; levels that a builder completes by default
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")  # fixed value: what a leaf covers, in this order
DIGEST = 32


def leaf_digest(fields: list[Column]) -> Column:
    """The digest over all fields: `-` for null, else the number of UTF-8 bytes, a colon and the value."""

    def part(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(f) for f in fields]), 256))


def joined(digests: list[bytes]) -> bytes:
    """The digest of a run of nodes: over their lower-case hex digits."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height(n: int, least: int = 0) -> int:
    """Levels above `n` leaves: until one node is left, and `least` at least."""
    levels = 0
    while n > 1 or levels < least:
        n, levels = -(-n // FAN), levels + 1
    return levels


def position(level: int, end: int, top: int) -> int:
    """Where the node of `level` whose leaves end before leaf `end` stands in the log of a tree `top` levels high.

    Of each level, all nodes that cover leaves before `end` are written by then, but for those above the node.
    """
    return sum(-(-end // FAN**k) for k in range(top + 1)) - (top - level) - 1


def append_log(leaves: list[bytes], least: int = 0) -> list[bytes]:
    """All nodes over `leaves` in the order in which they are complete; the last one is the root."""
    top = height(len(leaves), least)
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(top + 1)]
    for i, leaf in enumerate(leaves):
        log.append(leaf)
        waiting[0].append(leaf)
        for level in range(top):
            if (i + 1) % FAN ** (level + 1) and i + 1 < len(leaves):
                break
            node = joined(waiting[level])
            waiting[level] = []
            log.append(node)
            waiting[level + 1].append(node)
    return log


def sibling_runs(log: bytes, leaf: int, n: int, top: int) -> list[tuple[list[bytes], int]]:
    """Per level, the run of the leaf's ancestor (itself included) and its place in it, read from the log."""
    runs, at = [], leaf
    for level in range(top):
        count = -(-n // FAN**level)
        first = at - at % FAN
        run = []
        for i in range(first, min(first + FAN, count)):
            p = DIGEST * position(level, min((i + 1) * FAN**level, n), top)
            run.append(log[p : p + DIGEST])
        runs.append((run, at - first))
        at //= FAN
    return runs


def fold(leaf: bytes, runs: list[tuple[list[bytes], int]]) -> bytes:
    """The root that follows from a leaf and the other nodes of its runs."""
    for run, at in runs:
        leaf = joined([*run[:at], leaf, *run[at + 1 :]])
    return leaf


@dataclass
class Manifest:
    """Pages of the log: of the trees of all sources, round by round, and of the tree over their roots.

    `t` names a tree: `=` and the source, or the empty string for rows without one, which sorts as the source does.
    """

    pages: list[DataFrame]
    top_pages: list[DataFrame]
    root: bytes | None
    levels: int


_PAGE = "t string, block long, full boolean, n int, top int, log binary, root binary"


def _pages(nodes: DataFrame, name: str, extra: list[str], levels: int) -> DataFrame:
    """One row per builder from nodes (t, idx, digest, *extra), written: its log, and its rows in leaf order."""
    size = FAN**levels
    # Only the first page of a tree can be its only one; a tree is larger if its leaf number `size` exists.
    more = nodes.where(F.col("idx") == size).select("t", F.lit(0).cast("long").alias("block"), F.lit(True).alias("more"))
    block = F.call_function("div", F.col("idx"), F.lit(size))
    rows = nodes.withColumn("block", block).groupBy("t", "block").agg(
        F.sort_array(F.collect_list(F.struct("idx", "digest", *extra))).alias("leaves")
    )
    rows = rows.join(more, ["t", "block"], "left").withColumn("full", (F.col("block") > 0) | F.col("more").isNotNull())
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name == "leaves")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n": [], "top": [], "log": [], "root": []}
            digests = batch.column("leaves").flatten().field("digest").to_pylist()
            at = 0
            for n, full in zip(batch.column("leaves").value_lengths().to_pylist(), batch.column("full").to_pylist()):
                log = append_log(digests[at : at + n], levels if full else 0)
                at += n
                out["n"].append(n), out["top"].append(height(n, levels if full else 0))
                out["log"].append(b"".join(log)), out["root"].append(log[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("t", "block", "full")], pa.array(out["n"], pa.int32()), pa.array(out["top"], pa.int32()),
                    pa.array(out["log"], pa.binary()), pa.array(out["root"], pa.binary()), batch.column("leaves"),
                ],
                names=["t", "block", "full", "n", "top", "log", "root", "leaves"],
            )

    return stage(rows.select("t", "block", "full", "leaves").mapInArrow(build, f"{_PAGE}, {kept}"), name)


def _build(nodes: DataFrame, name: str, extra: list[str], levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of pages over nodes (t, idx, digest), and the roots (t, digest) of all trees.

    The only page of a tree holds its root; the pages of larger trees are the leaves of the next round.
    """
    rounds = [_pages(nodes, name, extra, levels)]
    while not rounds[-1].where("full").isEmpty():
        above = rounds[-1].where("full").select("t", F.col("block").alias("idx"), F.col("root").alias("digest"))
        rounds.append(_pages(above, name, [], levels))
    roots = [pages.where("NOT full").select("t", F.col("root").alias("digest")) for pages in rounds]
    return rounds, reduce(DataFrame.unionByName, roots)


def _paths(rounds: list[DataFrame], levels: int) -> DataFrame | None:
    """(t, block, path): per page of the lowest round, the runs from its root to the root of its tree; trees of
    one page have none. `path` is an array of (run, place) from the lowest level up."""
    if len(rounds) == 1:
        return None
    schema = "t string, block long, path array<struct<run:binary,place:int>>"
    path = None
    for pages in reversed(rounds[1:]):
        rows = pages.select("t", "block", "n", "top", "log")
        rows = rows.withColumn("path", F.lit(None).cast("array<struct<run:binary,place:int>>")) if path is None else rows.join(path, ["t", "block"], "left")

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    out: list[dict] = []
                    for leaf in range(row["n"]):
                        runs = sibling_runs(row["log"], leaf, row["n"], row["top"])
                        own = [{"run": b"".join(run), "place": at} for run, at in runs]
                        out.append({"t": row["t"], "block": row["block"] * FAN**levels + leaf, "path": own + (row["path"] or [])})
                    yield pa.RecordBatch.from_pylist(out, schema=_PATHS)

        path = stage(rows.mapInArrow(extract, schema), "paths")
    return path


_PATHS = pa.schema(
    [("t", pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.struct([("run", pa.binary()), ("place", pa.int32())])))]
)


def _tree_name(source: Column) -> Column:
    """Never null, and sorts as the source does with null first."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def build_manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> Manifest:
    """The log of all trees over `docs`, one leaf per row.

    Leaves of a source ascend by doc_id (null first), rows of one doc_id by digest; sources ascend bytewise,
    null first. Where `tampered` is true, a second digest is taken over the text with A-Z in lower case.
    A builder takes `FAN ** levels` leaves. Null fields, empty and very long texts are digests like any other.
    """
    fields = [F.col(f) for f in FIELDS]
    changed = [*fields[:-1], F.translate("text", UPPER, LOWER)]
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = docs.select(
        "doc_id",
        _tree_name(F.col("source")).alias("t"),
        leaf_digest(fields).alias("digest"),
        F.when(tampered, leaf_digest(changed)).alias("tampered"),
    )
    nodes = in_order_within(stage(leaves, "leaves"), "t", ["doc_id", "digest"], "idx")
    pages, roots = _build(nodes, "pages", ["doc_id", "tampered"], levels)
    roots = stage(roots, "roots")
    sources = in_order_within(roots.select(F.lit("all").alias("t"), F.col("t").alias("tree"), "digest"), "t", ["tree"], "idx")
    top_pages, root = _build(sources, "top-pages", ["tree"], levels)
    found = root.first()
    return Manifest(pages, top_pages, found["digest"] if found else None, levels)


def prove(manifest: Manifest) -> DataFrame:
    """Per row of the dataset: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The proof is the siblings on the way from the leaf to its subroot and on to the root, left to right, level
    by level; `proof_sha256` covers their hex digits. `folded_root` is computed again from the (tampered, if
    so marked) leaf and the siblings, `verified` says whether it is the root. A row without siblings has the
    digest of nothing. Repeated rows are leaves of their own; an empty dataset gives no rows. Very long texts
    are one digest like any other, nulls in any field are part of the digest.
    """
    kind = manifest.pages[0].schema["leaves"].dataType.elementType["doc_id"].dataType
    path_type = "array<struct<run:binary,place:int>>"
    upper = _paths(manifest.pages, manifest.levels)
    tops = _proofs_of_sources(manifest)
    rows = manifest.pages[0].select("t", "block", "n", "top", "log", "leaves")
    rows = rows.withColumn("path", F.lit(None).cast(path_type)) if upper is None else rows.join(upper, ["t", "block"], "left")
    # Few sources are sent to the pages by the size of their table; else the adaptive join splits a large source.
    rows = rows.join(tops, "t")
    root = manifest.root

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in ("n", "top", "log", "path", "above", "subroot")}
                leaves = batch.column("leaves").slice(i, 1).flatten()
                shared = [([r["run"][j : j + DIGEST] for j in range(0, len(r["run"]), DIGEST)], r["place"]) for r in (row["path"] or []) + (row["above"] or [])]
                shared_text = _others(shared)
                out: dict[str, list] = {k: [] for k in ("leaf", "proof", "folded", "verified")}
                digests, tampered = leaves.field("digest").to_pylist(), leaves.field("tampered").to_pylist()
                for first in range(0, row["n"], FAN):  # leaves of one run have all but their own place in common
                    runs = sibling_runs(row["log"], first, row["n"], row["top"])
                    above_text = _others(runs[1:]) + shared_text
                    for at in range(first, min(first + FAN, row["n"])):
                        own = [(run, at - first) for run, _ in runs[:1]]
                        proof = _others(own) + above_text
                        folded = fold(digests[at] if tampered[at] is None else tampered[at], own + runs[1:] + shared)
                        out["leaf"].append(digests[at].hex())
                        out["proof"].append(hashlib.sha256(proof.encode()).hexdigest())
                        out["folded"].append(folded.hex())
                        out["verified"].append(folded == root)
                n = row["n"]
                yield pa.RecordBatch.from_arrays(
                    [
                        leaves.field("doc_id"), pa.array(out["leaf"]), pa.array([row["subroot"].hex()] * n),
                        pa.array([root.hex()] * n), pa.array(out["proof"]), pa.array(out["folded"]), pa.array(out["verified"]),
                    ],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    schema = f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.mapInArrow(extract, schema)


def _others(runs: list[tuple[list[bytes], int]]) -> str:
    """The hex digits of all nodes of the runs but the ancestors themselves."""
    return "".join(d.hex() for run, at in runs for d in [*run[:at], *run[at + 1 :]])


def _proofs_of_sources(manifest: Manifest) -> DataFrame:
    """(t, subroot, above): the runs from a source's root to the root of all."""
    rows = manifest.top_pages[0].select("t", "block", "n", "top", "log", "leaves")
    upper = _paths(manifest.top_pages, manifest.levels)
    path_type = "array<struct<run:binary,place:int>>"
    rows = rows.withColumn("path", F.lit(None).cast(path_type)) if upper is None else rows.join(upper, ["t", "block"], "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in ("n", "top", "log", "path", "leaves")}
                out = []
                for at, leaf in enumerate(row["leaves"]):
                    runs = sibling_runs(row["log"], at, row["n"], row["top"])
                    own = [{"run": b"".join(run), "place": place} for run, place in runs]
                    out.append({"t": leaf["tree"], "subroot": leaf["digest"], "above": own + (row["path"] or [])})
                yield pa.RecordBatch.from_pylist(out, schema=_TOPS)

    return stage(rows.mapInArrow(extract, f"t string, subroot binary, above {path_type}"), "proofs-of-sources")


_TOPS = pa.schema(
    [("t", pa.string()), ("subroot", pa.binary()), ("above", pa.list_(pa.struct([("run", pa.binary()), ("place", pa.int32())])))]
)


def log_of(manifest: Manifest) -> DataFrame:
    """(round, t, block, position, digest): the log of every tree written out, page by page."""
    out = None
    for number, pages in enumerate(manifest.pages):
        nodes = F.sequence(F.lit(0), (F.octet_length("log") / DIGEST - 1).cast("int"))
        rows = pages.select(F.lit(number).alias("round"), "t", "block", "log", F.explode(nodes).alias("position"))
        rows = rows.withColumn("digest", F.lower(F.hex(F.substring("log", F.col("position") * DIGEST + 1, F.lit(DIGEST))))).drop("log")
        out = rows if out is None else out.unionByName(rows)
    return out
