"""Semantic chunking of documents that are one row each.

Plan, with an additive embedder: one hash exchange of the documents on `title`, in which rows of one title meet.
Cutting, distances, threshold and chunks then work on arrays of that one row, so nothing as long as the units is
sorted or exchanged, and vectors never leave the Arrow batch they are counted in. Other embedders get texts of
windows, one row per unit, and their units are exchanged on `title` once more behind the Python tasks. Either way a
title's units are the text of its input row, so the size of a row bounds them. Documents that are spread
over many rows, and may be larger than a row, go through `operators.longform`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirefold.functions.embedders import HashEmbedder
from quirefold.functions.text import PARAGRAPH, bound, is_not_blank, unit_array
from quirefold.functions.vectors import cosine_distance_of, dot, norm, round_to
from quirefold.operators.ordering import running_total_in_row_groups
from quirefold.operators.splitting import MAX_WORDS, WINDOW_SEPARATOR, split_units

# The amount used for a threshold type when none is given.
DEFAULT_AMOUNTS = {"percentile": 95, "standard_deviation": 3, "interquartile": 1.5, "gradient": 95}

# With `digits`, distances are rounded to that many digits, gradients to one more and thresholds to four more:
# cuts are then the same on every engine, and the exact percentile has a bounded state, as there are only so many
# values between 0 and 2. Without, they are compared as they are.
COMPARED_DIGITS = 6


@dataclass(frozen=True)
class Breakpoints:
    """How a document's distances turn into a threshold. `number_of_chunks` overrides the type."""

    kind: str = "percentile"
    amount: float | None = None
    number_of_chunks: int | None = None
    digits: int | None = None

    def __post_init__(self):
        if self.kind not in DEFAULT_AMOUNTS:
            raise ValueError(f"unknown breakpoint threshold type: {self.kind}")
        if self.amount is None:
            object.__setattr__(self, "amount", DEFAULT_AMOUNTS[self.kind])

    @property
    def uses_gradient(self) -> bool:
        return self.kind == "gradient" and self.number_of_chunks is None

    @property
    def bypass_units(self) -> int:
        """Documents with at most this many units are not measured; each unit is a chunk."""
        return 2 if self.kind == "gradient" else 1

    def nth(self, n: Column) -> Column:
        """Which of the `n` largest metrics is the threshold when a number of chunks is wanted."""
        return F.least(F.greatest(F.lit(self.number_of_chunks), F.lit(1)), n)

    def threshold(self, metric: Column, over: Callable[[Column], Column] = lambda c: c) -> Column:
        """Aggregate expression of the threshold; `over` turns it into a window expression.

        Not for a number of chunks, whose threshold is a rank: see `measure_units` and `document_thresholds`.
        """
        if self.kind in ("percentile", "gradient"):
            value = over(F.percentile(metric, F.lit(self.amount / 100.0)))
        elif self.kind == "standard_deviation":
            value = over(F.avg(metric)) + F.lit(float(self.amount)) * over(F.stddev_pop(metric))
        else:
            quarters = over(F.percentile(metric, F.array(F.lit(0.25), F.lit(0.75))))
            value = over(F.avg(metric)) + F.lit(float(self.amount)) * (quarters[1] - quarters[0])
        return value if self.digits is None else F.round(value, self.digits + 4)

    def metrics(self, distances: Column) -> Column:
        """The metric of every unit of a document, from the array of its distances."""
        return gradients(distances, self.digits) if self.uses_gradient else distances

    def threshold_of(self, metrics: Column) -> Column:
        """`threshold`, or the rank that stands for it, over an array of metrics; nulls do not count."""
        found = F.filter(metrics, lambda m: m.isNotNull())
        if self.number_of_chunks is not None:
            largest = F.sort_array(found, asc=False)
            return bound(largest, lambda a: F.get(a, self.nth(F.size(a)) - 1))
        if self.kind in ("percentile", "gradient"):
            value = bound(F.sort_array(found), lambda a: percentile_of(a, self.amount / 100.0))
        elif self.kind == "standard_deviation":
            value = bound(found, lambda a: mean_of(a) + F.lit(float(self.amount)) * deviation_of(a))
        else:
            spread = bound(F.sort_array(found), lambda a: percentile_of(a, 0.75) - percentile_of(a, 0.25))
            value = bound(found, mean_of) + F.lit(float(self.amount)) * spread
        return value if self.digits is None else F.round(value, self.digits + 4)


def percentile_of(ascending: Column, share: float) -> Column:
    """The aggregate `percentile` of a sorted array."""
    at = (F.size(ascending) - 1) * F.lit(share)
    low, high = F.floor(at), F.ceil(at)
    below, above = F.get(ascending, low.cast("int")), F.get(ascending, high.cast("int"))
    return F.when(below == above, below).otherwise((high - at) * below + (at - low) * above)


def mean_of(values: Column) -> Column:
    """The aggregate `avg` of an array."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values))


def deviation_of(values: Column) -> Column:
    """The aggregate `stddev_pop` of an array, by the same running moments."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(acc: Column, x: Column) -> Column:
        n, delta = acc["n"] + 1.0, x - acc["mean"]
        step = delta / n
        return F.struct(n.alias("n"), (acc["mean"] + step).alias("mean"), (acc["m2"] + delta * (delta - step)).alias("m2"))

    return F.aggregate(values, start, add, lambda acc: F.when(acc["n"] > 0, F.sqrt(acc["m2"] / acc["n"])))


def window_vectors(
    units: DataFrame, embedder, buffer_size: int, by: list[str], measured: Column | None = None
) -> DataFrame:
    """Add `vec`, the vector of the text window around each unit, where `measured` holds.

    The embedder never sees texts that are not measured. Additive embedders need no window texts: see `distances`.
    """
    around = Window.partitionBy(*by).orderBy("idx").rowsBetween(-buffer_size, buffer_size)
    measured = F.lit(True) if measured is None else measured
    combined = F.array_join(F.collect_list("sentence").over(around), WINDOW_SEPARATOR)
    return units.withColumn("_combined", F.when(measured, combined)).withColumn(
        "vec", embedder.embed(F.col("_combined"))
    ).drop("_combined")


def _rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else round_to(value, digits)


def neighbour_distances(units: DataFrame, by: list[str], digits: int | None = None) -> DataFrame:
    """Add `distance`: cosine distance between a unit's `vec` and the next one; null on the last unit."""
    order = Window.partitionBy(*by).orderBy("idx")
    units = units.withColumn("_norm", norm(F.col("vec")))
    return (
        units.withColumn("_next", F.lead(F.struct("vec", "_norm")).over(order))
        .withColumn(
            "distance",
            F.when(
                F.col("_next").isNotNull(),
                _rounded(
                    cosine_distance_of(dot(F.col("vec"), F.col("_next.vec")), F.col("_norm"), F.col("_next._norm")),
                    digits,
                ),
            ),
        )
        .drop("_next", "_norm", "vec")
    )


def gradient(by: list[str], digits: int | None = None) -> Column:
    """Numerical gradient of `distance`: central differences inside, one-sided at both ends."""
    order = Window.partitionBy(*by).orderBy("idx")
    here, prev, nxt = F.col("distance"), F.lag("distance").over(order), F.lead("distance").over(order)
    slope = F.when(prev.isNull(), nxt - here).when(nxt.isNull(), here - prev).otherwise((nxt - prev) / 2)
    return F.when(here.isNotNull(), _rounded(slope, None if digits is None else digits + 1))


def rounded_distances(distances: Column, digits: int | None) -> Column:
    return distances if digits is None else F.transform(distances, lambda x: round_to(x, digits))


def gradients(distances: Column, digits: int | None = None) -> Column:
    """`gradient` over an array of distances."""

    def slope(x: Column, i: Column) -> Column:
        prev, nxt = F.get(distances, i - 1), F.get(distances, i + 1)
        found = F.when(prev.isNull(), nxt - x).when(nxt.isNull(), x - prev).otherwise((nxt - prev) / 2)
        return F.when(x.isNotNull(), _rounded(found, None if digits is None else digits + 1))

    return F.transform(distances, slope)


def place(i: Column) -> tuple[Column, Column]:
    """`idx` and input row of the unit at position `i` of `measured_documents`."""
    at = F.get("_at", i)
    return F.coalesce(at["idx"], i), F.get("_rows", F.coalesce(at["row"], F.lit(0)))


def measured_documents(
    docs: DataFrame, breakpoints: Breakpoints, buffer_size: int, split_regex: str, max_words: int, embedder
) -> DataFrame:
    """One row per title: `_rows` (what its input rows carry, and their `n_units`), `_sentences`, `_at` (`idx` and input row
    of every unit, null for a title of one row), and `_measured` with the arrays `distance`, `metric`, `is_break` and the `threshold`.

    The exchange has as many parts as `spark.sql.shuffle.partitions`: narrowed by bytes there would be few more than
    cores, and the work on a part is many times that of reading it.
    """
    carried = [c for c in docs.columns if c not in ("title", "text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    titles = docs.repartition(parts, "title").groupBy("title").agg(F.collect_list(F.struct(*carried, "text")).alias("_rows"))
    none = F.array().cast("array<string>")
    cut = F.transform(
        "_rows",
        lambda r: F.struct(
            *[r[c].alias(c) for c in carried], F.coalesce(unit_array(r["text"], split_regex, max_words), none).alias("_units")
        ),
    )
    titles = titles.select("title", cut.alias("_cut"))
    rows = F.transform("_cut", lambda r: F.struct(*[r[c].alias(c) for c in carried], F.size(r["_units"]).alias("n_units")))
    units = F.flatten(
        F.transform(
            "_cut",
            lambda r, i: F.transform(r["_units"], lambda u, k: F.struct(k.alias("idx"), u.alias("sentence"), i.alias("row"))),
        )
    )
    met = F.when(F.size("_cut") > 1, F.array_sort(units))  # null for a title of one row, whose units are in order
    titles = titles.select("title", rows.alias("_rows"), F.get("_cut", F.lit(0))["_units"].alias("_own"), met.alias("_met"))
    titles = titles.select(
        "title",
        "_rows",
        F.transform("_met", lambda u: F.struct(u["idx"].alias("idx"), u["row"].alias("row"))).alias("_at"),
        F.coalesce(F.transform("_met", lambda u: u["sentence"]), "_own").alias("_sentences"),
    )
    heard = F.transform("_sentences", lambda s, i: F.when(place(i)[1]["n_units"] > breakpoints.bypass_units, s))
    all_heard = F.col("_at").isNull() & (F.size("_sentences") > breakpoints.bypass_units)
    heard = F.when(all_heard, F.col("_sentences")).otherwise(heard)
    titles = titles.withColumn("_distances", embedder.distances(heard, buffer_size))

    def facts(distances: Column, metrics: Column, threshold: Column) -> Column:
        def breaks(metric: Column, i: Column) -> Column:
            idx, row = place(i)
            apart = (row["n_units"] <= breakpoints.bypass_units) & (idx < row["n_units"] - 1)
            return F.coalesce(metric > threshold, apart)

        return F.struct(
            distances.alias("distance"), metrics.alias("metric"), threshold.alias("threshold"),
            F.transform(metrics, breaks).alias("is_break"),
        )

    measured = bound(
        rounded_distances(F.col("_distances"), breakpoints.digits),
        lambda d: bound(breakpoints.metrics(d), lambda m: bound(breakpoints.threshold_of(m), lambda t: facts(d, m, t))),
    )
    return titles.withColumn("_measured", measured).drop("_distances")


def measure_units(
    docs: DataFrame,
    breakpoints: Breakpoints,
    buffer_size: int = 1,
    split_regex: str = PARAGRAPH,
    max_words: int = MAX_WORDS,
    embedder=None,
) -> DataFrame:
    """Units with `distance`, `metric`, `threshold` and `is_break`."""
    embedder = embedder or HashEmbedder()
    if embedder.additive:
        titles = measured_documents(docs, breakpoints, buffer_size, split_regex, max_words, embedder)
        kept = [c for c in docs.columns if c not in ("title", "text")]

        def unit(sentence: Column, i: Column) -> Column:
            facts = [F.get(F.col("_measured")[c], i).alias(c) for c in ("distance", "metric", "is_break")]
            idx, row = place(i)
            return F.struct(row.alias("_row"), idx.alias("idx"), sentence.alias("sentence"), *facts)

        # the outer form keeps the optimizer from adding a filter that computes the whole array once more
        units = titles.select(
            "title", F.col("_measured")["threshold"].alias("threshold"), F.transform("_sentences", unit).alias("_units")
        ).select("title", "threshold", F.explode_outer("_units").alias("_unit"))
        return units.where(F.col("_unit").isNotNull()).select(
            *["title" if c == "title" else F.col(f"_unit._row.`{c}`") for c in docs.columns if c == "title" or c in kept],
            *[F.col(f"_unit.{c}") for c in ("_row.n_units", "idx", "sentence", "distance", "metric")],
            "threshold",
            F.col("_unit.is_break"),
        )
    units = split_units(docs.repartition("title"), split_regex, max_words)
    measured = F.col("n_units") > breakpoints.bypass_units
    units = window_vectors(units, embedder, buffer_size, ["title"], measured)
    units = neighbour_distances(units, ["title"], breakpoints.digits)
    metric = gradient(["title"], breakpoints.digits) if breakpoints.uses_gradient else F.col("distance")
    whole = Window.partitionBy("title")
    units = units.withColumn("metric", metric)
    if breakpoints.number_of_chunks is not None:
        ranked = Window.partitionBy("title").orderBy(F.desc_nulls_last("metric"))
        units = units.withColumns({"_n": F.count("metric").over(whole), "_nth": F.row_number().over(ranked)})
        chosen = F.when(F.col("_nth") == breakpoints.nth(F.col("_n")), F.col("metric"))
        units = units.withColumn("threshold", F.max(chosen).over(whole)).drop("_n", "_nth")
    else:
        units = units.withColumn("threshold", breakpoints.threshold(F.col("metric"), lambda c: c.over(whole)))
    return units.withColumn(
        "is_break", F.coalesce(F.col("metric") > F.col("threshold"), ~measured & (F.col("idx") < F.col("n_units") - 1))
    )


def join_units(numbered: DataFrame, carried: list[str]) -> DataFrame:
    """Group units by `(title, chunk_idx)` and join them with one space."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("idx", "sentence"))), lambda u: u["sentence"])
    return numbered.groupBy("title", "chunk_idx").agg(
        *[F.first(c).alias(c) for c in carried], F.array_join(in_order, " ").alias("chunk")
    )


def joined_chunks(titles: DataFrame, carried: list[str], by_metric: bool = False) -> DataFrame:
    """Chunks of `measured_documents`: the units up to each break, joined with one space.

    `by_metric` says that units of one `idx`, which only titles of several rows have, follow each other by falling metric.
    """
    if by_metric:
        met = F.transform(
            F.arrays_zip("_at", "_sentences", F.col("_measured")["metric"].alias("m"), F.col("_measured")["is_break"].alias("b")),
            lambda u: F.struct(u["_at"]["idx"].alias("idx"), u["m"].isNull().alias("none"), (-u["m"]).alias("m"), u.alias("u")),
        )
        met = F.when(F.col("_at").isNotNull(), F.transform(F.array_sort(met), lambda x: x["u"]))
        titles = titles.withColumn("_met", met).select(
            "title",
            "_rows",
            F.transform("_met", lambda u: u["_at"]).alias("_at"),
            F.coalesce(F.transform("_met", lambda u: u["_sentences"]), "_sentences").alias("_sentences"),
            F.struct(F.coalesce(F.transform("_met", lambda u: u["b"]), F.col("_measured")["is_break"]).alias("is_break")).alias("_measured"),
        )
    breaks = F.filter(F.transform(F.col("_measured")["is_break"], lambda b, i: F.when(b, i)), lambda i: i.isNotNull())

    def chunk(first: Column, last: Column, k: Column) -> Column:
        return F.struct(
            k.alias("chunk_idx"),
            place(first)[1].alias("_row"),
            F.array_join(F.slice("_sentences", first + 1, last - first + 1), " ").alias("chunk"),
        )

    def chunks(ends: Column) -> Column:
        return F.transform(ends, lambda e, k: bound(F.coalesce(F.get(ends, k - 1) + 1, F.lit(0)), lambda s: chunk(s, e, k)))

    ends = F.when(F.size("_sentences") > 0, F.concat(breaks, F.array(F.size("_sentences") - 1)))
    cut = titles.select("title", bound(ends, chunks).alias("_chunks")).select("title", F.explode_outer("_chunks").alias("_chunk"))
    return cut.where(F.col("_chunk").isNotNull()).select(
        "title", F.col("_chunk.chunk_idx"), *[F.col(f"_chunk._row.`{c}`") for c in carried], F.col("_chunk.chunk")
    )


def semantic_chunk(
    docs: DataFrame,
    buffer_size: int = 1,
    add_start_index: bool = False,
    breakpoint_threshold_type: str = "percentile",
    breakpoint_threshold_amount: float | None = None,
    number_of_chunks: int | None = None,
    sentence_split_regex: str = PARAGRAPH,
    embedder=None,
    max_words: int = MAX_WORDS,
    digits: int | None = None,
) -> DataFrame:
    """Documents `(title, text, ...)` to chunks `(title, chunk_idx, ..., chunk[, start_index])`.

    Titles must be unique. `digits` rounds what is compared, see `COMPARED_DIGITS`. All other columns of a document are copied to its chunks.
    Use as `docs.transform(semantic_chunk, ...)`.
    """
    breakpoints = Breakpoints(breakpoint_threshold_type, breakpoint_threshold_amount, number_of_chunks, digits)
    carried = [c for c in docs.columns if c not in ("title", "text")]
    embedder = embedder or HashEmbedder()
    if embedder.additive:
        titles = measured_documents(docs, breakpoints, buffer_size, sentence_split_regex, max_words, embedder)
        chunks = joined_chunks(titles, carried, number_of_chunks is not None)
        return with_start_index(chunks) if add_start_index else chunks
    units = measure_units(docs, breakpoints, buffer_size, sentence_split_regex, max_words, embedder)
    numbered = running_total_in_row_groups(units, ["title"], "idx", F.col("is_break"), "chunk_idx")
    chunks = join_units(numbered.withColumn("chunk_idx", F.col("chunk_idx").cast("int")), carried)
    return with_start_index(chunks) if add_start_index else chunks


def with_start_index(chunks: DataFrame) -> DataFrame:
    """Add `start_index`: the summed length of the document's earlier chunks, separators not counted."""
    return running_total_in_row_groups(chunks, ["title"], "chunk_idx", F.length("chunk"), "start_index")


def drop_blank_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(is_not_blank(F.col("chunk")))
