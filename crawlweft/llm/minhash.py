"""MinHash near-duplicate detection with HyperMinHash sketches.

A sketch has REGISTERS buckets; each keeps, of the smallest hash that falls into it, the leading-zero count and
MANTISSA bits after the leading one; an empty bucket takes the register of another that a hash of its number picks. Bands of compressed registers give candidates, the collision-corrected estimate
thins them, and full shingle sets confirm every link.

How a group stays linear: equal shingle sets collapse to one representative by an aggregation; in each band bucket the
representative that shares most buckets (the hub) is paired with the others (a star, never all pairs). Of what stars
leave apart, a pair x, y of one bucket with hub h has at most min(|x & h|, |y & h|) shingles of h in common, and the
others only among those outside h. So the pairs left to verify, exactly, are those that this bound alone allows and
those that share a shingle outside h; both across components only.

Defined cases: null text counts as empty; an empty set (no words) is linked with nothing; a text with fewer words than
a shingle has its whole sequence as one shingle; rows repeated under one doc_id are each placed by their own text (tables
with such rows are worked on by row, then given the smallest doc_id of each component); a null doc_id is its own component
(null) and is kept by near_duplicates(), while one_of_each() places its text like any other; columns beside doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .graph import components
from .kernels import U64, chunks, mix, shingles
from .runtime import drop_tables, materialize

REGISTERS, MANTISSA, BAND = 512, 10, 8
#: A pair is dropped before verification only if its estimate is so many standard deviations of the sketch below the threshold.
DEVIATIONS = 6


def registers(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, REGISTERS) uint16: (leading zeros + 1) << MANTISSA | mantissa, 0 where a bucket is empty."""
    low = np.full(n * REGISTERS, ~U64(0), U64)
    np.minimum.at(low, owner * REGISTERS + (hashes & U64(REGISTERS - 1)).astype(np.int64), hashes >> U64(12))
    empty = low == ~U64(0)
    exponent = np.frexp(low.astype(np.float64))[1].astype(np.int64)  # bit length of a 52-bit number
    shift = exponent - 1 - MANTISSA
    mantissa = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(U64), low << np.maximum(-shift, 0).astype(U64)) & U64((1 << MANTISSA) - 1)
    out = ((53 - exponent) << MANTISSA) | mantissa.astype(np.int64)
    out[empty] = 0
    out = out.astype(np.uint16).reshape(n, REGISTERS)
    # densify: empty buckets borrow from the first filled one in a fixed random sequence, at last from the next filled one
    row, col = np.nonzero((out == 0) & out.any(axis=1)[:, None])
    dense = out.copy()
    for t in range(1, 17):
        if not len(row):
            break
        from_ = (mix(col.astype(U64) * U64(64) + U64(t)) % U64(REGISTERS)).astype(np.int64)
        got = out[row, from_]
        dense[row, col] = got
        row, col = row[got == 0], col[got == 0]
    for r in np.unique(row).tolist():
        filled = np.flatnonzero(out[r])
        mine = col[row == r]
        dense[r, mine] = out[r, filled[np.searchsorted(filled, mine) % len(filled)]]
    return dense


def band_hashes(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, bands) hashes of neighbouring registers, and which of them hold any register."""
    groups = sketch.reshape(len(sketch), -1, BAND).astype(U64)
    key = np.zeros(groups.shape[:2], U64)
    for j in range(BAND):
        key = key << U64(16) | groups[:, :, j]
    return mix(mix(key) + np.arange(groups.shape[1], dtype=U64) * U64(0x9E3779B97F4A7C15)), groups.any(axis=2)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketch rows, less the chance agreements of independent registers."""
    used = (a > 0) | (b > 0)
    equal = (a == b) & used
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    chance = 0.1699195 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    both = ((a > 0) & (b > 0)).sum(axis=1)
    return np.clip((equal.sum(axis=1) - chance * both) / np.maximum(used.sum(axis=1), 1), 0, 1)


def slack(n: np.ndarray, threshold: float) -> np.ndarray:
    """How far an estimate may lie below the threshold; a set of n shingles fills that many registers of its own, the others are borrowed."""
    own = REGISTERS * -np.expm1(-n / REGISTERS)
    return DEVIATIONS * np.sqrt(threshold * (1 - threshold) / np.maximum(own, 1))


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """One row per document: n_shingles, a 128-bit digest of the set (s1, s2), the sketch and its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            h, owner, _ = shingles(batch["text"], words)
            size = np.bincount(owner, minlength=batch.num_rows)
            edge = np.concatenate(([0], np.cumsum(size)))
            digest = [np.concatenate((np.zeros(1, U64), np.cumsum(x, dtype=U64))) for x in (mix(h + U64(11)), mix(h ^ U64(0xA5A5A5A5A5A5A5A5)))]
            s1, s2 = ((x[edge[1:]] - x[edge[:-1]]).view(np.int64) for x in digest)
            reg = registers(h, owner, batch.num_rows)
            bands, held = band_hashes(reg)
            spans = np.concatenate(([0], np.cumsum(held.sum(axis=1)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(size), pa.array(s1), pa.array(s2), pa.array([r.tobytes() for r in reg], pa.binary()), pa.ListArray.from_arrays(spans, pa.array(bands[held].view(np.int64)))],
                ["doc_id", "n_shingles", "s1", "s2", "sketch", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, sketch binary, bands array<long>")


def _estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose estimate does not rule out the threshold."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"k_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(t[k].to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("k_a", "k_b"))
            n, m = (np.asarray(t[k]).astype(float) for k in ("n_a", "n_b"))
            keep = (estimate(a, b, n, m) >= threshold - slack(np.minimum(n, m), threshold)) & (np.minimum(n, m) >= threshold * np.maximum(n, m))
            yield t.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "k_a", "k_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in chunks(iter([batch]), "text_a"):
                sides = []
                for name in ("text_a", "text_b"):
                    h, o, _ = shingles(t[name], words)
                    sides.append((h, o))
                h, o = np.concatenate([x[0] for x in sides]), np.concatenate([x[1] for x in sides])
                order = np.lexsort((h, o))
                h, o = h[order], o[order]
                same = np.bincount(o[1:][(h[1:] == h[:-1]) & (o[1:] == o[:-1])], minlength=t.num_rows)
                union = np.bincount(o, minlength=t.num_rows) - same
                yield t.select(["a", "b"]).filter(pa.array((union > 0) & (100 * same >= percent * union)))

    side = lambda x: docs.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _against_hubs(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """For pairs (rep, hub): the set sizes, the intersection and the shingles of rep outside hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in chunks(iter([batch]), "text_rep"):
                h, o, _ = shingles(t["text_rep"], words)
                k, q, _ = shingles(t["text_hub"], words)
                every, owner = np.concatenate((h, k)), np.concatenate((o, q))
                mine = np.arange(len(every)) < len(h)
                order = np.lexsort((~mine, every, owner))
                e, w = every[order], owner[order]
                twin = np.concatenate(((e[1:] == e[:-1]) & (w[1:] == w[:-1]), [False])) if len(e) else np.zeros(0, bool)
                outside = mine[order] & ~twin
                both = np.bincount(w[twin], minlength=t.num_rows)
                size, other = (np.bincount(x, minlength=t.num_rows) for x in (o, q))
                edge = np.concatenate(([0], np.cumsum(np.bincount(w[outside], minlength=t.num_rows)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [t["rep"], t["hub"], pa.array(size), pa.array(other), pa.array(both), pa.ListArray.from_arrays(edge, pa.array(e[outside].view(np.int64)))],
                    ["rep", "hub", "n", "n_hub", "i", "outside"],
                )

    side = lambda x: docs.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("rep"), "rep").join(side("hub"), "hub").select("rep", "hub", "text_rep", "text_hub")
    return both.mapInArrow(run, "rep long, hub long, n long, n_hub long, i long, outside array<long>").dropDuplicates(["rep", "hub"])


def _across(open_: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """open_: (band, rep, hub, c) of buckets with several components. Pairs (a, b) of different components that may be linked."""
    measured = materialize(_against_hubs(open_.where("rep <> hub").select("rep", "hub").distinct(), docs, words), "measured")
    own = measured.select(F.col("hub").alias("rep"), "hub", F.col("n_hub").alias("n"), F.col("n_hub").alias("i")).distinct()
    info = measured.select("rep", "hub", "n", "i").unionByName(own)
    enough = lambda most, sizes: F.lit(100 + percent) * most >= F.lit(percent) * sizes
    # pairs that need no shingle outside the hub
    members = open_.join(info, ["rep", "hub"])
    least = members.groupBy("band").agg(F.min("n").alias("least"))
    able = members.join(least, "band").where(enough(F.col("i"), F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100)))).select("band", "rep", "c", "n", "i")
    able = materialize(able, "able")
    mixed = able.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band")
    able = able.join(mixed, "band")
    side = lambda d, x: d.select(*(c for c in d.columns if c not in ("rep", "c", "n", "i")), *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "c", "n", "i") if c in d.columns))
    first = side(able, "a").join(side(able, "b"), "band").where((F.col("rep_a") < F.col("rep_b")) & (F.col("c_a") != F.col("c_b")) & enough(F.least("i_a", "i_b"), F.col("n_a") + F.col("n_b")))
    # pairs that share a shingle outside the hub: prefix filter, rarest first. A partner needs percent of n in common, at
    # most i of it in the hub, so one of the first (outside - needed + 1) shingles is shared, and enough follow the first
    place = open_.select("rep", "c").distinct()
    outside = materialize(measured.select("rep", "hub", "n", "i", F.explode("outside").alias("t")).join(place, "rep"), "outside")
    spread = outside.groupBy("hub", "t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("f")).where("lo <> hi").select("hub", "t", "f")
    own = Window.partitionBy("hub", "rep")
    ranked = outside.join(spread, ["hub", "t"]).withColumn("left", F.count("*").over(own) - F.row_number().over(own.orderBy("f", "t")))
    prefix = materialize(ranked.where(F.col("left") + 1 >= F.ceil(F.col("n") * percent / 100) - F.col("i")).drop("f"), "prefix")
    ends = lambda x: prefix.select("hub", "t", *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "c", "n", "i", "left")))
    second = ends("a").join(ends("b"), ["hub", "t"]).where((F.col("rep_a") < F.col("rep_b")) & (F.col("c_a") != F.col("c_b")) & enough(F.least("i_a", "i_b") + F.least("left_a", "left_b") + 1, F.col("n_a") + F.col("n_b")))
    both = first.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).unionByName(second.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    return both.distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id), kept. docs needs doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _placed(docs, words, percent)
    rows = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = materialize(_placed(rows.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text"), words, percent).withColumnRenamed("doc_id", "row"), "placed")
    ids = rows.select("row", "doc_id")
    least = found.join(ids, "row").groupBy("component_id").agg(F.min("doc_id").alias("least"))
    named = found.join(least, "component_id").join(ids, "row").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    nameless = _placed(rows.where("doc_id is null").select("doc_id", "text"), words, percent).drop("kept")
    return named.unionByName(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, any columns, of which each component keeps one: of the smallest doc_id; nulls last, then by a hash of the row."""
    doc_id = F.col("doc_id").cast("long")
    if docs.groupBy(doc_id.alias("id")).count().where("id is null or count > 1").isEmpty():
        kept = near_duplicates(docs, words, percent).where("kept").select(F.col("doc_id").alias("_kept"))
        return docs.join(kept, docs["doc_id"].cast("long") == kept["_kept"], "left_semi")
    rows = materialize(docs.select(F.struct(*docs.columns).alias("of"), F.monotonically_increasing_id().alias("row")), "rows")
    found = _placed(rows.select(F.col("row").alias("doc_id"), "of.text"), words, percent).select(F.col("doc_id").alias("row"), "component_id")
    plain = [F.col("of")[f.name] for f in docs.schema.fields if not f.dataType.simpleString().startswith(("map", "variant"))]
    order = F.struct(F.col("of.doc_id").isNull(), F.col("of.doc_id").cast("long"), F.xxhash64(*plain), F.col("row"))
    first = rows.select("row", order.alias("order")).join(found, "row").groupBy("component_id").agg(F.min_by("row", "order").alias("row")).select("row")
    return rows.join(first, "row", "left_semi").select(*(F.col("of")[c].alias(c) for c in docs.columns))


def _placed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """near_duplicates() of (doc_id long, text) where rows of one doc_id are of one text."""
    sig = materialize(sketch(docs, words), "sketches")
    sets = sig.where("n_shingles > 0 and doc_id is not null")
    # an exact class keeps its smallest id; the bands and the sketch are the same for all its members
    classes = materialize(sets.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    of = sets.select("doc_id", "s1", "s2", "n_shingles", "sketch", "bands")
    keyed = of.join(classes.select("s1", "s2", "n_shingles", F.col("rep")), ["s1", "s2", "n_shingles"])
    reps = keyed.where("doc_id = rep").select("rep", "n_shingles", "sketch", "bands").dropDuplicates(["rep"])
    reps = materialize(reps, "representatives")
    full, sig = sig, materialize(sig.select("doc_id", "s1", "s2", "n_shingles"), "keys")
    sets = sig.where("n_shingles > 0 and doc_id is not null")
    drop_tables(full)
    banded = reps.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    banded = materialize(banded.join(shared, "band"), "bands")
    # the hub of a bucket is the member that meets most others over all its buckets
    reach = banded.groupBy("rep").agg(F.sum("size").alias("reach"))
    members = materialize(banded.join(reach, "rep").select("band", "rep", "reach"), "members")
    hubs = materialize(members.groupBy("band").agg(F.max_by("rep", F.struct("reach", -F.col("rep"))).alias("hub")), "hubs")
    members = materialize(members.join(hubs, "band").select("band", "rep", "hub"), "members")
    stars = members.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    threshold = percent / 100
    links = materialize(_verified(_estimated(stars, reps, threshold), docs, words, percent).distinct(), "links")
    part = materialize(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "parts")
    placed = members.join(part.withColumnRenamed("id", "rep"), "rep", "left").select("band", "rep", "hub", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band")
    open_ = materialize(placed.join(mixed, "band"), "open")
    if not open_.isEmpty():
        more = _verified(_estimated(_across(open_, docs, words, percent), reps, threshold), docs, words, percent)
        links = materialize(links.unionByName(more).distinct(), "links")
        part = materialize(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "parts")
    # a component's id is the smallest representative, and a representative is the smallest id of its class
    linked = classes.join(part.withColumnRenamed("id", "rep"), "rep", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    found = sets.select("doc_id", "n_shingles", "s1", "s2").join(linked, ["s1", "s2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = sig.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
