"""SimHash near-duplicate detection with pivot distance tables.

Fingerprints collapse to distinct ones by an aggregation. Two that differ in at most BITS of 64 bits agree on all bits of
b - BITS of any b parts of the bits, so each goes to one bucket for every choice of b - BITS parts; b grows with the
number of fingerprints. (Pivots alone bound no bucket: two unrelated fingerprints lie within BITS of each other at most
single coordinates.) In a bucket every fingerprint has its row of the pivot table, its distances to PIVOTS reference
fingerprints; by the triangle inequality a pair whose rows differ by more than BITS at any coordinate is discarded, and survivors are verified bit by bit.

What a bucket gives stays linear in its rows: a link from each fingerprint to the least of its component within the bucket. Small
buckets compare all pairs, larger ones go from fingerprint to fingerprint and drop what has been reached, so that a group of near
copies is left after a few steps. Buckets above HOT fingerprints never meet in one task: their fingerprints are
sent to every value within BITS / 2 bits, where two that are within BITS of each other meet, at most some 2,000 a value.

Defined cases: null text counts as empty; a text without words has fingerprint 0 and is linked like any other; with fewer words
than a shingle the whole sequence is one shingle; rows repeated under one doc_id are each placed by their own text; a null
doc_id is placed by its text, and a component of such rows alone has a null id; an empty table gives no rows; texts of any length are
hashed whole, a piece of shingles at a time; columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .graph import components
from .kernels import chunks, joined, lower, word_spans
from .runtime import materialize

WORDS, SEED, BITS, PIVOTS = 4, 42, 4, 16
#: Fingerprints of a bucket on average, at most; b parts are taken so that it holds.
FULL = 512
#: Fingerprints of a bucket that are compared pair by pair, and those that one task compares at all.
SMALL, HOT = 256, 1 << 18
_PIECE = 1 << 16
U64 = np.uint64


def text_fingerprints(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    """The fingerprint of each text: a bit is 1 if it is set in over half of the shingles' XXH64."""
    data, first, _ = joined(texts)
    begin, end = word_spans(data)
    owner = np.searchsorted(first, begin, "right") - 1
    counts = np.bincount(owner, minlength=len(first))
    # the words of all texts, lower-cased, with one space after each
    kept = np.zeros(len(data) + 1, np.int8)
    np.add.at(kept, begin, 1)
    np.add.at(kept, end, -1)
    kept = np.cumsum(kept[:-1], dtype=np.int8).astype(bool)
    data = np.where(kept, lower(data), np.uint8(32))
    kept[end] = True
    said = data[kept].tobytes()
    stop = np.cumsum(end - begin + 1) - 1
    start = stop - (end - begin)
    # shingle k of a text: its words k to k + words - 1, or all it has
    n = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    of = np.repeat(np.arange(len(first)), n)
    lead = np.concatenate(([0], np.cumsum(counts)))[:-1]
    at = lead[of] + np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
    till = np.minimum(at + words, (lead + counts)[of]) - 1
    ones = np.zeros((len(first), 64), np.int64)
    for k in range(0, len(of), _PIECE):
        piece = slice(k, k + _PIECE)
        h = np.array([xxhash.xxh64_intdigest(said[a:b], SEED) for a, b in zip(start[at[piece]].tolist(), stop[till[piece]].tolist(), strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        run = np.flatnonzero(np.diff(of[piece], prepend=-1))
        ones[of[piece][run]] += np.add.reduceat(bits, run, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([t["doc_id"], pa.array(text_fingerprints(t["text"], words).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """(PIVOTS, n) Hamming distances to the reference fingerprints, which are fixed random numbers."""
    references = np.random.default_rng(1).integers(0, 1 << 64, PIVOTS, np.uint64)
    return np.bitwise_count(fp[None, :] ^ references[:, None]).astype(np.int8)


def survivors(table: np.ndarray, fp: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of (i, j) within `bits`: coordinate after coordinate discards, the rest is verified."""
    for row in table:
        near = np.abs(row[i] - row[j]) <= bits
        i, j = i[near], j[near]
    near = np.bitwise_count(fp[i] ^ fp[j]) <= bits
    return i[near], j[near]


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n items the least item of its component under the pairs (i, j)."""
    at = np.arange(n)
    while True:
        low = np.minimum(at[i], at[j])
        new = at.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, at[i], low)
        np.minimum.at(new, at[j], low)
        new = new[new]
        if (new == at).all():
            return at
        at = new


def pairwise(key: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
    """Least items of components within buckets (runs of equal key); pairs at each distance in the run at once."""
    table, left, right = pivot_table(fp), [], []
    i, step = np.arange(len(fp)), 1
    while len(i := i[i + step < len(fp)]) and len(i := i[key[i] == key[i + step]]):
        a, b = survivors(table, fp, i, i + step, bits)
        left.append(a)
        right.append(b)
        step += 1
    return _least(len(fp), np.concatenate(left), np.concatenate(right)) if left else np.arange(len(fp))


def reached(fp: np.ndarray, bits: int) -> np.ndarray:
    """Least items of components of one bucket: from item to item, over those not reached yet, which are kept in order of the first pivot's distance."""
    table = pivot_table(fp)
    order = np.argsort(table[0], kind="stable")
    left, out = order, np.full(len(fp), -1)
    for start in range(len(fp)):
        if out[start] >= 0:
            continue
        out[start] = start
        left = left[out[left] < 0]
        todo = [start]
        while todo and len(left):
            x = todo.pop()
            lo, hi = np.searchsorted(table[0][left], (table[0][x] - bits, table[0][x] + bits + 1))
            near = left[lo:hi]
            for row in table[1:]:
                near = near[np.abs(row[near] - row[x]) <= bits]
            near = near[np.bitwise_count(fp[near] ^ fp[x]) <= bits]
            if len(near):
                out[near] = start
                todo += near.tolist()
                left = left[out[left] < 0]
    return out


def choices(n: int, bits: int = BITS, full: int = FULL) -> list[int]:
    """Masks of the bits that a bucket's fingerprints agree on: the fewest parts that leave at most `full` of n fingerprints a bucket."""
    for b in range(bits + 1, 2 * bits + 2):
        if b > 2 * bits or n <= full << (64 * (b - bits) // b):
            break
    edge = [64 * k // b for k in range(b + 1)]
    parts = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(b)]
    return [sum(c) for c in combinations(parts, b - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _by_buckets(rows: DataFrame, bits: int) -> DataFrame:
    """rows: (choice, key, fp) of buckets with at most HOT of them. Links (u, v) that connect what is connected within a bucket."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(edge)
        least, small = np.arange(len(fp)), np.repeat(size <= SMALL, size)
        at = np.flatnonzero(small)
        least[at] = at[pairwise(key[at], fp[at], bits)]
        for a, b in zip(edge[:-1][size > SMALL], edge[1:][size > SMALL], strict=True):
            least[a:b] = a + reached(fp[a:b], bits)
        found = least != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[found].view(np.int64)), pa.array(fp[least[found]].view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, last = np.zeros(0, U64), np.zeros(0, U64), None
        for t in batches:
            choice, bits_ = np.asarray(t["choice"]).astype(np.int64), np.asarray(t["key"])
            new = np.concatenate(([last is None or last != (choice[0], bits_[0])], (choice[1:] != choice[:-1]) | (bits_[1:] != bits_[:-1]))) if len(bits_) else np.zeros(0, bool)
            last = (choice[-1], bits_[-1]) if len(bits_) else last
            # buckets are numbered as they come; the one that is open stays for the next batch
            key = np.concatenate((key, (key[-1] if len(key) else U64(0)) + np.cumsum(new).astype(U64)))
            fp = np.concatenate((fp, np.asarray(t["fp"]).view(U64)))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield links(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield links(key, fp)

    return rows.repartition("choice", "key").sortWithinPartitions("choice", "key", "fp").select("choice", "key", "fp").mapInArrow(run, "u long, v long")


def _by_values(fps: DataFrame, bits: int) -> DataFrame:
    """Links (u, v) of fingerprints that meet at a value within bits / 2 of each; exact, whatever buckets they share."""
    masks = [0, *(_signed(sum(1 << k for k in c)) for n in range(1, bits // 2 + 1) for c in combinations(range(64), n))]
    met = fps.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"))
    least = F.min("fp").over(W.partitionBy("value"))
    return met.select(F.col("fp").alias("u"), least.alias("v")).where("u <> v").distinct()


def linked(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """fps: distinct fp. Links (u, v) whose components are those of all pairs within `bits`."""
    buckets = F.array(*(F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(choices(fps.count(), bits))))
    rows = fps.select("fp", F.explode(buckets).alias("b")).select("fp", "b.choice", "b.key")
    size = rows.groupBy("choice", "key").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(rows.join(size, ["choice", "key"]), "buckets")
    links = _by_buckets(shared.where(F.col("size") <= HOT).drop("size"), bits)
    if not shared.where(F.col("size") > HOT).isEmpty():
        links = links.unionByName(_by_values(shared.where(F.col("size") > HOT).select("fp").distinct(), bits))
    return materialize(links.distinct(), "links")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id (smallest linked doc_id). docs needs doc_id and text."""
    own = materialize(fingerprints(docs, words), "fingerprints")
    classes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    part = materialize(components(linked(classes.select("fp"), bits)), "parts").withColumnRenamed("id", "fp")
    placed = classes.join(part, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "component").join(least, "component").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
