"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared in a normal form: lower-case ASCII letters, no white space and no ASCII punctuation. An item of m
normalised bytes may occur in a document with at most k = ceil(m * ERRORS) edits. By the q-gram lemma such an occurrence
shares at least m + 1 - q - k * q of its q-grams with the item, on diagonals that differ by at most k. Hits of a
document's q-grams in the index of all items are therefore counted in overlapping bands of diagonals, each 2 * k + 1
wide or more and each diagonal in two bands; bands at the bound are verified by an alignment restricted to the band.
q is chosen for each item as the largest of SIZES that leaves a bound of at least MINIMUM hits. Shorter items (normal form
below LEAST bytes) are searched too, without edits and from word to word, by hashes of as many words as they have.
Longer ones than twice LONG are searched by their pieces of LONG bytes or a little more, each with its own budget: by the pigeonhole
principle one of them is within it wherever the whole is. Where a piece is found, the whole item is aligned around it, within the
whole's budget; a piece alone is no occurrence.

An index covers items of at most INDEX bytes. A larger benchmark has several, built one after the other in each task
against HELD bytes of documents at a time, so the corpus is read once and a task's memory does not grow with the benchmark.

Defined cases: null or empty texts and items match nothing; equal items each give rows; a document that holds an item
twice gives one row with the best occurrence; repeated documents give a row each, also without a doc_id; items and texts
may be of any length; columns beside doc_id, text and item_id, text are not read (clean() passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window as W, functions as F

from .kernels import U64, chunks, mix, span_hashes, word_spans, words_at
from .runtime import drop_tables, materialize

ERRORS, SIZES, MINIMUM, LEAST, INDEX = 0.1, (8, 6, 4), 8, 40, 4 << 20
#: Text held for one index after the other, where there are several; q-gram hits gathered before they are counted.
HELD, HITS = 32 << 20, 1 << 21
LONG = 1 << 10
_DROP = bytes(b for b in range(128) if not chr(b).isalnum())
_MARKS = bytes(b for b in _DROP if b != 32 and not 9 <= b <= 13)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def normal(text: bytes | None) -> bytes:
    return (text or b"").translate(_LOWER, _DROP)


def words(text: bytes | None) -> bytes:
    """The normal form with a space between words."""
    return b" ".join((text or b"").translate(_LOWER, _MARKS).split())


def budget(m: int) -> int:
    return int(np.ceil(m * ERRORS))


def gram_size(m: int) -> int | None:
    """The largest q whose lemma bound is at least MINIMUM."""
    return next((q for q in SIZES if m >= LEAST and m + 1 - q - budget(m) * q >= MINIMUM), None)


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes at each position as one number; data must be padded by eight bytes."""
    return words_at(data)[: len(data) - 8 - q + 1] & U64((1 << 8 * q) - 1)


def aligned(item: np.ndarray, text: np.ndarray, band: int, k: int) -> tuple[int, int, int] | None:
    """The best occurrence of item in text (end gaps of text are free) within `band` diagonals: (edits, start, end), or None above k.

    Row by row over the item; position j of row i stands for text index i + j.
    """
    m, width = len(item), band
    big = m + len(text) + 1
    j = np.arange(width)
    cost, start = np.where(j <= len(text), 0, big), j.copy()
    for i in range(m):
        at = i + j
        inside = at < len(text)
        step = np.where(inside, (text[np.minimum(at, len(text) - 1)] != item[i]).astype(np.int64), big)
        through, origin = cost + step, start
        up, up_start = np.append(cost[1:] + 1, big), np.append(start[1:], 0)
        better = up < through
        new, begin = np.where(better, up, through), np.where(better, up_start, origin)
        # gaps in the item: a running minimum along the row
        slid = np.minimum.accumulate(new - j)
        source = np.maximum.accumulate(np.where(new - j == slid, j, 0))
        cost, start = slid + j, begin[source]
        if cost.min() > k:
            return None
    cost = np.where(m + j <= len(text), cost, big)
    best = int(np.argmin(cost))
    return (int(cost[best]), int(start[best]), m + best) if cost[best] <= k else None


def furthest(item: np.ndarray, text: np.ndarray, span: int, k: int) -> tuple[int, int, int] | None:
    """aligned() for long items, by edits instead of rows: for each diagonal how far the item can be read with so many edits.

    Text indices are item indices plus 0 to span - 1 diagonals. A near copy takes as many rounds as it has edits.
    """
    m, n = len(item), len(text)
    # eight bytes at a time; what pads the ends equals nothing in a normal form
    left, right = words_at(np.append(item, np.zeros(16, np.uint8))), words_at(np.append(text, np.full(span + m + 16, 255, np.uint8)))
    d = np.arange(span)
    most = np.minimum(m, n - d)

    def slid(at: np.ndarray) -> np.ndarray:
        go = np.flatnonzero((at >= 0) & (at < most))
        while len(go):
            apart = left[at[go]] ^ right[at[go] + d[go]]
            step = np.where(apart == 0, 8, np.bitwise_count((apart & (~apart + U64(1))) - U64(1)).astype(np.int64) // 8)
            at[go] = np.minimum(at[go] + step, most[go])
            go = go[(step == 8) & (at[go] < most[go])]
        return at

    at, start = slid(np.where(most >= 0, 0, -1)), d.copy()
    for edits in range(k + 1):
        if (at >= m).any():
            best = int(np.argmax(at >= m))
            return edits, int(start[best]), m + best
        # a byte of both, of the item, or of the text is passed over
        ways = np.stack((at + 1, np.append(at[1:] + 1, -1), np.append(-1, at[:-1])))
        ways[0][at < 0] = -1
        which = np.argmax(ways, axis=0)
        start = np.stack((start, np.append(start[1:], 0), np.append(0, start[:-1])))[which, d]
        at = slid(np.where(most >= 0, np.minimum(ways[which, d], most), -1))
    return None


def _runs(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of all runs of n words in data, which ends in a space."""
    first, end = word_spans(data)
    h = span_hashes(data, first, end)
    size = max(len(h) - n + 1, 0)
    acc = np.zeros(size, U64)
    for j in range(n if size else 0):
        acc = acc * U64(0x9E3779B97F4A7C15) + h[j : size + j]
    return mix(acc + U64(n)), first[:size], end[n - 1 :][:size]


class Index:
    """All q-grams of a set of items: for each q a sorted array, a bitmap for a first look, and where each occurs; short items by word counts."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.items, self.whole, self.offset = [], [], []  # (item_id, piece), which of the given items it is of, and where
        given = [(i, t, n) for i, t in items if (n := normal(t))]
        self.ids, self.texts = [i for i, _, _ in given], [np.frombuffer(n, np.uint8) for _, _, n in given]
        for k, (i, _, n) in enumerate(given):
            cuts = [*range(0, len(n) - LONG + 1, LONG), len(n)] if len(n) >= 2 * LONG else [0, len(n)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                self.items.append((i, np.frombuffer(n[a:b], np.uint8)))
                self.whole.append(k)
                self.offset.append(a)
        self.sizes = np.array([len(n) for _, n in self.items], np.int64)
        self.budgets = np.array([budget(int(m)) for m in self.sizes], np.int64)
        self.tables, self.short = {}, {}
        size = [gram_size(int(m)) for m in self.sizes]
        for k, of in enumerate(self.whole):
            if size[k] is None:
                text = words(given[of][1])
                data = np.frombuffer(text + b" ", np.uint8)
                n = text.count(b" ") + 1
                self.short.setdefault(n, {}).setdefault(int(_runs(data, n)[0][0]), []).append((k, text))
        for q in SIZES:
            of = [k for k, s in enumerate(size) if s == q]
            if of:
                value = np.concatenate([grams(np.append(self.items[k][1], np.zeros(8, np.uint8)), q) for k in of])
                owner = np.concatenate([np.full(len(self.items[k][1]) - q + 1, k, np.int32) for k in of])
                place = np.concatenate([np.arange(len(self.items[k][1]) - q + 1, dtype=np.int32) for k in of])
                order = np.argsort(value, kind="stable")
                value, owner, place = value[order], owner[order], place[order]
                bits = max(16, int(np.ceil(np.log2(16 * len(value) + 1))))
                seen = np.zeros(1 << bits, bool)
                seen[self.slot(value, bits)] = True
                first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
                self.tables[q] = (bits, seen, value[first], np.append(first, len(value)), owner, place)

    @staticmethod
    def slot(value: np.ndarray, bits: int) -> np.ndarray:
        return (value * U64(0x9E3779B97F4A7C15) >> U64(64 - bits)).astype(np.int64)

    def _short_matches(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, int, int, int]]:
        if not self.short:
            return
        forms = [words(t) for t in texts]
        starts = np.concatenate(([0], np.cumsum([len(f) + 1 for f in forms])))
        whole = b" ".join([*forms, b""])
        data = np.frombuffer(whole, np.uint8)
        gaps = np.concatenate(([0], np.cumsum(data == 32)))
        for n, known in self.short.items():
            h, first, end = _runs(data, n)
            hit = np.flatnonzero(np.isin(h, np.fromiter(known, U64, len(known))))
            for x in hit.tolist():
                a, b = int(first[x]), int(end[x])
                t = int(np.searchsorted(starts, a, "right")) - 1
                if b < starts[t + 1]:
                    for k, text in known[int(h[x])]:
                        if whole[a:b] == text:
                            low = a - int(starts[t]) - int(gaps[a] - gaps[starts[t]])
                            yield t, self.whole[k], 0, low, low + len(self.items[k][1])

    def _whole_match(self, of: int, text: np.ndarray, at: int) -> tuple[int, int, int] | None:
        """The best occurrence of a whole item whose start lies within its budget of `at`, twice: (edits, start, end)."""
        item = self.texts[of]
        k = budget(len(item))
        # all diagonals that an occurrence may start on, and its budget on both sides
        a, b = at - 3 * k, min(len(text), at + len(item) + 4 * k)
        window = text[max(a, 0) : b]
        if len(window) < len(item) - k:
            return None
        # the lemma for the whole item: most of what holds a piece only ends here
        q = SIZES[0]
        mine, there = (np.unique(grams(np.append(x, np.zeros(8, np.uint8)), q), return_counts=True) for x in (item, window))
        _, i, j = np.intersect1d(mine[0], there[0], assume_unique=True, return_indices=True)
        if np.minimum(mine[1][i], there[1][j]).sum() < len(item) + 1 - q - k * q:
            return None
        before = max(-a, 0)
        got = furthest(item, np.append(np.zeros(before, np.uint8), window), 6 * k + 1, k)
        return got and (got[0], max(a + got[1], 0), a + got[2])

    def _bands(self, data: np.ndarray, q: int) -> set[tuple[int, int, int]]:
        """(item, first diagonal, span) of the bands at the lemma's bound."""
        bits, seen, values, edge, owner, place = self.tables[q]
        g = grams(data, q)
        at = np.flatnonzero(seen[self.slot(g, bits)])
        k = np.searchsorted(values, g[at])
        hit = values[np.minimum(k, len(values) - 1)] == g[at]
        at, k = at[hit], k[hit]
        n = edge[k + 1] - edge[k]
        width = 2 * self.budgets + 1
        need = self.sizes + 1 - q - self.budgets * q
        base = 2 * (len(data) // int(width.min()) + 4)
        # the place of a gram in its item counts once in a band: hits are reduced to that part by part
        part = np.cumsum(n) // HITS
        kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        for p in np.unique(part).tolist():
            some = part == p
            m = n[some]
            flat = np.repeat(edge[k[some]] - np.concatenate(([0], np.cumsum(m)))[:-1], m) + np.arange(m.sum())
            item, where = owner[flat].astype(np.int64), place[flat].astype(np.int64)
            diagonal = np.repeat(at[some], m) - where
            for shift in (0, 1):
                key = item * base + (diagonal + self.sizes[item] + shift * width[item]) // (2 * width[item])
                kept[shift].append(_distinct(key, where))
        found = set()
        for shift, parts in enumerate(kept):
            if parts:
                key, _ = _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True))) if len(parts) > 1 else parts[0]
                keys, count = np.unique(key, return_counts=True)
                for x in keys[count >= need[keys // base]].tolist():
                    i, b = divmod(x, base)
                    found.add((i, b * 2 * int(width[i]) - int(self.sizes[i]) - shift * int(width[i]), 2 * int(width[i])))
        return found

    def matches(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text index, index of the given item, edits, start, end in the normal form)."""
        yield from self._short_matches(texts)
        tried: dict[tuple[int, int], list[int]] = {}
        plain = [normal(t) for t in texts]
        starts = np.concatenate(([0], np.cumsum([len(p) + 1 for p in plain])))
        data = np.frombuffer(b"\n".join([*plain, b"\0" * 8]), np.uint8)
        for q in self.tables:
            for i, low, span in sorted(self._bands(data, q)):
                m, k = int(self.sizes[i]), int(self.budgets[i])
                middle = min(max(low + m // 2 + span // 2, 0), len(data) - 1)
                for t in sorted({min(int(np.searchsorted(starts, x, "right")) - 1, len(plain) - 1) for x in (max(low, 0), middle, max(low + span, 0), max(low + span + m - 1, 0))}):
                    # item bytes missing at the start of a document put its diagonals up to k below that start; the window
                    # has a zero for each byte before it, which no normal form holds: it costs as much as skipping an item byte
                    first = int(starts[t])
                    a, b = max(first, low) - k, min(first + len(plain[t]), low + span + m + k)
                    before = max(first - a, 0)
                    if b - a - before >= m - k:
                        # the band of the window that starts at a: all diagonals of the bucket and the budget on both sides
                        got = aligned(self.items[i][1], np.append(np.zeros(before, np.uint8), data[a + before : b]), span + 2 * k + 1, k)
                        of = self.whole[i]
                        if got and m == len(self.texts[of]):
                            yield t, of, got[0], max(a + got[1] - first, 0), a + got[2] - first
                        elif got:
                            # pieces of one occurrence point to starts within its budget: the whole is aligned once for them
                            at, seen = a + got[1] - first - self.offset[i], tried.setdefault((t, of), [])
                            if all(abs(at - x) > k for x in seen):
                                seen.append(at)
                                found = self._whole_match(of, np.frombuffer(plain[t], np.uint8), at)
                                if found:
                                    yield t, of, *found


def _distinct(key: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((where, key))
    key, where = key[order], where[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (where[1:] != where[:-1])))[: len(key)]
    return key[new], where[new]


def _item_sets(docs: DataFrame, benchmark: DataFrame) -> list[Broadcast]:
    """The items in sets of at most INDEX bytes (one larger item alone), each broadcast; the driver holds one set at a time."""
    items = benchmark.where("text is not null").select("item_id", F.col("text").cast("binary").alias("text"))
    total = F.sum(F.octet_length("text")).over(W.partitionBy("g").orderBy("item_id", "text"))
    # sums within 64 groups, so that no task sees all items
    sets = materialize(items.withColumn("g", F.pmod(F.xxhash64("item_id"), F.lit(64))).withColumn("s", F.floor(total / INDEX)), "items")
    bytes_ = sets.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    where = [F.lit(True)] if bytes_ <= INDEX else [(F.col("g") == r.g) & (F.col("s") == r.s) for r in sets.select("g", "s").distinct().orderBy("g", "s").collect()]
    out = [docs.sparkSession.sparkContext.broadcast([(r.item_id, bytes(r.text)) for r in sets.where(of).orderBy("item_id", "text").collect()]) for of in where]
    drop_tables(sets)
    return out


def _scanned(batches: Iterator[pa.RecordBatch], sets: list[Broadcast]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Batches with their hits (row, item_id, edits, item_chars, start, end), the best for each row and item."""

    def hits(index: Index, batch: pa.RecordBatch) -> list[tuple]:
        best: dict[tuple[int, int], tuple] = {}
        for t, i, e, a, b in index.matches(batch["text"].cast(pa.large_binary()).to_pylist()):
            key, found = (t, i), (e, a, b, index.ids[i], len(index.texts[i]))
            best[key] = min(best.get(key, found), found)
        return [(t, item, e, m, a, b) for (t, _), (e, a, b, item, m) in best.items()]

    if len(sets) == 1:
        index = Index(sets[0].value)
        for batch in chunks(batches, "text"):
            yield batch, sorted(hits(index, batch))
        return
    held, size = [], 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        found: list[list[tuple]] = [[] for _ in held]
        for of in sets:
            index = Index(of.value)
            for k, batch in enumerate(held):
                found[k] += hits(index, batch)
        yield from ((b, sorted(f)) for b, f in zip(held, found, strict=True))

    for batch in chunks(batches, "text"):
        held.append(batch)
        size += batch.nbytes
        if size >= HELD:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, item_chars, start, end) for every document that holds an item; offsets in the normal form."""
    sets = _item_sets(docs, benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, got in _scanned(batches, sets):
            ids = batch["doc_id"].to_pylist()
            rows = [(ids[t], *rest) for t, *rest in got]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(6)], ["doc_id", "item_id", "edits", "item_chars", "start", "end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, edits long, item_chars long, start long, end long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds an item; rows and columns otherwise as they are."""
    sets = _item_sets(docs, benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, got in _scanned(batches, sets):
            keep = np.ones(batch.num_rows, bool)
            keep[[t for t, *_ in got]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
