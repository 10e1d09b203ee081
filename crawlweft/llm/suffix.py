"""Exact removal of repeated substrings by a blockwise, depth-limited suffix array with a difference cover.

Every byte covered by a LENGTH-byte string that also starts earlier (smaller doc_id, or the same document, earlier) goes.
Only strings that can be repeated are sorted, in four passes:

1. counts: each window of LENGTH bytes belongs to the smallest hash of its GRAM-byte substrings (its anchor); windows in a
   row with one anchor are a segment. Segments are counted in cells of the anchor's hash; cells of very frequent anchors are hot.
2. segments: (anchor, content hash, place) go to buckets by anchor. Of equal contents the earliest stays, the others are
   repeats as a whole. Different contents with one anchor are candidates. Segments with hot anchors go to buckets by
   content and are thinned within each task first, so that a hot anchor fills no bucket.
3. candidates: the text of candidate segments goes to suffix buckets by anchor. A bucket's suffixes are sorted block by
   block: by their first COVER bytes, then long ties by ranks, computed before, of the suffixes at cover positions,
   comparing each with its group's pivot at the shift that puts both on the cover. Suffixes that differ within LENGTH
   bytes come in their order, so equal strings end up side by side; the earliest of each class stays. Hot candidates (an exact way
   for the rest) are compared by 128-bit fingerprints of each window, aggregated before the shuffle.
4. removal: marks are merged for each document and applied to its bytes.

Defined cases: null text is empty; no match crosses documents; rows repeated under one doc_id count as one document
(their texts one after the other, in order of their hash; identical rows are the same text); a null doc_id comes
last; an empty table gives no rows; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import U64, chunks, joined, mix, pack_planes, sliding_min, unpack_planes, words_at
from .runtime import drop_tables, materialize, shuffle_partitions, total_bytes

LENGTH, GRAM = 100, 24
WIDTH = LENGTH - GRAM + 1
COVER = 32
#: Text for each segment bucket, candidate text for each suffix bucket, suffixes sorted at once, segments sent at once.
SEGMENT_TEXT, SUFFIX_TEXT, BLOCK, FLUSH = 16 << 20, 2 << 20, 1 << 19, 1 << 18
PIECE = 1 << 23
_LAST = (1 << 63) - 1


def difference_cover(v: int) -> np.ndarray:
    """Residues whose differences are all residues modulo v, chosen greedily."""
    cover, missing = [0, 1], set(range(v)) - {0, 1, v - 1}
    while missing:
        gain = lambda c: len(missing & {d for x in cover for d in ((c - x) % v, (x - c) % v)})
        best = max((c for c in range(v) if c not in cover), key=gain)
        missing -= {d for x in cover for d in ((best - x) % v, (x - best) % v)}
        cover.append(best)
    return np.array(sorted(cover))


def shifts(v: int) -> np.ndarray:
    """[a, b]: the least shift that puts residues a and b both on the cover."""
    on = np.isin(np.arange(2 * v) % v, difference_cover(v))
    k = np.arange(v)
    both = on[k[:, None, None] + k] & on[k[None, :, None] + k]
    return both.argmax(axis=2)


_ON, _SHIFT = np.isin(np.arange(COVER), difference_cover(COVER)), shifts(COVER)


def segments(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of all texts in data: owner text, start in it, number of windows n, anchor, content hash, whether windows of it may be equal."""
    none = {k: np.zeros(0, np.int64) for k in ("owner", "start", "n", "at", "anchor", "content", "self")}
    if len(data) < LENGTH or not (lengths >= LENGTH).any():
        return none
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    w = words_at(padded)[: len(data)]
    g = w[: len(data) - GRAM + 1] * U64(0x9E3779B97F4A7C15)
    for k in range(8, GRAM, 8):
        g = (g ^ (g >> U64(29))) * U64(0xBF58476D1CE4E5B9) + w[k : len(data) - GRAM + 1 + k]
    g = mix(g)
    # 40 bits of hash, then the place within a piece: the same choice for equal windows wherever they stand
    place = np.empty(len(g) - WIDTH + 1, np.int64)
    for a in range(0, len(place), PIECE):
        of = g[a : a + PIECE + WIDTH - 1]
        low = sliding_min((of >> U64(24) << U64(24)) | np.arange(len(of), dtype=U64), WIDTH)
        place[a : a + PIECE] = a + (low & U64((1 << 24) - 1)).astype(np.int64)
    value = g[place]
    edge = np.zeros(len(place) + 1, np.int64)
    real = lengths >= LENGTH
    np.add.at(edge, starts[real], 1)
    np.add.at(edge, starts[real] + lengths[real] - LENGTH + 1, -1)
    valid = np.cumsum(edge)[:-1] > 0
    change = np.concatenate(([True], value[1:] != value[:-1])) | np.concatenate(([True], ~valid[:-1]))
    at = np.flatnonzero(valid & change)
    stop = np.flatnonzero(valid & np.concatenate((change[1:] | ~valid[1:], [True])))
    n = stop - at + 1
    s1 = np.concatenate((np.zeros(1, U64), np.cumsum(g, dtype=U64)))
    s2 = np.concatenate((np.zeros(1, U64), np.cumsum(g * np.arange(len(g), dtype=U64), dtype=U64)))
    e = at + n + WIDTH - 1
    a = s1[e] - s1[at]
    content = mix(a ^ mix(s2[e] - s2[at] - a * at.astype(U64)) ^ n.astype(U64))
    owner = np.searchsorted(starts, at, "right") - 1
    return {"owner": owner, "start": at - starts[owner], "n": n, "at": at, "anchor": value[at], "content": content, "self": place[at] != place[stop]}


def _cell(anchor: np.ndarray, cells: int) -> np.ndarray:
    return (mix(anchor) % U64(cells)).astype(np.int64)


def _refine(cls: np.ndarray, order: np.ndarray, key: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Splits classes of the suffixes at slots `part` of order by key; a class's number is the slot where it begins. Returns the slots still tied."""
    of = order[part]
    to = np.lexsort((key, cls[of]))
    c, k, new = cls[of][to], key[to], of[to]
    order[part] = new
    begin = np.concatenate(([True], (c[1:] != c[:-1]) | (k[1:] != k[:-1])))
    cls[new] = part[np.maximum.accumulate(np.where(begin, np.arange(len(part)), 0))]
    single = begin & np.concatenate((begin[1:], [True]))
    return part[~single]


_WORDS = (*range(0, LENGTH - 7, 8), LENGTH - 8)


def _ranks(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks by LENGTH bytes of the suffixes at cover positions `at`; -1 elsewhere."""
    big = words_at(text, ">")
    cls, order, part = np.zeros(len(at), np.int64), np.arange(len(at)), np.arange(len(at))
    for off in _WORDS:
        if not len(part):
            break
        part = _refine(cls, order, big[at[order[part]] + off].astype(U64), part)
    rank = np.full(len(text), -1, np.int32)
    rank[at] = cls
    return rank


def window_classes(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes of text at `at` by LENGTH bytes: (order, class of each), equal strings sharing a class.

    Every window lies in text, which is padded by LENGTH + COVER + 8 bytes.
    """
    big = words_at(text, ">")
    reach = np.zeros(len(text) + 1, np.int64)
    np.add.at(reach, at, 1)
    np.add.at(reach, at + COVER, -1)
    position = np.flatnonzero(np.cumsum(reach)[:-1] > 0)
    rank = _ranks(text, position[_ON[position % COVER]])
    head = big[at].astype(U64)
    # suffix buckets are ranges of the first eight bytes; one block of them is sorted at a time
    cut = np.unique(np.quantile(head, np.linspace(0, 1, len(at) // BLOCK + 2)[1:-1], method="nearest")) if len(at) > BLOCK else np.zeros(0, U64)
    block = np.searchsorted(cut, head, "right")
    orders, classes, base = [], np.zeros(len(at), np.int64), 0
    for b in range(len(cut) + 1):
        mine = np.flatnonzero(block == b)
        if not len(mine):
            continue
        pos = at[mine]
        cls, order, part = np.zeros(len(mine), np.int64), np.arange(len(mine)), np.arange(len(mine))
        for off in range(0, COVER, 8):
            if len(part):
                part = _refine(cls, order, big[pos[order[part]] + off].astype(U64), part)
        # long ties: a three-way split around each group's pivot by cover ranks, until all of a group equal its pivot
        tied = part
        while len(tied):
            of = order[tied]
            c = cls[of]
            begin = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            size = np.diff(np.append(begin, len(c)))
            pivot = pos[of[np.repeat(begin + size // 2, size)]]
            p = pos[of]
            shift = _SHIFT[p % COVER, pivot % COVER]
            sign = np.sign(rank[p + shift].astype(np.int64) - rank[pivot + shift])
            same = np.zeros(len(mine), bool)
            same[of[sign == 0]] = True
            left = _refine(cls, order, (sign + 1).astype(U64), tied)
            tied = left[~same[order[left]]]
        # neighbours that tied in the first bytes are compared over all of them
        new = np.ones(len(mine), bool)
        pair = part[np.concatenate(([False], part[1:] == part[:-1] + 1))]
        for off in _WORDS:
            pair = pair[big[pos[order[pair]] + off] == big[pos[order[pair - 1]] + off]]
        new[pair] = False
        orders.append(mine[order])
        classes[mine[order]] = base + np.maximum.accumulate(np.where(new, np.arange(len(mine)), 0))
        base += len(mine)
    return np.concatenate(orders), classes


def _earlier(text: np.ndarray, offset: np.ndarray, n: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments (text at offset, n windows, document, start): runs (document, start, windows) of windows that are not their string's earliest."""
    total = int(n.sum())
    seg = np.repeat(np.arange(len(n)), n)
    inner = np.arange(total) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
    d, p = doc[seg], start[seg] + inner
    order, cls = window_classes(text, offset[seg] + inner)
    to = np.lexsort((p, d, cls))
    c = cls[to]
    first = np.concatenate(([True], c[1:] != c[:-1]))
    lead = np.maximum.accumulate(np.where(first, np.arange(total), 0))
    repeat = np.zeros(total, bool)
    # the same place may come in two segments; it is no repeat of itself
    repeat[to] = (d[to] != d[to][lead]) | (p[to] != p[to][lead])
    return _runs(seg, d, p, repeat)


def _runs(seg: np.ndarray, d: np.ndarray, p: np.ndarray, repeat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.concatenate(([True], seg[1:] != seg[:-1]))
    begin = np.flatnonzero(repeat & (edge | ~np.concatenate(([False], repeat[:-1]))))
    stop = np.flatnonzero(repeat & (np.concatenate((edge[1:], [True])) | ~np.concatenate((repeat[1:], [False]))))
    return d[begin], p[begin], stop - begin + 1


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (doc_id, the largest long for null), base (0, or where this text begins among several of one doc_id), text, doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"))
    several = docs.groupBy("doc").count().where("count > 1").select("doc")
    if several.isEmpty():
        return docs.withColumn("base", F.lit(0).cast("long"))
    from pyspark.sql import Window as W

    hashed = docs.withColumn("h", F.coalesce(F.sha2("text", 256), F.lit("")))
    texts = hashed.join(several, "doc").select("doc", "h", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).distinct()
    base = texts.select("doc", "h", (F.sum("n").over(W.partitionBy("doc").orderBy("h")) - F.col("n")).alias("base"))
    return hashed.join(base, ["doc", "h"], "left").select("doc_id", "text", "doc", F.coalesce("base", F.lit(0)).alias("base"))


def _hot_cells(docs: DataFrame, cells: int, buckets: int) -> np.ndarray:
    """True for each cell with more than an eighth of a bucket's mean number of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in chunks(batches, "text"):
            total += np.bincount(_cell(segments(*joined(batch["text"]))["anchor"].view(U64), cells), minlength=cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    counts = materialize(docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    every = counts.agg(F.sum("n")).first()[0] or 0
    hot = np.zeros(cells, bool)
    # one bit for each cell, a fixed number for each bucket; of them at most 8 * buckets are hot
    hot[[r.cell for r in counts.where(F.col("n") > max(every // (8 * buckets), 64)).select("cell").toLocalIterator()]] = True
    drop_tables(counts)
    return hot


_FIELDS = (("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("n", "<i4"), ("own", "<u1"))


def _segment_rows(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, n, one blob for each field) rows, and decided repeats among them as bucket -1 - bucket."""
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def rows(bucket: np.ndarray, table: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        order = np.argsort(bucket, kind="stable")
        key, first = np.unique(bucket[order], return_index=True)
        edge = np.append(first, len(order))
        blobs = {f: [] for f, _ in _FIELDS}
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            for f, t in _FIELDS:
                v = table[f][order[a:b]].astype(t)
                blobs[f].append(v.tobytes() if f in ("content",) else pack_planes(v))
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(np.diff(edge)), *(pa.array(blobs[f], pa.binary()) for f, _ in _FIELDS)], ["bucket", "rows", *(f for f, _ in _FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, parts, size = len(held.value), [], 0
        first: dict[tuple[int, int], tuple[int, int, int, int]] = {}  # hot contents of this task: the earliest place so far

        def flush() -> Iterator[pa.RecordBatch]:
            if parts:
                table = {f: np.concatenate([p[f] for p in parts]) for f in parts[0]}
                yield rows(table.pop("bucket"), table)
                parts.clear()

        for batch in chunks(batches, "text"):
            s = segments(*joined(batch["text"]))
            if not len(s["n"]):
                continue
            doc, base = np.asarray(batch["doc"]), np.asarray(batch["base"])
            table = {"anchor": s["anchor"].view(U64), "content": s["content"].view(U64), "doc": doc[s["owner"]], "start": s["start"] + base[s["owner"]], "n": s["n"], "own": s["self"].astype(np.uint8)}
            warm = held.value[_cell(table["anchor"], cells)]
            table["own"] = table["own"] | (2 * warm).astype(np.uint8)
            bucket = (mix(np.where(warm, table["content"], table["anchor"])) % U64(buckets)).astype(np.int64)
            gone, again = np.zeros(len(warm), bool), []
            for i in np.flatnonzero(warm).tolist():
                key = (int(table["anchor"][i]), int(table["content"][i]))
                here = (int(table["doc"][i]), int(table["start"][i]), int(table["n"][i]), int(table["own"][i]))
                old = first.get(key)
                if old is None and len(first) < FLUSH:
                    first[key] = here
                    gone[i] = True
                elif old is not None:
                    gone[i] = True
                    first[key] = min(old, here)
                    if old[:2] != here[:2]:
                        again.append((*key, *max(old, here)))
            table["bucket"] = bucket
            parts.append({f: v[~gone] for f, v in table.items()})
            if again:
                a = list(zip(*again, strict=True))
                parts.append({f: np.array(v, t) for (f, t), v in zip(_FIELDS, a, strict=True)} | {"bucket": -1 - (mix(np.array(a[3], U64)) % U64(buckets)).astype(np.int64)})
            size += len(gone)
            if size >= FLUSH:
                size = 0
                yield from flush()
        if first:
            a = list(zip(*((*k, *v) for k, v in first.items()), strict=True))
            parts.append({f: np.array(v, t) for (f, t), v in zip(_FIELDS, a, strict=True)} | {"bucket": (mix(np.array(a[1], U64)) % U64(buckets)).astype(np.int64)})
        yield from flush()

    return docs.select("doc", "base", "text").mapInArrow(run, f"bucket int, rows long, {', '.join(f'{f} binary' for f, _ in _FIELDS)}")


def _decide(table: pa.Table) -> pa.Table:
    """Of a bucket's segments: kind 0 a repeat as a whole, 1 a candidate, 2 a hot candidate; the others are no rows."""
    col = {f: np.concatenate([np.frombuffer(b, t) if f == "content" else unpack_planes(b, t) for b in table[f].to_pylist()]) for f, t in _FIELDS}
    decided = np.repeat(np.asarray(table["bucket"]) < 0, np.asarray(table["rows"]))
    order = np.lexsort((col["start"], col["doc"], col["content"], col["anchor"], decided))
    col = {f: v[order] for f, v in col.items()}
    decided = decided[order]
    anchor, content = col["anchor"], col["content"]
    new_anchor = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (decided[1:] != decided[:-1])))
    new = new_anchor | np.concatenate(([True], content[1:] != content[:-1]))
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    same_place = (col["doc"] == col["doc"][lead]) & (col["start"] == col["start"][lead])
    group = np.cumsum(new_anchor) - 1
    contents = np.bincount(group, new)[group] if len(new) else np.zeros(0)
    kind = np.where(decided | ~same_place, 0, np.where(~new, -1, np.where(col["own"] & 2, 2, np.where((contents > 1) | (col["own"] & 1 > 0), 1, -1))))
    keep = kind >= 0
    return pa.table({"doc": pa.array(col["doc"][keep]), "start": pa.array(col["start"][keep]), "n": pa.array(col["n"][keep].astype(np.int64)), "kind": pa.array(kind[keep].astype(np.int32)), "anchor": pa.array(anchor[keep].view(np.int64))})


def _candidate_texts(docs: DataFrame, decided: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind, doc, start, n, text) of candidates, cut out of their documents."""
    pack = F.struct("start", "n", "kind", "anchor")
    wanted = decided.where("kind > 0").groupBy("doc").agg(F.collect_list(pack).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = []
            for doc, base, text, of in zip(batch["doc"].to_pylist(), batch["base"].to_pylist(), batch["text"].cast(pa.large_binary()).to_pylist(), batch["of"].to_pylist(), strict=True):
                for x in of:
                    a = x["start"] - base
                    if text is not None and 0 <= a < len(text):
                        rows.append((x["anchor"], x["kind"], doc, x["start"], x["n"], text[a : a + x["n"] + LENGTH - 1]))
            if rows:
                anchor, kind, doc, start, n, text = zip(*rows, strict=True)
                bucket = (mix(np.array(anchor, np.int64).view(U64) ^ U64(0x5851F42D4C957F2D)) % U64(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(kind, pa.int32()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(text, pa.binary())], ["bucket", "kind", "doc", "start", "n", "text"])

    return docs.select("doc", "base", "text").join(wanted, "doc").select("doc", "base", "text", "of").mapInArrow(run, "bucket int, kind int, doc long, start long, n long, text binary")


def _sorted_bucket(table: pa.Table) -> pa.Table:
    texts = table["text"].to_pylist()
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    offset = np.concatenate(([0], np.cumsum(size)))[:-1]
    data = np.frombuffer(b"".join(texts) + bytes(LENGTH + COVER + 8), np.uint8)
    d, p, n = _earlier(data, offset, np.asarray(table["n"]), np.asarray(table["doc"]), np.asarray(table["start"]))
    return pa.table({"doc": pa.array(d), "start": pa.array(p), "n": pa.array(n)})


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two 64-bit hashes of each window of hot candidates."""
    for batch in chunks(batches, "text", 1 << 18):
        texts = batch["text"].to_pylist()
        data = np.frombuffer(b"".join(texts) + bytes(LENGTH + 8), np.uint8)
        n = np.asarray(batch["n"])
        seg = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))[seg] + inner
        w = words_at(data)
        h, k = np.zeros(len(at), U64), np.zeros(len(at), U64)
        for off in (*range(0, LENGTH - 7, 8), LENGTH - 8):
            x = w[at + off]
            h = (h ^ (h >> U64(31))) * U64(0x9E3779B97F4A7C15) + x
            k = (k ^ (k >> U64(27))) * U64(0x94D049BB133111EB) + x * U64(0xD6E8FEB86659FD93)
        yield pa.RecordBatch.from_arrays([pa.array(mix(h).view(np.int64)), pa.array(mix(k).view(np.int64)), pa.array(np.asarray(batch["doc"])[seg]), pa.array(np.asarray(batch["start"])[seg] + inner)], ["f1", "f2", "doc", "start"])


def repeat_marks(docs: DataFrame) -> DataFrame:
    """(doc, start, n): n windows from start on that also start earlier. docs: doc, base, text."""
    spark = docs.sparkSession
    size = total_bytes(docs)
    full = max(32, -(-size // SEGMENT_TEXT))
    buckets = max(shuffle_partitions(spark), full)
    # cells follow the input's size alone, not how many partitions it is dealt over
    hot = _hot_cells(docs, 64 * full, full)
    rows = _segment_rows(docs, hot, buckets).withColumn("key", F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket")))
    schema = "doc long, start long, n long, kind int, anchor long"
    decided = materialize(rows.repartition(buckets, "key").groupBy("key").applyInArrow(_decide, schema), "decided")
    amount = decided.where("kind = 1").agg(F.sum(F.col("n") + LENGTH)).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-amount // SUFFIX_TEXT))
    texts = materialize(_candidate_texts(docs, decided, parts), "candidates")
    marks = "doc long, start long, n long"
    ordered = texts.where("kind = 1").repartition(parts, "bucket").groupBy("bucket").applyInArrow(_sorted_bucket, marks)
    prints = materialize(texts.where("kind = 2").select("doc", "start", "n", "text").mapInArrow(_fingerprints, "f1 long, f2 long, doc long, start long"), "fingerprints")
    first = prints.groupBy("f1", "f2").agg(F.min(F.struct("doc", "start")).alias("lead"), F.count("*").alias("c")).where("c > 1").select("f1", "f2", "lead")
    again = prints.join(first, ["f1", "f2"]).where(F.struct("doc", "start") != F.col("lead")).select("doc", "start", F.lit(1).cast("long").alias("n"))
    return decided.where("kind = 0").select("doc", "start", "n").unionByName(ordered).unionByName(again)


def repeated_removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text (binary) for every row of docs."""
    keyed = _keyed(docs)
    marks = repeat_marks(keyed)
    # start and n of a mark in one number: a document's marks are gathered, as its text is
    packed = marks.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = []
            lists = batch["marks"]
            flat = lists.flatten()
            start, n = (np.asarray(flat.field(k)) for k in ("start", "n"))
            count = np.asarray([len(x) if x is not None else 0 for x in lists.to_pylist()]) if not len(flat) else np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
            edge = np.concatenate(([0], np.cumsum(count)))
            for i, (base, text) in enumerate(zip(batch["base"].to_pylist(), batch["text"].cast(pa.large_binary()).to_pylist(), strict=True)):
                text = text or b""
                a = start[edge[i] : edge[i + 1]] - base
                b = a + n[edge[i] : edge[i + 1]] + LENGTH - 1
                mine = (a >= 0) & (b <= len(text))
                cover = np.zeros(len(text) + 1, np.int64)
                np.add.at(cover, a[mine], 1)
                np.add.at(cover, b[mine], -1)
                gone = np.cumsum(cover)[:-1] > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0
                rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    both = keyed.join(packed, "doc", "left").select("doc_id", "base", "text", "marks")
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary")
