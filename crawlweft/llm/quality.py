"""Document statistics and the two operators on them: a quality classifier and quality rules.

Both fit histogram gradient-boosted trees (gbt.py) to labels.quality on all labelled rows, which stay in blocks with Spark, and
score every whole text with the flattened node arrays. Thresholds too are found over all rows.
Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1. lang, source, doc_id and labels are no
inputs of a score.

Defined cases: null and empty texts have statistics of 0 and are scored like any other; a labels table without usable
rows gives every document the prior; a null quality is not learnt from; several labels of one document count each;
repeated rows are scored each; a null doc_id is scored, not held out; columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .gbt import Forest, counted_margins, fit_rows
from .kernels import U64, chunks, joined, lower, span_hashes, word_spans
from .runtime import drop_tables, materialize

#: Rows of a block of statistics, and of a task that sums over blocks.
BLOCK, TASK = 16_384, 50_000
FEATURES = (
    "log_words", "mean_word", "upper", "digits", "punct", "symbols", "pipes", "bang", "line_words", "dup_lines", "repeat_words",
    "distinct_words", "space", "other_bytes", "one_letter", "long_words", "caps_words", "symbol_words", "stop_end", "short_lines",
)
#: For the rules: more symbols, repetition or shouting never helps a document.
FALLING = {"symbols", "pipes", "bang", "dup_lines", "repeat_words", "caps_words", "symbol_words"}
MONOTONE = np.array([-1 if f in FALLING else 0 for f in FEATURES])
#: Share of good training documents that the learnt rule may reject.
REJECT = 0.002

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[ord(c) for c in ".,;:?'\"()-_/\\@+=~^`[]{}"]] = 3
_CLASS[[ord(c) for c in "#*$%&<>"]] = 4
_CLASS[ord("|")] = 5
_CLASS[ord("!")] = 6
_CLASS[[32, *range(9, 14)]] = 7
_CLASS[[*range(128, 256)]] = 8


def _per(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, n)[:n]


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts of each text (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and its feature row."""
    data, starts, lengths = joined(texts)
    n = len(starts)
    edge = np.concatenate((starts, [len(data)]))
    kind = _CLASS[data]
    by = np.zeros((n, 9))
    for c in range(1, 9):
        total = np.concatenate(([0], np.cumsum(kind == c)))
        by[:, c] = total[edge[1:]] - total[edge[:-1]]
    by[:, 7] -= 1  # the joining space
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points
    first, end = word_spans(data)
    owner = np.searchsorted(starts, first, "right") - 1
    words = _per(owner, n)
    chars = lead[end] - lead[first]
    word_chars = _per(owner, n, chars)
    # lines: ends are \n bytes and the joining spaces
    line_end = np.flatnonzero((data == 10) | np.isin(np.arange(len(data)), edge[1:] - 1))
    line_start = np.concatenate(([0], line_end[:-1] + 1)) if len(line_end) else line_end
    line_owner = np.searchsorted(starts, line_start, "right") - 1
    word_count = np.searchsorted(first, line_end, "left") - np.searchsorted(first, line_start, "left")
    real = word_count > 0
    lines = _per(line_owner[real], n)
    dup = np.zeros(n, np.int64)
    if real.any():
        lh, lo = span_hashes(data, line_start[real], line_end[real]), line_owner[real]
        order = np.lexsort((lh, lo))
        same = (lh[order][1:] == lh[order][:-1]) & (lo[order][1:] == lo[order][:-1])
        dup = _per(lo[order][1:][same], n).astype(np.int64)
    # words in three-word windows that are found twice or more in their text
    repeat, distinct = np.zeros(n, np.int64), np.zeros(n)
    if len(first):
        wh = span_hashes(data, first, end)
        order = np.lexsort((wh, owner))
        new = np.concatenate(([True], (wh[order][1:] != wh[order][:-1]) | (owner[order][1:] != owner[order][:-1])))
        distinct = _per(owner[order][new], n)
        if len(wh) > 2:
            three = np.flatnonzero(owner[:-2] == owner[2:])
            h = (wh[three] * U64(31) + wh[three + 1]) * U64(0x9E3779B97F4A7C15) + wh[three + 2]
            h ^= h >> U64(29)
            order = np.lexsort((h, owner[three]))
            s, so = h[order], owner[three][order]
            eq = (s[1:] == s[:-1]) & (so[1:] == so[:-1])
            often = np.zeros(len(three), bool)
            often[order[1:][eq]] = True
            often[order[:-1][eq]] = True
            covered = np.zeros(len(wh), bool)
            for j in range(3):
                covered[three[often] + j] = True
            repeat = _per(owner[covered], n).astype(np.int64)
    counts = {"n_words": words.astype(np.int64), "word_chars": word_chars.astype(np.int64), "n_symbols": (by[:, 4] + by[:, 5]).astype(np.int64), "n_dup_lines": dup, "n_repeat_words": repeat}
    size, w, ln = np.maximum(lengths, 1), np.maximum(words, 1), np.maximum(lines, 1)
    last = data[np.maximum(end - 1, 0)] if len(end) else np.zeros(0, np.uint8)
    upper = np.concatenate(([0], np.cumsum(kind == 1)))
    capital = (upper[end] - upper[first]) >= 2
    features = [
        np.log1p(words), word_chars / w, by[:, 1] / size, by[:, 2] / size, by[:, 3] / size, by[:, 4] / size, by[:, 5] / size, by[:, 6] / size, np.log1p(words / ln), dup / ln, repeat / w,
        distinct / w, by[:, 7] / size, by[:, 8] / size, _per(owner[chars == 1], n) / w, _per(owner[chars > 12], n) / w, _per(owner[capital], n) / w, _per(owner[np.isin(_CLASS[last], (4, 5))], n) / w,
        _per(owner[last == ord(".")], n) / w, _per(line_owner[real][word_count[real] < 4], n) / ln,
    ]
    return counts, np.stack(features, axis=1) if n else np.zeros((0, len(FEATURES)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        x = statistics(batch["text"])[1]
        ends = pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32())
        yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["id", "x"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield _block(held)
            held, n = [], 0
    if n:
        yield _block(held)


def _block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    x, y, half = (np.concatenate([np.asarray(of(b)) for b in batches]) for of in (lambda b: b["x"].flatten(), lambda b: b["q"], lambda b: b["half"]))
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x.astype(np.float64), y.astype(np.int8), half.astype(np.int8))], ["x", "y", "half"])


def learn(docs: DataFrame, labels: DataFrame, *, monotone: np.ndarray | None = None, threshold: bool = False) -> tuple[Forest, float]:
    """A forest fitted to labels.quality of all labelled rows, and 0; with threshold, a forest of half of those rows and the score below which REJECT of the good ones of the other half fall by it."""
    rows = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("q")).where(~held_out(F.col("id")))
    read = docs.select(F.col("doc_id").alias("id"), "text").where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    # statistics meet the labels, texts are not shuffled; the halves are those of a hash of the id
    met = read.mapInArrow(_statistics, "id long, x array<double>").join(rows, "id").repartition(max(1, -(-rows.count() // TASK)), "id")
    table = materialize(met.withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")).mapInArrow(_blocks, "x binary, y binary, half binary"), "labelled")
    blocks = table.rdd.map(lambda r: (np.frombuffer(r.x).reshape(-1, len(FEATURES)), np.frombuffer(r.y, np.int8), np.frombuffer(r.half, np.int8) == 0))
    try:
        if not threshold:
            return fit_rows(blocks.map(lambda b: b[:2]), monotone=monotone), 0.0
        forest = fit_rows(blocks.map(lambda b: (b[0][b[2]], b[1][b[2]])), monotone=monotone)
        at, n = counted_margins(blocks.map(lambda b: b[0][~b[2] & (b[1] == 1)]), forest)
        if not len(at):
            return forest, 0.0
        least = at[np.searchsorted(np.cumsum(n), REJECT * n.sum(), "right")]
        return forest, float(min(1 / (1 + np.exp(-least)), 0.5))
    finally:
        drop_tables(table)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    forest, _ = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(forest.score(statistics(batch["text"])[1]))], ["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def rules(docs: DataFrame, labels: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """docs (any columns, of them text) with the counts of statistics(), score, base_failed and kept appended (existing columns of these names are replaced).

    The forest is learnt from `of` (doc_id, text), or docs. kept: base rules passed, and the monotone forest's score at or above the threshold that learn() found for this forest.
    """
    forest, least = learn(docs if of is None else of, labels, monotone=MONOTONE, threshold=True)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    plain = docs.drop(*names, "score", "base_failed", "kept")
    schema = plain.schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            counts, x = statistics(batch["text"])
            failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            score = forest.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(counts[k]) for k in names), pa.array(score), pa.array(failed), pa.array(~failed & (score >= least))], [*batch.schema.names, *names, "score", "base_failed", "kept"])

    return plain.mapInArrow(run, f"{schema}, {', '.join(f'{k} long' for k in names)}, score double, base_failed boolean, kept boolean")
