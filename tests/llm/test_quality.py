import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crawlweft.llm import gbt, quality
from crawlweft.llm.queries import op1_quality_classifier, op2_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams, hit = {}, set()
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            hit |= {i + j for i in at for j in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def test_counts_of_every_text(spark):
    got = op2_quality_rules(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_odd_texts(spark):
    odd = [None, "", " \n ", "a", "\n\na\n a\na\n", "é|ü# x", "a b c a b c", "a a a a", "x " * 50000, "<" * 3000, "l\n" * 400]
    counts, x = quality.statistics(pa.array(odd))
    for i, t in enumerate(odd):
        assert tuple(int(counts[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain(t)[:5]
    assert np.isfinite(x).all()
    docs = spark.createDataFrame([(i, t, "kept", 1.0) for i, t in enumerate(odd)] + [(None, "x", "y", 2.0), (1, "", "y", 2.0)], "doc_id long, text string, kept string, score double")
    labels = spark.createDataFrame([(0, 1), (2, None), (None, 0)], "doc_id long, quality int")
    for of in (labels, labels.limit(0)):
        assert quality.rules(docs, of).count() == quality.classify(docs, of).count() == len(odd) + 2
    assert quality.classify(docs.limit(0), labels).collect() == []


def test_held_out_accuracy(spark):
    got = op1_quality_classifier(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", "quality").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98
    assert got.where((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull()).isEmpty()


def test_all_labelled_rows_are_learnt_from(spark):
    """Bad rows come last by the order that a bounded sample was taken in."""
    ids = spark.range(36000).where(~quality.held_out(F.col("id"))).orderBy(F.xxhash64("id")).toArrow()["id"].to_pylist()
    assert len(ids) > 22_000
    rows = [(i, *((1, "Plain words of a text.") if k < 20_000 else (0, "#### |||| $$$$ %%%%"))) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, quality int, text string")
    forest, least = quality.learn(df, df, threshold=True, monotone=quality.MONOTONE)
    good, bad = forest.score(quality.statistics(pa.array([rows[0][2], rows[-1][2]]))[1])
    assert bad < 0.1 < 0.9 < good and bad < least <= 0.5


def test_trees_over_blocks_do_not_depend_on_the_blocks(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((np.floor(rng.normal(size=(2000, 3)) * 8), rng.normal(size=(2000, 1)) * 1e-6), axis=1)
    y = (x[:, 0] - x[:, 1] + 4e6 * x[:, 3] + rng.normal(size=2000) > 0).astype(float)
    whole = gbt.fit(x, y, trees=6)
    dealt = []
    for parts, order in ((1, np.arange(2000)), (40, rng.permutation(2000))):
        blocks = [(x[order[k : k + 130]], y[order[k : k + 130]]) for k in range(0, 2000, 130)]
        dealt.append(gbt.fit_rows(spark.sparkContext.parallelize(blocks, parts), trees=6))
    assert all(np.array_equal(getattr(dealt[0], k), getattr(dealt[1], k)) for k in ("feature", "threshold", "left", "right", "value", "roots"))
    assert np.abs(dealt[0].score(x) - whole.score(x)).mean() < 0.02 and ((dealt[0].score(x) > 0.5) == (y > 0.5)).mean() > 0.8
    assert len(gbt.fit_rows(spark.sparkContext.parallelize([(x, y * 0)], 3)).roots) == len(gbt.fit_rows(spark.sparkContext.parallelize([], 3)).roots) == 0


def test_trees_are_monotone_and_flat_arrays_agree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 3))
    y = (x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=1500) > 0).astype(float)
    f = gbt.fit(x, y, trees=30, monotone=np.array([1, -1, 0]))
    assert ((f.score(x) > 0.5) == (y > 0.5)).mean() > 0.85
    for j, s in ((0, 1), (1, -1)):
        line = np.repeat(rng.normal(size=(40, 3)), 50, axis=0)
        line[:, j] = np.tile(np.linspace(-3, 3, 50), 40)
        assert (s * np.diff(f.score(line).reshape(40, 50), axis=1) >= -1e-12).all()

    def walk(row, k):
        while f.left[k] != k:
            k = f.left[k] if row[f.feature[k]] <= f.threshold[k] else f.right[k]
        return f.value[k]

    slow = [1 / (1 + np.exp(-(f.base + sum(walk(r, k) for k in f.roots)))) for r in x[:50]]
    assert np.allclose(slow, f.score(x[:50]))
