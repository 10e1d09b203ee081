import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlweft.llm import suffix


def brute(rows, length=suffix.LENGTH):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[doc] = (len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def run(docs):
    got = suffix.repeated_removed(docs).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}


def test_cover():
    for v in (7, 13, 32):
        d = suffix.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_window_classes_against_sorting():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 99, 300, dtype=np.uint8)
    parts = [base, np.full(260, 97, np.uint8), base[:150], np.tile(base[:7], 40), rng.integers(97, 99, 400, dtype=np.uint8), np.concatenate((base[40:180], base[20:160]))]
    text = np.concatenate([*parts, np.zeros(suffix.LENGTH + suffix.COVER + 8, np.uint8)])
    at = np.arange(sum(map(len, parts)) - suffix.LENGTH + 1)
    order, cls = suffix.window_classes(text, at)
    strings = [text[p : p + suffix.LENGTH].tobytes() for p in at]
    assert [strings[i] for i in order] == sorted(strings)
    assert len(set(cls.tolist())) == len(set(strings)) == len(set(zip(cls.tolist(), strings)))


def test_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert run(docs) == brute([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("hot", [False, True])
def test_edges(spark, hot, monkeypatch):
    rng = np.random.default_rng(2)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(40)]
    say = lambda n: " ".join(rng.choice(words, n))
    shared, line = say(30), "see the terms of use at example dot org slash terms of the house"
    rows = [None, "", "x" * 99, "x" * 100, "x" * 350, "ab" * 300, "é" * 120, "\0" * 250, shared, shared[:120]]
    rows += [say(rng.integers(1, 40)) + f"\n{line}\n" + say(rng.integers(1, 40)) + (shared[rng.integers(0, 60) :] if i % 3 == 0 else "") for i in range(150)]
    rows += ["many " * 3000, rows[-1], rows[-1] + "!", say(3000)]
    rows = list(enumerate(rows))
    if hot:
        monkeypatch.setattr(suffix, "_hot_cells", lambda docs, cells, buckets: np.ones(cells, bool))
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, base int, doc string")
    assert run(docs) == brute(rows)
    assert run(docs.unionByName(docs)) == brute(rows)
    assert run(docs.limit(0)) == {}


def test_texts_under_one_id(spark):
    a, b = "".join(chr(97 + i * i % 26) for i in range(150)) + "tail" * 30, "start" * 30
    docs = spark.createDataFrame([(1, a + b), (1, b + a), (None, a)], "doc_id long, text string")
    got = suffix.repeated_removed(docs).collect()
    assert len(got) == 3 and {(r.n_bytes, r.n_removed) for r in got if r.doc_id is None} == {(len(a), len(a))}
