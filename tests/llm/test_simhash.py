import random
import re

import numpy as np
import pytest
import xxhash

from crawlweft.llm import simhash
from crawlweft.llm.queries import op13_simhash_dedup

SF = "/root/testdata/sf0.01"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps):
    """Least item of each component of all pairs within four bits."""
    at, fp = list(range(len(fps))), np.array(fps, np.uint64)

    def find(x):
        while at[x] != x:
            at[x] = x = at[at[x]]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            at[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(fps))]


def clustered(rng, groups, size, spread):
    out = []
    for _ in range(groups):
        middle = rng.getrandbits(64)
        out += [middle ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, spread))) for _ in range(size)]
    return list(dict.fromkeys(out))


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    docs.sort(key=lambda r: r.doc_id)
    fps = [plain(r.text) for r in docs]
    least = roots(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op13_simhash_dedup(spark, SF).collect()}
    assert got == {r.doc_id: (f"{fp:016x}", docs[k].doc_id) for r, fp, k in zip(docs, fps, least, strict=True)}
    assert 0 < sum(k != x for x, k in enumerate(least)) < len(docs)


@pytest.mark.parametrize("full,small,hot", [(512, 256, 1 << 18), (1, 4, 1 << 18), (512, 2, 40), (0, 1, 1)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, full, small, hot):
    monkeypatch.setattr(simhash, "choices", lambda n, bits, f=simhash.choices: f(n, bits, full))
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(3)
    fps = sorted({*clustered(rng, 3, 60, 7), *(rng.getrandbits(64) for _ in range(200)), 0, (1 << 64) - 1})
    chain = fps[50]
    for k in range(0, 40, 4):  # neighbours four bits apart in a row
        fps.append(chain := chain ^ (15 << k))
    fps = list(dict.fromkeys(fps))
    want = roots(fps)
    links = simhash.linked(spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")).collect()
    place = {simhash._signed(x): k for k, x in enumerate(fps)}
    i, j = (np.array([place[r[c]] for r in links], np.int64) for c in ("u", "v"))
    assert simhash._least(len(fps), i, j).tolist() == want and len(set(want)) < len(fps) - 40
    assert len(links) <= 80 * len(fps)


def test_masks_lose_no_pair():
    for n in (10, 1 << 24, 1 << 40, 1 << 60):
        masks = simhash.choices(n)
        assert all(any(not m & d for m in masks) for d in (sum(1 << k for k in random.Random(s).sample(range(64), 4)) for s in range(300)))
    assert [len(simhash.choices(n)) for n in (10, 1 << 24, 1 << 31, 1 << 40)] == [5, 15, 35, 70]


def test_both_ways_within_buckets_agree():
    rng = random.Random(9)
    fp = np.array(sorted({*clustered(rng, 4, 80, 5), *(rng.getrandbits(64) for _ in range(100))}), np.uint64)
    want = roots(fp.tolist())
    assert simhash.reached(fp, 4).tolist() == want and simhash.pairwise(np.zeros(len(fp), np.uint64), fp, 4).tolist() == want


def test_odd_rows(spark):
    long = " ".join(f"w{k % 977}" for k in range(200_000))
    rows = [(5, None), (3, ""), (None, " \t\x0b"), (7, "one"), (6, "ONE"), (6, "É"), (None, "é è"), (9, long), (8, long + " x"), (8, "one"), (4, "a\x1fb c\xa0d"), (2, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 fp", "2 component", "3 least")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    fps = [plain(t) for _, t in rows]
    least = {}
    for (i, _), k in zip(rows, roots(fps), strict=True):
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    assert got == sorted(((i, f"{fp:016x}", least[k]) for (i, _), fp, k in zip(rows, fps, roots(fps), strict=True)), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
