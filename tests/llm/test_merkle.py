import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from crawlweft.llm import merkle
from crawlweft.llm.queries import op12_merkle_manifest, oracle_sql

SF = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def climb(nodes, k, fan):
    """The root above nodes, and the siblings of node k with their side, level by level."""
    path = []
    while len(nodes) > 1:
        runs = [nodes[i : i + fan] for i in range(0, len(nodes), fan)]
        path.append((runs[k // fan][: k % fan], runs[k // fan][k % fan + 1 :]))
        nodes, k = [h(*r) for r in runs], k // fan
    return nodes[0], path


def plain(rows, fan):
    groups = {}
    for r in sorted(rows, key=lambda r: (r["lang"] is not None, (r["lang"] or "").encode(), r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault(r["lang"], []).append(r)
    tops, out = [climb([leaf(r) for r in g], 0, fan)[0] for g in groups.values()], []
    for at, g in enumerate(groups.values()):
        leaves = [leaf(r) for r in g]
        for k, r in enumerate(g):
            sub, low = climb(leaves, k, fan)
            root, high = climb(tops, at, fan)
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            now = leaf({**r, "n_chars": r["n_chars"] + 1}) if bad else leaves[k]
            for before, after in low + high:
                now = h(*before, now, *after)
            out.append((r["doc_id"], leaves[k], sub, root, h(*(x for b, a in low + high for x in b + a)), now, now == root))
    return sorted(out, key=str)


def run(df, **shape):
    altered = merkle.digest_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    out = merkle.manifest(df, FIELDS, other=F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, altered), **shape)
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", F.sha2("path", 256), "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("fan,span", [(2, 1024), (2, 4), (3, 9), (4, 4)])
def test_every_row_against_a_plain_tree(spark, fan, span):
    rng = random.Random(4)
    rows = [dict(doc_id=rng.choice([None, *range(60)]), text=rng.choice([None, "", "é" * 3, "x" * 50_000, "-", "1:a"]), lang=rng.choice([None, "", "en", "en", "en", "é", "z", "\U0001f600", "￮"]), source=rng.choice([None, "a", "-"]), n_chars=rng.choice([None, 0, -5, 12])) for _ in range(150)]
    rows += [dict(doc_id=7, text="alone", lang="one leaf", source=None, n_chars=1), *[dict(doc_id=8, text="same", lang="en", source="s", n_chars=2)] * 3]
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA).selectExpr("*", "1 id", "2 grp", "3 leaf", "4 other")
    assert run(df, fan=fan, span=span) == plain(rows, fan)


def test_one_row_and_no_rows(spark):
    one = dict(doc_id=1, text="a", lang=None, source="s", n_chars=1)
    df = spark.createDataFrame([(1, "a", None, "s", 1)], SCHEMA)
    assert run(df) == plain([one], 2) and run(df)[0][4] == h() and run(df.limit(0)) == []


def test_query_matches_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df, want = op12_merkle_manifest(spark, SF), c.sql(oracle_sql()["op12_merkle_manifest"])
    assert df.columns == want.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())
