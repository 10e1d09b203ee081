import functools
import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from crawlweft.llm import repair
from crawlweft.llm.queries import op11_conversation_repair, oracle_sql

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\f\r"
NEXT = {("e", "s"): "s", ("e", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def flags(rows):
    """rows in order: (turn, role, text). Their first faults."""
    seen, out = set(), []
    for _, role, text in rows:
        if not text.strip(SPACES):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(SPACES)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """Every way of editing, from the end backwards: (cost, letters, lines)."""
    found = flags(rows)

    @functools.cache
    def best(i, q, inserted):
        ways = [(0, "", ())] if i == len(rows) and q in "ea" else []
        grown = lambda cost, letter, lines, rest: ways.append((cost + rest[0], letter + rest[1], lines + rest[2])) if rest else None
        for role in ("user", "assistant") if inserted < 3 else ():
            if (q, role[0]) in NEXT:
                grown(2, "I", (f"{role}:",), best(i, NEXT[q, role[0]], inserted + 1))
        if i < len(rows):
            _, role, text = rows[i]
            grown(3, "D", (), best(i + 1, q, 0))
            if found[i] not in ("blank", "duplicate"):
                for letter, cost, to in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    if (q, to[:1]) in NEXT:
                        grown(cost + (found[i] == "truncated"), letter, (f"{to}:{text}",), best(i + 1, NEXT[q, to[:1]], 0))
        return min(ways, key=lambda w: w[:2]) if ways else None

    cost, letters, lines = best(0, "e", 0)
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("block", [3, repair.BLOCK])
def test_cheapest_edits_against_all_ways(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng, rows = random.Random(5), []
    for conv in range(120):
        for _ in range(rng.randint(1, 9)):
            turn = rng.choice([None, *range(12)])
            rows.append((conv if conv else None, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "unknown", None]), rng.choice(["a.", "b!", "c?\n", "d", "é e", "", " \t\x0b", "a.\x1f", None, "a."])))
    rows += [(500, k, "user" if k % 2 else "assistant", "." * 4000 + str(k) + ".") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 block", "'x' letters", "2 idx")
    whole, turns = repair.repair(df)
    got = {r.conv_id: tuple(r)[1:] for r in whole.join(repair.digest(turns).withColumnRenamed("conv_id", "c"), F.expr("conv_id <=> c"), "left").select(*whole.columns, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))).collect()}
    said: dict = {}
    for conv, turn, role, text in rows:
        said.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert set(got) == set(said)
    for conv, mine in said.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        if len(mine) < 20:
            assert got[conv] == brute(mine), mine
    assert got[500][4:7] == (0, 4, f"I{'K' * 300}I")
    edits = {r.edit for r in turns.select("edit").distinct().collect()}
    assert edits == {"K", "R", "I"} and turns.where("edit = 'I' and (turn is not null or text <> '')").isEmpty()


def test_damage(spark):
    rows = [(c, t, r, x) for c in (*range(40), None) for t in (0, 1, None) for r, x in (("assistant", "Is. it? so!"), (None, None))]
    got = sorted(map(tuple, repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind:
            want += [(c, t, "user" if kind == 4 else r, {1: "", 2: x.translate(str.maketrans("", "", ".!?"))}.get(kind, x))] * (2 if kind == 3 else 1)
    assert got == sorted(want, key=str)


def test_query_matches_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = op11_conversation_repair(spark, SF)
    want = c.sql(oracle_sql()["op11_conversation_repair"])
    assert df.columns == want.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_empty_table_and_conversations_without_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    whole, turns = repair.repair(empty)
    assert whole.count() == 0 and turns.count() == 0 and repair.digest(turns).count() == 0
    gone = next(k for k in range(10**6) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "x."), (None, 0, "user", "y.")], empty.schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and set(got) == {gone, None}
