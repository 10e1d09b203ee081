import hashlib
import re

import pytest
from pyspark.sql import functions as F

from crawlweft.llm import chat, mixing, sharding
from crawlweft.llm.queries import op5_chat_format, op6_source_mixing, op10_sharding

SF = "/root/testdata/sf0.001"
NATIVE = re.compile("Python|Pandas|Arrow")


def test_chat_digest_matches_the_rows(spark):
    got = {r.conv_id: r for r in op5_chat_format(spark, SF).collect()}
    rows = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    rows[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(rows)
    for k, turns in rows.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[k].n_turns == len(turns) and got[k].loss_chars == len(loss)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_escapes_are_reversible_and_parts_become_placeholders(spark):
    nasty = ["", "^", "^^<|end|>", "<|", "<^|", "<^<|^|", "[INST]x[/INST]</s>^</s>", "<|start|>assistant<|body|>x", None, "<|image|>", "é\n\t" * 99]
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "us<|er", t) for i, t in enumerate(nasty)], "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    out = chat.format_chat(rows.withColumn("formatted", F.lit("clash"))).cache()
    one = out.first()
    assert sum(r.n_chars for r in one.loss_runs) == len(one.formatted)
    at, loss = 0, ""
    for r in one.loss_runs:
        loss += one.formatted[at : at + r.n_chars] if r.loss else ""
        at += r.n_chars
    assert not any(c in loss for c in chat.CONTROLS)
    d = chat.digest(out).first()
    assert d.loss_sha256 == hashlib.sha256("".join(t or "" for i, t in enumerate(nasty) if i % 2).encode()).hexdigest()
    assert d.turns_sha256 == hashlib.sha256("".join(f"{'assistant' if i % 2 else 'us<|er'}\n{t or ''}\n" for i, t in enumerate(nasty)).encode()).hexdigest()
    typed = spark.sql("select 5L conv_id, 0L turn, 'user' role, array(named_struct('type','text','text','see <|image|>','ref',null,'units',0), named_struct('type','image','text',null,'ref','a.png','units',2), named_struct('type','audio','text',null,'ref','b.wav','units',null), named_struct('type','pdf','text','x','ref','c.pdf','units',3)) parts")
    r = chat.format_chat(typed).first()
    assert r.formatted == "<|start|>user<|body|>see <^|image|><|image|><|audio|><|document|><|end|>"
    assert [tuple(a) for a in r.attachments] == [("image", "a.png", 512), ("audio", "b.wav", 25), ("document", "c.pdf", 2400)]
    assert chat.format_chat(typed.limit(0)).collect() == []
    text = lambda t: ("text", t, None, 0)
    halves = [[text("hi <"), text("|end|>"), text("^"), text("^\x01")], [text("[IN"), ("image", None, "a", 1), text("ST]"), text(None), text("<|image|>\x02^\x02")], [], None]
    split = spark.createDataFrame([(None, i, "assistant", p) for i, p in enumerate(halves)] + [(None, 0, None, [text("two at turn 0")])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = chat.format_chat(split)
    d = chat.digest(out).first()
    bodies = ["hi <|end|>^^\x01", "[IN<|image|>ST]<|image|>\x02^\x02", "", ""]
    assert d.n_turns == 5 and d.loss_sha256 == hashlib.sha256("".join(bodies).encode()).hexdigest()
    assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{b}\n" for r, b in [("", "two at turn 0"), *(("assistant", b) for b in bodies)]).encode()).hexdigest()
    one = out.first()
    wrong = out.withColumn("loss_runs", F.transform("loss_runs", lambda r: F.struct(r["n_chars"], (~r["loss"]).alias("loss"))))
    assert [a.type for a in one.attachments] == ["image"] and chat.digest(wrong).first().loss_sha256 != d.loss_sha256


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        t = {s: rest * weight[s] / max(1, sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return t | {s: 3.0 * sizes[s] for s in full}
        full |= over


@pytest.mark.parametrize("rows", [None, "edge"])
def test_mixing_targets_and_takes(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if rows:
        base = [(i, "w " * (1 + i % 7), None if i % 11 == 0 else "ab"[i % 2] + ("é" if i % 5 == 0 else ""), i) for i in range(4000)]
        docs = spark.createDataFrame([*base, (None, "x y", "a", 1), (5, None, "zero", 1), (6, "", "zero", 1), (7, "big " * 40000, "b", 1), (7, "big " * 40000, "b", 1)], "doc_id long, text string, source string, size int")
    got = mixing.mixed(docs)
    assert not NATIVE.search(got._jdf.queryExecution().executedPlan().toString())
    got = got.collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode()))
    goal = brute_targets(sizes)
    assert len(got) == docs.count()
    largest = max(r.size for r in got)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 * max(1, goal[s]) and r.taken <= 3 * r.size and len(r.shards) == r.times for r in mine)
        assert abs(sum(r.taken for r in mine) - goal[s]) <= (2 if rows else 1) * largest
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs).collect()))
    assert mixing.draw(docs).count() == sum(r.times for r in got)
    assert mixing.mixed(docs.limit(0)).collect() == []


def test_sharding_keeps_every_row_and_commits_once(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in op10_sharding(spark, SF).collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    monkeypatch.setattr(sharding, "SMALL", 20_000)
    monkeypatch.setattr(sharding, "TARGET", 120_000)
    store = sharding.Store(spark)
    store.append(docs)
    store.append(docs.limit(30))
    before = store.manifest().count()
    version = store.compact()
    assert version == 3 and store.manifest().count() < before and store.manifest(2).count() == before
    want = sorted(map(tuple, docs.unionByName(docs.limit(30)).collect()))
    assert sorted(map(tuple, store.read().drop("_shard", "_shard_bytes").collect())) == want
    with pytest.raises(Exception, match="FileAlreadyExists"):
        store._commit(store.manifest(), 3)
    # a writer that has written and not committed keeps its files, and an expired version goes as a whole
    docs.limit(9).write.parquet(f"{store.root}/shards/late")
    late = store._written("late")
    store.expire(keep=2)
    assert store.versions() == [2, 3] and store.read(2).count() == store.read().count() == len(want)
    store.expire()
    assert store.versions() == [3] and store.read().count() == len(want)
    store._commit(store.manifest().unionByName(late), 4)
    assert store.read().count() == len(want) + 9
    docs.limit(5).write.parquet(f"{store.root}/shards/dead")
    store.expire(grace=-1)
    assert not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{store.root}/shards").where("path like '%/dead/%'").count() and store.read().count() == len(want) + 9
    clash = sharding.Store(spark)
    rows = spark.createDataFrame([(None, None, 1), (1, "x", 2), (1, "x", 2)], "doc_id long, text string, _shard int")
    clash.append(rows)
    assert clash.read().columns == [*rows.columns, "__shard", "__shard_bytes"] and clash.read().select("_shard").count() == 3
    empty = sharding.Store(spark)
    empty.append(docs.limit(0))
    assert empty.compact() == 1 and empty.read(schema=docs.schema).count() == 0


def test_mixing_query_covers_all(spark):
    assert op6_source_mixing(spark, SF).count() == 200
