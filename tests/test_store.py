"""A stored crawl against dictionaries."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from crawlweft.operators.arrivals import appended_issues
from crawlweft.sources.store import Conflict, Store, headers_json

URLS = "id long, url string, normalized_url string, depth int, last_seen timestamp"


def arrival(spark, rng, day, n):
    return [(day * 1000 + k, f"u{k}", rng.choice([None, *(f"n{x}" for x in range(60))]), rng.randrange(9)) for k in range(n)], F.lit(f"2024-01-{day:02d}").cast("timestamp")


def test_merges_keep_the_first_row_and_the_last_sight(spark, tmp_path):
    rng, known, store = random.Random(1), {}, Store(spark, str(tmp_path), buckets=16, files=2)
    for day in (1, 2, 3):
        rows, at = arrival(spark, rng, day, 40)
        for r in rows:
            known[r[2]] = (*known.get(r[2], r)[:4], day)
        df = spark.createDataFrame(rows, "id long, url string, normalized_url string, depth int").withColumn("last_seen", at)
        assert store.merge("urls", df, ["id"]) == day
    got = {r.normalized_url: (r.id, r.url, r.normalized_url, r.depth, r.last_seen.day) for r in store.read("urls").collect()}
    assert got == known and store.read("urls").count() == len(known)
    assert store.read("urls", 1).where("last_seen > '2024-01-01'").isEmpty() and store.merge("urls", df.limit(0), ["id"]) == 4
    store.expire("urls")
    assert store.versions("urls") == [4] and {r.normalized_url for r in store.read("urls").collect()} == set(known)
    assert len(list((tmp_path / "urls" / "data").iterdir())) == len(store._manifest("urls")["parts"])


def test_a_merge_rewrites_its_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=32)
    rows = spark.range(500).select("id", F.concat(F.lit("n"), "id").alias("normalized_url"), F.lit(1).alias("depth"))
    store.merge("urls", rows)
    before = store._manifest("urls")["parts"]
    store.merge("urls", rows.where("id = 7").withColumn("depth", F.lit(5)))
    parts = store._manifest("urls")["parts"]
    (old,), new = before, set(parts) - set(before)
    assert len(parts[old]) == len(before[old]) - 1 and [len(parts[p]) for p in new] == [1] and store.read("urls").where("id = 7").first().depth == 1


def test_features_and_resources_take_what_their_rules_say(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    f = "url_id long, title string, word_count int"
    store.merge("html_features", spark.createDataFrame([(1, "a", 1), (2, "b", 2)], f))
    store.merge("html_features", spark.createDataFrame([(2, None, 3), (3, "c", None)], f))
    assert sorted(tuple(r)[:2] + (r.word_count,) for r in store.read("html_features").collect()) == [(1, "a", 1), (2, None, 3), (3, "c", None)]
    r = "id long, url string, status_code int, size long, alt string"
    store.merge("resources", spark.createDataFrame([(1, "x", 200, 10, "old"), (2, "x", 404, 20, "later")], r), ["id"])
    store.merge("resources", spark.createDataFrame([(3, "x", 500, None, "new")], r), ["id"])
    assert [(x.id, x.status_code, x.size, x.alt) for x in store.read("resources").collect()] == [(1, 500, None, "old")]
    pairs = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "resource_id long, url_id long")
    store.merge("page_resources", pairs)
    store.merge("page_resources", pairs)
    assert store.read("page_resources").count() == 2
    s = spark.createDataFrame([("h", "u", "running")], "id string, start_url string, status string")
    store.merge("sessions", s)
    store.merge("sessions", s.selectExpr("'h' id", "'done' status").unionByName(s.selectExpr("'other' id", "'done' status")), insert=False, take=("status",))
    assert [(x.id, x.start_url, x.status) for x in store.read("sessions").collect()] == [("h", "u", "done")]
    with pytest.raises(ValueError):
        store.append("links", spark.createDataFrame([(1, 2)], "id long, unknown long"))


def test_appends_keep_equal_rows_and_headers(spark, tmp_path):
    store, rows = Store(spark, str(tmp_path)), [(1, {"B": ["x", "y"], "A": ['q"']}), (1, {}), (2, None)]
    df = spark.createDataFrame(rows, "id long, headers map<string, array<string>>").select("id", headers_json("headers").alias("headers_json"))
    assert store.append("fetches", df) == 1 and store.append("fetches", df) == 2
    assert sorted((r.id, str(r.headers_json)) for r in store.read("fetches").collect()) == sorted([(1, '{"A":["q\\""],"B":["x","y"]}'), (1, "{}"), (2, "None")] * 2)


def counted(spark, rows, schema):
    """The rows, and how many of them have been computed."""
    seen = spark.sparkContext.accumulator(0)

    def see(row):
        seen.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(see), schema), seen


def test_merged_rows_are_computed_once(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4, files=2)
    for n in (1, 2):
        rows, seen = counted(spark, [(k * n, f"t{k}") for k in range(20)], "url_id long, title string")
        assert store.merge("html_features", rows) == n and seen.value == 20
    assert store.read("html_features").count() == 30 and not list((tmp_path / "html_features" / "data").glob("staged-*"))


def test_issues_of_two_appends_are_computed_once(spark):
    issues, seen = counted(spark, [(k // 2, "c", "t", "s", "response" if k % 3 else "content") for k in range(20)], "url_id long, issue_code string, issue_type string, severity string, category string")
    got = appended_issues({"issues": issues, "urls": issues}.__getitem__)
    assert seen.value == 20 and sorted(map(tuple, got.collect())) == [(k, "c", 2) for k in range(10)]


def test_of_two_writers_the_second_starts_anew(spark, tmp_path, monkeypatch):
    one, two = (Store(spark, str(tmp_path), buckets=4) for _ in range(2))
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, normalized_url string, depth int")
    one.merge("urls", rows.where("id = 1"))
    written, raced = two._written, []

    def late(*args):
        out = written(*args)
        if not raced:
            raced.append(one.merge("urls", rows.withColumn("depth", F.lit(3)), ["id"]))
        return out

    monkeypatch.setattr(two, "_written", late)
    assert two.merge("urls", spark.createDataFrame([(9, "c", 1), (8, "b", 7)], rows.schema)) == 3 and raced == [2]
    assert sorted((r.id, r.normalized_url, r.depth) for r in two.read("urls").collect()) == [(1, "a", 0), (2, "b", 3), (9, "c", 1)]
    monkeypatch.setattr(two, "_commit", lambda *_: (_ for _ in ()).throw(Conflict("taken")))
    with pytest.raises(Conflict):
        two.append("links", spark.createDataFrame([(1,)], "id long"))
    assert store_is_whole(one)


def store_is_whole(store):
    return all(store.read("urls", v).count() for v in store.versions("urls")) and uuid.UUID(next(iter(store._manifest("urls")["parts"])))
