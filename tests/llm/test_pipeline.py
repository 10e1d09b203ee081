from pyspark.sql import functions as F

import corpus_pipeline as cp
from crawlweft.llm import quality
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.001"


def test_each_stage_acts_on_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = [docs]
    for _, stage in cp.STAGES:
        after.append(stage(spark, after[-1], SF).cache())
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    ruled = quality.rules(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after[1]) == ids(ruled.where("kept"))
    groups = brute([(r.doc_id, r.text) for r in after[1].collect()], 5)
    assert ids(after[2]) == sorted(i for i, v in groups.items() if v[2])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r.doc_id for r in after[2].collect() if any(t in r.text for t in items)}
    assert not held & set(ids(after[3])) and len(ids(after[3])) >= len(ids(after[2])) - len(held) - 2
    assert set(ids(after[4])) <= set(ids(after[3])) and all(a.columns == docs.columns for a in after[1:5])
    assert ids(after[5]) == ids(after[4])
    # the same texts where one has no id, two share an id and a column has a name that a stage uses
    roots = [v[1] for v in groups.values()]
    a, b, c = [i for i in ids(after[3]) if roots.count(i) == 1][:3]
    odd = after[1].withColumn("doc_id", F.when(F.col("doc_id") == a, F.lit(None)).when(F.col("doc_id") == b, F.lit(c)).otherwise(F.col("doc_id"))).withColumn("_shard", F.lit(1)).withColumn("row", F.lit("r"))
    rows = [odd]
    for _, stage in cp.STAGES[1:]:
        rows.append(stage(spark, rows[-1], SF).cache())
    assert all(r.columns == odd.columns for r in rows[:4]) and [r.count() for r in rows[:3]] == [r.count() for r in after[1:4]]
    assert sorted(map(str, (r.doc_id for r in rows[2].collect()))) == sorted(map(str, [None, c, c, *(i for i in ids(after[3]) if i not in (a, b, c))])) and rows[4].count() == rows[3].count()
    assert cp.quality_rules(spark, odd.limit(9), SF).columns == odd.columns
    assert [n for n, _ in cp.STAGES] and cp.run(spark, SF).count() == after[5].count()


def test_repeated_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "text kept", "1 _shard")
    odd = docs.unionByName(docs.limit(20)).unionByName(docs.limit(1).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "lang", "cast(null as string) source", "n_chars", "kept", "_shard"))
    for _, stage in cp.STAGES[:2]:
        odd = stage(spark, odd, SF)
    assert odd.columns == docs.columns and odd.count() == odd.select("doc_id").distinct().count()
    for _, stage in cp.STAGES:
        docs.limit(0) and stage(spark, docs.limit(0), SF).collect()
