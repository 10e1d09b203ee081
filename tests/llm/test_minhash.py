import re

from crawlweft.llm.minhash import near_duplicates, one_of_each


def brute(rows, n, percent=80):
    """All pairs, full sets, union-find."""
    sets = {}
    for i, text in rows:
        w = [x for x in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_whole_table_matches_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for n in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, n).collect()}
        assert got == brute([tuple(r) for r in docs.collect()], n)


def test_edges_chain_nulls_and_extra_columns(spark):
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[k : k + 40]) for k in range(0, 20, 4)]
    rows = [*enumerate([None, "", " \t\n", "A b", "a B", "single", "Single", "É x", "é x", *chain, "x " * 5000, "x " * 5001])]
    docs = spark.createDataFrame([(i, t, "s", i, True) for i, t in rows], "doc_id long, text string, sketch string, rep long, kept boolean")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, 2).collect()}
    assert got == brute(rows, 2)
    again = near_duplicates(docs.unionByName(docs), 2).collect()
    assert len(again) == 2 * len(rows) and {(r.doc_id, r.component_id) for r in again} == {(i, v[1]) for i, v in got.items()}
    assert near_duplicates(docs.limit(0), 2).collect() == []


def test_group_of_near_copies_with_links_away_from_the_hub(spark):
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 18)):
            w[r.randrange(len(w))] = r.choice(base) if r.random() < 0.5 else word()
        rows.append(w)
        if i % 7 == 0:
            v = list(w)
            v[r.randrange(len(v))] = word()
            rows.append(v[: r.randint(100, 120)])
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (2, 5):
        got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_duplicates(docs, n).collect()}
        assert got == brute(rows, n)


def test_whole_table_of_a_thousand_rows_with_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, 2).collect()}
    assert got == brute([tuple(r) for r in docs.collect()], 2)


def test_one_id_with_two_texts_and_rows_without_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    near = lambda t: t + " end"
    rows = [(1, a, "p"), (1, b, "q"), (2, near(a), "r"), (3, near(b), "s"), (4, c, "t"), (4, c, "t"), (None, near(c), "u"), (None, "x y", "v"), (None, "z w", "w"), (None, None, "n"), (9, "", "e"), (9, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs, 2).collect() if r.doc_id is not None)
    assert got == sorted([(False, 1, 1, True)] * 2 + [(False, 2, 1, False), (False, 3, 1, False)] + [(False, 4, 4, True)] * 2 + [(False, 9, 9, True)] * 2)
    assert [(r.component_id, r.kept) for r in near_duplicates(docs, 2).collect() if r.doc_id is None] == [(None, True)] * 4
    kept = one_of_each(docs, 2)
    assert kept.columns == docs.columns and sorted(r._row for r in kept.collect()) == ["e", "f", "n", "p", "q", "t", "v", "w"]
    single = docs.where("doc_id in (2, 3) or _row = 't'").dropDuplicates()
    assert sorted(r._row for r in one_of_each(single, 2).collect()) == ["r", "s", "t"]
