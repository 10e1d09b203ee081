import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlweft.llm import decontaminate, pii, tokens
from crawlweft.llm.encoder import Encoder, drops_space
from crawlweft.llm.queries import op7_pii, op8_token_planes, op9_decontaminate, vocabulary

SF = "/root/testdata/sf0.001"


def documents(spark, sf=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def plain_base(text):
    text, found = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p[-5000:][-4000:].lstrip("0")[:5] or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in digits(m[0])][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


ODD = [None, "", "a@b@c.com x@y.z.w,.q@-.-", "1.2.3.4.5 999.1.1.1 01.002.3.4", "4111 1111 1111 1111 and 4111111111111112", "+1 (176) 555-0570. +12 3", "9" * 30000, "1." * 20000, "a" * 30000 + "@", "@" * 500, "+1" * 900,
       "mail er at mail dot com or call (441) 555-3597", 'token = "5c4a26e9bd0c2c2e356de5663481732ff8d0ec46"', "é💳 4111-1111-1111-1111\n", "0" * 5000 + ".0.0.0", "12-34 " * 3000]


def test_pii_base_spans(spark):
    texts = documents(spark, "/root/testdata/sf0.01")
    for r in op7_pii(spark, "/root/testdata/sf0.01").collect():
        want = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [sum(w.startswith(k + ":") for w in want) for k in pii.KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert set(want) <= set(filter(None, r.spans.split(",")))
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(ODD)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for i, t in enumerate(ODD):
        if t is None or len(t) < 10000:
            assert got[i].base_sha256 == hashlib.sha256(",".join(plain_base(t)).encode()).hexdigest()
    assert "email:5:23" in got[11].spans and "phone:32:46" in got[11].spans and got[12].spans == "secret:9:49"
    assert pii.find(docs.limit(0)).collect() == []


def test_pii_field_on_held_out_sentences():
    field, right, made, wrong = pii.trained(), 0, 0, 0
    for text, spans in pii.sentences(200, 77):
        got = {s for w in pii.windows(text) for s in field.decode(w)}
        made, right, wrong = made + len(spans), right + len(got & set(spans)), wrong + len(got - set(spans))
    assert right > 0.95 * made and wrong < 0.03 * made


ODD_TOKENS = "it's DON'T 'Sx <|endoftext|>hello x<|startoftext|>y <|x É́é ﬁ İstanbul ΣΑΣ ²½ª ſ ŉ \x85a\xa0b   c\x1cd\x00 e\u200bf 漢字 १२ \"'s .'s ''s 'Door we'LL they'vet 'l 'r <|startoftext|> "


def test_ids_of_any_text_are_the_tokenisers():
    from hypothesis import given, settings, strategies as st

    encoder, tk = Encoder(open(vocabulary(), "rb").read()), Tokenizer.from_file(vocabulary())
    alphabet = st.one_of(st.sampled_from(list("aAbz'sStTmMdDlLrReEvV019 .,!?-é\n\t<|²İßſ\xa0\xad")), st.characters(codec="utf-8"))

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet, max_size=60), min_size=1, max_size=6))
    def check(texts):
        ids, n = encoder([t.encode() for t in texts])
        edge = np.concatenate(([0], np.cumsum(n)))
        for t, a, b in zip(texts, edge[:-1], edge[1:], strict=True):
            assert ids[a:b].tolist() == tk.encode(t, add_special_tokens=False).ids

    check()
    spec = json.loads(tk.to_str())
    spec["normalizer"]["normalizers"].pop()
    other = json.dumps(spec)
    assert not drops_space(spec) and Encoder(other.encode())(["A b".encode(), b""])[0].tolist() == Tokenizer.from_str(other).encode("A b", add_special_tokens=False).ids


def test_tokens_round_trip(spark):
    tk = Tokenizer.from_file(vocabulary())
    rows = [(i, t) for i, t in documents(spark).items()] + [(-5, None), (10**6, ""), (10**6 + 1, "é ß  x <|endoftext|> İ" * 30), (10**6 + 2, "a" * 9000)]
    want, at = {}, 0
    for i, t in sorted(rows):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int").repartition(5)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.round_trip(docs, vocabulary()).collect()}
    assert got == want
    twice = tokens.round_trip(docs.unionByName(docs), vocabulary()).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in twice) == sorted((i, *v[1:]) for i, v in want.items() for _ in (0, 1))
    assert sorted(r.start for r in twice) == sorted(np.cumsum([0, *(want[i][1] for i in sorted(want) for _ in (0, 1))])[:-1].tolist())
    nameless = spark.createDataFrame([(None, "b b"), (None, "a"), (3, "c")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.start, r.n_tokens) for r in tokens.round_trip(nameless, vocabulary()).collect()) == [(False, 5, 2), (True, 0, 2), (True, 2, 3)]
    assert tokens.round_trip(docs.limit(0), vocabulary()).collect() == []
    assert op8_token_planes(spark, SF).count() == 200


def test_images_of_any_ids():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, np.uint32), np.array([2], np.uint32), rng.integers(0, 2**32, 200_001, dtype=np.uint32), np.full(70_000, 2**32 - 1, np.uint32)):
        d, n, back = tokens.decode_image(tokens.encode_image([None, -(1 << 63)], [0, len(ids)], ids))
        assert (back == ids).all() and d.to_pylist() == [None, -(1 << 63)] and n.tolist() == [0, len(ids)]


def test_decontamination_finds_what_contains_finds_and_edited_passages(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
        docs = documents(spark, sf)
        want = {(d, i) for i, t in items for d, x in docs.items() if t in x}
        got = op9_decontaminate(spark, sf).collect()
        assert want and want <= {(r.doc_id, r.item_id) for r in got}
        # nothing else, but for near copies of the holders
        assert all(r.edits <= decontaminate.budget(r.item_chars) for r in got)


def semi_global(item, text):
    """The least edits of item against any part of text, cell by cell of each row."""
    item, at = np.frombuffer(item, np.uint8), np.arange(len(item) + 1)
    row, best = at, len(item)
    for c in text:
        row = np.minimum.accumulate(np.concatenate(([0], np.minimum(row[:-1] + (item != c), row[1:] + 1))) - at) + at
        best = min(best, int(row[-1]))
    return best


def test_lemma_loses_no_occurrence_within_the_budget(spark):
    rng = np.random.default_rng(5)
    letter = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    items = [(i, letter(rng.integers(40, 260))) for i in range(40)] + [(98, None), (97, "")]
    index = decontaminate.Index([(i, (t or "").encode()) for i, t in items])
    texts, want = [], set()
    for k, (i, t) in enumerate(items[:40] * 3):
        edits = int(rng.integers(0, decontaminate.budget(len(t)) + 4))
        chars = list(t)
        for _ in range(edits):
            p = int(rng.integers(0, len(chars)))
            match rng.integers(0, 3):
                case 0: chars[p] = letter(1)
                case 1: del chars[p]
                case _: chars.insert(p, letter(1))
        texts.append((letter(rng.integers(0, 300)) + "".join(chars) + letter(rng.integers(0, 300))).encode())
        if semi_global(t.encode(), texts[-1]) <= decontaminate.budget(len(t)):
            want.add((k, i))
    got = {(k, index.ids[i]) for k, i, *_ in index.matches(texts)}
    assert got == want
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, texts[0].decode(), 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id) for r in decontaminate.contaminated(docs, bench).collect()} <= {3}
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == [] and decontaminate.clean(docs.limit(0), bench).collect() == []


def test_long_items_are_found_whole_or_not_at_all(spark):
    rng = np.random.default_rng(8)
    letter = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))

    def edited(text, edits, low, high):
        chars = list(text)
        for _ in range(edits):
            at = int(rng.integers(low, min(high, len(chars))))
            match rng.integers(0, 3):
                case 0: chars[at] = letter(1)
                case 1: del chars[at]
                case _: chars.insert(at, letter(1))
        return "".join(chars)

    items, rest = [letter(2048), letter(2500), letter(3071), letter(10_240)], lambda: letter(int(rng.integers(0, 400)))
    cases = [(i, part) for i, t in enumerate(items) for part in (t[1024:2048], t[: len(t) // 2], t[len(t) // 8 :], t[: -len(t) // 8], t, t[50:], t[:-50])]
    # edits all over, at one place, within the budget and just beyond
    cases += [(i, edited(t, int(n * decontaminate.budget(len(t))), low, high)) for i, t in enumerate(items) for n in (0.3, 0.9, 1.2) for low, high in ((0, len(t)), (1024, 1500))]
    texts = [(rest() + part + rest()).encode() for _, part in cases] + [b"", b"x", (items[0] + items[1]).encode(), (items[0] + letter(90) + items[0]).encode()]
    index = decontaminate.Index([(i, t.encode()) for i, t in enumerate(items)])
    got = {}
    for k, of, e, a, b in index.matches(texts):
        got[k, of] = min(got.get((k, of), (e, a, b)), (e, a, b))
    for k, text in enumerate(texts):
        for i, t in enumerate(items[:3] if k >= len(cases) else [items[cases[k][0]]]):
            i = i if k >= len(cases) else cases[k][0]
            limit = decontaminate.budget(len(t))
            # rows are whole-text alignments; the 10 kB item is only held against what its cases say
            best = semi_global(t.encode(), text) if len(t) < 2100 else None
            found = got.get((k, i))
            if best is not None:
                assert (found[0] if found else None) == (best if best <= limit else None), (k, i, best, limit)
            if found:
                assert found[0] <= limit and (best is None or semi_global(t.encode(), text[found[1] : found[2]]) == best)
    tenth = next(k for k, (i, part) in enumerate(cases) if i == 3 and part == items[3][1024:2048])
    assert (tenth, 3) not in got and got[cases.index((3, items[3])), 3][0] == 0 and 0 < got[cases.index((3, items[3][50:])), 3][0] <= 50
    docs = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, bench).collect()} == {(k, i, v[0]) for (k, i), v in got.items()}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == set(range(len(texts))) - {k for k, _ in got}


def test_short_items_long_items_many_sets_and_rows_without_id(spark, monkeypatch):
    rng = np.random.default_rng(3)
    long = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(6_000))  # over 40,000 normalised bytes
    items = [(1, "What is the capital of Australia?"), (2, "yes."), (3, "What is the capital of Australia?"), (4, "..."), (5, long)]
    texts = ["he asked: what is the CAPITAL, of Australia? no", "eyes yesterday", "Yes", "what is the capital of Austria", "x " + long[:20_000] + long[20_008:] + " y", ""]
    index = decontaminate.Index([(i, t.encode()) for i, t in items])
    found = lambda: {(t, index.ids[i], e) for t, i, e, *_ in index.matches([x.encode() for x in texts])}
    want = {(0, 1, 0), (0, 3, 0), (2, 2, 0), (4, 5, len(long[20_000:20_008].replace(" ", "")))}
    assert {(t, i) for t, i, _ in found()} == {(t, i) for t, i, _ in want} and want <= found() and max(map(len, (n for _, n in index.items))) <= 2 * decontaminate.LONG
    at = next(m for m in index.matches([texts[0].encode()]))
    assert decontaminate.normal(texts[0].encode())[at[3] : at[4]] == decontaminate.normal(items[0][1].encode())
    monkeypatch.setattr(decontaminate, "HITS", 1000)
    assert {(t, i) for t, i, _ in found()} == {(t, i) for t, i, _ in want}
    monkeypatch.setattr(decontaminate, "INDEX", 40)
    monkeypatch.setattr(decontaminate, "HELD", 50)
    docs = spark.createDataFrame([(None if k % 2 else k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items[:4], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == [(0, 1), (0, 3), (2, 2)]
    again = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    kept = decontaminate.clean(again, bench)
    assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == [1, 1, 3, 3, 4, 4, 5, 5]


def test_items_at_the_start_of_a_document_with_deleted_words():
    rng = np.random.default_rng(11)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))
    items = [" ".join(word() for _ in range(rng.integers(12, 45))) for _ in range(30)]
    index = decontaminate.Index([(i, t.encode()) for i, t in enumerate(items)])
    texts, want = [], set()
    for i, t in enumerate(items):
        words = t.split()
        for gone in (0, 1, len(words) // 2, len(words) - 1):
            for head, tail in (("", ""), ("", " ".join(word() for _ in range(30))), ("q", "")):
                texts.append(" ".join([head, *words[:gone], *words[gone + 1 :], tail]).encode())
                item = decontaminate.normal(t.encode())
                if semi_global(item, decontaminate.normal(texts[-1])) <= decontaminate.budget(len(item)):
                    want.add((len(texts) - 1, i))
    got = list(index.matches(texts))
    assert want <= {g[:2] for g in got} and len(want) > 200
    for t, i, edits, start, end in got:
        item, text = (decontaminate.normal(x) for x in (items[i].encode(), texts[t]))
        assert 0 <= start <= end <= len(text) and semi_global(item, text) <= edits <= decontaminate.budget(len(item))


def test_pii_spans_across_the_ends_of_pieces():
    field, line = pii.trained(), "mail er at mail dot com or call (441) 555-3597\n"
    short = pii.all_spans(line, field)[1]
    assert [s[2] for s in short] == ["email", "phone"]
    for n in range(pii.PIECE - 22, pii.PIECE + 2):
        head = "7\n" * (n // 2) + "7 " * (n % 2)
        got = pii.all_spans(head + line + "7\n" * 200, field)[1]
        assert [(a - len(head), b - len(head), k) for a, b, k in got if a >= len(head)] == short, n
