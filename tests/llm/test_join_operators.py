"""Decontamination, top-k, near duplicates, WARC and the pipeline: brute force and edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.llm import common, decontamination, near_dup, topk, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def brute_contamination(docs, items):
    out = {}
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(13, len(v))
            if item_id is None or not n:
                continue
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(item_id)
        ids = ",".join(sorted(map(str, found)))
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("bound", [200_000, 0])
def test_decontamination_by_brute_force(spark, bound):
    rng, v = random.Random(3), vocabulary(30, 3)
    text = lambda n: " ".join(rng.choice(v) for _ in range(n))
    items = [(1, text(30)), (2, text(13)), (3, "One, É-two K"), (4, ""), (5, None), (None, text(20)), (10, text(20)), (11, None)]
    items[7] = (11, items[0][1])  # a repeated item
    docs = [(i, text(60)) for i in range(5)]
    docs += [(5, f"{text(9)}, {''.join(c.upper() if c.isascii() else c for c in items[0][1])}. {text(5)}"), (6, f"{text(200)} {items[1][1]} {text(900)}"), (7, "x one é TWO k one é two K y"), (8, ""), (9, None), (10, f"{items[6][1]} {items[6][1]}"), (11, text(30_000)), (12, "ONE É two k"), (13, "one é two K")]
    d = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in docs], "doc_id long, text string, w string, row_key int, item_ids string")
    b = spark.createDataFrame([(i, t, "a") for i, t in items], "item_id long, text string, window string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontamination.decontaminate(d, b, max_broadcast_rows=bound).collect()}
    assert got == brute_contamination(docs, items)
    assert got[5][4] and not got[6][4]


def test_decontamination_edges(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontamination.decontaminate(d, none).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"])) for r in rows) == ["(1, 2, 0)", "(2, 0, 0)", "(None, 1, 0)"]
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontamination.decontaminate(d.where("false"), items).count() == 0


def test_beyond_the_bound_no_key_has_a_row_for_every_document(spark, monkeypatch):
    """Without a broadcast no end of a document goes to one task, and words are counted before they are shuffled."""
    d = spark.createDataFrame([(i, "x y z") for i in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "y")], "item_id long, text string")
    written = []
    monkeypatch.setattr(decontamination, "saved", lambda df, tag: written.append((tag, df)) or common.saved(df, tag))
    rows = decontamination.decontaminate(d, items, max_broadcast_rows=0).collect()
    assert len(rows) == 50 and all((r["n_words"], r["n_hit"]) == (3, 1) for r in rows)
    prefixes = dict(written)["prefixes"]
    assert [(r["window"], r["key"]) for r in prefixes.collect()] == [("y", "y")]


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 1000) for i in range(20)], "a long, b string")
    assert common.broadcast_if_small(df, 20)[1] and not common.broadcast_if_small(df, 19)[1]
    assert not common.broadcast_if_small(df, 20, max_bytes=20_000)[1]
    assert common.broadcast_if_small(df.where("false"), 0)[1]


def test_decontamination_runs_no_python(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    plan = decontamination.decontaminate(d, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_top(rows, queries, k):
    out = []
    for q, qv in queries.items():
        scores = sorted((-int(np.dot(np.array(qv), np.array(v))), i) for i, v in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [dict(), dict(block_rows=7, query_rows=3, query_blocks=2)])
def test_top_k_by_brute_force(spark, sizes):
    rng = random.Random(5)
    rows = [(i, [rng.randint(-3, 3) if rng.random() < 0.7 else 0 for _ in range(8)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(20)] + [(200, [0] * 8)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows] + [(300, None, 1, "x"), (None, [1] * 8, 1, "x"), (301, [None] * 8, 1, "x")], "vec_id long, weights array<long>, rank int, query_id string")
    queries = {i: v for i, v in rows if i % 10 == 0}
    got = topk.top_k(table, table.where("vec_id % 10 = 0"), k=4, **sizes)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, queries, 4)
    twice = table.where("vec_id < 3").union(table.where("vec_id < 3"))  # repeated candidates are candidates each; a query is answered once
    assert sorted((r["query_id"], r["vec_id"]) for r in topk.top_k(twice, twice.where("vec_id = 0"), k=9).collect()) == [(0, 1), (0, 1), (0, 2), (0, 2)]
    few = topk.top_k(table.where("vec_id < 3"), table.where("vec_id = 0"), k=5)
    assert few.count() == 2
    assert topk.top_k(table.where("false"), table, k=5).count() == 0
    assert topk.top_k(table, table.where("false"), k=5).count() == 0


def test_quantized(spark):
    rows = [(0, [0.5, -0.001, 0.0]), (1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf")]), (5, [])]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, v array<float>").select("i", topk.quantized(F.col("v"))).collect()}
    assert got == {0: [128, -1, 0], 1: None, 2: None, 3: None, 4: None, 5: []}


def brute_near(docs, t=0.8):
    sets = {}
    for i, text in docs:
        w = words(text)
        sets[i] = frozenset(tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)) if w else None
    distinct = list({s for s in sets.values() if s})
    linked = {s: [u for u in distinct if u != s and len(s & u) / len(s | u) >= t] for s in distinct}
    of = {s: [i for i, x in sets.items() if x == s] for s in distinct}
    out = {}
    for i, s in sets.items():
        if not s:
            out[i] = (i, i, 1, 0)
            continue
        seen, todo = {s}, [s]
        while todo:
            for u in linked[todo.pop()]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        out[i] = (min(of[s]), min(min(of[u]) for u in seen), len(of[s]), len(linked[s]))
    return out


@pytest.mark.parametrize(("block", "bound"), [(256, 200_000), (4, 0)])
def test_near_duplicates_by_brute_force(spark, block, bound):
    rng, v = random.Random(9), vocabulary(200, 9)
    docs = []
    for group in range(12):
        base = [rng.choice(v) for _ in range(rng.choice([4, 12, 60, 150]))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(v)
            docs.append((len(docs) * 3 + 1, " ".join(w)))
    docs += [(9000, ""), (9001, None), (9002, "..."), (9003, docs[0][1].upper()), (9004, "one"), (9005, "One!"), (9006, "x " * 40_000)]
    table = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in docs], "doc_id long, text string, id string, n int, comp string")
    got = {r["doc_id"]: (r["rep_id"], r["class_id"], r["n_copies"], r["n_links"]) for r in near_dup.near_duplicates(table, block=block, max_broadcast_rows=bound).collect()}
    assert got == brute_near(docs)


def test_near_duplicates_edges(spark):
    table = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q r s t u v")], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["rep_id"], r["class_id"], r["n_copies"], r["n_links"]) for r in near_dup.near_duplicates(table).collect()), key=str)
    assert rows == sorted([(1, 1, 1, 2, 0), (1, 1, 1, 2, 0), (2, 2, 2, 1, 0), (None, None, None, 1, 0)], key=str)
    assert near_dup.near_duplicates(table.where("false")).count() == 0


def test_rows_of_a_large_component_grow_in_proportion(spark):
    """A member of one component is dealt to about sixteen blocks, however many there are."""
    dealt = []
    for n in (1, 60, 5_000, 10_000, 20_000):
        rows = spark.range(n).withColumn("n", F.lit(n)).withColumn("total", F.lit(200 * n))
        per = near_dup.members_per_block(F.col("n"), F.col("total"), 256)
        dealt.append(near_dup._block_pairs(rows, "n", per).count() / n)
    assert dealt[:2] == [1, 1] and all(15 <= x <= 17 for x in dealt[2:])
    long = spark.range(1).select(near_dup.members_per_block(F.lit(5_000), F.lit(5_000 * 100_000), 256).alias("x")).first()["x"]
    assert long * 100_000 * 8 <= near_dup.BLOCK_BYTES


def test_large_buckets_are_compared_in_chunks():
    rng = np.random.default_rng(1)
    sizes, side = rng.integers(50, 60, 70), np.arange(70) % 3 == 0
    for other in (False, True):
        got = [p for a, b in near_dup._candidates(sizes, side, other, 0.9, chunk=8) for p in zip(a.tolist(), b.tolist(), strict=True)]
        pairs = [(i, j) for i in range(70) for j in range(70) if (not side[i] and side[j] if other else i < j)]
        assert sorted(got) == sorted((i, j) for i, j in pairs if min(sizes[i], sizes[j]) >= 0.9 * max(sizes[i], sizes[j]) - 1e-9)


def test_posterior_bound():
    least = near_dup.least_matches(0.8, 1e-6)
    assert len(least) == 8 and all(a < b for a, b in zip(least, least[1:], strict=False))
    rng = np.random.default_rng(0)
    n = np.arange(16, 129, 16)
    lost = sum(any((rng.random(128) < 0.8).cumsum()[n - 1] < least) for _ in range(2000))
    assert lost == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 60), (70, 60), (80, 80)]
    got = {r["id"]: r["comp"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 60: 50, 70: 50, 80: 80}
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>é</p>" * 200, "x" * 1500
    pages = [(1, "http://a.example.com/x?q=1", big), (2, "http://b.example.com", big), (9, "http://c.example.com/é \r\nX: y", big), (3, "", "short"), (4, None, "short"), (5, "http://[bad", None), (6, "http://a.example.com/x?q=1", other), (6, "http://a.example.com/x?q=1", other), (7, "http://a.example.com/x?q=1", other), (None, "http://n", "n"), (None, "http://n", big), (None, None, "y" * 1200), (None, "http://n", "y" * 1200)]
    table = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in pages], "page_id long, url string, html string, refers_to string, n int")
    folder = f"file://{tmp_path}/warc"
    captures = warc.write_archives(table, folder)
    directory = warc.write_index(captures, folder, block_lines=2)
    assert directory.count() >= 4
    rows = warc.read_all(directory).collect()
    unnamed = sorted((r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in rows if r["page_id"] is None)
    assert unnamed == [(1, "response", "None"), (1200, "response", "None"), (1200, "response", "None"), (len(big.encode()), "revisit", "9")]
    rows = [r for r in rows if r["page_id"] is not None]
    html = {i: (h or "").encode() for i, _, h in pages if i is not None}
    refers = {1: 9, 2: 9, 6: 7}
    assert sorted(r["page_id"] for r in rows) == sorted(i for i, _, _ in pages if i is not None)
    for r in rows:
        data = html[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert r["refers_to"] == refers.get(r["page_id"])
        assert r["record_type"] == ("revisit" if r["page_id"] in refers else "response")
        assert (bytes(r["payload"]) if r["payload"] is not None else None) == (None if r["page_id"] in refers else data)
    asked = spark.createDataFrame([("http://a.example.com/x?q=1",), ("http://a.example.com/x?q=1",), ("http://none.example.com/",), (None,)], "url string")
    found = warc.lookup(directory, asked)
    there = ["1", "3", "4", "6", "6", "7", "None"]  # the page without a page_id has no URL either
    assert sorted(str(r["page_id"]) for r in found.collect()) == there
    assert sorted(str(r["page_id"]) for r in warc.read_captures(found).collect()) == there
    none = warc.write_index(warc.write_archives(table.where("false"), folder), folder)
    assert warc.read_all(none).count() == 0


def test_url_key():
    assert warc.url_key("http://www.Example.com:8080/a?b") == "com,example,www:8080)/a?b"
    assert warc.url_key("https://example.com:443") == "com,example)/"


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng, v = random.Random(2), vocabulary(400, 2)
    text = lambda n: " ".join(rng.choice(v) for _ in range(n))
    item = text(40)
    clean = [(i, text(60)) for i in range(30)]
    toxic = [(100 + i, f"{text(20)} you idiot {text(20)} stupid moron") for i in range(5)]
    copies = [(200 + i, clean[3][1]) for i in range(3)] + [(210, clean[4][1].rsplit(" ", 1)[0] + " other")]
    dirty = [(300, f"{text(20)} {item} {text(10)}")]
    rows = [(i, t, "en", "s", len(t)) for i, t in clean + toxic + copies + dirty] + [(400, "", "en", "s", 0)]
    rows += [(3, clean[3][1], "en", "s", 1), (5, f"{text(20)} {item}", "en", "s", 1), (None, clean[6][1], "en", "s", 1), (None, f"x {item}", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == [*range(30), 400]
    from seqlab.llm.encoder import default_path, tokenizer

    of = dict(clean) | {400: ""}
    for r in out:
        ids = tokenizer(default_path()).encode(of[r["doc_id"]], add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE"]


def test_pipeline_stages_one_by_one(spark, tmp_path):
    """Each stage by brute force on its own input; all but the last keep the columns of documents."""
    import corpus_pipeline

    line = "a line of more than forty characters that many documents hold"
    rows = [(i, f"own text number {i} {'x' * i}\n{line}", "en", "s", 0) for i in range(6)] + [(6, None, None, None, None), (None, line, "en", "s", 5)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, columns)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "own text number 3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
    toxic = docs.union(spark.createDataFrame([(9, "you idiot", "en", "s", 9)], columns))
    assert stages["toxicity"](spark, toxic, str(tmp_path)).count() == len(rows)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["line dedup"](spark, docs, str(tmp_path)).collect()}
    for i, text, *_ in rows[:5]:
        assert got[i] == (text.split("\n")[0], len(text.split("\n")[0]))
    assert got[5][0] == rows[5][1] and got[6] == (None, None) and got[None] == ("", 0)
    left = sorted(str(r["doc_id"]) for r in stages["benchmark decontamination"](spark, docs, str(tmp_path)).collect())
    assert left == sorted(map(str, [0, 1, 2, 4, 5, 6, None]))
