"""Spelling variants, centroid clusters and SimHash components: brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from seqlab.llm import centroids, simhash, spelling


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_words(docs, min_length=7, min_count=2):
    n = Counter()
    for doc_id, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(n, ratio=10):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None)
    return out


def found_variants(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_variants_of_documents_by_brute_force(spark):
    rng = random.Random(11)
    common = ["".join(rng.choice("abàÿz") for _ in range(rng.randint(7, 10))) for _ in range(60)]
    docs = []
    for i in range(120):
        text = " ".join(rng.choice(common[: rng.randint(1, 60)]) for _ in range(60))
        docs.append((i, "".join(rng.choice("abzÀ .") if rng.random() < 0.01 else c.upper() if rng.random() < 0.02 else c for c in text)))
    docs += [(None, common[0] * 2 + " " + common[1]), (500, None), (501, ""), (502, "x" * 30_000 + " " + "x" * 30_000 + " " + "x" * 29_999), (503, "x" * 30_000 + ", " + "x" * 29_999 + "1" + "x" * 29_998 + "y"), (503, "x" * 29_998 + "y"), (1, docs[1][1])]
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    expected = brute_variants(brute_words(docs))
    assert found_variants(spelling.document_variants(d)) == expected
    assert any(f for f, *_ in expected.values())
    assert found_variants(spelling.document_variants(d.where("false"))) == {}


def test_variants_of_counts_by_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("ab€😀") for _ in range(rng.randint(0, 5))) for _ in range(400)}
    n = {w: rng.choice([1, 1, 2, 10, 20, 100, 1000]) for w in words}
    counts = spark.createDataFrame([(w, c, 0) for w, c in n.items()] + [(None, 5, 0)], "word string, n long, id int")
    expected = brute_variants(n)
    assert found_variants(spelling.spelling_variants(counts)) == expected
    assert any(f and f != r for f, r, *_ in expected.values())  # a chain of forms
    with pytest.raises(ValueError):
        spelling.spelling_variants(counts, ratio=1)


def test_words_that_collide_are_compared_as_strings(spark, monkeypatch):
    n = {"abcdefg": 50, "abcdefh": 2, "zzzzzzzzz": 3, "abcdef": 4, "qqqq": 9}
    real = spelling._mixed
    monkeypatch.setattr(spelling, "_mixed", lambda x: real(x) % np.uint64(2))  # for the rows below only, in this process
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(n))), pa.array(list(n))], names=["id", "word"])
    rows = sorted((r for out in spelling._keys([batch]) for r in out.to_pylist()), key=lambda r: r["key"])
    keys = pa.RecordBatch.from_pylist(rows)
    met = [r for out in spelling._met([keys.slice(0, 7), keys.slice(7, 1), keys.slice(8)]) for r in out.to_pylist()]
    assert len({r["key"] for r in met}) == 2
    words = list(n)
    spelled = pa.RecordBatch.from_pylist([r | {"word": words[r["id"]], "n": n[words[r["id"]]]} for r in met])
    pairs = Counter()
    for out in spelling._verify([spelled]):
        for r in out.to_pylist():
            pairs[words[r["id"]]] += r["n_near"]
    assert dict(pairs) == {"abcdefg": 2, "abcdefh": 2, "abcdef": 2}


def brute_lloyd(rows, k=8, rounds=10, scale=1024, dims=64):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    d2 = lambda v, y: sum((a - b) ** 2 for a, b in zip(v, y, strict=True))
    for at in range(rounds + 1):
        own = [min((d2(v, y), j) for j, y in enumerate(c)) for _, v in kept]
        if at < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), o in zip(kept, own, strict=True) if o[1] == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    total, part = sum(d for d, _ in own), Counter()
    for d, j in own:
        part[j] += d
    sha = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted(((i, j, d, part[j], total, sha[j]) for (i, _), (d, j) in zip(kept, own, strict=True)), key=repr)


def clusters(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=repr)


def test_clusters_by_brute_force(spark):
    rng = np.random.default_rng(12)
    middle = rng.normal(size=(5, 64))
    rows = [(i, (middle[i % 5] * (1 if i % 3 else 0.2) + rng.normal(size=64) * 0.05).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 360)] + [(7, rows[7][1]), (None, rows[9][1]), (None, rows[9][1])]  # repeated vectors, ids and nulls
    rows += [(900, None), (901, [1.0]), (902, [None] * 64), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [])]
    d = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    assert clusters(centroids.cluster_vectors(d)) == brute_lloyd(rows)
    few = rows[:3] + [(5, rows[2][1])]
    assert clusters(centroids.cluster_vectors(d.sparkSession.createDataFrame(few, "vec_id long, embedding array<double>"))) == brute_lloyd(few)
    assert clusters(centroids.cluster_vectors(d.where("vec_id >= 900"))) == []
    with pytest.raises(Exception, match="exact 64-bit"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("k", [1, 2, 40])
def test_nearest_by_brute_force_over_blocks_and_trees(k):
    rng = np.random.default_rng(k)
    middle = rng.integers(-500, 500, (20, 3))
    points = np.concatenate([middle[rng.integers(0, 20, 700)] + rng.integers(-9, 10, (700, 3)), np.repeat(middle[:1], 50, axis=0)])
    c = np.concatenate([middle, middle])[:k] if k > 2 else middle[:k]  # every centroid twice: ties
    tree, over = centroids.cover_tree(points, leaf=8), centroids.cover_tree(c, leaf=1)
    d2 = ((points[:, None] - c[None]) ** 2).sum(axis=2)
    found = centroids.nearest(points, tree, c, over)
    cluster, distance = np.full(len(points), -1), np.full(len(points), -1)
    for nodes, numbers in found.nodes:
        for q, j in zip(nodes, numbers, strict=True):
            at = tree.order[tree.lo[q] : tree.hi[q]]
            cluster[at], distance[at] = j, d2[at, j]
    for place, numbers, least in found.vectors:
        cluster[tree.order[place]], distance[tree.order[place]] = numbers, least
    assert (cluster == d2.argmin(axis=1)).all() and (distance == d2.min(axis=1)).all()
    if k == 40:
        assert found.computed < d2.size / 2  # node pairs were left


def test_cover_tree_invariants():
    points = np.random.default_rng(3).integers(-1000, 1000, (500, 4))
    tree = centroids.cover_tree(points, leaf=4)
    assert sorted(tree.order.tolist()) == list(range(500))
    for q in range(len(tree.center)):
        members = tree.order[tree.lo[q] : tree.hi[q]]
        gap = np.sqrt(((points[members] - points[tree.center[q]]) ** 2).sum(axis=1))
        assert tree.center[q] in members and np.isclose(gap.max(), tree.radius[q])
        kids = range(tree.first[q], tree.first[q] + tree.kids[q])
        if kids:
            assert tree.center[kids[0]] == tree.center[q]
            assert np.concatenate([tree.order[tree.lo[x] : tree.hi[x]] for x in kids]).tolist() == members.tolist()
            reach = centroids.BASE ** (np.ceil(np.log(tree.radius[q]) / np.log(centroids.BASE)) - 1)
            middle = points[tree.center[list(kids)]]
            apart = np.sqrt(((middle[:, None] - middle[None]) ** 2).sum(axis=2))[np.triu_indices(len(kids), 1)]
            assert (apart > reach).all() and (tree.radius[list(kids)] <= reach + 1e-9).all()


def brute_print(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", lower(text)) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, budget=4):
    of = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= budget:
                a, b = of[i], of[j]
                of = [min(a, b) if x in (a, b) else x for x in of]
    return of


def test_simhash_by_brute_force(spark):
    rng = random.Random(13)
    text = lambda n: rng.choice([" ", "\t", "\n\n"]).join(rng.choice(["Ab", "é", "c", "d'", "E5", " x"]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(150)]
    for i in range(150, 260):
        words = docs[rng.randrange(len(docs))][1].split(" ")
        words[rng.randrange(len(words))] = "c"
        docs.append((i, " ".join(words)))
    long = [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randint(0, 99)) for _ in range(600)]
    docs += [(i, " ".join([*long[: i - 300], "x", *long[i - 300 :]])) for i in range(300, 330)]  # near copies
    docs += [(-5, docs[3][1]), (None, docs[4][1]), (None, None), (400, ""), (401, " \n"), (402, text(60_000)), (3, docs[3][1])]
    rng.shuffle(docs)
    d = spark.createDataFrame([(i, t, "a", 0) for i, t in docs], "doc_id long, text string, bits string, component_id int").repartition(3)
    prints = [brute_print(t) for _, t in docs]
    of = brute_components(prints)
    least = {}
    for (i, _), c in zip(docs, of, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    expected = sorted(((i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(docs, prints, of, strict=True)), key=repr)
    for bounds in ({}, {"most": 3, "block": 2}):
        got = simhash.simhash_components(d, **bounds).collect()
        assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == expected
    assert len(set(of)) < len({p for p in prints})  # some different fingerprints are linked
    assert simhash.simhash_components(d.where("false")).collect() == []


@pytest.mark.parametrize("budget", [1, 4, 7])
def test_trie_join_by_brute_force(budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)
    values = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(4)] + [rng.integers(0, 2**64, 100, dtype=np.uint64)])
    for _ in range(3):
        values = np.concatenate([values, values[:90] ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64))])
    values = np.unique(values)
    links = np.bitwise_count(values[:, None] ^ values[None]) <= budget
    of = np.arange(len(values))
    while not np.array_equal(new := np.array([of[x].min() for x in links]), of):
        of = new
    tries = simhash.Tries(values, budget)
    tries.join(np.array([[0, len(values), 0, len(values)]]))
    assert np.array_equal(tries.root, of)
    half = len(values) // 2  # two sides: links across alone
    tries = simhash.Tries(np.concatenate([np.sort(values[::2]), np.sort(values[1::2])]), budget)
    n = len(values[::2])
    tries.join(np.array([[0, n, n, len(values)]]))
    across = np.bitwise_count(tries.values[:n, None] ^ tries.values[None, n:]) <= budget
    edges = {(i, n + j) for i, j in zip(*np.nonzero(across), strict=True)}
    assert half and all(tries.root[i] == tries.root[j] for i, j in edges)
    assert len(set(tries.root.tolist())) == len(values) - np.linalg.matrix_rank(_incidence(edges, len(values)))


def _incidence(edges, n):
    out = np.zeros((max(1, len(edges)), n))
    for row, (i, j) in enumerate(edges):
        out[row, i], out[row, j] = 1, -1
    return out


def test_fingerprint_of_few_words_and_of_ties():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t\r\n\x0b\x0c") == 0
    assert simhash.fingerprint("Ab c") == xxhash.xxh64_intdigest(b"ab c", 42) == brute_print("ab  c")
    assert simhash.fingerprint("a b c d e") == brute_print("a b c d e")  # two shingles: a bit needs both
