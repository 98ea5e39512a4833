"""Token counts, token files, BPE, license scans, line dedup: brute force, round trips and edge cases."""

import hashlib
import io
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from seqlab.llm import bpe, common, licenses, line_dedup, token_counts, token_files
from seqlab.llm.queries import QUERIES
from seqlab.llm.encoder import PieceEncoder, default_path, id_to_piece, tokenizer

TEXTS = [
    "the cat sat on the mat",
    "",
    None,
    "the cat sat on the mat",
    "  two  spaces\n\nand\tlines \n end ",
    "naïve café 中文 😀 x<|endoftext|> y",
    " lead",
    "a" * 5000,
    "word " * 3000,
    "it's, \"quoted\"... don't\r\nstop\x1c \x85\xa0z",
]


def documents(spark, texts=TEXTS, ids=None):
    """Documents with more columns, whose names clash with those of results."""
    rows = [(ids[i] if ids else i, t, "n_tokens", i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, row_key int, drops string")


def expected_ids(text):
    return tokenizer(default_path()).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "b1", "é", "'s", "<|endoftext|>", "...", "中", "\xa0", " ", " the"]), max_size=12).map("".join), max_size=4))
def test_pieces_encode_as_whole_texts(texts):
    for text, ids in zip(texts, PieceEncoder(default_path(), limit=3).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == expected_ids(text)


def test_only_tokenizers_that_may_be_cut_at_spaces_are_taken(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.loads(tokenizer(default_path()).to_str())
    for name, change in {"prefix": {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, "lower": {"normalizer": {"type": "Lowercase"}}, "strip": {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}}.items():
        (tmp_path / name).write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="byte-level"):
            tokenizer(str(tmp_path / name))


def test_bpe_matches_the_library(spark):
    docs = documents(spark)
    for size in (1 << 22, 50):
        rows = {r["doc_id"]: r for r in bpe.encode_decode(docs, block_words=size).collect()}
        assert len(rows) == len(TEXTS)
        for i, text in enumerate(TEXTS):
            ids = expected_ids(text)
            decoded = tokenizer(default_path()).decode(ids, skip_special_tokens=False)
            assert rows[i]["n_tokens"] == len(ids)
            assert bytes(rows[i]["ids"]) == np.array(ids, "<u4").tobytes()
            assert rows[i]["decoded"] == decoded == (text or "")
            assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert rows[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_of_repeated_rows_null_ids_and_no_rows(spark):
    docs = documents(spark, ["x y", "x y", "z"], ids=[7, 7, None])
    assert sorted(str(r["doc_id"]) for r in bpe.encode_decode(docs).collect()) == ["7", "7", "None"]
    assert bpe.encode_decode(docs.where("false")).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    docs = documents(spark)
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/ids", end_id=2, frame_bytes=64)
    rows = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, text in zip(rows, TEXTS, strict=True):
        ids = np.array([*expected_ids(text), 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    wanted = spark.createDataFrame([(4,), (8,), (99,)], "doc_id long")
    got = {r["doc_id"]: r["ids"] for r in token_files.fetch_tokens(manifest, wanted).collect()}
    assert got == {4: [*expected_ids(TEXTS[4]), 2], 8: [*expected_ids(TEXTS[8]), 2]}


def test_token_files_edges(spark, tmp_path):
    none = token_files.write_token_files(documents(spark).where("false"), f"file://{tmp_path}/none")
    assert token_files.read_token_files(none).count() == 0
    twice = token_files.write_token_files(documents(spark, ["b", "a", "c"], ids=[5, 5, None]), f"file://{tmp_path}/twice")
    rows = sorted(token_files.read_token_files(twice).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 5, 5] and [r["start"] for r in rows] == [0, 2, 4]
    got = token_files.fetch_tokens(twice, spark.createDataFrame([(5,), (None,), (6,)], "doc_id long")).collect()
    assert sorted(r["ids"] for r in got) == sorted([*expected_ids(t), 2] for t in "ba")


def test_token_files_with_many_null_ids(spark, tmp_path):
    docs = documents(spark, [str(i) for i in range(60)], ids=[None] * 30 + list(range(30))).repartition(7)
    rows = sorted(token_files.read_token_files(token_files.write_token_files(docs, str(tmp_path / "nulls"))).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None] * 30 + list(range(30))
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()


def test_shared_folder_with_and_without_a_scheme(spark, tmp_path):
    assert common.qualified(spark, f"{tmp_path}/x") == common.qualified(spark, f"file:{tmp_path}/x") == common.qualified(spark, f"file://{tmp_path}/x") == f"file://{tmp_path}/x"
    docs = documents(spark, ["a"])
    for folder in (f"{tmp_path}/plain", f"file://{tmp_path}/uri"):
        manifest = token_files.write_token_files(docs, folder)
        assert manifest.first()["file"].startswith("file:///") and token_files.read_token_files(manifest).count() == 1
    path = common.scratch(spark, "test")
    spark.range(3).write.parquet(path)
    common.discard(spark, [path, "file:///not/made/here"])
    assert path not in common.scratch_paths()
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_a_damaged_frame_is_found_and_only_wanted_frames_are_read():
    sink = io.BytesIO()
    sink.close, real = (lambda: None), sink.close
    writer = token_files.TokenFileWriter(sink, frame_bytes=400)
    for i in range(50):
        writer.add(i, np.arange(i, dtype="<u4").tobytes())
    writer.close()
    data = bytearray(sink.getvalue())
    reader = token_files.TokenFileReader(io.BytesIO(bytes(data)))
    assert len(reader.frames) > 5
    assert [len(x) // 4 for _, x in reader.rows()] == list(range(50))
    data[3] ^= 0xFF
    damaged = token_files.TokenFileReader(io.BytesIO(bytes(data)))
    assert [(i, len(x)) for i, x in damaged.rows([49])] == [(49, 49 * 4)]
    with pytest.raises(Exception):
        list(damaged.rows())
    real()


def brute_sections(text, bounds, rule):
    pieces = [id_to_piece(default_path())[i] for i in expected_ids(text)]
    at, spans = 0, []
    for p in pieces:
        spans.append((at, at + len(p)))
        at += len(p)
    out = []
    for a, b in bounds:
        a, b = (len((text or "")[:x].encode()) for x in (max(a, 0), max(b, 0)))
        n = 0.0
        for s, e in spans:
            if a < b:
                point = {"first": s, "last": e - 1, "most": (s + e - 1) // 2}.get(rule)
                n += (a <= point < b) if point is not None else max(0, min(b, e) - max(a, s)) / (e - s)
        cross = sum(1 for s, e in spans if a < b and (s < a < e or s < b < e))
        out.append((n, cross))
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens_by_brute_force(spark, rule):
    docs = documents(spark)
    bounds = [(0, 3), (2, 9), (9, 9), (8, 2), (5, 10_000)]
    sections = spark.createDataFrame([(i, a, b, "x") for i in range(len(TEXTS)) for a, b in bounds] + [(0, None, 4, "x")], "doc_id long, start long, stop long, text string")
    rows = token_counts.section_tokens(docs, sections, rule=rule).collect()
    assert len(rows) == len(TEXTS) * len(bounds)
    for r in rows:
        (n, cross), = brute_sections(TEXTS[r["doc_id"]], [(r["start"], r["stop"])], rule)
        assert r["n_tokens"] == pytest.approx(n), r
        assert r["n_crossing"] == cross, r


def test_lines_hold_every_token(spark):
    rows = token_counts.section_tokens(documents(spark)).collect()
    for i, text in enumerate(TEXTS):
        mine = [r for r in rows if r["doc_id"] == i]
        assert len(mine) == (text or "").count("\n") + 1
        assert sum(r["n_tokens"] for r in mine) == len(expected_ids(text)) == mine[0]["doc_tokens"]
    assert token_counts.section_tokens(documents(spark).where("false")).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_base(text):
    words = WORD.findall(lower(text))
    return len(words), sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def test_license_scan_by_brute_force(spark):
    texts = [
        *TEXTS,
        "Released UNDER the MIT-License. under the mit license, Apache License; Version 2.0 É",
        "cc by nc cc-by-nc 4.0 cc by nc sa",
        "This work is licensed under the GNU General Public License, version 3.",
        "sunder the mit license apache license version 20",
        "under the mit license " * 500,
    ]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        n, base = brute_base(text)
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1
    assert rows[len(TEXTS) + 2]["labels"] == "gpl-3"
    found = rows[len(TEXTS) + 2]["detections"]
    assert [(x["first_word"], x["n_words"]) for x in found] == [(3, 9)]
    assert len({x[2] for x in licenses.SIGNATURES}) == len(licenses.SIGNATURES) >= 200
    assert licenses.scan_licenses(documents(spark).where("false")).count() == 0


def shortest(nodes):
    """Texts that match a parsed regex: its shortest match by each alternative of each branch."""
    p, out = licenses.parts, [b""]
    for op, arg in nodes:
        if op is p.LITERAL:
            more = [bytes([arg])]
        elif op is p.IN:
            more = [b"1" if arg[0][0] is p.CATEGORY else bytes([arg[0][1] if arg[0][0] is p.LITERAL else arg[0][1][0]])]
        elif op is p.ANY:
            more = [b"x"]
        elif op in (p.MAX_REPEAT, p.MIN_REPEAT):
            more = [x * arg[0] for x in shortest(arg[2])]
        elif op is p.SUBPATTERN:
            more = shortest(arg[-1])
        elif op is p.BRANCH:
            more = [x for alternative in arg[1] for x in shortest(alternative)]
        else:
            assert op is p.ASSERT
            continue
        out = [x + y for x in out for y in more]
    return out


def test_license_gate_drops_no_match():
    for rule in licenses.rules():
        for text in shortest(licenses.parts.parse(rule.pattern.pattern)):
            norm = b" " + text + b" "
            assert rule.pattern.search(norm), (rule.name, text)
            assert licenses.detections(norm) == licenses.detections(norm, gated=False) != [], (rule.name, text)


def test_license_notices_without_the_word(spark):
    texts = ["Released under the GPL v3", "distributed under the BSD 3-clause", "published under MPL 2.0", "licensed under Apache 2.0", "offered under the Unlicense",
             "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "provided under Zlib", "Released under the GNU GPL v3.", None, "Available under MPL 2.0"]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    assert [rows[i]["labels"] for i in range(10)] == ["gpl-3", "bsd-3", "mpl-2", "apache-2", "unlicense", "mpl-2", "zlib", "gpl-3", "", "mpl-2"]
    assert all((r["score"] > 0) == (i != 8) for i, r in rows.items())


def test_license_texts_and_rows(spark):
    """Sentences of license texts, an SPDX line, overlapping detections by priority, repeated rows and null ids."""
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    texts = [gpl, apache, "SPDX-License-Identifier: MIT", "The Software shall be used for Good, not Evil.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", gpl, "plain"]
    table = spark.createDataFrame([(None if i == 5 else i // 6 if i == 6 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    rows = licenses.scan_licenses(table.union(table.where("doc_id = 3"))).collect()
    assert len(rows) == 8
    of = sorted((str(r["doc_id"]), r["labels"]) for r in rows)
    assert of == sorted([("0", "gpl-3"), ("1", "apache-2"), ("2", "mit"), ("3", "json"), ("3", "json"), ("4", "isc"), ("None", "gpl-3"), ("1", "")])
    assert all(len(r["detections"]) == 1 for r in rows if r["labels"])


def norm_of(text):
    return b" " + b" ".join(text.encode().lower().translate(common._TO_SPACE).split()) + b" "


@pytest.mark.parametrize(("text", "labels"), [
    ("Dual-licensed under the MIT license and the GPL v2.", "dual,gpl-2,mit"),
    ("Dual licensed under the Apache License 2.0 and BSL 1.1", "apache-2,bsl-1.1,dual"),
    ("Dual licensed under MIT and GPLv3", "dual,gpl-3,mit"),
    ("licensed under the MIT License or Apache License 2.0", "apache-2,mit"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2,mit"),
    ("SPDX-License-Identifier: (GPL-2.0-only OR MIT) AND BSD-3-Clause", "bsd-3,gpl-2,mit"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2,gpl-classpath"),
    ("the Apache License, Version 2.0", "apache-2"),
    ("under the GNU General Public License 3 or, alternatively, under the terms of the Mozilla Public License 2.0", "gpl-3,mpl-2"),
    ("ask Harvard or MIT, and the Apache tribe", ""),
])
def test_license_expressions(text, labels):
    assert ",".join(sorted({x[2] for x in licenses.detections(norm_of(text))})) == labels


def naive_detections(norm):
    """The written rule, without gates, sorted intervals or bisection."""
    found = [(m.start(), m.end(), r.priority, n, r) for n, r in enumerate(licenses.rules()) for m in r.pattern.finditer(norm)]
    for x in found:  # grows as it is gone through
        joined = not x[4].remark and licenses.CONJUNCTION.match(norm, x[1])
        for n, r in enumerate(licenses.conjuncts(), len(licenses.rules())):
            if joined and (m := r.pattern.match(norm, joined.end() + 1)) and (m.start(), m.end(), r.priority, n, r) not in found:
                found.append((m.start(), m.end(), r.priority, n, r))
    kept = []
    for remark in (False, True):
        left, mine = [x for x in found if x[4].remark == remark], []
        within = lambda x, y: y[0] <= x[0] and x[1] <= y[1] and ((x[0], x[1]) != (y[0], y[1]) or y[2:4] < x[2:4])
        while left:
            for x in sorted((x for x in left if not any(within(x, y) for y in left)), key=lambda x: (x[2], x[0])):
                if all(x[1] <= y[0] or y[1] <= x[0] for y in mine):
                    mine.append(x)
            left = [x for x in left if all(x[1] <= y[0] or y[1] <= x[0] for y in mine)]
        kept += mine
    return found, sorted((a, b, r.label, r.name) for a, b, _, _, r in kept)


def test_license_suppression_by_brute_force():
    rng = random.Random(8)
    phrases = sorted({t.strip() for r in (*licenses.rules(), *licenses.conjuncts()) for t in shortest(licenses.parts.parse(r.pattern.pattern)) if len(t) < 200})
    for _ in range(2000):
        parts = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice(phrases).split()
            a, b = sorted((0 if rng.random() < 0.7 else rng.randint(0, len(words)), len(words) if rng.random() < 0.7 else rng.randint(0, len(words))))
            parts += [b" ".join(words[a:b]), rng.choice([b"", b"and", b"or", b"under the", b"1 1", b"2 0", b"license", b"the"])]
        norm = b" " + b" ".join(b" ".join(parts).split()) + b" "
        found, expected = naive_detections(norm)
        got = licenses.detections(norm)
        assert got == expected == licenses.detections(norm, gated=False), norm
        for a, b, _, _, rule in found:  # nothing is lost that touches nothing that stays
            assert any(a < y and x < b and (label in licenses.REMARKS) == rule.remark for x, y, label, _ in got), norm


def test_license_intervals_do_not_overlap():
    norm = b" " + b" ".join(b"licensed under the apache license version 2 0 or the mit license spdx license identifier gpl 2 0 only".split()) + b" "
    found = licenses.detections(norm)
    assert {x[2] for x in found} >= {"apache-2", "gpl-2"}
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def brute_lines(docs):
    strip = " \t\n\x0b\x0c\r"
    holders = {}
    for i, text in docs:
        for line in {lower(x).strip(strip) for x in (text or "").split("\n")}:
            holders.setdefault(line, set()).update([] if i is None else [i])
    shared = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not ((k := lower(x).strip(strip)) in shared and shared[k] != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_by_brute_force(spark):
    common, accented = "this line is held by very many documents of all", "é" * 40
    docs = [(i, f"own {i}\n  {common.upper() if i % 2 else common}\t\n{accented if i > 3 else 'É' * 40}\n{common}\nshort") for i in range(9)]
    docs += [(20, None), (21, ""), (22, "\n\n"), (None, f"{common}\nx"), (23, "z" * 200_000)]
    table = spark.createDataFrame([(i, t, 1, "a", "b") for i, t in docs], "doc_id long, text string, row_key int, drops string, n_lines string")
    rows = sorted((tuple(r) for r in line_dedup.dedup_lines(table).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)
    assert rows == brute_lines(docs)
    kept = line_dedup.with_kept_lines(table)
    assert kept.columns == table.columns
    digests = sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept.collect()), key=str)
    assert digests == sorted(((r[0], r[3]) for r in rows), key=str)
    assert line_dedup.dedup_lines(table.where("false")).count() == 0


def test_line_dedup_of_repeated_rows(spark):
    """Rows that repeat a doc_id are one document: six rows of three documents are no five."""
    few, many = "w" * 40, "v" * 40
    docs = [(i % 3, few) for i in range(6)] + [(i % 5, f"{many}\n{i % 2}") for i in range(10)] + [(None, few)] * 9 + [(None, many)]
    rows = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in rows), key=str) == brute_lines(docs)
    assert sum(r["n_dropped"] for r in rows) == 9  # of many, save in document 4; a row without a doc_id is below it


def test_line_dedup_query_and_stage_count_distinct_documents(spark, tmp_path):
    few, many = "w" * 40, "v" * 40
    rows = [(i % 2, few) for i in range(5)] + [(10 + i, many) for i in range(5)]  # five rows of two documents, and five documents
    table = spark.createDataFrame(rows, "doc_id long, text string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_dropped"]) for r in got) == [(0, 0), (0, 0), (0, 0), (1, 0), (1, 0), (10, 1), (11, 1), (12, 1), (13, 1), (14, 0)]
    stage = corpus_pipeline.dedup_lines(spark, table, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in stage if r["text"]) == [(0, few)] * 3 + [(1, few)] * 2 + [(14, many)]


def test_files_follow_the_bytes_of_text(spark, tmp_path, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 20).alias("text"))
    monkeypatch.setattr(token_files, "TASK_BYTES", 1 << 30)  # one file keeps all cores busy
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            for size, least, most in ((1 << 28, 1, 1), (400 * 220 // 8, 6, 8)):
                monkeypatch.setattr(token_files, "FILE_BYTES", size)
                manifest = token_files.write_token_files(docs, f"{tmp_path}/{n}-{size}")
                assert least <= manifest.count() <= most
                assert manifest.agg(F.sum("n_docs")).first()[0] == 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
