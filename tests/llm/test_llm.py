"""The training-data operators: against brute force, exact round trips and held-out accuracy, and in edge cases."""

import hashlib
import json
import math
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from wayline.llm import attention_lm, audio, components, decontaminate, language_id, licence_patterns, licenses, near_dedup, packing, quality, shingles, textvec, token_files, tokens, warc
from wayline.llm import queries as q
from wayline.llm.scratch import new_path

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "the of and riverbank stone lantern über señor 東京 quiet harbour 7 x1 l'eau".split()
SMALL = "/root/testdata/sf0.001"


def texts(n=60, seed=0, low=0, high=120):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(low, high))) for _ in range(n)]


EDGES = [None, "", " ", "\n\t\r\v\f", "word", "two words", "A b c 　d", "é" * 50, "x" * 70_000, "same text here again", "same text here again", "<|endoftext|> it's I'LL 12,345", "\x1c\x1f a\x85b\u0085 c"]


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long, kept boolean"):
    """Documents with a column whose name clashes with results."""
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), True) for k, t in enumerate(rows)], schema)


def empty(spark):
    return frame(spark, ["x"]).limit(0)


# --- primitives -------------------------------------------------------------------------------------


def test_words_and_hashes():
    rows = EDGES + texts(20)
    for limit in (64, 1 << 20):
        got = []
        for block in textvec.blocks(pa.array(rows, type=pa.string()), limit):
            data = textvec.LOWER[block.data]
            starts, ends, first = block.words(textvec.SPACE, data)
            for i in range(len(block)):
                got.append([data[s:e].tobytes().decode() for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])])
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER)) for t in rows]
    block = next(textvec.blocks(pa.array(["ab ab ba", "ab"])))
    starts, ends, _ = block.words(textvec.SPACE)
    h = textvec.span_hashes(block.data, starts, ends)
    assert h[0] == h[1] == h[3] != h[2]


def thue_morse(size):
    """Two texts over {a, b}, each the other's complement: sums of byte values times powers can't tell them apart."""
    s = "a"
    while len(s) < size:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


HARD = [*thue_morse(1024), *thue_morse(4096), "lead " + thue_morse(2048)[0] + " tail", "lead " + thue_morse(2048)[1] + " tail"]
WEAK = np.uint64(0x3)


def weaken(monkeypatch):
    """Only four hashes: what stays exact compares bytes."""
    real = textvec.span_hashes
    for module in (textvec, tokens, decontaminate, attention_lm):
        monkeypatch.setattr(module, "span_hashes", lambda *a: real(*a) & WEAK, raising=False)


def test_hashes_of_hard_texts_differ():
    rows = [*HARD, "x" * 5_000_000, "x" * 4_999_999 + "y", "ab", "ab\0", "abcdefgh", "abcdefgh\0"]
    data = np.frombuffer("".join(rows).encode(), dtype=np.uint8)
    ends = np.cumsum([len(r) for r in rows])
    starts = ends - [len(r) for r in rows]
    assert len(set(textvec.span_hashes(data, starts, ends).tolist())) == len(rows)
    moved = np.concatenate([np.frombuffer(b"pad", dtype=np.uint8), data])
    assert np.array_equal(textvec.span_hashes(moved, starts + 3, ends + 3), textvec.span_hashes(data, starts, ends))
    same = textvec.same_spans(data, starts[:, None].repeat(len(rows), 1).ravel(), ends[:, None].repeat(len(rows), 1).ravel(), moved, np.tile(starts + 3, len(rows)), np.tile(ends + 3, len(rows)))
    assert np.array_equal(same.reshape(len(rows), -1), np.eye(len(rows), dtype=bool))


def test_distinct_spans_under_weak_hashes(monkeypatch):
    weaken(monkeypatch)
    rows = [*HARD, *HARD, "a", "b", "a", "longer than a lane", "longer than a lake"]
    data, ends = np.frombuffer("".join(rows).encode(), dtype=np.uint8), np.cumsum([len(r) for r in rows])
    starts = ends - [len(r) for r in rows]
    where, which, _ = textvec.distinct_spans(data, starts, ends, textvec.span_hashes(data, starts, ends))
    assert [rows[k] for k in where[which]] == rows and len(where) == len(set(rows))


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("name, words_only", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_are_the_librarys(name, words_only, weak, monkeypatch):
    if weak:
        weaken(monkeypatch)
    own = tokens.Coder(q.tokenizer_file(name), words_only)
    rows = EDGES + HARD + texts(40)
    got = []
    for block in textvec.blocks(pa.array(rows, type=pa.string()), 256):
        ids, counts = own.encode(block)
        got += np.split(ids, np.cumsum(counts)[:-1])
    for text, ids in zip(rows, got):
        assert ids.tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids


# --- op1 --------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long, other = "<p>" + "payload " * 20, "<p>" + "different " * 20
    rows = [(5, "u5", long), (3, "u\r\nWARC-Type: forged", long), (9, None, other), (1, "u1", None), (2, "u2", ""), (4, "u4", "short"), (6, "u6", "short"), (None, "u", long), (7, "u7", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = new_path(spark, "t")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    back = warc.read_records(spark, path).withColumn("bytes", warc.record_bytes()).collect()
    assert {r["page_id"]: bytes(r["payload"]) for r in back} == {i: (h or "").encode() for i, _, h in rows}
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in back}
    assert got[3] == ("response", None) and got[5] == ("revisit", 3) and got[None] == ("revisit", 3)
    assert {got[i] for i in (1, 2, 4, 6, 7, 9)} == {("response", None)}
    record = next(bytes(r["bytes"]) for r in back if r["page_id"] == 9)
    head, _, rest = record.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\n") and rest == other.encode() + b"\r\n\r\n"
    assert f"Content-Length: {len(other)}".encode() in head
    assert sorted(str(r["page_id"]) for r in warc.archive_digests(pages).collect()) == sorted(str(i) for i, *_ in rows)
    assert warc.archive_digests(pages.limit(0)).count() == 0


def test_warc_ties_and_damage(spark):
    """Equal rows: one response, the others revisit it; record ids are unique; damage is an error, never a row."""
    long = "tie " * 40
    rows = [(1, "u", long), (1, "u", long), (1, "v", long), (1, "w", "another " * 30), (None, "x", "null " * 30), (None, "x", "null " * 30), (2, "s", "short"), (2, "s", "short"), (3, "big", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = new_path(spark, "t")
    warc.write_archive(pages, path)
    back = warc.read_records(spark, path).collect()
    got = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in back)
    assert got == {(1, "response", None): 2, (1, "revisit", 1): 2, (None, "response", None): 1, (None, "revisit", None): 1, (2, "response", None): 2, (3, "response", None): 1}
    ids = [re.search(rb"WARC-Record-ID: (\S+)", bytes(r["header"]))[1] for r in back]
    assert len(set(ids)) == len(rows)
    assert {re.search(rb"WARC-Refers-To: (\S+)", bytes(r["header"]))[1] for r in back if r["record_type"] == "revisit"} < set(ids)


# --- op2 --------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    rows = EDGES + texts(10)
    path = new_path(spark, "t")
    audio.store_media(frame(spark, rows), path)
    features = new_path(spark, "t")
    audio.store_features(spark.read.schema(audio.MEDIA).parquet(path), features)
    stored = spark.read.schema(audio.STORED).parquet(features)
    got = {r["doc_id"]: r for r in audio.media_digests(stored).collect()}
    assert len(got) == len(rows)
    for k, t in enumerate(rows):
        b = (t or "").encode()
        p = b + b" " * ((-len(b)) % 192 or (0 if b else 192))
        assert (got[k]["n_bytes"], got[k]["payload_bytes"], got[k]["payload_sha256"], got[k]["tail_crc32"], got[k]["media_bytes"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(p) + 44)
    assert got[9]["feature"] == got[10]["feature"] and got[0]["feature"] == got[1]["feature"]
    tensors = audio.as_tensors(audio.feature_tensors(stored).orderBy("doc_id", "tensor").toArrow())
    block = rows[8].encode() + b" " * (-len(rows[8]) % 192)
    mel = audio.log_mel(np.frombuffer(block, dtype=np.uint8))
    mine = tensors.filter(pa.compute.equal(tensors["doc_id"], 8))
    assert np.array_equal(mine["features"].combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)[: len(mel)], mel)
    second = audio.RATE * audio.UP / audio.DOWN
    assert mine["begin_s"].to_pylist() == [k * audio.FRAMES * audio.HOP / second for k in range(-(-len(mel) // audio.FRAMES))]
    assert all(len(x) == audio.FRAMES * audio.MELS for r in stored.collect() for x in r["features"])
    spans = {}
    for r in audio.segment_spans(stored).orderBy("doc_id", "segment").collect():
        spans.setdefault(r["doc_id"], []).append((r["begin_s"], r["end_s"]))
    for k, t in enumerate(rows):
        p = (t or "").encode() + b" " * ((-len((t or "").encode())) % 192 or (0 if t else 192))
        loud = audio.segments(audio.log_mel(np.frombuffer(p, dtype=np.uint8)).mean(axis=1))
        assert np.allclose(spans.get(k, []), [(a * audio.HOP / second, ((b - 1) * audio.HOP + audio.FFT) / second) for a, b in loud])
    assert spans
    assert tensors.schema.field("features").type.shape == [audio.FRAMES, audio.MELS]
    assert audio.media_digests(stored.limit(0)).count() == 0


def test_features_in_pieces_equal_the_whole(monkeypatch):
    x = np.random.default_rng(0).integers(0, 256, 50_000).astype(np.uint8)
    whole = audio.log_mel(x)
    monkeypatch.setattr(audio, "PIECE_FRAMES", 7)
    assert np.allclose(audio.log_mel(x), whole, atol=1e-4)


def test_log_mel_equals_a_plain_one():
    """Zeros put between samples, one convolution, a Fourier sum and the triangles of the mel scale, frame by frame."""
    samples = np.random.default_rng(1).integers(0, 256, 6000).astype(np.uint8)
    x, half, wide = (samples.astype(float) - 128) / 128, 8, max(audio.UP, audio.DOWN)
    t = np.arange(-half * wide, half * wide + 1)
    taps = np.sinc(t / wide) / wide * audio.UP * (0.5 + 0.5 * np.cos(np.pi * t / (half * wide + 1)))
    dense = np.zeros(len(x) * audio.UP)
    dense[:: audio.UP] = x
    y = np.convolve(dense, taps)[half * wide :][:: audio.DOWN][: -(-len(x) * audio.UP // audio.DOWN)]
    got = audio.log_mel(samples)
    rate = audio.RATE * audio.UP / audio.DOWN
    edges = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 20 / 700), 2595 * np.log10(1 + rate / 2 / 700), audio.MELS + 2) / 2595) - 1)
    inner = [k for k in range(len(got)) if k * audio.HOP + audio.FFT <= len(y) - 2 * half * wide]
    assert len(got) == -(-len(y) // audio.HOP) and len(inner) > 3
    for k in inner:
        n = np.arange(audio.FFT)
        frame_ = y[k * audio.HOP : k * audio.HOP + audio.FFT] * (0.5 - 0.5 * np.cos(2 * np.pi * n / audio.FFT))
        power = [abs((frame_ * np.exp(-2j * np.pi * b * n / audio.FFT)).sum()) ** 2 for b in range(audio.FFT // 2 + 1)]
        for m in range(audio.MELS):
            a, b, c = edges[m : m + 3]
            f = np.arange(audio.FFT // 2 + 1) * rate / audio.FFT
            energy = sum(w * p for w, p in zip(np.maximum(0, np.minimum((f - a) / (b - a), (c - f) / (c - b))), power))
            assert abs(got[k, m] - np.log(max(energy, 1e-6))) < 1e-2


def test_resampling_keeps_low_tones_and_drops_high_ones():
    t = np.arange(16_000) / 16_000
    low, high = audio.resample(np.sin(2 * np.pi * 500 * t), 100, 6100), audio.resample(np.sin(2 * np.pi * 7000 * t), 100, 6100)
    want = np.sin(2 * np.pi * 500 * np.arange(100, 6200) / 6400)
    assert np.abs(low - want).max() < 0.05 and np.abs(high).max() < 0.05
    assert np.allclose(audio.polyphase_filter(3, 2).sum(axis=1), 1, atol=0.05)


def test_hysteresis():
    energy = np.array([0, 0, 0, 0, 0, 1, 0.3, 0.3, 0.0, 0.3, 0, 0.9, 0, 0, 0], dtype=float)
    assert audio.segments(energy) == [(5, 8), (11, 12)]
    assert audio.segments(np.zeros(5)) == []


# --- op3 --------------------------------------------------------------------------------------------


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x.txt", "prose " * 20 + "\n# Licensed under the Apache License, Version 2.0.\nmore"),
        (3, "a/b/y.txt", "nothing here"),
        (4, "a/b/c/z.txt", None),
        (5, "d/e.txt", "no licence whatsoever is named in this line of prose about rivers and lanterns and stones"),
        (6, None, ""),
        (7, "a/b/LICENSE.md", "Licensed under CC BY-NC 4.0."),
        (3, "a/b/y.txt", "nothing here"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r["doc_id"]: r for r in licenses.scan(files).collect()}
    assert (got[1]["license"], got[2]["license"]) == ("MIT", "Apache-2.0")
    assert (got[3]["license"], got[3]["effective_license"], got[3]["inherited_from"]) == (None, "CC-BY-NC-4.0", "a/b")
    assert (got[4]["effective_license"], got[4]["inherited_from"]) == ("CC-BY-NC-4.0", "a/b")
    assert got[5]["effective_license"] is None and got[6]["effective_license"] is None
    assert licenses.scan(files).count() == len(rows) and licenses.scan(files.limit(0)).count() == 0


def test_licences_in_full(spark):
    """Full texts, wrapped headers and tags, as real files have them."""
    full = {n: t for n, t, must in licence_patterns.patterns() if not must and len(t) > 600}
    wrapped = lambda t, mark: "\n".join(f"{mark}{x}".rstrip() for p in t.split("\n\n") for x in [*textwrap.wrap(p, 60), ""])
    gpl = "This file is part of Foo.\n\nFoo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nFoo is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0'
    code = "\nint main() { return 0; }\n" * 5
    cases = [(n, f"{n}/LICENSE", f"Copyright (c) 2011-2024 A. N. Author and others\n\n{wrapped(t, '')}") for n, t in full.items()]
    cases += [(n, f"c/{n}.c", wrapped(f"Copyright (c) 2020 Someone\n\n{full[n]}", " * ").join(["/*\n", "\n */"]) + code) for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")]
    cases += [("GPL-3.0", "g.py", wrapped(gpl, "# ") + code), ("GPL-3.0", "g.txt", wrapped(gpl, "") + code), ("Apache-2.0", "a.js", wrapped(apache, "// ") + code)]
    cases += [("MPL-2.0", "m.c", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */" + code)]
    cases += [(n, f"s/{k}.c", f"// SPDX-License-Identifier: {tag}{code}") for k, (tag, n) in enumerate([("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("gpl-2.0-or-later WITH Classpath-exception-2.0", "GPL-2.0"), ("(MIT OR Apache-2.0)", "Apache-2.0"), ("EPL-2.0", "EPL-2.0")])]
    cases += [(None, "e.md", "Foo is distributed under the EPL license." + code), (None, "n.c", "// #\n" * 20_000 + "// a licence of no kind")]
    files = spark.createDataFrame([(k, path, text) for k, (_, path, text) in enumerate(cases)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(files).collect()}
    assert [(p, got[k]) for k, (_, p, _) in enumerate(cases)] == [(p, n) for n, p, _ in cases]


# --- op4 --------------------------------------------------------------------------------------------

LANGS = {"en": "the river of and stone with lantern that they have seen".split(), "de": "der fluss und stein mit laterne dass sie haben gesehen für über".split(), "es": "el río de la piedra con linterna que ellos han visto años".split()}


def sentences(n, seed):
    rng = np.random.default_rng(seed)
    return [(lang, " ".join(rng.choice(words, rng.integers(5, 40)))) for _ in range(n) for lang, words in LANGS.items()]


def test_language_held_out(spark):
    rows = [(k, t, lang) for k, (lang, t) in enumerate(sentences(80, 0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs, docs, F.pmod(textvec.crc_bucket(F.col("doc_id")), F.lit(4)) != 2).collect()}
    held = [(k, lang) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert held and sum(got[k]["lang_pred"] == lang for k, lang in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values()) and np.mean([r["accepted"] for r in got.values()]) > 0.99


def test_language_edges(spark):
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(sentences(30, 1))], "doc_id long, text string, lang string")
    odd = frame(spark, [*EDGES, "123 !!! ???", "漢" * 500])
    got = {r["doc_id"]: r for r in language_id.identify(odd, docs, F.lit(True)).collect()}
    assert [got[k]["lang_pred"] for k in (0, 1, 2, 3, 13)] == ["und"] * 5 and got[0]["score"] == 0.0
    assert not got[14]["accepted"] and not got[0]["accepted"]
    assert {r["lang_pred"] for r in language_id.identify(odd, docs.limit(0), F.lit(True)).collect()} == {"und"}
    assert language_id.identify(empty(spark), docs, F.lit(True)).count() == 0
    assert set(language_id.keep_accepted(odd, F.lit(True)).columns) == set(odd.columns)


def test_language_and_quality_learn_from_long_texts(spark):
    rows = [(k, " ".join([t] * 400), lang) for k, (lang, t) in enumerate(sentences(12, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.sample(docs, F.lit(True), 800, 3000)
    assert {lang: len(x) for lang, x in got.items()} == {lang: 12 for lang in LANGS}
    whole = {lang: [t for _, t, l in rows if l == lang] for lang in LANGS}
    assert all(any(x in t and len(x) == min(3000, len(t)) for t in whole[lang]) for lang, part in got.items() for x in part)
    assert not all(any(t.startswith(x) for t in whole[lang]) for lang, part in got.items() for x in part)
    labels = spark.createDataFrame([(k, k % 2) for k, _, _ in rows], "doc_id long, quality int")
    texts_, y = quality.sample(docs, labels, F.lit(True), 4000, 3000)
    assert y.tolist() == [k % 2 for k in range(len(rows))] and all(x in t and len(x) == min(3000, len(t)) for x, (_, t, _) in zip(texts_, rows))
    odd = spark.createDataFrame([("",), ("abc",), ("é" * 10,), (None,)], "text string").select(textvec.run_of_text(F.col("text"), 3).alias("x")).collect()
    assert [r["x"] for r in odd] == ["", "abc", "ééé", None]


def test_kneser_ney_sums_to_one():
    kept = [t for lang, t in sentences(20, 2) if lang == "en"]
    model = language_id.fit({"en": kept})
    known = sorted({c for k, t in enumerate(kept) if k % 5 != 4 for c in t} | {" "})
    for history in ("th", "st", "zq", "e", "the st", "日本"):
        base = model.cross_entropies(next(textvec.blocks(pa.array([history]))))
        h, n, _ = model.cross_entropies(next(textvec.blocks(pa.array([history + c for c in [*known, "語"]]))))
        whole = np.exp(base[0][0, 0] * base[1][0] - h[:, 0] * n)
        assert abs(whole.sum() - 1) < 1e-3  # all known characters and one place for the unknown


def test_kneser_ney_equals_a_plain_model():
    """Every probability against counts in dictionaries."""
    kept = [t for lang, t in sentences(10, 5) if lang == "en"][:4]
    model, order = language_id.fit({"en": kept}), language_id.ORDER
    grams = [Counter() for _ in range(order + 1)]
    for t in kept:
        padded = " " * order + t
        for i in range(order, len(padded)):
            for n in range(1, order + 1):
                grams[n][padded[i - n + 1 : i + 1]] += 1
    for n in range(1, order):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    known = len(grams[1])

    def p(gram):
        n, counts = len(gram), grams[len(gram)]
        if n == 0:
            return 1 / (known + 1)
        once, twice = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        d = once / max(once + 2 * twice, 1) if once else 0.5
        own = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        return max(own.get(gram, 0) - d, 0) / total + sum(min(c, d) for c in own.values()) / total * p(gram[1:])

    for text in ("the river", "zebra the", "of", "hhh"):
        h, n, _ = model.cross_entropies(next(textvec.blocks(pa.array([text]))))
        padded = " " * order + text
        want = sum(math.log(p(padded[i - order + 1 : i + 1])) for i in range(order, len(padded)))
        assert abs(h[0, 0] * n[0] + want) < 1e-3


# --- op5 --------------------------------------------------------------------------------------------


def test_token_files(spark):
    rows = EDGES + texts(40)
    docs = frame(spark, rows).orderBy(F.rand(3)).repartition(5)
    path = new_path(spark, "t")
    token_files.write_token_files(docs, path, q.tokenizer_file("word_bpe_49k.json"), words_only=True)
    got = {r["doc_id"]: r for r in token_files.token_digests(spark, path).collect()}
    tokenizer, start = tokens.Coder(q.tokenizer_file("word_bpe_49k.json")).tokenizer, 0
    for k, t in enumerate(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    some = token_files.read_documents(spark, path, 5, 7)
    assert sorted(r["doc_id"] for r in some.collect()) == [5, 6, 7]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,5), LessThanOrEqual(doc_id,7)]" in some._jdf.queryExecution().toString()
    bare = new_path(spark, "t")
    token_files.write_token_files(empty(spark), bare, q.tokenizer_file("word_bpe_49k.json"))
    assert token_files.token_digests(spark, bare).count() == 0


def test_special_tokens_in_capitals():
    path = q.tokenizer_file("word_bpe_49k.json")
    rows = ["a <|ENDOFTEXT|> b", "a<|EndOfText|>B <|endoftext|>", "<|", "X<", "|Y <|STARTOFTEXT|>", "<|endoftext|> THE <| A"]
    own, library = tokens.Coder(path, words_only=True), tokens.Coder(path).tokenizer
    for block in textvec.blocks(pa.array(rows, type=pa.string())):
        ids, counts = own.encode(block)
        want = [library.encode(x, add_special_tokens=False).ids for x in rows]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


# --- op6 --------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k, t in enumerate(texts(300, 4, 20, 200)):
        good = bool(k % 3)
        rows.append((k, t if good else " ".join(w + str(rng.choice(["###", "&&&", "%%%"])) for w in t.split())))
        labels.append((k, int(good)))
    docs, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (9999, None), (None, 1)], "doc_id long, quality int")
    held = F.pmod(textvec.crc_bucket(F.col("doc_id")), F.lit(5)) == 0
    got = {r["doc_id"]: r for r in quality.classify(docs, docs, y, ~held).collect()}
    out = [(got[k]["predicted"], v) for k, v in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in out]) > 0.95
    odd = quality.classify(frame(spark, EDGES), docs, y, ~held).collect()
    assert len(odd) == len(EDGES) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in quality.classify(frame(spark, EDGES), docs, y.limit(0), ~held).collect()} == {0.5}
    assert quality.classify(empty(spark), docs, y, ~held).count() == 0


def test_quality_gradient():
    block = next(textvec.blocks(pa.array(texts(6, 5, 50, 300))))
    x, begin = quality.passages(block)
    assert np.array_equal(np.diff(begin), [max(1, -(-len(block.text(i).split()) // quality.PASSAGE)) for i in range(6)])
    model, y = quality.Bags(x.mean(0), np.ones(quality.FEATURES, np.float32)), np.array([0, 1, 1, 0, 1, 0], dtype=np.float64)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * model.forward(x, begin)[0]))))
    clipped = np.clip((x - model.mean) * model.scale, -6, 6)
    assert np.allclose(clipped, (x - model.mean) * model.scale)
    model.scale, model.mean, x = np.ones(quality.FEATURES), np.zeros(quality.FEATURES), clipped.astype(np.float64)
    grad = model.gradient(x, begin, y)
    for name in ("b", "V", "U", "w", "c", "d"):
        flat, at = model.p[name].reshape(-1), 0
        old = flat[at]
        flat[at] = old + 1e-5
        up = loss()
        flat[at] = old - 1e-5
        down = loss()
        flat[at] = old
        assert grad[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


# --- op7 --------------------------------------------------------------------------------------------


def brute_components(rows, words, per_hundred):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_hundred * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("words, per_hundred", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, per_hundred):
    rng = np.random.default_rng(words)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = list(EDGES)
    for size in (30, 60, 120):  # groups of edited copies, some of which link only through others
        base = list(rng.choice(vocabulary, size))
        for _ in range(25):
            copy = list(base)
            for i in rng.integers(0, size, rng.integers(0, max(2, size // 20))):
                copy[i] = str(rng.choice(vocabulary))
            rows.append(" ".join(copy))
    passage = " ".join(rng.choice(vocabulary, 40))
    rows += [passage + " " + " ".join(rng.choice(vocabulary, 60)) for _ in range(20)] + texts(30, 9)
    order = rng.permutation(len(rows))
    docs = frame(spark, [rows[i] for i in order])
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, words, per_hundred).collect()}
    want = brute_components([(k, rows[i]) for k, i in enumerate(order)], words, per_hundred)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicates_of_hard_texts(spark):
    rows = HARD + HARD[:2]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert got == {k: c for k, (_, c) in brute_components(list(enumerate(rows)), 3, 85).items()} and len(set(got.values())) == 6


def test_one_row_of_each_group_stays(spark):
    """Null ids, repeated ids and repeated rows: exactly one row of each group, and no text is lost."""
    base = [f"w{k}" for k in range(40)]
    a, b = " ".join(base), "another text altogether with some words of its own"
    near = " ".join([*base, "more"])
    rows = [(3, a), (7, a), (7, b), (None, a), (None, a), (None, "only null ids here and there"), (None, "only null ids here and there"), (9, near), (1, None), (1, None), (2, ""), (8, b), (8, b)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _row string").repartition(4)
    out = near_dedup.keep_distinct(docs, 3, 80)
    got = sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect())))
    assert out.columns == docs.columns and got == sorted(map(str, [(3, a), (7, b), (None, "only null ids here and there"), (1, None), (1, None), (2, "")]))
    assert near_dedup.keep_distinct(docs.limit(0)).count() == 0


def test_near_duplicates_edges(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "only null"), (2, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and sorted(str(r["component_id"]) for r in got) == ["1", "1", "1", "2", "None"]
    assert sum(r["kept"] for r in got) == 4  # a row of a repeated id stays with its twin; the null copy goes


def test_prefix_threshold():
    for s in (0.8, 0.85, 0.95):
        t = near_dedup.least_matches(32, s)
        missed = sum(math.comb(32, k) * s**k * (1 - s) ** (32 - k) for k in range(t))
        assert missed <= 1e-6 < missed + math.comb(32, t) * s**t * (1 - s) ** (32 - t)


def test_parity_bound():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**60, n).astype(np.uint64)) for n in (200, 150))
    b = np.unique(np.concatenate([b, a[:120]]))
    sketch = shingles.parities(np.concatenate([a, b]), np.array([len(a), len(b)]))
    differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in sketch[0] ^ sketch[1])
    assert differ <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 11), (5, 5), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8, 11: 8, **{k: 20 for k in range(20, 25)}}


# --- op8 --------------------------------------------------------------------------------------------


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= n]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= n
        else:
            bins.append(capacity - n)
    return bins


def test_plan_is_best_fit_decreasing():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        capacity = int(rng.integers(5, 60))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 300)).tolist()
        segments, opened = packing.plan(dict(Counter(lengths)), capacity)
        bins = plain_best_fit(lengths, capacity)
        assert opened == len(bins)
        places = {}
        for length, rank, first, offset, each in segments.tolist():
            following = [r for n, r, *_ in segments.tolist() if n == length and r > rank]
            end = min(following) if following else Counter(lengths)[length]
            for g in range(end - rank):
                places.setdefault(first + g // each, []).append((offset + g % each * length, length))
        for parts in places.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in p) for p in places.values()) == sorted(bins)


def test_packing(spark):
    rows = [t if t is None or len(t) < 1000 else "word " * 3000 for t in EDGES] + texts(60)
    docs = frame(spark, rows).repartition(4)
    got = packing.pack(docs, q.tokenizer_file("byte_bpe_50k.json"), 128, with_ids=True).collect()
    tokenizer = tokens.Coder(q.tokenizer_file("byte_bpe_50k.json")).tokenizer
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(range(len(rows)))
    for k, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        ids = tokenizer.encode(rows[k] or "", add_special_tokens=False).ids + [2]
        assert [x for r in parts for x in r["ids"]] == ids and all(r["length"] == 128 for r in parts[1:])
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) for r in parts)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by_sequence) == len(plain_best_fit([r["length"] for r in got], 128))
    assert packing.pack(empty(spark), q.tokenizer_file("byte_bpe_50k.json")).count() == 0


# --- op9 --------------------------------------------------------------------------------------------


def test_lm_scores(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(160):
        words = LANGS[("en", "de")[k % 2]]
        rows.append(" ".join(rng.choice(words, rng.integers(20, 80))))
    rows += EDGES
    docs = frame(spark, rows)
    held = F.pmod(textvec.crc_bucket(F.col("doc_id")), F.lit(5)) == 1
    got = {r["doc_id"]: r for r in attention_lm.score(docs, held, q.tokenizer_file("word_bpe_49k.json"), chunk_bytes=4096).collect()}
    split = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER)) + [0] for t in rows]
    out = [zlib.crc32(str(k).encode()) % 5 == 1 for k in range(len(rows))]
    c = Counter(w for k, s in enumerate(split) if not out[k] for w in s)
    n, v = sum(c.values()), len(c)
    for k, s in enumerate(split):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s)
        assert (got[k]["held_out"], got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (out[k], len(s), sum(c[w] > 0 for w in s), n)
        assert got[k]["base_score"] == pytest.approx(base, rel=1e-9)
    prose = [k for k in range(160) if out[k]]
    assert sum(got[k]["score"] for k in prose) > sum(got[k]["base_score"] for k in prose) * 0.95
    assert attention_lm.score(empty(spark), F.lit(False), q.tokenizer_file("word_bpe_49k.json")).count() == 0


def lm_words(rng, vocabulary, n):
    size = rng.integers(0, 4, n)
    return attention_lm.Words(rng.integers(0, vocabulary, size.sum()), np.concatenate([[0], np.cumsum(size)]))


def lm_net(vocabulary=50, seed=0):
    """A net in double precision whose weights are far from their start."""
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 30, 2 * vocabulary + 2).astype(float)
    net = attention_lm.Net(vocabulary, attention_lm.Tree.grown(vocabulary, rng.integers(0, attention_lm.GROUPS, vocabulary), counts))
    net.p = {k: v.astype(np.float64) + 0.2 * rng.standard_normal(v.shape) for k, v in net.p.items()}
    return net


def plain_lm(net, words):
    """A document's log probabilities, a word and a symbol at a time; pairs of the whole spelling and of the first symbol's leaf."""
    p, t, size = net.p, net.tree, attention_lm.DIM
    spelling = [words.ids[a:b].tolist() for a, b in zip(words.bounds[:-1], words.bounds[1:])]
    x = [p["E"][net.row(net.BEGIN)]] + [p["E"][s].sum(0) if s else p["E"][net.row(net.BLANK)] for s in spelling]
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    out = []
    for i in range(len(x)):
        low = max(0, i // attention_lm.STRIDE * attention_lm.STRIDE - attention_lm.STRIDE)
        e = np.array([x[i] @ p["Q"] @ (x[j] @ p["K"]) / math.sqrt(size) + p["r"][i - j] for j in range(low, i + 1)])
        read = sum(a * (x[j] @ p["V"]) for a, j in zip(soft(e), range(low, i + 1)))
        pre = x[i] @ p["W1"] + p["b"] + read @ p["W2"]
        if i == len(spelling):
            symbols = [2 * net.size]
        else:
            symbols = [2 * k + (n == len(spelling[i]) - 1) for n, k in enumerate(spelling[i])] or [2 * net.size + 1]
        before, total, head = net.row(net.FIRST), 0.0, None
        for s in symbols:
            h = np.tanh(pre + p["E"][before] @ p["U"])
            g, leaf = t.group[s], t.leaf[s]
            first = (1 - attention_lm.MIX) * soft(h @ p["O1"] + p["o1"])[g] + attention_lm.MIX * t.prior1[g]
            z = np.where(t.open[g], h @ p["O2"][g] + p["o2"][g], -1e9)
            second = (1 - attention_lm.MIX) * soft(z)[leaf] + attention_lm.MIX * t.prior2[g, leaf]
            head = math.log(first * second) if head is None else head
            total += math.log(first * second) + t.share[s]
            before = s // 2
        out.append((total, head))
    return np.array(out)


def test_lm_equals_a_plain_model():
    """Many documents under one mask against one word and symbol at a time; each token once; causal."""
    rng, net = np.random.default_rng(1), lm_net()
    counts = np.array([0, 5, 40, 1, 16, 33])
    words = lm_words(rng, 50, int(counts.sum()))
    w = attention_lm.windows(np.arange(len(words)), counts)
    assert np.array_equal(np.sort(w.query[w.real]), np.arange(counts.sum() + len(counts)))
    got = np.stack(net.word_logs(words, w, step=3), axis=1)
    ends = np.cumsum(counts)
    assert np.allclose(got, np.concatenate([plain_lm(net, words.take(np.arange(e - n, e))) for n, e in zip(counts, ends)]), atol=1e-5)
    other = attention_lm.Words(words.ids.copy(), words.bounds)
    at = int(words.bounds[ends[2] - 3])  # an id near the end of the third document
    other.ids[at] = (other.ids[at] + 1) % 50
    changed = np.stack(net.word_logs(other, w), axis=1)
    assert np.allclose(changed[: ends[2] + 3 - 6], got[: ends[2] + 3 - 6], atol=1e-9)


def test_lm_probabilities_sum_to_one():
    """Over all symbols, the end and a word without ids included, after any context; and the shares of a leaf's words with one unknown word."""
    net = lm_net()
    h = np.random.default_rng(5).standard_normal((4, attention_lm.HIDDEN))
    every = np.arange(2 * net.size + 2)
    for one in h:
        assert np.exp(net.logs(np.repeat(one[None], len(every), 0), every) + net.tree.share).sum() == pytest.approx(1, abs=1e-5)
    c = np.array([5, 1, 9])
    assert ((c + 0.5) / (c.sum() + 0.5 * (len(c) + 1))).sum() + 0.5 / (c.sum() + 0.5 * (len(c) + 1)) == pytest.approx(1)


def test_lm_gradient():
    rng, net = np.random.default_rng(2), lm_net()
    counts = np.array([0, 5, 40, 1, 24])
    words = lm_words(rng, 50, int(counts.sum()))
    w = attention_lm.windows(np.arange(len(words)), counts, np.array([1, 0, 1, 1, 0]) > 0, np.array([1, 1, 0, 1, 1]) > 0)
    _, grad, rows = net.loss_gradient(words, w)
    for name, g in grad.items():
        at = int(np.abs(g.reshape(-1)).argmax())
        place = (rows[at // attention_lm.DIM], at % attention_lm.DIM) if name == "E" else np.unravel_index(at, net.p[name].shape)
        old, found = net.p[name][place], []
        for step in (1e-4, -1e-4):
            net.p[name][place] = old + step
            found.append(net.loss_gradient(words, w)[0])
        net.p[name][place] = old
        assert g.reshape(-1)[at] == pytest.approx((found[0] - found[1]) / 2e-4, rel=1e-3, abs=1e-8), name


def test_lm_of_large_logits():
    """Logits too large for exp go through it less their largest, with the same results; a word of many ids counts them all."""
    net, counts = lm_net(), np.array([3, 20])
    for name in ("O1", "O2"):
        net.p[name] *= 40
    assert not net.outputs()[1] and lm_net().outputs()[1]
    ids = np.random.default_rng(7).integers(0, 50, 22 + 30)
    words = attention_lm.Words(ids, np.concatenate([[0], np.arange(30, 30 + 23)]))
    got = np.stack(net.word_logs(words, attention_lm.windows(np.arange(23), counts)), axis=1)
    assert np.allclose(got, np.concatenate([plain_lm(net, words.take(np.arange(e - n, e))) for n, e in zip(counts, (3, 23))]), atol=1e-5)


def test_lm_takes_no_position_that_nothing_reads():
    """A slice in the middle of a document predicts its words alone: the last is read by no position, and four blocks hold 64 words."""
    net, counts = lm_net(), np.array([64, 64, 0])
    words = lm_words(np.random.default_rng(8), 50, 128)
    w = attention_lm.windows(np.arange(128), counts, np.array([True, False, True]), np.array([False, True, True]))
    assert len(w.query) == 4 + 5 + 1 and w.exists.sum() == 64 + 65 + 1 and w.real.sum() == 64 + 64 + 1
    _, gradient, rows = net.loss_gradient(words, w)
    only = lm_words(np.random.default_rng(8), 50, 128).take(np.array([63])).ids
    assert set(only.tolist()) <= set(rows.tolist()) and all(np.isfinite(g).all() for g in gradient.values())
    full = attention_lm.windows(np.arange(128), counts)
    got, every = (net.word_logs(words, x)[0] for x in (w, full))
    assert np.allclose(got[:64], every[:64]) and np.allclose(got[65 : 64 + 65], every[66 : 65 + 65])


def test_lm_slices_keep_their_words():
    words = lm_words(np.random.default_rng(3), 50, 70)
    s, b = attention_lm.symbols_of(words, 50)
    back, counts = attention_lm._unpacked([s[b[i] : b[j]] for i, j in ((0, 0), (0, 5), (5, 45), (45, 46), (46, 70))], 50)
    assert counts.tolist() == [0, 5, 40, 1, 24] and np.array_equal(back.ids, words.ids) and np.array_equal(back.bounds, words.bounds)


def test_lm_learns_in_tasks(spark, monkeypatch):
    """Averaged rounds make the loss on what the tasks learned from smaller; more slices mean more that is learned from."""
    monkeypatch.setattr(attention_lm, "START", 40)
    monkeypatch.setattr(attention_lm, "TASK_SLICES", 60)
    path = q.tokenizer_file("word_bpe_49k.json")
    rng = np.random.default_rng(0)
    rows = [" ".join(rng.choice(LANGS[("en", "de")[k % 2]], 90)) for k in range(150)]
    chunks = frame(spark, rows).select(F.lit(1).cast("long").alias("chunk"), F.lit(False).alias("held_out"), "text")
    size = tokens.coder(path, words_only=True).tokenizer.get_vocab_size()
    gathered = chunks.repartition(4).mapInArrow(attention_lm._gather(path, size, 1.0), attention_lm.GATHERED).cache()
    slices = gathered.where(F.col("kind") == attention_lm.SLICED)
    n = slices.count()
    assert n == sum(-(-len(t.split()) // attention_lm.SLICE) for t in rows)
    count = np.zeros(2 * size + 2)
    for r in gathered.where(F.col("kind") == attention_lm.COUNTED).collect():
        count[r["symbols"]] += r["counts"]
    want = Counter(2 * x + (k == len(e) - 1) for t in rows for word in t.split() for e in [tokens.coder(path).tokenizer.encode(word, add_special_tokens=False).ids] for k, x in enumerate(e))
    assert {int(k): int(count[k]) for k in np.flatnonzero(count)} == want
    all_ = slices.collect()
    words, sizes = attention_lm._unpacked([np.array(r["symbols"]) for r in all_], size)
    flags = np.array([r["n"] for r in all_])
    w = attention_lm.windows(np.arange(len(words)), sizes, (flags & 1) > 0, (flags & 2) > 0)
    loss = []
    for rounds in ((), (0.004, 0.002)):
        monkeypatch.setattr(attention_lm, "ROUNDS", rounds)
        loss.append(attention_lm.fitted(gathered, size, n, count).loss_gradient(words, w)[0])
    assert loss[1] < loss[0]


def test_lm_learns_from_every_slice(spark, monkeypatch):
    """Every slice of every training document has one turn in one round, however many there are."""
    monkeypatch.setattr(attention_lm, "START", 10)
    rng, rounds, plain = np.random.default_rng(4), [], attention_lm._averaged
    rows = [" ".join(rng.choice(LANGS[("en", "de")[k % 2]], 100)) + f" only{k}" for k in range(120)] + EDGES

    def averaged(net, slices, *rest):
        rounds.append([(tuple(r[0]), r[1]) for r in slices.collect()])
        plain(net, slices, *rest)

    monkeypatch.setattr(attention_lm, "_averaged", averaged)
    held = F.col("doc_id") % 5 == 1
    assert attention_lm.score(frame(spark, rows), held, q.tokenizer_file("word_bpe_49k.json"), chunk_bytes=4096).count() == len(rows)
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in rows]
    assert sum(map(len, rounds)) == sum(max(-(-n // attention_lm.SLICE), 1) for k, n in enumerate(words) if k % 5 != 1)
    assert min(map(len, rounds)) > 0 and not set(rounds[0]) & set(rounds[-1])


def test_lm_counts_neighbours_of_every_slice():
    rng, size = np.random.default_rng(6), 40
    slices = [rng.integers(0, 2 * size + 2, n).tolist() for n in (0, 1, 30, 7)]
    near = (textvec.mix(np.arange(size, dtype=np.uint64)) % np.uint64(attention_lm.NEAR)).astype(int)
    want = np.zeros((size, attention_lm.NEAR))
    for s in slices:
        ids = [k // 2 for k in s if k < 2 * size]
        for i, a in enumerate(ids):
            for b in ids[max(0, i - attention_lm.REACH) : i] + ids[i + 1 : i + 1 + attention_lm.REACH]:
                want[a, near[b]] += 1
    batches = [pa.RecordBatch.from_arrays([pa.array(some, type=pa.list_(pa.int32()))], names=["symbols"]) for some in (slices[:2], slices[2:])]
    parts = {r["part"]: np.frombuffer(r["sums"], dtype=np.float32) for batch in attention_lm._neighbours(size)(iter(batches)) for r in batch.to_pylist()}
    assert np.array_equal(np.concatenate([parts[k] for k in sorted(parts)]).reshape(size, -1), want)


def test_lm_of_hard_and_long_words(spark):
    rows = [*HARD, "some words " * 150_000, "a b", None]
    got = {r["doc_id"]: r for r in attention_lm.score(frame(spark, rows), F.col("doc_id") == 1, q.tokenizer_file("word_bpe_49k.json"), chunk_bytes=4096).collect()}
    assert len(got) == len(rows) and all(np.isfinite(r["score"]) and r["score"] < 0 for r in got.values())
    assert (got[0]["n_known"], got[1]["n_known"], got[1]["n_tokens"]) == (2, 1, 2)  # the second text is not the first


# --- op10 -------------------------------------------------------------------------------------------


def brute_contamination(docs, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - window + 1, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def brute_longest(rows, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    out = {}
    for d, t in rows:
        w, best = split(t), (0, 0, None, None, None)
        for item, text in items:
            x = split(text)
            for o in range(len(x)):
                for i in range(len(w)):
                    n = 0
                    while o + n < len(x) and i + n < len(w) and x[o + n] == w[i + n]:
                        n += 1
                    if n >= min(window, len(x)) > 0:
                        best = min(best, (-n, 0 if item is not None else 1, item, o, i), key=lambda k: (k[0], k[1], k[2] or 0, k[3] or 0, k[4] or 0))
        out[d] = (-best[0], *best[2:])
    return out


def test_clean_rows_keep_a_column_named_like_row_numbers(spark):
    docs = spark.createDataFrame([(1, "lantern x1 here", 222, 7), (2, "nothing of it", 333, 8), (None, "lantern x1", None, 9)], "doc_id long, text string, _row long, _row_ long")
    bench = spark.createDataFrame([(1, "lantern x1"), (2, "of stone and lantern")], "item_id long, text string")
    for broadcast_bytes in (1 << 20, 1):
        assert [tuple(r) for r in decontaminate.keep_clean(docs, bench, 10, 20, broadcast_bytes).collect()] == [(2, "nothing of it", 333, 8)]


def test_files_without_an_id_have_their_licence(spark):
    line = "Licensed under the MIT License."
    docs = spark.createDataFrame([(None, "a/x.py", f"{line}\nimport os"), (1, "a/y.py", f"{line}\nimport os"), (None, "a/z.py", "import os")], "doc_id long, path string, text string")
    got = {r["path"]: (r["license"], r["inherited_from"]) for r in licenses.scan(docs).collect()}
    assert got["a/x.py"] == got["a/y.py"] and got["a/x.py"][0] is not None and got["a/z.py"][0] is None


def test_missing_ids_are_learned_from(spark):
    got = spark.createDataFrame([(None,), (7,)], "doc_id long").select(textvec.crc_bucket(F.col("doc_id"))).collect()
    assert [r[0] for r in got] == [0, zlib.crc32(b"7")]


@pytest.mark.parametrize("block_bytes, broadcast_bytes, window", [(200, 1 << 20, 10), (1 << 20, 1 << 20, 10), (300, 600, 10), (1 << 20, 1 << 20, 3), (1 << 20, 1 << 20, 21)])
def test_contamination_equals_brute_force(spark, block_bytes, broadcast_bytes, window):
    """In one block, in several, in several passes, and with windows longer than the depth of the arrays."""
    rng = np.random.default_rng(0)
    items = [(k, " ".join(rng.choice(WORDS, rng.integers(0, 30)))) for k in range(25)] + [(100, None), (101, "lantern x1"), (7, "stone stone"), (102, "... !")]
    items += [(103, f"{HARD[0]} by itself"), (104, HARD[3])]
    rows = EDGES + texts(40, 1) + HARD + [f"{HARD[1]} by itself", f"{HARD[0]}, by itself"]
    for k in range(20):
        item = items[k % 25][1].split()
        rows.append(" ".join(rng.choice(WORDS, 20)) + " " + ", ".join(item[k % 3 :]).upper() + " " + " ".join(rng.choice(WORDS, 9)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in decontaminate.contamination(frame(spark, rows), bench, window, block_bytes, broadcast_bytes).collect()}
    assert got == brute_contamination(list(enumerate(rows)), items, window)
    found = {r["doc_id"]: tuple(r[c] for c in decontaminate.LONGEST) for r in decontaminate.contamination(frame(spark, rows), bench, window, block_bytes, broadcast_bytes).collect()}
    assert found == brute_longest(list(enumerate(rows)), items, window)
    clean = decontaminate.keep_clean(frame(spark, rows), bench, window, block_bytes, broadcast_bytes)
    assert {r["doc_id"] for r in clean.collect()} == {k for k, x in got.items() if not x[-1]} and clean.columns == frame(spark, rows).columns
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(frame(spark, rows), bench.limit(0)).collect())


def test_longest_matches(spark):
    item = "zero " + " ".join(f"q{i}" for i in range(40))
    docs = frame(spark, ["q1 q2 q3", "pad pad " + " ".join(f"q{i}" for i in range(5, 37)) + " end", " ".join(f"q{i}" for i in range(9))])
    got = decontaminate.longest_matches(docs, spark.createDataFrame([(5, item), (6, "nowhere")], "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(5, 32, 6, 1, 2)]


@pytest.mark.parametrize("passes", [False, True])
def test_longest_matches_equal_brute_force(spark, passes):
    rng = np.random.default_rng(4)
    small = ["a", "b", "c"]
    rows = [" ".join(rng.choice(small, rng.integers(0, 12))) for _ in range(40)]
    long = " ".join(rng.choice(small, 60))
    rows += ["b " + long, long + " a", long]
    items = [(k, " ".join(rng.choice([*small, "d"], rng.integers(0, 9)))) for k in range(30)] + [(30, f"d {long} d"), (31, None)]
    docs = frame(spark, rows).orderBy(F.desc("doc_id"))
    want = []
    for i, t in items:
        q_, best = (t or "").split(), None
        for s in range(len(q_)):
            for d, text in enumerate(rows):
                w = text.split()
                for p in range(len(w)):
                    n = 0
                    while s + n < len(q_) and p + n < len(w) and q_[s + n] == w[p + n]:
                        n += 1
                    best = min(best or (0, 0, 0, 0), (-n, s, d, p)) if n else best
        if best:
            want.append((i, -best[0], *best[1:]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.longest_matches(docs, bench, 64 if passes else 1 << 20, 128 if passes else 1 << 20).collect()
    assert sorted(map(tuple, got)) == want


def test_suffix_array_is_sorted():
    words = np.random.default_rng(0).integers(0, 3, 400)
    first = np.array([0, 0, 150, 151, 400])
    array = decontaminate.SuffixArray(words, first)
    suffixes = [tuple(array.word[p : min(array.end[p], p + decontaminate.DEPTH)].tolist()) for p in array.order]
    assert suffixes == sorted(suffixes) and sorted(array.order.tolist()) == list(range(400))


# --- queries and pipeline ---------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs
    kept = {}
    for name, stage in p.STAGES[:-1]:
        rows = stage(spark, rows, SMALL).cache()
        assert rows.columns == docs.columns
        kept[name] = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert set(kept["decontamination"]) <= set(kept["near_dedup"]) <= set(kept["quality"]) <= set(kept["language_id"])
    want = {k for k, (_, c) in brute_components(list(kept["quality"].items()), 5, 80).items() if k == c}
    assert set(kept["near_dedup"]) == want
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    dirty = brute_contamination(list(kept["near_dedup"].items()), items, 10)
    assert set(kept["decontamination"]) == {k for k, x in dirty.items() if not x[-1]}
    pieces = p.STAGES[-1][1](spark, rows, SMALL).collect()
    assert {r["doc_id"] for r in pieces} == set(kept["decontamination"])
    assert [n for n, _ in p.STAGES] == ["language_id", "quality", "near_dedup", "decontamination", "packing"]


def test_pipeline_with_missing_and_repeated_ids(spark):
    """Rows without an id are learned from and judged like others; of repeated rows one stays; other columns, whatever their names, go along."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 120")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id"))).withColumns({"_row": F.col("n_chars") + 1, "kept": F.lit(True), "score": F.lit("s")})
    docs = docs.union(docs.where("n_chars % 5 = 0")).union(docs.limit(1).withColumns({"text": F.lit(None).cast("string")})).union(docs.limit(1).withColumn("text", F.lit("")))
    rows = docs
    for name, stage in p.STAGES[:-1]:
        before = rows.count()
        rows = stage(spark, rows, SMALL).cache()
        assert rows.columns == docs.columns and 0 < rows.count() <= before, name
        if name == "near_dedup":
            assert rows.count() == rows.select("text").distinct().count()
    assert rows.where("doc_id IS NULL").count() > 3 and rows.where("_row <> n_chars + 1 OR score <> 's'").count() == 0
    assert p.STAGES[-1][1](spark, rows, SMALL).count() >= rows.count()
    none = docs.limit(0)
    for _, stage in p.STAGES:
        none = stage(spark, none, SMALL) if none.columns == docs.columns else none
        assert none.count() == 0


def test_registered_names():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert json.dumps(sorted(names))


def test_shared_folder():
    from types import SimpleNamespace

    from wayline.llm import scratch

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master))

    assert scratch.shared_dir(session("spark://host:7077", "hdfs://a/b/")) == "hdfs://a/b"
    assert scratch.shared_dir(session("local[4]")).startswith("file:///")
    for master in ("local-cluster[3,2,1000]", "yarn"):
        with pytest.raises(ValueError):
            scratch.shared_dir(session(master))
