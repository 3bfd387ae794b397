import hashlib
import math
import os
import random
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import llm_brute as brute
from lexivec.llm import language, lattice, licences, lmscore, matroska, packing, toxicity
from lexivec.scratch import Scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, held string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None, 1, "x") for i, t, g, s in rows], SCHEMA)


def invented(rng, stems, n):
    return " ".join("".join(rng.choices(stems, k=rng.randrange(1, 4))) for _ in range(n))


STEMS = {"aa": ["the", "ing", "on", "er"], "bb": ["ü", "sch", "ei", "und"], "cc": ["ción", "que", "ar", "os"]}


def languages(seed=1, n=150):
    rng = random.Random(seed)
    return [(k, invented(rng, STEMS[g], rng.choice([3, 20, 80])), g, "s") for k, g in ((k, rng.choice(list(STEMS))) for k in range(n))]


def test_language(spark):
    rows = languages()
    rng = random.Random(9)
    mixed = invented(rng, STEMS["aa"], 120) + " " + invented(rng, STEMS["bb"], 60)
    odd = [(900, None, "aa", "s"), (901, "", None, "s"), (902, "12 34 !!", "aa", "s"), (903, mixed, None, "s"), (None, "the ing", "aa", "s"),
           (904, "the" * 50_000, None, "s"), (5, rows[5][1], "aa", "s")]
    got = language.identify(table(spark, rows + odd), lmscore.one_in(5, 0)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (brute.crc(i, 5) == 0) for i, *_ in rows)
    held = [(g, by[i]["lang_pred"]) for i, _, g, _ in rows if by[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert by[903]["lang_pred"] == "aa" and 0.55 < by[903]["score"] < 0.8
    assert {m["lang"] for m in by[903]["mixture"]} == {"aa", "bb"}
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_without_training(spark):
    docs = table(spark, [(1, "some words", None, "s")])
    assert language.identify(docs, lmscore.one_in(5, 0)).first()["lang_pred"] == "und"
    assert language.identify(table(spark, []), lmscore.one_in(5, 0)).count() == 0


def test_mixture_matches_plain_expectation_maximisation():
    rng = np.random.default_rng(3)
    logs = rng.normal(-5, 2, (60, 3))
    found = language.mixtures(logs, np.array([0, 60]))[0]
    like = np.exp(logs - logs.max(axis=1, keepdims=True))
    chosen = found > 0
    share = chosen / chosen.sum()
    for _ in range(language.ROUNDS):
        joint = like * share
        share = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
    assert np.allclose(found, share, atol=1e-3)


def labelled(seed=2, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        w = invented(rng, STEMS["aa"], rng.choice([10, 60, 200])).split()
        toxic = rng.random() < 0.3
        if toxic:
            for at in rng.choices(range(len(w)), k=3):
                w[at] = rng.choice(["vile", "vilk", "vilsch"]) + rng.choice(["on", "er", ""])
        rows.append((k, " ".join(w), "aa", "s"))
        labels.append((k, int(toxic), "x"))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled()
    frame = spark.createDataFrame([*labels, (None, 1, ""), (3, None, ""), (5, 0, "")], "doc_id bigint, toxic int, text string")
    odd = [(900, None, None, "s"), (901, "", None, "s"), (902, "ing vileon the", None, "s"), (903, "on " * 60_000, None, "s"), (None, "the", None, "s")]
    got = {r["doc_id"]: r for r in toxicity.score_texts(table(spark, rows + odd), frame, lmscore.one_in(4, 2)).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(got[i]["held_out"] == (brute.crc(i, 4) == 2) for i, *_ in rows)
    held = [(y, got[i]["predicted"]) for i, y, _ in labels if got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert got[902]["score"] > 10 * got[901]["score"] and got[900]["score"] == got[901]["score"]
    docs = table(spark, rows + odd)
    kept = toxicity.without_toxic(docs, frame)
    assert kept.columns == docs.columns and 0.6 * len(rows) < kept.count() < 0.8 * len(rows) + len(odd)


def test_toxicity_without_labels(spark):
    rows, _ = labelled(n=5)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.score_texts(table(spark, rows), none, lmscore.one_in(4, 2)).collect()} == {0.0}
    assert toxicity.without_toxic(table(spark, rows), none).count() == 5
    assert toxicity.score_texts(table(spark, []), none, lmscore.one_in(4, 2)).count() == 0


def test_shared_backoff_probabilities_sum_to_one():
    """Over all next bytes of one context the pooled model of seen grams leaves only backoff mass."""
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abc"), 4)) for _ in range(200)]
    grams = {}
    for w in words:
        padded = [1] * (toxicity.ORDER - 1) + [ord(c) for c in w] + [2]
        for k in range(toxicity.ORDER - 1, len(padded)):
            code = 0
            for b in padded[k - toxicity.ORDER + 1 : k + 1]:
                code = code << 8 | b
            grams[code] = grams.get(code, 0) + 1
    base = toxicity._shared(np.array(sorted(grams), np.uint64))
    assert ((base > 0) & (base < 1)).all()


def test_lattice():
    rng = random.Random(5)
    pieces = [bytes([b]) for b in range(256)] + [b" t", b"th", b"the", b" the", b"he", b"ing", b"in", b"aa", b"aaa"]
    logp = np.log(np.array([rng.random() for _ in pieces]) / len(pieces))
    weights = {p: math.exp(x) for p, x in zip(pieces, logp, strict=True)}
    vocabulary = lattice.Vocabulary(pieces)
    texts = [b" the", b" thething", b"aaaaaa", b"x", "é".encode(), b" " + b"the" * 40, b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = lattice.log_likelihoods(vocabulary, logp, data, offsets)
    for text, value in zip(texts, got, strict=True):
        want = brute.lattice_log(text, weights) if len(text) <= 64 else lattice._alone(vocabulary, logp, text)[0][-1]
        assert value == pytest.approx(want, rel=1e-9)
    counts = lattice.expected_counts(vocabulary, logp, data, offsets, np.ones(len(texts)))
    assert counts @ [len(p) for p in pieces] == pytest.approx(len(data))  # every segmentation covers every byte


@pytest.mark.parametrize("frequent", [0, 5, 1 << 18])
def test_lm_scores(spark, frequent):
    rows = languages(n=60)
    rows += [(900, None, None, "s"), (901, "", None, "s"), (902, "x" * 5000 + " THE the", None, "s"), (903, "\x00 é ▁", None, "s")]
    got = {r["doc_id"]: r for r in lmscore.lattice_scores(table(spark, rows), lmscore.one_in(7, 2), frequent=frequent).collect()}
    want = brute.base_scores([(i, t) for i, t, *_ in rows])
    assert set(got) == set(want)
    for i, (tokens, known, n, score) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, brute.crc(i, 7) == 2)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert got[900]["score"] == got[901]["score"] > got[902]["score"]


def test_lm_scores_without_training(spark):
    docs = table(spark, [(next(k for k in range(99) if brute.crc(k, 7) == 2), "some words", None, "s")])
    row = lmscore.lattice_scores(docs, lmscore.one_in(7, 2)).first()
    assert (row["n_known"], row["train_tokens"], row["base_score"]) == (0, 0, 0.0) and row["score"] < 0
    assert lmscore.lattice_scores(table(spark, []), lmscore.one_in(7, 2)).count() == 0


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 512, 4097, 70_001, 400_000])
def test_matroska_round_trip(size):
    payload = os.urandom(size) + bytes(-size % 64 or (64 if size == 0 else 0))
    media = matroska.write(payload)
    found = matroska.Reader(media)
    assert found.whole and found.payload(1) == payload
    assert [p.time_ns // 1_000_000 for p in found.packets] == [k * 64 for k in range(len(found.packets))]
    assert all(media[c.position : c.position + 4] == b"\x1f\x43\xb6\x75" for c in found.cues) and len(found.cues) == found.clusters


def test_matroska_lacing_and_unknown_sizes():
    def block(flags, body, time=0):
        return matroska.element(matroska.SIMPLE_BLOCK, b"\x82" + time.to_bytes(2, "big") + bytes([flags]) + body)

    frames = [b"a" * 300, b"bc", b"d" * 255, b"e"]
    xiph = block(0x82, bytes([3, 255, 45, 2, 255, 0]) + b"".join(frames))
    ebml = block(0x86, matroska._laced([300, 2, 255, 1])[1] + b"".join(frames), 5)
    fixed = block(0x04, bytes([1]) + b"xxyy", 9)
    group = matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, b"\x82\x00\x0b\x00zz") + matroska.element(0xFB, b"\x01"))
    cluster = b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + matroska._number(matroska.TIME, 1000) + xiph + ebml + fixed + group
    second = matroska.element(matroska.CLUSTER, matroska._number(matroska.TIME, 2000) + block(0x80, b"end"))
    media = matroska._HEAD + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + matroska._INFO + cluster + second
    found = matroska.Reader(media)
    assert found.whole and found.doc_type == "matroska"
    assert [media[p.begin : p.end] for p in found.packets] == [*frames, *frames, b"xx", b"yy", b"zz", b"end"]
    assert [p.time_ns // 1_000_000 for p in found.packets] == [1000] * 4 + [1005] * 4 + [1009] * 2 + [1011, 2000]
    assert [p.keyframe for p in found.packets] == [True] * 8 + [False] * 3 + [True]
    assert {p.track for p in found.packets} == {2} and found.clusters == 2
    for cut in range(0, len(media), 7):
        matroska.Reader(media[:cut])


def test_media_columns(spark):
    rows = [(1, None), (2, ""), (3, "é" * 40), (4, "x" * 100_000), (5, "é" * 40), (None, "t")]
    docs = table(spark, [(i, t, None, "s") for i, t in rows])
    files = matroska.as_media(docs)
    got = {r["doc_id"]: r for r in matroska.features(files).collect()}
    for i, t in rows:
        body = (t or "").encode()
        padded = body + bytes(-len(body) % 64 or (64 if not body else 0))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["whole"]) == (len(body), len(padded), True)
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
    assert got[3]["media_sha256"] == got[5]["media_sha256"] and got[3]["feature"] == got[5]["feature"]
    packets = matroska.packet_table(files)
    size = F.sum(F.col("end") - F.col("begin"))
    assert dict(packets.filter("doc_id = 4").groupBy("doc_id").agg(size).collect())[4] == 100_032
    broken = spark.createDataFrame([(1, b"\x1a"), (2, None), (3, b"")], "doc_id int, media binary")
    assert matroska.packet_table(broken).count() == 0
    assert matroska.features(matroska.as_media(docs.limit(0))).count() == 0


def test_packing(spark):
    rng = random.Random(6)
    rows = [(k, "w " * rng.choice([1, 30, 700, 2047, 2048, 5000]), None, "hot" if rng.random() < 0.4 else f"s{k % 9}") for k in range(300)]
    rows += [(400, None, None, None), (401, "", None, "hot"), (402, "same text here", None, "a"), (403, "Same  text HERE", None, "b"), (402, "same text here", None, "a")]
    for shard in (20_000, 40):
        docs = packing.measured(table(spark, rows))
        sizes = {r["doc_id"]: (r["n_tokens"], r["source"], r["cluster"]) for r in docs.select("doc_id", "n_tokens", "source", "cluster").collect()}
        got = packing.pack(docs, shard=shard).collect()
        total = sum(r["n_tokens"] for r in got)
        assert total == sum(len((t or "").split()) + 1 for _, t, *_ in rows)
        bins = {}
        for r in got:
            bins.setdefault(r["bin_id"], []).append(r)
        for members in bins.values():
            assert sum(m["n_tokens"] for m in members) <= packing.CAPACITY
            assert sorted(m["bin_offset"] for m in members)[0] == 0
            sources = [sizes[m["doc_id"]][1] for m in members if sizes[m["doc_id"]][1] is not None]
            clusters = [sizes[m["doc_id"]][2] for m in members if sizes[m["doc_id"]][2] is not None]
            assert len(set(sources)) == len(sources) and len(set(clusters)) == len(clusters)
    assert packing.pack(packing.measured(table(spark, []))).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = packing.Bins(100)
    for length, source in ((60, 0), (70, 1), (80, 2)):
        assert bins.find(length, source, 0) is None
        bins.place(length, source, 0)
    assert bins.find(15, 3, 0) == 2  # residual 20 is the tightest
    assert bins.find(15, 2, 0) == 1  # which holds source 2; the successor does not
    assert bins.find(25, 1, 0) == 0
    assert bins.find(41, 3, 0) is None


def test_ratios_of_all_grams(spark, monkeypatch):
    """Rare grams count, and ratios found by joins are those found at once."""
    rng = np.random.default_rng(8)
    word = rng.integers(97, 101, (3000, toxicity.ORDER)).astype(np.uint64)
    grams, n = np.unique((word << np.arange(0, 48, 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64), return_counts=True)
    toxic = rng.binomial(n, 0.3)
    rows = [(int(g), int(k - t), int(t), int(k)) for g, k, t in zip(grams, n, toxic, strict=True)]
    assert (n == 1).sum() > 500
    counts = spark.createDataFrame(rows, "gram bigint, ordinary bigint, toxic bigint, n bigint").cache()
    want = toxicity.ratios(grams, (n - toxic).astype(float), toxic.astype(float))
    every = toxicity.model_ratios(counts, Scratch(spark, "test"))
    assert all(np.array_equal(x, y) for x, y in zip(every, want, strict=True)) and len(every.grams) == len(grams)
    monkeypatch.setattr(toxicity, "GRAMS", 900)
    joined = toxicity.model_ratios(counts, Scratch(spark, "test"))
    assert np.array_equal(joined.grams, want.grams) and np.array_equal(joined.contexts, want.contexts)
    assert np.allclose(joined.known, want.known, atol=1e-5) and np.allclose(joined.new, want.new, atol=1e-5)
    known, new = toxicity.shared_ratios(counts, Scratch(spark, "test"))
    assert np.allclose([r["known"] for r in known.orderBy("gram").collect()], want.known, atol=1e-5)
    assert np.allclose([r["new"] for r in new.orderBy("context").collect()], want.new, atol=1e-5)


def test_rare_grams_are_learned(spark):
    """Texts whose words stand once in the labelled texts still give a model."""
    texts = table(spark, [(k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{j}x" for j in range(4)), None, "s") for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, toxic int")
    model = toxicity.learn(texts, labels)
    fold = F.pmod(F.shiftright(F.xxhash64("doc_id"), 7), F.lit(toxicity.FOLDS))
    learned = [r["text"] for r in texts.filter(fold > 0).collect()]
    grams = {("\x01" * 5 + w + "\x02")[k : k + 6] for text in learned for w in text.split() for k in range(len(w) + 1)}
    assert model is not None and len(model.ratios.grams) == len(grams) > 400


def test_licences(spark):
    mit = licences.SENTENCES
    rows = [(1, "Hello there. Released under the MIT License. Bye."), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n http"),
            (5, f"{mit[4]}. {mit[3]}."), (6, f"{mit[3]}. other words; {mit[4]}."), (7, "licensed under cc by 4 0\nAll rights reserved."), (8, "Released under the MIT License")]
    got = {r["doc_id"]: r for r in licences.scan(table(spark, [(i, t, None, "s") for i, t in rows])).collect()}
    assert {i: r["licence"] for i, r in got.items()} == {1: "MIT", 2: None, 3: None, 4: "Apache-2.0", 5: None, 6: "MIT", 7: "CC-BY-4.0", 8: "MIT"}
    assert got[4]["sentence_ids"] == "6,7,8" and got[7]["licences"] == "CC-BY-4.0,Proprietary"
    assert got[1]["first_position"] == 1 and got[2]["first_position"] == -1
    assert licences.scan(table(spark, [])).count() == 0


def test_licences_wrapped_and_marked(spark):
    """Every sentence where notices have it: wrapped, behind comment marks, with marks inside."""
    known = licences.SENTENCES
    rows, want = [], {}
    for k, sentence in known.items():
        for j, (width, mark) in enumerate([(30, ""), (40, "# "), (75, " * "), (75, "dnl "), (33, "REM ")]):
            body = "\n".join(mark + line for line in textwrap.wrap(sentence, width))
            rows.append((100 * k + j, f"{mark}Some heading\n{mark}\n{body}\n{mark}\n{mark}other text"))
            want[100 * k + j] = (str(k), 2)
    notices = [
        ("// SPDX-License-Identifier: MIT\nint x;", "21", "MIT"), ("/* SPDX-License-Identifier: Apache-2.0 */", "22", "Apache-2.0"),
        ("# SPDX-License-Identifier: GPL-3.0-or-later", "23", "GPL-3.0"), ("<!-- SPDX-License-Identifier: BSD-3-Clause -->", "24", "BSD-3-Clause"),
        (" * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed\n", "25", "MPL-2.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\r\nof this software and associated documentation files (the \"Software\"), to deal\r\nin the Software without restriction, including without limitation the rights\r\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\r\ncopies of the Software, and to permit persons to whom the Software is\r\nfurnished to do so, subject to the following conditions:\r\n\r\nThe above copyright notice and this permission notice shall be included in all\r\ncopies or substantial portions of the Software.\r\n", "3,4", "MIT"),
        ("    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n", "10,11", "GPL-3.0"),
        ("; This program is free software; you can redistribute it and/or modify\n; it under the terms of the GNU General Public License as published by\n; the Free Software Foundation; either version 2 of the License, or\n; (at your option) any later version.\n", "10,12", "GPL-2.0"),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n", "18,19", "BSD-3-Clause"),
        ("# Licensed under the Apache License, Version 2.0\n# (the \"License\"); you may not use this file except\n# in compliance with the License. You may obtain a\n# copy of the License at\n#\n#  http", "6,7,8", "Apache-2.0"),
        ("This is free and unencumbered software released into\nthe public domain.", "20", "Unlicense"),
        # No sentence goes on over a full stop, an empty line or other words.
        ("Licensed under the Apache License, Version 2.0. The License", "5", "Apache-2.0"), ("All rights\n\nreserved", "", None),
        ("All rights\nnot\nreserved", "", None), ("SPDX-License-Identifier: MIT OR Zlib", "", None), ("all\x01rights\x02reserved", "26", "Proprietary"),
    ]
    for k, (text, ids, _) in enumerate(notices):
        rows.append((k, text))
        want[k] = (ids, None)
    got = {r["doc_id"]: r for r in licences.scan(table(spark, [(i, t, None, "s") for i, t in rows])).collect()}
    assert {i: r["sentence_ids"] for i, r in got.items()} == {i: ids for i, (ids, _) in want.items()}
    assert all(got[i]["first_position"] == at for i, (_, at) in want.items() if at is not None)
    assert [got[k]["licence"] for k in range(len(notices))] == [licence for _, _, licence in notices]


def test_more_licences(spark):
    """Canonical notices, wrapped as they come."""
    bsd = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
           "1. Redistributions of source code must retain the above copyright notice,\n   this list of conditions and the following disclaimer.\n\n"
           "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n"
           "   and/or other materials provided with the distribution.\n")
    notices = [
        (bsd, "18,27,28", "BSD-2-Clause"),
        (bsd + "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n"
         "   this software without specific prior written permission.\n", "18,27,28,19", "BSD-3-Clause"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
         "copyright notice and this permission notice appear in all copies.\n", "29", "ISC"),
        (" * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n"
         " * version 2.1 of the License, or (at your option) any later version.\n", "35,36", "LGPL-2.1"),
        ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Affero General Public License as published by\n"
         "# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n", "10,38", "AGPL-3.0"),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http\n\n"
         "   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", "40,41,39", "Apache-2.0"),
        ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "31", "BSL-1.0"),
        ("// SPDX-License-Identifier: GPL-2.0-only", "42", "GPL-2.0"), ("/* SPDX-License-Identifier: ISC */", "49", "ISC"),
    ]
    got = {r["doc_id"]: r for r in licences.scan(table(spark, [(k, n[0], None, "s") for k, n in enumerate(notices)])).collect()}
    assert [(got[k]["sentence_ids"], got[k]["licence"]) for k in range(len(notices))] == [n[1:] for n in notices]
    assert {k for _, needed in licences.RULES for k in needed} == set(licences.SENTENCES)
