import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from portlight.llm import chat, decontaminate, licenses, spotsigs

from .. import oracle

WORDS = [f"word{i}" for i in range(400)]


def empty(spark, schema):
    return spark.createDataFrame([], schema)


# ---- chat ----


def test_preference_sql(spark):
    oracle.compare(spark, chat.op2_preference_format, chat.OP2_SQL)


def test_preference_segments(spark):
    schema = "pair_id long, turn long, role string, text string, part string"
    c = [(1, 0, "user", "q", "x"), (1, 1, "assistant", "a", "x"), (1, 2, "user", None, "x"), (1, 3, "assistant", "good", "x"), (2, 0, "user", "only", "x"), (None, 0, "user", "lost", "x"), (3, 0, None, None, "x"), (3, 0, None, None, "x")]
    r = [(1, 0, "user", "q", "y"), (1, 1, "assistant", "a", "y"), (1, 2, "user", None, "y"), (1, 3, "assistant", "bad", "y"), (1, 4, "user", "more", "y"), (3, 0, None, None, "y")]
    rows = chat.preference_segments(spark.createDataFrame(c, schema), spark.createDataFrame(r, schema))
    got = sorted((x.pair_id, x.part, x.turn, x.content, x.loss_mask, x.n_prompt_turns) for x in rows.collect())
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got == sorted(
        [(1, "prompt", 0, say("user", "q"), 0, 3), (1, "prompt", 1, say("assistant", "a"), 0, 3), (1, "prompt", 2, say("user", ""), 0, 3), (1, "chosen", 3, say("assistant", "good"), 1, 3), (1, "rejected", 3, say("assistant", "bad"), 1, 3),
         (1, "rejected", 4, say("user", "more"), 0, 3), (2, "chosen", 0, say("user", "only"), 0, 0), (3, "prompt", 0, say("", ""), 0, 1)]
    )
    whole = {x.pair_id: x for x in chat.assemble(rows).collect()}
    assert whole[1].prompt == say("user", "q") + say("assistant", "a") + say("user", "") and whole[1].rejected == say("assistant", "bad") + say("user", "more")
    assert chat.preference_segments(empty(spark, schema), empty(spark, schema)).count() == 0


# ---- SpotSigs ----


def brute_signatures(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    content = [w for w in words if w not in set(spotsigs.COMMON_WORDS)]
    chains, seen = set(), 0
    for w in words:
        if w in set(spotsigs.COMMON_WORDS):
            chains.add((w, *content[seen : seen + spotsigs.CHAIN]))
        else:
            seen += 1
    return chains or ({tuple(words)} if words else set())


def test_preference_of_long_and_tied_turns(spark):
    """Long texts, a turn that stands twice (the smallest role and text counts), other columns with the operator's own names."""
    long = "word " * 60_000
    rows = [(1, 0, "user", long, 9), (1, 1, "assistant", "b", 9), (1, 1, "assistant", "a", 9), (1, 2, "user", None, 9), (2, 0, None, "x", 9), (None, 0, "user", "x", 9), (3, None, "user", "x", 9)]
    other = [(1, 0, "user", long, 9), (1, 1, "assistant", "a", 9), (1, 2, "user", "", 9), (2, 0, None, "x", 9)]
    schema = "pair_id long, turn int, role string, text string, same int"
    got = sorted((r.pair_id, r.turn, r.part, len(r.content), r.loss_mask, r.n_prompt_turns) for r in chat.preference_segments(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)).collect())
    size = lambda role, text: len(f"<|{role}|>\n{text}<|end|>\n")
    assert got == [(1, 0, "prompt", size("user", long), 0, 2), (1, 1, "prompt", size("assistant", "a"), 0, 2), (1, 2, "chosen", size("user", ""), 0, 2), (1, 2, "rejected", size("user", ""), 0, 2), (2, 0, "prompt", size("", "x"), 0, 1)]
    assert chat.preference_segments(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0


def test_fingerprints_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").limit(60).collect()}
    docs |= {900: "", 901: None, 905: "no-common words", 10_000: "the", 10_001: "the", 5_000_000: "a b c the d"}
    frame = spark.createDataFrame([(k, v, "x") for k, v in docs.items()], "doc_id long, text string, sig string")
    got = {r.doc_id: r for r in spotsigs.fingerprint_report(frame).collect()}
    ids = sorted(docs)
    jaccard = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for i, k in enumerate(ids):
        text, nxt = docs[k] or "", docs[ids[(i + 1) % len(ids)]] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + nxt[:q]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = brute_signatures(text), brute_signatures(edited), brute_signatures(nxt)
        assert len(r.fingerprint) == 16 * len(a) and len(r.edited_fingerprint) == 16 * len(b)
        assert r.near_edited == pytest.approx(jaccard(a, b)) and r.near_next == pytest.approx(jaccard(a, c))
    assert got[10_000].fingerprint == got[10_001].fingerprint != ""
    assert spotsigs.fingerprint_report(empty(spark, "doc_id long, text string")).count() == 0
    assert [r.near_next for r in spotsigs.fingerprint_report(spark.createDataFrame([(1, "the dog ran"), (None, "x")], "doc_id long, text string")).collect()] == [1.0]


def test_repeated_ids_keep_their_rows(spark):
    """Rows of one doc_id follow each other by text, at the edges of ranges too."""
    texts = {k: f"the house of {WORDS[k % 400]} and the {WORDS[k % 300]}" for k in range(250, 262)}
    rows = [*texts.items(), (255, "a first"), (255, None), (256, "zz the last"), (256, "zz the last"), (256, ""), (511, "the end"), (511, "an end")]
    got = spotsigs.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted((k, t or "") for k, t in rows)
    want = []
    for (k, text), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        q = len(text) // 4
        want.append((k, len(text), hashlib.sha256((text[: len(text) - q] + nxt[:q]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)


def test_similar_pairs_against_brute_force(spark):
    base = " ".join(("the " if i % 4 == 0 else "") + WORDS[i % 97] + WORDS[i] for i in range(200))
    docs = {1: base, 2: base, 3: base + " the end of words here", 4: base.replace(WORDS[5], "other"), 5: "the quick brown fox jumps", 6: "", 7: None, 8: " ".join(base.split()[:150])}
    pairs, members = spotsigs.similar_pairs(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    cls = {r.doc_id: r.class_id for r in members.collect()}
    assert cls[2] == 1 and cls[7] == 6 and cls[3] == 3
    want = set()
    ids = sorted(set(cls.values()))
    for a in ids:
        for b in ids:
            x, y = brute_signatures(docs[a]), brute_signatures(docs[b])
            if a < b and x and y and len(x & y) / len(x | y) >= spotsigs.THRESHOLD:
                want.add((a, b))
    assert {(r.a, r.b) for r in pairs.collect()} == want != set()


def test_ranges_follow_each_other_over_sparse_keys(spark, monkeypatch):
    tops, plain = [], spotsigs.following
    monkeypatch.setattr(spotsigs, "following", lambda ranges, span: tops.append(ranges.count()) or plain(ranges, span))
    rng = random.Random(2)
    for keys in ([rng.randrange(-(2**40), 2**40) for _ in range(300)], list(range(70)), [5], []):
        tops.clear()
        ranges = sorted({k // 4 for k in keys})
        got = {r.range_: r.next_range_ for r in spotsigs.next_ranges(spark.createDataFrame([(k,) for k in keys], "key_ long"), 4).collect()}
        assert got == dict(zip(ranges, ranges[1:] + ranges[:1], strict=True))
        assert tops[-1] <= 4  # rows of the only window over all


# ---- licences ----


def test_licences_sql(spark):
    oracle.compare(spark, licenses.op7_sentence_licences, licenses.ORACLE)


def test_licence_rules(spark):
    bsd = [k for k, v in licenses.SENTENCES.items() if v.startswith("BSD")]
    docs = [(1, "x\n" + ".\n".join(bsd) + "."), (2, ". ".join(bsd[:3])), (3, ". ".join(reversed(bsd))), (4, "Released   under the mit LICENSE!\nLicensed under the Apache License, Version 2.0."), (5, None), (6, ""), (7, "All rights reserved"), (4, "Released under the MIT License")]
    got = sorted((r.doc_id, r.licences, r.status, r.n_sentences) for r in licenses.scan(spark.createDataFrame([(*d, "y") for d in docs], "doc_id long, text string, found string")).collect())
    assert got == [(1, "BSD-3-Clause", "licensed", 4), (2, "BSD-2-Clause", "licensed", 3), (3, "", "unmatched", 4), (4, "MIT", "licensed", 1), (4, "MIT,Apache-2.0", "licensed", 2), (5, "", "none", 0), (6, "", "none", 0), (7, "", "unmatched", 1)]


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{}Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{}Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

{}Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you
may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_wrapped_licence_texts(spark):
    full = {"MIT": MIT, "BSD-3-Clause": BSD.format("1. ", "2. ", "3. "), "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL}
    texts = [(name, text) for name, text in full.items()] + [("BSD-3-Clause", BSD.format("(1) ", "b) ", "* "))]
    for mark in ("# ", " * ", "// ", "REM ", "dnl "):
        texts += [(name, "".join(f"{mark}{line}\n" for line in text.splitlines())) for name, text in full.items()]
    texts += [(name, text.replace("\n", "\r\n")) for name, text in full.items()]
    texts += [(name, re.sub(r"(?<!\n)\n(?!\n)\s*", " ", text)) for name, text in full.items()]  # a line for each paragraph
    texts += [("MIT", "A heading\nReleased under the MIT License\nand more"), ("MIT", "Released under the MIT\nLicense " + "-" * 5000)]
    texts += [("", "Released under the\n\nMIT License"), ("", "Released under the MIT License of ours"), ("", "Released under the MIT. License")]
    got = {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [(i, got[i]) for i in range(len(texts))] == [(i, name) for i, (name, _) in enumerate(texts)]


ISC = """Copyright (c) 2020, A. Author

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY DAMAGES."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_more_licence_texts(spark):
    agpl = GPL2.replace("software; you", "software: you").replace("GNU General Public License as", "GNU Affero General Public License as").replace("Foundation; either version 2", "Foundation, either version 3")
    full = {"ISC": ISC, "Unlicense": UNLICENSE, "MPL-2.0": MPL, "LGPL-2.1-or-later": LGPL, "GPL-2.0-or-later": GPL2, "AGPL-3.0-or-later": agpl, "LGPL-3.0-or-later": agpl.replace("Affero", "Lesser")}
    texts = [(name, "".join(f"{mark}{line}\n" for line in text.splitlines())) for name, text in full.items() for mark in ("", "# ", " * ", "// ")]
    texts += [("MIT", "// SPDX-License-Identifier: MIT\nint x;"), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"), ("", "Licensed under CC BY-SA"), ("", ISC.replace("fee", "money")), ("ISC", ISC + "\nAll rights reserved.")]
    got = {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [(i, got[i]) for i in range(len(texts))] == [(i, name) for i, (name, _) in enumerate(texts)]


def test_pattern_finds_each_sentence_whole():
    known = [licenses.normalised(x) for x in licenses.SENTENCES]
    pattern = re.compile(rf"(?<![^\n])({licenses.any_sentence(known)})(?![^\n])")
    for x in known:
        assert pattern.findall(f"before\n{x}\nafter") == [x] and not pattern.findall(f"before {x}\nafter") and not pattern.findall(f"{x} after")


# ---- decontamination ----


def brute_leaks(docs, items):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    found = {}
    for k, text in docs:
        d = words(text)
        for item, t in items:
            w = words(t)
            if len(w) < 5 or len(d) < 5:
                continue
            want = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
            have = [tuple(d[i : i + 5]) for i in range(len(d) - 4)]
            for start in range(max(1, len(have) - len(want) + 1)):
                win = have[start : start + len(want)]
                shared = sum(min(win.count(x), want.count(x)) for x in set(win))
                if (s := shared / (len(win) + len(want) - shared)) >= 0.8:
                    found[k, item] = max(found.get((k, item), (0, 0)), (s, -start))
    return {k: (round(s, 9), -m) for k, (s, m) in found.items()}


def test_leaks_against_brute_force(spark):
    items = [(1, " ".join(WORDS[:40])), (2, " ".join(WORDS[100:125]) + ". " + " ".join(WORDS[100:110])), (3, "too short here"), (4, None), (None, " ".join(WORDS[:40]))]
    near = list(WORDS[:40])
    near[39] = "changed"
    docs = [(1, "Intro text. " + " ".join(WORDS[:40]).upper() + "! Outro."), (2, " ".join(near)), (3, " ".join(WORDS[:20])), (4, " ".join(WORDS[200:300])), (5, None), (6, ""), (7, " ".join(WORDS[:39])), (8, " ".join(WORDS[100:125] + WORDS[100:110] + WORDS[:40])),
            (9, " ".join(WORDS[:40] + ["x"] + WORDS[:40])), (9, " ".join(WORDS[:40] + ["x"] + WORDS[:40])), (None, " ".join(WORDS[:40])), (10, " ".join(WORDS[:17] + ["inserted"] + WORDS[17:40]))]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    rows = decontaminate.find_leaks(frame, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int"))
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in rows.collect()}
    assert got == brute_leaks([d for d in docs if d[0] is not None], [i for i in items if i[0] is not None])
    assert {(1, 1), (2, 1), (8, 1), (8, 2), (9, 1)} <= set(got)
    assert decontaminate.find_leaks(empty(spark, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.find_leaks(frame, empty(spark, "item_id long, text string")).count() == 0


def test_blocks_find_all_within_radius(spark):
    rows = spark.range(200).select(F.xxhash64("id").alias("a"), "id")
    flips = F.lit(0).cast("long")
    for i in range(decontaminate.RADIUS):
        flips = flips.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") * 7 + i * 3).cast("int") % 64))
    both = rows.withColumn("b", F.col("a").bitwiseXOR(flips)).withColumn("x", decontaminate.blocks("a")).withColumn("y", decontaminate.blocks("b"))
    assert both.filter("bit_count(a ^ b) <= 20 and not exists(zip_with(x, y, (p, q) -> p = q), z -> z)").count() == 0
