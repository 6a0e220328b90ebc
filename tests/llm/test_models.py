import hashlib
import random
import time
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolens.llm import decontaminate, htmltext, langid, pii, toxicity
from repolens.llm.boosting import boost, calibrate
from repolens.llm.licenses import NAMES, RULES, SENTENCES, TRIGGER, oracle, scan_licences

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, t string, score double, held_out boolean, ids string, base string"


def docs(spark, rows):
    """(doc_id, text, lang), with further columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, lang, "s", 1, 0, "t", 0.0, True, "x", "y") for i, t, lang in rows], DOCS)


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


# licences


APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.\n"
MIT = "MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.\n"
GPL = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version %s of the License, or\n(at your option) any later version.\n"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
THIRD = "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"


def commented(text, mark):
    return "".join(f"{mark} {line}\n" for line in text.split("\n"))


LICENCES = [
    ("Words.\nLicensed under the Apache License, Version 2.0.\nMore", "Apache-2.0"),
    (APACHE, "Apache-2.0"),
    (commented(APACHE, "#"), "Apache-2.0"),
    ("/*\n" + commented(APACHE, " *") + " */", "Apache-2.0"),
    ("Apache License\n   Version 2.0, January 2004\nhttp://www.apache.org/licenses/", "Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", "GPL-3.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", "LGPL-3.0"),
    (MIT, "MIT"),
    (commented(MIT, "//"), "MIT"),
    (GPL % 2, "GPL-2.0-or-later"),
    (commented(GPL % 3, ";;"), "GPL-3.0-or-later"),
    (BSD, "BSD-2-Clause"),
    (BSD + THIRD, "BSD-3-Clause"),
    (commented(BSD + THIRD, "--"), "BSD-3-Clause"),
    ("// SPDX-License-Identifier: MIT\n// SPDX-FileCopyrightText: someone\nint x;", "MIT"),
    ("# spdx-license-identifier: GPL-2.0+", "GPL-2.0-or-later"),
    ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0"),
    ("SPDX-License-Identifier: MIT OR Foo-1.0", "MIT,UNKNOWN"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttp://www.eclipse.org/legal/epl-2.0.", "EPL-2.0"),
    ("This project is distributed under the terms of the Mozilla Public License 2.0.", "MPL-2.0"),
    ("Released under the Frobnicate License, version 7.", "UNKNOWN"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Released under the MIT License. licensed under cc by-nc 4.0!\nReleased under the MIT license.", "MIT,CC-BY-NC-4.0"),
    ("This is unlicensed under nothing. Permission was not granted.", ""),
    (None, ""),
    ("", ""),
    ("x " * 100_000 + ".\nThis work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("This work is dedicated to the public\ndomain.", "Public-Domain"),
    ("This work is dedicated to the public  domain.", "Public-Domain"),
    ("this work is dedicated to\n the public\xa0domain", "Public-Domain"),
    ("Dedicated to the public\ndomain.", ""),
]


def test_licences(spark):
    rows = [(i, t, None) for i, (t, _) in enumerate(LICENCES)] + [(None, LICENCES[0][0], None), (1, APACHE, None)]
    got = [(r["doc_id"], r["licences"]) for r in scan_licences(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(i, want) for i, (_, want) in enumerate(LICENCES)] + [(None, "Apache-2.0"), (1, "Apache-2.0")], key=str)
    row = scan_licences(docs(spark, [(1, APACHE, None)])).first()
    assert (row["sentence_ids"], row["n_sentences"]) == ("=Apache-2.0,ApacheUse,ApacheCopy,ApacheUrl,ApacheAsIs", 5)
    assert scan_licences(docs(spark, [])).count() == 0


def test_licences_equal_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, t, None) for i, (t, _) in enumerate(LICENCES)]
    docs(spark, rows).select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(con.execute(oracle()).fetchall())
    assert sorted((r["doc_id"], r["sentence_ids"], r["licences"], r["n_sentences"]) for r in scan_licences(docs(spark, rows)).collect()) == want


LEADS = ("Licensed under ", "Released under the ", "This work is distributed under ", "Made available under ", "The code is dual-licensed under the ", "Published under the terms of the ", "Code is under the ", "We use the ")


def test_every_name_after_every_lead(spark):
    duckdb = pytest.importorskip("duckdb")
    cases = [(f"{lead}{name.upper() if k % 2 else name}.", licence) for k, lead in enumerate(LEADS) for licence, names in NAMES.items() for name in names]
    cases += [("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"), ("// SPDX-License-Identifier: (MIT AND GPL-2.0-only WITH Classpath-exception-2.0)", "GPL-2.0,MIT"), ("Licensed under MIT OR Apache-2.0.", "Apache-2.0,MIT"), ("Dual-licensed under the MIT and Apache 2.0 licenses.", "Apache-2.0,MIT"), ("SPDX-License-Identifier: Foo-1.0 OR MIT", "MIT,UNKNOWN"), ("We use the MIT license for this project.", "MIT"), ("The house is under the bridge. We use a hammer.", "")]
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"], r["n_sentences"]) for r in scan_licences(docs(spark, [(i, t, None) for i, (t, _) in enumerate(cases)])).collect()}
    assert [(t, got[i][1]) for i, (t, _) in enumerate(cases)] == [(t, x) for t, x in cases]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(cases)])
    assert {r[0]: r[1:] for r in con.execute(oracle()).fetchall()} == got


def test_licence_rules_are_reachable():
    """Each identifier of a rule is a sentence's, each licence has a rule, and each known sentence passes the guard."""
    assert {i for _, run in RULES for i in run} <= {*SENTENCES.values(), "UNKNOWN"}
    assert len({name for name, _ in RULES}) >= 50
    assert all(any(re.search(TRIGGER, w) for w in s.split()) for s in SENTENCES)


# languages


def test_languages(spark):
    rng = random.Random(2)
    make = lambda sounds: " ".join("".join(rng.choices(sounds, k=rng.randint(1, 3))) for _ in range(60))
    sounds = {"aa": ["ka", "to", "mi"], "bb": ["ße", "rü", "st"], "cc": ["ño", "lla", "ci"]}
    rows = [(i, make(sounds[lang := sorted(sounds)[i % 3]]), lang) for i in range(300)]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (1003, "kato " * 40_000, None), (None, rows[0][1], "cc"), (5, rows[5][1], None)]
    got = langid.identify_languages(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"] and by[1001]["score"] == 0
    tested = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert len(tested) > 30 and all(r["lang_pred"] == sorted(sounds)[r["doc_id"] % 3] for r in tested)
    assert langid.identify_languages(docs(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.identify_languages(docs(spark, [(1, "abc", None)])).collect()} == {"und"}


def test_bundles_are_sums_of_bound_trigrams(monkeypatch):
    own = langid.Bundler(64)
    vector = lambda c: np.random.default_rng([7, c]).choice(np.array([-1, 1], np.int8), 64).astype(int)
    text = " héllo wörld 語 дом"
    codes = [0] + [ord(c) if c != " " else 0 for c in text.strip()] + [0]
    want = sum(np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for a, b, c in zip(codes, codes[1:], codes[2:]))
    assert np.array_equal(own.bundle(text), want) and np.array_equal(own.bundle(text.upper() + "!!"), want)
    for kept, together, letters in ((5, 3, 2), (7, 100, 4096)):
        monkeypatch.setattr(langid, "KEPT", kept)
        monkeypatch.setattr(langid, "TOGETHER", together)
        monkeypatch.setattr(langid, "LETTERS_KEPT", letters)
        assert np.array_equal(langid.Bundler(64).bundle(text), want)


def test_scripts_are_kept_apart():
    """Texts in letters that share no code are told apart though their shapes are alike."""
    own = langid.Bundler()
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    plain = "the word of a text "
    for start in (0x430, 0x3B1, 0x5D0, 0x905, 0x4E00, 0xAC00):
        other = "".join(chr(start + ord(c) - 97) if c.isalpha() else c for c in plain)
        assert abs(cosine(own.bundle(plain), own.bundle(other))) < 0.45 and cosine(own.bundle(other), own.bundle(other * 2)) > 0.9


def test_rare_languages_are_learned(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["kato", "mika", "toka"], k=30)), "aa") for i in range(400)] + [(1000 + i, " ".join(rng.choices(["bless", "brust", "strub"], k=30)), "bb") for i in range(8)]
    found = langid.learn_prototypes(docs(spark, rows), train_rows=20)
    assert sorted(found) == ["aa", "bb"] and all(np.linalg.norm(p) for p in found.values())


# toxicity


def made_toxic(n, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(800)]
    bad = ["zozzle", "zozmug", "quibrat"]
    rows = []
    for i in range(n):
        words, y = rng.choices(plain, k=rng.randint(5, 150)), int(i % 4 == 0)
        if y:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), y))
    return rows


def test_toxicity(spark):
    rows = made_toxic(600)
    more = [(9000, None), (9001, ""), (9002, "1 2 !"), (9003, "abc def " * 20_000 + "zozzle"), (None, "abc")]
    table = docs(spark, [(i, t, None) for i, t, _ in rows] + [(i, t, None) for i, t in more] + [(3, rows[3][1], None)])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(0, 1, 1), (5, 1, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(table, labels).collect()
    assert len(got) == len(rows) + len(more) + 1
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert [by[i] for i in (9000, 9001, 9002)] == [0, 0, 0] and by[9003] == 1
    tested = [(by[i], y) for i, _, y in rows if held_out(i)]
    assert sum(p == y for p, y in tested) >= 0.95 * len(tested)
    assert toxicity.score_toxicity(docs(spark, []), labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(table.limit(3), labels.where("false")).collect()} == {0.0}


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(rng)
    for name in ("w", "b", "u", "wa", "va", "out"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    spelled = toxicity.spell(["one", "two", "three", "zz"])
    x, count, _ = net.inputs(spelled)
    assert count.tolist() == [3 + 2 + 1, 3 + 2 + 1, 5 + 4 + 3, 2 + 1]
    ids, y = np.array([[0, 1, 2, 3], [2, 0, -1, -1], [3, -1, -1, -1]]), np.array([1.0, 0.0, 1.0])
    _, d, d_x = net.gradients(net.project(x), x, ids, y)
    for name, at in (("w", (0, 1, 2)), ("w", (1, 3, 20)), ("b", (1, 5)), ("u", (0, 2, 3)), ("u", (1, 4, 18)), ("wa", (3, 1)), ("va", (2,)), ("out", (4,)), ("out", (-1,))):
        value, losses = getattr(net, name), []
        for step in (1e-3, -2e-3):
            value[at] += step
            losses.append(net.gradients(net.project(x), x, ids, y)[0])
        value[at] += 1e-3
        assert abs((losses[0] - losses[1]) / 2e-3 - d[name][at]) < 2e-3, name
    x2 = x.copy()
    x2[2, 1] += 1e-2
    moved = net.gradients(net.project(x2), x2, ids, y)[0] - net.gradients(net.project(x), x, ids, y)[0]
    assert abs(moved / 1e-2 - d_x[2, 1]) < 2e-3


def test_windows_cover_every_word():
    for n in (1, 15, 16, 17, 32, 33, 48, 49, 200):
        w = toxicity.windows_of(np.arange(n))
        assert set(w[w >= 0].tolist()) == set(range(n)) and w.shape[1] == toxicity.WINDOW
    assert toxicity.windows_of(np.array([5] * 90)).max(axis=1).tolist() == [5] * 5


def test_whole_words_are_spelled():
    """Words that differ in the middle only, and a word that is read in pieces."""
    a, b = "a" * 40 + "zozzle" + "b" * 40, "a" * 40 + "elzzoz" + "b" * 40
    net = toxicity.Network.fresh(np.random.default_rng(1))
    x = net.inputs_of([a, b])
    assert np.abs(x[0, toxicity.DIM :] - x[1, toxicity.DIM :]).max() > 0
    long = "".join(random.Random(2).choices("abcdef", k=2 * toxicity.LETTERS + 17))
    assert np.allclose(net.inputs_of(["x", long, "y"]), net.inputs(toxicity.spell(["x", long, "y"]))[0], atol=1e-6)


def test_the_network_learns_what_log_odds_cannot():
    """Both words are in all texts; only their order tells. Log-odds of words or of n-grams within them are the same for both classes."""

    def made(n, seed):
        rng = random.Random(seed)
        plain = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
        rows = []
        for i in range(n):
            words = rng.choices(plain, k=rng.randint(4, 26))
            at = rng.randrange(len(words) + 1)
            words[at:at] = ["zor", "mip"] if i % 2 else ["mip", "zor"]
            rows.append((" ".join(words), i % 2))
        return rows

    rows = made(1500, 1)
    net = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    unseen = made(400, 2)
    right = [(s >= 0.5) == y for s, (_, y) in zip(toxicity.Scorer(net).scores([t for t, _ in unseen]), unseen)]
    assert np.mean(right) > 0.9


def test_learning_is_bounded_by_characters(spark):
    rows = made_toxic(200)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    table = docs(spark, [(i, t, None) for i, t, _ in rows] + [(1000, "abc " * 300_000, None)])
    seen = []
    real = toxicity.train
    try:
        toxicity.train = lambda texts, labels, seed: seen.append(sum(map(len, texts)))
        toxicity.learn(table, labels, train_characters=20_000)
    finally:
        toxicity.train = real
    assert 15_000 < seen[0] <= 20_000


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            twice = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))]
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and sum(twice) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out)]


def test_personal_data(spark):
    rng = random.Random(4)
    texts = [None, "", "a@b.c%d@e.f x@y x@y.z.", "1.2.3.4.5.6.7.8 1.1.1.256 001.02.3.4 1.2.3", "+1 (555) 010-9999 +49 30 123456-78  +12 +1+2+3456789012", "4111 1111-1111 1111 and 4111 1111 1111 1112 and 1 2 3 4 5", "é" * 9 + "x@y.zz\n4111111111111111é", "1 " * 4000, "a" * 50_000, "9" * 20_000, "+1 " * 3000, "mail bob(at)foo.com or call (555) 123-4567 card 4111.1111.1111.1111 on 2020-01-02"]
    texts += ["".join(rng.choices("12345.@+- ax()", k=300)) for _ in range(150)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, texts[2], None), (2, texts[2], None)]
    got = pii.find_personal_data(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        base = plain_base(texts[2 if r["doc_id"] is None else r["doc_id"]] or "")
        spans = r["spans"].split(",") if r["spans"] else []
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), r["doc_id"]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(b.startswith(k) for b in base) for k in PATTERNS]
        assert set(base) <= set(spans) and len(set(spans)) == len(spans)
    last = next(r["spans"] for r in got if r["doc_id"] == 11)
    assert last == "email:5:19,phone:28:42,card:48:67"
    assert pii.find_personal_data(docs(spark, [])).count() == 0


def test_chosen_spans_equal_brute_force(spark):
    rng = random.Random(12)
    rows = [(0, [], []), (1, [(0, 5, 0)], []), (2, [], [(0, 4, 1, 0.9), (3, 8, 3, 0.5), (7, 9, 1, 0.1)]), (3, [(2, 3, 0), (2, 6, 3)], [(0, 2, 1, 0.5), (5, 7, 1, 0.5), (0, 2, 1, 0.5)])]
    for i in range(4, 60):
        span = lambda: (a := rng.randrange(120), a + rng.randint(1, 12), rng.randrange(4))
        rows.append((i, [span() for _ in range(rng.randint(0, 4))], [(*span(), rng.choice([0.1, 0.2, 0.5])) for _ in range(rng.randint(0, 40))]))
    table = spark.createDataFrame(rows, "id int, base array<struct<s:int,e:int,k:int>>, proposed array<struct<s:int,e:int,k:int,score:double>>")
    got = {r["id"]: sorted((x["s"], x["e"], x["k"]) for x in r["all"]) for r in table.select("id", pii.chosen(F.col("base"), F.col("proposed")).alias("all")).collect()}
    for i, base, proposed in rows:
        taken = list(base)
        for s, e, k, _ in sorted(proposed, key=lambda x: (-x[3], x[0], x[2], x[1])):
            if not any(s < y[1] and y[0] < e for y in taken):
                taken.append((s, e, k))
        assert got[i] == sorted(taken), i
    assert got[2] == [(0, 4, 1), (7, 9, 1)]


def test_many_spans_in_one_text(spark):
    """Base spans of 20,000 numbers, as Python's re finds them."""
    text = " ".join(f"+49 30 {k:08d}{',' * (k % 3)}" if k % 2 else f"call 555-{k % 1000:03d}-{k % 10000:04d} now" for k in range(20_000))
    r = pii.find_personal_data(docs(spark, [(1, text, None)])).first()
    base = plain_base(text)
    assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and r["n_phone"] == 10_000
    assert len(r["spans"].split(",")) == len(base) + 10_000


def test_proposed_forms(spark):
    texts = ["mail bob (At) foo.com", "bob ( at ) foo ( dot ) org", "X AT foo DOT com", "from fe80::1", "host 2001:db8::ff00:42", "use std::add", "Face::bed"]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(7)] == ["email:5:21", "email:0:26", "email:0:16", "ip:5:12", "ip:5:22", "", ""]


def test_boosted_trees_agree_as_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (400, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(int)
    model = boost(x, y)
    assert (((model.raw(x) > 0) == y).mean()) > 0.97
    table = spark.createDataFrame([(k, *map(int, r)) for k, r in enumerate(x)], "k int, a int, b int, c int")
    got = [r[0] for r in table.select("k", model.raw_column([F.col(c) for c in "abc"]).alias("s")).orderBy("k").select("s").collect()]
    assert np.allclose(got, model.raw(x))
    cut = calibrate(np.array([3.0, 2.0, 2.0, 1.0]), np.array([1, 1, 0, 0]), 0.9)
    assert 2 < cut < 3 and calibrate(np.array([1.0]), np.array([0]), 0.9) == float("inf")


# HTML


def brute_marginals(model, nodes, rows):
    import itertools
    import math

    total, on = 0.0, [0.0] * len(nodes)
    for states in itertools.product((0, 1), repeat=len(nodes)):
        e = sum(s * sum(model.weights[i] * v for i, v in row) for s, row in zip(states, rows))
        e += sum(model.pair[n.text is None][states[n.parent]][s] for n, s in zip(nodes[1:], states[1:]))
        total += math.exp(e)
        for k, s in enumerate(states):
            on[k] += s * math.exp(e)
    return [x / total for x in on]


def test_messages_give_exact_marginals():
    rng = random.Random(0)
    nodes = htmltext.parse("<body><nav><li>a<li><a>b</a></nav><article><p>c d e.<p>f</article>g")
    model = htmltext.Model([rng.uniform(-1, 1) for _ in htmltext.NAMES], [[[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)] for _ in range(2)])
    rows = [htmltext.features(nodes, k) for k in range(len(nodes))]
    assert len(nodes) < 16
    assert np.allclose(model.marginals(nodes, rows)[0], brute_marginals(model, nodes, rows))


def test_html_accuracy_on_unseen_layouts():
    rng, wrong, total = random.Random(77), 0, 0
    model = htmltext.default_model()
    for _ in range(200):
        nodes = htmltext.parse(htmltext.example_page(rng))
        p, _ = model.marginals(nodes, [htmltext.features(nodes, k) for k in range(len(nodes))])
        leaves = [(n.text.lstrip("© ").lower().startswith("c"), q > 0.5) for n, q in zip(nodes, p) if n.text is not None]
        wrong, total = wrong + sum(a != b for a, b in leaves), total + len(leaves)
    assert wrong < 0.02 * total


def test_extract_text(spark):
    article = "<article><h1>Some title &amp; more</h1><p>First  words\n here&nbsp;now <b>and<br>then.<p>Second one, which is longer than that.</article>"
    page = f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>a</a><li><a href='/b>c'>b</a></ul></nav><!-- <p>no</p> --><div class=ad>Buy this now.</div>{article}<div class=comments><p>I think that this is a reader's comment.</p></div><footer>&copy; 2020 us</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<nav><a href=x>only</a></nav>"), (None, "u", page), (1, "u", page), (5, "u", "<p>" * 30_000), (6, "u", '<a href="' * 2000), (7, "u", page[: page.index("longer")] + "<a href='/x")]
    got = [tuple(r) for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    text = "Some title & more\nFirst words here now and then.\nSecond one, which is longer than that."
    by = {r[0]: r for r in got}
    assert len(got) == len(rows) and got[0] == got[5] == (1, "u", text, len(text)) and by[None][2] == text
    assert by[2][2:] == ("", 0) and by[3][1:] == (None, "", 0) and by[4][2] == "" and by[5][2] == ""
    assert by[7][2] == "Some title & more\nFirst words here now and then.\nSecond one, which is"
    assert htmltext.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "piece,text",
    [
        ('<script src="a.js"/>var leaked = 1;</script>', None),
        ("<script src=https://cdn.x/y/>var leaked = 1;</script>", None),
        ("<svg><g><svg><text>in</text></svg>inner text leak</g></svg>", None),
        ("<svg/><p>More words stand here.</p>", "More words stand here."),
        ("<template><p>x</p><template>y</template>z</template>", None),
        ("<p>with <math><mi>x</mi><mo>+</mo></math> inside it.</p>", "with x+ inside it."),
        ("<noscript><p>Text without scripts is here.</p></noscript>", "Text without scripts is here."),
        ("<object><p>A fallback text is here for you.</p></object>", "A fallback text is here for you."),
        ('<div style="display:none"><p>Hidden words that nobody sees.</p></div>', None),
        ("<p hidden>Hidden words that nobody sees.</p>", None),
        ('<p style="overflow:hidden" title="a hidden thing">Shown words are here, in a box.</p>', "Shown words are here, in a box."),
        ("<p>Copyright law is the subject of this article, which says a lot.</p>", "Copyright law is the subject of this article, which says a lot."),
        ('<section class="comments-on-theory"><p>What others say of it stands in this section.</p></section>', "What others say of it stands in this section."),
        ("<xmp>a <b>shown</b> &amp; raw text of a page.</xmp>", "a <b>shown</b> &amp; raw text of a page."),
        ('<div class="reader-comments"><p>I think that this is a comment.</p></div>', None),
    ],
)
def test_what_is_text_of_a_page(piece, text):
    page = f"<body><nav><a href=/>a</a></nav><article><h1>Title of it</h1><p>First words are here.</p>{piece}<p>Last words are there, in the end.</p></article><footer>c</footer>"
    got = htmltext.main_text(page, htmltext.default_model()).split("\n")
    assert got == ["Title of it", "First words are here.", *([text] if text else []), "Last words are there, in the end."]


def test_names_of_a_body_hide_no_page():
    page = '<body id="main-menu-content" class="page-with-sidebar-left"><nav><a href=/>a</a></nav><article><h1>Title of it</h1><p>First words are here.</p></article></body>'
    assert htmltext.main_text(page, htmltext.default_model()) == "Title of it\nFirst words are here."


def test_cues_of_names():
    assert htmltext.cues_of("site-header") == (frozenset({"header"}), False)
    assert htmltext.cues_of("mainMenu wide") == (frozenset({"menu"}), False)
    assert htmltext.cues_of("comment-list") == (frozenset({"comment"}), False)
    assert htmltext.cues_of("comments-on-theory") == (frozenset(), True)
    assert htmltext.cues_of("post-content main-menu-content") == (frozenset({"post", "content"}), True)
    assert htmltext.cues_of("page-with-sidebar-left") == (frozenset(), True)
    assert htmltext.cues_of("") == (frozenset(), False)


def test_deep_pages_take_linear_time():
    def seconds(n):
        page = "<div>" * n + "<p>Words in the depth are here." + "</div>" * n + "<li>" * n
        at = time.process_time()
        htmltext.main_text(page, model)
        return time.process_time() - at

    model = htmltext.default_model()
    seconds(1000)
    assert seconds(80_000) < 12 * seconds(20_000)


def test_html_with_clashing_columns(spark):
    rows = [(1, "u", "<article><p>Words of the page are here.</p></article>", "mine", 7, "x", "y")]
    got = htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, page string, parts string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and [tuple(r) for r in got.collect()] == [(1, "u", "Words of the page are here.", 27)]


# decontamination


def test_lcs():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        return row[-1]

    rng = random.Random(0)
    for _ in range(200):
        a, b = rng.choices("abcd", k=rng.randint(1, 12)), rng.choices("abcde", k=rng.randint(0, 15))
        assert decontaminate.lcs(a, b) == plain(a, b)


def test_contamination(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.randint(15, 60))) for i in range(40)]
    rows, want = [], set()
    for d in range(400):
        t = text(rng.randint(1, 400))
        if d % 4 == 0:
            i = d % 40
            words = items[i][1].split()
            if d % 8 == 0:  # reworded: some words changed or dropped
                for _ in range(len(words) // 8):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
                del words[rng.randrange(len(words))]
            cut = rng.randint(0, len(t))
            t = t[:cut] + " " + " ".join(words).upper() + ". " + t[cut:]
            want.add((d, i))
        elif d % 4 == 1:  # a short quotation is no contamination
            t += " " + " ".join(items[d % 40][1].split()[:6])
        rows.append((d, t, None))
    odd = [(1000, None, None), (1001, "", None), (None, items[3][1], None), (1002, text(30_000) + " " + items[7][1], None), (0, rows[0][1], None)]
    want |= {(None, 3), (1002, 7)}
    benchmark = spark.createDataFrame([*items, (77, None), (78, ""), items[0]], "item_id long, text string")
    got = decontaminate.find_contamination(docs(spark, rows + odd), benchmark).collect()
    pairs = [(r["doc_id"], r["item_id"]) for r in got]
    brute = set()
    words = {i: decontaminate.words_of(t) for i, t in items}
    for d, t, _ in rows + odd[:3]:
        w = decontaminate.words_of(t)
        for i, q in words.items():
            if len(set(q) & set(w)) >= 0.7 * len(set(q)) and decontaminate.lcs(q, w) >= 0.7 * len(q):
                brute.add((d, i))
    assert set(pairs) <= want | brute and len(want & set(pairs)) >= 0.97 * len(want)
    assert pairs.count((0, 0)) == 2 and len(set(pairs)) == len(pairs) - 1
    assert decontaminate.find_contamination(docs(spark, []), benchmark).count() == 0
    assert decontaminate.find_contamination(docs(spark, rows[:3]), benchmark.where("false")).count() == 0


def test_contamination_of_short_items_and_amid_rare_words(spark):
    """All pairs that the verification accepts at any window, by brute force; a single window's cosine misses some of them."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(2000)]
    items = [(i, rng.choices(vocabulary, k=1 + i % 20)) for i in range(100)]
    rows = []
    for d in range(400):
        junk = d % 2
        around = [f"{rng.getrandbits(60):x}" if junk else rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        words = list(items[d % 100][1])
        if d >= 200 and len(words) > 8:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        cut = rng.randint(0, len(around))
        rows.append((d, " ".join(around[:cut] + words + around[cut:]), None))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = decontaminate.find_contamination(docs(spark, rows), benchmark).collect()
    brute = set()
    for d, t, _ in rows:
        w = decontaminate.words_of(t)
        for i, q in items:
            answer = q[-max(1, min(len(q), max(3, len(q) // 5))) :]
            for start, _ in decontaminate.passage_spans(len(w)):
                near = w[max(0, start - len(q)) : start + decontaminate.WINDOW + len(q)]
                enough = len(set(q) & set(near)) >= 0.7 * len(set(q)) - 1e-9 and decontaminate.lcs(q, near) >= 0.7 * len(q)
                if enough and decontaminate.lcs(answer, near) >= 0.5 * len(answer):
                    brute.add((d, i))
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute and brute >= {(d, d % 100) for d in range(400)}
    assert all(0 <= r["cosine"] <= 1 for r in got)


def test_contamination_by_kind(spark, monkeypatch):
    """Items of all lengths, whole and with words replaced, in prose: what occurs is found in each kind, and by the latent space alone if the item has 15 words or more. Clashing columns, and a benchmark in several blocks."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(4000)]
    weights = [1 / (k + 5) for k in range(4000)]
    text = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [text(length) for length in (6, 8, 10, 15, 25, 40, 60, 120) for _ in range(12)]
    rows, kinds = [], {}
    for part in (0.0, 0.1, 0.2, 0.25, 0.29):
        for i, words in enumerate(items):
            new = list(words)
            for k in rng.sample(range(len(new)), int(part * len(new))):
                new[k] = "zz" + rng.choice(vocabulary)
            around = text(rng.randint(30, 200))
            at = rng.randint(0, len(around))
            kinds.setdefault(("short" if len(words) < 15 else "long" if len(words) > 60 else "middle", part), []).append((len(rows), i))
            rows.append((len(rows), " ".join(around[:at] + new + around[at:]), None))
    benchmark = spark.createDataFrame([(i, " ".join(w), "x", 0.0, 1) for i, w in enumerate(items)], "item_id long, text string, doc_id string, cosine double, i int")
    pairs = lambda: sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(docs(spark, rows), benchmark).collect())
    got = pairs()
    for kind, planted in kinds.items():
        holds = []
        for d, i in planted:
            q, w = items[i], rows[d][1].split()
            near = lambda start: w[max(0, start - len(q)) : start + decontaminate.WINDOW + len(q)]
            tail = q[-max(1, min(len(q), max(3, len(q) // 5))) :]
            if any(len(set(q) & set(near(a))) >= 0.7 * len(set(q)) - 1e-9 and decontaminate.lcs(q, near(a)) / len(q) >= 0.7 and decontaminate.lcs(tail, near(a)) >= 0.5 * len(tail) for a, _ in decontaminate.passage_spans(len(w))):
                holds.append((d, i))
        assert len(holds) > 0.6 * len(planted) and len(set(holds) & set(got)) >= 0.98 * len(holds), kind
    planted = {x for found in kinds.values() for x in found}
    assert all(x in planted or len(items[x[1]]) < 15 for x in got)
    monkeypatch.setattr(decontaminate.Matcher, "by_rarest", lambda *_: iter(()))
    alone = set(pairs())
    for (size, part), found in kinds.items():
        if size != "short" and part <= 0.1:
            assert len(alone & set(found)) >= 0.9 * len(found), (size, part)
    monkeypatch.undo()
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 40)
    assert pairs() == got


def test_the_space_is_fitted_on_all_passages(spark):
    """What the fitted space keeps of all passages is at least three quarters of the most that a space of its rank can, by a full eigendecomposition (of these texts without structure a space fitted on 3,000 passages kept 37 %); the topics of long documents, each in a few of many, are in it."""
    rng = random.Random(4)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(12)]
    common = [f"c{j}" for j in range(300)]
    texts = [" ".join(rng.choices(common, k=40)) for _ in range(6000)]
    for k, topic in enumerate(topics):
        texts[100 * k] = " ".join(rng.choices(topic, k=16 * 500))
    items = [" ".join(rng.choices(common, k=30)) for _ in range(20)]
    seen = {}

    def fitted(*args):
        space = real(*args)
        seen["idf"], seen["latent"] = args[2], space.astype(float)
        return space

    real = decontaminate.fit_latent_space
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontaminate, "fit_latent_space", fitted)
        decontaminate.find_contamination(docs(spark, [(k, t, None) for k, t in enumerate(texts)]), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    idf, latent = seen["idf"], seen["latent"]
    assert np.allclose(latent.T @ latent, np.eye(latent.shape[1]), atol=1e-3)
    words = {w: decontaminate.word_features([w])[0][0] for w in sorted({w for t in texts + items for w in t.split()})}
    column = {f: k for k, f in enumerate(sorted(set(words.values())))}
    grams = []
    for some in (texts, items):
        rows = []
        for t in some:
            w = [words[x] for x in t.split()]
            for a, b in decontaminate.passage_spans(len(w)):
                row = np.zeros(len(column))
                for f in w[a:b]:
                    row[column[f]] += idf[f]
                rows.append(row / np.sqrt(sum(float(idf[f]) ** 2 for f in w[a:b])))
        rows = np.array(rows)
        grams.append(rows.T @ rows / len(rows))
    own = latent[sorted(column)]
    best = np.sort(np.linalg.eigvalsh(sum(grams)))[::-1][: latent.shape[1]].sum()
    assert np.trace(own.T @ sum(grams) @ own) >= 0.75 * best
    # The documents' part alone, which twelve of them make up for the most
    best = np.sort(np.linalg.eigvalsh(grams[0]))[::-1][: latent.shape[1]].sum()
    assert np.trace(own.T @ grams[0] @ own) >= 0.75 * best


@pytest.mark.parametrize("queries, occurrences", [(1024, 1 << 20), (50, 20)])
def test_few_pairs_are_held_against_the_whole_cosine(monkeypatch, queries, occurrences):
    """A space in which all is alike, so that nearly all windows pass the latent cosine with all passages: all that have the TF-IDF cosine, too, are found, and few are computed for that. What the rarest words lead to is all that the verification accepts."""
    monkeypatch.setattr(decontaminate, "QUERIES", queries)
    monkeypatch.setattr(decontaminate, "OCCURRENCES", occurrences, raising=False)
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(4000)]
    text = lambda n: rng.choices(vocabulary, [1 / (k + 5) for k in range(4000)], k=n)
    items = [(k, text(1 + rng.randrange(60))) for k in range(100)] + [(100, ["none", "of", "these"])]
    texts = [text(rng.randint(0, 300)) for _ in range(30)] + [text(600), [], ["none"]]
    for d in range(0, 30, 2):
        words = list(items[d][1])
        for k in rng.sample(range(len(words)), len(words) // (5 + d % 3)):
            words[k] = rng.choice(vocabulary)
        at = rng.randint(0, len(texts[d]))
        texts[d][at:at] = words
    given = [" ".join(t) for t in texts]
    f, size = decontaminate.word_features(given)
    df = np.zeros(decontaminate.FEATURES)
    for own in np.split(f, np.cumsum(size)[:-1]):
        df[own] += 1
    idf = np.log((len(texts) + 1) / (df + 0.5)).clip(0.01).astype(np.float32)
    matcher = decontaminate.Matcher(items, idf[:, None].copy(), idf * idf)
    computed = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            computed.append(len(np.asarray(at[0])))
            return np.asarray(super().__getitem__(at))

    matcher.has = [(column, has.view(Counted), *others) for column, has, *others in matcher.has]
    feature = lambda words: decontaminate.word_features([" ".join(words)])[0]
    passages = [(k, feature(q[a:b])) for k, q in items for a, b in decontaminate.passage_spans(len(q))]
    both, accepted, latent, windows = set(), set(), 0, 0
    for d, t in enumerate(texts):
        for a, b in decontaminate.passage_spans(len(t)) if t else ():
            w = feature(t[a:b])
            norm, windows = float(np.sqrt(np.square(idf[w]).sum())), windows + 1
            accepted |= {(d, k, a) for k, _ in items if matcher.verify(k, t, a)}
            for k, q in passages:
                full = float(np.sqrt(np.square(idf[q]).sum()))
                if idf[w].sum() / norm >= 0.45 * idf[q].sum() / full:
                    latent += 1
                    if np.square(idf[w[np.isin(w, q)]]).sum() >= 0.3 * norm * full and (d, k, a) in accepted:
                        both.add((d, k, a))
    found = {x[:3] for x in matcher._candidates(f, size, 0)}
    assert {x for x in found if x in accepted} == both and len(both) > 10
    assert latent > 0.5 * windows * len(passages) and sum(computed) < 0.25 * latent
    assert {x[:3] for x in matcher.by_rarest(f, size, 0)} >= accepted > both


@pytest.mark.parametrize("n", [1, 16, 17, 32, 33, 100])
def test_passages_cover_every_word(n):
    spans = decontaminate.passage_spans(n)
    assert {k for a, b in spans for k in range(a, b)} == set(range(n))
