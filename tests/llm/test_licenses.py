"""Licence scans, against plain cosines and hand-made trees."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tradewind.llm import licenses
from tradewind.llm.queries import op10_licenses


def words(text):
    return re.findall("[a-z0-9]+", text.lower())


def brute(texts, threshold=licenses.THRESHOLD):
    """(licence, cosine, share) of each text by full vectors."""
    templates = [(n, Counter(words(t))) for n, ts in sorted(licenses.TEMPLATES.items()) for t in ts]
    known = {w for _, t in templates for w in t}
    held = Counter(w for t in texts for w in set(words(t or "")) & known)
    weight = lambda w: math.log((1 + len(texts)) / (1 + held[w])) + 1
    longest = 2 * max(sum(t.values()) for _, t in templates)

    def cosine(a, b):
        dot = sum(a[w] * b[w] * weight(w) ** 2 for w in a)
        return round(dot / math.prod(math.sqrt(sum((n * weight(w)) ** 2 for w, n in x.items())) for x in (a, b)), 12)

    for text in texts:
        best, size = (0.0, None), 0
        lines = [words(x) for x in (text or "").split("\n")]
        total = sum(map(len, lines))
        for line in [*lines, *([sum(lines, [])] if total <= longest else [])]:
            for name, template in templates:
                if line and (c := cosine(Counter(line), template)) >= threshold and c > best[0]:
                    best, size = (c, name), len(line)
        yield best[1], best[0] or None, size / total if total else 0.0


def inherited(rows):
    """The licence and its directory for files (path, licence, cosine, share)."""
    best = {}
    for path, name, cosine, share in rows:
        if path is not None and name and share >= licenses.FILE_SHARE:
            above = path.rpartition("/")[0]
            best[above] = min(best.get(above, (9, "")), (-cosine, name))
    for path, name, _, _ in rows:
        above, found = path, (name, None)
        while name is None and above:
            above = above.rpartition("/")[0]
            if above in best:
                found = (best[above][1], above)
                break
        yield found


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet").orderBy("doc_id").collect()
    own = list(brute([r["text"] for r in docs]))
    paths = [f"{r['source']}/{r['lang']}/{r['doc_id']}" for r in docs]
    want = list(inherited([(p, *o) for p, o in zip(paths, own, strict=True)]))
    got = {r["path"]: r for r in op10_licenses(spark, cases.SF).collect()}
    assert len(got) == len(docs) and any(w[0] for w in want)
    for path, (_, cosine, share), (name, above) in zip(paths, own, want, strict=True):
        r = got[path]
        assert (r["license"], r["inherited_from"]) == (name, above)
        assert r["cosine"] == (pytest.approx(cosine) if cosine else None)
        assert r["is_license_file"] == (cosine is not None and share >= licenses.FILE_SHARE)


def test_nearest_directory_wins(spark):
    mit, gpl = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["GPL-3.0"][0]
    body = "some words that say nothing of the kind and go on for a while so that no notice fills a third of it"
    files = [
        ("LICENSE", mit), ("a/x.txt", body), ("a/b/LICENSE", gpl), ("a/b/c/d/y.txt", body), ("a/b/own.txt", f"{body}\n{mit}\n{body}"),
        ("z.txt", ""), (None, body), (None, mit), ("q/empty", None), ("a/b2/file", body), ("a/b/c/d/y.txt", body),
    ]
    docs = cases.clashing(spark.createDataFrame([(1, t, p, "x", 1) for p, t in files], "doc_id long, text string, p string, source string, n_chars long"))
    docs = docs.drop("path").withColumnRenamed("p", "path")
    found = licenses.scan_licenses(docs)
    assert set(docs.columns) < set(found.columns)
    got = {(r["path"], r["license"], r["inherited_from"]) for r in found.collect()}
    assert got == {
        ("LICENSE", "MIT", None), ("a/x.txt", "MIT", ""), ("a/b/LICENSE", "GPL-3.0", None), ("a/b/c/d/y.txt", "GPL-3.0", "a/b"),
        ("a/b/own.txt", "MIT", None), ("z.txt", "MIT", ""), (None, None, None), (None, "MIT", None), ("q/empty", "MIT", ""), ("a/b2/file", "MIT", ""),
    }
    assert found.count() == len(files)
    assert licenses.scan_licenses(docs.where(F.lit(False))).count() == 0


def test_each_text_is_scanned_once(spark, tmp_path):
    """Files with licences of their own, copies, and NULLs; the result does not scan again."""
    mit = licenses.TEMPLATES["MIT"][0]
    rows = [(f"d{i % 3}/f{i}", mit if i % 4 == 0 else f"own text {i % 5}") for i in range(40)] + [(None, None), ("d0/x", None)]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    got = found.collect()
    assert len(got) == len(rows)
    assert sum(r["license"] == "MIT" and r["inherited_from"] is None for r in got) == 10
    assert [r["license"] for r in got if r["path"] is None] == [None]


def test_ties_and_own_templates(spark):
    docs = spark.createDataFrame([("d/one", "beta rule\nalpha rule"), ("d/two", "gamma")], "path string, text string")
    found = licenses.scan_licenses(docs, templates={"b": ["beta rule"], "a": ["alpha rule"]})
    assert {(r["path"], r["license"]) for r in found.collect()} == {("d/one", "b"), ("d/two", "b")}


APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
    "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
    "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS."
)


def wrapped(text, mark="", width=6):
    parts = text.split()
    return "\n".join(mark + " ".join(parts[i : i + width]) for i in range(0, len(parts), width))


def matcher(texts, templates, threshold=licenses.THRESHOLD):
    known = {w for ts in templates.values() for t in ts for w in words(t)}
    held = Counter(w for t in texts for w in set(words(t)) & known)
    return licenses.Matcher(templates, len(texts), held, threshold)


@pytest.mark.parametrize("code", [0, 5, 100, 5000])
@pytest.mark.parametrize("mark", ["# ", " * ", ""])
def test_a_wrapped_header_is_found_at_every_length(code, mark):
    header = licenses.TEMPLATES["GPL-3.0"][1]
    text = f"{wrapped(header, mark)}\n" + "\n".join(f"x{i} = y{i % 7}" for i in range(code))
    found = matcher([text, *["other words"] * 99], {"GPL-3.0": [header], "MIT": licenses.TEMPLATES["MIT"]}).scan(text)
    assert found[0] == "GPL-3.0" and found[1] > 0.99
    assert (found[3] >= licenses.FILE_SHARE) == (len(words(header)) / len(words(text)) >= licenses.FILE_SHARE)


def test_a_licence_text_with_an_appendix_is_a_licence_file():
    body = " ".join(f"clause{i % 90} of the terms{i % 40} grants{i % 11} to you" for i in range(300))
    more = " ".join(f"appendix{i}" for i in range(len(words(body)) * 3 // 2))
    text = wrapped(f"Copyright 2020 somebody else {body} {more}", width=10)
    found = matcher([text, *["other words"] * 99], {"own": [body], "proprietary": ["All rights reserved."]}).scan(text)
    assert found[0] == "own" and found[3] == pytest.approx(0.4, abs=0.01)


def test_a_short_notice_inside_a_licence_text_gives_way():
    templates = {"long": [APACHE], "proprietary": ["All rights reserved."]}
    text = f"All rights reserved.\n{wrapped(APACHE.replace('agreed', 'settled'))}"
    assert matcher([text, *["other words"] * 99], templates).scan(text)[0] == "long"
    assert matcher([text, *["other words"] * 99], templates).scan("All rights reserved.\nno more")[0] == "proprietary"


def test_windows_equal_plain_cosines():
    rng = random.Random(5)
    for _ in range(30):
        text = [rng.choice("abcdefg") for _ in range(rng.randrange(1, 60))]
        template = [rng.choice("abcdx") for _ in range(rng.randrange(1, 9))]
        m = matcher([" ".join(text), "a b", "c"], {"t": [" ".join(template)]}, threshold=0.05)
        size = min(len(template), len(text))
        every = [c for i in range(len(text) - size + 1) for _, c in m.cosines(text[i : i + size], [0])]
        whole = [c for _, c in m.cosines(text, [0])]
        assert m.scan(" ".join(text))[1] == (max(every + whole) if every + whole else None)


def reworded(name):
    """The licence's text with a title, another holder, other line ends and every 40th word changed."""
    text = licenses.TEMPLATES[name][-1].replace("<year>", "2019").replace("<owner>", "Some Company Ltd.")
    parts = [f"changed{i}" if i % 40 == 17 else w for i, w in enumerate(text.split())]
    return f"All rights reserved.\n\n{wrapped(' '.join(parts), width=11)}"


TEXTS = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]


def test_licence_texts_speak_for_their_directories(spark):
    body = "some words that say nothing of the kind and go on for a while so that no notice fills a third of it"
    rows = [row for n in TEXTS for row in ((f"{n}/LICENSE", reworded(n)), (f"{n}/src/file", body))]
    rows += [(f"other/{i}/file", f"{body} {i}") for i in range(200)]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()
    got = {r["path"]: (r["license"], r["is_license_file"], r["inherited_from"]) for r in found}
    assert {n: got[f"{n}/LICENSE"] for n in TEXTS} == {n: (n, True, None) for n in TEXTS}
    assert {n: got[f"{n}/src/file"] for n in TEXTS} == {n: (n, False, n) for n in TEXTS}
    assert all(got[f"other/{i}/file"] == (None, False, None) for i in range(200))


@pytest.mark.parametrize(
    "notice, name",
    [
        ("// SPDX-License-Identifier: MIT", "MIT"),
        ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) */", "GPL-2.0"),
        ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
        ("# SPDX-License-Identifier: Zlib", None),
        ("# Copyright 2015 The Authors. All rights reserved.\n# Use of this source code is governed by a BSD-style\n# license that can be found in the LICENSE file.", "BSD-3-Clause"),
        ("# you may not use this file except in compliance with the License, Version 2.0 of the Apache License;\n# it is distributed on an AS IS BASIS, without\n# warranties or conditions of any kind. You may obtain a copy of\n# the License at apache.org/licenses/LICENSE-2.0 and see it for the specific language governing permissions", "Apache-2.0"),
        ("/* It is free software: you can redistribute it and modify it under\n * the terms of the GNU Affero General Public License as\n * published by the Free Software Foundation, version 3 of the License, or\n * any later version. */", "AGPL-3.0"),
        ("This file is licensed\nunder the MIT license", "MIT"),
    ],
)
def test_tags_and_reworded_notices_in_longer_files(notice, name):
    code = "\n".join(f"x{i} = y{i % 7} + call{i % 5}(z)" for i in range(300))
    texts = [f"{notice}\n{code}", f"{code}\n{notice}\n{code}", *[f"other words {i}" for i in range(200)]]
    m = matcher(texts, licenses.TEMPLATES)
    assert [m.scan(t)[0] for t in texts[:2]] == [name, name] and not m.scan(texts[0])[3] >= licenses.FILE_SHARE
