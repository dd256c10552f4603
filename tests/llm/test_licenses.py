import random
import time

import pytest

from foldwise.llm import licenses as lc
from foldwise.llm.license_texts import TEMPLATES


def test_increasing():
    rng = random.Random(0)
    for _ in range(200):
        v = [rng.randrange(12) for _ in range(rng.randrange(10))]
        got = [v[i] for i in lc.increasing(v)]
        assert got == sorted(set(got))
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        assert len(got) == max(best, default=0)


def test_align_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(14))] for _ in range(2))
        got = lc.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        assert len(got) <= len(lc._common(a, b))
    assert len(lc.align("the cat sat on the mat".split(), "the cat sat on a mat".split())) == 5
    assert lc.align(["x"] * 100, ["y"] * 100) == []


def test_templates_are_found_whole_and_edited():
    known = lc.templates(TEMPLATES)
    rng = random.Random(2)
    filler = ["thon", "erand", "under", "the", "of", "license", "this"]
    for name, texts in TEMPLATES.items():
        for t in texts:
            pre = " ".join(rng.choices(filler, k=60))
            doc = f"{pre}.\n{t.upper()}\n{pre}"
            (got,) = lc.scan(doc, known, 0.8)
            assert got[0] == name and got[3] == 1.0
            assert doc[got[1]:got[2]].lower().split()[0].strip('"') == t.lower().split()[0].strip('"')
            words = t.split()
            if len(words) > 30:
                # a header without its version or name is not that license: those words stay
                (made,) = lc.templates({name: [t]})
                telling = {made.words[j] for j in made.telling}
                free = [i for i, w in enumerate(words) if not telling & set(lc._WORD.findall(w.lower()))]
                for i in rng.sample(free, len(words) // 12):
                    words[i] = "changed"
                got = lc.scan(pre + " " + " ".join(words), known, 0.8)
                assert [x[0] for x in got] == [name] and 0.8 <= got[0][3] < 1


def test_scan_edge_cases(spark, make_docs):
    mit, cc = "Released under the MIT License.", "Licensed under CC BY-NC 4.0."
    rows = [(1, None), (2, ""), (3, mit), (4, f"{mit} x y z. {mit}\n{cc}"), (4, mit), (None, cc), (6, "the license of the work " * 4000 + mit), (7, "Licensed under")]
    got = {}
    for r in lc.scan_licenses(make_docs(rows, clash=True)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.n_places, [p.license for p in r.places]))
    assert got[1] == got[2] == got[7] == [(None, 0, [])]
    assert got[3] == [("MIT", 1, ["MIT"])] and got[None] == [("CC-BY-NC-4.0", 1, ["CC-BY-NC-4.0"])]
    assert sorted(got[4], key=lambda x: x[1]) == [("MIT", 1, ["MIT"]), ("CC-BY-NC-4.0", 3, ["MIT", "MIT", "CC-BY-NC-4.0"])]
    assert got[6][0][2][-1] == "MIT"
    assert lc.scan_licenses(make_docs([])).count() == 0
    assert lc.scan_licenses(make_docs(rows), texts={"none": [""]}).where("n_places > 0").count() == 0


def test_query_against_plain_search(spark):
    from foldwise.llm.q_licenses import op10_license_scan
    notices = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
               "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = op10_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(docs)
    for r in out:
        want = sorted((docs[r.doc_id].find(n), name) for n, name in notices.items() if n in docs[r.doc_id])
        assert [name for _, name in want] == [p.license for p in r.places]


def test_other_licenses_and_prose_are_not_taken():
    known = lc.templates(TEMPLATES)
    for text in ["Released under the BSD License.", "Released under the same license as the rest.", "Licensed under the Foo License.",
                 "Licensed under CC BY 3.0.", "Licensed under CC BY 3.0, see section 4.0", "This work is licensed under the GNU General Public License, version 9.",
                 "Licensed under the Eclipse Public License, Version 2.0.", TEMPLATES["GPL-3.0"][1].replace("version 3", "version 9")]:
        assert lc.scan(text, known, 0.8) == [], text
    assert "Apache-2.0" not in {x[0] for x in lc.scan("Licensed under the Mozilla Public License, Version 2.0.", known, 0.8)}
    assert [x[0] for x in lc.scan("Released under the terms of the MIT License", known, 0.8)] == ["MIT"]


def test_headers_need_their_version_and_name():
    known = lc.templates(TEMPLATES)
    for name in ("GPL-2.0", "LGPL-3.0", "AGPL-3.0"):
        header = next(t for t in TEMPLATES[name] if 50 < len(t.split()) < 120)
        version = name.split("-")[1][0]
        assert [x[0] for x in lc.scan(header, known, 0.8)] == [name]
        assert lc.scan(header.replace(f"version {version}", "version changed"), known, 0.8) == []
    assert [x[0] for x in lc.scan(next(t for t in TEMPLATES["LGPL-3.0"] if 50 < len(t.split()) < 120).replace("Lesser", "changed"), known, 0.8)] != ["LGPL-3.0"]


@pytest.mark.parametrize("text,want", [
    ("Licensed under the GNU General Public License, version 2", "GPL-2.0"), ("licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
    ("It is free under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "GPL-2.0"),
    ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("SPDX-License-Identifier: LGPL-3.0-or-later\n", "LGPL-3.0"), ("# SPDX-License-Identifier: MIT", "MIT"),
    ("SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"), ("SPDX-License-Identifier: GPL-2.0", "GPL-2.0"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("SPDX-License-Identifier: MIT-0", None), ("SPDX-License-Identifier: BSD-3-Clause-Clear", None), ("SPDX-License-Identifier: GPL-2.0+", None),
    ("SPDX-License-Identifier: EPL-2.0", None), ("SPDX-License-Identifier:", None)])
def test_notices_and_tags(text, want):
    assert [x[0] for x in lc.scan(f"some words {text}", lc.templates(TEMPLATES), 0.8)] == ([want] if want else [])


def test_a_text_is_told_by_its_title():
    text = max(TEMPLATES["GPL-3.0"], key=len)
    title = "GNU GENERAL PUBLIC LICENSE"
    assert title in text
    known = lc.templates(TEMPLATES)
    assert [x[0] for x in lc.scan(text, known, 0.8)] == ["GPL-3.0"]
    other = text.replace(title, "GNU AFFERO GENERAL PUBLIC LICENSE", 1)
    assert [x[0] for x in lc.scan(other, known, 0.8)] == ["AGPL-3.0"]


def test_coverage_equals_a_plain_common_subsequence():
    """Edited texts: the share of aligned words is that of the longest common subsequence, or just below it."""
    rng = random.Random(6)
    known = lc.templates(TEMPLATES)
    for name in ("MIT", "Apache-2.0", "BSD-3-Clause", "ISC", "GPL-2.0"):
        t = next(x for x in known if x.license == name and 60 < len(x.words) < 400)
        for _ in range(4):
            words = list(t.words)
            for i in rng.sample([j for j in range(len(words)) if j not in t.telling], len(words) // 15):
                words[i:i + 1] = rng.choice([[], ["other"], [words[i], "more"]])
            plain = len(lc._common(words, t.words)) / len(t.words)
            got = [x for x in lc.scan("before it " + " ".join(words) + " after it", [t], 0.8)]
            assert len(got) == 1 and plain - 0.02 <= got[0][3] <= plain


def test_many_places_take_linear_time():
    known = lc.templates({"MIT": ["Released under the MIT License."]})
    text = "Released under the MIT License. and so on " * 20_000
    start = time.process_time()
    assert len(lc.scan(text, known, 0.8)) == 20_000
    assert time.process_time() - start < 10


def test_the_more_complete_sibling_wins():
    known = lc.templates(TEMPLATES)
    for name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0"):
        assert len(max(TEMPLATES[name], key=len).split()) > 130
        for t in TEMPLATES[name]:
            assert [(x[0], x[3]) for x in lc.scan(f"Some words before. {t} And after.", known, 0.8)] == [(name, 1.0)], t[:80]
    header = max((t for t in TEMPLATES["AGPL-3.0"] if len(t.split()) < 100), key=len)
    assert [x[0] for x in lc.scan(header.replace("hope", "wish"), known, 0.8)] == ["AGPL-3.0"]


def test_repeats_are_all_found():
    known = lc.templates(TEMPLATES)
    for name, texts in TEMPLATES.items():
        for t in texts:
            for between in (" ", " x y z. "):
                if len(t.split()) < 300 or between == " ":
                    got = lc.scan(between.join([t] * 3), known, 0.8)
                    assert [(x[0], x[3]) for x in got] == [(name, 1.0)] * 3, (t[:80], between)


def test_large_gaps_are_aligned():
    rng = random.Random(3)
    for small in (1, 4096):
        for _ in range(60):
            a, b = ([rng.choice("abc") for _ in range(rng.randrange(30))] for _ in range(2))
            assert len(lc._common_long(a, b, small)) == len(lc._common(a, b))
    a, b = ([rng.choice("abc") for _ in range(200)] for _ in range(2))
    got = lc.align(a, b)
    assert all(a[i] == b[j] for i, j in got) and len(got) >= len(lc._common(a, b)) - 2
