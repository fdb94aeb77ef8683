import math
import os
import re
from collections import Counter

import pytest
from ledgerloom.llm.licenses import CUES, NOTICES, TEMPLATES, TEXTS, THRESHOLD, scan_licences, template_tokens

NOTICE = "Released under the MIT License."
FILES = [
    ("r/LICENSE", NOTICE),
    ("r/a/x.txt", "plain text\nno notice here"),
    ("r/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3.\nshort"),
    ("r/a/b/y.txt", "words " * 30_000),
    ("r/a/b/c/z.txt", None),
    ("r/a/b/c/own.txt", "text before the notice\nLicensed under CC BY-NC 4.0.\ntext after it, long enough not to be a licence file"),
    ("ra/x.txt", "a table may be reserved for a permission slip"),
    ("LICENSE.txt", "All rights reserved."),
    ("top.txt", ""),
    ("top.txt", ""),
    (None, "nothing"),
    (None, NOTICE),
]


def brute(files):
    """licence, origin and score of each file in plain Python."""
    lines = [[x for x in (t or "").split("\n") if re.search(CUES, x)] for _, t in files]
    vocabulary = {t for _, x in TEMPLATES for t in template_tokens(x)}
    df = Counter(t for ls in lines for t in {t for x in ls for t in template_tokens(x)} & vocabulary)
    idf = {t: math.log((1 + len(files)) / (1 + df[t])) + 1 for t in vocabulary}

    def vector(text):
        v = {t: c * idf.get(t, math.log(1 + len(files)) + 1) for t, c in Counter(template_tokens(text)).items()}
        n = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / n for t, x in v.items()}

    units = [(name, vector(x)) for name, x in TEMPLATES]
    own, covers = [], []
    for (_, text), ls in zip(files, lines, strict=True):
        best = [max((round(sum(w * u.get(t, 0) for t, w in vector(x).items()), 6), name) for name, u in units) for x in ls]
        good = [(b, x) for b, x in zip(best, ls, strict=True) if b[0] >= THRESHOLD]
        own.append(max((b for b, _ in good), default=None))
        covers.append(bool(good) and 2 * sum(len(x) for _, x in good) >= len(text))
    by_dir = {}
    for (path, _), o, c in zip(files, own, covers, strict=True):
        if c and path is not None:
            d = path.rpartition("/")[0]
            by_dir[d] = max(o, by_dir.get(d, o))
    out = []
    for (path, _), o in zip(files, own, strict=True):
        if o:
            out.append((path, o[1], "own", o[0]))
            continue
        d = path.rpartition("/")[0] if path is not None else None
        while d and d not in by_dir:
            d = d.rpartition("/")[0]
        found = by_dir.get(d) if d is not None else None
        out.append((path, found[1], "inherited", found[0]) if found else (path, None, "none", None))
    return out


def test_same_as_brute_force(spark):
    files = spark.createDataFrame([(*f, "k") for f in FILES], "path string, text string, licence string")
    got = [tuple(r) for r in scan_licences(files, keep=["path", "licence"]).collect()]
    assert sorted(got, key=str) == sorted(brute(FILES), key=str)
    by_path = {r[0]: r[1:3] for r in got if r[0]}
    assert by_path["r/a/x.txt"] == ("MIT", "inherited") and by_path["r/a/b/y.txt"] == ("GPL-3.0", "inherited")
    assert by_path["r/a/b/c/own.txt"] == ("CC-BY-NC-4.0", "own") and by_path["ra/x.txt"] == ("proprietary", "inherited")
    assert scan_licences(files.limit(0), keep=["path"]).count() == 0


MPL = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n"
LGPL = """# This library is free software: you can redistribute it and/or modify
# it under the terms of the GNU Lesser General Public License as
# published by the Free Software Foundation, either version 3 of the
# License, or any later version.
"""


def test_wrapped_notices_tags_and_whole_texts(spark):
    code = "def one(value):\n    return value + first_place\n" * 40
    mit = dict(TEXTS)["MIT"].split()
    whole = "Copyright 2020 A. Person\n\n" + "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    isc = " ".join(dict(NOTICES)["ISC"].split()).replace(" for any", "\n for any").replace(" provided", "\n\n provided")
    files = [
        ("m/x.c", MPL + code), ("l/x.py", LGPL + code), ("i/x.c", isc + "\n" + code), ("s/x.c", "// SPDX-License-Identifier: MIT\n" + code), ("w/COPYING", whole), ("w/a/x.c", code),
        ("o/x.c", dict(TEMPLATES)["Apache-2.0"].replace(" ", "\n\n") + "\n" + code), ("n/x.c", code), ("l/one.py", LGPL.replace("\n# ", " ") + code), ("g/x.c", "// SPDX-License-Identifier: GPL-2.0-or-later\n" + code),
    ]
    got = {r["path"]: (r["licence"], r["origin"]) for r in scan_licences(spark.createDataFrame(files, "path string, text string"), keep=["path"]).collect()}
    assert got == {
        "m/x.c": ("MPL-2.0", "own"), "l/x.py": ("LGPL-3.0", "own"), "i/x.c": ("ISC", "own"), "s/x.c": ("MIT", "own"), "w/COPYING": ("MIT", "own"), "w/a/x.c": ("MIT", "inherited"),
        "o/x.c": ("Apache-2.0", "own"), "n/x.c": (None, "none"), "l/one.py": ("LGPL-3.0", "own"), "g/x.c": ("GPL-2.0", "own"),
    }


#: What each whole text of the system is called.
SYSTEM = {
    "Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0",
}


def test_whole_licence_files_of_the_system(spark):
    """Each names itself and covers the files below it."""
    folder = "/usr/share/common-licenses"
    texts = {n: open(f"{folder}/{n}", encoding="utf-8", errors="replace").read() for n in SYSTEM if os.path.exists(f"{folder}/{n}")}
    if not texts:
        pytest.skip("no licence texts here")
    code = "def one(value):\n    return value + first_place\n" * 40
    files = [x for n, t in texts.items() for x in ((f"{n}/LICENSE", t), (f"{n}/src/x.py", code))]
    got = {r["path"]: (r["licence"], r["origin"]) for r in scan_licences(spark.createDataFrame(files, "path string, text string"), keep=["path"]).collect()}
    assert {n: got[f"{n}/LICENSE"] for n in texts} == {n: (SYSTEM[n], "own") for n in texts}
    assert {n: got[f"{n}/src/x.py"] for n in texts} == {n: (SYSTEM[n], "inherited") for n in texts}


def test_names_and_reserved_rights(spark):
    """A named file covers with a short grant among much else; reserved rights yield to any notice; a title counts at the start only."""
    code = "def one(value):\n    return value + first_place\n" * 40
    files = [
        ("a/NOTICE.txt", code + "Released under the MIT License.\n"), ("a/x.py", code), ("b/note.py", code + "Released under the MIT License.\n"), ("b/x.py", code),
        ("c/x.c", "All rights reserved.\nReleased under the MIT License.\n"), ("d/x.c", "All rights reserved.\n"), ("e/COPYING", code), ("e/x.py", code),
        ("f/x.md", "** GNU General Public License **\n   Version 2\n" + code), ("g/x.md", "See GNU General Public License Version 2\n" + code), ("h/x", "Mozilla Public License Version 2.07"),
    ]
    got = {r["path"]: (r["licence"], r["origin"]) for r in scan_licences(spark.createDataFrame(files, "path string, text string"), keep=["path"]).collect()}
    assert got["a/x.py"] == ("MIT", "inherited") and got["b/x.py"] == (None, "none") and got["c/x.c"] == ("MIT", "own") and got["d/x.c"] == ("proprietary", "own")
    assert got["e/x.py"] == (None, "none") and got["f/x.md"] == ("GPL-2.0", "own") and got["h/x"][0] != "MPL-2.0"
