"""Public licences in the forms in which they are met: full texts, notices, tags; longer rules mask shorter ones."""

import textwrap

import duckdb
import pytest

from proxjoin.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
NEITHER = """
3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
DISCLAIMED = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
APACHE_TEXT = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
FULL = [
    (MIT, "MIT"), (BSD2 + DISCLAIMED, "BSD-2-Clause"), (ISC, "ISC"), (MPL, "MPL-2.0"), (APACHE, "Apache-2.0"), (UNLICENSE, "Unlicense"), (ZLIB, "Zlib"),
    *((BSD2 + NEITHER.format(n) + DISCLAIMED, "BSD-3-Clause") for n in ("the copyright holder", "Some Company, Inc", "the University of Somewhere")),
    (GNU.format("program", "", "3"), "GPL-3.0"), (GNU.format("program", "", "2"), "GPL-2.0"), (GNU.format("library", "Lesser ", "2.1"), "LGPL-2.1"),
    (GNU.format("library", "Lesser ", "3"), "LGPL-3.0"), (GNU.format("program", "Affero ", "3"), "AGPL-3.0"), (GNU.format("program", "Lesser ", "3"), "LGPL-3.0"),
]
LINES = [
    (APACHE_TEXT, "Apache-2.0"), ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright", "GPL-3.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991", "GPL-2.0"), ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", "MPL-2.0"),
    ("Boost Software License - Version 1.0 - August 17th, 2003", "BSL-1.0"), ("Eclipse Public License - v 2.0", "EPL-2.0"), ("Creative Commons Legal Code\n\nCC0 1.0 Universal", "CC0-1.0"),
    ("This project is licensed under the MIT License.", "MIT"), ("Released under the BSD 3-Clause License.", "BSD-3-Clause"), ("Licensed under the Mozilla Public License 2.0.", "MPL-2.0"), ("Distributed under the GNU General Public License v3.0.", "GPL-3.0"),
    ("We met the MIT people under a licence.", ""), ("The copyright of all this is ours. Redistribution is not permitted.", ""),
    ("MIT License\n\nx\n\nLicensed under CC BY 4.0.\n", "CC-BY-4.0,MIT"), (None, ""), ("", ""),
]
TAGS = {"MIT": "MIT", "BSD-3-Clause": "BSD-3-Clause", "BSD-2-Clause": "BSD-2-Clause", "Apache-2.0": "Apache-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-or-later": "LGPL-2.1", "AGPL-3.0-only": "AGPL-3.0", "MPL-2.0": "MPL-2.0", "ISC": "ISC", "Unlicense": "Unlicense", "0BSD": "0BSD", "Zlib": "Zlib", "CC0-1.0": "CC0-1.0"}


def wrapped(text, width, before=""):
    return "\n".join(textwrap.fill(p, width, initial_indent=before, subsequent_indent=before, break_long_words=False, break_on_hyphens=False) if p.strip() else before for p in text.split("\n"))


def cases():
    out = [*FULL, *LINES]
    for text, name in FULL:
        out += [(wrapped(text, w), name) for w in (60, 72, 80)]
        out += [(wrapped(text, 76, b), name) for b in ("# ", " * ", "// ")]
    for tag, name in TAGS.items():
        out += [(f"{a}SPDX-License-Identifier: {tag}{b}\ncode = 1\n", name) for a, b in (("", ""), ("// ", ""), ("# ", ""), ("/* ", " */"), ("x = 1\n", ""))]
    out += [(FULL[0][0] + "\n\n" + FULL[7][0], "BSD-3-Clause,MIT"), ("word " * 40_000 + "\n" + MIT, "MIT"), ("# " * 40_000 + "copyright. " * 5_000, "")]
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t) for i, (t, _) in enumerate(cases())]
    return rows, [tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).orderBy("doc_id").collect()]


def test_every_form_is_recognised(found):
    assert [(cases()[r[0]][0], r[3]) for r in found[1] if r[3] != cases()[r[0]][1]] == []
    kinds = {r[3]: r[4] for r in found[1]}
    assert kinds["GPL-3.0"] == "copyleft" and kinds["BSD-3-Clause"] == "permissive" and kinds["Unlicense"] == "public domain" and kinds["CC-BY-4.0,MIT"] == "permissive"


def test_sql_says_the_same(found):
    rows, got = found
    short = [r for r in rows if len(r[1] or "") < 10_000]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", short)
    assert sorted(con.execute(licenses.oracle_sql()).fetchall()) == [r for r in got if len(rows[r[0]][1] or "") < 10_000]


def test_all_sentences_pass_the_first_test():
    import re

    assert all(re.search(licenses.MARKS, s) for s in licenses.KNOWN.values())
    assert all(i in licenses.KNOWN for _, _, ids in licenses.RULES for i in ids.split())
    counts = [len(ids.split()) for _, _, ids in licenses.RULES]
    assert counts == sorted(counts, reverse=True) and len({ids for _, _, ids in licenses.RULES}) == len(counts)


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ADVERTISING = """3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
   This product includes software developed by the Example Group.
"""
NEITHER = """4. Neither the name of {} nor the names of its contributors may be used to
   endorse or promote products derived from this software without specific
   prior written permission.
"""


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (BSD + NEITHER.format("Google Inc."), "BSD-3-Clause"),
        (BSD + NEITHER.format("Yahoo! Inc."), "BSD-3-Clause"),
        (BSD + NEITHER.format("the St. John's Univ. Press, Ltd."), "BSD-3-Clause"),
        (BSD + ADVERTISING + NEITHER.format("the Example Group"), "BSD-4-Clause"),
        (BSD, "BSD-2-Clause"),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\ncode", "Apache-2.0,MIT"),
        ("# SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR ISC", "BSD-3-Clause,ISC,MIT"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", "GPL-2.0"),
        ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 OR MIT\n", "GPL-2.0,MIT"),
        ("SPDX-License-Identifier: MIT\nThis is text or not, and more.", "MIT"),
        ("This project is available under the Apache License, Version 2.0.", "Apache-2.0"),
        ("SPDX-License-Identifier: Artistic-2.0", "Artistic-2.0"),
        ("SPDX-License-Identifier: PSF-2.0", "PSF-2.0"),
        ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004", "WTFPL"),
    ],
)
def test_common_texts(spark, text, found):
    import duckdb

    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.scan(frame).first().licenses == found
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("INSERT INTO documents VALUES (1, ?)", [text])
    result = con.execute(licenses.oracle_sql())
    assert result.fetchone()[[d[0] for d in result.description].index("licenses")] == found
