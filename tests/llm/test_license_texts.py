"""Licences are found in the texts as published, wrapped as usual, and by the SQL too."""

import duckdb

from proxjoin.llm import licenses

MIT = """MIT-like terms

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"""
GPL = """    Foo does bar
    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""
NOTICES = [
    ("Released under the\nMIT License.", "MIT"), ("MIT License", "MIT"), ("The MIT License\nmore", "MIT"), ("Licensed under the Apache License,\nVersion 2.0", "Apache-2.0"),
    ("This work is licensed under the GNU General\nPublic License, version 3.", "GPL-3.0"), ("Licensed under\nCC BY-NC 4.0", "CC-BY-NC-4.0"), ("Licensed under CC BY 4.0", "CC-BY-4.0"), ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"),
    ("This work is licensed under a Creative Commons\nAttribution 4.0 International License.", "CC-BY-4.0"), ("This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
]
SPDX = [("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0-or-later", "GPL-3.0"), ("GPL-3.0-only", "GPL-3.0")]


def test_published_texts(spark):
    cases = [(MIT, "MIT"), (GPL, "GPL-3.0"), (BSD, "BSD-2-Clause"), (APACHE, "Apache-2.0"), ("A mit b", ""), ("mit", ""), (None, ""), *NOTICES, *((f"// SPDX-License-Identifier: {a}\n", b) for a, b in SPDX)]
    rows = [(i, t) for i, (t, _) in enumerate(cases)]
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [r[3] for r in got] == [x for _, x in cases]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(licenses.oracle_sql()).fetchall()) == got


def test_sql_on_the_small_tables(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert sorted(con.execute(licenses.oracle_sql()).fetchall()) == sorted(tuple(r) for r in licenses.scan(spark.read.parquet(path)).collect())
