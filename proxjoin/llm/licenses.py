"""License scans by sentence rules.

Texts are cut into sentences at full stops, colons and the like and at blank lines; the colon of an SPDX tag and the
name in "neither the name of ... nor" are taken out first, and the parts of an SPDX expression (AND, OR) become tags each, less
their exceptions (WITH). A sentence is a line of what is left or, since texts are
wrapped, several lines in a row; of those that begin in one line the longest counts. It is put in plain form: lower
case, runs of other characters than letters and digits become one space. Plain sentences that a licence is made of have
identifiers; a document becomes the ordered sequence of its identifiers. Rules are sequences of identifiers, the
longest first: where a rule's sequence stands without a gap its licence is found, and the sentences are used up, so
that a longer rule masks the shorter ones inside.

Defined results: a null or empty text has no sentences and no licence. Repeated sentences stay in the sequence. Rows
are scanned each; an empty table gives none. Further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxjoin.llm.common import let

# Licences with their kinds, SPDX tags in plain form, and names in notices.
LICENCES = [
    ("0BSD", "permissive", ["0bsd"], []),
    ("AGPL-3.0", "copyleft", ["agpl 3 0 only", "agpl 3 0 or later", "agpl 3 0"], ["gnu affero general public license version 3", "gnu affero general public license v3 0", "agplv3"]),
    ("Apache-2.0", "permissive", ["apache 2 0"], ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"]),
    ("Artistic-2.0", "permissive", ["artistic 2 0"], ["artistic license 2 0", "artistic license version 2 0"]),
    ("BSD-2-Clause", "permissive", ["bsd 2 clause"], ["bsd 2 clause license"]),
    ("BSD-3-Clause", "permissive", ["bsd 3 clause"], ["bsd 3 clause license"]),
    ("BSD-4-Clause", "permissive", ["bsd 4 clause"], ["bsd 4 clause license"]),
    ("BSL-1.0", "permissive", ["bsl 1 0"], ["boost software license version 1 0"]),
    ("CC-BY-4.0", "permissive", ["cc by 4 0"], ["creative commons attribution 4 0 international license"]),
    ("CC-BY-NC-4.0", "noncommercial", ["cc by nc 4 0"], ["creative commons attribution noncommercial 4 0 international license"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc by sa 4 0"], ["creative commons attribution sharealike 4 0 international license"]),
    ("CC0-1.0", "public domain", ["cc0 1 0"], []),
    ("EPL-2.0", "copyleft", ["epl 2 0"], ["eclipse public license 2 0", "eclipse public license v2 0"]),
    ("GPL-2.0", "copyleft", ["gpl 2 0 only", "gpl 2 0 or later", "gpl 2 0"], ["gnu general public license version 2", "gnu general public license v2 0", "gplv2"]),
    ("GPL-3.0", "copyleft", ["gpl 3 0 only", "gpl 3 0 or later", "gpl 3 0"], ["gnu general public license version 3", "gnu general public license v3 0", "gplv3"]),
    ("ISC", "permissive", ["isc"], ["isc license"]),
    ("LGPL-2.1", "copyleft", ["lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 2 1"], ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1"]),
    ("LGPL-3.0", "copyleft", ["lgpl 3 0 only", "lgpl 3 0 or later", "lgpl 3 0"], ["gnu lesser general public license version 3", "gnu lesser general public license v3 0"]),
    ("MIT", "permissive", ["mit"], ["mit license", "terms of the mit license"]),
    ("MPL-2.0", "copyleft", ["mpl 2 0"], ["mozilla public license 2 0", "mozilla public license version 2 0"]),
    ("PSF-2.0", "permissive", ["psf 2 0", "python 2 0"], ["python software foundation license", "python software foundation license version 2", "psf license"]),
    ("Unlicense", "public domain", ["unlicense"], ["unlicense"]),
    ("WTFPL", "permissive", ["wtfpl"], ["wtfpl"]),
    ("Zlib", "permissive", ["zlib"], ["zlib license"]),
]
# What stands before a name in notices.
BEFORE = ["licensed under the", "released under the", "distributed under the", "this work is licensed under the", "this work is licensed under a", "this project is licensed under the", "this software is licensed under the", "available under the", "made available under the", "this project is available under the", "this software is available under the", "this code is available under the", "it is available under the"]
# Sentences of public licences in plain form, by identifier, as the splitter cuts them.
SENTENCES = {
    "A2": "licensed under the apache license version 2 0 the license",
    "A3": "you may not use this file except in compliance with the license",
    "A4": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "A5": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "A6": "see the license for the specific language governing permissions and limitations under the license",
    "A7": "you may obtain a copy of the license at",
    "A8": "http www apache org licenses license 2 0",
    "A9": "apache license version 2 0 january 2004",
    "A10": "terms and conditions for use reproduction and distribution",
    "A11": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "A12": "https www apache org licenses license 2 0",
    "M2": "mit license",
    "M3": "the mit license",
    "M4": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "M5": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "M6": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "M7": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "M8": "the mit license mit",
    "I1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "I2": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "I3": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "I4": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "I5": "isc license",
    "I6": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "B1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "B2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "B3": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "B4": "neither the name of nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "B5": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "B6": "bsd 2 clause license",
    "B7": "bsd 3 clause license",
    "B8": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "B9": "bsd 4 clause license",
    "AR1": "the artistic license 2 0",
    "AR2": "artistic license 2 0",
    "PS1": "python software foundation license version 2",
    "W1": "do what the fuck you want to public license",
    "G2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "G3": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "G4": "see the gnu general public license for more details",
    "G5": "this program is free software",
    "G6": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "G7": "this program is distributed in the hope that it will be useful but without any warranty",
    "G8": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "G9": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "G10": "gnu general public license version 3 29 june 2007",
    "G11": "gnu general public license version 2 june 1991",
    "L1": "this library is free software",
    "L2": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "L3": "this library is distributed in the hope that it will be useful but without any warranty",
    "L4": "see the gnu lesser general public license for more details",
    "L5": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "L6": "gnu lesser general public license version 3 29 june 2007",
    "L7": "gnu lesser general public license version 2 1 february 1999",
    "F1": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "F2": "see the gnu affero general public license for more details",
    "F3": "gnu affero general public license version 3 19 november 2007",
    "P1": "this source code form is subject to the terms of the mozilla public license v",
    "P2": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "P3": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "P4": "mozilla public license version 2 0",
    "U1": "this is free and unencumbered software released into the public domain",
    "U2": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "Z1": "this software is provided as is without any express or implied warranty",
    "Z2": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "O1": "boost software license version 1 0 august 17th 2003",
    "E1": "eclipse public license v 2 0",
    "C6": "cc0 1 0 universal",
    "C7": "creative commons legal code cc0 1 0 universal",
}
# Rules by licence, as sequences of identifiers; of a licence any rule will do.
SEQUENCES = {
    "0BSD": ["I4 I2", "I4 I2 I3"],
    "AGPL-3.0": ["F3", "F1", "G5 F1 G7 G8 F2", "F1 G7 G8 F2"],
    "Apache-2.0": ["A2 A3 A4 A5 A6", "A2 A3 A7 A8 A5 A6", "A2 A3 A11 A5 A6", "A2 A3 A7 A12 A5 A6", "A2 A3", "A9", "A9 A10"],
    "BSD-2-Clause": ["B1 B2 B3", "B1 B2 B3 B5", "B6", "B6 B1 B2 B3 B5", "B6 B1 B2 B3"],
    "BSD-3-Clause": ["B1 B2 B3 B4", "B1 B2 B3 B4 B5", "B7", "B7 B1 B2 B3 B4 B5", "B7 B1 B2 B3 B4"],
    "BSD-4-Clause": ["B1 B2 B3 B8 B4", "B1 B2 B3 B8 B4 B5", "B1 B2 B3 B8", "B9", "B9 B1 B2 B3 B8 B4 B5", "B9 B1 B2 B3 B8 B4"],
    "Artistic-2.0": ["AR1", "AR2"],
    "PSF-2.0": ["PS1"],
    "WTFPL": ["W1"],
    "BSL-1.0": ["O1"],
    "CC0-1.0": ["C6", "C7"],
    "EPL-2.0": ["E1"],
    "GPL-2.0": ["G11", "G9", "G5 G9 G7 G8 G4", "G9 G7 G8 G4"],
    "GPL-3.0": ["G10", "G6", "G2", "G2 G3 G4", "G5 G6 G7 G8 G4", "G6 G7 G8 G4"],
    "ISC": ["I1", "I1 I2", "I1 I2 I3", "I6", "I6 I2", "I6 I2 I3", "I5", "I5 I1 I2 I3", "I5 I6 I2 I3"],
    "LGPL-2.1": ["L7", "L2", "L1 L2 L3 G8 L4", "L2 L3 G8 L4"],
    "LGPL-3.0": ["L6", "L5", "L1 L5 L3 G8 L4", "L5 L3 G8 L4", "G5 L5 G7 G8 L4"],
    "MIT": ["M2", "M3", "M8", "M6", "M4 M5", "M6 M4 M5", "M6 M4 M5 M7", "M2 M6 M4 M5 M7", "M3 M6 M4 M5 M7", "M8 M6 M4 M5 M7"],
    "MPL-2.0": ["P1", "P1 P2", "P1 P3", "P4"],
    "Unlicense": ["U1", "U1 U2"],
    "Zlib": ["Z1 Z2"],
}


def _tables() -> tuple[dict[str, str], list[tuple[str, str, str]]]:
    """Sentences by identifier, and rules (licence, kind, sequence): the fixed ones, with those of tags and notices."""
    sentences, rules = dict(SENTENCES), []
    by_sentence = {v: k for k, v in sentences.items()}
    for licence, kind, tags, names in LICENCES:
        own = list(SEQUENCES.get(licence, ()))
        short = [f"licensed under {t}" for t in tags if t.startswith("cc ")]
        for k, said in enumerate([*(f"spdx license identifier {t}" for t in tags), *short, *(f"{b} {n}" for n in names for b in BEFORE)]):
            if said not in by_sentence:
                by_sentence[said] = f"{licence}#{k}"
                sentences[by_sentence[said]] = said
            own.append(by_sentence[said])
        rules += [(licence, kind, ids) for ids in dict.fromkeys(own)]
    return sentences, sorted(rules, key=lambda r: (-len(r[2].split()), r))


KNOWN, RULES = _tables()
#: Every known sentence has one of these words, so a text without them has none.
MARKS = "advertising materials|wtfpl|licens|copyright|warrant|redistribut|mit|apache|gpl|free software|public domain|cc0|permission|spdx|in no event|reproduction|mpl|anyone is free"
SENTENCE_END = r"([.!?;:])[\x20\x09-\x0D]+"
BLANK_LINE = r"\n[\x20\x09-\x0D]*\n"
#: An SPDX tag's colon, its exception, its first AND or OR, and the holder's name between words that are always the same.
TAG = r"(?i)(spdx-license-identifier):"
WITH = r"(?i)(spdx-license-identifier[^\n]*?)[ \t]+with[ \t]+[a-z0-9.-]+"
EITHER = r"(?i)(spdx-license-identifier)([ \t:]+[^\n]*?[^ \t\n:][ \t]*)[ \t](?:and|or)[ \t]"
#: Licences of an SPDX expression at most.
CHOICES = 6
HOLDER = r"(?i)(neither[^a-z0-9]+the[^a-z0-9]+name)s?([^a-z0-9]+of)[^a-z0-9][^;:]{1,200}?[^a-z0-9](nor[^a-z0-9])"
#: What is replaced, in order: each step takes one AND or OR of a tag's line.
REPLACED = [(WITH, 1, ""), *[(EITHER, 2, "\n\nSPDX-License-Identifier ")] * (CHOICES - 1), (TAG, 1, " ")]


def _replaced(text: Column) -> Column:
    tagged = text
    for pattern, groups, after in REPLACED:
        tagged = F.regexp_replace(tagged, pattern, "".join(f"${g}" for g in range(1, groups + 1)) + after)
    tags = F.lower(text).contains("spdx-license-identifier")  # most texts have none
    return F.regexp_replace(F.when(tags, tagged).otherwise(text), HOLDER, "$1$2 $3")


def _replaced_sql(text: str) -> str:
    for pattern, groups, after in REPLACED:
        said = "".join(f"\\{g}" for g in range(1, groups + 1))
        text = f"regexp_replace({text}, '{pattern}', '{said}' || " + ("chr(10) || chr(10) || " if "\n" in after else "") + f"'{after.strip(chr(10))}', 'g')"
    return f"regexp_replace({text}, '{HOLDER}', '\\1\\2 \\3', 'g')"


#: A line has a word at least, so no sentence has more lines than words.
LINES = max(len(s.split()) for s in KNOWN.values())


def _spaced(ids: str) -> str:
    """Each identifier between spaces of its own, so that sequences can be searched for as texts."""
    return "".join(f" {x} " for x in ids.split())


#: All rules as one pattern; of those that begin in one place the first, the longest, is taken.
ANY_RULE = "|".join(_spaced(ids).replace(".", "\\.") for _, _, ids in RULES)


def plain(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, kinds): identifiers in order, licences and their kinds by name."""
    known = F.create_map(*[F.lit(x) for name, sentence in KNOWN.items() for x in (sentence, name)])
    marked = F.lower(F.col(text)).rlike(MARKS)
    bare = _replaced(F.col(text))
    runs = F.split(F.regexp_replace(bare, SENTENCE_END, "$1\n\n"), BLANK_LINE)
    # Sentences by their first word; a line that begins one is told from others by its first word mostly.
    starts: dict[str, list[str]] = {}
    for s in KNOWN.values():
        starts.setdefault(s.split()[0], []).append(s)
    begins = F.create_map(*[x for w, all_of in starts.items() for x in (F.lit(w), F.array(*[F.lit(s) for s in all_of]))])

    def sentences(lines: Column) -> Column:
        def longest(line: Column, i: Column) -> Column:
            upto = F.sequence(F.least(F.size(lines) - i, F.lit(LINES)), F.lit(1))
            names = F.filter(F.transform(upto, lambda n: F.element_at(known, F.array_join(F.slice(lines, i + 1, n), " "))), lambda x: x.isNotNull())
            first = F.element_at(begins, F.substring_index(line, " ", 1))
            return F.when(F.coalesce(F.exists(first, lambda s: s.startswith(line)), F.lit(False)), F.get(names, F.lit(0)))

        return F.filter(F.transform(lines, longest), lambda x: x.isNotNull())

    ids = F.flatten(F.transform(runs, lambda run: let(F.filter(F.transform(F.split(run, "\n"), plain), lambda x: x != ""), sentences)))
    found = docs.select(F.col(key).alias("doc_id"), F.when(marked, F.array_join(ids, " ")).otherwise(F.lit("")).alias("sentence_ids"))
    found = found.withColumn("sentence_ids", F.coalesce("sentence_ids", F.lit("")))
    spaced = F.concat(F.lit(" "), F.replace("sentence_ids", F.lit(" "), F.lit("  ")), F.lit(" "))
    hits = F.regexp_extract_all(spaced, F.lit(f"({ANY_RULE})"), F.lit(1))

    def names(place: int) -> Column:
        of = F.create_map(*[F.lit(x) for r in RULES for x in (_spaced(r[2]), r[place])])
        return F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda m: F.element_at(of, m)))), ",")

    none = F.col("sentence_ids") == ""
    found = found.withColumn("_hits", F.when(none, F.array().cast("array<string>")).otherwise(hits))
    count = F.when(none, F.lit(0)).otherwise(F.size(F.split("sentence_ids", " "))).cast("long")
    return found.select("doc_id", count.alias("n_sentences"), "sentence_ids", names(0).alias("licenses"), names(1).alias("kinds"))


def oracle_sql() -> str:
    """The same in DuckDB SQL."""
    rules = ", ".join(f"('{a}', '{b}', '{_spaced(c)}')" for a, b, c in RULES)
    sentences = ", ".join(f"('{n}', '{s}')" for n, s in KNOWN.items())
    named = lambda c: f"coalesce((SELECT string_agg({c}, ',' ORDER BY {c}) FROM (SELECT DISTINCT {c} FROM rules WHERE list_contains(hits, rules.ids))), '')"
    return f"""
WITH known(id, sentence) AS (VALUES {sentences}), rules(licence, kind, ids) AS (VALUES {rules}),
docs AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
bare AS (SELECT r, {_replaced_sql('text')} AS t FROM docs WHERE text IS NOT NULL),
runs AS (SELECT r, unnest(string_split_regex(u, '\\n[\\x20\\x09-\\x0D]*\\n')) AS s, generate_subscripts(string_split_regex(u, '\\n[\\x20\\x09-\\x0D]*\\n'), 1) AS run
  FROM (SELECT r, regexp_replace(t, '([.!?;:])[\\x20\\x09-\\x0D]+', '\\1' || chr(10) || chr(10), 'g') AS u FROM bare)),
lines AS (SELECT r, run, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS p FROM runs),
begun AS (SELECT r, run, p, unnest(range(1, len(p) + 1)) AS i FROM lines),
hit AS (SELECT r, run, i, arg_max(id, k) AS id FROM (SELECT r, run, p, i, unnest(range(1, least(len(p) - i + 1, {LINES}) + 1)) AS k FROM begun
  WHERE EXISTS (SELECT 1 FROM known WHERE starts_with(known.sentence, p[i]))) w JOIN known ON array_to_string(list_slice(p, i, i + k - 1), ' ') = sentence GROUP BY r, run, i),
seq AS (SELECT doc_id, coalesce(string_agg(id, ' ' ORDER BY run, i), '') AS ids, count(id) AS n FROM docs LEFT JOIN hit USING (r) GROUP BY r, doc_id),
found AS (SELECT *, regexp_extract_all(' ' || replace(ids, ' ', '  ') || ' ', '({ANY_RULE})', 1) AS hits FROM seq)
SELECT doc_id, n AS n_sentences, ids AS sentence_ids, {named('licence')} AS licenses, {named('kind')} AS kinds
FROM found"""
