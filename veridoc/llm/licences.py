"""Licence recognition by ordered sentence rules; DataFrame functions only.

A text is cut into sentences, each is normalised and mapped to the identifier of a known licence sentence, unknown ones
drop out, and the remaining identifiers, in order, are matched against the rules: a rule holds if its identifiers stand
one after another in the sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.sources.tables import table

# Sentences of public licences and notices, normalised (lower case, words apart by one space).
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    4: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    5: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    6: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    10: "licensed under the apache license version 2 0",
    11: "licensed under the apache license version 2 0 the license",
    12: "you may not use this file except in compliance with the license",
    13: "you may obtain a copy of the license at",
    14: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    15: "see the license for the specific language governing permissions and limitations under the license",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    22: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    23: "see the gnu general public license for more details",
    24: "you should have received a copy of the gnu general public license along with this program",
    25: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    26: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    27: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    28: "see the gnu lesser general public license for more details",
    29: "you should have received a copy of the gnu lesser general public license along with this library",
    30: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    31: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    32: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    33: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    34: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    35: "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    40: "licensed under cc by nc 4 0",
    41: "licensed under cc by 4 0",
    42: "licensed under cc by sa 4 0",
    43: "this work is licensed under a creative commons attribution 4 0 international license",
    44: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    45: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    50: "all rights reserved",
    60: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    61: "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    62: "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    70: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    71: "see the gnu affero general public license for more details",
    72: "you should have received a copy of the gnu affero general public license along with this program",
    73: "this source code form is subject to the terms of the mozilla public license v",
    74: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    75: "this software is provided as is without any express or implied warranty",
    76: "in no event will the authors be held liable for any damages arising from the use of this software",
    77: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    78: "distributed under the boost software license version 1 0",
    80: "this project is licensed under the mit license see the license file for details",
    81: "licensed under the mit license see license",
    82: "this project is licensed under the apache license 2 0 see the license file for details",
    83: "licensed under the mit license see the license file for details",
    84: "licensed under the apache license version 2 0 see license",
    100: "spdx license identifier mit",
    101: "spdx license identifier apache 2 0",
    102: "spdx license identifier gpl 2 0 only",
    103: "spdx license identifier gpl 2 0 or later",
    104: "spdx license identifier gpl 3 0 only",
    105: "spdx license identifier gpl 3 0 or later",
    106: "spdx license identifier lgpl 2 1 or later",
    107: "spdx license identifier agpl 3 0 or later",
    108: "spdx license identifier bsd 2 clause",
    109: "spdx license identifier bsd 3 clause",
    110: "spdx license identifier isc",
    111: "spdx license identifier mpl 2 0",
    112: "spdx license identifier zlib",
    113: "spdx license identifier bsl 1 0",
    114: "spdx license identifier cc by 4 0",
    115: "spdx license identifier cc0 1 0",
    116: "spdx license identifier unlicense",
}
# Rules as (licence, kind, identifiers in order).
RULES = (
    ("MIT", "notice", (1,)), ("MIT", "notice", (2,)), ("MIT", "text", (3, 4, 5, 6)),
    ("Apache-2.0", "notice", (10,)), ("Apache-2.0", "header", (11, 12, 13)), ("Apache-2.0", "header", (11, 12, 13, 14, 15)), ("Apache-2.0", "header", (12, 14, 15)),
    ("GPL-3.0-only", "notice", (20,)), ("GPL-3.0-or-later", "header", (21,)), ("GPL-3.0-or-later", "header", (21, 22, 23, 24)),
    ("GPL-2.0-or-later", "header", (25,)), ("GPL-2.0-or-later", "header", (25, 22, 23, 24)),
    ("LGPL-2.1-or-later", "header", (26,)), ("LGPL-2.1-or-later", "header", (26, 27, 28, 29)), ("AGPL-3.0-or-later", "header", (70,)), ("AGPL-3.0-or-later", "header", (70, 22, 71, 72)),
    ("BSD-2-Clause", "text", (30, 31, 32)), ("BSD-2-Clause", "text", (30, 31, 32, 34, 35)), ("BSD-3-Clause", "text", (30, 31, 32, 33)), ("BSD-3-Clause", "text", (30, 31, 32, 33, 34, 35)),
    ("ISC", "text", (60, 61, 62)), ("MPL-2.0", "header", (73, 74)), ("Zlib", "text", (75, 76, 77)), ("BSL-1.0", "notice", (78,)),
    ("CC-BY-NC-4.0", "notice", (40,)), ("CC-BY-4.0", "notice", (41,)), ("CC-BY-SA-4.0", "notice", (42,)),
    ("CC-BY-4.0", "notice", (43,)), ("CC-BY-NC-4.0", "notice", (44,)), ("CC-BY-SA-4.0", "notice", (45,)),
    ("Proprietary", "notice", (50,)), ("MIT", "notice", (80,)), ("MIT", "notice", (81,)), ("Apache-2.0", "notice", (82,)), ("MIT", "notice", (83,)), ("Apache-2.0", "notice", (84,)),
    ("MIT", "tag", (100,)), ("Apache-2.0", "tag", (101,)), ("GPL-2.0-only", "tag", (102,)), ("GPL-2.0-or-later", "tag", (103,)), ("GPL-3.0-only", "tag", (104,)), ("GPL-3.0-or-later", "tag", (105,)),
    ("LGPL-2.1-or-later", "tag", (106,)), ("AGPL-3.0-or-later", "tag", (107,)), ("BSD-2-Clause", "tag", (108,)), ("BSD-3-Clause", "tag", (109,)), ("ISC", "tag", (110,)), ("MPL-2.0", "tag", (111,)),
    ("Zlib", "tag", (112,)), ("BSL-1.0", "tag", (113,)), ("CC-BY-4.0", "tag", (114,)), ("CC0-1.0", "tag", (115,)), ("Unlicense", "tag", (116,)),
)
#: Each known sentence has one of these in it, so a text without them has no known sentence.
NEEDED = ("licens", "licenc", "copyright", "warrant", "compliance", "redistribut", "reserved", "obtain", "liable")
#: What stands before the words of a comment line; an end mark there ends nothing.
MARKS = r"(?m)^[ \t]*[^\p{L}\p{N}\s]+[ \t]+"
#: What is put for what, one after another; the text is lower-cased before the blank is put for what is no word. A run of marks is
#: entered only where it begins and never given back ({0} and {1}), so its length counts once. SQL, whose expressions take linear
#: time anyway, has neither sign.
STEPS = (
    ("\r\n?", "\n"), (MARKS, ""), (r"([.!?])[ \t\r\n\x0B\f]+", "\x01"), (r"([;:])[ \t\r\n\x0B\f]+", "\x02"), (r"[^\p{L}\p{N}\n\x01\x02]+", " "),
    (r" ?\n[ \n]*\n ?", "\x01"), (r" ?\n ?", "\n"), (r"{0}[ \n\x02]*{1}\x01[ \n\x01\x02]*{1}", "\x01"), (r"{0}[ \n]*{1}\x02[ \n\x02]*{1}", "\x02"),
)


def normalised(text):
    """The text with words apart by one space, a line feed for each line end, \\x02 for each colon or semicolon before white
    space and \\x01 for each other end of a sentence: another end mark before white space or a line without words. Marks of
    comment lines vanish.
    """
    out = F.translate(text, "\x01\x02", "  ")
    for pattern, put in STEPS:
        start = r"(?<![ \n\x02])" if put == "\x01" else r"(?<![ \n])"
        out = F.regexp_replace(F.lower(out) if put == " " else out, pattern.replace("{0}", start).replace("{1}", "+"), put)
    return F.trim(out)


def identifiers(text):
    """The identifiers of the known sentences, in order, each with a space before and after it.

    A known sentence is a line, or several lines of a wrapped paragraph, whole: it starts and stops at the end of a line
    or of a sentence. It may have colons and semicolons within, as the GPL's have. Of two that start at the same place the longer one counts.
    """
    known = F.create_map(*[x for i, s in SENTENCES.items() for x in (F.lit(s), F.lit(f" {i} "))])
    any_known = "|".join(s.replace(" ", r"[ \n\x02]") for s in sorted(SENTENCES.values(), key=len, reverse=True))
    found = F.regexp_extract_all(normalised(text), F.lit(rf"(?<![^\n\x01\x02])(?:{any_known})(?![^\n\x01\x02])"), F.lit(0))
    return F.array_join(F.transform(found, lambda s: F.element_at(known, F.translate(s, "\n\x02", "  "))), "")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``licence``, ``kind``, ``rule`` (identifiers) and ``sentences`` (how many) for each rule that a row holds.

    A rule is left out where a longer one of the same row has all its identifiers. Texts that are null or have no known
    sentence give no row; repeated rows are reported as often. Every sentence of every text is looked at; texts without
    any of a few words that all known sentences need are passed over first, which changes no result. The time a text takes grows
    with its length, also where it is one run of marks. Of sentences that overlap, the one that starts first counts. An empty
    table gives no rows, and columns besides doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike("(?i)" + "|".join(NEEDED)))
    seen = rows.select("doc_id", identifiers(F.col("text")).alias("ids")).filter("ids <> ''")
    text = lambda ids: "".join(f" {i} " for i in ids)
    holds = lambda ids: F.contains(F.col("ids"), F.lit(text(ids)))
    made = []
    for licence, kind, ids in RULES:
        longer = [o for _, _, o in RULES if len(o) > len(ids) and text(ids) in text(o)]
        keep = holds(ids)
        for o in longer:
            keep = keep & ~holds(o)
        made.append(F.when(keep, F.struct(F.lit(licence).alias("licence"), F.lit(kind).alias("kind"), F.lit(" ".join(map(str, ids))).alias("rule"), F.lit(len(ids)).cast("long").alias("sentences"))))
    return seen.select("doc_id", F.explode(F.array_compact(F.array(*made))).alias("r")).select("doc_id", "r.*")


def op9_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    known = ", ".join(f"('{s}', {i})" for i, s in SENTENCES.items())
    text = lambda ids: "".join(f" {i} " for i in ids)
    rules = ", ".join(f"('{a}', '{k}', '{' '.join(map(str, ids))}', {len(ids)}, '{text(ids)}')" for a, k, ids in RULES)
    said = {"\n": "chr(10)", "\x01": "chr(1)", "\x02": "chr(2)", " ": "' '", "": "''"}
    out = "translate(text, concat(chr(1), chr(2)), '  ')"
    for pattern, put in STEPS:
        shown = pattern.replace("{0}", "").replace("{1}", "").replace("\r", "\\r").replace("\n", "\\n")
        out = f"regexp_replace({f'lower({out})' if put == ' ' else out}, '{shown}', {said[put]}, 'g')"
    # grow: known sentences that agree with the atoms from i to j, and what of them is still to come
    return rf"""
WITH RECURSIVE known(sentence, id) AS (VALUES {known}), rules(licence, kind, rule, sentences, ids) AS (VALUES {rules}),
cut AS (SELECT row_number() OVER () AS r, doc_id, trim({out}) AS n FROM documents WHERE text IS NOT NULL),
atom AS (SELECT r, unnest(regexp_extract_all(n, '([\n\x01\x02]*)([^\n\x01\x02]+)', 1)) AS sep, unnest(regexp_extract_all(n, '([\n\x01\x02]*)([^\n\x01\x02]+)', 2)) AS a,
    generate_subscripts(regexp_extract_all(n, '([\n\x01\x02]*)([^\n\x01\x02]+)', 2), 1) AS i FROM cut),
grow AS (SELECT r, i, i AS j, id, substr(sentence, length(a) + 2) AS rest FROM atom JOIN known ON sentence = a OR starts_with(sentence, concat(a, ' '))
    UNION ALL SELECT g.r, g.i, x.i, g.id, substr(g.rest, length(x.a) + 2) FROM grow g JOIN atom x ON x.r = g.r AND x.i = g.j + 1
      WHERE x.sep IN (chr(10), chr(2)) AND g.rest <> '' AND (g.rest = x.a OR starts_with(g.rest, concat(x.a, ' ')))),
whole AS (SELECT r, i, max(j) AS j, arg_max(id, j) AS id FROM grow WHERE rest = '' GROUP BY r, i),
taken AS (SELECT r, min(i) AS i, arg_min(j, i) AS j, arg_min(id, i) AS id FROM whole GROUP BY r
    UNION ALL SELECT * FROM (SELECT t.r, w.i, w.j, w.id FROM taken t JOIN whole w ON w.r = t.r AND w.i > t.j QUALIFY row_number() OVER (PARTITION BY t.r ORDER BY w.i) = 1)),
seq AS (SELECT r, string_agg(concat(' ', id, ' '), '' ORDER BY i) AS ids FROM taken GROUP BY r),
hit AS (SELECT s.r, u.* FROM seq s JOIN rules u ON contains(s.ids, u.ids))
SELECT doc_id, licence, kind, rule, CAST(sentences AS BIGINT) AS sentences FROM hit h JOIN cut USING (r)
WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.r = h.r AND o.sentences > h.sentences AND contains(o.ids, h.ids))
"""


OP9_SQL = _sql()
