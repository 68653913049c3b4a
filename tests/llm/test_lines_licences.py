import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from veridoc.llm import licences, lines


def same(spark, tmp_path, name, rows, schema, query, sql, extra):
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in extra})
    df.repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    out = query(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(out.columns) == sorted(names)
    key = lambda x: tuple(map(str, x))
    got = sorted((tuple(x[n] for n in names) for x in out.collect()), key=key)
    assert got == sorted(r.fetchall(), key=key)
    return got


PAGES = [(i, f"https://user@Site{i % 2}.org:80/p?{i}", f"<div>Menu</div><script>x<p>y</script><p>Text {i}<br/>more\n {i % 3}</p><!-- gone --><li>Foot &amp; note</li>") for i in range(24)]
PAGES += [(70 + i, "http://small.org/", f"<p>Menu</p><p>own {i}</p>") for i in range(4)] + [(80, "http://alone.org/", "<p>Menu</p><p>Menu</p>")]
PAGES += [(50, None, "<p>Menu</p>"), (51, "no url", None), (52, "http://site0.org/", ""), (3, PAGES[3][1], PAGES[3][2]), (None, "http://site1.org", "<p>only</p>"), (60, "http://site0.org", "<p>" + "word " * 50000)]


@pytest.mark.parametrize("rows", [PAGES, []])
def test_lines_equal_sql(spark, tmp_path, rows):
    got = same(spark, tmp_path, "pages", rows, "page_id long, url string, html string", lines.op2_line_dedup, lines.OP2_SQL, ("host", "lines", "line", "drop", "text"))
    if rows:
        assert all("Menu" not in x[-1] for x in got if x[1] == "site0.org") and any("Text 4" in x[-1] for x in got)
        assert [x[-1] for x in got if x[1] == "small.org"] == [f"own {i}" for i in range(4)] and [x[-1] for x in got if x[1] == "alone.org"] == ["Menu\nMenu"]


DOCS = [(1, "Intro. Released under the MIT License."), (2, "Licensed  under CC BY-NC 4.0.\nAll Rights Reserved"), (3, "released under the mit license without end"), (4, None), (5, ""), (6, "x. " * 30000 + "\nAll rights reserved."),
        (7, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n" + ". ".join(licences.SENTENCES[i] for i in (31, 32, 33)) + "."),
        (8, ". ".join(licences.SENTENCES[i] for i in (30, 31)) + ". Between. " + licences.SENTENCES[32] + "."), (9, ". ".join(licences.SENTENCES[i] for i in (31, 30, 32))), (1, "Released under the MIT License!"), (1, "Released under the MIT License!"), (None, "All rights reserved.")]


@pytest.mark.parametrize("rows", [DOCS, []])
def test_licences_equal_sql(spark, tmp_path, rows):
    got = same(spark, tmp_path, "documents", rows, "doc_id long, text string", licences.op9_licence_rules, licences.OP9_SQL, ("ids", "licence", "rule", "sentences"))
    if rows:
        found = {(r[0], r[1]) for r in got}
        assert {(1, "MIT"), (2, "CC-BY-NC-4.0"), (2, "Proprietary"), (6, "Proprietary"), (7, "BSD-3-Clause"), (8, "BSD-2-Clause"), (None, "Proprietary")} == found


def test_every_sentence_has_a_needed_word():
    assert all(any(n in s for n in licences.NEEDED) for s in licences.SENTENCES.values())


MIT = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
       "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
       "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."]
APACHE = ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "    http://www.apache.org/licenses/LICENSE-2.0",
          "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."]
GPL = ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
       "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
       "You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."]
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
       "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
       "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]


@pytest.mark.parametrize(("mark", "end"), [("", "\n"), ("# ", "\n"), (" * ", "\r\n"), ("// ", "\n"), (";; ", "\n")])
@pytest.mark.parametrize("width", [70, 80])
def test_wrapped_licences(spark, mark, end, width):
    def text(parts):
        return "".join(f"{mark}{line}".rstrip() + end for p in [f"Copyright (c) 2020 {mark} Someone", *parts] for line in [*textwrap.wrap(p, width), ""]) + "int main() {}"

    made = {"MIT": text(MIT), "Apache-2.0": text(APACHE), "BSD-3-Clause": text(BSD), "GPL-3.0-or-later": text(GPL)}
    rows = [(i, t) for i, t in enumerate(made.values())] + [(10, f"{mark}Released under the MIT{end}{mark}License{end}{mark}All rights reserved{end}{mark}by us"), (11, f"{mark}All rights{end}{end}{mark}reserved")]
    got = sorted((r.doc_id, r.licence, r.rule) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "MIT", "3 4 5 6"), (1, "Apache-2.0", "11 12 13 14 15"), (2, "BSD-3-Clause", "30 31 32 33"), (3, "GPL-3.0-or-later", "21 22 23 24"), (10, "MIT", "1"), (10, "Proprietary", "50")]


PROGRAM = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
MORE = {
    ("GPL-2.0-or-later", "25 22 23 24"): [GPL[0].replace("version 3", "version 2"), PROGRAM + "See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program; if not, see <https://www.gnu.org/licenses/>."],
    ("LGPL-2.1-or-later", "26 27 28 29"): [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        PROGRAM.replace("program", "library") + "See the GNU Lesser General Public License for more details.", "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation"],
    ("AGPL-3.0-or-later", "70 22 71 72"): [GPL[0].replace("GNU General", "GNU Affero General"), PROGRAM + "See the GNU Affero General Public License for more details.", GPL[2].replace("GNU General", "GNU Affero General")],
    ("BSD-2-Clause", "30 31 32 34 35"): [*BSD[:3], DISCLAIMER], ("BSD-3-Clause", "30 31 32 33 34 35"): [*BSD, DISCLAIMER],
    ("ISC", "60 61 62"): [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    ("MPL-2.0", "73 74"): ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    ("Zlib", "75 76 77"): [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    ("BSL-1.0", "78"): ["Distributed under the Boost Software License, Version 1.0. (See the file beside this one)"],
}


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_more_wrapped_licences(spark, mark):
    text = ["".join(f"{mark}{line}".rstrip() + "\n" for p in parts for line in [*textwrap.wrap(p, 76), ""]) + "x = 1" for parts in MORE.values()]
    got = sorted((r.doc_id, r.licence, r.rule) for r in licences.scan(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).collect())
    assert got == [(i, *known) for i, known in enumerate(MORE)]


def wrapped():
    every = [MIT, APACHE, GPL, BSD, *MORE.values()]
    for i, (parts, mark, end) in enumerate((p, m, e) for p in every for m, e in (("", "\n"), ("# ", "\n"), (" * ", "\r\n"), (";; ", "\r"))):
        yield i, "".join(f"{mark}{line}".rstrip() + end for p in [f"Copyright {mark} Someone; others", *parts] for line in [*textwrap.wrap(p, 70), ""]) + "int main() {}"
    yield from [(900, "Licensed under the Apache License,\nVersion 2.0\nthe License"), (901, "Released under; the MIT license\nAll rights reserved"), (902, "a\x01b\x02 All rights reserved\x01x"), (903, "\n\n;\n; All rights\n reserved ;"), (904, "All rights reserved\nAll rights reserved reserved\nALL  RIGHTS\tRESERVED:")]
    yield from [(910, "SPDX-License-Identifier: MIT"), (911, "// SPDX-License-Identifier: Apache-2.0\ncode()"), (912, "This project is licensed under the MIT License - see the LICENSE file for details."), (913, "Licensed under the MIT license (see LICENSE).")]


def test_wrapped_licences_equal_sql(spark, tmp_path):
    got = same(spark, tmp_path, "documents", list(wrapped()), "doc_id long, text string", licences.op9_licence_rules, licences.OP9_SQL, ("ids", "rule"))
    assert len(got) > 55 and {(r[0], r[1]) for r in got if r[0] >= 910} == {(910, "MIT"), (911, "Apache-2.0"), (912, "MIT"), (913, "MIT")}


def test_long_runs_of_marks_take_linear_time(spark):
    import time

    runs = ["; ", ": ", "\n", " ", ". ", ";\n", "\n:", "# ", "\r\n", "\x02", "\t;", "a\n;"]
    rows = [(i, "license " + mark * (1_000_000 // len(mark)) + "\nAll rights reserved.") for i, mark in enumerate(runs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    start = time.perf_counter()
    assert {r.doc_id for r in licences.scan(df).collect()} == set(range(len(runs)))
    assert time.perf_counter() - start < 60
