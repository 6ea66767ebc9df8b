"""License scans: a canonical digest of each entire text, hash-joined to the digests of known license texts; with DataFrame functions only.

Canonical form: lines that start with a copyright statement go; lower case; every run of other characters than letters and digits becomes one blank;
equivalent spellings become one. A line of a text is looked up in the same way, as license notices are single lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: license texts (public), notices, digests of longer license texts in canonical form, and equivalent spellings ----
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
TEXTS = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("ISC", f"ISC License\n{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("0BSD", f"{_GRANT}.\n{_ISC_END}"),
    ("0BSD", f"BSD Zero Clause License\n{_GRANT}.\n{_ISC_END}"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    *[(i, f"SPDX-License-Identifier: {i}") for i in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0")],
]
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Artistic-1.0-Perl", "de5e8896b763918701eb91e7bf8bf81f20a97c9f8dd1cacc44519e47d3462bf8"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2-only", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3-only", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
]
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("wilfull", "willful"), ("https", "http"),
]
#: A copyright statement names a year, a sign or an owner; "copyright notice" and "COPYRIGHT HOLDERS" at the start of a wrapped line are none.
COPYRIGHT = r"(?m)^[ \t\r*#/;-]*((?i:copyright)[ \t:]*(\([cC]\)|©|[0-9]{4}|<|\[)|(?i:copyright)[ \t]+by[ \t]|Copyright[ \t]+[A-Z][a-z]|\([cC]\)[ \t]*(?i:copyright|[0-9]{4})|©|(?i:all rights reserved))[^\n]*$"
PHRASES = [("sub license", "sublicense"), ("sub licence", "sublicense"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement")]
#: Every known text holds one of these in lower case; a text without any cannot be one.
ANCHORS = ("licens", "licenc", "permission", "redistribut")
# ---- end of fixed values ----


def canonical(text: Column) -> Column:
    low = F.lower(F.regexp_replace(text, COPYRIGHT, ""))
    word = F.split(F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), " ")
    same = F.create_map(*[F.lit(x) for pair in SPELLINGS for x in pair])
    out = F.array_join(F.transform(word, lambda w: F.coalesce(F.try_element_at(same, w), w)), " ")
    for a, b in PHRASES:
        out = F.regexp_replace(out, rf"\b{a}", b)
    return out


def known(spark) -> DataFrame:
    """(digest, license): a fixed table, bounded by this module."""
    texts = spark.createDataFrame(TEXTS, "license string, text string").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license")
    return texts.union(spark.createDataFrame(DIGESTS, "license string, digest string").select("digest", "license")).distinct()


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id column, license, notices): for each row, the license that the entire text is (null if none) and the licenses that lines of it name, in order, joined by commas.

    Every whole text is tested. A text that isn't a known license has a null license; null and empty texts too; notices are then empty. Rows that share an id are
    looked up together (the least license; all their notices); a null id is an id of its own. A very long text is one row and is canonicalised whole; an empty table gives no rows; other columns are left out, whatever their names. The known digests are a fixed small table and are
    broadcast; only texts with an anchor word are canonicalised, and only their matches are aggregated.
    """
    spark = docs.sparkSession
    low = F.lower(text_col)
    anchored = lambda c: F.greatest(*[c.contains(a) for a in ANCHORS])
    some = docs.where(anchored(low)).select(F.col(id_col).alias("__id"), F.col(text_col).alias("t"))
    lines = F.filter(F.transform(F.split("t", "\n", -1), lambda x, i: F.struct(x.alias("t"), i.alias("i"))), lambda s: anchored(F.lower(s.t)))
    units = some.select("__id", F.col("t"), F.lit(-1).alias("i")).union(some.select("__id", F.explode(lines).alias("s")).select("__id", "s.t", "s.i"))
    hits = units.select("__id", "i", F.sha2(canonical(F.col("t")), 256).alias("digest")).join(F.broadcast(known(spark)), "digest")
    hits = hits.groupBy("__id").agg(F.min(F.when(F.col("i") < 0, F.col("license"))).alias("license"), F.array_sort(F.collect_list(F.when(F.col("i") >= 0, F.struct("i", "license")))).alias("n"))
    out = docs.select(id_col).join(hits, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    return out.select(id_col, "license", F.coalesce(F.array_join(F.transform("n", lambda s: s.license), ","), F.lit("")).alias("notices"))


def sql(documents: str = "documents") -> str:
    """The same over a table in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    same = "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in SPELLINGS) + "}"
    bare = lambda t: f"array_to_string(list_transform(string_split(trim(regexp_replace(lower(regexp_replace({t}, {q(COPYRIGHT)}, '', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: coalesce({same}[w], w)), ' ')"
    canon = lambda t: reduce(lambda x, p: f"regexp_replace({x}, '\\b{p[0]}', '{p[1]}', 'g')", PHRASES, bare(t))
    anchored = lambda t: "(" + " OR ".join(f"contains({t}, {q(a)})" for a in ANCHORS) + ")"
    texts = ", ".join(f"({q(i)}, {q(t)})" for i, t in TEXTS)
    digests = "".join(f" UNION SELECT {q(d)}, {q(i)}" for i, d in DIGESTS)
    return f"""
        WITH known AS (SELECT DISTINCT sha256({canon("text")}) AS digest, license FROM (VALUES {texts}) AS k(license, text){digests}),
        anch AS (SELECT doc_id, text AS t FROM {documents} WHERE {anchored("lower(text)")}),
        lines AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM anch),
        units AS (SELECT doc_id, t, -1 AS i FROM anch UNION ALL SELECT doc_id, t, i FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS i FROM lines) WHERE {anchored("lower(t)")}),
        hits AS (SELECT doc_id, i, license FROM (SELECT doc_id, i, sha256({canon("t")}) AS digest FROM units) JOIN known USING (digest)),
        agg AS (SELECT doc_id, min(license) FILTER (WHERE i < 0) AS license, string_agg(license, ',' ORDER BY i, license) FILTER (WHERE i >= 0) AS notices FROM hits GROUP BY doc_id)
        SELECT doc_id, license, coalesce(notices, '') AS notices FROM {documents} LEFT JOIN agg USING (doc_id)"""
