"""Licence scans by canonical digest, in DataFrame operations only.

Whole documents, paragraphs and lines are brought to a canonical form (case, punctuation, spaces,
copyright lines, equivalent spellings) and their SHA-256 is looked up among the digests of known
licence texts, which take the same way. Nothing is matched by substring: a text counts if all of
it is the licence text. Known texts come as a table; the list here is the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and the usual one-line grants, by SPDX identifier.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD_2_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
BSD_3_TEXT = BSD_2_TEXT.replace("THIS SOFTWARE IS", BSD_3_CLAUSE + "THIS SOFTWARE IS")
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
KNOWN = (
    ("MIT", MIT_TEXT),
    ("MIT", "The MIT License\n\n" + MIT_TEXT),
    ("MIT", "MIT License\n\n" + MIT_TEXT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("ISC", ISC_TEXT),
    ("ISC", "ISC License\n\n" + ISC_TEXT),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("BSD-2-Clause", BSD_2_TEXT),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2_TEXT),
    ("BSD-3-Clause", BSD_3_TEXT),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_3_TEXT),
    ("Unlicense", UNLICENSE_TEXT),
    ("Zlib", ZLIB_TEXT),
    ("Zlib", "zlib License\n\n" + ZLIB_TEXT),
    ("GPL-3.0-or-later", GPL_NOTICE),
    ("LGPL-3.0-or-later", GPL_NOTICE.replace("GNU General", "GNU Lesser General")),
    ("AGPL-3.0-or-later", GPL_NOTICE.replace("GNU General", "GNU Affero General")),
    ("GPL-2.0-or-later", GPL_NOTICE.replace("version 3", "version 2")),
    ("MPL-2.0", MPL_NOTICE),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Spellings that mean the same, applied to lower-case text without punctuation; a line may end within one.
SPELLINGS = (
    (r"\blicence(s|d|e|es)?\b", "license$1"),
    (r"\bsub[ \n]+(licens)", "sub$1"),
    (r"\bcreative[ \n]+commons[ \n]+attribution\b", "cc by"),
    (r"\bhttps\b", "http"),
    (r"\b(?:v|ver|version)[ \n]*([0-9])", "version $1"),
    (r"\bnon[ \n]+(commercial|infring)", "non$1"),
    (r"\bper[ \n]+cent\b", "percent"),
    (r"\bcopyright[ \n]+owner(s?)\b", "copyright holder$1"),
    (r"\b(acknowledg|judg)ement", "$1ment"),
    (r"\b(fav|lab|col|hon)our", "$1or"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bwhilst\b", "while"),
    (r"([a-z]{3})is(e|ed|es|ing|ation|ations)\b", "$1iz$2"),
)
# Every known text has one of these in any spelling, so a document without them can match nothing; others are refused.
ANCHORS = ("licen", "permission", "unencumbered", "redistribut")
#: Digests that are broadcast; with more known texts both sides are shuffled.
SENT_DIGESTS = 100_000
WORDLESS = r"[^\p{L}\p{N}\n]+"
PARAGRAPH = r"\r?\n[ \t\r]*\n\s*"
#: Copyright lines go; a line of a wrapped text that begins with "copyright notice" and the like is none, and is marked before.
NO_NOTICE, MARKED = r"(?m)^([^\p{L}\p{N}\n]*)copyright[ \t]+(notice|holder|owner|law|interest|licen|and|or|in|on|of|is|to|claim|statement)", "$1qqcopyright $2"
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b[^\n]*[\p{L}\p{N}]|\(c\) ?[0-9]|©)[^\n]*$"


def canonical_lines(text: Column) -> Column:
    """array<string>: the canonical form of each line; '' for lines without letters or digits."""
    out = F.regexp_replace(F.lower(text), NO_NOTICE, MARKED)
    out = F.replace(F.regexp_replace(out, COPYRIGHT_LINE, ""), F.lit("qqcopyright"), F.lit("copyright"))
    out = F.regexp_replace(out, WORDLESS, " ")
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.transform(F.split(out, "\n"), lambda x: F.trim(x))


def joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


Known = tuple[tuple[str, str], ...] | DataFrame


def known_texts(spark: SparkSession, known: Known = KNOWN) -> DataFrame:
    if isinstance(known, DataFrame):
        return known.select("license", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in known])
    return spark.range(1).select(F.inline(rows))


def anchored(text: Column, anchors: tuple[str, ...]) -> Column:
    lowered, able = F.lower(text), F.lit(False)
    for a in anchors:
        able = able | F.contains(lowered, F.lit(a))
    return able


def known_digests(spark: SparkSession, known: Known = KNOWN, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """license, digest, one row for each distinct canonical text. Texts without an anchor are refused."""
    texts = known_texts(spark, known)
    if not (lacking := texts.filter(~F.coalesce(anchored(F.col("text"), anchors), F.lit(False))).select("license").limit(1)).isEmpty():
        raise ValueError(f"a known text of {lacking.first()[0]} has none of the anchors {anchors}: name others, or '' for all documents")
    digest = F.sha2(joined(F.flatten(F.transform(F.split("text", PARAGRAPH), lambda p: canonical_lines(p)))), 256)
    return texts.select("license", digest.alias("digest")).distinct()


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: Known = KNOWN, anchors: tuple[str, ...] = ANCHORS
) -> DataFrame:
    """doc_id, license, unit ('document', 'paragraph' or 'line'), n: how many such units of a document match.

    Paragraphs of one line and documents of one paragraph count as the smaller unit only. Null,
    empty and unlicensed texts give no rows; rows that repeat an id add up; null ids are one group;
    other columns are not looked at; texts of any length are looked at whole. known: pairs, or a table
    with license and text. Each known text must hold one of anchors in lower case (ValueError if not);
    documents without any are not canonicalised. The digests are counted and broadcast if they are few.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = docs.filter(anchored(text, anchors)).select(
        F.col(id_col).alias("doc_id"), F.transform(F.split(text, PARAGRAPH), lambda p: canonical_lines(p)).alias("paragraphs")
    )
    worded = lambda p: F.filter(p, lambda x: x != "")
    paragraphs = F.filter(F.transform("paragraphs", worded), lambda p: F.size(p) > 0)
    units = lines.select("doc_id", paragraphs.alias("p")).select(
        "doc_id",
        F.concat(
            F.transform(F.flatten("p"), lambda x: F.struct(F.lit("line").alias("unit"), F.sha2(x, 256).alias("digest"))),
            F.transform(
                F.filter("p", lambda x: F.size(x) > 1),
                lambda x: F.struct(F.lit("paragraph").alias("unit"), F.sha2(F.array_join(x, " "), 256).alias("digest")),
            ),
            F.transform(
                F.filter(F.array("p"), lambda x: F.size(x) > 1),
                lambda x: F.struct(F.lit("document").alias("unit"), F.sha2(F.array_join(F.flatten(x), " "), 256).alias("digest")),
            ),
        ).alias("units"),
    )
    digests = known_digests(docs.sparkSession, known, anchors)
    if not isinstance(known, DataFrame) or digests.count() <= SENT_DIGESTS:
        digests = F.broadcast(digests)
    return (
        units.select("doc_id", F.inline("units"))
        .join(digests, "digest")
        .groupBy("doc_id", "license", "unit")
        .agg(F.count("*").alias("n"))
    )
