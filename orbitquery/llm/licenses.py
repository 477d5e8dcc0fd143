"""Licence scans by canonical digest, in DataFrame functions only.

A text is brought to a canonical form (case, copyright lines, punctuation and
white space, equivalent spellings of whole words), its SHA-256 is taken, and whole
texts are hash-joined to the digests of known licences.  Single lines that are a
known notice in full are looked up the same way.  The table of known texts is part
of this module, so its size is fixed; long texts are held by their digests alone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text

# Lines that only name the holders, after case folding.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\s*(?:\(c\)|©|[0-9]{4})|\(c\)\s*[0-9]{4}|©|all rights reserved)[^\n]*"
NOISE = r"[^\p{L}\p{N}]+"
# Equivalent spellings, applied to canonical words in this order.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("licencee", "licensee"), ("licencees", "licensees"), ("licencor", "licensor"), ("licencors", "licensors"),
    ("sublicence", "sublicense"), ("sublicences", "sublicenses"), ("sublicenced", "sublicensed"), ("sublicencing", "sublicensing"), ("sub license", "sublicense"), ("sub licenses", "sublicenses"), ("sub licensed", "sublicensed"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("organisation", "organization"), ("authorisation", "authorization"), ("favour", "favor"),
    ("wilful", "willful"), ("acknowledgement", "acknowledgment"), ("fulfilment", "fulfillment"), ("per cent", "percent"), ("whilst", "while"), ("http", "https"),
]
#: Only lines with one of these words can be a notice.
NOTICE_WORDS = "licen[cs]e|permission|public domain|copyleft"

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_VERBATIM = """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."""
_MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."

# Known whole texts and one-line notices.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_END}"),
    ("BSD-2-Clause", "\n\n".join([_BSD_HEAD, _BSD_1, _BSD_2, _BSD_END])),
    ("BSD-2-Clause", "\n\n".join(["BSD 2-Clause License", _BSD_HEAD, _BSD_1, _BSD_2, _BSD_END])),
    ("BSD-3-Clause", "\n\n".join([_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_END])),
    ("BSD-3-Clause", "\n\n".join(["BSD 3-Clause License", _BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_END])),
    ("Zlib", _ZLIB),
    ("Apache-2.0-header", _APACHE_HEADER),
    ("MPL-2.0-header", _MPL_HEADER),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("WTFPL", _WTFPL),
    ("WTFPL", _VERBATIM),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("BSL-1.0", _BOOST),
]
# SHA-256 of the canonical forms of long licences, from their standard texts.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "4db164cc277b72e3d03f4161513c53b32de1cf3a402162a025e00d038383a74f"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("BSD-4-Clause-UC", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
]


def _spelled(spelling: str) -> str:
    """Words as they stand in a canonical form whose blanks are doubled, each with a blank of its own on both sides."""
    return f" {spelling.replace(' ', '  ')} "


def canonical(text: Column) -> Column:
    """Canonical form of a text column; null stays null.  Spellings change whole words only."""
    done = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    done = F.regexp_replace(done, NOISE, "  ")
    done = F.concat(F.lit(" "), F.trim(done), F.lit(" "))
    for spelling, usual in SPELLINGS:
        done = F.replace(done, F.lit(_spelled(spelling)), F.lit(_spelled(usual)))
    return F.trim(F.replace(done, F.lit("  "), F.lit(" ")))


def canonical_text(text: str) -> str:
    """The same on a single string, for the known table."""
    import regex

    done = regex.sub(COPYRIGHT_LINE, "", text.lower())
    done = f" {regex.sub(NOISE, '  ', done).strip(' ')} "
    for spelling, usual in SPELLINGS:
        done = done.replace(_spelled(spelling), _spelled(usual))
    return done.replace("  ", " ").strip(" ")


def digest(canonical_form: str) -> str:
    return hashlib.sha256(canonical_form.encode()).hexdigest()


def known_digests() -> dict[str, str]:
    """Digest to licence id; the first text of a digest names it."""
    found: dict[str, str] = {}
    for value, name in [*((digest(canonical_text(text)), name) for name, text in KNOWN), *((value, name) for name, value in DIGESTS)]:
        found.setdefault(value, name)
    return found


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(known_digests().items()), "canonical_sha256 string, license_id string")


def scan_licenses(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """doc_id, canonical_sha256, license_id (whole text) and notices (ids of full-line notices, sorted, comma-joined).

    license_id is null for a text that is no known licence, notices is empty without any.
    A null text counts as empty; texts whose canonical form is empty match nothing.  Null
    doc_ids and repeated rows keep a row each, other columns are ignored, and an empty table
    gives no rows.  `more` (license_id, text) adds known whole texts, as many as there are:
    its digests are joined by a shuffle, while the module's own table, of fixed size, is
    broadcast and comes first.
    """
    lookup = F.create_map(*[F.lit(x) for pair in sorted(known_digests().items()) for x in pair])
    rows = doc_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.lower(line).rlike(NOTICE_WORDS))
    lines = F.when(F.lower("text").rlike(NOTICE_WORDS), lines).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"), lines.alias("lines"))
    named = F.transform("lines", lambda line: F.try_element_at(lookup, F.sha2(canonical(line), 256)))
    rows = rows.select("doc_id", "canonical_sha256", F.array_join(F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull()))), ",").alias("notices"))
    rows = rows.join(F.broadcast(known_table(docs.sparkSession)), "canonical_sha256", "left")
    if more is not None:
        form = canonical(F.col("text").cast("string"))
        known = more.where(form != "").groupBy(F.sha2(form, 256).alias("canonical_sha256")).agg(F.min("license_id").alias("other"))
        rows = rows.join(known.hint("merge"), "canonical_sha256", "left").withColumn("license_id", F.coalesce("license_id", "other"))
    return rows.select("doc_id", "canonical_sha256", "license_id", "notices")


def oracle_sql() -> str:
    """DuckDB SQL of scan_licenses over `documents`."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        done = f"regexp_replace(lower({x}), {quoted(COPYRIGHT_LINE)}, '', 'g')"
        done = f"' ' || trim(regexp_replace({done}, {quoted(NOISE)}, '  ', 'g'), ' ') || ' '"
        for spelling, usual in SPELLINGS:
            done = f"replace({done}, {quoted(_spelled(spelling))}, {quoted(_spelled(usual))})"
        return f"trim(replace({done}, '  ', ' '), ' ')"

    known = ", ".join(f"({quoted(d)}, {quoted(n)})" for d, n in sorted(known_digests().items()))
    return f"""
WITH known(canonical_sha256, license_id) AS (VALUES {known}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
whole AS (SELECT doc_id, sha256({canon('text')}) AS canonical_sha256 FROM d),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
notice AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM lines JOIN known ON sha256({canon('line')}) = known.canonical_sha256
  WHERE regexp_matches(lower(line), {quoted(NOTICE_WORDS)}) GROUP BY doc_id)
SELECT whole.doc_id, whole.canonical_sha256, known.license_id, coalesce(notice.notices, '') AS notices
FROM whole LEFT JOIN known USING (canonical_sha256) LEFT JOIN notice ON whole.doc_id = notice.doc_id
"""
