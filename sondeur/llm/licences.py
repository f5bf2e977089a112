"""Licence scans by canonical digest lookup.

A text is made canonical (lower case; copyright and all-rights-reserved lines dropped; everything but ASCII letters and
digits, and so all punctuation and line breaks, made single blanks; words that begin with one of several equivalent
spellings given the same one) and digested whole.  The digest is joined with those of known licences: those of KNOWN, made
canonical by the same expressions, and of DIGESTS, which were made so once from texts that are too long to stand here.  All of
it is built-in expressions in one narrow pass; the table of known digests is broadcast only if its counted rows are few.

A licence is found in any case, spelling, quoting and wrapping, with anyone's copyright lines.  A copyright line is one that
begins, whatever marks stand before, with "copyright" and (c), ©, by, a year or a placeholder, with (c) and a year or a
placeholder, with ©, or with "all rights reserved"; a clause that begins with "(c)" and words is none.  A licence within
other text isn't found: the digest is of the entire text.

Defined results: every row gives one row.  A null text has a null digest and no licence.  A text of which nothing is
left (empty, marks or copyright lines alone) has the digest of the empty text and no licence.  Letters outside ASCII count
as blanks.  Two known licences of one canonical text count as the first by name.  Repeated rows give repeated rows, a
null doc_id is a value like others, and columns beside doc_id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

#: A line that names a copyright holder or reserves rights, whatever marks stand before it.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|by |[0-9:\[<{])|\(c\)[ \t]*(copyright|[0-9\[<{])|©|all rights reserved)[^\n]*"
#: Beginnings of words that count as the second.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("noncommercial", "non commercial"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sublicence", "sublicense"), ("unauthorised", "unauthorized"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Known texts by name; a name may stand with several texts, told apart by what follows "/".
KNOWN: dict[str, str] = {
    "0BSD": _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", ""),
    "Apache-2.0/notice": _APACHE_NOTICE,
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "ISC": _ISC,
    "ISC/titled": "ISC License\n\n" + _ISC,
    "MIT": _MIT,
    "MIT/titled": "MIT License\n\n" + _MIT,
    "MIT/the": "The MIT License (MIT)\n\n" + _MIT,
    "MIT/line": "Released under the MIT License.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "Unlicense": _UNLICENSE,
    "Zlib": _ZLIB,
    "Zlib/titled": "zlib License\n\n" + _ZLIB,
}


#: Digests of entire canonical texts, as their publishers issue them; "/terms" are without the appendix on how to apply them.
DIGESTS: dict[str, str] = {
    "77e1a2c8e9671a8095fa8108104daeae": "Apache-2.0",
    "2907559bf696d33fdfdc7da57023e979": "Apache-2.0/terms",
    "d44d7dd7bb33c43e91c9d5e48b1d489e": "Apache-2.0/terms-end",
    "01297679267ad921516667ccd889865e": "Artistic-1.0-Perl",
    "93a180096f6cfcf2c0dd24f75c2eec48": "CC0-1.0",
    "5148de011e82ae926023a4cb728325b7": "GFDL-1.2",
    "c6f930ecae83fda4161142774136c3e1": "GFDL-1.3",
    "824bfa08ef115d28b935bb45d075bc18": "GPL-1.0",
    "f9bdbdf2be484ced90e5d8d884a7bed9": "GPL-1.0/terms",
    "78f3b35da3d393ee93ecfeb7d20907e6": "GPL-1.0/terms-end",
    "30b82780876558cb4f80d263305eef51": "GPL-2.0",
    "b73af68d56407814bb0960dcc4125f3d": "GPL-2.0/terms",
    "42f2f51f3e726d001525877e3528c3d0": "GPL-2.0/terms-end",
    "57431c294319c882ff7cf5c688f356c0": "GPL-3.0",
    "c1d263ed7dad8374d032a647e169de1a": "GPL-3.0/terms",
    "03337ecd04584344766a0128066f5674": "GPL-3.0/terms-end",
    "6885b1a1b528de907e6c89bd80a1ea4f": "LGPL-2.0",
    "97832943be1e344d51af5aee1b658e4f": "LGPL-2.0/terms",
    "c396ba2f94537628797123bc12cd2d6e": "LGPL-2.0/terms-end",
    "79aa7998cfa6069eae71d7bea9b32641": "LGPL-2.1",
    "eaf6afb73fc860a002bfbccbe6f07ce7": "LGPL-2.1/terms",
    "3054b3781b1af43f906dc753acad15ee": "LGPL-2.1/terms-end",
    "b31b7335bc37919e8cdd79154e04d88d": "LGPL-3.0",
    "252dfbcf46f9012c7c356a9252f1c30c": "MPL-1.1",
    "b5b7a0cf4994910cd0204fba4637d6ec": "MPL-2.0",
}


def _spelt() -> str:
    """A pattern of any of the spellings at a word's beginning, by first letters, so that most words fail at once."""
    by: dict[str, list[str]] = {}
    for old, _ in SPELLINGS:
        by.setdefault(old[0], []).append(old[1:])
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by.items())) + ")"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    low = F.regexp_replace(F.translate(F.lower(text), "\r", "\n"), COPYRIGHT_LINE, "\n")
    words = F.regexp_replace(F.concat(F.lit(" "), low), "[^a-z0-9]+", " ")
    spelt = words
    for old, new in SPELLINGS:
        spelt = F.replace(spelt, F.lit(" " + old), F.lit(" " + new))
    # texts without any of the spellings are spared the replacements
    return F.trim(F.when(words.rlike(_spelt()), spelt).otherwise(words))


def digest(text: Column) -> Column:
    return F.md5(canonical(text).cast("binary"))


def licence_scan(docs: DataFrame, known: Mapping[str, str] = KNOWN, digests: Mapping[str, str] = DIGESTS) -> DataFrame:
    """(doc_id, digest, licence) of every row: licence is null where the whole text is no known licence."""
    spark = docs.sparkSession
    names = spark.createDataFrame([(name.partition("/")[0], text) for name, text in sorted(known.items())], "licence string, body string")
    made = spark.createDataFrame([(name.partition("/")[0], d) for d, name in digests.items()], "licence string, known string")
    table = names.select("licence", digest(F.col("body")).alias("known")).where(F.col("known") != F.md5(F.lit("").cast("binary"))).unionByName(made).groupBy("known").agg(F.min("licence").alias("licence"))
    own = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    return own.join(small(table, len(known) + len(digests)), own["digest"] == table["known"], "left").select("doc_id", "digest", "licence")


def oracle() -> str:
    """licence_scan over the table documents in DuckDB's SQL."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(text: str) -> str:
        low = f"regexp_replace(translate(lower({text}), chr(13), chr(10)), {quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
        words = f"regexp_replace(' ' || {low}, '[^a-z0-9]+', ' ', 'g')"
        for old, new in SPELLINGS:
            words = f"replace({words}, {quoted(' ' + old)}, {quoted(' ' + new)})"
        return f"md5(trim({words}))"

    rows = ", ".join(f"({quoted(name.partition('/')[0])}, {quoted(text)})" for name, text in sorted(KNOWN.items()))
    made = ", ".join(f"({quoted(d)}, {quoted(name.partition('/')[0])})" for d, name in DIGESTS.items())
    return (
        f"WITH names(licence, body) AS (VALUES {rows}), "
        f"made(digest, licence) AS (VALUES {made}), "
        f"known AS (SELECT digest, min(licence) AS licence FROM (SELECT {form('body')} AS digest, licence FROM names UNION ALL SELECT * FROM made) GROUP BY 1), "
        f"own AS (SELECT doc_id, {form('text')} AS digest FROM documents) "
        "SELECT own.doc_id, own.digest, known.licence FROM own LEFT JOIN known ON own.digest = known.digest"
    )
