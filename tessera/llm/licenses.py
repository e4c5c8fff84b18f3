"""Licence scans by digest: bring a text to one canonical form, hash it, look the hash up.

Canonical form: lower case; lines that state a copyright, by its year or sign,
and the words that all rights are reserved go; equivalent spellings become one;
every other sign than a letter or digit becomes a blank; blanks are merged, so
that line breaks make no difference. The sha256 of that form meets the digests
of known licences in a hash join (broadcast: the registry is a constant of this
module, and registry_frame() refuses more than MAX_REGISTRY entries). Whole
texts are looked up, and each line by itself in the same join, so that a notice
inside a document is found as well.

Nulls: a null text is empty and matches nothing. Repeated rows give equal
rows, one for each. Very long texts are digested where they lie. An empty table
gives an empty result. Ties: a text is one digest, a digest one licence; several
notices in a text are listed in sorted order. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import textwrap
from collections.abc import Iterator
from functools import cache
from importlib import resources
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm._common import pick, text_or_empty

MAX_REGISTRY = 10_000
#: Spelling, the one it becomes. Applied in this order, to canonical words; a hyphen is a blank there, so that words may be broken at it.
SPELLINGS = (
    ("licence", "license"), ("organisation", "organization"), ("authoris", "authoriz"), ("merchantibility", "merchantability"),
    ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("https ", "http "),
)
_BLANK = r"[\t\x0B\f\r ]*"
_STATES = rf"(?:copyright{_BLANK}(?:\(c\)|©|[\[<{{(]?(?:[0-9]{{4}}|year|yyyy))|(?:\(c\)|©){_BLANK}[\[<{{(]?(?:[0-9]{{4}}|year|yyyy))"
#: A line that states a copyright, with its year or sign (prose that begins with the word stays), and the reservation of rights wherever it stands.
COPYRIGHT_LINE = rf"(?m)^{_BLANK}{_STATES}[^\n]*$|all[\t\x0B\f\r\n ]+rights[\t\x0B\f\r\n ]+reserved"
NOT_WORD = r"[^\p{L}\p{N}]+"

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_NUMBERS = (("1. ", "2. ", "3. "), ("* ", "* ", "* "), ("a. ", "b. ", "c. "))
_ISC = """PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: (licence, family, kind, text); kind: text for whole licences, notice for a line that names one.
_FIRST = (
    ("MIT", "permissive", "text", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS),
    ("BSD-2-Clause", "permissive", "text", "BSD 2-Clause License\n\n" + _BSD_1 + "\n\n" + _BSD_END),
    ("BSD-3-Clause", "permissive", "text", "BSD 3-Clause License\n\n" + _BSD_1 + " " + _BSD_3 + "\n\n" + _BSD_END),
    ("ISC", "permissive", "text", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS " + _ISC),
    ("0BSD", "permissive", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS " + _ISC),
    ("Zlib", "permissive", "text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("WTFPL", "permissive", "text", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0", "permissive", "text", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Unlicense", "public domain", "text", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("MIT", "permissive", "notice", "Released under the MIT License."),
    ("MIT", "permissive", "notice", "Licensed under the MIT License."),
    ("MIT", "permissive", "notice", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "permissive", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "permissive", "notice", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "copyleft", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", "notice", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "copyleft", "notice", "Licensed under the GNU General Public License v3.0."),
    ("CC-BY-4.0", "permissive", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "non-commercial", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "public domain", "notice", "Released under CC0 1.0."),
)


#: Licence, its family, names in prose, SPDX identifiers. Whole texts that are too long for this module lie in TEXTS.
NAMES = (
    ("MIT", "permissive", ("MIT License", "MIT"), ("MIT",)),
    ("BSD-2-Clause", "permissive", ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"), ("BSD-2-Clause",)),
    ("BSD-3-Clause", "permissive", ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"), ("BSD-3-Clause",)),
    ("ISC", "permissive", ("ISC License",), ("ISC",)),
    ("0BSD", "permissive", ("BSD Zero Clause License", "Zero-Clause BSD License"), ("0BSD",)),
    ("Zlib", "permissive", ("zlib License",), ("Zlib",)),
    ("WTFPL", "permissive", ("WTFPL",), ("WTFPL",)),
    ("Apache-2.0", "permissive", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"), ("Apache-2.0",)),
    ("Unlicense", "public domain", ("Unlicense",), ("Unlicense",)),
    ("GPL-1.0", "copyleft", ("GNU General Public License, version 1", "GNU General Public License v1.0"), ("GPL-1.0", "GPL-1.0-only", "GPL-1.0-or-later", "GPL-1.0+")),
    ("GPL-2.0", "copyleft", ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL-2.0"), ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+")),
    ("GPL-3.0", "copyleft", ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0"), ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+")),
    ("LGPL-2.0", "copyleft", ("GNU Library General Public License, version 2", "GNU Library General Public License v2.0"), ("LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.0+")),
    ("LGPL-2.1", "copyleft", ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL-2.1"), ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1+")),
    ("LGPL-3.0", "copyleft", ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL-3.0"), ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0+")),
    ("AGPL-3.0", "copyleft", ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL-3.0"), ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0+")),
    ("MPL-1.1", "copyleft", ("Mozilla Public License, version 1.1", "Mozilla Public License 1.1", "MPL 1.1"), ("MPL-1.1",)),
    ("MPL-2.0", "copyleft", ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"), ("MPL-2.0", "MPL-2.0-no-copyleft-exception")),
    ("EPL-1.0", "copyleft", ("Eclipse Public License, version 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL 1.0"), ("EPL-1.0",)),
    ("EPL-2.0", "copyleft", ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0"), ("EPL-2.0",)),
    ("CC-BY-4.0", "permissive", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"), ("CC-BY-4.0",)),
    ("CC-BY-SA-4.0", "copyleft", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), ("CC-BY-SA-4.0",)),
    ("CC-BY-NC-4.0", "non-commercial", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), ("CC-BY-NC-4.0",)),
    ("CC0-1.0", "public domain", ("CC0 1.0", "CC0 1.0 Universal"), ("CC0-1.0",)),
)
#: Headings of short licences; each may also have none.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "FreeBSD License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD License", "The BSD License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "BSD 0-Clause License", "0BSD"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense", "The Unlicense (Unlicense)"),
}
TEXTS = (
    "AGPL-3.0", "Apache-2.0", "Apache-2.0_spdx", "CC-BY-SA-4.0", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-2.0_spdx", "GPL-3.0", "GPL-3.0_spdx",
    "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0",
)
#: Line lengths at which texts may be broken. Only paragraphs that state a copyright have other forms then.
WIDTHS = range(60, 101)


def _wrapped(text: str) -> Iterator[str]:
    """The text as it is, with each paragraph on one line, and broken at all WIDTHS; copyright lines stay lines, or are broken too."""
    yield text
    alone = re.sub(rf"(?mi)^({_BLANK}{_STATES}[^\n]*)$", r"\n\1\n", text)
    for x, merged in ((alone, True), (text, True), (text, False)):
        paragraphs = [" ".join(p.split()) if merged else p for p in re.split(r"\n[^\S\n]*\n", x) if p.strip()]
        yield "\n\n".join(paragraphs)
        forms = {p: [textwrap.fill(p, w, break_long_words=False, break_on_hyphens=False) for w in WIDTHS] for p in paragraphs if re.search(rf"(?i){_STATES}", p)}
        for i in range(len(WIDTHS) if forms else 0):
            yield "\n\n".join(forms[p][i] if p in forms else p for p in paragraphs)


def _bodies(name: str, text: str) -> Iterator[str]:
    """A short licence's text without its heading, in its usual wordings."""
    if name.startswith("BSD"):
        middle, parts = ("holder", "owner", "holders"), _BSD_1
        for numbers, holder in product(_NUMBERS, ("COPYRIGHT HOLDER", "COPYRIGHT OWNER", "COPYRIGHT HOLDERS", "AUTHORS", "AUTHOR")):
            first = parts.replace(" 1. ", f"\n\n{numbers[0]}").replace(" 2. ", f"\n\n{numbers[1]}")
            end = _BSD_END.replace("COPYRIGHT HOLDER OR", f"{holder} OR")
            if name == "BSD-2-Clause":
                yield f"{first}\n\n{end}"
            else:
                for x in (*(f"copyright {m}" for m in middle), "author", "University"):
                    yield f"{first}\n\n{_BSD_3.replace('3. ', numbers[2]).replace('copyright holder', x)}\n\n{end}"
        return
    head, _, rest = text.partition("\n\n")
    body = rest if head in TITLES.get(name, ()) else text
    yield body
    if name == "MIT":
        yield body.replace("this permission notice shall", "this permission notice (including the next paragraph) shall")
    if name in ("ISC", "0BSD"):
        yield body.replace("and/or distribute", "and distribute")
    if name == "Unlicense":
        yield body.rpartition("\n\n")[0]
        yield body.replace("https://unlicense.org/", "https://unlicense.org")
    if name == "Zlib":
        yield re.sub(r"(?m)^\d\. ", "* ", body)


def _long(text: str) -> Iterator[str]:
    """A long licence's text with its heading and without, with what follows its terms and without, with earlier addresses."""
    whole = [text, re.split(r"(?i)(?<=end of terms and conditions)", text)[0]]
    for x in whole:
        yield x
        yield re.sub(r"\A\s*(?:[^\n]*\S[^\n]*\n)+\s*", "", x, count=1)
        for old in ("59 Temple Place, Suite 330, Boston, MA  02111-1307  USA", "59 Temple Place - Suite 330, Boston, MA  02111-1307  USA", "675 Mass Ave, Cambridge, MA 02139, USA"):
            if (moved := re.sub(r"51 Franklin St(?:reet)?,\s+Fifth\s+Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA", old, x)) != x:
                yield moved


def _known() -> Iterator[tuple[str, str, str, str]]:
    """Every form of every known text and notice; the first ones are those of _FIRST."""
    yield from _FIRST
    for name, family, kind, text in _FIRST:
        if kind == "text" and name != "Apache-2.0":
            bodies = {canonical_text(x): x for body in _bodies(name, text) for x in _wrapped(body)}
            for body, title in product(bodies.values(), ("", *TITLES.get(name, ()))):
                yield name, family, kind, f"{title}\n\n{body}" if title else body
    families = {name: family for name, family, *_ in NAMES}
    for file in TEXTS:
        name = file.removesuffix("_spdx")
        text = resources.files("tessera.llm").joinpath("license_texts", f"{file}.txt").read_text("utf-8")
        for form in _long(text):
            yield from ((name, families[name], "text", x) for x in _wrapped(form))
    for name, family, prose, spdx in NAMES:
        for x in spdx:
            yield name, family, "notice", f"SPDX-License-Identifier: {x}"
        for x, the, how in product(prose, ("", "the "), ("", "This work is ", "This project is ", "This software is ", "This file is ")):
            for verb in ("Licensed", "Released"):
                yield name, family, "notice", f"{how}{verb} under {the}{x}."
                if name.split("-")[0] in ("GPL", "LGPL", "AGPL"):
                    yield name, family, "notice", f"{how}{verb} under {the}{x} or later."
                    yield name, family, "notice", f"{how}{verb} under {the}{x} or any later version."


def canonical(text: Column) -> Column:
    out = F.replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " "), F.lit("&"), F.lit(" and "))
    out = F.regexp_replace(out, NOT_WORD, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def canonical_text(text: str) -> str:
    """The same form of one string, for the registry on the driver."""
    out = re.sub(r"[\W_]+", " ", re.sub(COPYRIGHT_LINE, " ", text.lower()).replace("&", " and "))
    for old, new in SPELLINGS:
        out = out.replace(old, new)
    return out.strip()


def _first_of_each(known) -> dict[str, tuple[str, str, str, str]]:
    """By canonical form; paragraphs, which most forms share, are brought to theirs once."""
    part = cache(canonical_text)
    found: dict[str, tuple[str, str, str, str]] = {}
    for row in known:
        found.setdefault(" ".join(filter(None, map(part, re.split(r"\n\n", row[3])))), tuple(row))
    return found


_FORMS = _first_of_each(_known())
#: (licence, family, kind, text), one for each canonical form.
KNOWN = tuple(_FORMS.values())


def _forms(known) -> dict[str, tuple[str, str, str, str]]:
    return _FORMS if known is KNOWN else _first_of_each(known)


def registry(known=KNOWN) -> list[tuple[str, str, str, str]]:
    """(digest, licence, family, kind), one for each canonical text."""
    return sorted((hashlib.sha256(form.encode()).hexdigest(), *row[:3]) for form, row in _forms(known).items())


def registry_frame(spark: SparkSession, known=KNOWN) -> DataFrame:
    rows = registry(known)
    if len(rows) > MAX_REGISTRY:
        raise ValueError(f"the registry may hold {MAX_REGISTRY} licences, not {len(rows)}")
    return spark.createDataFrame(rows, "digest string, license string, family string, kind string")


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """(doc_id, text_digest, text_license, licenses, families, n_notices), one row for each document.

    text_license: the licence that the entire text is, or null. licenses and
    families: those of the text or of any line of it, sorted and joined by
    commas (empty: none). n_notices: lines that match.
    """
    # lines whose digest can match: a line's canonical form is as long as a known one
    lengths = sorted({len(form) for form in _forms(known)} - {0})
    d = pick(docs, doc_id="doc_id", text="text").withColumn("text", text_or_empty(F.col("text")))
    canon = F.transform(F.split("text", "\n"), canonical)
    found = F.transform(F.filter(canon, lambda c: F.length(c).isin(lengths)), lambda c: F.sha2(c, 256))
    d = d.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("text_digest"), found.alias("found"))
    # the whole text's digest and those of its lines meet the registry in one hash join
    d = d.select("doc_id", "text_digest", F.md5(F.array_join("found", "").cast("binary")).alias("lines"), F.posexplode(F.concat(F.array("text_digest"), "found")).alias("at", "digest"))
    d = d.join(F.broadcast(registry_frame(docs.sparkSession, known)), "digest", "left")
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    # rows that are equal in id and digests are counted, and become as many again
    rows = d.groupBy("doc_id", "text_digest", "lines").agg(
        F.sum((F.col("at") == 0).cast("long")).alias("copies"), F.max(F.when(F.col("at") == 0, F.col("license"))).alias("text_license"),
        listed("license").alias("licenses"), listed("family").alias("families"), F.sum(((F.col("at") > 0) & F.col("license").isNotNull()).cast("long")).alias("hits"),
    )
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("doc_id", "text_digest", "text_license", "licenses", "families", F.expr("hits div copies").alias("n_notices"))


def oracle_sql(known=KNOWN) -> str:
    """The same rows in DuckDB's SQL."""

    def canon(x: str) -> str:
        out = f"regexp_replace(replace(regexp_replace(lower({x}), '{COPYRIGHT_LINE}', ' ', 'g'), '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
        for old, new in SPELLINGS:
            out = f"replace({out}, '{old}', '{new}')"
        return f"trim({out})"

    values = ", ".join(str(r) for r in registry(known))
    return f"""
WITH known(digest, license, family, kind) AS (VALUES {values}),
 d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 lines AS (SELECT doc_id, sha256({canon("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
 hits AS (SELECT doc_id, digest FROM lines SEMI JOIN known USING (digest)),
 whole AS (SELECT doc_id, sha256({canon("text")}) AS digest FROM d),
 every AS (SELECT doc_id, digest FROM hits UNION SELECT doc_id, digest FROM whole SEMI JOIN known USING (digest)),
 named AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM every JOIN known USING (digest) GROUP BY doc_id),
 n AS (SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id)
SELECT whole.doc_id, whole.digest AS text_digest, known.license AS text_license, coalesce(licenses, '') AS licenses, coalesce(families, '') AS families, coalesce(n, 0) AS n_notices
FROM whole LEFT JOIN known USING (digest) LEFT JOIN named ON named.doc_id = whole.doc_id LEFT JOIN n ON n.doc_id = whole.doc_id"""
