"""License scans: canonical digests of whole texts and of lines, looked up among those of known licenses, in column expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import fresh, matched, sha_hex, text_identity, values_table, written

# Spellings that count as equal (British or older form, then the form it is mapped to).
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense",
    "organisation": "organization", "organisations": "organizations", "authorised": "authorized", "authorisation": "authorization",
    "favour": "favor", "honour": "honor", "acknowledgement": "acknowledgment", "artefact": "artifact", "colour": "color",
    "modelling": "modeling", "labelled": "labeled", "whilst": "while", "noncommercial": "non commercial", "ver": "version", "https": "http",
}

# Texts of public licenses, by SPDX id.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
}

# More texts of public licenses that share their parts.
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = TEXTS["BSD-2-Clause"].rpartition("\n\n")[2]
_MIT_HEAD, _, _MIT_END = TEXTS["MIT"].split("\n\n")
_GNU = """This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the {license} as published by the Free Software Foundation{version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {license} for more details.

You should have received a copy of the {license} along with this {what}{end}"""
_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
_SEE = ". If not, see <https://www.gnu.org/licenses/>."
TEXTS |= {
    "BSD-1-Clause": "\n\n".join([_BSD_HEAD, _BSD_SOURCE, _BSD_END]),
    "BSD-3-Clause": "\n\n".join([_BSD_HEAD, _BSD_SOURCE, _BSD_BINARY, _BSD_NAMES, _BSD_END]),
    "MIT-0": _MIT_HEAD.replace(", subject to the following conditions:", ".") + "\n\n" + _MIT_END,
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Copyright (C) 2004 Sam Hocevar <sam@hocevar.net>

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "FSFAP": "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.",
    "PostgreSQL": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.

IN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.

THE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND THE UNIVERSITY OF CALIFORNIA HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS.""",
    "Fair": """Usage of the works is permitted provided that this instrument is retained with the works, so that any entity that uses the works is notified of this instrument.

DISCLAIMER: THE WORKS ARE WITHOUT WARRANTY.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0-or-later": _GNU.format(what="program", sep=";", license=_GPL, version="; either version 2", end="; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    "GPL-3.0-or-later": _GNU.format(what="program", sep=":", license=_GPL, version=", either version 3", end=_SEE),
    "LGPL-2.1-or-later": _GNU.format(what="library", sep=";", license=_LGPL, version="; either version 2.1", end="; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"),
    "AGPL-3.0-or-later": _GNU.format(what="program", sep=":", license=_AGPL, version=", either version 3", end=_SEE),
}

# One-line notices that name a license.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]

# Titles that files of these licenses begin with; a text under its title has a digest of its own.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"],
    "Zlib": ["zlib License", "The zlib/libpng License"],
    "BSL-1.0": ["Boost Software License", "Boost Software License - Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "The 2-Clause BSD License"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "The 3-Clause BSD License"],
    "MIT-0": ["MIT No Attribution"],
}

#: Lines of a license, not of its holder, may begin with "copyright" where a text is wrapped: it is followed by one of these words, and the line has no year, (c) or ©.
COPYRIGHT_PROSE = "notices?|holders?|owners?|laws?|interests?|licen[sc]es?|licensors?|statements?|disclaimers?|protections?|rights?|and|or|in|is|to"
COPYRIGHT_LINE = rf"(?md)^[^\p{{L}}\p{{N}}\n]*(?:copyright\b(?![^\p{{L}}\p{{N}}\n]*(?:{COPYRIGHT_PROSE})\b(?![^\n]*(?:\b(?:19|20)\d\d\b|\(c\)|©)))|\(c\)|©|all rights reserved)[^\n]*$"


def canonical_lines(text: Column) -> Column:
    """Lower case, copyright lines (of a year or a holder) emptied, each run of other characters than letters, digits and \\n one space. Spellings are left."""
    plain = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    return F.regexp_replace(plain, r"[^\p{L}\p{N}\n]+", " ")


def one_spelling(canonical: Column) -> Column:
    """Equivalent spellings mapped to one; a canonical text is words with single spaces."""
    words = F.transform(F.split(canonical, " "), lambda w: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv]), w), w))
    return F.when(canonical.rlike(r"\b(?:" + "|".join(SPELLINGS) + r")\b"), F.array_join(words, " ")).otherwise(canonical)


def squeezed(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def canonical(text: Column) -> Column:
    return one_spelling(squeezed(canonical_lines(text)))


def titled() -> list[tuple[str, str]]:
    """(license, text under a title of it)."""
    return [(name, f"{title}\n\n{TEXTS[name]}") for name, titles in TITLES.items() for title in titles]


def first_words(notices: DataFrame) -> list[str]:
    """The words that a line may begin with, in any spelling, if it is one of the notices (license, text)."""
    rows = notices.select(F.substring_index(canonical(F.col("text")), " ", 1).alias("w")).distinct()
    first = {r["w"] for r in rows.collect()}  # as many as notices in the program
    return sorted(first | {old for old, new in SPELLINGS.items() if new.split(" ")[0] in first})


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license) of (license, text); of texts with one digest, the first license by name."""
    return known.select(sha_hex(canonical(F.col("text"))).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def named_licenses(df: DataFrame, text: str, notices: Sequence[tuple[str, str]]) -> DataFrame:
    """(t, u, named, n) of each different text that holds lines which are notices: a hash join of the digests of its short lines; a written table."""
    listed = values_table(df.sparkSession, notices, "license string, text string")
    longest, words = max(len(x) for _, x in notices), first_words(listed)
    c = F.col(f"`{text}`")
    # A line that becomes a notice by spelling alone is at most twice as long. Texts without a line that begins like a notice are passed over.
    begins = "(?m)^[^\\p{L}\\p{N}\\n]*(?:" + "|".join(words) + ")(?![\\p{L}\\p{N}])"
    lines = F.transform(F.split(canonical_lines(c), "\n"), lambda x: F.trim(x))
    short = F.filter(lines, lambda x: (F.length(x) <= 2 * longest) & F.substring_index(x, " ", 1).isin(words))
    own = df.where(F.lower(c).rlike(begins)).select(*[k.alias(n) for k, n in zip(text_identity(c), "tu")], F.explode(short).alias("line"))
    found = own.select("t", "u", sha_hex(one_spelling(F.col("line"))).alias("digest")).join(F.broadcast(known_digests(listed)), "digest")
    return written(found.groupBy("t", "u").agg(F.array_sort(F.collect_set("license")).alias("named"), F.count(F.lit(1)).alias("n")))[0]


def scan_licenses(df: DataFrame, text: str = "text", texts: Sequence[tuple[str, str]] | None = None, notices: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """The rows of df with license, notices and digest.

    license: the known license whose canonical text the whole text is, however long, else null (an exact hash join on the digest; where two known licenses
    share a digest, the first by name). notices: sorted different licenses named by lines that are a known notice (a hash join on the digests of lines, once
    for each different text). digest: of the canonical text. Null text: all null but an empty notices. An empty text has the digest of the empty text, which
    is no license. Repeated rows stay, with the same result. Empty input: no rows. Columns of these names are replaced.
    `texts` and `notices` are lists in the program; their digests are what is broadcast.
    """
    spark = df.sparkSession
    texts = list(TEXTS.items()) + NOTICES + titled() if texts is None else list(texts)
    notices = NOTICES if notices is None else list(notices)
    base = df.drop(*[c for c in df.columns if c.lower() in ("license", "notices", "digest")])
    t, u, digest, known_d, known_l, t2, u2, named = fresh(base, "t", "u", "canonical_digest", "known_digest", "known_license", "t_of", "u_of", "named")
    c = F.col(f"`{text}`")
    step = base.select("*", sha_hex(canonical(c)).alias(digest), *[k.alias(n) for k, n in zip(text_identity(c), (t, u))])
    if notices:
        lines = named_licenses(base.select(c), text, notices).toDF(t2, u2, named, "n of lines")
        step = matched(step, lines, [(t, t2), (u, u2)], "n of lines", F.size(named) * 40 + 40)
    else:
        step = step.withColumn(named, F.lit(None).cast("array<string>"))
    known = known_digests(values_table(spark, texts, "license string, text string")).toDF(known_d, known_l)
    joined = step.join(F.broadcast(known), F.col(digest) == F.col(known_d), "left")
    return joined.select(*[F.col(f"`{x}`") for x in base.columns], F.col(known_l).alias("license"), F.coalesce(named, F.array().cast("array<string>")).alias("notices"), F.col(digest).alias("digest"))
