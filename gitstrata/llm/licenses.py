"""Licence scans: canonical digest lookup.

A text is normalised: A-Z to a-z, punctuation and symbols to spaces, words of equivalent spelling to one
of them, copyright lines out, white space to single spaces. Its SHA-256 digest is hash-joined with the
digests of known licence texts, normalised alike. What is looked up is the entire text of each document,
and the entire text of each of its lines, as notices stand inside other text. Short licences are known by
their texts, long ones by their digests alone.

Lines are looked up in the task that reads them; only one small row for each document and the lines that
are notices are shuffled. The known digests are broadcast if there are at most SMALL_ROWS of them.

Nulls and edges: null or empty texts, and those with nothing but copyright lines, have no digest and match
nothing; of known texts with equal digests the smallest licence id counts; known rows without an id or
without words are ignored; rows that repeat a doc_id and text give a row each; null ids are kept; texts of
any length are normalised whole; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gitstrata.llm import text as T

SMALL_ROWS = 200_000

#: What counts as punctuation or symbol besides white space.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + " «®·»–—‘’“”•…™"
#: Equivalent spellings of one word, and of words that punctuation may part.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorise": "authorize", "authorised": "authorized", "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "emphasised": "emphasized",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize", "modelled": "modeled",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organisations": "organizations", "organise": "organize", "organised": "organized", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "recognised": "recognized", "sublicence": "sublicense", "utilisation": "utilization", "utilise": "utilize", "utilised": "utilized", "whilst": "while", "wilful": "willful",
}
PARTED = {" sub license": " sublicense", " non commercial": " noncommercial", " non infringement": " noninfringement", " per cent": " percent", " copyright owner": " copyright holder"}
#: A normalised line is a copyright line if it matches the first of these and not the second, which are lines of running text.
COPYRIGHT = r"^(portions )?(copyright( .*)?|c ?[0-9][0-9][0-9][0-9]( .*)?|all rights reserved)$"
RUNNING = r"^copyright (notices?|holders?|owners?|laws?|licenses?|statements?|disclaimer|interests?|and|or|in|to|under|is|are|may|shall|treaty|act)( .*)?$"

_FROM, _TO = PUNCTUATION + T.UPPER + "©", " " * len(PUNCTUATION) + T.LOWER + "c"


def canonical_lines(text: Column) -> Column:
    """The normalised lines of a text, in order, without empty and copyright lines."""
    spelling = F.create_map(*(F.lit(x) for pair in SPELLINGS.items() for x in pair))
    same = lambda w: F.coalesce(F.try_element_at(spelling, w), w)
    one = lambda line: F.array_join(F.transform(T.words(line), same), " ")
    every = F.transform(F.split(F.translate(T.whole(text), _FROM, _TO), "\n"), one)
    return F.filter(every, lambda x: (x != "") & ~(x.rlike(COPYRIGHT) & ~x.rlike(RUNNING)))


def joined(line: Column) -> Column:
    """Puts words together that punctuation had parted."""
    out = F.concat(F.lit(" "), line)
    for parted, one in PARTED.items():
        out = F.replace(out, F.lit(parted), F.lit(one))
    return F.ltrim(out)


def digest(canonical: Column) -> Column:
    return F.when(canonical != "", F.sha2(canonical, 256))


def known_digests(known: DataFrame) -> DataFrame:
    """known: license_id, text, and digest where that is known already. Returns digest, license, each digest once."""
    own = digest(joined(F.array_join(canonical_lines(F.col("text")), " ")))
    given = F.coalesce(F.col("digest"), own) if "digest" in known.columns else own
    out = known.filter("license_id is not null").select(given.alias("digest"), "license_id").filter("digest is not null")
    return out.groupBy("digest").agg(F.min("license_id").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words (long) and digest of its normalised text, license (null if
    the entire text is no known one), n_notices (long) and notices: how many of its lines are known
    texts, and their licences, distinct and in order.
    """
    table = known_digests(known)
    if table.count() <= SMALL_ROWS:
        table = F.broadcast(table)
    entire = F.struct(F.lit(True).alias("entire"), digest(joined(F.array_join("_lines", " "))).alias("digest"), F.lit(1).alias("times"))
    each = F.transform("_lines", lambda x: F.struct(F.lit(False).alias("entire"), digest(joined(x)).alias("digest"), F.lit(1).alias("times")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(T.whole(F.col("text"))).alias("_x"), canonical_lines(F.col("text")).alias("_lines"))
    n_words = F.when(F.col("entire"), F.regexp_count(joined(F.array_join("_lines", " ")), F.lit("[^ ]+")))
    units = rows.select("doc_id", "_x", "_lines", F.explode(F.concat(F.array(entire), each)).alias("u")).select("doc_id", "_x", "_lines", "u.entire", "u.digest")
    met = units.select("doc_id", "_x", "entire", "digest", n_words.alias("n_words")).join(table, "digest", "left").filter("entire or license is not null")
    first = lambda c: F.max(F.when(F.col("entire"), F.col(c)))
    # rows that repeat a doc_id and text meet here: each has the same lines
    out = met.groupBy("doc_id", "_x").agg(
        F.count_if("entire").alias("_rows"), first("n_words").cast("long").alias("n_words"), first("digest").alias("digest"), first("license").alias("license"),
        F.count_if(~F.col("entire")).alias("_found"), F.array_join(F.sort_array(F.collect_set(F.when(~F.col("entire"), F.col("license")))), ",").alias("notices"),
    )
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_rows").cast("int"))))
    return out.select("doc_id", "n_words", "digest", "license", (F.col("_found") / F.col("_rows")).cast("long").alias("n_notices"), "notices")


def known_licenses(spark: SparkSession, rows: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """The texts and digests below and ``rows`` (license_id, text) as a table: license_id, text, digest."""
    table = [*((i, t, None) for i, t in [*KNOWN, *rows]), *((i, None, d) for i, ds in DIGESTS for d in ds)]
    return spark.createDataFrame(table, "license_id string, text string, digest string")


_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MORE = "For more information, please refer to <https://unlicense.org>"

#: Licences by identifier, with the titles that may stand above their texts.
_TEXTS = [
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), _MIT),
    ("ISC", ("ISC License", "The ISC License"), f"{_ISC}\n{_ISC_WARRANTY}"),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD"), f"{_ZERO}\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The 2-Clause BSD License"), f"{_BSD}\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The 3-Clause BSD License"), f"{_BSD}\n{_BSD_NAME}\n{_BSD_WARRANTY}"),
    ("Zlib", ("zlib License", "The zlib License"), _ZLIB),
    ("Unlicense", (), _UNLICENSE), ("Unlicense", (), f"{_UNLICENSE}\n{_MORE}"),
    ("BSL-1.0", ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"), _BOOST),
]
#: Licences by identifier and how notices name them.
_NAMES = [
    ("Apache-2.0", "the Apache License, Version 2.0"), ("Apache-2.0", "the Apache License 2.0"), ("MIT", "the MIT License"), ("ISC", "the ISC License"),
    ("GPL-2.0", "the GNU General Public License, version 2"), ("GPL-3.0", "the GNU General Public License, version 3"), ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"), ("MPL-2.0", "the Mozilla Public License, version 2.0"), ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"), ("BSL-1.0", "the Boost Software License, Version 1.0"), ("EPL-2.0", "the Eclipse Public License, version 2.0"), ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
]
#: The forms of a notice.
_NOTICES = ("Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This software is licensed under {}", "This project is licensed under {}")

#: Standard header lines by identifier.
_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    *((f"{i}-or-later", _GNU.format(what=what, name=name, version=version)) for i, name, version in (
        ("GPL-2.0", "General Public License", 2), ("GPL-3.0", "General Public License", 3), ("LGPL-2.1", "Lesser General Public License", 2.1), ("LGPL-3.0", "Lesser General Public License", 3), ("AGPL-3.0", "Affero General Public License", 3),
    ) for what in ("program", "library", "file")),
]
#: Identifiers that an SPDX line may name besides those above.
_SPDX = (
    *(f"{i}{end}" for i in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.3") for end in ("-only", "-or-later", "", "+")),
    "MPL-1.1", "EPL-1.0", "Artistic-2.0", "PostgreSQL", "Python-2.0", "PSF-2.0", "OFL-1.1", "WTFPL", "MIT-0", "NCSA", "Apache-2.0 OR MIT", "MIT OR Apache-2.0", "BSD-4-Clause", "CDDL-1.0", "CC-BY-3.0", "CC-BY-SA-3.0",
)
#: SHA-256 digests of long licences' normalised texts: entire, and without what follows their terms.
DIGESTS = [
    ("Apache-2.0", ("04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40",)),
    ("Artistic-1.0-Perl", ("08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",)),
    ("CC0-1.0", ("cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",)),
    ("GFDL-1.3", ("93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6",)),
    ("GPL-1.0", ("9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",)),
    ("GPL-2.0", ("efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",)),
    ("GPL-3.0", ("5a03c45024821019e59bbbf8d5bd13f8395e4e13204f3e1cf7fb58b2422ec219", "a3befc99a52b31d6651d10d3a5453a64872b0c7adfec0f91a471a9df284d545d", "ad4a8c0f86b40eeaec03087f95684ff7965ffea480d1a58d4d7d9cb5ea929725",)),
    ("LGPL-2.0", ("289c8b47fa0ec7e5f22cd33d32feaa06f015b0f2fdb9ad916979b1011ca8c015", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",)),
    ("LGPL-2.1", ("5ddd6039d3b090c51328879800301dd19b1ad99e14d00f3c6f221ab45a32db57", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",)),
    ("LGPL-3.0", ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",)),
    ("MPL-1.1", ("26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986",)),
    ("MPL-2.0", ("6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",)),
]

KNOWN = [
    *((i, text) for i, _, text in _TEXTS),
    *((i, f"{title}\n{text}") for i, titles, text in _TEXTS for title in titles),
    *((i, notice.format(name)) for i, name in _NAMES for notice in _NOTICES),
    *_HEADERS,
    *((i, f"SPDX-License-Identifier: {i}") for i in sorted({i for i, *_ in (*_TEXTS, *_NAMES)} | set(_SPDX))),
]
