"""License scans by canonical digest lookup (DataFrame functions only).

A text's canonical form: A-Z lower-cased, copyright lines dropped, ASCII punctuation and white space folded to single
spaces, equivalent spellings made one. Its SHA-256 is joined by hash to a table of known digests. The whole text of a
document is looked up against whole licences; so is each line against known notices. The table is a parameter, and
broadcast up to MAX_KNOWN rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, text_or_empty

MAX_KNOWN = 10_000

#: Equivalent spellings, as (spelling, common form), on canonical text padded with a space at each end.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("sub licensing", "sublicensing"), ("organisation", "organization"),
    ("authorisation", "authorization"), ("fulfilment", "fulfillment"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("http", "https"),
)

#: Notices of one line, with the identifier of the licence that they grant.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: First lines that may stand above a text.
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT", "This software is released under the MIT license:"),
    "MIT-0": ("MIT No Attribution",),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License"),
    "Zlib": ("zlib License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD License", "The BSD 3-Clause License", "New BSD License"),
}

#: Whole licence texts, without their headings and copyright lines.
TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("MIT-0", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
)

#: SHA-256 of the canonical form of whole licence texts as they are commonly shipped (with and without appendix, by address).
DIGESTS = (
    ("Apache-2.0", "c40235f98e8998f2e4f5fc5131b16fb3c6c5f8ce252d3e6e08daf233725c2073"),
    ("Apache-2.0", "dfb11198400532b4f305d6de1101f4a4c4fb6ca0cf69686b401f9c97e428b15d"),
    ("Apache-2.0", "4a6318c7afd8feed8c4463ea5ae0f2f609d433928a8b17f31104c8e7743de2c5"),
    ("Apache-2.0", "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93"),
    ("Apache-2.0", "4db164cc277b72e3d03f4161513c53b32de1cf3a402162a025e00d038383a74f"),
    ("Apache-2.0", "e48104441e69502923d21a6370f79d0687ac869c266defceb024b36d8f617a4c"),
    ("Apache-2.0", "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809"),
    ("Apache-2.0", "744854b70a8980effae4d3a1180419baa6bb91abc86be96eb83a082fb8d6ec0d"),
    ("Apache-2.0 WITH LLVM-exception", "8b542b6366816a995dda48aacd7df20f2e8b9b6205f9a0dd165bfb3485e1817e"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSL-1.0", "4242941f56cc0aaf7a416006734167273b17a074704308b941e02a99526671b6"),
    ("BlueOak-1.0.0", "6cffa606d4960a0fadb3c8161a99b92c53dbe7b999697a5e26d35cfdc1d80f3d"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "b1c5aa1739d6987e6a07d17aec22866668fd58e96c5bf8b42f8885db04de1a31"),
    ("GPL-2.0", "aa997bc1c3422ccdc7ccabdc6f9aaa9ce2ebeed7be208887d2b13ff901326c75"),
    ("GPL-2.0", "5cb6370ac80145bff27a54858e51a973da8c42e030e5803cfe2c3953ae0150ac"),
    ("GPL-2.0", "42a2063beecb82de51a227e52a22e4acf4fa0d052827262e6bb57835e02e10e9"),
    ("GPL-3.0", "45d55e6a1f1db973422ccbae8d15b1ad6389e7c384bfc422b46f5e230b86ecaf"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "0e3c184176a70698802350b8f697a92e908601a66f8f622e8d4c08c9e90e0a8f"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "45ab1a2a290e74e8c905ed1fbb6a81f1d48fe964330aa7855ba1aa1f88306f09"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
    ("OFL-1.1", "b80f6498cf31cc02c16942b317f9b5b55be820889a29c0a2c97a9e41a7b4eb07"),
    ("Python-2.0", "0468cbd2bc927a382f60165d7cbed65b777137260ad311e0db99e8f0576fa804"),
    ("Python-2.0", "f82d93349f4f0e1d7f2c87bebb3d4cb39cb2450ff5dbe34f2bef30e9ad651257"),
    ("Python-2.0", "9d84609e2faa82d0f559211d4b4b3f75c7686635f230f9b1e136b75247760b12"),
    ("Python-2.0", "0e59092bad8c558766e5ee70e352d2fff12b82132cf77ce17060e87fc44e13aa"),
    ("Unicode-3.0", "53113a39b79251016cf92b8348f303cee44e4faee1f232536754abc669dd32c8"),
    ("WTFPL", "93f655c5808f904f07283ced722478ed4334973080b391360e7c6b64a1d1df9b"),
)

#: Lines that name a year, a mark or a holder to fill in; a sentence that merely wraps at the word stays. The same in Java's, RE2's and Python's dialects.
COPYRIGHT_LINE = r"(^|\n)[\x20\x09]*(copyright[^\n]*([0-9]{4}|\(c\)|©|<|\[|\x20(inc|llc|ltd|gmbh)\b)|copyright by |©|\(c\)[\x20\x09]*[0-9]{4}|all rights reserved)[^\n]*"
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MAYBE = r"(?i)licen[sc]"  # every notice holds it in any spelling: lines without it need no digest


def canonical(c: Column) -> Column:
    out = F.regexp_replace(lower_ascii(c), COPYRIGHT_LINE, "\n")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, PUNCTUATION, " ")), F.lit(" "))
    for spelling, common in SPELLINGS:
        for _ in range(2):  # the second takes what shares its space with the match before it
            out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {common} "))
    return F.trim(out)


def digest(c: Column) -> Column:
    return F.sha2(canonical(c), 256)


def listed(texts=TEXTS, notices=NOTICES) -> list[tuple[str, str, bool]]:
    """(name, text, whole) of every known text; a licence counts with any of its headings and without."""
    headed = [(name, f"{h}\n\n{text}" if h else text, True) for name, text in texts for h in ("", *HEADINGS.get(name, ()))]
    return headed + [(name, text, False) for name, text in notices]


def known(spark: SparkSession, texts=TEXTS, notices=NOTICES, digests=DIGESTS) -> DataFrame:
    """digest, license, whole: the table of known texts, one row a digest (the least name where two share one)."""
    d = spark.createDataFrame(listed(texts, notices), "license string, text string, whole boolean").select(digest(F.col("text")).alias("digest"), "license", "whole")
    d = d.unionByName(spark.createDataFrame([(x, name, True) for name, x in digests], "digest string, license string, whole boolean"))
    return d.groupBy("digest").agg(F.min("license").alias("license"), F.max("whole").alias("whole"))


def scan(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, license (the whole text's, or null), notices (names in order of their lines, comma-joined), n_notices, canonical_sha256.

    table: digest, license, whole (one row a digest). Up to MAX_KNOWN rows are broadcast; a larger table of whole texts
    is joined by shuffle, more notices are an error. A null text counts as empty, which is no licence. One row a row of
    docs; repeated rows repeat; an empty table gives none.
    """
    notices = table.filter("not whole").limit(MAX_KNOWN + 1).collect()
    if len(notices) > MAX_KNOWN:
        raise ValueError(f"at most {MAX_KNOWN} notices are looked up")
    small = len(table.filter("whole").select("whole").limit(MAX_KNOWN + 1).collect()) <= MAX_KNOWN
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(MAYBE))
    d = docs.select("doc_id", text_or_empty().alias("__text")).withColumn("__sha", digest(F.col("__text")))
    d = d.withColumn("__lines", F.transform(lines, digest))
    t = table.filter("whole").select(F.col("digest").alias("__digest"), "license")
    d = d.join(F.broadcast(t) if small else t, F.col("__sha") == F.col("__digest"), "left").drop("__digest")
    # the notices as a constant map from digest to name
    names = "\x01".join(f"{r.digest}\x02{r.license}" for r in notices)
    names = F.str_to_map(F.lit(names), F.lit("\x01"), F.lit("\x02"))
    d = d.withColumn("__found", F.filter(F.transform("__lines", lambda x: names[x]), lambda x: x.isNotNull()))
    return d.select("doc_id", "license", F.array_join("__found", ",").alias("notices"), F.size("__found").cast("long").alias("n_notices"),
                    F.col("__sha").alias("canonical_sha256"))


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known(spark))


def _sql_canonical(x: str) -> str:
    out = f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', chr(10), 'g')"
    out = f"(' ' || trim(regexp_replace({out}, '{PUNCTUATION}', ' ', 'g')) || ' ')"
    for spelling, common in SPELLINGS:
        for _ in range(2):
            out = f"replace({out}, ' {spelling} ', ' {common} ')"
    return f"trim({out})"


def oracle_op9() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, {quote(t)}, {whole})" for n, t, whole in listed())
    digests = ", ".join(str((n, d)) for n, d in DIGESTS)
    return f"""
WITH k AS (SELECT digest, min(name) AS license, bool_or(whole) AS whole FROM (SELECT sha256({_sql_canonical('t')}) AS digest, name, whole FROM (VALUES {rows}) v(name, t, whole) UNION ALL SELECT digest, name, true FROM (VALUES {digests}) v(name, digest)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d WHERE regexp_matches(t, '{MAYBE}')),
f AS (SELECT r, string_agg(k.license, ',' ORDER BY i) AS notices, count(*) AS n FROM (SELECT r, i, sha256({_sql_canonical('line')}) AS digest FROM l WHERE regexp_matches(line, '{MAYBE}')) x JOIN k USING (digest) WHERE NOT k.whole GROUP BY r),
w AS (SELECT r, doc_id, sha256({_sql_canonical('t')}) AS digest FROM d)
SELECT w.doc_id, k.license, coalesce(f.notices, '') AS notices, coalesce(f.n, 0) AS n_notices, w.digest AS canonical_sha256
FROM w LEFT JOIN k ON k.digest = w.digest AND k.whole LEFT JOIN f ON f.r = w.r
"""
