"""Licence scans by canonical digest lookup; DataFrame and SQL functions only.

A text is made canonical line by line: lower case, lines that state a copyright dropped, every run
of other than letters and digits one space, equivalent spellings made one. Its SHA-256 digest is
then looked up, by a hash join, among those of known licences: the whole text as one, and every
single line, so that both a licence file and a licence notice inside a document are known. Lines are
digested only where their canonical length is that of something known, which loses nothing.

The texts are read once; what leaves a task is digests. The known digests are broadcast after their
rows are counted.

Defined cases: a null text counts as empty, and an empty one, or one of copyright lines only, has
the digest of the empty text and no licence; repeated rows each give a row; a known text given
twice, or under two names, counts once, under the lesser name; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_or_not, stored

# Spellings that mean the same, after SPDX's guidelines for matching licences.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analog": "analogue", "analyze": "analyse", "artifact": "artefact", "authorization": "authorisation", "authorized": "authorised",
    "catalog": "catalogue", "center": "centre", "copyright holder": "copyright owner", "favorite": "favourite", "honor": "honour", "https": "http", "initialize": "initialise",
    "judgement": "judgment", "labeled": "labelled", "licence": "license", "licenced": "licensed", "merchantability": "merchantibility", "noncommercial": "non commercial",
    "organization": "organisation", "organizations": "organisations", "per cent": "percent", "program": "programme", "recognized": "recognised", "sublicence": "sublicense",
    "sub license": "sublicense", "utilization": "utilisation", "while": "whilst", "willful": "wilful", "v2": "version 2", "v3": "version 3",
}

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n"
    "For more information, please refer to <https://unlicense.org>"
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

# Licence texts and notices, by SPDX identifier.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _PERMIT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC),
    ("ISC", "ISC License\n" + _PERMIT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC),
    ("0BSD", _PERMIT + ".\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_ONE + _BSD_TWO + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_ONE + _BSD_TWO + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_ONE + _BSD_TWO + _BSD_THREE + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_ONE + _BSD_TWO + _BSD_THREE + _BSD_END),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Zlib", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0")),
    *((name, f"{verb} under {short}.") for verb in ("Licensed", "Released", "This work is licensed", "This project is licensed") for name, short in (
        ("MIT", "the MIT License"), ("ISC", "the ISC License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("Apache-2.0", "the Apache License 2.0"),
        ("GPL-2.0-only", "the GNU General Public License, version 2"), ("GPL-3.0-only", "the GNU General Public License, version 3"), ("LGPL-3.0-only", "the GNU Lesser General Public License, version 3"),
        ("MPL-2.0", "the Mozilla Public License, version 2.0"), ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    )),
]

#: Licence, SHA-256 and length of the canonical form of standard texts too long to stand here, with and without title
#: and appendix, with lines as published or a paragraph each.
DIGESTS: list[tuple[str, str, int]] = [
    ("Apache-2.0", "33a7bf8d21b67259fdd62bca0518375c885f5b237d94afbf8bfff059af3daea0", 8770),
    ("Apache-2.0", "e07ef5b2a73d0ac7132a45cae42d9737aec561bbd4207be4649236ae78a0da23", 8798),
    ("Apache-2.0", "1a5247b7851e16caa0d5711cd481c90f6f5cc382b581a2e6b6e60d06f08e933e", 8839),
    ("Apache-2.0", "dc1904efd9022c4eedea4728d7a8680f8f91e3736f4557c947733705050e7fb8", 8867),
    ("Apache-2.0", "1e414235157d16285bcedeb420d36121e288111ea9df28fba8b41cfebca358c7", 9853),
    ("Apache-2.0", "59fe89b2a31faaef960444dffce98f6b8114dd8679794982877441b13d95721b", 9922),
    ("CC-BY-SA-4.0", "33cc35cea5dbc5de8f9264bca9062347f48f2d7a026325730bcf879df5475427", 17416),
    ("CC-BY-SA-4.0", "006737b474624bd81a3556c363b2fe1b746a226f599c9ef45f75b06d8831b9a4", 17457),
    ("CC0-1.0", "6e530a85ac255cd278506983e3909f4e4784f53bbdd13bc9b8a280cabc3c0041", 6646),
    ("CC0-1.0", "5ae3f76dda2e69e50143522ea539402a0b5e33eb1a4ba0497fc88f282d5c0d33", 6692),
    ("GPL-2.0-only", "2a0d34bf8ceab6a1a8a817991214f32cb11501dfc281912193518c03022b2d13", 14351),
    ("GPL-2.0-only", "066eb1eee66ee8afd351d91d83d083b3b903186dabd573cfaf27f7f447ca25c6", 14379),
    ("GPL-2.0-only", "a78011a5a5e926c7575fa63866d2affc41e9fc8b05d6c42de04254f6e0ecfb1b", 14398),
    ("GPL-2.0-only", "19157abd12694b68b9651534f4c2f0f42377f7a9dd86dc3db2d094faeae34f80", 14426),
    ("GPL-2.0-only", "5622f4f7831f031df6199c066464c7cbc4da961317c13ce5e905be6798222952", 14524),
    ("GPL-2.0-only", "cd3b8241c4888eac568beac6ebb01274def474b48a37c511f3ce8111b3934626", 14552),
    ("GPL-2.0-only", "fa04a1c472f8dbeab1d9a9d742c31b0a668a80cc9854d0c7657b64f9155d39fd", 14571),
    ("GPL-2.0-only", "9538c1670ccbf2609df74a55a810ed692bbaa02555250955074483ef98555ba8", 14599),
    ("GPL-2.0-only", "a0c725aa3e8ceae83d07b9c4a37a2eb6355b6457a802393d15655a35bb9a8ccb", 17069),
    ("GPL-2.0-only", "3dda63836827171f371695edf1842d53fd14562edcfc5f32641c5ad451f3550e", 17116),
    ("GPL-2.0-only", "7a807b30991feb75a93e5c6126abd439dfaf34d1315084032e269d2929bf2f98", 17210),
    ("GPL-2.0-only", "a52eb464175d15715e46941a60fc8ae3a75f15c2018c4514ef357d74c6ae3bdd", 17257),
    ("GPL-3.0-only", "5d4b326bce392583de6ce5f6c256d32c253532ffa3523767ed0b82ad64aa6505", 30842),
    ("GPL-3.0-only", "6a866d102d4a9751109ec6e77649a379c9fee51e495e076338267404900a4407", 30870),
    ("GPL-3.0-only", "2d35346d6557eeee275206ae228ea97223b39e663e78f027d372dd50e6ae1a24", 30892),
    ("GPL-3.0-only", "4573f6f9fed7d4b7aba212eedacc1de967168737d008a2f4f229167fabd7167d", 30920),
    ("GPL-3.0-only", "7ed0ece14af2bd6a942a8f24c9cf1c45bb523e02138e343293ac74d43487d965", 30960),
    ("GPL-3.0-only", "43d5db0069e9cfbe1326537d4a1153021820a72fa0933c1c83f201d05fb9b9d6", 30988),
    ("GPL-3.0-only", "5997ac5691dc7d9f24ca106071df1cfcdd50927567c1e0487339afc13334530f", 31010),
    ("GPL-3.0-only", "d74fa80c74ebe0ff8b755a513a55a16ab8f095207308d21a235d0355dad7209c", 31038),
    ("GPL-3.0-only", "7833de86d6db57e6473947c5d757b7c42b511c81a817d704b00e8502d90a934d", 33366),
    ("GPL-3.0-only", "714a023bee84b9a6ab92e8ce6cc7b2740821be3963dcb2f387b8990a9c69e948", 33416),
    ("GPL-3.0-only", "8c82b2000980567f3ebc364d1a2b4319e2e88ed1d3db88526b7958d3f1c9b70d", 33452),
    ("GPL-3.0-only", "f948bc65f4f3b639616db73449d8412b80bff662695c5fca1aeae53870edf850", 33502),
    ("LGPL-3.0-only", "3db6999a9d211ace3efb66d5f27b6e2f1043384759e11eb8ab55061abc56a132", 6930),
    ("LGPL-3.0-only", "0a97c2d1871fe38ffacc65726cd4225d94ca9310a73b3424b4750ad16a3826df", 6987),
    ("LGPL-3.0-only", "1b123c3ac0e29325e6285919868ae6ef402c911f31a69958bd2be9ca91fc6765", 7047),
    ("LGPL-3.0-only", "a3466d4f60d6134443e1c2d5761e472d76d12119cf92985b28984b4d0d8c5ac6", 7104),
    ("MPL-2.0", "ea9ecbf4e4c44fd1ae721edc79d24e89a380f29c7c23e7e02deebcc8917ba045", 13626),
    ("MPL-2.0", "0ce0a4b2c67baf45fba977ea3c42794d0eb356d48a87f22eb3253b39bcbca3c7", 13661),
    ("MPL-2.0", "1eaaf5cacd520ced95e3348bf298e858d11a347c6f746fd96ec6b3343c72cf89", 14306),
    ("MPL-2.0", "1eb1047cfdc037233aa013acd26cf8e5253b483b76ab22b842c1e65c92bf5a5b", 14341),
]

_COPYRIGHT = r"^[^\p{L}\p{N}]*(copyright ([0-9(]|c\b|by\b|©)|\(c\) ?[0-9]|© ?[0-9]|all rights reserved)"


def canonical_sql(line: str, dialect: str = "spark") -> str:
    """SQL for the canonical form of one line; '' for a line that states a copyright."""
    raw, every = ("R", "") if dialect == "spark" else ("", ", 'g'")
    spaced = f"concat(' ', trim(regexp_replace(lower({line}), {raw}'[^\\p{{L}}\\p{{N}}]+', ' '{every})), ' ')"
    for this, that in EQUIVALENT.items():
        spaced = f"replace({spaced}, ' {this} ', ' {that} ')"
    matches = f"lower({line}) rlike {raw}'{_COPYRIGHT}'" if dialect == "spark" else f"regexp_matches(lower({line}), '{_COPYRIGHT}')"
    return f"CASE WHEN {matches} THEN '' ELSE trim({spaced}) END"


def canonical(df: DataFrame) -> DataFrame:
    """df, which has text, with canonical_lines (an array) and digest (of all lines together)."""
    df = df.withColumn("canonical_lines", F.expr(f"transform(split(coalesce(text, ''), '\\n'), l -> {canonical_sql('l')})"))
    return df.withColumn("digest", F.sha2(F.array_join(F.expr("filter(canonical_lines, l -> l != '')"), " "), 256))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, size and licence of every known text."""
    table = spark.createDataFrame(KNOWN if known is None else known, "licence string, text string")
    told = canonical(table).withColumn("size", F.length(F.array_join(F.expr("filter(canonical_lines, l -> l != '')"), " ")))
    told = told.where("size > 0").select("licence", "digest", "size")
    if known is None:
        told = told.unionByName(spark.createDataFrame(DIGESTS, "licence string, digest string, size int"))
    return told.groupBy("digest", "size").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, text_digest, licence of the whole text, notices (licences of single lines, by commas) and n_notices (lines)."""
    spark = docs.sparkSession
    table = stored(known_digests(spark, known), "licence-digests")
    sizes = [r["size"] for r in table.select("size").distinct().limit(10_000).collect()]
    digested = "transform(filter(canonical_lines, l -> length(l) IN ({})), l -> sha2(l, 256))".format(", ".join(map(str, sizes or [0]))) if len(sizes) < 10_000 else "transform(canonical_lines, l -> sha2(l, 256))"
    slim = stored(canonical(docs.select("doc_id", "text")).selectExpr("doc_id", "digest", f"{digested} AS line_digests"), "text-digests")
    of_line = small_or_not(table.select(F.col("digest").alias("line_digest"), F.col("licence").alias("notice")))
    lines = slim.where("size(line_digests) > 0").groupBy("digest").agg(F.first("line_digests").alias("line_digests")).select("digest", F.explode("line_digests").alias("line_digest"))
    notices = lines.join(of_line, "line_digest").groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"), F.count("*").alias("n_notices"))
    of_text = small_or_not(table.select("digest", "licence"))
    whole = slim.join(of_text, "digest", "left").join(notices, "digest", "left")
    return whole.select("doc_id", F.col("digest").alias("text_digest"), "licence", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def oracle() -> str:
    """The same, for DuckDB, over the table documents, with the texts of KNOWN but not the DIGESTS."""
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in KNOWN)
    form = canonical_sql("l", "duckdb")
    lists = "list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: " + form + ")"
    whole = "array_to_string(list_filter(lines, lambda l: l != ''), ' ')"
    return f"""
WITH given(licence, text) AS (VALUES {rows}),
given_lines AS (SELECT licence, {lists} AS lines FROM given),
known AS (SELECT sha256({whole}) AS digest, min(licence) AS licence FROM given_lines WHERE {whole} != '' GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, {lists} AS lines FROM documents),
told AS (SELECT r, doc_id, lines, sha256({whole}) AS digest FROM docs),
notices AS (
  SELECT r, string_agg(DISTINCT k.licence, ',' ORDER BY k.licence) AS notices, count(*) AS n
  FROM (SELECT r, unnest(lines) AS l FROM told) JOIN known k ON k.digest = sha256(l) GROUP BY r)
SELECT doc_id, digest AS text_digest, k.licence, coalesce(notices, '') AS notices, coalesce(n, 0)::BIGINT AS n_notices
FROM told LEFT JOIN known k USING (digest) LEFT JOIN notices USING (r)"""
