"""License scans by canonical digests.

A text is normalised (letter case, punctuation, copyright lines, equivalent spellings, white space) and its SHA-256 looked
up among those of known licence texts, normalised in the same way. Whole texts are joined by hash to the table of known
digests; each line is looked up as a text of its own too, as notices stand in lines. Everything is a DataFrame expression.

The known texts are whole MIT (with three kinds of heading), ISC, 0BSD, Zlib, Unlicense, BSD with two and three clauses and
the Apache header here, and by digest alone Apache 2.0, the GPL, LGPL, GFDL, MPL, Artistic, CC0 and BSD texts that are too
long to be kept. A text that holds a licence among other text has no `license`; its lines may have notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as the same, by words of the normalised text.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "merchantibility": "merchantability", "organisation": "organization", "authorised": "authorized", "behaviour": "behavior", "favour": "favor", "analyse": "analyze", "whilst": "while", "gnu gpl": "gnu general public license", "per cent": "percent"}

#: Notices, by SPDX identifier.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Released under CC0 1.0."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License."],
}

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

""" + _AS_IS
_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Licence texts, by SPDX identifier. Copyright lines are left out, as in normalising.
TEXTS = {
    "MIT": [_MIT, "MIT License\n\n" + _MIT, "The MIT License (MIT)\n\n" + _MIT],
    "ISC": ["ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC],
    "Apache-2.0": ["""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""],
    "Zlib": ["""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""],
}


_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_3 = _BSD_START + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

""" + _BSD_END
TEXTS |= {
    "BSD-2-Clause": [_BSD_START + _BSD_END, "BSD 2-Clause License\n\n" + _BSD_START + _BSD_END],
    "BSD-3-Clause": [_BSD_3, "BSD 3-Clause License\n\n" + _BSD_3],
    "Unlicense": ["""This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

""" + _AS_IS.replace(" OR COPYRIGHT HOLDERS", "") + """

For more information, please refer to <https://unlicense.org>"""],
}
#: SHA-256 of the normalised texts of long licences, as Debian ships them: whole, and up to the end of their terms.
DIGESTS = {
    "Apache-2.0": ["37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"],
    "Artistic-1.0-Perl": ["e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"],
    "BSD-3-Clause": ["3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"],
    "CC0-1.0": ["96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"],
    "GFDL-1.2-only": ["5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"],
    "GFDL-1.3-only": ["93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"],
    "GPL-1.0-only": ["6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"],
    "GPL-2.0-only": ["6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"],
    "GPL-3.0-only": ["0bfab56d550b40daa734fad2386cb4caf8527e34ff33eb85cf0f1a0aefbf5699", "f6e910952ff4741eb305128d599e488c6d0d321ffd70cd65bac3a2743fd8c8d3", "feed92b884fd7dae2afba366a8c6e0342b260acfe00d707f5db092cd9e9d3b5c"],
    "LGPL-2.0-only": ["430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"],
    "LGPL-2.1-only": ["48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"],
    "LGPL-3.0-only": ["af4f466bab5554afad60c219ff8bf29eddb00df6ef0f1fcf73fa05ad4b3289f5"],
    "MPL-1.1": ["3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"],
    "MPL-2.0": ["f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"],
}


def _marks(text: Column) -> Column:
    """Lower case, copyright lines out, runs of all but letters, digits and newlines as one space."""
    low = F.lower(text)
    noted = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©"))
    low = F.when(noted, F.regexp_replace(low, r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*(?:[0-9]{4}|\(c\)|©|all rights reserved)[^\n]*$", "")).otherwise(low)
    return F.regexp_replace(low, r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f\x{a0}\x{a9}\x{2010}-\x{201f}]+", " ")


def _spelled(words: Column) -> Column:
    """Equivalent spellings as one, in words parted by single spaces. Spaces are doubled meanwhile, so that each word has its own."""
    out = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for other, usual in SPELLINGS.items():
        other, usual = (x.replace(" ", "  ") for x in (other, usual))
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def normalised_lines(text: Column) -> Column:
    """The normalised form of each line."""
    return F.transform(F.split(_marks(text), "\n"), lambda x: _spelled(F.trim(x)))


def joined(lines: Column) -> Column:
    """The normalised form of a text, from those of its lines. A spelling of several words may go over a line's end."""
    return _spelled(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def normalised(text: Column) -> Column:
    """Lower case, copyright lines out, runs of all but letters and digits as one space, equivalent spellings as one."""
    return joined(normalised_lines(text))


def known(spark: SparkSession) -> DataFrame:
    """(digest, license) of the known texts and notices; a table of fixed size."""
    rows = [(t, i) for group in (NOTICES, TEXTS) for i, texts in group.items() for t in texts]
    frame = spark.createDataFrame(rows, "text string, license string").select(F.sha2(normalised(F.col("text")), 256).alias("digest"), "license")
    frame = frame.unionByName(spark.createDataFrame([(d, i) for i, digests in DIGESTS.items() for d in digests], "digest string, license string"))
    return frame.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs with the digest of its normalised text, the license that this text is (or null), and the licenses
    of its lines (`notices`, sorted, joined by a space; empty if none).

    Every text and every line is normalised and looked up, whatever its length and words. A null text counts as empty; an
    empty text has the digest of the empty string, which is no license's. Rows that repeat are scanned alike, ids may be
    null; other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = known(spark)
    rows = {r["digest"]: r["license"] for r in table.collect()}  # as many as NOTICES, TEXTS and DIGESTS have
    lookup = F.create_map(*[F.lit(x) for kv in rows.items() for x in kv])
    src = docs.select(F.col(id_col).alias("id"), normalised_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"))
    found = F.transform(F.filter(F.transform("lines", lambda x: F.sha2(x, 256)), lambda d: d.isin(list(rows))), lambda d: lookup[d])
    src = src.select("id", F.sha2(joined(F.col("lines")), 256).alias("digest"), F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("notices"))
    out = src.join(F.broadcast(table), "digest", "left")
    return out.select(F.col("id").alias(id_col), "digest", "license", "notices")
