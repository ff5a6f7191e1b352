"""Licence scan by canonical digests, in built-in Spark functions only.

A whole text is brought to a canonical form: letters in one case, copyright
lines gone, equivalent spellings made one, numbers of clauses gone, anything but letters
and digits a single space, the licence's own name in front gone. Its SHA-256 is hash-joined with the digests of the known
licences, which are put through the same expression. The known table is a
fixed list in this module, so it is small whatever the corpus; it is broadcast.

Defined cases: a null text counts as empty; a text with nothing but marks or
copyright lines has the empty canonical form, which matches no licence; rows
that repeat give equal results, one for each row; two known texts with one
canonical form count under the smaller name; null ids pass through; an empty
table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence texts as published, without their copyright lines.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
LICENCES = {
    "MIT": "MIT License\n\n" + _GRANT + ", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS,
    "MIT-0": "MIT No Attribution\n\n" + _GRANT + ".\n\n" + _AS_IS,
    "ISC": "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_AS_IS,
    "0BSD": _ISC_GRANT + ".\n\n" + _ISC_AS_IS,
    "BSD-2-Clause": _BSD_HEAD + _BSD_AS_IS,
    "BSD-3-Clause": _BSD_HEAD + _BSD_NAMES + _BSD_AS_IS,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Notice-MIT": "Released under the MIT License.",
    "Notice-Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Notice-GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
}
# Spellings that count as the same.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("judgement", "judgment"),
    ("modernise", "modernize"), ("organis", "organiz"), ("copyright owner", "copyright holder"), ("https://", "http://"),
    ("per cent", "percent"), ("programme", "program"), ("wilful", "willful"), ("(c)", "©"), ("&", "and"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright[ \t:]*(©|[0-9])|copyright [^\n]*[0-9]{4}|©)[^\n]*"
#: Numbers of clauses; bullets are marks and go with them.
CLAUSE = r"(^|[ \t\n\r])[(]?[0-9]{1,2}[.)][ \t\n\r]+([a-z])"
#: A licence's own name and "all rights reserved" in front of its first word.
HEADING = (
    r"^(?:(?:the )?(?:mit no attribution|(?:mit|isc|zlib|bsd [0-9] clause|bsd zero clause|(?:simplified |new |revised |modified )?bsd)(?: license)?)"
    r"(?: mit| isc| zlib| bsd [0-9] clause| simplified| new| revised)?(?: license)? )?(?:all rights reserved )?(permission|redistribution|this software) "
)
NO_TEXT = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a whole text."""
    out = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, "\n"), CLAUSE, " $2")
    return F.regexp_replace(F.trim(F.regexp_replace(out, NO_TEXT, " ")), HEADING, "$1 ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark, texts: dict[str, str] = LICENCES) -> DataFrame:
    """license_id and digest of each known text."""
    rows = spark.createDataFrame(sorted(texts.items()), "license_id string, text string")
    forms = rows.withColumn("form", canonical(F.col("text"))).filter("form <> ''")
    return forms.groupBy(F.sha2("form", 256).alias("known_sha256")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, texts: dict[str, str] = LICENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, canonical_sha256 and license_id (null if the text is no known licence)."""
    digests = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("canonical_sha256"))
    table = F.broadcast(known(docs.sparkSession, texts))  # as many rows as the fixed list at most
    joined = digests.join(table, F.col("canonical_sha256") == F.col("known_sha256"), "left")
    return joined.select("doc_id", "canonical_sha256", "license_id")
