"""Licence scan by canonical digest, in DataFrame functions only.

Texts are reduced to a canonical form (case, punctuation, white space, copyright
statements, equivalent spellings), and the digest of the whole form is looked up among the
digests of known licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal (fixed values): each left one is read as the right one.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("copyright owner", "copyright holder"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("non commercial", "noncommercial"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("sub license", "sublicense"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
)
_MIT_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n"
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n"
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies.\n"
)
_0BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public "
    "domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
    "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
    "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
    "this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
    "freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
    "acknowledgment in the product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution.\n"
)
#: (licence, text) of short licences with their usual headings (fixed values).
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT + _MIT_END),
    ("MIT", "MIT License\n" + _MIT + _MIT_END),
    ("MIT", "The MIT License\n" + _MIT + _MIT_END),
    ("MIT", "The MIT License (MIT)\n" + _MIT + _MIT_END),
    ("MIT-0", _MIT.split(", subject to the following")[0] + ".\n" + _MIT_END),
    ("MIT-0", "MIT No Attribution\n" + _MIT.split(", subject to the following")[0] + ".\n" + _MIT_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD + _BSD_3 + _BSD_END),
    ("ISC", _ISC + _ISC_END),
    ("ISC", "ISC License\n" + _ISC + _ISC_END),
    ("ISC", "The ISC License\n" + _ISC + _ISC_END),
    ("0BSD", _0BSD + _ISC_END),
    ("0BSD", "BSD Zero Clause License\n" + _0BSD + _ISC_END),
    ("Unlicense", _UNLICENSE + "For more information, please refer to <https://unlicense.org>"),
    ("Unlicense", _UNLICENSE + "For more information, please refer to <https://unlicense.org/>"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
)
#: (licence, digest) of the canonical forms of long licences, as their publishers give
#: them: whole, and without what follows the end of the terms where such a part exists.
#: Version 2 of the table, for the steps and spellings below; ``digest`` makes its entries.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "b8b4b7a1a3fc45a40c173b28ca0fcfde44b6289443f009fcb8d3cd6162c57d6e"),
    ("Apache-2.0", "4b7bf538613ad74324b8d88607299656873ed7b49b6f3b5b38c9e913571e248c"),
    ("Apache-2.0", "03879208f1e2fa6aaf0facb5ba6c54995463447e37078fbb73a1b8963cf9ea82"),
    ("Artistic-1.0-Perl", "b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49"),
    ("CC0-1.0", "8a20adffc7304b14c6abf18e4f5b5dd165c30fe18458e37e657014e4a1e7241a"),
    ("GFDL-1.2", "7bd3a9b625b0b9c72d575e34948a31aa1d9a92600e54323c0abd84a9844ce82d"),
    ("GFDL-1.3", "3e03599855be6f5154c1bba1c4189768a3518f5863527559438fa78fa2262af5"),
    ("GPL-1.0", "ac910954c3184907f3947de0193b0169b8c69656ff2de7f3330438f6ba4fb746"),
    ("GPL-1.0", "e865a0dda2da3969652b87fd53fdbacbc9c971447325f465df48971826e5f97c"),
    ("GPL-1.0", "0460830f1601ab5f615dd93818221b48820590af661686bdf540c70fe3d696a4"),
    ("GPL-2.0", "2e8e378a3d24393c0f3fd1439ffbe84e750886c09715e622426a6a0e54fa1bee"),
    ("GPL-2.0", "724499132592c4e4c95c8d0a0a79e0045822f797839536a7338312694e3341bc"),
    ("GPL-2.0", "80edaf5771a2ca5e7df6a5c023beb15391e60cf1bbae81a82600bb184fecef39"),
    ("GPL-3.0", "5537b42339f557495a7ef6edda391c721265c572a6e950e552ee50adbb55086b"),
    ("GPL-3.0", "ff9c0e18c1a1608644ad28deb80da932107c4b80783c872e3d08c8a027b39afa"),
    ("GPL-3.0", "6eb0833e9db6f0835dfc949258242b7b54a451fff8317a6d0dcfc2220293279c"),
    ("LGPL-2.0", "da0e4a7fe0b047c78b3d0d3d4f2a7ba30a2ee32b196527f97d3d30a05f3e9b64"),
    ("LGPL-2.0", "622075f1fe4872988a3bbcf39c8e7e6e541e23b11e4616c5e3aabe4d112ee19a"),
    ("LGPL-2.0", "bd0999750587375615c32cf6de65435ef8af157651c1b7aa2dc4cc944c4b4a18"),
    ("LGPL-2.1", "055f4d37605d52b52891d3649b129b56ef5bb6869370235f4c52fc9329159bad"),
    ("LGPL-2.1", "a74a83c079b6cf99a931e6f30d86747ba9b5500d10fef4c9e677c9b07773c2f6"),
    ("LGPL-2.1", "5160a066401fd9c61596563511e6a33d003756b39aa7d6b87943d927740ee828"),
    ("LGPL-3.0", "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45"),
    ("MPL-1.1", "a1ea0c4b634aa7b4256d56525c941092a1facf7d3e96c4ecb68ba71bc6744f7d"),
    ("MPL-2.0", "8dce888cb942d93cebeb8e0fea8afac43e084f54254ac4d9b99cfde68a62468b"),
)

_CLAIM = r"(copyright[ \t]*(\(c\)|©|[0-9])|(\(c\)|©)[ \t]*(copyright|[0-9]))"
#: Steps of the canonical form: (pattern, replacement), in order, on lower-case text. Java
#: (with lines ended by line feeds only), RE2 and DuckDB read them alike. A copyright line
#: goes whole if it doesn't end in a full stop, else up to the end of its first sentence.
STEPS: tuple[tuple[str, str], ...] = (
    (r"(?m)^[ \t\x0B\f]*[#*/;%>|-]+[ \t]", " "),  # comment and list marks at the start of a line
    (r"(?m)^[ \t]*" + _CLAIM + r"[^\n]*[^.\n\r\t ][ \t\r]*$", " "),
    (r"(?m)^[ \t]*" + _CLAIM + r"[^.\n]*(\.[^ \t\n\r][^.\n]*){0,50}(\.|$)", " "),
    (r"(?m)^[ \t]*all rights reserved\.?[ \t\r]*$", " "),
    (r"(?m)^[ \t]*(\(?[0-9a-z]{1,2}[.)])[ \t]", " "),  # numbers of list entries
    (r"[^\p{L}\p{N}]+", " "),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null, and a text without letters or
    digits is the empty string. Line breaks count where marks and numbers of list entries
    or copyright statements begin a line, and nowhere else."""
    out = F.lower(text)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern.replace("(?m)", "(?dm)"), to)
    # each word has spaces of its own, so equal spellings side by side are all found
    out = F.concat(F.lit(" "), F.replace(F.trim(out), F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} ".replace(" ", "  ")[1:-1]), F.lit(f" {new} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def catalogue(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """(digest, license) of known texts and of known digests; of equal digests the first
    name by order counts. Any table of these columns serves ``lookup`` as well."""
    rows = spark.createDataFrame(list(known), "license string, text string").select(digest(F.col("text")).alias("digest"), "license")
    rows = rows.unionByName(spark.createDataFrame(list(digests), "license string, digest string"))
    return rows.where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null for null texts and for empty forms."""
    # named once: beside a condition on it, the form would be computed twice
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def lookup(df: DataFrame, known: DataFrame, *, by: str = "digest", into: str = "license") -> DataFrame:
    """``df`` with the licence of each row's digest, or null, in column ``into``.

    Every row stays, copies too. ``known`` has each digest once, as ``catalogue`` sees to:
    a digest that it repeats would repeat rows. A digest that very many rows share does no
    harm, as Spark splits its rows or sends the catalogue to them, whichever its size allows.
    An empty table, or an empty catalogue, is fine.
    """
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != into)).alias("row"), F.col(by).alias("d"))
    return rows.join(known.select(F.col("digest").alias("d"), F.col("license").alias("found")), "d", "left").select("row.*", F.col("found").alias(into))


def scan(df: DataFrame, known: DataFrame, *, text: str = "text", into: str = "license") -> DataFrame:
    """``df`` with the licence that each whole text is, or null, in column ``into``.

    Null and empty texts are no licence.
    """
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != into)).alias("row"), digest(F.col(text)).alias("d"))
    return lookup(rows, known, by="d", into="found").select("row.*", F.col("found").alias(into))


def oracle_sql() -> str:
    """What the query gives, in DuckDB's SQL."""

    def form(x: str) -> str:
        out = f"lower({x})"
        for pattern, to in STEPS:
            out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
        out = f"' ' || replace(trim({out}), ' ', '  ') || ' '"
        for old, new in SPELLINGS:
            out = f"replace({out}, '{f' {old} '.replace(' ', '  ')[1:-1]}', '{f' {new} '.replace(' ', '  ')[1:-1]}')"
        return f"trim(replace({out}, '  ', ' '))"

    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)
    more = ", ".join(f"('{k}', '{d}')" for k, d in DIGESTS)
    return f"""
WITH each AS (SELECT license, sha256({form("t")}) AS digest FROM (VALUES {rows}) AS v(license, t) UNION ALL SELECT * FROM (VALUES {more}) AS w(license, digest)),
known AS (SELECT digest, min(license) AS license FROM each GROUP BY 1),
docs AS (SELECT doc_id, {form("text")} AS form FROM documents)
SELECT d.doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest, k.license
FROM docs d LEFT JOIN known k ON d.form <> '' AND sha256(d.form) = k.digest
"""
