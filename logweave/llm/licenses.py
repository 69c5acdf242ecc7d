"""Licence scans by canonical digests.

Texts are made canonical (case, punctuation, spelling; title and copyright lines
before the body and copyright statements inside it are left out), digested, and
hash-joined to the digests of known texts.  Whole documents are looked up against
licences and notices, and every whole line against the notices that usually stand
on one line.

The known side is fixed by this module, so its broadcast is bounded.

Defined results: null and empty texts match nothing; a document's notices are
listed once each, in order; repeated rows are judged one by one; an empty table
gives no rows.  Input columns other than id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import table

# Public licence texts and notices.
_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
          "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
          "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
          "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
              "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
              "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
              "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
              "PERFORMANCE OF THIS SOFTWARE.")
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
             "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
             "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
             "distribution. ")
_BSD_THREE = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission. ")
_BSD_AS_IS = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
              "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
              "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
              "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
              "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
              "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
              "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
LICENSES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
            "shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_AS_IS),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THREE + _BSD_AS_IS),
]
#: sha256 of the canonical body of the full texts, with and without what follows the terms
FULL_TEXTS = [
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Apache-2.0", "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
]
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("all-rights-reserved", "All rights reserved."),
]
SPDX_IDS = ["MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0",
            "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("organisation", "organization"), ("favour", "favor"),
             ("acknowledgement", "acknowledgment"), ("https", "http"), ("non commercial", "noncommercial"), ("colour", "color")]
COPYRIGHT_LINE = r"^(copyright|c (19|20)[0-9][0-9]|all rights reserved$)"
#: lines left out before the body, and statements left out anywhere; 'copyright holders be liable' is body text
TITLE_LINE = (r"^((the )?(mit|expat|mit expat|isc|0bsd|((new|modified|revised|simplified) )?bsd|[023] clause bsd|zero clause bsd"
              r"|bsd (0|zero|2|3) clause( simplified| new or revised| new| revised)?)( software)?( license)?"
              r"( (mit|expat|mit expat|isc|bsd|0bsd|bsd [023] clause))?"
              r"|(the )?(software )?license( agreement)?( (mit|isc|0bsd|bsd [23] clause))?"
              r"|spdx license identifier (mit|isc|0bsd|bsd [23] clause))$")
STATEMENT = r"^(copyright (c|©|\(?(19|20)[0-9][0-9]|yyyy|year)([^a-z]|$)|(c|©) ?(19|20)[0-9][0-9]|all rights reserved$)"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(c: Column) -> Column:
    """Lower case, runs of ASCII punctuation and space as one space, one spelling."""
    c = F.trim(F.regexp_replace(F.lower(c), _NOT_WORD, " "))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def known(spark: SparkSession) -> DataFrame:
    """(digest, license, line): digests of the known texts; its size is fixed."""
    rows = [(k, t, False) for k, t in LICENSES] + [(k, t, True) for k, t in NOTICES]
    rows += [(k, f"SPDX-License-Identifier: {k}", True) for k in SPDX_IDS]
    df = spark.createDataFrame(rows, "license string, text string, line boolean")
    # conditions are often listed with bullets, which the canonical form leaves out, in place of numbers
    bare = [(k, re.sub(r" [123]\. ", " ", t), False) for k, t in LICENSES if k.startswith("BSD")]
    df = df.union(spark.createDataFrame(bare, "license string, text string, line boolean"))
    full = spark.createDataFrame([(d, k, False) for k, d in FULL_TEXTS], "digest string, license string, line boolean")
    return df.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license", "line").union(full).distinct()


def bodies(lines: Column) -> Column:
    """Texts of a document to look up whole: without any line that begins like a copyright
    line, and without its head of titles and copyright lines and the statements after it."""
    start = F.array_position(F.transform(lines, lambda x: ~(x.rlike(COPYRIGHT_LINE) | x.rlike(STATEMENT) | x.rlike(TITLE_LINE))), True)
    rest = F.slice(lines, F.greatest(start, F.lit(1)).cast("int"), F.size(lines))
    return F.array_distinct(F.array(F.array_join(F.filter(lines, lambda x: ~x.rlike(COPYRIGHT_LINE)), " "),
                                    F.array_join(F.filter(rest, lambda x: ~x.rlike(STATEMENT)), " ")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license (of the whole text, or null), notices (sorted, of whole lines), n_notice_lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), canonical), lambda x: x != "")
    df = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), lines.alias("lines"))
    units = F.concat(F.transform(bodies(F.col("lines")), lambda x: F.struct(F.lit(True).alias("whole"), x.alias("t"))),
                     F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("t"))))
    df = df.select("id", "rid", F.explode(units).alias("u")).select("id", "rid", "u.whole", F.sha2("u.t", 256).alias("digest"))
    k = known(docs.sparkSession)
    df = df.join(F.broadcast(k), "digest", "left")
    # rows of one document stand in one task, so the partial aggregate leaves one row each
    return df.groupBy("rid", "id").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.array_sort(F.collect_set(F.when(~F.col("whole") & F.col("line"), F.col("license")))).alias("notices"),
        F.count(F.when(~F.col("whole") & F.col("line"), F.lit(1))).alias("n_notice_lines"),
    ).select(F.col("id").alias(id_col), "license", "notices", "n_notice_lines")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of the whole text and licence notices of every document."""
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "license", F.array_join("notices", ",").alias("notices"), "n_notice_lines")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical_sql(x: str) -> str:
    x = rf"trim(regexp_replace(lower({x}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
    for a, b in (("licence", "license"), ("sub license", "sublicense"), ("organisation", "organization"), ("favour", "favor"),
                 ("acknowledgement", "acknowledgment"), ("https", "http"), ("non commercial", "noncommercial"), ("colour", "color")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_VALUES = ", ".join(f"({_quoted(k)}, {_quoted(t)}, {line})" for k, t, line in
                    [(k, t, "false") for k, t in LICENSES] + [(k, t, "true") for k, t in NOTICES]
                    + [(k, f"SPDX-License-Identifier: {k}", "true") for k in SPDX_IDS])
OP4_SQL = f"""
WITH known AS (SELECT DISTINCT {_canonical_sql('t')} AS t, license, line FROM (VALUES {_VALUES}) AS v(license, t, line)),
l AS (SELECT rid, doc_id, i, {_canonical_sql('x')} AS x
      FROM (SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
            FROM (SELECT *, row_number() OVER () AS rid FROM documents))),
whole AS (SELECT rid, doc_id, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (x <> '' AND NOT regexp_matches(x, '^(copyright|c (19|20)[0-9][0-9]|all rights reserved$)')), '') AS t
          FROM l GROUP BY rid, doc_id),
w AS (SELECT rid, doc_id, min(license) AS license FROM whole LEFT JOIN known USING (t) GROUP BY rid, doc_id),
n AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS k
      FROM l JOIN known ON l.x = known.t AND known.line WHERE l.x <> '' GROUP BY rid)
SELECT doc_id, license, coalesce(notices, '') AS notices, CAST(coalesce(k, 0) AS BIGINT) AS n_notice_lines FROM w LEFT JOIN n USING (rid)
"""
