"""Licence scans by sentence rules, in SQL functions only.

A text is cut into sentences twice: at sentence ends and line breaks, and at sentence ends alone (for texts with
wrapped lines). Normalised sentences (lower case, everything but letters and digits as one space) that are known
become identifiers. A licence is found where the identifiers of its rule stand in order, other sentences between
them allowed; a rule that lies within another matching rule is left out. Texts without any of a few words that
every known sentence has are not cut at all. No row leaves its task: nothing is dealt out.

Null, empty and wordless texts have no licence; an empty table gives an empty result. Very long texts are cut whole.
Of rules that match, all count, so there are no ties. Repeated rows get equal results. Columns other than id and text
are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

#: Words of which every known sentence below has one, as the public texts of the licences have them.
TRIGGER = "licen[sc]e|warrant|permission|redistribut|creative commons|cc by|liable"

#: Known sentences, by identifier.
SENTENCES: dict[int, str] = {
    1: "Released under the MIT License.",
    2: "Licensed under the MIT License.",
    3: "This project is licensed under the MIT License.",
    4: "Licensed under the Apache License, Version 2.0.",
    5: 'Licensed under the Apache License, Version 2.0 (the "License");',
    6: "you may not use this file except in compliance with the License.",
    7: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    8: 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    9: "See the License for the specific language governing permissions and limitations under the License.",
    10: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    11: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    12: 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    13: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    14: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    15: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    16: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    17: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    18: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    19: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    20: "See the GNU General Public License for more details.",
    21: "This work is licensed under the GNU General Public License, version 3.",
    22: "Licensed under CC BY-NC 4.0.",
    23: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    24: "Licensed under CC BY 4.0.",
    25: "Licensed under CC BY-SA 4.0.",
    26: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    27: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    28: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

#: Ordered rules: licence, then its identifiers.
RULES: list[tuple[str, tuple[int, ...]]] = [
    ("MIT", (1,)), ("MIT", (2,)), ("MIT", (3,)), ("MIT", (10, 11, 12, 13)), ("MIT", (10, 11, 12)),
    ("Apache-2.0", (4,)), ("Apache-2.0", (5, 6, 8, 9)), ("Apache-2.0", (6, 7, 8, 9)), ("Apache-2.0", (6, 8, 9)),
    ("BSD-2-Clause", (14, 15, 16)), ("BSD-3-Clause", (14, 15, 16, 17)),
    ("GPL-3.0", (21,)), ("GPL-3.0", (18, 19, 20)),
    ("CC-BY-NC-4.0", (22,)), ("CC-BY-NC-4.0", (26,)), ("CC-BY-4.0", (23,)), ("CC-BY-4.0", (24,)), ("CC-BY-SA-4.0", (25,)),
    ("MPL-2.0", (27,)), ("ISC", (28,)),
]

_END = r"([.!?:;])[ \t\r\n]+"


def plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known(sentences: dict[int, str]) -> dict[str, int]:
    """Normalised sentences, each cut as texts are; the longest cut carries the identifier."""
    return {max(map(plain, re.split(r"(?<=[.!?:;])\s+", s)), key=len): key for key, s in sentences.items()}


def gate_of(sentences: dict[int, str]) -> str:
    """A pattern that the lower case of every text with a known sentence has: TRIGGER, or the longest word of each."""
    texts = list(known(sentences))
    if all(re.search(TRIGGER, s) for s in texts):
        return TRIGGER
    return "|".join(sorted({max(s.split() or [""], key=lambda w: (len(w), w)) for s in texts}))


def _within(small: tuple[int, ...], large: tuple[int, ...]) -> bool:
    rest = iter(large)
    return small != large and all(x in rest for x in small)


def sequence_of(text: Column, sentences: dict[int, str], gate: str = TRIGGER) -> Column:
    """The known identifiers in order, as <4><6>."""
    ids = known(sentences)
    table_ = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
    plain_ = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    marked = F.filter(F.split(text, "\x01"), lambda s: F.lower(s).rlike(gate))
    found = F.filter(F.transform(marked, lambda s: table_[plain_(s)]), lambda x: x.isNotNull())
    return F.array_join(F.transform(found, lambda x: F.concat(F.lit("<"), x.cast("string"), F.lit(">"))), "")


def scan_licences(
    docs: DataFrame, sentences: dict[int, str] | None = None, rules: list[tuple[str, tuple[int, ...]]] | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, sentence_ids, licences): identifiers by either cut, and the names found, sorted and comma-joined."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    gate = gate_of(sentences)
    at = F.col("text")
    by_line = F.regexp_replace(F.regexp_replace(at, "\n+", "\x01"), _END, "$1\x01")
    by_end = F.regexp_replace(F.regexp_replace(at, "\n[ \t\r]*\n", "\x01"), _END, "$1\x01")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    worth = F.lower(F.coalesce(at, F.lit(""))).rlike(gate)
    rows = rows.select("doc_id", *(F.when(worth, sequence_of(cut, sentences, gate)).otherwise("").alias(n) for n, cut in (("a", by_line), ("b", by_end))))
    fits = lambda ids: F.col("a").like(_pattern(ids)) | F.col("b").like(_pattern(ids))
    names = []
    for name, ids in rules:
        wider = [w for _, w in rules if _within(ids, w)]
        hit = fits(ids)
        for w in wider:
            hit = hit & ~fits(w)
        names.append(F.when(hit, F.lit(name)))
    sequence = F.when(F.length("a") >= F.length("b"), F.col("a")).otherwise(F.col("b"))
    return rows.select("doc_id", sequence.alias("sentence_ids"), F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))), ",").alias("licences"))


def _pattern(ids: tuple[int, ...]) -> str:
    return "%" + "%".join(f"<{i}>" for i in ids) + "%"


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def _sql() -> str:
    pairs = ", ".join(f"('{s}', {i})" for s, i in known(SENTENCES).items())
    rows = []
    for name, ids in RULES:
        fits = lambda x: f"(a LIKE '{_pattern(x)}' OR b LIKE '{_pattern(x)}')"
        rows.append(f"CASE WHEN {fits(ids)}" + "".join(f" AND NOT {fits(w)}" for _, w in RULES if _within(ids, w)) + f" THEN '{name}' END")
    cut = lambda inner: f"regexp_replace({inner}, '{_END}', '\\1' || chr(1), 'g')"
    return f"""
WITH known(s, k) AS (VALUES {pairs}),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, {cut("regexp_replace(coalesce(text, ''), chr(10) || '+', chr(1), 'g')")} AS a,
         {cut("regexp_replace(coalesce(text, ''), chr(10) || '[ ' || chr(9) || chr(13) || ']*' || chr(10), chr(1), 'g')")} AS b
  FROM documents
), pieces AS (
  SELECT r, 'a' AS kind, unnest(string_split(a, chr(1))) AS s, generate_subscripts(string_split(a, chr(1)), 1) AS i FROM texts
  UNION ALL SELECT r, 'b', unnest(string_split(b, chr(1))), generate_subscripts(string_split(b, chr(1)), 1) FROM texts
), ids AS (
  SELECT r, kind, string_agg('<' || k || '>', '' ORDER BY i) AS q
  FROM pieces JOIN known ON trim(regexp_replace(lower(pieces.s), '[^a-z0-9]+', ' ', 'g')) = known.s GROUP BY r, kind
), both_ AS (
  SELECT t.doc_id, coalesce(x.q, '') AS a, coalesce(y.q, '') AS b
  FROM texts t LEFT JOIN ids x ON t.r = x.r AND x.kind = 'a' LEFT JOIN ids y ON t.r = y.r AND y.kind = 'b'
)
SELECT doc_id, CASE WHEN length(a) >= length(b) THEN a ELSE b END AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{", ".join(rows)}], lambda x : x IS NOT NULL))), ','), '') AS licences
FROM both_
"""


OP4_SQL = _sql()
