"""License scan: known license sentences become identifiers, rules match sequences of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of common licenses and notices, normalised (fixed values): identifier, sentence.
SENTENCES = (
    ("apache-under", "licensed under the apache license version 2 0"),
    ("apache-head", "licensed under the apache license version 2 0 the license"),
    ("apache-use", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("apache-basis", "unless required by applicable law or agreed to in writing software distributed under the license "
     "is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-under", "released under the mit license"),
    ("mit-licensed", "licensed under the mit license"),
    ("mit-title", "mit license"),
    ("mit-title-the", "the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction including without "
     "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
     "and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the software"),
    ("mit-as-is", "the software is provided as is without warranty of any kind express or implied including but not "
     "limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and "
     "the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions "
     "and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-names", "neither the name of the copyright holder nor the names of its contributors may be used to endorse "
     "or promote products derived from this software without specific prior written permission"),
    ("bsd-under", "released under the bsd license"),
    ("gpl3-under", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-licensed", "licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software"),
    ("gpl2-later", "you can redistribute it and or modify it under the terms of the gnu general public license as "
     "published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl3-later", "you can redistribute it and or modify it under the terms of the gnu general public license as "
     "published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl-under", "licensed under the gnu lesser general public license version 3"),
    ("mpl-subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc0", "licensed under cc0 1 0"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
     "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications "
     "and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost-under", "distributed under the boost software license version 1 0"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("epl2-under", "made available under the terms of the eclipse public license 2 0"),
    ("agpl3-later", "you can redistribute it and or modify it under the terms of the gnu affero general public license as "
     "published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl21-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
     "published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl3-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
     "published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache-under", "licensed under the apache license 2 0"),
    ("apache-under", "licensed under the apache 2 0 license"),
    ("mit-under", "distributed under the mit license"),
    ("mit-under", "available under the mit license"),
    ("bsd-under", "licensed under the bsd license"),
    ("mpl-licensed", "licensed under the mozilla public license 2 0"),
    ("gpl2-licensed", "licensed under the gnu general public license version 2"),
    ("all-rights", "all rights reserved"),
)
# Names of licenses in a machine-readable tag (fixed values) and whether reuse is allowed.
TAGS = (
    ("MIT", True), ("Apache-2.0", True), ("BSD-2-Clause", True), ("BSD-3-Clause", True), ("ISC", True), ("Zlib", True),
    ("BSL-1.0", True), ("Unlicense", True), ("CC0-1.0", True), ("MPL-2.0", True), ("EPL-2.0", True), ("GPL-2.0-only", False),
    ("GPL-2.0-or-later", False), ("GPL-3.0-only", False), ("GPL-3.0-or-later", False), ("LGPL-2.1-or-later", False),
    ("LGPL-3.0-only", False), ("LGPL-3.0-or-later", False), ("AGPL-3.0-only", False), ("AGPL-3.0-or-later", False),
)
SENTENCES += tuple((f"tag-{name.lower()}", "spdx license identifier " + " ".join(name.lower().replace("-", ".").split(".")))
                   for name, _ in TAGS)
# Ordered rules: license, reuse allowed, and the identifiers that must follow one another. The
# first rule that matches names the document's license, so longer sequences stand first.
RULES = (
    ("MIT", True, ("mit-grant", "mit-notice", "mit-as-is")),
    ("BSD-3-Clause", True, ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", True, ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", True, ("apache-head", "apache-use", "apache-copy", "apache-basis", "apache-see")),
    ("GPL-3.0-or-later", False, ("gpl-free", "gpl3-later")),
    ("GPL-2.0-or-later", False, ("gpl-free", "gpl2-later")),
    ("CC-BY-NC-SA-4.0", False, ("cc-by-nc-sa",)),
    ("CC-BY-NC-4.0", False, ("cc-by-nc",)),
    ("GPL-3.0-only", False, ("gpl3-under",)),
    ("GPL-3.0-only", False, ("gpl3-licensed",)),
    ("LGPL-3.0-only", False, ("lgpl-under",)),
    ("CC-BY-SA-4.0", True, ("cc-by-sa",)),
    ("CC-BY-4.0", True, ("cc-by",)),
    ("CC0-1.0", True, ("cc0",)),
    ("MPL-2.0", True, ("mpl-subject",)),
    ("Apache-2.0", True, ("apache-head",)),
    ("Apache-2.0", True, ("apache-under",)),
    ("MIT", True, ("mit-under",)),
    ("MIT", True, ("mit-licensed",)),
    ("MIT", True, ("mit-grant",)),
    ("BSD", True, ("bsd-under",)),
    ("ISC", True, ("isc-grant",)),
    ("Zlib", True, ("zlib-grant",)),
    ("BSL-1.0", True, ("boost-under",)),
    ("Unlicense", True, ("unlicense-free",)),
    ("EPL-2.0", True, ("epl2-under",)),
    ("AGPL-3.0-or-later", False, ("agpl3-later",)),
    ("LGPL-2.1-or-later", False, ("lgpl21-later",)),
    ("LGPL-3.0-or-later", False, ("lgpl3-later",)),
    ("MPL-2.0", True, ("mpl-licensed",)),
    ("GPL-2.0-only", False, ("gpl2-licensed",)),
    *((name, free, (f"tag-{name.lower()}",)) for name, free in TAGS),
    ("proprietary", False, ("all-rights",)),
)
# Ends of sentences: a mark after two letters and before a blank (so "v. 2.0" and "1. First" go on), or a
# line without letters and digits, as comments have between paragraphs.
_END = r"([A-Za-z0-9)\]\"']{2}[.!?])[\x20\x09-\x0D]+|\n[^A-Za-z0-9\n]*\n"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def triggers(sentences: tuple) -> list[str]:
    """A few words of which every sentence has one, chosen greedily: texts without them are done."""
    left, chosen = [set(words.split()) for _, words in sentences], []
    while left:
        words = sorted({w for s in left for w in s if w.isalpha() and len(w) > 2} or {w for s in left for w in s})
        best = max(words, key=lambda w: (sum(w in s for s in left), len(w)))
        chosen.append(best)
        left = [s for s in left if best not in s]
    return chosen


def normalised(text: Column) -> Column:
    """Lower-case ASCII letters and digits in words with one space between, sentences ended by code point 1."""
    ended = F.regexp_replace(F.translate(text, _UPPER, _LOWER), _END, "$1\x01")
    return F.regexp_replace(ended, "[^a-z0-9\x01]+", " ")


def sentence_ids(text: Column, sentences: tuple = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A known sentence is a run of whole words inside a sentence of the text, wherever it
    stands there; of several that begin at one word the longest counts, and they do not overlap.
    """
    known = F.create_map(*[F.lit(x) for name, words in sentences for x in (words, name)])
    longest = sorted((words for _, words in sentences), key=lambda w: (-len(w), w))
    pattern = rf"\b(?:{'|'.join(longest)})\b"
    found = F.transform(F.regexp_extract_all(normalised(text), F.lit(pattern), F.lit(0)), lambda s: F.element_at(known, s))
    near = F.translate(text, _UPPER, _LOWER).rlike("|".join(triggers(sentences)))
    return F.when(near, found).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: tuple = SENTENCES,
                  rules: tuple = RULES) -> DataFrame:
    """``doc_id, license, reusable, sentence_ids, licenses`` for every row; one projection.

    A known sentence counts wherever it stands as whole words inside a sentence: in wrapped
    comments, below a copyright line, or in a sentence about the project. ``license`` is that
    of the first rule in order whose identifiers follow one another in the document, ``licenses`` all that match, in the order of the rules. Documents without
    a known license, null and empty ones too, have null and empty values; null keys and
    repeated rows give a row each. Texts are normalised by ASCII letters and digits.
    """
    ids = sentence_ids(F.coalesce(F.col(text), F.lit("")), sentences)
    path = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    found = docs.select(F.col(key).alias("doc_id"), ids.alias("ids")).select("doc_id", "ids", path.alias("path"))
    license_, reusable = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    matched = []
    for name, free, sequence in reversed(rules):
        here = F.contains("path", F.lit(f" {' '.join(sequence)} "))
        license_ = F.when(here, name).otherwise(license_)
        reusable = F.when(here, free).otherwise(reusable)
        matched.insert(0, F.when(here, name))
    names = F.array_join(F.array_distinct(F.array_compact(F.array(*matched))), ",")
    return found.select("doc_id", license_.alias("license"), reusable.alias("reusable"),
                        F.array_join("ids", ",").alias("sentence_ids"), names.alias("licenses"))


def oracle(sentences: tuple = SENTENCES, rules: tuple = RULES) -> str:
    """The same scan in DuckDB SQL over ``documents``: sentences as lists of words, laid on one after another."""
    known = ", ".join(f"('{words}', '{name}')" for name, words in sentences)
    cases = [(f"contains(path, ' {' '.join(s)} ')", name, free) for name, free, s in rules]
    license_ = " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in cases)
    reusable = " ".join(f"WHEN {c} THEN {str(f).lower()}" for c, _, f in cases)
    every = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n, _ in cases)
    end = _END.replace("'", "''")
    return f"""
WITH RECURSIVE known AS (SELECT string_split(words, ' ') AS w, name, words FROM (VALUES {known}) AS v(words, name)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT r, i, trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) AS part FROM (
    SELECT r, string_split(regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '{end}', '\\1' || chr(1), 'g'), chr(1)) AS p
    FROM docs), unnest(p) WITH ORDINALITY AS u(part, i)),
near AS (SELECT r, i, string_split(part, ' ') AS p, w, name FROM parts, known WHERE contains(part, words)),
hits AS (
  SELECT r, i, j, arg_max(name, len(w)) AS name, max(len(w)) AS n FROM near, unnest(range(1, len(p) - len(w) + 2)) AS t(j)
  WHERE p[j:j + len(w) - 1] = w GROUP BY r, i, j),
taken AS (
  SELECT r, i, min(j) AS j, arg_min(name, j) AS name, arg_min(j + n, j) AS free FROM hits GROUP BY r, i UNION ALL
  SELECT t.r, t.i, min(h.j), arg_min(h.name, h.j), arg_min(h.j + h.n, h.j)
  FROM taken t JOIN hits h ON t.r = h.r AND t.i = h.i AND h.j >= t.free GROUP BY t.r, t.i),
listed AS (SELECT r, string_agg(name, ' ' ORDER BY i, j) AS ids FROM taken GROUP BY r),
paths AS (
  SELECT doc_id, coalesce(ids, '') AS ids, ' ' || coalesce(ids, '') || ' ' AS path FROM docs LEFT JOIN listed USING (r))
SELECT doc_id, CASE {license_} END AS license, CASE {reusable} END AS reusable, replace(ids, ' ', ',') AS sentence_ids,
  coalesce(array_to_string(list_filter(list_distinct_ordered, lambda x: x IS NOT NULL), ','), '') AS licenses
FROM (SELECT *, (SELECT list(n ORDER BY first_at) FROM (
    SELECT n, min(place) AS first_at FROM (
      SELECT unnest(l) AS n, generate_subscripts(l, 1) AS place) WHERE n IS NOT NULL GROUP BY n)) AS list_distinct_ordered
  FROM (SELECT *, [{every}] AS l FROM paths))
"""
