"""Licence scans by sentence rules.

Sentences of a text, joined over wrapped lines, are normalised and looked up among known licence sentences; some may run
on as the licence's own text does (VARIANTS), and headers that name their program are known by patterns (NOTICES). The sequence of identifiers found, in
order of place, is matched against ordered rules: a rule holds where its identifiers follow one another, other known
sentences and ordinary text in between allowed. Every rule that holds is reported, and `license` names the first by the
rules' own order.

Known sentences and rules are small tables with a stated bound; the texts move nowhere: their sentences are looked up in
an in-row map, and rules are matched by a pattern over the identifier sequence. No shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaspan.llm.scratch import table

#: Known sentences and rules ride in the plan as literals; more than this is refused.
MAX_KNOWN = 10_000

#: Identifier -> sentence, as it stands after normalisation (lower case, runs of other than letters,
#: digits and dots as one blank).
SENTENCES = {
    "apache-2": "licensed under the apache license version 2.0",
    "apache-copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-warranty": "the software is provided as is without warranty of any kind",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl-2": "this work is licensed under the gnu general public license version 2",
    "gpl-or-later": "or at your option any later version",
    "cc-by-nc-4": "licensed under cc by nc 4.0",
    "cc-by-sa-4": "licensed under cc by sa 4.0",
    "cc-by-4": "licensed under cc by 4.0",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted",
    "all-rights": "all rights reserved",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "boost-1": "distributed under the boost software license version 1.0",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "cc0-1": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
}
#: Fixed values, most specific first: (licence, identifiers in order).
RULES = [
    ("Apache-2.0 with notice", ["apache-2", "apache-copy"]),
    ("Apache-2.0", ["apache-2"]),
    ("MIT", ["mit-grant", "mit-warranty"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("GPL-3.0-or-later", ["gpl-3", "gpl-or-later"]),
    ("GPL-3.0", ["gpl-3"]),
    ("GPL-2.0-or-later", ["gpl-2", "gpl-or-later"]),
    ("GPL-2.0", ["gpl-2"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD", ["bsd-redistribution"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-2"]),
    ("Unlicense", ["unlicense"]),
    ("BSL-1.0", ["boost-1"]),
    ("Zlib", ["zlib-warranty", "zlib-origin"]),
    ("CC0-1.0", ["cc0-1"]),
    ("All rights reserved", ["all-rights"]),
]


#: What may follow a known sentence in the licence's own text, after normalisation (a pattern).
VARIANTS = {
    "apache-2": "(?: the license(?: you may not use .*)?| see .*)?",
    "mit-licensed": "(?: see .*)?",
    "mit-released": "(?: see .*)?",
    "apache-basis": " without warranties .*",
    "bsd-endorse": ".*",
    "boost-1": "(?: see .*)?",
    "zlib-origin": ".*",
    "cc0-1": ".*",
    "mit-grant": " and associated documentation files .*",
    "mit-warranty": " express or implied .*",
    "bsd-redistribution": " provided that the following conditions are met(?: .*)?",
}
_GPL = "(?:.{1,80} )?is free software you can redistribute it and or modify it under the terms of the gnu %s as published by the free software foundation either version %s of the license or at your option any later version"
#: Sentences of licence headers that name their program: identifier -> pattern of the whole sentence.
NOTICES = {
    "gpl-3-notice": _GPL % ("general public license", "3"),
    "gpl-2-notice": _GPL % ("general public license", "2"),
    "lgpl-3-notice": _GPL % ("lesser general public license", "3"),
    "lgpl-2.1-notice": _GPL % ("lesser general public license", "2.1"),
    "agpl-3-notice": _GPL % ("affero general public license", "3"),
    "bsd-endorse-named": "neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}
NOTICE_RULES = [
    ("AGPL-3.0-or-later", ["agpl-3-notice"]), ("LGPL-3.0-or-later", ["lgpl-3-notice"]), ("LGPL-2.1-or-later", ["lgpl-2.1-notice"]),
    ("GPL-3.0-or-later", ["gpl-3-notice"]), ("GPL-2.0-or-later", ["gpl-2-notice"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-named"]),
]
#: Their place among the rules: before the other GPL rules.
_AT = [name for name, _ in RULES].index("GPL-3.0-or-later")

#: Sentences end at line breaks, and at . ! or ? before white space.
BREAK = r"[\n\r]+|(?<=[.!?])\s+"
#: Wrapped sentences end at blank lines (comment marks aside), and at . ! or ? before white space, but not behind `v.`.
WRAPPED_BREAK = r"(?:\r?\n[ \t#*/;-]*){2,}|(?<=[.!?])(?<!\bv\.)\s+"
#: An address on a line of its own belongs to the sentence before it.
ADDRESS = r"(?i)(?<=\bat)[\s#*/;-]+(?=https?://)"


def normalised(sentence: Column) -> Column:
    """Lower case, runs of other than letters, digits and dots as one blank; a final dot goes with the punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), r"[^a-z0-9.]+", " "), r"\.+(?= |$)", ""))


def identifiers(text: Column, look: Column, patterns: dict[str, str]) -> Column:
    """The known sentences of a text in order: of each sentence joined over its lines, then of its lines by themselves.

    A joined sentence counts when it is a known one or fits a pattern; it is not counted again where a line has it."""

    def of(raw: Column) -> Column:
        lines = F.filter(F.transform(F.split(raw, BREAK), lambda s: look[normalised(s)]), lambda i: i.isNotNull())
        whole = normalised(raw)
        named = F.coalesce(look[whole], *[F.when(whole.rlike(f"^(?:{p})$"), F.lit(i)) for i, p in patterns.items()])
        return F.when(named.isNull() | F.array_contains(lines, F.coalesce(named, F.lit(""))), lines).otherwise(F.concat(F.array(named), lines))

    return F.flatten(F.transform(F.split(F.regexp_replace(text, ADDRESS, " "), WRAPPED_BREAK), of))


def _in_order(seq: list[str]) -> str:
    """A pattern over `|a|b|c|`: the identifiers of seq in their order, others in between allowed."""
    return r"\|" + r"\|(?:.*\|)?".join(f"\\Q{i}\\E" for i in seq) + r"\|"


def scan(docs: DataFrame, known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_known, sentence_ids, licenses, license; one row per row.

    known (identifier -> sentence in normal form) and rules (licence, identifiers in order), most specific first, are the
    table's; without them the published sentences, headers and rules of this module serve. Texts that are null, empty or
    without known sentences have n_known 0, empty arrays and a null license. Repeated
    rows are scanned alike; other columns are ignored.
    """
    notices = NOTICES if known is None else {}
    known = SENTENCES if known is None else known
    rules = RULES[:_AT] + NOTICE_RULES + RULES[_AT:] if rules is None else rules
    patterns = {i: f"\\Q{known[i]}\\E{p}" for i, p in VARIANTS.items() if i in known and known[i] == SENTENCES[i]} | notices
    if len(known) > MAX_KNOWN or len(rules) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known sentences or rules")
    look = F.create_map(*[F.lit(x) for i, s in known.items() for x in (s, i)])
    # the first three words of each known sentence make a cheap test: most texts never get split
    heads = {"[^a-z0-9]+".join(re.escape(w) for w in s.split(" ")[:3]) for s in [*known.values(), *(["is free software", "neither the name"] if notices else [])]}
    probe = "(?i)" + "|".join(sorted(heads))
    text = F.coalesce("text", F.lit(""))
    found = F.when(text.rlike(probe), identifiers(text, look, patterns))
    ids = F.coalesce(found, F.array().cast("array<string>"))
    out = docs.select("doc_id", ids.alias("sentence_ids"))
    line = F.concat(F.lit("|"), F.array_join("sentence_ids", "|"), F.lit("|"))
    held = [F.when(line.rlike(_in_order(seq)), F.lit(name)) for name, seq in rules]
    licenses = F.array_distinct(F.array_compact(F.array(*held)))
    out = out.withColumn("licenses", F.when(F.size("sentence_ids") > 0, licenses).otherwise(F.array().cast("array<string>")))
    return out.select("doc_id", F.size("sentence_ids").alias("n_known"), "sentence_ids", "licenses", F.try_element_at("licenses", F.lit(1)).alias("license"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`; arrays are joined with `|`."""
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_known", F.array_join("sentence_ids", "|").alias("sentence_ids"), F.array_join("licenses", "|").alias("licenses"), "license")


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES.items())

    def holds(seq: list[str]) -> str:
        return "regexp_matches('|' || ids || '|', '" + r"\|" + r"\|(?:.*\|)?".join(x.replace(".", r"\.") for x in seq) + r"\|')"

    cases = ", ".join(f"CASE WHEN {holds(seq)} THEN '{name}' END" for name, seq in RULES)
    return rf"""
WITH known(s, id) AS (VALUES {known}),
parts AS (
  SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS k
  FROM (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '[\n\r]+') AS a FROM documents)),
norm AS (
  SELECT doc_id, k, trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), '\.+( |$)', '\1', 'g')) AS s FROM parts),
hits AS (SELECT doc_id, string_agg(id, '|' ORDER BY k) AS ids, count(*) AS n FROM norm JOIN known USING (s) GROUP BY doc_id),
judged AS (SELECT doc_id, n, ids, list_filter([{cases}], lambda x: x IS NOT NULL) AS l FROM hits),
uniq AS (SELECT doc_id, n, ids, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM judged)
SELECT d.doc_id, CAST(coalesce(u.n, 0) AS INTEGER) AS n_known, coalesce(u.ids, '') AS sentence_ids,
  coalesce(array_to_string(u.l, '|'), '') AS licenses, u.l[1] AS license
FROM documents d LEFT JOIN uniq u USING (doc_id)
"""


SQL = _sql()
