"""License scans by sentence rules, in DataFrame operations only.

Texts are cut into sentences, sentences are normalised, and those equal to a known license
sentence become its identifier.  A document's identifiers, in their order, are then matched
against license rules, each an ordered sequence of identifiers with optional parts; rules are
tried in their order and a stretch that one has claimed is closed to later ones.

The tables of sentences and rules are constants of this module, or given by the caller.  Up to
LIMIT sentences are part of the plan, and nothing is shuffled; more of them are a table of their
own that the texts' sentences are joined to.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: License sentences that may be part of a plan; a larger table is joined.
LIMIT = 1_000

#: License sentences as they are published, by identifier.
SENTENCES = {
    "M0": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT", "The MIT License (MIT)", "MIT License"],
    "M1": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "M2": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "W1": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "A0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: Apache-2.0", "Apache License", "Released under the Apache License, Version 2.0", "This project is licensed under the Apache License, Version 2.0"],
    "A1": ["you may not use this file except in compliance with the License"],
    "A2": ["You may obtain a copy of the License at"],
    "A3": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "A4": ["See the License for the specific language governing permissions and limitations under the License"],
    "G3": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU GENERAL PUBLIC LICENSE Version 3"],
    "G2": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "GP": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "GQ": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "GW": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "GS": ["You should have received a copy of the GNU General Public License along with this program"],
    "B1": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "B2": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "B3": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "B4": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "CN": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CB": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "Licensed under a Creative Commons Attribution 4.0 International License"],
    "CS": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"],
    "C0": ["This work is dedicated to the public domain under CC0 1.0", "Released under CC0 1.0"],
    "MP": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "IS": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "UN": ["All rights reserved"],
}

#: Licenses and the sequences of identifiers that tell them, tried in this order; `?` marks an optional part.
RULES = [
    ("MIT", "M0? M1 M2 W1?"), ("Apache-2.0", "A0 A1? A2 A3 A4?"), ("Apache-2.0", "A0 A1? A2?"), ("BSD-3-Clause", "B1 B2 B3 B4"), ("BSD-2-Clause", "B1 B2 B3"),
    ("GPL-3.0", "GP GW? GS?"), ("GPL-2.0", "GQ GW? GS?"), ("GPL-3.0", "G3"), ("GPL-2.0", "G2"), ("CC-BY-NC-4.0", "CN"), ("CC-BY-SA-4.0", "CS"), ("CC-BY-4.0", "CB"),
    ("CC0-1.0", "C0"), ("MPL-2.0", "MP"), ("ISC", "IS W1?"), ("MIT", "M0"), ("Proprietary", "UN"),
]

#: Sentences end at . ! ? ; before white space or the end, and at blank lines.
BY_PARAGRAPH = r"\r?\n[ \t]*\r?\n|[.!?;]+(?:[ \t\r\n]+|\z)"
OTHER, DOTS = r"[^a-z0-9.]+", r"\.+( |\z)|(^| )\.+"


def normalised(sentence: Column) -> Column:
    """Lower case (A-Z), runs of anything but letters and digits as one space; dots within numbers stay."""
    lower = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(F.regexp_replace(lower, OTHER, " "), DOTS, " "))


def _plain(sentence: str) -> str:
    """What `normalised` makes of the first sentence of a constant."""
    first = next(p for p in re.split(BY_PARAGRAPH.replace(r"\z", r"\Z"), sentence) if p.strip())
    lower = "".join(c.lower() if c in string.ascii_uppercase else c for c in first)
    return re.sub(DOTS.replace(r"\z", r"\Z"), " ", re.sub(OTHER, " ", lower)).strip(" ")


def sentence_map(sentences: dict[str, list[str]]) -> dict[str, str]:
    """Identifier by normalised sentence; of a published sentence with a stop inside, the first part stands for it."""
    return {_plain(text): name for name, texts in sorted(sentences.items(), reverse=True) for text in texts}


def _pattern(rule: str) -> str:
    return "".join(f"(?:<{part[:-1]}>)?" if part.endswith("?") else f"<{part}>" for part in rule.split())


def scan(docs: DataFrame, sentences: dict[str, list[str]] | None = None, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_sentences (known ones), sentence_ids and licenses.

    sentence_ids holds the identifiers in the order of the text, joined by spaces, and licenses
    the distinct licenses that rules found, sorted and joined by `|`; both are empty where there
    are none.  A text is read by paragraph (license texts may be wrapped), and what is no known
    sentence so is read by line, so that a text may hold licenses in either layout.  Needs doc_id and text; other
    columns are ignored.  A null text has no sentences; a null doc_id stays null; equal rows give
    equal rows; an empty table gives none.
    """
    known = sentence_map(SENTENCES if sentences is None else sentences)
    shortest = min(map(len, known), default=0)
    if len(known) > LIMIT:
        return _matched(_joined(docs, known, shortest), rules)
    names = F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair))
    # A normal form is never longer than its sentence.
    identifier = lambda s: F.when(F.length(s) >= shortest, F.element_at(names, normalised(s)))

    def identifiers(part: Column) -> Column:
        """Of a sentence by paragraph, or else of its lines: cuts by line are those by paragraph and line ends."""
        lines = F.filter(F.transform(F.split(part, r"[\r\n]+"), identifier), lambda x: x.isNotNull())
        whole = identifier(part)
        return F.when(whole.isNotNull(), F.array(whole)).when(part.rlike(r"[\r\n]"), lines).otherwise(F.array().cast("array<string>"))

    rows = _texts(docs)
    if not known:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_sentences"), F.lit("").alias("sentence_ids"), F.lit("").alias("licenses"))
    return _matched(rows.select("doc_id", F.flatten(F.transform(F.split("text", BY_PARAGRAPH), identifiers)).alias("ids")), rules)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _matched(rows: DataFrame, rules: list[tuple[str, str]] | None) -> DataFrame:
    """The scan's columns for rows of doc_id and ids."""
    claimed = F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    for name, rule in RULES if rules is None else rules:
        claimed = F.regexp_replace(claimed, _pattern(rule), f"[{name}]")
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(claimed, F.lit(r"\[([^\]]+)\]"), F.lit(1))))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"), F.array_join(found, "|").alias("licenses"))


def _joined(docs: DataFrame, known: dict[str, str], shortest: int) -> DataFrame:
    """doc_id and ids by a join: distinct sentences and lines of at least the shortest length meet the table, and the known ones their texts."""
    spark = docs.sparkSession
    names = spark.createDataFrame(sorted(known.items()), "normal string, name string")
    # Fixed by writing, as the numbers tell rows apart.
    rows = stored(_texts(docs).withColumn("no", F.monotonically_increasing_id()), "license-texts")
    parts = rows.select("no", F.posexplode(F.split("text", BY_PARAGRAPH)).alias("at", "part")).where(F.length("part") >= shortest)
    lines = parts.where(F.col("part").rlike(r"[\r\n]")).select("no", "at", F.posexplode(F.split("part", r"[\r\n]+")).alias("line", "s"))
    tried = parts.select("no", "at", F.lit(-1).alias("line"), "part").union(lines.where(F.length("s") >= shortest)).toDF("no", "at", "line", "s")
    hits = tried.withColumn("normal", normalised(F.col("s"))).join(names, "normal").select("no", "at", "line", "name")
    found = hits.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("at", "line", "name"))).alias("hits"))
    # A known sentence stands for its lines.
    whole = F.transform(F.filter("hits", lambda h: h["line"] < 0), lambda h: h["at"])
    ids = F.transform(F.filter("hits", lambda h: (h["line"] < 0) | ~F.array_contains(F.col("whole"), h["at"])), lambda h: h["name"])
    found = found.withColumn("whole", whole).select("no", ids.alias("ids"))
    return rows.select("no", "doc_id").join(found, "no", "left").select("doc_id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def sql() -> str:
    """The scan of documents for DuckDB: by paragraph, and by line what is no known sentence so."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = sentence_map(SENTENCES)
    names = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in sorted(known.items())) + "}"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    known_as = lambda x: f"n.names[trim(regexp_replace(regexp_replace({lower(x)}, '{OTHER}', ' ', 'g'), '{DOTS}', ' ', 'g'))]"
    lines = f"list_filter(list_transform(string_split_regex(p, '[\\r\\n]+'), lambda s: {known_as('s')}), lambda x: x IS NOT NULL)"
    parts = f"list_transform(string_split_regex(coalesce(text, ''), '{BY_PARAGRAPH}'), lambda p: CASE WHEN {known_as('p')} IS NOT NULL THEN [{known_as('p')}] ELSE {lines} END)"
    claimed = "list_aggregate(list_transform(ids, lambda x: '<' || x || '>'), 'string_agg', '')"
    for name, rule in RULES:
        claimed = f"regexp_replace({claimed}, '{_pattern(rule)}', '[{name}]', 'g')"
    return rf"""
        WITH n AS (SELECT {names} AS names),
        i AS (SELECT doc_id, flatten({parts}) AS ids FROM documents, n),
        c AS (SELECT doc_id, ids, coalesce({claimed}, '') AS claimed FROM i)
        SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(list_aggregate(ids, 'string_agg', ' '), '') AS sentence_ids,
               coalesce(list_aggregate(list_sort(list_distinct(regexp_extract_all(claimed, '\[([^\]]+)\]', 1))), 'string_agg', '|'), '') AS licenses
        FROM c"""
