"""Recognises licences in texts by their sentences, with column functions only.

A text is cut into pieces, which are normalised (lower case, only letters and digits, single spaces). A known licence
sentence is found where it is one piece, or neighbouring pieces that only a line end, ; or : divides, so wrapped lines
don't hide it. Known sentences have identifiers; a text becomes the sequence of the identifiers it holds, in order. Ordered rules name the
licence for a sequence of identifiers; longer rules come first and use up what they match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices, normalised, with an identifier for each.
SENTENCES = {
    # notices of one sentence
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "the mit license mit": "mit-title",
    "licensed under the apache license version 2 0": "apache2-notice",
    "released under the apache license version 2 0": "apache2-notice",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is licensed under the gnu general public license version 3": "gpl3-notice",
    "this work is licensed under the gnu general public license version 2": "gpl2-notice",
    "licensed under cc by 4 0": "cc-by-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "licensed under cc by nd 4 0": "cc-by-nd-4-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4-notice",
    "all rights reserved": "reserved",
    # MIT text
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-grant-and-condition",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    # ISC text
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    # BSD text
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    # Apache header
    "licensed under the apache license version 2 0 the license": "apache2-header",
    "you may not use this file except in compliance with the license": "apache2-use",
    "you may obtain a copy of the license at": "apache2-copy",
    # GPL header
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-plus-header",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-plus-header",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
}

#: Ordered rules: a sequence of identifiers and the licence it means. A sequence comes before those it contains.
RULES = (
    ("mit-title mit-grant mit-condition mit-warranty", "MIT"), ("mit-grant mit-condition mit-warranty", "MIT"),
    ("mit-title mit-grant-and-condition mit-warranty", "MIT"), ("mit-grant-and-condition mit-warranty", "MIT"),
    ("mit-grant mit-condition", "MIT"), ("mit-grant-and-condition", "MIT"),
    ("bsd-grant bsd-source bsd-binary bsd-names", "BSD-3-Clause"), ("bsd-grant bsd-source bsd-binary", "BSD-2-Clause"),
    ("bsd-grant bsd-source", "BSD-1-Clause"),
    ("apache2-header apache2-use apache2-copy", "Apache-2.0"), ("apache2-header apache2-use", "Apache-2.0"),
    ("gpl3-plus-header gpl-warranty", "GPL-3.0-or-later"), ("gpl2-plus-header gpl-warranty", "GPL-2.0-or-later"),
    ("gpl3-plus-header", "GPL-3.0-or-later"), ("gpl2-plus-header", "GPL-2.0-or-later"),
    ("isc-grant", "ISC"), ("mit-notice", "MIT"), ("apache2-notice", "Apache-2.0"), ("apache2-header", "Apache-2.0"),
    ("gpl3-notice", "GPL-3.0-only"), ("gpl2-notice", "GPL-2.0-only"), ("cc-by-4-notice", "CC-BY-4.0"),
    ("cc-by-sa-4-notice", "CC-BY-SA-4.0"), ("cc-by-nc-4-notice", "CC-BY-NC-4.0"), ("cc-by-nd-4-notice", "CC-BY-ND-4.0"),
    ("reserved", "all-rights-reserved"),
)
SENTENCE_END = r"[.;:!?]+(\s+|$)|\n\s*"
#: Steps that turn lower-case text into words with single spaces, "~" where a sentence may go on and "|" where it ends.
#: Runs are tried from their first character only, so that each step takes time in proportion to the text.
_STEPS = (
    (r"[|~]", " "),
    (r"(?:^|\n)[ \t]*(?:dnl|rem)(?![a-z0-9])", "\n"),  # comment marks of letters; others go with the punctuation
    (r"(?:^|\n)[^a-z0-9\n]*(?:[0-9]{1,2}|[a-z]|i{2,3}|iv)\)\s", "|"),  # list marks
    (r"(?<![.;:!?])[;:]*+[.!?][.;:!?]*+(?:\s++|$)", "|"),
    (r"\n[^a-z0-9\n|]*\n", "|"),  # a line without letters and digits
    (r"(?<![.;:!?])[;:]++(?:\s++|$)|\n", "~"),
    (r"[^a-z0-9|~]+", " "),
    (r"(?<![ ~|])[ ~]*+\|[ ~|]*+", "|"),
    (r"(?<![ ~])[ ]*+~[ ~]*+", "~"),
)
#: Any known sentence between two ends; of several at one place the shortest.
_KNOWN = "(?<=[|~])(?:" + "|".join(s.replace(" ", "[ ~]") for s in sorted(SENTENCES, key=len)) + ")(?=[|~])"


def pieces(text: Column) -> Column:
    """Normalised text with its ends; a null text has no words."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, mark in _STEPS[:-2]:
        out = F.regexp_replace(out, pattern, mark)
    out = F.concat(F.lit("|"), out, F.lit("|"))
    for pattern, mark in _STEPS[-2:]:
        out = F.regexp_replace(out, pattern, mark)
    return out


def identifiers(text: Column) -> Column:
    """The identifiers of known sentences of a text, in order."""
    table = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    found = F.regexp_extract_all(pieces(text), F.lit(_KNOWN), F.lit(0))
    return F.transform(found, lambda s: F.element_at(table, F.translate(s, "~", " ")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, identifiers, licences) of every row.

    identifiers: array of sentence identifiers in text order; licences: sorted distinct licence names that rules found.
    Sentences end at . ! ? before white space, at blank lines and list marks; they may also begin or end, or go on, at
    line ends and at ; and : before white space. Null, empty and licence-free texts give two empty
    arrays. Extra columns are ignored; a repeated key gives repeated rows. No shuffle.
    """
    seq = docs.select(F.col(key), identifiers(F.col(text)).alias("identifiers"))
    # each identifier stands between its own spaces, so rules match whole identifiers and never across used-up ones
    left = F.concat(F.lit(" "), F.concat_ws("  ", "identifiers"), F.lit(" "))
    state = seq.withColumn("left", left).withColumn("hits", F.array().cast("array<string>"))
    for rule, name in RULES:
        pattern = f" {rule.replace(' ', '  ')} "
        has = F.instr("left", pattern) > 0
        state = state.select(
            key, "identifiers", F.when(has, F.replace("left", F.lit(pattern), F.lit(" | "))).otherwise(F.col("left")).alias("left"),
            F.when(has, F.concat("hits", F.array(F.lit(name)))).otherwise(F.col("hits")).alias("hits"),
        )
    return state.select(key, "identifiers", F.array_sort(F.array_distinct("hits")).alias("licences"))


def oracle(table: str = "documents") -> str:
    """DuckDB's SQL for doc_id, identifiers and licences joined by commas, of texts that don't divide a known sentence.

    It cuts at every line end, ; and : (SENTENCE_END), so it misses sentences that are wrapped or divided there.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"{quote(s)}: {quote(i)}" for s, i in SENTENCES.items())
    listed = ", ".join(quote(s) for s in SENTENCES)
    sql = f"""WITH cut AS (
      SELECT doc_id, string_split_regex(lower(coalesce(text, '')), {quote(SENTENCE_END)}) AS s FROM {table}),
    named AS (
      SELECT doc_id, list_transform(list_filter(list_transform(s, lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))),
        lambda x: x IN ({listed})), lambda x: (MAP {{{known}}})[x]) AS ids FROM cut),
    r0 AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS l, []::VARCHAR[] AS hits FROM named)"""
    for k, (rule, name) in enumerate(RULES):
        p = quote(f" {rule.replace(' ', '  ')} ")
        sql += f""",
    r{k + 1} AS (SELECT doc_id, ids, replace(l, {p}, ' | ') AS l,
      CASE WHEN contains(l, {p}) THEN list_append(hits, {quote(name)}) ELSE hits END AS hits FROM r{k})"""
    return sql + f"""
    SELECT doc_id, len(ids) AS n_sentences, array_to_string(ids, ' ') AS identifiers,
      array_to_string(list_sort(list_distinct(hits)), ',') AS licences FROM r{len(RULES)}"""
