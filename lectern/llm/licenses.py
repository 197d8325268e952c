"""Operator 2: licence scans by sentence rules. DataFrame functions only.

A text is cut into sentences (after . ; : ! ? before white space, and at lines without letters
and digits), each normalised to lower-case words of a-z and 0-9. What is looked up are whole
lines of a sentence, one or several in a row, the most lines first: a known sentence may be
wrapped, and stand after a line that has no mark at its end. Known sentences map to identifiers,
others are left out, and the sequence of identifiers is matched against the licence rules in order: a
rule that finds its identifiers in a row takes every such row out of the sequence, so that a
licence whose text begins like a longer one is only found where the longer one is not.

Defined results: null and empty texts have no sentences and no licence. A sentence known to
no rule is reported but makes no licence. Repeated rows are scanned one by one; an empty table
gives no rows. Only ``doc_id`` and ``text`` are looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit_notice": "Released under the MIT License.",
    "mit_licensed": "Licensed under the MIT License.",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache_notice": "Licensed under the Apache License, Version 2.0.",
    "apache_header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache_use": "you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at",
    "gpl3_notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2_notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl_free": "This program is free software:",
    "gpl3_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "ccbync4_notice": "Licensed under CC BY-NC 4.0.",
    "ccby4_notice": "Licensed under CC BY 4.0.",
    "ccbysa4_notice": "Licensed under CC BY-SA 4.0.",
    "ccby4_work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa4_work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2_notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "unlicense_grant": "This is free and unencumbered software released into the public domain.",
    "lgpl_free": "This library is free software:",
    "lgpl21_terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3_terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3_terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc0_dedication": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "apache_title": "Apache License Version 2.0, January 2004",
    "apache_copyright": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "reserved": "All rights reserved.",
}
#: Identifiers that a line of its own may name.
NAMED = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "Unlicense"]
SENTENCES |= {f"named_{name.lower()}": f"SPDX-License-Identifier {name}" for name in NAMED}
#: Licences and the identifiers that make them, in the order in which they are tried.
RULES = [
    ("MIT", ("mit_grant", "mit_condition")),
    ("MIT", ("mit_notice",)),
    ("MIT", ("mit_licensed",)),
    ("Apache-2.0", ("apache_header", "apache_use", "apache_copy")),
    ("Apache-2.0", ("apache_notice",)),
    ("Apache-2.0", ("apache_header",)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl3_terms")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_terms")),
    ("GPL-3.0-only", ("gpl3_notice",)),
    ("GPL-2.0-only", ("gpl2_notice",)),
    ("CC-BY-NC-4.0", ("ccbync4_notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4_notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4_work",)),
    ("CC-BY-4.0", ("ccby4_notice",)),
    ("CC-BY-4.0", ("ccby4_work",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant",)),
    ("ISC", ("isc_grant",)),
    ("MPL-2.0", ("mpl2_notice",)),
    ("Unlicense", ("unlicense_grant",)),
    ("LGPL-2.1-or-later", ("lgpl_free", "lgpl21_terms")),
    ("LGPL-3.0-or-later", ("lgpl_free", "lgpl3_terms")),
    ("LGPL-3.0-or-later", ("gpl_free", "lgpl3_terms")),
    ("AGPL-3.0-or-later", ("gpl_free", "agpl3_terms")),
    ("CC0-1.0", ("cc0_dedication",)),
    ("Apache-2.0", ("apache_title",)),
    ("Apache-2.0", ("apache_copyright",)),
    *[(name, (f"named_{name.lower()}",)) for name in NAMED],
]
#: Every known sentence has one of these; texts without any are not cut into sentences.
CLUE = "(?i)licen|permi|redistribut|copy|copies|software|reserved"
BREAK = r"[.;:!?]+(?:\s+|$)|\n"
#: The mark after these words ends no sentence.
JOINED = "(?i)(SPDX-License-Identifier):[ \\t]*"


def normalised(sentence: str) -> str:
    return " ".join(re.findall(r"[a-z0-9]+", sentence.lower()))


def parts() -> dict[str, str]:
    """Normalised sentence -> identifier. A known sentence that the cut splits goes by its parts, numbered but for the last."""
    out = {}
    for name, sentence in SENTENCES.items():
        cut = [n for x in re.split(BREAK, sentence) if (n := normalised(x))]
        for i, part in enumerate(cut):
            out.setdefault(part, name if i == len(cut) - 1 else f"{name}.{i}")
    return out


def sequence(names: tuple[str, ...]) -> str:
    """The identifiers of a rule's sentences, those of their parts included, as they stand in a text's sequence."""
    known = parts()
    ids = [known[n] for name in names for x in re.split(BREAK, SENTENCES[name]) if (n := normalised(x))]
    return ",,".join(ids).join(",,")


def wrapped(known: dict[str, str]) -> str:
    """A pattern of known sentences in ``running`` text, longest first: from a line's or sentence's start to such an end."""
    each = sorted(known, key=lambda k: (-len(k), k))
    return f"(?<![^|\\n])(?:{'|'.join(k.replace(' ', '[ \\n]') for k in each)})(?![^|\\n])"


def running(text: Column) -> Column:
    """The words of a text with one blank, line end or | (end of a sentence) between each two."""
    out = F.translate(F.regexp_replace(text, JOINED, "$1 "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ|", "abcdefghijklmnopqrstuvwxyz ")
    for pattern, to in ((r"[.;:!?]+(?:\s+|$)", "|"), (r"[^a-z0-9|\n]+", " "), (r" *([|\n]) *", "$1"), (r"\n\n+", "|")):
        out = F.regexp_replace(out, pattern, to)
    return F.btrim(out)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licenses): identifiers in the order of the text, licences in the order of the rules."""
    known = parts()
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found = F.regexp_extract_all(running(F.coalesce("text", F.lit(""))), F.lit(wrapped(known)), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(lookup, F.translate(s, "\n", " ")))
    ids = F.when(F.col("text").rlike(CLUE), ids).otherwise(F.array().cast("array<string>"))
    out = docs.select("doc_id", ids.alias("ids"))
    out = out.select("doc_id", "ids", F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(",")).alias("_seq0"))
    for i, (_, names) in enumerate(RULES):
        out = out.withColumn(f"_seq{i + 1}", F.replace(F.col(f"_seq{i}"), F.lit(sequence(names)), F.lit("#")))
    found = [F.when(F.col(f"_seq{i + 1}") != F.col(f"_seq{i}"), F.lit(name)) for i, (name, _) in enumerate(RULES)]
    return out.select("doc_id", F.col("ids").alias("sentence_ids"), F.array_distinct(F.array_compact(F.array(*found))).alias("licenses"))


def report(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in parts().items())
    steps, last = [], "s0"
    for i, (_, names) in enumerate(RULES):
        steps.append(f"r{i} AS (SELECT *, replace({last}, {quote(sequence(names))}, '#') AS s{i + 1} FROM {'q' if i == 0 else f'r{i - 1}'})")
        last = f"s{i + 1}"
    hits = ", ".join(f"CASE WHEN s{i + 1} <> s{i} THEN {quote(name)} END" for i, (name, _) in enumerate(RULES))
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
cut AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '{JOINED}', '\\1 ', 'g'), '{BREAK}') AS parts FROM documents),
each AS (SELECT r, p, trim(regexp_replace(lower(parts[p + 1]), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM cut, unnest(range(0, len(parts))) AS t(p)),
ids AS (SELECT r, list(id ORDER BY p) AS ids FROM each JOIN known USING (sentence) GROUP BY r),
q AS (SELECT doc_id, coalesce(ids, []) AS ids, ',' || array_to_string(coalesce(ids, []), ',,') || ',' AS s0 FROM cut LEFT JOIN ids USING (r)),
{", ".join(steps)},
f AS (SELECT *, [{hits}] AS hits FROM r{len(RULES) - 1})
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       array_to_string([hits[i] FOR i IN range(1, len(hits) + 1) IF hits[i] IS NOT NULL AND list_position(hits, hits[i]) = i], ',') AS licenses
FROM f
"""
