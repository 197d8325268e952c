import textwrap

import duckdb
import pandas as pd

from lectern.llm import licenses
from tests.llm.helpers import frame

GRANT = licenses.SENTENCES["bsd_grant"]


def found(spark, texts):
    return {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in licenses.report(frame(spark, texts)).collect()}


TEXTS = [
    None,
    "",
    "Nothing here. Copy that!",
    "Text.\nReleased  under the MIT license.\nMore text",
    "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n http://x",
    f"{GRANT}\n1. x\n{licenses.SENTENCES['bsd_endorse']}",
    f"{GRANT} nothing more",
    f"{licenses.SENTENCES['mit_grant']}\n\n{licenses.SENTENCES['mit_condition']} Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.",
    licenses.SENTENCES["gpl_free"] + " " + licenses.SENTENCES["gpl3_terms"],
    licenses.SENTENCES["gpl_free"] + " " + licenses.SENTENCES["gpl2_terms"],
    "All rights reserved.",
    "x. " * 5000 + "This work is licensed under the GNU General Public License, version 3.",
]


def test_rules(spark):
    got = found(spark, TEXTS)
    assert [got[i][1] for i in range(len(TEXTS))] == ["", "", "", "MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "MIT,CC-BY-NC-4.0", "GPL-3.0-or-later", "GPL-2.0-or-later", "", "GPL-3.0-only"]
    assert got[10][0] == "reserved"


def test_equals_oracle(spark):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS}))
    expected = sorted(con.sql(licenses.oracle()).fetchall())
    assert sorted(tuple(r) for r in licenses.report(frame(spark, TEXTS)).collect()) == expected


def test_wrapped_texts(spark):
    known = licenses.SENTENCES
    whole = [
        f"MIT License\n\nCopyright (c) 2020 A\n\n{known['mit_grant']}\n\n{known['mit_condition']}",
        f"Copyright 2020 A\n{known['isc_grant']}",
        f"Copyright 2020 A\n{known['bsd_grant']}\n\n1. x\n\n3. {known['bsd_endorse']}",
        f"{known['gpl_free']} {known['gpl2_terms']}",
        f"{known['gpl_free']} {known['gpl3_terms']}",
        f"{known['apache_header']} {known['apache_use']}\n{known['apache_copy']}\n\n    http://x",
        f"{known['unlicense_grant']}\nAnyone",
        f"{known['mpl2_notice']}. 2.0.",
    ]
    texts, expected = [], []
    names = ["MIT", "ISC", "BSD-3-Clause", "GPL-2.0-or-later", "GPL-3.0-or-later", "Apache-2.0", "Unlicense", "MPL-2.0"]
    for text, name in zip(whole, names, strict=True):
        for width, before, end in ((78, "", "\n"), (60, "# ", "\n"), (40, " * ", "\r\n")):
            lines = [line for one in text.split("\n") for line in textwrap.wrap(one, width) or [""]]
            texts.append(end.join(before + line for line in lines))
            expected.append(name)
    texts += ["Released under the\n\nMIT License.", "Released under the MIT License\nof old.", "not Released under the\nMIT License."]
    expected += ["", "MIT", ""]
    got = found(spark, texts)
    assert [got[i][1] for i in range(len(texts))] == expected


def test_every_known_sentence_has_a_clue():
    import re

    assert all(re.search(licenses.CLUE, part) for part in licenses.parts())
    names = set(licenses.SENTENCES)
    assert all(set(rule) <= names for _, rule in licenses.RULES)


def test_empty_table_and_repeated_rows(spark):
    docs = frame(spark, ["Released under the MIT License."] * 2, [1, 1]).selectExpr("*", "1 AS ids", "2 AS licenses")
    assert [r["licenses"] for r in licenses.report(docs).collect()] == ["MIT", "MIT"]
    assert licenses.report(docs.where("false")).count() == 0


def test_named_licences_and_full_texts(spark):
    texts = [
        "// SPDX-License-Identifier: MIT\nint main;",
        "# SPDX-License-Identifier: GPL-3.0-or-later",
        "Apache License\nVersion 2.0, January 2004\nhttp://example.org\n\n2. Grant. Subject to the terms and conditions of\nthis License, each Contributor hereby grants to You a perpetual,\nworldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright\nlicense to reproduce, prepare Derivative Works of, publicly display,\npublicly perform, sublicense, and distribute the Work and such Derivative\nWorks in Source or Object form.",
        "This program is free software: you can redistribute it and/or modify it under\nthe terms of the GNU Affero General Public License as published by the Free\nSoftware Foundation, either version 3 of the License, or (at your option) any\nlater version.",
        "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
        "a licence mit\nmit\nSPDX-License-Identifier: unknown",
    ]
    got = [r["licenses"] for r in licenses.report(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["MIT", "GPL-3.0-or-later", "Apache-2.0", "AGPL-3.0-or-later", "LGPL-2.1-or-later", ""]
