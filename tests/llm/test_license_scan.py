from tessella.llm import license_scan as L

from .helpers import clashing, docs

HELD_OUT = {
    "This project is Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under CC BY 4.0": "cc-by", "licensed under CC BY-SA 4.0!": "cc-by-sa",
    "This work is licensed under the GNU General Public License, version 3.": "gpl", "Copyright 2020 X. All rights reserved.": "proprietary", "This code is released under the BSD license": "bsd",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
    "The license plate of the car was public.": "unknown", "We drove to the general store under the bridge.": "unknown", "": "unknown", "the of and": "unknown", "MIT students released a version": "unknown",
}

#: Families that share most of their words, titles inside sentences, and tags.
CLOSE = {
    'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License': 'lgpl',
    'Licensed under the GNU Lesser General Public License, version 3.': 'lgpl',
    'You should have received a copy of the GNU Affero General Public License along with this program.': 'agpl',
    'Released under the GNU Affero General Public License v3': 'agpl',
    'This work is licensed under CC BY-NC-SA 4.0': 'cc-by-nc-sa',
    'Licensed under CC BY-NC-SA 4.0.': 'cc-by-nc-sa',
    'Licensed under CC BY-NC-ND 4.0.': 'cc-by-nc-nd',
    'Licensed under CC BY-ND 4.0': 'cc-by-nd',
    'This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.': 'cc-by-nc-sa',
    'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.': 'cc-by-sa',
    'the company said all rights reserved seats were sold': 'unknown',
    'ask the MIT license office': 'unknown',
    'ISC License': 'isc',
    'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.': 'isc',
    'Distributed under the Boost Software License, Version 1.0.': 'boost',
    'SPDX-License-Identifier: BSL-1.0': 'boost',
    'SPDX-License-Identifier: EPL-2.0': 'epl',
    'Licensed under the EUPL, Version 1.2': 'eupl',
    'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0': 'epl',
    'SPDX-License-Identifier: LGPL-2.1-only': 'lgpl',
    'SPDX-License-Identifier: AGPL-3.0-or-later': 'agpl',
    'SPDX-License-Identifier: GPL-2.0-only': 'gpl',
    'Copyright (c) 2019-2023 The Example Company, Inc. All rights reserved.': 'proprietary',
    'All Rights Reserved': 'proprietary',
    'The MIT License (MIT)': 'mit',
    'her license to fish was granted free of charge': 'unknown',
    'this general publishes public letters under license': 'unknown',
    'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3': 'gpl',
}


def test_held_out_paragraphs():
    m = L.fitted()
    assert {p: m.predict(p)[0] for p in HELD_OUT} == HELD_OUT
    assert {p: m.predict(p)[0] for p in CLOSE} == CLOSE
    assert (m.weights == 0).mean() > 0.5 and len(m.grams) < L.VOCABULARY and m.error < 0.05 and 0.3 <= m.threshold <= 0.95


def test_plan_on_sentences_of_known_families(spark):
    """Without the model: every sentence is a document, found with its family or not at all."""
    cases = list((HELD_OUT | CLOSE).items())
    got = {r.doc_id: (r.families, r.paragraphs) for r in L.scanned_licences(docs(spark, [(i, "intro\n\n" + p) for i, (p, _) in enumerate(cases)])).collect()}
    for i, (p, family) in enumerate(cases):
        assert got[i] == (("", "") if family == "unknown" else (family, f"2:{family}")), p


def test_plan_equals_model(spark):
    ps = list(HELD_OUT)
    rows = [(1, "\n".join(ps)), (2, None), (3, ""), (4, "x " * 50_000 + "\n" + ps[1]), (4, "x " * 50_000 + "\n" + ps[1]), (5, ps[0] + "\n\n" + ps[0] + "\n" + ps[2])]
    df = clashing(docs(spark, rows), "line", "w", "th", "p", "g")
    m = L.fitted()
    for r in L.scanned_licences(df).collect():
        lines = (dict(rows)[r.doc_id] or "").split("\n")
        want = [(i, m.predict(x)[0]) for i, x in enumerate(lines) if m.predict(x)[0] != "unknown"]
        assert (r.n_licences, r.families, r.paragraphs) == (len(want), ",".join(sorted({f for _, f in want})), ",".join(f"{i}:{f}" for i, f in want)), r.doc_id
    assert L.scanned_licences(docs(spark, [])).collect() == []


def test_wrapped_notices_titles_and_tags(spark):
    import textwrap

    rows, want = [], []
    for family, texts in L.TEMPLATES.items():
        for t in texts:
            for width, mark in ((72, " * "), (40, "# "), (1, "")):
                if len(t.split()) > 10:
                    rows.append("intro\n\n" + "\n".join(mark + x for x in textwrap.wrap(t, width, break_long_words=False)) + "\n\nrest")
                    want.append(family)
    short = {"MIT License": "mit", "SPDX-License-Identifier: MIT": "mit", "GNU GENERAL PUBLIC LICENSE": "gpl", "// SPDX-License-Identifier: Apache-2.0": "apache", "BSD 3-Clause License": "bsd", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl"}
    rows, want = rows + list(short), want + list(short.values())
    split = ["Redistribution and use in source and binary\n\nforms with or without", "he works at mit\nand lost a driving license", "all\n\nrights\n\nreserved"]
    rows, want = rows + split, want + [""] * len(split)
    got = {r.doc_id: (r.families, r.n_licences) for r in L.scanned_licences(docs(spark, list(enumerate(rows)))).collect()}
    assert [(rows[i], got[i][0]) for i in range(len(rows)) if got[i][0] != want[i]] == []
    assert {got[i][1] for i in range(len(rows)) if want[i]} == {1}
