"""Licence sentences, names, SPDX expressions and rules, by known answers and by SQL."""

from __future__ import annotations

import re

import duckdb

from rasterloom.llm import license_scan, queries

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may
   be used to endorse or promote products derived from this software without
   specific prior written permission.
"""
GNU = """This {} is free software: you can redistribute it and/or modify it under the terms
of the GNU {} Public License as published by the Free Software Foundation; either
version {} of the License, or (at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies."""
CASES = [
    (BSD.format(""), "BSD-2-Clause"), (BSD.format(ENDORSE), "BSD-3-Clause"), (GNU.format("library", "Lesser General", "2.1"), "LGPL-2.1"), (GNU.format("program", "Affero General", "3"), "AGPL-3.0"),
    (GNU.format("library", "Lesser General", "3"), "LGPL-3.0"), (MPL, "MPL-2.0"), (ISC, "ISC"), ("This is free and unencumbered software released into the\npublic domain.", "Unlicense"),
    ("// SPDX: ISC", "ISC"), ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1"), ("SPDX-License-Identifier: CC0-1.0", "CC0-1.0"), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "Apache-2.0,MIT"),
    ("SPDX-License-Identifier: GPL-3.0-or-later OR MIT AND\n * BSD-2-Clause", "BSD-2-Clause,GPL-3.0,MIT"), ("SPDX-License-Identifier: MIT OR Mystery", ""), ("Licensed under the MIT license (see LICENSE).", "MIT"),
    ("Distributed under the Apache License 2.0.", "Apache-2.0"), ("This software is licensed under the terms of the\nGNU General Public License, version 2 or later; enjoy.", "GPL-2.0"), ("Dual licensed under the GPLv3.", "GPL-3.0"),
    ("Released under CC0 1.0 Universal", "CC0-1.0"), ("Published under a\nCreative Commons Attribution-ShareAlike 4.0 International License.", ""), ("The content is available under the Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Licensed under the new BSD license. Licensed under the\n\nUnlicense!", "BSD-3-Clause,Unlicense"), ("licensed under the mit license: see license", "MIT"), ("It was licensed under the MIT license.", ""), ("Licensed under the GPL.", "GPL"),
    ("licensed under the apache license, version 2.0\n(the \"License\");\nyou may not use this file except in compliance with the license...5 ok", "Apache-2.0"), (None, ""), ("", ""), ("licensed under \n" * 3000 + "mit", "MIT"), ("x " * 200_000 + "\nspdx mit", "MIT"),
]


def test_licences_by_known_answers_and_by_sql(spark, tmp_path):
    rows = [(i, text, "en", "s") for i, (text, _) in enumerate(CASES)] + [(1000, CASES[0][0], None, None), (1001, CASES[0][0], None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op8_license_scan(spark, str(tmp_path)).collect()))
    assert [r[3] for r in got] == [want for _, want in CASES] + ["BSD-2-Clause"] * 2
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(duck.execute(license_scan.ORACLE).fetchall()) == got


def test_every_known_sentence_is_found(spark):
    """Each sentence and name, alone and wrapped after each word, gives a licence or its part."""
    texts = [*license_scan.sentences(), *(f"released under the {n}" for n in license_scan.licence_names()), *(f"spdx {n}" for n in license_scan.spdx_names())]
    assert all(re.search(license_scan.MARKS, t) for t in texts) and len(texts) > 1000
    df = spark.createDataFrame([(i, t.replace(" ", s)) for i, t in enumerate(texts) for s in (" ", "\n * ")], "doc_id long, text string")
    got = license_scan.scan(df).select("text", "sentence_ids").collect()
    assert not [r.text for r in got if len(r.sentence_ids) != 1 or not r.sentence_ids[0]]


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "Released under the MIT license", "x", 1, "y")], "doc_id long, text string, sentence_ids string, rules int, licences string")
    assert license_scan.scan(df.limit(0)).count() == 0
    assert [r.licences for r in license_scan.scan(df).collect()] == [["MIT"]]
