"""Licence recognition in verbatim texts, wrapped, unwrapped and in comments, and against the SQL twin."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from rowloom.llm import licenses

APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL3 = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
BSD3 = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
"""


def test_wrapped_texts(spark):
    texts = [APACHE, MIT, GPL3, BSD3, MPL, "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;", "# SPDX-License-Identifier: BSD-3-Clause", MIT.replace("\n", " "), APACHE.replace("\n# ", " ")]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert list(got[k] for k in range(len(texts))) == ["Apache-2.0", "MIT", "GPL-3.0", "BSD-3-Clause", "MPL-2.0", "GPL-2.0", "BSD-3-Clause", "MIT", "Apache-2.0"]


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER.
"""
BSD2 = """Copyright (c) 2021 Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
FOLDER = "/usr/share/common-licenses"
WHOLE = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def variants(text):
    """As it is, on one line, wrapped anew, and as comments of several kinds."""
    flat = " ".join(text.split())
    words, lines = flat.split(" "), []
    for k in range(0, len(words), 9):
        lines.append(" ".join(words[k : k + 9]))
    yield text
    yield flat
    yield "\n".join(lines)
    for before in ("# ", "// ", " * ", ";; ", "-- "):
        yield "\n".join(before + line for line in text.splitlines())
    yield "/*\n * " + "\n * ".join(lines) + "\n */\nint main() { return 0; }"
    yield "int x;\r\n" + text.replace("\n", "\r\n")


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: r for r in licenses.scan(df).collect()}


def test_texts_in_every_form(spark):
    texts = {"MIT": MIT, "ISC": ISC, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Zlib": ZLIB, "Apache-2.0": APACHE.replace("# ", "").replace("#", ""), "AGPL-3.0": AGPL}
    each = [(name, v) for name, t in texts.items() for v in variants(t)]
    got = scanned(spark, [v for _, v in each])
    wrong = [(name, got[k].licenses, v[:60]) for k, (name, v) in enumerate(each) if got[k].licenses != name]
    assert not wrong


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no licence texts at hand")
@pytest.mark.parametrize("name", list(WHOLE))
def test_whole_texts(spark, name):
    with open(f"{FOLDER}/{name}") as f:
        text = f.read()
    each = list(variants(text))
    got = scanned(spark, each)
    assert all(WHOLE[name] in got[k].licenses.split(",") for k in got), [got[k].licenses for k in sorted(got)]
    assert all(len(set(got[k].licenses.split(","))) == 1 for k in got), [got[k].licenses for k in sorted(got)]


def test_spdx_lines(spark):
    each = [(x, end) for ids in licenses.SPDX.values() for x in ids.split() for end in (("", "-only", "-or-later") if "GPL" in x else ("",))]
    got = scanned(spark, [f"// SPDX-License-Identifier: {x}{end}\nint x;" for x, end in each])
    assert [got[k].licenses for k in range(len(each))] == [x for x, _ in each]


def test_any_rows(spark, tricky, nothing):
    got = licenses.scan(tricky.withColumn("ids", F.lit(1)))
    assert got.count() == tricky.count() and got.where("licenses <> ''").count() == 0
    long = spark.createDataFrame([(1, "filler words " * 80_000 + ".\n" + MIT), (1, "filler words " * 80_000 + ".\n" + MIT), (None, None)], "doc_id long, text string")
    assert sorted(r.licenses for r in licenses.scan(long).collect()) == ["", "MIT", "MIT"]
    assert licenses.scan(nothing).count() == 0


def test_sql_twin_on_real_texts(spark):
    texts = [v for t in (MIT, ISC, BSD2, BSD3, ZLIB, APACHE, AGPL, GPL3, MPL) for v in variants(t)]
    texts += [t + u for t in (MIT, BSD3, APACHE) for u in (GPL3, MIT, ZLIB)] + ["", None, "a\x01b\x02 license", "License ..5 .6.7; x: y! z? MIT License"]
    if os.path.isdir(FOLDER):
        texts += [v for name in WHOLE for v in list(variants(open(f"{FOLDER}/{name}").read()))[:4]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = licenses.scan(df).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.sql(licenses.oracle()).df().sort_values("doc_id").reset_index(drop=True)[got.columns]
    assert got.astype(str).equals(want.astype(str))
