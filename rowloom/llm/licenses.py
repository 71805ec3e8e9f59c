"""Licence recognition by sentences and ordered rules, in DataFrame functions only.

A text is brought to normal form: lower case, everything but letters, digits,
``+`` and ``.`` before a digit becomes one space, so comment marks and quotes
vanish.  A sentence begins and ends at a line end, a blank line, or behind one
of ``. ! ? ; :`` and a space; a known one may run over line ends, ``;`` and
``:``, however it is wrapped.  Known licence sentences, in normal form too, are
mapped to identifiers.  A rule is an ordered list of identifiers, some optional;
it matches where they follow each other among the document's recognised
sentences, with other text allowed between but no other licence sentence.  Rules
are ordered: a longer rule comes first and uses up its sentences.

The sentence table is a fixed literal of under two hundred entries, so the whole
operator is one projection: no shuffle, no join, no Python.

A null or empty text has no licence; a text of any length is searched whole; of
known sentences that begin together the longest wins; repeated rows get equal
results; an empty table gives an empty result; columns other than id and text
are not read, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier, then a sentence of a licence or notice.
SENTENCES = """
apache-notice: Licensed under the Apache License, Version 2.0
apache-notice: Licensed under the Apache License, Version 2.0 (the "License")
apache-may-not: you may not use this file except in compliance with the License
apache-copy-at: You may obtain a copy of the License at
apache-copy-at: You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
apache-copy-at: You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0
apache-as-is: Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS
apache-as-is: Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied
apache-limits: See the License for the specific language governing permissions and limitations under the License
apache-title: Apache License Version 2.0, January 2004
apache-title: Apache License Version 2.0, January 2004 http://www.apache.org/licenses/
apache-terms: "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document
mit-notice: Released under the MIT License
mit-notice: Licensed under the MIT license
mit-notice: This project is licensed under the MIT license
mit-title: The MIT License
mit-title: MIT License
mit-title: The MIT License (MIT)
mit-grant: Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit-grant: Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions
mit-keep: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software
mit-warranty: THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT
mit0-grant: Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so
x11-names: Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium
boost-title: Boost Software License - Version 1.0 - August 17th, 2003
boost-notice: Distributed under the Boost Software License, Version 1.0
boost-grant: Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following
isc-title: ISC License
isc-grant: Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
isc-grant: Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
0bsd-grant: Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
isc-warranty: THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
postgresql-grant: Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies
zlib-as-is: This software is provided 'as-is', without any express or implied warranty
zlib-liable: In no event will the authors be held liable for any damages arising from the use of this software
zlib-grant: Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions
unlicense-domain: This is free and unencumbered software released into the public domain
wtfpl-title: DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
bsd-notice: Released under the BSD license
bsd-notice: Licensed under the BSD license
bsd2-title: BSD 2-Clause License
bsd3-title: BSD 3-Clause License
bsd-redistribute: Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
bsd-source: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
bsd-binary: Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution
bsd3-endorse: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd3-endorse: Neither the name of the copyright owner nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd3-endorse: Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd3-endorse: Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd4-advertise: All advertising materials mentioning features or use of this software must display the following acknowledgement
gpl3-notice: This work is licensed under the GNU General Public License, version 3
gpl3-notice: Licensed under the GNU General Public License version 3
gpl2-notice: Licensed under the GNU General Public License version 2
lgpl3-notice: Licensed under the GNU Lesser General Public License version 3
lgpl21-notice: Licensed under the GNU Lesser General Public License version 2.1
agpl3-notice: Licensed under the GNU Affero General Public License version 3
gpl-free: This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation
gpl2-free: This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version
gpl3-free: This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version
agpl3-free: This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version
lgpl21-free: This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version
lgpl3-free: This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version
gpl-warranty: This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY
lgpl-warranty: This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY
gpl2-title: GNU GENERAL PUBLIC LICENSE Version 2, June 1991
gpl3-title: GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007
lgpl21-title: GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999
lgpl3-title: GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007
agpl3-title: GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007
gpl3-refers: "This License" refers to version 3 of the GNU General Public License
agpl3-refers: "This License" refers to version 3 of the GNU Affero General Public License
lgpl3-refers: As used herein, "this License" refers to version 3 of the GNU Lesser General Public License, and the "GNU GPL" refers to version 3 of the GNU General Public License
gpl2-applies: This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License
lgpl21-applies: This License Agreement applies to any software library or other program which contains a notice placed by the copyright holder or other authorized party saying it may be distributed under the terms of this Lesser General Public License (also called "this License")
mpl2-notice: This Source Code Form is subject to the terms of the Mozilla Public License, v
mpl2-title: Mozilla Public License Version 2.0
mpl2-title: Mozilla Public License, version 2.0
mpl2-contributor: "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software
epl2-notice: This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
epl2-notice: This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/
epl2-title: Eclipse Public License - v 2.0
cddl-title: COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0
artistic2-title: The Artistic License 2.0
ofl-title: SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007
ofl-notice: This Font Software is licensed under the SIL Open Font License, Version 1.1
cc-by-nc4-notice: Licensed under CC BY-NC 4.0
cc-by4-notice: Licensed under CC BY 4.0
cc-by-sa4-notice: Licensed under CC BY-SA 4.0
cc-by4-notice: This work is licensed under a Creative Commons Attribution 4.0 International License
cc-by-sa4-notice: This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License
cc-by-nc4-notice: This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License
cc-by4-notice: Creative Commons Attribution 4.0 International Public License
cc-by-sa4-notice: Creative Commons Attribution-ShareAlike 4.0 International Public License
cc-by-nc4-notice: Creative Commons Attribution-NonCommercial 4.0 International Public License
cc-by-nd4-notice: This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License
cc-by-nc-sa4-notice: This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License
cc-by-nc-nd4-notice: This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License
cc0-notice: This work is dedicated to the public domain under CC0 1.0
cc0-notice: CC0 1.0 Universal
cc0-work: A Work made available under CC0 may be protected by copyright and related or neighboring rights ("Copyright and Related Rights")
reserved: All rights reserved
"""

#: Licence, kind, then the rule's identifiers in order, ``?`` behind optional ones; earlier rules win.
RULES = """
Apache-2.0 permissive: apache-notice apache-may-not apache-copy-at? apache-as-is? apache-limits?
Apache-2.0 permissive: apache-title? apache-terms
Apache-2.0 permissive: apache-title
Apache-2.0 permissive: apache-notice
MIT permissive: mit-title? reserved? mit-grant mit-keep? mit-warranty? x11-names?
MIT-0 permissive: mit0-grant mit-warranty?
BSL-1.0 permissive: boost-title? boost-grant
ISC permissive: isc-title? reserved? isc-grant isc-warranty?
0BSD permissive: 0bsd-grant isc-warranty?
PostgreSQL permissive: reserved? postgresql-grant
Zlib permissive: zlib-as-is? zlib-liable? zlib-grant
BSD-4-Clause permissive: reserved? bsd-redistribute bsd-source? bsd-binary? bsd4-advertise bsd3-endorse?
BSD-3-Clause permissive: bsd3-title? reserved? bsd-redistribute bsd-source? bsd-binary? bsd3-endorse
BSD-2-Clause permissive: bsd2-title? reserved? bsd-redistribute bsd-source? bsd-binary?
AGPL-3.0 copyleft: agpl3-title? agpl3-refers
AGPL-3.0 copyleft: agpl3-free gpl-warranty?
AGPL-3.0 copyleft: agpl3-title
AGPL-3.0 copyleft: agpl3-notice
LGPL-3.0 copyleft: lgpl3-title? lgpl3-refers
LGPL-3.0 copyleft: lgpl3-free lgpl-warranty?
LGPL-3.0 copyleft: lgpl3-title
LGPL-3.0 copyleft: lgpl3-notice
LGPL-2.1 copyleft: lgpl21-title? lgpl21-applies
LGPL-2.1 copyleft: lgpl21-free lgpl-warranty?
LGPL-2.1 copyleft: lgpl21-title
LGPL-2.1 copyleft: lgpl21-notice
GPL-3.0 copyleft: gpl3-title? gpl3-refers
GPL-3.0 copyleft: gpl3-notice? gpl3-free gpl-warranty?
GPL-3.0 copyleft: gpl3-notice gpl-free gpl-warranty?
GPL-3.0 copyleft: gpl3-title
GPL-3.0 copyleft: gpl3-notice
GPL-2.0 copyleft: gpl2-title? gpl2-applies
GPL-2.0 copyleft: gpl2-notice? gpl2-free gpl-warranty?
GPL-2.0 copyleft: gpl2-notice gpl-free gpl-warranty?
GPL-2.0 copyleft: gpl2-title
GPL-2.0 copyleft: gpl2-notice
GPL copyleft: gpl-free gpl-warranty?
MPL-2.0 copyleft: mpl2-title? mpl2-contributor mpl2-notice?
MPL-2.0 copyleft: mpl2-title? mpl2-notice
MPL-2.0 copyleft: mpl2-title
EPL-2.0 copyleft: epl2-notice
EPL-2.0 copyleft: epl2-title
CDDL-1.0 copyleft: cddl-title
Artistic-2.0 permissive: artistic2-title
OFL-1.1 permissive: ofl-notice? ofl-title
OFL-1.1 permissive: ofl-notice
BSL-1.0 permissive: boost-notice
BSL-1.0 permissive: boost-title
ISC permissive: isc-title
MIT permissive: mit-notice
MIT permissive: mit-title
BSD-2-Clause permissive: bsd2-title
BSD-3-Clause permissive: bsd3-title
BSD permissive: bsd-notice
Unlicense permissive: unlicense-domain
WTFPL permissive: wtfpl-title
CC-BY-NC-ND-4.0 restricted: cc-by-nc-nd4-notice
CC-BY-NC-SA-4.0 restricted: cc-by-nc-sa4-notice
CC-BY-NC-4.0 restricted: cc-by-nc4-notice
CC-BY-ND-4.0 restricted: cc-by-nd4-notice
CC-BY-SA-4.0 copyleft: cc-by-sa4-notice
CC-BY-4.0 permissive: cc-by4-notice
CC0-1.0 permissive: cc0-notice? cc0-work
CC0-1.0 permissive: cc0-notice
"""

#: Identifiers that a line ``SPDX-License-Identifier:`` may name, by kind.  GNU ones also end in -only or -or-later.
SPDX = {
    "permissive": "MIT MIT-0 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD ISC Zlib BSL-1.0 Unlicense WTFPL CC0-1.0 CC-BY-4.0 Artistic-2.0 OFL-1.1 PostgreSQL Python-2.0 NCSA MS-PL",
    "copyleft": "GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 EUPL-1.2 CC-BY-SA-4.0 ODbL-1.0",
    "restricted": "CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 BUSL-1.1 SSPL-1.0",
}
#: What is left over at the end.
LAST_RULE = ("Proprietary", "restricted", ["reserved"])
#: Each known sentence holds one of these.
HINT = "(?i)licen[sc]|copyright|permission|reserved|redistribut|warrant|unencumbered|advertising|liable|authorization|covered|cc0"


def normal(sentence: str) -> str:
    """Normal form of one sentence."""
    return " ".join(re.sub(r"[^a-z0-9+.]+|\.(?![0-9])", " ", sentence.lower()).split())


def known_sentences() -> dict[str, str]:
    """Normal form -> identifier."""
    out = {normal(form): name for name, form in (x.split(": ", 1) for x in SENTENCES.strip().splitlines())}
    for ids in SPDX.values():
        for x in ids.split():
            for end in ("", "-only", "-or-later") if "GPL" in x else ("",):
                out[normal(f"SPDX-License-Identifier {x}{end}")] = f"spdx-{x.lower()}"
    return out


def rules() -> list[tuple[str, str, list[str]]]:
    """(licence, kind, identifiers) in order."""
    out = []
    for line in RULES.strip().splitlines():
        head, ids = line.split(": ", 1)
        out.append((*head.split(), ids.split()))
    return out + [(x, kind, [f"spdx-{x.lower()}"]) for kind, ids in SPDX.items() for x in ids.split()] + [LAST_RULE]


def rule_pattern(ids: list[str]) -> str:
    """Pattern of a rule over identifiers that are each written between two spaces."""
    return "".join(f"(?: {re.escape(x[:-1])} )?" if x.endswith("?") else f" {re.escape(x)} " for x in ids).replace("\\-", "-")


def any_form() -> str:
    """Pattern of every known sentence; words may be wrapped, and ``;`` or ``:`` fall within.  Longest first."""
    forms = sorted(known_sentences(), key=lambda f: (-len(f), f))
    return "|".join(f.replace("+", r"\+").replace(".", r"\.").replace(" ", r"[ \n\x02]+") for f in forms)


def identifiers(text: Column) -> Column:
    """Identifiers of the licence sentences of a text, in order; null if it has no hint of any."""
    known = F.create_map(*[F.lit(v) for pair in known_sentences().items() for v in pair])
    # \x01 ends a sentence, \x02 stands after ; or :, which like a line end may fall within one
    s = F.regexp_replace(F.translate(F.lower(text), "\x01\x02", "  "), r"(?<=[.!?])[\x20\t]", "\x01")
    s = F.regexp_replace(s, r"(?<=[;:])[\x20\t]", "\x02")
    s = F.regexp_replace(s, r"[^a-z0-9+.\n\x01\x02]+|\.(?![0-9])", " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r" {2,}", " "), r" ?([\n\x01\x02]) ?", "$1"))
    s = F.regexp_replace(s, r"\n{2,}", "\x01")
    found = F.regexp_extract_all(s, F.lit(rf"(?<![^\n\x01\x02])(?:{any_form()})(?![^\n\x01\x02])"), F.lit(0))
    ids = F.transform(found, lambda x: F.element_at(known, F.regexp_replace(x, r"[ \n\x02]+", " ")))
    return F.when(text.rlike(HINT), ids)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_sentences, sentence_ids, licenses, kinds)`` of every whole text.

    ``licenses`` and ``kinds`` join the distinct matches by comma, in rule order.
    """
    ids = identifiers(F.coalesce(F.col(text_col), F.lit("")))
    df = df.select(F.col(id_col).alias("doc_id"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    left = F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))
    every = rules()
    # folded over the rules, as an array of (rule, pattern): state is what is left of the sentences and what was found
    table = F.array(*[F.struct(F.lit(rule_pattern(r)).alias("p"), F.lit(x).alias("licence"), F.lit(k).alias("kind")) for x, k, r in every])
    none = F.array().cast("array<string>")
    zero = F.struct(left.alias("left"), none.alias("licences"), none.alias("kinds"))

    def step(acc: Column, r: Column) -> Column:
        hit = F.regexp_like(acc["left"], r["p"])
        more = F.struct(
            F.regexp_replace(acc["left"], r["p"], F.lit(" | ")).alias("left"),
            F.array_union(acc["licences"], F.array(r["licence"])).alias("licences"), F.array_union(acc["kinds"], F.array(r["kind"])).alias("kinds"),
        )
        return F.when(hit, more).otherwise(acc)

    found = F.aggregate(table, zero, step)
    df = df.withColumn("found", F.when(F.size("ids") > 0, found))
    joined = lambda f: F.coalesce(F.array_join(F.col("found")[f], ","), F.lit(""))
    return df.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
        joined("licences").alias("licenses"), joined("kinds").alias("kinds"),
    )


def oracle() -> str:
    """The same in DuckDB SQL: the same tables, sentences found by one pattern, rules applied one after another."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"{quote(form)}: {quote(name)}" for form, name in known_sentences().items())
    every = rules()
    steps = ["s0 AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS rest FROM found)"]
    for k, (_, _, ids) in enumerate(every):
        p = quote(rule_pattern(ids))
        steps.append(f"s{k + 1} AS (SELECT * EXCLUDE (rest), regexp_matches(rest, {p}) AS hit{k}, regexp_replace(rest, {p}, ' | ', 'g') AS rest FROM s{k})")

    def names(of: int) -> str:
        out = []
        for k, r in enumerate(every):
            # distinct names in the order of the first rule that hit
            earlier = [f"hit{j}" for j in range(k) if every[j][of] == r[of]]
            out.append(f"CASE WHEN hit{k}" + "".join(f" AND NOT {h}" for h in earlier) + f" THEN '{r[of]}' END")
        return f"array_to_string(list_filter([{', '.join(out)}], lambda x: x IS NOT NULL), ',')"

    form = any_form().replace("'", "''")
    return f"""
WITH hinted AS (SELECT doc_id, row_number() OVER () AS r, lower(text) AS s FROM documents WHERE regexp_matches(coalesce(text, ''), '{HINT}')),
cut AS (SELECT doc_id, r, regexp_replace(regexp_replace(replace(replace(s, chr(1), ' '), chr(2), ' '), '([.!?])[ \\t]', '\\1\x01', 'g'), '([;:])[ \\t]', '\\1\x02', 'g') AS s FROM hinted),
bare AS (SELECT doc_id, r, replace(regexp_replace(regexp_replace(s, '\\.([0-9])', '\x03\\1', 'g'), '[^a-z0-9+\\n\x01\x02\x03]+', ' ', 'g'), '\x03', '.') AS s FROM cut),
lines AS (SELECT doc_id, r, regexp_replace(trim(regexp_replace(regexp_replace(s, ' +', ' ', 'g'), ' ?([\\n\x01\x02]) ?', '\\1', 'g')), '\\n{{2,}}', '\x01', 'g') AS s FROM bare),
marked AS (SELECT doc_id, r, '\x01' || regexp_replace(s, '([\\n\x01\x02])', '\\1\\1', 'g') || '\x01' AS s FROM lines),
found AS (
  SELECT doc_id, list_transform(regexp_extract_all(s, '[\\n\x01\x02]({form})[\\n\x01\x02]', 1), lambda x: map_extract(MAP {{{known}}}, regexp_replace(x, '[ \\n\x02]+', ' ', 'g'))[1]) AS ids FROM marked
  UNION ALL SELECT doc_id, []::VARCHAR[] FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '{HINT}')),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       {names(0)} AS licenses, {names(1)} AS kinds
FROM s{len(every)}
"""
