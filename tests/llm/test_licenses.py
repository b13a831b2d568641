import re

from glossa.llm import licenses as li

#: Licence texts as projects carry them, not put together from the operator's tables.
MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty.
Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not
claim that you wrote the original software.
Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_every_known_sentence_has_a_stem():
    assert all(re.search(li.STEMS, s.lower()) for s in li.sentences()) and len(li.sentences()) > 300


def test_rules_name_known_sentences():
    known = set(li.sentences().values())
    named = {i for _, _, rule in li.RULES for x in rule for i in x.split("|")}
    assert {i for i in named if not i.startswith(("name-", "spdx-"))} <= known
    assert set(li.NAMES.values()) == {i[5:] for i in named if i.startswith("name-")}


def test_scan(spark):
    s = li.SENTENCES
    wrapped = s["apache-use"].replace(" ", "\n", 7) + ". " + s["apache-obtain"] + ".  " + s["apache-basis"] + ". " + s["apache-see"] + "."
    rows = [
        (1, "Some words\nReleased under the MIT License.\nmore"), (2, MIT), (3, wrapped), (4, None), (5, ""), (6, "licensed to nobody"),
        (7, "x. Licensed under CC BY-NC 4.0. This work is licensed under the GNU General Public License, version 3. y"),
        (8, "\n".join(s[f"bsd-{k}"] for k in ("use", "source", "binary", "name"))), (9, "\n".join(s[f"bsd-{k}"] for k in ("use", "source", "binary"))), (10, "\n".join(s[f"bsd-{k}"] for k in ("use", "binary", "source"))),
        (11, "Released under the MIT License. " * 3), (12, MPL), (13, LGPL), (14, ZLIB), (15, "# SPDX-License-Identifier: AGPL-3.0-or-later\ncode"), (16, "SPDX-License-Identifier: AGPL-3.0-or-later\ncode"),
        (17, "This file is released under the BSD 3-Clause License."), (18, "intro " * 200_000 + "\nDistributed under the Unlicense."), (19, "This file is released under the BSD 3-Clause License."),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, line_ids string, licences int")
    got = {r["doc_id"]: r for r in li.scan(docs).collect()}
    assert {k: r["licences"] for k, r in got.items()} == {
        1: "MIT-notice", 2: "MIT", 3: "Apache-2.0", 4: "", 5: "", 6: "", 7: "CC-BY-NC-4.0,GPL-3.0-notice", 8: "BSD-3-Clause", 9: "BSD-2-Clause", 10: "", 11: "MIT-notice", 12: "MPL-2.0", 13: "LGPL-2.1-or-later", 14: "Zlib",
        15: "AGPL-3.0-notice", 16: "AGPL-3.0-notice", 17: "BSD-3-Clause-notice", 18: "Unlicense", 19: "BSD-3-Clause-notice",
    }
    assert got[11]["n_sentences"] == 3
    assert li.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
