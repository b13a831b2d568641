"""Licence scans by sentence rules, in DataFrame functions alone.

A text is cut into sentences in two ways: at sentence ends and at line ends, which finds one-line notices, and at sentence
ends and blank lines with line ends as spaces, which finds wrapped texts. Sentences are normalised (lower case; all but letters and digits
as one space) and looked up among known licence sentences, each of which has an identifier. Besides the sentences of
SENTENCES those are notices: each form of FORMS with each name of NAMES, and SPDX lines. The identifiers of a text, in order,
are matched against the ordered rules: the first rule of a family that fits gives the licence.

Texts without a stem that every known sentence has (STEMS) skip the work; that loses nothing.

Defined cases: a null text has no sentences and no licences; repeated sentences repeat their identifiers and give a licence
once; rows that repeat give equal results; an empty table gives no rows; texts are read whole, whatever their length; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import let

STEMS = r"licens|permission|redistribut|warrant|copyright|public domain|misrepresent|for any purpose|acknowledgement|\bmpl\b|\bgpl\b"

# Identifiers and sentences of public licences.
SENTENCES = {
    "apache-short": 'Licensed under the Apache License, Version 2.0',
    "apache-use": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache-obtain": 'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": 'See the License for the specific language governing permissions and limitations under the License',
    "mit-notice": 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software',
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "gpl2-work": 'This work is licensed under the GNU General Public License, version 2',
    "gpl3-work": 'This work is licensed under the GNU General Public License, version 3',
    "gpl-hope": 'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE',
    "gpl3-free": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version',
    "gpl2-free": 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version',
    "ccbync-short": 'Licensed under CC BY-NC 4.0',
    "ccby-short": 'Licensed under CC BY 4.0',
    "ccbysa-short": 'Licensed under CC BY-SA 4.0',
    "ccby-intl": 'This work is licensed under a Creative Commons Attribution 4.0 International License',
    "ccbync-intl": 'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License',
    "bsd-use": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:',
    "bsd-source": 'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer',
    "bsd-binary": 'Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution',
    "bsd-name": 'Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission',
    "isc-grant": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies',
    "mpl-form": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0',
    "apache-short-2": 'This project is licensed under the Apache 2.0 license',
    "gpl-received": 'You should have received a copy of the GNU General Public License along with this program',
    "lgpl3-free": 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version',
    "lgpl21-free": 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version',
    "lgpl-hope": 'This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE',
    "agpl3-free": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version',
    "mpl-copy": 'If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/',
    "unlicense-free": 'This is free and unencumbered software released into the public domain',
    "unlicense-anyone": 'Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means',
    "epl2": 'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0',
    "cc0": 'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work',
    "cc0-dedicate": 'This work is dedicated to the public domain under CC0 1.0 Universal',
    "boost": 'Distributed under the Boost Software License, Version 1.0',
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": 'Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:',
    "zlib-origin": 'The origin of this software must not be misrepresented; you must not claim that you wrote the original software',
    "zlib-altered": 'Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software',
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd-advert": 'All advertising materials mentioning features or use of this software must display the following acknowledgement:',
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "bsd0-grant": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted',
    "ccbysa-intl": 'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License',
    "ccbynd-intl": 'This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License',
    "ccbyncsa-intl": 'This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License',
    "ccbynd-short": 'Licensed under CC BY-ND 4.0',
    "ccbyncsa-short": 'Licensed under CC BY-NC-SA 4.0',
    "bsd-style": 'Use of this source code is governed by a BSD-style license that can be found in the LICENSE file',
    "mit-style": 'Use of this source code is governed by an MIT-style license that can be found in the LICENSE file',
    "reserved": 'This software is proprietary and may not be redistributed without permission',
}
#: Forms of notices, and names of licences in them with their identifiers; every form is made with every name.
FORMS = (
    "Released under the {}", "Licensed under the {}", "Distributed under the {}", "This file is released under the {}", "This file is licensed under the {}", "This project is licensed under the {}", "This software is licensed under the {}",
    "This software is released under the {}", "This code is released under the {}", "This program is licensed under the {}", "The code is licensed under the {}", "Available under the {}", "See the LICENSE file for the {}", "Published under the {}",
)
NAMES = {
    "MIT License": "MIT", "MIT license (MIT)": "MIT", "Apache License 2.0": "Apache-2.0", "Apache License, Version 2.0": "Apache-2.0", "BSD License": "BSD", "BSD 2-Clause License": "BSD-2-Clause", "BSD 3-Clause License": "BSD-3-Clause", "ISC License": "ISC",
    "GNU General Public License v2.0": "GPL-2.0", "GNU General Public License v3.0": "GPL-3.0", "GNU GPL v2": "GPL-2.0", "GNU GPL v3": "GPL-3.0", "GNU Lesser General Public License v3.0": "LGPL-3.0", "GNU Affero General Public License v3.0": "AGPL-3.0",
    "Mozilla Public License 2.0": "MPL-2.0", "Eclipse Public License 2.0": "EPL-2.0", "Boost Software License 1.0": "BSL-1.0", "zlib License": "Zlib", "Unlicense": "Unlicense", "CC0 1.0 Universal license": "CC0-1.0",
}
#: Ordered rules: licence, family, identifiers in order. Of a family, only the first rule that fits counts.
RULES = (
    ("Apache-2.0", "apache", ("apache-use", "apache-obtain", "apache-basis", "apache-see")),
    ("Apache-2.0-notice", "apache", ("apache-short|apache-short-2|apache-use|name-Apache-2.0|spdx-Apache-2.0",)),
    ("MIT", "mit", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT-notice", "mit", ("name-MIT|spdx-MIT|mit-style",)),
    ("BSD-4-Clause", "bsd", ("bsd-use", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name")),
    ("BSD-3-Clause", "bsd", ("bsd-use", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", "bsd", ("bsd-use", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause-notice", "bsd", ("name-BSD-3-Clause|spdx-BSD-3-Clause",)),
    ("BSD-2-Clause-notice", "bsd", ("name-BSD-2-Clause|spdx-BSD-2-Clause",)),
    ("BSD-notice", "bsd", ("name-BSD|bsd-style",)),
    ("ISC", "isc", ("isc-grant",)),
    ("0BSD", "isc", ("bsd0-grant", "isc-warranty")),
    ("ISC-notice", "isc", ("name-ISC|spdx-ISC",)),
    ("GPL-3.0-or-later", "gpl", ("gpl3-free", "gpl-hope")),
    ("GPL-2.0-or-later", "gpl", ("gpl2-free", "gpl-hope")),
    ("GPL-3.0-notice", "gpl", ("gpl3-free|gpl3-work|name-GPL-3.0|spdx-GPL-3.0",)),
    ("GPL-2.0-notice", "gpl", ("gpl2-free|gpl2-work|name-GPL-2.0|spdx-GPL-2.0",)),
    ("LGPL-3.0-or-later", "lgpl", ("lgpl3-free", "lgpl-hope")),
    ("LGPL-2.1-or-later", "lgpl", ("lgpl21-free", "lgpl-hope")),
    ("LGPL-notice", "lgpl", ("lgpl3-free|lgpl21-free|name-LGPL-3.0|spdx-LGPL-3.0",)),
    ("AGPL-3.0-or-later", "agpl", ("agpl3-free", "gpl-hope")),
    ("AGPL-3.0-notice", "agpl", ("agpl3-free|name-AGPL-3.0|spdx-AGPL-3.0",)),
    ("CC-BY-NC-SA-4.0", "cc", ("ccbyncsa-short|ccbyncsa-intl",)),
    ("CC-BY-NC-4.0", "cc", ("ccbync-short|ccbync-intl",)),
    ("CC-BY-ND-4.0", "cc", ("ccbynd-short|ccbynd-intl",)),
    ("CC-BY-SA-4.0", "cc", ("ccbysa-short|ccbysa-intl",)),
    ("CC-BY-4.0", "cc", ("ccby-short|ccby-intl",)),
    ("CC0-1.0", "cc0", ("cc0|cc0-dedicate|name-CC0-1.0|spdx-CC0-1.0",)),
    ("MPL-2.0", "mpl", ("mpl-form|mpl-copy|name-MPL-2.0|spdx-MPL-2.0",)),
    ("EPL-2.0", "epl", ("epl2|name-EPL-2.0|spdx-EPL-2.0",)),
    ("BSL-1.0", "boost", ("boost|boost-grant|name-BSL-1.0|spdx-BSL-1.0",)),
    ("Zlib", "zlib", ("zlib-grant", "zlib-origin", "zlib-altered")),
    ("Zlib-notice", "zlib", ("name-Zlib|spdx-Zlib",)),
    ("Unlicense", "unlicense", ("unlicense-free|unlicense-anyone|name-Unlicense|spdx-Unlicense",)),
    ("proprietary", "reserved", ("reserved",)),
)
ENDS = r"(?<=[.!?;:])[\x20\x09-\x0D]+"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def _key(sentence: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in sentence.lower()).split())


def sentences() -> dict[str, str]:
    """All known sentences with their identifiers: those of SENTENCES, notices in every form, and SPDX lines."""
    out = {text: ident for ident, text in SENTENCES.items()}
    for name, ident in NAMES.items():
        out |= {form.format(name): f"name-{ident}" for form in FORMS if form.format(name) not in out}
    out |= {f"SPDX-License-Identifier: {ident}{more}": f"spdx-{ident}" for ident in sorted(set(NAMES.values())) for more in ("", "-only", "-or-later")}
    return out


def pieces() -> list[tuple[str, list[str]]]:
    """Known sentences cut the way texts are: a sentence with inner ends is a run of pieces."""
    import re

    found = [(f"<{ident}>", [_key(x) for x in re.split(r"(?<=[.!?;:])\s+", s) if _key(x)]) for s, ident in sentences().items()]
    return list({" | ".join(run): (ident, run) for ident, run in reversed(found)}.values())


def pattern_of(rule: tuple[str, ...]) -> str:
    """A rule's identifiers as a pattern over a text's; alternatives are parted by bars."""
    one = lambda x: "(?:" + "|".join(f"<{i.replace('.', '[.]')}>" for i in x.split("|")) + ")"
    return ".*".join(map(one, rule))


def ids_of(text: Column, cut: str) -> Column:
    """Identifiers of the known sentences of a text, in order, each in angle brackets."""
    known = pieces()
    keys = F.create_map(*(F.lit(x) for ident, run in known for x in (" | ".join(run), ident)))
    longest = max(len(run) for _, run in known)
    starts = sorted({run[0] for _, run in known})

    def at(all_pieces, p, i):
        joined = lambda n: F.try_element_at(keys, F.array_join(F.slice(all_pieces, i + 1, n), " | "))
        return F.when(p.isin(*starts), F.coalesce(*(joined(n) for n in range(longest, 0, -1)), F.lit(""))).otherwise("")

    return let(F.filter(F.transform(F.split(text, cut), normalised), lambda p: p != ""), lambda a: F.array_join(F.transform(a, lambda p, i: at(a, p, i)), ""))


def licences_in(ids: Column) -> Column:
    """Licences whose rules a run of identifiers fits, in the order of the rules."""
    by: dict[str, Column] = {}
    for name, family, rule in RULES:
        hit = ids.rlike(pattern_of(rule))
        by[family] = F.when(hit, name) if family not in by else by[family].when(hit, name)
    return F.filter(F.array(*by.values()), lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), line_ids and text_ids (their identifiers by either cut), licences (joined by commas)."""
    text = F.coalesce("text", F.lit(""))
    some = text.rlike(f"(?i){STEMS}")
    cut = docs.select(
        "doc_id",
        F.when(some, ids_of(text, rf"{ENDS}|\n+")).otherwise("").alias("line_ids"),
        F.when(some, ids_of(text, rf"{ENDS}|\n[\x20\t]*\n[\x20\x09-\x0D]*")).otherwise("").alias("text_ids"),
    )
    found = F.array_distinct(F.concat(licences_in(F.col("text_ids")), licences_in(F.col("line_ids"))))
    # a family's full text outranks its notice: of a family that both cuts find, the earlier rule stays
    order = F.array(*(F.lit(name) for name, _, _ in RULES))
    family = F.create_map(*(F.lit(x) for name, f, _ in RULES for x in (name, f)))
    best = F.filter(found, lambda n: ~F.exists(found, lambda m: (family[m] == family[n]) & (F.array_position(order, m) < F.array_position(order, n))))
    return cut.select("doc_id", F.greatest(*(F.size(F.split(c, "<")) - 1 for c in ("line_ids", "text_ids"))).cast("long").alias("n_sentences"), "line_ids", "text_ids", F.array_join(F.array_sort(best), ",").alias("licences"))
