"""Licence scans by sentence rules, in DataFrame expressions only.

A text is cut into parts at stops and line breaks, each is normalised (lower case, runs of what is no letter or digit as one
space), and the known sentences are mapped to their identifiers. A known sentence is one part, or several that follow each
other without a blank line between, as notices are wrapped and hold stops inside (`free software: you can`, `v. 2.0`). The identifiers, in the order of the text, are then matched against ordered
rules: a rule names the sentences that a licence text or notice must show one after the other; others may stand between.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, functions as F

#: Normalised sentences of common licence texts and notices, by identifier.
SENTENCES: dict[int, str] = {
    1: "licensed under the apache license version 2 0",
    2: "you may not use this file except in compliance with the license",
    3: "you may obtain a copy of the license at",
    4: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    5: "see the license for the specific language governing permissions and limitations under the license",
    6: "apache license version 2 0 january 2004",
    10: "released under the mit license",
    11: "licensed under the mit license",
    12: "this project is licensed under the mit license",
    13: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    14: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    15: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    16: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    22: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    23: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    24: "you should have received a copy of the gnu general public license along with this program",
    25: "licensed under the gnu general public license version 3",
    26: "licensed under the gnu general public license version 2",
    27: "licensed under the gnu affero general public license version 3",
    28: "licensed under the gnu lesser general public license version 3",
    30: "licensed under cc by nc 4 0",
    31: "licensed under cc by 4 0",
    32: "licensed under cc by sa 4 0",
    33: "this work is licensed under a creative commons attribution 4 0 international license",
    34: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    35: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    36: "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    37: "this is free and unencumbered software released into the public domain",
    40: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    41: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    42: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    43: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    44: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    50: "this source code form is subject to the terms of the mozilla public license v 2 0",
    51: "if a copy of the mpl was not distributed with this file you can obtain one at",
    52: "licensed under the mozilla public license version 2 0",
    53: "mozilla public license version 2 0",
    60: "all rights reserved",
    61: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    62: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    63: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    64: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    65: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    66: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    67: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    70: "gnu general public license version 3 29 june 2007",
    71: "gnu general public license version 2 june 1991",
    72: "gnu lesser general public license version 3 29 june 2007",
    73: "gnu lesser general public license version 2 1 february 1999",
    74: "gnu affero general public license version 3 19 november 2007",
    75: "cc0 1 0 universal",
}

#: Licences that an SPDX tag may name.
TAGGED = ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense", "BSL-1.0", "EPL-1.0", "EPL-2.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "WTFPL")
SENTENCES |= {100 + i: "spdx license identifier " + "".join(c if c.isalnum() else " " for c in x.lower()) for i, x in enumerate(TAGGED)}

#: Names that notices give a licence, as text of the normalised form; {} stands for a version.
NAMES: dict[str, str] = {
    "mit": "MIT", "expat": "MIT", "mit expat": "MIT", "isc": "ISC", "zlib": "Zlib", "wtfpl": "WTFPL", "unlicense": "Unlicense", "boost software": "BSL-1.0", "cc0 1 0 universal": "CC0-1.0", "cc0 1 0": "CC0-1.0",
    "bsd 2 clause": "BSD-2-Clause", "2 clause bsd": "BSD-2-Clause", "simplified bsd": "BSD-2-Clause", "freebsd": "BSD-2-Clause",
    "bsd 3 clause": "BSD-3-Clause", "3 clause bsd": "BSD-3-Clause", "new bsd": "BSD-3-Clause", "modified bsd": "BSD-3-Clause",
}
#: Licences with versions: name, version and the SPDX name.
VERSIONED = (
    ("apache", "2 0", "Apache-2.0"), ("boost software", "1 0", "BSL-1.0"), ("eclipse public", "1 0", "EPL-1.0"), ("eclipse public", "2 0", "EPL-2.0"), ("epl", "1 0", "EPL-1.0"), ("epl", "2 0", "EPL-2.0"),
    ("mozilla public", "2 0", "MPL-2.0"), ("mpl", "2 0", "MPL-2.0"), ("gnu general public", "2", "GPL-2.0"), ("gnu general public", "3", "GPL-3.0"), ("gnu gpl", "2", "GPL-2.0"), ("gnu gpl", "3", "GPL-3.0"), ("gpl", "2", "GPL-2.0"), ("gpl", "3", "GPL-3.0"),
    ("gnu lesser general public", "2 1", "LGPL-2.1"), ("gnu lesser general public", "3", "LGPL-3.0"), ("gnu lgpl", "2 1", "LGPL-2.1"), ("gnu lgpl", "3", "LGPL-3.0"), ("lgpl", "2 1", "LGPL-2.1"), ("lgpl", "3", "LGPL-3.0"),
    ("gnu affero general public", "3", "AGPL-3.0"), ("gnu agpl", "3", "AGPL-3.0"), ("agpl", "3", "AGPL-3.0"),
)
#: The parts of a Creative Commons licence, as a tag and as text.
COMMONS = {"by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc": "attribution noncommercial", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}


def notice_names() -> dict[str, str]:
    """Every name that a notice may give a licence, in the normalised form, with its SPDX name."""
    found = {f"{name}{end}": spdx for name, spdx in NAMES.items() for end in ("", " license", " licence")}
    for name, version, spdx in VERSIONED:
        versions = [version] + ([f"{version} 0"] if " " not in version else [])
        forms = [f"{name}{lic}{sep}{v}" for v in versions for lic in ("", " license", " licence") for sep in (" version ", " v", " v ", " ")] + [f"{name} {v} {lic}" for v in versions for lic in ("license", "licence")]
        if spdx.startswith(("GPL", "LGPL", "AGPL")):
            found |= {f"{f}{end}": f"{spdx}-or-later" for f in forms for end in (" or later", " or any later version", " or at your option any later version", " plus")}
            spdx += "-only"
        found |= dict.fromkeys(forms, spdx)
    for tag, words in COMMONS.items():
        spdx = f"CC-{tag.upper().replace(' ', '-')}-4.0"
        found |= dict.fromkeys((f"cc {tag} 4 0", f"cc {tag} 4 0 license", f"creative commons {words} 4 0", f"creative commons {words} 4 0 international", f"creative commons {words} 4 0 license", f"creative commons {words} 4 0 international license"), spdx)
    return found


#: What stands before a name in a notice, sentences in which a name stands and their known form, and an SPDX tag. _ is a blank or, in
#: a text that is cut into parts, the end of one.
NOTICE = r"(?:[a-z0-9 ]{1,60} )?(?:licensed|released|distributed|available|published|provided|shared)(?:_to_you)?_(?:under|with)(?:_the)?(?:_terms)?(?:_and_conditions)?(?:_of)?(?:_the)?_"
NAMED = (
    (r"neither_the_names?_of_[a-z0-9 |]{1,160}?_nor_the_names_of_(?:its|any|other)_contributors_may", "neither the name of the copyright holder nor the names of its contributors may"),
    (r"neither_the_name_of_[a-z0-9 ]{1,160}?_may_be_used_to_endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    (r"this_software_is_provided_by_[a-z0-9 |]{1,160}?_as_is_and_any_express", "this software is provided by the copyright holders and contributors as is and any express"),
)
TAG = "spdx license identifier "
TAG_MARK = r"(spdx[ -]license[ -]identifier):[ \t]*"
#: Operands of an SPDX expression that are looked at.
OPERANDS = 8
SENTENCES |= {300 + i: f"notice {x}" for i, x in enumerate(sorted(set(notice_names().values())))}
#: Titles of licence texts that are as good as a notice, and SPDX tags as they were written before.
TITLES = {"the mit license": "MIT", "the mit license mit": "MIT", "mit license": "MIT", "boost software license version 1 0": "BSL-1.0", "boost software license version 1 0 august 17th 2003": "BSL-1.0", "eclipse public license v 2 0": "EPL-2.0", "eclipse public license v 1 0": "EPL-1.0", "isc license": "ISC"}
OLD_TAGS = {
    "gpl 2 0": "GPL-2.0-only", "gpl 2 0 plus": "GPL-2.0-or-later", "gpl 3 0": "GPL-3.0-only", "gpl 3 0 plus": "GPL-3.0-or-later", "lgpl 2 1": "LGPL-2.1-only", "lgpl 2 1 plus": "LGPL-2.1-or-later",
    "lgpl 3 0": "LGPL-3.0-only", "lgpl 3 0 plus": "LGPL-3.0-or-later", "agpl 3 0": "AGPL-3.0-only", "agpl 3 0 plus": "AGPL-3.0-or-later",
}

#: Other forms that official notices give a sentence.
FORMS: dict[str, int] = {
    "apache license version 2 0 january 2004 http www apache org licenses": 6,
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": 66,
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": 63,
    "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": 43,
    "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": 43,
    "this software is provided by the copyright holder and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": 44,
    "this software is provided by the regents and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": 44,
    "licensed under the apache license version 2 0 the license": 1,
    "you may obtain a copy of the license at http www apache org licenses license 2 0": 3,
    "you may obtain a copy of the license at https www apache org licenses license 2 0": 3,
    "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": 36,
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": 36,
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": 51,
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": 51,
}

#: Rules, by name: licence, and the sentences in the order they must appear.
RULES: dict[str, tuple[str, tuple[int, ...]]] = {
    "apache-notice": ("Apache-2.0", (1,)),
    "apache-header": ("Apache-2.0", (1, 2, 4, 5)),
    "apache-text": ("Apache-2.0", (6,)),
    "mit-released": ("MIT", (10,)),
    "mit-licensed": ("MIT", (11,)),
    "mit-project": ("MIT", (12,)),
    "mit-text": ("MIT", (13, 14, 15)),
    "gpl3-work": ("GPL-3.0-only", (20,)),
    "gpl3-header": ("GPL-3.0-or-later", (21, 23)),
    "gpl2-header": ("GPL-2.0-or-later", (22, 23)),
    "gpl3-notice": ("GPL-3.0-only", (25,)),
    "gpl2-notice": ("GPL-2.0-only", (26,)),
    "agpl3-notice": ("AGPL-3.0-only", (27,)),
    "lgpl3-notice": ("LGPL-3.0-only", (28,)),
    "cc-by-nc-tag": ("CC-BY-NC-4.0", (30,)),
    "cc-by-tag": ("CC-BY-4.0", (31,)),
    "cc-by-sa-tag": ("CC-BY-SA-4.0", (32,)),
    "cc-by-text": ("CC-BY-4.0", (33,)),
    "cc-by-sa-text": ("CC-BY-SA-4.0", (34,)),
    "cc-by-nc-text": ("CC-BY-NC-4.0", (35,)),
    "cc0-text": ("CC0-1.0", (36,)),
    "unlicense-text": ("Unlicense", (37,)),
    "bsd2-text": ("BSD-2-Clause", (40, 41, 42, 44)),
    "bsd3-text": ("BSD-3-Clause", (40, 41, 42, 43, 44)),
    "mpl2-header": ("MPL-2.0", (50, 51)),
    "mpl2-notice": ("MPL-2.0", (52,)),
    "mpl2-text": ("MPL-2.0", (53,)),
    "lgpl21-header": ("LGPL-2.1-or-later", (62, 61)),
    "lgpl3-header": ("LGPL-3.0-or-later", (63, 61)),
    "lgpl3-program": ("LGPL-3.0-or-later", (63, 23)),
    "agpl3-header": ("AGPL-3.0-or-later", (64, 23)),
    "gpl2-only": ("GPL-2.0-only", (65,)),
    "isc-text": ("ISC", (66,)),
    "zlib-text": ("Zlib", (67,)),
    "gpl3-text": ("GPL-3.0-only", (70,)),
    "gpl2-text": ("GPL-2.0-only", (71,)),
    "lgpl3-text": ("LGPL-3.0-only", (72,)),
    "lgpl21-text": ("LGPL-2.1-only", (73,)),
    "agpl3-text": ("AGPL-3.0-only", (74,)),
    "cc0-title": ("CC0-1.0", (75,)),
    "reserved": ("LicenseRef-all-rights-reserved", (60,)),
}

RULES |= {f"spdx-{x.lower()}": (x, (100 + i,)) for i, x in enumerate(TAGGED)}
RULES |= {f"notice-{s[7:].lower()}": (s[7:], (i,)) for i, s in SENTENCES.items() if s.startswith("notice ")}
_BY_SENTENCE = {s: i for i, s in SENTENCES.items()}
FORMS |= {TAG + old: _BY_SENTENCE[TAG + "".join(c if c.isalnum() else " " for c in new.lower())] for old, new in OLD_TAGS.items()}
FORMS |= {title: _BY_SENTENCE[f"notice {lic}"] for title, lic in TITLES.items()}
#: Every sentence that is known as it stands.
KNOWN = {s: i for s, i in _BY_SENTENCE.items() if not s.startswith("notice ")} | FORMS

#: A part ends at a line break, or at a stop, mark or colon that blanks or the end follow.
STOP = r"[.!?;:]+(?:[ \t]+|\z)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every known sentence has one of STEMS, or `under` or `with` and one of NAME_STEMS; a text with none need not be cut.
STEMS = ("licen", "permission", "copyright", "software", "redistribut", "obtain", "warranty", "rights", "forms", "mpl", "cc0")
NAME_STEMS = ("mit", "expat", "isc", "zlib", "wtfpl", "boost", "bsd", "apache", "eclipse", "epl", "mozilla", "gnu", "gpl", "commons", "cc by", "cc-by")


def _may_hold(text: Column) -> Column:
    """Whether a text has a word without which nothing of the table occurs: a search for bytes, over the text once lowered."""
    def held(lowered: Column) -> Column:
        any_of = lambda words: functools.reduce(operator.or_, [lowered.contains(w) for w in words])
        return any_of(STEMS) | any_of(("under", "with")) & any_of(NAME_STEMS)

    return _let(F.lower(text), held)


def _let(value: Column, body) -> Column:
    """body(value), with the value made once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _names() -> str:
    return "|".join(x.replace(" ", "_") for x in sorted(notice_names(), key=len, reverse=True))


def _cut(pattern: str) -> str:
    """A pattern for a text with marks between its parts."""
    return pattern.replace("_", "[ |]")


def _brought_to_form(plain: Column) -> Column:
    """Names, notices and SPDX expressions of a text in parts, in the form of the table."""
    for pattern, form in NAMED:
        plain = F.regexp_replace(plain, _cut(pattern), form)
    own = "|".join(x.replace(" ", "_") for x in KNOWN if re.match(NOTICE.replace("_", " "), x))
    plain = F.regexp_replace(plain, _cut(f"(?<=[|~])(?!(?:{own})[|~]){NOTICE}({_names()})(?=[|~])"), "notice $1")
    plain = F.regexp_replace(plain, f"{TAG}([a-z0-9 ]+?) with [a-z0-9 ]+? exception[a-z0-9 ]*?(?= or | and |[|~])", f"{TAG}$1")
    for _ in range(OPERANDS - 1):
        plain = F.regexp_replace(plain, f"{TAG}([a-z0-9 ]+?) (?:or|and) (?!later)", f"{TAG}$1|{TAG}")
    return plain


def sentence_ids(text: Column, sentences: dict[int, str] | None = None) -> Column:
    """The identifiers of the known sentences of a text, in its order; an empty array for none, null or an empty text."""
    known = KNOWN if sentences is None else {s: i for i, s in sentences.items()}
    # parts with | between them, and ~ where a blank line is
    plain = F.regexp_replace(F.translate(text, UPPER + "|~", LOWER + "  "), "\r\n?", "\n")
    plain = F.regexp_replace(plain, TAG_MARK, r"$1 ")
    plain = F.regexp_replace(plain, r"(?<=[0-9])\+", " plus ")
    plain = F.regexp_replace(F.regexp_replace(plain, STOP, "|"), "[^a-z0-9|\n]+", " ")
    plain = F.regexp_replace(F.concat(F.lit("~"), plain, F.lit("~")), r"\n(?: ?\n)+", "~")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[ |\n]*~[ |\n~]*", "~"), r"[ |\n]*[|\n][ |\n]*", "|")
    notices = {}
    if sentences is None:
        plain = _brought_to_form(plain)
        notices = {f"notice {name}": _BY_SENTENCE[f"notice {lic}"] for name, lic in notice_names().items()}
    longest = sorted(known, key=len, reverse=True)
    pattern = "(?<=[|~])(?:" + "|".join([x.replace(" ", "[ |]") for x in longest] + ["notice [a-z0-9 |]+"] * bool(notices)) + ")(?=[|~])"
    keys, ids = F.array(*[F.lit(x) for x in (*known, *notices)]), F.array(*[F.lit(i) for i in (*known.values(), *notices.values())])
    found = F.transform(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)), lambda x: F.get(ids, (F.array_position(keys, F.translate(x, "|", " ")) - 1).cast("int")))
    return F.coalesce(F.when(_may_hold(text), F.array_compact(found)) if sentences is None else found, F.array().cast("array<int>"))


def beaten_by(rules: dict[str, tuple[str, tuple[int, ...]]]) -> dict[str, list[str]]:
    """For each rule those of another licence that ask for the same sentences and more: where one of them holds, it does not."""

    def part_of(short: tuple[int, ...], long: tuple[int, ...]) -> bool:
        rest = iter(long)
        return len(short) < len(long) and all(x in rest for x in short)

    return {a: [b for b, (other, more) in rules.items() if other != lic and part_of(seq, more)] for a, (lic, seq) in rules.items()}


def match_rules(ids: Column, rules: dict[str, tuple[str, tuple[int, ...]]] | None = None) -> tuple[Column, Column]:
    """Names of the rules that the identifiers satisfy (in the order of the rules) and their licences (sorted, each once).
    A rule whose sentences are part of a longer one of another licence gives way to it."""
    rules = rules or RULES
    beaten = beaten_by(rules)
    table = F.array(*[F.struct(
        F.lit(name).alias("rule"), F.lit(lic).alias("licence"), F.lit(seq[0]).alias("first"), F.lit("," + ",(?:[0-9]+,)*".join(map(str, seq)) + "," if len(seq) > 1 else None).cast("string").alias("pattern"),
        F.array(*map(F.lit, beaten[name])).cast("array<string>").alias("over")) for name, (lic, seq) in rules.items()])

    def kept(held: Column) -> Column:
        names = F.transform(held, lambda r: r["rule"])
        return _let(names, lambda all_: F.filter(held, lambda r: ~F.arrays_overlap(r["over"], all_)))

    def holding(line: Column) -> Column:
        return _let(F.filter(table, lambda r: F.array_contains(ids, r["first"]) & F.coalesce(F.regexp_like(line, r["pattern"]), F.lit(True))), kept)

    line = F.concat(F.lit(","), F.array_join(ids.cast("array<string>"), ","), F.lit(","))
    hits = F.when(F.size(ids) > 0, _let(line, holding))
    empty = F.array().cast("array<string>")
    return F.coalesce(F.transform(hits, lambda r: r["rule"]), empty), F.coalesce(F.array_sort(F.array_distinct(F.transform(hits, lambda r: r["licence"]))), empty)


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sentence_ids, rules and licences of every row; empty arrays where nothing is known. Repeated rows are each
    scanned; only the two named columns are read, and a very long text is scanned whole. No shuffle: a row's result depends on that row alone."""
    ids = df.select(F.col(id_col), sentence_ids(F.col(text_col)).alias("sentence_ids"))
    rules, licences = match_rules(F.col("sentence_ids"))
    return ids.select(id_col, "sentence_ids", rules.alias("rules"), licences.alias("licences"))


def oracle_sql() -> str:
    """The scan of `documents` in SQL, arrays as text; it knows only sentences that are one part each, as in the tables."""
    beaten = ", ".join(f"('{a}', '{b}')" for a, over in beaten_by(RULES).items() for b in over)
    known = ", ".join(f"('{s}', {i})" for s, i in KNOWN.items())
    names = ", ".join(f"('{name}', {_BY_SENTENCE[f'notice {lic}']})" for name, lic in notice_names().items())
    rules = ", ".join(f"({n}, '{name}', '{lic}', ',{',(?:[0-9]+,)*'.join(map(str, seq))},')" for n, (name, (lic, seq)) in enumerate(RULES.items()))
    plain = "part"
    for pattern, form in NAMED:
        plain = f"regexp_replace({plain}, '{pattern.replace('_', ' ').replace('[a-z0-9 |]', '[a-z0-9 ]')}', '{form}')"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
names(name, id) AS (VALUES {names}),
rules(n, rule, licence, pattern) AS (VALUES {rules}),
cut AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, string_split_regex(regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '{TAG_MARK}', '\\1 ', 'g'), '[\\n\\r]+|[.!?;:]+(?:[ \\t]+|\\z)') AS parts FROM documents)),
plain AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(translate(part, '{UPPER}', '{LOWER}'), '([0-9])\\+', '\\1 plus ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS part FROM cut),
tags AS (
  SELECT doc_id, i, unnest(operands) AS operand, generate_subscripts(operands, 1) AS j
  FROM (SELECT doc_id, i, string_split_regex(replace(regexp_replace(part[{len(TAG) + 1}:], ' with [a-z0-9 ]+? exception[a-z0-9 ]*?( or | and |$)', '\\1', 'g'), ' or later', ' or_later'), ' (?:or|and) ') AS operands FROM plain WHERE starts_with(part, '{TAG}'))),
hits AS (
  SELECT c.doc_id, c.i, 0 AS j, k.id FROM (SELECT doc_id, i, {plain} AS part FROM plain WHERE NOT starts_with(part, '{TAG}')) c JOIN known k ON k.sentence = c.part
  UNION ALL SELECT t.doc_id, t.i, t.j, k.id FROM tags t JOIN known k ON k.sentence = '{TAG}' || replace(t.operand, '_', ' ')
  UNION ALL SELECT c.doc_id, c.i, 0, n.id FROM plain c JOIN names n ON n.name = regexp_extract(c.part, '^{NOTICE.replace('_', ' ')}({_names().replace('_', ' ')})$', 1) WHERE c.part NOT IN (SELECT sentence FROM known)),
lines AS (SELECT doc_id, string_agg(id::VARCHAR, ',' ORDER BY i, j) AS ids FROM hits GROUP BY doc_id),
beaten(rule, by_rule) AS (VALUES {beaten}),
held AS (SELECT l.doc_id, r.* FROM lines l JOIN rules r ON regexp_matches(',' || l.ids || ',', r.pattern)),
matched AS (
  SELECT doc_id, string_agg(rule, ',' ORDER BY n) AS rules, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences
  FROM held h WHERE NOT EXISTS (SELECT 1 FROM beaten b JOIN held o ON o.rule = b.by_rule WHERE b.rule = h.rule AND o.doc_id = h.doc_id) GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.ids, '') AS sentence_ids, coalesce(m.rules, '') AS rules, coalesce(m.licences, '') AS licences
FROM documents d LEFT JOIN lines l USING (doc_id) LEFT JOIN matched m USING (doc_id)"""
