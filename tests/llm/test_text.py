"""Decontamination, licences, language, extraction."""

import random

import numpy as np
import pytest

from flowlens.llm import decontaminate, html_text, language, licenses, textnp

SHAPE = "doc_id long, text string, lang string, item_id long"


def docs(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang, -i) for i, t in enumerate(texts)], SHAPE)


def edit_distance_within(item, text):
    """Least distance of item to any stretch of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return min(row)


def test_myers_against_the_plain_table():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abcd", k=rng.randint(0, 60)))
        if rng.random() < 0.5:
            text += item[: len(item) // 2] + "x" + item[len(item) // 2:]
        assert decontaminate.myers(decontaminate.masks(item), len(item), text)[0] == edit_distance_within(item, text)


def test_every_item_within_budget_is_found(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 30)))) for i in range(12)] + [(98, ""), (99, None)]
    texts = [None, "", "clean text"]
    for i in range(60):
        item = items[i % 12][1]
        edited = list(item)
        for _ in range(rng.randint(0, decontaminate.budget(len(item)) + 2)):
            at = rng.randrange(len(edited))
            edited[at] = rng.choice(["", "z", edited[at] + "q"])
        texts.append(" ".join(word() for _ in range(20)) + " \n " + "".join(edited).upper() + "  " + word())
    want = {(d, i, edit_distance_within(decontaminate.normalise(t), decontaminate.normalise(x))) for d, x in enumerate(texts) if x for i, t in items if t and edit_distance_within(decontaminate.normalise(t), decontaminate.normalise(x)) <= decontaminate.budget(len(decontaminate.normalise(t)))}
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs(spark, texts)
    for block in (10, 8_000_000):
        got = {(r["id"], r["item_id"], r["distance"]) for r in decontaminate.contaminated(table, bench, block_chars=block).collect()}
        assert got == want and want
    clean = decontaminate.decontaminate(table, bench, block_chars=200)
    assert clean.columns == table.columns and {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, _, _ in want}
    assert decontaminate.contaminated(table, bench.limit(0)).count() == 0 and decontaminate.decontaminate(table, bench.limit(0)).count() == len(texts)


def test_licence_rules(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nSomething else.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    turned = "\n".join(reversed(mit.split("\n\n")))
    texts = ["text\nLicensed under the Apache License, Version 2.0.", mit, turned, "Released under the MIT License. Licensed under CC BY-NC 4.0.", "a licence for x", None, "", "This work is  licensed under the GNU General Public License, version 3.\n" * 2]
    out = {r["doc_id"]: r for r in licenses.scan_licences(docs(spark, texts)).collect()}
    assert [out[i]["licences"] for i in range(len(texts))] == [["Apache-2.0"], ["MIT"], [], ["CC-BY-NC-4.0", "MIT"], [], [], [], ["GPL-3.0-only"]]
    assert out[1]["sentence_ids"] == [13, 14, 15] and out[2]["sentence_ids"] == [15, 14, 13] and out[7]["sentence_ids"] == [20, 20]
    assert licenses.scan_licences(docs(spark, [])).count() == 0


NOTICES = {
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.',
    "apache-text": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT',
    "gpl3-header": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.",
    "gpl2-header": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd3-text": 'Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT',
    "mpl2-header": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-text": "This work is licensed under a Creative Commons\nAttribution 4.0 International License.",
    "bsd2-text": 'Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT',
    "lgpl21-header": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\nLesser General Public License for more details.\n\nYou should have received a copy of the GNU Lesser General Public\nLicense along with this library; if not, write to the Free Software\nFoundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA",
    "lgpl3-program": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Lesser General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU Lesser General Public License for more details.",
    "agpl3-header": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU Affero General Public License for more details.\n\nYou should have received a copy of the GNU Affero General Public License\nalong with this program.  If not, see <https://www.gnu.org/licenses/>.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.",
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS.',
    "cc-by-sa-text": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
    "cc-by-nc-text": "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.",
    "gpl3-text": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.",
    "agpl3-text": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007",
    "mpl2-text": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions",
    "cc0-text": "To the extent possible under law, the author(s) have dedicated all copyright\nand related and neighboring rights to this software to the public domain\nworldwide. This software is distributed without any warranty.",
}


#: What each notice says, written down apart from the rules.
LICENCE_OF = {
    "apache": "Apache-2.0", "mit": "MIT", "gpl3-header": "GPL-3.0-or-later", "gpl2-header": "GPL-2.0-or-later", "gpl2-only": "GPL-2.0-only", "gpl3-text": "GPL-3.0-only", "bsd3": "BSD-3-Clause", "bsd2": "BSD-2-Clause",
    "lgpl21": "LGPL-2.1-or-later", "lgpl3": "LGPL-3.0-or-later", "agpl3-header": "AGPL-3.0-or-later", "agpl3-text": "AGPL-3.0-only", "isc": "ISC", "mpl2": "MPL-2.0", "cc-by-sa": "CC-BY-SA-4.0", "cc-by-nc": "CC-BY-NC-4.0", "cc-by-text": "CC-BY-4.0", "cc0": "CC0-1.0"}


def test_notices_give_exactly_their_licence(spark):
    want = [next(v for k, v in LICENCE_OF.items() if name.startswith(k)) for name in NOTICES]
    unwrapped = ["\n\n".join(" ".join(p.split()) for p in t.split("\n\n")) for t in NOTICES.values()]
    spdx = [f"// SPDX-License-Identifier: {x}\nint x;" for x in ("MIT", "Apache-2.0", "GPL-2.0-or-later", "BSD-3-Clause")]
    out = {r["doc_id"]: r["licences"] for r in licenses.scan_licences(docs(spark, [*NOTICES.values(), *unwrapped, *spdx])).collect()}
    assert [out[i] for i in range(len(out))] == [[x] for x in [*want, *want, "MIT", "Apache-2.0", "GPL-2.0-or-later", "BSD-3-Clause"]]


def test_very_long_text_and_extra_columns(spark):
    filler = "No licence here, only words that say so. " * 50_000
    table = spark.createDataFrame([(1, filler + "\nReleased under the MIT License.\n" + filler, "a", 3)], "doc_id long, text string, rules string, licences long")
    row = licenses.scan_licences(table).first()
    assert row["licences"] == ["MIT"] and row["rules"] == ["mit-released"]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_notices(spark, mark):
    texts = ["int x;\n\n" + "\n".join((mark + line).rstrip() for line in t.split("\n")) + "\n\nint y;" for t in NOTICES.values()]
    texts += [t.replace("\n", "\r\n") for t in texts]
    out = {r["doc_id"]: r["rules"] for r in licenses.scan_licences(docs(spark, texts)).collect()}
    assert [name for i, name in enumerate(list(NOTICES) * 2) if name not in out[i]] == []
    apart = docs(spark, ["This work is licensed under\n\na Creative Commons Attribution 4.0 International License."])
    assert licenses.scan_licences(apart).first()["rules"] == []


def test_every_known_sentence_has_a_stem():
    import re

    assert all(any(x in s for x in licenses.STEMS) for s in licenses.KNOWN)
    assert all(any(x in name for x in (*licenses.STEMS, *licenses.NAME_STEMS)) for name in licenses.notice_names())
    assert all(i in licenses.SENTENCES for _, seq in licenses.RULES.values() for i in seq)


def test_vectors_against_the_plain_definition():
    text = "Ab c!"
    data = np.frombuffer(text.encode(), np.uint8)
    got = language.text_vectors(data, np.array([0, len(data)]), 64)[0]
    letters = [0, ord("a"), ord("b"), 0, ord("c"), 0]
    want = np.zeros(64)
    for i in range(len(letters) - 2):
        v = np.ones(64)
        for place, c in enumerate(letters[i:i + 3]):
            v *= np.roll(language._letter_vector(c, 64).astype(float), 2 - place)
        want += v
    # the last trigram begins with the last letter and ends with the boundary after it
    assert np.array_equal(got, want)


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.document_languages(table).join(table.select("doc_id", "lang", "text"), "doc_id").filter("held_out and length(text) >= 40").collect()
    assert len(out) > 100 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.99 * len(out) and all(0 <= r["score"] <= 1 for r in out)


def test_language_edge_cases(spark):
    table = docs(spark, ["the cat sat on the mat", "den Hund und die Katze", None, "", "123 %%% 4", "日本語の文章 Привет"], "en")
    prototypes = language.learn(table)
    out = {r["doc_id"]: r for r in language.predict(table, prototypes, [table.doc_id]).collect()}
    assert [out[i]["lang_pred"] for i in range(6)] == ["en", "en", "und", "und", "und", "en"] and out[2]["score"] == 0
    nothing = language.predict(table, language.learn(docs(spark, [])), [table.doc_id]).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    kept = language.identified(table)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 5]


def test_predictions_against_plain_counts(spark):
    """The query's own result: prototypes and cosines from a dictionary of trigrams, on one small table."""
    rng = random.Random(3)
    alphabets = {"aa": "abcde ", "bb": "defgh ", "cc": "xyzé日 "}
    rows = [(i, "".join(rng.choices(alphabets[lang], k=rng.randint(0, 200))), lang) for i, lang in enumerate(rng.choices(sorted(alphabets), k=120))] + [(900, None, "aa"), (901, "1 2", None), (902, "abc", None)]
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}

    def vector(text):
        letters = [0]
        for c in text or "":
            code = ord(c.lower()) if c.isalpha() else 0
            if code or letters[-1]:
                letters.append(code)
        letters += [0] * (letters[-1] != 0)
        out = np.zeros(language.DIM)
        for i in range(len(letters) - 2):
            v = np.ones(language.DIM)
            for place, c in enumerate(letters[i:i + 3]):
                v *= np.roll(language._letter_vector(c, language.DIM).astype(float), 2 - place)
            out += v
        return out

    sums = {}
    for i, text, lang in rows:
        if not held[i] and lang and text:
            sums[lang] = sums.get(lang, 0) + vector(text)
    table = spark.createDataFrame([(i, t, lang, "x", 1) for i, t, lang in rows], "doc_id long, text string, lang string, lang_pred string, score long")
    out = {r["doc_id"]: r for r in language.document_languages(table).collect()}
    assert len(out) == len(rows)
    for i, text, _ in rows:
        v = vector(text)
        norm = np.linalg.norm(v)
        if not norm:
            assert out[i]["lang_pred"] == "und" and out[i]["score"] == 0
            continue
        cosine = {k: v @ s / norm / np.linalg.norm(s) for k, s in sums.items()}
        best = max(cosine, key=cosine.get)
        assert out[i]["held_out"] == held[i] and abs(out[i]["score"] - max(0, cosine[best])) < 1e-4 and cosine[out[i]["lang_pred"]] > cosine[best] - 1e-4
    kept = language.identified(table)
    assert kept.columns == table.columns and kept.filter("lang is null").count() == 0


def test_text_far_from_every_language_is_rejected(spark):
    docs_ = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(4)
    junk = ["".join(rng.choices("qwxzjkvQ", k=300)) for _ in range(5)] + [" ".join("".join(rng.choices("ЖЩЪЫЭЮ", k=5)) for _ in range(60)) for _ in range(5)]
    table = docs_.unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], docs_.schema))
    kept = {r["doc_id"] for r in language.identified(table).collect()}
    clean = {r["doc_id"] for r in docs_.collect() if sum(c.isalpha() for c in r["text"] or "") > 20 and r["lang"]}
    assert not kept & set(range(-10, 0)) and clean <= kept


def test_long_texts_go_through_slices():
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghijé日  .,", k=60_000))
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.array([0, len(data)])
    want = language.text_vectors(data, at, 64)
    for size in (1, 997, 4096):
        whole, language.SLICE = language.SLICE, size
        try:
            got = language.text_vectors(data[:3000] if size == 1 else data, np.array([0, 3000]) if size == 1 else at, 64)
        finally:
            language.SLICE = whole
        assert np.array_equal(got, language.text_vectors(data[:3000], np.array([0, 3000]), 64) if size == 1 else want)
    words = "é日 " * 5 + "w" * 300 + " a\tb " + "".join(rng.choices("ab \n", k=5000))
    raw = np.frombuffer(words.encode(), np.uint8)
    spans = textnp.word_spans(raw, np.array([0, 7, 7, 400, len(raw)]))
    hashes = textnp.word_hashes(raw, *spans[:2])
    for size in (16, 64, 1000):
        whole, textnp.SLICE = textnp.SLICE, size
        try:
            again = textnp.word_spans(raw, np.array([0, 7, 7, 400, len(raw)]))
            assert all(np.array_equal(a, b) for a, b in zip(spans, again, strict=True)) and np.array_equal(hashes, textnp.word_hashes(raw, *again[:2]))
        finally:
            textnp.SLICE = whole


ARTICLE = ["A heading &amp; more", "First <b>bold</b>word paragraph\n with   space.", "Be.", "A <a href='/x'>link</a> line<br>broken", "Last one &lt;here&gt;&nbsp;now"]
WANT = "A heading & more First boldword paragraph with space. Be. A link line broken Last one <here> now"
AROUND = (
    "<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a='<p>x</p>';</script></head><body class='has-sidebar'><header><h2>Site</h2></header><nav><ul><li><a href='/'>Home</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies, a rather long notice that goes on and on.</div><!-- <p>no</p> --><div class=\"ad\">Buy now, a long advert text that nobody wants to read at all.</div>",
    "<aside class=sidebar><p>Other things to read, quite long too.</p></aside><form><label>Name</label><textarea>t</textarea><button>Go</button></form>"
    "<section id='comments'><article class='comment'><p>Great article, I have read it twice and told my friends, all of them, about it at length.</p></article></section><footer>&copy; site</footer></body></html>")


@pytest.mark.parametrize("open_,close", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"), ("<div><div>", "</div></div>")])
@pytest.mark.parametrize("inner", ["", "<div class='ad'>An advert in the middle of it all</div>", "<aside>See also</aside>"])
def test_main_text(open_, close, inner):
    body = f"<h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}<p>{ARTICLE[2]}</p>{inner}<p>{ARTICLE[3]}</p><p><b>{ARTICLE[4]}<br>"
    assert html_text.main_text(AROUND[0] + open_ + body + close + AROUND[1]) == WANT


LONG = "A paragraph of the article that has quite a few words, so that it is taken for prose wherever it stands {}."


@pytest.mark.parametrize("open_,close", [("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<main><article>", "</article></main>"), ("<div>", "</div>"), ("<div><div class='text'>", "</div></div>")])
@pytest.mark.parametrize("between", [
    "<table><tbody><tr><td>x</td></tr></tbody></table>", "<div><div><table><tr><td>x</td></tr></table></div></div>", "<section><div><div><ul><li>x</li></ul></div></div></section>",
    "</div></div><div><div>x</div></div><div><div>", "<article><h2>x</h2></article>"])
def test_an_article_in_several_stretches(open_, close, between):
    if "</div></div><div>" in between:
        open_, close = open_ + "<div><div>", "</div></div>" + close
    elif "<article" in between and "<div" == open_[:4]:
        between = "<section><div><h2>x</h2></div></section>"  # a page that marks anything gives what it marks
    html = AROUND[0] + open_ + f"<h1>T</h1><p>{LONG.format(1)}</p>{between}<p>{LONG.format(2)}</p>{between}<section><div><p>B.</p></div></section>" + close + AROUND[1]
    assert html_text.main_text(html) == f"T {LONG.format(1)} x {LONG.format(2)} x B."


def test_sections_of_an_unmarked_page():
    html = AROUND[0] + "".join(f"<section><div><div><p>{LONG.format(i)}</p></div></div></section>" for i in range(4)) + AROUND[1]
    assert html_text.main_text(html) == " ".join(LONG.format(i) for i in range(4))


@pytest.mark.parametrize("form", ["<form id='aspnetForm' method=post>", "<form name=f id=form1 action='./search.aspx'>", "<form>"])
@pytest.mark.parametrize("open_,close", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>")])
def test_a_form_around_the_page(form, open_, close):
    page = "<input type=hidden value=x><div><label for=q>Find</label><input id=q><select><option>One</select><button>Go</button></div>"
    html = "<body>" + form + page + open_ + f"<h1>T</h1><p>{LONG.format(1)}</p><p>B.</p>" + close + "</form></body>"
    assert html_text.main_text(html) == f"T {LONG.format(1)} B."
    assert html_text.main_text(f"<body>{form}<div>{LONG.format(1)}</div></form></body>") == LONG.format(1)
    assert html_text.main_text(f"<body><article>{LONG.format(1)}{form}<div><label>{LONG.format(2)}</label> Go <input></div></form></article>") == LONG.format(1)


@pytest.mark.parametrize("attributes", ['href="/hidden-gems"', "href=/hidden/id=comments", 'title="The hidden city"', 'data-hidden="false"', "href='/x?a=1&id=comments'", 'data-class="ad"', 'title="a role=menu b"', 'title = "x style=display:none"'])
def test_attributes_are_whole_names(attributes):
    for name in ("a", "p", "section"):
        assert html_text.main_text(f"<article><p>One</p><{name} {attributes}>two</{name}><p>three</p></article>") == "One two three"


@pytest.mark.parametrize("attributes", ["hidden", 'x="1" HIDDEN', "data-x hidden=''", "aria-hidden=true", 'href="/a"class="ad"', "title='a' id = comments", "class=ad/", 'style="display: none"'])
def test_attributes_that_drop(attributes):
    assert html_text.main_text(f"<article><p>One</p><div {attributes}>two</div><p>three</p></article>") == "One three"


@pytest.mark.parametrize("inner,want", [
    ("<svg class='i'/>", ""), ("<svg class='i'><text>no</text></svg>", ""), ("<iframe src=x><p>two</p>", "two "),
    ("<p title='a hidden gem'>two</p>", "two "), ("<p data-x='hidden'>two</p>", "two "), ("<a href='/p?id=comments'>two</a>", "two "),
    ("<div class='market-share'>two</div>", "two "), ("<div class='share-buttons'>two</div>", ""), ("<div class='x-sidebar'>two</div>", ""), ("<div class='col related posts'>two</div>", ""),
    ("<div class='ad'>two</div>", ""), ("<article><h2>two</h2></article>", "two ")])
def test_elements_inside_an_article(inner, want):
    assert html_text.main_text(f"<body><article><p>{LONG.format(1)}</p>{inner}<p>{LONG.format(2)}</p></article><footer>x</footer></body>") == f"{LONG.format(1)} {want}{LONG.format(2)}"


def test_paragraphs_around_empty_containers():
    page = f"<body><div><p>{LONG.format(1) * 3}</p><div></div><div></div><div></div><p>{LONG.format(2) * 3}</p></div><div></div><div></div><div>Short</div><footer>x</footer></body>"
    assert html_text.main_text(page) == f"{LONG.format(1) * 3} {LONG.format(2) * 3}"


def test_the_density_overrules_a_mark_that_holds_little():
    page = f"<body><article><p>A teaser.</p></article><div>{''.join(f'<p>{LONG.format(i)}</p>' for i in range(5))}</div></body>"
    assert html_text.main_text(page) == " ".join(LONG.format(i) for i in range(5))
    page = f"<body><article>{LONG.format(1)}</article><div></div><article>{LONG.format(2)}</article><article>Short</article></body>"
    assert html_text.main_text(page) == f"{LONG.format(1)} {LONG.format(2)}"


def test_threshold_depends_on_the_page():
    weight = np.array([3, 0, 0, 0, 400, 300, 0, 200, 0, 0, 0, 5, 0, 0, 0, 0, 350.0])
    assert [x[:2] for x in html_text.stretches(weight)] == [(2, 8), (14, 17)]
    assert [x[:2] for x in html_text.stretches(weight[:1])] == [(0, 1)] and html_text.stretches(np.zeros(4)) == []


def generated_page(seed):
    """A page without <article> or <main>, and its main text: blocks of any length, each page in its own layout, between
    menus, adverts, notices, side columns and comments."""
    rng = random.Random(seed)

    def words(low, high):
        return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def menu():
        return "<ul>" + "".join(f"<li><a href='/{i}'>{words(1, 2)}</a></li>" for i in range(rng.randint(3, 8))) + "</ul>"

    def block(text, depth):
        kind = rng.choice(["p", "p", "p", "li", "td", "section", "quote"])
        text = f"{text[:len(text) // 2].rstrip()}&nbsp;<b>{text[len(text) // 2:].lstrip()}</b>"
        return {"p": f"<p>{text}</p>", "li": f"<ul><li>{text}</li></ul>", "td": f"<table><tr><td>{text}</td></tr></table>", "section": f"<section><div><div><p>{text}</p></div></div></section>", "quote": f"<blockquote>{text}</blockquote>"}[kind]

    def advert():
        name = rng.choice(["ad", "advert-box", "cookie-notice", "newsletter signup", "social-share", "related-posts"])
        return f"<div class='{name}'><p>{words(5, 40)}</p></div>" if rng.random() < 0.3 else ""

    texts = [words(3, 8)] + [words(*rng.choice([(2, 5), (30, 90), (30, 90)])) + "." for _ in range(rng.randint(3, 12))]
    texts[1] = words(30, 60)
    body = f"<h1>{texts[0]}</h1>" + "".join(advert() + block(t, 0) for t in texts[1:])
    for _ in range(rng.randint(0, 3)):
        body = f"<div class='{rng.choice(['c', 'content', 'text market-share'])}'>{body}</div>"
    side = rng.choice(["<div id=sidebar>{}</div>", "<aside>{}</aside>", "<div class='comments'>{}</div>"]).format(f"<p>{words(20, 60)}</p>")
    page = f"<body><header><h2>{words(1, 3)}</h2></header><nav>{menu()}</nav><div>{menu()}</div>{'<div><div>' * 2}{body}{'</div></div>' * 2}{side}<form><input><label>{words(2, 9)}</label></form><footer>{words(3, 20)}</footer></body>"
    return page, " ".join(" ".join(" ".join((t[:len(t) // 2].rstrip(), t[len(t) // 2:].lstrip())).split()) if i else t for i, t in enumerate(texts))


def test_generated_pages_without_marks():
    wrong = [seed for seed in range(400) if html_text.main_text(generated_page(seed)[0]) != generated_page(seed)[1]]
    assert not wrong


def test_pages_edge_cases(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Only.</article>"), (2, None, None), (3, "u", ""), (4, "u", "<nav>x</nav>"), (5, "u", "plain text"), (6, "u", "<article><p>cut of"), (7, "u", "<a <b < c & d"), (1, "u", "<article><p>Only.</article>")], "page_id long, url string, html string")
    out = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_pages(pages).collect())
    assert [x[:2] for x in out][:7] == [(1, "Only."), (1, "Only."), (2, ""), (3, ""), (4, ""), (5, "plain text"), (6, "cut of")] and out[0][2] == 5
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_pages_of_the_tables(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_text.extract_pages(pages, keep=("page_id", "url", "html")).collect():
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(unescape(re.sub("<[^>]*>", "", re.sub("<(/?p|br|/?h1)>", " ", body))).split())


PROSE_LINE = "This is paragraph number {} of the article, with enough words in it to be prose and to be longer than a menu line, surely."
READER = "I have read this twice and told all of my friends about it, as it is by far the best thing that I have seen in the whole year."


@pytest.mark.parametrize("name", ["comments-thread", "reader-comments-thread", "user-comments-2", "post-comment"])
@pytest.mark.parametrize(("open_", "close"), [("<article>", "</article>"), ("<div id=story>", "</div>"), ("<main><div>", "</div></main>")])
def test_reader_comments_go_whatever_else_their_name_says(name, open_, close):
    html = f"<body><nav><a href=/>Home</a></nav>{open_}<h1>T</h1><p>{PROSE_LINE.format(1)}</p><p>{PROSE_LINE.format(2)}</p><div class='{name}'><p>{READER}</p></div>{close}</body>"
    assert html_text.main_text(html) == f"T {PROSE_LINE.format(1)} {PROSE_LINE.format(2)}"
    state = f"<body><article class='post comments-open'><h1>T</h1><p>{PROSE_LINE.format(1)}</p></article></body>"
    assert html_text.main_text(state) == f"T {PROSE_LINE.format(1)}"


@pytest.mark.parametrize("name", "responses replies related search share copyright disclaimer tracking".split())
def test_sections_of_an_article_about_such_a_subject_stay(name):
    page = "<body><main><h1>T</h1><p>{}</p><section id={}>{}</section></main></body>"
    assert html_text.main_text(page.format(PROSE_LINE.format(1), name, f"<h2>H</h2><p>{PROSE_LINE.format(2)}</p>")) == f"T {PROSE_LINE.format(1)} H {PROSE_LINE.format(2)}"
    for other in (f"<ul><li><a href=/>{READER}</a></li></ul>", f"<div class=author>Ann</div><p>{READER}</p>", "<p>Short.</p>", f"<p><a href=/>{READER}</a></p>"):
        assert html_text.main_text(page.format(PROSE_LINE.format(1), name, other)) == f"T {PROSE_LINE.format(1)}"


@pytest.mark.parametrize("other", ["<div id=foot><p>{}</p></div>", "<div class='legal'><p>{}</p></div>", "<div class='colophon'>{}</div>", "<div id='zz9'><p>{}</p></div>"])
@pytest.mark.parametrize(("open_", "close"), [("<div id=story>", "</div>"), ("<div>", "</div>"), ("", "")])
def test_neighbours_of_any_name_stay_out(other, open_, close):
    body = "<h1>T</h1>" + "".join(f"<p>{PROSE_LINE.format(k)}</p>" for k in range(4))
    html = f"<body><div class=x1><a href=/>Home</a> <a href=/b>B</a></div>{open_}{body}{close}{other.format('All of this is by us and ours alone.')}</body>"
    assert html_text.main_text(html) == "T " + " ".join(PROSE_LINE.format(k) for k in range(4))


def test_a_last_paragraph_that_is_all_link_stays():
    html = f"<body><div id=story><h1>T</h1><p>{PROSE_LINE.format(1)}</p><p>{PROSE_LINE.format(2)}</p><p><a href=x>Read the whole report</a></p></div><div class=z><a href=/>x</a></div></body>"
    assert html_text.main_text(html) == f"T {PROSE_LINE.format(1)} {PROSE_LINE.format(2)} Read the whole report"
    nested = "<article>" + "<section id=share>" * 3000 + "x"  # one look at an open section, not one for each
    assert html_text.main_text(nested) == ""


def test_a_very_long_page():
    body = "".join(f"<p>{PROSE_LINE.format(k)}</p>" for k in range(20_000))
    for open_, close in (("<article>", "</article>"), ("<div id=story>", "</div>")):
        assert html_text.main_text(f"<body><nav><a href=/>x</a></nav>{open_}{body}{close}</body>") == " ".join(PROSE_LINE.format(k) for k in range(20_000))


CLAUSES = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

  * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
  * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY {} ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
ENDORSE = "  * Neither the name of {} nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n"
OFTEN_SEEN = {
    CLAUSES.format(ENDORSE.format("Google Inc."), "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"): "BSD-3-Clause",
    CLAUSES.format(ENDORSE.format("the University of\nNowhere, Dept. 7"), "JANE DOE, Inc."): "BSD-3-Clause",
    CLAUSES.format("", "JANE DOE"): "BSD-2-Clause",
    "This project is licensed under the terms of the MIT license.": "MIT",
    "Distributed under the MIT License.": "MIT",
    "Released under the Apache License 2.0.": "Apache-2.0",
    "The MIT License (MIT)": "MIT",
    "Licensed under the MIT license": "MIT",
    "Made available under the\nterms of the Eclipse Public License 2.0.": "EPL-2.0",
    "Boost Software License - Version 1.0 - August 17th, 2003": "BSL-1.0",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "This work is shared under the Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0",
    "Licensed under CC BY-ND 4.0": "CC-BY-ND-4.0",
    "Licensed under the GNU GPL v3 or later.": "GPL-3.0-or-later",
    "Licensed under the GNU General Public License v2.0": "GPL-2.0-only",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
    "# SPDX-License-Identifier: GPL-2.0": "GPL-2.0-only",
    "SPDX-License-Identifier: LGPL-2.1+": "LGPL-2.1-or-later",
    "// SPDX-License-Identifier: (GPL-2.0+ WITH Linux-syscall-note-exception) AND (BSD-3-Clause OR ISC)": "BSD-3-Clause,GPL-2.0-or-later,ISC",
    "We talk about the MIT license here.": "",
    "It is distributed under the sea, with the mit of the night.": "",
    "Nobody but MIT was licensed under the bridge.": "",
}


def test_notices_that_are_often_seen(spark):
    rows = spark.createDataFrame(list(enumerate(OFTEN_SEEN)), "doc_id long, text string")
    got = {r["doc_id"]: ",".join(r["licences"]) for r in licenses.scan_licences(rows).collect()}
    assert list(got[i] for i in range(len(OFTEN_SEEN))) == list(OFTEN_SEEN.values())
