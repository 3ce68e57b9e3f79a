import re

from shoptide.llm import licences
from shoptide.llm.queries import op9_licences
from tests.llm.data import FOLDER, documents, empty, odd

HEADER = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""


def plain(text):
    """Rules and licences by loops over sentences."""
    best = []
    for cut in (licences.BY_LINE, licences.BY_PARAGRAPH):
        names = {words: name for name, words in licences.SENTENCES.items()}
        sentences = [re.sub("[^a-z0-9]+", " ", s.lower()).strip() for s in re.split(cut.replace("|$", r"|\Z"), text or "")]
        found = [names[s] for s in sentences if s in names]
        best = found if len(found) > len(best) else best
    left, rules, kinds = list(best), [], []
    for name, licence, _, sequences in licences.RULES:
        hit = False
        for at in range(len(left)):
            for sequence in sequences:
                if tuple(left[at:at + len(sequence)]) == sequence:
                    left[at:at + len(sequence)] = [None]
                    hit = True
        if hit:
            rules.append(name)
            kinds.append(licence)
    return ",".join(best), ",".join(rules), ",".join(dict.fromkeys(kinds))


def test_every_known_sentence_has_an_anchor_and_is_normalised():
    for words in licences.SENTENCES.values():
        assert re.search(licences.ANCHORS, words) and words == re.sub("[^a-z0-9]+", " ", words.lower()).strip()
    used = {i for rule in licences.RULES for sequence in rule[3] for i in sequence}
    assert used <= set(licences.SENTENCES)


def test_query_equals_a_plain_version(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = op9_licences(spark, FOLDER).collect()
    assert len(found) == len(texts) and any(r.rules for r in found)
    for r in found:
        assert (r.sentences, r.rules, r.licences) == plain(texts[r.doc_id])


def test_rules_look_at_sequences_in_order(spark):
    texts = [HEADER, "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.",
             "We saw the license of the driver. All rights reserved.", "released under the mit license and more", HEADER.replace("You may obtain", "One may get")]
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.rules for r in rows] == ["apache-header", "apache-notice", "cc-by-nc,mit-notice", "reserved", "", "apache-notice"]
    assert [r.licences for r in rows][:3] == ["Apache-2.0", "Apache-2.0", "CC-BY-NC-4.0,MIT"]


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
SPDX = {"MIT": "mit-notice", "Apache-2.0": "apache-notice", "GPL-3.0-or-later": "gpl-3-header", "GPL-3.0-only": "gpl-3-notice", "CC-BY-NC-4.0": "cc-by-nc",
        "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "BSD-3-Clause": "bsd-3-notice", "BSD-2-Clause": "bsd-2-text"}


def test_sentences_with_a_colon_or_semicolon_inside(spark):
    texts = [GPL, GPL.replace("software:", "software;"), "".join(f" * {line}\n" for line in GPL.split("\n")), "/*\n" + GPL.replace("\n", "\n# ") + "\n*/",
             "This program is free software: take it.", "SPDX-License-Identifier:\n\nMIT or so", "SPDX-License-Identifier. MIT"]
    texts += [line.format(name) for name in SPDX for line in ("SPDX-License-Identifier: {}", "int a;\n// SPDX-License-Identifier: {}\n#include <b>\n",
                                                              "/* spdx-license-identifier: {} */\nint a;")]
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.sentences, r.rules) for r in rows[:4]] == [("GPL3,GPL4", "gpl-3-header")] * 4
    assert [r.rules for r in rows[4:7]] == [""] * 3
    assert [(r.rules, r.licences) for r in rows[7:]] == [(rule, name) for name, rule in SPDX.items() for _ in range(3)]


def test_both_layouts_in_one_document(spark):
    notices = "Released under the MIT License\nLicensed under CC BY 4.0\nAll rights reserved\n"
    many = "Licensed under CC BY 4.0\nall rights reserved\n" * 5
    texts = [HEADER + "\n\n" + notices, many + "\n" + HEADER, "SPDX-License-Identifier: MIT\nx = 1\n\n" + GPL, GPL + "\n\n" + HEADER + "\n" + notices,
             "This project is\nlicensed under the MIT license\n\nAll rights\nreserved\n\nLicensed under CC BY 4.0\nmore"]
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    apache = "APA2,APA3,APA4,APA5,APA6"
    assert [r.sentences for r in rows] == [f"{apache},MIT1,CCB1,RES1", "CCB1,RES1," * 5 + apache, "MIT7,GPL3,GPL4", f"GPL3,GPL4,{apache},MIT1,CCB1,RES1",
                                           "MIT3,RES1,CCB1"]
    assert [r.rules for r in rows] == ["apache-header,cc-by,mit-notice,reserved", "apache-header,cc-by,reserved", "gpl-3-header,mit-notice",
                                       "apache-header,gpl-3-header,cc-by,mit-notice,reserved", "cc-by,mit-notice,reserved"]


def test_odd_rows(spark):
    rows = odd() + [(50, "Released under the MIT License." * 3000, "en", "a"), (50, "\n\nReleased under the MIT License", "en", "a")]
    docs = documents(spark, rows)
    found = licences.scan(docs)
    assert found.columns == [c for c in docs.columns if c != "rules"] + ["n_sentences", "sentences", "rules", "licences"]
    assert sorted((repr(r.doc_id), r.rules) for r in found.collect()) == sorted((repr(i), plain(t)[1]) for i, t, _, _ in rows)
    assert licences.scan(empty(spark)).count() == 0
