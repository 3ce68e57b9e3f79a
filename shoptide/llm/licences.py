"""Licence scans by sentence rules (operator 9), in column functions only.

A text is split into sentences, at ends of sentences and at line breaks; each is normalised (lower case, letters and digits, single spaces) and looked up
among known licence sentences. The identifiers found, in order, are matched against ordered rules, each a sequence of
identifiers: the first rule that fits takes its identifiers, and the next one looks at what is left. A sentence that has a colon or semicolon inside,
like an SPDX line, is looked up together with the part behind it. Sentences that run over
several lines are found by a second splitting that keeps lines of a paragraph together. What both find is united by position in the text; a
sentence inside another one found is left out.

A sentence without one of the words all known sentences share is not normalised at all. Nulls: a null text has no sentences. Texts are read whole;
repeated rows each have their result; an empty table gives no rows; all other columns stay, but for those named like the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptide.llm.common import fresh

#: Known sentences, normalised, with their identifiers.
SENTENCES = {
    "MIT1": "released under the mit license",
    "MIT2": "licensed under the mit license",
    "MIT3": "this project is licensed under the mit license",
    "MIT4": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
            " the software to deal in the software without restriction including without limitation the rights to use copy modify merge"
            " publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to"
            " do so subject to the following conditions",
    "MIT5": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MIT6": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of"
            " merchantability fitness for a particular purpose and noninfringement",
    "MIT7": "spdx license identifier mit",
    "APA1": "licensed under the apache license version 2 0",
    "APA2": "licensed under the apache license version 2 0 the license",
    "APA3": "you may not use this file except in compliance with the license",
    "APA4": "you may obtain a copy of the license at",
    "APA5": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
            " without warranties or conditions of any kind either express or implied",
    "APA6": "see the license for the specific language governing permissions and limitations under the license",
    "APA7": "spdx license identifier apache 2 0",
    "GPL1": "this work is licensed under the gnu general public license version 3",
    "GPL2": "licensed under the gnu general public license version 3",
    "GPL3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as"
            " published by the free software foundation either version 3 of the license or at your option any later version",
    "GPL4": "you should have received a copy of the gnu general public license along with this program",
    "GPL5": "spdx license identifier gpl 3 0 or later",
    "NCC1": "licensed under cc by nc 4 0",
    "NCC2": "this work is licensed under cc by nc 4 0",
    "NCC3": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "CCB1": "licensed under cc by 4 0",
    "CCB2": "this work is licensed under a creative commons attribution 4 0 international license",
    "CCS1": "licensed under cc by sa 4 0",
    "CCS2": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "BSD1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
            " conditions are met",
    "BSD2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BSD3": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in"
            " the documentation and or other materials provided with the distribution",
    "BSD4": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
            " from this software without specific prior written permission",
    "BSD5": "licensed under the bsd 3 clause license",
    "RES1": "all rights reserved",
}
#: Ordered rules: name, licence, kind, sequences of identifiers of which any will do.
RULES = (
    ("apache-header", "Apache-2.0", "permissive", (("APA2", "APA3", "APA4", "APA5", "APA6"), ("APA1", "APA3", "APA4", "APA5", "APA6"))),
    ("mit-text", "MIT", "permissive", (("MIT4", "MIT5", "MIT6"),)),
    ("bsd-3-text", "BSD-3-Clause", "permissive", (("BSD1", "BSD2", "BSD3", "BSD4"),)),
    ("bsd-2-text", "BSD-2-Clause", "permissive", (("BSD1", "BSD2", "BSD3"),)),
    ("gpl-3-header", "GPL-3.0-or-later", "copyleft", (("GPL3", "GPL4"), ("GPL3",), ("GPL5",))),
    ("gpl-3-notice", "GPL-3.0-only", "copyleft", (("GPL1",), ("GPL2",))),
    ("cc-by-nc", "CC-BY-NC-4.0", "non-commercial", (("NCC1",), ("NCC2",), ("NCC3",))),
    ("cc-by-sa", "CC-BY-SA-4.0", "share-alike", (("CCS1",), ("CCS2",))),
    ("cc-by", "CC-BY-4.0", "permissive", (("CCB1",), ("CCB2",))),
    ("apache-notice", "Apache-2.0", "permissive", (("APA1",), ("APA2",), ("APA7",))),
    ("mit-notice", "MIT", "permissive", (("MIT1",), ("MIT2",), ("MIT3",), ("MIT7",))),
    ("bsd-3-notice", "BSD-3-Clause", "permissive", (("BSD5",),)),
    ("reserved", "proprietary", "reserved", (("RES1",),)),
)
#: Every known sentence has one of these.
ANCHORS = "licen|permission|copyright|warrant|redistribut|reserved"
#: SPDX lines of licences beside those above, and the rules they also fit.
SPDX = {
    "GPL6": ("spdx license identifier gpl 3 0 only", "gpl-3-notice"),
    "NCC4": ("spdx license identifier cc by nc 4 0", "cc-by-nc"),
    "CCB3": ("spdx license identifier cc by 4 0", "cc-by"),
    "CCS3": ("spdx license identifier cc by sa 4 0", "cc-by-sa"),
    "BSD6": ("spdx license identifier bsd 3 clause", "bsd-3-notice"),
    "BSD7": ("spdx license identifier bsd 2 clause", "bsd-2-text"),
}
#: First parts, as written, of known sentences that a colon or semicolon cuts in two.
HEADS = r"(?:spdx-license-identifier|this\s[^a-z0-9]*program\s[^a-z0-9]*is\s[^a-z0-9]*free\s[^a-z0-9]*software)$"
SENTENCE_END = r"[.!?;:]+(?:[ \t\r\n]+|$)"
HITS = "array<struct<start:int,back:int,id:string>>"
BY_LINE = SENTENCE_END + r"|[\r\n]+"
BY_PARAGRAPH = SENTENCE_END + r"|\n[^A-Za-z0-9\n]*\n"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentence_hits(text: Column, cut: str) -> Column:
    """(start, back, id) of the known sentences of ``text`` in order, from the first letter or digit; ``back`` is the end, negative."""
    names = {**SENTENCES, **{name: words for name, (words, _) in SPDX.items()}}
    known = F.create_map(*[F.lit(x) for name, words in names.items() for x in (words, name)])
    parts, cuts = F.split(text, cut, -1), F.regexp_extract_all(text, F.lit(f"(?:{cut})"), F.lit(0))
    following = F.zip_with(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), cuts, lambda p, c: F.when(c.rlike("^[;:]"), p))
    joined = lambda s, after: F.lower(s).rlike(HEADS) & after.isNotNull()
    pair = lambda s, after: F.when(joined(s, after), F.try_element_at(known, F.concat_ws(" ", normalised(s), normalised(after))))
    looked = F.zip_with(parts, following, lambda s, after: F.struct(s.alias("s"), after.alias("after"), pair(s, after).alias("pair"), F.when(
        F.lower(s).rlike(ANCHORS), F.try_element_at(known, normalised(s))).alias("one")))
    steps = F.zip_with(looked, cuts, lambda x, c: F.struct(x.alias("x"), F.coalesce(F.length(c), F.lit(0)).alias("gap")))
    head = lambda s: F.length(s) - F.length(F.regexp_replace(s, "^[^A-Za-z0-9]+", ""))
    tail = lambda s: F.length(F.regexp_replace(s, "([A-Za-z0-9])[^A-Za-z0-9]+$", "$1"))

    def step(seen: Column, y: Column) -> Column:
        x, at = y["x"], seen["at"]
        after = at + F.length(x["s"]) + y["gap"]
        end = F.when(x["pair"].isNotNull(), after + tail(x["after"])).otherwise(at + tail(x["s"]))
        hit = F.struct((at + head(x["s"])).alias("start"), (-end).alias("back"), F.coalesce(x["pair"], x["one"]).alias("id"))
        return F.struct(after.alias("at"), F.when(hit["id"].isNotNull(), F.array_append(seen["hits"], hit)).otherwise(seen["hits"]).alias("hits"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(HITS).alias("hits")), step, lambda seen: seen["hits"])


def united(lines: Column, paragraphs: Column) -> Column:
    """Identifiers of the hits of both splittings, in order, without those inside others."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("ids"))
    return F.aggregate(F.array_sort(F.concat(lines, paragraphs)), start, lambda seen, x: F.when(-x["back"] > seen["end"], F.struct(
        (-x["back"]).alias("end"), F.array_append(seen["ids"], x["id"]).alias("ids"))).otherwise(seen), lambda seen: seen["ids"])


def _rule_pattern(sequences: tuple[tuple[str, ...], ...]) -> str:
    return "|".join("".join(f"{i} " for i in sequence) for sequence in sequences)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sentences`` (identifiers), ``rules`` and ``licences``, each in order and joined by commas, and ``n_sentences``."""
    docs, body = docs.drop("n_sentences", "sentences", "rules", "licences"), docs[text]
    ids, matched = fresh(docs, "ids", "matched")
    # One expression, so that only texts with an anchor are cut.
    found = F.when(F.lower(body).rlike(ANCHORS), united(sentence_hits(body, BY_LINE), sentence_hits(body, BY_PARAGRAPH)))
    listed = docs.select("*", F.coalesce(found, F.array().cast("array<string>")).alias(ids))
    left = F.concat(F.array_join(ids, " "), F.lit(" "))
    fits = []
    for name, licence, kind, sequences in RULES:
        pattern = _rule_pattern(sequences + tuple((i,) for i, (_, rule) in SPDX.items() if rule == name))
        fits.append(F.when(left.rlike(pattern), F.struct(F.lit(name).alias("rule"), F.lit(licence).alias("licence"))))
        left = F.regexp_replace(left, pattern, " ")
    found = listed.select("*", F.array_compact(F.array(*fits)).alias(matched))
    return found.select(*[found[c] for c in docs.columns], F.size(ids).cast("bigint").alias("n_sentences"),
                        F.array_join(ids, ",").alias("sentences"),
                        F.array_join(F.transform(matched, lambda f: f["rule"]), ",").alias("rules"),
                        F.array_join(F.array_distinct(F.transform(matched, lambda f: f["licence"])), ",").alias("licences"))
