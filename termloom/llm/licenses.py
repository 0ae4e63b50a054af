"""License scans by sentence rules, in DataFrame functions throughout.

Usual wordings are put into the wording of the known sentences first (WORDINGS). A text is cut into sentences at line ends and after marks that end a sentence, and wrapped lines are joined again; each
sentence is normalised to lower-case ASCII letters and digits parted by single blanks. Known license sentences map to
identifiers. A text's identifiers, in order, are matched against the rules: a rule is an ordered list of identifiers that
must occur in that order, with other sentences allowed between them. A rule yields to the rules that say more: those whose
list holds its own and further sentences, and those that YIELDS names. Each rule is found by one walk along the
identifiers, each sentence from the place where the last one was. Everything is per row: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Known sentences by identifier, in plain wording (fixed values: the licenses' own texts and common notices).
SENTENCES: dict[str, str] = {
    "apache2.notice": "Licensed under the Apache License, Version 2.0.",
    "apache2.notice.you": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache2.comply": "you may not use this file except in compliance with the License.",
    "apache2.obtain": "You may obtain a copy of the License at",
    "apache2.asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2.see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit.notice": "Released under the MIT License.",
    "mit.notice.licensed": "Licensed under the MIT License.",
    "mit.title": "The MIT License (MIT)",
    "mit.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit.include": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3.notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl.free": "This program is free software",
    "gpl.redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl.redistribute.plain": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2.later": "either version 2 of the License, or (at your option) any later version.",
    "gpl.nowarranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl.copy": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl3.notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "bsd.endorse.author": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl2.only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl2.only.license": "you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation",
    "gpl2.either": "either version 2 of the License",
    "gpl3.only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "gpl2.notice": "This work is licensed under the GNU General Public License, version 2.",
    "mpl2.line": "Licensed under the Mozilla Public License, version 2.0.",
    "bsd3.notice": "Licensed under the BSD 3-Clause License.",
    "bsd2.notice": "Licensed under the BSD 2-Clause License.",
    "mpl2.notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl2.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ccbync4.notice": "Licensed under CC BY-NC 4.0.",
    "ccby4.notice": "Licensed under CC BY 4.0.",
    "ccbysa4.notice": "Licensed under CC BY-SA 4.0.",
    "ccby4.work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa4.work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbync4.work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense.public": "This is free and unencumbered software released into the public domain.",
    "unlicense.use": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0.notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "proprietary.reserved": "All rights reserved.",
    "bsd.asis": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd0.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "lgpl.redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl21.later": "either version 2.1 of the License, or (at your option) any later version.",
    "gpl3.later": "either version 3 of the License, or (at your option) any later version.",
    "agpl.redistribute": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "boost.notice": "Distributed under the Boost Software License, Version 1.0.",
    "zlib.asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "epl2.notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "wtfpl.title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "wtfpl.version": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE, Version 2, December 2004",
}

#: Short identifiers of the SPDX list, in lines "SPDX-License-Identifier: ..." (fixed values).
SPDX = (
    "0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "EPL-2.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
_SPDX_LINE = "SPDX-License-Identifier:"
SENTENCES |= {f"spdx.{x.lower()}": f"{_SPDX_LINE} {x}" for x in SPDX}

#: (rule, license, identifiers in order), in the order of reports.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("apache2-line", "Apache-2.0", ("apache2.notice",)),
    ("apache2-header", "Apache-2.0", ("apache2.notice.you", "apache2.asis", "apache2.see")),
    ("mit-line", "MIT", ("mit.notice",)),
    ("mit-licensed-line", "MIT", ("mit.notice.licensed",)),
    ("mit-text", "MIT", ("mit.grant", "mit.include", "mit.asis")),
    ("isc-text", "ISC", ("isc.grant",)),
    ("bsd2-text", "BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("bsd3-text", "BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("gpl3-line", "GPL-3.0", ("gpl3.notice",)),
    ("gpl3-header", "GPL-3.0", ("gpl.free", "gpl.redistribute")),
    ("gpl2-header", "GPL-2.0", ("gpl.free", "gpl.redistribute.plain", "gpl2.later")),
    ("lgpl3-line", "LGPL-3.0", ("lgpl3.notice",)),
    ("mpl2-header", "MPL-2.0", ("mpl2.notice", "mpl2.copy")),
    ("ccbync4-line", "CC-BY-NC-4.0", ("ccbync4.notice",)),
    ("ccbync4-work", "CC-BY-NC-4.0", ("ccbync4.work",)),
    ("ccby4-line", "CC-BY-4.0", ("ccby4.notice",)),
    ("ccby4-work", "CC-BY-4.0", ("ccby4.work",)),
    ("ccbysa4-line", "CC-BY-SA-4.0", ("ccbysa4.notice",)),
    ("ccbysa4-work", "CC-BY-SA-4.0", ("ccbysa4.work",)),
    ("unlicense-text", "Unlicense", ("unlicense.public", "unlicense.use")),
    ("cc0-line", "CC0-1.0", ("cc0.notice",)),
    ("reserved-line", "LicenseRef-All-Rights-Reserved", ("proprietary.reserved",)),
    ("apache2-reference", "Apache-2.0", ("apache2.comply", "apache2.obtain")),
    ("mit-title", "MIT", ("mit.title",)),
    ("bsd2-full", "BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.asis")),
    ("bsd3-full", "BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.asis")),
    ("bsd0-text", "0BSD", ("bsd0.grant",)),
    ("gpl3-header-parts", "GPL-3.0", ("gpl.free", "gpl.redistribute.plain", "gpl3.later")),
    ("gpl-reference", "LicenseRef-GPL", ("gpl.nowarranty", "gpl.copy")),
    ("lgpl21-header", "LGPL-2.1", ("lgpl.redistribute", "lgpl21.later")),
    ("lgpl3-header", "LGPL-3.0", ("lgpl.redistribute", "gpl3.later")),
    ("agpl3-header", "AGPL-3.0", ("agpl.redistribute",)),
    ("bsd3-author", "BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse.author")),
    ("bsd3-line", "BSD-3-Clause", ("bsd3.notice",)),
    ("bsd2-line", "BSD-2-Clause", ("bsd2.notice",)),
    ("gpl2-only", "GPL-2.0-only", ("gpl.free", "gpl2.only")),
    ("gpl2-only-license", "GPL-2.0-only", ("gpl.free", "gpl2.only.license")),
    ("gpl2-line", "GPL-2.0", ("gpl2.notice",)),
    ("gpl3-only", "GPL-3.0-only", ("gpl.free", "gpl3.only")),
    ("mpl2-line", "MPL-2.0", ("mpl2.line",)),
    ("boost-line", "BSL-1.0", ("boost.notice",)),
    ("zlib-text", "Zlib", ("zlib.asis", "zlib.grant")),
    ("epl2-line", "EPL-2.0", ("epl2.notice",)),
    ("wtfpl-title", "WTFPL", ("wtfpl.title",)),
    ("wtfpl-text", "WTFPL", ("wtfpl.version",)),
    *((f"spdx-{x.lower()}", x, (f"spdx.{x.lower()}",)) for x in SPDX),
)

_NAMES = "|".join(x.replace(".", "[.]") for x in sorted(SPDX, key=lambda x: (-len(x), x)))
# What may stand between words: at most one line end, with comment signs (_G) or blanks (_W) about it; an empty line parts sentences.
_G = r"(?:[^A-Za-z0-9\n]+\n?[^A-Za-z0-9\n]*|\n[^A-Za-z0-9\n]*)"
_W = r"(?:[ \t]+(?:\n[ \t]*)?|\n[ \t]*)"
_UNDER = rf"{_W}under{_W}(?:the{_W})?(?:terms{_W}of{_W}the{_W})?"
_LICENSED = rf"(?i)\b(?:licen[sc]ed|released|distributed|available){_UNDER}"

#: Words of a holder's name in a clause, at most.
HOLDER_WORDS = 20

#: Usual wordings and the known sentence's wording, put in its place before a text is cut (pattern, replacement with \\1), in this
#: order: placeholders (whose name stands in the clause), optional words, notices within a longer sentence, and conjunctions of
#: short identifiers, which become a line each. Patterns are such that Java's and RE2's engines read alike.
WORDINGS: tuple[tuple[str, str], ...] = (
    (
        rf"(?i)\bneither{_G}(?:the{_G})?names?{_G}of{_G}(?:[^\s]+{_W}){{1,{HOLDER_WORDS}}}?nor{_G}(?:the{_G})?names?{_G}of{_G}(?:its|their|his|her|any|the|other|contributors|{_G})+may{_G}be{_G}used",
        "Neither the name of the copyright holder nor the names of its contributors may be used",
    ),
    (rf"(?i)\bthe{_G}names?{_G}of{_G}(?:the{_G})?(?:author|authors|copyright{_G}holders?|contributors?){_G}may{_G}not{_G}be{_G}used", "The name of the author may not be used"),
    (rf"(?i)\bmodify,?{_W}and{_W}distribute{_W}this{_W}software{_W}for{_W}any{_W}purpose", "modify, and/or distribute this software for any purpose"),
    (rf"(?i)\b(?:this|the){_W}(?:project|software|code|file|library|package|program|repository|module|plugin|tool){_W}is{_W}(?:licen[sc]ed|released|distributed|made{_W}available|available){_W}under", "\n\nLicensed under"),
    (rf"(?i)\blicen[sc]ed{_UNDER}MIT(?:{_W}licen[sc]e)?\b", "\n\nLicensed under the MIT License.\n\n"),
    (rf"(?i)\b(?:released|distributed|available){_UNDER}MIT(?:{_W}licen[sc]e)?\b", "\n\nReleased under the MIT License.\n\n"),
    (_LICENSED + rf"Apache(?:{_W}licen[sc]e)?(?:,?{_W}v(?:ersion{_W})?|[ \t-]+)2(?:\.0)?{_W}licen[sc]e\b", "\n\nLicensed under the Apache License, Version 2.0.\n\n"),
    (_LICENSED + rf"Apache{_W}licen[sc]e,?{_W}(?:v\.?[ \t]*)?2\.0\b", "\n\nLicensed under the Apache License, Version 2.0.\n\n"),
    (_LICENSED + rf"(?:GPL|GNU{_W}GPL)[ \t-]*(?:v|version)?[ \t]*3(?:\.0)?\b", "\n\nThis work is licensed under the GNU General Public License, version 3.\n\n"),
    (_LICENSED + rf"(?:GPL|GNU{_W}GPL)[ \t-]*(?:v|version)?[ \t]*2(?:\.0)?\b", "\n\nThis work is licensed under the GNU General Public License, version 2.\n\n"),
    (_LICENSED + rf"(?:MPL|Mozilla{_W}Public{_W}licen[sc]e)[ \t,-]*(?:v|version)?\.?\s*2\.0\b", "\n\nLicensed under the Mozilla Public License, version 2.0.\n\n"),
    (_LICENSED + rf"(?:BSD[ \t-]+3[ \t-]+clause|3[ \t-]+clause{_W}BSD|new{_W}BSD|modified{_W}BSD)\b(?:{_W}licen[sc]e\b)?", "\n\nLicensed under the BSD 3-Clause License.\n\n"),
    (_LICENSED + rf"(?:BSD[ \t-]+2[ \t-]+clause|2[ \t-]+clause{_W}BSD|simplified{_W}BSD)\b(?:{_W}licen[sc]e\b)?", "\n\nLicensed under the BSD 2-Clause License.\n\n"),
    (rf"SPDX-License-Identifier:[ \t]*[(]*({_NAMES})[)]* (OR|AND) ", r"\1 \2 "),
    (rf"[(]*\b({_NAMES})[)]* (?:OR|AND) [(]*", f"\n\n{_SPDX_LINE} \\1\n\n{_SPDX_LINE} "),
    (rf"({_SPDX_LINE})[ \t(]*({_NAMES})(?:[^A-Za-z0-9.+-]|[.]\s|$)", "\\1 \\2\n\n"),
)
#: A text without any of these has no wording to replace.
WORDED = r"(?i:licen[sc]|endorse|permission to use)|[A-Z0-9)] (?:OR|AND) "

#: Rules that don't count beside others which say more, though their sentences are no part of those.
YIELDS: dict[str, tuple[str, ...]] = {"gpl-reference": ("gpl3-line", "gpl3-header", "gpl3-header-parts", "gpl2-header"), "mit-title": ("mit-text",), "apache2-reference": ("apache2-header",)}


def stronger(rules=RULES) -> dict[str, tuple[str, ...]]:
    """For each rule those it yields to: rules whose list holds its list, in order, and more; and those of YIELDS."""

    def within(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
        rest = iter(b)
        return len(a) < len(b) and all(x in rest for x in a)

    return {name: tuple(other for other, _, more in rules if within(ids, more) or other in YIELDS.get(name, ())) for name, _, ids in rules}


#: Every known sentence holds one of these; a text without any of them needs no further look.
ANCHORS = "licen|permission|warrant|redistribut|copyright|public|mpl|rights|provided|software"
#: Identifiers that are gathered before they join the ones before them, so that a text of very many costs no square.
BLOCK = 512

_BREAK = r"([.!?;:])[ \t\r]+"
_OTHER = r"[^A-Za-z0-9\n]+"


def worded(text: Column) -> Column:
    """The text in the known sentences' wording."""
    out = text
    for pattern, instead in WORDINGS:
        out = F.regexp_replace(out, pattern, instead.replace("\\1", "$1").replace("\\2", "$2"))
    return F.when(text.rlike(WORDED), out).otherwise(text)


def normal_sentences(text: str) -> list[str]:
    """The same cut and normalisation in plain Python, for tables of sentences and tests."""
    cut = re.sub(_OTHER, " ", re.sub(_BREAK, r"\1\n", text.replace(_SPDX_LINE, _SPDX_LINE.replace(":", " ")))).lower()
    return [s for s in (p.strip(" ") for p in cut.split("\n")) if s]


def sentence_table(sentences: dict[str, str] | None = None) -> dict[str, str]:
    """Normalised sentence to identifier. A known sentence must be one sentence and hold an anchor."""
    table = {}
    for key, text in (sentences or SENTENCES).items():
        parts = normal_sentences(text)
        if len(parts) != 1 or not re.search(ANCHORS, parts[0]):
            raise ValueError(f"{key} is not one sentence with an anchor: {parts}")
        table[parts[0]] = key
    return table


def sentence_ids(text: Column, sentences: dict[str, str] | None = None) -> Column:
    """The identifiers of a text's known sentences, in order.

    Lines that follow each other are joined as far as that gives a known sentence: comment signs at their starts fall to the
    normalisation, and an empty line or a mark that ends a sentence ends it. Of sentences with one start the longest counts.
    """
    table = sentence_table(sentences)
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    begun = sorted({" ".join(words[:n]) for words in map(str.split, table) for n in range(1, len(words) + 1)})
    whole = sorted(table)
    text = worded(text)
    # an empty part after each mark; a mark at a line's end counts as one, too
    text = F.replace(text, F.lit(_SPDX_LINE), F.lit(_SPDX_LINE.replace(":", " ")))
    cut = F.lower(F.regexp_replace(F.regexp_replace(text, r"([.!?;:])(?:[ \t\r]+|(?=\n))", "$1\n\n"), _OTHER, " "))
    opened, strings = "array<struct<line:string,last:boolean>>", "array<string>"
    start = F.struct(F.array().cast(opened).alias("open"), F.array().cast(strings).alias("ids"), F.array().cast(f"array<{strings}>").alias("done"))
    fresh = F.array(F.struct(F.lit("").alias("line"), F.lit(False).alias("last")))

    def step(acc: Column, part: Column) -> Column:
        longer = F.transform(F.concat(acc["open"], fresh), lambda o: F.struct(F.ltrim(F.concat(o["line"], F.lit(" "), part)).alias("line"), o["last"].alias("last")))
        live = F.filter(longer, lambda o: o["line"].isin(begun))
        return F.when(part == "", F.struct(F.array().cast(opened).alias("open"), acc["ids"].alias("ids"), acc["done"].alias("done"))).otherwise(_noted(acc, live))

    def _noted(acc: Column, live: Column) -> Column:
        hit = F.get(F.filter(live, lambda o: o["line"].isin(whole)), F.lit(0))
        full = F.size(acc["ids"]) >= BLOCK  # all but the last, which a longer sentence may replace
        done = F.when(full & hit.isNotNull(), F.concat(acc["done"], F.array(F.slice(acc["ids"], 1, F.size(acc["ids"]) - 1)))).otherwise(acc["done"])
        ids = F.when(full, F.slice(acc["ids"], -1, 1)).otherwise(acc["ids"])
        before = F.when(hit["last"], F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))).otherwise(ids)
        ids = F.when(hit.isNull(), acc["ids"]).otherwise(F.concat(before, F.array(F.try_element_at(known, hit["line"]))))
        marked = F.transform(live, lambda o: F.struct(o["line"].alias("line"), (o["last"] | o["line"].isin(whole)).alias("last")))
        return F.struct(marked.alias("open"), ids.alias("ids"), done.alias("done"))

    parts = F.transform(F.split(cut, "\n", -1), lambda s: F.trim(s))
    ids = F.aggregate(parts, start, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["ids"]))
    return F.when(text.rlike("(?i)" + ANCHORS), ids).otherwise(F.array().cast("array<string>"))


def _holds(line: Column, ids: tuple[str, ...]) -> Column:
    """Whether the identifiers stand in the line (<a><b>...) in this order: each is looked for after the one before."""

    def after(at: Column, sign: Column) -> Column:
        found = F.call_function("locate", sign, line, at)
        return F.when((at > 0) & (found > 0), found + 1).otherwise(F.lit(0))

    return F.aggregate(F.array(*[F.lit(f"<{i}>") for i in ids]), F.lit(1), after) > 0


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules=RULES) -> DataFrame:
    """doc_id, sentence_ids, rules and licenses (arrays) of each row.

    A null or empty text has empty arrays, an empty table an empty result, and long texts are read whole; identifiers repeat as often as their sentences do, rules and licenses are
    reported once, in the order of ``rules``. A rule whose text stands beside that of a stronger rule isn't reported, even if
    it stands there a second time on its own. Repeated rows are scanned each; other columns are ignored.
    """
    found = docs.select(F.col("doc_id").cast("long"), sentence_ids(common.text_or_empty(), sentences).alias("sentence_ids"))
    found = found.withColumn("line", F.concat(F.lit(""), F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")))
    hits = F.array(*[F.when(_holds(F.col("line"), ids), F.struct(F.lit(name).alias("rule"), F.lit(license_).alias("license"))) for name, license_, ids in rules])
    none = F.array().cast("array<struct<rule:string,license:string>>")
    found = found.withColumn("hits", F.when(F.col("line") == "", none).otherwise(F.filter(hits, lambda h: h.isNotNull())))
    over = F.create_map(*[x for name, others in stronger(rules).items() for x in (F.lit(name), F.array(*map(F.lit, others)).cast("array<string>"))])
    names = F.transform("hits", lambda h: h["rule"])
    found = found.withColumn("hits", F.when(F.size("hits") < 2, F.col("hits")).otherwise(F.filter("hits", lambda h: ~F.arrays_overlap(F.try_element_at(over, h["rule"]), names))))
    return found.select("doc_id", "sentence_ids", F.transform("hits", lambda h: h["rule"]).alias("rules"), F.array_distinct(F.transform("hits", lambda h: h["license"])).alias("licenses"))


def digest(found: DataFrame) -> DataFrame:
    joined = {k: F.array_join(k, ",").alias(k) for k in ("sentence_ids", "rules", "licenses")}
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), *joined.values())


def oracle() -> str:
    """DuckDB SQL of ``digest(scan(documents))``.

    It cuts in a way of its own: a paragraph's parts stand between double bars, and each known sentence is a pattern whose
    words are parted by a blank or by bars. Of sentences that begin at one place the longest counts.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(i)}, {quote('[|](' + '(?: |[|][|])'.join(s.split()) + ')[|]')})" for s, i in sentence_table().items())
    rules = ", ".join(f"({n}, {quote(r)}, {quote(x)}, {quote('%' + '%'.join(f'<{i}>' for i in ids) + '%')})" for n, (r, x, ids) in enumerate(RULES))
    over = ", ".join(f"({quote(a)}, {quote(b)})" for a, others in stronger().items() for b in others)
    words = "coalesce(text, '')"
    for pattern, instead in WORDINGS:
        words = f"regexp_replace({words}, {quote(pattern)}, {' || chr(10) || '.join(map(quote, instead.split(chr(10))))}, 'g')"
    words = f"CASE WHEN regexp_matches(coalesce(text, ''), {quote(WORDED)}) THEN {words} ELSE coalesce(text, '') END"
    return rf"""
WITH known(id, pattern) AS (VALUES {known}), rule(n, name, license, pattern) AS (VALUES {rules}), stronger(weak, strong) AS (VALUES {over}),
d AS (SELECT doc_id, row_number() OVER () AS rid, replace({words}, '{_SPDX_LINE}', '{_SPDX_LINE.replace(":", " ")}') AS text FROM documents),
a AS (SELECT rid, regexp_replace(regexp_replace(lower(text), '([.!?;:])([ \t\r]+|\n)', '\1' || chr(10) || chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g') AS t FROM d WHERE regexp_matches(lower(text), '{ANCHORS}')),
p AS (SELECT rid, unnest(string_split_regex(regexp_replace(t, ' ?\n ?', chr(10), 'g'), '\n\n+')) AS par, generate_subscripts(string_split_regex(regexp_replace(t, ' ?\n ?', chr(10), 'g'), '\n\n+'), 1) AS pos FROM a),
b AS (SELECT rid, pos, '||' || replace(trim(par, ' ' || chr(10)), chr(10), '||') || '||' AS par FROM p),
m AS (SELECT rid, pos, par, id, unnest(regexp_extract_all(par, pattern, 1)) AS hit FROM b JOIN known ON regexp_matches(par, pattern)),
o AS (SELECT rid, pos, id, hit, par, row_number() OVER (PARTITION BY rid, pos, id, hit) AS nth FROM m),
s AS (SELECT rid, pos, id, hit, list_aggregate([length(x) FOR x IN list_slice(string_split(par, '|' || hit || '|'), 1, nth)], 'sum') + (nth - 1) * (length(hit) + 2) AS beg FROM o),
w AS (SELECT rid, pos, beg, arg_max(id, length(hit)) AS id FROM s GROUP BY rid, pos, beg),
i AS (SELECT rid, string_agg(id, ',' ORDER BY pos, beg) AS sentence_ids, string_agg('<' || id || '>', '' ORDER BY pos, beg) AS line, count(*) AS n FROM w GROUP BY rid),
g AS (SELECT i.rid, rule.n, name, license FROM i JOIN rule ON i.line LIKE rule.pattern),
h AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM stronger JOIN g AS other ON other.name = stronger.strong WHERE stronger.weak = g.name AND other.rid = g.rid)),
r AS (SELECT rid, string_agg(name, ',' ORDER BY n) AS rules FROM h GROUP BY rid),
l AS (SELECT rid, string_agg(license, ',' ORDER BY n) AS licenses FROM (SELECT rid, license, min(n) AS n FROM h GROUP BY rid, license) GROUP BY rid)
SELECT d.doc_id, coalesce(i.n, 0) AS n_sentences, coalesce(i.sentence_ids, '') AS sentence_ids, coalesce(r.rules, '') AS rules, coalesce(l.licenses, '') AS licenses
FROM d LEFT JOIN i USING (rid) LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)
"""
