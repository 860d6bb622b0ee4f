"""Licence scans by sentence rules, in Spark expressions only (operator 7).

A text is lower-cased, its sentence ends and line breaks become marks, and all else than a-z and 0-9 becomes one space.
Each sentence so normalised is looked up among the known licence sentences, in three readings: with lines as sentences,
with lines joined (for wrapped licence texts), and with lines joined up to a blank line (for whole notices). In the last
one copyright lines, addresses and what ends in "conditions:" or "are met:" are sentences of their own, and the parts
into which a listed sentence falls by its own punctuation (NOTICE_SENTENCES) are known as well. A sentence that isn't
listed but grants ("... is released under the terms of the MIT licence, see ...") or tags (SPDX) is known by the licence
name after it: the name is normalised (spelling, articles, "version", "v2"), and the longest listed name that it begins with
gives the identifier. The identifiers found, in order, are matched against the rules: a rule holds where its identifiers
follow each other in one of the readings, and a licence's short rule gives way to that of its notice or text.

Defined cases: a null, empty or blank text has no sentences; a sentence found twice counts twice; of names that begin
alike the longest counts; very long texts are read whole; rows of equal doc_id each come back; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences in normal form, by identifier.
SENTENCES = {
    "apache.short": ["licensed under the apache license version 2 0", "licensed under the apache license 2 0", "released under the apache license version 2 0", "this project is licensed under the apache license version 2 0", "this work is licensed under the apache license version 2 0"],
    "apache.1": ["licensed under the apache license version 2 0 the license"],
    "apache.2": ["you may not use this file except in compliance with the license"],
    "apache.3": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "apache.4": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache.5": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit.short": ["released under the mit license", "licensed under the mit license", "distributed under the mit license", "this project is licensed under the mit license", "this work is licensed under the mit license"],
    "mit.1": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit.2": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit.3": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "bsd.short": ["released under the bsd license", "licensed under the bsd license", "released under the bsd 3 clause license", "licensed under the bsd 3 clause license"],
    "bsd.1": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd.2": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd.3": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "gpl3.short": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "licensed under the gpl version 3", "released under the gpl v3"],
    "gpl2.short": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2", "licensed under the gpl version 2"],
    "gpl.1": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl.2": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl.3": ["see the gnu general public license for more details"],
    "lgpl.short": ["licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 2 1"],
    "agpl.short": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "mpl.short": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "mpl.2": ["if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "ccby.short": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "licensed under the creative commons attribution 4 0 international license"],
    "ccbysa.short": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "ccbync.short": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "ccbynd.short": ["licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"],
    "cc0.short": ["licensed under cc0 1 0", "this work is dedicated to the public domain under cc0 1 0"],
    "reserved": ["all rights reserved"],
}
# Creative Commons attribution licences by their parts, and versions.
_CC_NAMES = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
_CC_LISTED = {"by": "ccby.short", "by-sa": "ccbysa.short", "by-nc": "ccbync.short", "by-nd": "ccbynd.short"}  # of version 4.0
_CC_OTHERS = [(kind, v) for kind in _CC_NAMES for v in ("4 0", "3 0", "2 0") if v != "4 0" or kind not in _CC_LISTED]
# Rules in order; each a licence, its kind and the identifiers that must follow each other.
RULES = [
    ("apache-2.0-notice", "permissive", ["apache.1", "apache.2", "apache.3", "apache.4", "apache.5"]),
    ("apache-2.0", "permissive", ["apache.short"]),
    ("mit-text", "permissive", ["mit.1", "mit.2", "mit.3"]),
    ("mit", "permissive", ["mit.short"]),
    ("mit-0", "permissive", ["mit0.short"]),
    ("bsd-3-text", "permissive", ["bsd.1", "bsd.2", "bsd.3"]),
    ("bsd", "permissive", ["bsd.short"]),
    ("bsd-2-clause", "permissive", ["bsd2.short"]),
    ("isc-text", "permissive", ["isc.1", "isc.2"]),
    ("isc", "permissive", ["isc.short"]),
    ("zlib-text", "permissive", ["zlib.1", "zlib.2", "zlib.3"]),
    ("zlib", "permissive", ["zlib.short"]),
    ("bsl-1.0-text", "permissive", ["boost.1"]),
    ("bsl-1.0", "permissive", ["boost.short"]),
    ("unlicense-text", "permissive", ["unlicense.1", "unlicense.2"]),
    ("unlicense", "permissive", ["unlicense.short"]),
    ("artistic-2.0", "permissive", ["artistic.short"]),
    ("postgresql", "permissive", ["postgresql.short"]),
    ("python", "permissive", ["python.short"]),
    ("gpl-3.0-notice", "copyleft", ["gpl.1", "gpl.2", "gpl.3"]),
    ("gpl-3.0", "copyleft", ["gpl3.short"]),
    ("gpl-2.0", "copyleft", ["gpl2.short"]),
    ("gpl", "copyleft", ["gpl.short"]),
    ("epl", "copyleft", ["epl.short"]),
    ("lgpl", "copyleft", ["lgpl.short"]),
    ("agpl-3.0", "copyleft", ["agpl.short"]),
    ("mpl-2.0-notice", "copyleft", ["mpl.short", "mpl.2"]),
    ("mpl-2.0", "copyleft", ["mpl.short"]),
    ("cc-by-4.0", "permissive", ["ccby.short"]),
    ("cc-by-sa-4.0", "copyleft", ["ccbysa.short"]),
    ("cc-by-nc-4.0", "restricted", ["ccbync.short"]),
    ("cc-by-nd-4.0", "restricted", ["ccbynd.short"]),
    ("cc0-1.0", "permissive", ["cc0.short"]),
    *[(f"cc-{kind}-{v[0]}.{v[2]}", "copyleft" if kind == "by-sa" else "permissive" if kind == "by" else "restricted", [f"cc.{kind}.{v}"]) for kind, v in _CC_OTHERS],
    ("all-rights-reserved", "restricted", ["reserved"]),
]
# Licence names in normal form (articles, "version" and "v" left out), by identifier; unversioned ones need the word.
NAMES = {
    "mit.short": ["mit license", "mit expat license", "expat license", "x11 license", "mit open source license", "mit style license"],
    "mit0.short": ["mit 0 license", "mit no attribution license", "mit 0"],
    "apache.short": ["apache license 2 0", "apache license 2", "apache 2 0", "apache 2", "apache software license 2 0", "apache software foundation license 2 0", "asl 2 0"],
    "bsd.short": ["bsd license", "bsd 3 clause", "3 clause bsd", "new bsd license", "modified bsd license", "revised bsd license", "three clause bsd", "bsd three clause", "bsd style license"],
    "bsd2.short": ["bsd 2 clause", "2 clause bsd", "simplified bsd license", "freebsd license", "two clause bsd", "bsd two clause"],
    "isc.short": ["isc license"],
    "zlib.short": ["zlib license", "zlib libpng license"],
    "boost.short": ["boost software license", "boost license", "bsl 1 0"],
    "unlicense.short": ["unlicense"],
    "artistic.short": ["artistic license 2 0", "perl artistic license 2 0"],
    "postgresql.short": ["postgresql license"],
    "python.short": ["python software foundation license", "psf license"],
    "gpl.short": ["gnu general public license", "gnu gpl", "gpl license", "gpl", "general public license"],
    "mpl.short": ["mozilla public license 2 0", "mozilla public license 2", "mpl 2 0", "mpl 2"],
    "epl.short": ["eclipse public license", "epl 2 0", "epl 1 0"],
    "cc0.short": ["cc0", "creative commons zero", "creative commons cc0"],
}
for _v in (2, 3):
    NAMES[f"gpl{_v}.short"] = [f"{name} {v}" for name in ("gnu general public license", "gnu gpl", "gpl", "general public license") for v in (f"{_v} 0", str(_v))]
for _id, _long in (("lgpl", "lesser"), ("agpl", "affero")):
    NAMES[f"{_id}.short"] = [f"gnu {_long} general public license", f"{_long} general public license", f"gnu {_id}", _id] + ["gnu library general public license"] * (_id == "lgpl")
for _kind, _name in _CC_NAMES.items():
    for _v in ("4 0", "3 0", "2 0"):
        _id = _CC_LISTED[_kind] if _v == "4 0" and _kind in _CC_LISTED else f"cc.{_kind}.{_v}"
        NAMES[_id] = [f"cc {_kind.replace('-', ' ')} {_v}", f"creative commons {_name} {_v}", f"creative commons {_name} license {_v}", f"creative commons {_name} international license {_v}", f"creative commons {_name.replace('noncommercial', 'non commercial').replace('sharealike', 'share alike')} {_v}"]
# Tags of files (SPDX), by identifier.
TAGS = {"mit.short": ["mit"], "mit0.short": ["mit 0"], "apache.short": ["apache 2 0"], "bsd.short": ["bsd 3 clause"], "bsd2.short": ["bsd 2 clause"], "isc.short": ["isc"], "zlib.short": ["zlib"], "boost.short": ["bsl 1 0"], "unlicense.short": ["unlicense"], "artistic.short": ["artistic 2 0"], "postgresql.short": ["postgresql"], "python.short": ["psf 2 0", "python 2 0"], "gpl2.short": ["gpl 2 0"], "gpl3.short": ["gpl 3 0"], "lgpl.short": ["lgpl 2 0", "lgpl 2 1", "lgpl 3 0"], "agpl.short": ["agpl 3 0"], "mpl.short": ["mpl 2 0"], "epl.short": ["epl 1 0", "epl 2 0"], "cc0.short": ["cc0 1 0"]}
TAG = "spdx license identifier "
#: Part of every licence name or its sentence; sentences without it need no look at names.
NAMED = "licen|apache|bsd|gpl|mpl|epl|mit|cc0|cc by|creative commons|asl|bsl"
#: What a licence name follows, and how the name is normalised: (pattern, replacement), in patterns of either engine.
GRANT = r"^(?:.* )?(?:licen[sc]ed|sublicensed|relicensed|released|distributed|redistributed|available|published|provided|offered|covered|shared|issued|governed|made public|open sourced|opensourced|contributed|protected|falls|is|are) (?:free of charge |to you |here |by us )?(?:under|by) (?:(?:the|a|an|our|its|this|following|permissive|standard|free) )*(?:terms (?:and conditions )?of )?(?:(?:the|a|an|our|permissive|standard|free) )*(.+)$"
NAME_FORM = ((r"\blicen[cs]es?\b", "license"), (r"\b(?:the|version|ver|v) ", ""), (r"\b(gpl|lgpl|agpl|apache|mpl|epl|v)(?:v| v)?([1-4])\b", "@1 @2"), (r"\bv ([1-4])\b", "@1"), (r"\bgpl license ([23])\b", "gpl @1"), (r"\bnon commercial\b", "noncommercial"), (r"\bshare alike\b", "sharealike"), (r"\bno ?deriv(?:atives|s)?\b", "noderivatives"))
# What else the reading by paragraphs knows, parts of sentences by their punctuation among them.
_GPL_OPEN = "you can redistribute it and or modify it under the terms of the gnu general public license"
_GPL_HEAD, _GPL_LATER = _GPL_OPEN + " as published by the free software foundation", "either version {} of the license or at your option any later version"
_BSD_USE = "may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_AS_IS = "this software is provided by {} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_FAMILIES = {"gpl": "", "lgpl": "lesser ", "agpl": "affero "}
NOTICE_SENTENCES = {
    "isc.1": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc.2": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "zlib.1": ["this software is provided as is without any express or implied warranty"],
    "zlib.2": ["in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the author be held liable for any damages arising from the use of this software"],
    "zlib.3": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "boost.1": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "unlicense.1": ["this is free and unencumbered software released into the public domain"],
    "unlicense.2": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    **{f"{f}.v": [f"{head} under the terms of the gnu {w}general public license as published by the free software foundation{end}" for head in ("you can redistribute it and or modify it", "this program is free software you can redistribute it and or modify it", "this library is free software you can redistribute it and or modify it") for end in ("", *(f" either version {v} of the license or at your option any later version" for v in ("2", "2 1", "3")))] for f, w in _FAMILIES.items() if w},
    **{f"{f}.see": [f"see the gnu {w}general public license for more details"] for f, w in _FAMILIES.items() if w},
    "apache.3": ["you may obtain a copy of the license at"],
    "mit.1": [SENTENCES["mit.1"][0].removesuffix(" " + SENTENCES["mit.1"][1])],
    "bsd.4": [_BSD_AS_IS.format(who) for who in ("the copyright holders and contributors", "the copyright holder and contributors", "the copyright holders", "the copyright holder", "the author and contributors", "the authors and contributors", "the author", "the authors", "the regents and contributors")],
    "gpl.1a": ["this program is free software"],
    "gpl.1b": [_GPL_HEAD],
    "gpl2.1": [f"this program is free software {_GPL_HEAD} {end}" for end in (_GPL_LATER.format(2), "version 2 of the license", "version 2")] + [f"this program is free software {_GPL_OPEN} version 2 as published by the free software foundation"],
    "gpl2.1b": [f"{_GPL_HEAD} {end}" for end in (_GPL_LATER.format(2), "version 2 of the license", "version 2")] + [f"{_GPL_OPEN} version 2 as published by the free software foundation"],
    "gpl2.1c": [_GPL_LATER.format(2), "version 2 of the license"],
    "gpl3.1": [f"this program is free software {_GPL_HEAD} {end}" for end in ("version 3 of the license", "version 3")],
    "gpl3.1b": [f"{_GPL_HEAD} {end}" for end in (_GPL_LATER.format(3), "version 3 of the license", "version 3")],
    "gpl3.1c": [_GPL_LATER.format(3), "version 3 of the license"],
    "gpl.1d": [f"this program is free software {_GPL_HEAD}"],
    "gpl.2a": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "gpl.2b": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "mpl.short": ["this source code form is subject to the terms of the mozilla public license v"],
    "mpl.2": ["if a copy of the mpl was not distributed with this file you can obtain one at"],
}
#: A name in place of the copyright holder's, which may end in a full stop.
BSD_NAMES = rf"^(neither the name of .*)?nor the names of (its|their) contributors {_BSD_USE}$"
#: Rules for that reading besides RULES, as above.
NOTICE_RULES = [("bsd-2-text", "permissive", ["bsd.1", "bsd.2", "bsd.4"])] + [(f"{f}-notice", "copyleft", [f"{f}.see"]) for f in ("lgpl", "agpl")] + [
    (f"gpl-{v}.0-notice", "copyleft", head + tail)
    for v, whole in ((2, "gpl2.1"), (3, "gpl.1"), (3, "gpl3.1"))
    for head in ([whole], ["gpl.1a", f"gpl{v}.1b"], ["gpl.1a", "gpl.1b", f"gpl{v}.1c"], ["gpl.1d", f"gpl{v}.1c"])
    for tail in (["gpl.2", "gpl.3"], ["gpl.2a", "gpl.2b", "gpl.3"])
]
#: A copyright line or an address, and a blank line or the end of what introduces conditions: with them a sentence ends too.
ALONE = r"(?md)^[^a-z0-9\n]*(?:copyright(?!ed|[^a-z0-9\n]+(?:holder|owner|notice|law|licen|statement|disclaimer|and |or ))|\(c\)|\u00a9)[^\n]*$|https?://[^\s\x01]+"
PARAGRAPH_END = r"\n[^a-z0-9\n\x01]*\n|(?<=conditions|are met|restrictions|the following)[ \t]*:[ \t]*\n"
#: Every known sentence has one of these inside a word, so texts without them need no reading by paragraphs.
CLUES = "licen|software|reserved|redistribut|warranty|mpl|cc0|gpl"
#: Where a sentence ends and where a line does; both are marked by control characters.
SENTENCE_END, LINE_END = r"[.!?;]+(?:[ \t\n\r\f]+|\z)", r"[\n\r]+"


def known() -> dict[str, str]:
    return {s: name for name, texts in SENTENCES.items() for s in texts}


def known_in_notices() -> dict[str, str]:
    return known() | {s: name for name, texts in NOTICE_SENTENCES.items() for s in texts}


def names() -> list[tuple[str, str]]:
    """Licence names and their identifiers, longer names first."""
    listed = [(n, i) for i, found in NAMES.items() for n in found] + [(TAG + n, i) for i, found in TAGS.items() for n in found]
    return sorted(set(listed), key=lambda x: (-len(x[0]), x))


def _texts(values) -> str:
    """SQL literals; one expression text is built much faster than a thousand columns."""
    return ", ".join(f"'{v}'" for v in values)


def _named(sentence: str) -> str:
    """SQL for the identifier of the licence name in a sentence that grants or tags, else null."""
    name = f"CASE WHEN startswith({sentence}, '{TAG}') THEN {sentence} ELSE regexp_extract({sentence}, r'{GRANT}', 1) END"
    for pattern, new in NAME_FORM:
        name = f"regexp_replace({name}, r'{pattern}', r'{new.replace('@', '$')}')"
    listed = names()
    at = f"array_position(transform(array({_texts(n + ' ' for n, _ in listed)}), n -> startswith(name, n)), true)"
    found = f"transform(array({name} || ' '), name -> get(array({_texts(i for _, i in listed)}), int({at}) - 1))"  # the name is taken once
    return f"get({found}, 0)"


def _identifiers(sentences: str, table: dict[str, str]) -> Column:
    """Identifiers of the known sentences in the array column ``sentences``, in order."""
    listed = f"element_at(map_from_arrays(array({_texts(table)}), array({_texts(table.values())})), s)"
    grants = f"startswith(s, '{TAG}') OR (contains(s, ' under ') OR contains(s, ' by ') OR startswith(s, 'under ')) AND rlike(s, '{NAMED}')"
    each = F.expr(f"transform({sentences}, s -> CASE WHEN s IN ({_texts(table)}) THEN {listed} WHEN {grants} THEN {_named('s')} END)")
    return F.filter(each, lambda x: x.isNotNull())


def _plain(text: Column) -> Column:
    """Normal form, with marks for the ends of sentences and lines."""
    marked = F.regexp_replace(F.regexp_replace(text, SENTENCE_END, "\x01\n"), LINE_END, "\x02")
    return F.regexp_replace(marked, "[^a-z0-9\x01\x02]+", " ")


def _paragraphs(text: Column) -> Column:
    """``text`` with marks around what stands alone and at the ends of paragraphs."""
    alone = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), ALONE, "\x01$0\x01")
    return F.regexp_replace(alone, PARAGRAPH_END, "\x01\n")


def _joined(plain: str) -> Column:
    return F.split(F.regexp_replace(plain, "(?<=[^\x01\x02]) ?\x02+ ?", " "), "[ \x02]*\x01[ \x01\x02]*")


def _trimmed(sentences: Column) -> Column:
    return F.transform(sentences, lambda s: F.trim(s))


def _names(sentences: Column) -> Column:
    """The BSD sentence in its listed form, whoever it names."""
    return F.transform(sentences, lambda s: F.when(s.endswith(_BSD_USE) & s.rlike(BSD_NAMES), SENTENCES["bsd.3"][0]).otherwise(s))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones, in the reading that finds most), sentence_ids, licences and strictest kind of every row."""
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _plain(text).alias("plain"), F.when(text.rlike(CLUES), _plain(_paragraphs(text))).otherwise("").alias("parted"))
    readings = {"lines": _trimmed(F.split("plain", " ?[\x01\x02]+ ?")), "joined": _trimmed(_joined("plain")), "noticed": _names(_trimmed(_joined("parted")))}
    rows = rows.select("doc_id", *[x.alias(name) for name, x in readings.items()])
    a, b, c = _identifiers("lines", known()), _identifiers("joined", known()), _identifiers("noticed", known_in_notices())
    rows = rows.select("doc_id", a.alias("a"), b.alias("b"), c.alias("c"))
    two = F.when(F.size("b") > F.size("a"), F.col("b")).otherwise(F.col("a"))
    ids = F.when(F.size("c") > F.greatest(F.size("a"), F.size("b")), F.col("c")).otherwise(two)
    rows = rows.select("doc_id", ids.alias("ids"), F.concat_ws("|", F.lit(""), F.array_join("a", "|"), F.lit("-"), F.array_join("b", "|"), F.lit("-"), F.array_join("c", "|"), F.lit("")).alias("sequence"))
    rules = F.expr("array(" + ", ".join(f"named_struct('name', '{n}', 'kind', '{k}', 'ids', '|{'|'.join(ids)}|')" for n, k, ids in [*RULES, *NOTICE_RULES]) + ")")
    found = F.when(F.size("ids") > 0, F.filter(rules, lambda r: F.col("sequence").contains(r["ids"])))
    rows = rows.withColumn("all", found).withColumn("names", F.transform("all", lambda r: r["name"]))
    whole = lambda r, end: F.array_contains("names", F.concat(r["name"], F.lit(end)))
    rows = rows.withColumn("found", F.filter("all", lambda r: ~whole(r, "-notice") & ~whole(r, "-text")))
    kinds = F.transform("found", lambda r: r["kind"])
    kind = F.when(F.array_contains(kinds, "restricted"), "restricted").when(F.array_contains(kinds, "copyleft"), "copyleft").when(F.array_contains(kinds, "permissive"), "permissive").otherwise("none")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.coalesce(F.array_join(F.array_distinct(F.transform("found", lambda r: r["name"])), ","), F.lit("")).alias("licences"), kind.alias("kind"))
