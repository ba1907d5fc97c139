"""Licence recognition by sentence rules.

A text is read as normalised words; sentences begin after sentence marks and line breaks. At each beginning the longest
known licence sentence gives its identifier, if it also ends at an end (a sentence may run over line breaks). Short grants
("released under the MIT license") may stand at any word and go on after the licence's name, unless a "not" stands shortly
before; a grant may name several licences ("under MIT or Apache-2.0"). An SPDX line gives an identifier for each licence of its expression. The
identifiers of a text, in order, are then matched against an ordered list of rules: the first rule whose identifiers
stand there in a row gives its licence and uses them up. Copyright lines are known too but stand in no one's way.

Rows are scanned where they are read, without a shuffle; the tables below are all that a task needs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Licence sentences by identifier, in normalised words.
SENTENCES = {
    "apache-short": ["licensed under the apache license version 2.0", "licensed under the apache license 2.0", "released under the apache license version 2.0", "licensed under apache 2.0", "this work is licensed under the apache license version 2.0"],
    "apache-head": ["licensed under the apache license version 2.0 the license"],
    "apache-may-not": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at http www.apache.org licenses license-2.0", "you may obtain a copy of the license at https www.apache.org licenses license-2.0"],
    "apache-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-short": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license", "distributed under the mit license", "mit license", "the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "gpl3-short": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "licensed under the gpl version 3", "licensed under gplv3"],
    "gpl2-short": ["licensed under the gnu general public license version 2", "released under the gnu general public license version 2", "this work is licensed under the gnu general public license version 2", "licensed under gplv2"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-see": ["see the gnu general public license for more details"],
    "bsd-short": ["licensed under the bsd license", "released under the bsd license", "licensed under the bsd 3-clause license"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl-short": ["licensed under the mozilla public license version 2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"],
    "cc-by-short": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa-short": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc-by-nc-short": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-nc-nd-short": ["licensed under cc by-nc-nd 4.0"],
    "cc0-short": ["released under cc0 1.0", "licensed under cc0 1.0", "this work is dedicated to the public domain"],
    "reserved": ["all rights reserved"],
}
_FREE = "this {0} is free software you can redistribute it and or modify it under the terms of the gnu {1} as published by the free software foundation either version {2} of the license or at your option any later version"
_THINGS = ("program", "library", "software", "file")
for _name, _text in (
    ("gpl2-free", (_FREE, "general public license", "2")), ("gpl-free", (_FREE, "general public license", "3")),
    ("lgpl21-free", (_FREE, "lesser general public license", "2.1")), ("lgpl3-free", (_FREE, "lesser general public license", "3")),
    ("agpl3-free", (_FREE, "affero general public license", "3")),
    ("gpl2-only-free", ("this {0} is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",)),
    ("gpl-hope", ("this {0} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",)),
):
    SENTENCES.setdefault(_name, []).extend(_text[0].format(thing, *_text[1:]) for thing in _THINGS)
SENTENCES |= {
    "lgpl-see": ["see the gnu lesser general public license for more details"],
    "agpl-see": ["see the gnu affero general public license for more details"],
    "mit-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-names": [f"neither the name of the copyright {x} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission" for x in ("holder", "owner")],
    "bsd-as-is": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd-liability": [f"in no event shall the copyright {x} or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage" for x in ("holder", "holders", "owner")],
    "isc-grant": [f"permission to use copy modify and {x}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for x in ("or ", "")],
    "isc-as-is": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "isc-liability": ["in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"],
}


def _gnu(long: str, short: str, number: str) -> list[str]:
    """The ways to name a version of a GNU licence."""
    return [f"{g}{long} {v}" for g in ("gnu ", "") for v in (f"version {number}", f"v{number}", number)] + [
        f"{g}{short}{v}" for g in ("gnu ", "") for v in (f" version {number}", f" v{number}", f"v{number}", f"-{number}", f" {number}")]


# Names of licences in short grants, by identifier.
NAMES = {
    "mit-short": ["mit license", "mit licence"], "isc-short": ["isc license"],
    "apache-short": ["apache license version 2.0", "apache license 2.0", "apache license v2.0", "apache 2.0", "apache-2.0"],
    "bsd-short": ["bsd license", "bsd 3-clause license", "3-clause bsd license", "bsd-3-clause license"],
    "bsd2-short": ["bsd 2-clause license", "2-clause bsd license", "bsd-2-clause license", "simplified bsd license"],
    "mpl-short": ["mozilla public license version 2.0", "mozilla public license 2.0", "mozilla public license v2.0", "mpl 2.0"],
    "cc-by-short": ["cc by 4.0", "cc-by-4.0", "creative commons attribution 4.0 international license"],
    "cc-by-sa-short": ["cc by-sa 4.0", "cc-by-sa-4.0", "creative commons attribution-sharealike 4.0 international license"],
    "cc-by-nc-short": ["cc by-nc 4.0", "cc-by-nc-4.0", "creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-nc-nd-short": ["cc by-nc-nd 4.0", "cc-by-nc-nd-4.0"], "cc0-short": ["cc0 1.0", "cc0-1.0"],
    "epl2-short": ["eclipse public license 2.0", "eclipse public license version 2.0", "eclipse public license v2.0", "eclipse public license v 2.0", "epl 2.0", "epl-2.0"],
    "unlicense-short": ["unlicense"], "bsl1-short": ["boost software license 1.0", "boost software license version 1.0", "bsl-1.0"],
    "zlib-short": ["zlib license"],
}
#: Names that stand for a licence only as the whole object of a grant.
BARE = {"mit-short": ["mit"], "isc-short": ["isc"], "bsd-short": ["bsd-3-clause"], "bsd2-short": ["bsd-2-clause"], "mpl-short": ["mpl-2.0"]}
for _family, _long, _short, _numbers in (
    ("gpl2", "general public license", "gpl", ("2", "2.0")), ("gpl3", "general public license", "gpl", ("3", "3.0")),
    ("lgpl21", "lesser general public license", "lgpl", ("2.1",)), ("lgpl3", "lesser general public license", "lgpl", ("3", "3.0")),
    ("agpl3", "affero general public license", "agpl", ("3", "3.0")),
):
    _only = [x for n in _numbers for x in _gnu(_long, _short, n)]
    NAMES[f"{_family}-short"] = _only
    NAMES[f"{_family}-later"] = [f"{x} or {y}" for x in _only for y in ("later", "any later version", "newer", "at your option any later version", "at your option later")] + [f"{x}-or-later" for x in _only]
GRANTS = ("licensed", "dual-licensed", "dual licensed", "released", "distributed", "published", "available", "provided", "made available")
_NOT = frozenset("not never no longer neither nor isn't unless".split())
_JOIN = frozenset(("or", "and"))
# Rules in the order in which they are tried.
RULES = [
    ("Apache-2.0", ["apache-head", "apache-may-not", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-head", "apache-may-not"]),
    ("Apache-2.0", ["apache-short"]),
    ("MIT", ["mit-short", "mit-grant", "mit-notice", "as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is", "mit-liability"]),
    ("MIT", ["mit-short", "mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-short"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("GPL-2.0-only", ["gpl2-short"]),
    ("BSD-3-Clause", ["bsd-short"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-2.0-only", ["gpl2-only-free", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-only", ["gpl2-only-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "gpl-hope", "lgpl-see"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("LGPL-2.1-only", ["lgpl21-short"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope", "lgpl-see"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("LGPL-3.0-only", ["lgpl3-short"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope", "agpl-see"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("AGPL-3.0-only", ["agpl3-short"]),
    ("ISC", ["isc-grant", "isc-as-is", "isc-liability"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-short"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd2-short"]),
    ("BSD", ["bsd-grant"]),
    ("MPL-2.0", ["mpl-short"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-short"]),
    ("CC-BY-4.0", ["cc-by-short"]),
    ("CC0-1.0", ["cc0-short"]),
    ("all-rights-reserved", ["reserved"]),
    ("EPL-2.0", ["epl2-short"]),
    ("Unlicense", ["unlicense-short"]),
    ("BSL-1.0", ["bsl1-short"]),
    ("Zlib", ["zlib-short"]),
]

_WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
_BREAK = re.compile(r"[.!?;:\n]")
#: A known sentence or copyright line has one of these; other texts need no reading.
_SIGN = re.compile(r"licen[cs]e|copyright|permission|rights reserved|public domain|redistribut|warrant|©|\(c\)|cc0|gpl|free software|apache|cc.by|no event|spdx", re.IGNORECASE)
_COPYRIGHT = re.compile(r"(?:copyright|©|\(c\))[^\n]{0,20}?(?:19|20)[0-9]{2}", re.IGNORECASE)


#: SPDX lines: licences joined by AND, OR and WITH (an exception), with brackets.
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*((?:\([ \t]*)*[A-Za-z0-9.+-]+(?:[ \t)]+(?:AND|OR|WITH)[ \t(]+[A-Za-z0-9.+-]+)*)", re.IGNORECASE)
_SPDX_PART = re.compile(r"(WITH[ \t(]+)?(?<![A-Za-z0-9.+-])(?!(?:AND|OR|WITH)\b)([A-Za-z0-9][A-Za-z0-9.+-]*)", re.IGNORECASE)


def _tree(table: dict[str, list[str]], root: dict | None = None) -> dict:
    """Texts as nested words; None leads to the identifier."""
    root = {} if root is None else root
    for name, texts in table.items():
        for text in texts:
            node = root
            for word in text.split():
                node = node.setdefault(word, {})
            node[None] = name
    return root


_SENTENCES, _NAMES, _BARE = _tree(SENTENCES), _tree(NAMES), _tree(BARE)
_GRANTS = _tree({"grant": [f"{g} under{t}" for g in GRANTS for t in (" the", " a", " either the", " either", "")]})


def _longest(root: dict, words: list[str], at: int, ends: list[bool] | None = None) -> tuple[int, str]:
    """(end, identifier) of the longest known text from a word on, (0, "") if there is none; with ``ends`` it must end there."""
    node, i, best = root, at, (0, "")
    while i < len(words) and (node := node.get(words[i])):
        i += 1
        if None in node and (ends is None or ends[i - 1]):
            best = (i, node[None])
    return best


def _named(words: list[str], at: int, ends: list[bool]) -> tuple[int, str]:
    """A licence's name after a grant; a bare name only where nothing but another licence follows."""
    found = _longest(_NAMES, words, at)
    if found[0]:
        return found
    end, name = _longest(_BARE, words, at)
    return (end, name) if end and (ends[end - 1] or words[end] in _JOIN) else (0, "")


def known_sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of the licence sentences, grants and SPDX licences of a text, in order."""
    if not _SIGN.search(text):
        return []
    places = list(_WORD.finditer(text))
    words = [w[0].lower() for w in places]
    ends = [bool(_BREAK.search(text, a.end(), b.start())) for a, b in zip(places, places[1:])] + [True] * bool(words)
    out, at = [], 0
    while at < len(words):
        begins = not at or ends[at - 1]
        end, name = _longest(_SENTENCES, words, at, ends) if begins and words[at] in _SENTENCES else (0, "")
        if not end and words[at] in _GRANTS and (found := _longest(_GRANTS, words, at)[0]) and _NOT.isdisjoint(words[max(0, at - 3) : at]):
            start, here = at, found
            while (one := _named(words, here, ends))[0]:
                out.append((places[start].start(), places[one[0] - 1].end(), one[1]))
                end, start = one[0], one[0] + 1
                here = start if end < len(words) and words[end] in _JOIN and not ends[end - 1] else len(words)
                here += here < len(words) and words[here] in ("the", "a")
            at = max(end, at + 1)
            continue
        if end:
            out.append((places[at].start(), places[end - 1].end(), name))
        at = end or at + 1
    named = [(m.start(1) + p.start(2), m.start(1) + p.end(2), f"spdx:{p[2]}") for m in _SPDX.finditer(text) for p in _SPDX_PART.finditer(m[1]) if not p[1]]
    out += [x for x in named if not any(a < x[1] and x[0] < b for a, b, _ in out)]
    inside = [(m.start(), m.end(), "copyright") for m in _COPYRIGHT.finditer(text)]
    return sorted(out + [c for c in inside if not any(a < c[1] and c[0] < b for a, b, _ in out)])


def licences(identifiers: list[str]) -> list[str]:
    """The licences of an identifier sequence, by the first rule at each place."""
    row = [x for x in identifiers if x != "copyright"]
    out, at = [], 0
    while at < len(row):
        if row[at].startswith("spdx:"):
            out.append(row[at][5:])
            at += 1
            continue
        name, used = next(((n, len(ids)) for n, ids in RULES if row[at : at + len(ids)] == ids), ("", 1))
        if name:
            out.append(name)
        at += used
    return out


def licence_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, identifiers, licences, spans: one row a row of ``docs``.

    n_sentences counts the known sentences; the others are comma-joined in text order (spans: start:end in code
    points), empty if there are none, as for null and empty texts. Repeated rows and doc_ids stay rows of their own;
    whole texts are read. Other columns are ignored whatever their names; an empty table gives an empty table.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [known_sentences(t or "") for t in batch.column(1).to_pylist()]
            names = [[x for _, _, x in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, found), pa.int64()), pa.array([",".join(n) for n in names], pa.string()),
                 pa.array([",".join(licences(n)) for n in names], pa.string()), pa.array([",".join(f"{a}:{b}" for a, b, _ in f) for f in found], pa.string())],
                ["doc_id", "n_sentences", "identifiers", "licences", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_sentences long, identifiers string, licences string, spans string")
