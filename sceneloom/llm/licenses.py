"""Licence scans by sentence rules.

Texts are cut into pieces at line ends and sentence ends and normalised to lower-case words.  A run of
whole pieces becomes a sentence's identifier if it

- reads as a known licence sentence (looked up whole),
- is a reference: a form such as "this project is licensed under the terms of", or the tag of a licence
  identifier, before a licence's name or several of them (either, or, and, with an exception), or such a list alone, or
- comes close to a known sentence of at least LONG words: a named holder or a changed word does no harm.

Ordered licence rules are then matched against the sequence of identifiers, the longest first at each
place, and what they use up is not used again.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_batches, documents

#: Known sentences by identifier, as public licence texts word them.
SENTENCES = {
    "mit-ref": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "Distributed under the MIT License."],
    "mit-title": ["The MIT License (MIT)", "MIT License"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "apache2-ref": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "apache2-comply": ["You may not use this file except in compliance with the License."],
    "apache2-copy": ["You may obtain a copy of the License at"],
    "apache2-asis": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ],
    "gpl3-ref": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0."],
    "gpl2-ref": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "gpl-modify2+": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ],
    "gpl-modify3+": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "gpl-warranty": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ],
    "bsd-may": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ],
    "bsd3-ref": ["Licensed under the BSD 3-Clause License."],
    "bsd2-ref": ["Licensed under the BSD 2-Clause License."],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "mpl2-ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-nc-4-ref": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "cc-by-4-ref": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "cc-by-sa-4-ref": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "no-warranty": [
        "The software is provided \"as is\", without warranty of any kind, express or implied.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ],
    "bsd-disclaimer": ["This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."],
    "gpl-title": ["GNU General Public License"],
    "lgpl-title": ["GNU Lesser General Public License"],
    "agpl-title": ["GNU Affero General Public License"],
    "version-3-2007": ["Version 3, 29 June 2007"],
    "version-3-agpl": ["Version 3, 19 November 2007"],
    "version-2-1991": ["Version 2, June 1991"],
    "version-2.1-1999": ["Version 2.1, February 1999"],
    "lgpl-modify2.1+": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ],
    "agpl-modify3+": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "apache2-title": ["Apache License Version 2.0, January 2004"],
    "epl2-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "unlicense-domain": ["This is free and unencumbered software released into the public domain."],
    "zlib-asis": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "bsl-grant": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ],
    "mpl2-file": ["If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "cc0-dedicate": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."],
}
#: Ordered rules: a licence and the sequence of sentences that states it. Longer sequences stand first.
RULES = [
    ("BSD-3-Clause", ["bsd-may", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("Apache-2.0", ["apache2-ref", "apache2-comply", "apache2-copy", "apache2-asis"]),
    ("BSD-2-Clause", ["bsd-may", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache2-ref", "apache2-copy", "apache2-asis"]),
    ("GPL-2.0-or-later", ["gpl-modify2+", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-modify3+", "gpl-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache2-ref"]),
    ("MIT", ["mit-ref"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("GPL-2.0-only", ["gpl2-ref"]),
    ("GPL-2.0-or-later", ["gpl-modify2+"]),
    ("GPL-3.0-or-later", ["gpl-modify3+"]),
    ("BSD-3-Clause", ["bsd3-ref"]),
    ("BSD-2-Clause", ["bsd2-ref"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl2-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-ref"]),
    ("CC-BY-4.0", ["cc-by-4-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-ref"]),
    ("GPL-3.0-only", ["gpl-title", "version-3-2007"]),
    ("GPL-2.0-only", ["gpl-title", "version-2-1991"]),
    ("LGPL-3.0-only", ["lgpl-title", "version-3-2007"]),
    ("LGPL-2.1-only", ["lgpl-title", "version-2.1-1999"]),
    ("AGPL-3.0-only", ["agpl-title", "version-3-agpl"]),
    ("LGPL-2.1-or-later", ["lgpl-modify2.1+"]),
    ("AGPL-3.0-or-later", ["agpl-modify3+", "gpl-warranty"]),
    ("AGPL-3.0-or-later", ["agpl-modify3+"]),
    ("Apache-2.0", ["apache2-title"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("Unlicense", ["unlicense-domain"]),
    ("Zlib", ["zlib-asis", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("MPL-2.0", ["mpl2-ref", "mpl2-file"]),
    ("CC0-1.0", ["cc0-dedicate"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "no-warranty"]),
    ("MIT", ["mit-grant", "mit-notice", "no-warranty"]),
    ("BSD-3-Clause", ["bsd-may", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer"]),
    ("BSD-2-Clause", ["bsd-may", "bsd-source", "bsd-binary", "bsd-disclaimer"]),
]
#: What licences are called, by identifier; the identifier itself is a name too.
NAMES = {
    "MIT": ["MIT License", "MIT Licence", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache License v2", "Apache License v2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"],
    "ISC": ["ISC License"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL v2", "GPL 2.0"],
    "GPL-2.0-or-later": ["GPL-2.0+", "GPLv2+", "GPL v2+"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL v3", "GPL 3.0"],
    "GPL-3.0-or-later": ["GPL-3.0+", "GPLv3+", "GPL v3+"],
    "LGPL-2.1-or-later": ["LGPL-2.1+", "LGPLv2.1+"],
    "LGPL-3.0-or-later": ["LGPL-3.0+", "LGPLv3+"],
    "AGPL-3.0-or-later": ["AGPL-3.0+", "AGPLv3+"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL 2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3", "LGPL 3.0"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL 3.0"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0", "Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Perl Artistic License 2.0"],
    "WTFPL": ["WTFPL"],
}
#: Forms of a reference; every choice of their parts before a name counts (subject, verb, terms).
NOUNS = "code source software text content documentation data project library package work".split()
SUBJECTS = rf"(?:(?:this|the|our|all|it|its) (?:\w+ ){{0,3}}?(?:is|are) |(?:{'|'.join(NOUNS)})(?: code)? (?:(?:is|are) )?)?(?:dual )?"
VERBS = r"(?:licen[sc]ed|released|distributed|available|published|provided|made available|covered|redistributed|shared)"
TERMS = r" (?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
TAG = r"(?:spdx )?licen[sc]e(?: identifier)? "
#: A known sentence of so many words or more is recognised if so much of its three-word runs is there, and so little else.
LONG, CLOSE = 12, 0.65
#: Exceptions that an expression may add to a licence.
EXCEPTIONS = ["Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Bison-exception-2.2", "Autoconf-exception-3.0", "Linux-syscall-note"]
#: A licence's later versions too: what may follow the name of one that ends in "-only".
LATER = r"(?: (?:or|and)(?: at your option)?(?: any)? (?:later|newer)(?: versions?)?)"
WORD_LICENCE = r"(?: licen[sc]es?)?"
LINK = r" (?:and or |or |and )?(?:the )?"

#: A plus at a word's end is part of it: it tells "or later" apart.
_WORD = re.compile(r"[^\W_]+\+?")
_PIECE = re.compile(r"\n|(?<=[.;:!?])\s+")


def normalise(text: str) -> tuple[str, ...]:
    return tuple(_WORD.findall(text.lower()))


def known_sentences(sentences: dict[str, list[str]] | None = None) -> dict[tuple[str, ...], str]:
    return {normalise(s): k for k, forms in (sentences or SENTENCES).items() for s in forms}


def licence_names(names: dict[str, list[str]]) -> dict[str, str]:
    """Licence by normalised name. A name that two licences share is an error."""
    out: dict[str, str] = {}
    for licence, forms in names.items():
        for name in (" ".join(normalise(n)) for n in [licence, *forms]):
            if out.setdefault(name, licence) != licence:
                raise ValueError(f"two licences have one name: {name}")
    return out


def _runs(words: tuple[str, ...]) -> set[tuple[str, ...]]:
    return {words[i : i + 3] for i in range(len(words) - 2)}


class Sentences:
    """Known sentences, references by name, and the three-word runs of long sentences."""

    def __init__(self, sentences: dict[str, list[str]] | None = None, names: dict[str, list[str]] | None = None) -> None:
        self.known = known_sentences(sentences)
        self.heads, self.most = {k[0] for k in self.known}, max(map(len, self.known), default=0)
        self.names = licence_names(NAMES if names is None and sentences is None else names or {})
        any_name = "(?:" + "|".join(map(re.escape, sorted(self.names, key=len, reverse=True))) + ")"
        with_exception = "(?: with (?:" + "|".join(" ".join(normalise(e)) for e in EXCEPTIONS) + "))?"
        one = f"{any_name}{WORD_LICENCE}{LATER}?{WORD_LICENCE}{with_exception}"
        lead = f"(?:{SUBJECTS}{VERBS}{TERMS}(?:either (?:of )?(?:the )?)?|{TAG}(?:either )?)"
        self.reference = re.compile(f"(?:{lead}(?P<told>{one}(?:{LINK}{one})*)(?: at your option)?|(?P<bare>{one}(?: (?:or|and) {one})+))$") if self.names else None
        self.name = re.compile(f"(?P<link> and or | or | and | )?(?:the )?(?P<name>{any_name}){WORD_LICENCE}(?P<later>{LATER})?{WORD_LICENCE}{with_exception}")
        self.longest_reference = 12 + 3 * max((len(n.split()) for n in self.names), default=0)
        self.long = [(k, ident, _runs(k)) for k, ident in self.known.items() if len(k) >= LONG]
        self.by_run: dict[tuple[str, ...], list[int]] = {}
        for number, (_, _, runs) in enumerate(self.long):
            for run in runs:
                self.by_run.setdefault(run, []).append(number)
        self.reference_heads = {*NOUNS, *"this the our all it its dual spdx license licence".split()} | set(re.findall(r"\w+", VERBS.replace("[sc]", "c") + VERBS.replace("[sc]", "s"))) | {n.split()[0] for n in self.names}

    def exact(self, pieces: list[tuple[str, ...]], i: int) -> tuple[str, int] | None:
        """(identifier, next piece) of the longest known sentence that begins at piece i."""
        best, run, j = None, (), i
        while pieces[i][0] in self.heads and j < len(pieces) and len(run) + len(pieces[j]) <= self.most:
            run, j = run + pieces[j], j + 1
            if run in self.known:
                best = (self.known[run], j)
        return best

    def referred(self, pieces: list[tuple[str, ...]], i: int) -> tuple[str, int] | None:
        """The same for a reference to licences by name; its identifier is the expression of their identifiers."""
        best, run, j = None, (), i
        while self.reference and pieces[i][0] in self.reference_heads and j < len(pieces) and (j == i or len(run) + len(pieces[j]) <= self.longest_reference):
            run, j = run + pieces[j], j + 1
            if m := self.reference.match(" ".join(run)):
                best = (f"ref:{self.expression(m.group('told') or m.group('bare'))}", j)
        return best

    def expression(self, named: str) -> str:
        """Licence identifiers of a list of names, with OR and AND as told; names that only stand side by side count as AND."""
        out = ""
        for m in self.name.finditer(named):
            licence = self.names[m.group("name")]
            if m.group("later") and licence.endswith("-only"):
                licence = licence.removesuffix("-only") + "-or-later"
            out += (" OR " if "or" in (m.group("link") or "").split() else " AND ") * bool(out) + licence
        return out

    def close(self, pieces: list[tuple[str, ...]], i: int) -> tuple[str, int] | None:
        """The same for the known long sentence that a run of pieces comes closest to."""
        first = tuple(w for p in pieces[i : i + 3] for w in p)
        candidates = {n for run in _runs(first) for n in self.by_run.get(run, ())}
        best, score = None, CLOSE
        for number in sorted(candidates):
            key, ident, runs = self.long[number]
            words, j = (), i
            while j < len(pieces) and len(words) < 1.3 * len(key):
                words, j = words + pieces[j], j + 1
                own = _runs(words)
                share = len(own & runs) / max(len(own), len(runs))
                if share > score:
                    best, score = (ident, j), share
        return best


def sentence_ids(text: str, known: Sentences) -> list[str]:
    """Identifiers of the licence sentences in text, in order; at each piece the longest known one, else a reference, else a close one."""
    pieces = [p for p in map(normalise, _PIECE.split(text)) if p]
    found, i = [], 0
    while i < len(pieces):
        hit = known.exact(pieces, i) or known.referred(pieces, i) or known.close(pieces, i)
        if hit:
            found.append(hit[0])
        i = hit[1] if hit else i + 1
    return found


def match_rules(ids: list[str], rules: list[tuple[str, list[str]]]) -> tuple[list[str], list[str]]:
    """Licences whose rules match ids, in order, and the identifiers that no rule used. A reference is a rule by itself and gives each licence it names."""
    licences, rest, i = [], [], 0
    while i < len(ids):
        hit = next((([name], len(seq)) for name, seq in rules if ids[i : i + len(seq)] == seq), None)
        if ids[i].startswith("ref:"):
            hit = (re.split(" OR | AND ", ids[i][4:]), 1)
        if hit:
            licences += hit[0]
        else:
            rest.append(ids[i])
        i += hit[1] if hit else 1
    return licences, rest


def scan(docs: DataFrame, sentences: dict[str, list[str]] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """doc_id, sentence_ids, licences (in order, repeats kept) and unmatched ids of every row of docs.

    A null or empty text has none (empty arrays). Every text is searched whole, repeated rows one by one.
    Other columns of docs are not looked at; an empty table gives an empty table.
    """
    ordered = sorted(rules or RULES, key=lambda r: -len(r[1]))

    def run(batches):
        known = Sentences(sentences)
        for rows, data, off in byte_batches(batches, "text", 1 << 22):
            raw, out = data.tobytes(), ([], [], [])
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                ids = sentence_ids(raw[a:b].decode(), known)
                licences, rest = match_rules(ids, ordered)
                for col, x in zip(out, (ids, licences, rest)):
                    col.append(x)
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), *(pa.array(x, kind) for x in out)], names=["doc_id", "sentence_ids", "licences", "unmatched"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sentence_ids array<string>, licences array<string>, unmatched array<string>")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
