"""Licence scans: phrases, and template markup compiled to token automata.

A template is the licence's wording with two marks: ``<<opt>> ... <</opt>>``
around text that may be left out, and ``<<var N>>`` for a place where up to N
other words may stand. It is compiled into an automaton over words; a text is
accepted where the automaton, started at a word, reaches the end with all
mandatory wording matched exactly. Licences stand with their whole wording, so
a text that breaks off or says something else is none; the notices by which
works are put under a licence are templates of their own and score less. The
long licences (Apache, GNU, Mozilla, Creative Commons) are known by notices only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.text_arrow import slices, string_column

#: Phrases and their labels (fixed values).
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE <<var 8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<var 1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. <<var 1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """<<var 1>> Neither the name of <<var 16>> nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var 16>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var 16>> BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = "Permission to use, copy, modify, and<<opt>>/or<</opt>> distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND <<var 8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var 8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: The whole mandatory wording of licences (fixed values), with the marks described above.
TEMPLATES = {
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        <<opt>>files<</opt>> (the <<var 2>>), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice <<opt>>(including the next
        paragraph)<</opt>> shall be included in all copies or substantial portions of the Software. """
        + _AS_IS
    ],
    "bsd-2-clause": [_BSD_CONDITIONS + " " + _BSD_DISCLAIMER],
    "bsd-3-clause": [_BSD_CONDITIONS + " " + _BSD_NAMES + " " + _BSD_DISCLAIMER],
    "isc": [_ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_DISCLAIMER],
    "0bsd": [_ISC_GRANT + ". " + _ISC_DISCLAIMER],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the <<var 4>> be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: <<var 1>> The origin of this software must
        not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
        the product documentation would be appreciated but is not required. <<var 1>> Altered source versions must be plainly marked as such, and
        must not be misrepresented as being the original software. <<var 1>> This notice may not be removed or altered from any source distribution."""
    ],
    "bsl-1.0": [
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
        prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
        following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
        following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless
        such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
        DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
        or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
        software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
        under copyright law. """
        + _AS_IS
    ],
}


def _gnu(name: str, version: str) -> str:
    """The notice by which a program is put under a version of a GNU licence."""
    return f"""free software<<opt>>; you can redistribute it and/or modify it<</opt>> under the terms of the GNU {name} License as published by the
    Free Software Foundation<<opt>>;<</opt>> either version {version} of the License, <<opt>>or (at your option) any later version.<</opt>>"""


def _under(name: str) -> list[str]:
    return [f"licensed under {name}", f"released under {name}", f"distributed under {name}"]


#: Notices that put a work under a licence without its wording (fixed values).
NOTICES = {
    "mit": _under("the MIT License"),
    "apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at <<var 8>> Unless required by applicable law or agreed to in writing, software distributed under the License
        is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
        "under the Apache License<<opt>>, Version<</opt>> 2.0",
    ],
    "gpl-2.0": [_gnu("General Public", "2"), *_under("the GNU General Public License<<opt>>, version<</opt>> 2")],
    "gpl-3.0": [_gnu("General Public", "3"), *_under("the GNU General Public License<<opt>>, version<</opt>> 3")],
    "lgpl-2.1": [_gnu("Lesser General Public", "2.1"), *_under("the GNU Lesser General Public License<<opt>>, version<</opt>> 2.1")],
    "lgpl-3.0": [_gnu("Lesser General Public", "3"), *_under("the GNU Lesser General Public License<<opt>>, version<</opt>> 3")],
    "agpl-3.0": [_gnu("Affero General Public", "3"), *_under("the GNU Affero General Public License<<opt>>, version<</opt>> 3")],
    "mpl-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at <<var 6>>""",
        *_under("the Mozilla Public License<<opt>>, version<</opt>> 2.0"),
    ],
    "cc-by-4.0": ["licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> CC BY 4.0", "Creative Commons Attribution 4.0 International"],
    "cc-by-sa-4.0": ["licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "cc-by-nc-4.0": ["licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
}

#: Scores of a whole licence, a notice, and phrases alone.
WHOLE, NOTICE, PHRASE = 1.0, 0.8, 0.5

#: Quotation marks beyond ASCII (fixed values).
QUOTES = "\u2018\u2019\u201c\u201d\u00ab\u00bb"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words_of(text: str) -> list[str]:
    """A-Z lower-cased; runs of digits, a-z and characters beyond ASCII."""
    return WORD.findall(text.translate(_LOWER))


class TemplateAutomaton:
    """An automaton over words for one template."""

    def __init__(self, template: str):
        self.edges: list[dict[str, list[int]]] = [{}]
        self.any: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        at, opened = 0, []
        for mark, count, text in re.findall(r"<<(/?opt|var) ?(\d*)>>|([^<]+)", template):
            if mark == "opt":
                opened.append(at)
            elif mark == "/opt":
                self.free[opened.pop()].append(at)
            elif mark == "var":
                first = at
                for _ in range(int(count)):
                    at = self._state()
                    self.any[at - 1 if at - 1 >= first else first].append(at)
                end = self._state()
                for s in range(first, end):
                    self.free[s].append(end)
                at = end
            else:
                for word in words_of(text):
                    nxt = self._state()
                    self.edges[at].setdefault(word, []).append(nxt)
                    at = nxt
        self.final = at
        self.closed = [self._closure(s) for s in range(len(self.edges))]
        self.first = {w for s in self.closed[0] for w in self.edges[s]}
        self.first_any = any(self.any[s] for s in self.closed[0])

    def _state(self) -> int:
        self.edges.append({})
        self.any.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def match(self, words: list[str], start: int) -> int | None:
        """The end of the shortest accepted run of words from ``start``, or None."""
        states = set(self.closed[0])
        for i in range(start, len(words)):
            if self.final in states:
                return i
            word, nxt = words[i], set()
            for s in states:
                for t in self.edges[s].get(word, ()):
                    nxt |= self.closed[t]
                for t in self.any[s]:
                    nxt |= self.closed[t]
            if not nxt:
                return None
            states = nxt
        return len(words) if self.final in states else None


class LicenseScanner:
    """Templates with their whole wording and notices; both packs by default, a pack given alone stands alone."""

    def __init__(self, templates: dict[str, list[str]] | None = None, notices: dict[str, list[str]] | None = None):
        if templates is None and notices is None:
            templates, notices = TEMPLATES, NOTICES
        packs = ((templates or {}, True), (notices or {}, False))
        self.automata = [(label, whole, TemplateAutomaton(t)) for pack, whole in packs for label, all_ in pack.items() for t in all_]
        self.starts: dict[str, list[tuple[str, bool, TemplateAutomaton]]] = {}
        for label, whole, a in self.automata:
            if a.final in a.closed[0] or a.first_any:
                raise ValueError(f"a template of {label} must begin with a word of its own")
            for w in a.first:
                self.starts.setdefault(w, []).append((label, whole, a))
        self.phrases: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        for phrase, label in PHRASES.items():
            self.phrases.setdefault(phrase[0], []).append((phrase, label))
        self.watched = self.starts.keys() | self.phrases.keys()

    def scan(self, words: list[str]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, bool]]]:
        """Places of phrases (start, label), and template matches (start, end, label, whole licence).

        Curly quotes are word characters; templates look past them at a word's edges.
        """
        base, found = [], []
        plain = [w.strip(QUOTES) or w for w in words] if any(not w.isascii() for w in words) else words
        if not self.watched.isdisjoint(plain):
            for i, w in enumerate(plain):
                if w in self.watched:
                    for phrase, label in self.phrases.get(words[i], ()):
                        if tuple(words[i : i + len(phrase)]) == phrase:
                            base.append((i, label))
                    for label, whole, a in self.starts.get(w, ()):
                        end = a.match(plain, i)
                        if end is not None:
                            found.append((i, end, label, whole))
        return base, found


def scan_licenses(
    df: DataFrame, templates: dict[str, list[str]] | None = None, notices: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Licence phrases and template matches of every whole text.

    Returns id, n_words, n_base (places of phrases), first_word and last_word
    (their smallest and largest start; null without any), base_labels, labels
    (those of accepted templates too), score (1 with a whole licence, 0.8 with
    a notice, 0.5 with phrases only, else 0) and spans (start, end and label of
    each match, and whether it is a whole licence). Null and empty texts have
    no words; very long texts are scanned whole, in one piece; repeated rows
    are kept, those with null ids too; an empty input gives an empty result.
    """
    rows = df.select(df[id_col].alias("_id"), df[text_col].cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("whole", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(templates, notices)
        for batch in batches:
            for part in slices(batch, "_text"):
                out = []
                for text in string_column(part, "_text").to_pylist():
                    words = words_of(text)
                    base, found = scanner.scan(words)
                    labels = {x[1] for x in base}
                    out.append(
                        (
                            len(words),
                            len(base),
                            min((x[0] for x in base), default=None),
                            max((x[0] for x in base), default=None),
                            ",".join(sorted(labels)),
                            ",".join(sorted(labels | {x[2] for x in found})),
                            WHOLE if any(x[3] for x in found) else NOTICE if found else PHRASE if base else 0.0,
                            [{"start": a, "end": b, "label": c, "whole": d} for a, b, c, d in found],
                        )
                    )
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True))],
                    names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return rows.mapInArrow(
        scan,
        f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, spans array<struct<start: bigint, end: bigint, label: string, whole: boolean>>",
    )
