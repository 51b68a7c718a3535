"""Operator 3: license scans by template-markup matching.

Templates are full license texts, and short notices that license by themselves, in which ``<<beginOptional>> ... <<endOptional>>`` marks wording that may
be missing and ``<<var;N>>`` a replaceable place of at most N words.  They are compiled together to one
automaton over words; a text is accepted from a place if its words there agree exactly with all
mandatory wording of a template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases whose words are looked for as they are, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or
substantial portions of the Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"""
_CLAIM = """BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """Neither the name of <<var;12>> nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var;12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;12>> BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
_GPL_NOTICE = "under the <<beginOptional>>terms of the <<endOptional>>GNU {} Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either <<endOptional>>version {}"

#: Full public license texts, then the short notices that are licensing statements of their own, in template markup, and their labels.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", f"{_GRANT} {_AS_IS} THE AUTHORS OR COPYRIGHT HOLDERS {_CLAIM}"),
    ("json", f"{_GRANT} The Software shall be used for Good, not Evil. {_AS_IS} THE AUTHORS OR COPYRIGHT HOLDERS {_CLAIM}"),
    ("x11", f"""{_GRANT} {_AS_IS} THE X CONSORTIUM {_CLAIM} Except as contained in this notice, the name of the X Consortium shall not be used in advertising
or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."""),
    ("isc", f"""Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_TAIL}"""),
    ("0bsd", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_TAIL}"),
    ("bsd-2", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("bsd-3", f"{_BSD_HEAD} <<beginOptional>>3. <<endOptional>>{_BSD_NAME} {_BSD_TAIL}"),
    ("bsd-4", f"""{_BSD_HEAD} <<beginOptional>>3. <<endOptional>>All advertising materials mentioning features or use of this software must display the following
acknowledgement: This product includes software developed by <<var;20>> <<beginOptional>>4. <<endOptional>>{_BSD_NAME} {_BSD_TAIL}"""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source
versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""),
    ("bsl-1", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered
by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to
permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement,
including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all
derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language
processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER
LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("unlicense", f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize
copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the
benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS {_CLAIM}"""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
of the License at <<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
<<beginOptional>>You can<<endOptional>><<beginOptional>>you can<<endOptional>> obtain one at <<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>>://mozilla.org/MPL/2.0/."""),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-2", _GPL_NOTICE.format("General", 2)),
    ("gpl-3", _GPL_NOTICE.format("General", 3)),
    ("lgpl-2.1", _GPL_NOTICE.format("Lesser General", "2.1")),
    ("lgpl-3", _GPL_NOTICE.format("Lesser General", 3)),
    ("agpl-3", _GPL_NOTICE.format("Affero General", 3)),
    ("cc-by-nc", "licensed under <<var;6>> CC BY-NC <<beginOptional>>4.0<<endOptional>>"),
    ("cc-by-nc", "licensed under <<beginOptional>>a <<endOptional>>Creative Commons Attribution-NonCommercial <<var;1>> <<beginOptional>>International <<endOptional>>License"),
    ("cc-by", "licensed under <<beginOptional>>a <<endOptional>>Creative Commons Attribution <<var;1>> <<beginOptional>>International <<endOptional>>License"),
    ("mit", "licensed under the <<beginOptional>>terms of the <<endOptional>>MIT license"),
)
_MARK = re.compile(r"<<(beginOptional|endOptional|var;\d+)>>")


def words_of(text: str | None) -> list[str]:
    """The words of a text with A-Z in lower case."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


class TokenAutomaton:
    """Templates as one automaton over words, made deterministic as texts need it."""

    OTHER = ""

    def __init__(self, templates: Sequence[tuple[str, str]]) -> None:
        self.labels: list[str] = []
        self.on_word: list[dict[str, int]] = [{}]
        self.on_any: list[list[int]] = [[]]
        self.empty: list[list[int]] = [[]]
        self.accepts: dict[int, set[str]] = {}
        for label, template in templates:
            self._add(label, template)
        self.vocabulary = {w for moves in self.on_word for w in moves}
        self.start = self._closure({0})
        self.first = {w for s in self.start for w in self.on_word[s]}
        self.steps: dict[tuple[frozenset, str], frozenset] = {}

    def _state(self) -> int:
        self.on_word.append({})
        self.on_any.append([])
        self.empty.append([])
        return len(self.on_word) - 1

    def _add(self, label: str, template: str) -> None:
        here = self._state()
        self.empty[0].append(here)
        opened: list[int] = []
        for i, part in enumerate(_MARK.split(template)):
            if i % 2 == 0:
                for word in words_of(part):
                    after = self._state()
                    self.on_word[here][word] = after
                    here = after
            elif part == "beginOptional":
                after = self._state()
                self.empty[here].append(after)
                opened.append(here)
                here = after
            elif part == "endOptional":
                after = self._state()
                self.empty[here].append(after)
                self.empty[opened.pop()].append(after)
                here = after
            else:
                ends = [here]
                for _ in range(int(part[4:])):
                    after = self._state()
                    self.on_any[ends[-1]].append(after)
                    ends.append(after)
                here = self._state()
                for state in ends:
                    self.empty[state].append(here)
        self.accepts.setdefault(here, set()).add(label)

    def _closure(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _step(self, states: frozenset, word: str) -> frozenset:
        key = states, word if word in self.vocabulary else self.OTHER
        if (known := self.steps.get(key)) is None:
            after = {self.on_word[s][word] for s in states if word in self.on_word[s]} | {t for s in states for t in self.on_any[s]}
            known = self.steps[key] = self._closure(after)
        return known

    def at(self, words: list[str], i: int) -> tuple[set[str], int]:
        """Labels of the templates accepted from word ``i`` on, and where the longest ends."""
        states, labels, end, j = self.start, set(), i, i
        while j < len(words) and (states := self._step(states, words[j])):
            j += 1
            for s in states:
                if s in self.accepts:
                    labels |= self.accepts[s]
                    end = j
        return labels, end


class Scanner:
    """Base phrases and templates over one text."""

    def __init__(self, phrases: Mapping[str, str], templates: Sequence[tuple[str, str]]) -> None:
        self.phrases = [(p.split(" "), label) for p, label in phrases.items()]
        self.automaton = TokenAutomaton(templates)
        self.first = self.automaton.first | {p[0] for p, _ in self.phrases}

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels and score."""
        words = words_of(text)
        starts: list[int] = []
        base: set[str] = set()
        labels: set[str] = set()
        covered = 0
        reached = 0
        if not self.first.isdisjoint(words):
            for i, word in enumerate(words):
                if word in self.first:
                    end = i
                    for phrase, label in self.phrases:
                        if word == phrase[0] and words[i : i + len(phrase)] == phrase:
                            starts.append(i)
                            base.add(label)
                            end = max(end, i + len(phrase))
                    found, longest = self.automaton.at(words, i)
                    labels |= found
                    if (end := max(end, longest)) > i:
                        covered += max(0, end - max(i, reached))
                        reached = max(reached, end)
        score = covered / len(words) if words else 0.0
        return len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of all phrases, first_word and last_word are the first and last of their
    starts (null without any), labels join those of phrases and accepted templates (empty without any),
    score is the share of words that lie in a match.  Null and empty texts have no words.  Repeated rows
    give repeated rows, an empty table an empty one; further columns are not read.  No shuffle.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            found = pd.DataFrame([scanner.scan(t) for t in batch["text"]], columns=names)
            found = found.astype({"first_word": "Int64", "last_word": "Int64", "n_words": "int64", "n_base": "int64", "score": "float64"})
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), found], axis=1)

    slim = docs.select(id_text(id_col), F.col(text_col).alias("text"))
    return id_back(slim.mapInPandas(work, "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"))
