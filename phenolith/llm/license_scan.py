"""Licence texts in documents, found with a suffix automaton of licence templates.

The generalised suffix automaton of all templates and phrases is built once from the fixed
texts below and sent to every task. Documents are streamed through it word by word: it gives
the longest template substring that ends at each word (the matching statistics). Long matches
are chained into the template spans they cover.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import text_batches

#: Phrases whose words, standing consecutively, give a label by themselves.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Public licence texts. What stands before a slash is the label; short licences are there as
#: a whole too, and of long ones (apache-2, gpl, lgpl, agpl, mpl-2) the notice that files carry.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "mit/full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd/2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd/3-clause": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc/full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
}
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of text read at once, words of a match that counts, words skipped between two matches of
#: a chain, and the share of a template that a chain must cover to give its label.
WINDOW = 1 << 20
MIN_MATCH = 5
MAX_GAP = 12
MIN_COVER = 0.6


def words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and gives the runs of digits, letters and bytes beyond ASCII."""
    return WORD.findall(text.lower())


class Automaton:
    """Generalised suffix automaton over word ids.

    ``step`` holds the matching statistics: state and length of the longest suffix of the words so
    far that some template contains.
    """

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]) -> None:
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        self.names = list(templates)
        self.labels = [n.split("/")[0] for n in templates]
        texts = [self._numbered(t) for t in templates.values()]
        self.sizes = [len(t) for t in texts]
        given = [(p, label) for p, label in ((self._numbered(p), label) for p, label in phrases.items()) if p]
        #: Runs of vocabulary words that are shorter hold no phrase and no match that counts.
        self.shortest = min([MIN_MATCH, *(len(p) for p, _ in given)])
        for number, text in enumerate([*texts, *(p for p, _ in given)]):
            last = 0
            for at, word in enumerate(text):
                last = self._extend(last, word)
                if number < len(texts):
                    self.ends[last].add((number, at + 1))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends = [sorted(e) if self.length[s] >= MIN_MATCH else [] for s, e in enumerate(self.ends)]
        # phrases that the longest match at a state ends with, and the length it then needs
        self.found: list[tuple[tuple[int, str], ...]] = [()] * len(self.next)
        at_state: dict[int, list[tuple[int, str]]] = {}
        for phrase, label in given:
            state = 0
            for word in phrase:
                state = self.next[state][word]
            at_state.setdefault(state, []).append((len(phrase), label))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.found[state] = (*at_state.get(state, ()), *self.found[self.link[state]])

    def _numbered(self, text: str) -> list[int]:
        return [self.ids.setdefault(w, len(self.ids)) for w in words(text.encode())]

    def _add(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, state: int, target: int, word: int) -> int:
        """A copy of target for the shorter strings that reach it from state."""
        copy = self._add(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if (target := self.next[last].get(word)) is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, target, word)
        new, state = self._add(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, target, word)
        return new

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        while state and word not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], matched + 1
        return 0, 0


class Scan:
    """Streams one document. Words are fed in order; a gap in the positions starts afresh."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.state = self.matched = 0
        self.at = -1
        self.bases: list[int] = []  # number, first, last
        self.n_base, self.first, self.last = 0, None, None
        self.base_labels: set[str] = set()
        self.chains: dict[int, list[int]] = {}  # template: covered words, end in text, end in template, start in text
        self.covered: dict[int, tuple[int, int, int]] = {}  # template: words of its best chain, start and end in text

    def feed(self, at: int, word: int) -> None:
        a = self.automaton
        if at != self.at + 1:
            self.close()
            self.state = self.matched = 0
        state, matched = a.step(self.state, self.matched, word)
        if matched <= self.matched and self.matched >= MIN_MATCH:
            self.close()
        self.state, self.matched, self.at = state, matched, at
        for length, label in a.found[state]:
            if length <= matched:
                begin = at - length + 1
                self.n_base += 1
                self.first = begin if self.first is None else min(self.first, begin)
                self.last = begin if self.last is None else max(self.last, begin)
                self.base_labels.add(label)

    def close(self) -> None:
        """Chains the longest match that ends at the last word."""
        if self.matched < MIN_MATCH:
            return
        end, size = self.at + 1, self.matched
        for template, stop in self.automaton.ends[self.state]:
            covered, text_end, template_end, begin = self.chains.get(template, (0, -1 << 40, 0, 0))
            fresh = min(size, stop - template_end)
            if stop > template_end and end - size - text_end <= MAX_GAP and end > text_end:
                covered += fresh
            else:
                covered, begin = size, end - size
            self.chains[template] = [covered, end, stop, begin]
            if covered > self.covered.get(template, (0, 0, 0))[0]:
                self.covered[template] = covered, begin, end

    def result(self) -> tuple[str, str, float, list[dict]]:
        self.close()
        a = self.automaton
        shares = {t: n / a.sizes[t] for t, (n, _, _) in self.covered.items()}
        spans = [{"template": a.names[t], "start": begin, "end": end, "covered": min(1.0, n / a.sizes[t])} for t, (n, begin, end) in sorted(self.covered.items())]
        labels = self.base_labels | {a.labels[t] for t, x in shares.items() if x >= MIN_COVER}
        score = max([1.0 if self.base_labels else 0.0, *(min(1.0, x) for x in shares.values())])
        return ",".join(sorted(self.base_labels)), ",".join(sorted(labels)), score, spans


def scan_text(automaton: Automaton, text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one text.

    Words beyond the templates' vocabulary cannot be part of a match, and neither can runs between them
    that are shorter than any phrase; only longer runs are walked.
    """
    scan, n, begin = Scan(automaton), 0, 0
    number = automaton.ids.get
    while begin < len(text):
        end = begin + WINDOW
        while end < len(text) and WORD.match(text[end : end + 1]):
            end += 1
        ids = [number(w, -1) for w in words(text[begin:end])]
        size, at = len(ids), 0
        while True:
            while at < size and ids[at] < 0:
                at += 1
            if at == size:
                break
            stop = at
            while stop < size and ids[stop] >= 0:
                stop += 1
            if stop - at >= automaton.shortest or not at or stop == size:
                for k in range(at, stop):
                    scan.feed(n + k, ids[k])
            at = stop
        n += size
        begin = end
    return n, scan.n_base, scan.first, scan.last, *scan.result()


COUNTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template:string,start:long,end:long,covered:double>>"
SPANS = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))
TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), SPANS]


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, words, places of the phrases, labels, score and spans of every document.

    ``spans``: of each template with a long match, the words from start to before end that its best
    chain of matches runs over, and the share of the template that the matches cover.
    ``labels`` holds ``base_labels`` and the templates of which a chain of long matches covers
    ``MIN_COVER``; ``score`` is 1 for a phrase, else the largest share covered. Null and empty
    texts have no words, empty labels and score 0. Repeated rows are scanned each, an empty table gives
    an empty one; other columns are not carried. No shuffle.
    """
    automaton = Automaton(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    names = [*COUNTS, "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in text_batches(batches):
            raw = data.tobytes()
            rows = [scan_text(automaton, raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, " + RESULT)
