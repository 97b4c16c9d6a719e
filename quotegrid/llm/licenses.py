"""License scans by a generalised suffix automaton.

The automaton holds every stretch of words of every license template. A text is
streamed through it: after each word, the state stands for the longest stretch
ending there that some template has (its matching statistic). Stretches of
``LEAST_RUN`` words or more that can't be extended are chained, per template and
in order, into spans; a span that covers enough of a template names its license.

Only runs of words that templates use enter the automaton; all else resets it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, small_batches, text_chunks

# The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Texts of public licenses, as label and text.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This program is licensed under the GNU General Public License, version 3."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("lgpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0"),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."),
    ("eupl", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("perl", "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself."),
)
#: Words of a stretch at least; words that may lie between two stretches of a span; covered share that names a license.
LEAST_RUN, MOST_GAP, COVERED = 4, 12, 0.7
#: Bytes that words are made of: 0-9, a-z (after lower-casing) and all bytes beyond ASCII.
IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def words_of(text: str) -> list[str]:
    words = Words(pa.array([text]), lower=True, is_word=IS_WORD)
    names = words.unique.cast(pa.string()).to_pylist()
    return [names[c] for c in words.codes]


class SuffixAutomaton:
    """A generalised suffix automaton over word lists. A state knows, for each
    list that has its stretches, where one of them ends (``at``), and all of these
    places (``places``: list, end)."""

    def __init__(self, lists: Sequence[Sequence]):
        self.next, self.link, self.size = [{}], [-1], [0]
        self.at: list[dict[int, int]] = [{}]
        self.places: list[set[tuple[int, int]]] = [set()]
        for k, words in enumerate(lists):
            last = 0
            for i, w in enumerate(words):
                last = self._add(last, w)
                self.at[last].setdefault(k, i + 1)
                self.places[last].add((k, i + 1))
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            for k, end in self.at[s].items():
                self.at[self.link[s]].setdefault(k, end)
            self.places[self.link[s]] |= self.places[s]

    def _state(self, size: int, nexts: dict, link: int) -> int:
        self.next.append(nexts)
        self.size.append(size)
        self.link.append(link)
        self.at.append({})
        self.places.append(set())
        return len(self.size) - 1

    def _split(self, p: int, w) -> int:
        """The state of the longest stretch of p followed by w, made apart if it is inside a longer one."""
        q = self.next[p][w]
        if self.size[p] + 1 == self.size[q]:
            return q
        twin = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _add(self, last: int, w) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._state(self.size[last] + 1, {}, -1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, w)
        return new

    def statistics(self, words: Sequence) -> Iterator[tuple[int, int]]:
        """After each word: the state and the length of the longest stretch ending there."""
        s = n = 0
        for w in words:
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.size[s]
            if w in self.next[s]:
                s = self.next[s][w]
                n += 1
            yield s, n


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, least_run: int = LEAST_RUN):
        self.labels, self.lists = [label for label, _ in templates], [words_of(t) for _, t in templates]
        self.phrases = [(p.split(), label) for p, label in phrases]
        self.automaton = SuffixAutomaton(self.lists)
        self.vocabulary = {w for t in self.lists for w in t}
        self.least_run = least_run

    def stretches(self, words: Sequence[str], base: int) -> Iterator[tuple[int, int, int, int]]:
        """(template, place in it, start in the text, length) of the stretches that can't be extended."""
        found = list(self.automaton.statistics(words))
        for i, (s, n) in enumerate(found):
            if n >= self.least_run and (i + 1 == len(found) or found[i + 1][1] <= n):
                for k, end in self.automaton.places[s]:
                    yield k, end - n, base + i + 1 - n, n

    def spans(self, stretches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, start, stop, covered share), chained by place in text and
        template. Of a stretch's places in a template the one nearest to the
        chain's end goes on with it, and the first begins a new one."""
        out, by = [], {}
        for k, at, start, n in sorted(stretches, key=lambda x: (x[0], x[2], x[3], x[1])):
            by.setdefault(k, {}).setdefault((start, n), []).append(at)
        for k, own in by.items():
            chain: list[int] | None = None  # start, stop, end in the template, covered
            for (start, n), places in own.items():
                fit = [at for at in places if chain and start - chain[1] <= MOST_GAP and at + n > chain[2] and start + n > chain[1]]
                at = min(fit, key=lambda x: (abs(x - chain[2]), x)) if fit else places[0]  # noqa: B023
                if fit:
                    fresh = min(n, at + n - chain[2], start + n - chain[1])
                    chain = [chain[0], start + n, at + n, chain[3] + fresh]
                else:
                    if chain:
                        out.append((k, chain[0], chain[1], min(1.0, chain[3] / len(self.lists[k]))))
                    chain = [start, start + n, at + n, n]
            out.append((k, chain[0], chain[1], min(1.0, chain[3] / len(self.lists[k]))))
        return out


def _found(templates, phrases):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                words = Words(chunk.column("text"), lower=True, is_word=IS_WORD)
                n = len(words.n)
                names = words.unique.to_pylist()
                own = {w.encode(): w for w in scanner.vocabulary | {x for p, _ in scanner.phrases for x in p}}
                code = {own[x]: i for i, x in enumerate(names) if x in own}
                text, codes = words.text_of_word(), words.codes
                base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
                for phrase, label in scanner.phrases:
                    if len(codes) < len(phrase) or any(w not in code for w in phrase):
                        continue
                    m = len(codes) - len(phrase) + 1
                    hit = text[:m] == text[len(phrase) - 1 :]
                    for i, w in enumerate(phrase):
                        hit &= codes[i : i + m] == code[w]
                    for at in np.flatnonzero(hit).tolist():
                        base[text[at]].append((at - int(words.offsets[text[at]]), label))
                spans: list[list] = [[] for _ in range(n)]
                known = np.zeros(len(names) + 1, bool)
                known[[i for x, i in code.items() if x in scanner.vocabulary]] = True
                inside = np.flatnonzero(known[codes]) if len(codes) else np.zeros(0, np.int64)
                if len(inside):
                    cut = np.concatenate(([0], np.flatnonzero((inside[1:] != inside[:-1] + 1) | (text[inside[1:]] != text[inside[:-1]])) + 1, [len(inside)]))
                    long = np.flatnonzero(np.diff(cut) >= scanner.least_run)
                    for a, b in zip(cut[long].tolist(), cut[long + 1].tolist()):
                        lo, hi = int(inside[a]), int(inside[b - 1]) + 1
                        t = int(text[lo])
                        spans[t] += scanner.stretches([names[c].decode() for c in codes[lo:hi]], lo - int(words.offsets[t]))
                out = []
                for t in range(n):
                    at, found = [x for x, _ in base[t]], scanner.spans(spans[t]) if spans[t] else []
                    labels = {x for _, x in base[t]}
                    more = labels | {scanner.labels[k] for k, _, _, share in found if share >= COVERED}
                    score = 1.0 if labels else max((x[3] for x in found), default=0.0)
                    out.append((int(words.n[t]), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), score, [{"label": scanner.labels[k], "start": a, "stop": b, "covered": c} for k, a, b, c in found]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), SPANS)
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return rows


SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("covered", pa.float64())]))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, stop: long, covered: double>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """A row for each row of ``docs``: counts and places of the base phrases,
    labels, score (1 where a base phrase stands, else the largest covered share
    of a template), and the template spans in words.

    A null text counts as empty: no words, no labels, score 0. A very long text is
    scanned whole, in runs of the templates' words. Of templates that cover alike
    all give their label, which labels hold once. Repeated rows give equal rows;
    an empty table gives an empty result; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_found(templates, phrases), SCHEMA)
