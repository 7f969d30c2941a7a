"""License scans: phrase places, and an exact set-similarity join of text blocks with license templates.

The join orders tokens by their frequency in the corpus. A block that contains a share of a template's tokens must hold
one of the template's rarest tokens (prefix filter), have enough tokens (length filter) and enough left after the first
match (positional filter); what passes is verified. The templates are a fixed list, so they travel to the blocks.

Blocks are lines, and windows of as many words as a template has over all line breaks, so that wrapped texts are found.
Only texts that pass the same filters as a whole have windows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_pieces, utf8

CONTAINMENT = 0.8

# Phrases of the contract and the openings of well-known license texts.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
]

# Whole texts and notices, without names and years.
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_CLAUSES = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
OPENINGS = {label: text for label, text in reversed(TEMPLATES)}
GNU_END = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} General Public License for more details. You should have received a copy of the GNU {1} General Public License along with this {0}."
TEMPLATES = [
    *TEMPLATES,
    ("mit", f"{OPENINGS['mit']} {TEMPLATES[1][1]} {AS_IS}"),
    ("bsd", f"{OPENINGS['bsd']} {BSD_CLAUSES} {BSD_END}"),
    ("bsd", f"{OPENINGS['bsd']} {BSD_CLAUSES} {BSD_NAME} {BSD_END}"),
    ("isc", f'{OPENINGS["isc"]} THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("apache", f'{OPENINGS["apache"]} http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("gpl", f"{OPENINGS['gpl']} {GNU_END.format('program', '')}"),
    ("lgpl", f"{OPENINGS['lgpl']} {GNU_END.format('library', 'Lesser')}"),
    ("mpl", f"{OPENINGS['mpl']} https://mozilla.org/MPL/2.0/."),
    ("unlicense", f"{OPENINGS['unlicense']} Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

#: Lower-cases A-Z, keeps line feeds, blanks every other byte that is no word byte.
FOLDED = bytes(10 if i == 10 else i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def token_set(text: str) -> set[bytes]:
    return set(text.encode().translate(FOLDED).split())


def template_sets(templates: list[tuple[str, str]]) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(token_set(text))) for label, text in templates if token_set(text)]


def template_token_counts(texts: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents of the corpus each token of the templates stands; at most one row per such token returns."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in rows:
            data, offsets = utf8(batch.column(1))
            data = data.tobytes().translate(FOLDED)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                counts.update(vocabulary.intersection(data[a:b].split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    return {bytes(r.token): r.n for r in texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}


class TemplateIndex:
    """Finds the templates that a block of tokens contains to the threshold."""

    def __init__(self, templates: list[tuple[str, frozenset[bytes]]], counts: dict[bytes, int], containment: float, lengths: list[int] | None = None):
        self.lengths = lengths or [len(own) for _, own in templates]
        tokens = sorted({x for _, own in templates for x in own}, key=lambda x: (counts.get(x, 0), x))
        self.rank = {x: i for i, x in enumerate(tokens)}
        self.templates, self.prefix = [], {}
        for k, (label, own) in enumerate(templates):
            ordered = sorted(own, key=self.rank.__getitem__)
            needed = max(1, math.ceil(containment * len(ordered) - 1e-9))
            self.templates.append((label, own, needed))
            for at, token in enumerate(ordered[: len(ordered) - needed + 1]):
                self.prefix.setdefault(token, []).append((k, len(ordered) - at))
        self.starts = frozenset(self.prefix)

    def search(self, block: set[bytes]) -> list[tuple[str, float]]:
        return [(self.templates[k][0], share) for k, share in self.find(block)]

    def find(self, block: set[bytes]) -> list[tuple[int, float]]:
        hits = self.starts.intersection(block)
        if not hits:
            return []
        known = sorted(self.rank[x] for x in block if x in self.rank)
        left = {r: len(known) - i for i, r in enumerate(known)}
        seen, found = set(), []
        for token in sorted(hits, key=self.rank.__getitem__):
            for k, after in self.prefix[token]:
                _, own, needed = self.templates[k]
                if k in seen or len(block) < needed:
                    continue
                seen.add(k)
                if min(after, left[self.rank[token]]) >= needed and (shared := len(own & block)) >= needed:
                    found.append((k, shared / len(own)))
        return found

    def windows(self, words: list[bytes], k: int) -> list[tuple[int, int, float]]:
        """start, template and containment of the best of each run of overlapping windows that contain template k."""
        _, own, needed = self.templates[k]
        most, held, counts, found = self.lengths[k], deque(), Counter(), []
        for at, word in enumerate(words):
            if word not in own:
                continue
            held.append(at)
            counts[word] += 1
            while held[0] <= at - most:
                gone = words[held.popleft()]
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
            if len(counts) >= needed:
                share = len(counts) / len(own)
                if not found or held[0] >= found[-1][0] + most:
                    found.append((held[0], k, share))
                elif share > found[-1][2]:
                    found[-1] = (held[0], k, share)
        return found

    def explained(self, k: int, share: float, j: int, other: float) -> bool:
        """Whether template j, found with the share other at the same place, tells that k is not what stands there."""
        (label, own, _), (with_label, with_own, _) = self.templates[k], self.templates[j]
        alike = len(own & with_own) >= CONTAINMENT * min(len(own), len(with_own))
        return label != with_label and alike and (other, len(with_own)) > (share, len(own)) and (other > share or own < with_own)

    def scan(self, text: bytes, words: list[bytes]) -> list[tuple[int, str, float, bool]]:
        """line, label, containment and whether another template fits better, of all templates found in a text's lines and
        windows."""
        whole = self.find(set(words))
        if not whole:
            return []
        lines = [line.split() for line in text.split(b"\n")]
        line_of = [i for i, line in enumerate(lines) for _ in line]
        windows = sorted(x for k, _ in whole for x in self.windows(words, k))
        size, starts, longest = self.lengths, [x[0] for x in windows], max(self.lengths)
        meet = lambda x, y: 2 * (min(x[0] + size[x[1]], y[0] + size[y[1]]) - max(x[0], y[0])) > min(size[x[1]], size[y[1]])
        around = lambda x: windows[bisect_left(starts, x[0] - longest) : bisect_left(starts, x[0] + size[x[1]])]
        best: dict[tuple[int, int], float] = {}
        outdone: dict[tuple[int, int], float] = {}
        for at, k, share in windows:
            x = (at, k, share)
            into = outdone if any(meet(x, y) and self.explained(k, share, y[1], y[2]) for y in around(x)) else best
            into[line_of[at], k] = max(share, into.get((line_of[at], k), 0.0))
        for number, line in enumerate(lines):
            inside = self.find(set(line))
            for k, share in inside:
                fits = (number, k) in best or not any(self.explained(k, share, j, other) for j, other in inside)
                into = best if fits else outdone
                into[number, k] = max(share, into.get((number, k), 0.0))
        found = {key: (share, False) for key, share in best.items()}
        found = {key: (share, True) for key, share in outdone.items()} | found
        return [(number, self.templates[k][0], share, flag) for (number, k), (share, flag) in sorted(found.items())]


def phrase_places(words: list[bytes], phrases: list[tuple[bytes, str]]) -> list[tuple[int, str]]:
    joined, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases:
        at, place, upto = joined.find(phrase), 0, 0
        while at >= 0:
            place, upto = place + joined.count(b" ", upto, at), at
            found.append((place, label))
            at = joined.find(phrase, at + 1)
    return found


def license_scan(docs: DataFrame, containment: float = CONTAINMENT, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", all_labels: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    A block is a line, or a window of as many words as the template has (of windows that overlap, the best one); a template
    is found in it when the block holds the given share of the template's distinct tokens. blocks lists all that are found
    (line, label, containment, outdone), a window by its first line; outdone tells that a template of another label that
    shares most tokens with it fits the place better, as a notice of the lesser license holds that of the general one.
    labels and score leave outdone blocks aside unless all_labels is set. score is the best containment, 1 where a phrase stands, else 0. Null
    texts count as empty: no words, no labels (""), null places. Lines and texts may have any length. Rows that repeat
    an id each get a row; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    texts = text_pieces(docs, id_col, text_col)
    sets = template_sets(templates)
    lengths = [len(text.encode().translate(FOLDED).split()) for _, text in templates if token_set(text)]
    counts = template_token_counts(texts, frozenset(x for _, own in sets for x in own))
    wanted = [(b" " + b" ".join(p.encode().split()) + b" ", label) for p, label in phrases.items()]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(sets, counts, containment, lengths)
        for batch in rows:
            data, offsets = utf8(batch.column(1))
            data, out = data.tobytes().translate(FOLDED), []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = data[a:b]
                words = text.split()
                places = phrase_places(words, wanted)
                blocks = [{"line": number, "label": label, "containment": share, "outdone": outdone} for number, label, share, outdone in index.scan(text, words)]
                counted = [x for x in blocks if all_labels or not x["outdone"]]
                base = {label for _, label in places}
                starts = [at for at, _ in places]
                score = 1.0 if places else max((x["containment"] for x in counted), default=0.0)
                out.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x["label"] for x in counted})), score, blocks))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64()), ("outdone", pa.bool_())]))]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line: long, label: string, containment: double, outdone: boolean>>")
