"""License scans: windows of a text's words compared to licence templates by their word bigrams."""

import bisect
import heapq
import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import runs, texts_of

_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    " and associated documentation files (the Software), to deal in the Software without restriction"
)
_BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met: Redistributions of source code must retain the"
    " above copyright notice, this list of conditions and the following disclaimer. Redistributions"
    " in binary form must reproduce the above copyright notice, this list of conditions and the"
    " following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to"
    " endorse or promote products derived from this software without specific prior written permission."
)
_MIT_DISCLAIMER = (
    " THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT"
    " NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
    " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,"
    " DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,"
    " OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_DISCLAIMER = (
    " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS"
    " SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE"
    " AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES"
    " WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,"
    " NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE"
    " OF THIS SOFTWARE."
)
_BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR"
    " IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND"
    " FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR"
    " CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL"
    " DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,"
    " DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER"
    " IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT"
    " OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    f"{_PERMISSION}, including without limitation the rights to use, copy, modify, merge, publish,"
    " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom"
    " the Software is furnished to do so, subject to the following conditions: The above copyright"
    " notice and this permission notice shall be included in all copies or substantial portions of"
    " the Software."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
    " without fee is hereby granted, provided that the above copyright notice and this permission"
    " notice appear in all copies."
)


def _gnu(kind: str, version: str, thing: str = "This program") -> list[str]:
    """The notices of a GNU licence, as its appendix has them and without a later version."""
    told = f"{thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}"
    told += f" General Public License as published by the Free Software Foundation, either version {version} of the License"
    only = told.replace("either version", "version")
    return [
        f"This work is licensed under the GNU {kind} General Public License, version {version}.",
        f"Licensed under the GNU {kind} General Public License v{version}.",
        f"{told}, or (at your option) any later version.",
        f"{only}.",
        f"GNU {kind} GENERAL PUBLIC LICENSE Version {version},"
        + {"2": " June 1991", "2.1": " February 1999"}.get(
            version, " 19 November 2007" if kind == "Affero" else " 29 June 2007"
        ),
    ]


def _creative(kind: str, letters: str) -> list[str]:
    return [
        f"Licensed under CC {letters} 4.0.",
        f"This work is licensed under a Creative Commons {kind} 4.0 International License.",
        f"This work is licensed under the Creative Commons {kind} 4.0 International License. To view a"
        f" copy of this license, visit http://creativecommons.org/licenses/{letters.lower().replace(' ', '-')}/4.0/",
    ]


# Public licence notices and grants, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file"
        " except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the"
        " License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,"
        " either express or implied.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "The MIT License (MIT)",
        f"{_PERMISSION}.",
        _MIT_GRANT,
        _MIT_GRANT + _MIT_DISCLAIMER,
    ],
    "ISC": [
        "Released under the ISC License.",
        _ISC_GRANT,
        _ISC_GRANT + _ISC_DISCLAIMER,
    ],
    "GPL-3.0": _gnu("", "3"),
    "GPL-2.0": _gnu("", "2"),
    "LGPL-3.0": _gnu("Lesser", "3"),
    "LGPL-2.1": _gnu("Lesser", "2.1", "This library"),
    "AGPL-3.0": _gnu("Affero", "3"),
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy"
        " of the MPL was not distributed with this file, You can obtain one at"
        " https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD_CLAUSES, _BSD_CLAUSES + _BSD_DISCLAIMER],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        _BSD_CLAUSES + _BSD_NAMES,
        _BSD_CLAUSES + _BSD_NAMES + _BSD_DISCLAIMER,
    ],
    "CC-BY-4.0": _creative("Attribution", "BY"),
    "CC-BY-SA-4.0": _creative("Attribution-ShareAlike", "BY-SA"),
    "CC-BY-NC-4.0": _creative("Attribution-NonCommercial", "BY-NC"),
    "CC0-1.0": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "Creative Commons CC0 1.0 Universal",
    ],
}
for _name, _texts in TEMPLATES.items():
    _texts.append(f"SPDX-License-Identifier: {_name}")
    if "GPL" in _name:
        _texts += [f"SPDX-License-Identifier: {_name}-{_more}" for _more in ("only", "or-later")]

#: Words are letters and digits; a version such as 2.0 is one word.
_WORDS = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")
#: A sentence ends at a full stop or the like that a space or the line's end follows.
_SENTENCES = re.compile(r".+?(?:[.!?]+(?=\s|$)|$)")
_STOP = re.compile(r"[.!?]+(?=\s|$)")
_WHITE = re.compile(r"\s")
#: Words that tell licences apart or deny one: a notice has none that its template lacks.
NAMES = frozenset(
    "apache mit isc bsd endorse gpl lgpl agpl lesser library affero mozilla mpl"
    " sharealike sa noncommercial nc noderivatives nd cc0 not never neither nor cannot".split()
)
#: A denial that goes on into what follows, over line ends and the marks of comments.
_DENIED = re.compile(
    r"(?:\b(?:not|never|neither|nor|cannot|no[\s#*/]+longer)|n['\u2019]t)"
    r"(?:[\s#*/]+(?:a|an|and|are|available|be|been|being|currently|distributed|explicitly|is|it|licensed"
    r"|made|or|provided|published|released|the|this|under|was|were|yet))*[\s#*/\"'(\u201c]*\Z",
    re.IGNORECASE,
)
#: Characters before a notice in which a denial of it is looked for.
_DENIAL_SPAN = 200
_SPDX = re.compile(r"spdx-license-identifier:[ \t]*")
_OPERAND = re.compile(r"[ \t(]*([a-z0-9][\w.+:-]*)[ \t)]*")
_OPERATOR = re.compile(r"(and|or|with)(?=[ \t(])")


def bigrams(text: str) -> Counter:
    """Word bigrams of the normalised text, as a multiset; edges count as words."""
    words = ["", *_WORDS.findall(text.lower()), ""]
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 2 else Counter()


def dice(a: Counter, b: Counter) -> float:
    """Twice the shared bigrams over all bigrams."""
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class _Template:
    """What the scan needs of one template, its words as numbers of ``vocabulary``."""

    def __init__(self, license: str, text: str, vocabulary: dict[str, int], threshold: float):
        words = _WORDS.findall(text.lower())
        ids = [vocabulary[word] for word in words]
        self.license, self.size = license, len(ids) + 1
        self.first, self.last = ids[0], ids[-1]
        self.pairs = Counter(zip(ids, ids[1:], strict=False))
        # Of s shared bigrams and a in the window, 2 s >= t (a + b) and s <= a give
        # s >= t b / (2 - t) and a <= b (2 - t) / t. All but two of them lie inside.
        t = threshold
        self.inside = math.ceil(t * self.size / (2 - t) - 1e-9) - 2
        self.most = math.floor(self.size * (2 - t) / t + 1e-9) - 1
        self.versions = {word.removesuffix(".0") for word in words if word[0].isdigit()}
        self.others = {vocabulary[name] for name in NAMES.difference(words)}


class LicenseScanner:
    """Finds the windows of words that are near a template.

    Bigrams of the text that some template has are looked up for all words at once. Only
    around places with as many of a template's bigrams, as close together, as a window near
    it must have, windows are compared; the bounds change no result.
    """

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must lie above 0 and not above 1")
        self.threshold = threshold
        texts = [(name, text) for name, texts in templates.items() for text in texts if bigrams(text)]
        words = {word for _, text in texts for word in _WORDS.findall(text.lower())}
        words |= NAMES | {word.removesuffix(".0") for word in words if word[0].isdigit()}
        self.vocabulary = {word: k for k, word in enumerate(sorted(words), 1)}  # 0: any other word
        self.version = {k: w.removesuffix(".0") for w, k in self.vocabulary.items() if w[0].isdigit()}
        self.templates = [_Template(name, text, self.vocabulary, threshold) for name, text in texts]
        pairs = sorted({pair for template in self.templates for pair in template.pairs})
        self.number = np.zeros((len(words) + 1, len(words) + 1), np.int32)
        for k, pair in enumerate(pairs, 1):
            self.number[pair] = k
        self.has = np.zeros((len(pairs) + 1, len(self.templates)), np.float32)
        for at, template in enumerate(self.templates):
            self.has[[self.number[pair] for pair in template.pairs], at] = 1
        self.inside = np.array([template.inside for template in self.templates])

    def _numbers(self, lower: str) -> np.ndarray:
        """The numbers of all words; long texts are cut where white space is."""
        parts, at = [], 0
        while at < len(lower):
            cut = _WHITE.search(lower, at + 1_000_000)
            end = cut.start() if cut else len(lower)
            found = _WORDS.findall(lower, at, end)
            parts.append(np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int32, len(found)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def _best(self, words: np.ndarray, start: int, at: int, limit: int) -> tuple | None:
        """The best window from ``start`` that ends before ``limit``, as an entry of the queue."""
        template = self.templates[at]
        left, versions = dict(template.pairs), set(template.versions)
        shared, best, before = 0, None, None
        part = words[start : min(limit, start + template.most)].tolist()
        for n, word in enumerate(part, 1):
            if word in template.others:
                break
            versions.discard(self.version.get(word))
            if before is None:
                shared = int(word == template.first)
            elif left.get((before, word), 0) > 0:
                left[before, word] -= 1
                shared += 1
            ends = word == template.last
            if not versions and (ends or (before, word) in left):
                value = 2 * (shared + ends) / (n + 1 + template.size)
                if value >= self.threshold:
                    entry = (-shared - ends, -value, -n, start, at)
                    best = entry if best is None else min(best, entry)
            before = word
        return best

    def windows(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """First word, end, template and coefficient of the notices, in order.

        Of all windows that reach the threshold the one that shares most bigrams is taken
        (then the nearest, the longer, the earlier, the template named first), and so on
        among those that overlap none taken before.
        """
        if not len(words):
            return []
        numbers = self.number[words[:-1], words[1:]]
        places = np.flatnonzero(numbers)
        numbers = numbers[places]
        counts = np.bincount(numbers, minlength=len(self.has)).astype(np.float32) @ self.has
        queue = []
        for at in np.flatnonzero(counts >= self.inside).tolist():
            template = self.templates[at]
            own = places[self.has[numbers, at] > 0]
            starts = np.union1d(own, np.flatnonzero(words == template.first))
            near = np.searchsorted(own, starts + template.most - 2, "right") - np.searchsorted(own, starts)
            for start in starts[near >= template.inside].tolist():
                if best := self._best(words, start, at, len(words)):
                    queue.append(best)
        heapq.heapify(queue)
        begins, taken = [], []
        while queue:
            _, value, n, start, at = heapq.heappop(queue)
            k = bisect.bisect_right(begins, start)
            if k and taken[k - 1][1] > start:
                continue
            limit = begins[k] if k < len(begins) else len(words)
            if start - n > limit:
                if best := self._best(words, start, at, limit):
                    heapq.heappush(queue, best)
                continue
            begins.insert(k, start)
            taken.insert(k, (start, start - n, at, -value))
        return taken

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """Start, end, licence and coefficient of the notices, in order.

        A notice that is denied right before it is none. An SPDX expression gives every
        licence in it, each with its own place.
        """
        lower = text.lower()
        if len(lower) != len(text):  # a few letters change their length; offsets must not
            lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        taken = self.windows(self._numbers(lower))
        if not taken:
            return []
        found = self._spans(text, lower, taken)
        found = [hit for hit in found if not _DENIED.search(text, max(0, hit[0] - _DENIAL_SPAN), hit[0])]
        combined = self._expressions(lower)
        begins = [start for start, *_ in combined]
        kept = []
        for hit in found:
            k = bisect.bisect_left(begins, hit[1])
            if not k or combined[k - 1][1] <= hit[0]:
                kept.append(hit)
        return sorted(kept + [hit for *_, hits in combined for hit in hits])

    def _expressions(self, lower: str) -> list[tuple[int, int, list]]:
        """Start, end and notices of the SPDX lines that combine several identifiers.

        Each licence of an expression is compared as if it stood alone in its line; what
        follows WITH is an exception to the licence before, and none itself.
        """
        out = []
        for match in _SPDX.finditer(lower):
            at, operands, before = match.end(), [], "or"
            while operand := _OPERAND.match(lower, at):
                operands.append((before, *operand.span(1)))
                operator = _OPERATOR.match(lower, operand.end())
                if not operator:
                    break
                before, at = operator.group(1), operator.end()
            if len(operands) < 2:
                continue
            hits = []
            for before, start, end in operands:
                alone = self._numbers(match.group() + lower[start:end])
                nearest = [] if before == "with" else self.windows(alone)
                hits += [(start, end, self.templates[t].license, value) for *_, t, value in nearest[:1]]
            out.append((match.start(), operands[-1][2], hits))
        return out

    def _spans(self, text: str, lower: str, taken: list[tuple]) -> list[tuple[int, int, str, float]]:
        """The windows as characters; marks beside them belong to a notice up to the end of its
        line or sentence."""
        wanted = {k for first, end, *_ in taken for k in (first - 1, first, end - 1, end)}
        spans = {k: match.span() for k, match in enumerate(_WORDS.finditer(lower)) if k in wanted}
        found = []
        for first, end, at, value in taken:
            start, stop = spans[first][0], spans[end - 1][1]
            before = spans[first - 1][1] if first else 0
            after = spans[end][0] if end in spans else len(text)
            marks = [before if first == 0 else -1, text.rfind("\n", before, start) + 1 or -1]
            marks += [m.end() for m in _STOP.finditer(text, before, start)]
            if max(marks) >= 0:
                start = max(marks)
            line = text.find("\n", stop, after)
            line = line if line >= 0 else after if after == len(text) else -1
            point = _STOP.search(text, stop, after)
            if point and (line < 0 or point.start() < line):
                stop = point.end()
            elif line >= 0:
                stop = line
            found.append((start, stop, self.templates[at].license, value))
        return found


SCHEMA = "doc_id long, licenses array<struct<start:long,end:long,license:string,score:double>>"
_KIND = pa.list_(
    pa.struct(
        [
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("license", pa.string()),
            ("score", pa.float64()),
        ]
    )
)


def scan_licenses(
    docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = 0.8
) -> DataFrame:
    """``doc_id`` and ``licenses``, the licence notices in every whole text.

    Each notice has ``start`` and ``end`` (characters), ``license`` and ``score``, the Dice
    coefficient of its word bigrams with the nearest template. A notice is any window of
    words of the whole text, line ends being white space, that begins and ends with a
    bigram of the template, has the template's version numbers and none of the ``NAMES``
    it lacks. Notices don't overlap: those that share most bigrams come first. An SPDX
    expression with AND, OR or WITH gives each of its licences, compared as if alone. A
    notice that a denial leads into ("not licensed under") is left out.

    Texts without notices, null and empty ones have an empty list. Rows are independent:
    nothing is shuffled, repeated rows give a row each, a null ``doc_id`` stays null, an
    empty table gives no rows, other columns are ignored. ``templates`` (a few hundred KB
    at most) go to every task.
    """
    chosen = TEMPLATES if templates is None else templates

    def scanned(batches):
        scanner = LicenseScanner(chosen, threshold)
        for batch in runs(batches):
            found = [
                [dict(zip(("start", "end", "license", "score"), hit, strict=True)) for hit in scanner.scan(text)]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, _KIND)], ["doc_id", "licenses"]
            )

    return texts_of(docs).mapInArrow(scanned, SCHEMA)
