"""License scans: templates with markup, compiled into token automata.

A template is license wording with two kinds of regions. ``[...]`` encloses optional wording;
``{n}`` stands for any text of at most n words (a name, a year, an address). All other words are
mandatory and must stand in the text exactly and in order, after lower-casing A-Z. The automaton's
states are places between the template's words; it is run from every place of a document where the
template's first word stands, and a label is given when its end is reached. Templates hold the whole wording of
a license, but for its copyright line; notes that point to a license are templates of their own, with labels that say "notice".
The texts of the Apache, GNU, Mozilla and Creative Commons licenses themselves are not among the templates.

Each scan also reports the base phrases, found by the same automata (phrases have no regions).
``score`` is the largest share of a template's mandatory words that were met in order, 1 once a
template or phrase is accepted. NULL and empty texts have no words, no labels and score 0; repeated
rows are judged one by one; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veedor.llm.arrays import ALNUM, hash_texts, pieces, tidy, utf8, word_hashes, words

# Fixed values of the contract.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# The whole wording of public licenses.
_NO_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall {8} be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
    "other dealings in the software"
)
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
    "are met [1] [a] redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer [2] [b] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_ADVERTISING = (
    "[3] all advertising materials mentioning features or use of this software must display the following acknowledgement this product "
    "includes software developed by {16}"
)
_BSD_NAMES = (
    "[3] [4] [c] neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission"
)
_BSD_DISCLAIMER = (
    "this software is provided by {10} as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall {10} be liable for any direct indirect incidental "
    "special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or "
    "profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including "
    "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
WHOLE = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included "
        f"in all copies or substantial portions of the software {_NO_WARRANTY}",
        "mit",
    ),
    (f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}", "bsd-2-clause"),
    (f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_DISCLAIMER}", "bsd-3-clause"),
    (f"{_BSD_CONDITIONS} {_BSD_ADVERTISING} {_BSD_NAMES} {_BSD_DISCLAIMER}", "bsd-4-clause"),
    (
        "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies the software is provided as is and {6} disclaims all "
        "warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {6} be "
        "liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of "
        "this software",
        "isc",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will {6} be held liable for any damages arising "
        "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications "
        "and to alter it and redistribute it freely subject to the following restrictions [1] the origin of this software must not be "
        "misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in "
        "the product documentation would be appreciated but is not required [2] altered source versions must be plainly marked as such and "
        "must not be misrepresented as being the original software [3] this notice may not be removed or altered from any source distribution",
        "zlib",
    ),
)
# Notes that point to a license. They do not hold its wording, and their labels say so.
NOTICES = (
    ("released under the [terms of the] mit license", "mit-notice"),
    ("licensed under the apache license [version 2 0]", "apache-notice"),
    ("licensed under the apache license version 2 0", "apache-2.0-notice"),
    ("licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] [version {1}]", "gpl-notice"),
    ("licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 2", "gpl-2.0-notice"),
    ("licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 3", "gpl-3.0-notice"),
    ("gnu lesser general public license [version {1}]", "lgpl-notice"),
    ("gnu affero general public license [version {1}]", "agpl-notice"),
    ("licensed under [a] [the] [creative commons] cc by 4 0", "cc-by-4.0-notice"),
    ("licensed under [a] [the] [creative commons] cc by sa 4 0", "cc-by-sa-4.0-notice"),
    ("licensed under [a] [the] [creative commons] cc by nc 4 0", "cc-by-nc-4.0-notice"),
    ("licensed under [a] [the] [creative commons] cc by nc sa 4 0", "cc-by-nc-sa-4.0-notice"),
    ("licensed under [a] [the] creative commons attribution [{3}] 4 0 international [license]", "cc-by-4.0-notice"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0-notice"),
    ("this is free and unencumbered software released into the public domain", "unlicense-notice"),
    ("copyright [c] {12} all rights reserved", "all-rights-reserved"),
)
TEMPLATES = (*WHOLE, *NOTICES)
#: Words that are looked at first from a place where a template may begin.
SHORT = 16

_PART = re.compile(r"\[|\]|\{(\d+)\}|[^\s\[\]{}]+")


class Automaton(NamedTuple):
    """States 0..n; bit masks of states, in Python integers of any size."""

    label: str
    first: int  # hash of the first word
    by_word: dict[int, int]  # word -> states that it leads out of
    any_word: int  # states that any word leads out of
    skips: list[int]  # states reached from a state without reading, itself included
    end: int
    mandatory: list[int]  # mandatory words read once a state is reached

    def closure(self, states: int) -> int:
        out = 0
        while states:
            low = states & -states
            out |= self.skips[low.bit_length() - 1]
            states ^= low
        return out

    def run(self, h: list[int], at: int) -> float:
        """Largest share of the mandatory words met in order from ``at``; 1 when the end is reached."""
        return self.walk(h, at)[0]

    def walk(self, h: list[int], at: int) -> tuple[float, bool]:
        """``run``, and whether it went on when the words of ``h`` ended."""
        states, best, final = self.closure(1), 0, 1 << self.end
        while True:
            best = max(best, states)  # a later state never has read fewer mandatory words
            if states & final or at >= len(h) or not states:
                break
            states = self.closure((states & (self.by_word.get(h[at], 0) | self.any_word)) << 1)
            at += 1
        if best & final:
            return 1.0, False
        return self.mandatory[best.bit_length() - 1] / max(1, self.mandatory[-1]), states != 0


def compile_template(template: str, label: str) -> Automaton:
    """The automaton of a template; its first word must be mandatory."""
    wanted: list[str | None] = []  # word that leads out of each state; None for any
    jumps: list[tuple[int, int]] = []
    opened: list[int] = []
    mandatory = [0]
    for part in _PART.finditer(template.lower()):
        if part[0] == "[":
            opened.append(len(wanted))
        elif part[0] == "]":
            jumps.append((opened.pop(), len(wanted)))
        elif part[1]:
            start = len(wanted)
            for k in range(int(part[1])):
                jumps.append((start + k, start + int(part[1])))
                wanted.append(None)
                mandatory.append(mandatory[-1])
        else:
            wanted.append(part[0])
            mandatory.append(mandatory[-1] + (not opened))
    if opened or not wanted or wanted[0] is None or any(a == 0 for a, _ in jumps):
        raise ValueError(f"a template must close its regions and begin with a mandatory word: {template}")
    hashes = [None if w is None else int(hash_texts([w], ALNUM)[0][0]) for w in wanted]
    by_word: dict[int, int] = {}
    any_word = 0
    for k, h in enumerate(hashes):
        if h is None:
            any_word |= 1 << k
        else:
            by_word[h] = by_word.get(h, 0) | 1 << k
    skips = [1 << k for k in range(len(wanted) + 1)]
    for a, b in sorted(jumps, reverse=True):  # later jumps are closed already
        skips[a] |= skips[b]
    return Automaton(label, hashes[0], by_word, any_word, skips, len(wanted), mandatory)


def _scanner(phrases: list[Automaton], templates: list[Automaton]):
    starts = np.array(sorted({a.first for a in (*phrases, *templates)}), np.uint64)
    by_first: dict[int, list[tuple[Automaton, bool]]] = {}  # with whether it is a phrase
    for automaton, is_phrase in [*((a, True) for a in phrases), *((a, False) for a in templates)]:
        by_first.setdefault(automaton.first, []).append((automaton, is_phrase))
    reach = max(a.end for a in (*phrases, *templates)) + 1

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in pieces(offsets):
                w = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                h = word_hashes(w)
                slot = np.minimum(np.searchsorted(starts, h), len(starts) - 1)
                places = np.flatnonzero(starts[slot] == h)
                doc = np.searchsorted(w.first, places, "right") - 1
                found: dict[int, tuple[list[int], set[str], set[str], list[float]]] = {}
                for place, d in zip(places.tolist(), doc.tolist()):
                    last = int(w.first[d + 1])
                    ahead = h[place : min(place + SHORT, last)].tolist()
                    bases, own, labels, scores = found.setdefault(d, ([], set(), set(), [0.0]))
                    for automaton, is_phrase in by_first[ahead[0]]:
                        share, open_ = automaton.walk(ahead, 0)
                        if open_ and len(ahead) < min(reach, last - place):
                            ahead = h[place : min(place + reach, last)].tolist()
                            share = automaton.run(ahead, 0)
                        scores[0] = max(scores[0], share)
                        if share == 1.0:
                            labels.add(automaton.label)
                            if is_phrase:
                                bases.append(place - int(w.first[d]))
                                own.add(automaton.label)
                rows = [found.get(d, ([], set(), set(), [0.0])) for d in range(b - a)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column(0).slice(a, b - a),
                        "n_words": pa.array(np.diff(w.first), pa.int64()),
                        "n_base": pa.array([len(x[0]) for x in rows], pa.int64()),
                        "first_word": pa.array([min(x[0], default=None) for x in rows], pa.int64()),
                        "last_word": pa.array([max(x[0], default=None) for x in rows], pa.int64()),
                        "base_labels": pa.array([",".join(sorted(x[1])) for x in rows], pa.string()),
                        "labels": pa.array([",".join(sorted(x[2])) for x in rows], pa.string()),
                        "score": pa.array([x[3][0] for x in rows], pa.float64()),
                    }
                )

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    run = _scanner([compile_template(*p) for p in phrases], [compile_template(*t) for t in templates])
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return narrow.mapInArrow(tidy(run), schema)
