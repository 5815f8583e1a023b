"""License scans by template markup.

A template is license wording with ``<<beginOptional>>...<<endOptional>>`` regions, which
may be left out, and replaceable ones: ``<<var;name=x;max=N>>``, where up to N words may
stand, and ``<<var;name=x;match=a|b>>``, where one of the words given stands.  It is compiled
to an automaton over words; a text is accepted where a run of its words takes the automaton
from start to end, so all mandatory wording must match word for word.  Texts of licenses
are whole, disclaimers included; notices that name a license are templates of their own.

Defined results: null and empty texts have no words, no places and score 0; ties of
labels collapse; repeated rows are scanned alike; a replaceable region at the start of a
template may match nothing, so it is left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import columnar as C
from .storage import prepared, schema_with

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_COPYRIGHT = "<<var;name=holder;max=12>>"
_CLAUSES = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_DISCLAIMER = f"this software is provided by {_COPYRIGHT} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {_COPYRIGHT} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_GNU = "<<beginOptional>>this <<var;name=work;max=3>> is free software<<endOptional>> you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation either version {} of the license or <<beginOptional>>at your option<<endOptional>> any later version"
_NAMED = "<<beginOptional>>this <<var;name=work;max=3>> is<<endOptional>> licensed under the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version {}"
_CREATIVE = "<<beginOptional>>this work is<<endOptional>> licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc {} 4 0"

#: Template markup by label: public license texts and notices.
TEMPLATES = [
    ("cc-by-4.0", _CREATIVE.format("by")),
    ("cc-by-nc-4.0", _CREATIVE.format("by nc")),
    ("cc-by-sa-4.0", _CREATIVE.format("by sa")),
    ("gpl-3.0", _NAMED.format("3")),
    ("gpl-2.0", _NAMED.format("2")),
    ("gpl-3.0", _GNU.format("general", "3")),
    ("gpl-2.0", _GNU.format("general", "2")),
    ("lgpl-3.0", _GNU.format("lesser general", "3")),
    ("lgpl-2.1", _GNU.format("lesser general", "2 1")),
    ("agpl-3.0", _GNU.format("affero general", "3")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<var;name=scheme;match=http|https>> mozilla org mpl 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 <<beginOptional>>the license you may not use this file except in compliance with the license<<endOptional>>"),
    ("mit", "<<beginOptional>>released<<endOptional>> under the mit license"),
    ("mit", f"permission is hereby granted free of charge to any person obtaining a copy of <<var;name=software;max=8>> and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {_COPYRIGHT} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", f"permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {_COPYRIGHT} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {_COPYRIGHT} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause", f"{_CLAUSES} {_DISCLAIMER}"),
    ("bsd-3-clause", f"{_CLAUSES} <<beginOptional>>3<<endOptional>> neither the name of {_COPYRIGHT} nor the names of <<beginOptional>>its<<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission {_DISCLAIMER}"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the <<var;name=who;match=author|authors>> be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<beginOptional>>1<<endOptional>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<beginOptional>>2<<endOptional>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<beginOptional>>3<<endOptional>> this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]

_MARK = re.compile(r"<<beginOptional>>|<<endOptional>>|<<var;(?P<var>[^<>]*)>>|[0-9a-z]+")


def _region(fields: str) -> tuple[int, list[str]]:
    """(words at most, words given) of a replaceable region."""
    parts = dict(f.split("=", 1) for f in fields.split(";"))
    if "match" in parts:
        return 1, parts["match"].split("|")
    return int(parts["max"]), []


class Automaton:
    """Word automaton of one template: states 0..n, bit sets of states, epsilon moves closed in advance."""

    def __init__(self, label: str, markup: str):
        self.label = label
        edges: list[tuple[int, str | None, int]] = []  # None: any word
        skips: list[tuple[int, int]] = []  # always to a later state
        progress, opened, state, mandatory = [0], [], 0, 0
        for m in _MARK.finditer(markup):
            token = m[0]
            if token == "<<beginOptional>>":
                opened.append(state)
            elif token == "<<endOptional>>":
                skips.append((opened.pop(), state))
            elif m["var"]:
                most, given = _region(m["var"])
                if given:
                    edges += [(state, w, state + 1) for w in given]
                    state += 1
                    mandatory += not opened
                    progress.append(mandatory)
                elif state:
                    begin = state
                    for _ in range(most):
                        edges.append((state, None, state + 1))
                        state += 1
                        progress.append(mandatory)
                    skips += [(s, state) for s in range(begin, state)]
            else:
                edges.append((state, token, state + 1))
                state += 1
                mandatory += not opened
                progress.append(mandatory)
        self.final, self.mandatory, self.progress = state, max(1, mandatory), progress
        jumps: dict[int, int] = {}
        for s in range(state, -1, -1):
            reach = 1 << s
            for a, b in skips:
                if a == s:
                    reach |= jumps[b]
            jumps[s] = reach
        self.jumps = jumps
        self.by_word: dict[str, list[tuple[int, int]]] = {}
        self.any: list[tuple[int, int]] = []
        for a, w, b in edges:
            (self.any if w is None else self.by_word.setdefault(w, [])).append((1 << a, jumps[b]))
        self.start = jumps[0]
        self.by_hash = {word_hash(w): moves for w, moves in self.by_word.items()}
        self.first_words = [w for w, moves in self.by_word.items() if any(self.start & a for a, _ in moves)]

    def run(self, words: list, by_hash: bool = False) -> tuple[int, float, bool]:
        """(length of the longest accepted run from the first word or 0, best share of the mandatory words matched, whether it came to the end of words)."""
        now, longest, best, table = self.start, 0, 0, self.by_hash if by_hash else self.by_word
        for i, w in enumerate(words, 1):
            after = 0
            for a, b in table.get(w, ()):
                if now & a:
                    after |= b
            for a, b in self.any:
                if now & a:
                    after |= b
            if not after:
                break
            now = after
            best = max(best, self.progress[now.bit_length() - 1])
            if now >> self.final & 1:
                longest = i
        else:
            return longest, 1.0 if longest else min(best, self.mandatory - 1) / self.mandatory, True
        return longest, 1.0 if longest else min(best, self.mandatory - 1) / self.mandatory, False


def word_hash(word: str) -> int:
    return int(C.RollingHash.of_bytes(np.frombuffer(word.encode(), dtype=np.uint8), 0, True).spans(np.array([0]), np.array([len(word.encode())]))[0])


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))


def scan_licenses(docs: DataFrame, *, text: str = "text", carry: list[str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """The carried columns of every row with the places of base phrases, labels, score and accepted template spans."""
    prepared(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name in (carry or ["doc_id"])]
    machines = [Automaton(*t) for t in (TEMPLATES if templates is None else templates)]
    starts: dict[int, list[int]] = {}
    for i, m in enumerate(machines):
        for w in m.first_words:
            starts.setdefault(word_hash(w), []).append(i)
    start_hashes = np.sort(np.array(list(starts), dtype=np.uint64))
    phrases = [(label, [word_hash(w) for w in phrase.split()]) for phrase, label in PHRASES.items()]
    longest = max([m.final for m in machines], default=0)

    def run(batches):
        for batch in C.slices(batches, text):
            data, offsets = C.text_buffer(batch.column(batch.schema.get_field_index(text)))
            words = C.Words(data, offsets, C.ALNUM)
            hashes, rows = words.hashes(lower=True), batch.num_rows
            n_base = np.zeros(rows, dtype=np.int64)
            first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1, dtype=np.int64)
            base: list[set[str]] = [set() for _ in range(rows)]
            for label, parts in phrases:
                n = len(words) - len(parts) + 1
                if n <= 0:
                    continue
                ok = words.row[:n] == words.row[len(parts) - 1 :]
                for j, h in enumerate(parts):
                    ok &= hashes[j : j + n] == np.uint64(h)
                at = np.flatnonzero(ok)
                row = words.row[at]
                np.add.at(n_base, row, 1)
                np.minimum.at(first, row, at - words.first[row])
                np.maximum.at(last, row, at - words.first[row])
                for r in np.unique(row).tolist():
                    base[r].add(label)
            labels = [set(x) for x in base]
            score, spans = np.zeros(rows), [[] for _ in range(rows)]
            at = np.flatnonzero(start_hashes[np.minimum(np.searchsorted(start_hashes, hashes), len(start_hashes) - 1)] == hashes) if len(start_hashes) and len(words) else []
            for i in np.asarray(at).tolist():
                r = int(words.row[i])
                end = min(i + longest, int(words.first[r + 1]))
                near = hashes[i : min(i + 6, end)].tolist()
                for k in starts[int(hashes[i])]:
                    length, share, more = machines[k].run(near, True)
                    if more and end > i + 6:
                        length, share, _ = machines[k].run(hashes[i:end].tolist(), True)
                    if length:  # the hashes agree; the words themselves decide
                        said = [data[a:b].tobytes().decode("utf-8", "replace").lower() for a, b in zip(words.starts[i : i + length].tolist(), words.ends[i : i + length].tolist(), strict=True)]
                        length, share, _ = machines[k].run(said)
                    score[r] = max(score[r], share)
                    if length:
                        labels[r].add(machines[k].label)
                        spans[r].append({"label": machines[k].label, "first": i - int(words.first[r]), "last": i - int(words.first[r]) + length - 1})
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(batch.schema.get_field_index(f.name)) for f in keep], pa.array(words.counts), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                    pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(score), pa.array(spans, _SPANS),
                ],
                names=[*[f.name for f in keep], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select(*[f.name for f in keep], *([text] if text not in [f.name for f in keep] else [])).mapInArrow(run, schema_with(keep, SCHEMA))
