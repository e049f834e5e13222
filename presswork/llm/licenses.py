"""Licence scans: Dice coefficient of word bigrams between text windows and licence templates.

A text is normalised to words (lower case, letters and digits, "licence" spelt "license"). A template
of m bigrams is compared with every window of m consecutive bigrams of the text, or with the whole
text where that is shorter. Two bounds prune the work without changing the result: with bag sizes a
and b the coefficient is at most 2 min(a, b) / (a + b), and a window cannot score more than the
number of its places whose bigram occurs in the template.

Templates are headers, one-line notices, SPDX tags and the opening passages of licence bodies. Each bigram has a bit
for every template that holds it, in as many 64-bit words as the templates need, so their number is not limited.

Every window that reaches the threshold counts. Of overlapping windows the one with most bigrams in common stays,
then the better score, then the earlier one, so look-alikes (CC BY in CC BY-NC, GPL 2 and 3) are told apart and
a full header goes before the notice inside it. A name may have several wordings, written ``name#2``.

Null and empty texts find nothing, an empty table gives an empty result; very long texts are scanned whole. Of windows
that tie the first template stays. Repeated rows give the same answer each. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from presswork.llm.common import append_from_text

# Notices and headers as their publishers word them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
           "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
           "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                  "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                  "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                  "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
               "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
               "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
               "GNU General Public License for more details.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
           "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
           "this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
           "the distribution.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
               "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                 "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                 "binary, for any purpose, commercial or non-commercial, and by any means.",
}
_GPL = TEMPLATES["gpl-3.0"]
_LESSER = _GPL.replace("General Public", "Lesser General Public").replace("This program", "This library")
TEMPLATES |= {
    "gpl-2.0": _GPL.replace("version 3", "version 2"),
    "lgpl-2.1": _LESSER.replace("version 3", "version 2.1"),
    "lgpl-3.0": _LESSER,
    "agpl-3.0": _GPL.replace("General Public", "Affero General Public"),
    "mit-notice#2": "Licensed under the MIT License.",
    "apache-2.0-notice#2": "Licensed under the Apache License 2.0.",
    "apache-2.0-notice#3": "Released under the Apache License 2.0.",
    "mpl-2.0-notice": "Licensed under the Mozilla Public License 2.0.",
    "isc-notice": "Licensed under the ISC License.",
    "bsd-notice": "Licensed under the BSD 3-Clause License.",
    "bsd-notice#2": "Licensed under the BSD License.",
    "cc0-1.0": "Licensed under CC0 1.0.",
}
for _name, _words in {"gpl-2.0": "General Public License, version 2", "lgpl-2.1": "Lesser General Public License, version 2.1",
                      "lgpl-3.0": "Lesser General Public License, version 3", "agpl-3.0": "Affero General Public License, version 3"}.items():
    TEMPLATES[f"{_name}-notice"] = f"This work is licensed under the GNU {_words}."
for _kind, _words in {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial",
                      "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
                      "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}.items():
    for _version, _scope in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES.setdefault(f"cc-{_kind}-{_version}", f"This work is licensed under a Creative Commons {_words} {_version} {_scope} License.")
        TEMPLATES.setdefault(f"cc-{_kind}-{_version}-notice", f"Licensed under CC {_kind.upper()} {_version}.")
# opening passages of licence texts
_FSF = ("Copyright (C) {years} Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies "
        "of this license document, but changing it is not allowed.")
for _name, _title in {
    "gpl-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "agpl-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "lgpl-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gpl-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
}.items():
    _years = {"gpl-2.0": "1989, 1991", "lgpl-2.1": "1991, 1999"}.get(_name, "2007")
    TEMPLATES[f"{_name}#title"] = _title
    TEMPLATES[f"{_name}#opening"] = f"{_title} {_FSF.format(years=_years)}"
TEMPLATES |= {
    "apache-2.0#title": "Apache License Version 2.0, January 2004",
    "apache-2.0#opening": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND "
                          "DISTRIBUTION 1. Definitions.",
    "mpl-2.0#opening": "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, "
                       "contributes to the creation of, or owns Covered Software.",
    "mpl-2.0#title": "Mozilla Public License Version 2.0",
    "bsd#distributed": "distributed under the terms of the BSD license",
    "bsd#style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mit#distributed": "distributed under the terms of the MIT license",
    "apache-2.0#distributed": "distributed under the terms of the Apache License 2.0",
    "gpl-3.0#distributed": "distributed under the terms of the GNU General Public License version 3",
    "gpl-2.0#distributed": "distributed under the terms of the GNU General Public License version 2",
}
for _kind, _words in {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial",
                      "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
                      "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}.items():
    TEMPLATES[f"cc-{_kind}-4.0#opening"] = (
        f"Creative Commons {_words} 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be "
        f"bound by the terms and conditions of this Creative Commons {_words} 4.0 International Public License (\"Public License\").")
for _tag in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1",
             "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only",
             "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0"):
    _name = re.sub("-(only|or-later|[23]-clause)$", "", _tag.lower())
    TEMPLATES[f"{_name}#spdx-{_tag}"] = f"SPDX-License-Identifier: {_tag}"
THRESHOLD = 0.8
_WORD = re.compile(r"[a-z0-9]+")


def normalise(text: str) -> list[tuple[str, int, int]]:
    """Words with their code point offsets in the original text."""
    # lower-casing A-Z only keeps every offset where it was
    low = text.translate(_LOWER)
    return [("license" if m[0] == "licence" else m[0], m.start(), m.end()) for m in _WORD.finditer(low)]


_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@dataclass
class Scanner:
    """Templates as bigram bags, and one table from a bigram to the templates that have it."""

    templates: dict[str, str]
    threshold: float = THRESHOLD

    def __post_init__(self):
        words = {name: [w for w, _, _ in normalise(body)] for name, body in self.templates.items()}
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for ws in words.values() for w in ws}))}
        self.width = len(self.ids) + 1
        # one row of masks for every 64 templates
        self.masks = np.zeros((-(-len(words) // 64), self.width * self.width), np.uint64)
        self.bags = []
        for k, (name, ws) in enumerate(words.items()):
            bag = Counter(self.ids[a] * self.width + self.ids[b] for a, b in zip(ws, ws[1:]))
            self.masks[k // 64, list(bag)] |= np.uint64(1 << k % 64)
            self.bags.append((name, sum(bag.values()), bag))

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, score, start, end) of the windows at or above the threshold that overlap no better one, in template order."""
        low = text.translate(_LOWER)
        words = [self.ids.get("license" if w == "licence" else w, 0) for w in _WORD.findall(low)]
        size = len(words) - 1
        if size < 1:
            return []
        ids = np.array(words, np.int64)
        codes = ids[:-1] * self.width + ids[1:]
        masks = self.masks[:, codes]
        places = np.flatnonzero(masks.any(0))
        if not len(places):
            return []
        masks = masks[:, places]
        # how many places each template has: a template with too few is not looked at
        bits = (masks[:, None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)
        own_places = bits.sum(2).ravel()
        able = []
        for k, (name, m, bag) in enumerate(self.bags):
            a = min(m, size)
            if 2 * a < self.threshold * (a + m):  # size bound
                continue
            need = self.threshold * (a + m) / 2
            if own_places[k] < need:
                continue
            own = places[bits[k // 64, k % 64] == 1]
            able += [(-common, -2 * common / (a + m), at, k, a) for common, at in self._windows(codes, own, a, need, bag)]
        if not able:
            return []
        taken: list[tuple[int, int]] = []  # first and last word of the windows that stay, in order
        stay = []
        for common, score, at, k, a in sorted(able):
            i = bisect(taken, (at, at + a))
            if (i and taken[i - 1][1] >= at) or (i < len(taken) and taken[i][0] <= at + a):
                continue
            taken.insert(i, (at, at + a))
            stay.append((k, at, -score, at + a))
        spans = [x.span() for x in _WORD.finditer(low)]
        return [(self.bags[k][0].partition("#")[0], score, spans[at][0], spans[last][1]) for k, at, score, last in sorted(stay)]

    @staticmethod
    def _windows(codes: np.ndarray, own: np.ndarray, a: int, need: float, bag: Counter) -> list[tuple[int, int]]:
        """(bag intersection, place) of the windows of ``a`` bigrams that have at least ``need`` in common."""
        hits = np.zeros(len(codes) + 1, np.int64)
        hits[own + 1] = 1
        hits = hits.cumsum()
        able = np.flatnonzero(hits[a:] - hits[:-a] >= need)
        found, last = [], -2
        counts: Counter = Counter()
        common = 0
        for i in able.tolist():
            if i != last + 1:  # windows slide by one bigram where they follow on each other
                counts = Counter(codes[i:i + a].tolist())
                common = sum(min(n, bag[c]) for c, n in counts.items())
            else:
                old, new = int(codes[i - 1]), int(codes[i + a - 1])
                common -= counts[old] <= bag[old]
                counts[old] -= 1
                counts[new] += 1
                common += counts[new] <= bag[new]
            last = i
            if common >= need:
                found.append((common, i))
        return found


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``licenses`` (distinct names in template order), ``best_license``, ``best_score``
    (null without a find) and ``spans``: name, score and code point offsets of each find."""
    templates = TEMPLATES if templates is None else templates

    def make():
        scanner = Scanner(templates, threshold)

        def work(texts: list[str]) -> list[list]:
            out: list[list] = [[], [], [], []]
            for t in texts:
                found = scanner.scan(t)
                top = max(found, key=lambda f: f[1], default=None)
                out[0].append(list(dict.fromkeys(f[0] for f in found)))
                out[1].append(top and top[0])
                out[2].append(top and top[1])
                out[3].append([{"license": n, "score": s, "start": b, "end": e} for n, s, b, e in found])
            return out

        return work

    return append_from_text(
        docs.select(key, text), text,
        "licenses array<string>, best_license string, best_score double, "
        "spans array<struct<license: string, score: double, start: int, end: int>>", make, drop_text=True,
    )
