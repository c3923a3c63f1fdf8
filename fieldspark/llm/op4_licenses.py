"""Operator 4: license scan by conditional compression. Blocks of text with a license cue are compressed
with each license template as a raw zstandard dictionary; the templates that shrink a block are
then confirmed, greatest saving first, by the exact differences between their wording and the block's."""

from __future__ import annotations

import difflib
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm.common import ship, slices, table, text_of

# fixed values: wordings of public licenses and notices
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}
# fixed values: parts of words that stand in every template
CUES = ("licen", "rights reserved", "permission", "redistribut", "copyright", "warrant", "public domain")

NEAR = 600  # characters on either side of a cue that belong to its block
LEAST_SAVED = 1  # bytes of the compressed block that a template must save
LEAST_WORDS = 0.8  # share of a template's words that must stand in the block, in order
LEVEL = 3

_CUE = re.compile("|".join(map(re.escape, CUES)))
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")


def candidate_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the blocks around cues. A block reaches NEAR characters to either side of a cue, to
    word ends, also over empty lines, as licenses have paragraphs; blocks that touch are one, so a block
    has no greatest length."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length in lower case
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    out: list[tuple[int, int]] = []
    for m in _CUE.finditer(low):
        start, end = max(m.start() - NEAR, 0), min(m.end() + NEAR, len(text))
        while start > 0 and not text[start - 1].isspace() and start > m.start() - 2 * NEAR:
            start -= 1
        while end < len(text) and not text[end].isspace() and end < m.end() + 2 * NEAR:
            end += 1
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class Scanner:
    """Templates as prepared raw dictionaries, and their words."""

    def __init__(self, templates: dict[str, str]):
        options = {"write_content_size": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(level=LEVEL, **options).compress
        self.with_ = {}
        for name, t in templates.items():
            data = zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.with_[name] = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, **options).compress
        self.words = {name: [w.lower() for w in _WORD.findall(t)] for name, t in templates.items()}
        self.margin = 2 * max([NEAR, *map(len, templates.values())])  # longer than any wording with its differences

    def rank(self, block: str) -> list[tuple[float, str]]:
        """(size reduction, template) of the templates that save enough, greatest first, then by name."""
        raw = block.encode("utf-8", "surrogatepass")
        alone = len(self.plain(raw))
        saved = ((alone - len(c(raw)), name) for name, c in self.with_.items())
        return [(s / alone, name) for s, name in sorted(saved, key=lambda s: (-s[0], s[1])) if s >= LEAST_SAVED]

    def compare(self, block: str, name: str) -> tuple[int, int, float, list[str]] | None:
        """(start, end, share of the template's words, differences) of the best place of the template in
        the block; a difference is ``-word`` for a missing and ``+word`` for an added word. None if the
        block has too few of the template's words in any order."""
        found = list(_WORD.finditer(block))
        have, want = [m[0].lower() for m in found], self.words[name]
        if sum((Counter(want) & Counter(have)).values()) / len(want) < LEAST_WORDS:
            return None
        seed = difflib.SequenceMatcher(None, want, have, autojunk=False).find_longest_match()
        if not seed.size:
            return None
        margin = len(want) // 4 + 2  # the place is aligned with some words to spare
        low, high = max(seed.b - seed.a - margin, 0), min(seed.b - seed.a + len(want) + margin, len(have))
        near = difflib.SequenceMatcher(None, want, have[low:high], autojunk=False)
        same = [b for b in near.get_matching_blocks() if b.size]
        share = sum(b.size for b in same) / len(want)
        first, last = same[0].b, same[-1].b + same[-1].size
        differences = []
        for op, a, b, c, d in near.get_opcodes():
            if op != "equal":
                differences += [f"-{w}" for w in want[a:b]] + [f"+{w}" for w in have[low + max(c, first) : low + min(d, last)]]
        return found[low + first].start(), found[low + last - 1].end(), share, differences

    def places(self, block: str, name: str) -> list[tuple[int, int]]:
        """(start, end) of all places of the template's words in the block without a difference."""
        found, want = list(_WORD.finditer(block)), self.words[name]
        have = [m[0].lower() for m in found]
        out, i = [], 0
        while i <= len(have) - len(want):
            if have[i] == want[0] and have[i : i + len(want)] == want:
                out.append((found[i].start(), found[i + len(want) - 1].end()))
                i += len(want)
            else:
                i += 1
        return out

    def scan(self, text: str) -> list[tuple[int, int, str, float, float, list[str]]]:
        """(start, end, template, reduction, share, differences) of the confirmed licenses, by place. Of
        places that overlap, the one with more equal words stays, then the one with fewer differences.
        Long blocks are scanned in windows that overlap by two margins; what ends in the last margin of a
        window is left to the next one, so that no wording is cut."""
        out = []
        for start, end in candidate_blocks(text):
            at = start
            while at < end:
                stop = min(at + 3 * self.margin, end)
                found = self._scan(text, at, stop)
                if stop < end:
                    found = [f for f in found if f[1] <= stop - self.margin]
                out += sorted(found)
                at = end if stop == end else max([stop - 2 * self.margin, *(f[1] for f in found)])
        return out

    def _scan(self, text: str, start: int, end: int) -> list[tuple[int, int, str, float, float, list[str]]]:
        rest, found = [(start, end)], []
        while rest:
            a, z = rest.pop()
            best = None
            for reduction, name in self.rank(text[a:z]):
                hit = self.compare(text[a:z], name)
                if hit and hit[2] >= LEAST_WORDS:
                    key = (hit[2] * len(self.words[name]) - len(hit[3]), hit[2], name)
                    best = max(best, (key, hit, name, reduction)) if best else (key, hit, name, reduction)
            if not best:
                continue
            (s, e, share, differences), name, reduction = best[1:]
            # no wording of the block has more equal words, so all its other exact places win too
            for s, e in [(s, e)] if differences else self.places(text[a:z], name):
                found.append((a + s, a + e, name, reduction, share, differences))
            ends = sorted(f[:2] for f in found if a <= f[0] and f[1] <= z)
            for x, y in zip([a, *(e for _, e in ends)], [*(s for s, _ in ends), z]):
                if _CUE.search(text[x:y].lower()):
                    rest.append((x, y))
        return found


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, start, end, license, reduction, word_share, exact, differences: a row for each license
    wording found, with its place in code points.

    Null and empty texts, and texts without a cue, give no rows. Equal rankings are ordered by the
    template's name; repeated rows and rows with a null doc_id are scanned like others. Whole texts
    are scanned, however long; an empty table gives an empty result; other columns are not looked at.
    """
    ship(docs.sparkSession)
    known = dict(templates or TEMPLATES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("word_share", pa.float64()), ("exact", pa.bool_()), ("differences", pa.list_(pa.string()))])

    def run(batches):
        scanner = Scanner(known)
        for b in slices(batches, "_text"):
            rows, at = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for s, e, name, reduction, share, differences in scanner.scan(t):
                    at.append(i)
                    rows.append({"start": s, "end": e, "license": name, "reduction": reduction, "word_share": share, "exact": not differences, "differences": differences})
            if rows:
                found = pa.RecordBatch.from_pylist(rows, schema)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *found.columns], names=["doc_id", *schema.names])

    narrow = docs.select("doc_id", text_of().alias("_text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, start long, end long, license string, reduction double, word_share double, exact boolean, differences array<string>")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
