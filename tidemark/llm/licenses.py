"""Licence scans by conditional compression.

Candidate blocks are sentences and paragraphs with a licence word; of paragraphs over LONG characters, overlapping
windows around all licence words, each with room for the longest template on both sides. Sentences end at line
feeds, and are judged once more as they run on over them, with spaces for line feeds. Windows that run on over
blank lines are judged as well, and count where they name a licence that no block inside them names. Each distinct block is compressed by
zstandard alone and with every template as raw dictionary; templates are ranked by the share of the block's
size that they save. The best ones are then confirmed by their exact wording: words of the template and of
the block are aligned, and a template holds if at least `agree` of its words stand in the block in order and no
difference touches a word that tells licences apart (numbers, versions, names, conditions). Blocks of several lines or over 60 words are
held against templates of 20 words or more; shorter notices stand in sentences of their own. Of several that
hold the one wins that explains most words, each difference counting against two, then the one with fewest differing
words, then the one that saves most, then the first by name. Templates are notices and whole texts of short licences.

`SPDX-License-Identifier:` tags name their licence, or an expression of names, themselves: they are blocks of their own.

Defined results: a null or empty text has no blocks; a block that no template explains is counted, with no
licence; equal texts, repeated rows too, have equal results. All blocks of a text are scanned, of whatever number, and
very long texts whole; an empty table gives none; other columns pass through but for the output's name.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spark_util import in_arrow

#: Names (SPDX) and wordings of common licence notices.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Licensed under the 2-Clause BSD License."],
    "BSD-3-Clause": ["Licensed under the 3-Clause BSD License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "Licensed under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0."],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ],
    "EUPL-1.2": ["Licensed under the EUPL-1.2.", "Licensed under the European Union Public Licence, version 1.2."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "All-Rights-Reserved": ["All rights reserved."],
}
#: Whole texts of short licences, of which the notices above are parts.
TEXTS: dict[str, str] = {
    "MIT": TEMPLATES["MIT"][2] + " " + "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": TEMPLATES["ISC"][0] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense": TEMPLATES["Unlicense"][0] + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": TEMPLATES["Zlib"][0] + " 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
_KEEP = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEXTS["BSD-2-Clause"] = " ".join([TEMPLATES["BSD-2-Clause"][0], _KEEP, _AS_IS])
TEXTS["BSD-3-Clause"] = " ".join([TEMPLATES["BSD-2-Clause"][0], _KEEP, "3. " + TEMPLATES["BSD-3-Clause"][1], _AS_IS])
for _name, _text in TEXTS.items():
    TEMPLATES.setdefault(_name, []).append(_text)
#: Tags that name a licence: an expression of names joined by AND, OR and WITH.
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[A-Za-z0-9.+-]+(?:\)(?=[ \t]+(?:AND|OR|WITH)\b))?)*)")
#: Words that tell licences apart; a difference in one of them refutes a template.
TELLING = frozenset("not no mit apache gnu bsd lesser affero general public cc cc0 by nc nd sa sharealike noncommercial noderivatives attribution mozilla isc neither 2 3 4 1 0 v version clause domain reserved unencumbered redistribution".split())
TRIGGER = r"(?i)licen[cs]e|copyright|spdx|permission (is hereby|to use)|redistribut|public domain|\bcc[ -](by|0)|\bcc0\b|rights reserved|unencumbered|endorse or promote"
WORD = re.compile(r"[^\W_]+")
#: Paragraphs of more characters are judged in windows; a window has REACH characters around a licence word.
LONG = 4000
REACH = 3 * max(len(text) for wordings in TEMPLATES.values() for text in wordings) // 2
_SENTENCE = re.compile(r"(?:[^.!?\n]|[.!?](?=[^\s]))+[.!?:]*")
_WRAPPED = re.compile(r"(?:[^.!?]|[.!?](?=[^\s]))+[.!?:]*")
_BLANK = re.compile(r"\n\s*\n")
_ITEM = re.compile(r"(?<=[.;:])\s+\d{1,2}[.)](?=\s|$)")


def words(text: str) -> list[str]:
    """Lower-case words and numbers, without the numbers of a list's items."""
    return WORD.findall(_ITEM.sub(" ", text).lower())


def windows(text: str, lo: int, hi: int, trigger: re.Pattern) -> list[tuple[int, int]]:
    """(start, end) of windows of text[lo:hi]; each notice of up to REACH characters with a trigger lies in one."""
    out, done = [], -1
    for m in trigger.finditer(text.replace("\n", " "), lo, hi):
        if m.end() > done:
            out.append((max(lo, m.start() - REACH), min(hi, m.end() + 2 * REACH)))
            done = m.end() + REACH
    return out


def blocks(text: str, trigger: re.Pattern) -> list[tuple[int, int, str]]:
    """(start, length, wording) of candidate blocks: paragraphs with a trigger, or windows of long ones, and, where they
    differ, their sentences with one, of single lines and as they run on over line feeds."""
    out = []
    for m in re.finditer(r"[^\n]+(?:\n(?!\s*\n)[^\n]+)*", text):
        if not trigger.search(m.group().replace("\n", " ")):
            continue
        if len(m.group()) <= LONG:
            out.append((m.start(), len(m.group()), m.group()))
        else:
            out += [(a, b - a, text[a:b]) for a, b in windows(text, m.start(), m.end(), trigger)]
        for kind in (_SENTENCE, _WRAPPED):
            for line in kind.finditer(m.group()):
                own = line.group().strip()
                if kind is _WRAPPED and "\n" not in own:
                    continue
                flat = " ".join(own.split("\n"))
                if trigger.search(flat) and (line.group() != m.group() or kind is _WRAPPED):
                    out.append((m.start() + line.start() + len(line.group()) - len(line.group().lstrip()), len(own), flat))
    return out


def run_ons(text: str, trigger: re.Pattern) -> list[tuple[int, int, str]]:
    """(start, length, wording) of windows of the whole text that hold a blank line."""
    if not _BLANK.search(text):
        return []
    return [(a, b - a, text[a:b]) for a, b in windows(text, 0, len(text), trigger) if _BLANK.search(text, a, b)]


class Scanner:
    """Compressors with templates as dictionaries, and results of distinct blocks (at most `most` are kept)."""

    _made: dict[tuple, Scanner] = {}

    def __init__(self, save: float, agree: float, top: int, most: int = 100_000):
        import zstandard

        self.save, self.agree, self.top, self.most = save, agree, top, most
        self.trigger = re.compile(TRIGGER)
        self.plain = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
        self.templates = []
        for name, wordings in TEMPLATES.items():
            for text in wordings:
                raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.templates.append((name, words(text), zstandard.ZstdCompressor(level=3, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False)))
        self.wordings = {name: [" ".join(words(t)) for t in texts] for name, texts in TEMPLATES.items()}
        self.known: dict[str, tuple | None] = {}

    @classmethod
    def get(cls, *key) -> Scanner:
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def judge(self, block: str) -> tuple[str, int, int, list[str]] | None:
        """name, bytes saved, number of differing words, and these words (-missing, +added inside) of the winner."""
        data = block.encode("utf-8", "replace")
        alone = len(self.plain.compress(data))
        ranked = sorted(((alone - len(c.compress(data)), i) for i, (_, _, c) in enumerate(self.templates)), key=lambda x: (-x[0], x[1]))
        own, best = words(block), None
        if "\n" in block or len(own) > 60:
            ranked = [x for x in ranked if len(self.templates[x[1]][1]) >= 20]
        for saved, i in ranked[: self.top]:
            name, template, _ = self.templates[i]
            if saved < self.save * min(alone, len(" ".join(template))):
                break
            same = SequenceMatcher(None, template, own, autojunk=False).get_matching_blocks()
            hit = [b for b in same if b.size]
            if not hit or sum(b.size for b in hit) < self.agree * len(template):
                continue
            missing = [w for k, w in enumerate(template) if not any(b.a <= k < b.a + b.size for b in hit)]
            added = [w for k, w in enumerate(own[hit[0].b : hit[-1].b + hit[-1].size], hit[0].b) if not any(b.b <= k < b.b + b.size for b in hit)]
            if TELLING.intersection(missing) or TELLING.intersection(added):
                continue
            difference = ["-" + w for w in missing] + ["+" + w for w in added]
            # a whole text with a few words changed explains more than a sentence of it that is there to the letter
            key = (2 * len(difference) - sum(b.size for b in hit), len(difference), -saved, name)
            if best is None or key < best[0]:
                best = (key, (name, int(saved), len(difference), difference))
        return best[1] if best else None

    def found(self, block: str) -> tuple | None:
        if block not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[block] = self.judge(block)
        return self.known[block]

    def scan(self, text: str) -> list[dict]:
        out = []
        for tag in TAG.finditer(text):
            out.append({"start": tag.start(), "length": tag.end() - tag.start(), "license": " ".join(tag[1].split()), "saved": 0, "n_differences": 0, "differences": []})
        for start, length, block in blocks(text, self.trigger):
            found = self.found(block)
            if "\n" in text[start : start + length] and "\n" not in block:  # a wrapped sentence: counts where it adds a licence
                inside = {b["license"] for b in out if b["start"] < start + length and start < b["start"] + b["length"]}
                if not found or found[0] in inside:
                    continue
            name, saved, n, difference = found or (None, 0, 0, [])
            out.append({"start": start, "length": length, "license": name, "saved": saved, "n_differences": n, "differences": difference})
        for start, length, block in run_ons(text, self.trigger):
            found = self.found(block)
            inside = {b["license"] for b in out if b["start"] < start + length and start < b["start"] + b["length"]}
            if found and found[0] not in inside:
                out.append({"start": start, "length": length, "license": found[0], "saved": found[1], "n_differences": found[2], "differences": found[3]})
        return self.nested(text, out)

    def nested(self, text: str, out: list[dict]) -> list[dict]:
        """Blocks with the wording of a longer licence that a block around them has are parts of that licence."""
        named = [b for b in out if b["license"]]
        for x in named:
            for y in named:
                if x["license"] != y["license"] and y["length"] > x["length"] and y["start"] <= x["start"] and x["start"] + x["length"] <= y["start"] + y["length"]:
                    own = " ".join(words(text[x["start"] : x["start"] + x["length"]]))
                    if any(own in whole for whole in self.wordings.get(y["license"], ())):
                        x["license"] = y["license"]
        return out


SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("license", pa.string()), ("saved", pa.int64()), ("n_differences", pa.int64()), ("differences", pa.list_(pa.string()))])


def scan(df: DataFrame, text: str = "text", out: str = "blocks", save: float = 0.3, agree: float = 0.85, top: int = 6) -> DataFrame:
    """Adds the candidate blocks of each whole text with their licence, bytes saved and wording differences."""
    own = [c for c in df.columns if c != out]
    kind = T.ArrayType(T.StructType.fromDDL("start long, length long, license string, saved long, n_differences long, differences array<string>"))
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField(out, kind)])

    def run(batches):
        scanner = Scanner.get(save, agree, top)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                column = part.column(text)
                flat = pc.replace_substring(column, "\n", " ")
                hit = pc.fill_null(pc.match_substring_regex(flat, TRIGGER), False).to_numpy(zero_copy_only=False)
                found: list[list] = [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(hit):
                    found[i] = scanner.scan(column[int(i)].as_py())
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(found, pa.list_(SPAN))], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in own]).transform(in_arrow, run, schema)


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences of every document: candidate blocks, those explained, names, bytes saved and differing words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    named = F.filter("blocks", lambda b: b["license"].isNotNull())
    return scan(docs).select(
        "doc_id",
        F.size("blocks").cast("long").alias("n_blocks"),
        F.size(named).cast("long").alias("n_licensed"),
        F.array_join(F.array_sort(F.array_distinct(named["license"])), ",").alias("licenses"),
        F.aggregate(named["saved"], F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes_saved"),
        F.aggregate(named["n_differences"], F.lit(0).cast("long"), lambda a, x: a + x).alias("n_differences"),
    )
