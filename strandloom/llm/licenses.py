"""License scans: blocks compressed with each template as raw dictionary, ranked by the reduction, and confirmed word by word."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import slices, table, utf8

#: Names and wordings of public licences and notices. A block is compared with each.
TEMPLATES = {
    "MIT": " ".join(
        (
            "Permission is hereby granted, free of charge,",
            "to any person obtaining a copy of",
            "this software and associated documentation files (the",
            "\"Software\"), to deal in the Software without",
            "restriction, including without limitation the rights to",
            "use, copy, modify, merge, publish, distribute, sublicense,",
            "and/or sell copies of the Software, and",
            "to permit persons to whom the Software",
            "is furnished to do so, subject to",
            "the following conditions: The above copyright notice",
            "and this permission notice shall be included",
            "in all copies or substantial portions of",
            "the Software.",
        )
    ),
    "MIT-notice": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "all-rights-reserved": "All rights reserved.",
}
#: The share of a template's words that a passage must have, in order.
SHARE = 0.85
#: Blocks that a worker remembers.
CACHE = 20_000


def wording(text: bytes) -> list[bytes]:
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())


class Scanner:
    """Compresses blocks with the templates as dictionaries, and aligns them with the templates."""

    def __init__(self, templates: dict[str, str] | None = None):
        self.templates = {k: v.encode() for k, v in (templates or TEMPLATES).items()}
        self.words = {k: wording(v) for k, v in self.templates.items()}
        self.most = {k: max(1, round((1 - SHARE) * len(w))) for k, w in self.words.items()}  # words that may differ
        # Of a wording in most + 1 pieces, most differences leave one whole: a text that holds none of them can't be near it.
        pieces: dict[bytes, list[tuple[str, int]]] = {}
        for k, w in self.words.items():
            bounds = np.linspace(0, len(w), self.most[k] + 2).astype(int).tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b > a:
                    pieces.setdefault(b" " + b" ".join(w[a:b]) + b" ", []).append((k, a))
        self.pieces = ahocorasick.Automaton()
        for piece, of in pieces.items():
            self.pieces.add_word(piece.decode("latin-1"), (len(piece), of))
        self.pieces.make_automaton()
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.with_template = {k: zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, v in self.templates.items()}
        self.cache: dict[bytes, list] = {}

    def near(self, words: list[bytes], name: str) -> list[tuple[int, int, int]]:
        """(words that differ, first, last) of the passages with a template's wording, every end of the best of each start.

        An alignment by insertions and deletions of words; a cell is its cost times ``big`` plus where it began.
        """
        own, big = self.words[name], len(words) + 1
        ids = {w: i for i, w in enumerate(dict.fromkeys(own))}
        wanted = np.array([ids[w] for w in own])
        step = np.arange(len(own) + 1) * big
        cells, out = step.copy(), []
        for j, w in enumerate(words):
            new = cells + big
            new[0] = j + 1
            if w in ids:
                new[1:] = np.where(wanted == ids[w], np.minimum(new[1:], cells[:-1]), new[1:])
            cells = np.minimum.accumulate(new - step) + step
            differ, first = divmod(int(cells[-1]), big)
            if differ <= self.most[name] and len(own) + (j + 1 - first) - differ >= 2 * SHARE * len(own):
                out.append((differ, first, j + 1))
        return out

    def saved(self, text: bytes, name: str) -> tuple[int, float]:
        """Bytes, and their share, that a template as dictionary saves of the size compressed without one."""
        alone, given = (len(c.compress(text)) for c in (self.plain, self.with_template[name]))
        return alone - given, round(1 - given / alone, 6)

    def block(self, text: bytes) -> list[tuple[str, float, int, int, int]]:
        """(name, size reduction, words that differ, start, end in bytes) of all passages of a block that a template confirms."""
        if text in self.cache:
            return self.cache[text]
        if len(self.cache) >= CACHE:
            self.cache.clear()
        places = [m.span() for m in re.finditer(rb"[0-9a-z\x80-\xff]+", text.lower())]
        words, found = [text[a:b].lower() for a, b in places], []
        # The templates in order of how much they reduce the block; each is confirmed or not by its wording.
        for name in sorted(self.templates, key=lambda x: (-self.saved(text, x)[0], x)):
            # Of a passage's ends, the one that differs least stays.
            kept: list = []
            for differ, first, last in sorted(self.near(words, name), key=lambda x: (x[0], x[1] - x[2], x[1])):
                if all(last <= y[1] or first >= y[2] for y in kept):
                    kept.append((differ, first, last))
            for differ, first, last in kept:
                a, b = places[first][0], places[last - 1][1]
                found.append((name, *self.saved(text[a:b], name), differ, a, b))
        # Of confirmed passages that overlap, the one whose template saves more bytes of it stays.
        found.sort(key=lambda x: (-x[1], x[3], x[0]))
        kept = []
        for name, _, gain, differ, a, b in found:
            if all(b <= y[3] or a >= y[4] for y in kept):
                kept.append((name, gain, differ, a, b))
        self.cache[text] = sorted(kept, key=lambda x: x[3])
        return self.cache[text]

    def blocks(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Runs of words, however broken into lines, that hold every passage near a template with room for its differences."""
        joined = " " + b" ".join(words).decode("latin-1") + " "
        hits = list(self.pieces.iter(joined))
        starts = np.cumsum([0, *(len(w) + 1 for w in words)]) if hits else None
        near = []
        for end, (size, of) in hits:
            at = int(np.searchsorted(starts, end + 1 - size))
            for name, offset in of:
                k = at - offset
                near.append((max(0, k - self.most[name]), min(len(words), k + len(self.words[name]) + self.most[name])))
        out: list[tuple[int, int]] = []
        for a, b in sorted(near):
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def scan(self, text: bytes) -> list[tuple[str, float, int, int, int]]:
        """The licences of a whole text, by their place in it, in code points."""
        runs, found = self.blocks(wording(text)), []
        places = [m.span() for m in re.finditer(rb"[0-9a-z\x80-\xff]+", text.lower())] if runs else []
        for first, last in runs:
            a, b = places[first][0], places[last - 1][1]
            found += [(name, gain, differ, s + a, e + a) for name, gain, differ, s, e in self.block(text[a:b])]
        points, out, pos = 0, [], 0
        for name, gain, differ, s, e in found:
            points += len(text[pos:s].decode("utf-8", "replace"))
            size = len(text[s:e].decode("utf-8", "replace"))
            out.append((name, gain, differ, points, points + size))
            points, pos = points + size, e
        return out


def scanned(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs with licenses, an array of (name, reduction, differences, start, end), of each row's whole text.

    Null and empty texts have none; copies of a line have one each; repeated rows give equal rows. A column ``licenses``
    is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("licenses", text)]
    kind = "array<struct<name:string,reduction:double,differences:long,start:long,end:long>>"
    arrow = pa.list_(pa.struct([("name", pa.string()), ("reduction", pa.float64()), ("differences", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    names = ("name", "reduction", "differences", "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in slices(batches, "_text"):
            found = [[dict(zip(names, x, strict=True)) for x in scanner.scan(t)] for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, arrow)], [*keep, "licenses"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(*keep, utf8(text).alias("_text")).mapInArrow(run, f"{schema}licenses {kind}")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's licences: how many, their names, places, best reduction and differing words.

    Null and empty texts have none, and their reduction is null; repeated rows give equal rows; no documents give no rows.
    """
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.sort_array(F.array_distinct("licenses.name")), ",").alias("names"),
        F.array_join(spans, ",").alias("spans"), F.array_max("licenses.reduction").alias("reduction"), F.aggregate("licenses", F.lit(0).cast("long"), lambda a, x: a + x["differences"]).alias("differences"),
    )
