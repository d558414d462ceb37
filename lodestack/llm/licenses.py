"""License scans: templates retrieved by MinHash bands over overlapping windows, verified by containment.

Texts are words of letters and digits in lower case, in shingles of five. A template of m shingles is looked
for in windows of 2 b shingles at every b-th place, b the power of two from m on, so that each occurrence
lies wholly in one window. A window that holds 0.8 of the template's shingles has a Jaccard similarity of at
least 0.8 m / (2 b + 0.2 m) >= 0.19 with it, and one of BANDS bands of a single MinHash agrees with
probability 1 - (1 - 0.19)^32 > 0.998 (0.9999 for a whole template). Minima of blocks are shared by all
window sizes. A template that some window retrieves is verified by the exact share of its shingles in the
whole text, so that the containment does not hang on where windows lie; shingles that are strewn over more
than a window need not be retrieved.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import mix
from .license_texts import TEXTS
from .piece_codec import BLOCK_CHARS
from .shingles import shingles, words

BANDS = 32

# Fixed values: (family, license, notice). Notices need five words.
VERSIONS = {"Apache": ["1.0", "1.1", "2.0"], "GPL": ["1", "2", "3"], "LGPL": ["2", "2.1", "3"], "AGPL": ["3"], "MPL": ["1.1", "2.0"], "CC": ["1.0", "2.0", "2.5", "3.0", "4.0"]}
TEMPLATES = [
    ("MIT", "MIT", "Released under the MIT License."),
    ("MIT", "MIT", "This project is licensed under the MIT License."),
    ("MIT", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC0", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    *(("Apache", f"Apache-{v}", f"Licensed under the Apache License, Version {v}.") for v in VERSIONS["Apache"]),
    *(("GNU", f"GPL-{v}", f"This work is licensed under the GNU General Public License, version {v}.") for v in VERSIONS["GPL"]),
    *(("GNU", f"LGPL-{v}", f"This work is licensed under the GNU Lesser General Public License, version {v}.") for v in VERSIONS["LGPL"]),
    *(("GNU", f"AGPL-{v}", f"This work is licensed under the GNU Affero General Public License, version {v}.") for v in VERSIONS["AGPL"]),
    *(("MPL", f"MPL-{v}", f"This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}.") for v in VERSIONS["MPL"]),
    *((f"CC-{k}", f"CC-{k}-{v}", f"Licensed under CC {k} {v}.") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in VERSIONS["CC"]),
    *TEXTS,
]

FOLD = np.full(256, 0x20, np.uint8)
for _c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    FOLD[_c] = _c
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def shingled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of five folded words and the offsets of the texts'; texts of fewer words have one that no template has."""
    return shingles(*words(FOLD[data], offsets))


class Matcher:
    def __init__(self, templates: list[tuple[str, str, str]], least: float):
        self.templates, self.least = templates, least
        raw = [t[2].encode() for t in templates]
        flat, ends = shingled(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        self.sets = [np.unique(flat[a:b]) for a, b in pairwise(ends)]
        # Wordings that lie within a longer one of another license of their family, with what that one has besides.
        self.within: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, (family, name, _) in enumerate(templates):
            for j, (other, title, _) in enumerate(templates):
                if family == other and name != title and len(self.sets[j]) > len(self.sets[i]) and np.isin(self.sets[i], self.sets[j]).mean() >= least:
                    self.within.setdefault(i, []).append((j, np.setdiff1d(self.sets[j], self.sets[i])))
        self.factor = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)
        self.by_level: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            self.by_level.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
        self.found: dict[tuple[int, int], tuple[np.ndarray, dict[int, list[int]]]] = {}
        for level, which in self.by_level.items():
            for j in range(BANDS):
                at: dict[int, list[int]] = {}
                for i in which:
                    at.setdefault(int(self.hash(self.sets[i], j).min()), []).append(i)
                hint = np.zeros(1 << 16, bool)
                hint[[k >> 48 for k in at]] = True
                self.found[level, j] = (hint, at)

    def hash(self, x: np.ndarray, j: int) -> np.ndarray:
        h = x * self.factor[j]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        return h

    def windows(self, x: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, begin, end) of the windows that a band retrieves."""
        out = set()
        for j in range(BANDS):
            low, level = self.hash(x, j), 1
            while len(low):
                if level in self.by_level:
                    hint, at = self.found[level, j]
                    pair = np.minimum(low[:-1], low[1:]) if len(low) > 1 else low
                    for k in np.flatnonzero(hint[pair >> np.uint64(48)]).tolist():
                        out.update((i, k * level, (k + 2) * level) for i in at.get(int(pair[k]), ()))
                if level >= max(self.by_level):
                    break
                low = np.minimum(low[0::2], np.append(low[1::2], low[-1:]) if len(low) % 2 else low[1::2])
                level *= 2
        return out

    def match(self, x: np.ndarray, ends: np.ndarray) -> dict[int, list[tuple[str, float]]]:
        """text -> (license, containment) by name: of each family those that are wholly contained, or else the best one, by containment, length and name, without the wordings that a longer one accounts for."""
        met: set[tuple[int, int]] = set()
        for i, a, b in self.windows(x):
            hit = np.flatnonzero(np.isin(x[a:b], self.sets[i])) + a
            met.update((int(t), i) for t in np.unique(np.searchsorted(ends, hit, "right") - 1))
        share = {(t, i): np.count_nonzero(np.isin(self.sets[i], x[ends[t] : ends[t + 1]])) / len(self.sets[i]) for t, i in met}
        share = {k: v for k, v in share.items() if v >= self.least}
        best: dict[int, dict[str, dict[str, tuple[float, int]]]] = {}
        for (t, i), part in share.items():
            if any((t, j) in share and 2 * np.count_nonzero(np.isin(more, x[ends[t] : ends[t + 1]])) > len(more) for j, more in self.within.get(i, ())):
                continue
            family, name, _ = self.templates[i]
            own = best.setdefault(t, {}).setdefault(family, {})
            own[name] = max((part, len(self.sets[i])), own.get(name, (0.0, 0)))
        out = {}
        for t, families in best.items():
            out[t] = []
            for own in families.values():
                whole = [n for n, (share, _) in own.items() if share == 1.0]
                out[t] += [(n, own[n][0]) for n in whole or [min(own, key=lambda n: (-own[n][0], -own[n][1], n))]]
        return {t: sorted(found) for t, found in out.items()}


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licenses array<struct<license, containment>>) of every document, by license name; empty where none is found.

    Of licenses of one family (versions) all that are wholly contained count, or else the best contained one, the longer one at
    ties. A wording that lies within a longer one of its family, to the share `least`, does not count where that one is found
    with more than half of what it has besides: a 3-clause text is no 2-clause one, whoever holds it. A license of several wordings has its best one. Null and empty texts have none; repeated rows are scanned alike; texts
    are scanned whole; an empty table gives no rows; other columns are left out, whatever their names.
    """

    def run(batches):
        m = Matcher(templates, least)
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < BLOCK_CHARS and i + 1 < len(texts):
                    continue
                part = texts[start : i + 1]
                found = m.match(*shingled(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)])))
                rows = [found.get(k, []) for k in range(len(part))]
                flat = [x for r in rows for x in r]
                pairs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.float64())], names=["license", "containment"])
                yield pa.RecordBatch.from_arrays([b.column(0)[start : i + 1], pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pairs)], names=[id_col, "licenses"])
                start, size = i + 1, 0

    pruned = docs.select(id_col, text_col)
    return pruned.mapInArrow(run, f"`{id_col}` {pruned.schema[0].dataType.simpleString()}, licenses array<struct<license:string,containment:double>>")
