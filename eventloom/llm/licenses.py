"""License scans: fuzzy search for short notices.

A notice of n characters may have up to k edits. Cut into k + 1 parts, at least one part occurs unchanged (pigeonhole), so an Aho-Corasick
pass over the parts of all notices finds every place where a match can be. Of these a bit-parallel edit distance leaves out the ones without a
match (most: parts like "under the" are common to many notices). There the regex library's bounded-error matching ``(?:notice){e<=k}`` verifies the
edits and gives the span.

Defined cases: case is ignored; a null or empty text has no notice; texts are searched whole; offsets are characters from 0, the end
excluded; of overlapping spans the one with the fewest edits for its length stays (then the longest, the earliest, the first by name);
repeated rows give their spans each; a null id is reported as null; ids may be
whole numbers or texts; further columns play no part.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import apart, arrow_batches, narrow

#: Short notices by license, in lower case.
NOTICES = {
    "Apache-2.0": "licensed under the apache license, version 2.0",
    "MIT": "released under the mit license",
    "MIT-text": "permission is hereby granted, free of charge, to any person obtaining a copy",
    "GPL-3.0": "licensed under the gnu general public license, version 3",
    "GPL-2.0": "licensed under the gnu general public license, version 2",
    "LGPL": "licensed under the gnu lesser general public license",
    "AGPL-3.0": "licensed under the gnu affero general public license",
    "MPL-2.0": "subject to the terms of the mozilla public license, v. 2.0",
    "BSD": "redistribution and use in source and binary forms, with or without modification",
    "ISC": "permission to use, copy, modify, and/or distribute this software for any purpose",
    "CC-BY-4.0": "licensed under a creative commons attribution 4.0 international license",
    "CC-BY-SA-4.0": "licensed under a creative commons attribution-sharealike 4.0 international license",
    "Unlicense": "this is free and unencumbered software released into the public domain",
    "Proprietary": "unauthorized copying of this file, via any medium, is strictly prohibited",
}


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, part) of ``edits`` + 1 parts that make up the notice."""
    n, parts = len(notice), edits + 1
    ends = [n * k // parts for k in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(ends, ends[1:])]


class Nearest:
    """Whether some part of a text is within ``most`` edits of a pattern: the columns of the distance matrix as bits of two numbers (Myers, 1999)."""

    def __init__(self, pattern: str, most: int):
        self.size, self.most, self.bits = len(pattern), most, {}
        for k, c in enumerate(pattern):
            self.bits[c] = self.bits.get(c, 0) | 1 << k

    def __call__(self, text: str, begin: int, end: int) -> bool:
        full, top, score, most, bits = (1 << self.size) - 1, 1 << self.size - 1, self.size, self.most, self.bits
        up, down = full, 0
        for c in text[begin:end]:
            same = bits.get(c, 0)
            turn = same | down
            across = (((same & up) + up) ^ up) | same
            more, less = down | (full & ~(across | up)), up & across
            if more & top:
                score += 1
            elif less & top:
                score -= 1
                if score <= most:
                    return True
            more, less = more << 1 & full, less << 1 & full
            up, down = less | (full & ~(turn | more)), more & turn
        return False


class Finder:
    def __init__(self, notices: dict[str, str], share: float = 0.1):
        self.edits = {name: max(1, int(len(text) * share)) for name, text in notices.items()}
        self.notices = notices
        self.patterns = {name: regex.compile(f"(?b)(?:{regex.escape(text, special_only=True)}){{e<={self.edits[name]}}}") for name, text in notices.items()}
        self.near = {name: Nearest(text, self.edits[name]) for name, text in notices.items()}
        at: dict[str, list[tuple[str, int]]] = {}
        for name, text in notices.items():
            for offset, part in seeds(text, self.edits[name]):
                at.setdefault(part, []).append((name, offset))
        self.machine = ahocorasick.Automaton()
        for part, where in at.items():
            self.machine.add_word(part, (len(part), where))
        self.machine.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int, int]]:
        """(license, begin, end, edits) in order of begin."""
        lower = text.lower()
        if len(lower) != len(text):  # a character whose lower case is two: offsets must stay
            lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        windows: dict[str, list[list[int]]] = {}
        for last, (length, where) in self.machine.iter(lower):
            begin = last - length + 1
            for name, offset in where:
                k, n = self.edits[name], len(self.notices[name])
                low, high = max(0, begin - offset - k), begin - offset + n + k
                run = windows.setdefault(name, [])
                if run and low <= run[-1][1]:
                    run[-1] = [min(low, run[-1][0]), max(high, run[-1][1])]
                else:
                    run.append([low, high])
        found = []
        for name, runs in windows.items():
            for low, high in runs:
                parts = [(low, min(high, len(lower)))]
                while parts:  # a match is the one of fewest edits: others can be on either side
                    a, b = parts.pop()
                    if b - a >= len(self.notices[name]) - self.edits[name] and self.near[name](lower, a, b) and (m := self.patterns[name].search(lower, a, b)):
                        found.append((name, m.start(), m.end(), sum(m.fuzzy_counts)))
                        parts += [(a, m.start()), (m.end(), b)]
        return apart(sorted(found, key=lambda f: (f[3] / len(self.notices[f[0]]), f[1] - f[2], f[1], f[0])))


@lru_cache(maxsize=4)
def finder(share: float = 0.1) -> Finder:
    """One finder a worker process."""
    return Finder(NOTICES, share)


SPANS = "array<struct<license:string,begin:int,end:int,edits:int>>"
ARROW_SPANS = pa.list_(pa.struct([("license", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))


def scan(docs: DataFrame, share: float = 0.1) -> DataFrame:
    """(doc_id, license, begin, end, edits): a row for each notice with at most ``share`` of its length in edits."""
    arrow_batches(docs.sparkSession)

    @F.arrow_udf(SPANS)
    def search(column: pa.Array) -> pa.Array:
        f, out = finder(share), []
        for item in column:
            text = item.as_py()
            out.append([{"license": n, "begin": b, "end": e, "edits": k} for n, b, e, k in f.spans(text)] if text else [])
        return pa.array(out, ARROW_SPANS)

    return narrow(docs).select(F.col("_k").alias("doc_id"), F.explode(search("_t")).alias("s")).select("doc_id", "s.license", "s.begin", "s.end", "s.edits")
