"""License scans by ordered signature rules.

Rules are regexes over a text's words, joined by single spaces. A rule runs only if
one of its keywords stands in the text (an Aho-Corasick automaton finds them all in
one pass). Each place found is an interval of words with the rule's priority; an
interval that lies inside one of a higher priority, or of the same priority and longer,
is suppressed. Signatures of license bodies, headers, exceptions and notices are written
by hand in ``license_signatures`` and ``license_sentences``; names with versions come from families and phrase
templates here. Time goes with the length of a text and the number of its places.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import by_batches
from graphloom.llm.license_sentences import EXCEPTION_SENTENCES, SENTENCES
from graphloom.llm.license_signatures import BODIES, EXCEPTIONS, NAMES, NOTICES

#: Phrases whose every place counts, and their labels; fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Family: (label, keyword, names as regexes over words, versions); fixed values.
FAMILIES = {
    "apache": ("apache", ("apache license", "apache software license", "apache"), ("2 0", "1 1", "1 0")),
    "mit": ("license", ("mit license", "mit x11 license", "mit expat license"), ()),
    "bsd": ("bsd", ("bsd license", r"bsd [234] clause license", r"bsd [234] clause"), ("2", "3", "4")),
    "gpl": ("general public", ("gnu general public license", "general public license"), ("3 0", "3", "2 0", "2")),
    "agpl": ("affero", ("gnu affero general public license", "affero general public license"), ("3 0", "3", "1")),
    "lgpl": ("lesser", ("gnu lesser general public license", "lesser general public license"), ("3 0", "3", "2 1")),
    "mpl": ("mozilla", ("mozilla public license",), ("2 0", "1 1", "1 0")),
    "epl": ("eclipse", ("eclipse public license",), ("2 0", "1 0")),
    "artistic": ("artistic", ("artistic license", "perl artistic license"), ("2 0", "1 0")),
    "isc": ("license", ("isc license",), ()),
    "zlib": ("zlib", ("zlib license", "zlib libpng license"), ()),
    "unlicense": ("unlicense", ("the unlicense", "unlicense"), ()),
    "boost": ("boost", ("boost software license",), ("1 0",)),
    "ofl": ("font", ("sil open font license", "open font license"), ("1 1", "1 0")),
    "gfdl": ("documentation", ("gnu free documentation license", "free documentation license"), ("1 3", "1 2", "1 1")),
    "odbl": ("database", ("open database license",), ("1 0",)),
    "cc0": (("cc0", "commons zero"), ("cc0", "creative commons zero"), ("1 0",)),
    "public-domain": ("domain", ("public domain",), ()),
}
#: Short names that mean a license anywhere in a text: they are names of their family with keywords of their own.
SHORT = {"gpl": "gpl", "agpl": "agpl", "lgpl": "lgpl", "mpl": "mpl", "epl": "epl", "ofl": "ofl", "gfdl": "gfdl", "odbl": "odbl"}
#: SPDX ids that are ordinary words or mean other things too: they count behind an SPDX tag alone.
SPDX = {"mit": "mit", "isc": "isc", "zlib": "zlib", "artistic": "artistic", "boost": "bsl"}
#: Creative Commons elements, whose combinations make families of their own.
COMMONS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Phrases around a license's name, from the plainest to the most telling.
TEMPLATES = (
    "{name}",
    "(?:under|by|with) (?:the )?(?:terms of )?(?:the )?{name}",
    "(?:licensed|released|distributed|published|available|shared|provided) under (?:the )?(?:terms of )?(?:the )?{name}",
    "spdx license identifier {name}",
)
#: Bytes of words to themselves, A-Z to a-z, all other ASCII to spaces.
_TO_WORDS = bytes(i if i >= 128 or chr(i).isdigit() or chr(i).islower() else i + 32 if chr(i).isupper() else 32 for i in range(256))


class Rule(NamedTuple):
    label: str
    keywords: tuple[str, ...]
    pattern: str
    priority: int


class Found(NamedTuple):
    label: str
    start: int  # first word
    end: int  # past the last word
    priority: int


def rules() -> list[Rule]:
    """Every rule, the highest priority first."""
    named = [(k, (words,) if isinstance(words, str) else words, names, versions) for k, (words, names, versions) in FAMILIES.items()]
    named += [(f"cc-{x.replace(' ', '-')}", ("cc",), (f"cc {x}",), COMMONS_VERSIONS) for x in COMMONS]
    long = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?", "nc": "non ?commercial"}
    named += [(f"cc-{x.replace(' ', '-')}", ("commons",), ("creative commons " + " ".join(long[w] for w in x.split()),), COMMONS_VERSIONS) for x in COMMONS]
    named += [(k, (short, *sorted({f"{short}v{v.split()[0]}" for v in FAMILIES[k][2]})), (short,), FAMILIES[k][2]) for k, short in SHORT.items()]
    told = [(family, rank, template) for family, (rank, template) in product(named, enumerate(TEMPLATES))]
    told += [((k, ("spdx",), (short,), FAMILIES[k][2]), len(TEMPLATES) - 1, TEMPLATES[-1]) for k, short in SPDX.items()]
    out = []
    for (label, words, names, versions), rank, template in told:
        name = "(?:" + "|".join(sorted(names, key=len, reverse=True)) + ")"
        out.append(Rule(label, words, template.format(name=name), 10 * rank))
        gap = "(?: v?|v)" if names[0] in SHORT.values() else " v?"
        for v in versions:
            full = template.format(name=f"{name}(?: license)?(?: version| v)?{gap}{v}(?: only| or later)?")
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", words, full, 10 * rank + 5))
    for rows, priority in ((BODIES, 40), (EXCEPTIONS, 27), (NAMES, 12), (NOTICES, 1)):
        out += [Rule(label, (words,) if isinstance(words, str) else words, pattern, priority) for label, words, pattern, _ in rows]
    for rows, priority in ((SENTENCES, 40), (EXCEPTION_SENTENCES, 27)):
        out += [Rule(label, (words,), _normal(sentence).strip(), priority) for label, words, sentence in rows]
    return sorted(out, key=lambda r: (-r.priority, r.label, r.pattern))


class Pattern:
    """A rule's regex; its parts around ``…`` are found apart and paired by place, so that any words may stand between."""

    def __init__(self, pattern: str):
        self._parts = [re.compile(rf" (?:{x.strip()})(?= )" if "|" in x else rf" {x.strip()}(?= )") for x in pattern.split("…")]

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of every place. The head of a pair is the last one before a tail, and pairs with its first tail."""
        first, *others = ([m.span() for m in p.finditer(text)] for p in self._parts)
        for tails in others:
            ends, paired, used = [e for _, e in first], [], -1
            for start, end in tails:
                at = bisect.bisect_right(ends, start) - 1
                if at > used:
                    paired.append((first[at][0], end))
                    used = at
            first = paired
        yield from first


@functools.cache
def _compiled() -> tuple[ahocorasick.Automaton, list[tuple[Rule, Pattern]]]:
    """The keyword automaton, which gives the numbers of the rules a keyword opens."""
    numbered = [(r, Pattern(r.pattern)) for r in rules()]
    opens: dict[str, list[int]] = {}
    for i, (r, _) in enumerate(numbered):
        for word in r.keywords:
            opens.setdefault(word, []).append(i)
    automaton = ahocorasick.Automaton()
    for word, which in opens.items():
        automaton.add_word(f" {word} ", tuple(which))
    automaton.make_automaton()
    return automaton, numbered


def suppressed(found: list[Found]) -> list[Found]:
    """Without the intervals that a stronger one contains; in order of place.

    Stronger is a higher priority, then a longer interval, then the smaller label; of
    equal places one stays.
    """
    if not found:
        return []
    rows = sorted(found, key=lambda f: (-f.priority, f.start, -f.end, f.label))
    priority, start, end = (np.array([getattr(f, k) for f in rows], dtype=np.int64) for k in ("priority", "start", "end"))
    keep = np.ones(len(rows), dtype=bool)
    starts = ends = np.empty(0, dtype=np.int64)  # of what is kept of higher priorities, by start
    for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(priority)) + 1):
        # In order of start, an interval is inside another if one before it ends no sooner.
        before = np.maximum.accumulate(np.concatenate(([-1], end[at][:-1])))
        higher = np.searchsorted(starts, start[at], side="right")
        reach = np.concatenate(([-1], np.maximum.accumulate(ends))) if len(ends) else np.array([-1])
        keep[at] = (before < end[at]) & (reach[higher] < end[at])
        left = at[keep[at]]
        order = np.argsort(np.concatenate([starts, start[left]]), kind="stable")
        starts, ends = np.concatenate([starts, start[left]])[order], np.concatenate([ends, end[left]])[order]
    return sorted((f for f, k in zip(rows, keep.tolist(), strict=True) if k), key=lambda f: (f.start, f.end, f.label))


def _normal(text: str) -> str:
    """The words, each between spaces."""
    return f" {b' '.join(text.encode().translate(_TO_WORDS).split()).decode()} "


def detect(normal: str) -> list[Found]:
    """What the rules find in a normalised text."""
    automaton, numbered = _compiled()
    which = {i for _, hit in automaton.iter(normal) for i in hit}
    spans = [(numbered[i][0], *span) for i in sorted(which) for span in numbered[i][1].spans(normal)]
    if not spans:
        return []
    spaces = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), dtype="<u4") == 32)
    first, past = (np.searchsorted(spaces, [s[k] for s in spans]).tolist() for k in (1, 2))
    return suppressed([Found(rule.label, a, z, rule.priority) for (rule, *_), a, z in zip(spans, first, past, strict=True)])


def _places(normal: str, phrase: str) -> list[int]:
    """First words of every place of a phrase, overlapping ones too."""
    out, at, word, seen = [], normal.find(f" {phrase} "), 0, 0
    while at >= 0:
        word, seen = word + normal.count(" ", seen, at), at
        out.append(word)
        at = normal.find(f" {phrase} ", at + 1)
    return out


def _score(n_base: int, found: list[Found]) -> float:
    """How sure it is that the text states a license: 1 for an explicit grant."""
    best = max((0.5 + min(f.priority, 30) / 60 for f in found), default=0.0)
    return max(best, 0.5 if n_base else 0.0)


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base_starts, base_labels, found, labels, score) for each row.

    ``base_starts`` has the first word of every place of a base phrase, ``found`` the
    detections left after suppression. Labels are distinct and sorted. A null text is an
    empty one: no words, nothing found, score 0. Texts of any length are scanned whole.
    Repeated rows come out repeated, an empty table gives an empty result; other columns
    are not used.
    """

    def scan(text: str | None) -> tuple:
        normal = _normal(text or "")
        n = normal.count(" ") - 1 if len(normal) > 2 else 0
        starts, base = [], set()
        for phrase, label in BASE.items():
            if at := _places(normal, phrase):
                starts += at
                base.add(label)
        found = detect(normal) if n else []
        labels = sorted(base | {f.label for f in found})
        return n, sorted(starts), sorted(base), [f._asdict() for f in found], labels, _score(len(starts), found)

    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32())])
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(place), pa.list_(pa.string()), pa.float64()]
    names = ["doc_id", "n_words", "base_starts", "base_labels", "found", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    detail = "array<struct<label:string,start:bigint,end:bigint,priority:int>>"
    schema = f"doc_id {kind}, n_words bigint, base_starts array<bigint>, base_labels array<string>, found {detail}, labels array<string>, score double"
    return by_batches(docs.select("doc_id", "text"), run, schema)
