"""License scans: ordered signature rules behind a keyword prefilter.

A text is folded to its words (A-Z lower-cased; runs of digits, a-z and non-ASCII
characters) joined by single blanks, so a rule is a plain regex over words. Rules are the hand-written
``SENTENCES`` that license texts and notices are known by, and for the names and versions of ``FAMILIES`` the ways of naming them, several hundred in all, each
with a label, a priority and a keyword, a literal part of all that it matches. Only rules whose
keyword (and another literal, where there is one) occurs in a text, inside a word too (gplv3), are run; one pass of an Aho-Corasick automaton finds these. A name that is also an ordinary word or a product counts with a version only if
``license``, ``version`` or ``v`` stands between them. Detections are then resolved: one that lies inside
another of higher or equal priority is suppressed (equal intervals: the first label
stays). The base phrases are found apart from that and always stay. The work grows with the length of a text and its matches.

Defined results. Null or empty text: no words, no labels, score 0. Repeated rows give
repeated rows; a null doc_id is carried through. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as tv

# The base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# License families as (label, names as word patterns, versions or none).
FAMILIES = [
    ("mit", ["mit", "expat", "x11"], []),
    ("apache", ["apache", "apache software", "asl"], ["1 0", "1 1", "2 0", "2"]),
    ("gpl", ["gnu general public", "general public", "gnu gpl", "gpl"], ["1", "2", "3", "2 0", "3 0"]),
    ("lgpl", ["gnu lesser general public", "gnu library general public", "gnu lgpl", "lgpl"], ["2", "2 1", "3", "3 0"]),
    ("agpl", ["gnu affero general public", "affero general public", "gnu agpl", "agpl"], ["1", "3", "3 0"]),
    ("gfdl", ["gnu free documentation", "gfdl"], ["1 1", "1 2", "1 3"]),
    ("bsd", ["bsd", "berkeley software distribution"], ["2 clause", "3 clause", "4 clause", "0 clause"]),
    ("mpl", ["mozilla public", "mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public", "epl"], ["1 0", "2 0"]),
    ("cddl", ["common development and distribution", "cddl"], ["1 0", "1 1"]),
    ("eupl", ["european union public", "eupl"], ["1 0", "1 1", "1 2"]),
    ("artistic", ["artistic", "perl artistic"], ["1 0", "2 0"]),
    ("isc", ["isc", "internet systems consortium"], []),
    ("zlib", ["zlib", "zlib libpng"], []),
    ("boost", ["boost software", "bsl"], ["1 0"]),
    ("unlicense", ["unlicense"], []),
    ("wtfpl", ["do what the fuck you want to public", "wtfpl"], ["1", "2"]),
    ("ofl", ["sil open font", "ofl"], ["1 0", "1 1"]),
    ("psf", ["python software foundation", "psf"], ["2"]),
    ("postgresql", ["postgresql"], []),
    ("openssl", ["openssl"], []),
    ("ncsa", ["university of illinois ncsa", "ncsa"], []),
    ("afl", ["academic free", "afl"], ["2 1", "3 0"]),
    ("osl", ["open software", "osl"], ["2 1", "3 0"]),
    ("ms-pl", ["microsoft public", "ms pl"], []),
    ("ms-rl", ["microsoft reciprocal", "ms rl"], []),
    ("cpl", ["common public", "cpl"], ["1 0"]),
    ("upl", ["universal permissive", "upl"], ["1 0"]),
    ("odbl", ["open database", "odbl"], ["1 0"]),
    ("odc-by", ["open data commons attribution", "odc by"], ["1 0"]),
    ("pddl", ["public domain dedication and license", "pddl"], ["1 0"]),
    ("cecill", ["cecill"], ["1 0", "2 0", "2 1"]),
    ("json", ["json"], []),
    ("vim", ["vim"], []),
    ("php", ["php"], ["3 0", "3 01"]),
    ("ruby", ["ruby"], []),
    ("bsl", ["business source"], ["1 1"]),
    ("sspl", ["server side public", "sspl"], ["1"]),
    ("elastic", ["elastic"], ["2", "2 0"]),
]
#: Families whose names are ordinary words or products too.
ORDINARY = {"apache", "artistic", "php", "ruby", "json", "vim", "elastic", "postgresql", "openssl", "zlib", "x11", "expat", "perl artistic", "zlib libpng", "isc", "bsd", "berkeley software distribution", "open software", "open database", "asl", "psf", "upl", "afl", "osl", "bsl"}
# Creative Commons elements in their usual order.
CREATIVE_COMMONS = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv\\w*", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv\\w*"}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
# Sentences by which a text grants, names or refuses a license without naming a family.
SENTENCES = [
    # permissive grants and their conditions
    ("mit", 60, "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 58, "merge", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", 58, "substantial", r"shall be included in all copies or substantial portions of the software"),
    ("mit", 56, "restriction", r"to deal in the software without restriction"),
    ("mit", 56, "dealings", r"or the use or other dealings in the software"),
    ("mit-0", 59, "permit", r"and to permit persons to whom the software is furnished to do so the software is provided"),
    ("isc", 60, "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", 58, "hereby", r"with or without fee is hereby granted"),
    ("hpnd", 57, "permission", r"permission to use copy modify and distribute this software and its documentation"),
    ("ntp", 56, "suitability", r"makes no representations about the suitability (?:of )?this software for any purpose"),
    ("bsd", 60, "redistribution", r"redistributions? and use in source and binary forms with or without modification"),
    ("bsd", 60, "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 60, "binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 62, "endorse", r"may (?:not )?be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 63, "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("zlib", 60, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 58, "plainly", r"altered source versions must be plainly marked as such"),
    ("zlib", 58, "implied", r"provided as is without any express or implied warranty in no event will the authors"),
    ("boost", 60, "accompanying", r"obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", 58, "executable", r"machine executable object code generated by a source language processor"),
    ("apache-2", 60, "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2", 58, "limitations", r"for the specific language governing permissions and limitations under the license"),
    ("apache-2", 58, "perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2", 55, "basis", r"distributed under the license is distributed on an as is basis"),
    ("apache", 57, "developed", r"this product includes software developed by the apache software foundation"),
    ("openssl", 57, "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", 57, "cryptographic", r"this product includes cryptographic software written by"),
    ("ncsa", 57, "urbana", r"neither the names? of .{0,60}university of illinois at urbana champaign"),
    ("psf", 58, "psf", r"psf hereby grants licensee a non ?exclusive royalty free world wide license"),
    ("php", 58, "php", r"products derived from this software may not be called php"),
    ("python-cnri", 57, "cnri", r"cnri hereby grants licensee"),
    ("beerware", 58, "beer", r"you can buy me a beer in return"),
    ("wtfpl", 60, "fuck", r"you just do what the fuck you want to"),
    ("unlicense", 60, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 58, "anyone", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", 57, "unlicense", r"for more information please refer to https? unlicense org"),
    ("0bsd", 57, "0bsd", r"0bsd"),
    ("cc0", 55, "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", 58, "irrevocably", r"overtly fully permanently irrevocably and unconditionally waives?"),
    ("cc0", 58, "dedicated", r"has dedicated the work to the public domain"),
    ("public-domain", 50, "domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("public-domain", 50, "domain", r"public domain (?:dedication|mark|work)"),
    ("public-domain", 48, "copyright", r"no copyright is claimed"),
    ("public-domain", 48, "disclaims", r"the author hereby disclaims copyright to this source code"),
    ("public-domain", 47, "government", r"(?:this|a) work of the united states government"),
    # copyleft notices
    ("gpl", 61, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 57, "general public", r"see the gnu general public license for more details"),
    ("gpl", 57, "received", r"you should have received a copy of the gnu general public license"),
    ("gpl", 56, "later", r"either version (?:2|3) of the license or at your option any later version"),
    ("gpl-2", 62, "option", r"version 2 of the license or at your option any later version"),
    ("gpl-3", 62, "option", r"version 3 of the license or at your option any later version"),
    ("gpl", 58, "copyleft", r"the gnu general public license is a free copyleft license"),
    ("gpl", 57, "freedom", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom"),
    ("lgpl", 61, "lesser", r"under the terms of the gnu lesser general public license"),
    ("lgpl", 57, "lesser", r"see the gnu lesser general public license for more details"),
    ("lgpl", 61, "library", r"under the terms of the gnu library general public license"),
    ("agpl", 61, "affero", r"under the terms of the gnu affero general public license"),
    ("agpl", 58, "interacting", r"all users interacting with it remotely through a computer network"),
    ("gpl-classpath", 63, "linking", r"linking this library statically or dynamically with other modules"),
    ("gpl-exception", 55, "exception", r"as a special exception (?:to the gnu general public license )?(?:\w+ ){0,12}(?:permission|permitted|distribute|link)"),
    ("gfdl", 61, "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", 60, "documentation", r"under the terms of the gnu free documentation license"),
    ("mpl-2", 61, "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", 58, "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", 60, "contents", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("npl", 60, "netscape", r"the contents of this file are subject to the netscape public license"),
    ("epl", 60, "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", 57, "eclipse", r"eclipse public license (?:v|version)"),
    ("cpl", 60, "common public", r"made available under the terms of the common public license"),
    ("cddl", 60, "common development", r"subject to the terms of the common development and distribution license"),
    ("eupl", 60, "eupl", r"licensed under the eupl"),
    ("osl", 60, "open software", r"licensed under the open software license version"),
    ("artistic", 60, "artistic", r"the copyright holder permits the user to distribute .{0,80}under the terms of the artistic license"),
    ("artistic", 58, "perl", r"under the same terms as perl itself"),
    ("ruby", 58, "ruby", r"you can redistribute it and or modify it under (?:either )?the (?:same )?terms (?:of|as) (?:the )?ruby"),
    ("cecill", 60, "cecill", r"this software is governed by the cecill"),
    ("ofl", 60, "font", r"this font software is licensed under the sil open font license"),
    ("ofl", 58, "fonts", r"the ofl allows the licensed fonts to be used studied modified and redistributed freely"),
    ("ms-pl", 59, "accompanying", r"this license governs use of the accompanying software if you use the software you accept this license"),
    # content and data
    ("cc", 20, "creative", r"(?:under|by) an? creative commons (?:\w+ ){0,6}licen[sc]e"),
    ("cc", 30, "commons", r"some rights reserved (?:under )?creative commons"),
    ("cc-by", 40, "appropriate", r"you must give appropriate credit provide a link to the license"),
    ("cc-by-sa", 41, "remix", r"if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nc", 41, "commercial", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", 41, "modified", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", 45, "attribution", r"text is available under the creative commons attribution share ?alike"),
    ("odbl", 58, "database", r"made available under the open database license"),
    ("odbl", 58, "individual", r"any rights in individual contents of the database are licensed under"),
    ("odc-by", 58, "commons", r"made available under the open data commons attribution license"),
    ("pddl", 58, "dedication", r"made available under the public domain dedication and license"),
    ("ogl-uk", 58, "government", r"(?:contains public sector information )?licensed under the open government licen[sc]e"),
    ("etalab", 57, "ouverte", r"licence ouverte(?: open licence)?(?: etalab)?"),
    ("cdla", 58, "community", r"community data license agreement(?: permissive| sharing)?"),
    ("openrail", 58, "rail", r"(?:bigscience |creativeml )?open ?rail(?: m| s| d)?(?: licen[sc]e)?"),
    ("llama", 58, "llama", r"llama (?:2 |3 )?community licen[sc]e(?: agreement)?"),
    # source-available and restricted
    ("sspl", 60, "service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("bsl", 60, "change", r"change date .{0,80}change license"),
    ("bsl", 58, "production", r"non production use of the licensed work"),
    ("elastic", 60, "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 60, "clause", r"commons clause license condition"),
    ("commons-clause", 58, "sell", r"the license does not grant to you the right to sell the software"),
    ("polyform", 59, "polyform", r"polyform (?:noncommercial|small business|shield|strict|internal use)"),
    ("json", 58, "evil", r"the software shall be used for good not evil"),
    ("noncommercial", 35, "commercial", r"(?:for|only) non ?commercial (?:use|purposes)"),
    ("noncommercial", 35, "commercial", r"commercial use (?:of this \w+ )?is (?:strictly )?(?:prohibited|forbidden|not permitted|not allowed)"),
    ("academic", 35, "academic", r"for academic(?: and \w+)? (?:use|purposes) only"),
    ("academic", 35, "research", r"for research(?: and \w+)? (?:use|purposes) only"),
    ("academic", 35, "educational", r"for educational(?: and \w+)? (?:use|purposes) only"),
    ("personal", 34, "personal", r"for (?:your )?personal (?:non ?commercial )?use only"),
    ("evaluation", 35, "evaluation", r"for evaluation (?:use|purposes) only"),
    # reservations
    ("proprietary", 40, "reserved", r"all rights reserved"),
    ("proprietary", 40, "droits", r"tous droits réservés"),
    ("proprietary", 40, "vorbehalten", r"alle rechte vorbehalten"),
    ("proprietary", 40, "derechos", r"todos los derechos reservados"),
    ("proprietary", 40, "confidential", r"(?:strictly )?confidential and proprietary"),
    ("proprietary", 42, "proprietary", r"proprietary (?:and confidential )?(?:information|software|material) of"),
    ("proprietary", 45, "reproduced", r"(?:no part of this|may not be) (?:\w+ ){0,6}reproduced"),
    ("proprietary", 45, "permission", r"without (?:the )?(?:prior |express )*(?:written )?permission of (?:the )?(?:author|owner|publisher|copyright)"),
    ("proprietary", 45, "consent", r"without (?:the )?(?:prior |express )*(?:written )?consent of (?:the )?(?:author|owner|publisher|copyright)"),
    ("proprietary", 44, "unauthorized", r"unauthorized (?:copying|reproduction|use|distribution)(?: or \w+)? (?:of this \w+ )?(?:is )?(?:strictly )?prohibited"),
    ("proprietary", 43, "licensed", r"(?:is )?licensed not sold"),
    ("proprietary", 44, "reverse", r"(?:may|shall) not (?:\w+ ){0,6}reverse engineer"),
    ("eula", 50, "agreement", r"end user licen[sc]e agreement"),
    ("eula", 48, "agree", r"by (?:downloading|installing|copying|using)(?: or (?:downloading|installing|copying|using))? (?:the|this) (?:software|product) you agree"),
    ("eula", 48, "accept", r"by (?:downloading|installing|copying|using)(?: or (?:downloading|installing|copying|using))? (?:the|this) (?:software|product) you accept"),
    ("trademark", 15, "trademark", r"(?:are|is) (?:a )?(?:registered )?trademarks? of"),
    ("copyright", 10, "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
    ("copyright", 10, "copyright", r"copyrighted by (?:the )?\w+"),
    ("disclaimer", 12, "warrant", r"without (?:warranty|warranties)(?: or conditions)? of any kind"),
    ("disclaimer", 12, "merchantability", r"implied warranty of merchantability or fitness for a particular purpose"),
    ("spdx", 30, "spdx", r"spdx licen[sc]e identifier \w+"),
    ("unknown", 8, "license", r"see (?:the )?license(?: file| txt| md)? for (?:details|more information|license details)"),
    ("unknown", 8, "license", r"released under (?:the terms of )?(?:an? |the )?open source license"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    also: str  # another literal part, or nothing
    pattern: re.Pattern


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first; a rule's pattern is anchored on word limits."""
    out: list[Rule] = []

    def add(label: str, priority: int, keyword: str, pattern: str, also: str = "") -> None:
        out.append(Rule(label, priority, keyword, also, re.compile(rf"(?<![^ ]){pattern}(?![^ ])".encode())))

    for label, names, versions in FAMILIES:
        for name in names:
            key = max(name.split(), key=len)
            for v in versions:
                tag = f"{label}-{v.replace(' clause', '-clause').replace(' ', '.').removesuffix('.0')}"
                between = r"(?: public)?(?: software| project)?(?: licen[sc]es?(?: version)?| version)(?: v)? ?v?|(?: public)? v ?" if name in ORDINARY else r"(?: public)?(?: licen[sc]es?)?(?: version| v)? ?v?"
                add(tag, 90, key, rf"{name}(?:{between}){v}", v)
                add(tag, 95, key, rf"spdx licen[sc]e identifier {name} {v}(?: only| or later)?", "spdx")
            add(label, 80, key, rf"under (?:the )?(?:terms of )?(?:the )?{name}(?: style)? licen[sc]e", "licen")
            add(label, 75, key, rf"spdx licen[sc]e identifier {name}", "spdx")
            add(label, 70, key, rf"(?:the )?{name} licen[sc]e[ds]?", "licen")
            add(label, 65, key, rf"licen[sc]ed? (?:as |is )?(?:under |by )?(?:the )?{name}", "licen")
    for short, long in CREATIVE_COMMONS.items():
        tag = "cc-" + short.replace(" ", "-")
        for v in CC_VERSIONS:
            add(f"{tag}-{v.replace(' ', '.')}", 92, "cc by", rf"cc {short} {v}", v)
            add(f"{tag}-{v.replace(' ', '.')}", 91, "creative", rf"creative commons {long} {v}", v)
        add(tag, 72, "cc by", rf"cc {short}")
        add(tag, 71, "creative", rf"creative commons {long}")
        add(tag, 73, "creativecommons", rf"creativecommons org licenses {short}")
    for label, priority, keyword, pattern in SENTENCES:
        add(label, priority, keyword, pattern)
    return tuple(sorted(out, key=lambda r: -r.priority))


_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = [(p.encode(), label) for p, label in BASE_PHRASES.items()]


def fold(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(_FOLD).split()


@lru_cache(maxsize=1)
def _gates() -> tuple[ahocorasick.Automaton, dict[str, list[Rule]]]:
    """An automaton that finds the literals of all rules and the base phrases, and the rules of each keyword."""
    by: dict[str, list[Rule]] = {}
    for r in rules():
        by.setdefault(r.keyword, []).append(r)
    signs = ahocorasick.Automaton()
    for k in {*by, *(r.also for r in rules() if r.also), *BASE_PHRASES}:
        signs.add_word(k.encode().decode("latin-1"), k)
    signs.make_automaton()
    return signs, by


def literals(folded: bytes) -> set[str]:
    """Which literals a text holds, found in one pass."""
    return {k for _, k in _gates()[0].iter(folded.decode("latin-1"))}


def detect(folded: bytes, held: set[str] | None = None) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) of the detections that no other contains, by start."""
    held = literals(folded) if held is None else held
    levels: dict[int, list[tuple[int, int, str]]] = {}
    by = _gates()[1]
    for k in held & by.keys():
        for r in by[k]:
            if not r.also or r.also in held:
                for m in r.pattern.finditer(folded):
                    levels.setdefault(r.priority, []).append((m.start(), -m.end(), r.label))
    kept: list[tuple[int, int, str, int]] = []
    starts: list[int] = []
    reach: list[int] = []  # the farthest end of the kept detections up to each start
    for priority in sorted(levels, reverse=True):
        far, fresh = -1, []
        for a, b, label in sorted(levels[priority]):
            k = bisect_right(starts, a)
            if -b > far and not (k and reach[k - 1] >= -b):
                fresh.append((a, -b, label, priority))
            far = max(far, -b)
        if fresh:
            kept = sorted(kept + fresh)
            starts, reach = [d[0] for d in kept], list(accumulate((d[1] for d in kept), max))
    return kept


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[int, int, str]]]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and detections (in words) of one text."""
    words = fold(text)
    n = len(words)
    folded = b" ".join(words)
    held = literals(folded)
    if not held:
        return n, 0, None, None, "", "", 0.0, []
    base: list[tuple[int, str]] = []
    for phrase, label in _BASE:
        at = folded.find(phrase) if phrase.decode() in held else -1
        while at >= 0:
            end = at + len(phrase)
            if (at == 0 or folded[at - 1] == 32) and (end == len(folded) or folded[end] == 32):
                base.append((at, label))
            at = folded.find(phrase, at + 1)
    found = detect(folded, held)
    blanks = np.flatnonzero(np.frombuffer(folded, np.uint8) == 32) if base or found else None
    word = lambda places: np.searchsorted(blanks, places).tolist()
    places = word([a for a, _ in base]) if base else []
    labels = {label for _, label in base}
    every = labels | {d[2] for d in found}
    score = max([1.0 * bool(base), *(d[3] / 100 for d in found)])
    spans = [(a, b + 1, d[2]) for a, b, d in zip(word([d[0] for d in found]), word([d[1] for d in found]), found, strict=True)] if found else []
    return n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, spans


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first:int,end:int,label:string>>"


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, word count, base places and labels, all labels, score and resolved detections (word spans)."""

    def run(batches):
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        spans = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            offs, data = tv.buffers(batch.column(1))
            view = memoryview(data)
            rows = [scan(bytes(view[offs[i] : offs[i + 1]])) for i in range(batch.num_rows)]
            columns = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)]
            found = pa.array([[{"first": a, "end": b, "label": x} for a, b, x in r[7]] for r in rows], type=spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, found], names=["doc_id", *names, "detections"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")
