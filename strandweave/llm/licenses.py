"""License scans: ordered signature rules, gated by keywords, with priority and interval-containment suppression.

Rules are the hand-written signatures of license texts and notices in ``signatures``, and the statement forms (SPDX tag, "licensed
under", file header, URL, name) of a table of licenses' own patterns, in priority order; SPDX expressions are split into their
operands. A text is searched for the keywords first, and only rules of keywords that it has run. Of the detections, one that lies inside another of a
higher priority (or of the same priority and longer) is suppressed: one sweep over an ordered set of intervals. The base phrases
are counted by their words and are never suppressed.

One pass over whole texts without a shuffle.

Defined cases: null text has no words; repeated rows give repeated results; empty tables give no rows; other columns are
ignored; of detections over one interval with one priority the longer label stays, then the first in order; a long text is
searched whole, in time that grows with its length and n log n of its detections.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, flat, map_arrow, steps, word_spans
from .signatures import SIGNATURES

#: Base phrases and labels, as the contract fixes them.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, SPDX id pattern, name pattern, URL pattern (or none), keywords: every form of it holds all
#: the literals (joined by &) of one of them, once white space is collapsed.
LICENSES = [
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu general public licen[sc]e,? (?:version|v)\.? ?2|\b(?:gnu )?gpl,? ?(?:version|v)\.? ?2(?!\.[1-9])", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", "gpl|gnu general"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu general public licen[sc]e,? (?:version|v)\.? ?3|\b(?:gnu )?gpl,? ?(?:version|v)\.? ?3(?!\.[1-9])", r"gnu\.org/licenses/gpl-3\.0", "gpl|gnu general"),
    ("gpl", r"gpl", r"gnu general public licen[sc]e|\bgnu gpl\b", r"gnu\.org/licenses/gpl(?![-.0-9])", "gpl|gnu general"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu lesser general public licen[sc]e,? (?:version|v)\.? ?2\.1|\b(?:gnu )?lgpl,? ?(?:version|v)\.? ?2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", "lgpl|lesser general"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu lesser general public licen[sc]e,? (?:version|v)\.? ?3|\b(?:gnu )?lgpl,? ?(?:version|v)\.? ?3", r"gnu\.org/licenses/lgpl-3\.0", "lgpl|lesser general"),
    ("lgpl", r"lgpl", r"gnu (?:lesser|library) general public licen[sc]e", r"gnu\.org/licenses/lgpl(?![-.0-9])", "lgpl|lesser general|library general"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?affero general public licen[sc]e", r"gnu\.org/licenses/agpl", "agpl|affero"),
    ("gfdl", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu free documentation licen[sc]e", r"gnu\.org/licenses/fdl", "gfdl|free documentation|licenses/fdl"),
    ("apache-2.0", r"apache-2\.0", r"apache licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?", r"apache\.org/licenses/license-2\.0", "apache"),
    ("apache-1.1", r"apache-1\.1", r"apache software licen[sc]e,? (?:version |v\.? ?)?1\.1", r"apache\.org/licenses/license-1\.1", "apache"),
    ("apache", r"apache", r"apache (?:software )?licen[sc]e", r"apache\.org/licenses/?(?!license)", "apache"),
    ("mit", r"mit", r"\bmit[- ]licen[sc]e|\bexpat licen[sc]e", r"opensource\.org/licenses/mit", "mit&licen|mit&under|expat lic"),
    ("mit-0", r"mit-0", r"\bmit no attribution", r"opensource\.org/licenses/mit-0", "mit no attr|mit-0"),
    ("bsd-2-clause", r"bsd-2-clause", r"(?:2|two)[- ]clause bsd licen[sc]e|bsd[- ](?:2|two)[- ]clause licen[sc]e|simplified bsd licen[sc]e|freebsd licen[sc]e", r"opensource\.org/licenses/bsd-2-clause", "bsd"),
    ("bsd-3-clause", r"bsd-3-clause", r"(?:3|three)[- ]clause bsd licen[sc]e|bsd[- ](?:3|three)[- ]clause licen[sc]e|(?:new|modified|revised) bsd licen[sc]e", r"opensource\.org/licenses/bsd-3-clause", "bsd"),
    ("bsd-4-clause", r"bsd-4-clause", r"(?:4|four)[- ]clause bsd licen[sc]e|bsd[- ](?:4|four)[- ]clause licen[sc]e|original bsd licen[sc]e", r"spdx\.org/licenses/bsd-4-clause", "bsd"),
    ("0bsd", r"0bsd", r"zero[- ]clause bsd|bsd zero clause", r"opensource\.org/licenses/0bsd", "bsd"),
    ("bsd", r"bsd", r"\bbsd licen[sc]e", r"opensource\.org/licenses/bsd-license", "bsd"),
    ("isc", r"isc", r"\bisc licen[sc]e", r"opensource\.org/licenses/isc", "isc&licen|isc&under"),
    ("mpl-1.1", r"mpl-1\.1", r"mozilla public licen[sc]e,? (?:version |v\.? ?)?1\.1", r"mozilla\.org/mpl/1\.1|mozilla\.org/mpl/mpl-1\.1", "mozilla|mpl"),
    ("mpl-2.0", r"mpl-2\.0", r"mozilla public licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?", r"mozilla\.org/(?:en-us/)?mpl/2\.0", "mozilla|mpl"),
    ("mpl", r"mpl", r"mozilla public licen[sc]e", r"mozilla\.org/mpl/?(?![0-9m])", "mozilla|mpl"),
    ("epl-1.0", r"epl-1\.0", r"eclipse public licen[sc]e,? (?:- ?)?(?:version |v ?)?1\.0", r"eclipse\.org/legal/epl-v10", "eclipse|epl-"),
    ("epl-2.0", r"epl-2\.0", r"eclipse public licen[sc]e,? (?:- ?)?(?:version |v ?)?2\.0", r"eclipse\.org/legal/epl-2\.0", "eclipse|epl-"),
    ("cddl-1.0", r"cddl-1\.[01]", r"common development and distribution licen[sc]e", r"opensource\.org/licenses/cddl", "cddl|common development"),
    ("cpl-1.0", r"cpl-1\.0", r"common public licen[sc]e", r"opensource\.org/licenses/cpl", "cpl-|common public|licenses/cpl"),
    ("eupl", r"eupl-1\.[012]", r"european union public licen[sc]e", r"joinup\.ec\.europa\.eu/[^\s]*eupl", "eupl|european union public"),
    ("cc0-1.0", r"cc0-1\.0", r"\bcc0\b(?: 1\.0)?(?: universal)?", r"creativecommons\.org/publicdomain/zero/1\.0", "cc0|publicdomain/zero"),
    ("cc-by", r"cc-by-[1-4]\.[05]", r"\bcc[- ]by(?![- ](?:sa|nc|nd))|creative commons attribution(?![- ](?:share|non|no))", r"creativecommons\.org/licenses/by/[1-4]\.[05]", "cc by|cc-by|creative"),
    ("cc-by-sa", r"cc-by-sa-[1-4]\.[05]", r"\bcc[- ]by[- ]sa|creative commons attribution[- ]share ?alike", r"creativecommons\.org/licenses/by-sa/[1-4]\.[05]", "cc by|cc-by|creative"),
    ("cc-by-nc", r"cc-by-nc-[1-4]\.[05]", r"\bcc[- ]by[- ]nc(?![- ](?:sa|nd))|creative commons attribution[- ]non-?commercial(?![- ](?:share|no))", r"creativecommons\.org/licenses/by-nc/[1-4]\.[05]", "cc by|cc-by|creative"),
    ("cc-by-nd", r"cc-by-nd-[1-4]\.[05]", r"\bcc[- ]by[- ]nd|creative commons attribution[- ]no ?deriv\w*", r"creativecommons\.org/licenses/by-nd/[1-4]\.[05]", "cc by|cc-by|creative"),
    ("cc-by-nc-sa", r"cc-by-nc-sa-[1-4]\.[05]", r"\bcc[- ]by[- ]nc[- ]sa|creative commons attribution[- ]non-?commercial[- ]share ?alike", r"creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]", "cc by|cc-by|creative"),
    ("cc-by-nc-nd", r"cc-by-nc-nd-[1-4]\.[05]", r"\bcc[- ]by[- ]nc[- ]nd|creative commons attribution[- ]non-?commercial[- ]no ?deriv\w*", r"creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]", "cc by|cc-by|creative"),
    ("unlicense", r"unlicense", r"the unlicense\b|free and unencumbered software released into the public domain", r"unlicense\.org", "unlicense|unencumbered"),
    ("wtfpl", r"wtfpl", r"do what the fuck you want to public licen[sc]e", r"wtfpl\.net", "wtfpl|do what the"),
    ("zlib", r"zlib", r"\bzlib licen[sc]e|zlib/libpng licen[sc]e", r"zlib\.net/zlib_license|opensource\.org/licenses/zlib", "zlib"),
    ("bsl-1.0", r"bsl-1\.0", r"boost software licen[sc]e", r"boost\.org/license_1_0", "boost|bsl-"),
    ("artistic-2.0", r"artistic-2\.0", r"artistic licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?", r"opensource\.org/licenses/artistic-2\.0", "artistic"),
    ("artistic-1.0", r"artistic-1\.0", r"(?:perl )?artistic licen[sc]e(?! ?,? ?(?:version |v\.? ?)?2)", r"opensource\.org/licenses/artistic-1\.0", "artistic"),
    ("ofl-1.1", r"ofl-1\.[01]", r"(?:sil )?open font licen[sc]e", r"scripts\.sil\.org/ofl", "ofl|open font"),
    ("postgresql", r"postgresql", r"postgresql licen[sc]e", r"opensource\.org/licenses/postgresql", "postgresql"),
    ("python-2.0", r"(?:python|psf)-2\.0", r"python software foundation licen[sc]e|\bpsf licen[sc]e", r"docs\.python\.org/[^\s]*license", "python|psf"),
    ("php-3.01", r"php-3\.0?1?", r"\bphp licen[sc]e", r"php\.net/license", "php"),
    ("ruby", r"ruby", r"\bruby licen[sc]e", r"ruby-lang\.org/[^\s]*license", "ruby"),
    ("ms-pl", r"ms-pl", r"microsoft public licen[sc]e", r"opensource\.org/licenses/ms-pl", "ms-pl|microsoft public"),
    ("ms-rl", r"ms-rl", r"microsoft reciprocal licen[sc]e", r"opensource\.org/licenses/ms-rl", "ms-rl|microsoft reciprocal"),
    ("odbl-1.0", r"odbl-1\.0", r"open (?:data commons open )?database licen[sc]e", r"opendatacommons\.org/licenses/odbl", "odbl|database lic"),
    ("sspl-1.0", r"sspl-1\.0", r"server side public licen[sc]e", r"mongodb\.com/licensing/server-side-public-license", "sspl|server side|server-side"),
    ("busl-1.1", r"busl-1\.1", r"business source licen[sc]e", r"mariadb\.com/bsl11", "busl|business source|bsl11"),
    ("afl-3.0", r"afl-3\.0", r"academic free licen[sc]e", r"opensource\.org/licenses/afl-3\.0", "afl-|academic free"),
    ("osl-3.0", r"osl-3\.0", r"open software licen[sc]e", r"opensource\.org/licenses/osl-3\.0", "osl-|open software"),
    ("ncsa", r"ncsa", r"(?:university of illinois/)?ncsa (?:open source )?licen[sc]e", r"opensource\.org/licenses/ncsa", "ncsa"),
    ("openssl", r"openssl", r"\bopenssl licen[sc]e", r"openssl\.org/source/license", "openssl"),
    ("public-domain", r"public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", r"creativecommons\.org/publicdomain/mark", "public domain|publicdomain|public-domain"),
    ("proprietary", r"licenseref-proprietary", r"all rights reserved|proprietary and confidential", "", "all rights|proprietary"),
]

#: Statement forms: name, priority, pattern with the license's own parts; confidence is priority / 100.
FORMS = [
    ("tag", 100, r"spdx-license-identifier:\s*(?:{spdx})(?![\w.+-])"),
    ("under", 90, r"(?:licen[sc]ed|distributed|released|available|published|made available|use) under (?:the |an? )?(?:terms of (?:the )?)?(?:{name})"),
    ("under id", 88, r"(?:licen[sc]ed|distributed|released) under (?:the )?(?:terms of (?:the )?)?(?:{spdx})(?![\w.+-])"),
    ("url", 85, r"(?:https?://)?(?:www\.)?(?:{url})"),
    ("header", 80, r"licen[sc]e\s*[:=]\s*[\"']?(?:the )?(?:{name}|(?:{spdx})(?![\w.+-]))"),
    ("name", 60, r"(?:{name})"),
]


#: SPDX ids of exceptions, which stand behind WITH.
EXCEPTIONS = ["autoconf-exception-2.0", "autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0", "font-exception-2.0", "gcc-exception-2.0", "gcc-exception-3.1", "linux-syscall-note", "llvm-exception", "openvpn-openssl-exception", "u-boot-exception-2.0", "wxwindows-exception-3.1"]


class Rule(NamedTuple):
    label: str
    form: str
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern


#: White space, and comment marks behind it, as where a statement is wrapped in a file's header.
GAP = r"(?=\s)[\s#*/;>]++"


def spaced(pattern: str) -> str:
    """A space in a pattern stands for a gap, also where it is optional or in a class with a hyphen. Gaps are taken whole: no
    pattern has white space or a comment mark after a space."""
    return pattern.replace("[- ]", f"(?:-|{GAP})").replace(" ?", f"(?:{GAP})?+").replace(" ", GAP)


def wrapped(pattern: str) -> str:
    """A signature's space: white space and comment marks, as in a file's header."""
    return pattern.replace(" ?", r"[\s#*/;>]*+").replace("[- ]", r"(?:-|[\s#*/;>]++)").replace(" ", r"[\s#*/;>]++")


@cache
def rules() -> list[Rule]:
    """In order of priority."""
    out = [Rule(label, "text", priority, (keywords,), re.compile(wrapped(pattern))) for label, priority, keywords, pattern in SIGNATURES]
    for label, spdx, name, url, keywords in LICENSES:
        for form, priority, pattern in FORMS:
            if form == "url" and not url:
                continue
            text = spaced(pattern.format(spdx=spdx, name=name, url=url))
            out.append(Rule(label, form, priority, tuple(keywords.split("|")), re.compile(text)))
    return sorted(out, key=lambda r: -r.priority)


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    form: str
    priority: int


def suppress(found: list[Detection]) -> list[Detection]:
    """Without detections that lie inside a kept one of a higher priority, or of the same priority and longer (for equal
    intervals the more specific, longer label, then the first in order)."""
    kept: list[Detection] = []
    starts: list[int] = []  # of kept intervals that lie in no other; their ends ascend, too
    ends: list[int] = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, -len(d.label), d.start, d.label)):
        i = bisect_right(starts, d.start)
        if i and ends[i - 1] >= d.end:
            continue
        kept.append(d)
        low = i - 1 if i and starts[i - 1] == d.start else i
        high = bisect_right(ends, d.end, lo=low)
        starts[low:high], ends[low:high] = [d.start], [d.end]
    return sorted(kept)


#: What is left of gaps once white space is collapsed.
MARKS = re.compile(r" [#*/;>][ #*/;>]*+")
#: A chain of words joined as an SPDX expression joins ids, the words themselves, and what an expression follows.
CHAIN = r"\(*+[a-z0-9][\w.+-]*+\)*+(?:\s++(?:or|and|with)\s++\(*+[a-z0-9][\w.+-]*+\)*+)"
TAGGED, LOOSE, TOKEN = re.compile(r"(?<=spdx-license-identifier:)\s*+" + CHAIN + "*+"), re.compile(r"(?<![\w.+(-])" + CHAIN + "++"), re.compile(r"[a-z0-9][\w.+-]*+")
TAG = "spdx-license-identifier:"


@cache
def versioned() -> tuple[str, ...]:
    """Beginnings of ids that hold a version or a number, which no word of plain text has: one of an untagged expression's operands begins so."""
    begins = (re.match(r"[a-z0-9-]*", spdx)[0] for _, spdx, *_ in LICENSES)
    return tuple(sorted({b for b in begins if re.search(r"-(?:[0-9]|$)", b)} | {"python-2.0", "psf-2.0"}))


@lru_cache(maxsize=1 << 16)
def label_of(token: str) -> str | None:
    """The label of an SPDX id. The cache holds words of chains, of 64 characters at most."""
    if token in EXCEPTIONS:
        return token
    return next((label for label, spdx, *_ in LICENSES if re.fullmatch(spdx, token)), None)


def expressions(low: str, has: set[str]) -> Iterator[Detection]:
    """Operands of SPDX expressions, each a detection: all behind a tag; without one, runs of ids of which one has a version."""
    forms = [("tag", 100, TAGGED)] if TAG in has else []
    if any(v in has for v in versioned()):
        forms.append(("expression", 87, LOOSE))
    for form, priority, chain in forms:
        for m in chain.finditer(low):
            run: list[tuple[int, str, str]] = []
            words = [(t.start(), t[0].rstrip(".")) for t in TOKEN.finditer(low, m.start(), m.end())]
            for i in range(0, len(words) + 2, 2):  # every second word is an operator; the last turn ends a run
                at, word = words[i] if i < len(words) else (0, "")
                label = label_of(word) if 0 < len(word) <= 64 else None
                if label:
                    run.append((at, word, label))
                if not label or form == "tag":
                    if form == "tag" or (len(run) > 1 and any(w.startswith(versioned()) for _, w, _ in run)):
                        yield from (Detection(a, a + len(w), found, form, priority) for a, w, found in run)
                    run = []


@cache
def gates() -> tuple[ahocorasick.Automaton, dict[str, list[tuple[int, frozenset[str]]]]]:
    """An automaton of all keywords' words, and by its longest word each set of words that lets a rule (by its place) be run."""
    sets: dict[str, list[tuple[int, frozenset[str]]]] = {}
    for i, r in enumerate(rules()):
        for k in r.keywords:
            sets.setdefault(max(k.split("&"), key=len), []).append((i, frozenset(k.split("&"))))
    words = ahocorasick.Automaton()
    for w in {w for ks in sets.values() for _, k in ks for w in k} | {TAG, *versioned()}:
        words.add_word(w, w)
    words.make_automaton()
    return words, sets


def keywords_of(low: str) -> set[str]:
    """Keywords of a text, whose gaps are taken as single spaces, as patterns let them be any."""
    return {w for _, w in gates()[0].iter(MARKS.sub(" ", " ".join(low.split())))}


def gated(has: set[str]) -> list[Rule]:
    """Rules that have a keyword in the text, in order; the others can't match."""
    sets = gates()[1]
    return [rules()[i] for i in sorted({i for w in has for i, k in sets.get(w, ()) if k <= has})]


def scan(low: str) -> list[Detection]:
    """low: a text with A-Z lower-cased."""
    has = keywords_of(low)
    found = [Detection(m.start(), m.end(), r.label, r.form, r.priority) for r in gated(has) for m in r.pattern.finditer(low)]
    return suppress(found + list(expressions(low, has)))


WORD = rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]"
BASE = [(label, phrase.split()[0].encode() if i != 2 else b"cc", re.compile(rb"(?<!" + WORD + rb")" + (rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+").join(w.encode() for w in phrase.split()) + rb"(?!" + WORD + rb")")) for i, (phrase, label) in enumerate(PHRASES.items())]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_places(low: bytes) -> list[tuple[int, str]]:
    return sorted((m.start(), label) for label, first, pattern in BASE if first in low for m in pattern.finditer(low))


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start: int, end: int, label: string, form: string, priority: int>>"
_DETECTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("form", pa.string()), ("priority", pa.int32())])


def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(_DETECTION)]
    for batch in batches:
        data, offsets = flat(batch.column(1))
        rows = []
        for a, b in steps(offsets):
            low = LOWER[data[offsets[a] : offsets[b]]]
            at = offsets[a : b + 1] - offsets[a]
            starts, _ = word_spans(low, at, ALNUM)
            first = np.searchsorted(starts, at)
            for i in range(b - a):
                text = low[at[i] : at[i + 1]].tobytes()
                places = base_places(text)
                words = [int(np.searchsorted(starts, at[i] + p) - first[i]) for p, _ in places]
                base = {label for _, label in places}
                found = scan(text.decode("utf-8", "replace"))
                labels = base | {d.label for d in found}
                score = max([d.priority / 100 for d in found] + [0.5 if base else 0.0])
                rows.append((int(first[i + 1] - first[i]), len(places), min(words, default=None), max(words, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [d._asdict() for d in found]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 8, types[1:])]], names)


def licenses(docs: DataFrame) -> DataFrame:
    """Per document: counts and places of the base phrases, labels, the best confidence, and detections as code point
    intervals."""
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCANNED)
