"""License scans by ordered signature rules.

A rule is a label, a regular expression over the lower-cased bytes, the keywords that a text must hold for
the expression to be tried, a priority and a confidence. A text is first tested for the keywords, each
once; the rules whose keywords are all there run. Of the places found, the highest priority goes first,
then the longest, then the earliest; a place that lies inside an accepted one is suppressed. The phrases of
BASE are always reported, whatever else is found.

Most rules are written by hand (license_rules.py): bodies of licenses, notices, identifiers, grants, statements. Besides these
every license of the table below is looked for by name in a few phrasings. A name that is also that of a program or an
institute counts only with the word "license".

Defined cases: a null or empty text has no words, no labels and score 0; a text without a detection has
score 0; the rest of a row (null doc_id, repeated rows, other columns of any name) is carried through; columns named
like a result are replaced; a very long text is scanned whole, in one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_rules
from .common import fresh, text_of

#: Phrases of words and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Label: the license's names as words, its identifier as words.
LICENSES = {
    "mit": ("mit", "mit"),
    "mit-0": ("mit no attribution", "mit 0"),
    "apache-1.1": ("apache software version 1 1|apache version 1 1", "apache 1 1"),
    "apache-2": ("apache version 2 0|apache 2 0|apache version 2", "apache 2 0"),
    "gpl-2": ("gnu general public version 2|gnu gpl v2|gnu gpl version 2|gplv2", "gpl 2 0"),
    "gpl-3": ("gnu general public version 3|gnu gpl v3|gnu gpl version 3|gplv3", "gpl 3 0"),
    "lgpl-2.1": ("gnu lesser general public version 2 1|gnu lgpl v2 1|lgplv2 1", "lgpl 2 1"),
    "lgpl-3": ("gnu lesser general public version 3|gnu lgpl v3|lgplv3", "lgpl 3 0"),
    "agpl-3": ("gnu affero general public version 3|gnu agpl v3|agplv3", "agpl 3 0"),
    "gfdl": ("gnu free documentation|gfdl", "gfdl 1 3"),
    "bsd-2": ("bsd 2 clause|simplified bsd|freebsd", "bsd 2 clause"),
    "bsd-3": ("bsd 3 clause|new bsd|modified bsd|revised bsd", "bsd 3 clause"),
    "bsd-4": ("bsd 4 clause|original bsd", "bsd 4 clause"),
    "isc": ("isc", "isc"),
    "mpl-1.1": ("mozilla public version 1 1|mpl 1 1", "mpl 1 1"),
    "mpl-2": ("mozilla public version 2 0|mozilla public version 2|mpl 2 0", "mpl 2 0"),
    "epl-1": ("eclipse public version 1 0|eclipse public v1 0|epl 1 0", "epl 1 0"),
    "epl-2": ("eclipse public version 2 0|eclipse public v2 0|epl 2 0", "epl 2 0"),
    "cddl-1": ("common development and distribution version 1 0|cddl 1 0", "cddl 1 0"),
    "cpl-1": ("common public version 1 0|cpl 1 0", "cpl 1 0"),
    "eupl-1.2": ("european union public version 1 2|eupl v1 2", "eupl 1 2"),
    "artistic-2": ("artistic 2 0|artistic version 2 0", "artistic 2 0"),
    "zlib": ("zlib|zlib libpng", "zlib"),
    "bsl-1": ("boost software version 1 0|boost software", "bsl 1 0"),
    "ms-pl": ("microsoft public", "ms pl"),
    "ms-rl": ("microsoft reciprocal", "ms rl"),
    "unlicense": ("unlicense", "unlicense"),
    "wtfpl": ("do what the fuck you want to public|wtfpl", "wtfpl"),
    "postgresql": ("postgresql", "postgresql"),
    "python-2": ("python software foundation|psf", "python 2 0"),
    "ofl-1.1": ("sil open font version 1 1|sil open font|ofl 1 1", "ofl 1 1"),
    "odbl-1": ("open database|odbl", "odbl 1 0"),
    "odc-by-1": ("open data commons attribution|odc by", "odc by 1 0"),
    "cc0-1": ("cc0 1 0|cc0|creative commons zero", "cc0 1 0"),
    "cc-by": ("cc by 4 0|cc by 3 0|cc by|creative commons attribution", "cc by 4 0"),
    "cc-by-sa": ("cc by sa 4 0|cc by sa 3 0|cc by sa|creative commons attribution sharealike|creative commons attribution share alike", "cc by sa 4 0"),
    "cc-by-nd": ("cc by nd 4 0|cc by nd|creative commons attribution noderivatives|creative commons attribution noderivs", "cc by nd 4 0"),
    "cc-by-nc": ("cc by nc 4 0|cc by nc 3 0|cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial", "cc by nc 4 0"),
    "cc-by-nc-sa": ("cc by nc sa 4 0|cc by nc sa|creative commons attribution noncommercial sharealike", "cc by nc sa 4 0"),
    "cc-by-nc-nd": ("cc by nc nd 4 0|cc by nc nd|creative commons attribution noncommercial noderivatives", "cc by nc nd 4 0"),
}

#: Priority, confidence, keyword, phrasing. The keyword is in every text that the phrasing can match. {name} is
#: one of the license's names, with the word "license" where it may stand or, unless the name is telling, must; {named} is the
#: name with that word, {id} its identifier.
PHRASINGS = (
    (60, 1.0, "spdx", "spdx license identifier {id}"),
    (50, 0.95, "under", "(?:licensed|released|distributed|available|published|provided)~under~(?:the~)?(?:terms~of~)?(?:the~)?{name}"),
    (45, 0.9, "under", "under~the~(?:terms~(?:and~conditions~)?of~the~)?{name}"),
    (40, 0.9, "subject", "subject~to~(?:the~terms~of~)?the~{name}"),
    (35, 0.8, "licen", "licen[cs]es?~(?:is~|the~)?{name}"),
    (30, 0.7, "licen", "{named}"),
)

#: Names that say of themselves that they are licenses; so do names with a version.
TELLING = ("gfdl", "wtfpl", "unlicense", "odbl", "odc by", "cc0")

_WORD = rb"0-9a-z\x80-\xff"
_GAP = "[^0-9a-z\\x80-\\xff]+"
_IS_WORD = np.zeros(256, bool)
_IS_WORD[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True

RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@dataclass(frozen=True)
class Signature:
    label: str
    priority: int
    confidence: float
    keywords: tuple[bytes, ...]
    expression: re.Pattern
    base: bool = False


def _signature(label: str, priority: int, confidence: float, keywords: list[str], body: str, base: bool = False) -> Signature:
    text = body.replace("~?", " ?").replace("~", " ").replace(" ?", "(?:" + _GAP + ")?").replace(" ", _GAP)
    found = re.compile(b"(?<![" + _WORD + b"])" + text.encode("latin-1") + b"(?![" + _WORD + b"])")
    return Signature(label, priority, confidence, tuple(k.encode() for k in keywords), found, base)


def _named(name: str) -> tuple[str, str]:
    """The name where "license" may stand after any of its words, and where it must."""
    words = name.split()
    at = next((k for k, w in enumerate(words) if w in ("version", "v1", "v2", "v3") or w.isdigit()), len(words))
    head, tail = "~".join(words[:at]), "".join("~" + w for w in words[at:])
    return f"{head}(?:~licen[cs]e)?{tail}(?:~(?:international~|unported~)?licen[cs]e)?", f"{head}~licen[cs]e{tail}"


@cache
def signatures() -> tuple[Signature, ...]:
    rules = [_signature(label, 100, 1.0, sorted(phrase.split(), key=len), phrase, True) for phrase, label in BASE]
    for label, (names, identifier) in LICENSES.items():
        for name in names.split("|"):
            free, must = _named(name)
            if not (name in TELLING or name.startswith(("cc ", "creative commons")) or any(c.isdigit() for c in name)):
                free = must
            rare = max(name.split(), key=len)
            for priority, confidence, keyword, phrasing in PHRASINGS:
                if "{id}" in phrasing:
                    if name == names.split("|")[0]:
                        rules.append(_signature(label, priority, confidence, [max(identifier.split(), key=len), keyword], phrasing.replace("{id}", identifier)))
                else:
                    rules.append(_signature(label, priority, confidence, [rare, keyword], phrasing.replace("{name}", free).replace("{named}", must)))
    for label, priority, confidence, body in license_rules.rules():
        rules.append(_signature(label, priority, confidence, re.findall("<([^>]+)>", body), re.sub("<([^>]+)>", r"\1", body)))
    return tuple(sorted(rules, key=lambda r: -r.priority))


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    label: str
    priority: int
    confidence: float
    base: bool


@cache
def by_keyword() -> dict[bytes, dict[bytes, list[Signature]]]:
    """The signatures by the last of their keywords (there are few of those) and the first."""
    out: dict[bytes, dict[bytes, list[Signature]]] = {}
    for rule in signatures():
        out.setdefault(rule.keywords[-1], {}).setdefault(rule.keywords[0], []).append(rule)
    return out


def detections(lowered: bytes) -> list[Detection]:
    """All places that rules match in the lower-cased bytes, before suppression."""
    found = []
    for gate, rest in by_keyword().items():
        if gate in lowered:
            for keyword, rules in rest.items():
                if keyword in lowered:
                    for rule in rules:
                        if all(k in lowered for k in rule.keywords):
                            found += [Detection(*m.span(), rule.label, rule.priority, rule.confidence, rule.base) for m in rule.expression.finditer(lowered)]
    return found


def suppress(found: list[Detection]) -> list[Detection]:
    """Places that lie in no place of higher priority, nor in a longer one (or, of equals, a former one) of
    the same. Base phrases neither suppress nor are suppressed. One sweep per priority."""
    kept: list[Detection] = []
    for priority in sorted({d.priority for d in found if not d.base}, reverse=True):
        level = [d for d in found if d.priority == priority and not d.base]
        reach, out = -1, []
        for d in sorted(kept + level, key=lambda d: (d.start, -d.end, -d.priority)):
            if d.priority > priority or d.end > reach:
                out.append(d)
                reach = max(reach, d.end)
        kept = out
    return kept + [d for d in found if d.base]


def scan(text: bytes) -> tuple:
    """The columns of RESULT."""
    low = text.lower()
    is_word = _IS_WORD[np.frombuffer(low, np.uint8)]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    n_words = int(np.count_nonzero(begins))
    found = suppress(detections(low))
    if not found:
        return n_words, 0, None, None, "", "", 0.0
    base = sorted(d.start for d in found if d.base)
    first = last = None
    if base:
        first, last = (int(np.count_nonzero(begins[:x])) for x in (base[0], base[-1]))
    labels = lambda ds: ",".join(sorted({d.label for d in ds}))
    return n_words, len(base), first, last, labels(d for d in found if d.base), labels(found), max(d.confidence for d in found)


def _scan_all(text: pa.Array) -> pa.Array:
    columns = list(zip(*(scan(x.as_buffer().to_pybytes()) for x in text))) or [()] * 7
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [c.split()[0] for c in RESULT.split(", ")]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of RESULT: words, base places, first and last word of one, labels, score."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    docs = docs.drop(*[c for c in names if c != text])
    (found,) = fresh(docs, "_licenses")
    one = F.arrow_udf(_scan_all, f"struct<{RESULT.replace(' long', ':long').replace(' string', ':string').replace(' double', ':double')}>")
    return docs.withColumn(found, one(text_of(docs, text).cast("binary"))).select(*docs.columns, *[f"{found}.{c}" for c in names])
