"""License scans: ordered signature rules, gated by keywords; overlapping detections are resolved by priority and containment."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ALNUM, Words, text_runs, word_hash, words_in

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_V = r"(?:,?\s*(?:version|ver\.?|v\.?)?\s*"
_L = r"licen[cs]e"

#: label; keyword, for the reader; title; version that may follow it; SPDX ids; addresses.
#: Every row gives up to five rules: SPDX tag, "licensed under" notice, title with version, title alone, address.
_LICENSES = (
    ("mit", "mit", rf"(?:the\s+)?(?:mit|expat)(?:/x11)?\s+{_L}", "", r"mit", r"opensource\.org/licenses/mit"),
    ("mit-0", "mit", rf"mit\s+no\s+attribution(?:\s+{_L})?|mit-0", "", r"mit-0", r"opensource\.org/licenses/mit-0"),
    ("x11", "x11", rf"x11\s+{_L}", "", r"x11", r"spdx\.org/licenses/x11"),
    ("apache-2.0", "apache", rf"apache\s+(?:software\s+)?{_L}", _V + r"2(?:\.0)?)", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache", rf"apache\s+(?:software\s+)?{_L}", _V + r"1\.1)", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-1.0", "apache", rf"apache\s+(?:software\s+)?{_L}", _V + r"1\.0)", r"apache-1\.0", r"apache\.org/licenses/license-1\.0"),
    ("agpl-3.0", "affero", rf"(?:gnu\s+)?affero\s+general\s+public\s+{_L}", _V + r"3(?:\.0)?)", r"agpl-3\.0(?:-only|-or-later)?", r"gnu\.org/licenses/agpl(?:-3\.0)?"),
    ("agpl-1.0", "affero", rf"affero\s+general\s+public\s+{_L}", _V + r"1(?:\.0)?)", r"agpl-1\.0(?:-only|-or-later)?", r"affero\.org/oagpl"),
    ("lgpl-3.0", "lesser", rf"(?:gnu\s+)?lesser\s+general\s+public\s+{_L}", _V + r"3(?:\.0)?)", r"lgpl-3\.0(?:-only|-or-later)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl-2.1", "lesser", rf"(?:gnu\s+)?lesser\s+general\s+public\s+{_L}", _V + r"2\.1)", r"lgpl-2\.1(?:-only|-or-later)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-2.0", "library", rf"(?:gnu\s+)?library\s+general\s+public\s+{_L}", _V + r"2(?:\.0)?)", r"lgpl-2\.0(?:-only|-or-later)?", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    ("gpl-3.0", "gnu", rf"gnu\s+(?:general\s+public\s+{_L}|gpl)", _V + r"3(?:\.0)?)", r"gpl-3\.0(?:-only|-or-later)?", r"gnu\.org/licenses/gpl(?:-3\.0)?"),
    ("gpl-2.0", "gnu", rf"gnu\s+(?:general\s+public\s+{_L}|gpl)", _V + r"2(?:\.0)?)", r"gpl-2\.0(?:-only|-or-later)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-1.0", "gnu", rf"gnu\s+(?:general\s+public\s+{_L}|gpl)", _V + r"1(?:\.0)?)", r"gpl-1\.0(?:-only|-or-later)?", r"gnu\.org/licenses/old-licenses/gpl-1\.0"),
    ("gpl", "gpl", r"gpl\s*v?(?:1|2|3)(?:\.0)?|gplv(?:1|2|3)\+?", "", r"gpl(?:-\d\.\d)?\+", r"gnu\.org/copyleft/gpl"),
    ("gfdl", "documentation", rf"(?:gnu\s+)?free\s+documentation\s+{_L}", _V + r"1\.[0-3])", r"gfdl-1\.[1-3](?:-only|-or-later)?", r"gnu\.org/(?:licenses/fdl|copyleft/fdl)"),
    ("gnu-all-permissive", "notice", r"copying\s+and\s+distribution\s+of\s+this\s+file,?\s+with\s+or\s+without\s+modification", "", r"fsfap", r"spdx\.org/licenses/fsfap"),
    ("mpl-2.0", "mozilla", rf"mozilla\s+public\s+{_L}", _V + r"2(?:\.0)?)", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl-1.1", "mozilla", rf"mozilla\s+public\s+{_L}", _V + r"1\.1)", r"mpl-1\.1", r"mozilla\.org/mpl/(?:mpl-)?1\.1"),
    ("mpl-1.0", "mozilla", rf"mozilla\s+public\s+{_L}", _V + r"1\.0)", r"mpl-1\.0", r"mozilla\.org/mpl/mpl-1\.0"),
    ("epl-2.0", "eclipse", rf"eclipse\s+public\s+{_L}", r"(?:\s*-\s*v?|" + _V[3:] + r"2(?:\.0)?)", r"epl-2\.0", r"eclipse\.org/legal/epl-(?:2\.0|v20)"),
    ("epl-1.0", "eclipse", rf"eclipse\s+public\s+{_L}", r"(?:\s*-\s*v?|" + _V[3:] + r"1\.0)", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    ("edl-1.0", "eclipse", rf"eclipse\s+distribution\s+{_L}", "", r"", r"eclipse\.org/org/documents/edl-v10"),
    ("cddl-1.0", "cddl", r"common\s+development\s+and\s+distribution\s+licen[cs]e|cddl", _V + r"1\.0)", r"cddl-1\.0", r"opensource\.org/licenses/cddl-?1\.0"),
    ("cddl-1.1", "cddl", r"common\s+development\s+and\s+distribution\s+licen[cs]e|cddl", _V + r"1\.1)", r"cddl-1\.1", r"glassfish\.dev\.java\.net/public/cddl"),
    ("cpl-1.0", "common", rf"common\s+public\s+{_L}", _V + r"1\.0)", r"cpl-1\.0", r"opensource\.org/licenses/cpl1\.0"),
    ("cpal-1.0", "attribution", rf"common\s+public\s+attribution\s+{_L}", _V + r"1\.0)", r"cpal-1\.0", r"opensource\.org/licenses/cpal_1\.0"),
    ("bsd-2-clause", "bsd", rf"(?:simplified\s+bsd|bsd\s+2-clause|2-clause\s+bsd|freebsd)\s+{_L}", "", r"bsd-2-clause", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd", rf"(?:new\s+bsd|modified\s+bsd|revised\s+bsd|bsd\s+3-clause|3-clause\s+bsd)\s+{_L}", "", r"bsd-3-clause", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "bsd", rf"(?:original\s+bsd|bsd\s+4-clause|4-clause\s+bsd)\s+{_L}", "", r"bsd-4-clause", r"spdx\.org/licenses/bsd-4-clause"),
    ("0bsd", "bsd", rf"(?:zero-clause\s+bsd|bsd\s+zero\s+clause|0bsd)(?:\s+{_L})?", "", r"0bsd", r"opensource\.org/licenses/0bsd"),
    ("bsd", "bsd", rf"bsd(?:-style)?\s+{_L}", "", r"bsd-protection", r"opensource\.org/licenses/bsd-license"),
    ("isc", "isc", rf"isc\s+{_L}", "", r"isc", r"opensource\.org/licenses/isc"),
    ("zlib", "zlib", rf"zlib(?:/libpng)?\s+{_L}", "", r"zlib", r"zlib\.net/zlib_license|opensource\.org/licenses/zlib"),
    ("libpng", "libpng", rf"(?:png\s+reference\s+library|libpng)\s+{_L}", "", r"libpng(?:-2\.0)?", r"libpng\.org/pub/png/src/libpng-license"),
    ("boost-1.0", "boost", rf"boost\s+software\s+{_L}", _V + r"1\.0)", r"bsl-1\.0", r"boost\.org/license_1_0"),
    ("artistic-2.0", "artistic", rf"artistic\s+{_L}", _V + r"2(?:\.0)?)", r"artistic-2\.0", r"opensource\.org/licenses/artistic-2\.0"),
    ("artistic-1.0", "artistic", rf"artistic\s+{_L}", _V + r"1(?:\.0)?)", r"artistic-1\.0(?:-perl|-cl8)?", r"opensource\.org/licenses/artistic-1\.0"),
    ("python-2.0", "python", rf"python\s+software\s+foundation\s+{_L}|psf\s+{_L}", _V + r"2(?:\.0)?)", r"(?:python|psf)-2\.0", r"docs\.python\.org/3/license"),
    ("php-3.01", "php", rf"php\s+{_L}", _V + r"3\.01)", r"php-3\.01", r"php\.net/license/3_01"),
    ("ruby", "ruby", rf"ruby(?:'s)?\s+{_L}", "", r"ruby", r"ruby-lang\.org/en/about/license"),
    ("perl", "perl", r"same\s+terms\s+as\s+perl(?:\s+itself)?", "", r"", r"dev\.perl\.org/licenses"),
    ("unlicense", "unlicense", r"the\s+unlicense", "", r"unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl", _V + r"2(?:\.0)?)", r"wtfpl", r"wtfpl\.net|sam\.zoy\.org/wtfpl"),
    ("cc0-1.0", "cc0", r"cc0|creative\s+commons\s+zero", _V + r"1\.0)", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-pdm", "domain", r"public\s+domain\s+mark", _V + r"1\.0)", r"cc-pddc", r"creativecommons\.org/publicdomain/mark/1\.0"),
    ("public-domain", "domain", r"(?:released|dedicated|placed|put|is)\s+(?:in|into|to)\s+the\s+public\s+domain", "", r"", r"creativecommons\.org/licenses/publicdomain"),
    ("odbl-1.0", "database", rf"open\s+(?:data\s+commons\s+open\s+)?database\s+{_L}|odbl", _V + r"1\.0)", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "commons", rf"open\s+data\s+commons\s+attribution\s+{_L}", _V + r"1\.0)", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "commons", r"public\s+domain\s+dedication\s+and\s+licen[cs]e", _V + r"1\.0)", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("eupl-1.2", "eupl", rf"european\s+union\s+public\s+{_L}|eupl", _V + r"1\.2)", r"eupl-1\.2", r"joinup\.ec\.europa\.eu/.{0,60}eupl"),
    ("eupl-1.1", "eupl", rf"european\s+union\s+public\s+{_L}|eupl", _V + r"1\.1)", r"eupl-1\.1", r"ec\.europa\.eu/idabc/eupl"),
    ("cecill-2.1", "cecill", r"cecill(?:-[bc])?(?:\s+licen[cs]e)?", _V + r"2\.1)", r"cecill-2\.1", r"cecill\.info"),
    ("ms-pl", "microsoft", rf"microsoft\s+public\s+{_L}|ms-pl", "", r"ms-pl", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", "microsoft", rf"microsoft\s+reciprocal\s+{_L}|ms-rl", "", r"ms-rl", r"opensource\.org/licenses/ms-rl"),
    ("ofl-1.1", "ofl", r"(?:sil\s+)?open\s+font\s+licen[cs]e|ofl", _V + r"1\.1)", r"ofl-1\.1(?:-rfn|-no-rfn)?", r"scripts\.sil\.org/ofl"),
    ("ubuntu-font", "ubuntu", rf"ubuntu\s+font\s+{_L}", _V + r"1\.0)", r"ubuntu-font-1\.0", r"ubuntu\.com/legal/font-licence"),
    ("openssl", "openssl", rf"openssl\s+{_L}", "", r"openssl", r"openssl\.org/source/license"),
    ("postgresql", "postgresql", rf"postgresql\s+{_L}", "", r"postgresql", r"postgresql\.org/about/licence"),
    ("curl", "curl", rf"curl\s+{_L}", "", r"curl", r"curl\.(?:se|haxx\.se)/docs/copyright"),
    ("icu", "icu", rf"icu\s+{_L}", "", r"icu", r"source\.icu-project\.org/repos/icu/.{0,40}license"),
    ("unicode", "unicode", rf"unicode(?:,\s+inc\.)?\s+{_L}", "", r"unicode-(?:dfs-2016|3\.0)", r"unicode\.org/(?:copyright|license)"),
    ("ncsa", "ncsa", rf"(?:university\s+of\s+illinois/)?ncsa\s+open\s+source\s+{_L}", "", r"ncsa", r"opensource\.org/licenses/ncsa"),
    ("upl-1.0", "universal", rf"universal\s+permissive\s+{_L}", _V + r"1\.0)", r"upl-1\.0", r"oss\.oracle\.com/licenses/upl"),
    ("sspl-1.0", "sspl", rf"server\s+side\s+public\s+{_L}|sspl", _V + r"1(?:\.0)?)", r"sspl-1\.0", r"mongodb\.com/licensing/server-side-public-license"),
    ("busl-1.1", "business", rf"business\s+source\s+{_L}", _V + r"1\.1)", r"busl-1\.1", r"mariadb\.com/bsl11"),
    ("elastic-2.0", "elastic", rf"elastic\s+{_L}", _V + r"2(?:\.0)?)", r"elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    ("osl-3.0", "open", rf"open\s+software\s+{_L}", _V + r"3\.0)", r"osl-3\.0", r"opensource\.org/licenses/osl-3\.0"),
    ("afl-3.0", "academic", rf"academic\s+free\s+{_L}", _V + r"3\.0)", r"afl-3\.0", r"opensource\.org/licenses/afl-3\.0"),
    ("ecl-2.0", "educational", rf"educational\s+community\s+{_L}", _V + r"2\.0)", r"ecl-2\.0", r"opensource\.org/licenses/ecl-2\.0"),
    ("lppl-1.3c", "latex", rf"latex\s+project\s+public\s+{_L}", _V + r"1\.3[abc]?)", r"lppl-1\.3c", r"latex-project\.org/lppl"),
    ("qpl-1.0", "qpl", rf"q\s+public\s+{_L}|qpl", _V + r"1\.0)", r"qpl-1\.0", r"opensource\.org/licenses/qpl-1\.0"),
    ("vim", "vim", rf"vim\s+{_L}", "", r"vim", r"vimdoc\.sourceforge\.net/htmldoc/uganda"),
    ("json", "json", rf"json\s+{_L}", "", r"json", r"json\.org/license"),
    ("beerware", "beer", r"beer-?ware\s+licen[cs]e", "", r"beerware", r"people\.freebsd\.org/~phk"),
    ("ipl-1.0", "ibm", rf"ibm\s+public\s+{_L}", _V + r"1\.0)", r"ipl-1\.0", r"opensource\.org/licenses/ibmpl"),
    ("spl-1.0", "sun", rf"sun\s+public\s+{_L}", _V + r"1\.0)", r"spl-1\.0", r"opensource\.org/licenses/sunpublic"),
    ("apsl-2.0", "apple", rf"apple\s+public\s+source\s+{_L}", _V + r"2\.0)", r"apsl-2\.0", r"opensource\.apple\.com/apsl"),
    ("zpl-2.1", "zope", rf"zope\s+public\s+{_L}", _V + r"2\.1)", r"zpl-2\.1", r"old\.zope\.org/resources/license"),
    ("w3c", "w3c", rf"w3c\s+(?:software\s+(?:notice\s+and\s+)?|document\s+)?{_L}", "", r"w3c", r"w3\.org/consortium/legal"),
    ("nasa-1.3", "nasa", r"nasa\s+open\s+source\s+agreement", _V + r"1\.3)", r"nasa-1\.3", r"opensource\.org/licenses/nasa1\.3"),
    ("mulan-2", "mulan", rf"mulan\s+(?:permissive\s+software|psl)\s+{_L}?", _V + r"2)", r"mulanpsl-2\.0", r"license\.coscl\.org\.cn/mulanpsl2"),
    ("openrail", "openrail", r"(?:creativeml\s+)?(?:big(?:science|code)\s+)?openrail(?:-m|\+\+-m)?", "", r"", r"huggingface\.co/spaces/.{0,40}license"),
    ("ogl-uk-3.0", "government", rf"open\s+government\s+{_L}", _V + r"3(?:\.0)?)", r"ogl-uk-3\.0", r"nationalarchives\.gov\.uk/doc/open-government-licence"),
    ("etalab-2.0", "etalab", r"(?:licence\s+ouverte|etalab)", _V + r"2(?:\.0)?)", r"etalab-2\.0", r"etalab\.gouv\.fr/licence-ouverte"),
    ("dl-de-by-2.0", "datenlizenz", r"datenlizenz\s+deutschland", r"", r"dl-de-by-2\.0", r"govdata\.de/dl-de/by-2-0"),
)

#: Creative Commons: each kind with its names.
_COMMONS = (
    ("cc-by-nc-nd", r"(?:cc[\s-]+by[\s-]+nc[\s-]+nd|creative\s+commons\s+attribution[\s-]+non-?commercial[\s-]+no-?deriv(?:ative)?s?)", r"by-nc-nd"),
    ("cc-by-nc-sa", r"(?:cc[\s-]+by[\s-]+nc[\s-]+sa|creative\s+commons\s+attribution[\s-]+non-?commercial[\s-]+share-?alike)", r"by-nc-sa"),
    ("cc-by-nc", r"(?:cc[\s-]+by[\s-]+nc|creative\s+commons\s+attribution[\s-]+non-?commercial)", r"by-nc"),
    ("cc-by-nd", r"(?:cc[\s-]+by[\s-]+nd|creative\s+commons\s+attribution[\s-]+no-?deriv(?:ative)?s?)", r"by-nd"),
    ("cc-by-sa", r"(?:cc[\s-]+by[\s-]+sa|creative\s+commons\s+attribution[\s-]+share-?alike)", r"by-sa"),
    ("cc-by", r"(?:cc[\s-]+by|creative\s+commons\s+attribution)", r"by"),
)

#: Notices that name no license.
_NOTICES = (
    ("all-rights-reserved", r"all\s+rights\s+(?:are\s+)?reserved", 30),
    ("some-rights-reserved", r"some\s+rights\s+(?:are\s+)?reserved", 30),
    ("copyright", r"copyright\s+(?:\(c\)|\xc2\xa9)?\s*(?:19|20)\d\d", 20),
    ("proprietary", r"proprietary\s+and\s+confidential|confidential\s+and\s+proprietary", 30),
    ("no-redistribution", r"(?:may\s+not\s+be\s+redistributed|redistribution\s+is\s+(?:prohibited|not\s+permitted)|reproduction\s+(?:is\s+)?prohibited)", 30),
    ("non-commercial", r"for\s+non-?commercial\s+(?:use|purposes)\s+only", 25),
    ("generic-license", r"(?:see|read)\s+(?:the\s+)?(?:file\s+)?(?:license|licence|copying)(?:\.txt|\.md)?\s+(?:file\s+)?for\s+(?:details|more)", 25),
)


class Rule(NamedTuple):
    label: str
    gate: tuple[tuple[bytes, ...], ...]
    pattern: re.Pattern
    priority: int


def _needed(parsed) -> list[tuple[bytes, ...]]:
    """Groups of byte strings, of each of which every match of a parsed pattern holds one."""
    groups, run = [], bytearray()

    def close() -> None:
        if len(run) > 1:
            groups.append((bytes(run),))
        run.clear()

    for kind, value in parsed:
        if kind is _parser.LITERAL:
            run.append(value)
            continue
        close()
        if kind is _parser.SUBPATTERN:
            groups += _needed(value[3])
        elif kind is _parser.BRANCH:
            # of each alternative the group whose shortest string is the longest
            best = [max(_needed(x), key=lambda g: min(map(len, g)), default=()) for x in value[1]]
            if all(best):
                groups.append(tuple(sorted({w for group in best for w in group})))
        elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0:
            groups += _needed(value[2])
    close()
    return groups


def gate_of(pattern: bytes) -> tuple[tuple[bytes, ...], ...]:
    """What a text must hold for the pattern to match at all, read from the pattern itself: one string of every group."""
    return tuple(sorted(set(_needed(_parser.parse(pattern))), key=lambda g: (-min(map(len, g)), g)))


def signatures() -> list[Rule]:
    """The rules, those of the highest priority first."""
    under = r"(?:licen[cs]ed|released|distributed|published|provided|available|redistribut\w+)(?:\s+\w+){0,3}\s+under\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+(?:the\s+)?)?"
    rows: list[tuple[str, str, int]] = []
    for label, _, title, version, spdx, address in _LICENSES:
        rows.append((label, rf"\b{under}(?:{title}){version}", 80))
        if version:
            rows.append((label, rf"\b(?:{title}){version}", 60))
        rows.append((re.sub(r"-\d.*$", "", label) if version else label, rf"\b(?:{title})", 40))
        if spdx:
            rows.append((label, rf"spdx-license-identifier:\s*\(?{spdx}(?![\w.+-])", 100))
        rows.append((label, rf"(?:https?://|www\.)(?:www\.)?(?:{address})", 70))
    for label, name, path in _COMMONS:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            exact = version.replace(".", r"\.")
            rows.append((f"{label}-{version}", rf"\b{under}(?:a\s+)?{name}(?:\s+(?:international|unported|generic|licen[cs]e|version|v))*\s*{exact}", 80))
            rows.append((f"{label}-{version}", rf"\b{name}(?:\s+(?:international|unported|generic|licen[cs]e|version|v))*[\s-]*{exact}", 60))
            rows.append((f"{label}-{version}", rf"creativecommons\.org/licenses/{path}/{exact}", 70))
        rows.append((label, rf"\b{name}\b(?!-)", 40))
        rows.append((label, rf"spdx-license-identifier:\s*{label}-\d\.\d(?![\w.+-])", 100))
    rows += _NOTICES
    rows = list(dict.fromkeys(rows))
    rules = [Rule(label, gate_of(x), re.compile(x), priority) for label, x, priority in ((label, pattern.encode("latin-1"), priority) for label, pattern, priority in rows)]
    return sorted(rules, key=lambda r: -r.priority)


class Detection(NamedTuple):
    label: str
    start: int
    end: int
    priority: int


def resolve(found: list[Detection]) -> list[Detection]:
    """Detections by priority, then length, then place; one whose interval lies within that of an earlier one goes. Those that merely overlap stay.

    For each detection in that order, the farthest end among earlier ones that begin no later tells whether one of them contains it: a tree of
    prefix maxima over the places of beginnings, so n detections cost n log n.
    """
    starts = {at: i + 1 for i, at in enumerate(sorted({d.start for d in found}))}
    farthest = [-1] * (len(starts) + 1)
    kept: list[Detection] = []
    for x in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        i, end = starts[x.start], -1
        while i:
            end = max(end, farthest[i])
            i &= i - 1
        if end >= x.end:
            continue
        kept.append(x)
        i = starts[x.start]
        while i < len(farthest):
            farthest[i] = max(farthest[i], x.end)
            i += i & -i
    return sorted(kept, key=lambda d: (d.start, d.end, d.label))


class Scanner:
    def __init__(self) -> None:
        self.rules = signatures()
        self.gates: dict[tuple[tuple[bytes, ...], ...], list[int]] = defaultdict(list)
        for i, rule in enumerate(self.rules):
            self.gates[rule.gate].append(i)
        self.phrases = [(phrase.encode().split(), label) for phrase, label in PHRASES]
        self.hashes = [[np.uint64(word_hash(w)) for w in words] for words, _ in self.phrases]

    def places(self, words: Words) -> dict[int, list[tuple[int, str]]]:
        """Per text, the places (word of the text, label) where a phrase stands."""
        out: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for (phrase, label), hashes in zip(self.phrases, self.hashes, strict=True):
            n = len(words.hash) - len(phrase) + 1
            if n <= 0:
                continue
            match = words.text[:n] == words.text[len(phrase) - 1 :]
            for j, h in enumerate(hashes):
                match &= words.hash[j : n + j] == h
            for i in np.flatnonzero(match).tolist():
                if all(words.word(i + j) == w for j, w in enumerate(phrase)):
                    text = int(words.text[i])
                    out[text].append((i - int(np.searchsorted(words.text, text)), label))
        return out

    def detect(self, words: Words) -> dict[int, list[Detection]]:
        """Per text, the detections that remain. Only rules whose gate the text passes are tried."""
        out = {}
        for text in np.unique(words.text).tolist():
            content = words.bytes[words.offsets[text] : words.offsets[text + 1]].tobytes()
            held: dict[tuple[bytes, ...], bool] = {}

            def holds(group: tuple[bytes, ...], content=content, held=held) -> bool:
                if group not in held:
                    held[group] = any(x in content for x in group)
                return held[group]

            passed = sorted(i for gate, own in self.gates.items() if all(holds(g) for g in gate) for i in own)
            found = [Detection(r.label, m.start(), m.end(), r.priority) for r in (self.rules[i] for i in passed) for m in r.pattern.finditer(content)]
            if found:
                out[text] = resolve(found)
        return out


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("n_found", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("priority", T.IntegerType())]))),
    ]
)
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32())]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text); texts aren't shuffled.

    n_words: words, which are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; n_base, first_word, last_word,
    base_labels: the places of the fixed phrases. spans: detections of the signature rules (label, start and end
    in characters, priority); n_found: their number. labels: base labels and those of the spans; score: the strongest
    span's priority / 100, 0.5 at least if a phrase stands there, else 0.

    Rules are tried in order of priority, each only on texts that hold the strings that its pattern cannot do without. Detections are accepted
    by priority, then length, then place; what lies within an accepted one goes (see resolve). Of equal intervals the one of the higher
    priority stays, then the first label. A null or empty text has no words, empty labels and score 0; repeated rows give repeated results; no rows give no rows; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for first, last, raw, offsets in text_runs(batch.column(1)):
                words = words_in(raw, offsets, ALNUM)
                counts = np.bincount(words.text, minlength=last - first)
                places, spans = scanner.places(words), scanner.detect(words)
                rows = []
                for i in range(last - first):
                    base, found = places.get(i, []), spans.get(i, [])
                    starts = [p for p, _ in base]
                    # characters before each place: bytes that don't continue one
                    ends = np.cumsum((words.bytes[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80, dtype=np.int32) if found else None
                    size = lambda at, ends=ends: int(ends[at - 1]) if at else 0
                    named = sorted({label for _, label in base})
                    score = max([d.priority / 100 for d in found] + [0.5] * bool(base), default=0.0)
                    rows.append((int(counts[i]), len(base), min(starts, default=None), max(starts, default=None), ",".join(named), ",".join(sorted({*named, *(d.label for d in found)})), score, len(found), [{"label": d.label, "start": size(d.start), "end": size(d.end), "priority": d.priority} for d in found]))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), _SPANS]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns], names=SCHEMA.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(scan, SCHEMA)
