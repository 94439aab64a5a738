"""License scans: ordered signature rules over lower-cased whole texts.

Several hundred regular expressions are gated by keywords: a rule runs on a text only if the literals
that every match of its own pattern holds occur there. Detections carry their rule's priority; a detection
that lies inside one of higher priority, or of equal priority and greater length, is suppressed. Beside the
rules, three base phrases are looked up as consecutive words; their labels always stay.

Words are runs of characters outside the ASCII ranges ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased, so every non-ASCII character belongs to a word.

Cases: null text counts as empty (no words, no labels, score 0); repeated rows are scanned row by row;
equal intervals of equal priority keep the rule that stands first; texts of any length are read whole; an empty
table gives an empty result; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache
from re._constants import LITERAL, MAX_REPEAT, MIN_REPEAT, POSSESSIVE_REPEAT, SUBPATTERN
from re._parser import parse

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.session import in_slices, ship_package

#: The base phrases and their labels.
BASE_PHRASES = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))

#: Licences as (label, names, identifiers, addresses, grant phrases). Names and phrases are
#: patterns over lower-cased words; "~" stands for any run of characters between words, "~?" for such a
#: run or nothing, "~\\+" for such a run that ends in a plus, and "<word>" for any word.
LICENSES = (
    ("mit", ("mit~licen[cs]e", "expat~licen[cs]e"), ("mit", "x11"), ("opensource~org~licenses~mit",), ("permission~is~hereby~granted~free~of~charge~to~any~person~obtaining~a~copy", "the~software~is~provided~as~is~without~warranty~of~any~kind")),
    ("mit-0", ("mit~no~attribution",), ("mit-0",), (), ()),
    ("apache-2.0", ("apache~licen[cs]e~(?:version~)?2(?:~0)?", "apache~2~0", "asl~2(?:~0)?"), ("apache-2.0",), ("apache~org~licenses~license-2~0",), ("licensed~under~the~apache~licen[cs]e~version~2~0",)),
    ("apache-1.1", ("apache~(?:software~)?licen[cs]e~(?:version~)?1~1",), ("apache-1.1",), (), ()),
    ("apache-1.0", ("apache~(?:software~)?licen[cs]e~(?:version~)?1~0",), ("apache-1.0",), (), ()),
    ("apache", ("apache~(?:software~)?licen[cs]e",), (), ("apache~org~licenses",), ()),
    ("gpl-3.0", ("gnu~gpl~v?3", "gpl~?v?3(?:~0)?"), ("gpl-3.0", "gpl-3.0-only"), ("gnu~org~licenses~gpl-3~0",), ()),
    ("gpl-3.0-or-later", ("gpl~?v?3(?:~0)?(?:~or~later|~\\+)",), ("gpl-3.0-or-later",), (), ()),
    ("gpl-2.0", ("gnu~gpl~v?2", "gpl~?v?2(?:~0)?"), ("gpl-2.0", "gpl-2.0-only"), ("gnu~org~licenses~old-licenses~gpl-2~0",), ()),
    ("gpl-2.0-or-later", ("gpl~?v?2(?:~0)?(?:~or~later|~\\+)",), ("gpl-2.0-or-later",), (), ()),
    ("gpl-3.0", ("(?:gnu~)?general~public~licen[cs]e~(?:v|version)?~?3(?:~0)?",), (), (), ("either~version~3~of~the~licen[cs]e~or~(?:at~your~option~)?any~later~version",)),
    ("gpl-2.0", ("(?:gnu~)?general~public~licen[cs]e~(?:v|version)?~?2(?:~0)?",), (), (), ("either~version~2~of~the~licen[cs]e~or~(?:at~your~option~)?any~later~version",)),
    ("gpl", ("(?:gnu~)?general~public~licen[cs]e",), (), (), ("free~software~foundation",)),
    ("lgpl-3.0", ("(?:gnu~)?lesser~general~public~licen[cs]e~(?:v|version)?~?3",), (), (), ()),
    ("lgpl-2.1", ("(?:gnu~)?lesser~general~public~licen[cs]e~(?:v|version)?~?2~1",), (), (), ()),
    ("lgpl", ("(?:gnu~)?lesser~general~public~licen[cs]e",), (), (), ()),
    ("lgpl-3.0", ("lgpl~?v?3(?:~0)?",), ("lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"), ("gnu~org~licenses~lgpl-3~0",), ()),
    ("lgpl-2.1", ("lgpl~?v?2~1",), ("lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later"), ("gnu~org~licenses~lgpl-2~1",), ()),
    ("agpl-3.0", ("(?:gnu~)?affero~general~public~licen[cs]e(?:~(?:v|version)?~?3)?",), (), (), ()),
    ("agpl-3.0", ("agpl~?v?3(?:~0)?",), ("agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"), ("gnu~org~licenses~agpl-3~0",), ()),
    ("gfdl", ("(?:gnu~)?free~documentation~licen[cs]e",), (), (), ()),
    ("gfdl-1.3", ("gfdl~1~3",), ("gfdl-1.3", "gfdl-1.3-only", "gfdl-1.3-or-later"), ("gnu~org~licenses~fdl",), ()),
    ("bsd-2-clause", ("(?:2|two)~clause~bsd", "bsd~(?:2|two)~clause", "simplified~bsd", "freebsd~licen[cs]e"), ("bsd-2-clause",), ("opensource~org~licenses~bsd-2-clause",), ()),
    ("bsd-3-clause", ("(?:3|three)~clause~bsd", "bsd~(?:3|three)~clause", "new~bsd~licen[cs]e", "modified~bsd"), ("bsd-3-clause",), ("opensource~org~licenses~bsd-3-clause",), ()),
    ("bsd-4-clause", ("(?:4|four)~clause~bsd", "bsd~(?:4|four)~clause", "original~bsd"), ("bsd-4-clause",), (), ()),
    ("bsd-0-clause", ("zero~clause~bsd", "bsd~zero~clause"), ("0bsd",), (), ()),
    ("bsd", ("bsd~(?:style~)?licen[cs]e", "berkeley~software~distribution"), (), (), ()),
    ("bsd", (), (), (), ("redistribution~and~use~in~source~and~binary~forms", "redistributions~of~source~code~must~retain~the~above~copyright~notice", "redistributions~in~binary~form~must~reproduce~the~above~copyright~notice")),
    ("bsd-3-clause", (), (), (), ("neither~the~name~of~(?:<word>~){1,12}may~be~used~to~endorse~or~promote",)),
    ("isc", ("isc~licen[cs]e",), ("isc",), ("opensource~org~licenses~isc",), ()),
    ("isc", (), (), (), ("permission~to~use~copy~modify~and~or~distribute~this~software~for~any~purpose",)),
    ("mpl-2.0", ("mozilla~public~licen[cs]e~(?:v|version)?~?2(?:~0)?",), (), ("mozilla~org~mpl~2~0",), ("this~source~code~form~is~subject~to~the~terms~of~the~mozilla~public~licen[cs]e",)),
    ("mpl-1.1", ("mozilla~public~licen[cs]e~(?:v|version)?~?1~1",), (), (), ()),
    ("mpl", ("mozilla~public~licen[cs]e",), (), ("mozilla~org~mpl",), ()),
    ("mpl-2.0", ("mpl~?v?2(?:~0)?",), ("mpl-2.0", "mpl-2.0-no-copyleft-exception"), (), ()),
    ("mpl-1.1", ("mpl~?v?1~1",), ("mpl-1.1", "mpl-1.0"), (), ()),
    ("epl-2.0", ("eclipse~public~licen[cs]e~(?:v|version)?~?2(?:~0)?",), (), ("eclipse~org~legal~epl-2~0", "eclipse~org~legal~epl-v20"), ()),
    ("epl-1.0", ("eclipse~public~licen[cs]e~(?:v|version)?~?1(?:~0)?",), (), ("eclipse~org~legal~epl-v10",), ()),
    ("edl-1.0", ("eclipse~distribution~licen[cs]e",), (), ("eclipse~org~org~documents~edl-v10",), ()),
    ("epl-2.0", ("epl~?v?2(?:~0)?",), ("epl-2.0", "epl-1.0"), (), ()),
    ("cddl-1.0", ("cddl~?v?1(?:~0)?", "cddl"), ("cddl-1.0", "cddl-1.1"), (), ()),
    ("cddl-1.0", ("common~development~and~distribution~licen[cs]e",), (), (), ()),
    ("cpl-1.0", ("common~public~licen[cs]e(?:~(?:v|version)?~?1(?:~0)?)?",), ("cpl-1.0",), (), ()),
    ("unlicense", ("the~unlicense",), ("unlicense",), ("unlicense~org",), ()),
    ("unlicense", ("public~domain~dedication",), (), (), ("this~is~free~and~unencumbered~software~released~into~the~public~domain", "(?:released|placed|dedicated)~(?:in|into|to)~the~public~domain")),
    ("wtfpl", ("wtfpl",), ("wtfpl",), ("wtfpl~net",), ()),
    ("zlib", ("zlib~licen[cs]e", "zlib~libpng~licen[cs]e"), ("zlib", "zlib-acknowledgement"), (), ()),
    ("zlib", (), (), (), ("the~origin~of~this~software~must~not~be~misrepresented", "altered~source~versions~must~be~plainly~marked")),
    ("libpng", ("libpng~licen[cs]e",), ("libpng", "libpng-2.0"), (), ()),
    ("bsl-1.0", ("boost~software~licen[cs]e(?:~(?:v|version)?~?1(?:~0)?)?",), (), ("boost~org~license",), ()),
    ("bsl-1.0", (), ("bsl-1.0",), (), ()),
    ("bsl-1.1", ("business~source~licen[cs]e(?:~1~1)?",), ("busl-1.1",), (), ()),
    ("artistic-2.0", ("artistic~licen[cs]e~(?:v|version)?~?2(?:~0)?",), ("artistic-2.0",), (), ()),
    ("artistic-1.0", ("artistic~licen[cs]e",), ("artistic-1.0", "artistic-1.0-perl"), (), ()),
    ("psf-2.0", ("python~software~foundation~licen[cs]e(?:~(?:v|version)?~?2)?",), (), (), ()),
    ("psf-2.0", ("psf~licen[cs]e",), ("psf-2.0", "python-2.0"), (), ()),
    ("postgresql", ("postgresql~licen[cs]e",), ("postgresql",), (), ()),
    ("ncsa", ("(?:university~of~illinois~)?ncsa~(?:open~source~)?licen[cs]e",), ("ncsa",), (), ()),
    ("openssl", ("openssl~licen[cs]e",), ("openssl",), (), ()),
    ("ofl-1.1", ("(?:sil~)?open~font~licen[cs]e(?:~(?:v|version)?~?1~1)?",), (), ("scripts~sil~org~ofl",), ()),
    ("ofl-1.1", (), ("ofl-1.1", "ofl-1.0"), (), ()),
    ("eupl-1.2", ("european~union~public~licen[cs]e(?:~(?:v|version)?~?1~2)?",), (), (), ()),
    ("eupl-1.2", ("eupl(?:~v?~?1~2)?",), ("eupl-1.2", "eupl-1.1"), (), ()),
    ("cecill-2.1", ("cecill~(?:v|version)?~?2(?:~1)?", "cecill"), ("cecill-2.1", "cecill-b", "cecill-c"), ("cecill~info",), ()),
    ("osl-3.0", ("open~software~licen[cs]e~(?:v|version)?~?3(?:~0)?",), ("osl-3.0",), (), ()),
    ("afl-3.0", ("academic~free~licen[cs]e~(?:v|version)?~?3(?:~0)?",), ("afl-3.0",), (), ()),
    ("ms-pl", ("microsoft~public~licen[cs]e",), ("ms-pl",), (), ()),
    ("ms-rl", ("microsoft~reciprocal~licen[cs]e",), ("ms-rl",), (), ()),
    ("sspl-1.0", ("server~side~public~licen[cs]e",), ("sspl-1.0",), (), ()),
    ("elastic-2.0", ("elastic~licen[cs]e~(?:v|version)?~?2(?:~0)?", "elastic~licen[cs]e"), ("elastic-2.0",), (), ()),
    ("qpl-1.0", ("q~public~licen[cs]e",), ("qpl-1.0",), (), ()),
    ("vim", ("vim~licen[cs]e",), ("vim",), (), ()),
    ("ruby", ("ruby~licen[cs]e",), ("ruby",), (), ()),
    ("php-3.01", ("php~licen[cs]e(?:~(?:v|version)?~?3(?:~01)?)?",), ("php-3.01",), (), ()),
    ("ijg", ("independent~jpeg~group",), ("ijg",), (), ()),
    ("blueoak-1.0.0", ("blue~oak~model~licen[cs]e",), ("blueoak-1.0.0",), (), ()),
    ("odbl-1.0", ("open~database~licen[cs]e",), ("odbl-1.0",), ("opendatacommons~org~licenses~odbl",), ()),
    ("odc-by-1.0", ("open~data~commons~attribution~licen[cs]e",), ("odc-by-1.0",), ("opendatacommons~org~licenses~by",), ()),
    ("pddl-1.0", ("open~data~commons~public~domain~dedication",), ("pddl-1.0",), ("opendatacommons~org~licenses~pddl",), ()),
    ("cc0-1.0", ("cc0(?:~1~0)?(?:~universal)?",), ("cc0-1.0",), ("creativecommons~org~publicdomain~zero",), ()),
    ("proprietary", (), (), (), ("all~rights~reserved",)),
    ("proprietary", (), (), (), ("proprietary~and~confidential", "unauthorized~copying~of~this~file")),
    ("copyright", (), (), (), ("copyright~(?:c~)?(?:19|20)[0-9]{2}", "copyright~holders?")),
    ("copyright", (), (), (), ("©~(?:19|20)[0-9]{2}",)),
)

#: Creative Commons licences: each clause set has the same rules, by version.
CC_CLAUSES = (("by", "attribution"), ("by-sa", "attribution~share~?alike"), ("by-nd", "attribution~no~?deriv(?:ative)?s?"), ("by-nc", "attribution~non~?commercial"), ("by-nc-sa", "attribution~non~?commercial~share~?alike"), ("by-nc-nd", "attribution~non~?commercial~no~?deriv(?:ative)?s?"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Priorities: an identifier line outranks a grant sentence, that an address, that a name in passing.
IDENTIFIER, GRANT, ADDRESS, NAME = 40, 30, 20, 10
CONFIDENCE = {IDENTIFIER: 0.99, GRANT: 0.95, ADDRESS: 0.85, NAME: 0.7}
#: What may stand between two words: ASCII characters that belong to no word, however many. Runs and words
#: are possessive, so a long one costs its length once.
BETWEEN = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]"
WORD = r"[0-9a-z\x80-\U0010ffff]++(?:_++[0-9a-z\x80-\U0010ffff]++)*+"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    pattern: str


def _spelled(pattern: str) -> str:
    for sign, spelling in (("~\\+", BETWEEN + r"+\+"), ("~?", BETWEEN + "*+"), ("~", BETWEEN + "++"), ("<word>", WORD)):
        pattern = pattern.replace(sign, spelling)
    return r"(?<![0-9a-z])" + pattern + r"(?![0-9a-z])"


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, in order."""
    made: list[Rule] = []
    for label, names, identifiers, addresses, grants in LICENSES:
        for x in identifiers:
            made.append(Rule(label, IDENTIFIER, r"spdx-license-identifier:\s*+" + re.escape(x) + r"(?![0-9a-z.+-])"))
            made.append(Rule(label, IDENTIFIER, r"[\"']?licen[cs]e[\"']?\s*+[:=]\s*+[\"']?" + re.escape(x) + r"(?![0-9a-z.+-])"))
        for x in grants:
            made.append(Rule(label, GRANT, _spelled(x)))
        for x in names:
            made.append(Rule(label, GRANT, _spelled("(?:licensed|released|distributed|available|published)~(?:only~)?under~(?:the~)?(?:terms~(?:and~conditions~)?of~(?:the~)?)?" + x)))
            made.append(Rule(label, NAME, _spelled(x)))
        for x in addresses:
            made.append(Rule(label, ADDRESS, r"https?://(?:www\.)?" + x.replace("~", r"[./-]")))
    for clause, spoken in CC_CLAUSES:
        for version in CC_VERSIONS:
            label, number = f"cc-{clause}-{version}", version.replace(".", "~")
            made.append(Rule(label, IDENTIFIER, r"spdx-license-identifier:\s*+" + re.escape(label) + r"(?![0-9a-z.+-])"))
            made.append(Rule(label, ADDRESS, rf"creativecommons\.org/licenses/{clause}/{re.escape(version)}"))
            made.append(Rule(label, NAME, _spelled(f"creative~commons~{spoken}~{number}")))
            made.append(Rule(label, NAME, _spelled(f"cc~{clause.replace('-', '~')}~{number}")))
        made.append(Rule(f"cc-{clause}", NAME, _spelled(f"creative~commons~{spoken}")))
    made.append(Rule("creative-commons", NAME, _spelled("creative~commons~licen[cs]e")))
    return tuple(made)


def _literals(parsed) -> list[str]:
    """The runs of characters that every match of a parsed pattern spells out."""
    runs = [""]
    for op, of in parsed:
        if op is LITERAL:
            runs[-1] += chr(of)
            continue
        runs.append("")
        if op is SUBPATTERN:
            runs += [*_literals(of[-1]), ""]
        elif op in (MAX_REPEAT, MIN_REPEAT, POSSESSIVE_REPEAT) and of[0] > 0:
            runs += [*_literals(of[2]), ""]
    return [r for r in runs if r]


def _gates(rule: Rule) -> tuple[bytes, ...]:
    """Literals that a match of the rule must hold, read off its own pattern, longest first."""
    needed = {w.encode() for w in _literals(parse(rule.pattern))}
    return tuple(sorted({w for w in needed if len(w) > 1} or needed, key=lambda w: (len(w), w), reverse=True))


@lru_cache(maxsize=1)
def _compiled() -> tuple[ahocorasick.Automaton, dict[bytes, list[tuple[frozenset[bytes], int, Rule, re.Pattern]]]]:
    """An automaton over the rules' longest literals; the rules of each, with all the literals that gate them."""
    by_literal: dict[bytes, list[tuple[frozenset[bytes], int, Rule, re.Pattern]]] = {}
    for k, rule in enumerate(rules()):
        gates = _gates(rule)
        by_literal.setdefault(gates[0], []).append((frozenset(gates), k, rule, re.compile(rule.pattern)))
    automaton = ahocorasick.Automaton()
    for literal in by_literal:
        automaton.add_word(literal.decode(), literal)
    automaton.make_automaton()
    return automaton, by_literal


def detect(lowered: str, data: bytes | None = None) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) in a lower-cased text, after suppression, by start."""
    data = lowered.encode("utf-8", "replace") if data is None else data
    found: list[tuple[int, int, int, Rule]] = []
    automaton, by_literal = _compiled()
    for literal in {word for _, word in automaton.iter(lowered)}:
        for gates, k, rule, pattern in by_literal[literal]:
            if all(g in data for g in gates):
                found += [(m.start(), m.end(), k, rule) for m in pattern.finditer(lowered)]
    found.sort(key=lambda d: (-d[3].priority, d[0] - d[1], d[2], d[0]))
    return sorted(_maximal(found), key=lambda d: (d[0], d[1], d[2].label))


def _maximal(found: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Drop intervals inside one that came before. The kept ones form a staircase: starts and ends both rise."""
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    ends: list[int] = []
    for start, end, _, rule in found:
        k = bisect_left(starts, start + 1) - 1  # last kept start <= start; its end is the largest among those
        if k >= 0 and ends[k] >= end:
            continue
        kept.append((start, end, rule))
        at = bisect_left(starts, start)
        stop = at
        while stop < len(ends) and ends[stop] <= end:  # steps that the new one covers say nothing more
            stop += 1
        starts[at:stop], ends[at:stop] = [start], [end]
    return kept


_TO_MASK = bytes(ord("a") if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else ord(" ") for b in range(256))
_PHRASES = [(re.compile(rb"(?<![0-9a-z\x80-\xff])" + rb"[^0-9a-z\x80-\xff]+".join(w.encode() for w in words) + rb"(?![0-9a-z\x80-\xff])"), label) for words, label in BASE_PHRASES]


def scan_text(text: str | None) -> dict:
    """Everything that is reported about one text."""
    data = (text or "").encode("utf-8", "replace").lower()  # bytes.lower touches A-Z alone
    mask = b" " + data.translate(_TO_MASK)
    n_words = mask.count(b" a")
    places: list[int] = []
    base: set[str] = set()
    if b"license" in data:
        word_starts = None
        for pattern, label in _PHRASES:
            hits = [m.start() for m in pattern.finditer(data)]
            if hits:
                if word_starts is None:
                    flags = np.frombuffer(mask, np.uint8) == ord("a")
                    word_starts = np.flatnonzero(flags[1:] & ~flags[:-1])
                base.add(label)
                places += np.searchsorted(word_starts, hits).tolist()
    found = detect(data.decode("utf-8"), data)
    labels = base | {rule.label for _, _, rule in found}
    best = max((CONFIDENCE[rule.priority] for _, _, rule in found), default=0.7 if base else 0.0)
    return {
        "n_words": n_words, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": best,
        "detections": [{"label": r.label, "start": s, "end": e, "priority": r.priority} for s, e, r in found],
    }


SCAN_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:long,end:long,priority:int>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, word and phrase counts, labels, score and the detections' places."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            made = [scan_text(text) for text in batch.column("text").to_pylist()]
            columns = [batch.column("id")] + [pa.array([m[f.name] for m in made], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *(f.name for f in fields)])

    detection = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32())])
    fields = [pa.field(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")] + [pa.field("base_labels", pa.string()), pa.field("labels", pa.string()), pa.field("score", pa.float64()), pa.field("detections", pa.list_(detection))]
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(in_slices(run), f"id {id_type}, {SCAN_SCHEMA}").withColumnRenamed("id", id_col)
