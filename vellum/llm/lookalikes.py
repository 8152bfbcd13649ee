"""Visually identical text with different characters, brought to one consistent form.

The characters of a text are examined once each (a text has few distinct ones), so the cost hangs on the text's
length only through C-speed scans. Spaces of other kinds become U+0020, invisible format characters vanish,
full-width forms and styled letters and digits become plain, the whole is composed (NFC). Then every run
of letters gets its resolved script set: the intersection of the sets of scripts in which each letter could be
spelled, itself or by a look-alike. A run that mixes Latin with Greek or Cyrillic is rewritten in the script that
the set leaves; if more than one is left, in the text's main script if that is among them, else in the one with more
of the run's own letters; if none, its look-alikes go to the script of the majority as far as they have one there.
"""

from __future__ import annotations

import bisect
import sys
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.runtime import shared

# Letters of like look that the public list of confusables lacks or joins otherwise, as (Latin, Greek, Cyrillic);
# "-" where a script has no such letter.
LOOK_ALIKES = """
A Α А; B Β В; C - С; E Ε Е; F Ϝ -; H Η Н; I Ι І; J Ϳ Ј; K Κ К; M Μ М; N Ν -; O Ο О; P Ρ Р; S - Ѕ; T Τ Т; V - Ѵ; X Χ Х; Y Υ У; Z Ζ -;
a α а; c ϲ с; d - ԁ; e - е; g - ԍ; h - һ; i ι і; j ϳ ј; k κ к; l - ӏ; o ο о; p ρ р; q - ԛ; r - г; s - ѕ; u υ -; v ν ѵ; w ω ԝ; x χ х; y γ у;
Ä - Ӓ; Ë - Ё; Ï Ϊ Ї; Ö - Ӧ; ä - ӓ; ë - ё; ï ϊ ї; ö - ӧ; È - Ѐ; è - ѐ; ó ό -; í ί -; - Γ Г; - Λ Л; - Π П; - Φ Ф
"""
SCRIPTS = ("Latin", "Greek", "Cyrillic")


class Tables(NamedTuple):
    """What is known of letters: their spellings in other scripts, and their own scripts by ranges of code points."""

    alike: dict[str, dict[str, str]]
    starts: list[int]
    scripts: list[str]  # of the letters from the start at the same place on; "" where none or several
    shared: dict[str, frozenset[str]]  # letters that several scripts use

    def script(self, c: str) -> str:
        return self.scripts[bisect.bisect_right(self.starts, ord(c)) - 1]

    def spellings(self, c: str) -> frozenset[str] | set[str] | None:
        """Scripts in which the letter could be spelled; None if it restricts nothing."""
        if c in self.shared:
            return self.shared[c]
        own = self.script(c)
        return {own, *self.alike.get(c, ())} if own else None


def _letters() -> list[str]:
    return [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L"]


def _ranges(letters: list[str], script_of: dict[str, str]) -> tuple[list[int], list[str]]:
    starts, scripts = [0], [""]
    for c in letters:
        if script_of.get(c, "") != scripts[-1]:
            starts.append(ord(c))
            scripts.append(script_of.get(c, ""))
    return starts, scripts


def _typed(alike: dict[str, dict[str, str]]) -> dict[str, dict[str, str]]:
    for row in LOOK_ALIKES.replace("\n", " ").split(";"):
        forms = {s: c for s, c in zip(SCRIPTS, row.split(), strict=True) if c != "-"}
        for c in forms.values():
            alike[c] = {**alike.get(c, {}), **forms}
    return alike


_fixed: list[Tables] = []  # made once; a decorator that caches would be sent to workers by name, not by value
_public: list[Tables] = []


def typed_tables() -> Tables:
    """The three scripts and the fixed look-alikes alone."""
    if not _fixed:
        letters = _letters()
        own = {c: s for s in SCRIPTS for c in regex.findall(r"\p{%s}" % s, "".join(letters))}
        _fixed.append(Tables(_typed({}), *_ranges(letters, own), {}))
    return _fixed[0]


def public_tables(spark: SparkSession) -> Tables:
    """All scripts and Unicode's list of confusables, which Spark's own library of Unicode data (ICU) holds, with the fixed look-alikes.

    Letters of one skeleton look alike; in another script the one of the same category with the least code point is the
    spelling. Where the library is out of reach (no JVM beside the driver) that is an error, as the fixed look-alikes alone would
    give other texts; who wants those takes :func:`typed_tables`.
    """
    if not _public:
        try:
            jvm = spark._jvm
            skeletons = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton
            names = [str(x.name()) for x in jvm.java.lang.Character.UnicodeScript.values()]
        except (AttributeError, TypeError, Py4JError) as e:
            raise RuntimeError("look-alikes need Unicode's confusables, but Spark's ICU library can't be reached from here") from e
        letters = _letters()
        joined, own, uses = "".join(letters), {}, {}
        for name in sorted(set(names) - {"COMMON", "INHERITED", "UNKNOWN"}):
            title = name.title()
            # a script that is unknown here is an error too: its letters would pass for letters of no script
            members, users = regex.compile(r"\p{Script=%s}" % name), regex.compile(r"\p{Script_Extensions=%s}" % name)
            own.update((c, title) for c in members.findall(joined))
            for c in users.findall(joined):
                uses.setdefault(c, set()).add(title)
        kinds: dict[str, list[str]] = {}
        for c, skeleton in zip(letters, skeletons("\n".join(letters)).split("\n"), strict=True):
            if c in own and unicodedata.is_normalized("NFKC", c):
                kinds.setdefault(skeleton, []).append(c)
        alike: dict[str, dict[str, str]] = {}
        for group in kinds.values():
            if len({own[c] for c in group}) > 1:
                for c in group:
                    same = [x for x in group if unicodedata.category(x) == unicodedata.category(c)]
                    forms = {own[x]: x for x in sorted(same, reverse=True)}
                    forms[own[c]] = c
                    if len(forms) > 1:
                        alike[c] = forms
        shared = {c: frozenset(u) for c, u in uses.items() if len(u) > 1}
        _public.append(Tables(_typed(alike), *_ranges(letters, own), shared))
    return _public[0]


RUN = regex.compile(r"\p{L}+")
FOREIGN_RUN = regex.compile(r"(?<!\p{L})[\p{Greek}\p{Cyrillic}]\p{L}*")
MIXABLE = regex.compile(r"[\p{Greek}\p{Cyrillic}]")
LATIN = regex.compile(r"\p{Latin}")
BY_SCRIPT = {s: regex.compile(r"\p{%s}" % s) for s in SCRIPTS}
PLAIN = {"Lu", "Ll", "Lt", "Nd"}

FINDINGS = ("space", "invisible", "width", "styled", "decomposed", "mixed")

# What is known of single characters; there are no more than Unicode has.
_seen: dict[str, tuple[str, str] | None] = {}


def odd_character(c: str) -> tuple[str, str] | None:
    """(finding, replacement) of a character that has an ordinary form, else None."""
    kind = unicodedata.category(c)
    if kind == "Zs":
        return None if c == " " else ("space", " ")
    if kind == "Cf":
        return "invisible", ""
    if "＀" <= c <= "￯":
        return "width", unicodedata.normalize("NFKC", c)
    if kind in PLAIN and (to := unicodedata.normalize("NFKC", c)) != c:
        return "styled", to
    return None


def is_mixed(run: str) -> bool:
    return bool(LATIN.search(run) and MIXABLE.search(run))


def resolved_scripts(run: str, known: Tables | None = None) -> set[str]:
    """Scripts in which the whole run could be spelled; letters of no named script restrict nothing."""
    known = known or typed_tables()
    left: set[str] | None = None
    for c in set(run):
        forms = known.spellings(c)
        if forms is not None:
            left = set(forms) if left is None else left & forms
    return set(SCRIPTS) if left is None else left


def main_script(text: str) -> str:
    """The script of most of the text's letters, of those that are mixed up."""
    return max(SCRIPTS, key=lambda s: len(BY_SCRIPT[s].findall(text)))


def respelled(run: str, main: str, known: Tables | None = None) -> str:
    """A mixed run in one script, as far as look-alikes allow, in the text's ``main`` script if there is a choice."""
    known = known or typed_tables()
    own = [known.script(c) for c in run]
    left = resolved_scripts(run, known)
    there = [s for s in dict.fromkeys([*SCRIPTS, *own]) if s and s in own]
    # a letter without a look-alike weighs most: it shows the script that was meant
    weigh = {s: (s in left, s == main and s in left, sum(o == s and len(known.alike.get(c, ())) < 2 for o, c in zip(own, run, strict=True)), own.count(s), -i) for i, s in enumerate(there)}
    to = max(there, key=lambda s: weigh[s])
    return "".join(known.alike.get(c, {}).get(to, c) for c in run)


def whole_script_confusable(run: str, around: str, known: Tables | None = None) -> bool:
    """True if the run, in one script, could be spelled whole in ``around``, the text's main script."""
    known = known or typed_tables()
    # most words fail at their first letter
    first = known.script(run[0])
    if first == around or (first and around not in known.alike.get(run[0], ())):
        return False
    own = {known.script(c) for c in run} - {""}
    return len(own) == 1 and around not in own and around in resolved_scripts(run, known)


def consistent(text: str | None, count_whole: bool = False, known: Tables | None = None, respell_whole: bool = False) -> tuple[str | None, int, int]:
    """(text in consistent form, findings as bits in the order of FINDINGS, whole-script confusable words if counted).

    Null stays null and the empty text empty, both without findings. With ``respell_whole`` whole-script confusable words are
    spelled in the text's main script too; they are no finding.
    """
    if not text or text.isascii():
        return text, 0, 0
    known = known or typed_tables()
    found, seen = 0, _seen
    letters = set(text)
    swaps = []
    for c in letters:
        if c < "\x80":
            continue
        if c not in seen:
            seen[c] = odd_character(c)
        if (odd := seen[c]) is not None:
            found |= 1 << FINDINGS.index(odd[0])
            swaps.append((c, odd[1]))
    if not unicodedata.is_normalized("NFC", text):
        found |= 1 << FINDINGS.index("decomposed")
    foreign = any("Ͱ" <= c <= "῿" or c > "ꀀ" for c in letters) and MIXABLE.search(text) is not None
    if foreign and LATIN.search(text) and any(is_mixed(m.group()) for m in RUN.finditer(text) if not m.group().isascii()):
        found |= 1 << FINDINGS.index("mixed")
    for c, to in swaps:
        text = text.replace(c, to)
    text = unicodedata.normalize("NFC", text)
    whole = 0
    if foreign:
        # invisible characters may have split a run, so runs are taken again from the cleaned text
        main = main_script(text)
        text = RUN.sub(lambda m: respelled(m.group(), main, known) if not m.group().isascii() and is_mixed(m.group()) else m.group(), text)
        if count_whole or respell_whole:
            # of a text in Latin script only its words in other scripts can be meant
            runs = FOREIGN_RUN if main == "Latin" else RUN
            hits = [m for m in runs.finditer(text) if whole_script_confusable(m.group(), main, known)]
            whole = len(hits)
            if respell_whole:
                for m in reversed(hits):
                    text = text[: m.start()] + "".join(known.alike.get(c, {}).get(main, c) for c in m.group()) + text[m.end() :]
        text = unicodedata.normalize("NFC", text)
    return text, found, whole


def _normalize(tables, respell_whole: bool):
    """Columns: the id, the text, any others; the text is replaced, its findings are appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables()
        for b in batches:
            # long texts are handled a few at a time
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                made = [consistent(x, True, known, respell_whole) for x in part.column(0).to_pylist()]
                cols = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
                yield pa.record_batch([*part.columns[1:], *cols], names=[*part.schema.names[1:], "consistent_text", "findings", "n_whole_script"])

    return run


def consistent_text(df: DataFrame, text: str, keep: list[str], respell_whole: bool = False) -> DataFrame:
    """Columns ``keep`` of each row with ``consistent_text``, ``findings`` and ``n_whole_script``.

    findings is a bit set in the order of FINDINGS; 0 means that the text already is in consistent form. A null text
    gives a null form, the empty text the empty form, both without findings. Every row gives one row, repeated rows
    too. Columns other than ``keep`` and ``text`` are pruned; ``keep`` must not hold the three names above. With
    ``respell_whole`` words wholly in another script that could be spelled in the text's main script are so spelled; by
    default they are counted and stay. Nothing is shuffled: texts pass through Python workers in Arrow batches, whole.
    """
    spark = df.sparkSession
    tables = shared(spark, public_tables(spark))  # bounded by Unicode
    source = df.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{k}`") for k in keep])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return source.mapInArrow(_normalize(tables, respell_whole), f"{kept}{', ' if kept else ''}consistent_text string, findings int, n_whole_script int")


def finding_names(findings: str = "findings"):
    """The bit set as an array of names."""
    return F.filter(F.array(*[F.when(F.col(findings).bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(FINDINGS)]), lambda x: x.isNotNull())
