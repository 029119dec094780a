"""Licence scan: ordered signature rules over the words of a text.

All of it is expressions on the row: texts without the words of any rule are only counted.
"""

from __future__ import annotations

import json
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwatch.llm.common import table, text_of

# The phrases of the base and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
NOT_WORD_RAW = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # before capitals are made small


@dataclass(frozen=True)
class Rule:
    """A regex over small-lettered words with one blank between them; a lower ``priority`` goes first."""

    name: str
    label: str
    priority: int
    keyword: str
    pattern: str
    confidence: float
    gate: str = ""  # regex of words that every match has; the keyword if empty


# label, keyword that every text with it has, name as a regex, versions as a regex or "".
FAMILIES = [
    ("gpl", "gpl", r"(?:gnu )?gpl", r"v?[123](?: 0)?"),
    ("gpl", "general public", r"(?:gnu )?general public", r"v?[123](?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", r"v?[23](?: [01])?"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public", r"v?[23](?: [01])?"),
    ("lgpl", "library general", r"(?:gnu )?library general public", r"v?2(?: 0)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl", r"v?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public", r"v?3(?: 0)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", r"v?1(?: [123])?"),
    ("apache", "apache", r"apache(?: software)?", r"v?[12](?: [01])?"),
    ("mit", "mit", r"mit", ""),
    ("mit", "expat", r"expat", ""),
    ("mit", "x11", r"x11", ""),
    ("bsd", "bsd", r"(?:new |simplified |modified |original )?bsd", r"[0234] clause"),
    ("isc", "isc", r"isc", ""),
    ("mpl", "mpl", r"mpl", r"v?[12](?: [01])?"),
    ("mpl", "mozilla", r"mozilla public", r"v?[12](?: [01])?"),
    ("epl", "eclipse", r"eclipse public", r"v?[12](?: 0)?"),
    ("cddl", "common development", r"common development and distribution", r"v?1(?: [01])?"),
    ("cpl", "common public", r"common public", r"v?1(?: 0)?"),
    ("eupl", "european union", r"european union public", r"v?1(?: [012])?"),
    ("artistic", "artistic", r"artistic", r"v?[12](?: 0)?"),
    ("boost", "boost", r"boost software", r"v?1(?: 0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?", ""),
    ("python", "python", r"python software foundation", r"v?2(?: 0)?"),
    ("php", "php", r"php", r"v?3(?: 0[01])?"),
    ("wtfpl", "wtfpl", r"wtfpl", r"v?2"),
    ("unlicense", "unlicense", r"unlicense", ""),
    ("openssl", "openssl", r"openssl", ""),
    ("ofl", "open font", r"(?:sil )?open font", r"v?1(?: [01])?"),
    ("odbl", "open database", r"open database", r"v?1(?: 0)?"),
    ("postgresql", "postgresql", r"postgresql", ""),
    ("ms-pl", "microsoft public", r"microsoft public", ""),
    ("bsl", "business source", r"business source", r"v?1(?: 1)?"),
    ("elastic", "elastic", r"elastic", r"v?2(?: 0)?"),
    ("cc-by", "creative commons", r"creative commons attribution", r"v?[1234](?: [05])?"),
    ("cc-by-sa", "sharealike", r"(?:creative commons )?attribution sharealike", r"v?[1234](?: [05])?"),
    ("cc-by-nc", "noncommercial", r"(?:creative commons )?attribution noncommercial", r"v?[1234](?: [05])?"),
    ("cc-by-nd", "noderiv", r"(?:creative commons )?attribution noderiv(?:s|atives)", r"v?[1234](?: [05])?"),
]
# form, priority, confidence, words that every text with it has, regex around the name; {v} stands for the version.
LICENCE, RELEASED = "licen[cs]e", "(?:released|distributed|available|published) under"
FORMS = [
    ("identifier", 0, 1.0, LICENCE, r"spdx license identifier {n}(?: {v})?(?: only| or later)?"),
    ("grant", 1, 0.95, LICENCE, r"licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{n}(?: licen[cs]e)?"),
    ("grant-version", 1, 0.98, LICENCE, r"licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{n}(?: licen[cs]e)?(?: version)? {v}"),
    ("release", 1, 0.95, RELEASED, RELEASED + r" (?:the )?(?:terms of (?:the )?)?{n}(?: licen[cs]e)?"),
    ("subject", 1, 0.9, LICENCE, r"subject to (?:the )?(?:terms of (?:the )?)?{n} licen[cs]e"),
    ("versioned", 2, 0.9, LICENCE, r"{n} licen[cs]e(?: version)? {v}"),
    ("named", 3, 0.8, LICENCE, r"{n} licen[cs]e"),
    ("reversed", 3, 0.7, LICENCE, r"licen[cs]e {n}"),
]
# Rules of their own; words that stand for no family by name.
SINGLE = [
    Rule("cc-by", "cc-by", 3, "cc by", r"cc by", 0.8),
    Rule("cc-by-version", "cc-by", 2, "cc by", r"cc by [1234] [05]", 0.95),
    Rule("cc-by-sa", "cc-by-sa", 2, "cc by sa", r"cc by sa(?: [1234] [05])?", 0.95),
    Rule("cc-by-nc", "cc-by-nc", 2, "cc by nc", r"cc by nc(?: [1234] [05])?", 0.95),
    Rule("cc-by-nd", "cc-by-nd", 2, "cc by nd", r"cc by nd(?: [1234] [05])?", 0.95),
    Rule("cc-by-nc-sa", "cc-by-nc-sa", 1, "cc by nc sa", r"cc by nc sa(?: [1234] [05])?", 0.95),
    Rule("cc-by-nc-nd", "cc-by-nc-nd", 1, "cc by nc nd", r"cc by nc nd(?: [1234] [05])?", 0.95),
    Rule("cc0", "cc0", 2, "cc0", r"cc0(?: 1 0)?(?: universal)?", 0.95),
    Rule("cc-link", "cc-by", 1, "creativecommons org", r"creativecommons org licenses by(?: [1234] [05])?", 0.98),
    Rule("cc-sa-link", "cc-by-sa", 0, "creativecommons org", r"creativecommons org licenses by sa(?: [1234] [05])?", 0.98),
    Rule("cc-nc-link", "cc-by-nc", 0, "creativecommons org", r"creativecommons org licenses by nc(?: [1234] [05])?", 0.98),
    Rule("cc-nd-link", "cc-by-nd", 0, "creativecommons org", r"creativecommons org licenses by nd(?: [1234] [05])?", 0.98),
    Rule("gnu-link", "gpl", 1, "gnu org licenses", r"gnu org licenses (?:old licenses )?gpl(?: [123] 0)?", 0.95),
    Rule("apache-link", "apache", 1, "apache org licenses", r"apache org licenses license 2 0", 0.98),
    Rule("mit-grant", "mit", 0, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 0.98),
    Rule("isc-grant", "isc", 0, "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose", 0.95),
    Rule("bsd-grant", "bsd", 0, "redistribution and use", r"redistribution and use in source and binary forms with or without modification", 0.98),
    Rule("gpl-grant", "gpl", 0, "free software", r"this program is free software you can redistribute it and or modify it", 0.98),
    Rule("public-domain", "public-domain", 2, "public domain", r"(?:released into|dedicated to|placed in|in) the public domain", 0.8),
    Rule("reserved", "all-rights-reserved", 3, "all rights reserved", r"all rights reserved", 0.6),
    # Sentences of the licences' own texts and notices.
    Rule("gpl-warranty", "gpl", 1, "implied warranty of merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", 0.95),
    Rule("gpl-copy", "gpl", 1, "you should have received a copy", r"you should have received a copy of the gnu general public license", 0.95),
    Rule("lgpl-copy", "lgpl", 1, "you should have received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public license", 0.95),
    Rule("agpl-copy", "agpl", 1, "you should have received a copy", r"you should have received a copy of the gnu affero general public license", 0.95),
    Rule("gfdl-grant", "gfdl", 1, "permission is granted to copy", r"permission is granted to copy distribute and or modify this document", 0.95),
    Rule("apache-notice", "apache", 1, "you may not use this file except", r"you may not use this file except in compliance with the license", 0.9),
    Rule("apache-as-is", "apache", 2, "agreed to in writing", r"unless required by applicable law or agreed to in writing software distributed under the license", 0.85),
    Rule("mit-notice", "mit", 2, "permission notice shall be included", r"the above copyright notice and this permission notice shall be included in all copies", 0.85),
    Rule("mit-as-is", "mit", 3, "provided as is without warranty", r"the software is provided as is without warranty of any kind", 0.6),
    Rule("isc-as-is", "isc", 1, "author disclaims all warranties", r"the software is provided as is and the author disclaims all warranties", 0.9),
    Rule("bsd-endorse", "bsd", 2, "used to endorse or promote", r"may be used to endorse or promote products derived from this software", 0.85),
    Rule("bsd-source", "bsd", 2, "redistributions of source code", r"redistributions of source code must retain the above copyright notice", 0.85),
    Rule("bsd-advert", "bsd", 2, "advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display", 0.9),
    Rule("mpl-form", "mpl", 1, "source code form is subject", r"this source code form is subject to the terms of the mozilla public license", 0.98),
    Rule("mpl-file", "mpl", 1, "contents of this file are subject", r"the contents of this file are subject to the mozilla public license", 0.95),
    Rule("cddl-file", "cddl", 1, "contents of this file are subject", r"the contents of this file are subject to the terms of the common development and distribution license", 0.95),
    Rule("epl-notice", "epl", 1, "accompanying materials are made available", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 0.95),
    Rule("eupl-notice", "eupl", 1, "under the eupl", r"licen[cs]ed under the eupl", 0.95),
    Rule("zlib-marked", "zlib", 1, "altered source versions", r"altered source versions must be plainly marked as such", 0.95),
    Rule("zlib-origin", "zlib", 1, "origin of this software", r"the origin of this software must not be misrepresented", 0.9),
    Rule("boost-grant", "boost", 1, "obtaining a copy of the software and accompanying", r"obtaining a copy of the software and accompanying documentation covered by this license", 0.95),
    Rule("unlicense-grant", "unlicense", 0, "free and unencumbered", r"this is free and unencumbered software(?: released into the public domain)?", 0.98),
    Rule("wtfpl-grant", "wtfpl", 0, "do what the fuck you want", r"do what the fuck you want to(?: public license)?", 0.98),
    Rule("cc0-waiver", "cc0", 1, "waived all copyright", r"has waived all copyright and related or neighboring rights", 0.95),
    Rule("cc0-link", "cc0", 0, "creativecommons org", r"creativecommons org publicdomain zero 1 0", 0.98),
    Rule("ofl-name", "ofl", 1, "reserved font name", r"with reserved font name", 0.9),
    Rule("python-psf", "python", 1, "psf license agreement", r"psf license agreement(?: for python)?", 0.95),
    Rule("php-notice", "php", 1, "subject to version", r"this source file is subject to version [23] 0[01]? of the php license", 0.95),
    Rule("openssl-credit", "openssl", 1, "openssl toolkit", r"for use in the openssl toolkit", 0.9),
    Rule("artistic-perl", "artistic", 1, "same terms as perl", r"(?:under|on) the same terms as perl(?: itself)?", 0.8),
    Rule("odbl-notice", "odbl", 1, "made available under the open database", r"is made available under the open database license", 0.95),
    Rule("confidential", "proprietary", 2, "proprietary and confidential", r"proprietary and confidential", 0.8),
    Rule("no-copying", "proprietary", 2, "unauthorized copying", r"unauthorized copying of this file", 0.8),
    Rule("copyright", "copyright", 4, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", 0.5),
]
PRIORITIES = 5


def rules() -> Iterator[Rule]:
    """All signatures: every family in every form that its versions allow, then the single ones."""
    for label, keyword, name, version in FAMILIES:
        for form, priority, confidence, gate, pattern in FORMS:
            if version or "version" not in form:
                spelled = pattern.replace("(?: {v})?", "") if not version else pattern
                yield Rule(f"{label}-{form}", label, priority, keyword, spelled.replace("{n}", name).replace("{v}", version), confidence, gate)
    yield from SINGLE


def _gate() -> str:
    """A regex over raw texts that finds the gate words of every rule and base phrase, whatever stands between words."""
    between = rf"[{NOT_WORD_RAW}]"
    needed = dict.fromkeys([r.gate or r.keyword for r in rules()] + list(PHRASES))
    return rf"(?:^|{between})(?i:{'|'.join(needed)})".replace(" ", f"{between}+")


GATE = _gate()


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def running(items: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each item joined with all before it, in doubling strides: n log n steps, where appending to an array copies it n times."""
    def scan(first: Column) -> Column:
        strides = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.size(first)))), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.aggregate(strides, first, lambda now, by: F.transform(now, lambda x, i: F.coalesce(join(F.get(now, i - by), x), x)))

    return F.get(F.transform(F.array(items), scan), F.lit(0))


def places(spaced: Column, pattern: Column) -> Column:
    """Word ranges (start, end) of a rule's matches, from left to right; ``spaced`` has a blank before and after every word.

    Every match starts where the last one ended (``\\G``), so a text is read once.
    """
    whole = F.concat(F.lit(r"(?s)\G(.*?) (?:"), pattern, F.lit(")(?= )"))
    found = F.arrays_zip(
        F.transform(F.regexp_extract_all(spaced, whole, F.lit(1)), _blanks).alias("gap"),
        F.transform(F.regexp_extract_all(spaced, whole, F.lit(0)), _blanks).alias("both"),
    )
    at = lambda matches: F.zip_with(
        running(F.transform(matches, lambda m: m["both"]), lambda a, b: a + b), matches,
        lambda end, m: F.struct((end - m["both"] + m["gap"]).alias("start"), end.alias("end")))
    return F.get(F.transform(F.array(found), at), F.lit(0))


def _rule_array() -> Column:
    """The rules as one constant; hundreds of literals would keep the optimizer busy for a minute."""
    return F.from_json(F.lit(json.dumps([vars(r) for r in rules()])),
                       "array<struct<label:string,priority:int,keyword:string,pattern:string,confidence:double>>")


def _unsuppressed(found: Column) -> Column:
    """Less the detections inside one of the same or an earlier priority.  ``found`` is ordered by start, then falling end.

    The furthest end so far of each priority says whether a later detection lies inside.
    """
    own = F.transform(found, lambda d: F.transform(
        F.sequence(F.lit(0), F.lit(PRIORITIES - 1)), lambda p: F.when(p == d["priority"], d["end"]).otherwise(F.lit(-1))))
    furthest = running(own, lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    reach = lambda ends, d: F.coalesce(F.array_max(F.slice(ends, F.lit(1), d["priority"] + 1)), F.lit(-1))
    kept = lambda ends: F.filter(found, lambda d, i: reach(F.get(ends, i - 1), d) < d["end"])
    return F.get(F.transform(F.array(furthest), kept), F.lit(0))


def detections(spaced: Column) -> Column:
    """Detections that stay, by start: (start, end, label, confidence, ...)."""
    gated = F.filter(_rule_array(), lambda r: F.contains(spaced, F.concat(F.lit(" "), r["keyword"])))
    found = F.flatten(F.transform(gated, lambda r: F.transform(places(spaced, r["pattern"]), lambda p: F.struct(
        p["start"].alias("start"), (-p["end"]).alias("falling"), r["priority"].alias("priority"), r["label"].alias("label"),
        r["confidence"].alias("confidence"), p["end"].alias("end")))))
    return F.get(F.transform(F.array(F.array_sort(found)), _unsuppressed), F.lit(0))


def scan_licences(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``base`` (word ranges with labels) and ``spans`` (detections of the rules).

    A text without the gate words of any rule has only its words counted; no
    rule can match there.  The others are made small and spaced once; each rule whose keyword occurs is
    matched; a detection inside another of the same or an earlier priority is
    suppressed.  Nothing is shuffled.

    Null texts are empty and have no detections; null ids, repeated rows and
    an empty table need no care; other columns are ignored.
    """
    text = text_of()
    small = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    spaced = F.concat(F.lit(" "), F.btrim(F.regexp_replace(small, rf"[{NOT_WORD}]+", " ")), F.lit(" "))

    def labelled(label: str) -> Callable[[Column], Column]:
        return lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(label).alias("label"))

    def scan(s: Column) -> Column:
        base = F.flatten(F.array(*[F.transform(places(s, F.lit(phrase)), labelled(label)) for phrase, label in PHRASES.items()]))
        return F.struct(F.array_sort(base).alias("base"), detections(s).alias("spans"))

    found = F.when(F.regexp_like(text, F.lit(GATE)), F.get(F.transform(F.array(spaced), scan), F.lit(0)))
    counted = F.regexp_count(text, F.lit(rf"[^{NOT_WORD_RAW}]+")).cast("long")
    return docs.select("doc_id", counted.alias("n_words"), found.alias("found")).select("doc_id", "n_words", "found.base", "found.spans")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    found = scan_licences(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda b: b["start"])
    none = F.array().cast("array<string>")
    of_base = F.coalesce(F.transform("base", lambda b: b["label"]), none)
    of_rules = F.coalesce(F.transform("spans", lambda s: s["label"]), none)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(of_base).alias("base_labels"),
        joined(F.concat(of_base, of_rules)).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["confidence"])), F.lit(0.0)).alias("score"),
    )
