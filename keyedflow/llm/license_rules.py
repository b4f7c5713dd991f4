"""Signature rules of licenses: hundreds of regular expressions over normalised words.

A rule's pattern is matched against text in lower case whose words stand between single spaces,
with a space at both ends; it starts with a space and ends before one. The prefilter: every match
holds one of the words ``keywords`` and all the pieces of text ``needs``. ``tier`` is the priority,
1 before 3.
The forms below are written by hand for every name; names that follow a scheme (Creative
Commons, versions) are spelled out by it.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keywords: list[str]
    needs: list[str]
    pattern: str
    tier: int
    weight: float
    base: bool = False


#: The phrases that count as base, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

LICENSE = "licen[sc]e"
GRANT = (
    "(?:licensed|released|distributed|available|published|provided|redistributed|covered|governed|shared|used)"
    "(?: [^ ]+)? (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?"
)


def version(major: str, minor: str = "0") -> str:
    """A version in words: ``version 2 0``, ``v2``, ``2 0``."""
    last = f"(?: {minor})?" if minor == "0" else f" {minor}"
    return f"(?: version)?(?: v| v | ){major}{last}"


def _gnu(label: str, kind: str, short: str, major: str, minor: str = "0") -> tuple:
    long_name = f"(?:gnu )?{kind}general public {LICENSE}(?: {short})?{version(major, minor)}(?: or(?: at your option any)? later)?"
    return label, label.replace("-", " ").replace(".", " "), [
        ("general public", long_name),
        (f"{short}", f"(?:gnu )?{short}{version(major, minor)}(?: or later)?"),
        (f"{short}v{major}", f"(?:gnu )?{short}v{major}(?: {minor})?"),
    ]


#: Label, identifier in words, and names with the anchor that each of them holds.
FAMILIES: list[tuple[str, str, list[tuple[str, str]]]] = [
    ("mit", "mit", [(" mit ", f"(?:the )?mit(?: style| x11)? {LICENSE}"), ("expat", f"expat {LICENSE}")]),
    ("mit-0", "mit 0", [("no attribution", f"mit no attribution(?: {LICENSE})?")]),
    ("x11", "x11", [(" x11 ", f"x11 {LICENSE}")]),
    ("isc", "isc", [(" isc ", f"isc {LICENSE}")]),
    ("apache-1.0", "apache 1 0", [("apache", f"apache(?: software)? {LICENSE}{version('1')}")]),
    ("apache-1.1", "apache 1 1", [("apache", f"apache(?: software)? {LICENSE}{version('1', '1')}")]),
    ("apache-2.0", "apache 2 0", [("apache", f"apache(?: software)?(?: {LICENSE})?{version('2')}(?: {LICENSE})?")]),
    ("bsd-1-clause", "bsd 1 clause", [(" bsd ", f"(?:1|one) clause bsd(?: {LICENSE})?")]),
    ("bsd-2-clause", "bsd 2 clause", [(" bsd ", f"(?:2|two) clause bsd(?: {LICENSE})?"), ("simplified bsd", f"simplified bsd(?: {LICENSE})?"), ("freebsd", f"freebsd {LICENSE}")]),
    ("bsd-3-clause", "bsd 3 clause", [(" bsd ", f"(?:3|three) clause bsd(?: {LICENSE})?"), ("new bsd", f"new bsd {LICENSE}"), ("modified bsd", f"modified bsd {LICENSE}")]),
    ("bsd-4-clause", "bsd 4 clause", [(" bsd ", f"(?:4|four) clause bsd(?: {LICENSE})?"), ("original bsd", f"original bsd {LICENSE}")]),
    ("bsd", "bsd", [(" bsd ", f"bsd(?: style)? {LICENSE}")]),
    ("0bsd", "0bsd", [("zero clause", f"zero clause bsd(?: {LICENSE})?")]),
    _gnu("gpl-1.0", "", "gpl", "1"),
    _gnu("gpl-2.0", "", "gpl", "2"),
    _gnu("gpl-3.0", "", "gpl", "3"),
    _gnu("lgpl-2.0", "(?:lesser|library) ", "lgpl", "2"),
    _gnu("lgpl-2.1", "(?:lesser|library) ", "lgpl", "2", "1"),
    _gnu("lgpl-3.0", "lesser ", "lgpl", "3"),
    _gnu("agpl-3.0", "affero ", "agpl", "3"),
    ("gpl", "gpl", [(" gpl ", f"(?:gnu )?gpl(?: {LICENSE})?"), ("general public", f"gnu general public {LICENSE}")]),
    ("lgpl", "lgpl", [(" lgpl ", f"(?:gnu )?lgpl(?: {LICENSE})?"), ("lesser general", f"(?:gnu )?lesser general public {LICENSE}"), ("library general", f"(?:gnu )?library general public {LICENSE}")]),
    ("agpl", "agpl", [(" agpl ", f"(?:gnu )?agpl(?: {LICENSE})?"), ("affero", f"(?:gnu )?affero general public {LICENSE}")]),
    ("gfdl-1.2", "gfdl 1 2", [("free documentation", f"(?:gnu )?free documentation {LICENSE}{version('1', '2')}")]),
    ("gfdl-1.3", "gfdl 1 3", [("free documentation", f"(?:gnu )?free documentation {LICENSE}{version('1', '3')}")]),
    ("gfdl", "gfdl", [("free documentation", f"(?:gnu )?free documentation {LICENSE}"), (" gfdl ", "(?:gnu )?gfdl")]),
    ("mpl-1.0", "mpl 1 0", [("mozilla", f"mozilla public {LICENSE}{version('1')}"), (" mpl ", f"mpl{version('1')}")]),
    ("mpl-1.1", "mpl 1 1", [("mozilla", f"mozilla public {LICENSE}{version('1', '1')}"), (" mpl ", f"mpl{version('1', '1')}")]),
    ("mpl-2.0", "mpl 2 0", [("mozilla", f"mozilla public {LICENSE}{version('2')}"), (" mpl ", f"mpl{version('2')}")]),
    ("mpl", "mpl", [("mozilla", f"mozilla public {LICENSE}")]),
    ("epl-1.0", "epl 1 0", [("eclipse", f"eclipse public {LICENSE}{version('1')}"), (" epl ", f"epl{version('1')}")]),
    ("epl-2.0", "epl 2 0", [("eclipse", f"eclipse public {LICENSE}{version('2')}"), (" epl ", f"epl{version('2')}")]),
    ("epl", "epl", [("eclipse", f"eclipse (?:public|distribution) {LICENSE}")]),
    ("cddl-1.0", "cddl 1 0", [("common development", f"common development and distribution {LICENSE}(?: cddl)?{version('1')}"), (" cddl ", f"cddl{version('1')}")]),
    ("cddl-1.1", "cddl 1 1", [("common development", f"common development and distribution {LICENSE}(?: cddl)?{version('1', '1')}"), (" cddl ", f"cddl{version('1', '1')}")]),
    ("cpl-1.0", "cpl 1 0", [("common public", f"common public {LICENSE}(?:{version('1')})?")]),
    ("ipl-1.0", "ipl 1 0", [("ibm public", f"ibm public {LICENSE}(?:{version('1')})?")]),
    ("eupl-1.1", "eupl 1 1", [("european union", f"european union public {LICENSE}{version('1', '1')}"), (" eupl ", f"eupl{version('1', '1')}")]),
    ("eupl-1.2", "eupl 1 2", [("european union", f"european union public {LICENSE}{version('1', '2')}"), (" eupl ", f"eupl{version('1', '2')}")]),
    ("artistic-1.0", "artistic 1 0", [("artistic", f"artistic {LICENSE}{version('1')}")]),
    ("artistic-2.0", "artistic 2 0", [("artistic", f"artistic {LICENSE}{version('2')}")]),
    ("artistic", "artistic", [("artistic", f"(?:clarified )?artistic {LICENSE}")]),
    ("bsl-1.0", "bsl 1 0", [("boost", f"boost software {LICENSE}(?:{version('1')})?")]),
    ("busl-1.1", "busl 1 1", [("business source", f"business source {LICENSE}(?:{version('1', '1')})?")]),
    ("sspl-1.0", "sspl 1 0", [("server side public", f"server side public {LICENSE}(?:{version('1')})?")]),
    ("elastic-2.0", "elastic 2 0", [("elastic", f"elastic {LICENSE}{version('2')}")]),
    ("zlib", "zlib", [("zlib", f"zlib(?: libpng)? {LICENSE}")]),
    ("libpng", "libpng", [("libpng", f"libpng {LICENSE}")]),
    ("unlicense", "unlicense", [("unlicense", "(?:the )?unlicense")]),
    ("wtfpl", "wtfpl", [("wtfpl", "wtfpl"), ("want to public", f"want to public {LICENSE}")]),
    ("python-2.0", "python 2 0", [("python software", f"python software foundation {LICENSE}(?:{version('2')})?")]),
    ("php-3.01", "php 3 01", [(" php ", f"php {LICENSE}(?:{version('3', '01')})?")]),
    ("ruby", "ruby", [("ruby", f"ruby {LICENSE}")]),
    ("vim", "vim", [(" vim ", f"vim {LICENSE}")]),
    ("w3c", "w3c", [(" w3c ", f"w3c software(?: notice and)? {LICENSE}")]),
    ("ofl-1.1", "ofl 1 1", [("open font", f"(?:sil )?open font {LICENSE}(?:{version('1', '1')})?"), (" ofl ", f"(?:sil )?ofl{version('1', '1')}")]),
    ("odbl-1.0", "odbl 1 0", [("open database", f"open database {LICENSE}(?:{version('1')})?"), (" odbl ", "odbl")]),
    ("odc-by-1.0", "odc by 1 0", [("open data commons", f"open data commons attribution {LICENSE}")]),
    ("pddl-1.0", "pddl 1 0", [("public domain dedication", f"public domain dedication and {LICENSE}")]),
    ("cc0-1.0", "cc0 1 0", [(" cc0 ", "cc0(?: 1 0)?(?: universal)?"), ("creative commons zero", "creative commons zero(?: v1 0| 1 0)?(?: universal)?")]),
    ("ms-pl", "ms pl", [("microsoft public", f"microsoft public {LICENSE}")]),
    ("ms-rl", "ms rl", [("microsoft reciprocal", f"microsoft reciprocal {LICENSE}")]),
    ("apsl-2.0", "apsl 2 0", [("apple public", f"apple public source {LICENSE}(?:{version('2')})?")]),
    ("afl-3.0", "afl 3 0", [("academic free", f"academic free {LICENSE}(?:{version('3')})?")]),
    ("osl-3.0", "osl 3 0", [("open software", f"open software {LICENSE}(?:{version('3')})?")]),
    ("ncsa", "ncsa", [("illinois", f"university of illinois(?: ncsa)?(?: open source)? {LICENSE}")]),
    ("openssl", "openssl", [("openssl", f"openssl {LICENSE}")]),
    ("qpl-1.0", "qpl 1 0", [("q public", f"q public {LICENSE}")]),
    ("zpl-2.1", "zpl 2 1", [("zope", f"zope public {LICENSE}(?:{version('2', '1')})?")]),
    ("lppl-1.3c", "lppl 1 3c", [("latex project", f"latex project public {LICENSE}(?: 1 3c?)?")]),
    ("mulan-2.0", "mulanpsl 2 0", [("mulan", f"mulan(?: permissive software)? {LICENSE}(?:{version('2')})?")]),
    ("openrail", "openrail", [("openrail", "(?:creativeml |bigscience )?openrail(?: [ms]{1,2})?")]),
    ("llama", "llama", [("llama", f"llama(?: [0-9]+)* community {LICENSE}")]),
    ("gemma", "gemma", [("gemma", "gemma terms of use")]),
]

#: Creative Commons: short form, words of the long form.
CC_KINDS = {
    "by": "attribution",
    "by sa": "attribution share ?alike",
    "by nc": "attribution non ?commercial",
    "by nd": "attribution no ?derivatives?(?: works)?",
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?derivatives?(?: works)?",
}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Sentences that only stand in the text of one license or in its notice.
SENTENCES: list[tuple[str, str, str]] = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "substantial portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", "neither the name of(?: [^ ]+){1,12} may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "in compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache org licenses", "www apache org licenses license 2 0"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("gpl", "free software", "this (?:program|file|library) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "free software", "this (?:program|file|library) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "free software", "this (?:program|file|library) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl-2.0", "any later version", "either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "any later version", "either version 3 of the license or at your option any later version"),
    ("gpl", "gnu org licenses", "www gnu org licenses gpl"),
    ("lgpl", "gnu org licenses", "www gnu org licenses lgpl"),
    ("agpl", "gnu org licenses", "www gnu org licenses agpl"),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla org", "mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla public", "subject to the mozilla public license version 1 1"),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl-1.0", "common development", "subject to the terms of the common development and distribution license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "possible under law", "to the extent possible under law(?: [^ ]+){1,12} waived all copyright and related or neighboring rights"),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented"),
    ("bsl-1.0", "boost org", "boost org license 1 0"),
    ("wtfpl", "what the fuck you want", "you just do what the fuck you want to"),
    ("ofl-1.1", "reserved font name", "with reserved font name"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("python-2.0", "python software", "this license agreement is between the python software foundation"),
    ("proprietary", "proprietary", "(?:this (?:document|file|software) is )?proprietary and confidential"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("proprietary", "prior written", "without the prior written (?:permission|consent) of"),
    ("public-domain", "public domain", "(?:is|are|been) (?:hereby )?(?:placed|released|dedicated|put|given) (?:in|into|to) the public domain"),
    ("ms-pl", "opensource org", "opensource org licenses ms pl"),
    ("non-commercial", "non commercial", "for non commercial (?:use|purposes) only"),
    ("no-derivatives", "derivative works", "may not (?:create|make|prepare) derivative works"),
]

#: Anchors that are no whole words, and the words that hold them.
EITHER = {"licen": ["license", "licence"]}

#: Wording without the name of a license.
GENERIC: list[tuple[str, str]] = [
    ("licen", f"{GRANT} [^ ]+(?: [^ ]+)? {LICENSE}"),
    ("licen", f"see(?: the)? {LICENSE}(?: txt| md| file)?(?: for (?:details|more information))?"),
    ("licen", f"{LICENSE} agreement"),
    ("open source", f"open source {LICENSE}"),
    ("copyright", "copyright c? ?(?:19|20)[0-9]{2}"),
]


def rules() -> list[Rule]:
    """All rules in their order: base, then by priority. An anchor is a text that every match holds, in whole words."""

    def made(label: str, anchor: str, body: str, tier: int, weight: float, needs=(), base=False) -> Rule:
        keywords = EITHER.get(anchor) or [max(anchor.split(), key=len)]
        held = [anchor] if anchor not in EITHER and " " in anchor.strip() else []
        return Rule(label, keywords, held + list(needs), f" {body}(?= )", tier, weight, base)

    out = [made(label, f" {phrase} ", phrase, 0, 0.6, base=True) for phrase, label in BASE.items()]
    named, families = [], list(FAMILIES)
    for kind, words in CC_KINDS.items():
        for number in CC_VERSIONS:
            long_name = f"creative commons {words}(?: {LICENSE})?(?: version)? {number}(?: international| unported| generic)?(?: public)?(?: {LICENSE})?"
            label = f"cc-{kind} {number[0]}.{number[2]}".replace(" ", "-")
            families.append((label, f"cc {kind} {number}", [(f" cc {kind} ", f"cc {kind}(?: version)? {number}"), ("creative commons", long_name)]))
            out.append(made(label, "creativecommons", f"creativecommons org licenses {kind} {number}", 1, 0.9))
    for label, words, names in families:
        first = words.split(" ")[0]
        out.append(made(label, "spdx", f"spdx license identifier {words}(?: only| or later)?", 1, 1.0, [words]))
        out.append(made(label, "opensource", f"opensource org licenses? {words}", 1, 0.9, [words]))
        named.append(made(label, first, f"{LICENSE} {words}", 2, 0.6, [f"e {words} "]))
        for anchor, name in names:
            out.append(made(label, anchor, f"{GRANT} {name}", 1, 0.95))
            named.append(made(label, anchor, name, 2, 0.7))
    out += [made(label, anchor, body, 1, 1.0) for label, anchor, body in SENTENCES]
    return out + named + [made("unknown", anchor, body, 3, 0.2) for anchor, body in GENERIC]
