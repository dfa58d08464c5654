"""Signatures of licences and rights statements, in order of their writing (for operator 13).

A signature is a regular expression over lower-case words joined by single
spaces, tried where its first word stands.  Families of licences are spelt out
from their names, versions and ways of citing; statements are written one by
one.  Only what Java's and RE2's dialects share is used.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Words of the longest signature, at most.
SPAN = 28

# What a label rests on: a text of the licence, an exact citation, a name, a hint.
TEXT, CITED, NAMED, HINT = (4, 0.95), (3, 0.85), (2, 0.6), (1, 0.35)


@dataclass(frozen=True)
class Signature:
    """``pattern`` begins with one of ``anchors``; every match has ``keyword`` in it. A higher priority wins over what it contains."""

    label: str
    anchors: tuple[str, ...]
    pattern: str  # what follows the anchor
    keyword: str
    priority: int
    weight: float
    base: bool = False


def _rule(label: str, pattern: str, keyword: str, level: tuple[int, float], more: int = 0) -> Signature:
    first, _, rest = pattern.partition(" ")
    return Signature(label, tuple(first.split("|")), f" {rest}" if rest else "", keyword, level[0] + more, level[1])


#: The phrases and labels that are always found.
BASE = (
    Signature("cc-by", ("cc",), " by", "cc by", 0, 0.5, True),
    Signature("gpl", ("general",), " public license", "general public license", 0, 0.5, True),
    Signature("reserved", ("all",), " rights reserved", "rights reserved", 0, 0.3, True),
)


def _number(version: str) -> str:
    whole, _, part = version.partition(".")
    return f"{whole}(?: 0)?" if part in ("", "0") else f"{whole} {part}"


_V = "(?:version |v )?v?"
_LATER = " or (?:at your option )?(?:any )?later(?: version)?"
_GNU = (("gpl", "general public license", "1.0 2.0 3.0"), ("lgpl", "(?:lesser|library) general public license", "2.0 2.1 3.0"), ("agpl", "affero general public license", "1.0 3.0"), ("gfdl", "free documentation license", "1.1 1.2 1.3"))


def _gnu() -> list[Signature]:
    out = []
    for short, title, versions in _GNU:
        key = "free documentation license" if short == "gfdl" else "general public license"
        for v in versions.split():
            n = _number(v)
            full = f"gnu {title} (?:{short} )?(?:as published by the free software foundation )?(?:either )?{_V}{n}"
            out += [_rule(f"{short}-{v}", full, key, CITED), _rule(f"{short}-{v}-or-later", full + _LATER, key, CITED, 1), _rule(f"{short}-{v}-only", full + " only", key, CITED, 1)]
            out += [_rule(f"{short}-{v}", f"{short} {_V}{n}", short, CITED), _rule(f"{short}-{v}-or-later", f"{short} {_V}{n}{_LATER}", short, CITED, 1), _rule(f"{short}-{v}-only", f"{short} {_V}{n} only", short, CITED, 1)]
            out += [_rule(f"{short}-{v}", f"{short}v{v.split('.')[0]}" + ("" if v.endswith(".0") else f" {v.split('.')[1]}"), short, CITED), _rule(f"{short}-{v}", f"spdx license identifier {short} {n}", "spdx license identifier", TEXT), _rule(f"{short}-{v}", f"www gnu org licenses (?:old licenses )?{short} {n}", "gnu org licenses", CITED)]
        out += [_rule(short, f"gnu {title}", key, NAMED), _rule(short, f"under the {short}", short, NAMED), _rule(short, f"the {short} license", short, NAMED)]
    return out


_CC = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s(?: works)?"), ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"))


def _creative_commons() -> list[Signature]:
    out = []
    for code, title in _CC:
        words = code.replace("-", " ")
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            n = _number(v)
            out += [_rule(f"cc-{code}-{v}", f"cc {words} {_V}{n}", "cc by", CITED), _rule(f"cc-{code}-{v}", f"creative commons {title} (?:{v[0]} {v[2]}|{n})(?: international| unported| generic)?", "creative commons", CITED), _rule(f"cc-{code}-{v}", f"creativecommons org licenses {words} {n}", "creativecommons org", CITED)]
        out += [_rule(f"cc-{code}", f"cc {words}", "cc by", NAMED), _rule(f"cc-{code}", f"creative commons {title}", "creative commons", NAMED)]
    out += [_rule("cc0-1.0", "cc0", "cc0", NAMED), _rule("cc0-1.0", f"cc0 {_V}1 0", "cc0", CITED), _rule("cc0-1.0", "creative commons (?:cc0|zero)", "creative commons", NAMED), _rule("cc0-1.0", "creativecommons org publicdomain zero 1 0", "creativecommons org", CITED), _rule("cc", "creative commons license", "creative commons", HINT)]
    return out


_NAMES = (  # label, name, versions
    ("apache", "apache (?:software )?license", "1.0 1.1 2.0"),
    ("mpl", "mozilla public license", "1.0 1.1 2.0"),
    ("epl", "eclipse public license", "1.0 2.0"),
    ("eupl", "european union public licen[cs]e", "1.0 1.1 1.2"),
    ("cddl", "common development and distribution license", "1.0 1.1"),
    ("cpl", "common public license", "1.0"),
    ("artistic", "artistic license", "1.0 2.0"),
    ("bsl", "boost software license", "1.0"),
    ("busl", "business source license", "1.0 1.1"),
    ("afl", "academic free license", "1.1 1.2 2.0 2.1 3.0"),
    ("osl", "open software license", "1.0 2.0 2.1 3.0"),
    ("ofl", "sil open font license", "1.0 1.1"),
    ("odbl", "open (?:data commons open )?database license", "1.0"),
    ("php", "php license", "3.0 3.01"),
    ("python", "python (?:software foundation )?license", "2.0"),
    ("zpl", "zope public license", "2.0 2.1"),
    ("ecl", "educational community license", "1.0 2.0"),
    ("sspl", "server side public license", "1.0"),
    ("elastic", "elastic license", "2.0"),
    ("cecill", "cecill (?:free software )?license", "1.0 2.0 2.1"),
    ("upl", "universal permissive license", "1.0"),
    ("openrail", "(?:bigscience|creativeml) open rail(?: m)? license", "1.0 1.1"),
)


def _named() -> list[Signature]:
    out = []
    for label, name, versions in _NAMES:
        start = "bigscience|creativeml" + name.partition(")")[2] if name.startswith("(?:") else name
        for v in versions.split():
            out += [_rule(f"{label}-{v}", f"{start} {_V}{_number(v)}", "licen", CITED), _rule(f"{label}-{v}", f"spdx license identifier {label} {_number(v)}", "spdx license identifier", TEXT)]
        out.append(_rule(label, start, "licen", NAMED))
    return out


# One by one: label, keyword, strength, signature.
_STATEMENTS = (
    ("apache-2.0", "apache", CITED, "apache 2(?: 0)?(?: licensed?)?"),
    ("apache-2.0", "apache org licenses", CITED, "www apache org licenses license 2 0"),
    ("apache-2.0", "you may not use this file", TEXT, "you may not use this file except in compliance with the license"),
    ("apache-2.0", "without warranties or conditions", TEXT, "without warranties or conditions of any kind either express or implied"),
    ("mit", "mit licen", CITED, "mit licen[cs]e"),
    ("mit", "spdx license identifier", CITED, "spdx license identifier mit"),
    ("mit", "expat license", NAMED, "expat license"),
    ("mit", "permission is hereby granted", TEXT, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission notice shall be included", TEXT, "the above copyright notice and this permission notice shall be included in all copies"),
    ("mit-0", "mit no attribution", CITED, "mit no attribution"),
    ("isc", "licen", CITED, "isc licen[cs]e"),
    ("isc", "permission to use copy modify", TEXT, "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "bsd licen", NAMED, "bsd licen[cs]ed?"),
    ("bsd-2-clause", "bsd", CITED, "bsd 2 clause(?: simplified)?(?: license)?"),
    ("bsd-2-clause", "bsd", CITED, "simplified bsd license"),
    ("bsd-2-clause", "bsd", CITED, "freebsd license"),
    ("bsd-3-clause", "bsd", CITED, "bsd 3 clause(?: new| revised| new or revised)?(?: license)?"),
    ("bsd-3-clause", "bsd", CITED, "new|modified|revised bsd license"),
    ("bsd-3-clause", "neither the name", TEXT, "neither the name of (?:[^ ]+ ){1,8}may be used to endorse or promote products"),
    ("bsd-4-clause", "bsd", CITED, "bsd 4 clause(?: original)?(?: license)?"),
    ("bsd-4-clause", "advertising materials", TEXT, "all advertising materials mentioning features or use of this software must display"),
    ("bsd", "redistribution and use", TEXT, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("0bsd", "0bsd", CITED, "0bsd"),
    ("zlib", "licen", CITED, "zlib licen[cs]e"),
    ("zlib", "express or implied warranty", TEXT, "this software is provided as is without any express or implied warranty"),
    ("libpng", "licen", CITED, "libpng licen[cs]e"),
    ("boost-1.0", "boost software", TEXT, "distributed under the boost software license"),
    ("unlicense", "unlicense", CITED, "unlicense"),
    ("unlicense", "unencumbered software", TEXT, "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "wtfpl", CITED, "wtfpl"),
    ("beerware", "beer ware", CITED, "beer ware license"),
    ("postgresql", "licen", CITED, "postgresql licen[cs]e"),
    ("openssl", "openssl license", CITED, "openssl license"),
    ("ruby", "ruby license", CITED, "ruby license"),
    ("vim", "vim license", CITED, "vim license"),
    ("curl", "curl license", CITED, "curl license"),
    ("ncsa", "ncsa", CITED, "university of illinois ncsa open source license"),
    ("ms-pl", "microsoft public", CITED, "microsoft public license(?: ms pl)?"),
    ("ms-rl", "microsoft reciprocal", CITED, "microsoft reciprocal license(?: ms rl)?"),
    ("ibm-pl", "ibm public license", CITED, "ibm public license"),
    ("w3c", "w3c", CITED, "w3c (?:software|document) (?:notice and )?license"),
    ("llama", "llama", NAMED, "llama (?:[0-9] )?(?:[0-9] )?community license(?: agreement)?"),
    ("gemma", "gemma", NAMED, "gemma terms of use"),
    ("cdla-permissive", "community data license", CITED, "community data license agreement permissive"),
    ("cdla-sharing", "community data license", CITED, "community data license agreement sharing"),
    ("pddl", "public domain dedication", CITED, "public domain dedication and license"),
    ("ogl-uk", "open government", CITED, "open government licen[cs]e"),
    ("public-domain", "public domain", NAMED, "in|into the public domain"),
    ("public-domain", "public domain", NAMED, "public domain mark"),
    ("public-domain", "no known copyright", CITED, "no known copyright restrictions?"),
    ("gpl", "general public license", TEXT, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "general public license", TEXT, "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("gpl", "warranty", TEXT, "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("permissive", "licen", HINT, "permissively licensed"),
    ("open-source", "open source licen", HINT, "open source licen[cs]ed?"),
    ("dual", "dual licen", HINT, "dual licen[cs](?:ed|ing)"),
    ("license-file", "license", HINT, "see the license file"),
    ("license-file", "license", HINT, "license (?:txt|md)"),
    ("reserved", "rights reserved", NAMED, "all rights reserved"),
    ("reserved", "rights are reserved", NAMED, "all rights are reserved"),
    ("reserved", "rights reserved", HINT, "some rights reserved"),
    ("reserved", "droits", NAMED, "tous droits réservés"),
    ("reserved", "rechte", NAMED, "alle rechte vorbehalten"),
    ("reserved", "derechos", NAMED, "todos los derechos reservados"),
    ("copyright", "copyright", HINT, "copyright (?:c )?(?:©)? ?[12][0-9][0-9][0-9](?: [12][0-9][0-9][0-9])?"),
    ("copyright", "copyright", NAMED, "copyright (?:c )?[12][0-9][0-9][0-9] (?:[^ ]+ ){1,8}all rights reserved"),
    ("copyright", "copyrighted", HINT, "copyrighted (?:material|work|content)"),
    ("no-copying", "may be reproduced", NAMED, "no part of this (?:[^ ]+ ){1,3}may be reproduced"),
    ("no-copying", "permission", NAMED, "without (?:the )?(?:prior |express |written ){1,3}permission"),
    ("no-copying", "prohibited", NAMED, "unauthorised|unauthorized (?:copying|reproduction|use|distribution) (?:[^ ]+ ){0,6}prohibited"),
    ("proprietary", "proprietary", NAMED, "proprietary and confidential"),
    ("proprietary", "confidential", NAMED, "confidential and proprietary"),
    ("proprietary", "proprietary", NAMED, "proprietary licen[cs]e"),
    ("proprietary", "license agreement", HINT, "end user license agreement"),
    ("noncommercial", "commercial", NAMED, "for non ?commercial (?:use|purposes) only"),
    ("noncommercial", "commercial", NAMED, "not for commercial use"),
    ("noncommercial", "commercial", NAMED, "non commercial use only"),
    ("noncommercial", "commercial", NAMED, "noncommercial use only"),
    ("noncommercial", "commercial", NAMED, "polyform non ?commercial license"),
    ("research", "for research", NAMED, "for research (?:use|purposes) only"),
    ("evaluation", "for evaluation", NAMED, "for evaluation (?:use|purposes) only"),
    ("no-training", "used to train", NAMED, "may not be used to train"),
    ("no-training", "text and data mining", NAMED, "text and data mining (?:rights )?(?:is|are )?reserved"),
)


def signatures() -> tuple[Signature, ...]:
    """All of them; an earlier one wins over a later one of the same words and priority."""
    return (*BASE, *_gnu(), *_creative_commons(), *_named(), *[_rule(label, pattern, key, level) for label, key, level, pattern in _STATEMENTS])
