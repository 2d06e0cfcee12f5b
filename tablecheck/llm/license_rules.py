"""Signature rules of licenses: hand-written patterns over normalised words, with keywords and priorities.

A text is matched as its words (letters and digits, A-Z lower-cased) joined by single spaces, so patterns hold words
and single spaces only. Each pattern is bounded: it matches at most ``REACH`` words, and every match holds its keyword.
"""

from __future__ import annotations

from dataclasses import dataclass

REACH = 24
#: Words of most statements of licensing; not of all, so nothing is gated by them.
ANCHORS = ["license", "licence", "licenses", "licences", "licensed", "licensing", "spdx", "copyright", "copyrighted", "copyleft", "unlicense", "domain", "warranty", "warranties", "redistribution", "permission", "gpl", "gplv2", "gplv3", "lgpl", "agpl"]

NOTICE, NAME, HINT = 3, 2, 1  # priorities: a statement of licensing, a license's name, words that only hint at one


@dataclass(frozen=True)
class Signature:
    """``pattern`` is tried where ``keyword`` occurs; ``score`` is how sure a match is."""

    label: str
    priority: int
    keyword: str
    pattern: str
    score: float
    base: bool = False


#: Families: label, keyword, pattern of the name without the word license, pattern of its version (empty: none).
FAMILIES = [
    ("mit", "mit", "mit(?: x11| expat)?", ""),
    ("apache", "apache", "apache(?: software)?", "(?: v| ver| version)? ?(?:2 0|2|1 1|1 0|v2)"),
    ("gpl", "general public", "(?:gnu )?general public", "(?: v| version)? ?(?:1|2|3|v2|v3)(?: 0)?"),
    ("gpl", "gpl", "(?:gnu )?gpl", "(?: v| version)? ?(?:1|2|3|v2|v3)(?: 0)?"),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public", "(?: v| version)? ?(?:2 1|2|3)(?: 0)?"),
    ("lgpl", "library general", "(?:gnu )?library general public", "(?: v| version)? ?2(?: 0)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", "(?: v| version)? ?(?:2 1|2|3)(?: 0)?"),
    ("agpl", "affero", "(?:gnu )?affero general public", "(?: v| version)? ?(?:1|3)(?: 0)?"),
    ("agpl", "agpl", "(?:gnu )?agpl", "(?: v| version)? ?(?:1|3)(?: 0)?"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation", "(?: version)? ?1 [123]"),
    ("bsd", "bsd", "(?:(?:new|modified|revised|simplified|original) )?(?:[0234] clause )?(?:free ?)?bsd", "(?: version)? ?[0234] clause"),
    ("mpl", "mozilla public", "mozilla public", "(?: v| version)? ?(?:1 0|1 1|2 0|2)"),
    ("epl", "eclipse public", "eclipse public", "(?: v| version)? ?(?:1 0|2 0)"),
    ("edl", "eclipse distribution", "eclipse distribution", "(?: v| version)? ?1 0"),
    ("cddl", "development and distribution", "common development and distribution", "(?: version)? ?1 [01]"),
    ("cpl", "common public", "common public", "(?: version)? ?1 0"),
    ("ipl", "ibm public", "ibm public", "(?: version)? ?1 0"),
    ("eupl", "european union public", "european union public", "(?: v| version)? ?1 [012]"),
    ("artistic", "artistic", "(?:perl )?artistic", "(?: version)? ?[12] 0"),
    ("isc", "isc", "isc", ""),
    ("zlib", "zlib", "zlib(?: libpng)?", ""),
    ("libpng", "libpng", "libpng", "(?: version)? ?2"),
    ("boost", "boost", "boost software", "(?: version)? ?1 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", ""),
    ("wtfpl", "wtfpl", "wtfpl", "(?: version)? ?2"),
    ("postgresql", "postgresql", "postgresql", ""),
    ("openssl", "openssl", "openssl", ""),
    ("python", "python software", "python software foundation", "(?: version)? ?2"),
    ("php", "php", "php", "(?: version)? ?3 01?"),
    ("ruby", "ruby", "ruby", ""),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", ""),
    ("ofl", "open font", "(?:sil )?open font", "(?: version)? ?1 [01]"),
    ("osl", "open software", "open software", "(?: version)? ?[123] [01]"),
    ("afl", "academic free", "academic free", "(?: version)? ?[123] [012]"),
    ("mspl", "microsoft public", "microsoft public", ""),
    ("msrl", "microsoft reciprocal", "microsoft reciprocal", ""),
    ("upl", "universal permissive", "universal permissive", "(?: version)? ?1 0"),
    ("bsl", "business source", "business source", "(?: version)? ?1 1"),
    ("sspl", "server side public", "server side public", "(?: v| version)? ?1"),
    ("elastic", "elastic", "elastic", "(?: version)? ?2(?: 0)?"),
    ("odbl", "open database", "(?:open data commons )?open database", "(?: version)? ?1 0"),
    ("odc-by", "open data commons attribution", "open data commons attribution", "(?: version)? ?1 0"),
    ("cc-by", "commons attribution", "creative commons attribution", "(?: version)? ?[1234] 0(?: international| unported)?"),
    ("cc-by-sa", "share", "creative commons attribution share ?alike", "(?: version)? ?[1234] 0(?: international| unported)?"),
    ("cc-by-nc", "non", "creative commons attribution non ?commercial", "(?: version)? ?[1234] 0(?: international| unported)?"),
    ("cc-by-nd", "no deriv", "creative commons attribution no deriv(?:ative|ative work|ative works|atives|s)", "(?: version)? ?[1234] 0(?: international| unported)?"),
    ("cc0", "cc0", "(?:creative commons )?cc0", "(?: version)? ?1 0(?: universal)?"),
]

#: Short identifiers as they stand after the words "spdx license identifier".
IDENTIFIERS = [
    ("mit", "mit(?: 0)?"), ("apache", "apache (?:1 0|1 1|2 0)"), ("gpl", "gpl [123] 0(?: only| or later)?"), ("lgpl", "lgpl (?:2 0|2 1|3 0)(?: only| or later)?"),
    ("agpl", "agpl [13] 0(?: only| or later)?"), ("bsd", "(?:0bsd|bsd [1234] clause)"), ("mpl", "mpl (?:1 0|1 1|2 0)"), ("epl", "epl [12] 0"), ("cddl", "cddl 1 [01]"),
    ("eupl", "eupl 1 [012]"), ("artistic", "artistic [12] 0"), ("isc", "isc"), ("zlib", "zlib"), ("boost", "bsl 1 0"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"),
    ("postgresql", "postgresql"), ("python", "psf 2 0"), ("ncsa", "ncsa"), ("ofl", "ofl 1 [01]"), ("osl", "osl [123] [01]"), ("afl", "afl [123] [012]"), ("mspl", "ms pl"),
    ("upl", "upl 1 0"), ("bsl", "busl 1 1"), ("sspl", "sspl 1 0"), ("elastic", "elastic 2 0"), ("odbl", "odbl 1 0"), ("cc-by", "cc by [1234] 0"), ("cc-by-sa", "cc by sa [1234] 0"),
    ("cc-by-nc", "cc by nc [1234] 0"), ("cc-by-nd", "cc by nd [1234] 0"), ("cc0", "cc0 1 0"), ("gfdl", "gfdl 1 [123](?: only| or later)?"),
]

#: Sentences from license texts and notices: label, priority, keyword, pattern, score.
SENTENCES = [
    ("mit", NOTICE, "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.99),
    ("mit", NOTICE, "shall be included", "copyright notice and this permission notice shall be included in all copies or substantial portions", 0.95),
    ("isc", NOTICE, "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee", 0.99),
    ("bsd", NOTICE, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 0.99),
    ("bsd", NOTICE, "redistributions", "redistributions of source code must retain the above copyright notice", 0.95),
    ("bsd", NOTICE, "redistributions", "redistributions in binary form must reproduce the above copyright notice", 0.95),
    ("gpl", NOTICE, "redistribute it", "you can redistribute it and or modify it under the terms of the gnu general public license", 0.99),
    ("lgpl", NOTICE, "redistribute it", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", 0.99),
    ("agpl", NOTICE, "redistribute it", "you can redistribute it and or modify it under the terms of the gnu affero general public license", 0.99),
    ("gpl", NOTICE, "should have received", "you should have received a copy of the gnu general public license", 0.99),
    ("lgpl", NOTICE, "should have received", "you should have received a copy of the gnu lesser general public license", 0.99),
    ("agpl", NOTICE, "should have received", "you should have received a copy of the gnu affero general public license", 0.99),
    ("apache", NOTICE, "except in compliance", "you may not use this file except in compliance with the license", 0.9),
    ("apache", NOTICE, "obtain a copy", "you may obtain a copy of the license at http www apache org licenses license 2 0", 0.99),
    ("apache", NOTICE, "contributor license", "under one or more contributor license agreements", 0.9),
    ("mpl", NOTICE, "source code form", "this source code form is subject to the terms of the mozilla public license", 0.99),
    ("boost", NOTICE, "boost org", "copy at http www boost org license 1 0 txt", 0.99),
    ("unlicense", NOTICE, "unencumbered", "this is free and unencumbered software released into the public domain", 0.99),
    ("public-domain", NAME, "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", 0.9),
    ("public-domain", HINT, "public domain", "public domain", 0.6),
    ("cc", NAME, "creative commons", "creative commons licen[cs]e", 0.8),
    ("cc", NOTICE, "creativecommons", "creativecommons org licenses by(?: nc| nd| sa)* [1234] 0", 0.95),
    ("proprietary", NAME, "all rights", "copyright (?:c )?(?:[0-9]{4} )?(?:[^ ]+ ){0,6}all rights reserved", 0.7),
    ("proprietary", NAME, "proprietary", "proprietary(?: software)? licen[cs]e", 0.8),
    ("eula", NAME, "end user", "end user licen[cs]e agreement", 0.9),
    ("warranty-disclaimer", HINT, "warranty", "(?:without|no) warranty of any kind", 0.5),
    ("warranty-disclaimer", HINT, "warranties", "without warranties or conditions of any kind", 0.5),
    ("warranty-disclaimer", HINT, "implied", "(?:express or implied|implied) warrant(?:y|ies)", 0.5),
    ("unknown-license", HINT, "license", "(?:released|distributed|published|available|licensed) under (?:the|a|an) (?:[^ ]+ ){0,3}license", 0.4),
    ("unknown-license", HINT, "licensed", "licensed (?:under|to|by)", 0.4),
    ("unknown-license", HINT, "license", "see (?:the )?license(?: file)?", 0.4),
    ("copyright", HINT, "copyright", "copyright (?:c )?[0-9]{4}", 0.3),
]

#: The three base phrases; every place of them is counted.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]


def signatures() -> list[Signature]:
    """All rules in order: base phrases, sentences, identifiers, then four forms of each family's name."""
    rules = [Signature(label, NAME, phrase, phrase, 0.8, True) for label, phrase in BASE]
    rules += [Signature(*sentence) for sentence in SENTENCES]
    rules += [Signature(label, NOTICE, "spdx license", f"spdx license identifier {name}", 1.0) for label, name in IDENTIFIERS]
    for label, keyword, name, version in FAMILIES:
        word = "" if label == "unlicense" or "cc0" in name else " licen[cs]e"
        optional = f"(?:{version})?" if version else ""
        under = "(?:licensed|released|distributed|provided|available|published|covered) (?:under|by)(?: the terms of)?(?: the| an| a)?"
        rules += [
            Signature(label, NOTICE, keyword, f"{under} {name}{word}{optional}", 0.98),
            Signature(label, NOTICE, keyword, f"(?:license|licence) (?:is )?(?:the )?{name}(?:{word})?{optional}", 0.95),
            Signature(label, NAME, keyword, f"{name}{word}{optional}", 0.85),
        ]
        if version:
            rules.append(Signature(label, NAME, keyword, f"{name}{version}(?:{word})?", 0.85))
    return rules
