"""The licence signatures: families of names and fixed phrases, from which the ordered rules are made.

Each licence has a label, the SPDX identifiers that stand for it, a regex of its name and, where it has one, of its
address. FORMS turns every one into rules of different weight: a tag, a grant, a reference, an address, a bare title. PHRASES
are sentences from licence texts. Regexes see the text with A-Z in lower case. They are written with single blanks between
words; ``spaced`` makes each stand for any gap between words: blanks, line ends, and comment marks at the start of
a line. A keyword is a literal that every match contains once its gaps are single blanks, and rules are tried only where it occurs.
"""

from __future__ import annotations

import re

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A smaller ``rank`` wins; ``weight`` is the confidence of a match."""

    rank: int
    label: str
    keyword: str
    regex: str
    weight: float


#: Between two words: white space, and what a line of a comment may begin with.
GAP = r"(?:\s+(?:(?:[-#*/;%!>|]+|dnl|rem|\.\.)\s+|//\s*|#+\s*)?)"


def spaced(regex: str) -> str:
    """The regex with a gap for every blank; in a character class, any white space; counted dots also match line ends."""
    parts = re.split(r"(\[\^?(?:\\.|[^\]\\])*\])", regex)  # classes stand at odd places
    outside = lambda p: re.sub(r"(?<!\\)\.\{", r"[\\s\\S]{", p.replace(" ", GAP))
    return "".join(p.replace(" ", r"\s") if k % 2 else outside(p) for k, p in enumerate(parts))


_V = r"(?:,? ?(?:version|v\.?) ?)"

#: label, SPDX identifiers, keyword of the name, name, address (or None)
LICENCES = [
    ("gpl-2.0", "gpl-2.0(?:-only|-or-later|\\+)?", "general public", rf"(?:gnu )?general public licen[cs]e{_V}2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gpl-3.0(?:-only|-or-later|\\+)?", "general public", rf"(?:gnu )?general public licen[cs]e{_V}3(?:\.0)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-1.0", "gpl-1.0(?:-only|-or-later|\\+)?", "general public", rf"(?:gnu )?general public licen[cs]e{_V}1(?:\.0)?", r"gnu\.org/licenses/old-licenses/gpl-1\.0"),
    ("lgpl-2.0", "lgpl-2.0(?:-only|-or-later|\\+)?", "library general", rf"(?:gnu )?library general public licen[cs]e{_V}2(?:\.0)?", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    ("lgpl-2.1", "lgpl-2.1(?:-only|-or-later|\\+)?", "lesser general", rf"(?:gnu )?lesser general public licen[cs]e{_V}2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lgpl-3.0(?:-only|-or-later|\\+)?", "lesser general", rf"(?:gnu )?lesser general public licen[cs]e{_V}3(?:\.0)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", "lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e", r"gnu\.org/(?:copyleft|licenses)/lesser"),
    ("agpl-3.0", "agpl-3.0(?:-only|-or-later|\\+)?", "affero", rf"(?:gnu )?affero general public licen[cs]e(?:{_V}3(?:\.0)?)?", r"gnu\.org/licenses/agpl"),
    ("gfdl", "gfdl-1\\.[123](?:-only|-or-later)?", "free documentation", rf"(?:gnu )?free documentation licen[cs]e(?:{_V}1\.[123])?", r"gnu\.org/licenses/fdl"),
    ("apache-2.0", "apache-2.0", "apache", rf"apache (?:software )?licen[cs]e{_V}2(?:\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache-1.1", "apache", rf"apache (?:software )?licen[cs]e{_V}1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-1.0", "apache-1.0", "apache", rf"apache (?:software )?licen[cs]e{_V}1\.0", r"apache\.org/licenses/license-1\.0"),
    ("mit", "mit", "mit licen", r"(?:the )?mit licen[cs]e", r"opensource\.org/licen[cs]es?/mit"),
    ("x11", "x11", "x11 licen", r"x11 licen[cs]e", None),
    ("expat", "expat", "expat licen", r"expat licen[cs]e", None),
    ("isc", "isc", "isc licen", r"isc licen[cs]e", r"opensource\.org/licen[cs]es?/isc"),
    ("bsd-2-clause", "bsd-2-clause", "bsd", r"(?:bsd[- ]2[- ]clause|2[- ]clause bsd|simplified bsd|freebsd) licen[cs]e", r"opensource\.org/licen[cs]es?/bsd-2-clause"),
    ("bsd-3-clause", "bsd-3-clause", "bsd", r"(?:bsd[- ]3[- ]clause|3[- ]clause bsd|new bsd|revised bsd|modified bsd) licen[cs]e", r"opensource\.org/licen[cs]es?/bsd-3-clause"),
    ("bsd-4-clause", "bsd-4-clause", "bsd", r"(?:bsd[- ]4[- ]clause|4[- ]clause bsd|original bsd|old bsd) licen[cs]e", None),
    ("0bsd", "0bsd", "zero", r"(?:bsd zero[- ]clause|zero[- ]clause bsd) licen[cs]e", r"opensource\.org/licen[cs]es?/0bsd"),
    ("bsd", "bsd", "bsd licen", r"bsd licen[cs]e", r"opensource\.org/licen[cs]es?/bsd-license"),
    ("mpl-1.0", "mpl-1.0", "mozilla", rf"mozilla public licen[cs]e{_V}1\.0", r"mozilla\.org/mpl/1\.0"),
    ("mpl-1.1", "mpl-1.1", "mozilla", rf"mozilla public licen[cs]e{_V}1\.1", r"mozilla\.org/mpl/(?:mpl-)?1\.1"),
    ("mpl-2.0", "mpl-2.0", "mozilla", rf"mozilla public licen[cs]e{_V}2(?:\.0)?", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", "epl-1.0", "eclipse", rf"eclipse public licen[cs]e{_V}1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "epl-2.0", "eclipse", rf"eclipse public licen[cs]e{_V}2(?:\.0)?", r"eclipse\.org/legal/epl-(?:2\.0|v20)"),
    ("edl-1.0", "edl-1.0", "eclipse", rf"eclipse distribution licen[cs]e(?:{_V}1(?:\.0)?)?", r"eclipse\.org/org/documents/edl"),
    ("cddl-1.0", "cddl-1.0", "common development", rf"common development and distribution licen[cs]e(?:{_V}1(?:\.0)?)?", r"opensource\.org/licen[cs]es?/cddl"),
    ("cpl-1.0", "cpl-1.0", "common public", rf"common public licen[cs]e(?:{_V}1(?:\.0)?)?", r"opensource\.org/licen[cs]es?/cpl"),
    ("ipl-1.0", "ipl-1.0", "ibm public", r"ibm public licen[cs]e", None),
    ("artistic-1.0", "artistic-1.0(?:-perl|-cl8)?", "artistic licen", rf"(?:clarified )?artistic licen[cs]e(?:{_V}1(?:\.0)?)?", None),
    ("artistic-2.0", "artistic-2.0", "artistic licen", rf"artistic licen[cs]e{_V}2(?:\.0)?", r"opensource\.org/licen[cs]es?/artistic-license-2\.0"),
    ("zlib", "zlib(?:-acknowledgement)?", "zlib", r"zlib(?:/libpng)? licen[cs]e", r"opensource\.org/licen[cs]es?/zlib"),
    ("libpng", "libpng(?:-2\\.0)?", "libpng", r"libpng licen[cs]e", None),
    ("bsl-1.0", "bsl-1.0", "boost software", rf"boost software licen[cs]e(?:{_V}1(?:\.0)?)?", r"boost\.org/license_1_0"),
    ("unlicense", "unlicense", "unlicense", r"the unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", "public licen", r"do what the f\S{3} you want to public licen[cs]e", r"wtfpl\.net"),
    ("python-2.0", "python-2.0|psf-2.0", "python software foundation", r"python software foundation licen[cs]e", r"python\.org/(?:psf/)?license"),
    ("php-3.01", "php-3.0?1?", "php licen", rf"php licen[cs]e(?:{_V}3(?:\.0?1)?)?", r"php\.net/license"),
    ("ruby", "ruby", "ruby licen", r"ruby licen[cs]e", None),
    ("ofl-1.1", "ofl-1.1(?:-rfn|-no-rfn)?", "open font", rf"(?:sil )?open font licen[cs]e(?:{_V}1\.1)?", r"scripts\.sil\.org/ofl"),
    ("eupl-1.1", "eupl-1.1", "european union public", rf"european union public licen[cs]e{_V}1\.1", None),
    ("eupl-1.2", "eupl-1.2", "european union public", rf"european union public licen[cs]e(?:{_V}1\.2)?", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("ms-pl", "ms-pl", "microsoft public", r"microsoft public licen[cs]e", r"opensource\.org/licen[cs]es?/ms-pl"),
    ("ms-rl", "ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", r"opensource\.org/licen[cs]es?/ms-rl"),
    ("osl-3.0", "osl-3.0", "open software", rf"open software licen[cs]e(?:{_V}3(?:\.0)?)?", None),
    ("afl-3.0", "afl-3.0", "academic free", rf"academic free licen[cs]e(?:{_V}3(?:\.0)?)?", None),
    ("ncsa", "ncsa", "illinois/ncsa", r"(?:university of )?illinois/ncsa open source licen[cs]e", None),
    ("upl-1.0", "upl-1.0", "universal permissive", r"universal permissive licen[cs]e", None),
    ("postgresql", "postgresql", "postgresql licen", r"postgresql licen[cs]e", r"opensource\.org/licen[cs]es?/postgresql"),
    ("openssl", "openssl", "openssl licen", r"openssl licen[cs]e", None),
    ("curl", "curl", "curl licen", r"curl licen[cs]e", r"curl\.(?:se|haxx\.se)/docs/copyright"),
    ("w3c", "w3c(?:-\\d+)?", "w3c", r"w3c software (?:notice and )?licen[cs]e", r"w3\.org/consortium/legal/\S*copyright-software"),
    ("vim", "vim", "vim licen", r"vim licen[cs]e", None),
    ("sleepycat", "sleepycat", "sleepycat", r"sleepycat licen[cs]e", None),
    ("qpl-1.0", "qpl-1.0", "q public", r"q public licen[cs]e", None),
    ("odbl-1.0", "odbl-1.0", "open database", rf"open database licen[cs]e(?:{_V}1(?:\.0)?)?", r"opendatacommons\.org/licenses/odbl"),
    ("odbl-1.0", "odbl-1.0", "open data commons", rf"open data commons database licen[cs]e(?:{_V}1(?:\.0)?)?", None),
    ("odc-by-1.0", "odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[cs]e", r"opendatacommons\.org/licenses/pddl"),
    ("cc0-1.0", "cc0-1.0", "cc0", r"cc0(?:[ -]1\.0)?(?: universal)?", r"creativecommons\.org/publicdomain/zero"),
    ("cc-pdm-1.0", "cc-pdm-1.0", "public domain mark", r"public domain mark(?: 1\.0)?", r"creativecommons\.org/publicdomain/mark"),
    ("cc-by-nc-sa", "cc-by-nc-sa-\\d\\.\\d", "cc by", r"cc[ -]by[ -]nc[ -]sa(?:[ -]\d(?:\.\d)?)?", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", "cc-by-nc-nd-\\d\\.\\d", "cc by", r"cc[ -]by[ -]nc[ -]nd(?:[ -]\d(?:\.\d)?)?", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc", "cc-by-nc-\\d\\.\\d", "cc by", r"cc[ -]by[ -]nc(?:[ -]\d(?:\.\d)?)?", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-sa", "cc-by-sa-\\d\\.\\d", "cc by", r"cc[ -]by[ -]sa(?:[ -]\d(?:\.\d)?)?", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nd", "cc-by-nd-\\d\\.\\d", "cc by", r"cc[ -]by[ -]nd(?:[ -]\d(?:\.\d)?)?", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by", "cc-by-\\d\\.\\d", "cc by", r"cc[ -]by(?:[ -]\d(?:\.\d)?)?", r"creativecommons\.org/licenses/by/"),
    ("cc-by-nc-sa", "cc-by-nc-sa", "creative commons", r"creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike", None),
    ("cc-by-nc-nd", "cc-by-nc-nd", "creative commons", r"creative commons attribution[- ]non[- ]?commercial[- ]no[- ]?deriv(?:ative)?s?", None),
    ("cc-by-nc", "cc-by-nc", "creative commons", r"creative commons attribution[- ]non[- ]?commercial", None),
    ("cc-by-sa", "cc-by-sa", "creative commons", r"creative commons attribution[- ]share[- ]?alike", None),
    ("cc-by-nd", "cc-by-nd", "creative commons", r"creative commons attribution[- ]no[- ]?deriv(?:ative)?s?", None),
    ("cc-by", "cc-by", "creative commons", r"creative commons attribution", None),
]

#: Sentences of licence texts: label, keyword, regex, weight.
PHRASES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", 1.0),
    ("mit", "the above copyright notice", r"the above copyright notice and this permission notice shall be included in all", 0.9),
    ("mit", "the software is provided", r"the software is provided [\"']?as is[\"']?, without warranty of any kind", 0.8),
    ("isc", "permission to use, copy", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee", 1.0),
    ("bsd", "redistribution", r"redistributions? and use in source and binary forms", 1.0),
    ("bsd", "redistribution", r"redistributions of source code must retain the above copyright", 0.9),
    ("bsd", "redistribution", r"redistributions in binary form must reproduce the above copyright", 0.9),
    ("bsd-3-clause", "neither the name", r"neither the name of .{1,80}? nor the names of its contributors", 0.9),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software", 0.9),
    ("apache-2.0", "licensed under the apache", r"licensed under the apache licen[cs]e, version 2\.0", 1.0),
    ("apache-2.0", "except in compliance", r"you may not use this file except in compliance with the licen[cs]e", 0.7),
    ("apache-2.0", "distributed on an", r"distributed on an [\"']?as is[\"']? basis", 0.6),
    ("gpl", "free software; you can", r"this (?:program|library|file) is free software; you can redistribute it and/or modify", 0.9),
    ("gpl", "free software: you can", r"this (?:program|library|file) is free software: you can redistribute it and/or modify", 0.9),
    ("gpl", "any later version", r"either version \d(?:\.\d)?(?: of the licen[cs]e)?, or \(at your option\) any later version", 0.8),
    ("gpl", "hope that it will be useful", r"in the hope that it will be useful, but without any warranty", 0.8),
    ("gpl", "received a copy of the gnu", r"you should have received a copy of the gnu (?:lesser |affero |library )?general public licen[cs]e", 0.9),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public", 1.0),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public licen[cs]e", 1.0),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such", 1.0),
    ("zlib", "provided 'as-is'", r"this software is provided 'as-is', without any express or implied warranty", 0.8),
    ("bsl-1.0", "boost software", r"distributed under the boost software licen[cs]e", 1.0),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 1.0),
    ("epl-1.0", "accompanying program", r"the accompanying program is provided under the terms of this eclipse public", 0.9),
    ("ofl-1.1", "font software", r"this font software is licensed under the sil open font", 1.0),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 0.7),
    ("public-domain", "no copyright", r"no copyright is claimed", 0.5),
    ("proprietary", "all rights reserved", r"all rights reserved", 0.4),
    ("proprietary", "confidential", r"proprietary and confidential", 0.6),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|document|software)", 0.7),
    ("lgpl", "this library is free", r"this library is free software[;:] you can redistribute it and/or modify", 0.9),
    ("agpl-3.0", "affero", r"under the terms of the gnu affero general public licen[cs]e as published", 1.0),
    ("agpl-3.0", "remote network interaction", r"remote network interaction; use with the gnu general public licen[cs]e", 0.9),
    ("gfdl", "free documentation", r"copy, distribute and/or modify this document under the terms of the gnu free documentation", 1.0),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation", 0.8),
    ("apache-2.0", "limitations under the", r"governing permissions and limitations under the licen[cs]e", 0.6),
    ("apache-2.0", "terms and conditions for use", r"terms and conditions for use, reproduction, and distribution", 0.8),
    ("mpl-2.0", "incompatible with secondary", r"incompatible with secondary licen[cs]es, as defined by", 0.8),
    ("epl-2.0", "accompanying materials", r"accompanying materials are made available under the terms of the eclipse public licen[cs]e,?(?: v\.? ?| version )2", 1.0),
    ("epl-1.0", "accompanying materials", r"accompanying materials are made available under the terms of the eclipse public licen[cs]e,?(?: v\.? ?| version )1", 1.0),
    ("cddl-1.0", "common development", r"subject to the terms of the common development and distribution licen[cs]e", 1.0),
    ("cpl-1.0", "common public", r"is provided under the terms of this common public licen[cs]e", 1.0),
    ("artistic-1.0", "artistic control", r"copyright holder maintains some semblance of artistic control over the development of the package", 1.0),
    ("artistic-2.0", "artistic licen", r"this package is distributed under the terms of the artistic licen[cs]e,? (?:version )?2", 0.9),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented", 0.9),
    ("libpng", "png reference library", r"the png reference library is supplied [\"']?as is", 1.0),
    ("bsl-1.0", "any person or organization", r"any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e", 1.0),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", 1.0),
    ("wtfpl", "what the f", r"you just do what the f\S{3} you want to", 1.0),
    ("python-2.0", "making python available", r"psf is making python available to licensee on an [\"']?as is", 1.0),
    ("php-3.01", "php software", r"this product includes php software, freely available from", 1.0),
    ("ofl-1.1", "goals of the open font", r"the goals of the open font licen[cs]e", 0.9),
    ("eupl-1.2", "eupl", r"licensed under the eupl(?:,? (?:version |v\.? ?)?1\.2)?", 0.9),
    ("ms-pl", "governs use of the accompanying", r"this licen[cs]e governs use of the accompanying software", 0.8),
    ("osl-3.0", "open software", r"licensed under the open software licen[cs]e", 0.9),
    ("afl-3.0", "academic free", r"licensed under the academic free licen[cs]e", 0.9),
    ("ncsa", "deal with the software", r"to deal with the software without restriction", 0.9),
    ("upl-1.0", "larger works", r"any and all copyright rights in the software, and any and all patent rights .{1,90}? larger works", 0.9),
    ("postgresql", "without a written agreement", r"without fee, and without a written agreement is hereby granted", 1.0),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project", 1.0),
    ("curl", "purpose with or without fee", r"software for any purpose with or without fee is hereby granted, provided that the above copyright", 0.8),
    ("w3c", "copying this work", r"by (?:obtaining, using and/or|obtaining and/or) copying this work, you", 1.0),
    ("x11", "x consortium", r"the name of the x consortium shall not be used in advertising", 1.0),
    ("vim", "unmodified copies of vim", r"no restrictions on distributing unmodified copies of vim", 1.0),
    ("sleepycat", "obtain complete source", r"redistributions in any form must be accompanied by information on how to obtain complete source code", 1.0),
    ("qpl-1.0", "q public", r"under the terms of the q public licen[cs]e", 0.9),
    ("odbl-1.0", "open database", r"the open database licen[cs]e \(odbl\) is a licen[cs]e agreement intended to allow users to freely share", 1.0),
    ("cc0-1.0", "dedicated the work", r"has dedicated the work to the public domain by waiving all", 1.0),
    ("cc-by", "for any purpose, even commercially", r"remix, transform, and build upon the material for any purpose, even commercially", 0.7),
    ("cc-by-nc", "for commercial purposes", r"you may not use the material for commercial purposes", 0.8),
    ("bsd-2-clause", "views and conclusions", r"the views and conclusions contained in the software and documentation are those of the authors", 0.7),
    ("isc", "disclaims all warranties", r"the author disclaims all warranties with regard to this software", 0.7),
    ("ruby", "same terms as ruby", r"(?:under|on) the same terms as ruby", 0.9),
    ("gpl", "preamble", r"preamble the licen[cs]es for most software are designed to take away your freedom", 1.0),
    ("proprietary", "may not be reproduced", r"may not be reproduced,? (?:distributed )?.{0,60}?without (?:prior )?written permission", 0.7),
]

#: What may stand before a name: regex, rank, weight.
FORMS = [
    (r"(?:is |are )?(?:dual[- ])?licen[cs]ed under (?:the )?(?:terms of )?(?:the )?", 20, 0.98),
    (r"(?:is |are )?(?:released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?", 30, 0.95),
    (r"(?:subject to|governed by|in accordance with|according to|under) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?", 40, 0.9),
    ("", 60, 0.75),
]


def rules() -> list[Rule]:
    """All rules, the highest priority first."""
    made = [Rule(10, label, keyword, regex, weight) for label, keyword, regex, weight in PHRASES]
    for label, spdx, keyword, name, address in LICENCES:
        made.append(Rule(5, label, "spdx-license-identifier", rf"spdx-license-identifier:\s*(?:{spdx})(?![\w.+-])", 1.0))
        if address:
            host = address.split("/")[0].replace("\\", "").split("(")[0]
            made.append(Rule(50, label, host, rf"(?:https?://)?(?:www\.)?{address}\S*", 0.85))
        # A keyword is one literal, so a name written in two ways makes two rules.
        either = [(k, name.replace("cc[ -]by", k)) for k in ("cc by", "cc-by")] if keyword == "cc by" else [(keyword, name)]
        for literal, named in either:
            for before, rank, weight in FORMS:
                made.append(Rule(rank, label, literal, rf"(?<![\w-]){before}{named}(?!\w)", weight))
    return sorted(dict.fromkeys(made), key=lambda r: (r.rank, -len(r.regex)))
