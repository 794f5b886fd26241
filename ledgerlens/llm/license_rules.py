"""Signature rules of the license scan.

A rule is a regular expression over normalised text: words in lower case with
one space between them, so "GPL-3.0" reads "gpl 3 0". A rule names the keywords
of which every match holds one at least; they gate it. Rules come in tiers: a
smaller priority is the more specific evidence.

The texts of licenses (``TEXTS``), addresses (``ADDRESSES``) and names
(``FAMILIES``) are written by hand; the rules for tags, notices and references
are made of each family's name and versions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

TAG, TEXT, NOTICE, ADDRESS, VERSION, NAMED_NOTICE, NAME, HINT, BASE = 10, 20, 30, 35, 40, 50, 60, 70, 90
#: How sure a detection of a tier is of its label.
WEIGHT = {TAG: 0.99, TEXT: 0.97, NOTICE: 0.95, ADDRESS: 0.95, VERSION: 0.9, NAMED_NOTICE: 0.85, NAME: 0.7, HINT: 0.3, BASE: 0.6}


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    pattern: str
    keywords: tuple[str, ...]

    @cached_property
    def regex(self) -> re.Pattern:
        """Matches whole words only."""
        return re.compile(rf"(?<![^ ])(?:{self.pattern})(?![^ ])")


# The phrases of the contract and their labels.
BASE_PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: label, keywords, pattern of the name, versions. What follows " ~ " is too short to count
#: without a version or a notice.
FAMILIES = [
    ("gpl", "general public license|gpl", r"(?:gnu )?general public license(?: gpl)?|(?:gnu )?gpl", "1.0 2.0 3.0"),
    ("lgpl", "lesser|library general public license|lgpl", r"(?:gnu )?(?:lesser|library) general public license(?: lgpl)?|(?:gnu )?lgpl", "2.0 2.1 3.0"),
    ("agpl", "affero|agpl", r"(?:gnu )?affero general public license(?: agpl)?|(?:gnu )?agpl", "1.0 3.0"),
    ("gfdl", "free documentation license|gfdl", r"gnu free documentation license|(?:gnu )?gfdl", "1.1 1.2 1.3"),
    ("apache", "apache", r"apache(?: software)?(?: foundation)? licen[sc]e ~ apache", "1.0 1.1 2.0"),
    ("mpl", "mozilla public|mpl", r"mozilla public licen[sc]e(?: mpl)? ~ mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse|epl", r"eclipse public licen[sc]e(?: epl)? ~ epl", "1.0 2.0"),
    ("cddl", "common development|cddl", r"common development and distribution licen[sc]e(?: cddl)?|cddl", "1.0 1.1"),
    ("cpl", "common public license|cpl", r"common public license(?: cpl)? ~ cpl", "1.0"),
    ("cpal", "common public attribution|cpal", r"common public attribution license|cpal", "1.0"),
    ("eupl", "european union public|eupl", r"european union public licen[sc]e(?: eupl)?|eupl", "1.0 1.1 1.2"),
    ("cecill", "cecill", r"cecill(?: free software license(?: agreement)?)?", "1.0 1.1 2.0 2.1"),
    ("osl", "open software license|osl", r"open software license(?: osl)? ~ osl", "1.0 1.1 2.0 2.1 3.0"),
    ("afl", "academic free|afl", r"academic free license(?: afl)? ~ afl", "1.1 1.2 2.0 2.1 3.0"),
    ("apsl", "apple public source|apsl", r"apple public source license|apsl", "1.0 1.1 1.2 2.0"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[sc]e", "1.0 2.0"),
    ("bsl", "boost", r"boost software license", "1.0"),
    ("busl", "business source|busl", r"business source license|busl", "1.0 1.1"),
    ("ecl", "educational community|ecl", r"educational community license ~ ecl", "1.0 2.0"),
    ("efl", "eiffel forum", r"eiffel forum license", "1.0 2.0"),
    ("ipl", "ibm public", r"ibm public license", "1.0"),
    ("lppl", "latex project|lppl", r"latex project public license|lppl", "1.0 1.1 1.2 1.3a 1.3c"),
    ("lpl", "lucent public", r"lucent public license", "1.0 1.02"),
    ("ms-pl", "microsoft public|ms pl", r"microsoft public license ~ ms pl", ""),
    ("ms-rl", "microsoft reciprocal|ms rl", r"microsoft reciprocal license ~ ms rl", ""),
    ("nasa", "nasa open source", r"nasa open source agreement", "1.3"),
    ("npl", "netscape public", r"netscape public license", "1.0 1.1"),
    ("ofl", "open font license|ofl", r"(?:sil )?open font license(?: ofl)? ~ ofl", "1.0 1.1"),
    ("openssl", "openssl", r"openssl(?: project)? license", ""),
    ("php", "php license", r"php license", "3.0 3.01"),
    ("postgresql", "postgresql", r"postgresql license", ""),
    ("python", "python|psf license", r"python(?: software foundation)? license(?: agreement)?|psf license", "2.0"),
    ("qpl", "q public|qpl", r"q public license ~ qpl", "1.0"),
    ("rpl", "reciprocal public", r"reciprocal public license", "1.1 1.5"),
    ("ruby", "ruby license", r"ruby license", ""),
    ("sleepycat", "sleepycat", r"sleepycat license", ""),
    ("spl", "sun public", r"sun public license", "1.0"),
    ("sspl", "server side public|sspl", r"server side public license|sspl", "1.0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ""),
    ("upl", "universal permissive", r"universal permissive license", "1.0"),
    ("vim", "vim license", r"vim license", ""),
    ("w3c", "w3c software", r"w3c software(?: and document)?(?: notice and)? license", ""),
    ("wtfpl", "wtfpl|want to public license", r"wtfpl|do what the fuck you want to public license", "2.0"),
    ("x11", "x11 license", r"x11 license", ""),
    ("zlib", "zlib", r"zlib(?: libpng)? license", ""),
    ("zpl", "zope public|zpl", r"zope public license ~ zpl", "1.1 2.0 2.1"),
    ("mit", "mit license|expat license|mit expat license|mit x11 license", r"(?:the )?(?:mit license|expat license|mit expat license|mit x11 license)", ""),
    ("mit-0", "mit no attribution|mit 0", r"mit no attribution(?: license)? ~ mit 0(?: license)?", ""),
    ("isc", "isc", r"isc licen[sc]e", ""),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source license", ""),
    ("bsd", "bsd", r"(?:new |modified |revised |simplified |original |old )?bsd(?: style)? licen[sc]e", ""),
    ("bsd-2-clause", "bsd|freebsd", r"bsd 2 clause(?: license)?|2 clause bsd(?: license)?|two clause bsd(?: license)?|simplified bsd|free ?bsd license", ""),
    ("bsd-3-clause", "bsd", r"bsd 3 clause(?: license)?|3 clause bsd(?: license)?|three clause bsd(?: license)?|(?:new|modified|revised) bsd", ""),
    ("bsd-4-clause", "bsd", r"bsd 4 clause(?: license)?|4 clause bsd(?: license)?|four clause bsd(?: license)?|original bsd", ""),
    ("0bsd", "0bsd|zero clause bsd|bsd zero clause", r"0bsd(?: license)?|zero clause bsd(?: license)?|bsd zero clause(?: license)?", ""),
    ("odbl", "open database license|odbl", r"(?:open data commons )?open database license(?: odbl)?|odbl", "1.0"),
    ("odc-by", "open data commons attribution|odc by", r"open data commons attribution license ~ odc by", "1.0"),
    ("pddl", "public domain dedication and license|pddl", r"(?:open data commons )?public domain dedication and license(?: pddl)?|pddl", "1.0"),
    ("mulan-psl", "mulan", r"mulan permissive software license|mulan psl", "1.0 2.0"),
    ("elastic", "elastic license", r"elastic license", "1.0 2.0"),
    ("commons-clause", "commons clause", r"commons clause(?: license condition)?", "1.0"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use) license", "1.0.0"),
    ("json", "json license", r"json license", ""),
    ("hpnd", "historical permission notice", r"historical permission notice and disclaimer", ""),
    ("beerware", "beerware|beer ware", r"beer ?ware license", ""),
    ("cc0", "cc0|creative commons zero", r"(?:creative commons )?cc0|creative commons zero", "1.0"),
    ("openrail", "openrail|open rail", r"(?:creativeml )?(?:bigscience )?open ?rail(?: m| s| d)?(?: license)?", ""),
    ("llama", "llama", r"llama(?: [234](?: [0-9])?)? community license(?: agreement)?", ""),
    ("ogl", "open government licence|open government license", r"open government licen[sc]e", "1.0 2.0 3.0"),
]

#: Parts of the Creative Commons licenses: short form and words.
CC_PARTS = {"by": "attribution", "nc": r"non ?commercial", "nd": r"no ?deriv(?:ative|ativework)?s?", "sa": r"share ?alike"}
CC_KINDS = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"

#: label, keyword, pattern: sentences of the licenses and of their usual notices.
TEXTS = [
    ("mit", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: \S+){0,6} deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is", r"the software is provided as is without warranty of any kind express or implied"),
    ("mit-0", "to whom the software is furnished", r"to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "shall not be used in advertising", r"except as contained in this notice the names? of (?:\S+ ){1,12}shall not be used in advertising"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("hpnd", "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted"),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote products", r"neither the names? of (?:\S+ ){1,16}may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", "no express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-2.0", "you may not use this file except in compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache license version 2 0 january 2004", r"apache license version 2 0 january 2004"),
    ("apache-2.0", "grant of patent license", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-2.0", "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-1.1", "this product includes software developed by the apache", r"this product includes software developed by the apache (?:group|software foundation)"),
    ("gpl", "this program is free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3.0", "either version 3 of the license", r"gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", "either version 2 of the license", r"gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", "version 3 29 june 2007", r"gnu general public license version 3 29 june 2007"),
    ("gpl-2.0", "version 2 june 1991", r"gnu general public license version 2 june 1991"),
    ("gpl-1.0", "version 1 february 1989", r"gnu general public license version 1 february 1989"),
    ("gpl", "you should have received a copy of the gnu", r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "everyone is permitted to copy", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-3.0", "the gnu general public license is a free copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl", "you should have received a copy of the gnu", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)"),
    ("lgpl-2.1", "version 2 1 february 1999", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "version 3 29 june 2007", r"gnu lesser general public license version 3 29 june 2007"),
    ("lgpl", "this library is free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl-3.0", "version 3 19 november 2007", r"gnu affero general public license version 3 19 november 2007"),
    ("agpl", "you should have received a copy of the gnu", r"you should have received a copy of the gnu affero general public license along with this program"),
    ("gfdl", "permission is granted to copy distribute and or modify this document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "this source code form is subject to", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("npl", "the contents of this file are subject to the netscape", r"the contents of this file are subject to the netscape public license"),
    ("epl-2.0", "eclipse public license 2 0 which", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which"),
    ("epl-1.0", "eclipse public license v1 0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cddl", "the contents of this file are subject to the terms of the common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("bsl-1.0", "distributed under the boost software license", r"distributed under the boost software license version 1 0"),
    ("zlib", "this software is provided as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "the origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "this is free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "you just do what the", r"you just do what the fuck you want to"),
    ("beerware", "you can buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", "shall be used for good", r"the software shall be used for good not evil"),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim", r"the artistic license 2 0 (?:\S+ ){0,12}everyone is permitted to copy and distribute verbatim copies"),
    ("artistic-1.0", "the intent of this document is to state the conditions", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("perl", "under the same terms as perl", r"(?:redistribute it and or modify it )?under the same terms as perl itself"),
    ("ofl-1.1", "this font software is licensed under", r"this font software is licensed under the sil open font license version 1 1"),
    ("openssl", "this product includes software developed by the openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ncsa", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person (?:\S+ ){0,40}to deal with the software without restriction"),
    ("cc0-1.0", "to the extent possible under law", r"to the extent possible under law (?:\S+ ){1,16}has waived all copyright and related or neighbou?ring rights"),
    ("cc-by", "you are free to share copy", r"you are free to share copy and redistribute the material in any medium or format"),
    ("cc", "some rights reserved", r"some rights reserved"),
    ("commons-clause", "the grant of rights under the license will not include", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("sspl-1.0", "if you make the functionality of the program", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("python-2.0", "python software foundation license version 2", r"python software foundation license version 2"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|put|donated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", r"(?:this (?:work|file|software|document|image)|it) is in the public domain"),
    ("proprietary", "proprietary and confidential", r"(?:unauthorized copying (?:\S+ ){1,12})?(?:strictly prohibited )?proprietary and confidential"),
    ("proprietary", "no part of this", r"no part of this (?:publication|book|document|work|software) may be reproduced"),
    ("proprietary", "end user license agreement", r"end user license agreement"),
]

#: label, keyword, pattern: addresses of license texts.
ADDRESSES = [
    ("apache-2.0", "apache org licenses", r"(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("mit", "opensource org licenses", r"opensource org licenses? mit(?: license)?(?: php| html)?"),
    ("bsd-2-clause", "opensource org licenses", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource org licenses", r"opensource org licenses? bsd 3 clause"),
    ("isc", "opensource org licenses", r"opensource org licenses? isc"),
    ("gpl-2.0", "gnu org licenses", r"(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?"),
    ("gpl-3.0", "gnu org licenses", r"(?:www )?gnu org licenses gpl 3 0(?: html| txt)?"),
    ("gpl", "gnu org licenses", r"(?:www )?gnu org licenses gpl(?: html| txt)?"),
    ("lgpl", "gnu org licenses", r"(?:www )?gnu org licenses lgpl(?: html| txt)?"),
    ("agpl", "gnu org licenses", r"(?:www )?gnu org licenses agpl(?: html| txt)?"),
    ("gfdl", "gnu org licenses", r"(?:www )?gnu org licenses fdl(?: html| txt)?"),
    ("mpl-2.0", "mozilla org", r"(?:www )?mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1.1", "mozilla org", r"(?:www )?mozilla org mpl(?: mpl 1 1)?(?: html)?"),
    ("epl-2.0", "eclipse org", r"(?:www )?eclipse org legal epl (?:v20|2 0)"),
    ("epl-1.0", "eclipse org", r"(?:www )?eclipse org legal epl v10"),
    ("bsl-1.0", "boost org", r"(?:www )?boost org license 1 0(?: txt)?"),
    ("ofl", "scripts sil org", r"scripts sil org ofl"),
    ("cc0-1.0", "creativecommons org publicdomain", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org publicdomain", r"creativecommons org publicdomain mark 1 0"),
    ("unlicense", "unlicense org", r"unlicense org"),
    ("wtfpl", "wtfpl net", r"(?:www )?wtfpl net"),
    ("odbl-1.0", "opendatacommons org", r"(?:www )?opendatacommons org licenses odbl(?: 1 0)?"),
    ("ogl", "nationalarchives gov uk", r"nationalarchives gov uk doc open government licence(?: version [123])?"),
]

HINTS = [
    ("copyright", "all rights reserved", r"all rights? reserved"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("license-file", "see license", r"see license(?: txt| md)?(?: file)? for (?:more )?(?:details|information|terms)"),
    ("license-file", "license file", r"see the (?:accompanying )?license file"),
]

_NOTICE = (r"(?:licen[sc]ed|released|distributed|redistributed|published|provided|covered|available|offered|shared|used)(?: \S+){0,3} "
           r"(?:under|by|with|through|subject to|in accordance with)(?: an?| the)?(?: terms(?: and conditions)? of)?(?: an?| the)? ")


def _version(v: str) -> str:
    """A version as it is written after a name: "3 0", "v3", "version 3 0 or later"."""
    parts = v.split(".")
    tail = "".join(f" {p}" for p in parts[1:])
    number = parts[0] + (f"(?:{tail})?" if set(parts[1:]) <= {"0"} else tail)
    return rf"(?: licen[sc]e)?(?: version| ver| v)? v?{number}(?: or later| or newer| only| or any later version)?"


def _of_family(label: str, keywords: str, name: str, versions: str) -> list[Rule]:
    keys = tuple(keywords.split("|"))
    alone, _, short = name.partition(" ~ ")
    name = f"{alone}|{short}" if short else alone
    tag = label.replace("-", " ")
    tag_keys = (f"spdx license identifier {tag}",)
    rules = [Rule(f"tag:{label}", label, TAG, rf"spdx license identifier {tag}", tag_keys),
             Rule(f"notice:{label}", label, NAMED_NOTICE, _NOTICE + rf"(?:{name})", keys), Rule(f"name:{label}", label, NAME, alone, keys)]
    for v in versions.split():
        one = f"{label}-{v}"
        rules += [Rule(f"tag:{one}", one, TAG, rf"spdx license identifier {tag} {v.replace('.', ' ')}(?: only| or later)?", tag_keys),
                  Rule(f"notice:{one}", one, NOTICE, _NOTICE + rf"(?:{name}){_version(v)}", keys),
                  Rule(f"version:{one}", one, VERSION, rf"(?:{name}){_version(v)}", keys)]
        if label in ("gpl", "lgpl", "agpl"):  # written as one word
            rules.append(Rule(f"glued:{one}", one, VERSION, f"(?:gnu )?{label}v{v.replace('.', ' ').removesuffix(' 0')}(?: 0)?", (f"{label}v{v[0]}",)))
    return rules


def _creative_commons() -> list[Rule]:
    keys, rules = ("cc by", "creative commons", "creativecommons org licenses"), []
    for kind in CC_KINDS:
        short = "cc " + kind.replace("-", " ")
        name = rf"(?:creative commons )?{short}|creative commons {' '.join(CC_PARTS[p] for p in kind.split('-'))}"
        rules += [Rule(f"notice:cc-{kind}", f"cc-{kind}", NAMED_NOTICE, _NOTICE + rf"(?:{name})(?: international)?(?: licen[sc]e)?", keys),
                  Rule(f"name:cc-{kind}", f"cc-{kind}", NAME, rf"(?:{name})(?: licen[sc]e)?", keys)]
        for v in CC_VERSIONS.split():
            one, number = f"cc-{kind}-{v}", v.replace(".", " ")
            versioned = rf"(?:{name})(?: licen[sc]e)?(?: version| v)? {number}(?: international| unported| generic)?(?: licen[sc]e)?"
            rules += [Rule(f"notice:{one}", one, NOTICE, _NOTICE + versioned, keys), Rule(f"version:{one}", one, VERSION, versioned, keys),
                      Rule(f"tag:{one}", one, TAG, rf"spdx license identifier {short} {number}", ("spdx license identifier cc",)),
                      Rule(f"address:{one}", one, ADDRESS, rf"creativecommons org licenses {kind.replace('-', ' ')} {number}", keys)]
    return rules


def default_rules() -> list[Rule]:
    """All rules, by priority; within one, as written."""
    rules = [r for f in FAMILIES for r in _of_family(*f)] + _creative_commons()
    for kind, priority, rows in (("text", TEXT, TEXTS), ("address", ADDRESS, ADDRESSES), ("hint", HINT, HINTS)):
        rules += [Rule(f"{kind}:{label}:{i}", label, priority, pattern, (key,)) for i, (label, key, pattern) in enumerate(rows)]
    rules += [Rule(f"base:{label}", label, BASE, phrase, (phrase,)) for phrase, label in BASE_PHRASES]
    return sorted(rules, key=lambda r: r.priority)
