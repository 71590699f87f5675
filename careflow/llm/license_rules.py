"""Signature rules of license texts, over normalised words (lower-case ASCII, one space between words).

``FAMILIES`` lists, for each keyword, the licenses that are only meant where this word occurs: label, what the license
is called in prose, and its short identifier. ``LEADS`` are the ways in which texts refer to a name; each name
with each lead is one rule. ``NOTICES`` are sentences of the licenses themselves. Priorities: 1 a sentence of the
license, 2 a reference that says the work is under it, 3 an identifier, 4 the bare name.
"""

from __future__ import annotations

import re

# Names, identifiers and sentences of public licenses. {v} stands for an optional "version" or "v".
# keyword: (label, names in prose, identifiers)
FAMILIES: dict[str, list[tuple[str, str, str]]] = {
    "mit": [
        ("mit", "mit(?: x11| expat)?(?: style)? licen[cs]e", "mit"),
        ("mit-0", "mit no attribution(?: licen[cs]e)?", "mit 0"),
    ],
    "expat": [("mit", "expat licen[cs]e", "expat")],
    "x11": [("x11", "x11 licen[cs]e", "x11")],
    "apache": [
        ("apache-2", "apache(?: software)? licen[cs]e{v}2(?: 0)?", "apache{v}2(?: 0)?"),
        ("apache-1.1", "apache(?: software)? licen[cs]e{v}1 1", "apache 1 1"),
        ("apache-1", "apache(?: software)? licen[cs]e{v}1 0", "apache 1 0"),
        ("apache", "apache(?: software)? licen[cs]e", "apache licen[cs]e"),
    ],
    "asl": [("apache-2", "asl{v}2(?: 0)?", "asl 2(?: 0)?")],
    "bsd": [
        ("bsd-2", "(?:2 clause|two clause|simplified|freebsd) bsd licen[cs]e", "bsd 2 clause"),
        ("bsd-2", "bsd (?:2 clause|two clause)(?: licen[cs]e)?", "bsd 2"),
        ("bsd-2-patent", "bsd 2 clause (?:plus )?patent(?: licen[cs]e)?", "bsd 2 clause patent"),
        ("bsd-3", "(?:3 clause|three clause|new|modified|revised) bsd licen[cs]e", "bsd 3 clause"),
        ("bsd-3", "bsd (?:3 clause|three clause)(?: licen[cs]e)?", "bsd 3"),
        ("bsd-3-clear", "bsd 3 clause clear(?: licen[cs]e)?", "bsd 3 clause clear"),
        ("bsd-4", "(?:4 clause|four clause|original|old) bsd licen[cs]e", "bsd 4 clause"),
        ("bsd-4", "bsd (?:4 clause|four clause)(?: licen[cs]e)?", "bsd 4"),
        ("0bsd", "(?:zero clause|0 clause) bsd licen[cs]e", "bsd 0 clause"),
        ("bsd", "bsd(?: style)? licen[cs]e", "bsd"),
    ],
    "0bsd": [("0bsd", "0bsd licen[cs]e", "0bsd")],
    "gpl": [
        ("gpl-1", "(?:gnu )?gpl{v}1(?: 0)?(?: only)?", "gpl 1 0(?: only)?"),
        ("gpl-2", "(?:gnu )?gpl{v}2(?: 0)?(?: only)?", "gpl 2 0(?: only)?"),
        ("gpl-2+", "(?:gnu )?gpl{v}2(?: 0)? or(?: any)? (?:later|newer)", "gpl 2 0 or later"),
        ("gpl-2-classpath", "(?:gnu )?gpl{v}2(?: 0)? with(?: the)? classpath exception", "gpl 2 0 with classpath exception"),
        ("gpl-3", "(?:gnu )?gpl{v}3(?: 0)?(?: only)?", "gpl 3 0(?: only)?"),
        ("gpl-3+", "(?:gnu )?gpl{v}3(?: 0)? or(?: any)? (?:later|newer)", "gpl 3 0 or later"),
        ("gpl", "gnu gpl", "gpl"),
    ],
    "agpl": [
        ("agpl-3", "(?:gnu )?agpl{v}3(?: 0)?(?: only)?", "agpl 3 0(?: only)?"),
        ("agpl-3+", "(?:gnu )?agpl{v}3(?: 0)? or(?: any)? (?:later|newer)", "agpl 3 0 or later"),
        ("agpl", "gnu agpl", "agpl"),
    ],
    "lgpl": [
        ("lgpl-2", "(?:gnu )?lgpl{v}2(?: 0)?(?: only)?", "lgpl 2 0(?: only)?"),
        ("lgpl-2.1", "(?:gnu )?lgpl{v}2 1(?: only)?", "lgpl 2 1(?: only)?"),
        ("lgpl-2.1+", "(?:gnu )?lgpl{v}2 1 or(?: any)? (?:later|newer)", "lgpl 2 1 or later"),
        ("lgpl-3", "(?:gnu )?lgpl{v}3(?: 0)?(?: only)?", "lgpl 3 0(?: only)?"),
        ("lgpl-3+", "(?:gnu )?lgpl{v}3(?: 0)? or(?: any)? (?:later|newer)", "lgpl 3 0 or later"),
        ("lgpl", "gnu lgpl", "lgpl"),
    ],
    "general": [
        ("gpl-1", "gnu general public licen[cs]e{v}1(?: 0)?", "gnu gpl 1"),
        ("gpl-2", "gnu general public licen[cs]e{v}2(?: 0)?", "gnu gpl 2"),
        ("gpl-2+", "gnu general public licen[cs]e{v}2(?: 0)? or(?: at your option)?(?: any)? (?:later|newer)", "gnu gpl 2 or later"),
        ("gpl-3", "gnu general public licen[cs]e{v}3(?: 0)?", "gnu gpl 3"),
        ("gpl-3+", "gnu general public licen[cs]e{v}3(?: 0)? or(?: any)? (?:later|newer)", "gnu gpl 3 or later"),
        ("gpl", "gnu general public licen[cs]e", "gnu general public licen[cs]e"),
        ("lgpl-2", "gnu (?:lesser|library) general public licen[cs]e{v}2(?: 0)?", "gnu lgpl 2"),
        ("lgpl-2.1", "gnu lesser general public licen[cs]e{v}2 1", "gnu lgpl 2 1"),
        ("lgpl-3", "gnu lesser general public licen[cs]e{v}3(?: 0)?", "gnu lgpl 3"),
        ("lgpl", "gnu (?:lesser|library) general public licen[cs]e", "gnu lgpl"),
        ("agpl-3", "gnu affero general public licen[cs]e{v}3(?: 0)?", "gnu agpl 3"),
        ("agpl", "(?:gnu )?affero general public licen[cs]e", "gnu agpl"),
    ],
    "documentation": [("gfdl", "gnu free documentation licen[cs]e{v}1 [123]", "gfdl 1 [123]"), ("gfdl", "gnu free documentation licen[cs]e", "gfdl")],
    "mozilla": [
        ("mpl-2", "mozilla public licen[cs]e{v}2(?: 0)?", "mozilla 2 0"),
        ("mpl-1.1", "mozilla public licen[cs]e{v}1 1", "mozilla 1 1"),
        ("mpl-1", "mozilla public licen[cs]e{v}1 0", "mozilla 1 0"),
        ("mpl", "mozilla public licen[cs]e", "mozilla public licen[cs]e"),
    ],
    "mpl": [
        ("mpl-2", "mpl{v}2(?: 0)?", "mpl 2 0"),
        ("mpl-2-no-copyleft", "mpl{v}2(?: 0)? no copyleft exception", "mpl 2 0 no copyleft exception"),
        ("mpl-1.1", "mpl{v}1 1", "mpl 1 1"),
    ],
    "eclipse": [
        ("epl-2", "eclipse public licen[cs]e{v}2(?: 0)?", "eclipse 2 0"),
        ("epl-1", "eclipse public licen[cs]e{v}1(?: 0)?", "eclipse 1 0"),
        ("edl-1", "eclipse distribution licen[cs]e{v}1(?: 0)?", "eclipse distribution 1 0"),
    ],
    "epl": [("epl-2", "epl{v}2(?: 0)?", "epl 2 0"), ("epl-1", "epl{v}1(?: 0)?", "epl 1 0")],
    "edl": [("edl-1", "edl{v}1(?: 0)?", "edl 1 0")],
    "common": [("cpl-1", "common public licen[cs]e{v}1 0", "common public licen[cs]e"), ("cpal-1", "common public attribution licen[cs]e", "cpal 1 0")],
    "development": [("cddl-1", "common development and distribution licen[cs]e(?: version| v)?(?: 1 [01])?", "development and distribution licen[cs]e")],
    "cddl": [("cddl-1", "cddl{v}1(?: [01])?", "cddl(?: 1 [01])?")],
    "european": [("eupl", "european union public licen[cs]e(?: version| v)?(?: 1 [12])?", "european union public licen[cs]e")],
    "eupl": [("eupl", "eupl{v}1(?: [12])?", "eupl(?: 1 [12])?")],
    "boost": [("bsl-1", "boost software licen[cs]e(?: version)?(?: 1 0)?", "boost 1 0")],
    "bsl": [("bsl-1", "bsl 1 0", "bsl 1 0"), ("busl-1.1", "bsl 1 1", "bsl 1 1")],
    "artistic": [
        ("artistic-2", "artistic licen[cs]e{v}2(?: 0)?", "artistic 2 0"),
        ("artistic-1", "artistic licen[cs]e{v}1(?: 0)?", "artistic 1 0"),
        ("artistic-1-perl", "perl artistic licen[cs]e", "artistic 1 0 perl"),
        ("artistic-1-clarified", "clarified artistic licen[cs]e", "clartistic"),
    ],
    "isc": [("isc", "isc(?: style)? licen[cs]e", "isc")],
    "zlib": [("zlib", "zlib(?: libpng)? licen[cs]e", "zlib")],
    "libpng": [("libpng", "libpng licen[cs]e(?: version 2)?", "libpng(?: 2 0)?")],
    "unlicense": [("unlicense", "the unlicense", "unlicense")],
    "wtfpl": [("wtfpl", "wtfpl(?: version| v)?(?: 2)?", "wtfpl")],
    "beerware": [("beerware", "beerware licen[cs]e", "beerware")],
    "python": [
        ("psf-2", "python software foundation licen[cs]e(?: version)?(?: 2)?", "python 2 0(?: 1)?"),
        ("cnri-python", "cnri python licen[cs]e", "cnri python"),
    ],
    "psf": [("psf-2", "psf licen[cs]e(?: agreement)?", "psf 2 0")],
    "php": [("php-3", "php licen[cs]e(?: version| v)?(?: 3(?: 0| 01)?)?", "php 3 01"), ("php-3", "php licen[cs]e", "php 3 0")],
    "ruby": [("ruby", "ruby licen[cs]e", "ruby")],
    "perl": [("perl", "same terms as perl(?: itself)?", "perl")],
    "postgresql": [("postgresql", "postgresql licen[cs]e", "postgresql")],
    "font": [("ofl-1.1", "sil open font licen[cs]e(?: version)?(?: 1 1)?", "sil open font licen[cs]e"), ("ubuntu-font", "ubuntu font licen[cs]e", "ubuntu font 1 0")],
    "ofl": [("ofl-1.1", "sil ofl(?: 1 1)?", "ofl(?: 1 1)?")],
    "openssl": [("openssl", "openssl licen[cs]e", "openssl")],
    "ssleay": [("openssl", "ssleay licen[cs]e", "ssleay")],
    "curl": [("curl", "curl licen[cs]e", "curl")],
    "ncsa": [("ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa")],
    "w3c": [("w3c", "w3c(?: software(?: notice and)?)? licen[cs]e", "w3c(?: 20150513)?")],
    "icu": [("icu", "icu licen[cs]e", "icu")],
    "unicode": [("unicode", "unicode(?: data files and software)? licen[cs]e(?: v3)?", "unicode (?:3 0|dfs 201[56])")],
    "tcl": [("tcl", "tcl tk licen[cs]e", "tcl")],
    "hpnd": [("hpnd", "hpnd licen[cs]e", "hpnd")],
    "vim": [("vim", "vim licen[cs]e", "vim")],
    "zope": [("zpl-2.1", "zope public licen[cs]e{v}2 1", "zope 2 1"), ("zpl", "zope public licen[cs]e", "zope")],
    "zpl": [("zpl-2.1", "zpl{v}2 1", "zpl 2 1")],
    "ibm": [("ipl-1", "ibm public licen[cs]e", "ibm public licen[cs]e")],
    "academic": [("afl-3", "academic free licen[cs]e{v}3(?: 0)?", "academic 3 0"), ("afl", "academic free licen[cs]e", "academic free licen[cs]e")],
    "afl": [("afl-3", "afl{v}3(?: 0)?", "afl 3 0"), ("afl-2.1", "afl{v}2 1", "afl 2 1")],
    "osl": [("osl-3", "osl{v}3(?: 0)?", "osl 3 0"), ("osl-2.1", "osl{v}2 1", "osl 2 1")],
    "open": [
        ("osl-3", "open software licen[cs]e{v}3(?: 0)?", "open software 3 0"),
        ("ogl-3", "open government licen[cs]e(?: version| v)?(?: 3 0)?", "open government licen[cs]e"),
        ("odbl-1", "open (?:data commons open )?database licen[cs]e(?: version| v)?(?: 1 0)?", "open database licen[cs]e"),
        ("odc-by-1", "open data commons attribution licen[cs]e", "open data commons by 1 0"),
        ("pddl-1", "open data commons public domain dedication(?: and)? licen[cs]e", "open data commons pddl 1 0"),
        ("openrail", "open rail(?: m)? licen[cs]e", "open rail"),
    ],
    "openldap": [("oldap", "openldap public licen[cs]e(?: version 2 8)?", "openldap")],
    "openrail": [("openrail", "(?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?", "openrail(?: m)?")],
    "llama": [("llama", "llama(?: 2| 3)? community licen[cs]e", "llama")],
    "odbl": [("odbl-1", "odbl{v}1(?: 0)?", "odbl(?: 1 0)?")],
    "pddl": [("pddl-1", "pddl{v}1(?: 0)?", "pddl(?: 1 0)?")],
    "ogl": [("ogl-3", "ogl{v}3(?: 0)?", "ogl(?: uk)? 3 0")],
    "microsoft": [
        ("ms-pl", "microsoft public licen[cs]e", "microsoft public licen[cs]e"),
        ("ms-rl", "microsoft reciprocal licen[cs]e", "microsoft reciprocal licen[cs]e"),
    ],
    "ms": [("ms-pl", "ms pl licen[cs]e", "ms pl"), ("ms-rl", "ms rl licen[cs]e", "ms rl")],
    "server": [("sspl-1", "server side public licen[cs]e(?: version| v)?(?: 1)?", "server side public licen[cs]e")],
    "sspl": [("sspl-1", "sspl{v}1(?: 0)?", "sspl(?: 1 0)?")],
    "business": [("busl-1.1", "business source licen[cs]e(?: version)?(?: 1 1)?", "business source licen[cs]e")],
    "busl": [("busl-1.1", "busl{v}1 1", "busl 1 1")],
    "elastic": [("elastic-2", "elastic licen[cs]e{v}2(?: 0)?", "elastic 2 0"), ("elastic-1", "elastic licen[cs]e", "elastic licen[cs]e")],
    "commons": [("commons-clause", "commons clause(?: licen[cs]e)? condition", "commons clause")],
    "polyform": [
        ("polyform-nc", "polyform noncommercial licen[cs]e(?: 1 0 0)?", "polyform noncommercial 1 0 0"),
        ("polyform-sb", "polyform small business licen[cs]e(?: 1 0 0)?", "polyform small business 1 0 0"),
        ("polyform-shield", "polyform shield licen[cs]e(?: 1 0 0)?", "polyform shield 1 0 0"),
    ],
    "prosperity": [("prosperity", "prosperity public licen[cs]e", "prosperity 3 0 0")],
    "parity": [("parity", "parity public licen[cs]e", "parity 7 0 0")],
    "hippocratic": [("hippocratic", "hippocratic licen[cs]e", "hippocratic 2 1")],
    "anti": [("anti-996", "anti 996 licen[cs]e", "anti 996")],
    "blueoak": [("blueoak-1", "blueoak model licen[cs]e", "blueoak 1 0 0")],
    "oak": [("blueoak-1", "blue oak model licen[cs]e(?: 1 0 0)?", "oak 1 0 0")],
    "mulan": [("mulan-psl-2", "mulan permissive software licen[cs]e{v}2", "mulan psl 2 0"), ("mulan-psl-2", "mulan psl{v}2", "mulan psl 2"), ("mulan-psl", "mulan permissive software licen[cs]e", "mulan permissive software licen[cs]e")],
    "cecill": [("cecill-b", "cecill b(?: licen[cs]e)?", "cecill b"), ("cecill-c", "cecill c(?: licen[cs]e)?", "cecill c"), ("cecill-2.1", "cecill{v}2 1", "cecill 2 1"), ("cecill", "cecill licen[cs]e", "cecill")],
    "nasa": [("nasa-1.3", "nasa open source agreement(?: version| v)?(?: 1 3)?", "nasa 1 3")],
    "reciprocal": [("rpl-1.5", "reciprocal public licen[cs]e(?: 1 5)?", "rpl 1 5")],
    "sleepycat": [("sleepycat", "sleepycat licen[cs]e", "sleepycat")],
    "qpl": [("qpl-1", "qpl{v}1(?: 0)?", "qpl 1 0")],
    "sun": [("sissl", "sun industry standards source licen[cs]e", "sun industry standards source licen[cs]e"), ("spl-1", "sun public licen[cs]e", "sun public licen[cs]e")],
    "netscape": [("npl-1.1", "netscape public licen[cs]e{v}1 1", "netscape 1 1"), ("npl", "netscape public licen[cs]e", "netscape public licen[cs]e")],
    "apple": [("apsl-2", "apple public source licen[cs]e{v}2(?: 0)?", "apple 2 0"), ("apsl", "apple public source licen[cs]e", "apple public source licen[cs]e")],
    "apsl": [("apsl-2", "apsl{v}2(?: 0)?", "apsl 2 0")],
    "intel": [("intel", "intel(?: simplified software| open source) licen[cs]e", "intel")],
    "upl": [("upl-1", "upl{v}1(?: 0)?", "upl 1 0")],
    "universal": [("upl-1", "universal permissive licen[cs]e(?: v 1 0)?", "universal permissive licen[cs]e")],
    "json": [("json", "json licen[cs]e", "json")],
    "art": [("fal-1.3", "free art licen[cs]e(?: 1 3)?", "lal 1 3")],
    "publication": [("opubl-1", "open publication licen[cs]e{v}1(?: 0)?", "opubl 1 0")],
    "cern": [("cern-ohl-s", "cern ohl s(?: v2)?", "cern ohl s 2 0"), ("cern-ohl-w", "cern ohl w(?: v2)?", "cern ohl w 2 0"), ("cern-ohl-p", "cern ohl p(?: v2)?", "cern ohl p 2 0"), ("cern-ohl", "cern open hardware licen[cs]e", "cern ohl 1 2")],
    "ecl": [("ecl-2", "ecl{v}2(?: 0)?", "ecl 2 0")],
    "educational": [("ecl-2", "educational community licen[cs]e{v}2(?: 0)?", "educational community licen[cs]e")],
    "ntp": [("ntp", "ntp licen[cs]e", "ntp")],
    "naist": [("naist-2003", "naist(?: 2003)? licen[cs]e", "naist 2003")],
    "bzip2": [("bzip2", "bzip2(?: and libbzip2)? licen[cs]e", "bzip2 1 0 6")],
    "ijg": [("ijg", "ijg licen[cs]e", "ijg")],
    "freetype": [("ftl", "freetype(?: project)? licen[cs]e", "ftl")],
    "imagemagick": [("imagemagick", "imagemagick licen[cs]e", "imagemagick")],
    "latex": [("lppl-1.3", "latex project public licen[cs]e(?: version| v)?(?: 1 3c?)?", "latex project public licen[cs]e")],
    "lppl": [("lppl-1.3", "lppl{v}1 3c?", "lppl 1 3c?")],
    "creative": [
        ("cc0", "creative commons(?: cc0| zero)(?: 1 0)?(?: universal)?", "creative commons zero"),
        ("cc-by", "creative commons attribution(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?", "creative commons by"),
        ("cc-by-sa", "creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?", "creative commons by sa"),
        ("cc-by-nd", "creative commons attribution no ?deriv(?:s|atives)(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?", "creative commons by nd"),
        ("cc-by-nc", "creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?", "creative commons by nc"),
        ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?", "creative commons by nc sa"),
        ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?", "creative commons by nc nd"),
        ("cc", "creative commons licen[cs]e", "creative commons"),
    ],
    "cc": [
        ("cc-by", "cc by(?: [1234] [05])?(?: licen[cs]e)?", "cc by [1234] 0"),
        ("cc-by-sa", "cc by sa(?: [1234] [05])?(?: licen[cs]e)?", "cc by sa(?: [1234] 0)?"),
        ("cc-by-nd", "cc by nd(?: [1234] [05])?(?: licen[cs]e)?", "cc by nd(?: [1234] 0)?"),
        ("cc-by-nc", "cc by nc(?: [1234] [05])?(?: licen[cs]e)?", "cc by nc [1234] 0"),
        ("cc-by-nc-sa", "cc by nc sa(?: [1234] [05])?(?: licen[cs]e)?", "cc by nc sa(?: [1234] 0)?"),
        ("cc-by-nc-nd", "cc by nc nd(?: [1234] [05])?(?: licen[cs]e)?", "cc by nc nd(?: [1234] 0)?"),
    ],
    "cc0": [("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0")],
}

# (kind, priority, confidence, how a name or identifier is led in)
LEADS: list[tuple[str, int, float, str]] = [
    ("licensed", 2, 0.9, "(?:dual |double |re)?licen[cs]ed(?: to you| for use)? (?:under|by|with) (?:the |a |an )?(?:terms of the )?{name}"),
    ("released", 2, 0.9, "(?:released|distributed|published|available|provided|offered) under (?:the |a |an )?(?:terms of the )?{name}"),
    ("terms", 2, 0.85, "(?:terms|conditions) of (?:the |a |an )?{name}"),
    ("under", 2, 0.8, "under (?:the |a |an )?{name}"),
    ("licensed as", 3, 0.9, "(?:dual |double |re)?licen[cs]ed (?:under|as) (?:the )?{id}"),
    ("released as", 3, 0.85, "(?:released|distributed|published|available|provided|offered) under (?:the )?{id}"),
    ("tag", 3, 0.95, "(?:spdx licen[cs]e identifier|licen[cs]e) {id}"),
    ("name", 4, 0.5, "{name}"),
]

#: The label of "all rights reserved", which license headers say too.
PROPRIETARY = "proprietary"

# (keyword, label, regex of a sentence of the license)
NOTICES: list[tuple[str, str, str]] = [
    ("hereby", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("sublicense", "mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("substantial", "mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("noninfringement", "mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("tort", "mit", "whether in an action of contract tort or otherwise arising from out of or in connection with the software"),
    ("fee", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("disclaims", "isc", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("tortious", "isc", "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("redistribution", "bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("redistributions", "bsd", "redistributions of source code must retain the above copyright notice"),
    ("redistributions", "bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("contributors", "bsd", "this software is provided by the (?:copyright holders and contributors|regents and contributors|author and contributors) as is"),
    ("exemplary", "bsd", "be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("neither", "bsd-3", "neither the name of (?:the )?[^ ]+(?: [^ ]+){0,8} nor the names of (?:its|any) contributors"),
    ("endorse", "bsd-3", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("advertising", "bsd-4", "all advertising materials mentioning features or use of this software must display"),
    ("compliance", "apache-2", "you may not use this file except in compliance with the license"),
    ("obtain", "apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("warranties", "apache-2", "distributed on an as is basis without warranties or conditions of any kind"),
    ("irrevocable", "apache-2", "perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? (?:copyright|patent) license"),
    ("asf", "apache-2", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("redistribute", "gpl", "this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu"),
    ("hope", "gpl", "distributed in the hope that it will be useful but without any warranty"),
    ("franklin", "gpl", "free software foundation inc 51 franklin st(?:reet)?"),
    ("verbatim", "gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("copyleft", "gpl", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("later", "gpl-2+", "version 2 of the license or (?:at your option )?any later version"),
    ("later", "gpl-3+", "version 3 of the license or (?:at your option )?any later version"),
    ("later", "lgpl-2.1+", "version 2 1 of the license or (?:at your option )?any later version"),
    ("classpath", "gpl-2-classpath", "subject to the classpath exception as provided"),
    ("linking", "gpl-2-classpath", "linking this library statically or dynamically with other modules is making a combined work"),
    ("network", "agpl-3", "all users interacting with it remotely through a computer network"),
    ("mozilla", "mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("secondary", "mpl-2-no-copyleft", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("basis", "mpl-1.1", "software distributed under the license is distributed on an as is basis without warranty of any kind either express(?:ed)? or implied see the license for the specific language governing rights and limitations"),
    ("express", "zlib", "this software is provided as is without any express or implied warranty"),
    ("altered", "zlib", "altered source versions must be plainly marked as such"),
    ("misrepresented", "zlib", "the origin of this software must not be misrepresented"),
    ("unencumbered", "unlicense", "this is free and unencumbered software released into the public domain"),
    ("detriment", "unlicense", "for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("domain", "public-domain", "(?:dedicated|placed|released|is in) (?:to |in |into )?the public domain"),
    ("waived", "cc0", "has waived all copyright and related or neighboring rights"),
    ("relinquish", "cc0", "relinquish all copyright and related rights"),
    ("fuck", "wtfpl", "(?:do|just do) what the fuck you want to(?: public license)?"),
    ("beer", "beerware", "you can buy me a beer in return"),
    ("accompanying", "epl", "this program and the accompanying materials are made available under the terms of the eclipse"),
    ("documentation", "gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation"),
    ("invariant", "gfdl", "with no invariant sections(?: with)? no front cover texts and no back cover texts"),
    ("accompanying", "bsl-1", "free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("derivative", "bsl-1", "unless such copies or derivative works are solely in the form of machine executable object code"),
    ("reserved", "ofl-1.1", "with reserved font name"),
    ("font", "ofl-1.1", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("package", "artistic-2", "you may distribute modified versions of the package as source"),
    ("perl", "perl", "you can redistribute it and or modify it under the same terms as perl itself"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("cryptographic", "openssl", "this product includes cryptographic software written by eric young"),
    ("php", "php-3", "this source file is subject to version 3 0?1? ?of the php license"),
    ("illinois", "ncsa", "neither the names of [^ ]+(?: [^ ]+){0,8} university of illinois"),
    ("jpeg", "ijg", "this software is based in part on the work of the independent jpeg group"),
    ("evil", "json", "the software shall be used for good not evil"),
    ("redistributing", "sleepycat", "redistributing(?: in any form)? must be accompanied by information on how to obtain complete source code"),
    ("production", "busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("managed", "elastic-2", "you may not provide the software to third parties as a hosted or managed service"),
    ("service", "sspl-1", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("sell", "commons-clause", "the license does not grant to you the right to sell the software"),
    ("noncommercial", "polyform-nc", "any noncommercial purpose is a permitted purpose"),
    ("licence", "eupl", "unless required by applicable law or agreed to in writing software distributed under the licence is distributed on an as is basis"),
    ("eupl", "eupl", "licensed under the eupl"),
    ("cecill", "cecill", "this software is governed by the cecill(?: [bc])? license under french law"),
    ("confidential", PROPRIETARY, "this software is (?:the )?(?:confidential and proprietary|proprietary and confidential)(?: information)?"),
    ("unauthorized", PROPRIETARY, "unauthorized (?:copying|reproduction|use|distribution)(?: of this (?:file|software|document))?(?: via any medium)? is (?:strictly )?prohibited"),
    ("reserved", PROPRIETARY, "(?:copyright )?(?:[0-9]{4} )?(?:[^ ]+ ){0,4}all rights reserved"),
]


_OPTIONAL = re.compile(r"\(\?:[^()]*\)\?")
VERSION = "(?: version| v| release)? ?v?"


def rules() -> list[dict]:
    """All rules in order: kind, keyword, keywords, licen, label, regex, priority, confidence. A rule matches whole words only.

    Every match has one of ``keywords`` as a word: ``keyword`` (for identifiers, their first word) or, where a version may
    follow it without a space, the two as one word, as in gpl2 and gplv2. ``licen`` is true where no match is possible
    without these letters, which most texts don't hold.
    """
    out = [
        {"kind": "notice", "keyword": keyword, "label": label, "regex": regex, "priority": 1, "confidence": 1.0}
        for keyword, label, regex in NOTICES
    ]
    for keyword, family in FAMILIES.items():
        for label, name, identifier in family:
            for kind, priority, confidence, lead in LEADS:
                out.append(
                    {
                        "kind": kind,
                        "keyword": re.match("[a-z0-9]+", identifier)[0] if "{id}" in lead else keyword,
                        "label": label,
                        "regex": lead.replace("{name}", f"(?:{name})").replace("{id}", f"(?:{identifier})"),
                        "priority": priority,
                        "confidence": confidence,
                    }
                )
    for rule in out:
        numbers = re.findall(rf"(?<![a-z0-9]){rule['keyword']}\{{v\}}([0-9])", rule["regex"])
        rule["keywords"] = (rule["keyword"], *(f"{rule['keyword']}{v}{n}" for n in dict.fromkeys(numbers) for v in ("", "v")))
        regex = rule["regex"].replace("{v}", VERSION)
        rule["licen"] = bool(re.search(r"licen(?:\[cs\]|s)e", _OPTIONAL.sub("", regex)))
        rule["regex"] = f"(?<![^ ])(?:{regex})(?![^ ])"
    return out
