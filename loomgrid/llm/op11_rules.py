"""The signature rules of licence scans.

Patterns are over words as op11_license makes them: lower case, whatever is not a letter, digit or character beyond ASCII
is one space. So "CC BY-SA 4.0" is "cc by sa 4 0". A rule's gates are words of which every match holds at least one.

Each licence below has a name, an identifier and an address; FORMS makes rules of them. TEXTS are passages of the
licences' own wording, BASE the phrases that every scan counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Of overlapping detections the one of higher priority stays; confidences enter a document's score.
PRIORITY = {"text": 70, "identifier": 60, "address": 50, "grant": 40, "field": 30, "name": 20, "base": 10}
CONFIDENCE = {"text": 0.98, "identifier": 0.99, "address": 0.9, "grant": 0.95, "field": 0.85, "name": 0.75, "base": 0.5}

#: (phrase, label): the contract's own phrases; fixed values.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]


def v(major: int, minor: int | None = None) -> str:
    """A version after a name: "version 2.0", "v2", "v 2 0", "2"."""
    tail = f"(?: {minor})" + "?" * (minor == 0) if minor is not None else ""
    return f"(?: version| ver| v)? v?{major}{tail}"


L = "licen[cs]e"
LATER = "(?: only| or later| or newer| or any later version| or at your option any later version)?"

#: (label, gates, name, identifier, address): hand-written; an empty pattern makes no rule.
LICENSES = [
    ("agpl-1.0", "affero agpl agplv1", f"affero general public {L}{v(1, 0)}", "agpl 1 0(?: only| or later)?|agplv1", "affero org oagpl html"),
    ("agpl-3.0", "affero agpl agplv3", f"(?:gnu )?affero general public {L}(?:{v(3, 0)})?{LATER}", "agpl 3 0(?: only| or later)?|agplv3", "gnu org licenses agpl(?: 3 0)?"),
    ("gpl-1.0", "gnu gpl gplv1", f"gnu general public {L}{v(1, 0)}{LATER}", "gpl 1 0(?: only| or later)?|gplv1", "gnu org licenses (?:old licenses )?gpl 1 0"),
    ("gpl-2.0", "gnu gpl gplv2", f"(?:gnu general public {L}|gnu gpl){v(2, 0)}{LATER}", "gpl 2 0(?: only| or later)?|gplv2", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu gpl gplv3", f"(?:gnu general public {L}|gnu gpl){v(3, 0)}{LATER}", "gpl 3 0(?: only| or later)?|gplv3", "gnu org licenses gpl(?: 3 0)?"),
    ("gpl", "gnu gpl", f"gnu general public {L}|gnu gpl", "gpl", "gnu org copyleft gpl"),
    ("gpl-2.0-classpath", "classpath", f"gnu general public {L}{v(2, 0)} with(?: the)? classpath exception", "gpl 2 0(?: only| or later)? with classpath exception 2 0", "gnu org software classpath license"),
    ("lgpl-2.0", "gnu lgpl lgplv2", f"gnu library general public {L}{v(2, 0)}{LATER}", "lgpl 2 0(?: only| or later)?|lgplv2", "gnu org licenses (?:old licenses )?lgpl 2 0"),
    ("lgpl-2.1", "lesser gnu lgpl lgplv2", f"(?:gnu )?lesser general public {L}{v(2, 1)}{LATER}|gnu lgpl{v(2, 1)}", "lgpl 2 1(?: only| or later)?|lgplv2 1", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "lesser gnu lgpl lgplv3", f"(?:gnu )?lesser general public {L}{v(3, 0)}{LATER}|gnu lgpl{v(3, 0)}", "lgpl 3 0(?: only| or later)?|lgplv3", "gnu org licenses lgpl(?: 3 0)?"),
    ("lgpl", "gnu lgpl", f"gnu (?:lesser|library) general public {L}|gnu lgpl", "lgpl", "gnu org copyleft lesser"),
    ("gfdl", "gnu gfdl fdl", f"gnu free documentation {L}(?:{v(1, 1)}|{v(1, 2)}|{v(1, 3)})?{LATER}", "gfdl 1 [123](?: only| or later)?|gfdl", "gnu org (?:licenses|copyleft) fdl(?: 1 [123])?"),
    ("apache-1.0", "apache asl", f"apache (?:software )?{L}{v(1, 0)}", "apache 1 0|asl 1 0", "apache org licenses license 1 0"),
    ("apache-1.1", "apache asl", f"apache (?:software )?{L}{v(1, 1)}", "apache 1 1|asl 1 1", "apache org licenses license 1 1"),
    ("apache-2.0", "apache asl", f"apache (?:software )?{L}{v(2, 0)}", "apache 2 0|asl 2 0", "apache org licenses license 2 0"),
    ("mit", "mit expat", f"mit {L}|expat {L}|mit style {L}|mit x11 {L}", "mit|expat", "opensource org licenses mit(?: license)?"),
    ("mit-0", "mit", f"mit no attribution(?: {L})?", "mit 0", "github com aws mit 0"),
    ("x11", "x11 xfree86", f"x11 {L}|xfree86 {L}(?:{v(1, 1)})?", "x11|xfree86 1 1", "xfree86 org current license"),
    ("isc", "consortium isc", f"isc {L}|internet systems consortium {L}|isc style {L}", "isc", "opensource org licenses isc"),
    ("bsd-2-clause", "bsd freebsd simplified", f"(?:simplified|2 clause|two clause) bsd {L}|bsd (?:2|two) clause(?: {L})?|freebsd {L}", "bsd 2 clause|bsd 2", "opensource org licenses bsd(?: license php| 2 clause)"),
    ("bsd-3-clause", "bsd revised", f"(?:new|revised|modified|3 clause|three clause) bsd {L}|bsd (?:3|three) clause(?: {L})?", "bsd 3 clause|bsd 3", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", f"(?:original|4 clause|four clause) bsd {L}|bsd (?:4|four) clause(?: {L})?", "bsd 4 clause", "directory fsf org wiki license bsd 4clause"),
    ("bsd", "berkeley bsd", f"bsd {L}|bsd style {L}|berkeley software distribution {L}", "bsd", "freebsd org copyright"),
    ("0bsd", "bsd 0bsd", f"(?:zero clause|bsd zero clause|free public) bsd {L}|zero clause bsd", "0bsd", "opensource org licenses 0bsd"),
    ("mpl-1.0", "mozilla mpl", f"mozilla public {L}{v(1, 0)}", "mpl 1 0", "mozilla org mpl mpl 1 0"),
    ("mpl-1.1", "mozilla mpl", f"mozilla public {L}{v(1, 1)}", "mpl 1 1", "mozilla org mpl (?:mpl )?1 1"),
    ("mpl-2.0", "mozilla mpl", f"mozilla public {L}{v(2, 0)}", "mpl 2 0", "mozilla org mpl 2 0"),
    ("mpl", "mozilla mpl", f"mozilla public {L}", "mpl", "mozilla org mpl"),
    ("npl", "netscape npl", f"netscape public {L}(?:{v(1, 0)}|{v(1, 1)})?", "npl 1 [01]", "mozilla org npl"),
    ("epl-1.0", "eclipse epl", f"eclipse public {L}{v(1, 0)}", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse epl", f"eclipse public {L}{v(2, 0)}", "epl 2 0", "eclipse org legal epl (?:2 0|v20)"),
    ("epl", "eclipse", f"eclipse public {L}", "", "eclipse org legal epl"),
    ("edl-1.0", "eclipse edl", f"eclipse distribution {L}(?:{v(1, 0)})?", "edl 1 0", "eclipse org org documents edl v10"),
    ("cddl-1.0", "cddl", f"common development and distribution {L} cddl{v(1, 0)}|cddl{v(1, 0)}", "cddl 1 0", "opensource org licenses cddl1"),
    ("cddl-1.1", "cddl", "cddl" + v(1, 1), "cddl 1 1", "glassfish java net public cddl gpl 1 1"),
    ("cddl", "development cddl", f"common development and distribution {L}", "cddl", "sun com cddl"),
    ("cpl-1.0", "common cpl", f"common public {L}{v(1, 0)}", "cpl 1 0", "opensource org licenses cpl1 0"),
    ("ipl-1.0", "ibm ipl", f"ibm public {L}(?:{v(1, 0)})?", "ipl 1 0", "opensource org licenses ipl 1 0"),
    ("eupl-1.1", "european eupl", f"european union public {L}{v(1, 1)}", "eupl 1 1", "joinup ec europa eu software page eupl"),
    ("eupl-1.2", "european eupl", f"european union public {L}{v(1, 2)}", "eupl 1 2", "joinup ec europa eu collection eupl"),
    ("eupl", "european", f"european union public {L}", "", ""),
    ("cecill", "cecill", f"cecill(?: {L})?(?:{v(1, 0)}|{v(2, 0)}|{v(2, 1)})?|cecill free software {L}", "cecill (?:1 [01]|2 [01])", "cecill info licences licence cecill v2"),
    ("cecill-b", "cecill", f"cecill b(?: {L})?", "cecill b", "cecill info licences licence cecill b"),
    ("cecill-c", "cecill", f"cecill c(?: {L})?", "cecill c", "cecill info licences licence cecill c"),
    ("artistic-1.0", "artistic", f"artistic {L}{v(1, 0)}", "artistic 1 0(?: perl)?", "opensource org licenses artistic license 1 0"),
    ("artistic-2.0", "artistic", f"artistic {L}{v(2, 0)}", "artistic 2 0", "perlfoundation org artistic license 2 0"),
    ("artistic", "artistic", f"(?:perl )?artistic {L}", "", "perl com language misc artistic"),
    ("bsl-1.0", "boost bsl", f"boost software {L}(?:{v(1, 0)})?", "bsl 1 0", "boost org license 1 0"),
    ("busl-1.1", "business busl", f"business source {L}(?:{v(1, 1)})?", "busl 1 1", "mariadb com bsl11"),
    ("zlib", "zlib libpng", f"zlib {L}|zlib libpng {L}", "zlib", "zlib net zlib license"),
    ("libpng", "libpng png", f"libpng {L}(?:{v(2, 0)})?|png reference library {L}", "libpng(?: 2 0)?", "libpng org pub png src libpng license"),
    ("unlicense", "unlicense unlicence", "the unlicense|unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl fuck", f"do what the fuck you want to public {L}(?:{v(2)})?|wtfpl", "wtfpl", "wtfpl net"),
    ("beerware", "beerware beer", f"beer ?ware {L}", "beerware", "people freebsd org phk"),
    ("postgresql", "postgresql", f"postgresql {L}", "postgresql", "postgresql org about licence"),
    ("python-2.0", "python psf", f"python software foundation {L}(?:{v(2, 0)})?|python {L}{v(2, 0)}|psf {L}(?:{v(2, 0)})?", "python 2 0|psf 2 0", "docs python org 3 license"),
    ("php-3.01", "php", f"php {L}(?:{v(3, 0)}| version 3 01| 3 01)?", "php 3 0|php 3 01", "php net license 3 01"),
    ("ruby", "ruby", f"ruby {L}|ruby s {L}", "ruby", "ruby lang org en about license"),
    ("openssl", "openssl ssleay", f"openssl {L}|openssl and ssleay {L}s?|ssleay {L}", "openssl", "openssl org source license"),
    ("ofl-1.1", "sil ofl", f"sil open font {L}(?:{v(1, 0)}|{v(1, 1)})?|open font {L} ofl", "ofl 1 [01]", "scripts sil org ofl"),
    ("odbl-1.0", "database odbl", f"open database {L}(?: odbl)?(?:{v(1, 0)})?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "commons odc", f"open data commons attribution {L}(?:{v(1, 0)})?", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl-1.0", "commons pddl domain", f"(?:open data commons )?public domain dedication and {L}(?: pddl)?", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("cc0-1.0", "cc0 creative creativecommons", "cc0(?: 1 0)?(?: universal)?|creative commons zero(?: v?1 0)?(?: universal)?", "cc0 1 0|cc0", "creativecommons org publicdomain zero(?: 1 0)?"),
    ("cc-pdm", "cc creative creativecommons mark", "creative commons public domain mark(?: 1 0)?|public domain mark 1 0", "cc pdm 1 0", "creativecommons org publicdomain mark"),
    ("cc-by", "cc creative creativecommons", f"cc by|creative commons attribution(?: {L})?", "cc by", "creativecommons org licenses by"),
    ("cc-by-sa", "cc creative creativecommons", f"cc by sa|creative commons attribution share ?alike(?: {L})?", "cc by sa", "creativecommons org licenses by sa"),
    ("cc-by-nc", "cc creative creativecommons", f"cc by nc|creative commons attribution non ?commercial(?: {L})?", "cc by nc", "creativecommons org licenses by nc"),
    ("cc-by-nd", "cc creative creativecommons", f"cc by nd|creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: {L})?", "cc by nd", "creativecommons org licenses by nd"),
    ("cc-by-nc-sa", "cc creative creativecommons", f"cc by nc sa|creative commons attribution non ?commercial share ?alike(?: {L})?", "cc by nc sa", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "cc creative creativecommons", f"cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: {L})?", "cc by nc nd", "creativecommons org licenses by nc nd"),
    ("ms-pl", "microsoft ms", f"microsoft public {L}|ms pl", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft ms", f"microsoft reciprocal {L}|ms rl", "ms rl", "opensource org licenses ms rl"),
    ("apsl-2.0", "apple apsl", f"apple public source {L}(?:{v(1, 0)}|{v(2, 0)})?", "apsl (?:1 [012]|2 0)", "opensource apple com license apsl"),
    ("sissl", "sun sissl", f"sun industry standards source {L}(?:{v(1, 1)})?", "sissl(?: 1 2)?", "openoffice org licenses sissl license"),
    ("spl-1.0", "sun spl", f"sun public {L}(?:{v(1, 0)})?", "spl 1 0", "opensource org licenses spl1 0"),
    ("qpl-1.0", "qpl", f"q public {L} qpl(?:{v(1, 0)})?|qpl{v(1, 0)}", "qpl 1 0", "doc qt io archives 3 3 license"),
    ("zpl-2.1", "zope zpl", f"zope public {L}(?:{v(2, 0)}|{v(2, 1)})?", "zpl (?:1 1|2 [01])", "zope org resources license zpl"),
    ("w3c", "w3c", f"w3c software (?:notice and )?{L}|w3c software and document (?:notice and )?{L}", "w3c(?: 19980720| 20150513)?", "w3 org consortium legal copyright software"),
    ("unicode-dfs", "unicode", f"unicode (?:data files and software|inc) {L}(?: agreement)?|unicode {L}{v(3)}", "unicode dfs 201[56]|unicode 3 0|unicode tou", "unicode org copyright"),
    ("icu", "icu", f"icu {L}", "icu", "source icu project org repos icu icu trunk license"),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa open source {L}|uiuc ncsa {L}|ncsa {L}", "ncsa", "otm illinois edu uiuc opensource"),
    ("afl-3.0", "academic afl", f"academic free {L}(?:{v(1, 1)}|{v(2, 0)}|{v(2, 1)}|{v(3, 0)})?", "afl (?:1 [12]|2 [01]|3 0)", "opensource org licenses afl 3 0"),
    ("osl-3.0", "open osl", f"open software {L}{v(3, 0)}|open software {L}{v(2, 1)}", "osl (?:1 [01]|2 [01]|3 0)", "opensource org licenses osl 3 0"),
    ("ecl-2.0", "educational ecl", f"educational community {L}(?:{v(1, 0)}|{v(2, 0)})?", "ecl [12] 0", "opensource org licenses ecl2"),
    ("upl-1.0", "universal upl", f"universal permissive {L}(?:{v(1, 0)})?", "upl 1 0", "oss oracle com licenses upl"),
    ("blueoak-1.0.0", "blue blueoak", f"blue oak model {L}(?: 1 0 0)?", "blueoak 1 0 0", "blueoakcouncil org license 1 0 0"),
    ("mulanpsl-2.0", "mulan mulanpsl", f"mulan permissive software {L}(?:{v(1)}|{v(2)})?|mulan psl{v(2)}", "mulanpsl [12] 0", "license coscl org cn mulanpsl2"),
    ("sspl-1.0", "server sspl", f"server side public {L}(?:{v(1, 0)}|{v(1)})?", "sspl 1 0", "mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic", f"elastic {L}(?:{v(1, 0)}|{v(2, 0)})?", "elastic 2 0", "elastic co licensing elastic license"),
    ("commons-clause", "clause", f"commons clause(?: {L})? condition(?:{v(1, 0)})?|commons clause {L}", "", "commonsclause com"),
    ("polyform-nc-1.0", "polyform", f"polyform noncommercial {L}(?: 1 0 0)?", "polyform noncommercial 1 0 0", "polyformproject org licenses noncommercial 1 0 0"),
    ("polyform-sb-1.0", "polyform", f"polyform small business {L}(?: 1 0 0)?", "polyform small business 1 0 0", "polyformproject org licenses small business 1 0 0"),
    ("rail-m", "rail openrail", f"(?:bigscience|creativeml|bigcode)(?: bloom)? (?:open)? ?rail(?: m)? {L}|(?:open)?rail m {L}", "openrail m|creativeml openrail m", "huggingface co spaces bigscience license"),
    ("llama", "llama", f"llama (?:[234](?: [0-9])? )?community {L}(?: agreement)?", "llama [234](?: [0-9])?", "ai meta com llama license"),
    ("gemma", "gemma", "gemma terms of use", "gemma", "ai google dev gemma terms"),
    ("nvidia-sla", "nvidia cuda", f"nvidia (?:software|cuda)(?: toolkit)? {L} agreement|cuda toolkit end user {L} agreement", "", "docs nvidia com cuda eula"),
    ("intel-ssl", "intel", f"intel simplified software {L}|intel open source {L}", "intel", "software intel com intel simplified software license"),
    ("ijg", "jpeg ijg", f"independent jpeg group(?: s)? {L}|ijg {L}", "ijg", "ijg org"),
    ("freetype", "freetype ftl", f"freetype (?:project )?{L}|freetype {L} ftl", "ftl", "freetype org license"),
    ("imagemagick", "imagemagick", f"imagemagick {L}", "imagemagick", "imagemagick org script license"),
    ("curl", "curl", f"curl {L}", "curl", "curl se docs copyright"),
    ("vim", "vim", f"vim {L}", "vim", "vimdoc sourceforge net htmldoc uganda"),
    ("tcl", "tcl", f"tcl tk {L}|tcl {L}", "tcl", "tcl lang org software tcltk license"),
    ("lppl-1.3c", "latex lppl", f"latex project public {L}(?:{v(1, 3)}| version 1 3[abc]?| v?1 3[abc])?", "lppl 1 (?:[012]|3[ac])", "latex project org lppl"),
    ("naist", "nara naist", f"nara institute of science and technology {L}|naist {L}", "naist 2003", ""),
    ("hpnd", "hpnd historical", f"historical permission notice and disclaimer(?: {L})?", "hpnd", "opensource org licenses hpnd"),
    ("ogl-uk-3.0", "government ogl", f"open government {L}(?:{v(1, 0)}|{v(2, 0)}|{v(3, 0)})?", "ogl uk [123] 0", "nationalarchives gov uk doc open government licence"),
    ("etalab-2.0", "etalab", f"licence ouverte(?: open licence)? etalab|etalab(?: open)? {L}(?:{v(2, 0)})?", "etalab 2 0", "etalab gouv fr licence ouverte open licence"),
    ("dl-de-by-2.0", "datenlizenz dl", "datenlizenz deutschland(?: namensnennung)?(?: version)? 2 0", "dl de by 2 0", "govdata de dl de by 2 0"),
    ("fal-1.3", "art", f"free art {L}(?: 1 3)?|licence art libre(?: 1 3)?", "", "artlibre org licence lal"),
]

#: (label, gates, pattern): what the licences themselves say; hand-written.
TEXTS = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "substantial", "the above copyright notice and this permission notice (?:\\S+ ){0,6}shall be included in all copies or substantial portions of the software"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "neither", "neither the names? of (?:\\S+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "governing", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-1.1", "apache", "this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl", "redistribute", f"you can redistribute it and or modify it under the terms of the gnu general public {L} as published by the free software foundation"),
    ("gpl", "gnu", f"you should have received a copy of the gnu general public {L}(?: along with (?:this|the) (?:program|software|library))?"),
    ("gpl-2.0", "gnu", f"modify it under the terms of the gnu general public {L} as published by the free software foundation (?:either )?version 2(?: of the {L})?{LATER}"),
    ("gpl-3.0", "gnu", f"modify it under the terms of the gnu general public {L} as published by the free software foundation (?:either )?version 3(?: of the {L})?{LATER}"),
    ("lgpl", "gnu", f"you should have received a copy of the gnu (?:lesser|library) general public {L}"),
    ("lgpl-2.1", "lesser", f"under the terms of the gnu lesser general public {L} as published by the free software foundation (?:either )?version 2 1"),
    ("lgpl-3.0", "lesser", f"under the terms of the gnu lesser general public {L} as published by the free software foundation (?:either )?version 3"),
    ("agpl-3.0", "affero", f"under the terms of the gnu affero general public {L} as published by the free software foundation"),
    ("gfdl", "documentation", f"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {L}"),
    ("mpl-1.1", "mozilla", f"the contents of this file are subject to the mozilla public {L} version 1 1"),
    ("mpl-2.0", "mozilla", f"this source code form is subject to the terms of the mozilla public {L} v 2 0"),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-1.0", "eclipse", f"this program and the accompanying materials are made available under the terms of the eclipse public {L} v1 0"),
    ("epl-2.0", "eclipse", f"this program and the accompanying materials are made available under the terms of the eclipse public {L} (?:v )?2 0"),
    ("cddl", "cddl distribution", f"the contents of this file are subject to the terms of the common development and distribution {L}"),
    ("bsl-1.0", "permission boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "arising", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("postgresql", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ofl-1.1", "font", f"this font software is licensed under the sil open font {L} version 1 1"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("cc-by", "attribution", f"this work is licensed under (?:a|the) creative commons attribution (?:[1-4] [05] )?(?:international|unported|generic)(?: {L})?"),
    ("cc-by-sa", "attribution", f"this work is licensed under (?:a|the) creative commons attribution share ?alike (?:[1-4] [05] )?(?:international|unported|generic)(?: {L})?"),
    ("cc-by-nc", "attribution", f"this work is licensed under (?:a|the) creative commons attribution non ?commercial (?:[1-4] [05] )?(?:international|unported|generic)(?: {L})?"),
    ("cc0-1.0", "waived", "to the extent possible under law (?:\\S+ ){1,12}has waived all copyright and related or neighboring rights"),
    ("public-domain", "domain", "(?:this (?:work|file|software|code|text|document)|it) is (?:hereby )?(?:in|placed in|placed into|released into|dedicated to) the public domain"),
    ("all-rights-reserved", "reserved", "all rights reserved"),
    ("all-rights-reserved", "derechos", "todos los derechos reservados"),
    ("all-rights-reserved", "droits", "tous droits réservés"),
    ("all-rights-reserved", "rechte", "alle rechte vorbehalten"),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)(?: information)?"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)(?: via any medium)? is strictly prohibited"),
    ("non-commercial", "non noncommercial", "for (?:personal|research|academic|educational)(?: (?:and|or) (?:personal|research|academic|educational))? and non ?commercial use only|for non ?commercial (?:use|purposes) only"),
]

#: Versions and ports that a Creative Commons name may be followed by.
CC_TAIL = "(?: [1-4] [05])?(?: (?:international|unported|generic|igo|universal)(?: licen[cs]e)?)?"

#: What stands around a licence's name (n), identifier (i) or address (u) in each form.
FORMS = {
    "identifier": "spdx license identifier (?:i)",
    "address": "(?:https? )?(?:www )?(?:u)(?: (?:txt|html|en html|php|legalcode|deed en))?",
    "grant": f"(?:licen[cs]ed|released|distributed|available|published|provided|covered|offered|shared)(?: \\S+)? (?:under|by) (?:(?:the|an?) )?(?:(?:terms|conditions)(?: and conditions)? of )?(?:(?:the|an?) )?(?:n|i)(?: {L})?",
    "field": f"{L}s? (?:type |name |id |is )?(?:i)",
    "name": "(?:n)",
}
#: The word before an address's domain.
SITE = re.compile("([a-z0-9]+) (?:org|com|net|eu|info|edu|gov|se|co|io|dev|de|fr|cn)(?= |$)")


@dataclass(frozen=True)
class Rule:
    """A signature: its place among the rules breaks ties that priority and length leave."""

    name: str
    label: str
    form: str
    gates: tuple[str, ...]
    pattern: str

    def compiled(self) -> re.Pattern:
        """Over bytes of words between single spaces, one before the first and one after the last."""
        return re.compile(f" (?:{self.pattern})(?= )".encode())


def formed(label: str, gates: str, name: str, identifier: str, address: str) -> list[Rule]:
    tail = CC_TAIL if label.startswith("cc") else ""
    parts = {"n": name and f"(?:{name}){tail}", "i": identifier and f"(?:{identifier}){tail}", "u": address and f"(?:{address}){tail}"}
    out = []
    for form, around in FORMS.items():
        used = re.findall(r"(?<=[:|])[niu](?=[)|])", around)
        have = [parts[p] for p in used if parts[p]]
        if have:
            hole = "(?:" + "|".join(used) + ")"
            # an address holds its own site, which need not be among the gates of the name
            own = SITE.findall(address)[:1] if form == "address" else gates.split()
            out.append(Rule(f"{label}/{form}", label, form, tuple(own), around.replace(hole, "(?:" + "|".join(have) + ")")))
    return out


def rules() -> list[Rule]:
    """All rules, in order; those of BASE last."""
    out = [Rule(f"{label}/text{k}", label, "text", tuple(gates.split()), pattern) for k, (label, gates, pattern) in enumerate(TEXTS)]
    for x in LICENSES:
        out += formed(*x)
    return out + [Rule(f"{label}/base", label, "base", tuple(phrase.split()[:1]), phrase) for phrase, label in BASE]
