r"""License signatures, written by hand: label -> (priority, keyword, expression).

Expressions are matched against the line of words that :mod:`licenses` makes: lower case, no
punctuation, one blank between words ("GPL-2.0-or-later" reads "gpl 2 0 or later").  They
are bounded by whole words.  The keyword is a run of words that stands in every match, or several
with bars between, of which one does.
Labels follow SPDX where it has one: "-only" and "-or-later" as the text says, exceptions
after "WITH", choices joined by "OR".  A label that begins with "WITH" is an exception alone: the scan
joins it to the license that stands before it.
"""

#: Priorities: a grant, a license's own text or an identifier; a named license; a bare name.
GRANT, NAMED, BARE = 3, 2, 1

_L = r"licen[cs]e"
_V = r"(?:version |v ?)?"
_GPL = rf"(?:gnu )?(?:general public {_L}|gpl)"
_LGPL = rf"(?:gnu )?(?:lesser general public {_L}|library general public {_L}|lgpl)"
_AGPL = rf"(?:gnu )?(?:affero general public {_L}|agpl)"
_LATER = r"(?:(?: of the license)? or (?:at your option )?(?:any )?(?:later|newer|above)(?: versions?)?|\+| plus)"
_UNDER = r"(?:licen[cs]ed|released|distributed|available|published|provided|redistributed|offered|covered|governed|shared)(?: to you)? (?:under|by)(?: the)?(?: terms(?: and conditions)? of(?: the)?)?"

RULES = {
    "mit": (
        (
            GRANT, "hereby granted free of charge",
            r"permission is hereby granted free of charge to any person obtaining a copy of this software",
        ),
        (GRANT, "deal in the software", r"to deal in the software without restriction"),
        (
            GRANT, "substantial portions of the software",
            r"this permission notice shall be included in all copies or substantial portions of the software",
        ),
        (
            GRANT, "holders be liable for any claim",
            r"in no event shall the authors or copyright holders be liable for any claim",
        ),
        (GRANT, "mit", rf"{_UNDER} mit(?: {_L})?"), (GRANT, "mit", rf"spdx {_L} identifier mit"),
        (NAMED, "mit", rf"mit {_L}"), (NAMED, "mit", rf"{_L} mit"), (NAMED, "expat", rf"expat {_L}"),
        (GRANT, "expat", rf"{_UNDER} expat(?: {_L})?"), (NAMED, "x11", rf"(?:mit x11|x11) {_L}"),
        (NAMED, "mit", r"mit style"),
    ),
    "mit-0": (
        (GRANT, "mit no attribution", rf"{_UNDER} mit no attribution(?: {_L})?"),
        (GRANT, "mit 0", rf"spdx {_L} identifier mit 0"), (NAMED, "mit no attribution", r"mit no attribution"),
        (NAMED, "mit 0", rf"mit 0 {_L}"),
    ),
    "mit-modern-variant": (
        (
            GRANT, "without written agreement",
            r"permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute",
        ),
    ),
    "isc": (
        (
            GRANT, "use copy modify and",
            r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted",
        ),
        (GRANT, "isc", rf"{_UNDER} isc(?: {_L})?"), (GRANT, "isc", rf"spdx {_L} identifier isc"),
        (NAMED, "isc", rf"isc {_L}"), (NAMED, "internet systems consortium", rf"internet systems consortium {_L}"),
    ),
    "0bsd": (
        (GRANT, "0bsd", rf"spdx {_L} identifier 0bsd"),
        (NAMED, "bsd", rf"(?:zero clause bsd|bsd zero clause|bsd 0 clause)(?: {_L})?"), (NAMED, "0bsd", r"0bsd"),
    ),
    "bsd-2-clause": (
        (
            GRANT, "freebsd project",
            r"interpreted as representing official policies either expressed or implied of the freebsd project",
        ),
        (GRANT, "bsd 2 clause", rf"spdx {_L} identifier bsd 2 clause"),
        (GRANT, "bsd", rf"{_UNDER} (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: {_L})?"),
        (NAMED, "bsd", rf"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: {_L})?"),
        (NAMED, "freebsd", rf"freebsd {_L}"),
        (
            NAMED, "source and binary forms",
            r"redistribution and use in source and binary forms with or without modification are permitted",
        ),
    ),
    "bsd-3-clause": (
        (
            GRANT, "endorse or promote products",
            r"neither the names? of .{1,120}? may be used to endorse or promote products derived from this software",
        ),
        (GRANT, "bsd 3 clause", rf"spdx {_L} identifier bsd 3 clause"),
        (
            GRANT, "bsd",
            rf"{_UNDER} (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: {_L})?",
        ),
        (NAMED, "bsd", rf"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: {_L})?"),
    ),
    "bsd-3-clause-clear": (
        (
            GRANT, "no express or implied licenses to",
            r"no express or implied licenses to any party s patent rights are granted by this license",
        ),
        (GRANT, "bsd 3 clause clear", rf"spdx {_L} identifier bsd 3 clause clear"),
    ),
    "bsd-4-clause": (
        (
            GRANT, "advertising materials mentioning",
            r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment",
        ),
        (GRANT, "bsd 4 clause", rf"spdx {_L} identifier bsd 4 clause"),
        (NAMED, "bsd", rf"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: {_L})?"),
    ),
    "bsd": (
        (GRANT, "bsd", rf"{_UNDER} bsd(?: {_L})?"), (BARE, "bsd", rf"bsd(?: style)? {_L}"),
        (BARE, "berkeley software distribution", rf"berkeley software distribution {_L}"),
    ),
    "apache-1.0": (
        (
            GRANT, "for use in the apache http",
            r"this product includes software developed by the apache group for use in the apache http server project",
        ),
        (NAMED, "apache", rf"apache {_L} {_V}1 0"),
    ),
    "apache-1.1": (
        (
            GRANT, "developed by the apache software",
            r"this product includes software developed by the apache software foundation",
        ),
        (GRANT, "apache 1 1", rf"spdx {_L} identifier apache 1 1"),
        (NAMED, "apache", rf"apache (?:software )?{_L} {_V}1 1"),
    ),
    "apache-2.0": (
        (
            GRANT, "apache",
            rf"licen[cs]ed under the apache {_L} {_V}2 0 the {_L}(?: you may not use this file except in compliance with the {_L})?",
        ),
        (
            GRANT, "perpetual worldwide non exclusive no charge royalty free irrevocable copyright",
            r"perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of",
        ),
        (GRANT, "apache 2 0", rf"spdx {_L} identifier apache 2 0"),
        (GRANT, "apache", rf"{_UNDER} (?:apache (?:software )?{_L},? {_V}2(?: 0)?|apache 2(?: 0)?(?: {_L})?)"),
        (NAMED, "apache", rf"apache (?:software )?{_L} {_V}2(?: 0)?"), (NAMED, "apache 2 0", rf"apache 2 0(?: {_L})?"),
        (NAMED, "licenses license 2 0", r"(?:http|https) www apache org licenses license 2 0"),
        (NAMED, "asl 2 0", r"asl 2 0"),
    ),
    "apache-2.0 WITH llvm-exception": (
        (GRANT, "llvm", rf"apache {_L} {_V}2 0 with llvm exceptions?"),
        (GRANT, "llvm exception", rf"spdx {_L} identifier apache 2 0 with llvm exception"),
    ),
    "apache": (
        (GRANT, "apache", rf"{_UNDER} apache(?: software)?(?: {_L})?"), (BARE, "apache", rf"apache (?:software )?{_L}")
    ),
    "gpl-1.0-only": (
        (GRANT, "gpl 1 0", rf"spdx {_L} identifier gpl 1 0(?: only)?"),
        (NAMED, "general public|gpl", rf"{_GPL} {_V}1(?: 0)?(?: only)?"),
    ),
    "gpl-1.0-or-later": (
        (GRANT, "gpl 1 0", rf"spdx {_L} identifier gpl 1 0 or later"),
        (NAMED, "general public|gpl", rf"{_GPL} {_V}1(?: 0)?{_LATER}"),
    ),
    "gpl-2.0-only": (
        (
            GRANT, "as published by the free software",
            r"under the terms of version 2 of the gnu general public license as published by the free software foundation",
        ),
        (GRANT, "gpl 2 0", rf"spdx {_L} identifier gpl 2 0(?: only)?"),
        (NAMED, "general public|gpl", rf"{_GPL} {_V}2(?: 0)?(?: only)?"), (NAMED, "gplv2", r"(?:gnu )?gplv2"),
        (NAMED, "version 2 of the gnu", r"version 2 of the gnu general public license"),
        (
            GRANT, "freedom to share and",
            r"the licenses for most software are designed to take away your freedom to share and change it",
        ),
    ),
    "gpl-2.0-or-later": (
        (
            GRANT, "either version 2",
            r"gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        ),
        (GRANT, "gpl 2 0", rf"spdx {_L} identifier gpl 2 0 or later"), (GRANT, "gpl 2 0", r"gpl 2 0 or later"),
        (NAMED, "general public|gpl", rf"{_GPL} {_V}2(?: 0)?{_LATER}"), (NAMED, "gplv2", rf"(?:gnu )?gplv2{_LATER}"),
        (NAMED, "either version 2", r"either version 2 of the license or at your option any later version"),
    ),
    "gpl-3.0-only": (
        (GRANT, "gpl 3 0", rf"spdx {_L} identifier gpl 3 0(?: only)?"),
        (
            GRANT, "share and change all versions",
            r"the gnu general public license is intended to guarantee your freedom to share and change all versions of a program",
        ),
        (NAMED, "general public|gpl", rf"{_GPL} {_V}3(?: 0)?(?: only)?"), (NAMED, "gplv3", r"(?:gnu )?gplv3"),
        (NAMED, "version 3 of the gnu", r"version 3 of the gnu general public license"),
    ),
    "gpl-3.0-or-later": (
        (
            GRANT, "either version 3",
            r"gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ),
        (GRANT, "gpl 3 0", rf"spdx {_L} identifier gpl 3 0 or later"), (GRANT, "gpl 3 0", r"gpl 3 0 or later"),
        (NAMED, "general public|gpl", rf"{_GPL} {_V}3(?: 0)?{_LATER}"), (NAMED, "gplv3", rf"(?:gnu )?gplv3{_LATER}"),
        (NAMED, "either version 3", r"either version 3 of the license or at your option any later version"),
    ),
    "gpl": (
        (GRANT, "gnu", rf"{_UNDER} gnu (?:general public {_L}|gpl)"), (GRANT, "gpl", rf"{_UNDER} gpl"),
        (
            NAMED, "is free software you can",
            r"is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        ),
        (BARE, "gnu general public", rf"gnu general public {_L}"), (BARE, "gnu gpl", r"gnu gpl"),
        (
            BARE, "copy of the gnu general",
            r"you should have received a copy of the gnu general public license along with this program",
        ),
    ),
    "gpl-2.0 WITH classpath-exception-2.0": (
        (
            GRANT, "the classpath exception",
            r"oracle designates this particular file as subject to the classpath exception",
        ),
        (
            GRANT, "linking this library statically",
            r"linking this library statically or dynamically with other modules is making a combined work based on this library",
        ),
        (GRANT, "classpath", rf"{_GPL} {_V}2(?: 0)?(?: only)? with (?:the )?(?:gnu )?classpath exception(?: 2 0)?"),
        (
            GRANT, "classpath exception 2 0",
            rf"spdx {_L} identifier gpl 2 0(?: only)? with classpath exception 2 0",
        ),
    ),
    "WITH classpath-exception-2.0": ((NAMED, "classpath exception", r"(?:gnu )?classpath exception(?: 2 0)?"),),
    "gpl-3.0 WITH gcc-exception-3.1": (
        (GRANT, "gcc exception 3 1", rf"spdx {_L} identifier gpl 3 0(?: only)? with gcc exception 3 1"),
    ),
    "WITH gcc-exception-3.1": (
        (GRANT, "gcc runtime library exception", r"gcc runtime library exception(?: version 3 1)?"),
        (NAMED, "gcc exception", r"gcc exception(?: 3 1)?"),
    ),
    "gpl-2.0 WITH linux-syscall-note": (
        (GRANT, "linux syscall note", rf"spdx {_L} identifier gpl 2 0(?: only)? with linux syscall note"),
    ),
    "WITH linux-syscall-note": ((NAMED, "linux syscall note", r"linux syscall note"),),
    "gpl-2.0 WITH font-exception-2.0": (
        (GRANT, "embeds this font", r"if you create a document which uses this font and embeds this font"),
        (NAMED, "font exception", rf"{_GPL} {_V}(?:2 0|2|3 0|3)? ?with (?:the )?font exception"),
    ),
    "gpl WITH autoconf-exception": (
        (
            GRANT, "generated by autoconf",
            r"contains a configuration script generated by autoconf you may include it under the same distribution terms",
        ),
    ),
    "gpl WITH bison-exception": (
        (
            GRANT, "bison parser skeleton",
            r"you may create a larger work that contains part or all of the bison parser skeleton",
        ),
    ),
    "gpl WITH linking-exception": (
        (
            GRANT, "permission to link",
            r"(?:gives?|have|grants?) (?:you )?permission to link (?:the code of )?(?:this|the) (?:program|library|software) with",
        ),
    ),
    "WITH linking-exception": (
        (NAMED, "linking exception", r"(?:static |openssl )?linking exception"),
    ),
    "lgpl-2.0-only": (
        (GRANT, "lgpl 2 0", rf"spdx {_L} identifier lgpl 2 0(?: only)?"),
        (NAMED, "lesser general public|library general public|lgpl", rf"{_LGPL} {_V}2(?: 0)?(?: only)?"),
    ),
    "lgpl-2.0-or-later": (
        (GRANT, "lgpl 2 0", rf"spdx {_L} identifier lgpl 2 0 or later"),
        (NAMED, "lesser general public|library general public|lgpl", rf"{_LGPL} {_V}2(?: 0)?{_LATER}"),
        (
            GRANT, "library general public",
            r"gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        ),
    ),
    "lgpl-2.1-only": (
        (GRANT, "lgpl 2 1", rf"spdx {_L} identifier lgpl 2 1(?: only)?"),
        (NAMED, "lesser general public|library general public|lgpl", rf"{_LGPL} {_V}2 1(?: only)?"),
    ),
    "lgpl-2.1-or-later": (
        (GRANT, "lgpl 2 1", rf"spdx {_L} identifier lgpl 2 1 or later"),
        (
            GRANT, "either version 2 1",
            r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        ),
        (NAMED, "lesser general public|library general public|lgpl", rf"{_LGPL} {_V}2 1{_LATER}"),
    ),
    "lgpl-3.0-only": (
        (GRANT, "lgpl 3 0", rf"spdx {_L} identifier lgpl 3 0(?: only)?"),
        (NAMED, "lesser general public|library general public|lgpl", rf"{_LGPL} {_V}3(?: 0)?(?: only)?"),
        (NAMED, "lgplv3", r"lgplv3"),
    ),
    "lgpl-3.0-or-later": (
        (GRANT, "lgpl 3 0", rf"spdx {_L} identifier lgpl 3 0 or later"),
        (
            GRANT, "either version 3",
            r"gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ),
        (NAMED, "lesser general public|library general public|lgpl", rf"{_LGPL} {_V}3(?: 0)?{_LATER}"),
    ),
    "lgpl": (
        (GRANT, "lesser general public", rf"{_UNDER} gnu lesser general public {_L}"),
        (GRANT, "lgpl", rf"{_UNDER} (?:gnu )?lgpl"),
        (BARE, "lesser general public", rf"(?:gnu )?lesser general public {_L}"),
        (BARE, "library general public", rf"(?:gnu )?library general public {_L}"), (BARE, "lgpl", r"lgpl"),
    ),
    "agpl-3.0-only": (
        (GRANT, "agpl 3 0", rf"spdx {_L} identifier agpl 3 0(?: only)?"),
        (NAMED, "affero general public|agpl", rf"{_AGPL} {_V}3(?: 0)?(?: only)?"), (NAMED, "agplv3", r"agplv3"),
    ),
    "agpl-3.0-or-later": (
        (GRANT, "agpl 3 0", rf"spdx {_L} identifier agpl 3 0 or later"),
        (
            GRANT, "gnu affero general public",
            r"gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ),
        (NAMED, "affero general public|agpl", rf"{_AGPL} {_V}3(?: 0)?{_LATER}"),
    ),
    "agpl": (
        (GRANT, "affero general public", rf"{_UNDER} (?:gnu )?affero general public {_L}"),
        (BARE, "affero general public", rf"(?:gnu )?affero general public {_L}"), (BARE, "agpl", r"agpl"),
    ),
    "gfdl-1.1": ((NAMED, "free documentation", rf"gnu free documentation {_L} {_V}1 1(?: or any later version)?"),),
    "gfdl-1.2": (
        (GRANT, "gfdl 1 2", rf"spdx {_L} identifier gfdl 1 2(?: only| or later)?"),
        (NAMED, "free documentation", rf"gnu free documentation {_L} {_V}1 2(?: or any later version)?"),
    ),
    "gfdl-1.3": (
        (GRANT, "gfdl 1 3", rf"spdx {_L} identifier gfdl 1 3(?: only| or later)?"),
        (NAMED, "free documentation", rf"gnu free documentation {_L} {_V}1 3(?: or any later version)?"),
    ),
    "gfdl": (
        (GRANT, "front cover texts and", r"with no invariant sections no front cover texts and no back cover texts"),
        (BARE, "free documentation", rf"gnu free documentation {_L}"), (BARE, "gfdl", r"gfdl"),
    ),
    "mpl-1.0": ((NAMED, "mozilla public", rf"mozilla public {_L} {_V}1 0"),),
    "mpl-1.1": (
        (GRANT, "mozilla public", rf"the contents of this file are subject to the mozilla public {_L} {_V}1 1"),
        (GRANT, "mpl 1 1", rf"spdx {_L} identifier mpl 1 1"),
        (NAMED, "mozilla public", rf"mozilla public {_L} {_V}1 1"), (NAMED, "mpl 1 1", r"mpl 1 1"),
    ),
    "mpl-2.0": (
        (GRANT, "mozilla public", rf"this source code form is subject to the terms of the mozilla public {_L} {_V}2 0"),
        (
            GRANT, "if a copy of the mpl",
            r"if a copy of the mpl was not distributed with this file you can obtain one at",
        ),
        (GRANT, "mpl 2 0", rf"spdx {_L} identifier mpl 2 0"),
        (NAMED, "mozilla public", rf"mozilla public {_L} {_V}2(?: 0)?"), (NAMED, "mpl 2 0", r"mpl 2 0"),
    ),
    "mpl": (
        (GRANT, "mozilla public", rf"{_UNDER} mozilla public {_L}"), (BARE, "mozilla public", rf"mozilla public {_L}")
    ),
    "epl-1.0": (
        (
            GRANT, "eclipse public",
            rf"this program and the accompanying materials are made available under the terms of the eclipse public {_L} {_V}1 0",
        ),
        (GRANT, "epl 1 0", rf"spdx {_L} identifier epl 1 0"),
        (NAMED, "eclipse public", rf"eclipse public {_L} {_V}1(?: 0)?"),
    ),
    "epl-2.0": (
        (
            GRANT, "eclipse public",
            rf"this program and the accompanying materials are made available under the terms of the eclipse public {_L} {_V}2 0",
        ),
        (GRANT, "epl 2 0", rf"spdx {_L} identifier epl 2 0"),
        (NAMED, "eclipse public", rf"eclipse public {_L} {_V}2(?: 0)?"),
    ),
    "epl": (
        (GRANT, "eclipse public", rf"{_UNDER} eclipse public {_L}"), (BARE, "eclipse public", rf"eclipse public {_L}")
    ),
    "edl-1.0": ((NAMED, "eclipse distribution", rf"eclipse distribution {_L}(?: {_V}1 0)?"),),
    "cddl-1.0": (
        (GRANT, "cddl 1 0", rf"spdx {_L} identifier cddl 1 0"),
        (
            GRANT, "common development and distribution",
            rf"the contents of this file are subject to the terms of the common development and distribution {_L}",
        ),
        (NAMED, "common development and distribution", rf"common development and distribution {_L}(?: {_V}1 0)?"),
        (NAMED, "cddl", r"cddl(?: {0,1}1 0)?"),
    ),
    "cddl-1.1": (
        (NAMED, "common development and distribution", rf"common development and distribution {_L} {_V}1 1"),
        (GRANT, "cddl 1 1", rf"spdx {_L} identifier cddl 1 1"),
    ),
    "cpl-1.0": (
        (GRANT, "cpl 1 0", rf"spdx {_L} identifier cpl 1 0"),
        (NAMED, "common public", rf"common public {_L}(?: {_V}1 0)?"),
    ),
    "cpal-1.0": ((NAMED, "common public attribution", rf"common public attribution {_L}(?: {_V}1 0)?"),),
    "eupl-1.1": (
        (GRANT, "eupl 1 1", rf"spdx {_L} identifier eupl 1 1"),
        (NAMED, "european union public", rf"european union public {_L} {_V}1 1"),
    ),
    "eupl-1.2": (
        (GRANT, "eupl 1 2", rf"spdx {_L} identifier eupl 1 2"),
        (NAMED, "european union public", rf"european union public {_L}(?: {_V}1 2)?"),
        (NAMED, "eupl", rf"eupl(?: {_V}1 2)?"),
    ),
    "osl-3.0": (
        (GRANT, "osl 3 0", rf"spdx {_L} identifier osl 3 0"),
        (NAMED, "open software", rf"open software {_L}(?: {_V}3 0)?"),
    ),
    "afl-3.0": (
        (GRANT, "afl 3 0", rf"spdx {_L} identifier afl 3 0"),
        (NAMED, "academic free", rf"academic free {_L}(?: {_V}3 0)?"),
    ),
    "artistic-1.0": (
        (NAMED, "artistic", rf"artistic {_L} {_V}1 0"),
        (
            GRANT, "semblance of artistic control",
            r"the copyright holder maintains some semblance of artistic control over the development of the package",
        ),
    ),
    "artistic-2.0": (
        (GRANT, "artistic 2 0", rf"spdx {_L} identifier artistic 2 0"),
        (NAMED, "artistic", rf"artistic {_L} {_V}2(?: 0)?"), (BARE, "artistic", rf"artistic {_L}"),
    ),
    "zlib": (
        (
            GRANT, "origin of this software must",
            r"the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        ),
        (
            GRANT, "altered source versions must be",
            r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
        ),
        (GRANT, "zlib", rf"{_UNDER} zlib(?: libpng)?(?: {_L})?"), (GRANT, "zlib", rf"spdx {_L} identifier zlib"),
        (NAMED, "zlib", rf"zlib (?:libpng )?{_L}"),
    ),
    "libpng": (
        (NAMED, "libpng", rf"libpng {_L}(?: {_V}2)?"),
        (GRANT, "contributing authors and group", r"the contributing authors and group 42 inc disclaim all warranties"),
    ),
    "libtiff": (
        (
            GRANT, "sam leffler and silicon",
            r"the names of sam leffler and silicon graphics may not be used in any advertising",
        ),
        (NAMED, "libtiff", rf"libtiff {_L}"),
    ),
    "ijg": (
        (GRANT, "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ),
    "curl": ((GRANT, "curl", rf"spdx {_L} identifier curl"), (NAMED, "curl", rf"curl {_L}")),
    "ncsa": (
        (GRANT, "ncsa", rf"(?:university of illinois ncsa open source|ncsa open source) {_L}"),
        (GRANT, "ncsa", rf"spdx {_L} identifier ncsa"),
    ),
    "bsl-1.0": (
        (
            GRANT, "machine executable object code generated",
            r"solely in the form of machine executable object code generated by a source language processor",
        ),
        (GRANT, "bsl 1 0", rf"spdx {_L} identifier bsl 1 0"),
        (GRANT, "boost software", rf"{_UNDER} boost software {_L}(?: {_V}1 0)?"),
        (NAMED, "boost software", rf"boost software {_L}(?: {_V}1 0)?"),
    ),
    "busl-1.1": (
        (GRANT, "busl 1 1", rf"spdx {_L} identifier busl 1 1"),
        (NAMED, "business source", rf"business source {_L}(?: {_V}1 1)?"),
    ),
    "sspl-1.0": (
        (GRANT, "sspl 1 0", rf"spdx {_L} identifier sspl 1 0"),
        (NAMED, "server side public", rf"server side public {_L}(?: {_V}1)?"),
    ),
    "elastic-2.0": (
        (GRANT, "elastic 2 0", rf"spdx {_L} identifier elastic 2 0"),
        (NAMED, "elastic", rf"elastic {_L} (?:{_V}2(?: 0)?)"),
    ),
    "commons-clause": (
        (GRANT, "right to sell the software", r"the license does not grant to you the right to sell the software"),
        (NAMED, "commons clause", r"commons clause(?: license condition)?"),
    ),
    "polyform-noncommercial-1.0.0": ((NAMED, "polyform noncommercial", rf"polyform noncommercial {_L}(?: 1 0 0)?"),),
    "python-2.0": (
        (GRANT, "psf is making python available", r"psf is making python available to licensee on an as is basis"),
        (GRANT, "python 2 0", rf"spdx {_L} identifier python 2 0"),
        (NAMED, "python software foundation", rf"python software foundation {_L}(?: {_V}2)?"),
        (NAMED, "psf", rf"psf {_L}"),
    ),
    "php-3.01": (
        (GRANT, "includes php software freely available", r"this product includes php software freely available from"),
        (NAMED, "php", rf"php {_L}(?: {_V}3 0?1)?"),
    ),
    "ruby": ((NAMED, "ruby", rf"ruby(?: s)? {_L}"), (GRANT, "ruby", rf"spdx {_L} identifier ruby")),
    "tcl": (
        (
            GRANT, "regents of the university of california sun microsystems",
            r"copyrighted by the regents of the university of california sun microsystems inc scriptics",
        ),
        (NAMED, "tcl", rf"tcl(?: tk)? {_L}"),
    ),
    "openssl": (
        (
            GRANT, "for use in the openssl",
            r"this product includes software developed by the openssl project for use in the openssl toolkit",
        ),
        (GRANT, "openssl", rf"spdx {_L} identifier openssl"), (NAMED, "openssl", rf"openssl {_L}"),
    ),
    "ssleay": (
        (
            GRANT, "cryptographic software written by eric",
            r"this product includes cryptographic software written by eric young",
        ),
    ),
    "unlicense": (
        (
            GRANT, "free and unencumbered software",
            r"this is free and unencumbered software released into the public domain",
        ),
        (GRANT, "unlicense", rf"spdx {_L} identifier unlicense"), (GRANT, "unlicense", rf"{_UNDER} unlicense"),
        (NAMED, "unlicense", r"(?:the )?unlicense"),
    ),
    "wtfpl": (
        (GRANT, "you just do what the", r"you just do what the fuck you want to"),
        (GRANT, "wtfpl", rf"spdx {_L} identifier wtfpl"), (NAMED, "wtfpl", r"wtfpl"),
        (NAMED, "you want to public", rf"do what the f\S* you want to public {_L}"),
    ),
    "beerware": (
        (GRANT, "you can buy me a", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
        (NAMED, "beerware", rf"beerware(?: {_L})?"), (NAMED, "beer ware", rf"beer ware(?: {_L})?"),
    ),
    "json": (
        (GRANT, "used for good not evil", r"the software shall be used for good not evil"),
        (NAMED, "json", rf"(?:the )?json {_L}"),
    ),
    "ms-pl": (
        (GRANT, "ms pl", rf"spdx {_L} identifier ms pl"), (NAMED, "microsoft public", rf"microsoft public {_L}"),
        (NAMED, "ms pl", r"ms pl"),
    ),
    "ms-rl": (
        (GRANT, "ms rl", rf"spdx {_L} identifier ms rl"), (NAMED, "microsoft reciprocal", rf"microsoft reciprocal {_L}")
    ),
    "ofl-1.1": (
        (
            GRANT, "this font software is licensed",
            rf"this font software is licensed under the sil open font {_L}(?: {_V}1 1)?",
        ),
        (GRANT, "ofl 1 1", rf"spdx {_L} identifier ofl 1 1"),
        (NAMED, "open font", rf"(?:sil )?open font {_L}(?: {_V}1 1)?"),
    ),
    "ubuntu-font-1.0": ((NAMED, "ubuntu font", rf"ubuntu font {_L}(?: {_V}1 0)?"),),
    "lppl-1.3c": (
        (
            GRANT, "latex project public",
            rf"this work may be distributed and or modified under the conditions of the latex project public {_L}",
        ),
        (NAMED, "latex project public", rf"latex project public {_L}(?: {_V}1 3c?)?"),
    ),
    "qpl-1.0": ((NAMED, "q public", rf"q public {_L}(?: {_V}1 0)?"),),
    "ipl-1.0": ((NAMED, "ibm public", rf"ibm public {_L}(?: {_V}1 0)?"),),
    "w3c": ((NAMED, "w3c", rf"w3c (?:software notice and |software and document notice and )?{_L}"),),
    "postgresql": (
        (
            GRANT, "without a written agreement is hereby",
            r"for any purpose without fee and without a written agreement is hereby granted",
        ),
        (NAMED, "postgresql", rf"postgresql {_L}"),
    ),
    "odbl-1.0": (
        (GRANT, "open database", rf"{_UNDER} open database {_L}(?: {_V}1 0)?"),
        (NAMED, "open database", rf"open database {_L}(?: {_V}1 0)?"), (NAMED, "odbl", r"odbl"),
    ),
    "odc-by-1.0": (
        (NAMED, "open data commons attribution", rf"open data commons attribution {_L}(?: {_V}1 0)?"),
        (NAMED, "odc by", r"odc by"),
    ),
    "pddl-1.0": ((NAMED, "public domain dedication and", rf"public domain dedication and {_L}(?: {_V}1 0)?"),),
    "cdla-permissive-2.0": ((NAMED, "community data", rf"community data {_L} agreement permissive(?: {_V}2 0)?"),),
    "openrail": (
        (NAMED, "responsible ai", rf"(?:open )?responsible ai {_L}s?"),
        (NAMED, "openrail", r"(?:bigscience |creativeml )?openrail(?: m)?"),
    ),
    "llama-community": ((NAMED, "llama", rf"llama (?:2|3|3 1|3 2|3 3|4) community {_L}(?: agreement)?"),),
    "cc0-1.0": (
        (
            GRANT, "dedicated the work to the",
            r"has dedicated the work to the public domain by waiving all of his or her rights",
        ),
        (GRANT, "cc0 1 0", rf"spdx {_L} identifier cc0 1 0"),
        (NAMED, "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
        (NAMED, "publicdomain zero", r"creativecommons org publicdomain zero 1 0"),
    ),
    "cc-by-2.0": ((NAMED, "cc by|creative commons attribution", r"(?:cc by|creative commons attribution) 2 0"),),
    "cc-by-2.5": ((NAMED, "cc by|creative commons attribution", r"(?:cc by|creative commons attribution) 2 5"),),
    "cc-by-3.0": (
        (GRANT, "cc by 3 0", rf"spdx {_L} identifier cc by 3 0"),
        (
            NAMED, "cc by|creative commons attribution",
            rf"(?:cc by|creative commons attribution) 3 0(?: (?:unported|international|{_L}))?",
        ),
        (NAMED, "licenses by 3 0", r"creativecommons org licenses by 3 0"),
    ),
    "cc-by-4.0": (
        (GRANT, "cc by 4 0", rf"spdx {_L} identifier cc by 4 0"),
        (
            GRANT, "cc by|creative commons attribution",
            rf"{_UNDER} (?:cc by|creative commons attribution) 4 0(?: international)?(?: {_L})?",
        ),
        (
            NAMED, "cc by|creative commons attribution",
            rf"(?:cc by|creative commons attribution) 4 0(?: international)?(?: {_L})?",
        ),
        (NAMED, "licenses by 4 0", r"creativecommons org licenses by 4 0"),
    ),
    "cc-by-sa-2.0": (
        (NAMED, "cc by|creative commons attribution", r"(?:cc by sa|creative commons attribution share ?alike) 2 0"),
    ),
    "cc-by-sa-3.0": (
        (
            NAMED, "cc by|creative commons attribution",
            rf"(?:cc by sa|creative commons attribution share ?alike) 3 0(?: (?:unported|international|{_L}))?",
        ),
        (NAMED, "licenses by sa 3 0", r"creativecommons org licenses by sa 3 0"),
    ),
    "cc-by-sa-4.0": (
        (GRANT, "cc by sa 4 0", rf"spdx {_L} identifier cc by sa 4 0"),
        (
            GRANT, "cc by|creative commons attribution",
            rf"{_UNDER} (?:cc by sa|creative commons attribution share ?alike) 4 0(?: international)?(?: {_L})?",
        ),
        (
            NAMED, "cc by|creative commons attribution",
            r"(?:cc by sa|creative commons attribution share ?alike) 4 0(?: international)?",
        ),
        (NAMED, "licenses by sa 4 0", r"creativecommons org licenses by sa 4 0"),
    ),
    "cc-by-nd-4.0": (
        (
            NAMED, "cc by|creative commons attribution",
            r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s) 4 0(?: international)?",
        ),
        (NAMED, "licenses by nd 4 0", r"creativecommons org licenses by nd 4 0"),
    ),
    "cc-by-nc-3.0": (
        (NAMED, "cc by|creative commons attribution", r"(?:cc by nc|creative commons attribution non ?commercial) 3 0"),
    ),
    "cc-by-nc-4.0": (
        (
            GRANT, "cc by|creative commons attribution",
            rf"{_UNDER} (?:cc by nc|creative commons attribution non ?commercial) 4 0(?: international)?(?: {_L})?",
        ),
        (
            NAMED, "cc by|creative commons attribution",
            r"(?:cc by nc|creative commons attribution non ?commercial) 4 0(?: international)?",
        ),
        (NAMED, "licenses by nc 4 0", r"creativecommons org licenses by nc 4 0"),
    ),
    "cc-by-nc-sa-3.0": (
        (
            NAMED, "cc by|creative commons attribution",
            r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 3 0",
        ),
    ),
    "cc-by-nc-sa-4.0": (
        (
            GRANT, "cc by|creative commons attribution",
            rf"{_UNDER} (?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0(?: international)?(?: {_L})?",
        ),
        (
            NAMED, "cc by|creative commons attribution",
            r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0(?: international)?",
        ),
    ),
    "cc-by-nc-nd-4.0": (
        (
            NAMED, "cc by|creative commons attribution",
            r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s) 4 0(?: international)?",
        ),
    ),
    "cc-by": (
        (GRANT, "cc by", rf"{_UNDER} cc by"),
        (BARE, "creative commons attribution", rf"creative commons attribution(?: {_L})?"),
    ),
    "cc-by-sa": (
        (BARE, "cc by sa", r"cc by sa"),
        (BARE, "creative commons attribution", r"creative commons attribution share ?alike"),
    ),
    "cc-by-nc": (
        (BARE, "cc by nc", r"cc by nc"),
        (BARE, "creative commons attribution", r"creative commons attribution non ?commercial"),
    ),
    "cc-by-nd": ((BARE, "cc by nd", r"cc by nd"),),
    "cc-by-nc-sa": ((BARE, "cc by nc sa", r"cc by nc sa"),),
    "cc-by-nc-nd": ((BARE, "cc by nc nd", r"cc by nc nd"),),
    "cc": ((BARE, "creative commons", rf"creative commons(?: {_L})?"),),
    "public-domain": (
        (
            GRANT, "public domain",
            r"(?:has been |is hereby |is |been )?(?:released|placed|dedicated|put) (?:in|into|to) the public domain",
        ),
        (GRANT, "author disclaims copyright to this", r"the author disclaims copyright to this source code"),
        (BARE, "public domain", r"(?:in |the )?public domain"),
    ),
    "mit OR apache-2.0": (
        (GRANT, "mit or apache 2 0", rf"(?:spdx {_L} identifier )?mit or apache 2 0"),
        (GRANT, "apache 2 0 or mit", rf"(?:spdx {_L} identifier )?apache 2 0 or mit"),
        (GRANT, "apache", rf"apache {_L} {_V}2 0(?: {_L}\S* apache or \S+)? or (?:the )?mit {_L}(?: at your option)?"),
        (GRANT, "mit", rf"dual licen[cs]ed under (?:the )?mit and (?:the )?apache(?: 2 0)?(?: {_L}s?)?"),
        (GRANT, "mit", rf"dual licen[cs]ed under (?:the )?apache(?: 2 0)? and (?:the )?mit(?: {_L}s?)?"),
    ),
    "gpl-2.0 OR mit": (
        (GRANT, "gpl", r"dual (?:licen[cs]ed under )?(?:the )?(?:mit and gpl|gpl and mit|mit gpl|bsd gpl)"),
        (
            GRANT, "mit",
            rf"spdx {_L} identifier (?:gpl 2 0(?: only| or later)? or mit|mit or gpl 2 0(?: only| or later)?)",
        ),
    ),
    "mpl-1.1 OR gpl-2.0 OR lgpl-2.1": (
        (GRANT, "gpl 2 0 lgpl 2 1", r"version mpl 1 1 gpl 2 0 lgpl 2 1"),
        (
            GRANT, "alternatively the contents of this",
            r"alternatively the contents of this file may be used under the terms of either the gnu general public license",
        ),
    ),
    "no-license": (
        (
            NAMED,
            "not licensed|not licenced|not released|not distributed|not available|not published|not covered|not offered",
            rf"(?:is |are )?not (?:licen[cs]ed|released|distributed|available|published|covered|offered)(?: to you)? (?:under|by)(?: the)?(?: terms of(?: the)?)? (?:\S+ ){{1,6}}?(?:{_L}|gpl|bsd|mit)",
        ),
        (
            NAMED,
            "no license|no licence|no open source license|no open source licence|no free software license|no free software licence",
            rf"(?:there is |has |comes with )no (?:open source |free software )?{_L}",
        ),
        (
            NAMED, "without a license|without a licence|without any license|without any licence",
            rf"without (?:a|any) {_L}",
        ),
    ),
    "proprietary": (
        (GRANT, "confidential", r"(?:confidential and proprietary|proprietary and confidential)"),
        (
            GRANT, "unauthorized copying of this",
            r"unauthorized copying of this (?:file|software|program|document) via any medium is strictly prohibited",
        ),
        (GRANT, "reverse engineer decompile or", r"you may not (?:\S+ ){0,8}reverse engineer decompile or disassemble"),
        (GRANT, "end user", rf"end user {_L} agreement"), (NAMED, "all rights reserved", r"all rights reserved"),
        (NAMED, "trade secrets", r"contains (?:valuable )?trade secrets"),
        (GRANT, "no part of this", r"no part of this (?:publication|book|work|document) may be reproduced"),
        (
            NAMED, "reproduced without",
            r"may not be (?:copied or )?reproduced without (?:the )?(?:prior )?(?:written )?(?:permission|consent)",
        ),
    ),
    "non-commercial": (
        (
            GRANT, "commercial use only|commercial purposes only|noncommercial use only|noncommercial purposes only",
            r"for (?:personal and )?non ?commercial (?:use|purposes) only",
        ),
        (GRANT, "academic use only|academic purposes only", r"for (?:research and )?academic (?:use|purposes) only"),
        (NAMED, "commercial use", r"commercial use is (?:strictly )?prohibited"),
    ),
    "freeware": ((NAMED, "freeware", rf"(?:is |as )?freeware(?: {_L})?"),),
    "shareware": ((NAMED, "shareware", r"(?:is |as )?shareware"),),
    "open-government-2.0": ((NAMED, "open government", rf"open government {_L} {_V}2 0"),),
    "open-government-3.0": (
        (
            GRANT, "public sector information",
            r"contains public sector information licensed under the open government licence v3 0",
        ),
        (NAMED, "open government", rf"open government {_L}(?: {_V}3 0)?"),
    ),
    "gutenberg": (
        (GRANT, "project gutenberg", rf"under the terms of the project gutenberg {_L}"),
        (NAMED, "project gutenberg", rf"(?:full )?project gutenberg(?: tm)? {_L}"),
    ),
}

#: What may stand between a license and its exception, and around and between two licenses of which one may choose.
WITH_GAP = r"^ (?:license |licence )?(?:and |plus |together )?(?:with |including )(?:the |a |an )?$"
OR_GAP = r"^ (?:license |licence )?or (?:under )?(?:the )?(?:terms of (?:the )?)?$"
AND_GAP = r"^ (?:license |licence )?and (?:the )?$"
EITHER = r" either (?:the |of the |under the |of )?$"
AT_YOUR_OPTION = r"^ (?:license |licence )?at your (?:option|choice|discretion) "
CHOICE = r" (?:choose|chosen|choice|select|selected|pick) (?:\S+ ){0,2}(?:between|of|from)(?: either)? (?:the )?$"
DUAL = r" (?:dual licen[cs]ed|dually licen[cs]ed|dual licen[cs]e) (?:\S+ ){0,1}(?:under|as|by|with) (?:the )?$"
#: What before a detection takes it back: a negation, and between the two only words like these.
NOT = (
    r" (?:not|never|neither|nor|cannot|isn t|aren t|wasn t)"
    r"(?: (?:is|it|are|be|been|licen[cs]ed|released|distributed|covered|available|published|provided|offered|governed|under|by|a|an|the|terms|of|to|you)){0,7} $"
)
