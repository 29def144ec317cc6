"""License scans by ordered signature rules, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import documents

# The phrases whose places are counted, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Priorities: identifiers, grants and the licenses' own sentences, names and addresses, statements that name no license.
TAG, GRANT, BODY, NAME, PLACE, NOTICE = 4, 3, 3, 2, 2, 1

#: Keywords, rarer ones first, each with a blank before and after the text. Every alternative of every pattern holds one, so that a text
#: without any can match no rule; a rule runs where one of its alternatives' first keywords stands.
KEYWORDS = (
    "creativecommons", "creative commons", "cc by", "cc0", "wtfpl", "mit no attribution", " mpl", " epl", "eupl", "cddl", "bsd", "spdx", "gpl", "copyleft", "public domain", "datenlizenz", "product includes", "perl itself",
    "as long as you retain", "unauthori", "reserv", "vorbehalten", "warrant", "copyright", "copying", "permission", "redistribut", "proprietary", "licen", "software", "material", "agreement", "free for", "terms of use", "the model", "third parties",
    "open source", "object code", "gcc runtime", "invariant sections", "change date", "research", "commercial", "to any person", "contributor hereby", "distribute or publish", "other modules", "this notice", "source versions", "package may be",
    "to convey", "ouverte", "without restriction", "liable", "no restrictions", "supplied as is", "modified",
)

#: Label, names, words of the SPDX identifier, words of addresses. All stand for texts reduced to lower-case words with one blank between.
LICENSES: tuple[tuple[str, str, str, str], ...] = (
    ("apache-2.0", r"apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("apache-1.1", r"apache (?:software )?licen[cs]e (?:version |v )?1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-1.0", r"apache (?:software )?licen[cs]e (?:version |v )?1 0", "apache 1 0", "apache org licenses license 1 0"),
    ("apache", r"apache (?:software )?licen[cs]e", "apache", "apache org licenses"),
    ("mit", r"(?:mit|expat|x11 mit) licen[cs]e", "mit", "opensource org licenses? mit"),
    ("mit-0", r"mit no attribution(?: licen[cs]e)?", "mit 0", "opensource org licenses? mit 0"),
    ("x11", r"x11 licen[cs]e", "x11", "x org licenses"),
    ("gpl-3.0-or-later", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: gpl)?,?(?: version| v)? ?3(?: 0)? or (?:any )?later(?: version)?", "gpl 3 0 or later", "gnu org licenses gpl 3 0 or later"),
    ("gpl-2.0-or-later", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: gpl)?(?: version| v)? ?2(?: 0)? or (?:any )?later(?: version)?", "gpl 2 0 or later", "gnu org licenses old licenses gpl 2 0 or later"),
    ("gpl-3.0", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: gpl)?(?: version| v)? ?3(?: 0)?", "gpl 3 0(?: only)?", "gnu org licenses gpl 3 0"),
    ("gpl-2.0", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: gpl)?(?: version| v)? ?2(?: 0)?", "gpl 2 0(?: only)?", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-1.0", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: gpl)?(?: version| v)? ?1(?: 0)?", "gpl 1 0", "gnu org licenses old licenses gpl 1 0"),
    ("gpl", r"gnu (?:general public licen[cs]e|gpl)", "gpl", "gnu org licenses gpl"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: lgpl)?(?: version| v)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: lgpl)?(?: version| v)? ?2 1", "lgpl 2 1(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-2.0", r"(?:gnu )?(?:library general public licen[cs]e|lgpl)(?: lgpl)?(?: version| v)? ?2(?: 0)?", "lgpl 2 0(?: only| or later)?", "gnu org licenses old licenses lgpl 2 0"),
    ("lgpl", r"gnu (?:lesser|library) (?:general public licen[cs]e|gpl)", "lgpl", "gnu org licenses lgpl"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public licen[cs]e|agpl)(?: agpl)?(?: version| v)? ?3(?: 0)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0"),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", "agpl", "gnu org licenses agpl"),
    ("gfdl-1.3", r"gnu free documentation licen[cs]e(?: version| v)? ?1 3", "gfdl 1 3(?: only| or later)?", "gnu org licenses fdl 1 3"),
    ("gfdl", r"gnu free documentation licen[cs]e", "gfdl", "gnu org licenses fdl"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?", "bsd 2 clause", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?", "bsd 3 clause", "opensource org licenses? bsd 3 clause"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?", "bsd 4 clause", "opensource org licenses? bsd 4 clause"),
    ("0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?", "0bsd", "opensource org licenses? 0bsd"),
    ("bsd", r"bsd(?: style)? licen[cs]e", "bsd", "opensource org licenses? bsd licen[cs]e"),
    ("isc", r"isc licen[cs]e", "isc", "opensource org licenses? isc"),
    ("mpl-2.0", r"(?:mozilla public licen[cs]e|mpl)(?: mpl)?(?: version| v)? ?2(?: 0)?", "mpl 2 0", "mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1.1", r"(?:mozilla public licen[cs]e|mpl)(?: mpl)?(?: version| v)? ?1 1", "mpl 1 1", "mozilla org (?:en us )?mpl 1 1"),
    ("mpl", r"mozilla public licen[cs]e", "mpl", "mozilla org (?:en us )?mpl"),
    ("epl-2.0", r"eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("epl-1.0", r"eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl", r"eclipse public licen[cs]e", "epl", "eclipse org legal epl"),
    ("cddl-1.1", r"common development and distribution licen[cs]e(?: cddl)?(?: version| v)? ?1 1", "cddl 1 1", "oss oracle com licenses cddl"),
    ("cddl-1.0", r"common development and distribution licen[cs]e(?: cddl)?(?: version| v)? ?1 0", "cddl 1 0", "opensource org licenses? cddl1"),
    ("cddl", r"common development and distribution licen[cs]e", "cddl", "opensource org licenses? cddl"),
    ("cpl-1.0", r"common public licen[cs]e(?: version| v)?(?: ?1 0)?", "cpl 1 0", "opensource org licenses? cpl1"),
    ("eupl-1.2", r"european union public licen[cs]e(?: version| v)?(?: ?1 2)", "eupl 1 2", "joinup ec europa eu licen[cs]e eupl 1 2"),
    ("eupl", r"european union public licen[cs]e", "eupl", "joinup ec europa eu licen[cs]e eupl"),
    ("artistic-2.0", r"artistic licen[cs]e(?: version| v)? ?2(?: 0)?", "artistic 2 0", "opensource org licenses? artistic licen[cs]e 2 0"),
    ("artistic", r"artistic licen[cs]e", "artistic 1 0", "opensource org licenses? artistic"),
    ("bsl-1.0", r"boost software licen[cs]e", "bsl 1 0", "boost org licen[cs]e 1 0"),
    ("busl-1.1", r"business source licen[cs]e", "busl 1 1", "mariadb com bsl11 licen[cs]e"),
    ("sspl-1.0", r"server side public licen[cs]e", "sspl 1 0", "mongodb com licensing server side public licen[cs]e"),
    ("elastic-2.0", r"elastic licen[cs]e(?: version| v)?(?: ?2(?: 0)?)?", "elastic 2 0", "elastic co licensing elastic licen[cs]e"),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib", "opensource org licenses? zlib licen[cs]e"),
    ("unlicense", r"(?:the )?unlicen[cs]e", "unlicense", "unlicense org"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public licen[cs]e)", "wtfpl", "wtfpl net licen[cs]e"),
    ("psf-2.0", r"(?:python software foundation|psf) licen[cs]e", "psf 2 0", "python org licen[cs]e"),
    ("php-3.01", r"php licen[cs]e", "php 3 01", "php net licen[cs]e 3 01"),
    ("ruby", r"ruby licen[cs]e", "ruby", "ruby lang org licen[cs]e"),
    ("openssl", r"openssl licen[cs]e", "openssl", "openssl org source licen[cs]e"),
    ("ofl-1.1", r"(?:sil )?open font licen[cs]e", "ofl 1 1", "scripts sil org ofl licen[cs]e"),
    ("odbl-1.0", r"open (?:data commons open )?database licen[cs]e", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", r"open data commons attribution licen[cs]e", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl-1.0", r"public domain dedication and licen[cs]e", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("ms-pl", r"microsoft public licen[cs]e", "ms pl", "opensource org licenses? ms pl licen[cs]e"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "ms rl", "opensource org licenses? ms rl licen[cs]e"),
    ("ncsa", r"university of illinois ncsa open source licen[cs]e", "ncsa", "opensource org licenses? ncsa"),
    ("afl-3.0", r"academic free licen[cs]e", "afl 3 0", "opensource org licenses? afl 3 0"),
    ("osl-3.0", r"open software licen[cs]e", "osl 3 0", "opensource org licenses? osl 3 0"),
    ("upl-1.0", r"universal permissive licen[cs]e", "upl 1 0", "oss oracle com licenses upl"),
    ("openrail", r"(?:creativeml |bigscience )?open ?rail(?: m)? licen[cs]e", "openrail", "bigscience huggingface co openrail licen[cs]e"),
    ("cc0-1.0", r"(?:cc0(?: 1 0)?|creative commons zero)(?: universal| licen[cs]e)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: \d 0)?", "cc by nc nd \\d 0", "creativecommons org licenses by nc nd \\d 0"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: \d 0)?", "cc by nc sa \\d 0", "creativecommons org licenses by nc sa \\d 0"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: \d 0)?", "cc by nc \\d 0", "creativecommons org licenses by nc \\d 0"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: \d 0)?", "cc by nd \\d 0", "creativecommons org licenses by nd \\d 0"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)(?: \d 0)?", "cc by sa \\d 0", "creativecommons org licenses by sa \\d 0"),
    ("cc-by-4.0", r"(?:cc by|creative commons attribution)(?: international)? 4 0(?: international)?", "cc by 4 0", "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", r"(?:cc by|creative commons attribution)(?: unported)? 3 0(?: unported)?", "cc by 3 0", "creativecommons org licenses by 3 0"),
    ("cc-by", r"(?:cc by|creative commons attribution)", "cc by", "creativecommons org licenses by"),
)

#: Label, priority and pattern of sentences from the licenses' own texts, of notices in file headers, and of statements that name no license.
SENTENCES: tuple[tuple[str, int, str], ...] = (
    # The permissive family.
    ("mit", BODY, r"permission is hereby granted free of charge to any person obtaining a copy of this (?:software|font software|work|data)"),
    ("mit", BODY, r"to deal in the (?:software|materials|work) without restriction including without limitation the rights"),
    ("mit", BODY, r"rights to use copy modify merge publish distribute sublicen[cs]e and or sell copies of the software"),
    ("mit", BODY, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the (?:software|work)"),
    ("mit", BODY, r"the above copyright notice and this permission notice including the next paragraph shall be included in all copies"),
    ("mit", BODY, r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("x11", BODY, r"except as contained in this notice the names? of (?:the )?.{1,60} shall not be used in advertising or otherwise to promote the sale"),
    ("isc", BODY, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", BODY, r"the author disclaims all warranties with regard to this software including all implied warranties"),
    ("isc", BODY, r"in no event shall the author be liable for any special direct indirect or consequential damages"),
    ("hpnd", BODY, r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("hpnd", BODY, r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("bsd", BODY, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", BODY, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", BODY, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", BODY, r"this software is provided by (?:the )?.{1,60} as is and any express or implied warranties"),
    ("bsd", BODY, r"in no event shall (?:the )?(?:copyright (?:holders?|owner)|regents|foundation) or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-3-clause", BODY, r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause-clear", BODY, r"no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e"),
    ("bsd-4-clause", BODY, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause-views", BODY, r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("zlib", BODY, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", BODY, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", BODY, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1.0", BODY, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("bsl-1.0", BODY, r"machine executable object code generated by a source language processor"),
    ("ntp", BODY, r"provided that the above copyright notice appears in all copies and that both that? copyright notice and this permission notice appear in supporting documentation"),
    ("curl", BODY, r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("unlicense", BODY, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", BODY, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", BODY, r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed"),
    ("beerware", BODY, r"as long as you retain this notice you can do whatever you want with this (?:stuff|software|file)"),
    ("beerware", BODY, r"the beer ?ware licen[cs]e"),
    ("fsfap", BODY, r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("fsful", BODY, r"this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it"),
    ("postgresql", BODY, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", BODY, r"to deal with the software without restriction including without limitation the rights"),
    ("json", BODY, r"the software shall be used for good not evil"),
    ("vim", BODY, r"there are no restrictions on distributing unmodified copies of vim"),
    ("ftl", BODY, r"portions of this software are copyright \d\d\d\d the freetype project"),
    ("libpng", BODY, r"the png reference library is supplied as is"),
    ("ijg", BODY, r"this software is based in part on the work of the independent jpeg group"),
    ("icu", BODY, r"copyright c? ?\d\d\d\d \d\d\d\d international business machines corporation and others"),
    ("unicode", BODY, r"to any person obtaining a copy of the unicode data files and any associated documentation"),
    ("openssl", BODY, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", BODY, r"this product includes cryptographic software written by eric young"),
    ("php-3.01", BODY, r"this product includes php software freely available from"),
    ("w3c", BODY, r"permission to copy modify and distribute this (?:software|work) and its documentation with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("psf-2.0", BODY, r"psf hereby grants licensee a nonexclusive royalty free world ?wide licen[cs]e"),
    ("psf-2.0", BODY, r"psf is making python available to licensee on an as is basis"),
    ("tcl", BODY, r"the authors hereby grant permission to use copy modify distribute and licen[cs]e this software and its documentation for any purpose"),
    ("ecl-2.0", BODY, r"educational community licen[cs]e"),
    ("mit-0", BODY, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    # Apache.
    ("apache-2.0", BODY, r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", BODY, r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache-2.0", BODY, r"without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", BODY, r"see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e"),
    ("apache-2.0", BODY, r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent|except as stated)"),
    ("apache-2.0", BODY, r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2.0", BODY, r"licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache-1.1", BODY, r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", BODY, r"products derived from this software may not be called apache nor may apache appear in their name"),
    # The GNU family.
    ("gpl", BODY, r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed"),
    ("gpl", BODY, r"this program is free software (?:you can|it may be) redistribut(?:e it|ed) and or modif(?:y it|ied) under the terms of the gnu general public licen[cs]e"),
    ("gpl", BODY, r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", BODY, r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e"),
    ("gpl", BODY, r"you should have received a copy of the gnu general public licen[cs]e along with this (?:program|software|file|package)"),
    ("gpl", BODY, r"write to the free software foundation inc (?:59 temple place|51 franklin st(?:reet)?|675 mass ave)"),
    ("gpl-2.0-or-later", BODY, r"either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-3.0-or-later", BODY, r"either version 3 of the licen[cs]e or at your option any later version"),
    ("gpl-2.0", BODY, r"the licen[cs]es for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", BODY, r"you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program"),
    ("gpl-3.0", BODY, r"the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works"),
    ("gpl-3.0", BODY, r"to convey a work means any kind of propagation that enables other parties to make or receive copies"),
    ("gpl-with-classpath-exception", BODY, r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-with-autoconf-exception", BODY, r"as a special exception to the gnu general public licen[cs]e if you distribute this file as part of a program that contains a configuration script"),
    ("gpl-with-gcc-exception", BODY, r"gcc runtime library exception"),
    ("gpl", BODY, r"distributed under the gpl"),
    ("lgpl", BODY, r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", BODY, r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this (?:library|program|software)"),
    ("lgpl-2.1", BODY, r"either version 2 1 of the licen[cs]e or at your option any later version"),
    ("lgpl-2.1", BODY, r"this is the first released version of the lesser gpl"),
    ("lgpl-3.0", BODY, r"this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3"),
    ("agpl-3.0", BODY, r"the gnu affero general public licen[cs]e is a free copyleft licen[cs]e"),
    ("agpl-3.0", BODY, r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", BODY, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl", BODY, r"with no invariant sections no front cover texts and no back cover texts"),
    # Weak copyleft.
    ("mpl-2.0", BODY, r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl-2.0", BODY, r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", BODY, r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("mpl-1.1", BODY, r"alternatively the contents of this file may be used under the terms of either the gnu general public licen[cs]e"),
    ("npl-1.1", BODY, r"the contents of this file are subject to the netscape public licen[cs]e"),
    ("epl-1.0", BODY, r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0"),
    ("epl-2.0", BODY, r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v ?)?2 0"),
    ("cpl-1.0", BODY, r"the accompanying program is provided under the terms of this common public licen[cs]e"),
    ("cddl", BODY, r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("cddl", BODY, r"when distributing covered code include this cddl header"),
    ("eupl", BODY, r"licensed under the eupl"),
    ("artistic", BODY, r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", BODY, r"this licen[cs]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", BODY, r"(?:redistribute|modify) it under the same terms as perl itself"),
    ("ms-pl", BODY, r"this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e"),
    ("cecill", BODY, r"this software is governed by the cecill(?: [abc])? licen[cs]e under french law"),
    ("osl-3.0", BODY, r"licensed under the open software licen[cs]e"),
    ("qpl", BODY, r"q public licen[cs]e"),
    ("sleepycat", BODY, r"redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"),
    ("lppl", BODY, r"this work may be distributed and or modified under the conditions of the latex project public licen[cs]e"),
    ("ofl-1.1", BODY, r"this font software is licensed under the sil open font licen[cs]e"),
    ("ofl-1.1", BODY, r"the font software may be sold as part of a larger software package but no copy"),
    # Content and data.
    ("cc-by", BODY, r"this work is licensed under a creative commons attribution(?: \d 0)?(?: international| unported)? licen[cs]e"),
    ("cc-by-sa", BODY, r"this work is licensed under a creative commons attribution share ?alike"),
    ("cc-by-nc", BODY, r"this work is licensed under a creative commons attribution non ?commercial"),
    ("cc-by-nd", BODY, r"this work is licensed under a creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by", BODY, r"you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by", BODY, r"you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made"),
    ("cc-by-sa", BODY, r"if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e"),
    ("cc-by-nc", BODY, r"you may not use the material for commercial purposes"),
    ("cc-by-nd", BODY, r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc0-1.0", BODY, r"to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", BODY, r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("odbl-1.0", BODY, r"this .{1,60} is made available under the open database licen[cs]e"),
    ("odc-by-1.0", BODY, r"this .{1,60} is made available under the open data commons attribution licen[cs]e"),
    ("ogl-uk-3.0", BODY, r"contains public sector information licensed under the open government licen[cs]e"),
    ("ogl-uk", NAME, r"open government licen[cs]e"),
    ("etalab-2.0", NAME, r"licence ouverte(?: open licence)?"),
    ("dl-de-by-2.0", NAME, r"datenlizenz deutschland namensnennung(?: version)? 2 0"),
    ("public-domain", NAME, r"(?:released|placed|dedicated|is|are) (?:in|in ?to|to) the public domain"),
    ("public-domain", NAME, r"this (?:work|file|code|software|image|document) (?:has been|was|is hereby) (?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("us-government-work", NAME, r"work of the (?:united states|u s) government .{0,60}(?:not subject to copyright|public domain)"),
    ("copyleft", NAME, r"copyleft (?:all rights reversed|licen[cs]e)"),
    # Models and sources that may be seen but not freely used.
    ("llama-community", NAME, r"(?:meta )?llama \d(?: \d)? community licen[cs]e(?: agreement)?"),
    ("gemma", NAME, r"gemma terms of use"),
    ("openrail", BODY, r"you agree not to use the model or derivatives of the model"),
    ("busl-1.1", BODY, r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("busl-1.1", BODY, r"effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("sspl-1.0", BODY, r"if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("elastic-2.0", BODY, r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", BODY, r"the licen[cs]e does not grant to you the right to sell the software"),
    ("commons-clause", NAME, r"commons clause licen[cs]e condition"),
    ("polyform", NAME, r"polyform (?:noncommercial|small business|perimeter|shield|strict|internal use) licen[cs]e"),
    ("proprietary", NAME, r"(?:proprietary|commercial) licen[cs]e"),
    ("proprietary", NAME, r"unauthori[sz]ed (?:copying|reproduction|use|distribution) of this (?:file|software|program|document|material) .{0,40}(?:strictly )?(?:prohibited|forbidden)"),
    ("proprietary", NAME, r"this (?:software|program|source code|file|document) is (?:the )?(?:confidential and proprietary|proprietary and confidential)(?: information)?"),
    ("proprietary", NAME, r"no part of this (?:publication|work|document|book|software) may be reproduced .{0,60}without (?:the )?(?:prior )?(?:express )?(?:written )?permission"),
    ("proprietary", NAME, r"end user licen[cs]e agreement"),
    ("proprietary", NAME, r"this agreement is a legal agreement between you and"),
    ("non-commercial", NAME, r"(?:for|only for) non ?commercial (?:use|purposes) only"),
    ("non-commercial", NAME, r"free for (?:personal|academic|educational|research|non ?commercial) use(?: only)?"),
    ("research-only", NAME, r"(?:for|available for) (?:academic )?research (?:purposes|use) only"),
    # Statements that point elsewhere.
    ("see-license", NOTICE, r"see (?:the )?(?:file )?(?:licen[cs]e|copying)(?: file| txt| md)? for (?:details|more information|more details|licen[cs]e information|copyright information)"),
    ("see-license", NOTICE, r"licen[cs]e (?:terms )?(?:can be found|is found|are found|found) in the (?:licen[cs]e|copying) file"),
    ("see-license", NOTICE, r"use of this source code is governed by a .{1,40}licen[cs]e that can be found in the licen[cs]e file"),
    ("see-license", NOTICE, r"for (?:the )?full (?:copyright and )?licen[cs]e (?:information|text|terms) (?:please )?(?:see|view)"),
    ("dual-license", NOTICE, r"(?:dual|multi|double|triple) licen[cs]ed under"),
    ("dual-license", NOTICE, r"licensed under either of .{1,80} at your option"),
    ("open-source", NOTICE, r"(?:this is|released as|available as|is) (?:free and )?open source(?: software)? (?:under|licen[cs]ed)"),
    ("all-rights-reserved", NOTICE, r"all rights reserved"),
    ("all-rights-reserved", NOTICE, r"alle rechte vorbehalten"),
    ("all-rights-reserved", NOTICE, r"tous droits reserves"),
    ("all-rights-reserved", NOTICE, r"todos los derechos reservados"),
)

_GRANT = r"(?:re)?(?:licen[cs]ed|released|distributed|available|published|provided|used|shared) (?:under|subject to|according to) (?:the )?(?:terms of )?(?:the )?"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All signature rules, in order: identifiers, grants, names and addresses of each license, then sentences.

    A pattern takes the blank before its first word and looks for that after its last one, so that places of neighbours
    don't share a blank and patterns begin with fixed letters where they can.
    """
    out: list[tuple[str, int, str]] = []
    for label, name, tag, place in LICENSES:
        out += [(label, TAG, rf"spdx licen[cs]e identifier (?:{tag})"), (label, GRANT, _GRANT + f"(?:{name})"), (label, NAME, name), (label, PLACE, place)]
    return tuple(Rule(label, priority, _keywords(p), f" {p}(?= )") for label, priority, p in dict.fromkeys([*out, *SENTENCES]))


def _expand(p: str, i: int = 0) -> tuple[set[str], int]:
    """The texts that a pattern stands for, from place i to the end of its group; a NUL stands for what is not fixed."""
    done, runs = set(), {""}
    while i < len(p) and p[i] != ")":
        if p[i] == "|":
            done, runs, i = done | runs, {""}, i + 1
            continue
        if p.startswith("(?:", i):
            unit, i = _expand(p, i + 3)
            i += 1
        elif p[i] in "[\\.":
            unit, i = {"\0"}, {"[": p.find("]", i) + 1, "\\": i + 2, ".": i + 1}[p[i]]
        else:
            unit, i = {p[i]}, i + 1
        if p.startswith("?", i):
            unit, i = unit | {""}, i + 1
        elif p.startswith("{", i):
            unit, i = {"\0"}, p.index("}", i) + 1
        runs = {r + u for r in runs for u in unit}
    return done | runs, i


def _runs(pattern: str) -> set[str]:
    """All alternatives of a pattern, with the blanks that stand around each match."""
    return {f" {x} " for x in _expand(pattern)[0]}


def _keywords(pattern: str) -> tuple[str, ...]:
    """The first keyword of each alternative of a pattern: every match holds one of them."""
    found = set()
    for x in _runs(pattern):
        if not any(k in x for k in KEYWORDS):
            raise ValueError(f"no keyword for {x!r} of {pattern}")
        found.add(next(k for k in KEYWORDS if k in x))
    return tuple(k for k in KEYWORDS if k in found)


_ACCEPT = "named_struct('p1', -1, 'p2', -1, 'p3', -1, 'p4', -1, 'best', 0, 'kept', cast(array() as array<string>))"

#: Places of a rule's matches: gaps and matches alternate, so running sums of their lengths are the starts. Sums run within blocks of
#: some square root of the matches, from the sums of the blocks before: arrays are only ever appended to while they are short.
_PLACES = """
flatten(transform(hits, h ->
  element_at(transform(array(cast(ceil(sqrt(size(h.lens))) as int)), b ->
    element_at(transform(array(transform(sequence(0, cast(ceil(size(h.lens) / b) as int) - 1), i -> arrays_zip(slice(h.gaps, i * b + 1, b), slice(h.lens, i * b + 1, b)))), blocks ->
      flatten(transform(
        arrays_zip(blocks, aggregate(
          transform(blocks, x -> aggregate(x, 0, (n, y) -> n + y['0'] + y['1'])),
          named_struct('at', 0, 'before', cast(array() as array<int>)),
          (n, y) -> named_struct('at', n.at + y, 'before', array_append(n.before, n.at)), n -> n.before)),
        z -> aggregate(
          z.blocks, named_struct('at', z['1'], 'found', cast(array() as array<struct<start: int, back: int, rank: int, label: string>>)),
          (n, y) -> named_struct(
            'at', n.at + y['0'] + y['1'],
            'found', array_append(n.found, named_struct('start', n.at + y['0'], 'back', -(n.at + y['0'] + y['1']), 'rank', h.rank, 'label', h.label))),
          n -> n.found)))), 1)), 1)))
"""

#: Detections come by start, longer before shorter, higher priority first. One inside an accepted detection of no lower priority is dropped.
_SWEEP = f"""
aggregate(
  array_sort(found), {_ACCEPT},
  (s, d) -> if(
    -d.back <= greatest(s.p4, if(d.rank >= -3, s.p3, -1), if(d.rank >= -2, s.p2, -1), if(d.rank >= -1, s.p1, -1)), s,
    named_struct(
      'p1', if(d.rank = -1, greatest(s.p1, -d.back), s.p1), 'p2', if(d.rank = -2, greatest(s.p2, -d.back), s.p2),
      'p3', if(d.rank = -3, greatest(s.p3, -d.back), s.p3), 'p4', if(d.rank = -4, greatest(s.p4, -d.back), s.p4),
      'best', greatest(s.best, -d.rank), 'kept', array_union(s.kept, array(d.label)))))
"""


@lru_cache(1)
def _hits() -> str:
    """SQL over ``w``: rank, label and the lengths of gaps and matches of each rule that matches. Every pattern is a literal, compiled once a task."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in rules():
        p = f"r'{r.pattern}'"
        matches = f"regexp_extract_all(w, {p}, 0)"
        gaps = f"transform(slice(split(w, {p}, -1), 1, size({matches})), x -> length(x))"
        hit = f"named_struct('rank', {-r.priority}, 'label', '{r.label}', 'gaps', {gaps}, 'lens', transform({matches}, x -> length(x)))"
        groups.setdefault(r.keywords, []).append(f"if(w rlike {p}, {hit}, null)")
    parts = (f"if({' or '.join(f"contains(w, '{k}')" for k in keys)}, array_compact(array({', '.join(hits)})), null)" for keys, hits in groups.items())
    return f"if(w is null, null, flatten(array_compact(array({', '.join(parts)}))))"


def scan(docs: DataFrame) -> DataFrame:
    """Licenses named in every whole text.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, a row for
    each row of ``docs``. Words are runs of anything but ASCII characters other than letters and
    digits, with A-Z in lower case. Base columns count the places of ``PHRASES``. Signature rules
    run on texts that hold one of ``KEYWORDS``, and only those of which the text holds a keyword; of their detections the ones inside a detection of no lower priority are dropped. labels are
    those of base places and of detections that are left. score: the highest priority left over 4 (base places have that of names).

    Null and empty texts have no words, empty labels, score 0 and null first_word and last_word. Rows with null doc_id
    and repeated rows are scanned like any other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = documents(docs).select("doc_id", F.trim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")).alias("norm"))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    # Lower case by Unicode is only a prefilter here: it finds no less than A-Z alone does.
    gated = words.select("doc_id", "norm", F.concat(F.lit(" "), F.lower("norm"), F.lit(" ")).alias("any_case"))
    open_ = F.lit(False)
    for g in KEYWORDS:
        open_ = open_ | F.contains("any_case", F.lit(g))
    n_words = F.when(F.col("norm") == "", F.lit(0)).otherwise(spaces(F.col("norm")) + 1).cast("long")
    gated = gated.select("doc_id", n_words.alias("n_words"), F.when(open_, F.translate("norm", upper, lower)).alias("low"))
    # A blank before and one after each word: neighbouring phrases share none.
    wide = gated.select("doc_id", "n_words", F.concat(F.lit(" "), "low", F.lit(" ")).alias("w"), F.concat(F.lit(" "), F.replace("low", F.lit(" "), F.lit("  ")), F.lit(" ")).alias("wide"))
    parts = wide.select("*", *(F.when(F.contains("wide", F.lit(_wide(p))), F.split("wide", _wide(p), -1)).alias(f"in{i}") for i, (p, _) in enumerate(PHRASES)))
    for i, (p, _) in enumerate(PHRASES):
        c = F.col(f"in{i}")
        before = (spaces(F.element_at(c, 1)) / 2).cast("long")
        after = (F.col("n_words") - (spaces(F.element_at(c, -1)) / 2) - len(p.split())).cast("long")
        parts = parts.withColumn(f"n{i}", F.when(c.isNull(), 0).otherwise(F.size(c) - 1)).withColumn(f"a{i}", before).withColumn(f"z{i}", after).drop(f"in{i}")
    base = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"n{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)))))
    k = range(len(PHRASES))
    based = parts.select("doc_id", "n_words", "w", sum((F.col(f"n{i}") for i in k), F.lit(0)).cast("long").alias("n_base"), F.least(*(F.col(f"a{i}") for i in k)).alias("first_word"), F.greatest(*(F.col(f"z{i}") for i in k)).alias("last_word"), base.alias("base"))
    found = based.withColumn("hits", F.expr(_hits())).drop("w").withColumn("found", F.expr(_PLACES)).drop("hits")
    kept = found.withColumn("swept", F.expr(f"if(found is null, {_ACCEPT}, {_SWEEP})")).drop("found")
    labels = F.array_sort(F.array_union("base", "swept.kept"))
    return kept.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size(labels) == 0, 0.0).otherwise(F.greatest(F.col("swept.best"), F.when(F.size("base") > 0, F.lit(NAME)).otherwise(0)) / 4.0).alias("score"),
    )


def _wide(phrase: str) -> str:
    return " " + phrase.replace(" ", "  ") + " "
