"""License scan with ordered signature rules; DataFrame functions only.

A text becomes lower-case words (runs of digits, a-z and non-ASCII characters) with two spaces
between, so that every rule takes a space on both sides and neighbouring detections never share one.
A first gate of few words and then each rule's keyword keep the regexes from most texts; every rule is first
tested as a literal of the plan, whose pattern is compiled once, and only those that match are placed.  A rule has a label and a priority (0 first).  A
detection is dropped if it lies within one of a rule with higher priority, or of equal priority and
greater length; equal ones stay.

A text's detections are rows of their own while they are placed and suppressed: places are running sums
of the text between matches, and a detection lies within another if an earlier or equal start has an
end as far, which is a running maximum per priority.  Both are window functions over one row's
detections, linear but for the sort, whatever the length of a text.

Beside the rules there are base phrases, found wherever their words stand consecutively; their labels
always stay.  The score is the greatest confidence of what was found: 1 for identifiers, 0.9 for
grants, 0.7 for names, 0.5 for a base phrase alone, else 0.

Defined results: null is empty; repeated rows repeat; other columns are ignored.  Only narrow rows are
shuffled, by a number of the row: no text is, and no group is larger than one text's detections.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Base phrases and their labels (fixed values).
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Label, name as a regex over words, keyword that every match contains (fixed values).
NAMES = [
    ("apache-1.1", "apache (?:software )?licen[cs]e (?:version )?1 1", "apache"),
    ("apache-2.0", "apache (?:software )?licen[cs]e (?:version )?2(?: 0)?", "apache"),
    ("apache", "apache (?:software )?licen[cs]e", "apache"),
    ("mit", "(?:mit|expat|x11) (?:style )?licen[cs]e", "licen"),
    ("bsd-2-clause", "(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd) licen[cs]e", "bsd"),
    ("bsd-3-clause", "(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd) licen[cs]e", "bsd"),
    ("bsd-4-clause", "(?:4 clause bsd|bsd 4 clause|original bsd) licen[cs]e", "bsd"),
    ("bsd", "bsd (?:style )?licen[cs]e", "bsd"),
    ("isc", "isc licen[cs]e", "isc"),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib"),
    ("gpl-2.0", "(?:gnu )?(?:general public licen[cs]e|gpl) (?:version |v)?2(?: 0)?", "2"),
    ("gpl-3.0", "(?:gnu )?(?:general public licen[cs]e|gpl) (?:version |v)?3(?: 0)?", "3"),
    ("gpl", "(?:gnu general public licen[cs]e|gnu gpl|gplv[23])", "g"),
    ("lgpl-2.1", "(?:gnu )?(?:lesser general public licen[cs]e|lgpl) (?:version |v)?2 1", "l"),
    ("lgpl-3.0", "(?:gnu )?(?:lesser general public licen[cs]e|lgpl) (?:version |v)?3(?: 0)?", "l"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "general"),
    ("agpl-3.0", "(?:gnu )?affero general public licen[cs]e(?: version| v)? 3(?: 0)?", "affero"),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", "affero"),
    ("fdl", "gnu free documentation licen[cs]e", "documentation"),
    ("mpl-1.1", "mozilla public licen[cs]e (?:version )?1 1", "mozilla"),
    ("mpl-2.0", "mozilla public licen[cs]e (?:version )?2(?: 0)?", "mozilla"),
    ("mpl", "mozilla public licen[cs]e", "mozilla"),
    ("epl-1.0", "eclipse public licen[cs]e (?:version )?1(?: 0)?", "eclipse"),
    ("epl-2.0", "eclipse public licen[cs]e (?:version )?2(?: 0)?", "eclipse"),
    ("epl", "eclipse public licen[cs]e", "eclipse"),
    ("cddl", "common development and distribution licen[cs]e", "development"),
    ("cpl", "common public licen[cs]e", "common"),
    ("eupl", "european union public licen[cs]e", "european"),
    ("artistic-2.0", "artistic licen[cs]e (?:version )?2(?: 0)?", "artistic"),
    ("artistic", "artistic licen[cs]e", "artistic"),
    ("boost", "boost software licen[cs]e", "boost"),
    ("unlicense", "the unlicense", "unlicense"),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "want"),
    ("python", "python (?:software foundation )?licen[cs]e", "python"),
    ("postgresql", "postgresql licen[cs]e", "postgresql"),
    ("openssl", "openssl licen[cs]e", "openssl"),
    ("ofl", "(?:sil )?open font licen[cs]e", "font"),
    ("odbl", "open (?:database|data commons open database) licen[cs]e", "database"),
    ("ms-pl", "microsoft public licen[cs]e", "microsoft"),
    ("cc-by-4.0", "creative commons attribution (?:international )?(?:licen[cs]e )?(?:version )?4 0", "creative"),
    ("cc-by-sa", "creative commons attribution share ?alike", "creative"),
    ("cc-by-sa", "cc by sa", "cc"),
    ("cc-by-nc", "creative commons attribution non ?commercial", "creative"),
    ("cc-by-nc", "cc by nc", "cc"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s", "creative"),
    ("cc-by-nd", "cc by nd", "cc"),
    ("cc-by", "creative commons attribution", "creative"),
    ("cc0", "(?:cc0|creative commons zero)", "c"),
]

#: Words before a name that make it a grant (fixed values).
GRANT = "(?:(?:is |are )?licen[cs]ed under|(?:released|distributed|available|published|provided) under|subject to|under) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"

#: SPDX identifiers as they are written, by label; those of GNU licences also with -only and -or-later (fixed values).
SPDX = [
    ("0bsd", "0BSD"), ("afl-2.1", "AFL-2.1"), ("afl-3.0", "AFL-3.0"), ("agpl-3.0", "AGPL-3.0"), ("apache-1.0", "Apache-1.0"), ("apache-1.1", "Apache-1.1"), ("apache-2.0", "Apache-2.0"), ("apsl-2.0", "APSL-2.0"),
    ("artistic-1.0", "Artistic-1.0"), ("artistic-1.0", "Artistic-1.0-Perl"), ("artistic-2.0", "Artistic-2.0"), ("beerware", "Beerware"), ("blueoak-1.0.0", "BlueOak-1.0.0"), ("bsd-1-clause", "BSD-1-Clause"),
    ("bsd-2-clause", "BSD-2-Clause"), ("bsd-2-clause-patent", "BSD-2-Clause-Patent"), ("bsd-3-clause", "BSD-3-Clause"), ("bsd-3-clause-clear", "BSD-3-Clause-Clear"), ("bsd-4-clause", "BSD-4-Clause"), ("boost", "BSL-1.0"),
    ("busl-1.1", "BUSL-1.1"), ("bzip2", "bzip2-1.0.6"), ("cc-by-3.0", "CC-BY-3.0"), ("cc-by-4.0", "CC-BY-4.0"), ("cc-by-nc-4.0", "CC-BY-NC-4.0"), ("cc-by-nc-nd-4.0", "CC-BY-NC-ND-4.0"), ("cc-by-nc-sa-4.0", "CC-BY-NC-SA-4.0"),
    ("cc-by-nd-4.0", "CC-BY-ND-4.0"), ("cc-by-sa-3.0", "CC-BY-SA-3.0"), ("cc-by-sa-4.0", "CC-BY-SA-4.0"), ("cc0", "CC0-1.0"), ("cddl", "CDDL-1.0"), ("cddl", "CDDL-1.1"), ("cecill-2.1", "CECILL-2.1"), ("cecill-b", "CECILL-B"),
    ("cecill-c", "CECILL-C"), ("cpl", "CPL-1.0"), ("curl", "curl"), ("ecl-2.0", "ECL-2.0"), ("efl-2.0", "EFL-2.0"), ("elastic-2.0", "Elastic-2.0"), ("epl-1.0", "EPL-1.0"), ("epl-2.0", "EPL-2.0"), ("eupl", "EUPL-1.1"), ("eupl", "EUPL-1.2"),
    ("fdl", "GFDL-1.2"), ("fdl", "GFDL-1.3"), ("ftl", "FTL"), ("gpl-1.0", "GPL-1.0"), ("gpl-2.0", "GPL-2.0"), ("gpl-3.0", "GPL-3.0"), ("hpnd", "HPND"), ("icu", "ICU"), ("ijg", "IJG"), ("ipl-1.0", "IPL-1.0"), ("isc", "ISC"),
    ("lgpl-2.0", "LGPL-2.0"), ("lgpl-2.1", "LGPL-2.1"), ("lgpl-3.0", "LGPL-3.0"), ("libpng", "Libpng"), ("libpng", "libpng-2.0"), ("lppl-1.3c", "LPPL-1.3c"), ("mit", "MIT"), ("mit-0", "MIT-0"), ("mpl-1.0", "MPL-1.0"), ("mpl-1.1", "MPL-1.1"),
    ("mpl-2.0", "MPL-2.0"), ("ms-pl", "MS-PL"), ("ms-rl", "MS-RL"), ("mulanpsl-2.0", "MulanPSL-2.0"), ("ncsa", "NCSA"), ("odbl", "ODbL-1.0"), ("odc-by-1.0", "ODC-By-1.0"), ("ofl", "OFL-1.1"), ("openssl", "OpenSSL"), ("osl-3.0", "OSL-3.0"),
    ("pddl-1.0", "PDDL-1.0"), ("php-3.01", "PHP-3.01"), ("postgresql", "PostgreSQL"), ("python", "PSF-2.0"), ("python", "Python-2.0"), ("qpl-1.0", "QPL-1.0"), ("ruby", "Ruby"), ("sleepycat", "Sleepycat"), ("sspl-1.0", "SSPL-1.0"), ("tcl", "TCL"),
    ("unicode-dfs-2016", "Unicode-DFS-2016"), ("unlicense", "Unlicense"), ("upl-1.0", "UPL-1.0"), ("vim", "Vim"), ("w3c", "W3C"), ("wtfpl", "WTFPL"), ("x11", "X11"), ("zlib", "Zlib"), ("zpl-2.1", "ZPL-2.1"),
]

#: Rules that stand alone: label, regex, keyword, priority (fixed values).
ALONE = [
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "confidential", 1),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution)(?: of this (?:file|work|software))?", "unauthori", 1),
    ("proprietary", "may not be (?:copied|reproduced|redistributed) without (?:prior )?(?:written )?(?:permission|consent)", "may", 1),
    ("public-domain", "(?:dedicated|released|placed) (?:to|into|in) the public domain", "public", 1),
    ("public-domain", "public domain", "public", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby", 1),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission", 1),
    ("bsd", "redistribution and use in source and binary forms(?: with or without modification)?", "redistribution", 1),
    ("zlib", "this software is provided as is without any express or implied warranty", "warranty", 2),
    ("gpl", "either version [23] of the licen[cs]e or at your option any later version", "option", 1),
    ("gpl-2.0", "gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e", "foundation", 1),
    ("gpl-3.0", "gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e", "foundation", 1),
    ("gpl-2.0", "gnu general public licen[cs]e version 2 as published by the free software foundation", "foundation", 1),
    ("lgpl-2.1", "gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e", "foundation", 1),
    ("lgpl-3.0", "gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e", "foundation", 1),
    ("agpl-3.0", "gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e", "affero", 1),
    ("fdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "documentation", 1),
    ("apache-2.0", "licen[cs]ed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e", "compliance", 1),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", "mozilla", 1),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1", "mozilla", 1),
    ("epl-1.0", "made available under the terms of the eclipse public licen[cs]e (?:v ?)?1 0", "eclipse", 1),
    ("epl-2.0", "made available under the terms of the eclipse public licen[cs]e (?:v ?)?2 0", "eclipse", 1),
    ("cddl", "subject to the terms of the common development and distribution licen[cs]e", "development", 1),
    ("boost", "distributed under the boost software licen[cs]e version 1 0", "boost", 1),
    ("bsd", "governed by a bsd style licen[cs]e", "bsd", 1),
    ("mit", "governed by an mit style licen[cs]e", "mit", 1),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 1),
    ("ofl", "this font software is licen[cs]ed under the sil open font licen[cs]e version 1 1", "font", 1),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee", "fee", 1),
    ("zlib", "altered source versions must be plainly marked as such", "altered", 1),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "endorse", 1),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising", 1),
    ("artistic", "under the same terms as perl itself", "perl", 1),
    ("cc0", "has waived all copyright and related or neighbou?ring rights", "waived", 1),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", "copyright", 2),
]

#: Sentences, notices and addresses that only one license uses: label, regex, keyword (fixed values); grants, priority 1.
SIGNATURES = [
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify", "restriction"),
    ("mit", "(?:www )?opensource org licenses? mit(?: license)?", "opensource"),
    ("mit", "see (?:the )?licen[cs]e mit", "mit"),
    ("isc", "and or distribute this software for any purpose with or without fee is hereby granted", "fee"),
    ("isc", "(?:www )?opensource org licenses? isc", "opensource"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions", "redistributions"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions"),
    ("bsd-2-clause", "(?:www )?opensource org licenses? bsd 2 clause", "opensource"),
    ("bsd-2-clause", "the freebsd copyright", "freebsd"),
    ("bsd-3-clause", "(?:www )?opensource org licenses? bsd 3 clause", "opensource"),
    ("bsd-3-clause", "the name of the author may not be used to endorse or promote products derived from this software", "endorse"),
    ("bsd-4-clause", "this product includes software developed by the university of california berkeley and its contributors", "berkeley"),
    ("bsd-4-clause", "this product includes software developed by the netbsd foundation", "netbsd"),
    ("apache-2.0", "(?:www )?apache org licenses license 2 0", "apache"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", "applicable"),
    ("apache-2.0", "subject to the terms and conditions of this licen[cs]e each contributor hereby grants to you a perpetual worldwide", "perpetual"),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache"),
    ("apache-1.0", "this product includes software developed by the apache group", "apache"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "redistribute"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", "hope"),
    ("gpl", "you should have received a copy of the gnu general public licen[cs]e along with this program", "received"),
    ("gpl-2.0", "(?:www )?gnu org licenses (?:old licenses )?gpl 2 0", "gnu"),
    ("gpl-3.0", "(?:www )?gnu org licenses gpl 3 0", "gnu"),
    ("gpl-2.0", "dual mit gpl licen[cs]e version 2", "dual"),
    ("gpl-classpath-exception", "linking this library statically or dynamically with other modules is making a combined work", "linking"),
    ("gpl-gcc-exception", "gcc runtime library exception", "runtime"),
    ("gpl-bison-exception", "you may create a larger work that contains part or all of the bison parser skeleton", "bison"),
    ("gpl-autoconf-exception", "if you distribute this file as part of a program that contains a configuration script generated by autoconf", "autoconf"),
    ("gpl-font-exception", "if you create a document which uses this font and embed this font or unaltered portions", "embed"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", "redistribute"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this (?:library|program)", "received"),
    ("lgpl-2.0", "gnu library general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e", "foundation"),
    ("lgpl-2.1", "(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1", "gnu"),
    ("lgpl-3.0", "(?:www )?gnu org licenses lgpl 3 0", "gnu"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", "affero"),
    ("agpl-3.0", "(?:www )?gnu org licenses agpl 3 0", "gnu"),
    ("fdl", "with no invariant sections no front cover texts and no back cover texts", "invariant"),
    ("fdl", "(?:www )?gnu org licenses fdl", "gnu"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("mpl-2.0", "(?:www )?mozilla org (?:en us )?mpl 2 0", "mozilla"),
    ("mpl-1.1", "(?:www )?mozilla org mpl mpl 1 1", "mozilla"),
    ("mpl-1.1", "alternatively the contents of this file may be used under the terms of either the gnu general public licen[cs]e", "alternatively"),
    ("npl", "the contents of this file are subject to the netscape public licen[cs]e", "netscape"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", "accompanying"),
    ("epl-1.0", "(?:www )?eclipse org legal epl v10", "eclipse"),
    ("epl-2.0", "(?:www )?eclipse org legal epl 2 0", "eclipse"),
    ("edl-1.0", "eclipse distribution licen[cs]e v ?1 0", "eclipse"),
    ("cddl", "you can obtain a copy of the licen[cs]e at usr src opensolaris licen[cs]e", "opensolaris"),
    ("cddl", "when distributing covered code include this cddl header in each file", "cddl"),
    ("cpl", "the accompanying program is provided under the terms of this common public licen[cs]e", "accompanying"),
    ("ipl-1.0", "ibm public licen[cs]e version 1 0", "ibm"),
    ("apsl-2.0", "apple public source licen[cs]e version 2 0", "apple"),
    ("apsl", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source licen[cs]e", "apple"),
    ("eupl", "licen[cs]ed under the eupl(?: version 1 [12])?", "eupl"),
    ("cecill", "this software is governed by the cecill(?: [bc])? licen[cs]e under french law", "cecill"),
    ("osl-3.0", "licen[cs]ed under the open software licen[cs]e version 3 0", "open"),
    ("afl-3.0", "licen[cs]ed under the academic free licen[cs]e version 3 0", "academic"),
    ("afl-2.1", "licen[cs]ed under the academic free licen[cs]e version 2 1", "academic"),
    ("artistic", "the artistic licen[cs]e which comes with this kit", "artistic"),
    ("artistic-2.0", "(?:www )?opensource org licenses? artistic licen[cs]e 2 0", "opensource"),
    ("ruby", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl", "bsdl"),
    ("ruby", "under the same terms as ruby(?: itself)?", "ruby"),
    ("python", "psf licen[cs]e agreement for python", "psf"),
    ("python", "beopen com licen[cs]e agreement for python", "beopen"),
    ("php-3.01", "this product includes php software freely available from", "php"),
    ("php-3.01", "php licen[cs]e version 3 0 ?1", "php"),
    ("zlib", "the origin of this software must not be misrepresented", "misrepresented"),
    ("zlib", "this notice may not be removed or altered from any source distribution", "altered"),
    ("libpng", "png reference library licen[cs]e", "png"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "organization"),
    ("boost", "(?:www )?boost org licen[cs]e 1 0", "boost"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl"),
    ("ssleay", "this product includes cryptographic software written by eric young", "cryptographic"),
    ("postgresql", "postgresql global development group", "postgresql"),
    ("ncsa", "university of illinois ncsa open source licen[cs]e", "ncsa"),
    ("w3c", "w3c software (?:and document )?notice and licen[cs]e", "w3c"),
    ("unicode", "unicode inc licen[cs]e agreement data files and software", "unicode"),
    ("icu", "icu licen[cs]e icu 1 8 1 and later", "icu"),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "jpeg"),
    ("ftl", "the freetype project licen[cs]e", "freetype"),
    ("tcl", "this software is copyrighted by the regents of the university of california sun microsystems", "regents"),
    ("x11", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", "dealings"),
    ("hpnd", "supporting documentation and that the name of the copyright holder not be used in advertising or publicity", "publicity"),
    ("vim", "vim licen[cs]e", "vim"),
    ("curl", "curl and libcurl are licen[cs]ed under", "libcurl"),
    ("sqlite", "may you do good and not evil may you find forgiveness for yourself and forgive others", "forgiveness"),
    ("json", "the software shall be used for good not evil", "evil"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer", "beer"),
    ("wtfpl", "(?:www )?wtfpl net", "wtfpl"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "compile"),
    ("unlicense", "(?:www )?unlicense org", "unlicense"),
    ("cc0", "creativecommons org publicdomain zero 1 0", "creativecommons"),
    ("cc-by-4.0", "creativecommons org licenses by 4 0", "creativecommons"),
    ("cc-by-3.0", "creativecommons org licenses by 3 0", "creativecommons"),
    ("cc-by-sa-4.0", "creativecommons org licenses by sa 4 0", "creativecommons"),
    ("cc-by-sa-3.0", "creativecommons org licenses by sa 3 0", "creativecommons"),
    ("cc-by-nc-4.0", "creativecommons org licenses by nc 4 0", "creativecommons"),
    ("cc-by-nd-4.0", "creativecommons org licenses by nd 4 0", "creativecommons"),
    ("cc-by-nc-sa-4.0", "creativecommons org licenses by nc sa 4 0", "creativecommons"),
    ("cc-by-nc-nd-4.0", "creativecommons org licenses by nc nd 4 0", "creativecommons"),
    ("ofl", "(?:with )?reserved font name", "reserved"),
    ("ofl", "(?:www )?scripts sil org ofl", "ofl"),
    ("bitstream-vera", "permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this licen[cs]e", "fonts"),
    ("ubuntu-font", "ubuntu font licen[cs]e version 1 0", "ubuntu"),
    ("odbl", "opendatacommons org licenses odbl 1 0", "opendatacommons"),
    ("odc-by-1.0", "opendatacommons org licenses by 1 0", "opendatacommons"),
    ("pddl-1.0", "opendatacommons org licenses pddl 1 0", "opendatacommons"),
    ("cdla-permissive", "community data licen[cs]e agreement permissive", "community"),
    ("cdla-sharing", "community data licen[cs]e agreement sharing", "community"),
    ("ogl-uk", "contains public sector information licen[cs]ed under the open government licen[cs]e", "sector"),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "microsoft"),
    ("ms-lpl", "microsoft limited public licen[cs]e", "microsoft"),
    ("sspl-1.0", "server side public licen[cs]e version 1", "server"),
    ("busl-1.1", "business source licen[cs]e 1 1", "business"),
    ("elastic-2.0", "elastic licen[cs]e 2 0", "elastic"),
    ("commons-clause", "commons clause licen[cs]e condition v ?1 0", "commons"),
    ("polyform-noncommercial", "polyform noncommercial licen[cs]e 1 0 0", "polyform"),
    ("polyform-shield", "polyform shield licen[cs]e 1 0 0", "polyform"),
    ("blueoak-1.0.0", "blue oak model licen[cs]e 1 0 0", "oak"),
    ("mulanpsl-2.0", "mulan permissive software licen[cs]e v ?2", "mulan"),
    ("lppl-1.3c", "latex project public licen[cs]e either version 1 3c?", "latex"),
    ("openrail", "(?:creativeml )?open rail m(?: licen[cs]e)? use based restrictions in licen[cs]e", "rail"),
    ("llama-community", "llama (?:2|3) community licen[cs]e agreement", "llama"),
    ("anti-996", "anti 996 licen[cs]e", "996"),
    ("hippocratic", "hippocratic licen[cs]e", "hippocratic"),
    ("erlpl-1.1", "the contents of this file are subject to the erlang public licen[cs]e", "erlang"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", "redistributions"),
    ("qpl-1.0", "the q public licen[cs]e version 1 0", "q"),
    ("zpl-2.1", "zope public licen[cs]e zpl version 2 1", "zope"),
    ("ecl-2.0", "educational community licen[cs]e version 2 0", "educational"),
    ("efl-2.0", "eiffel forum licen[cs]e version 2", "eiffel"),
    ("upl-1.0", "the universal permissive licen[cs]e upl version 1 0", "universal"),
    ("bzip2", "this program bzip2 the associated library libbzip2 and all documentation are copyright", "libbzip2"),
    ("sun-bcl", "sun microsystems inc binary code licen[cs]e agreement", "binary"),
    ("nvidia-eula", "nvidia software licen[cs]e agreement", "nvidia"),
    ("intel-simplified", "intel simplified software licen[cs]e", "intel"),
    ("proprietary", "this software is the confidential and proprietary information of", "confidential"),
    ("proprietary", "unpublished proprietary source code copyright", "unpublished"),
    ("proprietary", "contains trade secrets? and is protected by copyright", "trade"),
    ("proprietary", "the software is licen[cs]ed not sold", "sold"),
    ("proprietary", "end user licen[cs]e agreement", "user"),
    ("proprietary", "for evaluation purposes only under (?:a|the) licen[cs]e", "evaluation"),
    ("proprietary", "under a non disclosure agreement and copyright", "disclosure"),
    ("proprietary", "requires a commercial licen[cs]e", "commercial"),
    ("public-domain", "(?:this (?:work|file|code|software) is )?in the public domain and has no copyright", "domain"),
    ("public-domain", "no copyright is claimed", "claimed"),
]

#: Words of which every text with a detection contains one: the first gate.
GATE = ("licen", "copyright", "public  domain", "cc  by", "all  rights  reserved", "cc0", "creative  commons", "creativecommons", "confidential", "unauthori", "may  not  be", "hereby  granted", "permission  to", "redistribut", "warranty", "later  version", "gpl", "altered  source", "advertising  materials", "perl  itself", "cover  texts", "runtime  library", "bison  parser", "autoconf", "this  font", "the  mpl", "mozilla", "eclipse", "cddl", "eupl", "same  terms", "product  includes", "misrepresented", "postgresql", "based  in  part", "dealings", "forgiveness", "good  not  evil", "a  beer", "wtfpl", "anyone  is  free", "font  name", "scripts  sil", "restriction", "linking  this", "statically", "purpose  with", "promote  products", "netbsd", "endorse", "trade  secret")

CONFIDENCE = (1.0, 0.9, 0.7)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def rules() -> list[dict]:
    """Names alone and granted, the SPDX identifiers, then what is written by hand; about 380."""
    out = [{"label": label, "rx": rx, "kw": kw, "prio": prio} for label, name, kw in NAMES for rx, prio in ((name, 2), (GRANT + name, 1))]
    for label, tag in SPDX:
        words = re.sub("[^0-9a-z]+", " ", tag.lower())
        suffix = "(?: only| or later)?" if re.match("a?gpl|lgpl|gfdl", words) else ""
        out.append({"label": label, "rx": f"spdx license identifier {words}{suffix}", "kw": "spdx", "prio": 0})
    out += [{"label": label, "rx": rx, "kw": kw, "prio": prio} for label, rx, kw, prio in [*ALONE, *((*r, 1) for r in SIGNATURES)]]
    for r in out:
        r["rx"] = "( " + r["rx"].replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + " )"
    return out


def _count(text: Column, phrase: str) -> Column:
    """Places of a phrase that starts and ends with a space and cannot overlap itself."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def _words_before(text: Column, at: Column) -> Column:
    """Words that end before the character at (0-based)."""
    head = F.substring(text, F.lit(1), at + 1)
    return ((F.length(head) - F.length(F.replace(head, F.lit("  "), F.lit(" "))) - 1)).cast("long")


def _hits(table: list[dict]) -> str:
    """SQL for the numbers of the rules that match `t`: by keyword, each pattern a literal of the plan that is compiled once."""
    by_keyword: dict[str, list[str]] = {}
    for i, r in enumerate(table):
        by_keyword.setdefault(r["kw"], []).append(f"CASE WHEN t RLIKE '{r['rx']}' THEN {i} END")
    groups = ", ".join(f"CASE WHEN contains(t, '{kw}') THEN array({', '.join(tests)}) END" for kw, tests in by_keyword.items())
    return f"array_compact(flatten(array_compact(array({groups}))))"


def _matches(text: Column, rule: Column, rx: Column) -> Column:
    """rule, i, gap, n of each match of a rule: its number, the length of the text since the last match's start, its length."""
    pieces = F.split(F.regexp_replace(text, rx, F.lit("\x01$1\x02")), "\x01")
    plain = lambda p: F.length(F.replace(p, F.lit("\x02"), F.lit("")))
    pairs = F.transform(F.array(pieces), lambda x: F.arrays_zip(F.slice(x, F.lit(2), F.size(x)).alias("p"), x.alias("before")))[0]  # pieces are made once
    rows = F.transform(pairs, lambda z, i: F.struct(rule.alias("rule"), i.alias("i"), plain(z["before"]).alias("gap"), (F.instr(z["p"], "\x02") - 1).alias("n")))
    return F.slice(rows, F.lit(1), F.size(rows) - 1)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections of every row."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), capitals, capitals.lower())
    plain = F.trim(F.regexp_replace(lowered, SEPARATORS, "  "))
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.concat(F.lit("  "), plain, F.lit("  ")).alias("t"))
    t = F.col("t")
    rows = rows.withColumn("open", F.expr(" OR ".join(f"contains(t, '{word}')" for word in GATE)))
    table = rules()
    patterns = F.array(*(F.lit(r["rx"]) for r in table))
    rows = rows.withColumn("hits", F.when(F.col("open"), F.expr(_hits(table))))
    found = F.flatten(F.transform("hits", lambda i: _matches(t, i, F.get(patterns, i))))
    counts, first, last, named = [], [], [], []
    for phrase, label in BASE:
        p = " " + phrase.replace(" ", "  ") + " "
        n = F.when(F.col("open"), _count(t, p)).otherwise(F.lit(0))
        counts.append(n)
        first.append(F.when(F.col("open") & (F.instr(t, p) > 0), _words_before(t, F.instr(t, p) - 1)))
        back = F.instr(F.reverse(t), p[::-1])
        last.append(F.when(F.col("open") & (F.instr(t, p) > 0), _words_before(t, F.length(t) - back + 1 - len(p))))
        named.append(F.when(F.col("open") & F.contains(t, F.lit(p)), F.lit(label)))
    words = F.when(F.trim("t") == "", 0).otherwise((F.length("t") - F.length(F.replace(t, F.lit("  "), F.lit(" ")))) - 1).cast("long")
    scalars = {"n_words": words, "n_base": sum(counts[1:], counts[0]).cast("long"), "first_word": F.least(*first), "last_word": F.greatest(*last), "base": F.array_compact(F.array(*named))}
    narrow = rows.select(F.monotonically_increasing_id().alias("r"), "doc_id", *(c.alias(n) for n, c in scalars.items()), found.alias("found"))
    each = narrow.select("r", "doc_id", *scalars, F.explode_outer("found").alias("f")).select("r", "doc_id", *scalars, "f.*").repartition("r")
    prios, labels = (F.array(*(F.lit(r[k]) for r in table)) for k in ("prio", "label"))
    each = each.withColumns({"prio": F.get(prios, F.col("rule")), "at": F.sum("gap").over(Window.partitionBy("r", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))})
    each = each.withColumn("end", F.col("at") + F.col("n"))
    order = Window.partitionBy("r").orderBy("at")
    reach = lambda p, to: F.max(F.when(F.col("prio") == p, F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, to))
    levels = range(len(CONFIDENCE))
    each = each.withColumns({f"upto{p}": reach(p, 0) for p in levels} | {f"before{p}": reach(p, -1) for p in levels})
    hidden = F.lit(False)
    for p in levels:
        yes = lambda c: F.coalesce(c, F.lit(False))
        hidden = hidden | ((F.col("prio") > p) & yes(F.col(f"upto{p}") >= F.col("end"))) | ((F.col("prio") == p) & (yes(F.col(f"before{p}") >= F.col("end")) | yes(F.col(f"upto{p}") > F.col("end"))))
    kept = F.struct(F.col("at").cast("int").alias("at"), "n", "prio", F.get(labels, F.col("rule")).alias("label"))
    each = each.withColumn("kept", F.when(F.col("rule").isNotNull() & ~hidden, kept))
    done = each.groupBy("r").agg(*(F.first(c).alias(c) for c in ("doc_id", *scalars)), F.sort_array(F.collect_list("kept")).alias("kept"))
    every = F.array_sort(F.array_distinct(F.concat("base", F.transform("kept", lambda h: h["label"]))))
    best = F.aggregate(F.transform("kept", lambda h: F.get(F.array(*map(F.lit, CONFIDENCE)), h["prio"])), F.when(F.size("base") > 0, 0.5).otherwise(0.0), lambda a, x: F.greatest(a, x))
    return done.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), best.alias("score"), F.col("kept").alias("detections"))


def sql() -> str:
    """The same in DuckDB, with the rules as a table."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(r['label'])}, {quote(r['rx'])}, {quote(r['kw'])}, {r['prio']})" for r in rules())
    phrases = ", ".join(f"({quote(' ' + p.replace(' ', '  ') + ' ')}, {quote(label)})" for p, label in BASE)
    gate = " OR ".join(f"contains(t, {quote(w)})" for w in GATE)
    return f"""
WITH rules(label, rx, kw, prio) AS (VALUES {values}), phrases(p, label) AS (VALUES {phrases}),
docs AS (SELECT doc_id, '  ' || trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}', '  ', 'g')) || '  ' AS t FROM documents),
base AS (SELECT doc_id, p, b.label, t, (length(t) - length(replace(t, p, ''))) // length(p) AS n,
    (length(t[1:instr(t, p)]) - length(replace(t[1:instr(t, p)], '  ', ' ')) - 1) AS f,
    (length(t[1:length(t) - instr(reverse(t), reverse(p)) + 2 - length(p)]) - length(replace(t[1:length(t) - instr(reverse(t), reverse(p)) + 2 - length(p)], '  ', ' ')) - 1) AS l
  FROM docs, phrases b WHERE contains(t, p)),
b AS (SELECT doc_id, sum(n)::BIGINT AS n_base, min(f)::BIGINT AS first_word, max(l)::BIGINT AS last_word, string_agg(label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
parts AS (SELECT doc_id, label, prio, string_split(regexp_replace(t, rx, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM docs, rules WHERE ({gate}) AND contains(t, kw)),
pieces AS (SELECT doc_id, label, prio, unnest(parts) AS part, unnest(range(0, len(parts))) AS i, row_number() OVER () AS k, parts FROM parts WHERE len(parts) > 1),
found AS (SELECT doc_id, label, prio, instr(part, chr(2)) - 1 AS n, length(replace(array_to_string(parts[1:i], ''), chr(2), '')) AS at0 FROM pieces WHERE i > 0),
kept AS (SELECT * FROM found h WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.doc_id = h.doc_id AND g.at0 <= h.at0 AND g.at0 + g.n >= h.at0 + h.n AND (g.prio < h.prio OR (g.prio = h.prio AND g.n > h.n)))),
named AS (SELECT doc_id, label, CASE prio WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.7 END AS c FROM kept UNION ALL SELECT doc_id, label, 0.5 FROM base),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c)::DOUBLE AS score FROM named GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN trim(t) = '' THEN 0 ELSE length(t) - length(replace(t, '  ', ' ')) - 1 END::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
"""
