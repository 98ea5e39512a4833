"""License scans by ordered signature rules.

A text is normalised to its words (A-Z lower-cased, one space between, one at
each end). Rules are hand-written regexes over that form, in order of priority;
each is gated by words that its regex requires, looked for as plain substrings
before it runs. Names that a conjunction adds to a detection ("... MIT or
Apache 2.0", terms of SPDX expressions) are detections too.

Suppression goes in rounds, and only what stays suppresses: of the detections
that touch none that stays, those that lie within no other one (of equal
intervals the better priority, then the earlier rule) are taken by priority,
then by start, each unless it overlaps one taken before. So whatever is
suppressed overlaps a detection that stays. Labels of REMARKS name no license
(general notices, mentions of two licenses, of a file); they and the licenses
do not suppress each other.

Base rules are phrases that are always reported, each with all its places.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _parser as parts

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqlab.llm.common import _TO_SPACE

SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,first_word:bigint,n_words:bigint,rule:string>>"

#: Phrases that are always reported, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Families: (label, names as regexes over normalised words).
FAMILIES = (
    ("mit", r"mit|expat|x11|mit x11|mit expat"),
    ("mit-0", r"mit 0|mit no attribution"),
    ("isc", r"isc|internet (?:systems|software) consortium"),
    ("zlib", r"zlib|zlib libpng|libpng"),
    ("bsl-1", r"boost(?: software)?|bsl 1(?: 0)?"),
    ("unlicense", r"unlicense|the unlicense"),
    ("wtfpl", r"wtfpl|do what the fuck you want to(?: public)?"),
    ("artistic-1", r"artistic(?: license)? 1(?: 0)?|perl artistic"),
    ("artistic-2", r"artistic(?: license)?(?: version)? 2(?: 0)?"),
    ("postgresql", r"postgresql|postgres"),
    ("python-2", r"python(?: software foundation)?(?: license)?(?: version)? 2(?: 0)?|psf(?: 2(?: 0)?)?"),
    ("ruby", r"ruby"),
    ("php-3", r"php(?: license)?(?: version)? 3(?: 0\d?)?"),
    ("openssl", r"openssl|ssleay"),
    ("ncsa", r"ncsa|university of illinois(?: ncsa)?(?: open source)?"),
    ("json", r"json"),
    ("beerware", r"beer ?ware"),
    ("cc0", r"cc0(?: 1 0)?|creative commons zero"),
    ("ofl-1.1", r"sil open font|ofl 1(?: 1)?|open font"),
    ("bsd-2", r"bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd"),
    ("bsd-3", r"bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd"),
    ("bsd-4", r"bsd 4 clause|4 clause bsd|original bsd"),
    ("bsd-0", r"0bsd|bsd zero clause|zero clause bsd"),
    ("bsd", r"bsd|berkeley software distribution"),
    ("apache-1.1", r"apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?|asl 2(?: 0)?"),
    ("apache", r"apache(?: software)?"),
    ("gpl-1", r"(?:gnu )?gpl(?: version| v)? ?1(?: 0)?|(?:gnu )?general public license(?: version| v)? ?1"),
    ("gpl-2", r"(?:gnu )?gpl ?v?(?: version)? ?2(?: 0)?|(?:gnu )?general public license(?: version| v)? ?2(?: 0)?"),
    ("gpl-3", r"(?:gnu )?gpl ?v?(?: version)? ?3(?: 0)?|(?:gnu )?general public license(?: version| v)? ?3(?: 0)?"),
    ("gpl", r"(?:gnu )?gpl|(?:gnu )?general public"),
    ("lgpl-2", r"(?:gnu )?lgpl ?v?(?: version)? ?2(?: 0)?|library general public license(?: version)? 2(?: 0)?"),
    ("lgpl-2.1", r"(?:gnu )?lgpl ?v?(?: version)? ?2 1|(?:lesser|library) general public license(?: version| v)? ?2 1"),
    ("lgpl-3", r"(?:gnu )?lgpl ?v?(?: version)? ?3(?: 0)?|lesser general public license(?: version| v)? ?3(?: 0)?"),
    ("lgpl", r"(?:gnu )?lgpl|(?:gnu )?(?:lesser|library) general public"),
    ("agpl-3", r"(?:gnu )?agpl ?v?(?: version)? ?3(?: 0)?|affero general public license(?: version| v)? ?3(?: 0)?"),
    ("agpl", r"(?:gnu )?agpl|(?:gnu )?affero(?: general public)?"),
    ("gfdl-1.3", r"(?:gnu )?(?:gfdl|fdl|free documentation license)(?: version| v)? ?1 3"),
    ("gfdl", r"(?:gnu )?(?:gfdl|fdl|free documentation)"),
    ("mpl-1.1", r"(?:mozilla public(?: license)?|mpl)(?: version| v)? ?1(?: 1| 0)"),
    ("mpl-2", r"(?:mozilla public(?: license)?|mpl)(?: version| v)? ?2(?: 0)?"),
    ("mpl", r"mozilla public|mpl"),
    ("epl-1", r"(?:eclipse public(?: license)?|epl)(?: version| v)? ?1(?: 0)?"),
    ("epl-2", r"(?:eclipse public(?: license)?|epl)(?: version| v)? ?2(?: 0)?"),
    ("epl", r"eclipse public|epl"),
    ("cddl-1", r"(?:cddl|common development and distribution(?: license)?)(?: version| v)? ?1(?: 0| 1)?"),
    ("cddl", r"cddl|common development and distribution"),
    ("cpl-1", r"common public(?: license)?(?: version)?(?: 1 0)?"),
    ("eupl-1.2", r"(?:eupl|european union public(?: license| licence)?)(?: version| v)? ?1 ?[12]?"),
    ("osl-3", r"open software license(?: version)?(?: 3 0)?|osl 3(?: 0)?"),
    ("afl-3", r"academic free(?: license)?(?: version)?(?: 3 0)?|afl 3(?: 0)?"),
    ("ms-pl", r"microsoft public|ms pl"),
    ("ms-rl", r"microsoft reciprocal|ms rl"),
    ("vim", r"vim"),
    ("zpl-2", r"zope public(?: license)?(?: version)?(?: 2 [01])?|zpl 2(?: [01])?"),
    ("upl-1", r"universal permissive|upl 1(?: 0)?"),
    ("odbl-1", r"open (?:data commons )?(?:database|odbl)|odbl(?: 1 0)?"),
    ("odc-by", r"open data commons attribution|odc by(?: 1 0)?"),
    ("pddl-1", r"public domain dedication and license|pddl(?: 1 0)?"),
    ("cecill-2", r"cecill(?: free software license)?(?: version| v)? ?2(?: [01])?|cecill"),
    ("elastic-2", r"elastic(?: license)?(?: version)? 2(?: 0)?"),
    ("sspl-1", r"server side public|sspl(?: 1)?"),
    ("bsl-1.1", r"business source(?: license)?(?: 1 1)?|busl 1 1|bsl 1 1"),
)

#: Names whose version follows the word license: (name, ((label, version), ...)).
VERSIONS = (
    (r"apache(?: software)?", (("apache-1.1", r"1 1"), ("apache-2", r"2(?: 0)?"))),
    (r"(?:gnu )?general public|gnu gpl|gpl", (("gpl-1", r"1(?: 0)?"), ("gpl-2", r"2(?: 0)?"), ("gpl-3", r"3(?: 0)?"))),
    (r"(?:gnu )?(?:lesser|library) general public|(?:gnu )?lgpl", (("lgpl-2", r"2(?: 0)?"), ("lgpl-2.1", r"2 1"), ("lgpl-3", r"3(?: 0)?"))),
    (r"(?:gnu )?affero general public|(?:gnu )?agpl", (("agpl-3", r"3(?: 0)?"),)),
    (r"(?:gnu )?free documentation", (("gfdl-1.2", r"1 2"), ("gfdl-1.3", r"1 3"))),
    (r"mozilla public", (("mpl-1.1", r"1 1"), ("mpl-2", r"2(?: 0)?"))),
    (r"eclipse public", (("epl-1", r"1(?: 0)?"), ("epl-2", r"2(?: 0)?"))),
    (r"european union public", (("eupl-1.1", r"1 1"), ("eupl-1.2", r"1 2"))),
    (r"artistic", (("artistic-1", r"1(?: 0)?"), ("artistic-2", r"2(?: 0)?"))),
    (r"boost software", (("bsl-1", r"1(?: 0)?"),)),
    (r"business source", (("bsl-1.1", r"1 1"),)),
    (r"zope public", (("zpl-2", r"2(?: [01])?"),)),
    (r"elastic", (("elastic-2", r"2(?: 0)?"),)),
)

#: Labels that name no license.
REMARKS = frozenset(("dual", "reference", "copyleft-other", "permissive-other", "proprietary", "non-commercial"))

#: What joins a further name to a detection.
CONJUNCTION = re.compile(rb" (?:and or|and|or|with)(?: alternatively)?(?: also)?(?: under)?(?: the)?(?: terms of the)?(?= )")

#: Creative Commons terms: (label, words after "cc" or "creative commons").
COMMONS = (
    ("cc-by-nc-nd", r"by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc-sa", r"by nc sa|attribution non ?commercial share ?alike"),
    ("cc-by-nc", r"by nc|attribution non ?commercial"),
    ("cc-by-nd", r"by nd|attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-sa", r"by sa|attribution share ?alike"),
    ("cc-by", r"by|attribution"),
)

#: Where a family's name makes a notice: one pattern around NAME.
NOTICE = (
    r"(?:licensed|released|distributed|available|provided|published|covered|redistributed|offered) (?:(?:to you )?under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:NAME)(?: licen[sc]e)?(?: version \d(?: \d)?)?"
    r"|(?:under|subject to|according to|pursuant to|permitted by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:NAME) licen[sc]e"
    r"|licen[sc]es? (?:type |is |id |name )?(?:the )?(?:NAME)(?: licen[sc]e)?"
    r"|(?:the )?(?:NAME) licen[sc]e(?: version \d(?: \d)?)?"
    r"|spdx license identifier (?:NAME)(?: only| or later)?"
)

#: Hand-written signatures: (label, priority, pattern), the grants, conditions, disclaimers, headers and identifiers of licenses and of general notices.
SIGNATURES = (
    # MIT and its relatives
    ("mit", 1, r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?"),
    ("mit", 1, r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish"),
    ("mit", 2, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 2, r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", 2, r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", 2, r"opensource org licenses mit(?: license)?"),
    ("mit", 3, r"mit style licen[sc]e|mit licensed|licensed mit|mit x11 style"),
    ("mit", 1, r"spdx license identifier mit"),
    ("mit-0", 1, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction .{0,200}?furnished to do so the software is provided"),
    ("mit-0", 1, r"spdx license identifier mit 0"),
    ("mit-advertising", 1, r"except as contained in this notice the names? of .{0,100}? shall not be used in advertising or otherwise to promote the sale"),
    ("x11", 2, r"x11 is a trademark of|x window system is a trademark of"),
    ("isc", 1, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 1, r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("isc", 2, r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("isc", 2, r"in no event shall the author be liable for any special direct indirect or consequential damages"),
    ("isc", 1, r"spdx license identifier isc"),
    ("0bsd", 1, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("ntp", 1, r"permission to use copy modify and distribute this software and its documentation for any purpose .{0,40}?fee is hereby granted"),
    ("ntp", 2, r"makes no representations about the suitability (?:of )?this software for any purpose"),
    ("hpnd", 2, r"historical permission notice and disclaimer"),
    # BSD
    ("bsd", 2, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 3, r"redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", 3, r"redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd", 3, r"this software is provided by the (?:copyright holders and contributors|author|authors|regents and contributors) as is and any express or implied warranties"),
    ("bsd", 3, r"procurement of substitute goods or services loss of use data or profits or business interruption"),
    ("bsd-3", 2, r"neither the names? of .{0,120}? may be used to endorse or promote products"),
    ("bsd-3", 2, r"the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-3", 1, r"opensource org licenses bsd 3 clause"),
    ("bsd-3", 1, r"spdx license identifier bsd 3 clause"),
    ("bsd-2", 1, r"opensource org licenses bsd 2 clause"),
    ("bsd-2", 1, r"spdx license identifier bsd 2 clause"),
    ("bsd-2", 2, r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-4", 1, r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-4", 2, r"this product includes software developed by the university of california berkeley"),
    ("bsd-clear", 1, r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-patent", 1, r"bsd 2 clause plus patent|bsd plus patent"),
    ("bsd", 3, r"bsd style licen[sc]e|bsd licensed|use of this source code is governed by a bsd style"),
    # Apache
    ("apache-2", 1, r"www apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2", 1, r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", 2, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", 1, r"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2", 2, r"you must give any other recipients of the work or derivative works a copy of this license"),
    ("apache-2", 2, r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2", 2, r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", 1, r"spdx license identifier apache 2 0"),
    ("apache-2", 3, r"apache 2 0 licensed|apache v2 licen[sc]e|alv2"),
    ("apache-1.1", 1, r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", 2, r"products derived from this software may not be called apache nor may apache appear in their name"),
    ("apache-1.0", 2, r"this product includes software developed by the apache group for use in the apache http server project"),
    # GPL family
    ("gpl", 3, r"you can redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?"),
    ("gpl-2", 2, r"under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2", 2, r"under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("gpl-3", 2, r"under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", 2, r"under the terms of the gnu general public license version 3 (?:only )?as published by the free software foundation"),
    ("gpl-2", 1, r"gnu general public license version 2 june 1991"),
    ("gpl-3", 1, r"gnu general public license version 3 29 june 2007"),
    ("gpl-1", 1, r"gnu general public license version 1 february 1989"),
    ("gpl", 3, r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl", 3, r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", 2, r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2", 2, r"you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program"),
    ("gpl-3", 2, r"you may convey a covered work in object code form under the terms of sections 4 and 5"),
    ("gpl-3", 2, r"no covered work shall be deemed part of an effective technological measure"),
    ("gpl-2", 1, r"spdx license identifier gpl 2 0(?: only| or later)?"),
    ("gpl-3", 1, r"spdx license identifier gpl 3 0(?: only| or later)?"),
    ("gpl-1", 1, r"spdx license identifier gpl 1 0(?: only| or later)?"),
    ("gpl-2", 3, r"gplv2(?: or later)?|gpl v2"),
    ("gpl-3", 3, r"gplv3(?: or later)?|gpl v3"),
    ("gpl-3", 2, r"www gnu org licenses gpl 3 0"),
    ("gpl-2", 2, r"www gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl", 4, r"www gnu org (?:licenses gpl|copyleft gpl)"),
    ("gpl-classpath", 1, r"classpath exception|linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-autoconf", 1, r"autoconf (?:configure script )?exception|contains a configuration script generated by autoconf"),
    ("gpl-gcc", 1, r"gcc runtime library exception"),
    ("gpl-bison", 1, r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-font", 2, r"gpl font exception|if you create a document which uses this font and embed this font"),
    ("lgpl", 2, r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", 1, r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2", 1, r"gnu library general public license version 2 june 1991"),
    ("lgpl-3", 1, r"gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-2.1", 1, r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", 1, r"gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl", 2, r"you should have received a copy of the gnu (?:lesser|library) general public license along with this"),
    ("lgpl", 2, r"a program that contains no derivative of any portion of the library but is designed to work with the library"),
    ("lgpl-2.1", 1, r"spdx license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-2", 1, r"spdx license identifier lgpl 2 0(?: only| or later)?"),
    ("lgpl-3", 1, r"spdx license identifier lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", 3, r"lgplv2 1|lgpl v2 1"),
    ("lgpl-3", 3, r"lgplv3|lgpl v3"),
    ("agpl", 2, r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3", 1, r"gnu affero general public license version 3 19 november 2007"),
    ("agpl-3", 2, r"if you modify the program your modified version must prominently offer all users interacting with it remotely"),
    ("agpl-3", 1, r"spdx license identifier agpl 3 0(?: only| or later)?"),
    ("agpl-3", 3, r"agplv3|agpl v3"),
    ("gfdl", 2, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 2, r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl-1.3", 1, r"gnu free documentation license version 1 3"),
    ("gfdl-1.2", 1, r"gnu free documentation license version 1 2"),
    # weak copyleft
    ("mpl-2", 1, r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 1, r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2", 2, r"mozilla org mpl 2 0"),
    ("mpl-2", 2, r"incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-2", 1, r"spdx license identifier mpl 2 0"),
    ("mpl-1.1", 1, r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", 2, r"alternatively the contents of this file may be used under the terms of either the gnu general public license version 2"),
    ("mpl-1.0", 1, r"the contents of this file are subject to the mozilla public license version 1 0"),
    ("npl-1.1", 1, r"the contents of this file are subject to the netscape public license version 1 1"),
    ("epl-2", 1, r"this program and the accompanying materials are made available under the terms of the eclipse public license v? ?2 0"),
    ("epl-1", 1, r"this program and the accompanying materials are made available under the terms of the eclipse public license v? ?1 0"),
    ("epl-2", 1, r"spdx license identifier epl 2 0"),
    ("epl-1", 1, r"spdx license identifier epl 1 0"),
    ("epl-2", 2, r"eclipse org legal epl 2 0"),
    ("epl-1", 2, r"eclipse org legal epl v10"),
    ("edl-1", 2, r"eclipse distribution license v? ?1 0"),
    ("cpl-1", 1, r"the accompanying program is provided under the terms of this common public license"),
    ("ipl-1", 1, r"the accompanying program is provided under the terms of this ibm public license"),
    ("cddl-1", 1, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1", 1, r"spdx license identifier cddl 1 0"),
    ("cddl-1.1", 1, r"spdx license identifier cddl 1 1"),
    ("eupl-1.2", 1, r"licensed under the eupl (?:version )?1 2"),
    ("eupl-1.1", 1, r"licensed under the eupl (?:version )?1 1"),
    ("eupl", 2, r"licence for the european union public licence|european union public licence"),
    ("osl-3", 1, r"licensed under the open software license version 3 0"),
    ("afl-3", 1, r"licensed under the academic free license version 3 0"),
    ("ms-pl", 1, r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", 1, r"for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code"),
    ("artistic-1", 1, r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", 1, r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", 2, r"(?:under|on) the same terms as perl itself"),
    ("qpl-1", 1, r"the q public license version 1 0"),
    ("sissl", 1, r"sun industry standards source license"),
    ("apsl-2", 1, r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("cecill-2", 1, r"this software is governed by the cecill licen[sc]e under french law"),
    ("cecill-b", 1, r"this software is governed by the cecill b licen[sc]e under french law"),
    ("cecill-c", 1, r"this software is governed by the cecill c licen[sc]e under french law"),
    # permissive, others
    ("zlib", 1, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 1, r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("zlib", 2, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("zlib", 1, r"spdx license identifier zlib"),
    ("bsl-1", 1, r"www boost org license 1 0(?: txt)?"),
    ("bsl-1", 1, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1", 1, r"distributed under the boost software license version 1 0"),
    ("bsl-1", 1, r"spdx license identifier bsl 1 0"),
    ("unlicense", 1, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 1, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", 2, r"unlicense org"),
    ("wtfpl", 1, r"do what the fuck you want to public license"),
    ("wtfpl", 1, r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("cc0", 1, r"creativecommons org publicdomain zero 1 0"),
    ("cc0", 1, r"to the extent possible under law .{0,80}? has waived all copyright and related or neighboring rights"),
    ("cc0", 1, r"spdx license identifier cc0 1 0"),
    ("cc-pdm", 1, r"creativecommons org publicdomain mark 1 0"),
    ("cc", 4, r"some rights reserved|creative commons licen[sc]e"),
    ("postgresql", 1, r"in no event shall the university of california be liable to any party for direct indirect special incidental"),
    ("postgresql", 2, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("python-2", 1, r"psf is making python available to licensee on an as is basis"),
    ("python-2", 1, r"this license agreement is between the python software foundation"),
    ("php-3", 1, r"this source file is subject to version 3 0?1? ?of the php license"),
    ("php-3", 2, r"this product includes php software freely available from"),
    ("openssl", 1, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 1, r"this product includes cryptographic software written by eric young"),
    ("ncsa", 1, r"permission is hereby granted free of charge .{0,160}?to deal with the software without restriction"),
    ("json", 1, r"the software shall be used for good not evil"),
    ("beerware", 1, r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("curl", 1, r"curl and libcurl are licensed under|copyright and permission notice copyright c .{0,40}?daniel stenberg"),
    ("libtiff", 1, r"the names of sam leffler and silicon graphics may not be used in any advertising"),
    ("ijg", 1, r"this software is based in part on the work of the independent jpeg group"),
    ("libpng", 1, r"the png reference library is supplied as is"),
    ("icu", 1, r"icu license icu 1 8 1 and later"),
    ("unicode", 1, r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("w3c", 1, r"w3c software (?:and document )?notice and license"),
    ("w3c", 2, r"pre existing intellectual property disclaimers notices or terms and conditions"),
    ("ofl-1.1", 1, r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", 1, r"the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself"),
    ("ofl-1.1", 2, r"scripts sil org ofl"),
    ("bitstream-vera", 1, r"bitstream vera is a trademark of bitstream inc"),
    ("zpl-2", 1, r"zope public license zpl version 2"),
    ("upl-1", 1, r"the universal permissive license upl version 1 0"),
    ("vim", 1, r"vim is charityware"),
    ("ruby", 1, r"you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices"),
    ("tcl", 1, r"this software is copyrighted by the regents of the university of california sun microsystems"),
    ("blueoak-1", 1, r"blue oak model license"),
    ("mulan-2", 1, r"mulan psl v2|mulan permissive software license version 2"),
    ("ecl-2", 1, r"educational community license version 2 0"),
    ("naist", 1, r"nara institute of science and technology"),
    # data
    ("odbl-1", 1, r"this .{0,60}?is made available under the open database license"),
    ("odbl-1", 2, r"opendatacommons org licenses odbl"),
    ("odc-by", 1, r"opendatacommons org licenses by"),
    ("pddl-1", 1, r"opendatacommons org licenses pddl"),
    ("ogl-3", 1, r"contains public sector information licensed under the open government licence v? ?3 0"),
    ("ogl", 2, r"open government licen[sc]e"),
    ("cdla-permissive", 1, r"community data license agreement permissive"),
    ("cdla-sharing", 1, r"community data license agreement sharing"),
    ("etalab-2", 1, r"licence ouverte(?: open licence)?(?: version 2 0)?"),
    # models and source-available
    ("openrail", 1, r"creativeml open rail ?m|bigscience (?:bloom )?rail|open rail licen[sc]e"),
    ("sspl-1", 1, r"server side public license version 1"),
    ("sspl-1", 2, r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2", 1, r"you may not provide the software to third parties as a hosted or managed service"),
    ("elastic-2", 1, r"spdx license identifier elastic 2 0"),
    ("bsl-1.1", 1, r"business source license 1 1|the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("bsl-1.1", 2, r"change date .{0,40}?change license"),
    ("commons-clause", 1, r"commons clause license condition|the license does not grant to you the right to sell the software"),
    ("polyform-nc", 1, r"polyform noncommercial license"),
    ("polyform-sb", 1, r"polyform small business license"),
    ("prosperity", 2, r"prosperity public license"),
    ("parity", 2, r"parity public license"),
    ("fsl", 1, r"functional source license"),
    # general notices
    ("public-domain", 3, r"(?:released|placed|dedicated|donated|put) (?:in|into|to) the public domain"),
    ("public-domain", 4, r"(?:is|are) in the public domain"),
    ("public-domain", 3, r"this work (?:was|is) (?:prepared|produced) by (?:an officer or employee|employees) of the united states government"),
    ("proprietary", 3, r"all rights reserved"),
    ("proprietary", 3, r"confidential and proprietary|proprietary and confidential|proprietary licen[sc]e"),
    ("proprietary", 2, r"unauthorized (?:copying|reproduction|distribution|use) of this (?:file|software|material|document|work)"),
    ("proprietary", 2, r"no part of this (?:publication|book|document|work) may be reproduced"),
    ("proprietary", 3, r"may not be (?:reproduced|copied|redistributed|published) without (?:the )?(?:prior )?(?:written|express) (?:written )?(?:permission|consent)"),
    ("proprietary", 3, r"this (?:software|product) is licensed not sold"),
    ("proprietary", 3, r"end user licen[sc]e agreement"),
    ("non-commercial", 3, r"for (?:personal|private|educational|research|academic) (?:and )?non ?commercial use only"),
    ("non-commercial", 3, r"non ?commercial use only|no commercial use"),
    ("permissive-other", 4, r"permission is granted to (?:copy|use|distribute|reproduce)"),
    ("permissive-other", 4, r"may be (?:freely|copied and) (?:distributed|redistributed|used|copied)"),
    ("copyleft-other", 5, r"copyleft licen[sc]e"),
    ("dual", 4, r"dual licensed under|available under (?:either of )?two licenses|at your option either"),
    ("reference", 5, r"see (?:the )?(?:license|licence|copying|copyright) (?:file|txt|md)(?: for (?:details|more|the full))?"),
    ("reference", 5, r"license that can be found in the license file"),
)


@dataclass(frozen=True)
class Rule:
    """A signature: the regex must match whole words of the normalised text."""

    name: str
    label: str
    priority: int
    needs: tuple[tuple[bytes, ...], ...]
    pattern: re.Pattern

    @property
    def remark(self) -> bool:
        return self.label in REMARKS


def needs(pattern: bytes) -> tuple[tuple[bytes, ...], ...]:
    """What every match of a regex requires: of each tuple, one literal at least is in the text (or beside the match, where an assertion says so)."""

    def of(nodes) -> list[tuple[bytes, ...]]:
        found, run = [], bytearray()

        def ended() -> None:
            if run:
                found.append((bytes(run),))
            run.clear()

        for op, arg in nodes:
            if op is parts.LITERAL:
                run.append(arg)
                continue
            behind, before = op is parts.ASSERT and arg[0] < 0, bytes(run)
            if op is not parts.ASSERT or behind:
                ended()
            if op is parts.ASSERT and all(x is parts.LITERAL for x, _ in arg[1]):
                run.extend(x for _, x in arg[1])
            if op is parts.ASSERT and not behind:
                ended()
            if op is parts.SUBPATTERN:
                found += of(arg[-1])
            elif op in (parts.MAX_REPEAT, parts.MIN_REPEAT) and arg[0] > 0:
                found += of(arg[2])
            elif op is parts.BRANCH:
                each = [of([*((parts.LITERAL, x) for x in before), *alternative]) for alternative in arg[1]]
                if all(each):
                    words = {w for x in each for w in max(x, key=lambda c: (min(map(len, c)), -len(c)))}
                    found.append(tuple(sorted(w for w in words if not any(v in w for v in words - {w}))))
        ended()
        return found

    return tuple(n for n in dict.fromkeys(of(parts.parse(pattern))) if min(map(len, n)) > 2)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority."""
    out = []

    def add(name: str, label: str, priority: int, pattern: str) -> None:
        whole = rb"(?<= )(?:" + pattern.encode() + rb")(?= )"
        out.append(Rule(name, label, priority, needs(whole), re.compile(whole)))

    for label, names in FAMILIES:
        add(f"{label}:notice", label, 4, NOTICE.replace("NAME", names))
    for name, versions in VERSIONS:
        for label, version in versions:
            add(f"{label}:version", label, 3, rf"(?:the )?(?:{name}) licen[sc]e(?: version| v)? ?{version}")
    for label, terms in COMMONS:
        add(f"{label}:name", label, 2, rf"(?:cc|creative commons) (?:{terms})(?: licen[sc]e)?(?: international| unported)?(?: [1-4] \d)?(?: international| unported)?")
        add(f"{label}:url", label, 1, rf"creativecommons org licenses (?:{terms.split('|')[0]}) [1-4] \d")
    for n, (label, priority, pattern) in enumerate(SIGNATURES):
        add(f"{label}:{n}", label, priority, pattern)
    return tuple(sorted(out, key=lambda r: r.priority))


@lru_cache(maxsize=1)
def conjuncts() -> tuple[Rule, ...]:
    """Names alone, as they follow a conjunction; they are tried there only, so they have no gate."""
    out = []
    for label, names in FAMILIES:
        out.append(Rule(f"{label}:conjunct", label, 4, (), re.compile(rb"(?<= )(?:" + names.encode() + rb")(?: licen[sc]e)?(?: only| or later)?(?= )")))
    for name, versions in VERSIONS:
        for label, version in versions:
            out.append(Rule(f"{label}:conjunct-version", label, 4, (), re.compile(rf"(?<= )(?:{name}) licen[sc]e(?: version| v)? ?{version}(?: only| or later)?(?= )".encode())))
    return tuple(out)


@lru_cache(maxsize=1)
def gates() -> dict[tuple[bytes, ...], list[tuple[int, Rule]]]:
    """(order, rule) by the most common need that those of the rule imply; a text that meets none of these matches no rule."""
    shared = Counter(need for rule in rules() for need in rule.needs)
    implied = {n: max((g for g in shared if all(any(v in w for v in g) for w in n)), key=lambda g: shared[g]) for n in shared}
    out: dict[tuple[bytes, ...], list[tuple[int, Rule]]] = {}
    for order, rule in enumerate(rules()):
        out.setdefault(max((implied[n] for n in rule.needs), key=lambda g: shared[g]), []).append((order, rule))
    return out


def _met(norm: bytes) -> Iterator[tuple[int, Rule]]:
    """(order, rule) of the rules whose needs a text meets."""
    known: dict[tuple[bytes, ...], bool] = {}

    def holds(need: tuple[bytes, ...]) -> bool:
        if need not in known:
            known[need] = any(w in norm for w in need)
        return known[need]

    for need, gated in gates().items():
        if holds(need):
            yield from (x for x in gated if all(map(holds, x[1].needs)))


def matches(norm: bytes, *, gated: bool = True) -> list[tuple[int, int, int, int, Rule]]:
    """(start, end, priority, order, rule) of all that rules match, and of names that conjunctions add to licenses, before suppression."""
    tried = _met(norm) if gated else enumerate(rules())
    found = [(m.start(), m.end(), rule.priority, order, rule) for order, rule in tried for m in rule.pattern.finditer(norm)]
    ends = [x[1] for x in found if not x[4].remark]
    seen = set()
    while ends:
        end = ends.pop()
        joined = CONJUNCTION.match(norm, end) if end not in seen else None
        seen.add(end)
        if joined:
            at = joined.end() + 1
            for order, rule in enumerate(conjuncts(), len(rules())):
                if m := rule.pattern.match(norm, at):
                    found.append((at, m.end(), rule.priority, order, rule))
                    ends.append(m.end())
    return found


def _widest(found: list) -> list:
    """Those that lie within no other; of equal intervals the first by priority and order."""
    out, longest = [], -1
    for x in sorted(found, key=lambda x: (x[0], -x[1], x[2], x[3])):
        if x[1] > longest:
            out.append(x)
            longest = x[1]
    return out


def suppressed(found: list) -> list:
    """What stays of matches, by start: see the rule above."""
    kept: list = []  # by start; they do not overlap

    def free(x) -> bool:
        at = bisect_left(kept, x[0], key=lambda k: k[0])
        return not (at and kept[at - 1][1] > x[0]) and not (at < len(kept) and kept[at][0] < x[1])

    while found:
        for x in sorted(_widest(found), key=lambda x: (x[2], x[0])):
            if free(x):
                insort(kept, x, key=lambda k: k[:4])
        found = [x for x in found if free(x)]
    return kept


def detections(norm: bytes, *, gated: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, label, rule) of what stays after suppression, by start; ``norm`` is a normalised text.

    The gate skips rules that cannot match, and changes nothing else.
    """
    found = matches(norm, gated=gated)
    kept = [x for remark in (False, True) for x in suppressed([y for y in found if y[4].remark == remark])]
    return sorted((a, b, rule.label, rule.name) for a, b, _, _, rule in kept)


def _base(norm: bytes) -> list[tuple[int, str]]:
    """(start, label) of all places of base phrases, overlapping ones too."""
    out = []
    for phrase, label in BASE.items():
        key, at = f" {phrase} ".encode(), -1
        while (at := norm.find(key, at + 1)) >= 0:
            out.append((at + 1, label))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            words = text.encode().lower().translate(_TO_SPACE).split() if text else []
            norm = b" " + b" ".join(words) + b" "
            base, more = _base(norm), detections(norm)
            spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32) if base or more else None
            word = lambda at: int(np.searchsorted(spaces, at)) - 1  # noqa: B023, E731
            places = [word(at) for at, _ in base]
            labels = {x for _, x in base}
            every = labels | {x[2] for x in more}
            # certainty of the best evidence, and how much there is of it
            score = 1 - 0.5 ** (2 * len(base) + len(more)) if every else 0.0
            spans = [{"label": label, "first_word": word(a), "n_words": word(b) - word(a) + 1, "rule": name} for a, b, label, name in more]
            rows.append((len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, spans))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("rule", pa.string())]))]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License labels of every whole text, with base phrases and signature rules.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (their smallest and largest first word, from 0), base_labels and
    labels (distinct, sorted, comma-joined; labels has those of rules too),
    score (0 to 1, more with more evidence) and detections (of rules). Labels of
    REMARKS name no license: they state a general notice.

    Edge cases: null is an empty text, with no words and no labels. Overlapping
    places of base phrases count each. Of equal intervals, the rule that comes
    first stays. Repeated rows and null doc_ids give a row each; an empty table
    gives none. Other columns are ignored. No shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, SCANNED)
