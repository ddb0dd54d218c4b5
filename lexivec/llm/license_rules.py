"""Signature rules of licenses, written by hand, in order of priority.

A rule is a label, a regular expression over a text's words (lower-cased letters and
digits, one blank between words) and a weight. $1 in a label is what the expression's
group has found, blanks as dots. Its keywords are derived from it, unless they are given.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: Licenses' own texts, then notices, then tags and addresses, then names with a version, then names alone, then other claims.
TABLE = (
    # texts
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.9),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", 1.0),
    ("x11", "except as contained in this notice the names? of (?:[^ ]+ ){1,8}shall not be used in advertising or otherwise to promote the sale", 1.0),
    ("json", "the software shall be used for good not evil", 1.0),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1.0),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that", 1.0),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software", 1.0),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted provided", 1.0),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions", 0.8),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions", 0.8),
    ("bsd-3-clause", "neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|their|the) contributors may be used to endorse or promote products", 1.0),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license", 1.0),
    ("bsd-patent", "subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license", 1.0),
    ("apache-2.0", "apache license version 2 0 january 2004", 1.0),
    ("apache-2.0", "terms and conditions for use reproduction and distribution 1 definitions license shall mean", 1.0),
    ("apache-1.1", "this product includes software developed by the apache software foundation", 0.9),
    ("apache-1.0", "this product includes software developed by the apache group for use in the apache http server project", 1.0),
    ("gpl-1", "gnu general public license version 1 february 1989", 1.0),
    ("gpl-2", "gnu general public license version 2 june 1991", 1.0),
    ("gpl-3", "gnu general public license version 3 29 june 2007", 1.0),
    ("lgpl-2", "gnu library general public license version 2 june 1991", 1.0),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", 1.0),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007", 1.0),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007", 1.0),
    ("gpl-2", "the licenses for most software are designed to take away your freedom to share and change it", 1.0),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works", 1.0),
    ("agpl-3", "the gnu affero general public license is a free copyleft license for software and other kinds of works", 1.0),
    ("agpl-3", "an opportunity to receive the corresponding source of your version by providing access to the corresponding source from a network server", 1.0),
    ("lgpl-3", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", 1.0),
    ("lgpl", "the modified work must itself be a software library", 0.9),
    ("fdl", "the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom", 1.0),
    ("mpl-1.1", "mozilla public license version 1 1 1 definitions", 1.0),
    ("mpl-2.0", "mozilla public license version 2 0 1 definitions", 1.0),
    ("epl-1.0", "the accompanying program is provided under the terms of this eclipse public license agreement", 1.0),
    ("epl-2.0", "the accompanying program is provided under the terms of this eclipse public license v 2 0", 1.0),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license agreement", 1.0),
    ("ipl-1.0", "the accompanying program is provided under the terms of this ibm public license agreement", 1.0),
    ("cddl", "common development and distribution license cddl version (?:1 0|1 1) 1 definitions", 1.0),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied", 1.0),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 1.0),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1.0),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1.0),
    ("libpng", "the png reference library is supplied as is", 1.0),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 1.0),
    ("wtfpl", "you just do what the fuck you want to", 1.0),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", 1.0),
    ("ofl-1.1", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects", 1.0),
    ("python-2.0", "this license agreement is between the python software foundation psf and the individual or organization", 1.0),
    ("php", "this product includes php software freely available from", 1.0),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("ssleay", "this product includes cryptographic software written by eric young", 1.0),
    ("ijg", "this software is based in part on the work of the independent jpeg group", 1.0),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 1.0),
    ("vim", "there are no restrictions on distributing unmodified copies of vim except that they must include this license text", 1.0),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices", 1.0),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code for the db software", 1.0),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 1.0),
    ("w3c", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms", 1.0),
    ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service", 1.0),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 1.0),
    ("commons-clause", "the license does not grant to you the right to sell the software", 1.0),
    ("upl-1.0", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data", 1.0),
    ("blueoak-1.0.0", "everyone who gets a copy of any part of this software from you with or without changes also gets the text of this license", 1.0),
    ("cc0-1.0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright", 1.0),
    ("cc0-1.0", "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights", 1.0),
    ("cc-by", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution", 1.0),
    ("cc", "creative commons corporation is not a law firm and does not provide legal services", 0.9),
    ("odbl-1.0", "the open database license odbl is a license agreement intended to allow users to freely share modify and use this database", 1.0),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", 1.0),
    ("license-text", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.8),
    # notices
    ("gpl-$1", "(?:this|the) program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version ([123])(?: of the license or at your option any later version)?", 1.0),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.9),
    ("lgpl-$1", "free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation (?:either )?version (2 1|2|3)", 1.0),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 0.9),
    ("agpl-3", "free software you can redistribute it and or modify it under the terms of the gnu affero general public license", 1.0),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", 0.9),
    ("lgpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license", 0.9),
    ("gpl", "you should have received a copy of the gnu general public license along with", 0.9, (" gnu general public license along ",)),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with", 0.9, (" general public license along ",)),
    ("agpl", "you should have received a copy of the gnu affero general public license along with", 0.9, (" gnu affero general public license along ",)),
    ("gpl-exception", "as a special exception the copyright holders? (?:of this library )?gives? (?:you )?permission to link", 0.9),
    ("gpl-classpath", "(?:gpl|gnu general public license)(?: v2| version 2| 2 0)? with(?: the)? classpath exception", 1.0),
    ("gpl-exception", "gcc runtime library exception", 0.9),
    ("apache-2.0", "licensed under the apache license version 2 0", 1.0),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", 0.8),
    ("apache-2.0", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", 0.8),
    ("apache", "licensed to the apache software foundation asf under one or more contributor license agreements", 1.0),
    ("apache-2.0", "this file is licensed to you under the apache license", 0.9),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", 1.0),
    ("mpl-$1", "the contents of this file are subject to the mozilla public license version (1 0|1 1|2 0)", 1.0),
    ("mpl-exception", "this source code form is incompatible with secondary licenses", 1.0),
    ("npl", "the contents of this file are subject to the netscape public license", 1.0),
    ("apsl", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license", 1.0),
    ("epl-$1", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: version)?(?: v ?| )(1 0|2 0)", 1.0),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", 0.9),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", 1.0),
    ("fdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public license", 1.0),
    ("artistic", "this (?:program|library|module) is free software you can redistribute it and or modify it under the same terms as perl itself", 1.0),
    ("artistic-2.0", "under the terms of the artistic license version 2 0", 1.0),
    ("bsd", "use of this source code is governed by a bsd style license", 0.9),
    ("mit", "use of this source code is governed by an mit style license", 0.9),
    ("mit", "(?:licensed|released|distributed|available|published|covered) under the(?: terms of the)? mit license", 1.0, (" mit license ",)),
    ("mit", "(?:licensed|released|distributed|available|published|covered) under(?: the)?(?: terms of the)? mit", 0.9, (" under mit ", " the mit ")),
    ("bsd", "(?:licensed|released|distributed|available|published|covered) under (?:the|a)(?: terms of the)? bsd license", 1.0, (" bsd license ",)),
    ("gpl-$1", "(?:licensed|released|distributed|available|published|covered) under the(?: terms of the)? (?:gnu )?(?:general public license|gpl)(?: version)?(?: v ?| )?([123])", 1.0, ("general public license", " gpl")),
    ("gpl", "(?:licensed|released|distributed|available|published|covered) under the(?: terms of the)? (?:gnu )?(?:general public license|gpl)", 0.9, ("general public license ", " gpl ")),
    ("lgpl", "(?:licensed|released|distributed|available|published|covered) under the(?: terms of the)? (?:gnu )?(?:lesser general public license|lgpl)", 0.9, ("lesser general public license ", " lgpl ")),
    ("agpl", "(?:licensed|released|distributed|available|published|covered) under the(?: terms of the)? (?:gnu )?(?:affero general public license|agpl)", 0.9, ("affero general public license ", " agpl ")),
    ("cc", "(?:licensed|released|distributed|available|published|covered) under (?:a|the)(?: terms of the)? creative commons", 0.8, (" creative commons ",)),
    ("dual", "dual licensed under", 0.5),
    # tags and addresses
    ("gpl-$1", "spdx license identifier gpl ([123]) 0(?: only| or later)?", 1.0),
    ("lgpl-$1", "spdx license identifier lgpl (2 0|2 1|3 0)(?: only| or later)?", 1.0),
    ("agpl-$1", "spdx license identifier agpl ([13]) 0(?: only| or later)?", 1.0),
    ("apache-$1", "spdx license identifier apache (1 0|1 1|2 0)", 1.0),
    ("mit", "spdx license identifier mit", 1.0),
    ("mit-0", "spdx license identifier mit 0", 1.0),
    ("bsd-$1-clause", "spdx license identifier bsd ([1234]) clause", 1.0),
    ("0bsd", "spdx license identifier 0bsd", 1.0),
    ("isc", "spdx license identifier isc", 1.0),
    ("mpl-$1", "spdx license identifier mpl (1 0|1 1|2 0)", 1.0),
    ("epl-$1", "spdx license identifier epl (1 0|2 0)", 1.0),
    ("cddl-$1", "spdx license identifier cddl (1 0|1 1)", 1.0),
    ("eupl-$1", "spdx license identifier eupl (1 0|1 1|1 2)", 1.0),
    ("cc0-1.0", "spdx license identifier cc0 1 0", 1.0),
    ("cc-by-$1", "spdx license identifier cc by (1 0|2 0|2 5|3 0|4 0)", 1.0),
    ("cc-by-sa-$1", "spdx license identifier cc by sa (1 0|2 0|2 5|3 0|4 0)", 1.0),
    ("cc-by-nc-$1", "spdx license identifier cc by nc (1 0|2 0|2 5|3 0|4 0)", 1.0),
    ("cc-by-nd-$1", "spdx license identifier cc by nd (1 0|2 0|2 5|3 0|4 0)", 1.0),
    ("cc-by-nc-sa-$1", "spdx license identifier cc by nc sa (1 0|2 0|2 5|3 0|4 0)", 1.0),
    ("cc-by-nc-nd-$1", "spdx license identifier cc by nc nd (1 0|2 0|2 5|3 0|4 0)", 1.0),
    ("unlicense", "spdx license identifier unlicense", 1.0),
    ("wtfpl", "spdx license identifier wtfpl", 1.0),
    ("zlib", "spdx license identifier zlib", 1.0),
    ("boost-1.0", "spdx license identifier bsl 1 0", 1.0),
    ("ofl-$1", "spdx license identifier ofl (1 0|1 1)", 1.0),
    ("artistic-$1", "spdx license identifier artistic (1 0|2 0)", 1.0),
    ("busl-1.1", "spdx license identifier busl 1 1", 1.0),
    ("sspl-1.0", "spdx license identifier sspl 1 0", 1.0),
    ("elastic-2.0", "spdx license identifier elastic 2 0", 1.0),
    ("apache-2.0", "apache org licenses license 2 0", 1.0),
    ("gpl", "gnu org licenses(?: old licenses)? gpl", 0.9),
    ("lgpl", "gnu org licenses(?: old licenses)? lgpl", 0.9),
    ("agpl", "gnu org licenses agpl", 0.9),
    ("fdl", "gnu org licenses fdl", 0.9),
    ("mpl-2.0", "mozilla org mpl 2 0", 1.0),
    ("epl", "eclipse org legal epl", 0.9),
    ("mit", "opensource org licenses mit", 1.0),
    ("bsd", "opensource org licenses bsd", 0.9),
    ("boost-1.0", "boost org license 1 0 txt", 1.0),
    ("ofl", "scripts sil org ofl", 0.9),
    ("cc-by-$1", "creativecommons org licenses by (1 0|2 0|2 5|3 0|4 0)", 1.0),
    ("cc-by-sa-$1", "creativecommons org licenses by sa (1 0|2 0|2 5|3 0|4 0)", 1.0),
    ("cc-by-nc-$1", "creativecommons org licenses by nc (1 0|2 0|2 5|3 0|4 0)", 1.0),
    ("cc-by-nd-$1", "creativecommons org licenses by nd (1 0|2 0|2 5|3 0|4 0)", 1.0),
    ("cc-by-nc-sa-$1", "creativecommons org licenses by nc sa (1 0|2 0|2 5|3 0|4 0)", 1.0),
    ("cc-by-nc-nd-$1", "creativecommons org licenses by nc nd (1 0|2 0|2 5|3 0|4 0)", 1.0),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", 1.0),
    ("public-domain", "creativecommons org publicdomain mark 1 0", 1.0),
    # names with a version
    ("gpl-$1", "(?:gnu )?general public license(?: gpl)?(?: version)?(?: v ?| )([123])(?: 0)?(?: only| or later| or any later version)?", 0.9),
    ("gpl-$1", "(?:gnu )?gpl(?: version)?(?: v ?| )([123])(?: 0)?(?: only| or later)?", 0.9),
    ("gpl-$1", "(?:gnu )?gplv([123])(?: 0)?", 0.9),
    ("lgpl-$1", "(?:gnu )?(?:lesser|library) general public license(?: lgpl)?(?: version)?(?: v ?| )(2 1|2|3)(?: 0)?(?: only| or later)?", 0.9),
    ("lgpl-$1", "(?:gnu )?lgpl(?: version)?(?: v ?| )(2 1|2|3)(?: 0)?(?: only| or later)?", 0.9),
    ("lgpl-$1", "(?:gnu )?lgplv(2 1|2|3)", 0.9),
    ("agpl-$1", "(?:gnu )?affero general public license(?: agpl)?(?: version)?(?: v ?| )([13])(?: 0)?(?: only| or later)?", 0.9),
    ("agpl-$1", "(?:gnu )?agpl(?: version)?(?: v ?| )([13])(?: 0)?(?: only| or later)?", 0.9),
    ("agpl-$1", "(?:gnu )?agplv([13])", 0.9),
    ("fdl-$1", "(?:gnu )?(?:free documentation license|gfdl)(?: version)?(?: v ?| )(1 1|1 2|1 3)", 0.9),
    ("apache-$1", "apache(?: software)?(?: license)?(?: version)?(?: v ?| )(1 0|1 1|2 0)", 0.9),
    ("apache-2.0", "apache license 2", 0.8),
    ("bsd-$1-clause", "bsd ([234]) clause(?: license)?", 0.9, (" bsd ",)),
    ("bsd-2-clause", "(?:simplified|freebsd) bsd license|freebsd license", 0.9),
    ("bsd-3-clause", "(?:new|revised|modified) bsd license", 0.9),
    ("bsd-4-clause", "(?:original|old) bsd license", 0.9),
    ("mpl-$1", "mozilla public license(?: mpl)?(?: version)?(?: v ?| )(1 0|1 1|2 0)", 0.9),
    ("mpl-$1", "mpl(?: version)?(?: v ?| )(1 0|1 1|2 0)", 0.9),
    ("epl-$1", "eclipse public license(?: epl)?(?: version)?(?: v ?| )(1 0|2 0)", 0.9),
    ("epl-$1", "epl(?: version)?(?: v ?| )(1 0|2 0)", 0.8),
    ("eupl-$1", "(?:european union public licen[cs]e|eupl)(?: version)?(?: v ?| )(1 0|1 1|1 2)", 0.9),
    ("cddl-$1", "(?:common development and distribution license|cddl)(?: version)?(?: v ?| )(1 0|1 1)", 0.9),
    ("artistic-$1", "artistic license(?: version)?(?: v ?| )(1 0|2 0)", 0.9),
    ("boost-1.0", "boost software license(?: version)?(?: v ?| )1 0", 0.9),
    ("ofl-$1", "(?:sil )?open font license(?: ofl)?(?: version)?(?: v ?| )(1 0|1 1)", 0.9),
    ("php-$1", "php license(?: version)?(?: v ?| )(3 0|3 01)", 0.9),
    ("osl-$1", "open software license(?: version)?(?: v ?| )(1 0|2 0|2 1|3 0)", 0.9),
    ("afl-$1", "academic free license(?: version)?(?: v ?| )(1 2|2 0|2 1|3 0)", 0.9),
    ("cecill-$1", "cecill(?: version)?(?: v ?| )(1 0|2 0|2 1|b|c)", 0.9),
    ("ogl-$1", "open government licen[cs]e(?: version)?(?: v ?| )?(1 0|2 0|3 0)", 0.9),
    ("cdla", "community data license agreement(?: permissive| sharing)?", 0.9),
    ("mulan-2", "mulan permissive software license(?: version)?(?: v ?| )?2", 0.9),
    ("busl-1.1", "business source license(?: version)?(?: v ?| )1 1", 0.9),
    ("cc0-1.0", "(?:cc0|creative commons zero)(?: version)?(?: v ?| )?1 0", 0.9),
    ("cc-by-$1", "(?:cc by|creative commons attribution)(?: license)?(?: version)?(?: v ?| )(1 0|2 0|2 5|3 0|4 0)(?: international| unported| generic)?", 0.9),
    ("cc-by-sa-$1", "(?:cc by sa|creative commons attribution share ?alike)(?: license)?(?: version)?(?: v ?| )(1 0|2 0|2 5|3 0|4 0)(?: international| unported| generic)?", 0.9),
    ("cc-by-nd-$1", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: license)?(?: version)?(?: v ?| )(1 0|2 0|2 5|3 0|4 0)(?: international| unported| generic)?", 0.9),
    ("cc-by-nc-$1", "(?:cc by nc|creative commons attribution non ?commercial)(?: license)?(?: version)?(?: v ?| )(1 0|2 0|2 5|3 0|4 0)(?: international| unported| generic)?", 0.9),
    ("cc-by-nc-sa-$1", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: license)?(?: version)?(?: v ?| )(1 0|2 0|2 5|3 0|4 0)(?: international| unported| generic)?", 0.9),
    ("cc-by-nc-nd-$1", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: license)?(?: version)?(?: v ?| )(1 0|2 0|2 5|3 0|4 0)(?: international| unported| generic)?", 0.9),
    # names alone
    ("gpl", "(?:gnu )?general public license", 0.6),
    ("gpl", "(?:gnu )?gpl(?: license)?", 0.6),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public license", 0.6),
    ("lgpl", "(?:gnu )?lgpl(?: license)?", 0.6),
    ("agpl", "(?:gnu )?affero general public license", 0.6),
    ("agpl", "(?:gnu )?agpl(?: license)?", 0.6),
    ("fdl", "(?:gnu )?(?:free documentation license|gfdl)", 0.6),
    ("apache", "apache(?: software| public)? licen[cs]e", 0.6),
    ("mit", "(?:mit|expat)(?: x11| style| software)? licen[cs]e", 0.6),
    ("bsd", "bsd(?: style| software)? licen[cs]e", 0.6),
    ("isc", "isc licen[cs]e", 0.6),
    ("mpl", "mozilla public licen[cs]e|mpl licensed", 0.6),
    ("epl", "eclipse public licen[cs]e", 0.6),
    ("eupl", "european union public licen[cs]e|eupl", 0.6),
    ("cddl", "common development and distribution licen[cs]e|cddl", 0.6),
    ("cpl", "common public license", 0.6),
    ("ipl", "ibm public license", 0.6),
    ("apsl", "apple public source license", 0.6),
    ("artistic", "(?:perl )?artistic licen[cs]e", 0.6),
    ("boost", "boost(?: software)? licen[cs]e", 0.6),
    ("zlib", "zlib(?: libpng)? licen[cs]e", 0.6),
    ("unlicense", "(?:the )?unlicense", 0.6),
    ("wtfpl", "do what the fuck you want to public license|wtfpl(?: license)?", 0.6),
    ("beerware", "beer ?ware licen[cs]e", 0.6),
    ("python", "python software foundation licen[cs]e|psf licen[cs]e", 0.6),
    ("php", "php licen[cs]e", 0.6),
    ("ruby", "ruby licen[cs]e", 0.6),
    ("openssl", "openssl licen[cs]e", 0.6),
    ("postgresql", "postgresql licen[cs]e", 0.6),
    ("vim", "vim licen[cs]e", 0.6),
    ("w3c", "w3c(?: software)?(?: notice and)? licen[cs]e", 0.6),
    ("lppl", "latex project public licen[cs]e|lppl", 0.6),
    ("qpl", "q public licen[cs]e", 0.6),
    ("ofl", "(?:sil )?open font licen[cs]e", 0.6),
    ("osl", "open software licen[cs]e", 0.6),
    ("afl", "academic free licen[cs]e", 0.6),
    ("ecl", "educational community licen[cs]e", 0.6),
    ("ms-pl", "microsoft public licen[cs]e", 0.6),
    ("ms-rl", "microsoft reciprocal licen[cs]e", 0.6),
    ("upl", "universal permissive licen[cs]e", 0.6),
    ("sspl", "server side public licen[cs]e", 0.6),
    ("elastic", "elastic licen[cs]e", 0.6),
    ("busl", "business source licen[cs]e", 0.6),
    ("commons-clause", "commons clause", 0.6),
    ("odbl", "open database licen[cs]e|odbl", 0.6),
    ("odc-by", "open data commons attribution licen[cs]e", 0.6),
    ("pddl", "public domain dedication and licen[cs]e", 0.6),
    ("ogl", "open government licen[cs]e", 0.6),
    ("cc0", "cc0|creative commons zero", 0.6),
    ("cc-by", "cc by|creative commons attribution", 0.6),
    ("cc-by-sa", "cc by sa|creative commons attribution share ?alike", 0.6),
    ("cc-by-nd", "cc by nd|creative commons attribution no ?deriv(?:ative)?s", 0.6),
    ("cc-by-nc", "cc by nc|creative commons attribution non ?commercial", 0.6),
    ("cc-by-nc-sa", "cc by nc sa|creative commons attribution non ?commercial share ?alike", 0.6),
    ("cc-by-nc-nd", "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s", 0.6),
    ("cc", "creative commons licen[cs]e", 0.6),
    # other claims
    ("public-domain", "(?:in|into|to) the public domain|public domain(?: dedication)?", 0.7),
    ("proprietary", "unauthori[sz]ed copying of this (?:file|software|document)(?: via any medium)? is strictly prohibited", 0.9),
    ("proprietary", "(?:confidential and proprietary|proprietary and confidential)(?: information)?", 0.7),
    ("proprietary", "end user licen[cs]e agreement", 0.6),
    ("proprietary", "no part of this (?:publication|document|book|work|software) may be reproduced", 0.7),
    ("non-commercial", "for (?:personal|academic|research|non ?commercial)(?: use)? (?:use )?only", 0.5, (" for personal ", " for academic ", " for research ", " for non")),
    ("reserved", "(?:some|all|no) rights reserved", 0.5),
    ("as-is", "(?:provided )?as is without (?:any )?(?:express or implied )?warrant(?:y|ies)(?: of any kind)?", 0.4),
    ("copyright", "copyright (?:c )?(?:[0-9]{4} )?(?:[0-9]{4} )?by|copyright (?:c )?[0-9]{4}", 0.4),
)
#: Parts of keywords; a text's words have one of them, or a keyword without any, if a rule matches.
STEMS = (" licen", "license", "copyright", "permission", "redistribut", "spdx", "creative commons", "creativecommons", "public domain", "rights reserved", "gpl", "apache ", "software", " cc ", " cc0", "verbatim copies", "proprietary")


def _pieces(pattern: str) -> list[list[tuple[str, str, str]]]:
    """For each alternative its items: (literal, group or other; text; quantifier)."""
    out: list[list[tuple[str, str, str]]] = [[]]
    k = 0
    while k < len(pattern):
        c, start = pattern[k], k
        if c == "|":
            out.append([])
            k += 1
            continue
        if c == "(":
            depth = 0
            while True:
                depth += {"(": 1, ")": -1}.get(pattern[k], 0)
                k += 1
                if not depth:
                    break
            item = ("group", pattern[start + 1 : k - 1].removeprefix("?:"))
        elif c == "[":
            k = pattern.index("]", k) + 1
            item = ("other", pattern[start:k])
        else:
            k += 1
            item = ("literal", c)
        times = ""
        if k < len(pattern) and pattern[k] in "?*+{":
            end = pattern.index("}", k) + 1 if pattern[k] == "{" else k + 1
            times, k = pattern[k:end], end
        out[-1].append((*item, times))
    return out


def literal_parts(pattern: str, opens: bool = True, ends: bool = True) -> tuple[str, ...]:
    """Strings of which every match has one, the shortest as long as can be; a match has a blank on both sides.

    opens and ends: whether the pattern is at the beginning and the end of the match.
    """
    out: list[str] = []
    for items in _pieces(pattern):
        found: list[tuple[str, ...]] = [("",)]
        run = " " if opens else ""
        for k, (kind, text, times) in enumerate(items):
            if kind == "literal" and not times:
                run += text
                continue
            found.append((run,))
            run = ""
            if kind == "group" and not times:
                found.append(literal_parts(text, opens and k == 0, ends and k == len(items) - 1))
        found.append((run + (" " if ends and run else ""),))
        out += max(found, key=lambda parts: min(map(len, parts)))
    return tuple(dict.fromkeys(out))


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    weight: float
    keywords: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not self.keywords:
            object.__setattr__(self, "keywords", literal_parts(self.pattern))


RULES = [Rule(*row) for row in TABLE]
