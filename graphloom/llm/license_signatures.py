"""Signatures of license texts, headers, exceptions and notices, each with a passage that it must find.

A row is (label, keyword, regex, passage). Regexes read lower-cased words with single
spaces between them; the keyword, or one of them, is among the words of every match. ``…`` stands for any words, none too. The rows are
written by hand from the licenses' public texts; names with their versions, which
follow a rule, are made in ``license_scan``.
"""

from __future__ import annotations

#: Whole sentences of license bodies and of the headers that grant them.
BODIES = [
    ("mit", "associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial portions", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "with or without fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"),
    ("0bsd", "with or without fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED"),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the (?:above )?copyright notice", "Redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the (?:above )?copyright notice", "Redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", "endorse or promote", "neither the names? of … nor the names of (?:its|their) contributors may be used to endorse or promote", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("bsd-3-clear", "patent rights", "no express or implied licenses to any party s patent rights are granted by this license", "NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE."),
    ("apache-2.0", "compliance with the license", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS'),
    ("apache-2.0", "apache org", "apache org licenses license 2 0", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "january 2004", "apache license version 2 0 january 2004", "Apache License, Version 2.0, January 2004"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation", "This product includes software developed by the Apache Software Foundation"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl-2-or-later", "either version", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3-or-later", "either version", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "received a copy", "you should have received a copy of the gnu general public license", "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl-2", "june 1991", "gnu general public license version 2 june 1991", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl-3", "29 june 2007", "gnu (?:lesser )?general public license version 3 29 june 2007", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl", "gnu org", "gnu org licenses (?:old licenses )?gpl", "https://www.gnu.org/licenses/gpl.html"),
    ("lgpl", "gnu org", "gnu org licenses (?:old licenses )?lgpl", "https://www.gnu.org/licenses/lgpl.html"),
    ("agpl", "gnu org", "gnu org licenses agpl", "https://www.gnu.org/licenses/agpl.html"),
    ("gfdl", "gnu org", "gnu org licenses (?:old licenses )?fdl", "https://www.gnu.org/licenses/fdl.html"),
    ("lgpl", "free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("lgpl-2.1-or-later", "either version", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl-2.0", "library general public", "gnu library general public license", "GNU Library General Public License"),
    ("agpl-3", "19 november 2007", "gnu affero general public license version 3 19 november 2007", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public license v 2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("mpl-1.1", "contents of this file", "the contents of this file are subject to the mozilla public license version 1 1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("mpl", "mozilla org", "mozilla org mpl", "http://mozilla.org/MPL/2.0/"),
    ("epl-1.0", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("epl-2.0", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version )?2 0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("cddl", "development and distribution", "common development and distribution license", "Common Development and Distribution License (CDDL)"),
    ("zlib", "held liable for any damages", "in no event will the authors be held liable for any damages arising from the use of this software", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented", "Altered source versions must be plainly marked as such, and must not be misrepresented"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", "The origin of this software must not be misrepresented;"),
    ("boost", "person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost-1.0", "boost org", "boost org license 1 0", "http://www.boost.org/LICENSE_1_0.txt"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "anyone is free", "anyone is free to copy modify publish use compile sell or distribute this software", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("unlicense", "unlicense org", "unlicense org", "<http://unlicense.org/>"),
    ("cc0-1.0", "publicdomain", "creativecommons org publicdomain zero 1 0", "http://creativecommons.org/publicdomain/zero/1.0/"),
    ("cc0", "neighboring rights", "waived all copyright and related or neighboring rights", "the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-pdm", "publicdomain", "creativecommons org publicdomain mark 1 0", "https://creativecommons.org/publicdomain/mark/1.0/"),
    ("cc-by", "creativecommons", "creativecommons org licenses by [1-4] [05]", "https://creativecommons.org/licenses/by/4.0/"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1-4] [05]", "https://creativecommons.org/licenses/by-sa/4.0/"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1-4] [05]", "https://creativecommons.org/licenses/by-nd/3.0/"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1-4] [05]", "https://creativecommons.org/licenses/by-nc/2.5/"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1-4] [05]", "https://creativecommons.org/licenses/by-nc-sa/4.0/"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1-4] [05]", "https://creativecommons.org/licenses/by-nc-nd/4.0/"),
    ("cc", "creative commons", "th(?:is|e) (?:work|article|book|page|text|content|material|document|image|photo|video|dataset) is licensed under (?:a|the) creative commons", "This work is licensed under a Creative Commons license."),
    ("ofl", "font software", "this font software is licensed under the sil open font license", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("ofl", "sil org", "scripts sil org ofl", "https://scripts.sil.org/OFL"),
    ("ofl", "reserved font", "with reserved font names?", "Copyright 2020, with Reserved Font Name Example"),
    ("gfdl", "this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("gfdl", "invariant sections", "with no invariant sections", "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts"),
    ("odbl", "opendatacommons", "opendatacommons org licenses odbl", "http://opendatacommons.org/licenses/odbl/1.0/"),
    ("pddl", "opendatacommons", "opendatacommons org licenses pddl", "http://opendatacommons.org/licenses/pddl/1.0/"),
    ("odc-by", "opendatacommons", "opendatacommons org licenses by", "http://opendatacommons.org/licenses/by/1.0/"),
    ("json", "good not evil", "the software shall be used for good not evil", "The Software shall be used for Good, not Evil."),
    ("beerware", "beer in return", "you can buy me a beer in return", "if you think this stuff is worth it, you can buy me a beer in return."),
    ("hpnd", "software and its documentation", "permission to use copy modify and distribute this software and its documentation for any purpose", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose"),
    ("x11", "x consortium", "the name of the x consortium shall not be used in advertising", "the name of the X Consortium shall not be used in advertising or otherwise"),
    ("openssl", "openssl", "this product includes software developed by the openssl project", "This product includes software developed by the OpenSSL Project"),
    ("php", "php", "this product includes php software", "This product includes PHP software, freely available from"),
    ("ijg", "jpeg group", "this software is based in part on the work of the independent jpeg group", "this software is based in part on the work of the Independent JPEG Group"),
    ("perl", "perl", "(?:under )?the same terms as (?:the )?perl(?: 5)?(?: itself| programming language)?", "you can redistribute it under the same terms as Perl itself"),
    ("ruby", "ruby", "(?:under )?the same terms as ruby", "distributed under the same terms as Ruby"),
]
#: Names of licenses that come without versions here.
NAMES = [
    ("afl", "academic free", "academic free license", "Academic Free License"),
    ("osl", "open software", "open software license", "Open Software License 3.0"),
    ("eupl", "european union", "european union public licen[cs]e", "European Union Public Licence"),
    ("cecill", "cecill", "cecill(?: [abc])?(?: free software)?(?: license)?", "CeCILL-B Free Software License"),
    ("ms-pl", "microsoft public", "microsoft public license", "Microsoft Public License (Ms-PL)"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal license", "Microsoft Reciprocal License"),
    ("apsl", "apple public", "apple public source license", "Apple Public Source License"),
    ("qpl", "q public", "q public license", "Q Public License"),
    ("npl", "netscape", "netscape public license", "Netscape Public License"),
    ("rpl", "reciprocal public", "reciprocal public license", "Reciprocal Public License"),
    ("sissl", "sun industry", "sun industry standards source license", "Sun Industry Standards Source License"),
    ("cpl", "common public", "common public license", "Common Public License 1.0"),
    ("ipl", "ibm public", "ibm public license", "IBM Public License"),
    ("psf", "python software", "python software foundation license", "Python Software Foundation License"),
    ("python", "python license", "python license", "under the Python License"),
    ("php", "php license", "php license", "the PHP License, version 3.01"),
    ("openssl", "openssl license", "openssl license", "OpenSSL License"),
    ("ssleay", "ssleay", "(?:original )?ssleay license", "Original SSLeay License"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license", "University of Illinois/NCSA Open Source License"),
    ("w3c", "w3c", "w3c (?:software|document)(?: and document)?(?: notice and)? license", "W3C Software Notice and License"),
    ("vim", "vim license", "vim license", "distributed under the VIM license"),
    ("ruby", "ruby license", "ruby license", "under the Ruby License"),
    ("tcl", "tcl", "tcl tk license", "Tcl/Tk License"),
    ("curl", "curl license", "curl license", "the curl license"),
    ("libpng", "libpng", "libpng license", "libpng license"),
    ("ftl", ("freetype", "free type"), "free ?type(?: project)? license", "The FreeType Project LICENSE"),
    ("imagemagick", "imagemagick", "imagemagick license", "ImageMagick License"),
    ("info-zip", "info zip", "info zip license", "Info-ZIP license"),
    ("sleepycat", "sleepycat", "sleepycat license", "Sleepycat License"),
    ("zpl", "zope", "zope public license", "Zope Public License (ZPL)"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "PostgreSQL Licence"),
    ("upl", "universal permissive", "universal permissive license", "Universal Permissive License v 1.0"),
    ("blueoak", "blue oak", "blue oak model license", "Blue Oak Model License 1.0.0"),
    ("mulan", "mulan", "mulan (?:permissive software|psl|publ)(?: license)?", "Mulan PSL v2"),
    ("busl", "business source", "business source license", "Business Source License 1.1"),
    ("sspl", "server side", "server side public license", "Server Side Public License"),
    ("elastic", "elastic license", "elastic license(?: v| version)?(?: 2 0)?", "Elastic License 2.0"),
    ("commons-clause", "commons clause", "commons clause(?: license condition)?", "Commons Clause License Condition v1.0"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use)", "PolyForm Noncommercial License"),
    ("confluent", "confluent", "confluent community license", "Confluent Community License"),
    ("openrail", "rail", "(?:open rail|bigscience (?:bloom )?rail)(?: m)?(?: license)?", "BigScience Open RAIL-M License"),
    ("openrail", "openrail", "openrail(?: m)?(?: license)?", "CreativeML OpenRAIL-M"),
    ("wtfpl", "wtfpl", "wtfpl", "WTFPL"),
    ("beerware", "beer ware", "beer ware license", "THE BEER-WARE LICENSE"),
    ("unicode", "unicode", "unicode (?:license|data files and software license)", "Unicode License v3"),
    ("icu", "icu license", "icu license", "ICU License"),
    ("ogl", "open government", "open government licen[cs]e", "Open Government Licence v3.0"),
    ("etalab", "etalab", "etalab(?: open)? licen[cs]e", "Etalab Open Licence"),
    ("dl-de", "datenlizenz", "datenlizenz deutschland", "Datenlizenz Deutschland - Namensnennung"),
    ("gutenberg", "project gutenberg", "project gutenberg license", "the Project Gutenberg License"),
    ("bitstream-vera", "bitstream vera", "bitstream vera(?: fonts)?(?: copyright| license)", "Bitstream Vera Fonts Copyright"),
    ("hpnd", "historical permission", "historical permission notice and disclaimer", "Historical Permission Notice and Disclaimer"),
    ("lppl", "latex project", "latex project public license", "LaTeX Project Public License"),
    ("eula", "end user", "end user licen[cs]e agreement", "End-User License Agreement"),
]
#: Exceptions to a license.
EXCEPTIONS = [
    ("exception-classpath", "classpath", "classpath exception", "GPL with Classpath Exception"),
    ("exception-linking", "combined work", "linking this library statically or dynamically with other modules is making a combined work", "Linking this library statically or dynamically with other modules is making a combined work"),
    ("exception-gcc", "runtime library", "gcc runtime library exception", "the GCC Runtime Library Exception, version 3.1"),
    ("exception-bison", "bison", "contains part or all of the bison parser skeleton", "you may create a larger work that contains part or all of the Bison parser skeleton"),
    ("exception-autoconf", "autoconf", "configur(?:e|ation) script generated by autoconf", "that contains a configuration script generated by Autoconf"),
    ("exception-llvm", "llvm", "with llvm exceptions?", "Apache License v2.0 with LLVM Exceptions"),
    ("exception-openssl", "openssl library", "permission to link the code of portions of this program with the openssl library", "permission to link the code of portions of this program with the OpenSSL library"),
    ("exception-syscall", "system calls", "user programs that use kernel services by normal system calls", "This copyright does not cover user programs that use kernel services by normal system calls"),
    ("exception-font", "font exception", "font exception", "GPL with font exception"),
    ("exception", "special exception", "as a special exception", "As a special exception, the copyright holders give you permission"),
]
#: Notices that name no license.
NOTICES = [
    ("reserved", "rights reserved", "all rights reserved", "All Rights Reserved."),
    ("reserved", "rights reserved", "some rights reserved", "Some rights reserved"),
    ("no-rights-reserved", "rights reserved", "no rights reserved", "No Rights Reserved"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?", "Copyright (c) 1999-2004"),
    ("warranty", "warranty", "without (?:any )?warranty(?: of any kind)?", "WITHOUT WARRANTY OF ANY KIND"),
    ("warranty", "merchantability", "(?:implied )?warrant(?:y|ies) of merchantability", "the implied warranties of MERCHANTABILITY"),
    ("warranty", "fitness for a particular", "fitness for a particular purpose", "fitness for a particular purpose"),
    ("liability", "in no event", "in no event shall … be liable", "In no event shall the copyright owner or contributors be liable"),
    ("permission", "hereby granted", "permission is hereby granted", "Permission is hereby granted"),
    ("dual", "dual licensed", "(?:is |are )?dual licensed", "This crate is dual-licensed"),
    ("dual", "either of", "licensed under either of", "Licensed under either of"),
    ("see-file", "details", "see (?:the )?(?:file )?(?:license|licence|copying|copyright)(?: txt| md)?(?: file)? for (?:more )?details", "See the LICENSE file for details."),
    ("public-domain", "public domain", "(?:dedicated to|released (?:in)?to|placed (?:in)?to?|in|part of) the public domain", "This text is in the public domain."),
    ("public-domain", "publicdomain", "publicdomain", "https://example.org/publicdomain"),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)(?: information)?", "Proprietary and confidential."),
    ("proprietary", "strictly prohibited", "unauthori[sz]ed (?:copying|use|distribution|reproduction) … is strictly prohibited", "Unauthorized copying of this file, via any medium, is strictly prohibited"),
    ("proprietary", "licensed materials", "licensed materials property of", "Licensed Materials - Property of Example"),
    ("proprietary", "internal use", "for internal use only", "For internal use only"),
    ("no-redistribution", "written permission", "(?:may not|must not|cannot) be (?:reproduced|copied|redistributed|distributed|published) … without (?:the )?(?:express |prior |explicit )?(?:express |prior )?written permission", "may not be reproduced in any form without prior written permission"),
    ("noncommercial", ("commercial", "noncommercial"), "for non ?commercial (?:use|purposes?)(?: only)?", "For non-commercial use only."),
    ("research-only", "research", "for (?:academic )?research (?:use|purposes?) only", "for research purposes only"),
    ("evaluation-only", "evaluation", "for evaluation (?:use|purposes?) only", "for evaluation purposes only"),
    ("personal-use", "personal", "for (?:your )?(?:private and )?personal(?: and non ?commercial)? use only", "for your personal use only"),
    ("trademark", "registered", "(?:is a|are) registered trademarks? of", "Example is a registered trademark of Example Corp."),
    ("patent", ("patent", "patents"), "(?:patents? pending|protected by (?:one or more )?patents?)", "Patent pending."),
    ("free-of-charge", "free of charge", "free of charge for any purpose", "available free of charge for any purpose"),
    ("attribution", "attribution", "attribution (?:is )?required", "Attribution required"),
    ("share-alike", "under the same license", "distribute … under the same license", "you must distribute your contributions under the same license"),
]
