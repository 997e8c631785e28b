"""Sentences of license bodies, each a signature by its words: (label, keyword, sentence).

The keyword is among the sentence's lower-cased words. Labels name the version where
the sentence stands in that version alone. The sentences are those of the licenses'
public texts.
"""

from __future__ import annotations

SENTENCES = [
    ("mit", "sublicense", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "copyright holders", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"),
    ("mit", "arising from", "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE"),
    ("mit", "portions of the software", "The above copyright notice and this permission notice shall be included in all copies and substantial portions of the Software"),
    ("bsd", "copyright holders", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'),
    ("bsd", "regents", "THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("bsd", "exemplary", "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"),
    ("bsd", "substitute goods", "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION"),
    ("bsd", "theory of liability", "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT"),
    ("bsd", "documentation and", "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-4", "university of california", "This product includes software developed by the University of California, Berkeley and its contributors"),
    ("isc", "disclaims all warranties", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE'),
    ("isc", "isc disclaims", 'THE SOFTWARE IS PROVIDED "AS IS" AND ISC DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE'),
    ("isc", "special direct", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER"),
    ("apache-2.0", "copyright license", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of"),
    ("apache-2.0", "patent license", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license"),
    ("apache-2.0", "other recipients", "You must give any other recipients of the Work or Derivative Works a copy of this License"),
    ("apache-2.0", "prominent notices", "You must cause any modified files to carry prominent notices stating that You changed the files"),
    ("apache-2.0", "derivative works", "You must retain, in the Source form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices"),
    ("apache-2.0", "notice text", 'If the Work includes a "NOTICE" text file as part of its distribution'),
    ("apache-2.0", "intentionally submitted", "any Contribution intentionally submitted for inclusion in the Work by You to the Licensor shall be under the terms and conditions of this License"),
    ("apache-2.0", "trade names", "This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor"),
    ("apache-2.0", "licensor provides", 'Licensor provides the Work (and each Contributor provides its Contributions) on an "AS IS" BASIS'),
    ("apache-2.0", "support warranty", "You may choose to offer, and charge a fee for, acceptance of support, warranty, indemnity, or other liability obligations"),
    ("apache-2.0", "boilerplate", "To apply the Apache License to your work, attach the following boilerplate notice"),
    ("apache-1.1", "apache software foundation", "This software consists of voluntary contributions made by many individuals on behalf of the Apache Software Foundation"),
    ("apache-1.1", "apache", 'The names "Apache" and "Apache Software Foundation" must not be used to endorse or promote products derived from this software'),
    ("apache-1.0", "apache group", "This product includes software developed by the Apache Group for use in the Apache HTTP server project"),
    ("gpl", "freedom to share", "The licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "freedom not price", "When we speak of free software, we are referring to freedom, not price"),
    ("gpl", "verbatim copies", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("gpl", "hope that", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("gpl", "show w", "comes with ABSOLUTELY NO WARRANTY; for details type `show w'"),
    ("gpl", "redistribute it", "This is free software, and you are welcome to redistribute it under certain conditions"),
    ("gpl", "write to the free", "if not, write to the Free Software Foundation, Inc."),
    ("gpl-2", "based on the program", 'a "work based on the Program" means either the Program or any derivative work under copyright law'),
    ("gpl-2", "physical act", "You may charge a fee for the physical act of transferring a copy, and you may at your option offer warranty protection in exchange for a fee"),
    ("gpl-2", "modified files", "You must cause the modified files to carry prominent notices stating that you changed the files and the date of any change"),
    ("gpl-2", "third parties", "in whole or in part contains or is derived from the Program or any part thereof, to be licensed as a whole at no charge to all third parties"),
    ("gpl-2", "machine readable", "Accompany it with the complete corresponding machine-readable source code, which must be distributed under the terms of Sections 1 and 2 above"),
    ("gpl-2", "written offer", "Accompany it with a written offer, valid for at least three years, to give any third party"),
    ("gpl-2", "expressly provided", "You may not copy, modify, sublicense, or distribute the Program except as expressly provided under this License"),
    ("gpl-2", "not signed it", "You are not required to accept this License, since you have not signed it"),
    ("gpl-2", "geographical", "the original copyright holder who places the Program under this License may add an explicit geographical distribution limitation"),
    ("gpl-2", "mere aggregation", "mere aggregation of another work not based on the Program with the Program"),
    ("gpl-3", "deny users", "Some devices are designed to deny users access to install or run modified versions of the software inside them"),
    ("gpl-3", "technological measure", "No covered work shall be deemed part of an effective technological measure under any applicable law fulfilling obligations under article 11"),
    ("gpl-3", "system libraries", 'The "System Libraries" of an executable work include anything, other than the work as a whole'),
    ("gpl-3", "corresponding source", 'The "Corresponding Source" for a work in object code form means all the source code needed to generate, install, and'),
    ("gpl-3", "rights granted", "All rights granted under this License are granted for the term of copyright on the Program, and are irrevocable provided the stated conditions are met"),
    ("gpl-3", "installation information", '"Installation Information" for a User Product means any methods, procedures, authorization keys, or other information'),
    ("gpl-3", "additional permissions", '"Additional permissions" are terms that supplement the terms of this License by making exceptions from one or more of its conditions'),
    ("gpl-3", "propagate or modify", "You may not propagate or modify a covered work except as expressly provided under this License"),
    ("gpl-3", "covered work", "Each time you convey a covered work, the recipient automatically receives a license from the original licensors, to run, modify and propagate that work"),
    ("gpl-3", "essential patent", "A contributor's \"essential patent claims\" are all patent claims owned or controlled by the contributor"),
    ("gpl-3", "affero", "you have permission to link or combine any covered work with a work licensed under version 3 of the GNU Affero General Public License"),
    ("lgpl", "library is distributed", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("lgpl-2.1", "uses the library", 'A program that contains no derivative of any portion of the Library, but is designed to work with the Library by being compiled or linked with it, is called a "work that uses the Library"'),
    ("lgpl-2.1", "reverse engineering", "provided that the terms permit modification of the work for the customer's own use and reverse engineering for debugging such modifications"),
    ("lgpl-2.1", "ordinary gnu", "You may opt to apply the terms of the ordinary GNU General Public License instead of this License to a given copy of the Library"),
    ("lgpl-2.1", "successor", "It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1"),
    ("lgpl-3", "combined work", 'A "Combined Work" is a work produced by combining or linking an Application with the Library'),
    ("lgpl-3", "terms and conditions", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License"),
    ("agpl-3", "remotely", "if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("agpl-3", "becomes available", "The GNU Affero General Public License is designed specifically to ensure that, in such cases, the modified source code becomes available to the community"),
    ("agpl", "affero", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("agpl", "affero", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "incompatible with secondary", 'This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v. 2.0'),
    ("mpl-2.0", "covered software", '"Covered Software" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A'),
    ("mpl-2.0", "source code form", "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License"),
    ("mpl-2.0", "larger work", "You may create and distribute a Larger Work under terms of Your choice, provided that You also comply with the requirements of this License for the Covered Software"),
    ("mpl-2.0", "secondary license", '"Secondary License" means either the GNU General Public License, Version 2.0, the GNU Lesser General Public License, Version 2.1'),
    ("mpl-1.1", "software distributed", 'Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language'),
    ("mpl-1.1", "original code", "The Initial Developer of the Original Code is"),
    ("mpl-1.1", "provisions above", "If you do not delete the provisions above, a recipient may use your version of this file under the terms of any one of the MPL, the GPL or the LGPL"),
    ("epl", "agreement", 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT")'),
    ("epl", "recipient", "ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT"),
    ("epl", "commercial contributor", "If that Commercial Contributor then makes performance claims, or offers warranties related to Product X"),
    ("epl-2.0", "secondary licenses", "This Source Code may also be made available under the following Secondary Licenses when the conditions for such availability set forth in the Eclipse Public License"),
    ("epl-1.0", "agreement steward", "The Eclipse Foundation is the initial Agreement Steward"),
    ("cddl", "development and distribution", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("cddl-1.0", "cddl header", "When distributing Covered Code, include this CDDL HEADER in each file"),
    ("cddl", "netbeans", "You can obtain a copy of the License at http://www.netbeans.org/cddl-gplv2.html"),
    ("cpl", "common public", 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS COMMON PUBLIC LICENSE ("AGREEMENT")'),
    ("zlib", "provided as is", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib", "commercial applications", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("zlib", "acknowledgment", "an acknowledgment in the product documentation would be appreciated but is not required"),
    ("zlib", "source distribution", "This notice may not be removed or altered from any source distribution"),
    ("libpng", "group 42", "The Contributing Authors and Group 42, Inc. specifically permit, without fee, and encourage the use of this source code as a component to supporting the PNG file format"),
    ("boost", "machine executable", "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor"),
    ("boost", "prepare derivative", "use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("boost-1.0", "accompanying file", "See accompanying file LICENSE_1_0.txt"),
    ("unlicense", "jurisdictions", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("unlicense", "detriment", "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("unlicense", "relinquishment", "an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
    ("cc0-1.0", "affirmer", "Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights"),
    ("cc0-1.0", "waiver", "Should any part of the Waiver for any reason be judged legally invalid or ineffective under applicable law"),
    ("cc0-1.0", "extent possible", "To the extent possible under law, the person who associated CC0 with this work has waived"),
    ("cc", "exercising the licensed", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions"),
    ("cc", "its public licenses", "Creative Commons is not a party to its public licenses"),
    ("cc", "licensed material", "If You Share the Licensed Material (including in modified form), You must retain the following if it is supplied by the Licensor"),
    ("cc", "effective technological", '"Effective Technological Measures" means those measures that, in the absence of proper authority, may not be circumvented'),
    ("cc", "law firm", "CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES"),
    ("cc", "ccpl", 'THE WORK (AS DEFINED BELOW) IS PROVIDED UNDER THE TERMS OF THIS CREATIVE COMMONS PUBLIC LICENSE ("CCPL" OR "LICENSE")'),
    ("cc-by-sa", "adapter s license", "The Adapter's License You apply must be a Creative Commons license with the same License Elements, this version or later, or a BY-SA Compatible License"),
    ("cc-by-nc", "noncommercial means", "NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation"),
    ("cc-by-nd", "adapted material", "You do not have permission under this Public License to Share Adapted Material"),
    ("ofl", "font software", "The Font Software may be sold as part of a larger software package but no copy of one or more of the Font Software typefaces may be sold by itself"),
    ("ofl", "modified version", "No Modified Version of the Font Software may use the Reserved Font Name(s) unless explicit written permission is granted"),
    ("ofl", "collaborative font", "The goals of the Open Font License (OFL) are to stimulate worldwide development of collaborative font projects"),
    ("ofl", "ofl allows", "The OFL allows the licensed fonts to be used, studied, modified and redistributed freely as long as they are not sold by themselves"),
    ("gfdl", "functional and useful", 'The purpose of this License is to make a manual, textbook, or other functional and useful document "free" in the sense of freedom'),
    ("gfdl", "front cover", "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts"),
    ("gfdl", "transparent copy", 'A "Transparent" copy of the Document means a machine-readable copy'),
    ("gfdl", "printed copies", "If you publish printed copies (or copies in media that commonly have printed covers) of the Document, numbering more than 100"),
    ("gfdl", "entitled gnu", 'A copy of the license is included in the section entitled "GNU Free Documentation License"'),
    ("artistic", "semblance", "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control"),
    ("artistic", "standard version", "You may make and give away verbatim copies of the source form of the Standard Version of this Package without restriction"),
    ("artistic", "reasonable copying fee", "You may charge a reasonable copying fee for any distribution of this Package"),
    ("artistic-2.0", "perl foundation", "Copyright (c) 2000-2006, The Perl Foundation"),
    ("artistic-2.0", "given package", "You are always permitted to make arrangements wholly outside of this license directly with the Copyright Holder of a given Package"),
    ("odbl", "database", "This database is made available under the Open Database License"),
    ("odbl", "database contents", "Any rights in individual contents of the database are licensed under the Database Contents License"),
    ("odbl", "produced work", 'If You Publicly Use a Produced Work, You must include a notice associated with the Produced Work reasonably calculated to make any Person'),
    ("odbl", "openstreetmap", "OpenStreetMap is open data, licensed under the Open Data Commons Open Database License"),
    ("odc-by", "attribution license", "This database is made available under the Open Data Commons Attribution License"),
    ("pddl", "public domain dedication", "This database is made available under the Public Domain Dedication and License v1.0"),
    ("eupl", "eupl", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL"),
    ("eupl", "original work", "The Licensor hereby grants You a worldwide, royalty-free, non-exclusive, sublicensable licence to do the following, for the duration of copyright vested in the Original Work"),
    ("cecill", "cecill", "This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software"),
    ("cecill", "cecill b", "This software is governed by the CeCILL-B license under French law and abiding by the rules of distribution of free software"),
    ("cecill", "cecill c", "This software is governed by the CeCILL-C license under French law and abiding by the rules of distribution of free software"),
    ("ms-pl", "accept this license", "This license governs use of the accompanying software. If you use the software, you accept this license"),
    ("ms-pl", "contributor grants you", "each contributor grants you a non-exclusive, worldwide, royalty-free copyright license to reproduce its contribution, prepare derivative works of its contribution"),
    ("ms-rl", "recipients the source", "For any file you distribute that contains code from the software (in source code or binary form), you must provide recipients the source code to that file along with a copy of this license"),
    ("osl", "open software", 'Licensed under the Open Software License version 3.0'),
    ("osl", "external deployment", 'The term "External Deployment" means the use, distribution, or communication of the Original Work or Derivative Works in any way'),
    ("afl", "academic free", "Licensed under the Academic Free License version 3.0"),
    ("psf", "psf", "PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform and/or display publicly"),
    ("psf", "psf", 'PSF is making Python available to Licensee on an "AS IS" basis'),
    ("psf", "beopen", "BEOPEN PYTHON OPEN SOURCE LICENSE AGREEMENT VERSION 1"),
    ("ncsa", "illinois", "Neither the names of the University of Illinois"),
    ("ncsa", "deal with the software", "to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish"),
    ("w3c", "read understood", "This work is being provided by the copyright holders under the following license. By obtaining and/or copying this work, you agree that you have read, understood, and will comply"),
    ("w3c", "w3c", "This W3C work (including software, documents, or other related items) is being provided by the copyright holders"),
    ("php", "php development", 'THIS SOFTWARE IS PROVIDED BY THE PHP DEVELOPMENT TEAM ``AS IS\'\''),
    ("php", "php", 'The name "PHP" must not be used to endorse or promote products derived from this software'),
    ("postgresql", "written agreement", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("postgresql", "maintenance support", "HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS"),
    ("vim", "vim", "There are no restrictions on distributing unmodified copies of Vim except that they must include this license text"),
    ("tcl", "existing copyright", "The authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose, provided that existing copyright notices are retained"),
    ("openssl", "openssl toolkit", "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit"),
    ("ssleay", "eric young", "This product includes cryptographic software written by Eric Young"),
    ("ssleay", "ssl documentation", "The SSL documentation included with this distribution is covered by the same copyright terms"),
    ("curl", "daniel stenberg", "Daniel Stenberg, and many contributors"),
    ("ftl", "freetype", "Portions of this software are copyright (c) The FreeType Project"),
    ("info-zip", "info zip", 'For the purposes of this copyright and license, "Info-ZIP" is defined as the following set of individuals'),
    ("imagemagick", "imagemagick studio", "ImageMagick Studio LLC, a non-profit organization dedicated to making software imaging solutions freely available"),
    ("sleepycat", "db software", "Redistributions in any form must be accompanied by information on how to obtain complete source code for the DB software"),
    ("zpl", "zope", 'This software is subject to the provisions of the Zope Public License, Version 2.1 (ZPL)'),
    ("wtfpl", "name is changed", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("beerware", "meet some day", "If we meet some day, and you think this stuff is worth it, you can buy me a beer"),
    ("blueoak", "much permission", "This license gives everyone as much permission to work with this software as possible, while protecting contributors from liability"),
    ("upl", "lrgrwrks", 'any piece of software and/or hardware listed in the lrgrwrks.txt file if one is included with the Software'),
    ("busl", "change date", "Effective on the Change Date, or the fourth anniversary of the first publicly available distribution of a specific version of the Licensed Work"),
    ("busl", "non production", "The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work"),
    ("sspl", "service source", "If you make the functionality of the Program or a modified version available to third parties as a service, you must make the Service Source Code available"),
    ("elastic", "managed service", "You may not provide the software to third parties as a hosted or managed service, where the service provides users with access to any substantial set of the features"),
    ("commons-clause", "right to sell", "the grant of rights under the License will not include, and the License does not grant to you, the right to Sell the Software"),
    ("confluent", "excluded purpose", '"Excluded Purpose" means making available any software-as-a-service, platform-as-a-service, infrastructure-as-a-service'),
    ("polyform", "strict obligations", "In order to get any license under these terms, you must agree to them as both strict obligations and conditions to all your licenses"),
    ("openrail", "derivatives of the model", "You agree not to use the Model or Derivatives of the Model in any way that violates any applicable national, federal, state, local or international law or regulation"),
    ("openrail", "complementary material", '"Complementary Material" means the accompanying source code and scripts used to define, run, load, benchmark or evaluate the Model'),
    ("unicode", "data files", "Permission is hereby granted, free of charge, to any person obtaining a copy of the Unicode data files and any associated documentation"),
    ("unicode", "unicode inc", "NOTICE TO USER: Carefully read the following legal agreement. BY DOWNLOADING, INSTALLING, COPYING OR OTHERWISE USING UNICODE INC.'S DATA FILES"),
    ("ogl", "public sector", "Contains public sector information licensed under the Open Government Licence v3.0"),
    ("ogl", "crown", "Contains Ordnance Survey data (c) Crown copyright and database right"),
    ("gutenberg", "ebook", "This eBook is for the use of anyone anywhere in the United States and most other parts of the world at no cost and with almost no restrictions whatsoever"),
    ("gutenberg", "gutenberg", "You may copy it, give it away or re-use it under the terms of the Project Gutenberg License included with this eBook"),
    ("bitstream-vera", "fonts accompanying", "Permission is hereby granted, free of charge, to any person obtaining a copy of the fonts accompanying this license"),
    ("hpnd", "supporting documentation", "provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("x11", "x consortium", "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software"),
    ("lppl", "latex project", "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License, either version 1.3"),
    ("lppl", "maintained", "This work has the LPPL maintenance status `maintained'"),
    ("qpl", "patches", "You may make modifications to the Software and distribute your modifications, in a form that is separate from the Software, such as patches"),
    ("ijg", "no warranty notice", "If any part of the source code for this software is distributed, then this README file must be included, with this copyright and no-warranty notice unaltered"),
    ("json", "good not evil", "The Software shall be used for Good, not Evil"),
    ("sqlite-blessing", "may you", "May you find forgiveness for yourself and forgive others"),
    ("sqlite-blessing", "may you", "May you share freely, never taking more than you give"),
    ("mulan", "mulan psl", "licensed under Mulan PSL v2. You can use this software according to the terms and conditions of the Mulan PSL v2"),
    ("python", "stichting", "Copyright (c) 1991 - 1995, Stichting Mathematisch Centrum Amsterdam"),
    ("nist", "nist", "This software was developed by employees of the National Institute of Standards and Technology (NIST), an agency of the Federal Government"),
    ("us-government", "title 17", "Pursuant to title 17 Section 105 of the United States Code this software is not subject to copyright protection"),
    ("us-government", "disclosure by the government", "Use, duplication, or disclosure by the Government is subject to restrictions"),
]
#: Sentences of exceptions to a license.
EXCEPTION_SENTENCES = [
    ("exception-classpath", "independent modules", "the copyright holders of this library give you permission to link this library with independent modules to produce an executable"),
    ("exception-gcc", "target code", "You have permission to propagate a work of Target Code formed by combining the Runtime Library with Independent Modules"),
    ("exception-gcc", "instantiate templates", "if other files instantiate templates or use macros or inline functions from this file"),
    ("exception-libtool", "libtool", "if you distribute this file as part of a program or library that is built using GNU Libtool"),
    ("exception-autoconf", "autoconf", "the Free Software Foundation gives unlimited permission to copy, distribute and modify the configure scripts that are the output of Autoconf"),
    ("exception-qt", "qt", "As a special exception, The Qt Company gives you certain additional rights"),
    ("exception-wxwindows", "exception notice", "EXCEPTION NOTICE 1. As a special exception, the copyright holders of this library give permission for additional uses of the text"),
    ("exception-ocaml", "dynamically", "you may link, statically or dynamically, a work that uses the Library with a publicly distributed version of the Library to produce an executable file"),
    ("exception-font", "document", "if you create a document which uses this font, and embed this font or unaltered portions of this font into the document, this font does not by itself cause the resulting document to be covered"),
    ("exception-openssl", "openssl", "You must obey the GNU General Public License in all respects for all of the code used other than OpenSSL"),
    ("exception-foss", "open source software", "use of this software in conjunction with Free and Open Source Software"),
    ("exception-gstreamer", "gstreamer", "permission for non-GPL-compatible GStreamer plugins to be used and distributed together with GStreamer"),
    ("exception-u-boot", "u boot", "standalone applications that use U-Boot services by means of the jump table"),
    ("exception-ecos", "compile this file", "if other files instantiate templates or use macros or inline functions from this file, or you compile this file and link it with other works"),
    ("exception-universal-foss", "universal foss", "the Universal FOSS Exception, version 1.0"),
]
