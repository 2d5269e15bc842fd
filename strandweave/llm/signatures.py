"""Hand-written signatures of license texts and notices.

Fixed values: label, priority, words that every match holds (all of those joined by &), and a pattern over text with A-Z
lower-cased. A space in a pattern stands for a run of white space and comment marks, as texts are wrapped in sources' headers.
"""

BODY, NOTICE = 95, 92

SIGNATURES = [
    # permissive: MIT and its relatives
    ("mit", BODY, "permission&granted", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", BODY, "permission&substantial", r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions of the software"),
    ("mit", BODY, "warranty&express&implied", r"the software is provided [\"'“`]+as is[\"'”]+,? without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    ("x11", BODY, "consortium", r"except as contained in this notice, the name of the x consortium shall not be used"),
    ("ncsa", BODY, "deal&restriction", r"to deal with the software without restriction"),
    ("json", BODY, "evil", r"the software shall be used for good, not evil"),
    ("isc", BODY, "permission&fee", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("0bsd", BODY, "permission&fee", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\."),
    ("isc", BODY, "disclaims&regard", r"the software is provided [\"'“`]+as is[\"'”]+ and (?:the author|isc) disclaims all warranties with regard to this software"),
    ("hpnd", BODY, "permission&fee", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("postgresql", BODY, "permission&fee", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("bsl-1.0", BODY, "permission&granted", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("beerware", BODY, "whatever&stuff", r"you can do whatever you want with this stuff"),
    ("upl-1.0", BODY, "permission&patent", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software, associated documentation and/or data \(collectively the [\"'“]software[\"'”]\), free of charge and under any and all copyright rights in the software, and any and all patent rights"),
    ("blueoak-1.0.0", BODY, "contributor&licenses", r"each contributor licenses you to do everything with this software that would otherwise infringe that contributor's copyright"),
    # BSD
    ("bsd", BODY, "redistribution&binary", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", BODY, "redistributions&retain", r"redistributions of source code must retain the (?:above )?copyright notice, this list of conditions"),
    ("bsd", BODY, "redistributions&reproduce", r"redistributions in binary form must reproduce the (?:above )?copyright notice, this list of conditions"),
    ("bsd-3-clause", BODY, "endorse&contributors", r"neither the names? of [^.;]{1,160}? nor the names of (?:its|their|other) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", BODY, "advertising&acknowledg", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ments?"),
    ("bsd", BODY, "warranties&holders", r"this software is provided by the copyright holders and contributors [\"'“`]+as is[\"'”]+ and any express or implied warranties"),
    ("bsd", BODY, "warranties&regents", r"this software is provided by the regents and contributors [\"'“`]+as is[\"'”]+ and any express or implied warranties"),
    ("bsd-2-clause", BODY, "official&policies", r"the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies"),
    ("bsd", NOTICE, "bsd", r"use of this source code is governed by a bsd-style license"),
    ("bsd-3-clause-clear", BODY, "patent&express", r"no express or implied licenses to any party's patent rights are granted by this license"),
    # Apache
    ("apache-2.0", NOTICE, "apache", r"licensed under the apache license, version 2\.0 \(the [\"'“]license[\"'”]\)"),
    ("apache-2.0", NOTICE, "apache&contributor", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache-2.0", BODY, "apache&january", r"apache license,? version 2\.0, january 2004"),
    ("apache-2.0", NOTICE, "compliance&file", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", BODY, "applicable&basis", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an [\"'“]as is[\"'”] basis"),
    ("apache-2.0", BODY, "contributor&irrevocable&copyright", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("apache-2.0", BODY, "contributor&irrevocable&patent", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable \(except as stated in this section\) patent license"),
    ("apache-1.1", BODY, "apache&product", r"this product includes software developed by the apache software foundation"),
    ("apache-2.0", NOTICE, "apache", r"\bapache[- ]?2(?:\.0)? licen[sc]ed?\b"),
    ("llvm-exception", BODY, "llvm", r"apache license v2\.0 with llvm exceptions"),
    # GPL family
    ("gpl", NOTICE, "redistribute&gnu", r"this (?:program|file|software|package) is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", NOTICE, "gnu&version", r"gnu general public license as published by the free software foundation[;,:] (?:either )?version 2 of the license"),
    ("gpl-3.0", NOTICE, "gnu&version", r"gnu general public license as published by the free software foundation[;,:] (?:either )?version 3 of the license"),
    ("gpl-2.0", NOTICE, "gnu&version", r"gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3.0", NOTICE, "gnu&version", r"gnu general public license version 3 as published by the free software foundation"),
    ("gpl-2.0", NOTICE, "gnu&version", r"under the terms of version 2 of the gnu general public license"),
    ("gpl-3.0", NOTICE, "gnu&version", r"under the terms of version 3 of the gnu general public license"),
    ("gpl", NOTICE, "hope&useful", r"this (?:program|file|software|package) is distributed in the hope that it will be useful, but without any warranty"),
    ("gpl", NOTICE, "gnu&received", r"you should have received a copy of the gnu general public license"),
    ("gpl", BODY, "verbatim&permitted", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("gpl-2.0", BODY, "designed&freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", BODY, "copyleft&gnu", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("gpl-3.0", BODY, "practical&works", r"the licenses for most software and other practical works are designed to take away your freedom"),
    ("gpl-2.0", NOTICE, "gpl", r"\bgpl ?v?-?2(?:\.0)?\+?(?![\w.])"),
    ("gpl-3.0", NOTICE, "gpl", r"\bgpl ?v?-?3(?:\.0)?\+?(?![\w.])"),
    ("lgpl-2.1", NOTICE, "lgpl", r"\blgpl ?v?-?2\.1\+?(?![\w.])"),
    ("lgpl-3.0", NOTICE, "lgpl", r"\blgpl ?v?-?3(?:\.0)?\+?(?![\w.])"),
    ("agpl-3.0", NOTICE, "agpl", r"\bagpl ?v?-?3(?:\.0)?\+?(?![\w.])"),
    ("classpath-exception-2.0", BODY, "exception&modules", r"as a special exception, the copyright holders of this library give you permission to link this library with independent modules"),
    ("lgpl", NOTICE, "library&redistribute", r"this library is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", NOTICE, "lesser&version", r"gnu lesser general public license as published by the free software foundation[;,:] (?:either )?version 2\.1 of the license"),
    ("lgpl-3.0", NOTICE, "lesser&version", r"gnu lesser general public license as published by the free software foundation[;,:] (?:either )?version 3 of the license"),
    ("lgpl", NOTICE, "lesser&received", r"you should have received a copy of the gnu lesser general public license"),
    ("lgpl-3.0", BODY, "lesser&incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl-3.0", NOTICE, "affero&version", r"gnu affero general public license as published by the free software foundation[;,:] (?:either )?version 3 of the license"),
    ("agpl-3.0", BODY, "network&server&cooperation", r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("gfdl", NOTICE, "documentation&gnu", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    # Mozilla, Eclipse, CDDL
    ("mpl-2.0", NOTICE, "mozilla", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("mpl-2.0", NOTICE, "mpl&obtain", r"if a copy of the mpl was not distributed with this file,? you can obtain one at"),
    ("mpl-2.0", BODY, "incompatible&secondary", r"this source code form is [\"'“]incompatible with secondary licenses[\"'”]"),
    ("mpl-1.1", NOTICE, "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl", NOTICE, "governing&limitations", r"see the license for the specific language governing rights and limitations under the license"),
    ("epl-1.0", NOTICE, "eclipse&accompanying", r"(?:this program and )?the accompanying materials are made available under the terms of the eclipse public license,? v(?:ersion)?\.? ?1\.0"),
    ("epl-2.0", NOTICE, "eclipse&accompanying", r"(?:this program and )?the accompanying materials are made available under the terms of the eclipse public license,? v(?:ersion)?\.? ?2\.0"),
    ("epl", BODY, "eclipse&accompanying", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("edl-1.0", NOTICE, "eclipse&distribution", r"eclipse distribution license,? (?:-|v|version)? ?v? ?1\.0"),
    ("cddl-1.0", NOTICE, "common&development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.0", NOTICE, "opensolaris", r"usr/src/opensolaris\.license"),
    ("cpl-1.0", BODY, "common&accompanying", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", NOTICE, "ibm", r"\bibm public license"),
    # zlib, Boost, public domain
    ("zlib", BODY, "as-is&liable", r"this software is provided [\"'“`]+as-is[\"'”]+, without any express or implied warranty\. in no event will the authors? be held liable"),
    ("zlib", BODY, "origin&misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", BODY, "altered&plainly", r"altered source versions must be plainly marked as such"),
    ("zlib", BODY, "notice&altered", r"this notice may not be removed or altered from any source distribution"),
    ("libpng", BODY, "png", r"this code is released under the libpng license"),
    ("bsl-1.0", NOTICE, "boost", r"boost software license - version 1\.0"),
    ("unlicense", BODY, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", BODY, "compile&sell", r"anyone is free to copy, modify, publish, use, compile, sell,? or distribute this software"),
    ("wtfpl", BODY, "verbatim&permitted", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed"),
    ("wtfpl", BODY, "fuck", r"you just do what the fuck you want to"),
    ("cc0-1.0", BODY, "waived&neighboring", r"waived all copyright and related or neighboring rights"),
    ("cc0-1.0", BODY, "deed&dedicated", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("public-domain", NOTICE, "public&domain", r"this (?:file|code|software|work|program) is in the public domain"),
    ("public-domain", NOTICE, "disclaims&copyright", r"the author disclaims copyright to this source code"),
    ("pddl-1.0", NOTICE, "domain&dedication", r"open data commons public domain dedication and licen[sc]e"),
    # Creative Commons deeds
    ("cc", BODY, "redistribute&medium", r"you are free to:? share (?:—|-) copy and redistribute the material in any medium or format"),
    ("cc-by", BODY, "appropriate&credit", r"you must give appropriate credit, provide a link to the license, and indicate if changes were made"),
    ("cc-by-nc", BODY, "material&commercial", r"you may not use the material for commercial purposes"),
    ("cc-by-sa", BODY, "remix&contributions", r"if you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", BODY, "remix&modified", r"if you remix, transform, or build upon the material, you may not distribute the modified material"),
    ("cc-by", NOTICE, "licensed&creative", r"licensed under an? creative commons attribution(?: [1-4]\.[05])?(?: international| unported)? licen[sc]e"),
    # languages and projects
    ("artistic-1.0", BODY, "package&intent", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", BODY, "establishes&package", r"this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed"),
    ("artistic-1.0", NOTICE, "perl&terms", r"under the same terms as perl(?: itself)?"),
    ("ofl-1.1", NOTICE, "font", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", BODY, "font&stimulate", r"the goals of the open font license \(ofl\) are to stimulate worldwide development of collaborative font projects"),
    ("ofl-1.1", BODY, "fonts&bundled", r"the fonts, including any derivative works, can be bundled, embedded, redistributed and/or sold"),
    ("python-2.0", BODY, "python&agreement", r"this license agreement is between the python software foundation"),
    ("php-3.01", BODY, "php&freely", r"this product includes php(?: software)?, freely available from"),
    ("php-3.01", BODY, "php&endorse", r"the name [\"'“]php[\"'”] must not be used to endorse or promote products derived from this software"),
    ("openssl", BODY, "openssl&project", r"this product includes software developed by the openssl project"),
    ("openssl", BODY, "cryptographic&eric", r"this product includes cryptographic software written by eric young"),
    ("ruby", BODY, "ruby&matsumoto", r"ruby is copyrighted free software by yukihiro matsumoto"),
    ("ruby", BODY, "verbatim&duplicate", r"you may make and give away verbatim copies of the source form of the software without restriction, provided that you duplicate all of the original copyright notices"),
    ("ms-pl", BODY, "accompanying&governs", r"this license governs use of the accompanying software\. if you use the software, you accept this license"),
    ("ms-rl", BODY, "reciprocal&grants", r"reciprocal grants ?- ?for any file you distribute that contains code from the software"),
    ("odbl-1.0", NOTICE, "database", r"is made available under the open database license"),
    ("odc-by-1.0", NOTICE, "commons&attribution", r"open data commons attribution licen[sc]e"),
    ("curl", NOTICE, "curl", r"\bcurl licen[sc]e"),
    ("vim", NOTICE, "vim", r"\bvim licen[sc]e"),
    ("tcl", BODY, "california&scriptics", r"this software is copyrighted by the regents of the university of california, sun microsystems, inc\., scriptics corporation"),
    ("w3c", NOTICE, "w3c", r"\bw3c(?:®)? software (?:and document )?notice and license"),
    ("unicode", NOTICE, "unicode", r"\bunicode,? inc\. licen[sc]e agreement"),
    ("imagemagick", NOTICE, "imagemagick", r"\bimagemagick licen[sc]e"),
    ("freetype", NOTICE, "freetype", r"\bfreetype (?:project )?licen[sc]e"),
    ("ijg", BODY, "independent&jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("info-zip", BODY, "info-zip", r"this is version [0-9-]+(?: of the)? info-zip (?:copyright and )?licen[sc]e"),
    ("nasa-1.3", NOTICE, "nasa", r"\bnasa open source agreement"),
    ("apsl-2.0", NOTICE, "apple", r"\bapple public source license"),
    ("cpal-1.0", NOTICE, "attribution&common", r"\bcommon public attribution license"),
    ("qpl-1.0", NOTICE, "public", r"\b(?:the )?q public license"),
    ("rpl-1.5", NOTICE, "reciprocal", r"\breciprocal public license"),
    ("spl-1.0", NOTICE, "sun", r"\bsun public license"),
    ("cecill", NOTICE, "cecill", r"\bcecill(?:-[bc])?(?:[- ]v?[12](?:\.[01])?)?\b"),
    ("mulanpsl-2.0", NOTICE, "mulan", r"\bmulan (?:permissive software license|psl),? ?v(?:ersion )?2"),
    ("eupl", NOTICE, "european", r"licensed under the european union public licen[sc]e"),
    ("ogl-3.0", NOTICE, "government", r"\bopen government licen[sc]e(?: v3(?:\.0)?)?"),
    ("etalab-2.0", NOTICE, "ouverte", r"licence ouverte(?: open licence)?(?: v?2\.0)?"),
    # source-available and proprietary
    ("sspl-1.0", BODY, "functionality&service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", BODY, "licensor&non-production", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work"),
    ("elastic-2.0", NOTICE, "elastic", r"\belastic license(?:,)? (?:version |v)?2(?:\.0)?"),
    ("elastic-2.0", BODY, "hosted&managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", NOTICE, "commons&clause", r"[\"'“]commons clause[\"'”] license condition|\bcommons clause licen[sc]e"),
    ("polyform", NOTICE, "polyform", r"\bpolyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use) licen[sc]e"),
    ("openrail", NOTICE, "rail", r"\b(?:creativeml |bigscience |bigcode )?open ?rail(?:-?[ms]+)?(?: licen[sc]e)?\b"),
    ("llama", NOTICE, "llama", r"\bllama [2-4](?:\.[0-9])? community license"),
    ("gemma", NOTICE, "gemma", r"\bgemma terms of use"),
    ("proprietary", BODY, "unauthorized&prohibited", r"unauthorized copying of this file, via any medium,? is strictly prohibited"),
    ("proprietary", BODY, "confidential&information", r"this software is the confidential and proprietary information of"),
    ("proprietary", BODY, "reproduced&written", r"may not be reproduced(?:,| or)? [^.;]{0,80}?without (?:the )?(?:prior |express )*written (?:permission|consent)"),
    ("proprietary", NOTICE, "proprietary&confidential", r"confidential and proprietary"),
    ("eula", NOTICE, "end&user", r"\bend[- ]user licen[sc]e agreement"),
]
