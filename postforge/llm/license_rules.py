"""Hand-written licence signature rules over normalised words.

A rule is (label, priority, keyword, pattern). Patterns see lower-cased words
joined by single spaces and match whole words. The keyword must occur in the
text before the pattern is tried. Priority 3 is a grant or notice, 2 a named
licence, 1 a tag or weak reference.
"""

from __future__ import annotations

RULES: tuple[tuple[str, int, str, str], ...] = (
    # MIT and relatives
    ("mit", 3, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 3, "mit", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit licen[cs]e"),
    ("mit", 2, "mit", r"(?:the )?mit licen[cs]ed?"),
    ("mit", 2, "expat", r"(?:the )?expat licen[cs]e"),
    ("mit", 1, "mit", r"licen[cs]e mit"),
    ("mit", 1, "mit", r"spdx license identifier mit"),
    ("mit", 1, "opensource", r"opensource org licenses mit(?: php)?"),
    ("mit-0", 2, "mit", r"mit (?:no attribution|0) licen[cs]e"),
    ("x11", 2, "x11", r"(?:the )?x11 licen[cs]e"),
    ("x11", 3, "x consortium", r"except as contained in this notice the name of the x consortium shall not be used"),
    ("isc", 3, "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 2, "isc", r"(?:the )?isc licen[cs]e"),
    ("isc", 1, "isc", r"spdx license identifier isc"),
    ("0bsd", 2, "0bsd", r"0bsd(?: licen[cs]e)?"),
    ("0bsd", 2, "zero clause", r"(?:bsd )?zero clause (?:bsd )?licen[cs]e"),
    ("zlib", 3, "as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", 2, "zlib", r"(?:the )?zlib(?: libpng)? licen[cs]e"),
    ("libpng", 2, "libpng", r"(?:the )?libpng licen[cs]e"),
    ("boost", 2, "boost", r"boost software licen[cs]e(?: version)?(?: 1 0)?"),
    ("boost", 1, "bsl", r"spdx license identifier bsl 1 0"),
    ("boost", 1, "boost org", r"www boost org license 1 0 txt"),
    ("ncsa", 2, "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e"),
    ("curl", 2, "curl", r"(?:the )?curl licen[cs]e"),
    ("python-2", 2, "python software foundation", r"python software foundation licen[cs]e(?: agreement)?(?: for python)?(?: version 2)?"),
    ("python-2", 2, "psf licen", r"psf licen[cs]e(?: agreement)?(?: for python)?(?: version 2)?"),
    ("cnri-python", 2, "cnri", r"cnri (?:open source )?(?:python )?licen[cs]e(?: agreement)?"),
    ("ruby", 2, "ruby", r"(?:the )?ruby licen[cs]e"),
    ("php-3", 2, "php", r"(?:the )?php licen[cs]e(?: version)?(?: 3 0[01]?)?"),
    ("postgresql", 2, "postgresql", r"(?:the )?postgresql licen[cs]e"),
    ("openssl", 2, "openssl", r"(?:the )?openssl(?: ssleay)? licen[cs]e"),
    ("vim", 2, "vim", r"(?:the )?vim licen[cs]e"),
    ("icu", 2, "icu", r"(?:the )?icu licen[cs]e"),
    ("unicode", 2, "unicode", r"unicode (?:data files and software )?licen[cs]e(?: agreement)?(?: v3)?"),
    ("w3c", 2, "w3c", r"w3c (?:r )?(?:software|document)(?: notice and)?(?: and document)? licen[cs]e"),
    ("beerware", 2, "beer", r"(?:the )?beer ?ware licen[cs]e(?: revision 42)?"),
    ("wtfpl", 2, "wtfpl", r"(?:the )?wtfpl(?: version 2| v2)?(?: licen[cs]e)?"),
    ("wtfpl", 2, "what the fuck", r"do what the fuck you want to public licen[cs]e"),
    ("unlicense", 2, "unlicen", r"(?:the )?unlicen[cs]e"),
    ("unlicense", 3, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("fair", 2, "fair licen", r"(?:the )?fair licen[cs]e"),
    ("json", 3, "good not evil", r"the software shall be used for good not evil"),
    ("imagemagick", 2, "imagemagick", r"(?:the )?imagemagick licen[cs]e"),
    ("freetype", 2, "freetype", r"(?:the )?freetype (?:project )?licen[cs]e"),
    ("ijg", 2, "jpeg group", r"independent jpeg group licen[cs]e"),
    ("naumen", 2, "naumen", r"naumen public licen[cs]e"),
    ("afl-3", 2, "academic free", r"academic free licen[cs]e(?: version| v)?(?: [123] [012])?"),
    ("ecl-2", 2, "educational community", r"educational community licen[cs]e(?: version)?(?: 2 0)?"),
    ("upl-1", 2, "universal permissive", r"universal permissive licen[cs]e(?: v| version)?(?: 1 0)?"),
    ("mulan-2", 2, "mulan", r"mulan (?:permissive software licen[cs]e|psl) (?:version 2|v2)"),
    ("blueoak-1", 2, "blue oak", r"blue oak model licen[cs]e(?: 1 0 0)?"),
    # Apache
    ("apache-2", 3, "apache", r"licensed under the apache license version 2 0"),
    ("apache-2", 2, "apache", r"apache (?:software )?(?:public )?licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("apache-2", 1, "apache", r"spdx license identifier apache 2 0"),
    ("apache-2", 1, "apache", r"apache 2(?: 0)? licen[cs]ed?"),
    ("apache-2", 1, "apache", r"(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-1.1", 2, "apache", r"apache (?:software )?licen[cs]e(?: version| v)? 1 1"),
    ("apache-1.0", 2, "apache", r"apache (?:software )?licen[cs]e(?: version| v)? 1 0"),
    ("apache", 1, "apache", r"apache (?:software )?licen[cs]ed?"),
    # BSD
    ("bsd-3", 3, "neither the name", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd", 3, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-4", 3, "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-4", 2, "bsd", r"(?:original|4 clause|four clause) bsd licen[cs]e"),
    ("bsd-4", 2, "bsd", r"bsd 4 clause(?: original)?(?: licen[cs]e)?"),
    ("bsd-3", 2, "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd licen[cs]e"),
    ("bsd-3", 2, "bsd", r"bsd 3 clause(?: new| revised)?(?: licen[cs]e)?"),
    ("bsd-2", 2, "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e"),
    ("bsd-2", 2, "bsd", r"bsd 2 clause(?: simplified)?(?: licen[cs]e)?"),
    ("bsd-2", 2, "freebsd", r"(?:the )?freebsd licen[cs]e"),
    ("bsd", 1, "bsd", r"(?:the )?bsd(?: style)? licen[cs]ed?"),
    ("bsd", 1, "bsd", r"under (?:the )?(?:terms of the )?bsd"),
    # GNU
    ("gpl-3", 3, "general public", r"licensed under the gnu general public license version 3"),
    ("gpl-2", 3, "general public", r"licensed under the gnu general public license version 2"),
    ("gpl-3", 2, "general public", r"(?:the )?(?:gnu )?general public licen[cs]e(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)?"),
    ("gpl-2", 2, "general public", r"(?:the )?(?:gnu )?general public licen[cs]e(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2(?: 0)?"),
    ("gpl-1", 2, "general public", r"(?:the )?(?:gnu )?general public licen[cs]e(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v) ?1(?: 0)?"),
    ("gpl-3-or-later", 3, "general public", r"general public licen[cs]e(?: as published by the free software foundation)? either version 3 of the licen[cs]e or at your option any later version"),
    ("gpl-2-or-later", 3, "general public", r"general public licen[cs]e(?: as published by the free software foundation)? either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-3-or-later", 1, "gpl", r"gpl ?v?3(?: 0)? or later"),
    ("gpl-2-or-later", 1, "gpl", r"gpl ?v?2(?: 0)? or later"),
    ("gpl-3-only", 1, "gpl", r"gpl ?v?3(?: 0)? only"),
    ("gpl-2-only", 1, "gpl", r"gpl ?v?2(?: 0)? only"),
    ("gpl-3", 1, "gpl", r"(?:gnu )?gpl(?: version| v)? ?3(?: 0)?"),
    ("gpl-3", 1, "gplv3", r"(?:gnu )?gplv3"),
    ("gpl-2", 1, "gpl", r"(?:gnu )?gpl(?: version| v)? ?2(?: 0)?"),
    ("gpl-2", 1, "gplv2", r"(?:gnu )?gplv2"),
    ("gpl", 1, "general public", r"(?:the )?(?:gnu )?general public licen[cs]e"),
    ("gpl", 1, "gpl", r"under (?:the )?(?:terms of the )?(?:gnu )?gpl"),
    ("gpl", 1, "gpl", r"gpl licen[cs]ed?"),
    ("gpl", 1, "gnu org", r"(?:www )?gnu org licenses gpl(?: 3 0)?(?: html| txt)?"),
    ("gpl-classpath", 2, "classpath", r"(?:gpl|general public licen[cs]e)(?: version 2)? with (?:the )?classpath exception"),
    ("gcc-exception", 2, "runtime library exception", r"gcc runtime library exception(?: version 3 1)?"),
    ("font-exception", 2, "font", r"gpl(?: version 2)? with font exception"),
    ("autoconf-exception", 2, "autoconf", r"autoconf (?:configure script )?exception"),
    ("lgpl-3", 2, "lesser general public", r"(?:the )?(?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)?"),
    ("lgpl-2.1", 2, "lesser general public", r"(?:the )?(?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2 1"),
    ("lgpl-2", 2, "library general public", r"(?:the )?(?:gnu )?library general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?:(?: version| v)? 2(?: 0)?)?"),
    ("lgpl", 2, "lesser general public", r"(?:the )?(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl-3", 1, "lgpl", r"(?:gnu )?lgpl ?v?3(?: 0)?(?: or later| only)?"),
    ("lgpl-2.1", 1, "lgpl", r"(?:gnu )?lgpl ?v?2 1(?: or later| only)?"),
    ("lgpl-3", 1, "lgplv3", r"(?:gnu )?lgplv3"),
    ("lgpl", 1, "lgpl", r"(?:gnu )?lgpl(?: licen[cs]ed?)?"),
    ("agpl-3", 2, "affero", r"(?:the )?(?:gnu )?affero general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?:(?: version| v)? 3(?: 0)?)?"),
    ("agpl-1", 2, "affero", r"affero general public licen[cs]e(?: version| v) 1"),
    ("agpl-3", 1, "agpl", r"(?:gnu )?agpl ?v?3(?: 0)?(?: or later| only)?"),
    ("agpl-3", 1, "agplv3", r"(?:gnu )?agplv3"),
    ("gfdl-1.3", 2, "free documentation", r"(?:gnu )?free documentation licen[cs]e(?: version| v) 1 3"),
    ("gfdl-1.2", 2, "free documentation", r"(?:gnu )?free documentation licen[cs]e(?: version| v) 1 2"),
    ("gfdl", 2, "free documentation", r"(?:the )?(?:gnu )?free documentation licen[cs]e"),
    ("gfdl", 1, "gfdl", r"(?:gnu )?gfdl"),
    ("sspl-1", 2, "server side public", r"server side public licen[cs]e(?: version| v)?(?: 1)?"),
    ("sspl-1", 1, "sspl", r"sspl(?: 1 0| v1)?"),
    # Mozilla, Eclipse and other weak copyleft
    ("mpl-2", 3, "mozilla public", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 2, "mozilla public", r"mozilla public licen[cs]e(?: version| v)? 2(?: 0)?"),
    ("mpl-1.1", 2, "mozilla public", r"mozilla public licen[cs]e(?: version| v)? 1 1"),
    ("mpl-1.0", 2, "mozilla public", r"mozilla public licen[cs]e(?: version| v)? 1 0"),
    ("mpl", 1, "mozilla public", r"(?:the )?mozilla public licen[cs]e"),
    ("mpl-2", 1, "mpl", r"mpl ?v?2(?: 0)?"),
    ("mpl-1.1", 1, "mpl", r"mpl ?v?1 1"),
    ("npl", 2, "netscape", r"netscape public licen[cs]e(?: version)?(?: 1 [01])?"),
    ("epl-2", 2, "eclipse public", r"eclipse public licen[cs]e(?: version| v)? 2(?: 0)?"),
    ("epl-1", 2, "eclipse public", r"eclipse public licen[cs]e(?: version| v)? 1(?: 0)?"),
    ("epl", 1, "eclipse public", r"(?:the )?eclipse public licen[cs]e"),
    ("epl-2", 1, "epl", r"epl ?v?2(?: 0)?"),
    ("edl-1", 2, "eclipse distribution", r"eclipse distribution licen[cs]e(?: version| v)?(?: 1 0)?"),
    ("cddl-1.1", 2, "common development", r"common development and distribution licen[cs]e(?: cddl)?(?: version)? 1 1"),
    ("cddl-1", 2, "common development", r"common development and distribution licen[cs]e(?: cddl)?(?: version)?(?: 1 0)?"),
    ("cddl", 1, "cddl", r"cddl(?: 1 [01])?"),
    ("cpl-1", 2, "common public", r"common public licen[cs]e(?: version| v)?(?: 1 0)?"),
    ("cpal-1", 2, "common public attribution", r"common public attribution licen[cs]e(?: version)?(?: 1 0)?"),
    ("ipl-1", 2, "ibm public", r"ibm public licen[cs]e(?: version)?(?: 1 0)?"),
    ("eupl-1.2", 2, "european union public", r"european union public licen[cs]e(?: eupl)?(?: version| v)?(?: 1 2)?"),
    ("eupl-1.1", 2, "european union public", r"european union public licen[cs]e(?: eupl)?(?: version| v)? 1 1"),
    ("eupl", 1, "eupl", r"eupl(?: 1 [12])?"),
    ("osl-3", 2, "open software licen", r"open software licen[cs]e(?: version| v)?(?: [123] [01])?"),
    ("ms-pl", 2, "microsoft public", r"microsoft public licen[cs]e(?: ms pl)?"),
    ("ms-rl", 2, "microsoft reciprocal", r"microsoft reciprocal licen[cs]e(?: ms rl)?"),
    ("apsl-2", 2, "apple public", r"apple public source licen[cs]e(?: version)?(?: [12] [012])?"),
    ("artistic-2", 2, "artistic", r"artistic licen[cs]e(?: version)? 2(?: 0)?"),
    ("artistic-1", 2, "artistic", r"artistic licen[cs]e(?: version)? 1(?: 0)?"),
    ("artistic", 1, "artistic", r"(?:the )?artistic licen[cs]e"),
    ("perl", 2, "perl itself", r"under the same terms as perl itself"),
    ("qpl-1", 2, "q public", r"q public licen[cs]e(?: version)?(?: 1 0)?"),
    ("sleepycat", 2, "sleepycat", r"sleepycat licen[cs]e"),
    ("sissl", 2, "sun industry", r"sun industry standards source licen[cs]e"),
    ("spl-1", 2, "sun public", r"sun public licen[cs]e(?: version)?(?: 1 0)?"),
    ("nasa-1.3", 2, "nasa open source", r"nasa open source agreement(?: version)?(?: 1 3)?"),
    ("cecill-2.1", 2, "cecill", r"cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: version| v)? 2 1"),
    ("cecill-b", 2, "cecill", r"cecill b(?: licen[cs]e)?"),
    ("cecill-c", 2, "cecill", r"cecill c(?: licen[cs]e)?"),
    ("cecill", 1, "cecill", r"cecill(?: licen[cs]e)?"),
    ("lppl-1.3c", 2, "latex project", r"latex project public licen[cs]e(?: version)?(?: 1 3[abc]?)?"),
    ("lppl", 1, "lppl", r"lppl(?: 1 3[abc]?)?"),
    ("ofl-1.1", 2, "open font", r"(?:sil )?open font licen[cs]e(?: version| v)?(?: 1 1)?"),
    ("ofl-1.1", 1, "ofl", r"(?:sil )?ofl(?: 1 1)?"),
    ("erlpl-1.1", 2, "erlang", r"erlang public licen[cs]e(?: version)?(?: 1 1)?"),
    ("zpl-2.1", 2, "zope", r"zope public licen[cs]e(?: zpl)?(?: version)?(?: [12] [01])?"),
    ("interbase-1", 2, "interbase", r"interbase public licen[cs]e(?: v| version)?(?: 1 0)?"),
    ("rpl-1.5", 2, "reciprocal public", r"reciprocal public licen[cs]e(?: version)?(?: 1 [135])?"),
    ("motosoto", 2, "motosoto", r"motosoto open source licen[cs]e"),
    ("nokia-1.0a", 2, "nokia", r"nokia open source licen[cs]e(?: version)?(?: 1 0a?)?"),
    ("realnetworks-1", 2, "realnetworks", r"realnetworks public source licen[cs]e(?: v| version)?(?: 1 0)?"),
    ("sugarcrm-1.1", 2, "sugarcrm", r"sugarcrm public licen[cs]e(?: v| version)?(?: 1 1 3)?"),
    ("ypl-1.1", 2, "yahoo", r"yahoo public licen[cs]e(?: v| version)?(?: 1 [01])?"),
    # Creative Commons: words, tags and addresses
    ("cc-by-nc-nd", 3, "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", 3, "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-nc", 3, "creative commons", r"creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-nd", 3, "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-sa", 3, "creative commons", r"creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by", 3, "creative commons", r"creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    ("cc0", 3, "creative commons", r"creative commons (?:cc0|zero)(?: v)?(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc-pdm", 2, "public domain mark", r"(?:creative commons )?public domain mark(?: 1 0)?"),
    ("cc", 1, "creative commons", r"(?:under (?:a )?)?creative commons(?: licen[cs]ed?)?"),
    ("cc-by-nc-nd", 2, "cc by nc nd", r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", 2, "cc by nc sa", r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc", 2, "cc by nc", r"(?:licensed under )?cc by nc(?: [1234] [05])?"),
    ("cc-by-nd", 2, "cc by nd", r"cc by nd(?: [1234] [05])?"),
    ("cc-by-sa", 2, "cc by sa", r"cc by sa(?: [1234] [05])?"),
    ("cc-by", 2, "cc by", r"(?:licensed under )?cc by(?: [1234] [05])?"),
    ("cc0", 2, "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", 1, "creativecommons", r"creativecommons org licenses by nc nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", 1, "creativecommons", r"creativecommons org licenses by nc sa(?: [1234] [05])?"),
    ("cc-by-nc", 1, "creativecommons", r"creativecommons org licenses by nc(?: [1234] [05])?"),
    ("cc-by-nd", 1, "creativecommons", r"creativecommons org licenses by nd(?: [1234] [05])?"),
    ("cc-by-sa", 1, "creativecommons", r"creativecommons org licenses by sa(?: [1234] [05])?"),
    ("cc-by", 1, "creativecommons", r"creativecommons org licenses by(?: [1234] [05])?"),
    ("cc0", 1, "creativecommons", r"creativecommons org publicdomain zero(?: 1 0)?"),
    # data and model licences
    ("odbl-1", 2, "open database", r"(?:open data commons )?open database licen[cs]e(?: odbl)?(?: v| version)?(?: 1 0)?"),
    ("odc-by-1", 2, "open data commons", r"open data commons attribution licen[cs]e(?: odc by)?(?: v| version)?(?: 1 0)?"),
    ("pddl-1", 2, "public domain dedication", r"(?:open data commons )?public domain dedication and licen[cs]e(?: pddl)?"),
    ("cdla-permissive-2", 2, "community data", r"community data licen[cs]e agreement permissive(?: version)?(?: [12] 0)?"),
    ("cdla-sharing-1", 2, "community data", r"community data licen[cs]e agreement sharing(?: version)?(?: 1 0)?"),
    ("ogl-uk-3", 2, "open government", r"open government licen[cs]e(?: v| version)?(?: [123] 0)?"),
    ("etalab-2", 2, "etalab", r"(?:licence ouverte )?etalab(?: open licen[cs]e)?(?: version)?(?: 2 0)?"),
    ("dl-de-by-2", 2, "datenlizenz", r"datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?"),
    ("openrail", 2, "rail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: m| d)? licen[cs]e"),
    ("elastic-2", 2, "elastic", r"elastic licen[cs]e(?:(?: v| version)? 2(?: 0)?)?"),
    ("busl-1.1", 2, "business source", r"business source licen[cs]e(?: version)?(?: 1 1)?"),
    ("polyform-nc", 2, "polyform", r"polyform noncommercial licen[cs]e(?: 1 0 0)?"),
    ("polyform-sb", 2, "polyform", r"polyform small business licen[cs]e(?: 1 0 0)?"),
    ("commons-clause", 2, "commons clause", r"commons clause(?: licen[cs]e)?(?: condition)?(?: v1 0)?"),
    ("parity-7", 2, "parity", r"parity public licen[cs]e(?: 7 0 0)?"),
    # dedications, reservations and weak signs
    ("public-domain", 3, "public domain", r"(?:released|placed|dedicated|donated|put) (?:into|in|to) the public domain"),
    ("public-domain", 1, "public domain", r"(?:is |are )?in the public domain"),
    ("proprietary", 3, "rights reserved", r"all rights reserved"),
    ("proprietary", 3, "alle rechte", r"alle rechte vorbehalten"),
    ("proprietary", 3, "tous droits", r"tous droits réservés"),
    ("proprietary", 3, "todos los derechos", r"todos los derechos reservados"),
    ("proprietary", 3, "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 2, "no part of this", r"no part of this .{1,60}? may be reproduced"),
    ("proprietary", 2, "written permission", r"without (?:the )?(?:prior )?(?:express )?written permission"),
    ("proprietary", 2, "unauthorized", r"unauthorized (?:copying|reproduction|distribution)(?: or distribution)?"),
    ("proprietary", 2, "end user", r"end user licen[cs]e agreement"),
    ("proprietary", 1, "eula", r"eula"),
    ("proprietary", 1, "commercial licen", r"commercial licen[cs]e(?: agreement)?"),
    ("warranty-disclaimer", 1, "without warranty", r"without warranty of any kind(?: express or implied)?"),
    ("warranty-disclaimer", 1, "merchantability", r"(?:implied )?warranty of merchantability(?: or fitness for a particular purpose)?"),
    ("copyright", 1, "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("spdx", 1, "spdx", r"spdx license identifier [0-9a-z]+"),
    ("unknown-reference", 1, "license", r"(?:see|read) (?:the )?license(?: file)?(?: txt| md)? for (?:details|more information|the full text)"),
    ("unknown-reference", 1, "licen", r"licen[cs]ed under (?:a |the )?(?:following|terms of)"),
    ("dual", 1, "dual", r"dual licen[cs]ed(?: under)?"),
)
