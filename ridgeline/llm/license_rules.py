"""The hand-written signature rules of the licence scan.

One rule a line: label | keywords | expression, over normalised words between single spaces. A text tries a rule only if one of
its keywords is among its words. Sections go from sure to vague; within one, the order is that of priority.
"""

from __future__ import annotations

#: Fragments that rules share.
FRAGMENTS = {
    "S": r"(?:licensed|released|distributed|available|published|provided|covered|redistributed|offered|shared) (?:\S+ ){0,3}?under (?:\S+ ){0,6}?",
    "T": r"under the terms of (?:\S+ ){0,4}?",
    "V": r"(?:licen[cs]e )?(?:v ?|version |ver )?",
    "L": r"(?: only| or later| or any later version)?",
    "I": r"spdx license identifier ",
}

#: Sections of rules with their scores.
SECTIONS = (
    ("text", 1.0, r"""
mit | granted | permission is hereby granted free of charge to any person obtaining a copy
mit-0 | granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
isc | hereby | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
bsd-3-clause | contributors | neither the name of (?:\S+ ){1,14}?nor the names of its contributors
bsd-3-clause | endorse | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | redistributions of source code must retain the (?:above )?copyright notice
apache | apache | you may obtain a copy of the license at https? www apache org licenses license 2 0
apache | compliance | you may not use this file except in compliance with the license
apache | apache | licensed to the apache software foundation asf under one or more contributor license agreements
apache | perpetual | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
gpl-or-later | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version \d of the license or at your option any later version
lgpl-or-later | redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation either version \d(?: \d)? of the license or at your option any later version
agpl-or-later | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
gpl | franklin | write to the free software foundation inc (?:\S+ ){1,8}?franklin (?:st|street) fifth floor
gpl | gnu | you should have received a copy of the gnu general public license along with
lgpl | gnu | you should have received a copy of the gnu (?:lesser|library) general public license along with
agpl | affero | you should have received a copy of the gnu affero general public license along with
gfdl | invariant | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gpl | copyleft | gnu general public license is a free copyleft license for software
mpl | subject | this source code form is subject to the terms of the mozilla public license
mpl | mozilla | the contents of this file are subject to the mozilla public license
epl | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
edl | eclipse | this program and the accompanying materials are made available under the terms of the eclipse distribution license
cddl | cddl development | the contents of this file are subject to the terms of the common development and distribution license
unlicense | unencumbered | this is free and unencumbered software released into the public domain
boost | machine | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | misrepresented | the origin of this software must not be misrepresented
wtfpl | wtfpl fuck | you just do what the fuck you want to
cc-by | creativecommons | to view a copy of this license visit https? creativecommons org licenses by \d
cc-by-sa | creativecommons | to view a copy of this license visit https? creativecommons org licenses by sa
cc-by-nc | creativecommons | to view a copy of this license visit https? creativecommons org licenses by nc \d
cc0 | waived | to the extent possible under law (?:\S+ ){1,12}?has waived all copyright and related or neighboring rights
cc0 | zero | creative commons (?:cc0 1 0 universal|zero) public domain dedication
artistic | artistic | the intent of this document is to state the conditions under which a package may be copied
ofl | fonts | the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ncsa | illinois | developed by (?:\S+ ){0,8}?university of illinois at urbana champaign
postgresql | paragraph | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
mit | consortium | except as contained in this notice the name of (?:\S+ ){1,8}?shall not be used in advertising
python | psf | psf hereby grants licensee a nonexclusive royalty free world wide license
academic-free | academic | licensed under the academic free license version
odbl | database | this (?:\S+ ){1,4}?is made available under the open database license
sspl | service | if you make the functionality of the program or a modified version available to third parties as a service
busl | change | effective on the change date or the fourth anniversary of the first publicly available distribution
commons-clause | commons | without limiting other conditions in the license the grant of rights under the license will not include (?:\S+ ){0,6}?the right to sell the software
beerware | beer | as long as you retain this notice you can do whatever you want with this stuff
json | evil | the software shall be used for good not evil
public-domain | dedicated | the authors? (?:\S+ ){0,6}?dedicates? (?:\S+ ){0,8}?to the public domain
proprietary | reproduced | no part of this (?:work|publication|document|book) may be reproduced
proprietary | confidential | this (?:software|document|file) contains (?:proprietary and )?confidential (?:and proprietary )?information
"""),
    ("identifier", 0.99, r"""
mit-0 | spdx | {I}mit 0
mit | spdx | {I}(?:mit|x11|expat)(?: cmu| modern variant)?
isc | spdx | {I}isc
apache | spdx | {I}apache2?(?: 1 0| 1 1| 2 0)?
agpl | spdx | {I}agpl(?:v3)?(?: 1 0| 3 0)?{L}
lgpl | spdx | {I}lgpl(?:v[23])?(?: 2 0| 2 1| 3 0)?{L}
gpl | spdx | {I}gpl(?:v[123])?(?: 1 0| 2 0| 3 0)?{L}(?: with \S+ exception(?: \S+){{0,2}})?
gfdl | spdx | {I}(?:gfdl|gnu fdl)(?: 1 [123])?{L}
bsd-2-clause | spdx | {I}(?:bsd 2 clause(?: patent| views)?|0bsd)
bsd-3-clause | spdx | {I}bsd 3 clause(?: clear| lbnl| attribution)?
bsd-4-clause | spdx | {I}bsd 4 clause(?: uc)?
bsd | spdx | {I}bsd(?: source code| protection| 1 clause)?
mpl | spdx | {I}mpl(?: 1 0| 1 1| 2 0)?(?: no copyleft exception)?
epl | spdx | {I}epl(?: [12] 0)?
edl | spdx | {I}(?:edl|bsd 3 clause eclipse)(?: 1 0)?
cpl | spdx | {I}cpl(?: 1 0)?
cddl | spdx | {I}cddl(?: 1 [01])?
eupl | spdx | {I}eupl(?: 1 [012])?
artistic | spdx | {I}(?:cl)?artistic(?: [12] 0)?(?: perl| cl8)?
zlib | spdx | {I}(?:zlib|libpng)(?: acknowledgement| 2 0)?
boost | spdx | {I}(?:bsl|boost)(?: 1 0)?
unlicense | spdx | {I}unlicense
wtfpl | spdx | {I}wtfpl
cc0 | spdx | {I}cc0 1 0
cc-by-nc-nd | spdx | {I}cc by nc nd \d \d
cc-by-nc-sa | spdx | {I}cc by nc sa \d \d
cc-by-nc | spdx | {I}cc by nc \d \d
cc-by-nd | spdx | {I}cc by nd \d \d
cc-by-sa | spdx | {I}cc by sa \d \d
cc-by | spdx | {I}cc by \d \d
odbl | spdx | {I}(?:odbl|open database)(?: 1 0)?
odc-by | spdx | {I}odc by 1 0
pddl | spdx | {I}pddl 1 0
ofl | spdx | {I}(?:sil )?ofl(?: 1 [01])?(?: rfn| no rfn)?
psf | spdx | {I}psf(?: 2 0)?
python | spdx | {I}(?:cnri )?python(?: \d(?: \d)*)?
php | spdx | {I}php(?: 3 (?:0|01))?
ruby | spdx | {I}ruby
postgresql | spdx | {I}postgresql
openssl | spdx | {I}(?:openssl|ssleay)
curl | spdx | {I}curl
ncsa | spdx | {I}ncsa
academic-free | spdx | {I}afl(?: \d \d)?
open-software | spdx | {I}osl(?: \d \d)?
ms-pl | spdx | {I}ms (?:pl|lpl)
ms-rl | spdx | {I}ms rl
upl | spdx | {I}upl(?: 1 0)?
mulan | spdx | {I}mulanpsl(?: [12] 0)?
cecill | spdx | {I}cecill (?:b|c|\d \d)
elastic | spdx | {I}elastic(?: 2 0)?
sspl | spdx | {I}sspl 1 0
busl | spdx | {I}busl 1 1
blueoak | spdx | {I}blueoak 1 0 0
vim | spdx | {I}vim
json | spdx | {I}json
beerware | spdx | {I}beerware
"""),
    ("statement", 0.95, r"""
mit-0 | mit | {S}mit (?:no attribution|0)
mit | mit | {S}mit(?: x11)?(?: licen[cs]e)?
mit | expat | {S}expat(?: licen[cs]e)?
mit | x11 | {S}x11(?: licen[cs]e)?
isc | isc | {S}isc(?: licen[cs]e)?
apache | apache asl | {S}(?:apache|asl)(?: software)? {V}(?:2 0|2|1 1|1 0)
apache | apache apache2 | {S}apache2?(?: software)?(?: licen[cs]e)?
agpl | affero agpl agplv3 | {S}(?:gnu )?(?:affero general public licen[cs]e|agpl(?:v3)?)(?: {V}[13](?: 0)?)?{L}
lgpl | lesser library lgpl lgplv2 lgplv3 | {S}(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl(?:v[23])?)(?: {V}[23](?: [01])?)?{L}
gpl | general gpl gplv1 gplv2 gplv3 | {S}(?:gnu )?(?:general public licen[cs]e|gpl(?:v[123])?)(?: {V}[123](?: 0)?)?{L}
gfdl | documentation gfdl fdl | {S}(?:gnu )?(?:free documentation licen[cs]e|g?fdl)(?: {V}1 [123])?{L}
bsd-2-clause | bsd freebsd | {S}(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?
bsd-3-clause | bsd | {S}(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-4-clause | bsd | {S}(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?
bsd | bsd | {S}bsd(?: style)?(?: licen[cs]e)?
mpl | mozilla mpl | {S}(?:mozilla public licen[cs]e|mpl)(?: {V}[12](?: [01])?)?
epl | eclipse epl | {S}(?:eclipse public licen[cs]e|epl)(?: {V}[12](?: 0)?)?
edl | eclipse edl | {S}(?:eclipse distribution licen[cs]e|edl)(?: {V}1 0)?
cpl | common cpl | {S}(?:common public licen[cs]e|cpl)(?: {V}1 0)?
cddl | cddl development | {S}(?:common development and distribution licen[cs]e|cddl)(?: {V}1 [01])?
eupl | eupl union | {S}(?:european union public licen[cs]e|eupl)(?: {V}1 [012])?
artistic | artistic clartistic | {S}(?:perl )?(?:clarified )?(?:cl)?artistic(?: licen[cs]e)?(?: {V}[12] 0)?
zlib | zlib libpng | {S}(?:zlib|libpng|zlib libpng)(?: licen[cs]e)?
boost | boost bsl | {S}(?:boost(?: software licen[cs]e)?|bsl)(?: {V}1 0)?
unlicense | unlicense | {S}unlicense
wtfpl | wtfpl | {S}wtfpl
cc0 | cc0 | {S}cc0(?: 1 0)?
cc-by-nc-nd | noncommercial commercial nc | {S}(?:creative commons|cc) (?:attribution|by) (?:noncommercial|non commercial|nc) (?:noderiv(?:ative)?s|no derivatives|nd)(?: {V}\d \d)?
cc-by-nc-sa | noncommercial commercial nc | {S}(?:creative commons|cc) (?:attribution|by) (?:noncommercial|non commercial|nc) (?:sharealike|share alike|sa)(?: {V}\d \d)?
cc-by-nc | noncommercial commercial nc | {S}(?:creative commons|cc) (?:attribution|by) (?:noncommercial|non commercial|nc)(?: {V}\d \d)?
cc-by-nd | noderivatives noderivs nd derivatives | {S}(?:creative commons|cc) (?:attribution|by) (?:noderiv(?:ative)?s|no derivatives|nd)(?: {V}\d \d)?
cc-by-sa | sharealike alike sa | {S}(?:creative commons|cc) (?:attribution|by) (?:sharealike|share alike|sa)(?: {V}\d \d)?
cc-by | attribution by | {S}(?:creative commons attribution|cc by)(?: {V}\d \d)?
odbl | database odbl | {S}(?:open database(?: licen[cs]e)?|odbl)(?: {V}1 0)?
odc-by | odc commons | {S}(?:open data commons attribution(?: licen[cs]e)?|odc by)
pddl | pddl | {S}pddl
ofl | font ofl | {S}(?:sil )?(?:open font licen[cs]e|ofl)(?: {V}1 [01])?
psf | psf python | {S}(?:psf|python software foundation)(?: licen[cs]e)?(?: {V}2)?
python | python | {S}(?:cnri )?python(?: licen[cs]e)?
php | php | {S}php(?: licen[cs]e)?(?: {V}3 0?1)?
ruby | ruby | {S}ruby(?: licen[cs]e| s licen[cs]e)?
postgresql | postgresql | {S}postgresql(?: licen[cs]e)?
openssl | openssl ssleay | {S}(?:openssl|ssleay)(?: licen[cs]e)?
curl | curl | {S}curl(?: licen[cs]e)?
ncsa | ncsa | {S}(?:university of illinois )?ncsa(?: open source licen[cs]e)?
academic-free | afl academic | {S}(?:academic free licen[cs]e|afl)(?: {V}\d \d)?
open-software | osl open | {S}(?:open software licen[cs]e|osl)(?: {V}\d \d)?
ms-pl | microsoft ms | {S}(?:microsoft public licen[cs]e|ms pl)
ms-rl | microsoft ms | {S}(?:microsoft reciprocal licen[cs]e|ms rl)
upl | upl permissive | {S}(?:universal permissive licen[cs]e|upl)(?: {V}1 0)?
mulan | mulan mulanpsl | {S}(?:mulan (?:permissive software licen[cs]e|psl)|mulanpsl)(?: {V}[12])?
cecill | cecill | {S}cecill(?: [bc])?
elastic | elastic | {S}elastic(?: licen[cs]e)?(?: {V}[12](?: 0)?)?
sspl | sspl | {S}(?:server side public licen[cs]e|sspl)
busl | busl business | {S}(?:business source licen[cs]e|busl)(?: {V}1 1)?
openrail | openrail | {S}(?:\S+ )?openrail(?: m)?
proprietary | proprietary | {S}(?:\S+ )?proprietary licen[cs]e
gpl | gnu | {T}gnu general public licen[cs]e
lgpl | gnu | {T}gnu (?:lesser|library) general public licen[cs]e
mpl | mozilla | {T}mozilla public licen[cs]e
epl | eclipse | {T}eclipse public licen[cs]e
"""),
    ("versioned", 0.9, r"""
apache | apache | apache(?: software)? licen[cs]e (?:v ?|version |ver )?2(?: 0)?
apache | apache | apache(?: software)? licen[cs]e (?:v ?|version |ver )?1 [01]
apache | asl | asl (?:v ?|version )?2 0
agpl | affero | (?:gnu )?affero general public licen[cs]e (?:v ?|version )?[13](?: 0)?{L}
agpl | agpl agplv3 | (?:gnu )?agpl(?:v3| v3| 3 0| version 3){L}
lgpl | lesser library | (?:gnu )?(?:lesser|library) general public licen[cs]e (?:v ?|version )?[23](?: [01])?{L}
lgpl | lgpl lgplv2 lgplv3 | (?:gnu )?lgpl(?:v[23]| v ?[23]| version [23]| [23])(?: [01])?{L}
gpl | general | (?:gnu )?general public licen[cs]e (?:v ?|version )?[123](?: 0)?{L}
gpl | gpl gplv2 gplv3 gplv1 | (?:gnu )?gpl(?:v[123]| v ?[123]| version [123]| [123])(?: 0)?{L}
gfdl | documentation | (?:gnu )?free documentation licen[cs]e (?:v ?|version )?1 [123]
mpl | mozilla | mozilla public licen[cs]e (?:v ?|version )?[12](?: [01])?
mpl | mpl | mpl (?:v ?|version )?[12] [01]
epl | eclipse | eclipse public licen[cs]e (?:v ?|version )?[12](?: 0)?
epl | epl | epl (?:v ?|version )?[12] 0
cddl | cddl | cddl (?:v ?|version )?1 [01]
eupl | eupl | eupl (?:v ?|version )?1 [012]
artistic | artistic | artistic licen[cs]e (?:v ?|version )?[12](?: 0)?
boost | boost | boost software licen[cs]e (?:v ?|version )?1 0
cc-by-nc-nd | nd | cc by nc nd \d \d
cc-by-nc-sa | nc | cc by nc sa \d \d
cc-by-nc | nc | cc by nc \d \d
cc-by-nd | nd | cc by nd \d \d
cc-by-sa | sa | cc by sa \d \d
cc-by | cc | cc by \d \d
cc-by-sa | sharealike alike | creative commons attribution (?:sharealike|share alike) \d \d
cc-by | attribution | creative commons attribution \d \d
ofl | font | (?:sil )?open font licen[cs]e (?:v ?|version )?1 [01]
odbl | database | open database licen[cs]e (?:odbl )?(?:v ?|version )?1 0
php | php | php licen[cs]e (?:v ?|version )?3 0?1?
academic-free | academic | academic free licen[cs]e (?:v ?|version )?\d \d
open-software | open | open software licen[cs]e (?:v ?|version )?\d \d
mulan | mulan | mulan psl (?:v ?|version )?[12]
elastic | elastic | elastic licen[cs]e (?:v ?|version )?[12](?: 0)?
busl | business | business source licen[cs]e (?:v ?|version )?1 1
sspl | sspl | sspl (?:v ?|version )?1
"""),
    ("name", 0.7, r"""
mit | mit | (?:the )?mit(?: x11)? licen[cs]e
mit | expat | expat licen[cs]e
mit | x11 | x11 licen[cs]e
isc | isc | isc licen[cs]e
isc | consortium | internet systems consortium licen[cs]e
apache | apache | apache(?: software)? licen[cs]e
agpl | affero | (?:gnu )?affero general public licen[cs]e
lgpl | lesser library | (?:gnu )?(?:lesser|library) general public licen[cs]e
gpl | general | (?:gnu )?general public licen[cs]e
agpl | agpl | gnu agpl
lgpl | lgpl | gnu lgpl
gpl | gpl | gnu gpl
gfdl | documentation | (?:gnu )?free documentation licen[cs]e
bsd-2-clause | bsd | bsd 2 clause(?: licen[cs]e)?
bsd-2-clause | clause | (?:2|two) clause bsd(?: licen[cs]e)?
bsd-2-clause | simplified | simplified bsd licen[cs]e
bsd-2-clause | freebsd | freebsd licen[cs]e
bsd-3-clause | bsd | bsd 3 clause(?: licen[cs]e)?
bsd-3-clause | clause | (?:3|three) clause bsd(?: licen[cs]e)?
bsd-3-clause | bsd | (?:new|modified|revised) bsd licen[cs]e
bsd-4-clause | bsd | (?:bsd 4 clause|(?:4|four) clause bsd|original bsd licen[cs]e)
bsd | bsd | bsd(?: style)? licen[cs]e
bsd | berkeley | berkeley software distribution licen[cs]e
mpl | mozilla | mozilla public licen[cs]e
epl | eclipse | eclipse public licen[cs]e
edl | eclipse | eclipse distribution licen[cs]e
cpl | common | common public licen[cs]e
cddl | development | common development and distribution licen[cs]e
eupl | union | european union public licen[cs]e
artistic | artistic | (?:clarified )?artistic licen[cs]e
zlib | zlib | zlib(?: libpng)? licen[cs]e
zlib | libpng | libpng licen[cs]e
boost | boost | boost software licen[cs]e
unlicense | unlicense | the unlicense
cc0 | cc0 | cc0 1 0(?: universal)?
cc0 | zero | creative commons zero
cc-by-nc-nd | commons | creative commons attribution (?:noncommercial|non commercial) (?:noderiv(?:ative)?s|no derivatives)
cc-by-nc-sa | commons | creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike)
cc-by-nc | commons | creative commons attribution (?:noncommercial|non commercial)
cc-by-nd | commons | creative commons attribution (?:noderiv(?:ative)?s|no derivatives)
cc-by-sa | commons | creative commons attribution (?:sharealike|share alike)
cc-by | commons | creative commons attribution licen[cs]e
odbl | database | open database licen[cs]e
odc-by | commons | open data commons attribution licen[cs]e
pddl | dedication | open data commons public domain dedication and licen[cs]e
ofl | font | (?:sil )?open font licen[cs]e
psf | python | python software foundation licen[cs]e
python | python | python licen[cs]e
php | php | php licen[cs]e
ruby | ruby | ruby licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
openssl | openssl | openssl licen[cs]e
openssl | ssleay | ssleay licen[cs]e
curl | curl | curl licen[cs]e
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[cs]e
academic-free | academic | academic free licen[cs]e
open-software | open | open software licen[cs]e
ms-pl | microsoft | microsoft public licen[cs]e
ms-rl | microsoft | microsoft reciprocal licen[cs]e
upl | permissive | universal permissive licen[cs]e
mulan | mulan | mulan permissive software licen[cs]e
cecill | cecill | cecill (?:free software licen[cs]e|[bc]|\d \d)
elastic | elastic | elastic licen[cs]e
sspl | server | server side public licen[cs]e
busl | business | business source licen[cs]e
openrail | responsible | responsible ai licen[cs]e
openrail | openrail | openrail m
beerware | beerware | beerware licen[cs]e
blueoak | blue | blue oak model licen[cs]e
vim | vim | vim licen[cs]e
commons-clause | clause | commons clause
proprietary | reserved | all rights reserved
proprietary | proprietary | proprietary licen[cs]e
proprietary | confidential | proprietary and confidential
public-domain | domain | (?:dedicated to|released into|placed in|in) the public domain
"""),
)
