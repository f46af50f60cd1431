"""Signature rules of licenses, one by one: texts, notices, headers, names, addresses and identifiers as people write them.

A line of a group is ``priority keyword: expression``; a group's heading is its label. An expression is matched against lower-case
words with one space between, from the begin of a word to the end of one. It isn't tried unless the keyword stands in the
text, and no text is looked at that holds none of the stems.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: One of these is part of each keyword.
STEMS = (
    "licen", "spdx", "copyright", "permission", "redistribut", "public domain", "all rights", "warrant", "gpl", "general public", "apache", "mozilla", "creative", "cc by", "cc0",
    "boost software", "mit x11", "under mit", "bsd", "sell copies", "proprietary", "confidential", "open font", "wtfpl", "do what the", "beerware", "freely", "eclipse public", "common development",
    "eupl", "open database", "dedicate", "advertising", "misrepresented", "openssl", "prohibited",
)

RULES_TEXT = r"""
mit
100 spdx license identifier mit: spdx license identifier mit(?! 0)
90 mit license: licen[cs]ed under (?:the )?(?:terms of (?:the )?)?mit license
90 mit license: (?:released|distributed|published|available|provided|shared|contributed) under (?:the )?(?:terms of (?:the )?)?mit license
85 mit license: (?:the )?mit license mit
80 under mit: (?:released|distributed|published|available|provided|licen[cs]ed) under mit
80 mit license: (?:see|read) (?:the )?(?:file )?license(?: file| txt| md)? for (?:the )?(?:full )?mit license
75 permission is hereby granted: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
70 sell copies: use copy modify merge publish distribute sublicense and or sell copies of the software
65 copyright notice and this permission: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
70 licenses mit: (?:opensource org|choosealicense com|spdx org) licenses mit
60 mit licen: mit licen[cs]ed?
60 mit licen: (?:use of this source code is|code is|project is) governed by (?:an |the )?mit licen[cs]e
55 license mit: license mit

mit-0
100 spdx license identifier mit 0: spdx license identifier mit 0
90 mit no attribution license: (?:licen[cs]ed under |released under )?(?:the )?mit no attribution license
90 mit 0 license: (?:licen[cs]ed under |released under )?(?:the )?mit 0 license

x11
100 spdx license identifier x11: spdx license identifier x11
80 mit x11: (?:the )?mit x11(?: style)? licen[cs]e
70 shall not be used in advertising: except as contained in this notice the names? of .{1,60} shall not be used in advertising or otherwise to promote the sale

apache-1.1
100 spdx license identifier apache 1: spdx license identifier apache 1 [01]
90 apache software license: (?:the )?apache software license version 1 [01]
85 apache license: (?:the )?apache license version 1 [01]
70 apache: the names? apache(?: server| software foundation)? (?:and .{1,40} )?must not be used to endorse or promote products

apache-2
100 spdx license identifier apache 2: spdx license identifier apache 2 0
95 apache license: licen[cs]ed under (?:the )?(?:terms of (?:the )?)?apache license version 2(?: 0)?(?: the license)?
90 apache license: (?:released|distributed|published|available|provided|shared|contributed) under (?:the )?(?:terms of (?:the )?)?apache license(?: version)?(?: 2)?(?: 0)?
85 apache license: apache license (?:version |v)?2(?: 0)?(?: january 2004)?
85 apache license: licen[cs]ed under (?:the )?apache license
80 apache 2: (?:licen[cs]ed|released|distributed) under (?:the )?apache 2(?: 0)?(?: licen[cs]e)?
75 obtain a copy of the license: you may not use this file except in compliance with the license you may obtain a copy of the license at
75 without warranties or conditions of any kind: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
75 apache license: apache license .{0,80}terms and conditions for use reproduction and distribution
70 apache org licenses: (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
60 apache 2: apache(?: software)? 2(?: 0)? licen[cs]e
60 apache license: apache license
60 apachev2: apachev2 licen[cs]e
55 license apache 2: license apache 2 0

bsd-2-clause
100 spdx license identifier bsd 2: spdx license identifier bsd 2 clause(?: patent| views)?
90 bsd license: (?:licen[cs]ed |released )?(?:under )?(?:the )?(?:simplified|2 clause|two clause|freebsd) bsd license
85 bsd 2 clause: (?:the )?bsd 2 clause (?:simplified )?licen[cs]e
80 redistributions in binary form must reproduce: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution(?! .{0,12}(?:neither|all advertising)) this software is provided by

bsd-3-clause
100 spdx license identifier bsd 3: spdx license identifier bsd 3 clause(?: clear| lbnl| attribution)?
90 bsd license: (?:licen[cs]ed |released )?(?:under )?(?:the )?(?:new|revised|modified|3 clause|three clause) bsd license
85 bsd 3 clause: (?:the )?bsd 3 clause (?:new |revised )?licen[cs]e
80 prior written permission: neither the names? of .{1,120}? may be used to endorse or promote products derived from this software without specific prior written permission

bsd-4-clause
100 spdx license identifier bsd 4: spdx license identifier bsd 4 clause(?: uc)?
90 bsd license: (?:licen[cs]ed |released )?(?:under )?(?:the )?(?:original|old|4 clause|four clause) bsd license
80 all advertising materials mentioning: all advertising materials mentioning features or use of this software must display the following acknowledge?ment

bsd
90 bsd license: licen[cs]ed under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style| type)? license
85 bsd license: (?:released|distributed|published|available|provided) under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style| type)? license
75 redistribution and use in source: redistribution and use in source and binary forms with or without modification are permitted
65 redistributions of source code must retain: redistributions of source code must retain the above copyright notice
80 bsd style license: governed by a bsd style license(?: that can be found in the license file)?
60 bsd licen: bsd(?: style)? licen[cs]ed?
55 license bsd: license bsd

0bsd
100 spdx license identifier 0bsd: spdx license identifier 0bsd
90 zero clause bsd: (?:the )?(?:bsd )?zero clause bsd(?: license)?
75 permission to use copy modify: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided

isc
100 spdx license identifier isc: spdx license identifier isc
90 isc license: (?:licen[cs]ed |released |distributed )?(?:under )?(?:the )?(?:terms of (?:the )?)?isc license
75 permission to use copy modify: permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
55 license isc: license isc

gpl-1
100 spdx license identifier gpl 1: spdx license identifier gpl 1 0(?: only| or later)?
85 general public license: gnu general public license (?:as published by the free software foundation )?(?:either )?version 1

gpl-2
100 spdx license identifier gpl 2: spdx license identifier gpl 2 0(?: only| or later| with classpath exception 2 0)?
95 general public license: redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?(?: or (?:at your option )?any later version)?
90 general public license: (?:licen[cs]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:general public license|gpl) (?:version |v)?2(?: 0)?
85 gnu general public license: gnu general public license (?:version |v)2(?: june 1991)?
75 gpl: free software foundation inc (?:51 franklin st(?:reet)?|59 temple place) .{0,60}gpl
80 gplv2: (?:gnu )?gplv2(?: only| or later)?(?: licen[cs]ed?)?
60 gpl 2: (?:gnu )?gpl (?:version )?2(?: 0)?(?: only| or later)?
55 license gpl 2: license gpl 2 0(?: only| or later)?

gpl-3
100 spdx license identifier gpl 3: spdx license identifier gpl 3 0(?: only| or later| with gcc exception 3 1)?
95 general public license: redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3(?: of the license)?(?: or (?:at your option )?any later version)?
90 general public license: (?:licen[cs]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:general public license|gpl) (?:version |v)?3(?: 0)?
85 gnu general public license: gnu general public license (?:version |v)3(?: 29 june 2007)?
80 gplv3: (?:gnu )?gplv3(?: only| or later)?(?: licen[cs]ed?)?
60 gpl 3: (?:gnu )?gpl (?:version )?3(?: 0)?(?: only| or later)?
70 licenses gpl 3: gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
55 license gpl 3: license gpl 3 0(?: only| or later)?

gpl
90 general public license: (?:licen[cs]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?gnu general public license
85 general public license: redistribute it and or modify it under the terms of the gnu general public license
85 under the gpl: (?:licen[cs]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl
75 copy of the gnu general public license: you should have received a copy of the gnu general public license along with
70 gpl html: gnu org (?:copyleft|licenses) gpl html
65 the licenses for most software: the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change
60 gnu general public license: (?:the )?gnu general public license
60 gpl licen: (?:gnu )?gpl licen[cs]ed?
55 license gpl: license gpl

lgpl-2.1
100 spdx license identifier lgpl 2: spdx license identifier lgpl 2 [01](?: only| or later)?
95 lesser general public license: redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2 1
90 general public license: (?:licen[cs]ed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lesser|library) general public license (?:version |v)?2(?: [01])?
85 general public license: gnu (?:lesser|library) general public license (?:version |v)2(?: [01])?
80 lgplv2: (?:gnu )?lgplv2(?: 1)?(?: only| or later)?
60 lgpl 2: (?:gnu )?lgpl (?:version )?2(?: [01])?(?: only| or later)?

lgpl-3
100 spdx license identifier lgpl 3: spdx license identifier lgpl 3 0(?: only| or later)?
95 lesser general public license: redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3
90 lesser general public license: (?:licen[cs]ed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lesser general public license (?:version |v)?3(?: 0)?
85 lesser general public license: gnu lesser general public license (?:version |v)3
80 lgplv3: (?:gnu )?lgplv3(?: only| or later)?
60 lgpl 3: (?:gnu )?lgpl (?:version )?3(?: 0)?(?: only| or later)?

lgpl
90 general public license: (?:licen[cs]ed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?gnu (?:lesser|library) general public license
85 general public license: redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
85 under the lgpl: (?:licen[cs]ed|released|distributed|available|provided) under the (?:gnu )?lgpl
75 general public license along: you should have received a copy of the gnu (?:lesser|library) general public license along with
60 general public license: gnu (?:lesser|library) general public license
60 lgpl licen: (?:gnu )?lgpl licen[cs]ed?

agpl-3
100 spdx license identifier agpl 3: spdx license identifier agpl 3 0(?: only| or later)?
95 affero general public license: redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation (?:either )?version 3
90 affero general public license: (?:licen[cs]ed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?affero general public license(?: (?:version |v)?3(?: 0)?)?
85 affero general public license: gnu affero general public license (?:version |v)3(?: 19 november 2007)?
80 agplv3: (?:gnu )?agplv3(?: only| or later)?(?: licen[cs]ed?)?
75 affero general public license along: you should have received a copy of the gnu affero general public license along with
60 agpl 3: (?:gnu )?agpl (?:version )?3(?: 0)?

agpl
85 under the agpl: (?:licen[cs]ed|released|distributed|available|provided) under the (?:gnu )?agpl
60 affero general public license: (?:gnu )?affero general public license

gfdl
100 spdx license identifier gfdl: spdx license identifier gfdl 1 [123](?: only| or later)?
90 free documentation license: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license(?: version 1 [123])?
85 free documentation license: (?:licen[cs]ed|released|available) under (?:the )?(?:terms of (?:the )?)?gnu free documentation license
60 free documentation license: gnu free documentation license(?: version 1 [123])?

mpl-1.1
100 spdx license identifier mpl 1: spdx license identifier mpl 1 [01]
90 mozilla public license: subject to the mozilla public license version 1 [01]
85 mozilla public license: mozilla public license (?:version |v)?1 [01]

mpl-2
100 spdx license identifier mpl 2: spdx license identifier mpl 2 0(?: no copyleft exception)?
95 mozilla public license: this source code form is subject to the terms of the mozilla public license v 2 0
90 mozilla public license: (?:licen[cs]ed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?mozilla public license(?: (?:version |v )?2(?: 0)?)?
85 mozilla public license: mozilla public license (?:version |v )2(?: 0)?
70 mozilla org mpl: mozilla org (?:en us )?mpl 2 0
60 mozilla public license: mozilla public license

epl-1
100 spdx license identifier epl 1: spdx license identifier epl 1 0
90 eclipse public license: (?:under the terms of the )?eclipse public license (?:version |v)?1 0(?: which accompanies this distribution)?

epl-2
100 spdx license identifier epl 2: spdx license identifier epl 2 0
90 eclipse public license: (?:under the terms of the )?eclipse public license (?:version |v )?2(?: 0)?(?: which is available at)?
60 eclipse public license: eclipse public license

cddl
100 spdx license identifier cddl: spdx license identifier cddl 1 [01]
90 common development and distribution: subject to the terms of the common development and distribution license(?: version 1 [01])?
60 common development and distribution license: common development and distribution license(?: (?:version |v)?1 [01])?

cpl
100 spdx license identifier cpl: spdx license identifier cpl 1 0
60 common public license: common public license(?: (?:version |v)1 0)?

zlib
100 spdx license identifier zlib: spdx license identifier zlib(?: acknowledgement)?
90 zlib license: (?:licen[cs]ed |released )?(?:under )?(?:the )?(?:terms of (?:the )?)?zlib(?: libpng)? license
75 redistribute it freely: permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
65 must not be misrepresented: the origin of this software must not be misrepresented you must not claim that you wrote the original software

bsl-1
100 spdx license identifier bsl 1: spdx license identifier bsl 1 0
90 boost software license: (?:distributed |licen[cs]ed )?(?:under the )?boost software license (?:version |v)1 0
60 boost software license: boost software license

unlicense
100 spdx license identifier unlicense: spdx license identifier unlicense
90 the unlicense: (?:released |licen[cs]ed )?(?:into |under )?the unlicense
95 released into the public domain: this is free and unencumbered software released into the public domain
70 unlicense org: (?:refer to )?(?:https? )?unlicense org

wtfpl
100 spdx license identifier wtfpl: spdx license identifier wtfpl
90 do what the fuck: (?:the )?do what the fuck you want to public license
60 wtfpl: wtfpl(?: licen[cs]ed?)?

beerware
100 spdx license identifier beerware: spdx license identifier beerware
85 beerware: (?:the )?beerware licen[cs]e(?: revision 42)?

artistic-1
100 spdx license identifier artistic 1: spdx license identifier artistic 1 0(?: perl)?
85 artistic license: (?:the )?artistic license (?:version )?1 0

artistic-2
100 spdx license identifier artistic 2: spdx license identifier artistic 2 0
85 artistic license: (?:the )?artistic license (?:version )?2 0

perl
90 license as perl: under the same (?:terms|license) as perl(?: itself)?
90 redistribut: you (?:can|may) redistribute it and or modify it under the same terms as perl itself

python-2
100 spdx license identifier: spdx license identifier (?:python|psf) 2 0
90 python software foundation license: (?:licen[cs]ed under )?(?:the )?(?:terms of (?:the )?)?python software foundation license(?: version 2)?
85 psf licen: psf licen[cs]e(?: agreement)?

postgresql
100 spdx license identifier postgresql: spdx license identifier postgresql
85 postgresql license: (?:under )?(?:the )?postgresql license

openssl
100 spdx license identifier openssl: spdx license identifier openssl
85 openssl license: (?:under )?(?:the )?openssl license
75 openssl project: this product includes software developed by the openssl project

ruby
100 spdx license identifier ruby: spdx license identifier ruby
85 ruby license: (?:under )?(?:the )?(?:terms of (?:the )?)?ruby license
80 license as ruby: under the same licen[cs]e as ruby

php-3
100 spdx license identifier php 3: spdx license identifier php 3 0?1?
90 php license: subject to version 3 0?1? of the php license
85 php license: (?:the )?php license(?: version 3 0?1?)?

vim
100 spdx license identifier vim: spdx license identifier vim
85 vim license: (?:under )?(?:the )?vim license

ncsa
100 spdx license identifier ncsa: spdx license identifier ncsa
85 ncsa open source license: (?:the )?university of illinois ncsa open source license

w3c
100 spdx license identifier w3c: spdx license identifier w3c
85 licen: w3c software (?:and document )?(?:notice and )?licen[cs]e

curl
100 spdx license identifier curl: spdx license identifier curl
80 licensed as described in the file copying: this software is licensed as described in the file copying

json
100 spdx license identifier json: spdx license identifier json
80 permission notice shall be included: copies or substantial portions of the software the software shall be used for good not evil

ofl-1.1
100 spdx license identifier ofl: spdx license identifier ofl 1 [01](?: rfn| no rfn)?
90 sil open font license: (?:this font software is )?(?:licen[cs]ed )?(?:under )?(?:the )?sil open font license(?: version 1 1)?
60 open font license: open font license

eupl-1.2
100 spdx license identifier eupl: spdx license identifier eupl 1 [012]
90 licensed under the eupl: licen[cs]ed under the eupl(?: version 1 [012])?
80 european union public licen: european union public licen[cs]e(?: (?:version |v )?1 [012])?

afl-3
100 spdx license identifier afl 3: spdx license identifier afl 3 0
85 academic free license: (?:licen[cs]ed under )?(?:the )?academic free license(?: version 3 0)?

osl-3
100 spdx license identifier osl 3: spdx license identifier osl 3 0
85 open software license: (?:licen[cs]ed under )?(?:the )?open software license(?: version 3 0)?

ms-pl
100 spdx license identifier ms pl: spdx license identifier ms pl
85 microsoft public license: (?:the )?microsoft public license(?: ms pl)?

ms-rl
100 spdx license identifier ms rl: spdx license identifier ms rl
85 microsoft reciprocal license: (?:the )?microsoft reciprocal license(?: ms rl)?

upl-1
100 spdx license identifier upl: spdx license identifier upl 1 0
85 universal permissive license: (?:the )?universal permissive license(?: v 1 0)?

blueoak-1
100 spdx license identifier blueoak: spdx license identifier blueoak 1 0 0
85 blue oak model license: (?:the )?blue oak model license(?: 1 0 0)?

mulan-2
100 spdx license identifier mulanpsl: spdx license identifier mulanpsl 2 0
85 licen: mulan p(?:ermissive |ub)(?:software |l )?licen[cs]e(?: v?2)?
85 licen: mulan psl v?2 licen[cs]e

cecill
100 spdx license identifier cecill: spdx license identifier cecill(?: [bc]| 2 [01])?
85 cecill licen: (?:governed by (?:the )?)?cecill(?: [bc])? licen[cs]e

sspl-1
100 spdx license identifier sspl: spdx license identifier sspl 1 0
90 server side public license: (?:the )?server side public license(?: version 1)?

elastic-2
100 spdx license identifier elastic: spdx license identifier elastic 2 0
90 elastic license: (?:licen[cs]ed under )?(?:the )?elastic license(?: 2 0| v2)?

busl-1.1
100 spdx license identifier busl: spdx license identifier busl 1 1
90 business source license: (?:licen[cs]ed under )?(?:the )?business source license(?: 1 1)?

polyform
100 spdx license identifier polyform: spdx license identifier polyform [a-z0-9 ]{4,40} 1 0 0
85 licen: polyform (?:noncommercial|strict|shield|small business|internal use|perimeter) license(?: 1 0 0)?

commons-clause
90 commons clause license: commons clause license condition v1 0
70 licen: (?:with|plus|and) (?:the )?commons clause .{0,40}licen

openrail
90 licen: (?:creativeml |bigscience |bigcode )?open ?rail(?: m)? licen[cs]e

llama
90 community licen: llama ?[23]?(?: [123])? community licen[cs]e(?: agreement)?

odbl
100 spdx license identifier odbl: spdx license identifier odbl 1 0
90 open database license: (?:made available |licen[cs]ed )?(?:under )?(?:the )?open database license(?: odbl)?(?: v?1 0)?

odc-by
100 spdx license identifier odc by: spdx license identifier odc by 1 0
90 open data commons attribution license: (?:made available |licen[cs]ed )?(?:under )?(?:the )?open data commons attribution license

pddl
100 spdx license identifier pddl: spdx license identifier pddl 1 0
90 public domain dedication and license: (?:open data commons )?public domain dedication and license

cc0
100 spdx license identifier cc0: spdx license identifier cc0 1 0
90 creative commons zero: creative commons zero(?: v?1 0)?(?: universal)?
85 cc0 1: (?:licen[cs]ed |released |available )?(?:under )?(?:the )?(?:terms of (?:the )?)?cc0 1 0(?: universal)?(?: licen[cs]e)?
80 waived all copyright: waived all copyright and related or neighboring rights
75 creativecommons org publicdomain zero: creativecommons org publicdomain zero 1 0
60 cc0 licen: cc0 licen[cs]ed?

cc-by
100 spdx license identifier cc by: spdx license identifier cc by [1234] [05]
90 creative commons attribution: (?:licen[cs]ed |released |available )?(?:under )?(?:a |the )?creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?(?! (?:share|non|no))
85 creativecommons org licenses by: creativecommons org licenses by [1234] [05]
80 cc by: (?:licen[cs]ed |released |available )(?:under )?(?:a |the )?cc by(?: [1234] [05])?(?! (?:sa|nd|nc))
60 cc by: cc by(?: [1234] [05])? licen[cs]ed?

cc-by-sa
100 spdx license identifier cc by sa: spdx license identifier cc by sa [1234] [05]
90 creative commons attribution share: (?:licen[cs]ed |released |available )?(?:under )?(?:a |the )?creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
85 creativecommons org licenses by sa: creativecommons org licenses by sa [1234] [05]
80 cc by sa: cc by sa(?: [1234] [05])?(?: licen[cs]ed?)?

cc-by-nd
100 spdx license identifier cc by nd: spdx license identifier cc by nd [1234] [05]
90 creative commons attribution no: (?:licen[cs]ed |released |available )?(?:under )?(?:a |the )?creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?
85 creativecommons org licenses by nd: creativecommons org licenses by nd [1234] [05]
80 cc by nd: cc by nd(?: [1234] [05])?(?: licen[cs]ed?)?

cc-by-nc
100 spdx license identifier cc by nc: spdx license identifier cc by nc [1234] [05]
90 creative commons attribution non: (?:licen[cs]ed |released |available )?(?:under )?(?:a |the )?creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?(?! (?:share|no))
85 creativecommons org licenses by nc: creativecommons org licenses by nc [1234] [05]
80 cc by nc: cc by nc(?: [1234] [05])?(?: licen[cs]ed?)?(?! (?:sa|nd))

cc-by-nc-sa
100 spdx license identifier cc by nc sa: spdx license identifier cc by nc sa [1234] [05]
90 creative commons attribution non: (?:licen[cs]ed |released |available )?(?:under )?(?:a |the )?creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?
85 creativecommons org licenses by nc sa: creativecommons org licenses by nc sa [1234] [05]
85 cc by nc sa: cc by nc sa(?: [1234] [05])?(?: licen[cs]ed?)?

cc-by-nc-nd
100 spdx license identifier cc by nc nd: spdx license identifier cc by nc nd [1234] [05]
90 creative commons attribution non: (?:licen[cs]ed |released |available )?(?:under )?(?:a |the )?creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?
85 creativecommons org licenses by nc nd: creativecommons org licenses by nc nd [1234] [05]
85 cc by nc nd: cc by nc nd(?: [1234] [05])?(?: licen[cs]ed?)?

creative-commons
60 creative commons licen: (?:a |the )?creative commons licen[cs]e

public-domain
90 public domain: (?:released|placed|dedicated|put)(?: into| in| to)? the public domain
85 in the public domain: (?:this (?:work|file|software|code|text)|it) is (?:hereby )?in the public domain
85 dedicate: (?:hereby )?dedicates? (?:any and all copyright interest in .{1,60} |this .{1,40} )?to the public domain
60 public domain: public domain

proprietary
100 spdx license identifier licenseref proprietary: spdx license identifier licenseref proprietary
80 all rights reserved: all rights reserved
85 proprietary and confidential: (?:strictly )?proprietary and confidential
85 confidential and proprietary: confidential and proprietary(?: information)?
80 is strictly prohibited: unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)(?: via any medium)? is strictly prohibited(?: proprietary and confidential)?
75 without permission: (?:may|must) not be (?:copied|reproduced|distributed|used)(?: or [a-z]+)? without (?:prior |express |written ){0,3}permission
75 end user license agreement: end user licen[cs]e agreement
"""


class Rule(NamedTuple):
    order: int
    label: str
    priority: int
    keyword: str
    pattern: str
    #: Words of a base phrase; 0: not one.
    base: int


def rules(phrases: tuple[tuple[str, str], ...]) -> list[Rule]:
    """The base phrases, whose matches are places (they may overlap), then the hand-written rules, in order."""
    found = [(label, 100, phrase, f"(?<= )(?={phrase} )", len(phrase.split())) for phrase, label in phrases]
    for group in RULES_TEXT.strip().split("\n\n"):
        label, *lines = group.split("\n")
        for line in lines:
            priority, keyword, pattern = re.fullmatch(r"(\d+) ([^:]+): (.+)", line).groups()
            found.append((label, int(priority), keyword, f"(?<= )(?:{pattern})(?= )", 0))
    return [Rule(i, *r) for i, r in enumerate(found)]
