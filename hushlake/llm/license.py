"""License scan by ordered signature rules, in DataFrame expressions only.

Texts are cut to words, and rules are regexes over words. A rule is tried only
where its keyword occurs; detections inside a longer one, or that overlap one of
higher priority, are dropped. Everything happens within the row: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases with labels that are always reported.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Detections that are gathered at a time: appending to an array copies it.
PART = 256

#: What a word is, in text of either case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: label | keyword | name of the license as a regex over words. A name's keyword must occur in every match of it.
NAMES = r"""
apache-1.0 | apache | apache (?:software )?license,? (?:version |v)?1 0
apache-1.1 | apache | apache (?:software )?license (?:version |v)?1 1
apache-2.0 | apache | apache (?:software )?license (?:version |v)?2(?: 0)?
apache | apache | apache (?:software )?licen[sc]e
afl-3.0 | academic | academic free license (?:version |v)?3 0
afl | academic | academic free license
agpl-3.0 | affero | (?:gnu )?affero general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)?3(?: 0)?
agpl | affero | (?:gnu )?affero general public license
gpl-1.0 | general | (?:gnu )?general public license (?:either )?(?:version |v)?1(?: 0)?
gpl-2.0 | general | (?:gnu )?general public license (?:either )?(?:version |v)?2(?: 0)?
gpl-3.0 | general | (?:gnu )?general public license (?:either )?(?:version |v)?3(?: 0)?
gpl-2.0-or-later | general | (?:gnu )?general public license (?:either )?(?:version |v)?2(?: 0)? (?:of the license )?or (?:at your option )?any later version
gpl-3.0-or-later | general | (?:gnu )?general public license (?:either )?(?:version |v)?3(?: 0)? (?:of the license )?or (?:at your option )?any later version
gpl | general | gnu general public license
lgpl-2.0 | library | (?:gnu )?library general public license (?:version |v)?2(?: 0)?
lgpl-2.1 | lesser | (?:gnu )?lesser general public license (?:version |v)?2 1
lgpl-3.0 | lesser | (?:gnu )?lesser general public license (?:version |v)?3(?: 0)?
lgpl | lesser | (?:gnu )?lesser general public license
gfdl-1.3 | documentation | (?:gnu )?free documentation license (?:version |v)?1 3
gfdl | documentation | (?:gnu )?free documentation license
mit | license | (?:the )?mit license
mit-0 | attribution | mit no attribution(?: license)?
x11 | license | (?:the )?x11 license
expat | license | (?:the )?expat license
isc | license | (?:the )?isc license
bsd-2-clause | freebsd | (?:the )?freebsd license
bsd-2-clause | bsd | (?:the )?(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: simplified)? license
bsd-3-clause | bsd | (?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: new or revised)? license
bsd-4-clause | bsd | (?:the )?(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: original or old)? license
0bsd | bsd | (?:bsd zero clause|zero clause bsd)(?: license)?
0bsd | public | free public license 1 0 0
bsd | bsd | (?:the )?bsd(?: style)? licen[sc]e
mpl-1.0 | mozilla | mozilla public license (?:version |v)?1 0
mpl-1.1 | mozilla | mozilla public license (?:version |v)?1 1
mpl-2.0 | mozilla | mozilla public license (?:version |v)?2(?: 0)?
mpl | mozilla | mozilla public license
epl-1.0 | eclipse | eclipse public license (?:version |v)?1 0
epl-2.0 | eclipse | eclipse public license (?:version |v)?2 0
epl | eclipse | eclipse public license
edl-1.0 | eclipse | eclipse distribution license (?:version |v)?1 0
cddl-1.0 | distribution | common development and distribution license (?:version |v)?1 0
cddl-1.1 | distribution | common development and distribution license (?:version |v)?1 1
cddl | distribution | common development and distribution license(?: cddl)?
cpl-1.0 | common | common public license (?:version |v)?1 0
cpal-1.0 | common | common public attribution license (?:version |v)?1 0
eupl-1.1 | european | european union public licen[sc]e (?:version |v)?1 1
eupl-1.2 | european | european union public licen[sc]e (?:version |v)?1 2
eupl | european | european union public licen[sc]e
osl-3.0 | open | open software license (?:version |v)?3 0
ofl-1.1 | font | (?:sil )?open font license (?:version |v)?1 1
ofl | font | (?:sil )?open font license
artistic-1.0 | artistic | artistic license (?:version |v)?1 0
artistic-2.0 | artistic | artistic license (?:version |v)?2 0
artistic | artistic | (?:the )?(?:perl )?artistic license
bsl-1.0 | boost | boost software license (?:version |v)?1 0
bsl | boost | boost software license
busl-1.1 | business | business source license (?:version |v)?1 1
sspl-1.0 | server | server side public license (?:version |v)?1
elastic-2.0 | elastic | elastic license (?:version |v)?2 0
unlicense | unlicense | (?:the )?unlicense
wtfpl | public | do what the [a-z]+ you want to public license
zlib | license | (?:the )?zlib(?: libpng)? license
libpng | license | (?:the )?libpng license
openssl | openssl | openssl license
ssleay | ssleay | (?:original )?ssleay license
python-2.0 | python | python (?:software foundation )?license (?:version |v)?2(?: 0)?
psf | python | python software foundation license
php-3.01 | php | php license (?:version |v)?3 01
php | php | php license
ruby | ruby | (?:the )?ruby license
vim | vim | vim license
postgresql | postgresql | postgresql licen[sc]e
curl | license | (?:the )?curl license
ncsa | ncsa | (?:university of illinois )?ncsa open source license
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
ecl-2.0 | educational | educational community license (?:version |v)?2 0
upl-1.0 | universal | universal permissive license (?:version |v)?1 0
blueoak-1.0.0 | blue | blue oak model license 1 0 0
mulan-psl-2.0 | mulan | mulan (?:permissive software license|psl) (?:version |v)?2
cecill-2.1 | cecill | cecill (?:free software )?licen[sc]e (?:agreement )?(?:version |v)?2 1
cecill | cecill | cecill(?: free software)? licen[sc]e
etalab-2.0 | ouverte | licence ouverte(?: open licence)? (?:version |v)?2 0
ogl-uk-3.0 | government | open government licen[sc]e (?:version |v)?3 0
ogl | government | open government licen[sc]e
odbl-1.0 | database | open (?:data commons open )?database license(?: odbl)?(?: (?:version |v)?1 0)?
odc-by-1.0 | commons | open data commons attribution license(?: (?:version |v)?1 0)?
pddl-1.0 | commons | open data commons public domain dedication and license
cdla-permissive-2.0 | community | community data license agreement permissive (?:version |v)?2 0
cc0-1.0 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc-by-1.0 | cc | cc by 1 0
cc-by-2.0 | cc | cc by 2 0
cc-by-2.5 | cc | cc by 2 5
cc-by-3.0 | cc | cc by 3 0
cc-by-4.0 | cc | cc by 4 0
cc-by-sa-2.0 | cc | cc by sa 2 0
cc-by-sa-3.0 | cc | cc by sa 3 0
cc-by-sa-4.0 | cc | cc by sa 4 0
cc-by-sa | cc | cc by sa
cc-by-nc-2.0 | cc | cc by nc 2 0
cc-by-nc-3.0 | cc | cc by nc 3 0
cc-by-nc-4.0 | cc | cc by nc 4 0
cc-by-nc | cc | cc by nc
cc-by-nd-3.0 | cc | cc by nd 3 0
cc-by-nd-4.0 | cc | cc by nd 4 0
cc-by-nd | cc | cc by nd
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
cc-by-nc-sa | cc | cc by nc sa
cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
cc-by-nc-nd | cc | cc by nc nd
cc-by | creative | creative commons attribution(?: (?:[0-9] [0-9]))?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-sa | creative | creative commons attribution share(?: )?alike(?: (?:[0-9] [0-9]))?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nc | creative | creative commons attribution non(?: )?commercial(?: (?:[0-9] [0-9]))?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nd | creative | creative commons attribution no(?: )?deriv(?:ative)?s?(?: (?:[0-9] [0-9]))?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nc-sa | creative | creative commons attribution non(?: )?commercial share(?: )?alike(?: (?:[0-9] [0-9]))?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nc-nd | creative | creative commons attribution non(?: )?commercial no(?: )?deriv(?:ative)?s?(?: (?:[0-9] [0-9]))?(?: international| unported| generic)?(?: public)?(?: license)?
"""

#: label | keyword | confidence in per cent | regex over words: notices and texts that name no license, and sentences of license texts.
NOTICES = r"""
cc-by | cc | 70 | cc by
gpl | general | 60 | general public license
reserved | reserved | 60 | all rights reserved
reserved | vorbehalten | 65 | alle rechte vorbehalten
reserved | réservés | 65 | tous droits réservés
reserved | reservados | 65 | todos los derechos reservados
mit | permission | 95 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
isc | permission | 90 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution | 90 | redistribution and use in source and binary forms with or without modification are permitted provided that
bsd-3-clause | endorse | 90 | may be used to endorse or promote products derived from this software without specific prior written permission
apache-2.0 | compliance | 90 | you may not use this file except in compliance with the license
apache-2.0 | apache | 90 | apache org licenses license 2 0
gpl | redistribute | 80 | this program is free software you can redistribute it and or modify it
lgpl | redistribute | 80 | this library is free software you can redistribute it and or modify it
gpl | warranty | 70 | this program is distributed in the hope that it will be useful but without any warranty
gpl | gnu | 80 | gnu org licenses gpl(?: [0-9] [0-9])?(?: html| txt)?
lgpl | gnu | 80 | gnu org licenses lgpl(?: [0-9] [0-9])?(?: html| txt)?
agpl | gnu | 80 | gnu org licenses agpl(?: [0-9] [0-9])?(?: html| txt)?
mpl-2.0 | mozilla | 90 | mozilla org mpl 2 0
mpl-2.0 | source | 90 | this source code form is subject to the terms of the mozilla public license v 2 0
mit | opensource | 90 | opensource org licenses mit(?: license)?
bsd-2-clause | opensource | 90 | opensource org licenses bsd 2 clause
bsd-3-clause | opensource | 90 | opensource org licenses bsd 3 clause
isc | opensource | 90 | opensource org licenses isc
unlicense | unencumbered | 90 | this is free and unencumbered software released into the public domain
mit | notice | 85 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | warranty | 80 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | liable | 80 | in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
mit | sublicense | 85 | without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit-0 | furnished | 60 | sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
x11 | advertising | 85 | shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization
isc | warranties | 85 | the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
isc | liable | 85 | in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever
hpnd | permission | 85 | permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted
hpnd | publicity | 80 | not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission
0bsd | permission | 85 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd | redistributions | 85 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions | 85 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | consequential | 80 | be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
bsd | disclaimed | 80 | implied warranties of merchantability and fitness for a particular purpose are disclaimed
bsd-3-clause | contributors | 85 | neither the name of (?:[^ ]+ ){1,8}nor the names of its contributors may be used
bsd-4-clause | acknowledgement | 90 | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause | contributors | 80 | this product includes software developed by (?:[^ ]+ ){1,8}and its contributors
bsd-source-code | redistributions | 70 | redistributions of source code must retain the above copyright notice unmodified
apache-1.0 | acknowledgment | 85 | redistributions of any form whatsoever must retain the following acknowledgment
apache-1.1 | acknowledgment | 85 | the end user documentation included with the redistribution if any must include the following acknowledgment
apache-2.0 | license | 90 | licensed under the apache license version 2 0 the license you may not use this file
apache-2.0 | applicable | 85 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | governing | 80 | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | perpetual | 85 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce
apache-2.0 | prominent | 80 | you must cause any modified files to carry prominent notices stating that you changed the files
apache-2.0 | litigation | 80 | if you institute patent litigation against any entity including a cross claim or counterclaim in a lawsuit
gpl | foundation | 80 | under the terms of the gnu general public license as published by the free software foundation
gpl-2.0-or-later | foundation | 90 | as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
gpl-3.0-or-later | foundation | 90 | as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
gpl-2.0 | foundation | 85 | as published by the free software foundation version 2(?: of the license)?
gpl-3.0 | foundation | 85 | as published by the free software foundation version 3(?: of the license)?
gpl | warranty | 70 | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl | received | 80 | you should have received a copy of the gnu general public license along with this program
gpl | foundation | 70 | write to the free software foundation inc (?:59 temple place|51 franklin street|675 mass ave)
gpl-2.0 | verbatim | 70 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-2.0 | freedom | 80 | the licenses for most software are designed to take away your freedom to share and change it
gpl-2.0 | derived | 60 | you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program
gpl-2.0 | executable | 80 | you may copy and distribute the program or a work based on it under section 2 in object code or executable form
gpl-3.0 | copyleft | 85 | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3.0 | propagate | 80 | to propagate a work means to do anything with it that without permission would make you directly or secondarily liable
gpl-3.0 | propagate | 80 | you may make run and propagate covered works that you do not convey without conditions
gpl-3.0 | technological | 80 | no covered work shall be deemed part of an effective technological measure under any applicable law
gpl-3.0 | corresponding | 75 | the corresponding source for a work in object code form means all the source code needed to generate install and run the object code
lgpl | received | 80 | you should have received a copy of the gnu (?:lesser|library) general public license along with this library
lgpl-2.1 | foundation | 85 | as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
lgpl-2.1 | lesser | 80 | this license the lesser general public license applies to some specially designated software packages
lgpl-3.0 | convey | 80 | you may convey a combined work under terms of your choice that taken together effectively do not restrict modification
agpl-3.0 | affero | 85 | the gnu affero general public license is a free copyleft license for software and other kinds of works
agpl-3.0 | remotely | 90 | your modified version must prominently offer all users interacting with it remotely through a computer network
agpl | received | 80 | you should have received a copy of the gnu affero general public license along with this program
gfdl | permission | 85 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | invariant | 80 | with no invariant sections (?:with )?no front cover texts and no back cover texts
mpl-1.1 | mozilla | 85 | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | mpl | 85 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0 | incompatible | 85 | this source code form is incompatible with secondary licenses as defined by the mozilla public license
mpl-1.1 | rights | 70 | for the specific language governing rights and limitations under the license the original code is
epl-1.0 | accompanying | 85 | the accompanying program is provided under the terms of this eclipse public license agreement
epl-2.0 | accompanying | 85 | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v(?: )?)?2 0
epl-1.0 | accompanying | 85 | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v(?: )?)?1 0
cpl-1.0 | accompanying | 85 | the accompanying program is provided under the terms of this common public license agreement
cddl | development | 80 | the contents of this file are subject to the terms of the common development and distribution license
cddl | cddl | 75 | when distributing covered (?:code|software) include this cddl header notice in each file
cddl-1.0 | initial | 70 | initial developer means the individual or entity that first makes original software available under this license
eupl | eupl | 80 | licensed under the eupl(?: (?:version |v(?: )?)?1 [0-9])?
osl-3.0 | open | 70 | licensed under the open software license version 3 0
afl-3.0 | academic | 85 | licensed under the academic free license version 3 0
artistic-1.0 | package | 80 | you may make and give away verbatim copies of the source form of the standard version of this package without restriction
artistic-2.0 | permitted | 80 | you are permitted to use the standard version and create and use modified versions for any purpose without restriction
artistic | perl | 75 | same terms as perl itself(?: (?:either )?the artistic license)?
bsl-1.0 | permission | 90 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
bsl-1.0 | machine | 80 | unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
busl-1.1 | production | 85 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
busl-1.1 | anniversary | 80 | effective on the change date or the fourth anniversary of the first publicly available distribution
sspl-1.0 | functionality | 85 | if you make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 | hosted | 85 | you may not provide the software to third parties as a hosted or managed service
unlicense | dedication | 90 | we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
unlicense | publish | 85 | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | fuck | 85 | you just do what the fuck you want to
zlib | misrepresented | 90 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered | 85 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | supplied | 80 | the png reference library is supplied as is
openssl | openssl | 85 | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | ssl | 80 | this package is an ssl implementation written by eric young
python-2.0 | psf | 85 | psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test
php-3.01 | php | 85 | this product includes php software freely available from
postgresql | permission | 80 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
curl | permission | 60 | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
ncsa | restriction | 80 | to deal with the software without restriction including without limitation the rights to use copy modify merge publish
ms-pl | patent | 60 | if you bring a patent claim against any contributor over patents that you claim are infringed by the software
ofl-1.1 | font | 85 | this font software is licensed under the sil open font license
ofl-1.1 | reserved | 85 | no modified version of the font software may use the reserved font name
upl-1.0 | licensor | 85 | under any and all copyright rights in the software and any and all patent rights owned or freely licensable by each licensor
cc0-1.0 | waives | 85 | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
cc0-1.0 | neighboring | 80 | (?:has )?(?:waived|dedicated) all copyright and related (?:or|and) neighboring rights to this work
cc-by-sa | creative | 60 | text is available under the creative commons attribution share(?: )?alike license
cc-by | redistribute | 70 | you are free to share copy and redistribute the material in any medium or format
cc-by | license | 70 | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | remix | 80 | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc-by-nc | commercial | 70 | you may not use the material for commercial purposes
cc-by-nd | remix | 80 | if you remix transform or build upon the material you may not distribute the modified material
odbl-1.0 | database | 75 | any rights in individual contents of the database are licensed under the database contents license
odc-by-1.0 | database | 70 | the licensor grants to you a worldwide royalty free non exclusive license to use the database
ogl-uk-3.0 | sector | 85 | contains public sector information licensed under the open government licen[sc]e
etalab-2.0 | ouverte | 80 | sous licence ouverte(?: open licence)?(?: version 2 0)?
cecill | cecill | 80 | ce logiciel est régi par la licence cecill
public-domain | domain | 75 | no copyright (?:is )?(?:claimed|asserted) (?:[^ ]+ ){0,6}public domain
public-domain | domain | 70 | this (?:work|file|software|code) is (?:hereby )?(?:released |dedicated )?(?:in|into|to) the public domain
public-domain | government | 60 | (?:work|works) of the (?:united states|u s) government (?:and )?(?:is|are) not subject to copyright
beerware | beer | 85 | you can buy me a beer in return
json | evil | 80 | the software shall be used for good not evil
commons-clause | sell | 85 | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
proprietary | confidential | 75 | this (?:document|file|software|material) contains (?:[^ ]+ ){0,4}confidential (?:and proprietary )?information
proprietary | reproduced | 70 | no part of this (?:publication|book|work|document) may be reproduced
proprietary | agree | 60 | by (?:installing|downloading|using) (?:this|the) software you agree to (?:be bound by )?(?:the|these) terms
proprietary | permission | 60 | (?:reprinted|reproduced|used) (?:with|by) (?:kind )?permission of
reserved | rights | 65 | some rights reserved
reserved | reservados | 65 | reservados todos los derechos
reserved | derechos | 55 | derechos reservados
reserved | urheberrechtlich | 65 | urheberrechtlich geschützt
cc-by | namensnennung | 70 | creative commons (?:lizenz )?namensnennung
cc-by-sa | bedingungen | 75 | namensnennung weitergabe unter gleichen bedingungen
cc-by-nc | commerciale | 75 | attribution pas d utilisation commerciale
cc-by | creative | 70 | (?:licencia )?creative commons (?:reconocimiento|atribución)
public-domain | domain | 70 | (?:released|dedicated|placed|is) (?:in|into|to) the public domain
zlib | implied | 80 | this software is provided as is without any express or implied warranty
cc-by | creativecommons | 90 | creativecommons org licenses by(?: [0-9] [0-9])?
cc-by-sa | creativecommons | 90 | creativecommons org licenses by sa(?: [0-9] [0-9])?
cc-by-nc | creativecommons | 90 | creativecommons org licenses by nc(?: [0-9] [0-9])?
cc-by-nd | creativecommons | 90 | creativecommons org licenses by nd(?: [0-9] [0-9])?
cc-by-nc-sa | creativecommons | 90 | creativecommons org licenses by nc sa(?: [0-9] [0-9])?
cc-by-nc-nd | creativecommons | 90 | creativecommons org licenses by nc nd(?: [0-9] [0-9])?
cc0-1.0 | creativecommons | 90 | creativecommons org publicdomain zero 1 0
copyright | copyright | 50 | copyright (?:c )?(?:[0-9]{4} )+(?:[^ ]+)
proprietary | confidential | 60 | (?:proprietary and confidential|confidential and proprietary)
proprietary | unauthorized | 60 | unauthorized (?:copying|reproduction|use)(?: or (?:copying|reproduction|distribution))? of this (?:file|software|document|material)
"""


@lru_cache(maxsize=1)
def rules() -> list[dict]:
    """All rules, most specific first. Each name gives a bare rule, one with a granting verb, and a tag by its identifier."""
    found = []
    for line in NAMES.strip().splitlines():
        label, keyword, name = (x.strip() for x in line.split("|", 2))
        found.append({"label": label, "keyword": keyword, "confidence": 0.9, "priority": 20, "regex": f"(?:{name})"})
        found.append({"label": label, "keyword": keyword, "confidence": 1.0, "priority": 30, "regex": f"(?:licen[sc]ed|released|distributed|available|provided|published|covered) (?:under|by|with) (?:the )?(?:terms of )?(?:the )?(?:{name})"})
        found.append({"label": label, "keyword": "spdx", "confidence": 1.0, "priority": 40, "regex": "spdx license identifier " + " ".join(label.replace("-", " ").replace(".", " ").split())})
    for line in NOTICES.strip().splitlines():
        label, keyword, confidence, text = (x.strip() for x in line.split("|", 3))
        found.append({"label": label, "keyword": keyword, "confidence": int(confidence) / 100, "priority": 10, "regex": f"(?:{text})"})
    unique = list({(r["label"], r["regex"], r["keyword"]): r for r in found}.values())
    return [r | {"rule": k} for k, r in enumerate(unique)]


def spaced(regex: str) -> str:
    """A regex over words as one over text in which each word has a space on both sides of its own."""
    return f" {regex.replace(' ', '  ')} "


#: One of these occurs wherever a keyword does; a word of three letters or less needs its borders too.
HINTS = tuple("licen reserv permission redistribut endorse compliance domain warrant vorbehalten réserv copyright confidential unauthorized attribution clause spdx gnu opensource unencumbered creative mozilla cc mulan cecill source software geschützt perl anniversary functionality executable technological convey bedingungen beer cddl propagate commercial consequential contributors dedication derived fuck invariant liable litigation mpl permitted prominent remix remotely reproduced ssl supplied waives".split())
_CC = r"(?:^|[^a-z0-9])cc(?:0|[^a-z0-9])"


def hinted(text: Column) -> Column:
    """Whether a text in lower case may match any rule: plain searches, so that most texts never meet a regex."""
    found = [F.contains(text, F.lit(h)) for h in HINTS if h != "cc"] + [F.contains(text, F.lit("cc")) & text.rlike(_CC)]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def flat(text: Column) -> Column:
    """Words in lower case, each with a space on both sides of its own; empty without words.

    ``lower`` also folds letters beyond ASCII; that moves no word and makes no word of a rule.
    """
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _words_in(part: Column) -> Column:
    return F.floor((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def _parts(items: Column) -> Column:
    """An array in parts of PART items."""
    count = lambda x: F.greatest(F.ceil(F.size(x) / PART) - 1, F.lit(0))
    return _let(items, lambda x: F.transform(F.sequence(F.lit(0), count(x)), lambda k: F.slice(x, (k * PART + 1).cast("int"), F.lit(PART))))


def _spans(t: Column) -> Column:
    """Detections of all rules whose keyword occurs, in order of start, longest and strongest first."""
    by_key: dict[str, list[dict]] = {}
    for r in rules():
        by_key.setdefault(r["keyword"], []).append(r)
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    struct = lambda r: f"named_struct('regex', {q(spaced(r['regex']))}, 'label', {q(r['label'])}, 'priority', {r['priority']}, 'confidence', {r['confidence']}D, 'rule', {r['rule']})"
    table = F.expr("map(" + ", ".join(f"{q(k)}, array({', '.join(map(struct, found))})" for k, found in by_key.items()) + ")")
    keys = F.array_distinct(F.regexp_extract_all(t, F.lit(f" ({'|'.join(by_key)})(?= )")))

    def of(r: Column) -> Column:
        found, gaps = F.regexp_extract_all(t, F.concat(F.lit("("), r["regex"], F.lit(")")), F.lit(1)), F.split(t, r["regex"], -1)
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
        step = lambda s, x: F.struct(
            (s["at"] + _words_in(x["g"]) + _words_in(x["m"])).alias("at"),
            F.concat(s["out"], F.array(F.struct((s["at"] + _words_in(x["g"])).alias("start"), (s["at"] + _words_in(x["g"]) + _words_in(x["m"])).alias("end")))).alias("out"),
        )
        pairs = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))
        # Places within a part first, then those of the parts: an array that grows is at most a part long.
        nested = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:bigint,end:bigint>>>").alias("out"))
        shift = lambda s, part: F.transform(part["out"], lambda p: F.struct((s["at"] + p["start"]).alias("start"), (s["at"] + p["end"]).alias("end")))
        join = lambda s, part: F.struct((s["at"] + part["at"]).alias("at"), F.concat(s["out"], F.array(shift(s, part))).alias("out"))
        places = F.flatten(F.aggregate(F.transform(_parts(pairs), lambda part: F.aggregate(part, zero, step)), nested, join)["out"])
        return F.transform(places, lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("neg_end"), (-r["priority"]).alias("neg_priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence")))

    return F.array_sort(F.flatten(F.transform(F.flatten(F.transform(keys, lambda k: F.element_at(table, k))), of)))


_SPAN = "struct<start:bigint,neg_end:bigint,neg_priority:int,rule:int,label:string,confidence:double>"


def _kept(spans: Column) -> Column:
    """One sweep in order of start, longest first: a span inside the one that stands there goes; of two that overlap, the one of lower priority goes (the later one on a tie)."""
    none = F.lit(None).cast(_SPAN)

    def step(s: Column, x: Column) -> Column:
        cur = s["cur"]
        apart = cur.isNull() | (x["start"] >= -cur["neg_end"])
        takes = ~apart & (x["neg_end"] < cur["neg_end"]) & (x["neg_priority"] < cur["neg_priority"])
        return F.struct(F.when(apart & cur.isNotNull(), F.concat(s["done"], F.array(cur))).otherwise(s["done"]).alias("done"), F.when(apart | takes, x).otherwise(cur).alias("cur"))

    def part(s: Column, spans: Column) -> Column:
        within = F.aggregate(spans, F.struct(F.array().cast(f"array<{_SPAN}>").alias("done"), s["cur"].alias("cur")), step)
        return F.struct(F.concat(s["done"], F.array(within["done"])).alias("done"), within["cur"].alias("cur"))

    zero = F.struct(F.array().cast(f"array<array<{_SPAN}>>").alias("done"), none.alias("cur"))
    return F.aggregate(_parts(spans), zero, part, lambda s: F.concat(F.flatten(s["done"]), F.when(s["cur"].isNull(), F.array().cast(f"array<{_SPAN}>")).otherwise(F.array(s["cur"]))))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, base, detections)``, a row for each input row.

    ``base`` has, for each phrase of BASE, struct<label, n, first, last>; where
    ``detections`` is array<struct<label, start, end, rule, confidence>> of what
    the rules leave, in words from 0. A null or empty text has no words and
    empty arrays; repeated rows each have their row; null ids are passed on.
    """
    t = F.col("t")
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.select(F.col(id_col).alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.when(hinted(F.lower(text)), flat(text)).alias("t"))
    base = []
    for phrase, label in BASE:
        p = F.lit(spaced(phrase))
        n = F.floor((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / len(spaced(phrase))).cast("long")
        last = F.col("n_words") - _words_in(F.substring_index(t, spaced(phrase), -1)) - len(phrase.split())
        base.append(F.when(F.contains(t, p), F.struct(F.lit(label).alias("label"), n.alias("n"), _words_in(F.substring_index(t, spaced(phrase), 1)).alias("first"), last.alias("last"))))
    out = out.select("doc_id", "n_words", F.filter(F.array(*base), lambda b: b.isNotNull()).alias("base"), F.when(t.isNotNull(), _kept(_spans(t))).alias("found"))
    det = F.transform("found", lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), (-x["neg_end"]).alias("end"), x["rule"].alias("rule"), x["confidence"].alias("confidence")))
    return out.select("doc_id", "n_words", "base", F.coalesce(det, F.array().cast("array<struct<label:string,start:bigint,end:bigint,rule:int,confidence:double>>")).alias("detections"))


def summary(df: DataFrame) -> DataFrame:
    """The scan as one flat row for each document."""
    base, labels = F.transform("base", lambda b: b["label"]), F.transform("detections", lambda d: d["label"])
    return scan(df).select(
        "doc_id", "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda s, b: s + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, labels))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
