"""Signature rules of license texts and notices, written by hand.

Fixed values: a line is label, priority, weight and a pattern over lower-cased
words that are joined by single spaces. Priorities: 97 and more for sentences
that also stand, shortened, in another license; 90 for sentences of one
license; 85 for notices; 70 for titles; 60 for identifiers and addresses; 40
for statements that name no license.
"""

RULES = r"""
mit 90 0.98 permission is hereby granted free of charge to any person obtaining a copy of this software
mit 90 0.95 to deal in the software without restriction including without limitation the rights to use copy modify merge
mit 90 0.95 the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit 88 0.9 the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit 88 0.85 in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit 85 0.95 (?:this|the) (?:project|code|software|package|library|repository|work) is (?:made )?(?:licensed|available|released|distributed) under (?:the )?(?:terms of (?:the )?)?mit(?: license)?
mit 70 0.95 the mit license mit
mit 60 0.95 opensource org licenses mit
mit 60 0.9 license mit
expat 70 0.9 (?:the )?expat license
mit-0 97 0.98 to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit-0 70 0.95 mit no attribution
x11 90 0.95 the name of the x consortium shall not be used in advertising
x11 70 0.9 x11 license
isc 90 0.98 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 88 0.9 the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
isc 85 0.95 (?:licensed|released|available|distributed) under (?:the )?isc(?: license)?
isc 70 0.95 isc license isc
isc 60 0.95 opensource org licenses isc
bsd 90 0.98 redistribution and use in source and binary forms with or without modification are permitted provided that
bsd 88 0.9 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd 88 0.9 redistributions in binary form must reproduce the above copyright notice
bsd 88 0.85 in no event shall the copyright (?:holder|owner) or contributors be liable for any direct indirect incidental special
bsd-3-clause 97 0.98 neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-3-clause 70 0.95 bsd 3 clause(?: new or revised)?(?: license)?
bsd-3-clause 70 0.95 (?:new|revised|modified) bsd license
bsd-2-clause 70 0.95 bsd 2 clause(?: simplified)?(?: license)?
bsd-2-clause 70 0.95 simplified bsd license
bsd-2-clause 70 0.95 freebsd license
bsd-4-clause 97 0.98 all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause 70 0.95 (?:original|old) bsd license
bsd 85 0.9 use of this source code is governed by a bsd style license
bsd 60 0.95 opensource org licenses bsd
0bsd 97 0.98 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
0bsd 70 0.95 zero clause bsd
0bsd 70 0.95 bsd zero clause license
apache 90 0.98 you may not use this file except in compliance with the license
apache 90 0.95 licensed to the apache software foundation asf under one or more contributor license agreements
apache 88 0.95 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache 88 0.9 see the license for the specific language governing permissions and limitations under the license
apache 88 0.95 you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0
apache 90 0.95 terms and conditions for use reproduction and distribution 1 definitions
apache 90 0.95 each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache 85 0.95 licensed under the apache license version 2 0 the license
apache 70 0.95 apache license 2 0
apache 70 0.95 apache license version (?:1 0|1 1|2 0)
apache 70 0.95 apache software license
apache 60 0.95 www apache org licenses license 2 0
apache 60 0.95 apache 2 0 license
gpl 90 0.98 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl 88 0.95 this program is distributed in the hope that it will be useful but without any warranty
gpl 88 0.95 you should have received a copy of the gnu general public license along with this (?:program|file|software|package|library)
gpl 90 0.95 the licenses for most software are designed to take away your freedom to share and change it
gpl 90 0.95 the gnu general public license is a free copyleft license for software and other kinds of works
gpl 88 0.9 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl 88 0.9 if the program does not specify a version number of this license you may choose any version ever published by the free software foundation
gpl 85 0.9 either version [23] of the license or at your option any later version
gpl 70 0.95 gnu general public license version [123]
gpl 70 0.95 gnu gpl v ?[123]
gpl 60 0.9 gpl [123] 0 (?:only|or later)
gpl 60 0.9 www gnu org licenses gpl
gpl 60 0.9 gplv[123]
lgpl 97 0.98 this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl 97 0.98 you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl 97 0.95 you should have received a copy of the gnu (?:lesser|library) general public license
lgpl 97 0.95 this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
lgpl 75 0.95 gnu lesser general public license version (?:2 1|3)
lgpl 75 0.95 gnu library general public license
lgpl 60 0.9 lgpl (?:2 0|2 1|3 0) (?:only|or later)
lgpl 60 0.9 www gnu org licenses lgpl
lgpl 60 0.9 lgplv[23]
agpl 97 0.98 you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl 97 0.95 you should have received a copy of the gnu affero general public license
agpl 97 0.95 the gnu affero general public license is a free copyleft license for software and other kinds of works
agpl 90 0.95 remote network interaction use with the gnu general public license
agpl 75 0.95 gnu affero general public license version 3
agpl 60 0.9 agpl [13] 0 (?:only|or later)
agpl 60 0.9 www gnu org licenses agpl
gpl-classpath 97 0.95 as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl-classpath 75 0.95 gpl 2 0 with classpath exception
gpl-gcc-exception 75 0.95 gcc runtime library exception
gpl-font-exception 97 0.95 as a special exception if you create a document which uses this font
gfdl 90 0.98 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl 90 0.95 with no invariant sections no front cover texts and no back cover texts
gfdl 70 0.95 gnu free documentation license
mpl 90 0.98 this source code form is subject to the terms of the mozilla public license
mpl 88 0.95 if a copy of the mpl was not distributed with this file you can obtain one at
mpl 90 0.95 the contents of this file are subject to the mozilla public license version 1 [01]
mpl 90 0.95 incompatible with secondary licenses
mpl 70 0.95 mozilla public license (?:version )?[12] [01]
mpl 60 0.95 (?:www )?mozilla org (?:en us )?mpl
mpl 60 0.9 mpl 2 0
npl 70 0.95 netscape public license
epl 90 0.98 the accompanying program is provided under the terms of this eclipse public license
epl 88 0.95 this program and the accompanying materials are made available under the terms of the eclipse public license
epl 70 0.95 eclipse public license (?:version |v )?[12] 0
epl 60 0.95 www eclipse org legal epl
edl 70 0.95 eclipse distribution license
cpl 90 0.95 the accompanying program is provided under the terms of this common public license
cpl 70 0.95 common public license (?:version )?1 0
ibm-pl 70 0.95 ibm public license
cddl 90 0.98 the contents of this file are subject to the terms of the common development and distribution license
cddl 70 0.95 common development and distribution license
cddl 60 0.9 cddl 1 [01]
eupl 90 0.98 licensed under the eupl
eupl 90 0.95 this european union public licen[cs]e the eupl applies to the work
eupl 70 0.95 european union public licen[cs]e
cecill 90 0.95 this software is governed by the cecill(?: [bc])? license under french law
cecill 70 0.95 cecill free software license agreement
artistic 90 0.95 the intent of this document is to state the conditions under which a package may be copied
artistic 90 0.95 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms
artistic 85 0.95 under the same terms as perl itself
artistic 70 0.95 (?:the )?artistic license (?:version )?[12] 0
artistic 70 0.9 the clarified artistic license
afl 70 0.95 academic free license (?:version |v )?[123] [0-9]
osl 70 0.95 open software license (?:version |v )?[123] [0-9]
osl 88 0.95 licensed under the open software license version 3 0
nposl 70 0.95 non profit open software license
bsl 90 0.98 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
bsl 85 0.95 distributed under the boost software license version 1 0
bsl 60 0.95 www boost org license 1 0
busl 90 0.98 the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
busl 70 0.95 business source license 1 1
busl 88 0.9 change license apache license version 2 0
sspl 90 0.98 if you make the functionality of the program or a modified version available to third parties as a service
sspl 70 0.95 server side public license
elastic 90 0.95 you may not provide the software to third parties as a hosted or managed service
elastic 70 0.95 elastic license 2 0
commons-clause 90 0.95 the software is provided to you by the licensor under the license as defined below subject to the following condition
commons-clause 70 0.95 commons clause license condition
polyform 70 0.95 polyform (?:noncommercial|small business|shield|strict|perimeter) license
zlib 90 0.98 this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib 88 0.95 the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib 88 0.9 altered source versions must be plainly marked as such and must not be misrepresented
zlib 70 0.95 the zlib(?: libpng)? license
libpng 90 0.95 the contributing authors and group 42 inc disclaim all warranties
libpng 70 0.95 png reference library license
libtiff 90 0.95 the names of sam leffler and silicon graphics may not be used in any advertising
ijg 90 0.95 this software is based in part on the work of the independent jpeg group
bzip2 70 0.9 bzip2 and libbzip2 license
unlicense 90 0.98 this is free and unencumbered software released into the public domain
unlicense 88 0.95 anyone is free to copy modify publish use compile sell or distribute this software
unlicense 60 0.95 unlicense org
wtfpl 90 0.98 you just do what the fuck you want to
wtfpl 70 0.95 do what the fuck you want to public license
beerware 90 0.98 if we meet some day and you think this stuff is worth it you can buy me a beer
beerware 70 0.95 the beer ware license
cc0 90 0.98 to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights
cc0 88 0.95 the person who associated a work with this deed has dedicated the work to the public domain
cc0 70 0.95 cc0 1 0 universal
cc0 60 0.95 creativecommons org publicdomain zero 1 0
cc-pdm 60 0.9 creativecommons org publicdomain mark 1 0
cc-by 85 0.95 this work is licensed under a creative commons attribution (?:[1-4] [05] )?(?:international )?license
cc-by 70 0.95 creative commons attribution [1-4] [05] (?:international|unported|generic)
cc-by 60 0.95 creativecommons org licenses by [1-4] [05]
cc-by-sa 97 0.95 creative commons attribution share ?alike
cc-by-sa 88 0.95 if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-sa 60 0.95 creativecommons org licenses by sa
cc-by-nc 97 0.95 creative commons attribution non ?commercial
cc-by-nc 88 0.9 you may not use the material for commercial purposes
cc-by-nc 60 0.95 creativecommons org licenses by nc
cc-by-nd 97 0.95 creative commons attribution no ?deriv(?:s|atives)
cc-by-nd 88 0.9 if you remix transform or build upon the material you may not distribute the modified material
cc-by-nd 60 0.95 creativecommons org licenses by nd
cc-by-nc-sa 98 0.95 creative commons attribution non ?commercial share ?alike
cc-by-nc-sa 61 0.95 creativecommons org licenses by nc sa
cc-by-nc-nd 98 0.95 creative commons attribution non ?commercial no ?deriv(?:s|atives)
cc-by-nc-nd 61 0.95 creativecommons org licenses by nc nd
cc-sampling 70 0.9 creative commons sampling plus
odbl 70 0.95 open database license
odbl 60 0.95 opendatacommons org licenses odbl
odc-by 70 0.95 open data commons attribution license
pddl 70 0.95 public domain dedication and license
ogl-uk 70 0.95 open government licence v ?[123] 0
ogl-uk 88 0.95 contains public sector information licensed under the open government licence
etalab 70 0.95 etalab open license
cdla 70 0.95 community data license agreement (?:permissive|sharing)
ofl 90 0.98 this font software is licensed under the sil open font license
ofl 70 0.95 sil open font license
ofl 60 0.95 scripts sil org ofl
lppl 90 0.95 this work may be distributed and or modified under the conditions of the latex project public license
lppl 70 0.95 latex project public license
psf 90 0.95 this license agreement is between the python software foundation psf and the individual or organization
psf 70 0.95 python software foundation license
python 70 0.95 cnri open source license agreement
ruby 90 0.95 you can redistribute it and or modify it under either the terms of the 2 clause bsdl
ruby 85 0.9 under the same license as ruby
php 90 0.98 this product includes php software freely available from
php 90 0.95 this source file is subject to version [23] 0[0-9]? of the php license
php 70 0.95 the php license version [23] 0
zend 70 0.95 the zend engine license
postgresql 90 0.98 permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
postgresql 70 0.95 postgresql licen[cs]e
openssl 90 0.98 this product includes software developed by the openssl project for use in the openssl toolkit
openssl 88 0.95 the names openssl toolkit and openssl project must not be used to endorse
openssl 70 0.95 dual openssl and ssleay license
ssleay 90 0.95 this product includes cryptographic software written by eric young
curl 90 0.95 copyright c [0-9]{4} [0-9]{4} daniel stenberg
ncsa 90 0.95 to deal with the software without restriction including without limitation the rights to use copy modify merge
ncsa 70 0.95 university of illinois ncsa open source license
upl 90 0.98 the above copyright notice and either this complete permission notice or at a minimum a reference to the upl must be included
upl 70 0.95 universal permissive license v ?1 0
ms-pl 70 0.95 microsoft public license ms pl
ms-pl 90 0.95 each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution
ms-rl 70 0.95 microsoft reciprocal license
ms-rl 90 0.95 for any file you distribute that contains code from the software
w3c 90 0.95 permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted
w3c 70 0.95 w3c software notice and license
unicode 90 0.95 to deal in the data files or software without restriction
unicode 70 0.95 unicode license agreement data files and software
icu 70 0.9 icu license icu 1 8 1 and later
zpl 90 0.95 this software is provided by zope corporation as is
zpl 70 0.95 zope public license zpl
qpl 70 0.95 the q public license version 1 0
sleepycat 70 0.95 the sleepycat license
sleepycat 90 0.95 redistributions in any form must be accompanied by information on how to obtain complete source code for the db software
vim 90 0.95 vim is charityware
vim 70 0.95 vim license
jython 70 0.9 jython license
json 90 0.98 the software shall be used for good not evil
hpnd 70 0.95 historical permission notice and disclaimer
naist 70 0.9 naist license
ecl 70 0.95 educational community license version 2 0
apsl 70 0.95 apple public source license
nasa 70 0.95 nasa open source agreement
rpl 70 0.95 reciprocal public license
sunpl 70 0.95 sun public license version 1 0
cua 70 0.9 cua office public license
openldap 70 0.95 the openldap public license
blueoak 70 0.95 blue oak model license
blueoak 90 0.95 each contributor licenses you to do everything with this software that would otherwise infringe
mulan 70 0.95 mulan permissive software license
mulan 90 0.95 you can use this software according to the terms and conditions of the mulan psl
anti-996 70 0.95 anti 996 license
hippocratic 70 0.95 hippocratic license
rail 70 0.95 (?:open)?rail (?:m )?license
rail 90 0.95 you agree not to use the model or derivatives of the model
llama 70 0.95 llama [23](?: [0-9])? community license agreement
gemma 70 0.9 gemma terms of use
jsr 70 0.9 java specification license
oracle-bcl 70 0.95 oracle binary code license agreement
oracle-otn 70 0.95 oracle technology network license agreement
android-sdk 70 0.9 android software development kit license agreement
eula 70 0.85 end user license agreement
eula 88 0.85 by installing copying or otherwise using the software you agree to be bound by the terms
eula 88 0.85 you may not reverse engineer decompile or disassemble the software
proprietary 88 0.9 this software is the confidential and proprietary information of
proprietary 88 0.85 unauthorized copying of this file via any medium is strictly prohibited
proprietary 88 0.85 no part of this (?:publication|document|work) may be reproduced
proprietary 70 0.85 proprietary and confidential
proprietary 40 0.6 all rights reserved
freeware 60 0.7 this software is freeware
shareware 60 0.7 this software is shareware
public-domain 88 0.9 (?:hereby )?(?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain 85 0.85 this (?:file|work|code|software|program) is in the public domain
public-domain 88 0.85 the author disclaims copyright to this source code
government 88 0.85 works? of the united states government .{0,60}?not subject to copyright protection
"""
