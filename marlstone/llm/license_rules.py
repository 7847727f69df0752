"""The signature rules of license scans, in words: a name in each of its uses, and hand-written clauses of license texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licenses: label, keyword, and the regex of its names in words.
FAMILIES = (
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e"),
    ("agpl", "agpl", "agpl(?:v?[13])?"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl", "library general", "(?:gnu )?library general public licen[sc]e"),
    ("lgpl", "lgpl", "lgpl(?:v?[23])?"),
    ("gpl", "general public", "(?:gnu )?general public licen[sc]e"),
    ("gpl", "gpl", "(?:gnu )?gpl(?:v?[123])?"),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[sc]e"),
    ("apache", "apache", "apache (?:software )?licen[sc]e"),
    ("mit", "mit", "mit(?: x11| expat)? licen[sc]e"),
    ("mit-0", "mit no attribution", "mit no attribution(?: licen[sc]e)?"),
    ("bsd-2", "bsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[sc]e"),
    ("bsd-3", "bsd", "(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[sc]e"),
    ("bsd-4", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd) licen[sc]e"),
    ("bsd", "bsd", "bsd(?: style)? licen[sc]e"),
    ("isc", "isc", "isc licen[sc]e"),
    ("mpl", "mozilla", "mozilla public licen[sc]e"),
    ("epl", "eclipse", "eclipse public licen[sc]e"),
    ("edl", "eclipse", "eclipse distribution licen[sc]e"),
    ("cpl", "common public", "common public licen[sc]e"),
    ("cddl", "common development", "common development and distribution licen[sc]e"),
    ("eupl", "european union", "european union public licen[sc]e"),
    ("artistic", "artistic", "(?:perl )?artistic licen[sc]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", "libpng licen[sc]e"),
    ("boost", "boost", "boost software licen[sc]e"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0", "cc0", "(?:creative commons )?cc0(?: universal)?"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-nd", "cc by nd", "cc by nd"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-nc-nd", "commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "commons", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "commons", "creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike"),
    ("cc-by", "commons", "creative commons attribution"),
    ("odbl", "open database", "open database licen[sc]e"),
    ("odc-by", "open data commons", "open data commons attribution licen[sc]e"),
    ("pddl", "public domain", "public domain dedication and licen[sc]e"),
    ("ofl", "open font", "(?:sil )?open font licen[sc]e"),
    ("openssl", "openssl", "openssl licen[sc]e"),
    ("php", "php", "php licen[sc]e"),
    ("psf", "python software", "python software foundation licen[sc]e"),
    ("ruby", "ruby", "ruby licen[sc]e"),
    ("postgresql", "postgresql", "postgresql licen[sc]e"),
    ("ms-pl", "microsoft public", "microsoft public licen[sc]e"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[sc]e"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("osl", "open software", "open software licen[sc]e"),
    ("afl", "academic free", "academic free licen[sc]e"),
    ("upl", "universal permissive", "universal permissive licen[sc]e"),
    ("bsl", "business source", "business source licen[sc]e"),
    ("sspl", "server side", "server side public licen[sc]e"),
    ("elastic", "elastic", "elastic licen[sc]e"),
    ("mulan", "mulan", "mulan permissive software licen[sc]e"),
    ("rail", "responsible ai", "responsible ai licen[sc]e"),
)

#: How a family's name is used: priority, weight, and the regex around the name.
FORMS = (
    (0, 1.0, "spdx licen[sc]e identifier {}(?: (?:v|version )?[0-9]+(?: [0-9]+)?)?"),
    (0, 0.95, "(?:licen[sc]ed|released|distributed|published|available|provided|covered|redistributed) under (?:the )?(?:terms of )?(?:the )?{}(?: (?:v|version )?[0-9]+(?: [0-9]+)?)?"),
    (1, 0.85, "{} (?:v|version )?[0-9]+(?: [0-9]+)?(?: or (?:any )?later)?"),
    (2, 0.7, "{}"),
)

#: Clauses by license: the label, then a line a clause with its priority, its weight and its regex, all written by hand. A clause's
#: keyword is what stands in braces; the braces aren't part of the regex.
CLAUSES = r"""
mit
0 0.9 permission is hereby granted {free of charge} to any person obtaining a copy(?: of this software)?
1 0.7 {to deal in the software without restriction} including without limitation the rights
1 0.7 to use copy modify merge publish distribute {sublicense} and or sell copies of the software
1 0.6 the above {copyright} notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
2 0.4 the software is provided as is without {warranty} of any kind express or implied
2 0.4 fitness for a particular purpose and {noninfringement}
2 0.4 in no event shall the authors or {copyright} holders be liable for any claim damages or other liability
2 0.4 whether in an action of contract tort or otherwise arising from out of or {in connection with the software}
1 0.7 except as contained in this notice the name s? ?of the above {copyright} holders shall not be used in advertising
x11
0 0.85 except as contained in this notice the name of (?:the x consortium|.{3,40}?) shall not be used in advertising or otherwise to promote the sale use or {other dealings in this software}
bsd
0 0.9 {redistribution} and use in source and binary forms with or without modification are permitted
1 0.7 {redistribution}s of source code must retain the above copyright notice this list of conditions and the following disclaimer
1 0.7 {redistribution}s in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
2 0.4 {this software is provided by} the (?:copyright holders and contributors|regents and contributors|author) as is
2 0.4 any express or implied {warrant}ies including but not limited to the implied warranties of merchantability
2 0.3 procurement of substitute goods or services loss of use data or profits or {business interruption}
2 0.3 however caused and {on any theory of liability} whether in contract strict liability or tort
2 0.3 {even if advised of the possibility} of such damages?
bsd-3
0 0.85 neither the name of .{3,80}? nor the names of its contributors may be used to {endorse or promote} products derived from this software
0 0.85 the name of the author may not be used to {endorse or promote} promote products derived from this software without specific prior written permission
bsd-4
0 0.9 all {advertising materials} mentioning features or use of this software must display the following acknowledge?ment
1 0.7 {this product includes software} developed by the university of california
bsd-0
0 0.85 {permission} to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
isc
0 0.8 {permission} to use copy modify and or distribute this software for any purpose
1 0.6 provided that the above {copyright} notice and this permission notice appear in all copies
2 0.4 the author disclaims all {warrant}ies with regard to this software
2 0.4 in no event shall the author be liable for any special direct indirect or {consequential damages}
apache
0 0.8 {unless required by applicable law} or agreed to in writing
1 0.7 you may not use this file except {in compliance with} the license
1 0.7 you may obtain a copy of the {license} at
1 0.5 distributed on an as is basis without {warrant}ies or conditions of any kind
1 0.6 see the {license} for the specific language governing permissions and limitations
0 0.85 terms and conditions for {use reproduction and distribution}
0 0.85 each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable {copyright} license
0 0.85 each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable {patent license}
1 0.6 such {license} applies only to those patent claims licensable by such contributor
1 0.6 you must give any other recipients of the work or derivative works a copy of this {license}
1 0.6 you must cause any modified files to carry {prominent notices} stating that you changed the files
1 0.6 contains a {notice text file} as part of its distribution
1 0.5 this {license} does not grant permission to use the trade names trademarks service marks
1 0.6 {this product includes software} developed by the apache software foundation
apache-1
0 0.85 products derived from this software {may not be called} apache nor may apache appear in their name
0 0.8 the names? apache(?: server)? and apache (?:group|software foundation) must {not be used to endorse}
gpl
0 0.8 this program is {free software} you can redistribute it and or modify
0 0.8 this (?:file|library|package|module|code) is {free software} you can redistribute it and or modify
1 0.7 either version [123](?: [0-9])? of the {license} or at your option any later version
1 0.5 this program is distributed in the hope that it will be useful but without any {warranty}
1 0.6 you should have received a copy of the gnu general {public license}
1 0.5 write to the {free software} foundation
0 0.85 everyone is permitted to copy and distribute verbatim copies of this {licen}se document but changing it is not allowed
1 0.6 the {license}s for most software are designed to take away your freedom to share and change it
1 0.6 when we speak of {free software} we are referring to freedom not price
1 0.6 activities other than {copying distribution and modification} are not covered by this license
1 0.6 you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program {to be licensed}
1 0.6 accompany it with the complete corresponding machine {readable source code}
1 0.6 you may not impose any {further restrictions} on the recipients exercise of the rights granted
1 0.6 there is no {warranty} for the program to the extent permitted by applicable law
2 0.4 the entire risk as to the quality and {performance of the program} is with you
gpl-2
0 0.9 gnu {general public} license version 2 june 1991
1 0.7 version 2 of the {license} or at your option any later version
1 0.7 under the terms of version 2 of the gnu {general public} license
gpl-3
0 0.9 gnu {general public} license version 3 29 june 2007
1 0.7 version 3 of the {license} or at your option any later version
1 0.6 the gnu general {public license} is a free copyleft license for software and other kinds of works
1 0.6 {to convey a work} means any kind of propagation that enables other parties to make or receive copies
1 0.6 no covered work shall be deemed part of an effective {technological measure}
1 0.6 you may {convey a covered work} in object code form
1 0.6 {installation information} for a user product means any methods procedures authorization keys
gpl-exception
0 0.8 as a {special exception} the (?:free software foundation|copyright holders?|author) gives? (?:you )?(?:unlimited )?permission
1 0.6 with the {classpath} exception
1 0.7 linking this (?:library|program|module) statically or dynamically with other modules is making a {combined work}
1 0.6 gcc runtime {library exception}
lgpl
0 0.85 gnu {lesser general public} license version (?:2 1|3)
0 0.85 gnu {library general public} license version 2
1 0.6 a program that contains no derivative of any portion of the library but is {designed to work with} the library
1 0.6 you should have received a copy of the gnu (?:lesser|library) general {public license}
1 0.6 this {license} applies to certain designated libraries
1 0.6 if the work is a {derivative of the library}
agpl
0 0.9 gnu {affero general public} license version 3 19 november 2007
0 0.8 all users interacting with it remotely through a computer network an {opportunity to receive} the corresponding source
1 0.7 remote network interaction use with the gnu {general public} license
gfdl
0 0.85 {permission} is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
1 0.7 with no invariant sections no front cover texts and {no back cover texts}
1 0.7 with no {invariant sections} no front cover texts
mpl
0 0.85 this source code form is subject to the terms of the mozilla {public license}
0 0.85 if a copy of the mpl was not {distributed with this file} you can obtain one at
1 0.7 the contents of this file are subject to the mozilla {public license} version 1 [01]
1 0.6 incompatible with secondary {license}s
1 0.6 {covered software} is provided under this license on an as is basis
1 0.5 software {distributed under the license} is distributed on an as is basis without warranty of any kind either express or implied
npl
0 0.85 netscape {public license}
1 0.7 the initial {developer of the original code} is
epl
0 0.85 the accompanying program is provided under the terms of this eclipse {public license}
1 0.7 this program and the accompanying materials are made available under the terms of the eclipse {public license}
1 0.6 any {use reproduction or distribution} of the program constitutes recipients acceptance of this agreement
cpl
0 0.85 the accompanying program is provided under the terms of this common {public license}
cddl
0 0.85 the contents of this file are subject to the terms of the common development and {distribution license}
1 0.7 when distributing covered code include this {cddl header} notice in each file
ipl
0 0.85 ibm {public license} version 1 0
eupl
0 0.85 {under the eupl}(?: version)? 1 [12]
0 0.85 this european union {public licen}ce the eupl applies to the work
artistic
0 0.85 the intent of this document is to state the conditions under which a {package may be copied}
1 0.7 you may make and give away verbatim copies of the source form of the {standard version}
1 0.7 {same terms as perl} (?:5 )?itself
perl
0 0.8 {free software} you can redistribute it and or modify it under the same terms as (?:perl|the perl)
ruby
0 0.8 you can {redistribut}e it and or modify it under either the terms of the 2 clause bsdl
zlib
0 0.85 in no event will the authors be held liable for any {damages arising from} the use of this software
0 0.8 {permission} is granted to anyone to use this software for any purpose including commercial applications
1 0.7 the {origin of this software} must not be misrepresented
1 0.7 altered source versions must be plainly marked as such and must {not be misrepresented}
1 0.6 this {notice may not be removed} or altered from any source distribution
libpng
0 0.8 if you modify libpng you may insert {additional notices}
ijg
0 0.85 this {software is based in part} on the work of the independent jpeg group
freetype
0 0.85 portions of this software are {copyright} .{0,30}?the freetype project
boost
0 0.85 distributed under the {boost} software license
1 0.7 {permission} is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense
0 0.9 this is {free and unencumbered} software released into the public domain
1 0.7 anyone is free to copy modify publish use compile {sell or distribute this software}
1 0.6 we make this {dedication for} the benefit of the public at large
wtfpl
0 0.9 do what the fuck you want to {public license}
1 0.7 you just {do what the fuck} you want to
beerware
0 0.9 the {beer ware} license
1 0.7 if we meet some day and you think this stuff is worth it you can {buy me a beer}
cc0
0 0.85 to the extent possible under law .{3,80}? has waived all {copyright} and related or neighboring rights
1 0.7 cc0 1 0 universal {public domain} dedication
1 0.7 no {copyright} the person who associated a work with this deed has dedicated the work
cc-by
0 0.85 this work is {licensed under} a creative commons attribution [0-9] [0-9] (?:international|unported|generic)
1 0.7 you must give appropriate credit provide a link to the {license} and indicate if changes were made
1 0.6 licensor hereby grants you a worldwide royalty free non exclusive perpetual .{0,40}?{license}
cc-by-sa
0 0.85 this work is {licensed under} a creative commons attribution share ?alike
1 0.7 you must {distribute your contributions} under the same license as the original
1 0.6 text is available under the creative {commons} attribution share ?alike license
cc-by-nc
0 0.85 this work is {licensed under} a creative commons attribution non ?commercial
1 0.7 you may not use the material for {commercial purposes}
cc-by-nd
0 0.85 this work is {licensed under} a creative commons attribution no ?deriv
1 0.7 if you remix transform or build upon the material you may not {distribute the modified} material
odbl
0 0.85 this .{3,60}? is made available under the {open database} license
1 0.7 any rights in individual contents of the {database are licensed} under the database contents license
pddl
0 0.85 {public domain} dedication and license(?: pddl)?
ofl
0 0.85 this {font software} is licensed under the sil open font license
1 0.7 neither the {font software} nor any of its individual components in original or modified versions may be sold by itself
1 0.7 no modified version of the {font software} may use the reserved font name
openssl
0 0.85 {this product includes software} developed by the openssl project for use in the openssl toolkit
1 0.7 this product includes {cryptographic software} written by eric young
php
0 0.85 this product includes {php software} freely available from
1 0.7 products derived from this software {may not be called} php
psf
0 0.85 psf hereby grants licensee a nonexclusive royalty free world wide {license}
1 0.7 this {license} agreement is between the python software foundation
postgresql
0 0.8 {permission} to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
1 0.6 in no event shall the university of california be {liable to any party}
hpnd
0 0.75 {permission} to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose
tcl
0 0.8 the authors hereby grant {permission} to use copy modify distribute and license this software and its documentation for any purpose
curl
0 0.75 {permission} to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
icu
0 0.75 {permission} is hereby granted free of charge .{0,120}?provided that the above copyright notice s? ?and this permission notice appear in all copies of the software
unicode
0 0.85 unicode inc {license} agreement data files and software
1 0.7 copyright .{0,30}?unicode inc all {rights reserved}
w3c
0 0.85 by obtaining using and or copying this work you the {licensee} agree that you have read understood
ms-pl
0 0.85 this {license} governs use of the accompanying software if you use the software you accept this license
1 0.6 each contributor grants you a non exclusive worldwide royalty free {copyright} license to reproduce its contribution
ms-rl
1 0.7 {reciprocal grants} for any file you distribute that contains code from the software
ncsa
0 0.85 {permission} is hereby granted free of charge .{0,60}?to deal with the software without restriction
1 0.7 neither the names of .{3,80}? nor the names of its contributors may be used to {endorse or promote} products derived from this software without specific prior written permission
osl
0 0.8 {licensed under} the open software license version [0-9]
1 0.6 external deployment means the use {distribution or communication} of the original work
afl
0 0.8 {licensed under} the academic free license version [0-9]
upl
0 0.8 subject to the condition set forth below {permission} is hereby granted to any person obtaining a copy of this software
1 0.6 the larger works? to which the {software is contributed}
bsl
0 0.8 the {licensor} hereby grants you the right to copy modify create derivative works redistribute and make non production use
1 0.7 additional use grant {change date} change license
1 0.6 effective on the {change date}
sspl
0 0.8 making the {functionality of the program} or modified version available to third parties as a service
1 0.7 you must make the {service source code} available via network download
elastic
0 0.8 you may not provide the {software to third parties} as a hosted or managed service
1 0.7 you may not move change disable or circumvent the {license} key functionality
commons-clause
0 0.85 {commons} clause license condition
1 0.7 the grant of rights under the {license} will not include and the license does not grant to you the right to sell the software
polyform
0 0.85 polyform (?:noncommercial|small business|shield|strict|free trial|internal use|perimeter|defensive) {license}
1 0.7 any noncommercial purpose is a {permitted purpose}
redis
0 0.8 redis source available {license}
confluent
0 0.8 confluent community {license}
mulan
0 0.85 you can use this {software according to} the terms and conditions of the mulan
rail
0 0.8 (?:bigscience|creativeml|bigcode) open ?{rail}(?: m| d| s)?
1 0.7 {you agree not to use the model} or derivatives of the model (?:in|for) any of the following
1 0.7 {use based restrictions} (?:as )?referenced in paragraph 5
llama
0 0.85 llama (?:2 |3 )?(?:[0-9] )?community {license} agreement
1 0.7 {built with} (?:meta )?llama
gemma
0 0.85 gemma is provided under and subject to the {gemma terms of use}
hippocratic
0 0.8 hippocratic {license}
anti-996
0 0.8 anti 996 {license}
json
0 0.85 the {software shall be used for good} not evil
sqlite
0 0.85 the author disclaims {copyright} to this source code in place of a legal notice here is a blessing
vim
0 0.8 vim {license}
1 0.7 there are no restrictions on distributing unmodified copies of vim except that they must include this {license} text
lppl
0 0.85 latex project {public license}
1 0.7 this work has the {lppl maintenance} status
apsl
0 0.85 apple {public source} license
1 0.7 this file contains original code and or {modifications of original code} as defined in and that are subject to the apple
qpl
0 0.8 q {public license}
sleepycat
0 0.8 {redistribution}s in any form must be accompanied by information on how to obtain complete source code
sissl
0 0.8 sun industry standards source {license}
ecl
0 0.8 educational community {license}
fair
0 0.8 usage of the works is {permitted} provided that this instrument is retained with the works
nonfree
0 0.7 (?:free )?{for personal use only}(?: not for commercial use)?
1 0.6 {free for non} ?commercial use
1 0.6 {not for commercial} (?:use|distribution|redistribution)
1 0.6 {for non commercial} (?:use|purposes)(?: only)?
1 0.6 {for academic} (?:and|or) research (?:use|purposes) only
public-domain
1 0.6 (?:released into|dedicated to|placed in|in) the {public domain}
1 0.6 this (?:file|work|code|program|software) is (?:hereby )?in the {public domain}
1 0.6 {work of the united states government}
1 0.6 is not subject to {copyright} protection
proprietary
1 0.5 {proprietary} and confidential
1 0.6 this (?:software|document) (?:contains|is) (?:the )?(?:confidential and )?{proprietary} information
1 0.6 unauthori[sz]ed {copying of this file} via any medium is strictly prohibited
1 0.6 no part of this (?:publication|book|document|work) {may be reproduced}
1 0.6 you may not reverse engineer decompile or {disassemble the software}
1 0.5 end user {license agreement}
1 0.5 may not be reproduced distributed or transmitted without (?:prior )?written {permission}
all-rights-reserved
1 0.5 all {rights reserved}
1 0.5 alle {rechte vorbehalten}
1 0.5 {tous droits reserves}
copyright
2 0.3 {copyright} (?:c )?(?:19|20)[0-9]{2}
no-warranty
2 0.2 {without warranty} of any kind
2 0.2 without any {warranty} without even the implied warranty of merchantability or fitness for a particular purpose
2 0.2 provided as is and without any express or implied {warrant}ies
patent
2 0.3 {patent}s? (?:pending|grant)
""".strip()

PRIORITIES = 4
_KEYWORD = re.compile(r"\{([a-z][a-z0-9 ]*)\}")

#: Parts of most keywords: a text that holds none of them, nor any other keyword, is passed over.
STEMS = ("licen", "copyright", "gpl", "cc by", "cc0", "commons", "permission", "permitted", "redistribut", "warrant", "public domain", "rights reserved", "proprietary", "patent", "endorse", "software")


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]  # all must stand in a text
    priority: int
    weight: float
    regex: str
    base: bool = False


def clauses() -> list[Rule]:
    """The rules of CLAUSES, in order."""
    made, label = [], ""
    for line in CLAUSES.split("\n"):
        if line[0].isdigit():
            priority, weight, regex = line.split(" ", 2)
            made.append(Rule(label, (_KEYWORD.search(regex)[1],), int(priority), float(weight), _KEYWORD.sub(r"\1", regex)))
        else:
            label = line
    return made


def rules() -> list[Rule]:
    """All rules in order: each use of each name, the clauses, and the base phrases, which are of the last priority."""
    made = []
    for label, keyword, name in FAMILIES:
        keywords = (keyword, "licen") if name.endswith(" licen[sc]e") else (keyword,)
        made += [Rule(label, keywords, priority, weight, form.format(name)) for priority, weight, form in FORMS]
    made += clauses()
    made += [Rule(label, (phrase,), PRIORITIES - 1, 0.6, phrase, True) for phrase, label in BASE.items()]
    return made


def gates() -> list[str]:
    """What a text must hold one of to match any rule: the stems, and a keyword of each rule whose keywords hold no stem or other gate."""
    found = list(STEMS)
    for keywords in sorted({r.keywords for r in rules()}, key=lambda k: (len(k[0]), k)):
        if not any(gate in keyword for gate in found for keyword in keywords):
            found.append(keywords[0])
    return found
