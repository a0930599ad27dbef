"""Hand-written licence signatures over canonical text: lower-case words, one space between them.

Fixed values, in natural order: one rule a line, ``label | priority | keyword | regex``. The keyword is a literal that
every match of the regex contains; the regex is tried only in documents that hold it. A larger priority wins where
detections overlap. The regex stands between word boundaries.
"""

RULES = r"""
0bsd | 70 | 0bsd | 0bsd(?: license)?
0bsd | 70 | zero clause bsd | (?:bsd )?zero clause bsd(?: license)?
academic-3.0 | 70 | academic free license | academic free license (?:version |v )?3 0
academic-2.1 | 70 | academic free license | academic free license (?:version |v )?2 1
academic | 50 | academic free license | academic free license
agpl-3.0-only | 80 | agpl | (?:gnu )?agpl (?:v ?|version )?3(?: 0)? only
agpl-3.0-or-later | 80 | agpl | (?:gnu )?agpl (?:v ?|version )?3(?: 0)? or (?:any )?later
agpl-3.0 | 70 | agpl | (?:gnu )?agpl ?(?:v ?|version )?3(?: 0)?
agpl-3.0 | 75 | affero general public license | (?:gnu )?affero general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )?3(?: 0)?
agpl-1.0 | 75 | affero general public license | affero general public license (?:version |v )?1(?: 0)?
agpl | 50 | affero general public license | (?:gnu )?affero general public license
aladdin | 60 | aladdin free public license | aladdin free public license
apache-1.0 | 70 | apache | apache (?:software )?license (?:version |v )?1 0
apache-1.1 | 70 | apache | apache (?:software )?license (?:version |v )?1 1
apache-2.0 | 75 | apache | apache (?:software )?license,? (?:version |v ?)?2(?: 0)?
apache-2.0 | 75 | apache | apache (?:v ?)?2 0(?: license)?
apache-2.0 | 80 | apache org licenses | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 65 | asl 2 | asl 2 0
apache | 40 | apache license | (?:the )?apache license
apache | 40 | licensed to the apache software foundation | licensed to the apache software foundation
apsl-2.0 | 70 | apple public source license | apple public source license (?:version |v )?2 0
apsl | 50 | apple public source license | apple public source license
artistic-2.0 | 70 | artistic | artistic license (?:version |v )?2 0
artistic-1.0 | 70 | artistic | artistic license (?:version |v )?1 0
artistic | 50 | artistic license | (?:perl )?artistic license
beerware | 60 | beer ware | beer ware license
beerware | 55 | buy me a beer | you can buy me a beer in return
blueoak-1.0.0 | 70 | blue oak model license | blue oak model license(?: 1 0 0)?
bsd-1-clause | 70 | bsd | (?:bsd 1 clause|1 clause bsd)(?: license)?
bsd-2-clause | 75 | bsd | (?:bsd 2 clause|2 clause bsd)(?: license)?
bsd-2-clause | 70 | simplified bsd | simplified bsd(?: license)?
bsd-2-clause | 70 | freebsd license | freebsd license
bsd-3-clause | 75 | bsd | (?:bsd 3 clause|3 clause bsd)(?: license)?
bsd-3-clause | 70 | new bsd license | new bsd license
bsd-3-clause | 70 | modified bsd license | modified bsd license
bsd-3-clause | 70 | revised bsd license | revised bsd license
bsd-3-clause | 65 | endorse or promote products | neither the name of .{1,120}? may be used to endorse or promote products
bsd-4-clause | 75 | bsd | (?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?
bsd-4-clause | 65 | advertising materials mentioning | all advertising materials mentioning features or use of this software
bsd | 50 | bsd | bsd (?:style )?licen[cs]e
bsd | 45 | redistribution and use in source and binary | redistribution and use in source and binary forms with or without modification are permitted
bsl-1.0 | 70 | boost software license | boost software license(?: (?:version |v )?1 0)?
bsl-1.0 | 75 | boost org license | (?:www )?boost org license 1 0 txt
busl-1.1 | 70 | business source license | business source license(?: (?:version )?1 1)?
bzip2 | 60 | bzip2 license | bzip2 license
cc0-1.0 | 75 | cc0 | cc0(?: (?:version )?1 0)?(?: universal)?
cc0-1.0 | 75 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc-by-1.0 | 70 | cc by | cc by 1 0
cc-by-2.0 | 70 | cc by | cc by 2 0
cc-by-2.5 | 70 | cc by | cc by 2 5
cc-by-3.0 | 70 | cc by | cc by 3 0
cc-by-4.0 | 70 | cc by | cc by 4 0
cc-by-nc-2.0 | 75 | cc by nc | cc by nc 2 0
cc-by-nc-3.0 | 75 | cc by nc | cc by nc 3 0
cc-by-nc-4.0 | 75 | cc by nc | cc by nc 4 0
cc-by-nc-nd-2.0 | 80 | cc by nc nd | cc by nc nd 2 0
cc-by-nc-nd-3.0 | 80 | cc by nc nd | cc by nc nd 3 0
cc-by-nc-nd-4.0 | 80 | cc by nc nd | cc by nc nd 4 0
cc-by-nc-nd | 65 | cc by nc nd | cc by nc nd
cc-by-nc-sa-2.0 | 80 | cc by nc sa | cc by nc sa 2 0
cc-by-nc-sa-3.0 | 80 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-sa-4.0 | 80 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-sa | 65 | cc by nc sa | cc by nc sa
cc-by-nd-3.0 | 75 | cc by nd | cc by nd 3 0
cc-by-nd-4.0 | 75 | cc by nd | cc by nd 4 0
cc-by-nd | 60 | cc by nd | cc by nd
cc-by-sa-2.0 | 75 | cc by sa | cc by sa 2 0
cc-by-sa-2.5 | 75 | cc by sa | cc by sa 2 5
cc-by-sa-3.0 | 75 | cc by sa | cc by sa 3 0
cc-by-sa-4.0 | 75 | cc by sa | cc by sa 4 0
cc-by-sa | 60 | cc by sa | cc by sa
cc-by-4.0 | 80 | creativecommons org licenses by 4 | creativecommons org licenses by 4 0
cc-by-3.0 | 80 | creativecommons org licenses by 3 | creativecommons org licenses by 3 0
cc-by-sa-4.0 | 85 | creativecommons org licenses by sa 4 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 85 | creativecommons org licenses by sa 3 | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | 85 | creativecommons org licenses by nc 4 | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | 90 | creativecommons org licenses by nc sa 4 | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 90 | creativecommons org licenses by nc nd 4 | creativecommons org licenses by nc nd 4 0
cc-by-nd-4.0 | 85 | creativecommons org licenses by nd 4 | creativecommons org licenses by nd 4 0
cc-by-4.0 | 75 | creative commons attribution 4 | creative commons attribution 4 0(?: international)?(?: license)?
cc-by-3.0 | 75 | creative commons attribution 3 | creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-sa-4.0 | 80 | creative commons attribution share | creative commons attribution share ?alike 4 0(?: international)?(?: license)?
cc-by-sa-3.0 | 80 | creative commons attribution share | creative commons attribution share ?alike 3 0(?: unported)?(?: license)?
cc-by-sa | 65 | creative commons attribution share | creative commons attribution share ?alike(?: license)?
cc-by-nc-4.0 | 80 | creative commons attribution non | creative commons attribution non ?commercial 4 0(?: international)?(?: license)?
cc-by-nc | 65 | creative commons attribution non | creative commons attribution non ?commercial(?: license)?
cc-by-nd | 65 | creative commons attribution no | creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: 4 0)?(?: license)?
cc-by | 55 | creative commons attribution | creative commons attribution(?: license)?
cc | 40 | creative commons license | creative commons license
cc-pd | 60 | creative commons public domain | creative commons public domain(?: mark| dedication)?
cddl-1.0 | 70 | cddl | cddl (?:version |v )?1 0
cddl-1.1 | 70 | cddl | cddl (?:version |v )?1 1
cddl-1.0 | 75 | common development and distribution license | common development and distribution license (?:version |v )?1 0
cddl-1.1 | 75 | common development and distribution license | common development and distribution license (?:version |v )?1 1
cddl | 50 | common development and distribution license | common development and distribution license
cecill-2.1 | 70 | cecill | cecill (?:free software license agreement )?(?:version |v )?2 1
cecill-b | 70 | cecill b | cecill b(?: license)?
cecill-c | 70 | cecill c | cecill c(?: license)?
cecill | 50 | cecill | cecill
cpal-1.0 | 70 | common public attribution license | common public attribution license(?: (?:version )?1 0)?
cpl-1.0 | 70 | common public license | common public license(?: (?:version |v )?1 0)?
curl | 60 | curl license | curl license
ecl-2.0 | 70 | educational community license | educational community license(?: (?:version )?2 0)?
ecos-2.0 | 60 | ecos license | ecos license(?: (?:version )?2 0)?
efl-2.0 | 60 | eiffel forum license | eiffel forum license(?: (?:version )?2 0?)?
elastic-2.0 | 70 | elastic license | elastic license(?: (?:version )?2 0)?
epl-1.0 | 75 | eclipse public license | eclipse public license (?:version |v )?1 0
epl-2.0 | 75 | eclipse public license | eclipse public license (?:version |v )?2 0
epl | 50 | eclipse public license | eclipse public license
epl-1.0 | 80 | eclipse org legal epl v10 | (?:www )?eclipse org legal epl v10 html
epl-2.0 | 80 | eclipse org legal epl 2 0 | (?:www )?eclipse org legal epl 2 0
eupl-1.1 | 75 | european union public licen | european union public licen[cs]e (?:version |v )?1 1
eupl-1.2 | 75 | european union public licen | european union public licen[cs]e (?:version |v )?1 2
eupl | 50 | european union public licen | european union public licen[cs]e
eupl-1.2 | 70 | eupl | eupl (?:v )?1 2
fsfap | 55 | copying and distribution of this file | copying and distribution of this file with or without modification are permitted in any medium
ftl | 60 | freetype project license | freetype project license
fsl-1.1 | 65 | functional source license | functional source license(?: (?:version )?1 1)?
gfdl-1.1 | 75 | free documentation license | (?:gnu )?free documentation license (?:version |v )?1 1
gfdl-1.2 | 75 | free documentation license | (?:gnu )?free documentation license (?:version |v )?1 2
gfdl-1.3 | 75 | free documentation license | (?:gnu )?free documentation license (?:version |v )?1 3
gfdl | 50 | free documentation license | (?:gnu )?free documentation license
gfdl | 45 | gfdl | gfdl
gpl-1.0 | 75 | gnu general public license | gnu general public license (?:version |v ?)?1(?: 0)?
gpl-2.0 | 75 | gnu general public license | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?2(?: 0)?
gpl-3.0 | 75 | gnu general public license | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?3(?: 0)?
gpl-2.0-only | 85 | gnu general public license | gnu general public license (?:version |v ?)?2(?: 0)? only
gpl-3.0-only | 85 | gnu general public license | gnu general public license (?:version |v ?)?3(?: 0)? only
gpl-2.0-or-later | 85 | gnu general public license | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?2(?: 0)?(?: of the license)? or (?:at your option )?any later version
gpl-3.0-or-later | 85 | gnu general public license | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?3(?: 0)?(?: of the license)? or (?:at your option )?any later version
gpl | 45 | general public license | (?:gnu )?general public license
gpl-2.0 | 65 | gpl | (?:gnu )?gpl ?(?:v ?|version )?2(?: 0)?
gpl-3.0 | 65 | gpl | (?:gnu )?gpl ?(?:v ?|version )?3(?: 0)?
gpl-2.0-only | 80 | gpl 2 0 only | gpl 2 0 only
gpl-2.0-or-later | 80 | gpl 2 0 or later | gpl 2 0 or later
gpl-3.0-only | 80 | gpl 3 0 only | gpl 3 0 only
gpl-3.0-or-later | 80 | gpl 3 0 or later | gpl 3 0 or later
gpl | 60 | gnu org licenses gpl | (?:www )?gnu org licenses gpl(?: 3 0| 2 0)?(?: html| txt)?
gpl-cc | 55 | gpl cooperation commitment | gpl cooperation commitment
gpl-with-classpath | 70 | classpath exception | classpath exception(?: 2 0)?
gsoap | 55 | gsoap public license | gsoap public license
hpnd | 60 | historical permission notice and disclaimer | historical permission notice and disclaimer
ibm-pl | 60 | ibm public license | ibm public license(?: (?:version )?1 0)?
icu | 60 | icu license | icu license
ijg | 60 | independent jpeg group | independent jpeg group s? ?software
intel | 50 | intel open source license | intel open source license
isc | 70 | isc license | (?:the )?isc license
isc | 60 | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
json | 60 | shall be used for good not evil | the software shall be used for good not evil
lgpl-2.0 | 75 | library general public license | (?:gnu )?library general public license(?: (?:version |v ?)?2(?: 0)?)?
lgpl-2.1 | 75 | lesser general public license | (?:gnu )?lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?2 1
lgpl-3.0 | 75 | lesser general public license | (?:gnu )?lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?3(?: 0)?
lgpl-2.1-or-later | 85 | lesser general public license | (?:gnu )?lesser general public license (?:version |v ?)?2 1(?: of the license)? or (?:at your option )?any later version
lgpl-3.0-or-later | 85 | lesser general public license | (?:gnu )?lesser general public license (?:version |v ?)?3(?: 0)?(?: of the license)? or (?:at your option )?any later version
lgpl | 60 | lesser general public license | (?:gnu )?lesser general public license
lgpl-2.1 | 70 | lgpl | (?:gnu )?lgpl ?(?:v ?|version )?2 1
lgpl-3.0 | 70 | lgpl | (?:gnu )?lgpl ?(?:v ?|version )?3(?: 0)?
lgpl | 45 | lgpl | lgpl
libpng | 60 | libpng license | libpng license
llama-2 | 60 | llama 2 community license | llama 2 community license(?: agreement)?
llama-3 | 60 | llama 3 community license | llama 3 community license(?: agreement)?
lppl-1.3c | 70 | latex project public license | latex project public license (?:version |v )?1 3c?
lppl | 50 | latex project public license | latex project public license
mit | 70 | mit license | (?:the )?mit license
mit | 72 | mit license | (?:under|licensed under) the mit license
mit | 65 | mit licensed | mit licensed
mit | 75 | opensource org licenses mit | (?:www )?opensource org licenses mit(?: license)?(?: php)?
mit | 60 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit-0 | 75 | mit no attribution | mit no attribution(?: license)?
mit-0 | 75 | mit 0 license | mit 0 license
mit-x11 | 65 | x11 license | (?:mit )?x11 license
mpl-1.0 | 75 | mozilla public license | mozilla public license (?:version |v ?)?1 0
mpl-1.1 | 75 | mozilla public license | mozilla public license (?:version |v ?)?1 1
mpl-2.0 | 75 | mozilla public license | mozilla public license (?:version |v ?)?2 0
mpl | 50 | mozilla public license | mozilla public license
mpl-1.1 | 65 | mpl 1 1 | mpl 1 1
mpl-2.0 | 65 | mpl 2 0 | mpl 2 0
mpl-2.0 | 80 | mozilla org mpl 2 0 | mozilla org mpl 2 0
ms-pl | 70 | microsoft public license | microsoft public license
ms-rl | 70 | microsoft reciprocal license | microsoft reciprocal license
mulan-psl-2.0 | 70 | mulan psl | mulan psl ?v?2
mulan-psl-2.0 | 70 | mulan permissive software license | mulan permissive software license(?: (?:version |v )?2)?
ncsa | 70 | ncsa open source license | (?:university of illinois )?ncsa open source license
netcdf | 50 | netcdf license | netcdf license
npl-1.1 | 65 | netscape public license | netscape public license(?: (?:version )?1 1)?
odbl-1.0 | 70 | open database license | (?:open data commons )?open database license(?: (?:version |v )?1 0)?
odbl-1.0 | 65 | odbl | odbl(?: 1 0)?
odc-by-1.0 | 70 | open data commons attribution | open data commons attribution license(?: (?:version |v )?1 0)?
odc-by-1.0 | 65 | odc by | odc by(?: 1 0)?
ofl-1.0 | 70 | sil open font license | sil open font license (?:version |v )?1 0
ofl-1.1 | 70 | sil open font license | sil open font license (?:version |v )?1 1
ofl | 50 | open font license | (?:sil )?open font license
ogl-uk-3.0 | 70 | open government licen | open government licen[cs]e (?:version |v ?)?3(?: 0)?
ogl | 50 | open government licen | open government licen[cs]e
oldap-2.8 | 65 | openldap public license | openldap public license(?: (?:version )?2 8)?
openrail | 60 | openrail | (?:creativeml |bigscience )?(?:open ?rail)(?: m)?(?: license)?
openssl | 65 | openssl license | openssl license
osl-3.0 | 70 | open software license | open software license(?: (?:version |v )?3 0)?
pddl-1.0 | 70 | public domain dedication and license | public domain dedication and license(?: (?:version |v )?1 0)?
php-3.01 | 65 | php license | php license(?: (?:version |v )?3 01)?
polyform-nc | 65 | polyform noncommercial license | polyform noncommercial license(?: 1 0 0)?
polyform-sb | 65 | polyform small business license | polyform small business license(?: 1 0 0)?
postgresql | 65 | postgresql license | postgresql license
psf-2.0 | 65 | python software foundation license | python software foundation license(?: (?:version )?2)?
psf-2.0 | 65 | psf license | psf license
public-domain | 60 | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 55 | public domain | this (?:work|file|software|text|document) is in the public domain
qpl-1.0 | 65 | q public license | q public license(?: (?:version )?1 0)?
rpl-1.5 | 65 | reciprocal public license | reciprocal public license(?: (?:version )?1 5)?
rpsl-1.0 | 65 | realnetworks public source license | realnetworks public source license
ruby | 60 | ruby license | ruby license
ruby | 55 | same terms as ruby | same terms as ruby
perl | 55 | same terms as perl | same terms as perl(?: itself)?
sgi-b-2.0 | 65 | sgi free software license b | sgi free software license b(?: (?:version )?2 0)?
sleepycat | 60 | sleepycat license | sleepycat license
spl-1.0 | 60 | sun public license | sun public license
sspl-1.0 | 70 | server side public license | server side public license(?: (?:version |v )?1)?
tcl | 55 | tcl tk license | tcl tk license
unicode | 60 | unicode license agreement | unicode license agreement
unlicense | 70 | unlicense | (?:the )?unlicense(?: org)?
unlicense | 65 | free and unencumbered software | this is free and unencumbered software released into the public domain
upl-1.0 | 70 | universal permissive license | universal permissive license(?: (?:version |v )?1 0)?
vim | 60 | vim license | vim license
w3c | 65 | w3c software | w3c software (?:notice and license|and document license)
wtfpl | 70 | wtfpl | wtfpl
wtfpl | 70 | do what the fuck you want to public license | do what the fuck you want to public license
x11 | 50 | x consortium | x consortium license
zlib | 70 | zlib | zlib(?: libpng)? license
zlib | 55 | the origin of this software must not be misrepresented | the origin of this software must not be misrepresented
zpl-2.1 | 70 | zope public license | zope public license(?: (?:version |v )?2 1)?
all-rights-reserved | 30 | all rights reserved | all rights reserved
proprietary | 45 | proprietary and confidential | proprietary and confidential
proprietary | 45 | no part of this publication may be reproduced | no part of this publication may be reproduced
proprietary | 40 | end user license agreement | end user license agreement
spdx | 35 | spdx license identifier | spdx license identifier
unspecified | 20 | licensed under | (?:is |are )?licensed under(?: the)?
"""

#: The base phrases (words that stand consecutively) and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
