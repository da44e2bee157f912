"""Hand-written license signatures.

One signature a line under the label it gives: priority, confidence, expression. A blank is a gap between words (anything but
letters, digits and bytes above 7F), `<word>` is a keyword that every match holds, `?` after a group makes it optional.
Expressions are matched against lower-cased text. Priorities: 90 a license's own body, 80 its notice with a version, 60 an identifier
behind a tag, 55 a statement, 48 a grant without a version, 25 an abbreviation that stands alone.
"""

SIGNATURES = r"""
[mit]
50 0.9 licensed under (?:the )?<mit>
48 0.85 <mit> licensed
20 0.7 <mit> or apache
90 1.0 <permission> is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
90 0.95 <permission> is hereby granted free of charge to any person obtaining a copy of (?:this|the) software
90 0.9 the above copyright notice and this <permission> notice shall be included in all copies or substantial portions of the software
90 0.85 to use copy modify merge publish distribute <sublicense> and or sell copies of the software
80 0.85 in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of <contract>
60 1.0 <spdx> license identifier mit
60 0.95 license (?:text )?(?:is )?<mit> x11
48 0.9 (?:licensed|released|distributed|available) under (?:an )?<mit> style licen[cs]e
48 0.9 <mit> expat licen[cs]e
48 0.9 <expat> licen[cs]e
48 0.9 <x11> licen[cs]e
48 0.9 see the <mit> licen[cs]e (?:file )?for (?:more )?details
25 0.7 opensource org licenses <mit>
25 0.6 licen[cs]e <mit>
[mit-0]
90 1.0 to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute <sublicense> and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
60 1.0 <spdx> license identifier mit 0
48 0.9 <mit> 0 licen[cs]e
48 0.9 mit no <attribution> licen[cs]e
[isc]
90 1.0 <permission> to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
90 0.9 <permission> to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
60 1.0 <spdx> license identifier isc
48 0.9 internet systems <consortium> (?:isc )?licen[cs]e
25 0.7 opensource org licenses <isc>
[0bsd]
90 1.0 <permission> to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
60 1.0 <spdx> license identifier 0bsd
48 0.9 <0bsd>
48 0.9 zero clause <bsd>
[bsd]
90 0.9 <redistribution> and use in source and binary forms with or without modification are permitted
90 0.85 <redistribution> and use in source and binary forms
80 0.85 <redistributions> of source code must retain the above copyright notice this list of conditions and the following disclaimer
80 0.85 <redistributions> in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
48 0.85 (?:licensed|released|distributed|available) under (?:a|the) <bsd> (?:style )?licen[cs]e
48 0.85 use of this source code is governed by a <bsd> style licen[cs]e
48 0.8 <berkeley> software distribution licen[cs]e
25 0.6 <bsd> style licen[cs]e
25 0.6 <bsd> licen[cs]e
[bsd-2]
60 1.0 <spdx> license identifier bsd 2 clause
48 0.9 two clause <bsd> licen[cs]e
48 0.9 <bsd> two clause licen[cs]e
48 0.9 2 clause <bsd>
48 0.9 <freebsd> licen[cs]e
48 0.9 the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies either expressed or implied of the <freebsd> project
25 0.8 <bsd> 2 clause
[bsd-3]
90 0.95 nor the names of its contributors may be used to <endorse> or promote products derived from this software without specific prior written permission
60 1.0 <spdx> license identifier bsd 3 clause
48 0.9 three clause <bsd> licen[cs]e
48 0.9 <bsd> three clause licen[cs]e
48 0.9 3 clause <bsd>
25 0.8 <bsd> 3 clause
25 0.7 opensource org licenses <bsd> 3 clause
[bsd-4]
90 1.0 all advertising materials mentioning features or use of this software must display the following <acknowledgement>
60 1.0 <spdx> license identifier bsd 4 clause
48 0.9 4 clause <bsd>
25 0.8 <bsd> 4 clause
[apache-1.1]
60 1.0 <spdx> license identifier apache 1 1
80 0.95 the <apache> software license version 1 1
90 0.95 this product includes software developed by the <apache> software foundation
[apache-2]
90 1.0 <licensed> under the apache license version 2 0 the license you may not use this file except in compliance with the license
80 0.95 you may obtain a copy of the license at (?:https? )?(?:www )?<apache> org licenses license 2 0
80 0.9 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without <warranties> or conditions of any kind
90 0.95 terms and conditions for use <reproduction> and distribution 1 definitions
60 1.0 <spdx> license identifier apache 2 0
48 0.9 <apache> license v2(?: 0)?
48 0.9 <apache> licence version 2(?: 0)?
48 0.9 <apache> software license 2 0
48 0.85 licensed to the <apache> software foundation asf under one or more contributor license agreements
25 0.8 <apache> 2 0
25 0.7 <asl> 2 0
25 0.8 <apache> org licenses license 2 0
[gpl]
48 0.8 under the (?:terms of the )?<gpl>
90 0.85 this program is free software you can <redistribute> it and or modify it
90 0.8 this (?:program|library|file|package) is free software you can <redistribute> it
80 0.85 you should have received a copy of the <gnu> general public license along with this program
80 0.8 see the <gnu> general public license for more details
80 0.8 when we speak of free software we are referring to <freedom> not price
48 0.85 (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?<gnu> general public licen[cs]e
48 0.85 (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?<gpl>
48 0.8 under the (?:terms of the )?<gnu> gpl
25 0.7 <gnu> general public licen[cs]e
25 0.6 <gpl> licen[cs]ed
[gpl-1-or-later]
60 1.0 <spdx> license identifier gpl 1 0 or later
80 0.95 <gnu> general public license as published by the free software foundation either version 1
[gpl-2]
80 0.9 gnu general <public> licen[cs]e (?:version |v ?)2(?: 0)?
49 0.9 (?:under the )?(?:terms of the )?(?:gnu )?<gpl> v ?2(?: 0)?
49 0.9 (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?<gpl> (?:version |v)?2(?: 0)?
90 1.0 gnu general public license version 2 june <1991>
60 1.0 <spdx> license identifier gpl 2 0(?: only)?
80 0.95 <gnu> general public license version 2 as published by the free software foundation
80 0.95 under the terms of the <gnu> general public license v2
48 0.9 gnu <gpl> 2(?: 0)?
48 0.9 gnu <gpl> v2
48 0.9 <gpl> version 2(?: 0)?(?: only)?
25 0.8 <gpl> 2 0(?: only)?
25 0.8 <gplv2>
25 0.8 <gpl> v2(?: 0)?
25 0.7 <gpl2>
[gpl-2-or-later]
60 0.9 (?:under the )?(?:terms of the )?(?:gnu )?<gpl> v ?2(?: 0)? or (?:any )?later
60 1.0 <spdx> license identifier gpl 2 0 or later
95 1.0 this program is free software you can <redistribute> it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
80 1.0 (?:under the terms of the )?<gnu> general public license as published by the free software foundation either version 2 of the license or at your option any later version
80 0.95 <gnu> general public license version 2 or (?:at your option )?any later version
80 0.95 <gnu> general public license (?:version |v)2 or (?:later|newer)
48 0.9 <gpl> version 2 or (?:any )?(?:later|newer)
25 0.85 <gpl> 2 0 or later
25 0.85 <gplv2> or (?:any )?later
25 0.8 <gpl> v2 or (?:any )?later
[gpl-3]
80 0.9 gnu general <public> licen[cs]e (?:version |v ?)3(?: 0)?
49 0.9 (?:under the )?(?:terms of the )?(?:gnu )?<gpl> v ?3(?: 0)?
49 0.9 (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?<gpl> (?:version |v)?3(?: 0)?
90 1.0 gnu general public license version 3 29 june <2007>
60 1.0 <spdx> license identifier gpl 3 0(?: only)?
80 0.95 <gnu> general public license version 3 as published by the free software foundation
80 0.95 under the terms of the <gnu> general public license v3
48 0.9 gnu <gpl> 3(?: 0)?
48 0.9 gnu <gpl> v3
48 0.9 <gpl> version 3(?: 0)?(?: only)?
25 0.8 <gpl> 3 0(?: only)?
25 0.8 <gplv3>
25 0.8 <gpl> v3(?: 0)?
25 0.7 <gpl3>
[gpl-3-or-later]
60 0.9 (?:under the )?(?:terms of the )?(?:gnu )?<gpl> v ?3(?: 0)? or (?:any )?later
60 1.0 <spdx> license identifier gpl 3 0 or later
95 1.0 this program is free software you can <redistribute> it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
80 1.0 (?:under the terms of the )?<gnu> general public license as published by the free software foundation either version 3 of the license or at your option any later version
80 0.95 <gnu> general public license version 3 or (?:at your option )?any later version
80 0.95 <gnu> general public license (?:version |v)3 or (?:later|newer)
48 0.9 <gpl> version 3 or (?:any )?(?:later|newer)
25 0.85 <gpl> 3 0 or later
25 0.85 <gplv3> or (?:any )?later
25 0.8 <gpl> v3 or (?:any )?later
[gpl-classpath-exception]
80 0.95 as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an <executable>
60 1.0 with <classpath> exception 2 0
25 0.8 <classpath> exception
[lgpl]
90 0.85 this library is free software you can <redistribute> it and or modify it under the terms of the gnu lesser general public license
80 0.8 <gnu> lesser general public license for more details
48 0.85 (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?<lgpl>
25 0.7 <gnu> lesser general public licen[cs]e
25 0.7 <gnu> library general public licen[cs]e
[lgpl-2.1]
49 0.9 (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?<lgpl> (?:version |v)?2 1
90 1.0 gnu lesser general public license version 2 1 february <1999>
60 1.0 <spdx> license identifier lgpl 2 1(?: only)?
48 0.9 <lgpl> version 2 1
25 0.8 <lgpl> 2 1(?: only)?
25 0.8 <lgplv2> 1
[lgpl-2.1-or-later]
60 1.0 <spdx> license identifier lgpl 2 1 or later
80 1.0 (?:under the terms of the )?<gnu> lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
25 0.85 <lgpl> 2 1 or later
[lgpl-3]
49 0.9 (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?<lgpl> (?:version |v)?3(?: 0)?
90 1.0 gnu lesser general public license version 3 29 june <2007>
60 1.0 <spdx> license identifier lgpl 3 0(?: only)?
48 0.9 <lgpl> version 3
25 0.8 <lgpl> 3 0(?: only)?
25 0.8 <lgplv3>
[lgpl-3-or-later]
60 1.0 <spdx> license identifier lgpl 3 0 or later
80 1.0 (?:under the terms of the )?<gnu> lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
25 0.85 <lgpl> 3 0 or later
[agpl-3]
90 1.0 gnu affero general public license version 3 19 november <2007>
60 1.0 <spdx> license identifier agpl 3 0(?: only)?
80 0.9 gnu <affero> general public license for more details
48 0.9 under (?:the )?(?:terms of )?(?:the )?(?:gnu )?<affero> general public licen[cs]e
48 0.9 gnu <agpl>
25 0.8 <agpl> 3 0(?: only)?
25 0.8 <agplv3>
25 0.8 <agpl> v3
[agpl-3-or-later]
60 1.0 <spdx> license identifier agpl 3 0 or later
80 1.0 (?:under the terms of the )?gnu <affero> general public license as published by the free software foundation either version 3 of the license or at your option any later version
25 0.85 <agpl> 3 0 or later
[gfdl]
90 1.0 <permission> is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
60 1.0 <spdx> license identifier gfdl 1 [123]
48 0.9 gnu free <documentation> licen[cs]e version 1 [123]
25 0.8 <gfdl> 1 [123]
[mpl-1.1]
48 0.9 <mozilla> public licen[cs]e (?:version |v ?)1 1
60 1.0 <spdx> license identifier mpl 1 1
90 0.95 the contents of this file are subject to the <mozilla> public license version 1 1
25 0.8 <mpl> 1 1
[mpl-2]
48 0.9 <mozilla> public licen[cs]e (?:version |v ?)2(?: 0)?
90 1.0 this source code form is subject to the terms of the <mozilla> public license v 2 0
80 0.9 if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?<mozilla> org mpl 2 0
60 1.0 <spdx> license identifier mpl 2 0
48 0.9 <mozilla> public licen[cs]e 2 0
48 0.9 <mozilla> public licen[cs]e v2(?: 0)?
25 0.8 <mpl> 2 0
25 0.8 <mplv2>
[epl-1]
48 0.9 <eclipse> public licen[cs]e (?:version |v ?)1(?: 0)?
90 0.95 the accompanying program is provided under the terms of this <eclipse> public license
60 1.0 <spdx> license identifier epl 1 0
80 0.9 <eclipse> org legal epl v10
25 0.8 <epl> 1 0
[epl-2]
48 0.9 <eclipse> public licen[cs]e (?:version |v ?)2(?: 0)?
60 1.0 <spdx> license identifier epl 2 0
80 0.95 this program and the accompanying materials are made available under the terms of the <eclipse> public license 2 0
80 0.9 <eclipse> org legal epl 2 0
25 0.8 <epl> 2 0
[cddl-1]
60 1.0 <spdx> license identifier cddl 1 [01]
80 0.95 the contents of this file are subject to the terms of the common <development> and distribution license
25 0.8 <cddl> 1 [01]
[eupl-1.2]
60 1.0 <spdx> license identifier eupl 1 2
80 0.95 licensed under the <eupl> version 1 2
25 0.8 <eupl> 1 2
[artistic-1]
60 1.0 <spdx> license identifier artistic 1 0
90 0.95 the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of <artistic> control
[artistic-2]
60 1.0 <spdx> license identifier artistic 2 0
48 0.9 <artistic> licen[cs]e 2 0
48 0.85 same terms as <perl> itself
[zlib]
90 1.0 this software is provided as is without any express or implied <warranty> in no event will the authors be held liable for any damages arising from the use of this software
80 0.9 altered source versions must be plainly marked as such and must not be <misrepresented> as being the original software
60 1.0 <spdx> license identifier zlib
48 0.9 <libpng> licen[cs]e
[bsl-1]
90 1.0 <permission> is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
60 1.0 <spdx> license identifier bsl 1 0
80 0.95 distributed under the <boost> software license
80 0.9 <boost> org license 1 0 txt
[busl-1.1]
60 1.0 <spdx> license identifier busl 1 1
80 0.95 <business> source license 1 1
25 0.7 <business> source licen[cs]e
[sspl-1]
60 1.0 <spdx> license identifier sspl 1 0
80 0.95 server side public licen[cs]e version 1 <mongodb>
25 0.8 <server> side public licen[cs]e
[elastic-2]
60 1.0 <spdx> license identifier elastic 2 0
25 0.85 <elastic> licen[cs]e (?:version )?(?:v)?2 0
[unlicense]
90 1.0 this is free and <unencumbered> software released into the public domain
80 0.95 anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled <binary>
60 1.0 <spdx> license identifier unlicense
25 0.8 <unlicense> org
[wtfpl]
90 1.0 you just do what the <fuck> you want to
60 1.0 <spdx> license identifier wtfpl
25 0.8 <wtfpl>
[postgresql]
90 0.95 <permission> to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
60 1.0 <spdx> license identifier postgresql
[ncsa]
60 1.0 <spdx> license identifier ncsa
48 0.9 university of <illinois> (?:ncsa )?open source licen[cs]e
[python-2]
60 1.0 <spdx> license identifier (?:python|psf) 2 0
80 0.95 this license agreement is between the python software foundation psf and the individual or organization licensee <accessing> and otherwise using
48 0.9 <python> software foundation licen[cs]e
[php-3]
60 1.0 <spdx> license identifier php 3 01?
48 0.9 <php> licen[cs]e version 3 01?
[ruby]
60 1.0 <spdx> license identifier ruby
48 0.85 (?:licensed|released|distributed) under (?:the )?same (?:terms|licen[cs]e) as <ruby>
[openssl]
60 1.0 <spdx> license identifier openssl
90 0.95 this product includes software developed by the <openssl> project for use in the openssl toolkit
[curl]
60 1.0 <spdx> license identifier curl
[ofl-1.1]
90 1.0 this font software is licensed under the <sil> open font license version 1 1
60 1.0 <spdx> license identifier ofl 1 1
80 0.9 the goals of the open font license ofl are to stimulate worldwide development of <collaborative> font projects
25 0.8 <scripts> sil org ofl
[odbl-1]
60 1.0 <spdx> license identifier odbl 1 0
80 0.95 this (?:database|data) is made available under the open <database> licen[cs]e
25 0.8 <opendatacommons> org licenses odbl
25 0.7 <odbl>
[odc-by-1]
60 1.0 <spdx> license identifier odc by 1 0
25 0.8 <opendatacommons> org licenses by
[pddl-1]
60 1.0 <spdx> license identifier pddl 1 0
25 0.8 <opendatacommons> org licenses pddl
48 0.9 public <domain> dedication and licen[cs]e pddl
[cc0-1]
90 1.0 has <waived> all copyright and related or neighboring rights to
60 1.0 <spdx> license identifier cc0 1 0
80 0.95 <cc0> 1 0 universal
48 0.9 creative commons <zero>
48 0.9 <cc0> public domain dedication
25 0.8 <creativecommons> org publicdomain zero
25 0.8 <cc0> 1 0
[cc-pdm]
25 0.8 <creativecommons> org publicdomain mark
25 0.8 public domain <mark> 1 0
[cc-by]
80 0.95 <creative> commons attribution (?:4 0|3 0|2 5|2 0) (?:international|unported|generic)
80 0.95 this work is licensed under (?:a )?(?:the )?<creative> commons attribution
60 1.0 <spdx> license identifier cc by [1234] [05]
25 0.8 <creativecommons> org licenses by
25 0.8 cc <by> (?:4 0|3 0|2 5|2 0)
48 0.85 <creative> commons attribution licen[cs]e
[cc-by-sa]
80 0.95 <creative> commons attribution share ?alike (?:4 0|3 0|2 5|2 0) (?:international|unported|generic)
80 0.95 this work is licensed under (?:a )?(?:the )?<creative> commons attribution share ?alike
60 1.0 <spdx> license identifier cc by sa [1234] [05]
48 0.9 text is available under the <creative> commons attribution share ?alike licen[cs]e
25 0.8 <creativecommons> org licenses by sa
25 0.8 cc <by> sa(?: 4 0| 3 0| 2 5| 2 0)?
[cc-by-nd]
80 0.95 <creative> commons attribution no ?deriv(?:ative)?s (?:4 0|3 0|2 5|2 0) (?:international|unported|generic)
60 1.0 <spdx> license identifier cc by nd [1234] [05]
25 0.8 <creativecommons> org licenses by nd
25 0.8 cc <by> nd(?: 4 0| 3 0| 2 5| 2 0)?
[cc-by-nc]
80 0.95 <creative> commons attribution non ?commercial (?:4 0|3 0|2 5|2 0) (?:international|unported|generic)
80 0.95 this work is licensed under (?:a )?(?:the )?<creative> commons attribution non ?commercial
60 1.0 <spdx> license identifier cc by nc [1234] [05]
25 0.8 <creativecommons> org licenses by nc
25 0.8 cc <by> nc (?:4 0|3 0|2 5|2 0)
[cc-by-nc-sa]
80 0.95 <creative> commons attribution non ?commercial share ?alike (?:4 0|3 0|2 5|2 0) (?:international|unported|generic)
80 0.95 this work is licensed under (?:a )?(?:the )?<creative> commons attribution non ?commercial share ?alike
60 1.0 <spdx> license identifier cc by nc sa [1234] [05]
25 0.8 <creativecommons> org licenses by nc sa
25 0.8 cc <by> nc sa
[cc-by-nc-nd]
80 0.95 <creative> commons attribution non ?commercial no ?deriv(?:ative)?s (?:4 0|3 0|2 5|2 0) (?:international|unported|generic)
60 1.0 <spdx> license identifier cc by nc nd [1234] [05]
25 0.8 <creativecommons> org licenses by nc nd
25 0.8 cc <by> nc nd
[openrail]
60 0.95 <openrail> (?:m )?licen[cs]e
48 0.9 <bigscience> (?:rail|openrail m) licen[cs]e
25 0.8 <creativeml> openrail m
[llama]
48 0.9 <llama> (?:2|3|3 1) community licen[cs]e
[all-rights-reserved]
55 0.9 all <rights> (?:are )?reserved
55 0.8 alle <rechte> vorbehalten
55 0.8 tous <droits> r\xc3\xa9serv\xc3\xa9s
55 0.8 todos los <derechos> reservados
[public-domain]
55 0.9 (?:released|placed|dedicated|put) (?:in|into|to) the public <domain>
55 0.8 this (?:work|file|document|software|image) is in the public <domain>
55 0.8 <dedicated> to the public domain
[proprietary]
55 0.8 <proprietary> and confidential
55 0.8 confidential and <proprietary>
55 0.8 this is <unpublished> proprietary source code
55 0.75 <proprietary> licen[cs]e
[no-redistribution]
55 0.8 may not be (?:copied or )?<redistribut>ed
55 0.8 do not (?:copy or )?<redistribut>e (?:this|the|these|it|without)
55 0.8 no <redistribut>ion (?:is )?(?:allowed|permitted|without)
55 0.8 unauthorized copying of this file via any medium is strictly <prohibited>
55 0.8 may not be reproduced in any form without (?:the )?(?:prior |express )?(?:written )?<permission>
55 0.75 reproduction (?:in whole or in part )?without (?:written )?permission is <prohibited>
[personal-use]
55 0.7 for <personal> use only
55 0.7 <personal> use only
[non-commercial-use]
55 0.7 (?:for )?non ?<commercial> use only
55 0.7 not for <commercial> use
55 0.7 free for non ?<commercial> (?:use|purposes)
[evaluation-only]
55 0.7 for <evaluation> (?:purposes |use )?only
[end-user-license]
55 0.8 end user <license> agreement
55 0.7 by installing (?:or using )?(?:this|the) software you <agree> to
[research-only]
55 0.7 for <research> (?:purposes|use) only
55 0.7 for academic (?:and research )?use <only>
"""


def rules() -> list[tuple[str, int, float, str]]:
    """Label, priority, confidence and expression of every line."""
    out, label = [], ""
    for line in SIGNATURES.splitlines():
        if line.startswith("["):
            label = line[1:-1]
        elif line:
            priority, confidence, expression = line.split(" ", 2)
            out.append((label, int(priority), float(confidence), expression))
    return out
