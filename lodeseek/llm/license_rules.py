r"""The signature rules of the license scan, written by hand.

A line: license | priority | keywords | pattern. Every match holds one of the keywords (lower case, separated
by commas), which is what gates the pattern. In patterns a blank stands for blanks, line ends and comment
marks, as many as GAP allows; letters match in either case. Priorities: 90 machine-readable tags, 80 grants
and clauses of a license's own text, 70 notices that name license and version, 50 names, 30 abbreviations
and clues, 10 words that only say that some license or copyright is there.
"""

GAP = r"[\s*#/;>|\"'-]{1,12}"

RULES = r"""
GPL-1.0-only | 90 | spdx | spdx-license-identifier: ?gpl-1\.0(?:-only)?(?![\w.+-])
GPL-1.0-or-later | 90 | spdx | spdx-license-identifier: ?gpl-1\.0(?:\+|-or-later)
GPL-2.0-only | 90 | spdx | spdx-license-identifier: ?gpl-2\.0(?:-only)?(?![\w.+-])
GPL-2.0-or-later | 90 | spdx | spdx-license-identifier: ?gpl-2\.0(?:\+|-or-later)
GPL-3.0-only | 90 | spdx | spdx-license-identifier: ?gpl-3\.0(?:-only)?(?![\w.+-])
GPL-3.0-or-later | 90 | spdx | spdx-license-identifier: ?gpl-3\.0(?:\+|-or-later)
LGPL-2.0-or-later | 90 | spdx | spdx-license-identifier: ?lgpl-2\.0(?:\+|-or-later|-only)?(?![\w.-])
LGPL-2.1-only | 90 | spdx | spdx-license-identifier: ?lgpl-2\.1(?:-only)?(?![\w.+-])
LGPL-2.1-or-later | 90 | spdx | spdx-license-identifier: ?lgpl-2\.1(?:\+|-or-later)
LGPL-3.0-only | 90 | spdx | spdx-license-identifier: ?lgpl-3\.0(?:-only)?(?![\w.+-])
LGPL-3.0-or-later | 90 | spdx | spdx-license-identifier: ?lgpl-3\.0(?:\+|-or-later)
AGPL-3.0-only | 90 | spdx | spdx-license-identifier: ?agpl-3\.0(?:-only)?(?![\w.+-])
AGPL-3.0-or-later | 90 | spdx | spdx-license-identifier: ?agpl-3\.0(?:\+|-or-later)
MIT | 90 | spdx | spdx-license-identifier: ?mit(?![\w.-])
MIT-0 | 90 | spdx | spdx-license-identifier: ?mit-0(?![\w.-])
Apache-1.1 | 90 | spdx | spdx-license-identifier: ?apache-1\.1(?![\w.-])
Apache-2.0 | 90 | spdx | spdx-license-identifier: ?apache-2\.0(?![\w.-])
0BSD | 90 | spdx | spdx-license-identifier: ?0bsd(?![\w.-])
BSD-2-Clause | 90 | spdx | spdx-license-identifier: ?bsd-2-clause(?:-patent|-views)?(?![\w.-])
BSD-3-Clause | 90 | spdx | spdx-license-identifier: ?bsd-3-clause(?:-clear|-lbnl)?(?![\w.-])
BSD-4-Clause | 90 | spdx | spdx-license-identifier: ?bsd-4-clause(?![\w.-])
ISC | 90 | spdx | spdx-license-identifier: ?isc(?![\w.-])
MPL-1.1 | 90 | spdx | spdx-license-identifier: ?mpl-1\.[01](?![\w.-])
MPL-2.0 | 90 | spdx | spdx-license-identifier: ?mpl-2\.0(?:-no-copyleft-exception)?(?![\w.-])
EPL-1.0 | 90 | spdx | spdx-license-identifier: ?epl-1\.0(?![\w.-])
EPL-2.0 | 90 | spdx | spdx-license-identifier: ?epl-2\.0(?![\w.-])
CDDL-1.0 | 90 | spdx | spdx-license-identifier: ?cddl-1\.[01](?![\w.-])
EUPL-1.2 | 90 | spdx | spdx-license-identifier: ?eupl-1\.[012](?![\w.-])
BSL-1.0 | 90 | spdx | spdx-license-identifier: ?bsl-1\.0(?![\w.-])
Zlib | 90 | spdx | spdx-license-identifier: ?zlib(?![\w.-])
Unlicense | 90 | spdx | spdx-license-identifier: ?unlicense(?![\w.-])
WTFPL | 90 | spdx | spdx-license-identifier: ?wtfpl(?![\w.-])
CC0-1.0 | 90 | spdx | spdx-license-identifier: ?cc0-1\.0(?![\w.-])
CC-BY-4.0 | 90 | spdx | spdx-license-identifier: ?cc-by-[1-4]\.[05](?![\w.-])
CC-BY-SA-4.0 | 90 | spdx | spdx-license-identifier: ?cc-by-sa-[1-4]\.[05](?![\w.-])
CC-BY-NC-4.0 | 90 | spdx | spdx-license-identifier: ?cc-by-nc-[1-4]\.[05](?![\w.-])
CC-BY-ND-4.0 | 90 | spdx | spdx-license-identifier: ?cc-by-nd-[1-4]\.[05](?![\w.-])
CC-BY-NC-SA-4.0 | 90 | spdx | spdx-license-identifier: ?cc-by-nc-sa-[1-4]\.[05](?![\w.-])
CC-BY-NC-ND-4.0 | 90 | spdx | spdx-license-identifier: ?cc-by-nc-nd-[1-4]\.[05](?![\w.-])
OFL-1.1 | 90 | spdx | spdx-license-identifier: ?ofl-1\.[01](?![\w.-])
Artistic-2.0 | 90 | spdx | spdx-license-identifier: ?artistic-[12]\.0(?![\w.-])
PSF-2.0 | 90 | spdx | spdx-license-identifier: ?(?:psf-2\.0|python-2\.0(?:\.1)?)(?![\w.-])
PostgreSQL | 90 | spdx | spdx-license-identifier: ?postgresql(?![\w.-])
NCSA | 90 | spdx | spdx-license-identifier: ?ncsa(?![\w.-])
AFL-3.0 | 90 | spdx | spdx-license-identifier: ?afl-[123]\.[0-2](?![\w.-])
OSL-3.0 | 90 | spdx | spdx-license-identifier: ?osl-[123]\.[01](?![\w.-])
MS-PL | 90 | spdx | spdx-license-identifier: ?ms-pl(?![\w.-])
MS-RL | 90 | spdx | spdx-license-identifier: ?ms-rl(?![\w.-])
SSPL-1.0 | 90 | spdx | spdx-license-identifier: ?sspl-1\.0(?![\w.-])
BUSL-1.1 | 90 | spdx | spdx-license-identifier: ?busl-1\.1(?![\w.-])
LicenseRef | 90 | spdx | spdx-license-identifier: ?licenseref-[\w.-]{1,60}
unknown-spdx | 10 | spdx | spdx-license-identifier: ?\(?[\w.+-]{1,60}
GPL-1.0-or-later | 70 | gnu | gnu general public licen[cs]e,? (?:version|v\.?) ?1(?:\.0)?(?![\d.]\d)
GPL-2.0-only | 70 | gnu | gnu general public licen[cs]e,? (?:\(gpl\),? )?(?:version|v\.?) ?2(?:\.0)?(?![\d.]\d)
GPL-3.0-only | 70 | gnu | gnu general public licen[cs]e,? (?:\(gpl\),? )?(?:version|v\.?) ?3(?:\.0)?(?![\d.]\d)
GPL-2.0-only | 70 | gnu | version 2 of the gnu general public licen[cs]e
GPL-3.0-only | 70 | gnu | version 3 of the gnu general public licen[cs]e
GPL-2.0-or-later | 75 | gnu | gnu general public licen[cs]e as published by the free software foundation[;,] either version 2 of the licen[cs]e,? or \(?at your option\)? any later version
GPL-3.0-or-later | 75 | gnu | gnu general public licen[cs]e as published by the free software foundation[;,] either version 3 of the licen[cs]e,? or \(?at your option\)? any later version
GPL-1.0-or-later | 75 | gnu | gnu general public licen[cs]e as published by the free software foundation[;,] either version 1,? or \(?at your option\)? any later version
GPL-2.0-only | 72 | gnu | gnu general public licen[cs]e version 2 as published by the free software foundation
GPL-3.0-only | 72 | gnu | gnu general public licen[cs]e version 3 as published by the free software foundation
GPL-2.0-or-later | 74 | gnu | gnu general public licen[cs]e,? (?:version|v\.?) ?2(?:\.0)?,? or (?:\(at your option\) )?(?:any )?(?:later|newer)(?: version)?
GPL-3.0-or-later | 74 | gnu | gnu general public licen[cs]e,? (?:version|v\.?) ?3(?:\.0)?,? or (?:\(at your option\) )?(?:any )?(?:later|newer)(?: version)?
GPL-1.0-or-later | 50 | gnu | gnu general public licen[cs]e
GPL-1.0-or-later | 48 | general | (?<!lesser\x20)(?<!library\x20)(?<!affero\x20)general public licen[cs]e
GPL-2.0-only | 60 | gpl | (?<![\w-])gpl[- ]?v?2(?:\.0)?(?!\.?\d|\+)(?![- ]or)
GPL-2.0-or-later | 62 | gpl | (?<![\w-])gpl[- ]?v?2(?:\.0)?(?:\+| or (?:any )?later|-or-later)
GPL-3.0-only | 60 | gpl | (?<![\w-])gpl[- ]?v?3(?:\.0)?(?!\.?\d|\+)(?![- ]or)
GPL-3.0-or-later | 62 | gpl | (?<![\w-])gpl[- ]?v?3(?:\.0)?(?:\+| or (?:any )?later|-or-later)
GPL-1.0-or-later | 30 | gpl | (?<![\w-])gpl(?![\w-])
GPL-1.0-or-later | 80 | copyleft | the gnu general public licen[cs]e is a free,? copyleft licen[cs]e
GPL-3.0-only | 80 | 2007 | gnu general public licen[cs]e version 3,? 29 june 2007
GPL-2.0-only | 80 | 1991 | gnu general public licen[cs]e version 2,? june 1991
GPL-1.0-or-later | 40 | gpl | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?gpl(?![\w-])
GPL-2.0-with-classpath-exception | 76 | classpath | gpl(?:v2|-2\.0| version 2)? with (?:the )?classpath exception
GPL-2.0-with-classpath-exception | 70 | classpath | subject to the ["']?classpath["']? exception
GPL-3.0-with-GCC-exception | 70 | gcc | gcc runtime library exception
LGPL-2.0-or-later | 70 | gnu | gnu library general public licen[cs]e(?:,? (?:version|v\.?) ?2(?:\.0)?)?
LGPL-2.1-only | 70 | lesser | gnu lesser general public licen[cs]e,? (?:\(lgpl\),? )?(?:version|v\.?) ?2\.1(?!\d)
LGPL-3.0-only | 70 | lesser | gnu lesser general public licen[cs]e,? (?:\(lgpl\),? )?(?:version|v\.?) ?3(?:\.0)?(?![\d.]\d)
LGPL-2.1-or-later | 75 | lesser | gnu lesser general public licen[cs]e as published by the free software foundation[;,] either version 2\.1 of the licen[cs]e,? or \(?at your option\)? any later version
LGPL-3.0-or-later | 75 | lesser | gnu lesser general public licen[cs]e as published by the free software foundation[;,] either version 3 of the licen[cs]e,? or \(?at your option\)? any later version
LGPL-2.0-or-later | 75 | gnu | gnu library general public licen[cs]e as published by the free software foundation[;,] either version 2 of the licen[cs]e,? or \(?at your option\)? any later version
LGPL-2.1-or-later | 74 | lesser | gnu lesser general public licen[cs]e,? (?:version|v\.?) ?2\.1,? or (?:\(at your option\) )?(?:any )?later
LGPL-2.0-or-later | 52 | lesser | gnu lesser general public licen[cs]e
LGPL-2.0-or-later | 50 | lesser | lesser general public licen[cs]e
LGPL-2.1-only | 60 | lgpl | (?<![\w-])lgpl[- ]?v?2\.1(?!\d|\+)(?![- ]or)
LGPL-2.1-or-later | 62 | lgpl | (?<![\w-])lgpl[- ]?v?2\.1(?:\+| or later|-or-later)
LGPL-3.0-only | 60 | lgpl | (?<![\w-])lgpl[- ]?v?3(?:\.0)?(?!\.?\d|\+)(?![- ]or)
LGPL-3.0-or-later | 62 | lgpl | (?<![\w-])lgpl[- ]?v?3(?:\.0)?(?:\+| or later|-or-later)
LGPL-2.0-or-later | 30 | lgpl | (?<![\w-])lgpl(?![\w-])
AGPL-3.0-only | 70 | affero | gnu affero general public licen[cs]e,? (?:\(agpl\),? )?(?:version|v\.?) ?3(?:\.0)?(?![\d.]\d)
AGPL-3.0-or-later | 75 | affero | gnu affero general public licen[cs]e as published by the free software foundation[;,] either version 3 of the licen[cs]e,? or \(?at your option\)? any later version
AGPL-3.0-only | 80 | affero | gnu affero general public licen[cs]e version 3,? 19 november 2007
AGPL-1.0-only | 70 | affero | affero general public licen[cs]e,? (?:version|v\.?) ?1(?:\.0)?
AGPL-3.0-only | 52 | affero | (?:gnu )?affero general public licen[cs]e
AGPL-3.0-only | 60 | agpl | (?<![\w-])agpl[- ]?v?3(?:\.0)?(?!\.?\d|\+)
AGPL-3.0-or-later | 62 | agpl | (?<![\w-])agpl[- ]?v?3(?:\.0)?(?:\+| or later|-or-later)
AGPL-3.0-only | 30 | agpl | (?<![\w-])agpl(?![\w-])
GFDL-1.3 | 70 | documentation | gnu free documentation licen[cs]e,? (?:version|v\.?) ?1\.[123]
GFDL-1.3 | 50 | documentation | gnu free documentation licen[cs]e
GFDL-1.3 | 30 | gfdl | (?<![\w-])gfdl(?:[- ]?v?1\.[123])?(?![\w-])
Apache-2.0 | 70 | apache | apache licen[cs]e,? (?:\(?(?:version|v\.?)? ?2(?:\.0)?)(?![\d.]\d)\)?
Apache-2.0 | 75 | apache | licensed under the apache licen[cs]e,? version 2\.0(?: \(the ["']?license["']?\))?
Apache-2.0 | 80 | apache | licensed to the apache software foundation \(asf\) under one or more contributor licen[cs]e agreements
Apache-2.0 | 80 | apache.org | you may obtain a copy of the licen[cs]e at https?://www\.apache\.org/licenses/license-2\.0
Apache-2.0 | 60 | apache.org | https?://(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
Apache-2.0 | 80 | 2004 | apache licen[cs]e version 2\.0,? january 2004
Apache-2.0 | 60 | apache | (?<![\w-])apache[- ]?(?:v|version )?2(?:\.0)?(?![\w.-]*\w)
Apache-2.0 | 52 | asl | (?<![\w-])asl[- ]?(?:v|version )?2(?:\.0)?(?![\w.-])
Apache-1.1 | 70 | apache | apache (?:software )?licen[cs]e,? (?:version|v\.?) ?1\.1
Apache-1.0 | 70 | apache | apache (?:software )?licen[cs]e,? (?:version|v\.?) ?1\.0
Apache-1.1 | 80 | apache | this product includes software developed by the apache software foundation
Apache-2.0 | 50 | apache | (?:the )?apache (?:software )?licen[cs]e
Apache-2.0 | 30 | apache | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache(?![\w-])
MIT | 70 | mit | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit licen[cs]e
MIT | 60 | mit | (?<![\w-])(?:the )?mit licen[cs]e(?: \(mit\))?
MIT | 50 | mit | (?<![\w-])mit[- ]licensed(?!\w)
MIT | 50 | mit | licen[cs]e: ?mit(?![\w-])
MIT | 45 | mit | (?:licensed|released|distributed|available) under (?:the )?mit(?![\w-])
MIT | 60 | opensource.org | https?://(?:www\.)?opensource\.org/licenses?/mit(?:-license)?(?:\.php|\.html)?
MIT | 80 | hereby | permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files
MIT | 79 | sublicense | to use,? copy,? modify,? merge,? publish,? distribute,? sublicense,? and/or sell copies of the software
MIT | 78 | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
X11 | 70 | x11 | (?<![\w-])(?:the )?x11 licen[cs]e
Expat | 70 | expat | (?<![\w-])(?:the )?expat licen[cs]e
MIT-0 | 70 | mit | (?<![\w-])mit(?: no attribution|-0)(?: licen[cs]e)?
MIT-Modern-Variant | 78 | documentation | permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose
BSD-2-Clause | 70 | bsd | (?<![\w-])(?:simplified|2[- ]clause|two[- ]clause|freebsd) bsd licen[cs]e
BSD-2-Clause | 70 | bsd | (?<![\w-])bsd[- ]2[- ]clause(?: ["']?simplified["']?)?(?: licen[cs]e)?
BSD-2-Clause | 68 | bsd | bsd licen[cs]e \(2[- ]clause\)
BSD-3-Clause | 70 | bsd | (?<![\w-])(?:new|modified|revised|3[- ]clause|three[- ]clause) bsd licen[cs]e
BSD-3-Clause | 70 | bsd | (?<![\w-])bsd[- ]3[- ]clause(?: ["']?(?:new|revised)["']?)?(?: licen[cs]e)?
BSD-3-Clause | 68 | bsd | bsd licen[cs]e \(3[- ]clause\)
BSD-4-Clause | 70 | bsd | (?<![\w-])(?:original|old|4[- ]clause|four[- ]clause) bsd licen[cs]e
BSD-4-Clause | 70 | bsd | (?<![\w-])bsd[- ]4[- ]clause(?: licen[cs]e)?
BSD-4-Clause | 80 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
BSD-3-Clause | 80 | endorse | neither the names? of [^.\n]{1,120} nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software
BSD-3-Clause | 60 | governed | use of this source code is governed by a bsd-style licen[cs]e
BSD-2-Clause | 78 | redistribution | redistribution and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met
BSD-2-Clause | 76 | redistributions | redistributions of source code must retain the above copyright notice,? this list of conditions and the following disclaimer
BSD-2-Clause | 76 | redistributions | redistributions in binary form must reproduce the above copyright notice,? this list of conditions and the following disclaimer
0BSD | 70 | bsd | (?<![\w-])(?:zero[- ]clause bsd|0bsd|bsd[- ]0[- ]clause|bsd zero clause)(?: licen[cs]e)?
BSD-3-Clause | 50 | bsd | (?<![\w-])(?:the )?bsd(?:-style)? licen[cs]e
BSD-3-Clause | 45 | bsd | (?:licensed|released|distributed|available) under (?:the )?bsd(?![\w-])
BSD-3-Clause | 60 | opensource.org | https?://(?:www\.)?opensource\.org/licenses?/bsd-[234]-clause
ISC | 70 | isc | (?<![\w-])(?:the )?isc licen[cs]e
ISC | 80 | hereby | permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
ISC | 50 | isc | licen[cs]e: ?isc(?![\w-])
MPL-1.0 | 70 | mozilla | mozilla public licen[cs]e,? (?:version|v\.?) ?1\.0
MPL-1.1 | 70 | mozilla | mozilla public licen[cs]e,? (?:version|v\.?) ?1\.1
MPL-2.0 | 70 | mozilla | mozilla public licen[cs]e,? (?:\(?(?:version|v\.?)?) ?2\.0\)?
MPL-2.0 | 80 | mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e,? v\.? ?2\.0
MPL-1.1 | 80 | mozilla | the contents of this file are subject to the mozilla public licen[cs]e version 1\.1
MPL-2.0 | 60 | mozilla.org | https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0
MPL-2.0 | 50 | mozilla | mozilla public licen[cs]e
MPL-2.0 | 60 | mpl | (?<![\w-])mpl[- ]?(?:v|version )?2(?:\.0)?(?![\w.-])
MPL-1.1 | 60 | mpl | (?<![\w-])mpl[- ]?(?:v|version )?1\.1(?![\w.-])
EPL-1.0 | 70 | eclipse | eclipse public licen[cs]e,?(?: -)? ?(?:version|v\.?) ?1\.0
EPL-2.0 | 70 | eclipse | eclipse public licen[cs]e,?(?: -)? ?(?:version|v\.?)? ?2\.0
EPL-1.0 | 50 | eclipse | eclipse public licen[cs]e
EDL-1.0 | 70 | eclipse | eclipse distribution licen[cs]e(?:,? (?:version|v\.?) ?1\.0)?
EPL-2.0 | 60 | epl | (?<![\w-])epl[- ]?(?:v|version )?2(?:\.0)?(?![\w.-])
EPL-1.0 | 60 | epl | (?<![\w-])epl[- ]?(?:v|version )?1(?:\.0)?(?![\w.-])
CPL-1.0 | 70 | common | common public licen[cs]e(?:,? (?:version|v\.?) ?1\.0)?
IPL-1.0 | 70 | ibm | ibm public licen[cs]e(?:,? (?:version|v\.?) ?1\.0)?
CDDL-1.0 | 70 | development | common development and distribution licen[cs]e(?: \(cddl\))?(?:,? (?:version|v\.?) ?1\.0)?
CDDL-1.1 | 72 | development | common development and distribution licen[cs]e(?: \(cddl\))?,? (?:version|v\.?) ?1\.1
CDDL-1.0 | 50 | cddl | (?<![\w-])cddl(?:[- ]?v?1\.[01])?(?![\w-])
EUPL-1.1 | 70 | european | european union public licen[cs]e,? (?:version|v\.?) ?1\.1
EUPL-1.2 | 70 | european | european union public licen[cs]e(?:,? (?:version|v\.?) ?1\.2)?
EUPL-1.2 | 50 | eupl | (?<![\w-])eupl(?:[- ]?v?1\.[012])?(?![\w-])
CeCILL-2.1 | 70 | cecill | (?<![\w-])cecill(?:-b|-c)?(?:[- ](?:v|version )?[12]\.[01])?(?: licen[cs]e)?(?![\w-])
BSL-1.0 | 70 | boost | boost software licen[cs]e(?:,? (?:version|v\.?)? ?1\.0)?
BSL-1.0 | 80 | boost | distributed under the boost software licen[cs]e,? version 1\.0
BUSL-1.1 | 70 | business | business source licen[cs]e(?:,? (?:version|v\.?)? ?1\.1)?
SSPL-1.0 | 70 | server | server side public licen[cs]e(?:,? (?:version|v\.?) ?1)?
Elastic-2.0 | 70 | elastic | (?<![\w-])elastic licen[cs]e(?:,? (?:version|v\.?)? ?2\.0)?
Commons-Clause | 70 | clause | commons clause(?: licen[cs]e)? condition(?: v1\.0)?
Commons-Clause | 50 | clause | (?<![\w-])commons clause(?![\w-])
PolyForm-Noncommercial-1.0.0 | 70 | polyform | polyform noncommercial licen[cs]e(?: 1\.0\.0)?
PolyForm-Shield-1.0.0 | 70 | polyform | polyform shield licen[cs]e(?: 1\.0\.0)?
Zlib | 70 | zlib | (?<![\w-])(?:the )?zlib(?:/libpng)? licen[cs]e
Zlib | 80 | as-is | this software is provided ["']?as-is["']?,? without any express or implied warranty\.? in no event will the authors be held liable
Zlib | 78 | misrepresented | the origin of this software must not be misrepresented
Libpng | 70 | libpng | (?<![\w-])(?:the )?libpng licen[cs]e
Unlicense | 70 | unlicense | (?<![\w-])(?:the )?unlicense(?![\w-])
Unlicense | 80 | unencumbered | this is free and unencumbered software released into the public domain
Unlicense | 60 | unlicense.org | https?://(?:www\.)?unlicense\.org
WTFPL | 70 | want | do what the f(?:uck|\*{1,3}k?) you want to public licen[cs]e
WTFPL | 60 | wtfpl | (?<![\w-])wtfpl(?![\w-])
Beerware | 70 | beer | (?:the )?beer-?ware licen[cs]e(?: \(revision 42\))?
CC0-1.0 | 70 | cc0 | (?<![\w-])cc0(?:[- ](?:v|version )?1\.0)?(?: universal)?(?: public domain dedication)?(?![\w-])
CC0-1.0 | 72 | cc0, zero | creative commons (?:cc0|zero)(?:,? v?1\.0)?(?: universal)?
CC0-1.0 | 72 | publicdomain/zero | https?://creativecommons\.org/publicdomain/zero/1\.0
CC-BY-1.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by[- ]1\.0(?![\w-])
CC-BY-2.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by[- ]2\.[05](?![\w-])
CC-BY-3.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by[- ]3\.0(?![\w-])
CC-BY-4.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by[- ]4\.0(?![\w-])
CC-BY-SA-2.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by-sa[- ]2\.[05](?![\w-])
CC-BY-SA-3.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by-sa[- ]3\.0(?![\w-])
CC-BY-SA-4.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by-sa[- ]4\.0(?![\w-])
CC-BY-NC-2.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by-nc[- ]2\.[05](?![\w-])
CC-BY-NC-3.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by-nc[- ]3\.0(?![\w-])
CC-BY-NC-4.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by-nc[- ]4\.0(?![\w-])
CC-BY-ND-3.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by-nd[- ]3\.0(?![\w-])
CC-BY-ND-4.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by-nd[- ]4\.0(?![\w-])
CC-BY-NC-SA-3.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by-nc-sa[- ]3\.0(?![\w-])
CC-BY-NC-SA-4.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by-nc-sa[- ]4\.0(?![\w-])
CC-BY-NC-ND-3.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by-nc-nd[- ]3\.0(?![\w-])
CC-BY-NC-ND-4.0 | 70 | cc by, cc-by | (?<![\w-])cc[- ]by-nc-nd[- ]4\.0(?![\w-])
CC-BY-NC | 40 | cc by, cc-by | (?<![\w-])cc[- ]by-nc(?![\w-])
CC-BY-SA | 40 | cc by, cc-by | (?<![\w-])cc[- ]by-sa(?![\w-])
CC-BY | 30 | cc by, cc-by | (?<![\w-])cc[- ]by(?![\w-])
CC-BY-4.0 | 74 | creative | creative commons attribution 4\.0(?: international)?(?: (?:public )?licen[cs]e)?
CC-BY-3.0 | 74 | creative | creative commons attribution 3\.0(?: unported)?(?: licen[cs]e)?
CC-BY-2.0 | 74 | creative | creative commons attribution 2\.[05](?: generic)?(?: licen[cs]e)?
CC-BY-SA-4.0 | 74 | creative | creative commons attribution[- ]share ?alike 4\.0(?: international)?(?: (?:public )?licen[cs]e)?
CC-BY-SA-3.0 | 74 | creative | creative commons attribution[- ]share ?alike 3\.0(?: unported)?(?: licen[cs]e)?
CC-BY-NC-4.0 | 74 | creative | creative commons attribution[- ]non-?commercial 4\.0(?: international)?(?: (?:public )?licen[cs]e)?
CC-BY-NC-3.0 | 74 | creative | creative commons attribution[- ]non-?commercial 3\.0(?: unported)?(?: licen[cs]e)?
CC-BY-ND-4.0 | 74 | creative | creative commons attribution[- ]no-?deriv(?:ative)?s? 4\.0(?: international)?(?: (?:public )?licen[cs]e)?
CC-BY-NC-SA-4.0 | 74 | creative | creative commons attribution[- ]non-?commercial[- ]share ?alike 4\.0(?: international)?(?: (?:public )?licen[cs]e)?
CC-BY-NC-ND-4.0 | 74 | creative | creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s? 4\.0(?: international)?(?: (?:public )?licen[cs]e)?
CC-BY | 50 | creative | creative commons attribution(?: licen[cs]e)?
CC-unknown | 30 | creative | creative commons(?: (?:public )?licen[cs]e)?
CC-BY-4.0 | 72 | creativecommons.org | https?://creativecommons\.org/licenses/by/4\.0
CC-BY-3.0 | 72 | creativecommons.org | https?://creativecommons\.org/licenses/by/3\.0
CC-BY-SA-4.0 | 72 | creativecommons.org | https?://creativecommons\.org/licenses/by-sa/4\.0
CC-BY-SA-3.0 | 72 | creativecommons.org | https?://creativecommons\.org/licenses/by-sa/3\.0
CC-BY-NC-4.0 | 72 | creativecommons.org | https?://creativecommons\.org/licenses/by-nc/4\.0
CC-BY-ND-4.0 | 72 | creativecommons.org | https?://creativecommons\.org/licenses/by-nd/4\.0
CC-BY-NC-SA-4.0 | 72 | creativecommons.org | https?://creativecommons\.org/licenses/by-nc-sa/4\.0
CC-BY-NC-ND-4.0 | 72 | creativecommons.org | https?://creativecommons\.org/licenses/by-nc-nd/4\.0
CC-unknown | 45 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/[a-z-]{2,12}/[1-4]\.[05]
CC-PDM-1.0 | 70 | publicdomain/mark | https?://creativecommons\.org/publicdomain/mark/1\.0
public-domain | 60 | domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | 58 | domain | (?:this (?:work|file|software|text|code)|it) is (?:hereby )?(?:in|part of) the public domain
public-domain | 30 | domain | (?<![\w-])public domain(?![\w-])
PDDL-1.0 | 70 | dedication | (?:open data commons )?public domain dedication and licen[cs]e(?: \(pddl\))?
ODbL-1.0 | 70 | database | (?:open data commons )?open database licen[cs]e(?: \(odbl\))?(?: v?1\.0)?
ODbL-1.0 | 50 | odbl | (?<![\w-])odbl(?:[- ]?v?1\.0)?(?![\w-])
ODC-By-1.0 | 70 | commons | open data commons attribution licen[cs]e(?: v?1\.0)?
OGL-UK-3.0 | 70 | government | open government licen[cs]e(?: v?3\.0)?
OFL-1.1 | 70 | font | (?:sil )?open font licen[cs]e(?:,? (?:version|v\.?) ?1\.1)?
OFL-1.1 | 60 | scripts.sil.org | https?://scripts\.sil\.org/ofl
Artistic-1.0 | 70 | artistic | artistic licen[cs]e,? (?:version |v\.? ?)?1\.0
Artistic-2.0 | 70 | artistic | artistic licen[cs]e,? (?:version |v\.? ?)?2\.0
Artistic-1.0 | 50 | artistic | (?<![\w-])(?:the )?(?:perl )?artistic licen[cs]e
Artistic-1.0-Perl | 70 | perl | under the same terms as perl(?: itself)?
Ruby | 70 | ruby | (?<![\w-])(?:the )?ruby licen[cs]e
PHP-3.01 | 70 | php | (?<![\w-])(?:the )?php licen[cs]e(?:,? (?:version|v\.?) ?3\.0?1?)?
PHP-3.01 | 80 | php | this source file is subject to version 3\.01? of the php licen[cs]e
PSF-2.0 | 70 | python | python software foundation licen[cs]e(?: (?:version|v\.?) ?2)?
PSF-2.0 | 50 | psf | (?<![\w-])psf licen[cs]e
Zend-2.0 | 70 | zend | (?<![\w-])zend (?:engine )?licen[cs]e
PostgreSQL | 70 | postgresql | (?<![\w-])(?:the )?postgresql licen[cs]e
NCSA | 70 | ncsa | (?:university of illinois/)?ncsa open source licen[cs]e
OpenSSL | 70 | openssl | (?<![\w-])openssl licen[cs]e
OpenSSL | 80 | openssl | this product includes software developed by the openssl project
SSLeay | 78 | cryptographic | cryptographic software written by eric young
curl | 70 | curl | (?<![\w-])curl licen[cs]e
ICU | 70 | icu | (?<![\w-])icu licen[cs]e
Unicode-3.0 | 70 | unicode | unicode(?:,? inc\.?)? licen[cs]e(?: agreement)?(?: v3)?
FTL | 70 | freetype | freetype (?:project )?licen[cs]e
IJG | 78 | jpeg | based in part on the work of the independent jpeg group
TCL | 70 | tcl | (?<![\w-])tcl(?:/tk)? licen[cs]e
Vim | 70 | vim | (?<![\w-])vim licen[cs]e
W3C | 70 | w3c | w3c(?:\(r\)|®)? software (?:notice and )?licen[cs]e
MS-PL | 70 | microsoft | microsoft public licen[cs]e(?: \(ms-pl\))?
MS-RL | 70 | microsoft | microsoft reciprocal licen[cs]e(?: \(ms-rl\))?
MS-PL | 50 | ms-pl | (?<![\w-])ms-pl(?![\w-])
AFL-3.0 | 70 | academic | academic free licen[cs]e(?:,? (?:version|v\.?)? ?[123]\.[0-2])?
OSL-3.0 | 70 | software | open software licen[cs]e(?:,? (?:version|v\.?)? ?[123]\.[01])?
QPL-1.0 | 70 | public | (?<![\w-])q public licen[cs]e(?:,? (?:version|v\.?) ?1\.0)?
APSL-2.0 | 70 | apple | apple public source licen[cs]e(?:,? (?:version|v\.?)? ?[12]\.[0-2])?
Intel | 70 | intel | intel (?:open source|simplified software) licen[cs]e
NPOSL-3.0 | 70 | non-profit | non-profit open software licen[cs]e(?:,? (?:version|v\.?)? ?3\.0)?
RPL-1.5 | 70 | reciprocal | reciprocal public licen[cs]e(?:,? (?:version|v\.?)? ?1\.[15])?
Sleepycat | 70 | sleepycat | (?<![\w-])sleepycat licen[cs]e
LPPL-1.3c | 70 | latex | latex project public licen[cs]e(?:,? (?:version|v\.?)? ?1\.[0-3][ac]?)?
NTP | 70 | ntp | (?<![\w-])ntp licen[cs]e
UPL-1.0 | 70 | permissive | universal permissive licen[cs]e(?:,? (?:version|v\.?)? ?1\.0)?
MulanPSL-2.0 | 70 | mulan | mulan (?:permissive|psl)(?: software)?(?: licen[cs]e)?,? ?(?:v2)?
BlueOak-1.0.0 | 70 | oak | blue oak model licen[cs]e(?: 1\.0\.0)?
OpenRAIL | 70 | rail | (?:creativeml|bigscience|bigcode)? ?open ?rail(?:-?\+{0,2}-?m|-?s)?(?: licen[cs]e)?
Llama-community | 70 | llama | llama ?[23]?(?:\.\d)? community licen[cs]e(?: agreement)?
Hippocratic-2.1 | 70 | hippocratic | hippocratic licen[cs]e(?: (?:version )?[123]\.[01])?
JSON | 78 | evil | the software shall be used for good,? not evil
proprietary | 60 | reserved | (?:©|\(c\)|copyright) [^\n]{0,80}all rights reserved
proprietary | 40 | reserved | all rights reserved
proprietary | 60 | proprietary | (?:confidential and proprietary|proprietary and confidential)
proprietary | 50 | proprietary | proprietary (?:licen[cs]e|software licen[cs]e)
proprietary | 60 | unauthorized | unauthorized (?:copying|reproduction|use|distribution)(?: (?:of|or) [\w ]{1,40})? is (?:strictly )?prohibited
commercial | 50 | commercial, enterprise | (?:commercial|enterprise) licen[cs]e(?: agreement)?
commercial | 50 | agreement | end[- ]user licen[cs]e agreement
freeware | 50 | freeware, shareware | (?<![\w-])(?:freeware|shareware)(?![\w-])
non-commercial | 50 | non-commercial, noncommercial | for (?:personal,? )?(?:and )?non-?commercial (?:use|purposes) only
research-only | 50 | research | for research (?:and academic )?(?:use|purposes) only
no-redistribution | 60 | permission | (?:you )?may not (?:be )?(?:copy|copied|reproduced?|redistributed?)(?:,? or [\w]{1,20})? without (?:the )?(?:prior |express )?(?:written )?permission
unknown-license | 20 | under | (?:licensed|released|distributed) under (?:the )?(?:terms (?:of|and) )?[\w.+-]{1,30}(?: [\w.+-]{1,30})? licen[cs]e
unknown-license | 10 | licence, license | see (?:the )?licen[cs]e(?:\.txt|\.md| file)?(?: for (?:more )?details)?
unknown-license | 10 | licence, license | licen[cs]e: ?[a-z][\w.+-]{1,40}
copyright | 10 | copyright | copyright (?:\(c\)|©)? ?(?:19|20)\d\d(?: ?[-,] ?(?:19|20)\d\d){0,12}
copyright | 9 | (c) | (?<!\w)\(c\) ?(?:19|20)\d\d
copyright | 9 | © | © ?(?:19|20)\d\d
""".strip()
