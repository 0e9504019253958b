"""Signatures of licenses: label; then keyword => expression, on text in lower case. Earlier lines have priority.

@ stands for separators between words. A name, an identifier, addresses and telling phrases are rules of their own.
"""

RULES = r"""
agpl-3.0-or-later | agpl-3.0-or-later => agpl-3\.0-or-later | affero => gnu@affero@general@public@license@(?:as@published@by@the@free@software@foundation@)?either@version@3
agpl-3.0 | agpl-3.0 => agpl-3\.0(?:-only)? | affero => (?:gnu@)?affero@general@public@licen[cs]e(?:@v(?:ersion)?@?3(?:\.0)?)? | gnu.org/licenses/agpl => gnu\.org/licenses/agpl | agplv3 => agplv3
lgpl-3.0-or-later | lgpl-3.0-or-later => lgpl-3\.0-or-later | lesser => lesser@general@public@license@(?:as@published@by@the@free@software@foundation@)?either@version@3
lgpl-3.0 | lgpl-3.0 => lgpl-3\.0(?:-only)? | lesser => (?:gnu@)?lesser@general@public@licen[cs]e@v(?:ersion)?@?3(?:\.0)? | lgplv3 => lgplv3 | lgpl-3 => gnu\.org/licenses/lgpl-3
lgpl-2.1-or-later | lgpl-2.1-or-later => lgpl-2\.1-or-later | lesser => lesser@general@public@license@(?:as@published@by@the@free@software@foundation@)?either@version@2\.1
lgpl-2.1 | lgpl-2.1 => lgpl-2\.1(?:-only)? | lesser => (?:gnu@)?lesser@general@public@licen[cs]e@v(?:ersion)?@?2(?:\.1)? | lgplv2 => lgplv2(?:\.1)?
lgpl | lesser => (?:gnu@)?lesser@general@public@licen[cs]e | library => gnu@library@general@public@licen[cs]e | lgpl => licen[cs]ed?@under@(?:the@)?lgpl | gnu.org/licenses/lgpl => gnu\.org/licenses/lgpl
gpl-3.0-or-later | gpl-3.0-or-later => gpl-3\.0-or-later | general => general@public@license@(?:as@published@by@the@free@software@foundation@)?either@version@3 | gplv3 => gplv3\+
gpl-3.0 | gpl-3.0 => gpl-3\.0(?:-only)? | general => (?:gnu@)?general@public@licen[cs]e@v(?:ersion)?@?3(?:\.0)? | gplv3 => gplv3 | gpl-3 => gnu\.org/licenses/gpl-3
gpl-2.0-or-later | gpl-2.0-or-later => gpl-2\.0-or-later | general => general@public@license@(?:as@published@by@the@free@software@foundation@)?either@version@2 | gplv2 => gplv2\+
gpl-2.0 | gpl-2.0 => gpl-2\.0(?:-only)? | general => (?:gnu@)?general@public@licen[cs]e@v(?:ersion)?@?2(?:\.0)? | gplv2 => gplv2 | gpl-2 => gnu\.org/licenses/(?:old-licenses/)?gpl-2
gpl-1.0 | gpl-1.0 => gpl-1\.0(?:-only|-or-later)? | general => (?:gnu@)?general@public@licen[cs]e@v(?:ersion)?@?1
gpl | general => (?:gnu@)?general@public@licen[cs]e | gpl => (?:licen[cs]ed?|released)@under@(?:the@)?(?:gnu@)?gpl | gnu.org/licenses/gpl => gnu\.org/licenses/gpl | gnu => gnu@gpl
gfdl | free => gnu@free@documentation@licen[cs]e | gfdl-1 => gfdl-1\.[123] | gnu.org/licenses/fdl => gnu\.org/licenses/fdl
apache-2.0 | apache-2.0 => apache-2\.0 | apache => apache@(?:software@)?licen[cs]e@v(?:ersion)?@?2(?:\.0)? | licenses/license-2.0 => apache\.org/licenses/license-2\.0 | apache2 => apache2@licen[cs]e
apache-1.1 | apache-1.1 => apache-1\.1 | apache => apache@(?:software@)?licen[cs]e@v(?:ersion)?@?1\.1
apache-1.0 | apache-1.0 => apache-1\.0 | apache => apache@(?:software@)?licen[cs]e@v(?:ersion)?@?1\.0
apache | apache => apache@(?:software@)?licen[cs]e | asl => (?:the@)?asl@licen[cs]e | apache.org/licenses => apache\.org/licenses
mit-0 | mit-0 => \bmit-0\b | attribution => mit@no@attribution
mit | spdx-license-identifier => spdx-license-identifier:@?mit\b | permission => permission@is@hereby@granted@free@of@charge@to@any@person@obtaining@a@copy | licen => \bmit@licen[cs]ed? | opensource.org/licenses/mit => opensource\.org/licenses/mit | expat => expat@licen[cs]e
x11 | x11 => \bx11@licen[cs]e | consortium => x@consortium@licen[cs]e
bsd-4-clause | bsd-4-clause => bsd-4-clause | original => original@bsd@licen[cs]e | advertising => all@advertising@materials@mentioning@features
bsd-3-clause | bsd-3-clause => bsd-3-clause | clause => (?:3|three)@clause@bsd | new => (?:new|modified|revised)@bsd@licen[cs]e | neither => neither@the@name@of@(?:[a-z0-9.]{1,30}@){0,12}nor@the@names@of@its@contributors | opensource.org/licenses/bsd-3 => opensource\.org/licenses/bsd-3
bsd-2-clause | bsd-2-clause => bsd-2-clause | clause => (?:2|two)@clause@bsd | simplified => simplified@bsd@licen[cs]e | freebsd => freebsd@licen[cs]e | opensource.org/licenses/bsd-2 => opensource\.org/licenses/bsd-2
bsd-1-clause | bsd-1-clause => bsd-1-clause
0bsd | 0bsd => \b0bsd\b | zero-clause => zero-clause@bsd
bsd | licen => \bbsd@licen[cs]e | redistribution => redistribution@and@use@in@source@and@binary@forms | bsd-style => bsd-style@licen[cs]e
isc | licen => \bisc@licen[cs]e | permission => permission@to@use@copy@modify@and@(?:or@)?distribute@this@software@for@any@purpose | opensource.org/licenses/isc => opensource\.org/licenses/isc
mpl-2.0 | mpl-2.0 => mpl-2\.0 | mozilla => mozilla@public@licen[cs]e@v?(?:ersion@)?@?2(?:\.0)? | mozilla.org/mpl/2 => mozilla\.org/mpl/2 | mplv2 => mplv2
mpl-1.1 | mpl-1.1 => mpl-1\.1 | mozilla => mozilla@public@licen[cs]e@v?(?:ersion@)?@?1\.1
mpl | mozilla => mozilla@public@licen[cs]e | mozilla.org/mpl => mozilla\.org/mpl
epl-2.0 | epl-2.0 => epl-2\.0 | eclipse => eclipse@public@licen[cs]e@v?(?:ersion@)?@?2(?:\.0)? | epl-v20 => eclipse\.org/legal/epl-v20
epl-1.0 | epl-1.0 => epl-1\.0 | eclipse => eclipse@public@licen[cs]e@v?(?:ersion@)?@?1(?:\.0)? | epl-v10 => eclipse\.org/legal/epl-v10
epl | eclipse => eclipse@public@licen[cs]e | distribution => eclipse@distribution@licen[cs]e
cddl-1.1 | cddl-1.1 => cddl-1\.1
cddl-1.0 | cddl-1.0 => cddl-1\.0 | common => common@development@and@distribution@licen[cs]e | cddl => \bcddl@licen[cs]e
cpl-1.0 | cpl-1.0 => \bcpl-1\.0 | common => common@public@licen[cs]e
eupl-1.2 | eupl-1.2 => eupl-1\.2 | european => european@union@public@licen[cs]e@v?(?:ersion@)?@?1\.2
eupl | european => european@union@public@licen[cs]e | eupl => \beupl\b
cc-by-nc-nd-4.0 | by-nc-nd-4 => cc-by-nc-nd-4\.0 | by-nc-nd/4 => creativecommons\.org/licenses/by-nc-nd/4 | noncommercial => attribution@noncommercial@noderiv(?:ative)?s@4
cc-by-nc-sa-4.0 | by-nc-sa-4 => cc-by-nc-sa-4\.0 | by-nc-sa/4 => creativecommons\.org/licenses/by-nc-sa/4 | noncommercial => attribution@noncommercial@sharealike@4
cc-by-nc-4.0 | by-nc-4 => cc-by-nc-4\.0 | by-nc/4 => creativecommons\.org/licenses/by-nc/4 | noncommercial => attribution@noncommercial@4
cc-by-sa-4.0 | by-sa-4 => cc-by-sa-4\.0 | by-sa/4 => creativecommons\.org/licenses/by-sa/4 | sharealike => attribution@sharealike@4
cc-by-nd-4.0 | by-nd-4 => cc-by-nd-4\.0 | by-nd/4 => creativecommons\.org/licenses/by-nd/4 | noderiv => attribution@noderiv(?:ative)?s@4
cc-by-4.0 | cc-by-4 => cc-by-4\.0 | licenses/by/4 => creativecommons\.org/licenses/by/4 | attribution => creative@commons@attribution@4
cc-by-nc-nd-3.0 | by-nc-nd-3 => cc-by-nc-nd-3\.0 | by-nc-nd/3 => creativecommons\.org/licenses/by-nc-nd/3
cc-by-nc-sa-3.0 | by-nc-sa-3 => cc-by-nc-sa-3\.0 | by-nc-sa/3 => creativecommons\.org/licenses/by-nc-sa/3 | noncommercial => attribution@noncommercial@sharealike@3
cc-by-nc-3.0 | by-nc-3 => cc-by-nc-3\.0 | by-nc/3 => creativecommons\.org/licenses/by-nc/3
cc-by-sa-3.0 | by-sa-3 => cc-by-sa-3\.0 | by-sa/3 => creativecommons\.org/licenses/by-sa/3 | sharealike => attribution@sharealike@3
cc-by-3.0 | cc-by-3 => cc-by-3\.0 | licenses/by/3 => creativecommons\.org/licenses/by/3 | attribution => creative@commons@attribution@3
cc-by-sa-2.0 | by-sa-2 => cc-by-sa-2\.[05] | by-sa/2 => creativecommons\.org/licenses/by-sa/2
cc-by-2.0 | cc-by-2 => cc-by-2\.[05] | licenses/by/2 => creativecommons\.org/licenses/by/2
cc0-1.0 | cc0-1.0 => cc0-1\.0 | publicdomain/zero => creativecommons\.org/publicdomain/zero | cc0 => \bcc0\b | universal => cc0@1\.0@universal
cc-pdm | publicdomain/mark => creativecommons\.org/publicdomain/mark
creative-commons | creative => creative@commons@(?:attribution@|public@)?licen[cs]e | creativecommons.org/licenses => creativecommons\.org/licenses
unlicense | unlicense => \bunlicense\b | unlicense.org => unlicense\.org | unencumbered => free@and@unencumbered@software@released@into@the@public@domain
public-domain | domain => (?:released|placed|dedicated)@(?:in|into|to)@the@public@domain | pddl => \bpddl-1\.0
wtfpl | wtfpl => \bwtfpl\b | what => do@what@the@f.{2,4}@you@want@to@public@licen[cs]e
zlib | zlib => zlib@(?:libpng@)?licen[cs]e | as-is => provided@as-is@without@any@express@or@implied@warranty | libpng => libpng@licen[cs]e
bsl-1.0 | bsl-1.0 => \bbsl-1\.0 | boost => boost@software@licen[cs]e | boost.org/license => boost\.org/license
busl-1.1 | busl-1.1 => busl-1\.1 | business => business@source@licen[cs]e
sspl-1.0 | sspl-1.0 => sspl-1\.0 | server => server@side@public@licen[cs]e
elastic-2.0 | elastic-2.0 => elastic-2\.0 | elastic => elastic@licen[cs]e(?:@2\.0)?
artistic-2.0 | artistic-2.0 => artistic-2\.0 | artistic => artistic@licen[cs]e@2(?:\.0)? | perlfoundation.org/artistic => perlfoundation\.org/artistic
artistic-1.0 | artistic-1.0 => artistic-1\.0 | artistic => artistic@licen[cs]e
ofl-1.1 | ofl-1.1 => ofl-1\.1 | sil => sil@open@font@licen[cs]e | scripts.sil.org/ofl => scripts\.sil\.org/ofl
postgresql | postgresql => postgresql@licen[cs]e
python-2.0 | python-2.0 => python-2\.0 | psf => psf@licen[cs]e | python => python@software@foundation@licen[cs]e
ruby | ruby => \bruby@licen[cs]e
php-3.01 | php-3.01 => php-3\.01 | php => php@licen[cs]e@v?(?:ersion@)?@?3
openssl | openssl => openssl@licen[cs]e | ssleay => ssleay@licen[cs]e
odbl-1.0 | odbl-1.0 => odbl-1\.0 | database => open@(?:data@commons@)?(?:open@)?database@licen[cs]e
odc-by-1.0 | odc-by-1.0 => odc-by-1\.0 | commons => open@data@commons@attribution
ncsa | ncsa => (?:university@of@illinois@)?ncsa@(?:open@source@)?licen[cs]e
upl-1.0 | upl-1.0 => upl-1\.0 | universal => universal@permissive@licen[cs]e
ms-pl | ms-pl => \bms-pl\b | microsoft => microsoft@public@licen[cs]e
ms-rl | ms-rl => \bms-rl\b | reciprocal => microsoft@reciprocal@licen[cs]e
afl-3.0 | afl-3.0 => afl-3\.0 | academic => academic@free@licen[cs]e
osl-3.0 | osl-3.0 => osl-3\.0 | open => open@software@licen[cs]e
ecl-2.0 | ecl-2.0 => ecl-2\.0 | educational => educational@community@licen[cs]e
cecill-2.1 | cecill-2.1 => cecill-2\.1 | cecill => \bcecill@(?:free@software@)?licen[cs]e
mulan-psl-2.0 | mulanpsl-2.0 => mulanpsl-2\.0 | mulan => mulan@permissive@software@licen[cs]e
w3c | w3c => w3c@software@(?:notice@and@)?licen[cs]e
vim | vim => \bvim@licen[cs]e
tcl | tcl => tcl@(?:tk@)?licen[cs]e
ipl-1.0 | ipl-1.0 => \bipl-1\.0 | ibm => ibm@public@licen[cs]e
qpl-1.0 | qpl-1.0 => \bqpl-1\.0 | q => \bq@public@licen[cs]e
lppl-1.3c | lppl-1.3c => lppl-1\.3c | latex => latex@project@public@licen[cs]e
openrail | openrail => \bopenrail(?:\+\+)?(?:-m)?\b | rail => responsible@ai@licen[cs]e
proprietary | proprietary => proprietary@(?:and@confidential|licen[cs]e) | licensed => not@licensed@for@redistribution
all-rights-reserved | rights => all@rights@reserved
"""
