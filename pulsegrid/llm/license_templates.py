"""Public texts by which works state their licence, as (licence, kind, text).

Kinds: "notice" is a header or a sentence, "text" a whole licence, "head" the
opening of one that is too long to be held whole.
"""

from __future__ import annotations

_GNU = "Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GNU_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_REST = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'


def _gnu_header(name: str, version: str, what: str = "program") -> str:
    return f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} {_GNU_WARRANTY} GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."


GPL, LGPL, AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
#: Names that the identifiers of headers take.
IDENTIFIERS = ["Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0"]
TEMPLATES: list[tuple[str, str, str]] = [
    *((name, "notice", f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "head", 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT license. See LICENSE file in the project root."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "Use of this source code is governed by an MIT-style license."),
    ("MIT", "notice", _MIT_GRANT),
    ("MIT", "text", f"MIT License Copyright (c) {_MIT_GRANT} {_MIT_REST}"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "notice", _gnu_header(GPL, "3")),
    ("GPL-2.0", "notice", _gnu_header(GPL, "2")),
    ("LGPL-3.0", "notice", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "notice", _gnu_header(LGPL, "3")),
    ("LGPL-2.1", "notice", _gnu_header(LGPL, "2.1", "library")),
    ("AGPL-3.0", "notice", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "notice", _gnu_header(AGPL, "3")),
    ("GPL-3.0", "head", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_GNU} Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("GPL-2.0", "head", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 {_GNU} Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("LGPL-3.0", "head", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_GNU} This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("LGPL-2.1", "head", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 {_GNU} This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1."),
    ("AGPL-3.0", "head", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 {_GNU} Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("MPL-2.0", "notice", "This source code is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "head", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor\'s Contribution.'),
    ("BSD-3-Clause", "notice", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "notice", _BSD_START),
    ("BSD-2-Clause", "text", f"BSD 2-Clause License Copyright (c) All rights reserved. {_BSD_START} {_BSD_END}"),
    ("BSD-3-Clause", "notice", f"{_BSD_START} {_BSD_NAME}"),
    ("BSD-3-Clause", "text", f"BSD 3-Clause License Copyright (c) All rights reserved. {_BSD_START} {_BSD_NAME} {_BSD_END}"),
    ("ISC", "text", f"ISC License Copyright (c) {_ISC}"),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "notice", "Dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "head", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP."),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "notice", "All rights reserved."),
]
#: Words too common to tell licences apart; they have no weight.
COMMON = "a also an and any are as at be but by can do does each even for found from he hence her his how if in into is it its kinds made make may means more must not number of on one or other shall she so such than that the their them then there these they this those to under use was we were which will with work works you your".split()
#: Ordinary words, of some language: anchors only where others don't suffice.
ORDINARY = "above action additional agreed author basis case change charge combination community cooperation copies copy counts damages deal distributed distribution domain ensure except february file files first following free freedom general including international legal library limited list mit nc network notice number program project provided public root sa share style subject successor terms v version without".split()
