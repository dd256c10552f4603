"""Public licence texts and notices that ``licenses`` looks for.  Long whole texts are
in ``license_files``, a file for each license."""

import pkgutil

TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.""",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "CC0-1.0": ["Released under CC0 1.0 Universal."],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    ],
}

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
    TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
    AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
    TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
    SOFTWARE."""
_BSD_CLAUSE_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
    PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
    GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
    LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
    OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
    INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
    SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
    PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
    THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _gnu(what: str, name: str, version: str) -> str:
    """The standard header of a GNU license."""
    return f"""This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public
        License as published by the Free Software Foundation, either version {version} of the License, or (at your
        option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        {name} Public License for more details."""


def _short_gnu(what: str, name: str, version: str) -> str:
    return _gnu(what, name, version).split(f" This {what} is distributed")[0]


def _add(name: str, *texts: str) -> None:
    TEMPLATES.setdefault(name, []).extend(texts)


_add("MIT", TEMPLATES["MIT"][2] + " " + _WARRANTY)
_add("ISC", TEMPLATES["ISC"][0] + " " + _ISC_DISCLAIMER)
_add("BSD-3-Clause", TEMPLATES["BSD-2-Clause"][0] + " " + _BSD_CLAUSE_3, TEMPLATES["BSD-2-Clause"][0] + " " + _BSD_CLAUSE_3 + " " + _BSD_DISCLAIMER)
_add("BSD-2-Clause", TEMPLATES["BSD-2-Clause"][0] + " " + _BSD_DISCLAIMER)
for _name, _what, _words, _version in [
        ("GPL-1.0", "program", "General", "1"), ("GPL-2.0", "program", "General", "2"), ("GPL-3.0", "program", "General", "3"),
        ("LGPL-2.0", "library", "Library General", "2"), ("LGPL-2.1", "library", "Lesser General", "2.1"),
        ("LGPL-3.0", "library", "Lesser General", "3"), ("AGPL-3.0", "program", "Affero General", "3")]:
    _add(_name, _short_gnu(_what, _words, _version), _gnu(_what, _words, _version))
TEMPLATES["GPL-3.0"].remove(_short_gnu("program", "General", "3"))  # there already
_add("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1.")
for _name, _words, _versions in [("GPL", "General", "1 2 3"), ("LGPL", "Library General", "2"), ("LGPL", "Lesser General", "2.1 3"), ("AGPL", "Affero General", "3")]:
    for _version in _versions.split():
        _add(f"{_name}-{_version if '.' in _version else _version + '.0'}", *[
            f"Licensed under the GNU {_words} Public License{_mark} version {_version}" for _mark in (",", " (the license),")],
            f"Licensed under the terms of the GNU {_words} Public License, version {_version}",
            f"under the terms of the GNU {_words} Public License version {_version} as published by the Free Software Foundation")
_add("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0.",
     """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
     distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""")
for _name, _words in [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
                      ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                      ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]:
    _add(f"CC-{_name}-4.0", f"Licensed under a Creative Commons {_words} 4.0 International License.")
_add("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.")
for _name in ("Apache-2.0", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1",
              "MPL-2.0", "Unlicense"):
    _add(_name, pkgutil.get_data(__package__, f"license_files/{_name}.txt").decode())

#: Identifiers of source file tags; a tag names a license only if nothing follows its identifier.
TAGS = {name: [name, *[f"{name}-{end}" for end in ("only", "or-later") if name.split("-")[0] in ("GPL", "LGPL", "AGPL")]] for name in TEMPLATES}
for _name, _ids in TAGS.items():
    _add(_name, *[f"SPDX-License-Identifier: {_id}" for _id in _ids])
#: The title of a license whose whole text is not among the files, and the license whose text it is but for few words.
RETITLED = {"AGPL-3.0": ("GPL-3.0", "GNU Affero General Public License Version 3")}
