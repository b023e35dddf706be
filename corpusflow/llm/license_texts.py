"""Whole licence texts and standard headers: (licence, text, telling phrases). The long texts are files in ``licenses``."""

from __future__ import annotations

import re
from pathlib import Path

#: File, licence as the files are named by their publishers, phrases of their titles.
FILES = (
    ("Apache-2.0", "Apache-2.0", ("apache license version 2 0",)),
    ("Artistic", "Artistic-1.0", ("the artistic license",)),
    ("CC0-1.0", "CC0-1.0", ("cc0 1 0 universal",)),
    ("GFDL-1.2", "GFDL-1.2", ("gnu free documentation license version", "license version 1 2")),
    ("GFDL-1.3", "GFDL-1.3", ("gnu free documentation license version", "license version 1 3")),
    ("GPL-1", "GPL-1.0", ("gnu general public license version", "public license version 1")),
    ("GPL-2", "GPL-2.0", ("gnu general public license version", "public license version 2")),
    ("GPL-3", "GPL-3.0", ("gnu general public license version", "public license version 3")),
    ("LGPL-2", "LGPL-2.0", ("library general public license version", "public license version 2")),
    ("LGPL-2.1", "LGPL-2.1", ("lesser general public license version", "license version 2 1")),
    ("LGPL-3", "LGPL-3.0", ("lesser general public license version", "public license version 3")),
    ("MPL-1.1", "MPL-1.1", ("mozilla public license version 1", "license version 1 1")),
    ("MPL-2.0", "MPL-2.0", ("mozilla public license version 2",)),
)
#: The Affero licence has the General Public License's text but for its name, its preamble and one section, so the text with
#: the name changed stands for it: a whole copy holds well over the share that is asked for.
AFFERO = ("AGPL-3.0", ("affero general public license version", "public license version 3"))

GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software. "
)
AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
    "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {who} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
)
X_NAME = (
    "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in "
    "this Software without prior written authorization from the X Consortium."
)
BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
BSD_THREE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission. "
)
BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS "
    "OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    'notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
    "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
    "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_FOUR = (
    "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed "
    "by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
    "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
    "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
    "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
    "source distribution."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
    "laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the "
    "benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of "
    "all present and future rights to this software under copyright law. "
)
#: Licence, name after "GNU", version.
GNU = (
    ("GPL", "General Public License", "1"), ("GPL", "General Public License", "2"), ("GPL", "General Public License", "3"),
    ("LGPL", "Library General Public License", "2"), ("LGPL", "Lesser General Public License", "2.1"), ("LGPL", "Lesser General Public License", "3"),
    ("AGPL", "Affero General Public License", "3"),
)
CREATIVE_COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}


def texts() -> list[tuple[str, str, tuple[str, ...]]]:
    folder = Path(__file__).with_name("licenses")
    whole = {name: (folder / f"{file}.txt").read_text(encoding="utf-8") for file, name, _ in FILES}
    rows = [(name, whole[name], tells) for _, name, tells in FILES]
    rows.append((AFFERO[0], re.sub(r"(?i)\bGNU(\s+)General", r"GNU\1Affero General", whole["GPL-3.0"]), AFFERO[1]))
    free = GRANT.split(", subject to the following conditions")[0] + ". "
    rows += [
        ("MIT", GRANT + AS_IS.format(who="AUTHORS OR COPYRIGHT HOLDERS"), ("above copyright notice and this",)),
        ("MIT-0", free + AS_IS.format(who="AUTHORS OR COPYRIGHT HOLDERS"), ("do so the software is",)),
        ("X11", GRANT + AS_IS.format(who="X CONSORTIUM") + X_NAME, ("name of the x consortium",)),
        ("BSD-2-Clause", BSD_TWO + BSD_END, ("distribution this software is provided",)),
        ("BSD-3-Clause", BSD_TWO + BSD_THREE + BSD_END, ("endorse or promote products derived", "distribution 3 neither the name")),
        ("BSD-4-Clause", BSD_TWO + BSD_FOUR + BSD_END, ("all advertising materials mentioning features",)),
        ("ISC", ISC, ()),
        ("Zlib", ZLIB, ()),
        ("Unlicense", UNLICENSE + AS_IS.format(who="AUTHORS"), ("free and unencumbered software",)),
    ]
    for short, name, version in GNU:
        lead = f"is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation"
        licence = f"{short}-{version if '.' in version else version + '.0'}"
        called, major = f"gnu {name}", f"version {version}"
        for what in ("program", "library"):
            rows.append((licence, f"This {what} {lead}, either {major} of the License, or (at your option) any later version.", (called, f"either {major}")))
            rows.append((licence, f"This {what} {lead}; either {major} of the License.", (called, f"either {major}")))
            rows.append((licence, f"This {what} {lead}, {major} of the License.", (called, f"foundation {major}")))
        rows.append((licence, f"This work is licensed under the GNU {name}, {major}.", (called, major)))
    for short, name in CREATIVE_COMMONS.items():
        for version, where in (("4.0", "International"), ("3.0", "Unported")):
            rows.append((f"CC-{short}-{version}", f"This work is licensed under a Creative Commons {name} {version} {where} License.", (f"{name} {version}",)))
    return rows
