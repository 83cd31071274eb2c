"""Public licence texts and notices that the licence scan knows (a parameter of the scan)."""

# Short licences in full, as published.
_WARRANTY_BSD = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_BSD_2 = """
Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution.
"""
_BSD_3 = _BSD_2 + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission.
"""
_MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ISC_GRANT = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted"""
_ISC_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE.
"""
_ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
the original software.
3. This notice may not be removed or altered from any source distribution.
"""
FULL_TEXTS = {
    "0BSD": _ISC_GRANT + ".\n" + _ISC_WARRANTY,
    "BSD-2-Clause": _BSD_2 + _WARRANTY_BSD,
    "BSD-3-Clause": _BSD_3 + _WARRANTY_BSD,
    "ISC": _ISC_GRANT + """, provided that the above copyright notice and this permission notice
appear in all copies.
""" + _ISC_WARRANTY,
    "MIT": _MIT,
    "Zlib": _ZLIB,
}

# SHA-256 of the canonical form (license_scan) of long licences as published, in the
# editions of Debian's /usr/share/common-licenses; where a text has an appendix after its terms,
# of the whole, of the terms with the line that ends them, and of the terms without it.
FULL_DIGESTS = {
    "Apache-2.0": (
        "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
        "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40",
        "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f",
    ),
    "CC0-1.0": ("cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",),
    "GPL-2.0": (
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
    ),
    "GPL-3.0": (
        "7c43f539c0d6222cb9eaf4eb535dfadd67656f04d06bf12b26d89ab3cc1baa94",
        "7d75204ed685fd08ff55e7de654cd69da831b4d875c3d2c2e69d04d738cccc3e",
        "dd35883083089e6d76ba8a178db431b99ae33b3d2e87dc33fa479fe6aa2ce307",
    ),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-2.0": ("61525901247b1a7c093fc10f73de8260d1d1a1a8b3bc78f417119ee4fcfb0979",),
}

# Names under which notices speak of a licence.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero v1.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "MPL 2.0"),
}
# What stands before the name in a one-line notice.
OPENINGS = ("Licensed under", "Released under", "Distributed under", "Available under",
            "This work is licensed under", "This software is licensed under",
            "This project is licensed under", "This file is licensed under",
            "Permission is granted under", "SPDX-License-Identifier:")

_GNU_HEADER = ("This program is free software: you can redistribute it and/or modify it under the terms of the "
               "GNU {} as published by the Free Software Foundation, either version {} of the License, or (at "
               "your option) any later version.")
# Lines of the standard headers that name licence and version by themselves.
HEADERS = {
    "AGPL-3.0": (_GNU_HEADER.format("Affero General Public License", 3),),
    "Apache-2.0": ('Licensed under the Apache License, Version 2.0 (the "License");',
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
                   'except in compliance with the License.'),
    "GPL-2.0": (_GNU_HEADER.format("General Public License", 2),),
    "GPL-3.0": (_GNU_HEADER.format("General Public License", 3),),
    "LGPL-3.0": (_GNU_HEADER.format("Lesser General Public License", 3),),
    "MPL-2.0": ("License, v. 2.0. If a copy of the MPL was not distributed with this",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
}

# Further names that stand as a title above a licence's text.
MORE_TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ('BSD 2-Clause "Simplified" License',),
    "BSD-3-Clause": ('BSD 3-Clause "New" or "Revised" License',),
    "Zlib": ("zlib License",),
}


def titles() -> list[str]:
    """Lines that only name a licence, by rule: article, name, short name in brackets."""
    names = [(k, n) for table in (NAMES, MORE_TITLES) for k, own in table.items() for n in (*own, k)]
    return [f"{article}{n}{short}" for k, n in names for article in ("", "The ") for short in ("", f" ({k})")]


def known_texts() -> list[tuple[str, str, str]]:
    """(licence, kind, text): full texts, header lines, and notices by rule (opening, article, name)."""
    out = [(k, "text", v) for k, v in FULL_TEXTS.items()]
    out += [(k, "notice", x) for k, lines in HEADERS.items() for x in lines]
    for licence, names in NAMES.items():
        for name in (*names, licence):
            for opening in OPENINGS:
                for article in (" ", " the ", " the terms of the "):
                    out.append((licence, "notice", f"{opening}{article}{name}"))
    return out
