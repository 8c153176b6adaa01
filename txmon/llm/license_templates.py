"""What licences are stated with: identifiers, names, standard headers and the texts of the short licences."""

from __future__ import annotations

import re
from typing import NamedTuple


class Template(NamedTuple):
    """``need``: terms that a statement must hold, whatever its cosine; ``rank``: 2 names one licence, 1 a family or a
    sentence that several share, 0 a bare reservation of rights; ``whole``: compared with whole files, else with lines,
    sentences and paragraphs."""

    licence: str
    text: str
    need: tuple[str, ...] = ()
    rank: int = 2
    whole: bool = False


# SPDX identifiers and the names that files use.
NAMES = [
    ("0BSD", ["0BSD License", "Zero-Clause BSD License", "BSD Zero Clause License"]),
    ("AGPL-3.0", ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPL-3.0"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "BSD 2-Clause Simplified License", "2-Clause BSD License", "Simplified BSD License"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "BSD 3-Clause New or Revised License", "3-Clause BSD License", "New BSD License", "Modified BSD License"]),
    ("CC-BY-4.0", ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC BY 4.0 International License"]),
    ("CC-BY-NC-4.0", ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("CC-BY-NC-SA-4.0", ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"]),
    ("CC-BY-ND-4.0", ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"]),
    ("CC-BY-SA-4.0", ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("CC0-1.0", ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"]),
    ("EPL-2.0", ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0"]),
    ("GPL-2.0", ["GNU General Public License, version 2", "GNU GPL version 2", "GPL version 2"]),
    ("GPL-3.0", ["GNU General Public License, version 3", "GNU GPL version 3", "GPL version 3"]),
    ("ISC", ["ISC License", "ISC license (ISCL)"]),
    ("LGPL-2.1", ["GNU Lesser General Public License, version 2.1", "GNU LGPL version 2.1", "LGPL version 2.1"]),
    ("LGPL-3.0", ["GNU Lesser General Public License, version 3", "GNU LGPL version 3", "LGPL version 3"]),
    ("MIT", ["MIT License", "MIT/X11 License", "The MIT License (MIT)"]),
    ("MPL-2.0", ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"]),
    ("Unlicense", ["Unlicense"]),
    ("Zlib", ["zlib License", "zlib/libpng License"]),
]

# The same licences where no version is stated.
FAMILIES = [
    ("AGPL", ["GNU Affero General Public License", "GNU AGPL"]),
    ("Apache", ["Apache License", "Apache Software License"]),
    ("BSD", ["BSD License", "BSD-style license"]),
    ("CC-BY", ["Creative Commons Attribution License"]),
    ("GPL", ["GNU General Public License", "GNU GPL", "GPL license"]),
    ("LGPL", ["GNU Lesser General Public License", "GNU LGPL"]),
    ("MPL", ["Mozilla Public License"]),
]

# Sentences that licences are named in.
PATTERNS = [
    "{name}",
    "License: {name}",
    "Licensed under {name}",
    "Licensed under the {name}",
    "Released under the {name}",
    "Distributed under the {name}",
    "Distributed under the terms of the {name}",
    "This work is licensed under the {name}",
    "This program is licensed under the {name}",
    "This library is licensed under the {name}",
    "This project is licensed under the {name}, see the LICENSE file for details",
    "Licensed under the {name}. See LICENSE file in the project root for full license information",
    "Use of this source code is governed by the {name} that can be found in the LICENSE file",
]

# Titles with date, standard headers and grants of the licences.
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version {v} of the License, or (at your option) any later version."""
_GPL_ONLY = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version {v}
as published by the Free Software Foundation."""
_LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation; either version {v} of the License, or (at your option) any later version."""
_AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
ZERO_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
UNLICENSE_GRANT = "This is free and unencumbered software released into the public domain."
ZLIB_GRANT = """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
HEADERS = [
    Template("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", ("2",)),
    Template("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ("3",)),
    Template("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", ("2.1",)),
    Template("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ("3",)),
    Template("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", ("3",)),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004", ("2",)),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", ("2",)),
    Template("EPL-2.0", "Eclipse Public License - v 2.0", ("2",)),
    Template("GPL-2.0", _GPL.format(v=2), ("2",)),
    Template("GPL-3.0", _GPL.format(v=3), ("3",)),
    Template("GPL-2.0", _GPL_ONLY.format(v=2), ("2",)),
    Template("GPL-3.0", _GPL_ONLY.format(v=3), ("3",)),
    Template("LGPL-2.1", _LGPL.format(v=2.1), ("2.1",)),
    Template("LGPL-3.0", _LGPL.format(v=3), ("3",)),
    Template("AGPL-3.0", _AGPL, ("3",)),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", ("2",)),
    Template("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""", ("2",)),
    Template("Apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0", ("2",)),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("2",)),
    Template("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/.""", ("2",)),
    Template("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal", ("1",)),
    Template("MIT", MIT_GRANT),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("ISC", ISC_GRANT, ("provided",)),
    Template("0BSD", ZERO_GRANT, rank=1),
    Template("BSD-2-Clause", BSD_GRANT, rank=1),
    Template("BSD-3-Clause", BSD_THIRD, ("endorse",)),
    Template("Unlicense", UNLICENSE_GRANT, ("unencumbered",)),
    Template("Zlib", ZLIB_GRANT, ("alter",)),
    Template("proprietary", "Proprietary and confidential", ("proprietary",)),
    Template("proprietary", "Copyright. All rights reserved. Proprietary and confidential.", ("proprietary",)),
    Template("proprietary", "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential", ("proprietary",)),
    Template("all-rights-reserved", "Copyright. All rights reserved.", ("reserved",), 0),
    Template("all-rights-reserved", "All rights reserved.", ("reserved",), 0),
]

# Warranty disclaimers, and the texts of the short licences made of them.
_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS
OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_CLAUSES = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_UNLICENSE_REST = """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_ZLIB_START = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
use of this software."""
_ZLIB_REST = """1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
TEXTS = {
    "MIT": ["MIT License", MIT_GRANT, _MIT_KEEP, _MIT_END],
    "ISC": ["ISC License", ISC_GRANT, _ISC_END],
    "0BSD": ["BSD Zero Clause License", ZERO_GRANT, _ISC_END],
    "BSD-2-Clause": ["BSD 2-Clause License", BSD_GRANT, _BSD_CLAUSES, _BSD_END],
    "BSD-3-Clause": ["BSD 3-Clause License", BSD_GRANT, _BSD_CLAUSES, "3. " + BSD_THIRD, _BSD_END],
    "Unlicense": [UNLICENSE_GRANT, _UNLICENSE_REST, _MIT_END],
    "Zlib": ["zlib License", _ZLIB_START, ZLIB_GRANT, _ZLIB_REST],
}
#: Terms that the whole text of a licence cannot be without.
_TEXT_NEED = {"MIT": ("charge", "sublicense"), "0BSD": ("fee",), "BSD-2-Clause": ("binary",), "ISC": ("provided", "appear"), "BSD-3-Clause": ("endorse",), "Unlicense": ("relinquishment",), "Zlib": ("misrepresented",)}


#: Words of a name that do not tell licences apart.
_GENERIC = {"license", "the", "version", "public", "general", "international", "universal", "dedication", "domain", "software", "style", "or", "revised"}


def telling(name: str) -> tuple[str, ...]:
    """The terms that a statement must hold to mean this name: all but the generic ones, versions in their short form."""
    words = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", name.lower().replace("cc0", "cc 0"))
    return tuple(sorted({re.sub(r"^v(?=[0-9])|(?<=[0-9])(\.0)+$", "", w) for w in words} - _GENERIC))


def templates() -> list[Template]:
    """All templates: identifiers and names in every pattern, headers, and whole texts with and without their title."""
    out = []
    for licence, names in NAMES:
        ids = [licence, f"{licence}-only", f"{licence}-or-later"] if "GPL" in licence else [licence]
        out += [Template(licence, f"SPDX-License-Identifier: {i}", telling(licence)) for i in ids]
        out += [Template(licence, p.format(name=n), telling(n)) for n in [licence, *names] for p in PATTERNS]
    out += [Template(family, p.format(name=n), telling(n), 1) for family, names in FAMILIES for n in names for p in PATTERNS]
    out += HEADERS
    for licence, parts in TEXTS.items():
        need = _TEXT_NEED.get(licence, ())
        out += [Template(licence, "\n".join(parts), need, whole=True), Template(licence, "\n".join(["Copyright", *parts[1:]]), need, whole=True)]
    return out
