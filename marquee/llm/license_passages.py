"""Passages of standard licences and file headers, compared with windows of lines.

The long licences (Apache, GPL, LGPL, AGPL, MPL) are known by the opening of
their file and by the header they prescribe, the short ones by each paragraph.
"""

from __future__ import annotations

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_NOTICE = """The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:"""
_BSD_1 = """Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer."""
_BSD_2 = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_FREE = """{what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public
License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any
later version."""
_GNU_OPENING = """GNU {kind} PUBLIC LICENSE Version {version}, {day} Copyright (C) {year} Free Software Foundation, Inc.
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""
_GNU = (("GPL-1.0", "General", "1", "February 1989", "1989"), ("LGPL-2.0", "Library General", "2", "June 1991", "1991"),
        ("GPL-2.0", "General", "2", "June 1991", "1989, 1991"), ("GPL-3.0", "General", "3", "29 June 2007", "2007"),
        ("LGPL-2.1", "Lesser General", "2.1", "February 1999", "1991, 1999"),
        ("LGPL-3.0", "Lesser General", "3", "29 June 2007", "2007"),
        ("AGPL-3.0", "Affero General", "3", "19 November 2007", "2007"))
_SPDX = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GPL-1.0", "LGPL-2.0",
         "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
_NAMED = (("MIT", "MIT License"), ("Apache-2.0", "Apache License Version 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"),
          ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
          ("GPL-2.0", "GNU General Public License version 2"), ("GPL-3.0", "GNU General Public License version 3"),
          ("LGPL-2.1", "GNU Lesser General Public License version 2.1"),
          ("LGPL-3.0", "GNU Lesser General Public License version 3"),
          ("AGPL-3.0", "GNU Affero General Public License version 3"))

PASSAGES = (
    *[(name, f"SPDX-License-Identifier: {name}") for name in _SPDX],
    *[(name, f"SPDX-License-Identifier: {name}-{more}") for name, *_ in _GNU for more in ("only", "or-later")],
    *[(name, f"This file is part of, distributed under the {words}.") for name, words in _NAMED],
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MIT", _MIT_GRANT), ("MIT", _MIT_NOTICE), ("MIT", _MIT_WARRANTY),
    ("MIT", " ".join((_MIT_GRANT, _MIT_NOTICE, _MIT_WARRANTY))),
    # A paragraph that the two BSD licences share is the shorter one's.
    ("BSD-2-Clause", _BSD_GRANT), ("BSD-2-Clause", _BSD_1), ("BSD-2-Clause", _BSD_2), ("BSD-2-Clause", _BSD_WARRANTY),
    ("BSD-2-Clause", " ".join((_BSD_GRANT, _BSD_1, _BSD_2, _BSD_WARRANTY))), ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", " ".join((_BSD_GRANT, _BSD_1, _BSD_2, _BSD_3, _BSD_WARRANTY))),
    ("ISC", _ISC_GRANT), ("Apache-2.0", _APACHE_HEADER),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", _MPL_HEADER), ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("MPL-1.1", "Mozilla Public License Version 1.1 1. Definitions"),
    ("Artistic-1.0", """The intent of this document is to state the conditions under which a Package may be copied, such
     that the Copyright Holder maintains some semblance of artistic control over the development of the package"""),
    *[(name, _FREE.format(what=what, kind=kind, version=version)) for name, kind, version, *_ in _GNU
      for what in ("This program", "This library")],
    *[(name, _GNU_OPENING.format(kind=kind, version=version, day=day, year=year)) for name, kind, version, day, year in _GNU],
)
#: Words of ordinary prose, the most frequent first; they are the last to become key words.
ORDINARY = ("the", "of", "and", "to", "a", "in", "is", "for", "that", "it", "with", "as", "on", "by", "be", "or", "this", "are",
            "from", "at", "an", "not", "you", "your", "all", "no", "any", "but", "if", "one", "so", "may", "such", "other",
            "only", "more", "out", "under", "was", "which", "been", "has", "its", "use", "used", "even", "either", "do",
            "http", "https", "part", "name", "names", "kind", "later", "form", "up", "1", "2", "3", "2.0",
            "4.0", "public", "general", "free", "file", "person", "work", "special", "particular", "without", "whether",
            "business", "event", "rights", "services", "however", "included", "including", "following", "above", "source",
            "program", "provided", "version", "subject", "terms", "1991", "2007", "everyone", "must", "can", "shall")
