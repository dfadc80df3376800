"""Known licences: short public licence texts and one-line notices as templates without names, and whole long texts from files."""

from __future__ import annotations

from pathlib import Path

#: Whole texts, one file a licence, named by its id.
FOLDER = Path(__file__).parent / "licences"
#: Fixed value: the line behind which some licences say how to apply them.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""

_ISC_0 = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""

#: Fixed values: (licence id, text). A text with and without its title is the same licence.
SHORT_TEXTS = [
    ("MIT", f"{_MIT}\n{_AS_IS}"),
    ("MIT", f"MIT License\n{_MIT}\n{_AS_IS}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT}\n{_AS_IS}"),
    ("ISC", f"{_ISC}\n{_ISC_END}"),
    ("ISC", f"ISC License\n{_ISC}\n{_ISC_END}"),
    ("0BSD", f"{_ISC_0}\n{_ISC_END}"),
    ("0BSD", f"BSD Zero Clause License\n{_ISC_0}\n{_ISC_END}"),
    ("BSD-2-Clause", f"{_BSD_START}\n{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_START}\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START}\n{_BSD_NAMES}\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_START}\n{_BSD_NAMES}\n{_BSD_END}"),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
]


def whole_texts() -> list[tuple[str, str]]:
    """The texts of the files; also each without what follows the end of its terms, and without that line."""
    found = []
    for path in sorted(FOLDER.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        found.append((path.stem, text))
        if END_OF_TERMS in text:
            terms = text[:text.index(END_OF_TERMS)]
            found += [(path.stem, terms + END_OF_TERMS), (path.stem, terms)]
    return found


LICENSES = SHORT_TEXTS + whole_texts()
