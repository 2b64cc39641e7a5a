"""Licence notices by Dice similarity over word bigrams.

Texts and templates are normalised alike: ASCII letters in lower case, ASCII punctuation as spaces. Word
pairs of any template mark a text's words; marked stretches (gaps of up to ``GAP`` words) are segments. For each
template windows slide over a segment, of the sizes that can still reach the threshold: with a window of n and a
template of m bigrams, Dice is at most 2 min(n, m) / (n + m). The best windows that don't overlap are notices.
"""

from __future__ import annotations

from bisect import bisect
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridweave.llm.common import WordHashes, lean, shingle_hashes, small_batches, text_bytes

#: Dice similarity from which a segment is a licence's notice.
THRESHOLD = 0.8
GAP = 3

# Notices (fixed values).
TEMPLATES = {
    "all-rights-reserved": ("All rights reserved.",),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "bsd-3-clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc0-1.0": ("This work has been dedicated to the public domain under CC0 1.0.",),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "lgpl-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.",),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
}

#: Standard headers, and the whole texts of the short licences (fixed values).
TEXTS = {
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        'written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
        "DAMAGE.",
    ),
    "gpl-2.0": (
        (
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
            "option) any later version."
        ),
        (
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
            "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
            "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
            "General Public License for more details."
        ),
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details.",
    ),
    "lgpl-2.1": (
        (
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
            "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
            "your option) any later version."
        ),
        (
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
            "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
            "your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY "
            "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
            "Lesser General Public License for more details."
        ),
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
}

_AS_IS_2 = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: More licences: short notices, standard headers and the whole texts of short ones (fixed values).
MORE = {
    "0bsd": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS "
        'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "agpl-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "artistic-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",),
    "bsd-2-clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        f"documentation and/or other materials provided with the distribution. {_AS_IS_2}",
    ),
    "bsl-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to '
        "prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
        "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE "
        "DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    "isc": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ),
    "lgpl-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        'under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
}
ALL = {name: TEMPLATES.get(name, ()) + TEXTS.get(name, ()) + MORE.get(name, ()) for name in sorted({*TEMPLATES, *TEXTS, *MORE})}

_TABLE = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def normalised(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def dice(a: np.ndarray, b: np.ndarray) -> float:
    """Dice coefficient of two sets of bigrams (sorted distinct arrays)."""
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b)) if len(a) + len(b) else 0.0


class Matcher:
    def __init__(self, templates: dict[str, tuple[str, ...]] = ALL, threshold: float = THRESHOLD):
        self.hashes, self.threshold = WordHashes(), threshold
        self.templates = sorted(
            ((len(g), name, g) for name, texts in templates.items() for t in texts if len(g := np.unique(self.bigrams(normalised(t.encode()))))),
            key=lambda x: x[:2],
        )
        self.sizes = np.array([t[0] for t in self.templates])
        self.marks = np.unique(np.concatenate([t[2] for t in self.templates]))

    def bigrams(self, words: list[bytes]) -> np.ndarray:
        return shingle_hashes(self.hashes.of(words), 2) if len(words) > 1 else np.zeros(0, np.uint64)

    def segments(self, grams: np.ndarray) -> list[tuple[int, int]]:
        """(first, end) bigram positions of the marked stretches."""
        place = np.searchsorted(self.marks, grams)
        place[place == len(self.marks)] = 0
        at = np.nonzero(self.marks[place] == grams)[0]
        if not len(at):
            return []
        cut = np.nonzero(np.diff(at) > GAP + 1)[0] + 1
        return [(int(p[0]), int(p[-1]) + 1) for p in np.split(at, cut)]

    def best(self, own: np.ndarray) -> tuple[float, str] | None:
        """(minus Dice, name) of the nearest template of a set of bigrams, if it reaches the threshold; ties to the first name."""
        n, t = len(own), self.threshold
        low, high = np.searchsorted(self.sizes, [n * t / (2 - t) - 1e-9, n * (2 - t) / t + 1e-9])
        found = min(((-dice(own, g), name) for _, name, g in self.templates[low:high]), default=None)
        return found if found and -found[0] >= t else None

    def windows(self, grams: np.ndarray) -> list[tuple[int, float, str, int, int]]:
        """(shared bigrams, Dice, licence, first, end) of each template's best windows of a stretch, none overlapping another of its own.

        A window begins and ends with bigrams of the template; one with n distinct bigrams can reach the threshold only within the
        size bounds, and only if it shares at least m t / (2 - t) of the template's m.
        """
        out, t = [], self.threshold
        if len(grams) < self.sizes[0] * t / (2 - t) - 1e-9:
            return out
        order = np.argsort(grams, kind="stable")
        before = np.full(len(grams), -1)  # where each bigram stood last
        again = grams[order[1:]] == grams[order[:-1]]
        before[order[1:][again]] = order[:-1][again]
        for m, name, g in self.templates:
            least = max(1, int(np.ceil(m * t / (2 - t) - 1e-9)))
            most = int(m * (2 - t) / t + 1e-9)
            if least > len(grams):
                break  # the other templates are larger
            ours = np.isin(grams, g)
            if np.count_nonzero(ours) < least:
                continue

            def best(a: int, stop: int, m=m, most=most, ours=ours):
                """The best window from a on that ends before ``stop``: of equal ones the longest."""
                new = before[a:stop] < a
                n = np.cumsum(new)
                z = int(np.searchsorted(n, most + 1))
                shared = np.cumsum(new[:z] & ours[a : a + z])
                rate = np.where(ours[a : a + z], 2 * shared / (n[:z] + m), 0)
                k = int(len(rate) - 1 - rate[::-1].argmax())
                return (-float(rate[k]), a, a + k + 1, int(shared[k]))

            heap = [w for a in np.nonzero(ours)[0].tolist() if -(w := best(a, len(grams)))[0] >= t]
            heapify(heap)
            taken: list[tuple[int, int]] = []
            while heap:
                rate, a, z, shared = heappop(heap)
                k = bisect(taken, (a, len(grams)))
                if k and taken[k - 1][1] > a:
                    continue
                if k < len(taken) and taken[k][0] < z:  # what is left before the next one
                    if -(w := best(a, taken[k][0]))[0] >= t:
                        heappush(heap, w)
                    continue
                taken.insert(k, (a, z))
                out.append((shared, -rate, name, a, z))
        return out

    def __call__(self, raw: bytes) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first word, words) of the notices, in order.

        Of the templates' windows over each marked stretch those that share most bigrams with theirs go first, then by Dice and name;
        windows that overlap one before are dropped. A stretch that is a notice as a whole and holds no second one is given whole.
        """
        grams = self.bigrams(normalised(raw))
        out = []
        for a, z in self.segments(grams):
            found = self.windows(grams[a:z])
            taken: list[tuple[int, int]] = []
            hits = []
            for _, score, name, x, y in sorted(found, key=lambda w: (-w[0], -w[1], w[2], w[3])):
                k = bisect(taken, (x, z))
                if (k and taken[k - 1][1] > x) or (k < len(taken) and taken[k][0] < y):
                    continue
                taken.insert(k, (x, y))
                hits.append((name, score, a + x, y - x + 1))
            if len(hits) < 2 and (whole := self.best(np.unique(grams[a:z]))):
                hits = [(whole[1], -whole[0], a, z - a + 1)]
            out += hits
        return sorted(out, key=lambda w: w[2])


def license_notices(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, at (first word of the normalised text), words: one row for each notice found.

    Null, empty and blank texts have none; repeated rows each give theirs, and so do rows without doc_id; very long texts are searched whole;
    ties between templates go to the first name; other columns are ignored; an empty table gives an empty table.
    """
    lean(docs)
    kinds = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("dice", pa.float64()), ("at", pa.int64()), ("words", pa.int64())])

    def run(batches):
        match = Matcher(threshold=threshold)
        for b in small_batches(batches):
            rows = [(d, *m) for d, raw in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text")), strict=True) for m in match(raw)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, dice double, at long, words long")
