"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Every line and every block of a text, and the text as a whole, are sparse vectors of word counts times inverse
document frequency over the templates; a word that no template has weighs most. A block is a run of lines that
are not blank and are all comments or all not, so a header of many comment lines is one block. A line or block
whose cosine to a template reaches ``header`` is a licence header of its file. A file is the licence file of its
directory if its whole text reaches ``file``, or if it is named like one (LICENSE, COPYING, ...) and has a header:
the title of a long licence is enough there. A file without a header takes the licence file of its nearest
directory, upwards from its own. A licence has as many templates as it has usual forms.

Directories, not files, look for their nearest licence: each distinct directory lists its ancestors, which
are joined with the licence files by path; files then join their directory. The template list is part of the
configuration and bounds what each task holds.

Edge cases: null and empty texts have no header; they can inherit. A null path has no directory and inherits
nothing. Of several licence files in a directory the best score counts, then the smaller template name.
Repeated rows each get a row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import join_measured
from weekloom.llm.words import LETTERS, Words, mix, passes
from weekloom.session import stage

AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""


def gnu(name: str, version: str) -> str:
    """The usual header of the licences of this family."""
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as
    published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
    warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received
    a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""


#: The usual forms of common licences: notices, headers, whole texts, titles of long ones. Another list is a parameter.
TEMPLATES: dict[str, str | tuple[str, ...]] = {
    "agpl-3.0": (gnu("GNU Affero General Public License", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        APACHE,
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd-2-clause": (f"{BSD} {BSD_AS_IS}", "SPDX-License-Identifier: BSD-2-Clause"),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        f"{BSD} {BSD_NAMES} {BSD_AS_IS}",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-2.0": (gnu("GNU General Public License", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        gnu("GNU General Public License", "3"),
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "lgpl-3.0": (gnu("GNU Lesser General Public License", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "mit": (
        "Released under the MIT License.",
        f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS}""",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "Mozilla Public License Version 2.0",
    ),
}

#: Names of licence files, as a regular expression over the path.
LICENCE_FILE = r"(?i)(^|/)((un)?licen[cs]es?|copying)([._-][^/]*)?$"


@dataclass(frozen=True)
class Thresholds:
    header: float = 0.8
    file: float = 0.8


class Templates:
    """Word hashes (sorted), their weights per template, and the weight of a word that no template has."""

    def __init__(self, texts: dict[str, str | tuple[str, ...]]) -> None:
        forms = [(name, text) for name, of in sorted(texts.items()) for text in ([of] if isinstance(of, str) else of)]
        self.names = [name for name, _ in forms]
        bags = []
        for _, text in forms:
            w = Words([text.encode()], LETTERS)
            bags.append(Counter(w.hash.tolist()))
        self.known = np.array(sorted({h for b in bags for h in b}), np.uint64)
        n = len(bags)
        held = np.array([sum(h in b for b in bags) for h in self.known.tolist()])
        self.idf = np.log((1 + n) / (1 + held)) + 1
        self.strange = math.log(1 + n) + 1
        weights = np.array([[b[h] for b in bags] for h in self.known.tolist()]) * self.idf[:, None]
        self.weights = weights / np.sqrt((weights**2).sum(axis=0))

    def best(self, owner: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Best template and cosine of each of n bags; word i belongs to bag owner[i]."""
        with np.errstate(over="ignore"):
            key = mix(words + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        owner, words = owner[first], words[first]
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        known = self.known[at] == words
        weight = count * np.where(known, self.idf[at], self.strange)
        norm = np.sqrt(np.bincount(owner, weight**2, n))
        dot = np.stack([np.bincount(owner[known], weight[known] * self.weights[at[known], t], n) for t in range(len(self.names))])
        cosine = dot / np.where(norm > 0, norm, 1)
        return cosine.argmax(axis=0), cosine.max(axis=0)


def blocks(data: np.ndarray, begins: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Block number of each line, given where lines and texts begin."""
    ends = np.concatenate([begins[1:], [len(data)]])
    solid = np.concatenate([np.flatnonzero(data > 32), [len(data)]])
    first = solid[np.searchsorted(solid, begins)]
    blank = first >= ends
    # Two spaces behind the end, so that every line has two bytes.
    padded = np.concatenate([data, np.full(2, 32, data.dtype)])
    one, two = padded[first], padded[first + 1]
    comment = np.isin(one, np.frombuffer(b"#*;%", np.uint8))
    for a, b in (b"//", b"/*", b"--", b"<!"):
        comment |= (one == a) & (two == b)
    opens = blank | np.isin(begins, texts)
    opens[1:] |= blank[:-1] | (comment[1:] != comment[:-1])
    opens[0] = True
    return np.cumsum(opens) - 1


def _scan(batches: Iterator[pa.RecordBatch], templates: Templates) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for at, part in passes(batch.column("_text")):
            w = Words(part, LETTERS)
            if not len(w.hash):
                out += [(None, 0.0, None, 0.0)] * len(part)
                continue
            feeds = np.flatnonzero((w.data == 10))
            begins = np.unique(np.concatenate([w.offset[:-1], feeds + 1]))
            line = np.searchsorted(begins, w.start, "right") - 1
            block = blocks(w.data, begins, w.offset[:-1])[line]
            units = []
            for unit in (line, block):
                _, head, unit = np.unique(unit, return_index=True, return_inverse=True)
                doc = np.searchsorted(w.offset, w.start[head], "right") - 1
                units.append((doc, *templates.best(unit, w.hash, len(head))))
            doc_of_unit, which, score = (np.concatenate(x) for x in zip(*units))
            doc_of_word = np.searchsorted(w.offset, w.start, "right") - 1
            file, file_score = templates.best(doc_of_word, w.hash, len(part))
            best: dict[int, tuple[float, str]] = {}
            for k in np.flatnonzero(score > 0.3):
                d, s, name = int(doc_of_unit[k]), float(score[k]), templates.names[which[k]]
                if d not in best or (s, best[d][1]) > (best[d][0], name):
                    best[d] = (s, name)
            for d in range(len(part)):
                s, name = best.get(d, (0.0, None))
                whole = float(file_score[d])
                out.append((name, s, templates.names[file[d]] if whole > 0 else None, whole))
        columns = list(zip(*out)) if out else [()] * 4
        kinds = (pa.string(), pa.float64(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("_path"), batch.column("_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            names=["_path", "_id", "_header", "_header_score", "_file", "_file_score"],
        )


def ancestors(path: Column) -> Column:
    """All directories above a path, the root "" included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(
    files: DataFrame, thresholds: Thresholds = Thresholds(), templates: dict[str, str | tuple[str, ...]] | None = None
) -> DataFrame:
    """``id``, ``path``, ``licence``, ``score`` and ``origin`` (header, file, inherited or null) of every file.

    ``files``: ``id``, ``path``, ``text``.
    """
    shared = files.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES))
    kind = dict(files.dtypes)["id"]
    slim = files.select(F.col("path").alias("_path"), F.col("id").alias("_id"), F.col("text").alias("_text"))
    schema = f"_path string, _id {kind}, _header string, _header_score double, _file string, _file_score double"
    scored = stage(slim.mapInArrow(lambda b: _scan(b, shared.value), schema), "licences")
    scored = scored.withColumn("_dir", parent(F.col("_path")))
    # A file named like a licence file counts by its best line or block, too.
    whole = F.col("_file_score") >= thresholds.file
    named = F.col("_path").rlike(LICENCE_FILE) & (F.col("_header_score") >= thresholds.header) & ~whole
    scored = scored.withColumns(
        {
            "_is_file": F.coalesce(whole | named, F.lit(False)),
            "_file": F.when(named, F.col("_header")).otherwise(F.col("_file")),
            "_file_score": F.when(named, F.col("_header_score")).otherwise(F.col("_file_score")),
        }
    )
    best = F.max_by(F.struct("_file", "_file_score"), F.struct("_file_score", F.col("_file")))
    of_dir = (
        scored.where(F.col("_is_file") & F.col("_dir").isNotNull())
        .groupBy(F.col("_dir").alias("_above"))
        .agg(best.alias("_best"))
    )
    of_dir = stage(of_dir, "licence-files")
    dirs = scored.where("_dir IS NOT NULL").select("_dir").distinct()
    above = dirs.select("_dir", F.explode(ancestors(F.concat("_dir", F.lit("/x")))).alias("_above"))
    above = above.where((F.col("_dir") == "") | ~F.col("_above").startswith("/"))
    nearest = (
        join_measured(above, of_dir, ["_above"], "inner", 200)
        .groupBy("_dir")
        .agg(F.max_by("_best", F.length("_above")).alias("_near"))
    )
    nearest = stage(nearest, "nearest")
    own, file = F.col("_header_score") >= thresholds.header, F.col("_is_file")
    pick = lambda a, b, c: F.when(file, a).when(own, b).otherwise(c)
    return join_measured(scored, nearest, ["_dir"], "left", 200).select(
        F.col("_id").alias("id"),
        F.col("_path").alias("path"),
        pick(F.col("_file"), F.col("_header"), F.col("_near._file")).alias("licence"),
        pick(F.col("_file_score"), F.col("_header_score"), F.col("_near._file_score")).alias("score"),
        pick(F.lit("file"), F.lit("header"), F.when(F.col("_near").isNotNull(), "inherited")).alias("origin"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, then the ten thousands and hundreds of the id."""
    path = F.concat_ws(
        "/",
        F.coalesce("source", F.lit("unknown")),
        F.floor(F.col("doc_id") / 10000).cast("string"),
        F.floor(F.col("doc_id") / 100).cast("string"),
        F.col("doc_id").cast("string"),
    )
    return docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")
