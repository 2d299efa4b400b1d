"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Passages of a whole text are its lines, the sentences of lines that have several, its paragraphs (blocks of
lines, as notices are wrapped), runs of paragraphs that may belong to a licence, and the text itself. Their
terms, weighted by frequency and inverse document frequency, are compared with those of the licence
templates by cosine; only terms of templates are held, so vectors stay sparse, and terms outside them count
in a passage's norm with the highest weight. Document frequencies of the templates' terms are counted over
all documents.

A passage names the licence of its nearest template if the cosine is ``MIN_COSINE`` or more, and no other
licence is within ``MARGIN``. Only templates whose own terms (name, version) the passage has, and whose barred
ones it has not, are compared, so that a version or variant is named rightly or not at all. A document's
licence is that of its best passage.

Of the terms that a template needs, those that fewest documents have are its marks. A passage without any
template's mark can match none: such passages, and texts, are left out at once, which loses nothing.

A licence file is one of a usual name that has a licence, or one that as a whole is a licence's full text. A
document without a licence inherits that of the nearest directory above it that holds a licence file. The
path join runs over distinct directories and their ancestors, not over documents.

Defined cases: null and blank texts have no licence; equal best cosines go to the first licence by name, equal
files of a directory to the first path; a null path is in the root; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelark.llm.common import materialize, sized

MIN_COSINE, MARGIN = 0.75, 0.03
#: A template of so many terms is a licence's full text.
FULL_TERMS = 50
FILE_NAMES = r"(?i)^(un)?licen[sc]e|^copying|^notice"
_term = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_wrapped = re.compile(r"(?<=[a-z])-[ \t\r]*\n[ \t\r*#/%;>|-]*(?=[a-z])")
_end = re.compile(r"[.!?]+(?=[ \t\r\x0b\x0c\n])|\n")


@dataclass(frozen=True)
class Template:
    """A wording of a licence. A passage needs one term of each of ``needs`` and none of ``bars``."""

    licence: str
    text: str
    needs: tuple[tuple[str, ...], ...]
    bars: tuple[str, ...] = ()


# Wordings of licences -----------------------------------------------------------------

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR'
    " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
    " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without'
    " restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom"
    " the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial"
    " portions of the Software. "
) + _AS_IS
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT'
    " SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION"
    " OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must"
    " retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
    " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written"
    " permission. "
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF'
    " MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,"
    " EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER"
    " CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN"
    " IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source"
    " code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this"
    " software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our"
    " heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
) + _AS_IS
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
    " http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_AS_IS = (
    ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,'
    " either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_GNU = {
    "GPL": ("General Public License", ("2.0", "3.0"), ("lesser", "library", "affero")),
    "LGPL": ("Lesser General Public License", ("2.1", "3.0"), ("affero",)),
    "AGPL": ("Affero General Public License", ("3.0",), ("lesser", "library")),
}
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_PLAIN = (
    Template("0BSD", _ISC.partition(", provided")[0] + "." + _ISC_AS_IS, (("fee",), ("granted",)), ("appear",)),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", (("apache",), ("2.0",))),
    Template("Apache-2.0", _APACHE, (("apache",), ("2.0",))),
    Template("Apache-2.0", _APACHE + _APACHE_AS_IS, (("apache",), ("2.0", "license-2.0"))),
    Template("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", (("bsd",), ("2-clause",))),
    Template("BSD-2-Clause", _BSD + _BSD_AS_IS, (("redistributions",), ("disclaimed",)), ("neither", "endorse", "advertising")),
    Template("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", (("bsd",), ("3-clause",))),
    Template("BSD-3-Clause", _BSD + _BSD_NAME + _BSD_AS_IS, (("redistributions",), ("neither",), ("endorse",), ("disclaimed",)), ("advertising",)),
    Template("CC0-1.0", "Licensed under CC0 1.0 Universal.", (("cc0",),)),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, under CC0 1.0 Universal public domain dedication.", (("cc0",), ("1.0",))),
    Template("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", (("eclipse",), ("1.0", "v1.0"))),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", (("eclipse",), ("2.0", "v2.0"))),
    Template("ISC", "Licensed under the ISC License.", (("isc",),)),
    Template("ISC", _ISC, (("fee",), ("granted",), ("appear",))),
    Template("ISC", _ISC + _ISC_AS_IS, (("fee",), ("granted",), ("appear",))),
    Template("MIT", "Released under the MIT License.", (("mit",),)),
    Template("MIT", "Licensed under the MIT license.", (("mit",),)),
    Template("MIT", _MIT, (("sublicense",), ("substantial",), ("portions",)), ("advertising",)),
    Template("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.', (("mozilla",), ("1.1",))),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", (("mozilla",), ("2.0",))),
    Template("Unlicense", _UNLICENSE, (("unencumbered",),)),
    Template("Unlicense", "This is free and unencumbered software released into the public domain.", (("unencumbered",),)),
)


def _gnu() -> Iterator[Template]:
    for short, (name, versions, bars) in _GNU.items():
        for v in versions:
            whole = v.removesuffix(".0")
            own = tuple((t,) for t in name.lower().split()) + ((v, whole, f"v{v}", f"v{whole}"),)
            texts = [f"This work is licensed under the GNU {name}, version {whole}.", f"GNU {name} Version {whole}"]
            for what in ("program", "library")[: 2 if short == "LGPL" else 1]:
                texts.append(
                    f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation;"
                    f" either version {whole} of the License, or (at your option) any later version."
                )
            for text in texts:
                yield Template(f"{short}-{v}", text, own, bars)


def _cc() -> Iterator[Template]:
    for code, name in _CC.items():
        for v, kind in (("3.0", "Unported"), ("4.0", "International")):
            own = ((code.lower(), name.lower()), (v,))
            for text in (f"Licensed under CC {code} {v}.", f"This work is licensed under a Creative Commons {name} {v} {kind} License."):
                yield Template(f"CC-{code}-{v}", text, own)


def _spdx(names: list[str]) -> Iterator[Template]:
    for name in names:
        ends = ("", "-only", "-or-later") if re.match("A?L?GPL", name) else ("",)
        for end in ends:
            yield Template(name, f"SPDX-License-Identifier: {name}{end}", (((name + end).lower(),),))


_worded = [*_PLAIN, *_gnu(), *_cc()]
TEMPLATES: tuple[Template, ...] = tuple(sorted([*_worded, *_spdx(sorted({t.licence for t in _worded}))], key=lambda t: t.licence))


def words(passage: str) -> list[str]:
    """The terms of a passage; one that is wrapped behind a hyphen is whole."""
    return _term.findall(_wrapped.sub("-", passage.lower()))


def terms(passage: str) -> Counter:
    return Counter(words(passage))


VOCABULARY = frozenset(x for t in TEMPLATES for x in terms(t.text)) | frozenset(x for t in TEMPLATES for need in t.needs for x in need)


class Matcher:
    """Cosine of passages to templates under document frequencies of the templates' terms and marks."""

    def __init__(self, documents: int, frequency: dict[str, int]) -> None:
        self.idf = {t: math.log((1 + documents) / (1 + frequency.get(t, 0))) + 1 for t in VOCABULARY}
        self.rarest = math.log(1 + documents) + 1
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.full: list[bool] = []
        #: Terms without which no passage matches any template.
        self.marks: set[str] = set()
        for k, template in enumerate(TEMPLATES):
            found = terms(template.text)
            self.full.append(sum(found.values()) >= FULL_TERMS)
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in found.items()))
            for t, n in found.items():
                self.postings[t].append((k, n * self.idf[t] / norm))
            self.marks |= set(min(template.needs, key=lambda need: (max(frequency.get(t, 0) for t in need), need)))

    def maybe(self, passage: str) -> bool:
        """False only if the passage matches no template."""
        return not self.marks.isdisjoint(words(passage))

    def best(self, passage: str) -> tuple[str | None, float, bool]:
        """The licence that a passage names, or none; its cosine; whether the template is a full text."""
        found = terms(passage)
        if self.marks.isdisjoint(found):
            return None, 0.0, False
        dots, square = defaultdict(float), 0.0
        for t, n in found.items():
            weight = n * self.idf.get(t, self.rarest)
            square += weight * weight
            for k, w in self.postings.get(t, ()):
                dots[k] += weight * w
        size, top, other = math.sqrt(square), (0.0, -1), 0.0
        for k in sorted(dots, key=lambda k: (-dots[k], k)):
            cosine, template = dots[k] / size, TEMPLATES[k]
            if cosine < MIN_COSINE - MARGIN:
                break
            if all(any(t in found for t in need) for need in template.needs) and found.keys().isdisjoint(template.bars):
                if top[1] < 0:
                    top = (cosine, k)
                elif template.licence != TEMPLATES[top[1]].licence:
                    other = cosine
                    break
        if top[1] < 0 or top[0] < MIN_COSINE or top[0] - other < MARGIN:
            return None, 0.0, False
        return TEMPLATES[top[1]].licence, top[0], self.full[top[1]]


def paragraphs(text: str) -> list[str]:
    """Blocks of lines between lines without a letter or digit."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if _term.search(line.lower()):
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return ["\n".join(x) for x in out if x]


def passages(text: str, matcher: Matcher) -> Iterator[str]:
    """What is compared of a text, but for passages without a mark."""
    run: list[str] = []
    for block in [*paragraphs(text), ""]:
        if block and matcher.maybe(block):
            run.append(block)
            lines = block.split("\n")
            if len(lines) > 1:
                yield block
            for line in lines:
                if not matcher.maybe(line):
                    continue
                yield line
                cuts = [m.end() for m in _end.finditer(line)]
                if cuts and cuts[-1] < len(line.rstrip()) or len(cuts) > 1:
                    for a, b in zip([0, *cuts], [*cuts, len(line)], strict=True):
                        if line[a:b].strip():
                            yield line[a:b]
        else:
            if len(run) > 1:
                yield "\n".join(run)
            run = []


def licence_of(text: str | None, matcher: Matcher) -> tuple[str | None, float | None, bool]:
    """Licence and cosine of a whole text's best passage, and whether the text is a licence's full text."""
    if not text or not matcher.maybe(text):
        return None, None, False
    name, top, full = matcher.best(text)
    for passage in passages(text, matcher):
        found, cosine, _ = matcher.best(passage)
        if found is not None and (cosine > top or cosine == top and (name is None or found < name)):
            name, top = found, cosine
    return name, None if name is None else round(top, 6), full


def frequencies(docs: DataFrame, text_col: str) -> tuple[int, dict[str, int]]:
    """Documents, and how many hold each of the templates' terms: at most one number per term reaches the driver."""
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                documents += 1
                counts.update(VOCABULARY.intersection(words(text or "")))
        counts[""] = documents
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    got = {r.term: r.n for r in docs.select(text_col).mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return got.pop("", 0), got


def headers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """(id, path, licence, cosine, full) per row: the best passage, and whether the whole text is a licence."""
    matcher = Matcher(*frequencies(docs, text_col))
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("path", T.StringType()), T.StructField("licence", T.StringType()),
        T.StructField("cosine", T.DoubleType()), T.StructField("full", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [licence_of(text, matcher) for text in batch.column(2).to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            columns = [batch.column(0), batch.column(1).cast(pa.string()), *[pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(text_col)).mapInArrow(run, schema)


def directory_of(path):
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """(id, path, licence, cosine, origin, inherited_from) per row; origin is header, inherited or none."""
    rows = materialize(headers(docs, id_col, text_col, path_col).withColumn("dir", directory_of(F.col("path"))), "headers")
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAMES)
    files = rows.filter(F.col("licence").isNotNull() & (named | F.col("full")))
    held = files.groupBy("dir").agg(F.min_by("licence", F.struct("path", "licence")).alias("dir_licence"))
    held = materialize(held.withColumnRenamed("dir", "above"), "licence-files")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    chain = rows.select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.above")
    nearest = chain.join(sized(held), "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_licence")).alias("n"))
    nearest = materialize(nearest.select(F.col("dir").alias("_dir"), F.col("n.above").alias("_above"), F.col("n.dir_licence").alias("_licence")), "nearest")
    out = rows.join(sized(nearest), F.col("dir") == F.col("_dir"), "left")
    own = F.col("licence").isNotNull()
    origin = F.when(own, "header").when(F.col("_licence").isNotNull(), "inherited").otherwise("none")
    return out.select(id_col, "path", F.coalesce("licence", "_licence").alias("licence"), "cosine", origin.alias("origin"), F.when(~own, F.col("_above")).alias("inherited_from"))
