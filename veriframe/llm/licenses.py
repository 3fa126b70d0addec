"""Licence scan: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest directory above.

A licence has several templates: short notices and the paragraphs of its header or text. Compared are, where they
hold a licence cue, single lines and whole paragraphs (lines joined up to one without words) with THRESHOLD, and the
stretches of a paragraph as long as a template with the stricter NEAR, which finds notices that are wrapped or stand
within other words. A licence tag (SPDX or "license: id") names its licence by itself. The best cosine names the
document's licence; "all rights reserved" counts only where nothing else is found. Term weights come from the
templates, a fixed set. A file that is nothing but a notice (at least half of its words stand in notices) is a
licence file and speaks for its directory, as is one that begins as the full text of a licence does (cosine of both
beginnings, OPENING); documents without a notice take over the licence of the nearest ancestor directory with a licence
file, by joins on the path's ancestors: where its files name several, all of them, in order, joined by " | ". Null and empty texts have no notice but inherit;
a null path part is '~'; ties go to the first name in order.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

# Short notices and header paragraphs of public licences.
TEMPLATES = {
    "Apache-2.0": (
        "licensed under the apache license version 2.0", "apache license version 2.0", "apache license 2.0", "apache license version 2.0 january 2004 http www.apache.org licenses",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license 2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    "BSD-3-Clause": (
        "redistribution and use in source and binary forms with or without modification are permitted bsd license", "bsd 3 clause license", "3 clause bsd license", "new bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "CC-BY-4.0": ("licensed under cc by 4.0 creative commons attribution", "licensed under cc by 4.0", "creative commons attribution 4.0 international license", "licensed under a creative commons attribution 4.0 international license"),
    "CC-BY-NC-4.0": ("licensed under cc by nc 4.0 creative commons attribution noncommercial", "licensed under cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license", "licensed under a creative commons attribution noncommercial 4.0 international license"),
    "GPL-3.0": (
        "this work is licensed under the gnu general public license version 3", "gnu general public license version 3", "gnu general public license v3", "licensed under the gpl version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "MIT": (
        "released under the mit license permission is hereby granted free of charge", "released under the mit license", "licensed under the mit license", "mit license", "the mit license mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "MPL-2.0": ("this source code form is subject to the terms of the mozilla public license version 2.0", "mozilla public license version 2.0", "mozilla public license v 2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0"),
    "proprietary": ("all rights reserved no part may be reproduced without permission of the copyright holder", "all rights reserved"),
}
# How the full texts of public licences begin.
OPENINGS = {
    "AGPL-3.0": "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble the gnu affero general public license is a free copyleft license",
    "Apache-2.0": "apache license version 2.0 january 2004 http www.apache.org licenses terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "Artistic-1.0": "the artistic license preamble the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package",
    "BSL-1.0": "boost software license version 1.0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation",
    "CC0-1.0": "creative commons legal code cc0 1.0 universal creative commons corporation is not a law firm and does not provide legal services distribution of this document does not create an attorney client relationship",
    "CC-BY-4.0": "attribution 4.0 international creative commons corporation creative commons is not a law firm and does not provide legal services or legal advice distribution of creative commons public licenses does not create a lawyer client or other relationship",
    "CC-BY-NC-4.0": "attribution noncommercial 4.0 international creative commons corporation creative commons is not a law firm and does not provide legal services or legal advice distribution of creative commons public licenses does not create a lawyer client or other relationship",
    "GFDL-1.2": "gnu free documentation license version 1.2 november 2002 copyright c 2000 2001 2002 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "GFDL-1.3": "gnu free documentation license version 1.3 3 november 2008 copyright c 2000 2001 2002 2007 2008 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "GPL-1.0": "gnu general public license version 1 february 1989 copyright c 1989 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble",
    "GPL-2.0": "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble",
    "GPL-3.0": "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble the gnu general public license is a free copyleft license",
    "LGPL-2.0": "gnu library general public license version 2 june 1991 copyright c 1991 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this is the first released version of the library gpl",
    "LGPL-2.1": "gnu lesser general public license version 2.1 february 1999 copyright c 1991 1999 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this is the first released version of the lesser gpl",
    "LGPL-3.0": "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this version of the gnu lesser general public license",
    "MPL-1.1": "mozilla public license version 1.1 1 definitions 1.0.1 commercial use means distribution or otherwise making the covered code available to a third party",
    "MPL-2.0": "mozilla public license version 2.0 1 definitions 1.1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",
    "Unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary",
}
RESERVED = "proprietary"
# Words by which a notice of another licence differs from one that it resembles.
FOREIGN = {"CC-BY-4.0": {"nc", "noncommercial", "sa", "sharealike", "nd", "noderivatives"}, "CC-BY-NC-4.0": {"sa", "sharealike", "nd", "noderivatives"}, "GPL-3.0": {"lesser", "library", "affero"}}
CUE = re.compile(r"licen[sc]e|copyright|rights reserved|redistribution|permission is|creative commons|implied warrant|spdx|\bgpl\b", re.I)
HINT = re.compile(r"licen[sc]e|copyright|reserved|redistribution|permission|commons|warrant|spdx|\bgpl\b", re.I)  # a word of each cue, which may be wrapped
SPDX = re.compile(r"spdx-licen[sc]e-identifier\s*:\s*(.*)", re.I)
TAG = re.compile(r"\blicen[sc]e[\"']?\s*[:=]\s*[\"']?([a-z0-9][a-z0-9.+-]*)", re.I)
ID = re.compile(r"[a-z0-9][a-z0-9.+-]*", re.I)
IDS = {k.lower(): k for k in TEMPLATES} | {f"gpl-3.0{x}": "GPL-3.0" for x in ("+", "-only", "-or-later")}
THRESHOLD, NEAR, OPENING, ADDRESS, WORD = 0.55, 0.85, 0.75, 16, re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


class Templates:
    def __init__(self):
        lists = [(k, WORD.findall(v)) for k, vs in sorted(TEMPLATES.items()) for v in vs]
        df = Counter(w for k in TEMPLATES for w in {w for name, v in lists if name == k for w in v})
        self.idf = {w: 1 + math.log(len(TEMPLATES) / n) for w, n in df.items()}
        self.rare = 1 + math.log(len(TEMPLATES))
        self.names, self.sizes = [k for k, _ in lists], [len(v) for _, v in lists]
        self.vectors = [self.unit(Counter(v)) for _, v in lists]
        self.openings = {k: WORD.findall(v) for k, v in OPENINGS.items()}
        opened = Counter(w for v in self.openings.values() for w in set(v))
        self.opening_idf = {w: 1 + math.log(len(OPENINGS) / n) for w, n in opened.items()}
        self.at = {w: i for i, w in enumerate(self.idf)}
        self.weight = np.array([*self.idf.values(), self.rare])
        self.matrix = np.array([[t.get(w, 0.0) for w in self.idf] + [0.0] for t in self.vectors]) * self.weight

    def unit(self, count: Counter) -> dict[str, float]:
        v = {w: n * self.idf.get(w, self.rare) for w, n in count.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    def whole(self, words: list[str]) -> list[tuple[str, float]]:
        """Names and cosines at or over THRESHOLD of a line or paragraph."""
        v = self.unit(Counter(words))
        out = ((k, sum(x * t.get(w, 0.0) for w, x in v.items())) for k, t in zip(self.names, self.vectors, strict=True) if not FOREIGN.get(k, set()) & v.keys())
        return [(k, c) for k, c in out if c >= THRESHOLD]

    def stretches(self, words: list[str]) -> list[tuple[str, float, int, int]]:
        """Name, cosine, start and end of stretches at or over NEAR that are as long as a template and hold a word of a cue."""
        ids = np.array([self.at.get(w, len(self.at)) for w in words])
        sums = lambda x: np.concatenate([np.zeros((*x.shape[:-1], 1)), np.cumsum(x, axis=-1)], axis=-1)
        cues, norms, tops = sums(np.array([bool(HINT.search(w)) for w in words], float)), sums(self.weight[ids] ** 2), sums(self.matrix[:, ids])
        out, kept = [], []
        for i, (k, n) in enumerate(zip(self.names, self.sizes, strict=True)):
            if n > len(words):
                continue
            # a repeated word makes the true norm larger, so this is never below the cosine
            bound = (tops[i, n:] - tops[i, :-n]) / np.sqrt(norms[n:] - norms[:-n])
            for a in np.flatnonzero((bound >= NEAR - 1e-6) & (cues[n:] > cues[:-n])).tolist():
                v = self.unit(Counter(words[a : a + n]))
                cos = sum(x * self.vectors[i].get(w, 0.0) for w, x in v.items())
                if cos >= NEAR and not FOREIGN.get(k, set()) & set(words[max(0, a - 3) : a + n + 3]):
                    out.append((k, cos, a, a + n))
        taken = np.zeros(len(words), bool)
        for x in sorted(out, key=lambda x: (-round(x[1], 9), x[2] - x[3], x[0], x[2])):
            if not taken[x[2] : x[3]].any():
                taken[x[2] : x[3]] = True
                kept.append(x)
        return kept

    def paragraph(self, lines: list[str]) -> tuple[list[tuple[str, float]], float]:
        """Names and cosines found in joined lines, and the number of their words that stand in notices."""
        found, words, of, noticed = [], [], [], np.zeros(len(lines))
        for i, line in enumerate(lines):
            spdx, tag = SPDX.search(line), TAG.search(line)
            ids = ID.findall(spdx[1]) if spdx else [tag[1].rstrip(".")] if tag else []
            known = [(IDS[x.lower()], 1.0) for x in ids if x.lower() in IDS]
            own = WORD.findall(line.lower())
            if not spdx and not known:
                words += own
                of += [i] * len(own)
                known = self.whole(own) if CUE.search(line) else []
            found += known
            noticed[i] = bool(known)
        if HINT.search(" ".join(words)):
            if len(lines) > 1 and CUE.search(" ".join(words)) and (joined := self.whole(words)):
                found += joined
                noticed[sorted(set(of))] = 1
            size, part = Counter(of), Counter()
            for k, cos, a, b in self.stretches(words):
                found.append((k, cos))
                part.update(of[a:b])
            for i, n in part.items():
                noticed[i] = max(noticed[i], n / size[i])
        return found, float(sum(n * len(x.split()) for n, x in zip(noticed, lines, strict=True)))

    def opening(self, text: str) -> tuple[str, float] | None:
        """The licence whose full text begins as this one does, but for ADDRESS words, and the cosine of both beginnings."""
        words, found = WORD.findall(text[: 40 * max(map(len, self.openings.values()))].lower()), []
        for k, own in self.openings.items():
            here = Counter(words[: len(own) + ADDRESS])
            v, w = ({x: n * self.opening_idf.get(x, 1.0) for x, n in c.items()} for c in (here, Counter(own)))
            norm = math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values())) or 1.0
            cos = sum(x * w.get(t, 0.0) for t, x in v.items()) / norm
            if cos >= OPENING and words[: 2 * len(own)].count(own[0]):
                found.append((k, cos))
        return min(found, key=lambda x: (-round(x[1], 9), x[0])) if found else None

    def best(self, text: str | None) -> tuple[str | None, float, float]:
        """(licence, cosine, share of the text's words that stand in notices)"""
        if not HINT.search(text or ""):
            return None, 0.0, 0.0
        if whole := self.opening(text):
            return *whole, 1.0
        found, noticed, words, lines = [], 0.0, 0, []
        for line in [*re.split(r"[\r\n]", text), ""]:
            words += len(line.split())
            if re.search(r"\w", line):
                lines.append(line)
            elif lines:
                if any(HINT.search(x) for x in lines):
                    here, n = self.paragraph(lines)
                    found += here
                    noticed += n
                lines = []
        if not found:
            return None, 0.0, 0.0
        name, cos = min(found, key=lambda x: (x[0] == RESERVED, -round(x[1], 9), x[0]))
        return name, cos, noticed / words


def scan(docs: DataFrame) -> DataFrame:
    """docs: doc_id, path, text. Returns doc_id, path, license, cosine, share; no shuffle."""

    @F.pandas_udf("license string, cosine double, share double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = Templates()
        for b in batches:
            yield pd.DataFrame([t.best(x) for x in b], columns=["license", "cosine", "share"])

    return docs.select("doc_id", "path", run("text").alias("s")).select("doc_id", "path", "s.*")


def inherit(found: DataFrame) -> DataFrame:
    """Adds directory and inherited; joins meet distinct directories, not documents."""
    f = cut(found.withColumn("directory", F.regexp_replace("path", "/[^/]*$", "")))
    files = f.where("license is not null and share >= 0.5").groupBy("directory").agg(F.array_join(F.sort_array(F.collect_set("license")), " | ").alias("inherits"))  # as many as there are licences
    files = files.select(F.col("directory").alias("above"), "inherits")
    parts = F.split("directory", "/")
    up = F.explode(F.sequence(F.lit(1), F.size(parts)))
    dirs = f.select("directory").distinct().select("directory", up.alias("depth")).withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = dirs.join(files, "above").withColumn("k", F.row_number().over(Window.partitionBy("directory").orderBy(F.desc("depth")))).where("k = 1")
    return f.join(nearest.select("directory", "inherits", F.col("above").alias("inherited_from")), "directory", "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is source/lang/doc_id."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"))
    out = inherit(scan(docs))
    return out.select("doc_id", "path", F.coalesce("license", "inherits").alias("license"), F.when(F.col("license").isNotNull(), "own").when(F.col("inherits").isNotNull(), "inherited").otherwise("none").alias("basis"), F.round("cosine", 6).alias("cosine"), F.when(F.col("license").isNull(), F.col("inherited_from")).alias("inherited_from"))
