"""License scan: TF-IDF cosine of statements to templates, then inheritance.

Every sentence or line of a file is a sparse vector of its distinct words
weighted by inverse document frequency, compared by cosine with the templates
below.  So are its lines, its unwrapped sentences, its paragraphs and, in a
licence file, the whole text with the longer ``TEXTS``: titles, SPDX lines,
standard headers and the bodies of licence files, which also have tokens that
tell licenses and versions apart.  A file that declares nothing takes the license of the nearest ancestor
directory that has a licence file, found by joining directories with the
licence files of their ancestors.  Only SQL functions are used.

Scale.  Document frequencies are counted over all texts, for the templates'
words alone, so what reaches the driver is bounded by the templates.  A text
of ``TEXTS`` is compared only where its telling words stand.  By the
Cauchy-Schwarz inequality a sentence that reaches the threshold must hold one
of a template's heaviest words; texts without any such word are passed over
without loss.  Inheritance works on distinct directories, not on files.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if_small, stash

# fixed statements by license id
TEMPLATES = [
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd-2-clause", "Released under the BSD 2-Clause License."),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "Released under CC0 1.0 Universal, public domain dedication."),
    ("gpl-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mpl-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("proprietary", "All rights reserved."),
]
THRESHOLD = 0.75


@dataclass(frozen=True)
class Text:
    """Longer text of a license.  ``must`` and ``never`` are words that the
    compared unit has to hold or to lack, ``file_must`` and ``file_never`` the
    same of the whole file; the first of ``must`` is looked for in the file."""

    license: str
    text: str
    must: tuple[str, ...]
    never: tuple[str, ...] = ()
    file_must: tuple[str, ...] = ()
    file_never: tuple[str, ...] = ()


def _gnu(license: str, kind: str, version: str, dated: str, never: tuple[str, ...]) -> list[Text]:
    name = f"GNU {kind}General Public License"
    must = ("license", "general", "public", version, *kind.lower().split())
    short = license.split("-")[0]
    terms = f"under the terms of the {name} as published by the Free Software Foundation"
    out = [f"{name} Version {version}, {dated}", f"{name} Version {version}", f"{name} v{version}.0"]
    for noun in ("program", "work", "library", "file", "software", "project"):
        out += [f"This {noun} is licensed under the {name}, version {version}.",
                f"This {noun} is free software: you can redistribute it and/or modify it {terms}, "
                f"either version {version} of the License, or (at your option) any later version.",
                f"This {noun} is free software; you can redistribute it and/or modify it {terms}, version {version} of the License."]
    texts = [Text(license, t, must, never) for t in out if f"v{version}" not in t]
    texts.append(Text(license, out[2], tuple(w if w != version else f"v{version}" for w in must), never))
    texts += [Text(license, f"SPDX-License-Identifier: {short.upper()}-{version}.0{end}", ("spdx", short, version)) for end in ("", "-only", "-or-later")]
    if version == "3" and short != "lgpl":
        texts.append(Text(license, f"The {name} is a free, copyleft license for software and other kinds of works"
                          + (", specifically designed to ensure cooperation with the community in the case of network server software." if kind else "."),
                          ("copyleft", "kinds", *kind.lower().split()), never))
    return texts


def _creative(license: str, short: str, long: str, never: tuple[str, ...]) -> list[Text]:
    must = tuple(re.findall("[a-z]+", long.lower()))
    never_long = tuple({"sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}[w] for w in never)
    return [*[Text(license, t, (*must, "creative", "4"), never_long) for t in (
                f"Creative Commons {long} 4.0 International", f"Creative Commons {long} 4.0 International Public License",
                f"Attribution 4.0 International Creative Commons Corporation {long}",
                f"This work is licensed under a Creative Commons {long} 4.0 International License.",
                f"This work is licensed under the Creative Commons {long} 4.0 International License. To view a copy of this license, "
                f"visit http://creativecommons.org/licenses/{short.lower()[3:]}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.")],
            Text(license, f"{long} 4.0 International", (*must, "international", "4"), never_long),
            Text(license, f"SPDX-License-Identifier: {short}-4.0", ("spdx", "cc", "4", *short.lower().split("-")[1:]), never)]


MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:"""
MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_BODY = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:"""
BSD_CLAUSES = """Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_TERMS = """you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under
the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""


def _bsd(license: str, number: str, file_must: tuple[str, ...], file_never: tuple[str, ...], whole: str) -> list[Text]:
    return [*[Text(license, t, ("license", "bsd", number)) for t in (
                f"BSD {number}-Clause License", f"The {number}-Clause BSD License", f"Licensed under the {number}-Clause BSD License.")],
            Text(license, f"SPDX-License-Identifier: BSD-{number}-Clause", ("spdx", "bsd", number)),
            *[Text(license, t, ("redistribution", "binary", "forms"), (), file_must, file_never) for t in (BSD_BODY, BSD_BODY + BSD_CLAUSES, whole)]]


# titles, SPDX lines, headers and licence files by license id
TEXTS = [
    *_gnu("agpl-3.0", "Affero ", "3", "19 November 2007", ("lesser",)),
    *_gnu("gpl-2.0", "", "2", "June 1991", ("lesser", "affero", "library", "3")),
    *_gnu("gpl-3.0", "", "3", "29 June 2007", ("lesser", "affero", "2")),
    *_gnu("lgpl-3.0", "Lesser ", "3", "29 June 2007", ("affero", "2")),
    *[Text("apache-2.0", t, ("apache", "2")) for t in (
        "Apache License 2.0", "Apache License, Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); ' + APACHE_TERMS,
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed "
        "with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, "
        'Version 2.0 (the "License"); ' + APACHE_TERMS, "SPDX-License-Identifier: Apache-2.0")],
    Text("apache-2.0", "Apache License", ("apache", "license"), ("1", "software")),
    *_bsd("bsd-2-clause", "2", (), ("endorse", "advertising"), BSD_BODY + BSD_CLAUSES + BSD_REST),
    *_bsd("bsd-3-clause", "3", ("endorse",), ("advertising",), BSD_BODY + BSD_CLAUSES + BSD_THIRD + BSD_REST),
    *_creative("cc-by-4.0", "CC-BY", "Attribution", ("nc", "sa", "nd")),
    *_creative("cc-by-nc-4.0", "CC-BY-NC", "Attribution NonCommercial", ("sa", "nd")),
    *_creative("cc-by-sa-4.0", "CC-BY-SA", "Attribution ShareAlike", ("nc", "nd")),
    *[Text("cc0-1.0", t, ("cc0", "1")) for t in (
        "CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
        "This work is licensed under the CC0 1.0 Universal License.", "SPDX-License-Identifier: CC0-1.0")],
    *[Text("mit", t, ("license", "mit")) for t in (
        "MIT License", "The MIT License (MIT)", "Licensed under the MIT License.", "This project is licensed under the MIT License.")],
    Text("mit", "SPDX-License-Identifier: MIT", ("spdx", "mit")),
    *[Text("mit", t, ("permission", "granted", "sublicense", "subject")) for t in (MIT_BODY, MIT_BODY + " " + MIT_REST, "MIT License " + MIT_BODY + " " + MIT_REST)],
    *[Text("mpl-2.0", t, ("mozilla", "public", "license", "2")) for t in (
        "Mozilla Public License Version 2.0", "Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.")],
    Text("mpl-2.0", "SPDX-License-Identifier: MPL-2.0", ("spdx", "mpl", "2")),
    Text("proprietary", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
         ("confidential", "unauthorized", "copying", "prohibited")),
    Text("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited.", ("unauthorized", "copying", "prohibited")),
]
LICENSE_FILE = "(?i)^(licen[cs]e|copying|notice)([^a-z].*)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9]+", text.lower())))


def distinct_words(text: Column) -> Column:
    """Distinct words of ASCII letters and digits, A-Z lowered."""
    return F.filter(F.array_distinct(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+")), lambda w: w != "")


def statements(text: Column) -> Column:
    """Lines, split again behind sentence ends."""
    return F.split(F.regexp_replace(text, "([.!?])[ \t\r]+", "$1\n"), "\n")


def paragraphs(text: Column) -> Column:
    """Blocks between lines without letters and digits, each as one line."""
    blocks = F.split(text, "\n(?:[^A-Za-z0-9\n]*\n)+")
    return F.transform(blocks, lambda b: F.regexp_replace(b, "[ \t\r]*\n[^A-Za-z0-9\n]*", " "))


def inverse_frequencies(files: DataFrame, text_col: str) -> tuple[dict[str, float], dict[str, float], float]:
    """(idf of every word of the templates, the same of ``TEXTS``, idf of a
    word in no document), over all texts."""
    short, long = ({w for t in ts for w in template_words(t)} for ts in ([t for _, t in TEMPLATES], [t.text for t in TEXTS]))
    text = F.coalesce(files[text_col], F.lit(""))
    found = files.select(F.explode_outer(F.array_intersect(distinct_words(text), F.lit(sorted(short | long)))).alias("w"))
    df = {r.w: r["count"] for r in found.where("w is not null").groupBy("w").count().collect()}  # template words
    n = files.count()
    idf = lambda k: math.log((n + 1) / (k + 1)) + 1
    return {w: idf(df.get(w, 0)) for w in short}, {w: idf(df.get(w, 0)) for w in long}, idf(0)


def anchors(idf: dict[str, float], threshold: float) -> list[str]:
    """Words of which every sentence that reaches ``threshold`` holds one: a
    template's heaviest, until the rest weighs less than threshold**2 of it."""
    out = set()
    for _, text in TEMPLATES:
        words = sorted(template_words(text), key=lambda w: (-idf[w], w))
        total = sum(idf[w] ** 2 for w in words)
        rest = total
        for w in words:
            if rest < threshold ** 2 * total * (1 - 1e-9):
                break
            out.add(w)
            rest -= idf[w] ** 2
    return sorted(out)


def best_template(words: Column, idf: dict[str, float], unseen: float) -> Column:
    """Struct (score, license) of the most similar template; ties go to the
    template that comes first."""
    weights = F.create_map(*[x for w, v in sorted(idf.items()) for x in (F.lit(w), F.lit(v * v))])
    sums = lambda a: F.aggregate(a, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(weights, w), F.lit(unseen * unseen)))
    scored = []
    for rank, (name, text) in enumerate(TEMPLATES):
        own = template_words(text)
        norm = math.sqrt(sum(idf[w] ** 2 for w in own))
        dot = sums(F.array_intersect(words, F.array(*map(F.lit, own))))
        scored.append(F.struct(F.round(dot / (F.sqrt(sums(words)) * norm), 9).alias("score"), F.lit(-rank).alias("order"), F.lit(name).alias("license")))
    return F.array_max(F.array(*scored))


def bind(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def best_text(text: Column, whole: Column, idf: dict[str, float], unseen: float) -> Column:
    """Struct (score, order, license) of the most similar of ``TEXTS`` over the
    lines, sentences and paragraphs of a file, and the whole file where
    ``whole``; null without any whose words are all there."""
    weights = F.expr("map(" + ", ".join(f"'{w}', {v * v!r}D" for w, v in sorted(idf.items())) + ")")
    sums = lambda a: F.aggregate(a, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(weights, w), F.lit(unseen * unseen)))
    strings = lambda ws: f"cast(array({', '.join(map(repr, ws))}) AS array<string>)"
    known = F.expr("array(" + ", ".join(
        f"named_struct('order', {-len(TEMPLATES) - i}, 'license', '{t.license}', 'own', {strings(template_words(t.text))}, "
        f"'norm', {math.sqrt(sum(idf[w] ** 2 for w in template_words(t.text)))!r}D, 'must', {strings(t.must)}, 'never', {strings(t.never)}, "
        f"'file_must', {strings(t.file_must)}, 'file_never', {strings(t.file_never)})" for i, t in enumerate(TEXTS)) + ")")
    fits = lambda has, must, never: (F.size(F.array_except(must, has)) == 0) & ~F.arrays_overlap(never, has)

    def of_unit(words: Column, here: Column) -> Column:
        able = F.filter(here, lambda t: fits(words, t["must"], t["never"]))
        return bind(F.struct(able.alias("able"), F.when(F.size(able) > 0, F.sqrt(sums(words))).alias("norm")), lambda u: F.array_max(F.transform(
            u["able"], lambda t: F.struct(F.round(sums(F.array_intersect(words, t["own"])) / (u["norm"] * t["norm"]), 9).alias("score"),
                                          t["order"].alias("order"), t["license"].alias("license")))))

    blocks = paragraphs(text)
    units = F.array_distinct(F.concat(statements(text), blocks, F.flatten(F.transform(blocks, statements)),
                                      F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))))
    signs = F.lit(_sign(sorted({t.must[0] for t in TEXTS})))
    units = F.filter(units, lambda u: F.rlike(u, signs))
    here = bind(distinct_words(text), lambda has: F.filter(known, lambda t: fits(has, F.concat(t["must"], t["file_must"]), t["file_never"])))
    return bind(here, lambda h: F.when(F.size(h) > 0, F.array_max(F.transform(units, lambda u: bind(distinct_words(u), lambda w: of_unit(w, h))))))


def _sign(words: list[str]) -> str:
    return "(?i)(?<![a-z0-9])(" + "|".join(words) + ")(?![a-z0-9])"


def declared_licenses(files: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", whole: Column | None = None) -> DataFrame:
    """``files`` plus ``declared``: struct (score, order, license) of the best
    statement of the text, null below ``threshold`` (ties: the template that
    comes first).  One of ``TEXTS`` comes before a statement with a lower
    score, before that of another version of its license, whose telling words
    a statement does not ask for, and before bare reserved rights.  ``whole``
    says which files are compared as a whole, too."""
    idf, long_idf, unseen = inverse_frequencies(files, text_col)
    sign = _sign(anchors(idf, threshold))
    lines = F.filter(statements(F.col(text_col)), lambda s: F.rlike(s, F.lit(sign)))
    best = F.array_max(F.transform(lines, lambda s: F.transform(F.array(distinct_words(s)), lambda w: best_template(w, idf, unseen))[0]))
    best = F.transform(F.array(best), lambda b: F.when(b["score"] >= threshold, b))[0]
    text = best_text(F.col(text_col), F.lit(False) if whole is None else whole, long_idf, unseen)
    text = bind(text, lambda b: F.when(b["score"] >= threshold, b))
    files = files.withColumn("declared", F.when(F.rlike(F.col(text_col), F.lit(sign)), best))
    files = files.withColumn("__text", F.when(F.rlike(F.col(text_col), F.lit(_sign(sorted({t.must[0] for t in TEXTS})))), text))
    ours, other = F.col("__text"), F.col("declared")
    family = lambda c: F.substring_index(c["license"], "-", 1)
    first = other.isNull() | (ours["score"] > other["score"]) | (ours["license"] != other["license"]) & (
        (family(ours) == family(other)) | (other["license"] == "proprietary"))
    return files.withColumn("declared", F.when(ours.isNotNull() & first, ours).otherwise(other)).drop("__text")


def scan_licenses(files: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", path_col: str = "path",
                  text_col: str = "text") -> DataFrame:
    """(id, path, license, how, score, licence_file), one row per input row.

    ``how`` is ``declared``, ``inherited`` (from ``licence_file``) or ``none``.
    A licence file is one named so by ``LICENSE_FILE`` that declares a license;
    of several in a directory the highest score counts, then the smallest path.
    A null or empty text declares nothing, a null path has no ancestors,
    repeated rows are judged alike, an empty table gives no rows, and other
    columns are not read.
    """
    rows = files.select(files[id_col].alias("id"), files[path_col].alias("path"), files[text_col].alias("text"))
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    names_license = F.coalesce(F.rlike(F.try_element_at(parts, F.lit(-1)), F.lit(LICENSE_FILE)), F.lit(False))
    scanned = declared_licenses(rows, threshold, whole=names_license).select(
        "id", "path", "declared", F.when(F.col("path").isNotNull(), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")).alias("dir"),
        names_license.alias("names_license"))
    scanned = stash(scanned, "license-rows")
    found = scanned.where("names_license and declared is not null and dir is not null").groupBy("dir").agg(
        F.max_by(F.struct(F.col("declared.license").alias("license"), "path"), F.col("declared.score")).alias("x"),
        F.max("declared.score").alias("score"))
    # ties in score: the smallest path
    tied = scanned.where("names_license and declared is not null").join(
        broadcast_if_small(found.select(F.col("dir").alias("__dir"), F.col("score").alias("__score"))),
        (F.col("dir") == F.col("__dir")) & (F.col("declared.score") == F.col("__score")))
    owners = stash(tied.groupBy("dir").agg(F.min(F.struct("path", F.col("declared.license").alias("license"))).alias("own")), "license-owners")
    # every directory with a file that declares nothing, joined with its ancestors
    steps = F.filter(F.split("dir", "/"), lambda p: p != "")
    dirs = scanned.where("declared is null and dir is not null").select("dir").distinct()
    ups = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")).withColumn(
        "up", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    nearest = ups.join(broadcast_if_small(owners.select(F.col("dir").alias("up"), "own")), "up").groupBy("dir").agg(
        F.max_by("own", "depth").alias("own"))
    nearest = stash(nearest, "license-nearest")
    out = scanned.join(broadcast_if_small(nearest), "dir", "left")
    declared = F.col("declared").isNotNull()
    return out.select("id", "path", F.when(declared, F.col("declared.license")).otherwise(F.col("own.license")).alias("license"),
                      F.when(declared, "declared").when(F.col("own").isNotNull(), "inherited").otherwise("none").alias("how"),
                      F.when(declared, F.col("declared.score")).alias("score"), F.when(~declared, F.col("own.path")).alias("licence_file"))


# --- the same in DuckDB ------------------------------------------------------

def oracle_sql(files: str, threshold: float = THRESHOLD) -> str:
    """The scan over a SQL expression ``files`` with doc_id, path and text."""
    templates = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
    toks = lambda c: f"list_filter(list_distinct(string_split_regex(translate({c}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+')), lambda x: x <> '')"
    return f"""
WITH files AS (SELECT row_number() OVER () AS rid, * FROM ({files})),
 templates(ord, license, body) AS (VALUES {templates}),
 tw AS (SELECT ord, license, unnest({toks('body')}) AS w FROM templates),
 dw AS (SELECT rid, unnest({toks('text')}) AS w FROM files),
 idf AS (SELECT v.w, ln(((SELECT count(*) FROM files) + 1) / (count(dw.rid) + 1)) + 1 AS i
         FROM (SELECT DISTINCT w FROM tw) v LEFT JOIN dw ON dw.w = v.w GROUP BY v.w),
 unseen AS (SELECT ln((count(*) + 1) / 1) + 1 AS i FROM files),
 tn AS (SELECT ord, any_value(license) AS license, sqrt(sum(i * i)) AS n FROM tw JOIN idf USING (w) GROUP BY ord),
 lines AS (SELECT rid, unnest(string_split(regexp_replace(text, '([.!?])[ \t\r]+', '\\1' || chr(10), 'g'), chr(10))) AS s FROM files),
 uniq AS (SELECT DISTINCT rid, s FROM lines),
 lw AS (SELECT rid, s, unnest({toks('s')}) AS w FROM uniq),
 ln_ AS (SELECT rid, s, sqrt(sum(coalesce(idf.i, (SELECT i FROM unseen)) * coalesce(idf.i, (SELECT i FROM unseen)))) AS n
         FROM lw LEFT JOIN idf USING (w) GROUP BY rid, s),
 dots AS (SELECT rid, s, ord, sum(i * i) AS d FROM lw JOIN tw USING (w) JOIN idf USING (w) GROUP BY rid, s, ord),
 scored AS (SELECT dots.rid, dots.ord, tn.license, round(d / (ln_.n * tn.n), 9) AS score
            FROM dots JOIN ln_ USING (rid, s) JOIN tn USING (ord)),
 best AS (SELECT rid, license, score FROM scored WHERE score >= {threshold}
          QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, ord) = 1),
 named AS (SELECT f.rid, f.doc_id, f.path, best.license, best.score,
           list_filter(string_split(f.path, '/'), lambda x: x <> '') AS parts FROM files f LEFT JOIN best USING (rid)),
 placed AS (SELECT *, array_to_string(parts[1:len(parts) - 1], '/') AS dir,
            regexp_matches(parts[len(parts)], '{LICENSE_FILE}') AS own FROM named),
 owners AS (SELECT dir, license, path FROM placed WHERE own AND license IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
 near AS (SELECT p.rid, o.license, o.path FROM placed p JOIN owners o
          ON p.dir = o.dir OR o.dir = '' OR starts_with(p.dir, o.dir || '/')
          WHERE p.license IS NULL QUALIFY row_number() OVER (PARTITION BY p.rid ORDER BY length(o.dir) DESC) = 1)
SELECT p.doc_id, p.path, coalesce(p.license, near.license) AS license,
       CASE WHEN p.license IS NOT NULL THEN 'declared' WHEN near.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       p.score, near.path AS licence_file
FROM placed p LEFT JOIN near USING (rid)
"""
