"""License scan: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Comment marks are taken off the lines of a text that speaks of licences, and
its paragraphs are put together again. Candidates are lines, runs of up to four
sentences across line breaks, runs of up to six paragraphs that start with one
that speaks of licences, and the whole text, if half of their words are words of
the templates; equal ones are scored once. Their
sparse TF-IDF vectors (document frequencies over all candidates and the
templates) meet those of the templates in a join on the token. Templates are
whole headers, whole short licences and the titles of long ones, and a
candidate must name the licence's version or clause to be taken for it.

A document without a licence of its own takes that of the licence file in the
nearest directory above it: directories, not documents, are spread over their
ancestors and joined. All of it is DataFrame functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.llm.common import staged

# The public wording of licence headers, short licences and titles, in lower and upper case as published.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_NAME = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free
Software Foundation, either version {1} of the License, or (at your option) any later version."""
_GNU_END = """ This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with
this program. If not, see <https://www.gnu.org/licenses/>."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
#: (licence, GNU name, version, title's date)
_GNU_LICENSES = (
    ("GPL-2.0", "General Public License", "2", "Version 2, June 1991"), ("GPL-3.0", "General Public License", "3", "Version 3, 29 June 2007"),
    ("LGPL-2.1", "Lesser General Public License", "2.1", "Version 2.1, February 1999"),
    ("LGPL-3.0", "Lesser General Public License", "3", "Version 3, 29 June 2007"),
    ("AGPL-3.0", "Affero General Public License", "3", "Version 3, 19 November 2007"))


def _gnu():
    for name, title, version, dated in _GNU_LICENSES:
        yield name, f"This work is licensed under the GNU {title}, version {version}."
        yield name, f"Licensed under the GNU {title} version {version}."
        yield name, _GNU.format(title, version)
        yield name, _GNU.format(title, version) + _GNU_END.format(title)
        yield name, f"GNU {title.upper()} {dated}"


#: (licence, template text)
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", _APACHE), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", _MIT), ("MIT", "The MIT License (MIT)"),
    *_gnu(),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-3-Clause", _BSD + _BSD_NAME + _BSD_END), ("BSD-3-Clause", _BSD + _BSD_NAME),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."), ("MPL-2.0", _MPL), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("ISC", "Released under the ISC License."), ("ISC", _ISC), ("Unlicense", _UNLICENSE),
)
#: Tokens of which a candidate must hold one from each group to be taken for a licence.
MUST = {
    "GPL-2.0": (("2", "2.0", "v2"),), "GPL-3.0": (("3", "3.0", "v3"),), "LGPL-2.1": (("2.1", "v2.1"), ("lesser", "library")),
    "LGPL-3.0": (("3", "3.0", "v3"), ("lesser",)), "AGPL-3.0": (("3", "3.0", "v3"), ("affero",)), "Apache-2.0": (("2.0", "2", "license-2.0"), ("apache",)),
    "MPL-2.0": (("2.0", "2"), ("mozilla", "mpl")), "BSD-3-Clause": (("neither", "3-clause"),), "BSD-2-Clause": (("redistributions", "2-clause"),),
    "MIT": (("mit", "sublicense"),), "ISC": (("isc", "fee"),), "CC-BY-4.0": (("4.0",),), "CC-BY-SA-4.0": (("4.0",), ("by-sa", "attribution-sharealike")),
    "CC-BY-NC-4.0": (("4.0",), ("by-nc", "attribution-noncommercial")), "CC0-1.0": (("cc0",),), "Unlicense": (("unencumbered",),),
}
#: A licence with these tokens is another one.
MUST_NOT = {"GPL-2.0": ("lesser", "library", "affero"), "GPL-3.0": ("lesser", "affero"), "BSD-2-Clause": ("neither", "3-clause")}
TRIGGERS = ("licens", "licenc", "copyright", "public domain", "permission is hereby", "permission to use", "redistribution and use", "cc0", "free software")
#: The same words in any case, for texts that are not lower-cased yet.
_TRIGGER_PATTERN = "(?i)" + "|".join(TRIGGERS)
MIN_SCORE = 0.7
#: Sentences and paragraphs that a run may join.
SENTENCE_RUN, PARAGRAPH_RUN = 4, 6
FILE_NAMES = r"(?i)^(un)?(licen[sc]e|copying|notice)s?(\..*)?$"
OPENING_MARKS = r"^[ \t\r]*(?://+!?|#+|/\*+|\*+/?|--+|;+|%+|<!--|rem )?[ \t\r]*"
CLOSING_MARKS = r"[ \t\r]*(?:\*+/|-->)?[ \t\r]*$"
SENTENCES = r"[.;!?][ \t]+"
TOKENS = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: The words of all templates.
VOCABULARY = sorted({w for _, t in TEMPLATES for w in re.findall(TOKENS, t.translate(str.maketrans(_UPPER, _LOWER)))})


def _speaks(text: Column) -> Column:
    hit = F.lit(False)
    for t in TRIGGERS:
        hit = hit | F.contains(text, F.lit(t))
    return hit


def _runs(parts: str, flags: str, most: int, near: bool) -> Column:
    """Runs of 1 to ``most`` neighbours of the array column ``parts``, joined: those whose first part speaks of licences
    (``flags``) or, if ``near``, any part."""
    speaks = lambda i, k: F.coalesce(F.get(F.col(flags), i + k), F.lit(False))

    def starting(i, k):  # the run of k + 1 parts from i, or null
        met = speaks(i, 0)
        for j in range(1, k + 1 if near else 1):
            met = met | speaks(i, j)
        return F.when(met & (i + k < F.size(parts)), F.concat_ws(" ", *[F.get(F.col(parts), i + j) for j in range(k + 1)]))

    def reach(i):
        met = speaks(i, 0)
        for j in range(1, most if near else 1):
            met = met | speaks(i, j)
        return met

    starts = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), reach)
    runs = F.flatten(F.transform(starts, lambda i: F.array(*[starting(i, k) for k in range(most)])))
    return F.when(F.size(parts) > 0, F.filter(runs, lambda r: r.isNotNull()))


def candidates(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seg): the distinct candidate segments of the lower-case texts ``low``.

    At least half of a segment's words must be words of the templates: what is
    mostly other text cannot be near one.
    """
    lines = F.transform(F.split("low", "\n"), lambda x: F.regexp_replace(
        F.regexp_replace(F.regexp_replace(x, OPENING_MARKS, ""), CLOSING_MARKS, ""), r"[ \t\r]+", " "))
    # the steps are written: folded into one another, a text would be split anew for each of its parts
    paras = staged(texts.select(*keys, F.filter(F.split(F.array_join(lines, "\n"), "\n\n+"), lambda p: p != "").alias("paras")), "license-paragraphs")
    spoken = paras.select(*keys, F.explode(F.filter("paras", _speaks)).alias("p"))
    one_line = spoken.select(*keys, F.filter(F.split("p", "\n|" + SENTENCES), _speaks).alias("segs"))
    flagged = lambda df: staged(staged(df, "license-parts").select(*keys, "parts", F.transform("parts", _speaks).alias("flags")), "license-flags")
    sentences = flagged(spoken.select(*keys, F.split(F.replace("p", F.lit("\n"), F.lit(" ")), SENTENCES).alias("parts"))) \
        .select(*keys, _runs("parts", "flags", SENTENCE_RUN, True).alias("segs"))
    joined = flagged(paras.select(*keys, F.transform("paras", lambda p: F.replace(p, F.lit("\n"), F.lit(" "))).alias("parts")))
    whole = joined.select(*keys, F.concat(F.coalesce(_runs("parts", "flags", PARAGRAPH_RUN, False), F.array()), F.array(F.array_join("parts", " "))).alias("segs"))
    segs = one_line.unionByName(sentences).unionByName(whole).select(*keys, F.explode("segs").alias("seg"))
    segs = segs.select(*keys, F.trim("seg").alias("seg")).where(F.col("seg") != "") \
        .withColumn("tokens", F.regexp_extract_all("seg", F.lit(TOKENS), F.lit(0)))
    known = F.size(F.filter("tokens", lambda t: t.isin(VOCABULARY)))
    return segs.where(2 * known >= F.size("tokens")).select(*keys, "seg").distinct()


def _tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(TOKENS), F.lit(0))).alias("token")) \
        .groupBy(*keys, "token").agg(F.count("*").cast("double").alias("tf"))


def _templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(name).alias("license"), F.lit(text.translate(str.maketrans(_UPPER, _LOWER))).alias("text"))
                     for i, (name, text) in enumerate(TEMPLATES)])
    return spark.range(1).select(F.inline(rows))


def allowed(license: Column, tokens: Column) -> Column:
    """Whether a candidate with these tokens may be taken for the licence."""
    out = F.lit(True)
    for name in sorted({n for n, _ in TEMPLATES}):
        fits = F.lit(True)
        for group in MUST.get(name, ()):
            fits = fits & F.arrays_overlap(tokens, F.array(*map(F.lit, group)))
        if name in MUST_NOT:
            fits = fits & ~F.arrays_overlap(tokens, F.array(*map(F.lit, MUST_NOT[name])))
        out = F.when(license == name, fits).otherwise(out)
    return out


def segment_licenses(segments: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(seg, license, score, n_tokens) of distinct segments ``seg`` with their counts ``c``: the best licence of each, if any."""
    spark = segments.sparkSession
    tem = _templates(spark)
    words = segments.withColumn("tokens", F.regexp_extract_all(F.col("seg"), F.lit(TOKENS), F.lit(0)))
    words = staged(words.select(F.sha2("seg", 256).alias("sid"), "seg", "c", "tokens"), "license-segments")
    seg_tokens = words.select("sid", "c", F.explode("tokens").alias("token")).groupBy("sid", "c", "token").agg(F.count("*").cast("double").alias("tf"))
    tem_tokens = _tokens(tem, ["t", "license"], "text")
    df = seg_tokens.select("token", "c").unionByName(tem_tokens.select("token", F.lit(1).cast("bigint").alias("c"))) \
        .groupBy("token").agg(F.sum("c").alias("df"))
    total = segments.agg((F.coalesce(F.sum("c"), F.lit(0)) + len(TEMPLATES)).alias("n"))
    idf = df.crossJoin(F.broadcast(total)).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # one-row side
    idf = staged(idf, "license-idf")
    weigh = lambda d: d.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    tw = weigh(tem_tokens)
    tw = tw.join(tw.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "t") \
        .groupBy("token").agg(F.collect_list(F.struct("t", "license", (F.col("w") / F.col("norm")).alias("tw"))).alias("tem"))
    # one row per segment and token meets the templates that have it; sums come before the templates are told apart
    sw = staged(weigh(seg_tokens).join(F.broadcast(tw), "token", "left"), "license-weights")  # templates: fixed size
    norms = sw.groupBy("sid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = sw.select("sid", "w", F.explode("tem").alias("m")).groupBy("sid", "m.t", "m.license").agg(F.sum(F.col("w") * F.col("m.tw")).alias("dot"))
    cos = dots.join(norms, "sid").select("sid", "license", F.round(F.col("dot") / F.col("norm"), 4).alias("score")).where(F.col("score") >= min_score) \
        .groupBy("sid", "license").agg(F.max("score").alias("score"))
    fits = cos.join(words.select("sid", "seg", "tokens"), "sid").where(allowed(F.col("license"), F.col("tokens")))
    best = fits.groupBy("sid").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("b"),
                                   F.first("seg").alias("seg"), F.first(F.size("tokens")).alias("n_tokens"))
    return best.select("seg", F.col("b.l").alias("license"), (-F.col("b.s")).alias("score"), "n_tokens")


def ancestors(directory: Column) -> Column:
    """The directory and all above it, nearest first; the root is empty."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(parts, 1, n - i), "/"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", min_score: float = MIN_SCORE) -> DataFrame:
    """One row per input row: id, path, license, score, status, inherited_from.

    ``status`` is ``declared`` (a candidate of the text matches a template),
    ``inherited`` (from the licence file in the nearest directory above,
    ``inherited_from``) or ``none``. A licence file is one that declares a
    licence and is named so, or whose licence covers at least half of its words.
    Among equal scores the first licence by name wins, among licence files of
    one directory the highest score. Null texts declare nothing; a null path
    inherits nothing; repeated rows stay; an empty table gives none; other
    columns are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    same = ["id", "path", "key"]
    speaking = base.where(F.col("text").rlike(_TRIGGER_PATTERN)).withColumn("low", F.translate("text", _UPPER, _LOWER)) \
        .select("id", "path", F.sha2("text", 256).alias("key"), F.size(F.regexp_extract_all("low", F.lit(TOKENS), F.lit(0))).alias("words"), "low")
    cand = staged(candidates(staged(speaking, "license-texts"), [*same, "words"]), "license-candidates")
    best = segment_licenses(cand.groupBy("seg").agg(F.count("*").alias("c")), min_score)
    met = cand.join(best, "seg").groupBy(*same, "license").agg(F.max("score").alias("score"), F.max("n_tokens").alias("covered"), F.first("words").alias("words"))
    own = met.groupBy(*same).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"), (2 * F.col("covered") >= F.col("words")).alias("whole"))).alias("b")) \
        .select(F.col("id").alias("o_id"), F.col("path").alias("o_path"), F.col("key").alias("o_key"), F.col("b.l").alias("license"),
                (-F.col("b.s")).alias("score"), F.col("b.whole").alias("whole"))
    slim = base.select("id", "path", F.when(F.col("text").rlike(_TRIGGER_PATTERN), F.sha2("text", 256)).alias("key"))
    slim = slim.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")))
    met = (F.col("key") == F.col("o_key")) & F.col("id").eqNullSafe(F.col("o_id")) & F.col("path").eqNullSafe(F.col("o_path"))
    marked = staged(slim.join(own, met, "left").select("id", "path", "dir", "license", "score", "whole"), "license-declared")
    is_file = F.col("license").isNotNull() & (F.regexp_extract("path", r"[^/]*$", 0).rlike(FILE_NAMES) | F.col("whole"))
    files = marked.where(is_file & F.col("dir").isNotNull()).groupBy(F.array_join(F.filter(F.split("dir", "/"), lambda p: p != ""), "/").alias("at")) \
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("b")) \
        .select("at", F.col("b.l").alias("dir_license"), (-F.col("b.s")).alias("dir_score"))
    # all directories lie below the root: its file, one row at most, is attached and not joined
    root = files.where("at = ''").agg(F.max("dir_license").alias("root_license"), F.max("dir_score").alias("root_score"))
    dirs = marked.where(F.col("dir").isNotNull()).select("dir").distinct()
    above = dirs.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("up", "at")).where("at <> ''")
    nearest = above.join(files, "at").groupBy("dir").agg(F.min(F.struct("up", "at", "dir_license", "dir_score")).alias("b"))
    nearest = dirs.join(nearest, "dir", "left").crossJoin(F.broadcast(root)).select(  # one-row side
        "dir", F.when(F.col("b").isNotNull(), F.col("b.at")).when(F.col("root_license").isNotNull(), F.lit("")).alias("from"),
        F.coalesce("b.dir_license", "root_license").alias("dir_license"), F.coalesce("b.dir_score", "root_score").alias("dir_score"))
    got = marked.join(nearest, "dir", "left")
    free = F.col("license").isNull()
    return got.select(
        F.col("id").alias(id_col), "path", F.coalesce("license", "dir_license").alias("license"), F.coalesce("score", "dir_score").alias("score"),
        F.when(~free, "declared").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("status"),
        F.when(free, F.col("from")).alias("inherited_from"))
