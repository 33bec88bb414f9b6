"""Licence detection by sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

All of it is DataFrame expressions. Each sentence of a file, and the whole text of a licence file, is a passage that is
compared with each template, a notice or the text of a licence; document frequencies of all words are counted over the
whole corpus. A passage is only scored if it has one of the terms without which no template could be near enough: by
Cauchy-Schwarz, the other terms alone stay under the threshold, whatever the passage's other words weigh. Equal passages
are scored once: their words, counted, are joined with the frequencies for the norm and with the templates for the dots.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import LOWER, UPPER, ascii_lower, named, read, stored

#: (licence, notice). The usual one-sentence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright (CC0 1.0)"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved"),
)
MIN_COSINE = 0.6
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"
BREAK = "([.;])[ \t\r\f]+"
TOKEN = "[a-z0-9]+"


def tokens(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


#: (licence, text) of whole licence files. The texts as the licences give them, less their copyright line.
FILES = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
)
ALL_TEMPLATES = (*TEMPLATES, *FILES)
VOCABULARY = sorted({t for _, notice in ALL_TEMPLATES for t in tokens(notice)})


def document_frequencies(files: DataFrame) -> DataFrame:
    """term and n, the documents that have it, of every word of the corpus; added up within each task first."""
    words = F.array_distinct(F.split(ascii_lower(F.col("text")), "[^a-z0-9]+"))
    return files.select(F.explode(words).alias("term")).filter("term <> ''").groupBy("term").agg(F.count("*").alias("n"))


def weights(n: int, frequency: dict[str, int]) -> dict[str, float]:
    """idf of each template term."""
    return {t: math.log((1 + n) / (1 + frequency.get(t, 0))) + 1 for t in VOCABULARY}


def vectors(idf: dict[str, float], min_cosine: float) -> tuple[str, list[tuple[int, str, str, float]]]:
    """The terms of which a passage needs one, as a pattern; and (template, licence, term, weight) of unit vectors."""
    needed: set[str] = set()
    made = []
    for i, (name, notice) in enumerate(ALL_TEMPLATES):
        words = tokens(notice)
        w = {t: words.count(t) * idf[t] for t in set(words)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rest = 0.0
        for t in sorted(w, key=lambda t: (w[t], t)):  # the lightest may be all that is shared
            rest += w[t] ** 2
            if rest >= (0.999 * min_cosine * norm) ** 2:
                needed.add(t)
        made += [(i, name, t, w[t] * idf[t] / norm) for t in sorted(w)]
    return "(^|[^a-z0-9])(" + "|".join(sorted(needed)) + ")($|[^a-z0-9])", made


def licence_file(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, "[^/]*$", 0).rlike(LICENCE_FILE), F.lit(False))


def best_licenses(files: DataFrame, min_cosine: float) -> DataFrame:
    """row, path, own_license and own_score of every file; one scan counts words, one finds the passages to score.

    Passages are the sentences, and of a licence file the whole text too. Equal ones are scored once, and so are files
    with the same ones; a passage's words are grouped, never compared with each other.
    """
    n, counts = files.count(), stored(document_frequencies(files))
    idf = weights(n, {r["term"]: r["n"] for r in counts.filter(F.col("term").isin(VOCABULARY)).collect()})
    needs, made = vectors(idf, min_cosine)
    spark = files.sparkSession
    templates = F.broadcast(spark.createDataFrame(made, "template int, license string, term string, weight double"))  # the terms of ALL_TEMPLATES
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    text = ascii_lower(F.col("text"))
    near = F.filter(F.split(F.regexp_replace(text, BREAK, "$1\n"), "\n"), lambda s: s.rlike(needs))
    near = F.when(licence_file(F.col("path")) & (F.size(near) > 0), F.concat(near, F.array(text))).otherwise(near)
    found = stored(files.select("row", "path", F.array_distinct(near).alias("near")))
    some = found.filter(F.size("near") > 0).withColumn("set", F.unhex(F.sha2(F.array_join("near", "\n"), 256)))
    passages = some.select("set", F.explode("near").alias("passage")).withColumn("sid", F.unhex(F.sha2("passage", 256)))

    def terms(of: DataFrame) -> DataFrame:
        """sid, term and tf of the distinct passages: grouped by passage before and after, so that only passages move."""
        return of.groupBy("sid").agg(F.first("passage").alias("passage")).select("sid", F.explode(F.split("passage", "[^a-z0-9]+")).alias("term")).filter("term <> ''")

    # The templates' words alone bound the cosine from above: a passage's norm is theirs at least.
    words = terms(passages).join(known, "term").groupBy("sid", "term", "idf").agg(F.count("*").alias("tf"))
    bounds = words.groupBy("sid").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2.0)))).alias("bound"))
    dots = words.join(templates, "term").groupBy("sid", "template", "license").agg(F.sum(F.col("tf") * F.col("weight")).alias("dot"))
    dots = stored(dots.join(bounds, "sid").filter(F.col("dot") >= 0.999 * min_cosine * F.col("bound")).select("sid", "license", "dot"))
    weight = F.log((1 + F.lit(n)) / (1 + F.col("n"))) + 1
    all_words = terms(passages.join(dots.select("sid").distinct(), "sid", "left_semi")).groupBy("sid", "term").agg(F.count("*").alias("tf"))
    norms = all_words.join(counts, "term").groupBy("sid").agg(F.sqrt(F.sum(F.pow(F.col("tf") * weight, F.lit(2.0)))).alias("norm"))
    scored = dots.join(norms, "sid").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= min_cosine)
    scored = stored(scored.groupBy("sid").agg(F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("best")))
    of_set = passages.select("set", "sid").distinct().join(scored, "sid").groupBy("set").agg(F.min("best").alias("best"))
    none = found.filter("near IS NULL OR size(near) = 0").select("row", "path", F.lit(None).cast("string").alias("own_license"), F.lit(None).cast("double").alias("own_score"))
    return some.join(of_set, "set", "left").select("row", "path", F.col("best.license").alias("own_license"), (-F.col("best.score")).alias("own_score")).unionByName(none)


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = (), min_cosine: float = MIN_COSINE) -> DataFrame:
    """keep, path_col, own_license, own_score, license and inherited_from of every row.

    own_license is that of the best passage, if its cosine is min_cosine or more (equal ones: the first in text
    order); own_score is its cosine. A passage is a sentence, or the whole text of a file whose name is that of a licence
    file. A file without a licence takes that of the licence file in the nearest directory upwards, its own included (of
    several the one with the least path); inherited_from is that directory. The top directory is the empty text. Null or
    empty texts have no licence of their own, rows with a null path inherit none, and repeated rows each get their row.
    Other columns, whatever their names, are neither read nor returned.
    """
    rows = files.select(F.struct(F.lit(0).alias(" "), *(named(c) for c in keep)).alias("row"), named(path_col).alias("path"), named(text_col).alias("text"))
    rows = stored(best_licenses(rows, min_cosine).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")))
    licences = rows.filter(licence_file(F.col("path")) & F.col("own_license").isNotNull())
    given = licences.groupBy(F.col("dir").alias("from")).agg(F.min(F.struct("path", "own_license")).alias("first")).select("from", F.col("first.own_license").alias("given"))
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.when(F.col("dir") != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>")))
    directories = rows.filter("dir IS NOT NULL").select("dir").distinct()
    nearest = directories.select("dir", F.posexplode(above).alias("depth", "from")).join(given, "from").groupBy("dir").agg(F.max(F.struct("depth", "from", "given")).alias("near"))
    out = rows.join(nearest, "dir", "left")
    own = F.col("own_license").isNotNull()
    return out.select(*(F.col("row").getField(c).alias(c) for c in keep), F.col("path").alias(path_col), "own_license", "own_score", F.coalesce("own_license", "near.given").alias("license"), F.when(~own, F.col("near.from")).alias("inherited_from"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no paths: sources are laid out as trees, with every tenth document as a directory's licence file."""
    i = F.col("doc_id")
    top, middle, low = F.col("source"), F.concat(F.lit("b"), F.expr("doc_id div 1000")), F.concat(F.lit("c"), F.expr("doc_id div 100"))
    licence = F.concat(F.lit("LICENSE."), i)
    path = F.when(i % 1000 == 0, F.concat_ws("/", top, licence)).when(i % 100 == 0, F.concat_ws("/", top, middle, licence)).when(i % 10 == 0, F.concat_ws("/", top, middle, low, licence)).otherwise(F.concat_ws("/", top, middle, low, F.concat(i, F.lit(".txt"))))
    return scan_licenses(read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"), keep=("doc_id",))


_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_TEMPLATES = ", ".join(f"({i}, '{name}', '{notice}')" for i, (name, notice) in enumerate(ALL_TEMPLATES))
ORACLE_SQL = f"""
WITH f AS (
  SELECT doc_id, {_LOWER} AS t, CASE
    WHEN doc_id % 1000 = 0 THEN source || '/LICENSE.' || doc_id
    WHEN doc_id % 100 = 0 THEN source || '/b' || doc_id // 1000 || '/LICENSE.' || doc_id
    WHEN doc_id % 10 = 0 THEN source || '/b' || doc_id // 1000 || '/c' || doc_id // 100 || '/LICENSE.' || doc_id
    ELSE source || '/b' || doc_id // 1000 || '/c' || doc_id // 100 || '/' || doc_id || '.txt' END AS path
  FROM documents),
tt AS (SELECT i, name, term, count(*) AS tf FROM (SELECT i, name, unnest(regexp_extract_all(lower(x), '{TOKEN}')) AS term FROM (VALUES {_TEMPLATES}) v(i, name, x)) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(t, '{TOKEN}'))) AS term FROM f) GROUP BY term),
n AS (SELECT count(*) AS n FROM f),
idf AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT term FROM tt UNION SELECT term FROM df) LEFT JOIN df USING (term), n),
tn AS (SELECT i, sqrt(sum((tf * idf) ** 2)) AS norm FROM tt JOIN idf USING (term) GROUP BY i),
s AS (SELECT doc_id, unnest(range(1, len(u) + 1)) AS k, unnest(u) AS u FROM (SELECT doc_id, string_split(regexp_replace(t, '([.;])[ \\t\\r\\f]+', '\\1' || chr(10), 'g'), chr(10)) AS u FROM f)
  UNION ALL SELECT doc_id, 0, t FROM f WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$')),
w AS (SELECT doc_id, k, term, count(*) AS tf FROM (SELECT doc_id, k, unnest(regexp_extract_all(u, '{TOKEN}')) AS term FROM s) GROUP BY ALL),
sn AS (SELECT doc_id, k, sqrt(sum((tf * idf) ** 2)) AS norm FROM w JOIN idf USING (term) GROUP BY doc_id, k),
c AS (
  SELECT w.doc_id, w.k, tt.i, tt.name, round(sum(w.tf * tt.tf * idf ** 2) / (any_value(sn.norm) * any_value(tn.norm)), 6) AS score
  FROM w JOIN tt USING (term) JOIN idf USING (term) JOIN sn ON sn.doc_id = w.doc_id AND sn.k = w.k JOIN tn ON tn.i = tt.i GROUP BY w.doc_id, w.k, tt.i, tt.name),
o AS (SELECT doc_id, first(name ORDER BY score DESC, name) AS own_license, max(score) AS own_score FROM c WHERE score >= {MIN_COSINE} GROUP BY doc_id),
r AS (SELECT f.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, own_license, own_score FROM f LEFT JOIN o USING (doc_id)),
g AS (SELECT dir AS from_dir, min_by(own_license, path) AS given FROM r WHERE own_license IS NOT NULL AND regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$') GROUP BY dir),
a AS (SELECT r.dir, max_by(given, length(from_dir)) AS given, max_by(from_dir, length(from_dir)) AS from_dir FROM (SELECT DISTINCT dir FROM r) r JOIN g ON from_dir = '' OR r.dir = from_dir OR starts_with(r.dir, from_dir || '/') GROUP BY r.dir)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, given) AS license, CASE WHEN own_license IS NULL THEN from_dir END AS inherited_from
FROM r LEFT JOIN a USING (dir)
"""
