"""License scan: TF-IDF cosine of notices to templates, then inheritance along directories.

A notice is a line with a licence marker. Its terms are weighted by term frequency and inverse
document frequency over all notices of the corpus and the templates; terms no template has count
as unseen. The best template at or over ``threshold`` is the line's licence, and the best line's
licence is the file's. Licence files also speak for their directory: a file without a licence of
its own inherits from the nearest ancestor directory that has one, found by joining directories
to the licences on their paths.

Only built-in functions are used. The vocabulary and the templates are fixed lists, so their
tables may be broadcast. Directories are joined once each, not once per file, and salted.

Defined results: null or empty texts have no notice; a null path has no directory and inherits
nothing; rows that share a path share its licence; ties go to the smaller template id, then the
smaller path; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.common import bare, staged

MARKER = "(?i)licen[cs]e|copyright|spdx|copyleft|public domain|all rights reserved"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: File names that speak for their directory.
LICENCE_FILE = "(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"

# Short notices by which well-known licences are declared.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "This software is licensed under the MIT license.",
            "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license.",
                     "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This file is subject to the terms of the Mozilla Public License, v. 2.0.",
                "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "Licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


#: Starts the keys of rows without a path; no path holds it.
NO_PATH = "\0"


@dataclass(frozen=True)
class Rule:
    threshold: float = 0.7
    salts: int = 32


def template_terms() -> list[tuple[str, str, int, int]]:
    """(licence, term, number of the template, occurrences)."""
    out, n = [], 0
    for licence, texts in TEMPLATES.items():
        for text in texts:
            words = re.findall(TERM, text.lower())
            out += [(licence, w, n, words.count(w)) for w in sorted(set(words))]
            n += 1
    return out


def notices(files: DataFrame) -> DataFrame:
    """(path, line, term, tf) of every line with a marker in files (path, text)."""
    marked = files.filter(F.col("text").rlike(MARKER)).select("path", F.filter(
        F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(
            i.alias("line"), x.alias("words"))), lambda x: x["words"].rlike(MARKER))
        .alias("lines"))
    return marked.select("path", F.inline("lines")).select(
        "path", "line", F.explode(F.regexp_extract_all(F.lower("words"), F.lit(TERM), 0))
        .alias("term")).groupBy("path", "line", "term").agg(F.count("*").alias("tf"))


def scan_notices(files: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(path, licence, cosine) of every file with a notice at or over the threshold."""
    spark = files.sparkSession
    templates = template_terms()
    terms = sorted({t[1] for t in templates})
    found = staged(notices(files), "notices")
    known = spark.createDataFrame([(t,) for t in terms], "term string")
    # One row per template term and one total: bounded by the fixed templates.
    df = {r["term"]: r["n"] for r in found.join(F.broadcast(known), "term").groupBy("term")
          .agg(F.count("*").alias("n")).collect()}
    lines = found.select("path", "line").distinct().count()
    total = lines + max(t[2] for t in templates) + 1
    for _, term, _, _ in templates:
        df[term] = df.get(term, 0) + 1
    idf = {t: math.log((1 + total) / (1 + df[t])) + 1 for t in terms}
    norm: dict[int, float] = {}
    for _, term, n, tf in templates:
        norm[n] = norm.get(n, 0.0) + (tf * idf[term]) ** 2
    weights = spark.createDataFrame(
        [(term, licence, n, tf * idf[term] / math.sqrt(norm[n]))
         for licence, term, n, tf in templates],
        "term string, licence string, template int, weight double")
    values = spark.createDataFrame(list(idf.items()), "term string, idf double")
    unseen = math.log(1 + total) + 1
    weighted = found.join(F.broadcast(values), "term", "left").withColumn(
        "value", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    size = weighted.groupBy("path", "line").agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
    dots = weighted.join(F.broadcast(weights), "term").groupBy(
        "path", "line", "licence", "template").agg(
            F.sum(F.col("value") * F.col("weight")).alias("dot"))
    scored = dots.join(size, dots["path"].eqNullSafe(size["path"])
                       & (dots["line"] == size["line"])).select(
        dots["path"], "licence", F.round(F.col("dot") / F.col("size"), 6).alias("cosine")) \
        .filter(F.col("cosine") >= rule.threshold)
    return scored.groupBy("path").agg(F.min(F.struct(
        (-F.col("cosine")).alias("rank"), "licence")).alias("best")).select(
            "path", F.col("best.licence").alias("licence"), (-F.col("best.rank")).alias("cosine"))


def folder_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(
        path.isNotNull(), F.lit(""))


def scan(files: DataFrame, rule: Rule = Rule(), path_col: str = "path", text_col: str = "text"
         ) -> DataFrame:
    """(path, licence, how, cosine, licence_dir) of every row of ``files``."""
    files = bare(files, path=path_col, text=text_col)
    # A row without a path is known by its text alone.
    files = files.withColumn("key", F.coalesce("path", F.concat(F.lit(NO_PATH), F.md5(
        F.coalesce("text", F.lit(""))))))
    own = staged(scan_notices(files.select(F.col("key").alias("path"), "text"), rule), "licences")
    name = F.regexp_replace("path", "^.*/", "")
    speaking = own.filter(name.rlike(LICENCE_FILE) & ~F.startswith("path", F.lit(NO_PATH))).groupBy(folder_of(F.col("path")).alias("dir")) \
        .agg(F.min(F.struct((-F.col("cosine")).alias("rank"), "path", "licence")).alias("b")) \
        .select("dir", F.col("b.licence").alias("dir_licence"))
    folders = files.select(folder_of(F.col("path")).alias("folder")).filter(
        "folder IS NOT NULL").distinct()
    parts = F.split("folder", "/", -1)
    above = folders.select("folder", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))\
        .withColumn("dir", F.concat_ws("/", F.slice(parts, F.lit(1), F.col("depth")))) \
        .withColumn("salt", F.pmod(F.xxhash64("folder"), F.lit(rule.salts)).cast("int"))
    spread = speaking.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(rule.salts - 1))))
    nearest = above.join(spread, ["dir", "salt"]).groupBy("folder").agg(
        F.max(F.struct("depth", "dir", "dir_licence")).alias("n")).select(
            "folder", F.col("n.dir").alias("licence_dir"), F.col("n.dir_licence"))
    rows = files.select("path", "key", folder_of(F.col("path")).alias("f"))
    mine = own.withColumnRenamed("path", "p")
    return rows.join(nearest, F.col("f") == F.col("folder"), "left").join(
        mine, F.col("key") == F.col("p"), "left").select(
        "path", F.coalesce("licence", "dir_licence").alias("licence"),
        F.when(F.col("licence").isNotNull(), "notice").when(
            F.col("dir_licence").isNotNull(), "inherited").otherwise("none").alias("how"),
        "cosine", F.when(F.col("licence").isNull(), F.col("licence_dir")).alias("licence_dir"))
