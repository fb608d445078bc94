"""License scans: sparse TF-IDF cosine to templates, inherited from the nearest directory.

Templates are notices, titles, SPDX tags, headers and the full texts in ``license_texts``.
A term weighs (1 + log of its count) times its rarity among all lines of the corpus, counted
for all terms. A header is a run of lines of any length. A file meets only templates of
which its terms can make up enough. For each of these the run of lines nearest to the template is
found by running sums: lines add what they share with it and lose a part of their own weight,
and the stretch with the greatest sum wins. Such runs, and whole files, are then scored exactly by joins
on terms. A file has the license of the largest cosine. One without a match takes the license
of the nearest directory above it that holds a licence file: one so marked, or one that mostly
is the text of a license.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.common import column
from clientele.sources.staging import staged

# Usual license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0",
}
# Other usual short forms: titles, and headers of files.
SHORT_FORMS = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
                   "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                   "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                   "governing permissions and limitations under the License."),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "GPL-2.0": ("GNU General Public License version 2", "GNU General Public License Version 2, June 1991",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPL-3.0": ("GNU General Public License version 3", "GNU General Public License Version 3, 29 June 2007",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "LGPL-3.0": ("GNU Lesser General Public License version 3", "GNU Lesser General Public License Version 3, 29 June 2007"),
    "MIT": ("MIT License", "The MIT License (MIT)"),
    "MPL-2.0": ("Mozilla Public License Version 2.0",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}
TAGS = ("", "-only", "-or-later")
TEXTS = Path(__file__).parent / "license_texts"
LEAST_COSINE = 0.8
# A file that matches a full text is a licence file if this share of its terms lies in the match.
MOSTLY = 0.5
# Bound of the frequent terms.
FREQUENT = 100_000
TERM = r"[.-]?[a-z0-9]++(?:[.-][a-z0-9]++)*+"


def all_terms(line: Column) -> Column:
    """Terms of a line: lower-case letters, digits, and single dots or hyphens before or within."""
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))


def terms(line: Column) -> Column:
    """Distinct terms of a line."""
    return F.array_distinct(all_terms(line))


def _terms_of(text: str) -> Counter[str]:
    """As ``all_terms`` for a given text, counted."""
    split = [t.rstrip(".-") for t in "".join(c if c.isalnum() or c in ".-" else " " for c in text.lower()).split()]
    return Counter(t for t in split if t)


def template_terms(templates: Mapping[str, str]) -> list[tuple[str, Counter[str], bool]]:
    """License, terms, and whether it is a full text, of the notices given and of the other forms of their licenses."""
    found = []
    for name, notice in sorted(templates.items()):
        tags = TAGS if "GPL" in name else TAGS[:1]
        short = [notice, *SHORT_FORMS.get(name, ()), *(f"SPDX-License-Identifier: {name}{t}" for t in tags)]
        found += [(name, _terms_of(text), False) for text in short]
        path = TEXTS / f"{name}.txt"
        if path.exists():
            found.append((name, _terms_of(path.read_text("utf-8")), True))
    return found


def _once(df: DataFrame, *columns: str, **made: Column) -> DataFrame:
    """Columns and new ones, made by a generator: filters on top do not repeat what makes them."""
    return df.select(*columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def _lines(files: DataFrame) -> DataFrame:
    """Lines with a term: file, number of the line and its terms."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return _once(lines, "file", "line", terms=terms(F.col("content"))).filter(F.size("terms") > 0)


def term_counts(lines: DataFrame) -> DataFrame:
    """Lines with each term (term, n); the empty term counts all lines."""
    every = F.explode(F.concat(F.array(F.lit("")), "terms"))
    return staged(lines.select(every.alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")))


class _Templates:
    """Weighted terms of the templates (license, terms, full text), given the lines with each term."""

    def __init__(self, counts: DataFrame, templates: list[tuple[str, Counter[str], bool]], least: float):
        self.counts, self.templates, self.least = counts, templates, least
        vocabulary = F.concat(_listed(sorted({t for _, own, _ in templates for t in own})), F.array(F.lit("")))
        own = counts.sparkSession.range(1).select(F.explode(vocabulary).alias("term"))
        known = dict(counts.join(F.broadcast(own), "term").select("term", "n").collect())
        self.total = known.pop("", 0)
        self.weights = [{t: (1 + math.log(k)) * (math.log((1 + self.total) / (1 + known.get(t, 0))) + 1) for t, k in own.items()}
                        for _, own, _ in templates]
        self.sizes = [sum(w * w for w in ws.values()) for ws in self.weights]

    def needed(self) -> Column:
        """Terms of which a match holds one at least: without them it misses too much of each template."""
        found = set()
        for ws, size in zip(self.weights, self.sizes, strict=True):
            missed = 0.0
            for t, w in sorted(ws.items(), key=lambda x: (-x[1], x[0])):
                found.add(t)
                missed += w * w
                if missed > (1 - self.least ** 2) * size * (1 + 1e-9):
                    break
        return _listed(sorted(found))

    def table(self) -> DataFrame:
        """Terms of all templates: place (0, -1, ...), size, term, its weight and squared rarity; as large as the templates are."""
        rows = [F.struct(F.lit(-i).alias("place"), F.lit(size).alias("size"), _listed(list(ws)).alias("terms"),
                         F.lit(list(ws.values())).alias("weights"))
                for i, (ws, size) in enumerate(zip(self.weights, self.sizes, strict=True))]
        one = self.counts.sparkSession.range(1).select(F.inline(F.array(*rows)))
        return one.select("place", "size", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("weights").alias("weight"))))

    def named(self) -> DataFrame:
        """License, and whether it is a full text, by place."""
        rows = [F.struct(F.lit(-i).alias("place"), F.lit(name).alias("license"), F.lit(full).alias("full")) for i, (name, _, full) in enumerate(self.templates)]
        return self.counts.sparkSession.range(1).select(F.inline(F.array(*rows)))

    def rarity(self) -> Column:
        return F.log((1 + self.total) / (1 + F.col("n"))) + 1


def _listed(words: list[str]) -> Column:
    """An array of terms, none of which holds a blank."""
    return F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")


def _with_rarity(counted: DataFrame, rarity: DataFrame) -> DataFrame:
    """``counted`` with the rarity of its terms.

    Terms on more than one of ``FREQUENT`` occurrences are less than ``FREQUENT`` whatever the corpus is, so these are
    sent to all tasks; the others are joined by term, none of which holds more than that part of the rows.
    """
    every = rarity.filter("term <> ''").agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > every / FREQUENT
    frequent = F.broadcast(rarity.filter(often).drop("n"))
    return (counted.join(frequent, "term")
            .unionByName(counted.join(frequent.drop("rarity"), "term", "left_anti").join(rarity.filter(~often).drop("n"), "term")))


def _nearest_runs(weighted: DataFrame, pairs: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """Runs of lines (row, first, last) nearest to a template that their row may match.

    A line shares s with a template and weighs w. A run over the limit c weighs between c and 1/c times the
    template; the run with the greatest sum of s - p * w is the one of largest cosine if p is c / 2 over that
    ratio. Three prices p over this range leave it under a hundredth below the largest, where no
    term is on two lines. Sums are in millionths, so that they are exact.
    """
    square = F.pow("rarity", 2)
    shared = (weighted.join(F.broadcast(table.select("term", "place")), "term").join(pairs, ["row", "place"])
              .groupBy("row", "line", "place").agg(F.sum(square).alias("shared")))
    every = weighted.groupBy("row", "line").agg(F.sum(square).alias("own")).join(pairs, "row")
    lines = every.join(shared, ["row", "line", "place"], "left")
    prices = [least * least / 2, least / 2, 0.5]
    value = [F.round(1e6 * (F.coalesce("shared", F.lit(0.0)) - p * F.col("own"))).cast("long") for p in prices]
    valued = lines.select("row", "place", "line", F.posexplode(F.array(*value)).alias("price", "value"))
    run = Window.partitionBy("row", "place", "price").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    summed = valued.withColumn("upto", F.sum("value").over(run))
    # The smallest sum before a line, the last of equal ones: the run that ends here starts after it.
    start = F.min(F.struct((F.col("upto") - F.col("value")).alias("before"), (-F.col("line")).alias("minus"))).over(run)
    ended = summed.withColumn("start", start).withColumn("sum", F.col("upto") - F.col("start.before"))
    best = ended.groupBy("row", "place", "price").agg(
        F.max(F.struct(F.col("sum"), (-F.col("line")).alias("minus"), F.col("start.minus").alias("start"))).alias("b"))
    return best.filter("b.sum > 0").select("row", (-F.col("b.start")).alias("first"), (-F.col("b.minus")).alias("last")).distinct()


def header_matches(files: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """Per file with a match, from (file, text): license and cosine of its best run of lines or whole
    text, the line where that starts, the share of the file's terms in it, and whether it matches a full text."""
    counts = term_counts(_lines(files))
    given = _Templates(counts, template_terms(templates), least)
    table = staged(given.table())
    near = files.filter(F.arrays_overlap(all_terms(F.col("text")), given.needed())).withColumn("row", F.monotonically_increasing_id())
    lines = near.select("row", "file", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    lines = staged(lines.select("row", "file", "line", all_terms(F.col("content")).alias("terms")).filter(F.size("terms") > 0))
    tokens = lines.select("row", "line", F.explode("terms").alias("term"))
    # No vector has a larger cosine than the root of the share of the template on the terms that both have.
    held = tokens.join(F.broadcast(table.select("term").distinct()), "term", "left_semi").select("row", "term").distinct()
    enough = F.sum(F.pow("weight", 2)) >= least ** 2 * F.col("size") * (1 - 1e-9)
    pairs = staged(held.join(F.broadcast(table), "term").groupBy("row", "place", "size").agg(enough.alias("enough"))
                   .filter("enough").select("row", "place"))
    counted = staged(tokens.join(pairs.select("row").distinct(), "row", "left_semi")
                     .groupBy("row", "line", "term").agg(F.count(F.lit(1)).alias("tf")))
    weighted = staged(_with_rarity(counted, counts.select("term", "n", given.rarity().alias("rarity"))))
    whole = weighted.groupBy("row").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    runs = _nearest_runs(weighted, pairs, table, least).unionByName(whole).distinct()
    parts = (runs.join(weighted, "row").filter("line between first and last")
             .groupBy("row", "first", "last", "term").agg(F.sum("tf").alias("tf"), F.first("rarity").alias("rarity"))
             .withColumn("w", (1 + F.log("tf")) * F.col("rarity")))
    parts = staged(parts.select("row", "first", "last", "term", "tf", "w"))
    norms = parts.groupBy("row", "first", "last").agg(F.sum(F.col("w") * F.col("w")).alias("norm"), F.sum("tf").alias("held"))
    dots = (parts.join(F.broadcast(table), "term").groupBy("row", "first", "last", "place", "size")
            .agg(F.sum(F.col("w") * F.col("weight")).alias("dot")))
    cosine = F.round(F.col("dot") / F.sqrt(F.col("norm") * F.col("size")), 9)
    scored = dots.join(norms, ["row", "first", "last"]).withColumn("cosine", cosine).filter(F.col("cosine") >= least)
    sizes = weighted.groupBy("row").agg(F.sum("tf").alias("all"))
    scored = scored.join(sizes, "row").withColumn("share", F.col("held") / F.col("all")).join(F.broadcast(given.named()), "place")
    full = F.col("full") & (F.col("share") >= MOSTLY)
    best = F.max(F.struct("cosine", (-F.col("first")).alias("minus"), "place", "share", "license")).alias("m")
    by_row = scored.groupBy("row").agg(best, F.max(full).alias("full"))
    names = lines.select("row", "file").distinct()
    return (by_row.join(names, "row").groupBy("file").agg(F.max("m").alias("m"), F.max("full").alias("full"))
            .select("file", F.col("m.license").alias("license"), F.col("m.cosine").alias("cosine"), (-F.col("m.minus")).alias("line"),
                    F.col("m.share").alias("share"), "full"))


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first."""
    parts = F.split(path, "/")
    depths = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.transform(depths, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licenses(files: DataFrame, is_licence_file: Column, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST_COSINE,
                  file_col: str = "doc_id", path_col: str = "path", text_col: str = "text", mostly: float | None = None) -> DataFrame:
    """Per file: license, cosine and line of its own match, or the directory it inherits from.

    ``is_licence_file`` marks files whose license holds for their directory, as does that of a
    file most of whose text is the full text of a license, and, if ``mostly`` is given, of a file
    with at least that share of its terms in its match; of several in
    one directory the largest cosine counts, then the smallest file. NULL and empty texts match
    nothing, NULL paths inherit nothing; very long texts are read whole; rows that repeat a file are one file with the texts
    of all; other columns are ignored; an empty table gives an empty result.
    """
    rows = staged(files.select(column(files, file_col).alias("file"), column(files, path_col).alias("path"), is_licence_file.alias("for_all")))
    own = staged(header_matches(files.select(column(files, file_col).alias("file"), column(files, text_col).alias("text")), templates, least))
    matched = rows.join(own, "file", "left")
    holds = F.col("for_all") | F.col("full")
    if mostly is not None:
        holds |= F.col("share") >= mostly
    holders = (matched.filter(holds & F.col("license").isNotNull() & F.col("path").isNotNull())
               .groupBy(F.element_at(F.concat(ancestors(F.col("path")), F.array(F.lit(""))), 1).alias("directory"))
               .agg(F.min_by("license", F.struct((-F.col("cosine")).alias("minus"), F.col("file"))).alias("inherited")))
    # Directories are far fewer than files: each finds its nearest holder once.
    place = F.element_at(F.concat(ancestors(F.col("path")), F.array(F.lit(""))), 1)
    above = rows.filter(F.col("path").isNotNull()).select(place.alias("place")).distinct()
    nearest = staged(
        above.select("place", F.explode(F.concat(F.array("place"), ancestors(F.col("place")))).alias("directory"))
        .join(holders, "directory").groupBy("place")
        .agg(F.max_by(F.struct("directory", "inherited"), F.length("directory")).alias("from")))
    given = F.col("license").isNotNull()
    return (matched.withColumn("place", place).join(nearest, "place", "left")
            .select("file", "path", F.coalesce("license", "from.inherited").alias("license"), "cosine", "line",
                    F.when(~given, F.col("from.directory")).alias("inherited_from")))


def documents_as_files(docs: DataFrame) -> DataFrame:
    """The documents table as a tree of files: source, language, and one directory per 20 ids."""
    folder = F.expr("cast(doc_id div 20 as string)")
    parts = [F.coalesce(F.col("source"), F.lit("-")), F.coalesce(F.col("lang"), F.lit("-")), folder, F.col("doc_id").cast("string")]
    return docs.select("doc_id", "text", F.concat_ws("/", *parts).alias("path"))
