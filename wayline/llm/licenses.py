"""Licence scan with DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance by directory.

Units are the lines of a file that hold a licence word, the paragraphs and comment blocks around them
and, of a file whose name is that of a licence file, the whole text. Equal units are scored once. Lines
and whole texts are compared with one-line notices (``TEMPLATES``); what no notice matches, and every
block, is compared with full licence texts, standard headers and usual phrases (``licence_patterns``),
several a licence. An SPDX tag is read, not compared: the identifier of its expression that sorts
first counts as 1.0.

A unit and a template are vectors of terms weighted by count times smoothed inverse document frequency,
ln((1 + units) / (1 + units with the term)) + 1, over all distinct units and templates that are compared;
the best template by cosine counts if it reaches ``least``. For patterns the documents are the patterns
alone, and the unit must have the terms that the pattern can't do without. A file has the licence of its whole text if that has one, else of its best unit. A
*licence file*, by name or because its licence lines, paragraphs or comment blocks make up at least
``share`` of its characters, speaks for its directory; a file without a licence of its own inherits from
the nearest ancestor directory that one speaks for (of several, the best match, then the template that
sorts first).

Distinct units and distinct directories are resolved before they meet files, so that a directory or a
line that a third of all files share is one row of the joins that decide.

Defined results: a null text has no units; a null path is the root; ties go to the template that sorts
first; repeated rows are each reported, and rows of one doc_id and path (a null id is an id too) take the best of
their units together; a text of any length is one row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_patterns import patterns
from .scratch import keep

#: Short notices by which files name their licence, by SPDX identifier.
TEMPLATES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LicenseRef-Proprietary", "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, Version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: A line with one of these is a unit.
ANCHORS = "licen[sc]|copyright|spdx|rights reserved|public domain"
#: Names of licence files, without their extension.
FILE_NAMES = "licen[sc]e|copying|copyright|notice|unlicense"
#: Comment blocks are runs of lines with a mark, or what stands between two marks. Possessive: long blocks need no stack.
COMMENT_LINES = r"(?m)((?:^[ \t]*+(?:#|//|/\*|\*|--|;|%|<!--)[^\n]*+(?:\n|\z))++)"
COMMENT_SPANS = r"(?s)(/\*.*?\*/|<!--.*?-->|\"\"\".*?\"\"\"|'''.*?''')"
PARAGRAPH_ENDS = r"\r?\n(?:[^\p{L}\p{N}\n]*+\n)++"
_ID = r"\(*[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\+?\)*"
SPDX = rf"(?i)spdx-license-identifier:[ \t]*({_ID}(?:[ \t]+(?:and|or|with)[ \t]+{_ID})*)"
LINE, PARAGRAPH, MARKED, SPAN, WHOLE = range(5)
TERM = "[a-z0-9]+(?:[.][0-9]+)*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(column: str) -> F.Column:
    return F.regexp_extract_all(F.translate(column, _UPPER, _LOWER), F.lit(f"({TERM})"), F.lit(1))


def unit_matches(units: DataFrame, least: float) -> DataFrame:
    """unit, license and similarity of the distinct ``units`` (unit) that are near enough to a notice."""
    spark = units.sparkSession
    templates = spark.createDataFrame(TEMPLATES, "license string, unit string")
    distinct = keep(units.select("unit").distinct(), "licence-units")
    both = distinct.select("unit", F.lit(None).cast("string").alias("license")).union(templates.select("unit", "license"))
    counted = keep(both.select("unit", "license", F.explode(_terms("unit")).alias("term")).groupBy("unit", "license", "term").agg(F.count("*").alias("tf")), "licence-terms")
    number = distinct.count() + len(TEMPLATES)
    idf = counted.groupBy("term").agg((F.log(F.lit(1.0 + number) / (1 + F.count("*"))) + 1).alias("idf"))
    weighted = counted.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("unit", "license").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # The templates' side is fixed and small; a unit's terms find the templates that have them.
    known = weighted.where("license IS NOT NULL").select("term", "license", F.col("w").alias("tw")).join(F.broadcast(norms.where("license IS NOT NULL").select("license", F.col("norm").alias("tnorm"))), "license")
    dots = weighted.where("license IS NULL").select("unit", "term", "w").join(F.broadcast(known), "term").groupBy("unit", "license", "tnorm").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms.where("license IS NULL").select("unit", "norm"), "unit").select("unit", "license", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6).alias("similarity"))
    best = F.min_by(F.struct("license", "similarity"), F.struct(-F.col("similarity"), F.col("license")))
    return scored.where(F.col("similarity") >= least).groupBy("unit").agg(best.alias("b")).select("unit", "b.*")


def _weights() -> tuple[list, list, list]:
    """Of the patterns: terms with their weight; (term, template, weight in a vector of length 1, whether it must be there); templates with their license and number of such terms."""
    vectors = [(name, Counter(re.findall(TERM, text.translate(str.maketrans(_UPPER, _LOWER)))), set(must)) for name, text, must in [*((*x, ()) for x in TEMPLATES), *patterns()]]
    seen = Counter(term for _, terms, _ in vectors for term in terms)
    idf = {term: log((1 + len(vectors)) / (1 + n)) + 1 for term, n in seen.items()}
    rows = []
    for k, (_, terms, must) in enumerate(vectors):
        norm = sqrt(sum((n * idf[x]) ** 2 for x, n in terms.items()))
        rows += [(x, k, n * idf[x] / norm, int(x in must)) for x, n in terms.items()]
    return sorted(idf.items()), rows, [(k, name, len(must)) for k, (name, _, must) in enumerate(vectors)]


def pattern_matches(units: DataFrame, least: float) -> DataFrame:
    """unit, license and similarity of the distinct ``units`` (unit) that are near enough to a pattern."""
    spark = units.sparkSession
    idf, weights, names = _weights()
    top = log(1 + len(names)) + 1
    idf = F.broadcast(spark.createDataFrame(idf, "term string, idf double"))
    weights, names = F.broadcast(spark.createDataFrame(weights, "term string, template int, tw double, has int")), F.broadcast(spark.createDataFrame(names, "template int, license string, wanted int"))
    # Dealt by digest once, the terms of a unit stay in its task.
    vectors = lambda x: x.repartition("key").select("key", F.explode(_terms("unit")).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf")).join(idf, "term", "left").select("key", "term", (F.col("tf") * F.coalesce("idf", F.lit(top))).alias("w"), F.col("idf").isNotNull().alias("known"))
    keyed = units.select("unit", F.sha2("unit", 256).alias("key"))
    square = F.col("w") * F.col("w")
    norms = vectors(keyed).groupBy("key").agg(F.sqrt(F.sum(square)).alias("norm"), F.sqrt(F.sum(F.when(F.col("known"), square))).alias("most"))
    # No cosine is above the share of a unit's length that lies in terms of any pattern: this rules prose out.
    able = keep(keyed.join(norms.where(F.col("most") >= (least - 1e-6) * F.col("norm")), "key"), "licence-able", compression="zstd")
    dots = vectors(able.select("key", "unit")).join(weights, "term").groupBy("key", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"), F.sum("has").alias("has"))
    scored = dots.join(names, "template").where("has >= wanted").join(able, "key").select("unit", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity"))
    best = F.min_by(F.struct("license", "similarity"), F.struct(-F.col("similarity"), F.col("license")))
    return scored.where(F.col("similarity") >= least).groupBy("unit").agg(best.alias("b")).select("unit", "b.*")


def tagged(units: DataFrame) -> DataFrame:
    """unit, license and similarity 1.0 of ``units`` (unit) with an SPDX tag: the identifier that sorts first, without '-only', '-or-later', '+' and exceptions."""
    tags = units.select("unit").distinct().select("unit", F.explode(F.regexp_extract_all("unit", F.lit(SPDX), F.lit(1))).alias("tag"))
    plain = F.regexp_replace(F.regexp_replace("tag", r"(?i)\swith\s+\S+", ""), r"[()]", "")
    ids = tags.select("unit", F.explode(F.split(plain, r"(?i)\s+(?:and|or)\s+")).alias("id"))
    known = sorted({name for name, *_ in TEMPLATES} | {name for name, *_ in patterns()})
    proper = F.create_map(*[F.lit(x) for name in known for x in (name.lower(), name)])
    bare = F.regexp_replace(F.trim("id"), r"(?i)(-only|-or-later|\+)$", "")
    return ids.groupBy("unit").agg(F.min(F.coalesce(F.try_element_at(proper, F.lower(bare)), bare)).alias("license")).withColumn("similarity", F.lit(1.0))


def scan(files: DataFrame, least: float = 0.7, share: float = 0.5) -> DataFrame:
    """doc_id, path, license, similarity, effective_license and inherited_from for each row of ``files`` (doc_id, path, text).

    license and similarity: the file's own, else null; inherited_from: the directory whose licence file decides, else null.
    """
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = F.rlike(F.element_at(F.split("path", "/"), -1), F.lit(rf"(?i)^({FILE_NAMES})([.][a-z0-9]+)?$"))
    lines = F.filter(F.split("text", "\r?\n"), lambda x: F.rlike(x, F.lit(f"(?i){ANCHORS}")))
    # Lines are looked at where the files are read; only files that have units leave that stage.
    holders = keep(files.select("doc_id", "path", named.alias("named"), F.length("text").alias("size"), "text", lines.alias("lines")).where(F.col("named") | (F.size("lines") > 0)), "licence-files", compression="zstd")
    with_word = lambda found: F.filter(found, lambda x: F.rlike(x, F.lit(f"(?i){ANCHORS}")))
    of = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("unit")))
    extract = lambda pattern: F.transform(with_word(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))), lambda x: F.regexp_replace(x, r"\s+$", ""))
    kinds = [of(LINE, F.col("lines")), of(PARAGRAPH, with_word(F.split("text", PARAGRAPH_ENDS))), of(MARKED, extract(COMMENT_LINES)), of(SPAN, extract(COMMENT_SPANS)), of(WHOLE, F.when(F.col("named"), F.array("text")).otherwise(F.array().cast("array<string>")))]
    exploded = keep(holders.select("doc_id", "path", "named", "size", F.explode(F.concat(*kinds)).alias("u")).select("doc_id", "path", "named", "size", "u.*"), "licence-lines", compression="zstd")
    noticed = keep(unit_matches(exploded.where(F.col("kind").isin(LINE, WHOLE)), least), "licence-noticed")
    rest = exploded.where(~F.rlike("unit", F.lit(SPDX)) | F.contains("unit", F.lit("\n"))).select("unit").distinct().join(noticed, "unit", "left_anti")
    best = F.min_by(F.struct("license", "similarity"), F.struct(-F.col("similarity"), F.col("license")))
    matches = noticed.union(pattern_matches(rest, least)).union(tagged(exploded.where(F.col("kind") == LINE))).groupBy("unit").agg(best.alias("b")).select("unit", "b.*")
    # Written, as is what is joined by directory below: a line or a directory of very many files is then split at run time.
    matched = exploded.join(keep(matches, "licence-matches"), "unit")
    first = F.min_by(F.struct("license", "similarity"), F.struct(-(F.col("kind") == WHOLE).cast("int"), -F.col("similarity"), F.col("license")))
    # Units of one kind don't overlap, those of different kinds do.
    covered = [F.sum(F.when(F.col("kind") == k, F.length("unit")).otherwise(0)) for k in (LINE, PARAGRAPH, MARKED, SPAN)]
    own = keep(matched.groupBy("doc_id", "path").agg(first.alias("b"), (F.max("named") | (F.greatest(*covered) >= share * F.max("size"))).alias("speaks")).select("doc_id", "path", "b.*", "speaks"), "licence-own")
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    spoken = own.where("speaks").groupBy(directory.alias("dir")).agg(best.alias("b")).select(F.col("dir").alias("ancestor"), F.col("b.license").alias("dir_license"))
    parts = F.split("dir", "/")
    climbed = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    steps = files.select(directory.alias("dir")).distinct().select("dir", F.posexplode(climbed).alias("depth", "ancestor"))
    nearest = keep(steps.join(spoken, "ancestor").groupBy("dir").agg(F.max_by(F.struct("dir_license", "ancestor"), "depth").alias("n")).select("dir", "n.*"), "licence-directories")
    # Rows that share doc_id and path take the best of their units together.
    known = F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("known")
    out = files.select("doc_id", "path", known, directory.alias("dir")).join(own.select(known, "path", "license", "similarity"), ["known", "path"], "left").join(nearest, "dir", "left")
    bare = F.col("license").isNull()
    return out.select("doc_id", "path", "license", "similarity", F.coalesce("license", "dir_license").alias("effective_license"), F.when(bare, F.col("ancestor")).alias("inherited_from"))
