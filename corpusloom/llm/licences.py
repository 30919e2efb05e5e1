"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

What is compared with the templates: comment marks are taken off a file, and then
every line with a cue word, every block (lines between blank ones, so wrapped
headers and paragraphs are whole) with a cue word, and the whole text where such
blocks make up half of it, as licence files do. Every distinct one is compared
once: words ``[a-z0-9]+`` of the lower-cased text, weights tf * (ln((1 +
templates) / (1 + df)) + 1), cosine over all its words. The best template at or
above ``THRESHOLD`` names its licence, and a file's best one the file's own (ties:
the licence that sorts first).

A file is a licence file if its name says so (LICENSE, COPYING, NOTICE and the
like) or if at least half of its words lie in lines with cue words or in blocks
that a template fits. The best licence file of a directory licenses it. A file
without a licence of its own has that of its nearest ancestor directory that is
licensed. Ancestors are resolved for distinct directories by joins on path
prefixes, then joined to the files.

Everything is DataFrame functions; the template table is a bounded constant and
the only thing that is broadcast. Texts are searched for cues once; what has any
is kept in the checkpoint folder.

Defined cases: null text or path counts as empty; rows with the same path are one
file and each gets its result; very long texts are scanned whole; an empty table
gives an empty result; further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.plans.session import cut

THRESHOLD = 0.6
CUES = r"(?i)licen[cs]e|copyright|spdx|warrant|rights reserved|permission is|public domain|redistribut"
NAMES = r"(?i)^(un)?(licen[cs]e|copying|copyright|notice)([._-].*)?$"

#: Marks of comments at the beginning of a line, and what lies between blocks.
MARKS, BETWEEN = r"^[ \t]*(//|#|/\*+|\*/|\*|;|--|<!--)+[ \t]?", r"\n[ \t\r]*\n"

#: Statements, titles and paragraphs by which licences are known.
TEMPLATES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", 'MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright (c). All rights reserved."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def line_licences(lines: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """print (SHA-256), licence and score of the distinct lines that a template fits. Only prints travel with words."""
    spark, total = lines.sparkSession, len(templates)
    given = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "t int, licence string, text string")
    counted = given.select("t", "licence", F.explode(words(F.col("text"))).alias("word")).groupBy("t", "licence", "word").agg(F.count("*").alias("tf"))
    idf = lambda df: F.log((1 + F.lit(total)) / (1 + df)) + 1
    weights = counted.groupBy("word").agg(F.count("*").alias("df")).select("word", idf(F.col("df")).alias("idf"))
    rated = counted.join(weights, "word").withColumn("w", F.col("tf") * F.col("idf"))
    norms = rated.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    index = rated.join(norms, "t").groupBy("word").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("t", "licence", (F.col("w") / F.col("norm")).alias("w"))).alias("at"))

    distinct = lines.groupBy(F.sha2("line", 256).alias("print")).agg(F.first("line").alias("line"))
    tf = distinct.select("print", F.explode(words(F.col("line"))).alias("word")).groupBy("print", "word").agg(F.count("*").alias("tf"))
    known = tf.join(F.broadcast(index), "word", "left")  # as many rows as the templates have words
    rated = known.withColumn("w", F.col("tf") * F.coalesce("idf", idf(F.lit(0))))
    # one pass gives the products with all templates and, as template -1, the squared length
    none = F.array().cast("array<struct<t:int,licence:string,x:double>>")
    products = F.coalesce(F.transform("at", lambda a: F.struct(a["t"].alias("t"), a["licence"].alias("licence"), (F.col("w") * a["w"]).alias("x"))), none)
    square = F.array(F.struct(F.lit(-1).alias("t"), F.lit("").alias("licence"), (F.col("w") * F.col("w")).alias("x")))
    sums = rated.select("print", F.explode(F.concat(products, square)).alias("p")).groupBy("print", "p.t", "p.licence").agg(F.sum("p.x").alias("x"))
    length = F.sqrt(F.max(F.when(F.col("t") < 0, F.col("x"))).over(W.partitionBy("print")))
    scored = sums.withColumn("length", length).where("t >= 0").select("print", "licence", F.round(F.col("x") / F.col("length"), 6).alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy("print").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("print", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def folder(path: Column) -> Column:
    """The directory of a path; '' at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, path: Column, text: Column, keep: dict[str, Column], templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns, path, licence, score, origin (own, inherited or null) and licensed_dir of each row."""
    rows = files.select(F.coalesce(path, F.lit("")).alias("path"), F.coalesce(text, F.lit("")).alias("text"))
    count = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.size(words(x)))
    cued = rows.where(F.col("text").rlike(CUES)).select("path", F.regexp_replace("text", "(?md)" + MARKS, "").alias("text"))
    of = lambda parts: F.filter(parts, lambda x: x.rlike(CUES))
    cued = cued.select("path", "text", of(F.split("text", "\n")).alias("lines"), of(F.split("text", BETWEEN)).alias("blocks"), F.size(words(F.col("text"))).alias("words"))
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(NAMES)
    whole = F.when((2 * count(F.col("blocks")) >= F.col("words")) | named, F.array("text")).otherwise(F.array().cast("array<string>"))
    unit = lambda is_block: lambda x: F.struct(x.alias("line"), F.lit(is_block).alias("is_block"), F.size(words(x)).alias("n"))
    units = F.concat(F.transform("lines", unit(False)), F.transform(F.concat("blocks", whole), unit(True)))
    each = cued.select("path", ((2 * count(F.col("lines")) >= F.col("words")) | named).alias("is_file"), "words", F.explode(units).alias("u"))
    own_lines = cut(each.groupBy("path", "u.line").agg(F.max("is_file").alias("is_file"), F.max("words").alias("words"), F.max("u.is_block").alias("is_block"), F.max("u.n").alias("n")))
    found = own_lines.withColumn("print", F.sha2("line", 256)).drop("line").join(line_licences(own_lines, templates, threshold), "print")
    in_blocks = F.sum(F.when(F.col("is_block"), F.col("n")).otherwise(0))
    own = found.groupBy("path").agg((F.max("is_file") | (2 * in_blocks >= F.max("words"))).alias("is_file"), F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")).select("path", "is_file", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))

    licensed = own.where("is_file").groupBy(folder(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "licence", "path")).alias("b")).select("dir", F.col("b.licence").alias("from_licence"), (-F.col("b.s")).alias("from_score"))
    dirs = rows.select(folder(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit(""))))
    ancestors = dirs.select("dir", F.explode(F.array_distinct(up)).alias("above"))
    nearest = ancestors.join(licensed.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "from_licence", "from_score")).alias("b")).select("dir", F.col("b.above").alias("above"), "b.from_licence", "b.from_score")

    asked = files.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], F.coalesce(path, F.lit("")).alias("path")).withColumn("dir", folder(F.col("path")))
    out = asked.join(own.withColumnRenamed("licence", "own_licence").withColumnRenamed("score", "own_score"), "path", "left").join(nearest, "dir", "left")
    origin = F.when(F.col("own_licence").isNotNull(), "own").when(F.col("from_licence").isNotNull(), "inherited")
    return out.select(
        *[F.col(f"k{i}").alias(name) for i, name in enumerate(keep)],
        "path",
        F.coalesce("own_licence", "from_licence").alias("licence"),
        F.coalesce("own_score", "from_score").alias("score"),
        origin.alias("origin"),
        F.when(F.col("own_licence").isNull(), F.col("above")).alias("licensed_dir"),
    )
