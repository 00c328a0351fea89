"""Licence scans: a trained paragraph classifier with confirmation by templates.

A text is read in units: every line, and every run of lines without a blank line that are short enough to be wrapped
(``wrapped`` characters), joined to one paragraph; a run of more than ``window`` words is read in windows that overlap by
half.  Word n-grams (1 to 3) of a unit, as a sparse presence vector over those of the embedded texts, go through multinomial
logistic regression over licence families and ``unknown``.  Every unit of every text is scored.  The probability from
which a unit counts as a licence is calibrated on a fold of notices and of document lines that the fit has not seen.  A
prediction is then confirmed by comparing the unit with its family's templates: the share of a template's word pairs
that the unit holds.

DataFrame functions and JVM-side ``pyspark.ml`` stages only.  The notices are the embedded templates and variants made of
them (cut, thinned out, amid other words); the unknown class is the embedded sentences and a bounded sample of document
lines that hold little of any template (``sample`` lines, the first by a hash).

Defined results: null and empty texts have no units and no rows; equal probabilities go to the family that sorts first;
repeated rows give repeated results; other columns are left alone; on an empty table the embedded texts alone teach.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
# Licence notices by family, as they commonly stand in files; long ones in their sentences.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT license."),
    ("mit", "The MIT License (MIT)"),
    ("mit", "MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Apache License, Version 2.0"),
    ("apache", "Apache License 2.0"),
    ("apache", "Apache-2.0 license"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("gpl", "GNU General Public License v3.0"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl", "Licensed under the GPL version 2."),
    ("gpl", "Licensed under the GPL."),
    ("gpl", "GPLv3 or later"),
    ("gpl", "GPLv2 or later"),
    ("gpl", "Licensed under GPLv3"),
    ("gpl", "Licensed under GPLv2"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("lgpl", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("lgpl", "Licensed under the LGPL."),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("agpl", "Licensed under the AGPL."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "BSD 3-Clause License"),
    ("bsd", "BSD 2-Clause License"),
    ("bsd", "Licensed under the BSD license."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "Mozilla Public License 2.0"),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("isc", "ISC License"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("zlib", "SPDX-License-Identifier: Zlib"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "CC BY 4.0"),
    ("cc-by", "CC BY 3.0"),
    ("cc-by", "CC-BY-4.0 license"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "CC BY-SA 4.0"),
    ("cc-by-sa", "CC BY-SA 3.0"),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0", "CC0 1.0 Universal"),
    ("cc0", "SPDX-License-Identifier: CC0-1.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("unlicense", "For more information, please refer to the Unlicense"),
    ("proprietary", "All rights reserved."),
    ("proprietary", "No part of this work may be reproduced without prior written permission of the publisher."),
    ("proprietary", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
    ("proprietary", "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
]
# Sentences with words of licences that are none.
OTHER = [
    "The driver lost his license after the accident and had to take the bus.",
    "She applied for a fishing licence at the town hall.",
    "The restaurant was granted a license to serve wine.",
    "He asked for permission to leave the room.",
    "Permission was granted by the parents before the trip.",
    "The copyright debate in parliament went on for hours.",
    "Public policy and the general public were the subject of the talk.",
    "The licensed dealer sells used cars in the city.",
    "Version two of the plan was released in spring.",
    "The warranty covers parts and labour for two years.",
    "Software under test is free of known faults.",
    "A commons is land that is used by all villagers.",
    "The terms of the treaty were published in full.",
    "You can redistribute the chairs along the wall.",
    "Work on the bridge is subject to the weather.",
    "The foundation gave money to the library for use by any person.",
    "The Mozilla festival and the Apache helicopter were in the news.",
    "Students at MIT write software and sell copies of their books.",
    "The author has all rights to be heard in court, with or without a lawyer.",
    "The source of the river is free of charge to visit for any purpose.",
    "A copy of this letter was distributed to all members in writing.",
    "The conditions are met if the distribution of the samples is normal.",
    "Creative people in the commons room share work in progress.",
    "In no event did the authors arrive before noon.",
]


@dataclass
class LicenceParams:
    """``confirm``: the share of a template's word pairs that confirms it.  ``false_share``: of held-out lines of
    documents, so many may pass as a licence.  ``sample``: document lines that teach and calibrate the unknown class."""

    confirm: float = 0.6
    false_share: float = 0.002
    sample: int = 4000
    wrapped: int = 120
    window: int = 120


def tokens_of(text: Column) -> Column:
    """Lower-case words of letters and digits, with dots, plus signs and hyphens only inside."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+")
    return F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(".+-"))), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def longer(grams: Column, tokens: Column, n: int) -> Column:
    """Each of the (n - 1)-grams of an array with its next word; null at the end and where a part is null."""
    return F.zip_with(grams, F.slice(tokens, F.lit(n), F.greatest(F.lit(0), F.size(tokens) - n + 1)), lambda a, b: F.concat(a, F.lit(" "), b))


def pairs_of(tokens: Column) -> Column:
    """The distinct word pairs of an array."""
    return F.array_distinct(F.filter(longer(tokens, tokens, 2), lambda g: g.isNotNull()))


def features(tokens: Column, known: list[str]) -> Column:
    """The n-grams of known words: no other can be in the vocabulary, so no other is put together."""

    def of(some: Column) -> Column:
        every = let(longer(some, some, 2), lambda twos: F.concat(some, twos, longer(twos, some, 3)))
        return F.filter(every, lambda g: g.isNotNull())

    return let(F.transform(tokens, lambda w: F.when(w.isin(*known), w)), of)


@dataclass
class LicenceModel:
    params: LicenceParams
    pipeline: PipelineModel
    families: list[str]
    words: list[str]  # of the vocabulary
    threshold: float


def templates(spark: SparkSession) -> DataFrame:
    """``family, tokens, pairs`` of each template."""
    rows = spark.createDataFrame(TEMPLATES, "family string, text string").select("family", tokens_of(F.col("text")).alias("tokens"))
    return rows.withColumn("pairs", pairs_of(F.col("tokens")))


def variants(known: DataFrame) -> DataFrame:
    """``family, tokens, source`` of notices as they may stand in texts: whole, cut, thinned out, and amid other words.

    A variant shorter than three words or than half its template says little, and is not made.  Words that several
    families share are not cut out on their own.
    """
    n = F.size("tokens")
    whole = known.select("family", "tokens", F.xxhash64(F.array_join("tokens", " ")).alias("source"))
    least = F.greatest(F.lit(3), F.ceil(n * 0.5).cast("int"))
    heads = whole.where(n > 3).select("family", "source", F.explode(F.expr("sequence(greatest(3, cast(ceil(size(tokens) * 0.5) as int)), size(tokens), 3)")).alias("k"), "tokens")
    heads = heads.select("family", F.slice("tokens", F.lit(1), F.col("k")).alias("tokens"), "source")
    tails = whole.where(n > 3).select("family", F.slice("tokens", n - least + 1, least).alias("tokens"), "source")
    thin = whole.where(n > 6).select("family", "source", F.explode(F.expr("sequence(0, 4)")).alias("k"), "tokens")
    thin = thin.select("family", F.filter("tokens", lambda w, i: i % 5 != F.col("k")).alias("tokens"), "source")
    amid = whole.select("*", F.explode(F.array(*map(F.lit, OTHER[:8]))).alias("other"))
    amid = amid.select("family", F.concat("tokens", tokens_of(F.col("other"))).alias("tokens"), "source")
    named = whole.select("family", F.concat(F.split(F.lit("copyright c 2020 by the authors"), " "), "tokens").alias("tokens"), "source")
    return whole.unionByName(heads).unionByName(tails).unionByName(thin).unionByName(amid).unionByName(named)


def containment(tokens: Column, pairs: Column) -> Column:
    """The largest share of an array of templates' word pairs that the tokens hold."""
    return let(pairs_of(tokens), lambda own: F.array_max(F.transform(pairs, lambda t: F.size(F.array_intersect(t, own)) / F.size(t))))


def training_rows(spark: SparkSession, docs: DataFrame | None, p: LicenceParams, id_col: str, text_col: str) -> DataFrame:
    """``family, tokens, fold``: fold 0 is left out of the trial fit, by whole templates and lines."""
    known = templates(spark)
    rows = variants(known).unionByName(spark.createDataFrame([(UNKNOWN, t) for t in OTHER], "family string, text string").select("family", tokens_of(F.col("text")).alias("tokens"), F.xxhash64("text").alias("source")))
    if docs is not None:
        lines = docs.select(docs[id_col].cast("string").alias("_id"), F.posexplode(F.split(docs[text_col].cast("string"), "\n")).alias("_k", "_line")).where("trim(_line) <> ''")
        some = lines.select(F.xxhash64("_id", "_k").alias("source"), F.substring("_line", 1, 2000).alias("_line")).orderBy("source", "_line").limit(p.sample)
        every = known.agg(F.collect_list("pairs").alias("all"))  # one row, bounded by TEMPLATES
        some = some.select("source", tokens_of(F.col("_line")).alias("tokens")).crossJoin(F.broadcast(every))
        plain = some.where(F.coalesce(containment(F.col("tokens"), F.col("all")), F.lit(0.0)) < 0.3)
        rows = rows.unionByName(plain.select(F.lit(UNKNOWN).alias("family"), "tokens", "source"))
    return rows.where("size(tokens) > 0").withColumn("fold", F.pmod(F.xxhash64("source", F.lit("fold")), F.lit(5)))


def fit(spark: SparkSession, docs: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", params: LicenceParams | None = None) -> LicenceModel:
    """The classifier, and its threshold from notices and lines that were left out of a trial fit."""
    p = params or LicenceParams()
    # The vocabulary are the n-grams of the embedded texts: a fixed number of features, whatever the documents hold.
    fixed = spark.createDataFrame([(t,) for _, t in TEMPLATES] + [(t,) for t in OTHER], "text string").select(tokens_of(F.col("text")).alias("tokens")).coalesce(1)
    words = sorted({w for r in fixed.collect() for w in r.tokens})
    rows = training_rows(spark, docs, p, id_col, text_col).withColumn("grams", features(F.col("tokens"), words)).repartition(4, "source").cache()  # a few thousand short rows
    stages = [
        StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc"),
        CountVectorizer(inputCol="grams", outputCol="vector", binary=True, vocabSize=1 << 14, minDF=1.0).fit(fixed.select(features(F.col("tokens"), words).alias("grams"))),
        LogisticRegression(featuresCol="vector", labelCol="label", regParam=0.0005, maxIter=40, family="multinomial"),
    ]
    # Templates with hardly a neighbour in their family cannot be told from a fit without them, so only variants with
    # a template of the same source in the fit are held out, and whole lines.
    held = (F.col("fold") == 0) & ((F.col("family") == UNKNOWN) | (F.pmod(F.xxhash64("tokens"), F.lit(2)) == 0))
    trial = Pipeline(stages=stages).fit(rows.where(~held))
    left = best(trial.transform(rows.where(held)), list(trial.stages[0].labels))
    q = left.agg(
        F.percentile(F.when(F.col("true") == UNKNOWN, F.col("top_known")), F.lit(1 - p.false_share)).alias("unknown"),
        F.percentile(F.when((F.col("true") != UNKNOWN) & (F.col("true") == F.col("family")), F.col("top_known")), F.lit(0.02)).alias("known"),
    ).first()
    model = Pipeline(stages=stages).fit(rows)
    rows.unpersist()
    high, low = q.unknown if q.unknown is not None else 0.5, q.known if q.known is not None else 0.5
    return LicenceModel(p, model, list(model.stages[0].labels), words, float((high + low) / 2 if high < low else high))


def best(scored: DataFrame, families: list[str]) -> DataFrame:
    """The likeliest family besides ``unknown``, and its probability; an old ``family`` column becomes ``true``."""
    p = F.col("_p")
    known = F.array(*[F.struct(F.get(p, F.lit(i)).alias("p"), F.lit(-i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(families) if f != UNKNOWN])
    if "family" in scored.columns:
        scored = scored.withColumnRenamed("family", "true")
    out = scored.withColumn("_p", vector_to_array("probability")).withColumn("_top", F.array_max(known))
    return out.withColumn("top_known", F.col("_top.p")).withColumn("family", F.col("_top.f")).drop("_p", "_top", "rawPrediction", "prediction", "probability", "vector")


def units(df: DataFrame, p: LicenceParams, id_col: str, text_col: str) -> DataFrame:
    """``_id, unit, paragraph, window, tokens``: every line, and the windows of every run of wrapped lines."""
    rows = df.select(df[id_col].alias("_id"), df[text_col].cast("string").alias("_text")).where("_text is not null and _text <> ''")
    lines = rows.select("_id", F.lit("line").alias("unit"), F.posexplode(F.split("_text", "\n")).alias("paragraph", "_t")).where("_t <> ''")
    run = rf"(?m)(?:^(?=[^\n]*\S)[^\n]{{1,{p.wrapped}}}+(?:\n|\z)){{2,}}+"
    runs = rows.where(F.contains("_text", F.lit("\n"))).select("_id", F.lit("run").alias("unit"), F.posexplode(F.regexp_extract_all("_text", F.lit(run), F.lit(0))).alias("paragraph", "_t"))
    # Behind a generator: named below, the words would be worked out for each use.
    both = lines.unionByName(runs).select("_id", "unit", "paragraph", F.explode(F.array(tokens_of(F.col("_t")))).alias("_all")).where("size(_all) > 0")
    half = p.window // 2
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("_all") / half).cast("int") - 2))
    return both.select("_id", "unit", "paragraph", F.posexplode(F.transform(starts, lambda k: F.slice("_all", k * half + 1, F.lit(p.window)))).alias("window", "tokens"))


def scan(df: DataFrame, model: LicenceModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, unit, paragraph, window, family, likeliest, probability, containment, confirmed`` of what looks like a licence.

    A window of a unit (short units have one) looks like a licence from the calibrated probability on; ``family`` is
    ``unknown`` if no template of the likeliest family confirms it.
    """
    p, stages = model.params, model.pipeline.stages
    rows = units(df, p, id_col, text_col).withColumn("grams", features(F.col("tokens"), model.words))
    scored = best(stages[2].transform(stages[1].transform(rows)).drop("grams"), model.families).where(F.col("top_known") >= model.threshold)
    by_family = templates(df.sparkSession).where("size(pairs) > 0").groupBy("family").agg(F.collect_list("pairs").alias("templates"))
    joined = scored.join(F.broadcast(by_family), "family", "left")  # one row per family: bounded by TEMPLATES
    told = joined.withColumn("containment", F.coalesce(containment(F.col("tokens"), F.col("templates")), F.lit(0.0)))
    confirmed = F.col("containment") >= p.confirm
    return told.select(F.col("_id").alias(id_col), "unit", "paragraph", "window", F.when(confirmed, F.col("family")).otherwise(UNKNOWN).alias("family"), F.col("family").alias("likeliest"), F.col("top_known").alias("probability"), "containment", confirmed.alias("confirmed"))
