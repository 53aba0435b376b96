"""Licence scans: a trained paragraph classifier over sparse word n-grams, as DataFrame expressions.

A paragraph ends at a blank line, before and after an SPDX line, and at a line break after a closing
mark (. : ; ! ?); other line breaks are wrapped lines and join. A multinomial logistic regression over
words and word pairs names a paragraph's licence family, `unknown` (a licence of no family here) or
`none`. It is fitted on the driver, from the notices below, on seeded variants of them (words dropped,
framed by other words), with notices of other licences for `unknown` and everyday sentences and
notices' words out of order for `none`; a temperature fitted on further, harder variants calibrates
its probabilities. A family is confirmed by comparison with single templates: some one notice of the
family must have `overlap` of its distinct n-grams in the paragraph, whatever prose stands around it.
What looks like a licence but is confirmed for no family is `unknown`, its confidence being the
probability that the paragraph is a licence at all.

The scan runs in the JVM only. Words of the notices that carry weight are a fixed list. One such word makes
no notice (`mit` is German for with): a paragraph with fewer than two different ones is `none`, and a
document with fewer passes through with one test of its word array. Paragraphs with such words are stored with the ids; the weights (a row for each n-gram of the
notices) and the templates are tables whose sizes depend on the notices alone, and are broadcast.

Special cases: null and empty texts, and texts without a licensed paragraph, give family `none`,
confidence 0 and no paragraphs; of several families the one of the most confirmed paragraphs is the
document's, ties going to the name that sorts first, and `unknown` only where there is no other;
whole texts are read, however long; rows and ids repeat freely; extra columns may have any names; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import store

#: Licence notices by family (fixed texts).
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "SPDX-License-Identifier: BSD-3-Clause",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights and dedicated this work to the public domain.", "This is free and unencumbered software released into the public domain."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-3.0-or-later",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
            "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3.", "You can redistribute this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "This document is confidential and proprietary.", "Copyright. All rights reserved."],
}
#: Notices of licences that are no family here (fixed texts), for the unknown class.
OTHERS = [
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "SPDX-License-Identifier: EPL-2.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
    "Licensed under the Eclipse Public License.", "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.", "Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Zlib",
    "Licensed under the European Union Public Licence.", "This font software is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the Academic Free License version 3.0.",
    "Licensed under the PostgreSQL License.", "Do what the fuck you want to public license.", "This data is made available under the Open Database License.", "Use of this software is governed by the Business Source License.",
    "Licensed under the terms of the vendor's own licence agreement.", "Use and distribution are subject to the terms of the license agreement.", "This file is licensed under a custom license, see the terms.", "SPDX-License-Identifier: Custom",
]
#: Everyday sentences that share words with notices (fixed texts), for the none class.
EVERYDAY = [
    "He lost his driver license on the way to work.", "The public library is free for every person.", "They released the new version of the software last year.",
    "The general gave his permission to use the form.", "This file is part of the copy that you may obtain at work.", "A free program for the public was distributed in the domain of art.",
    "The terms of the work are written without conditions.", "She asked for permission to copy the general terms of the file.", "The version of the program that the university provides is open to every person.",
    "The software was written in Berlin and distributed on disks.", "He has a driving licence and a fishing license.", "Mozilla and Apache are names of projects.", "The foundation grants money to public schools.",
    "Damages were paid after the claim.", "A notice about the conditions stood above the door.", "The author of the source has rights.", "Commercial use of the land was granted by the state.", "Many people use this source of water.", "The foundation published a document about rights and law.",
]
#: Words too common to speak for a licence by themselves (fixed list).
COMMON = frozenset("a about above all an and any are as at be by can either except for from has have he his if in is it its last may must new no not of on or other part people person should such that the they this to under use used was way with work you your every year many art water do what so but which without will one own out see into more whether even along whom neither nor unless held want made name names kind possible s v".split())
UNKNOWN, NONE = "unknown", "none"
#: Different speaking words that a paragraph must have to be scored.
LEAST_WORDS = 2
#: Where paragraphs end: after a closing mark, at blank lines, and around SPDX lines.
BREAK = r"(?<=[.:;!?][\"')\]]?)[ \t]*[\r\n]+|(?:\r?\n|\r)[ \t]*(?:\r?\n|\r)\s*|[\r\n]+(?=\W*SPDX-License-Identifier)|(?<=SPDX-License-Identifier: ?\S{1,40})[ \t]*[\r\n]+"
_WORD = r"[^a-z0-9.\-]+"


def features(paragraph: str) -> list[str]:
    """Words and neighbouring pairs of a paragraph, as the expressions below give them."""
    w = [x for x in (re.sub(r"^[.\-]+|[.\-]+$", "", x) for x in re.split(_WORD, paragraph.lower())) if x]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


@lru_cache(maxsize=4)
def fit(seed: int = 3, rounds: int = 300, variants: int = 16) -> tuple[list[str], dict[str, np.ndarray], np.ndarray, float]:
    """Families (unknown and none last), weights of each n-gram, biases and temperature."""
    rng = np.random.default_rng(seed)
    families = [*sorted(TEMPLATES), UNKNOWN, NONE]
    notices = [(TEMPLATES.get(f, OTHERS if f == UNKNOWN else []), k) for k, f in enumerate(families)]
    texts = [t for ts, _ in notices for t in ts]
    every = sorted({w for t in texts for w in features(t) if " " not in w})
    # a feature speaks if it has a word that isn't common
    vocab = sorted({f for t in texts for f in features(t) if not set(f.split()) <= COMMON})
    at = {f: i for i, f in enumerate(vocab)}
    common = sorted(COMMON)

    def made(n: int, dropped: float) -> tuple[np.ndarray, np.ndarray]:
        said: list[tuple[str, int]] = []
        for ts, k in notices:
            for t in ts:
                said.append((t, k))
                w = t.split()
                for _ in range(n):
                    kept = [x for x in w if rng.random() > dropped]
                    frame = [str(rng.choice(common)) for _ in range(int(rng.integers(0, 6)))]
                    said.append((" ".join(frame + kept if rng.random() < 0.5 else kept + frame), k))
        none = len(families) - 1
        said += [(" ".join(map(str, rng.choice(every + 3 * common, int(rng.integers(3, 25))))), none) for _ in range(len(said) // 3)]
        said += [(" ".join(x for x in t.split() if rng.random() > 0.2), none) for t in EVERYDAY * n]
        x = np.zeros((len(said), len(vocab)), dtype=np.float32)
        for i, (t, _) in enumerate(said):
            x[i, [at[f] for f in set(features(t)) & at.keys()]] = 1
        return x, np.array([k for _, k in said])

    x, y = made(variants, 0.12)
    hot = np.eye(len(families), dtype=np.float32)[y]
    w, b = np.zeros((len(vocab), len(families)), np.float32), np.zeros(len(families), np.float32)
    gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - hot) / len(x)
        dw, db = x.T @ d + 1e-5 * w, d.sum(axis=0)
        gw += dw**2
        gb += db**2
        w -= 0.2 * dw / np.sqrt(gw)
        b -= 0.2 * db / np.sqrt(gb)
    x, y = made(6, 0.3)
    z = x @ w + b

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean())

    temperature = min((0.5 * 1.1**i for i in range(25)), key=loss)
    return families, {f: w[i].astype(float) for f, i in at.items()}, b.astype(float), temperature


def _words(paragraph: Column) -> Column:
    parts = F.transform(F.split(F.lower(paragraph), _WORD), lambda x: F.regexp_replace(x, r"^[.\-]+|[.\-]+$", ""))
    return F.filter(parts, lambda x: x != "")


def _grams(ws: Column) -> Column:
    """Distinct words and pairs of neighbours."""
    n = F.greatest(F.size(ws) - 1, F.lit(0))
    return F.array_distinct(F.concat(ws, F.zip_with(F.slice(ws, F.lit(1), n), F.slice(ws, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))))


def _speaking() -> list[str]:
    """Words that make a paragraph worth scoring: each n-gram of the model has at least one of them."""
    return sorted({w for f in fit()[1] for w in f.split() if w not in COMMON})


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """One row per document: id, family, confidence, n_paragraphs (of the family), n_licensed, families.

    least: probability that a family, or for `unknown` any licence, must have; overlap: share of one template's
    n-grams that a paragraph must hold.
    """
    spark = docs.sparkSession
    families, weights, bias, temperature = fit()
    k = len(families)
    table = F.broadcast(spark.createDataFrame([(f, [float(v) for v in w]) for f, w in sorted(weights.items())], "gram string, w array<double>"))
    templates = F.broadcast(spark.createDataFrame([(f, sorted(set(features(t)))) for f, ts in sorted(TEMPLATES.items()) for t in ts], "family string, template array<string>"))
    speaking = F.array(*map(F.lit, _speaking()))

    # words with dots or hyphens at their ends still speak: the test is on words as they are split, ends stripped by the pattern
    speaks = lambda c: F.size(F.array_intersect(F.split(F.lower(c), r"[.\-]*[^a-z0-9.\-]+[.\-]*|^[.\-]+|[.\-]+$"), speaking)) >= LEAST_WORDS
    paragraphs = F.filter(F.split(F.when(speaks(F.col(text_col)), F.col(text_col)), BREAK), speaks)
    base = store(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), paragraphs.alias("paragraphs")))
    each = base.where(F.size("paragraphs") > 0).select("row", F.posexplode("paragraphs").alias("pos", "paragraph"))
    each = each.select("row", "pos", F.explode(F.array(_words(F.col("paragraph")))).alias("ws"))  # a generator, so that words are split once
    each = each.select("row", "pos", _grams(F.col("ws")).alias("grams"))
    one = each.select("row", "pos", F.explode("grams").alias("gram")).join(table, "gram")
    part = one.groupBy("row", "pos").agg(*(F.sum(F.round(F.col("w")[i], 9)).alias(f"w{i}") for i in range(k)))
    part = part.withColumn("z", F.array(*((F.col(f"w{i}") + F.lit(float(bias[i]))) / F.lit(temperature) for i in range(k)))).select("row", "pos", "z")
    part = part.withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
    part = part.withColumn("p", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, x: a + x)))
    named = F.slice("p", 1, k - 2)
    part = part.select(
        "row", "pos", (1 - F.element_at("p", -1)).alias("licence"), F.array_max(named).alias("p"),
        F.element_at(F.array(*map(F.lit, families)), F.array_position(named, F.array_max(named)).cast("int")).alias("family"),
    ).where(F.col("licence") >= least)
    share = F.size(F.array_intersect("grams", "template")) / F.size("template")
    likely = part.where(F.col("p") >= least).join(each, ["row", "pos"]).join(templates, "family")
    sure = likely.groupBy("row", "pos").agg(F.max(share).alias("share")).where(F.col("share") >= overlap).select("row", "pos", F.lit(True).alias("sure"))
    found = part.join(sure, ["row", "pos"], "left").select("row", F.when(F.col("sure"), F.col("family")).otherwise(F.lit(UNKNOWN)).alias("family"), F.when(F.col("sure"), F.col("p")).otherwise(F.col("licence")).alias("p"))
    by_family = found.groupBy("row", "family").agg(F.count(F.lit(1)).alias("m"), F.max("p").alias("p"))
    place = F.struct((F.col("family") == UNKNOWN).alias("last"), (-F.col("m")).alias("m"), F.col("family").alias("family"), F.col("p").alias("p"))
    result = by_family.groupBy("row").agg(F.sum("m").alias("n_licensed"), F.array_sort(F.collect_list(place)).alias("found"))
    out = base.select("row", "id").join(result, "row", "left")
    first = F.try_element_at("found", F.lit(1))
    none = F.array().cast("array<string>")
    return out.select(
        F.col("id").alias(id_col), F.coalesce(first["family"], F.lit(NONE)).alias("family"), F.coalesce(first["p"], F.lit(0.0)).alias("confidence"),
        F.coalesce(-first["m"], F.lit(0).cast("long")).alias("n_paragraphs"), F.coalesce("n_licensed", F.lit(0).cast("long")).alias("n_licensed"),
        F.coalesce(F.array_sort(F.transform("found", lambda x: x["family"])), none).alias("families"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
