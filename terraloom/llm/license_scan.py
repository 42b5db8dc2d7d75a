"""License notices in texts: MinHash bands over text windows retrieve templates, exact shingle containment verifies.

Texts and templates become lower-case words of letters and digits, and five-word shingles. A template of T words belongs
to the smallest tier whose window of W words is at least 2 (T - 1): windows start every W / 2 words, so that any T words
in a row lie whole in one of them, and of that window's shingles the template's make up at least a fixed share. With one
hash a band, the number of bands is the least for which a window with ``threshold`` of the template's shingles shares a
band with it with a probability of ``recall`` or more. Windows and templates are joined by (tier, band, value); what
they retrieve is verified by the exact containment of the template's shingles in the window.

Of a template, the bands keep one shingle each: the one with the least hash. A window can share a band with a template
only if it holds that shingle, so windows without any such shingle need no bands: the test against these few shingles is
the band join's own condition, made where the window is. They are a literal of the plan; templates with more than
``MAX_KEYS`` of them in all are scanned in blocks, each a pass over the texts, so that any number of templates of any
length can be given.

Only DataFrame functions are used. Defined results: null, empty and one-word texts have no match; a null doc_id is kept;
repeated rows are separate rows with equal results; templates of fewer than five words are refused; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, window_hashes

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Band shingles that one pass over the texts looks for.
MAX_KEYS = 20_000
#: Public license texts and notices (fixed values).
TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit": "Released under the MIT License",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "wtfpl-terms": "TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO",
}


def license_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def tier_of(n_words: int) -> int:
    window = 8
    while window < 2 * (n_words - 1):
        window *= 2
    return window


def bands_of(n_words: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The least number of one-hash bands for the guarantee, from the smallest Jaccard similarity that a verified pair has."""
    shared = math.ceil(threshold * (n_words - SHINGLE + 1))
    union = tier_of(n_words) - SHINGLE + 1 + (n_words - SHINGLE + 1) - shared
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(shared / union, 1 - 1e-9))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, n (words), shingles (distinct hashes)."""
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    return rows.select("license", license_words(F.col("text")).alias("w")).select("license", F.size("w").alias("n"), F.array_distinct(window_hashes(F.col("w"), SHINGLE)).alias("shingles"))


def band_minima(shingles: Column, bands: Column) -> Column:
    """Of each band the least hash, with the shingle that has it: an array of struct(value, shingle)."""
    return F.transform(F.sequence(F.lit(1), bands), lambda j: F.array_min(F.transform(shingles, lambda s: F.struct(F.xxhash64(s, j).alias("value"), s.alias("shingle")))))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, recall: float = RECALL, max_keys: int = MAX_KEYS) -> DataFrame:
    """One row per document row and license found: doc_id, license, n_windows (verified), containment (the best),
    first_word (where the first verified window starts, in words)."""
    templates = templates or TEMPLATES
    sizes = {r["license"]: r["n"] for r in template_table(docs.sparkSession, templates).select("license", "n").collect()}
    if short := [name for name, n in sizes.items() if n < SHINGLE]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    out, block, keys = None, {}, 0
    for name, text in sorted(templates.items(), key=lambda x: tier_of(sizes[x[0]])):
        bands = bands_of(sizes[name], threshold, recall)
        if block and keys + bands > max_keys:
            part = _scan_block(docs, block, sizes, threshold, recall)
            out, block, keys = part if out is None else out.unionByName(part), {}, 0
        block[name] = text
        keys += bands
    part = _scan_block(docs, block, sizes, threshold, recall)
    return part if out is None else out.unionByName(part)


def _scan_block(docs: DataFrame, templates: dict[str, str], sizes: dict[str, int], threshold: float, recall: float) -> DataFrame:
    spark = docs.sparkSession
    tiers: dict[int, int] = {}
    for name in templates:
        tier = tier_of(sizes[name])
        tiers[tier] = max(tiers.get(tier, 0), bands_of(sizes[name], threshold, recall))
    placed = spark.createDataFrame([(name, tier_of(sizes[name]), tiers[tier_of(sizes[name])]) for name in templates], "license string, tier int, bands int")
    table = template_table(spark, templates).join(placed, "license")
    index = table.select("license", "tier", F.posexplode(band_minima(F.col("shingles"), F.col("bands"))).alias("band", "x")).select("license", "tier", "band", "x.*")
    # One shingle per band and template is collected to become a literal, within the block's bound.
    keys = sorted({r["shingle"] for r in index.select("shingle").collect()})
    holds = lambda shingles: F.exists(shingles, lambda x: x.isin(*keys))
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), let(license_words(F.col("text")), lambda w: F.when(F.size(w) >= SHINGLE, window_hashes(w, SHINGLE))).alias("s"))
    texts = texts.where(holds("s"))

    def windows(tier: int, bands: int) -> Column:
        wide = tier - SHINGLE + 1
        starts = F.sequence(F.lit(0), F.greatest(F.size("s") - wide + tier // 2 - 1, F.lit(0)), F.lit(tier // 2))
        cut = F.transform(starts, lambda i: F.struct(F.lit(tier).alias("tier"), F.lit(bands).alias("bands"), i.alias("at"), F.slice("s", i + 1, wide).alias("w")))
        return F.filter(cut, lambda x: holds(x["w"]))

    found = texts.select("doc_id", "row", F.explode(F.concat(*(windows(t, b) for t, b in tiers.items()))).alias("x")).select("doc_id", "row", "x.*")
    banded = found.select("doc_id", "row", "tier", "at", "w", F.posexplode(band_minima(F.col("w"), F.col("bands"))).alias("band", "x")).select("doc_id", "row", "tier", "at", "w", "band", "x.value")
    pairs = banded.join(F.broadcast(index.select("license", "tier", "band", "value")), ["tier", "band", "value"]).groupBy("row", "at", "tier", "license").agg(F.first("doc_id").alias("doc_id"), F.first("w").alias("w"))
    held = pairs.join(table.select("license", "shingles"), "license").withColumn("containment", F.size(F.array_intersect("w", "shingles")) / F.size("shingles")).where(F.col("containment") >= threshold)
    return held.groupBy("row", "license").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n_windows"), F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word")).drop("row")


def query(documents: DataFrame) -> DataFrame:
    found = scan_licenses(documents)
    return found.select("doc_id", "license", F.round("containment", 6).alias("containment"))
