"""License scans: passages against licence templates by the Dice coefficient over word bigrams.

Passages are the lines of a text and, where several hold words, the text as a whole; where the whole does not match,
also runs of its words, in which a line that matched stands as one foreign word. So notices are found that are
wrapped over lines or stand inside a line. Passages and templates are lower-cased and everything but letters and
digits parts words. A template of s distinct bigrams can only reach the threshold t with passages of t/(2-t)*s to
(2-t)/t*s bigrams, of which t/(2-t)*s are its own; other templates are pruned by these bounds, and so are passages
and texts without enough bigrams of any template. Runs start at a bigram of the template and are no shorter than
it, so that none leaves out the words that tell two versions apart; of runs that share words the best counts.
Everything is a column expression on the row of the document: no shuffle, no join, no Python.

Null and empty texts, and texts without a match, give a row with no licence. Of equal scores the template that
comes first in TEMPLATES counts for a passage.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Notices as their stewards word them, and the usual one-line forms.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Proprietary", "All rights reserved."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

# The usual openings of one-line notices, and what follows them.
OPENINGS = ["Licensed under", "Released under", "Distributed under", "Available under", "Published under", "Provided under", "Covered by"]
NAMES = [
    ("Apache-2.0", "the Apache License, Version 2.0."), ("Apache-2.0", "the Apache License 2.0."), ("Apache-2.0", "the Apache 2.0 License."), ("MIT", "the MIT License."),
    ("GPL-2.0", "the GNU General Public License, version 2."), ("GPL-3.0", "the GNU General Public License, version 3."),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1."), ("LGPL-3.0", "the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "the BSD 2-Clause License."), ("BSD-3-Clause", "the BSD 3-Clause License."), ("MPL-2.0", "the Mozilla Public License, v. 2.0."), ("MPL-2.0", "the Mozilla Public License, version 2.0."),
    ("ISC", "the ISC License."), ("CC0-1.0", "CC0 1.0."), ("CC-BY-4.0", "CC BY 4.0."), ("CC-BY-SA-4.0", "CC BY-SA 4.0."), ("CC-BY-NC-4.0", "CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0."), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0."), ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0."), ("CC-BY-4.0", "a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License."), ("CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License."), ("CC-BY-NC-SA-4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
]
TEMPLATES += [t for t in ((n, f"{o} {x}") for o in OPENINGS for n, x in NAMES) if t not in TEMPLATES]


def template_bigrams(text: str) -> list[str]:
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def bounds(size: int, threshold: float = THRESHOLD) -> tuple[float, float]:
    """The sizes of sets that can reach the threshold with a set of this size; a hair wider, against rounding."""
    return threshold / (2 - threshold) * size - 1e-9, (2 - threshold) / threshold * size + 1e-9


def _words(passage: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}]+", " ")), " ")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _bigrams(words: Column) -> Column:
    return _let(words, lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))


def scan(documents: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_matches, licenses (sorted, joined by ";"), best_dice (6 places) and best_license of every row."""
    sets = [template_bigrams(t) for _, t in templates]
    runs = [len(re.sub(r"[\W_]+", " ", t.lower()).split()) - 1 for _, t in templates]  # bigrams with repeats
    every = sorted({b for s in sets for b in s})
    smallest = min(map(len, sets))
    least = bounds(smallest, threshold)[0]
    most = max(bounds(len(s), threshold)[1] for s in sets)
    # The parts fold to constants; a literal for each bigram would be walked by every rule of the optimizer.
    numbers = lambda values: F.split(F.lit(",".join(map(repr, values))), ",")
    limits = [bounds(len(s), threshold) for s in sets]
    known = F.arrays_zip(
        numbers(range(len(sets))), numbers(map(len, sets)), numbers(lo for lo, _ in limits), numbers(hi for _, hi in limits), numbers(runs),
        numbers(int(bounds(n, threshold)[1]) for n in runs), F.array(*[F.split(F.lit(";".join(s)), ";") for s in sets]),
    ).cast("array<struct<i:int,size:int,lo:double,hi:double,run:int,longest:int,bigrams:array<string>>>")
    names = F.split(F.lit(";".join(n for n, _ in templates)), ";")

    def dice(b: Column, t: Column) -> Column:
        return F.lit(2.0) * F.size(F.array_intersect(b, t["bigrams"])) / (F.size(b) + t["size"])

    def fitting(b: Column) -> Column:
        fits = F.filter(known, lambda t: (t["lo"] <= F.size(b)) & (F.size(b) <= t["hi"]))
        top = F.array_max(F.transform(fits, lambda t: F.struct(dice(b, t).alias("dice"), (-t["i"]).alias("minus"))))
        shared = F.size(F.filter(b, lambda x: x.isin(every)))
        return F.when((F.size(b) <= most) & (shared >= threshold / 2 * (F.size(b) + smallest) - 1e-9), top)

    def best(w: Column) -> Column:
        """The best template of a passage's words, or null. Repeats only make a set smaller, so the lower bound holds for the word count."""
        found = F.when((F.size(w) - 1 >= least) & (F.size(F.array_distinct(w)) - 1 <= most), _let(F.array_distinct(_bigrams(w)), fitting))
        return _let(found, lambda s: F.when(s["dice"] >= threshold, s))

    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = documents.select("doc_id", F.transform(lines, _words).alias("lines"))
    rows = rows.select("doc_id", F.filter("lines", lambda w: F.element_at(w, 1) != "").alias("lines"))
    rows = rows.select("doc_id", "lines", F.transform("lines", best).alias("hits"), F.when(F.size("lines") > 1, _let(F.flatten("lines"), best)).alias("whole"))
    rest = F.flatten(F.zip_with("lines", "hits", lambda w, s: F.when(s.isNull(), w).otherwise(F.array(F.lit("\0")))))
    rows = rows.select("doc_id", "hits", "whole", F.when(F.col("whole").isNull(), _bigrams(rest)).alias("b"))
    # The places in the text (from 0) of bigrams that any template has.
    places = F.filter(F.transform("b", lambda x, i: F.when(x.isin(every), F.struct(i.alias("at"), x.alias("x")))), lambda p: p.isNotNull())
    rows = rows.select("doc_id", "hits", "whole", "b", places.alias("places"))
    rows = rows.select("doc_id", "hits", "whole", "b", "places", F.array_distinct("places.x").alias("own"))
    possible = F.when(F.size("own") >= least, F.filter(known, lambda t: F.size(F.array_intersect("own", t["bigrams"])) >= t["lo"]))

    def of_template(t: Column) -> Column:
        at = F.transform(F.filter("places", lambda p: F.array_contains(t["bigrams"], p["x"])), lambda p: p["at"])

        def from_start(t: Column, at: Column, a: Column, i: Column) -> Column:
            # Places are in order and apart, so a run's are among the next `longest` ones: work grows with the text alone.
            within = F.filter(F.slice(at, i + 1, t["longest"]), lambda e: e < a + t["longest"])
            ends = F.concat(F.array(F.least(a + t["run"], F.size("b")) - 1), F.filter(within, lambda e: e >= a + t["run"]))
            run = lambda e: F.array_distinct(F.slice("b", a + 1, e - a + 1))
            return F.when(
                F.get(at, i + F.ceil(t["lo"]).cast("int") - 1) < a + t["longest"],  # as many places as the lower bound asks for
                F.transform(ends, lambda e: F.struct(dice(run(e), t).alias("dice"), (-t["i"]).alias("minus"), (-a).alias("start"), (-e).alias("end"))),
            ).otherwise(F.array())

        return F.flatten(_let(at, lambda at: F.transform(at, lambda a, i: from_start(t, at, a, i))))

    rows = rows.select("doc_id", "hits", "whole", F.reverse(F.array_sort(F.filter(F.flatten(F.transform(possible, of_template)), lambda s: s["dice"] >= threshold))).alias("runs"))
    # Of runs that share words the best stays; start and end are negative places of bigrams, which reach one word further.
    apart = lambda s, kept: ~F.exists(kept, lambda k: (s["start"] >= k["end"] - 1) & (k["start"] >= s["end"] - 1))
    runs_kept = F.aggregate("runs", F.slice("runs", 1, 0), lambda kept, s: F.when(apart(s, kept), F.concat(kept, F.array(s))).otherwise(kept))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["dice"].alias("dice"), s["minus"].alias("minus")))
    hits = F.filter(F.concat("hits", F.array("whole"), F.coalesce(plain(runs_kept), F.array().cast("array<struct<dice:double,minus:int>>"))), lambda s: s.isNotNull())
    found = rows.select("doc_id", hits.alias("hits"))
    name = lambda s: F.element_at(names, (F.lit(1) - s["minus"]).cast("int"))
    top = F.array_max("hits")
    return found.select(
        "doc_id", F.size("hits").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", name))), ";").alias("licenses"),
        F.round(top["dice"], 6).alias("best_dice"), F.when(F.size("hits") > 0, name(top)).alias("best_license"),
    )


def oracle() -> str:
    """The scan in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    bigrams = lambda w: f"list_transform(range(1, len({w})), lambda j: {w}[j] || ' ' || {w}[j + 1])"
    rows = []
    for i, (name, text) in enumerate(TEMPLATES):
        found, run = template_bigrams(text), len(re.sub(r"[\W_]+", " ", text.lower()).split()) - 1
        rows.append(f"({i}, {quote(name)}, [{', '.join(map(quote, found))}], {run}, {int(bounds(run)[1])})")
    fits = f"len(b) * (2 - {THRESHOLD}) >= {THRESHOLD} * len(bigrams) AND len(bigrams) * (2 - {THRESHOLD}) >= {THRESHOLD} * len(b)"
    return f"""
WITH templates(i, name, bigrams, run, longest) AS (VALUES {', '.join(rows)}),
texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT r, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM texts),
lines AS MATERIALIZED (SELECT r, k, string_split(trim(regexp_replace(lower(p), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM cut WHERE regexp_matches(p, '[\\p{{L}}\\p{{N}}]')),
passages AS (SELECT r, k, w FROM lines UNION ALL SELECT r, 0, flatten(list(w ORDER BY k)) FROM lines GROUP BY r HAVING count(*) > 1),
sets AS (SELECT r, k, list_distinct({bigrams('w')}) AS b FROM passages WHERE len(w) > 1),
scored AS (SELECT r, k, i, name, 2.0 * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) AS dice FROM sets, templates WHERE {fits}),
best AS MATERIALIZED (SELECT r, k, i, name, dice FROM scored WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY dice DESC, i) = 1),
rest AS (SELECT r, flatten(list(CASE WHEN i IS NULL THEN w ELSE [chr(0)] END ORDER BY k)) AS w FROM lines LEFT JOIN best USING (r, k) WHERE r NOT IN (SELECT r FROM best WHERE k = 0) GROUP BY r),
runs_of AS MATERIALIZED (SELECT r, {bigrams('w')} AS b FROM rest),
places AS MATERIALIZED (SELECT r, i, x, pos FROM (SELECT r, unnest(b) AS x, generate_subscripts(b, 1) AS pos FROM runs_of) JOIN (SELECT i, unnest(bigrams) AS x FROM templates) USING (x)),
possible AS MATERIALIZED (SELECT r, i, pos FROM places SEMI JOIN (SELECT r, i FROM places JOIN templates USING (i) GROUP BY r, i HAVING count(DISTINCT x) * (2 - {THRESHOLD}) >= {THRESHOLD} * any_value(len(bigrams)) - 1e-9) USING (r, i)),
within AS MATERIALIZED (SELECT r, i, s.pos AS a, e.pos AS e FROM possible s JOIN templates USING (i) JOIN possible e USING (r, i) WHERE e.pos >= s.pos AND e.pos < s.pos + longest),
dense AS (SELECT r, i, a FROM within JOIN templates USING (i) GROUP BY r, i, a HAVING count(*) * (2 - {THRESHOLD}) >= {THRESHOLD} * any_value(len(bigrams)) - 1e-9),
spans AS (SELECT r, i, a, least(a + run, len(b) + 1) - 1 AS e FROM dense JOIN templates USING (i) JOIN runs_of USING (r)
          UNION ALL SELECT r, i, a, e FROM within JOIN dense USING (r, i, a) JOIN templates USING (i) WHERE e >= a + run),
measured AS (SELECT r, i, a, e, 2.0 * len(list_intersect(list_distinct(b[a:e]), bigrams)) / (len(list_distinct(b[a:e])) + len(bigrams)) AS dice FROM spans JOIN runs_of USING (r) JOIN templates USING (i)),
greedy AS (SELECT r, list_reduce(list([{{'i': i, 'a': a, 'e': e, 'dice': dice}}] ORDER BY dice DESC, i, a, e),
           lambda kept, s: CASE WHEN len(list_filter(kept, lambda q: s[1].a <= q.e + 1 AND q.a <= s[1].e + 1)) = 0 THEN list_concat(kept, s) ELSE kept END) AS kept FROM measured WHERE dice >= {THRESHOLD} GROUP BY r),
hits AS (SELECT r, i, dice FROM best UNION ALL SELECT r, h.i, h.dice FROM (SELECT r, unnest(kept) AS h FROM greedy)),
docs AS (SELECT r, count(*) AS n, array_to_string(list_sort(list_distinct(list(name))), ';') AS names, max(dice) AS top, first(name ORDER BY dice DESC, i) AS top_name FROM hits JOIN templates USING (i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(names, '') AS licenses, round(top, 6) AS best_dice, top_name AS best_license
FROM texts LEFT JOIN docs USING (r)"""
