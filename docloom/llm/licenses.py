"""License scans: ordered signature rules over normalised words; DataFrame functions only.

Texts are lower-cased and reduced to words between single spaces, so rules need not mind punctuation or line ends. A
rule is a regular expression with a keyword that all its matches have, a priority and a confidence. A text that has none
of the keywords, `GATE`, is no candidate; on candidates only rules whose keyword occurs run. Each match is a span of words. A span that
lies in another one of at least its priority is suppressed: the longer wins, then the higher priority, then the earlier
rule. Nothing is shuffled: a row is scanned where it is read.

Rules are signatures of license texts and notices, written one by one, and forms of reference to license families,
several hundred in all, in order of priority.

Nulls and edges: null text is empty, has no words and no labels; labels are distinct and sorted; repeated rows and null
ids are rows like others; texts of any length are scanned whole, and the search for what suppresses a detection stays
within `NEAR` words of it, which no rule's match reaches across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: The phrases and labels of the base scan.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Label, alternatives of the name (words between single spaces) with a keyword that each necessarily has,
#: SPDX identifier as words.
FAMILIES = (
    ("mit", (("mit", "mit"),), "mit"),
    ("mit-0", (("mit", "mit no attribution"),), "mit 0"),
    ("apache-2", (("apache", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),), "apache 2 0"),
    ("apache-1.1", (("apache", "apache(?: software)?(?: license)?(?: version)? 1 1"),), "apache 1 1"),
    ("apache-1", (("apache", "apache(?: software)?(?: license)?(?: version)? 1 0"),), "apache 1 0"),
    ("bsd-2-clause", (("bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)"), ("freebsd", "freebsd")), "bsd 2 clause"),
    ("bsd-3-clause", (("bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)"),), "bsd 3 clause"),
    ("bsd-4-clause", (("bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),), "bsd 4 clause"),
    ("0bsd", (("bsd", "(?:zero clause bsd|bsd zero clause)"), ("0bsd", "0bsd")), "0bsd"),
    ("bsd", (("bsd", "bsd(?: style)?"),), "bsd"),
    ("gpl-2", (("gpl", "gpl ?v?2(?: 0)?"), ("gnu general public", "gnu general public license(?: version| v)? ?2(?: 0)?")), "gpl 2 0(?: only| or later)?"),
    ("gpl-3", (("gpl", "gpl ?v?3(?: 0)?"), ("gnu general public", "gnu general public license(?: version| v)? ?3(?: 0)?")), "gpl 3 0(?: only| or later)?"),
    ("gpl", (("gpl", "gpl"), ("gnu general public", "gnu general public")), "gpl"),
    ("lgpl-2.1", (("lgpl", "lgpl ?v?2 1"), ("gnu lesser general public", "gnu lesser general public license(?: version| v)? ?2 1")), "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", (("lgpl", "lgpl ?v?3(?: 0)?"), ("gnu lesser general public", "gnu lesser general public license(?: version| v)? ?3(?: 0)?")), "lgpl 3 0(?: only| or later)?"),
    ("lgpl", (("lgpl", "lgpl"), ("gnu lesser general public", "gnu lesser general public"), ("gnu library general public", "gnu library general public")), "lgpl"),
    ("agpl-3", (("agpl", "agpl ?v?3(?: 0)?"), ("gnu affero general public", "gnu affero general public license(?: version| v)? ?3(?: 0)?")), "agpl 3 0(?: only| or later)?"),
    ("agpl", (("agpl", "agpl"), ("gnu affero general public", "gnu affero general public")), "agpl"),
    ("mpl-2", (("mpl", "mpl ?2(?: 0)?"), ("mozilla public license", "mozilla public license(?: version| v)? ?2(?: 0)?")), "mpl 2 0"),
    ("mpl-1.1", (("mpl", "mpl ?1 1"), ("mozilla public license", "mozilla public license(?: version| v)? ?1 1")), "mpl 1 1"),
    ("epl-2", (("epl", "epl ?2(?: 0)?"), ("eclipse public license", "eclipse public license(?: version| v)? ?2(?: 0)?")), "epl 2 0"),
    ("epl-1", (("epl", "epl ?1(?: 0)?"), ("eclipse public license", "eclipse public license(?: version| v)? ?1(?: 0)?")), "epl 1 0"),
    ("cddl-1", (("cddl", "cddl(?: 1 0)?"), ("common development", "common development and distribution")), "cddl 1 0"),
    ("cpl-1", (("common public license", "common public license(?: version)?(?: 1 0)?"),), "cpl 1 0"),
    ("eupl-1.2", (("eupl", "eupl(?: v)?(?: 1 2)?"), ("european union public", "european union public")), "eupl 1 2"),
    ("isc", (("isc", "isc"),), "isc"),
    ("zlib", (("zlib", "zlib(?: libpng)?"),), "zlib"),
    ("unlicense", (("unlicense", "unlicense"),), "unlicense"),
    ("wtfpl", (("wtfpl", "wtfpl"),), "wtfpl"),
    ("bsl-1", (("boost software license", "boost software license(?: version)?(?: 1 0)?"),), "bsl 1 0"),
    ("artistic-2", (("artistic", "artistic license(?: version)? 2(?: 0)?"),), "artistic 2 0"),
    ("artistic", (("artistic", "artistic"),), "artistic 1 0"),
    ("python-2", (("python software foundation", "python software foundation(?: license)?(?: version 2)?"), ("psf", "psf(?: license)?(?: version 2)?")), "(?:psf|python) 2 0"),
    ("ruby", (("ruby", "ruby"),), "ruby"),
    ("php-3", (("php license", "php license(?: version)? 3(?: 0| 01)?"),), "php 3 01"),
    ("openssl", (("openssl", "openssl"),), "openssl"),
    ("postgresql", (("postgresql", "postgresql"),), "postgresql"),
    ("ofl-1.1", (("open font license", "(?:sil )?open font license(?: version)?(?: 1 1)?"),), "ofl 1 1"),
    ("ms-pl", (("microsoft public", "microsoft public"),), "ms pl"),
    ("ms-rl", (("microsoft reciprocal", "microsoft reciprocal"),), "ms rl"),
    ("ncsa", (("ncsa", "(?:university of illinois )?ncsa(?: open source)?"),), "ncsa"),
    ("odbl", (("odbl", "odbl"), ("open database", "open database")), "odbl 1 0"),
    ("odc-by", (("open data commons attribution", "open data commons attribution"),), "odc by 1 0"),
    ("pddl", (("pddl", "pddl"), ("public domain dedication", "public domain dedication and")), "pddl 1 0"),
    ("gfdl", (("gnu free documentation", "gnu free documentation"),), "gfdl 1 [123](?: only| or later)?"),
    ("cc0", (("cc0", "cc0(?: 1 0)?(?: universal)?"), ("creative commons zero", "creative commons zero(?: 1 0)?(?: universal)?")), "cc0 1 0"),
    ("cc-by-nc-nd", (("cc by", "cc by nc nd(?: [1-4] [05])?"), ("creative commons attribution", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?")), "cc by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", (("cc by", "cc by nc sa(?: [1-4] [05])?"), ("creative commons attribution", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?")), "cc by nc sa [1-4] [05]"),
    ("cc-by-nc", (("cc by", "cc by nc(?: [1-4] [05])?"), ("creative commons attribution", "creative commons attribution non ?commercial(?: [1-4] [05])?")), "cc by nc [1-4] [05]"),
    ("cc-by-nd", (("cc by", "cc by nd(?: [1-4] [05])?"), ("creative commons attribution", "creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?")), "cc by nd [1-4] [05]"),
    ("cc-by-sa", (("cc by", "cc by sa(?: [1-4] [05])?"), ("creative commons attribution", "creative commons attribution share ?alike(?: [1-4] [05])?")), "cc by sa [1-4] [05]"),
    ("cc-by", (("cc by", "cc by(?: [1-4] [05])?"), ("creative commons attribution", "creative commons attribution(?: [1-4] [05])?")), "cc by [1-4] [05]"),
    ("public-domain", (("public domain", "public domain"),), "public domain"),
    ("proprietary", (("proprietary", "proprietary"),), "licenseref proprietary"),
)
#: Fixed value: what every tag begins with, the keyword of its rules.
TAG = "spdx license identifier"
#: Name, expression, priority, confidence of each form in which a family is referred to.
FORMS = (
    ("tag", f"{TAG} {{id}}", 50, 1.0),
    ("grant", "(?:licen[sc]ed|released|distributed|available|published|provided|covered|offered|shared) under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[sc]e)?", 40, 0.95),
    ("terms", "(?:subject to|governed by|in compliance with|according to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: licen[sc]e)?", 35, 0.9),
    ("under", "under (?:the |an? )?{name} licen[sc]e", 30, 0.9),
    ("copy", "(?:copy of|see|read) (?:the )?{name} licen[sc]e", 20, 0.8),
    ("label", "licen[sc]e {name}", 15, 0.7),
    ("name", "{name} licen[sc]e", 10, 0.6),
)
#: Signatures of license texts and notices: label, keyword, expression, priority, confidence.
TEXTS = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 60, 0.98),
    ("mit", "substantial portions", "copyright notice and this permission notice shall be included in all copies or substantial portions", 58, 0.95),
    ("mit", "without warranty of any kind", "the software is provided as is without warranty of any kind express or implied", 50, 0.85),
    ("x11", "x consortium", "name of the x consortium shall not be used in advertising", 60, 0.95),
    ("isc", "permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 60, 0.98),
    ("0bsd", "permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided", 62, 0.9),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms(?: of)? with or without modification are permitted", 60, 0.95),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions", 58, 0.95),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice", 58, 0.95),
    ("bsd-3-clause", "endorse or promote", "neither the name of(?: [a-z0-9]+){1,8} nor the names of its contributors may be used to endorse or promote products", 61, 0.97),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display", 61, 0.97),
    ("apache-2", "limitations under the license", "see the license for the specific language governing permissions and limitations under the license", 55, 0.9),
    ("apache-2", "you may not use this file", "you may not use this file except in compliance with the license", 55, 0.9),
    ("apache-2", "apache org", "apache org licenses license 2 0", 56, 0.98),
    ("apache-2", "terms and conditions for use", "terms and conditions for use reproduction and distribution", 54, 0.85),
    ("gpl", "you can redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 60, 0.98),
    ("gpl", "gnu general public license", "received a copy of the gnu general public license along with", 58, 0.98),
    ("gpl-2", "either version 2", "gnu general public license as published by the free software foundation either version 2 of the license", 62, 0.98),
    ("gpl-3", "either version 3", "gnu general public license as published by the free software foundation either version 3 of the license", 62, 0.98),
    ("lgpl", "you can redistribute", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 60, 0.98),
    ("lgpl-2.1", "either version 2 1", "gnu lesser general public license as published by the free software foundation either version 2 1", 62, 0.98),
    ("lgpl-3", "either version 3", "gnu lesser general public license as published by the free software foundation either version 3", 62, 0.98),
    ("agpl-3", "either version 3", "gnu affero general public license as published by the free software foundation either version 3", 62, 0.98),
    ("agpl", "you can redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license", 60, 0.98),
    ("gfdl", "copy distribute and or modify", "copy distribute and or modify this document under the terms of the gnu free documentation license", 60, 0.98),
    ("mpl-2", "source code form is subject", "this source code form is subject to the terms of the mozilla public license v 2 0", 62, 0.99),
    ("mpl-1.1", "contents of this file", "the contents of this file are subject to the mozilla public license version 1 1", 62, 0.99),
    ("epl-2", "accompanying materials", "accompanying materials are made available under the terms of the eclipse public license 2 0", 62, 0.99),
    ("epl-1", "accompanying materials", "accompanying materials are made available under the terms of the eclipse public license v1 0", 62, 0.99),
    ("cddl-1", "contents of this file", "the contents of this file are subject to the terms of the common development and distribution license", 62, 0.99),
    ("eupl-1.2", "european union public", "licensed under the european union public licence v 1 2", 62, 0.98),
    ("zlib", "as is without any express", "this software is provided as is without any express or implied warranty", 55, 0.85),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 60, 0.97),
    ("libpng", "contributing authors", "libpng the contributing authors and", 55, 0.85),
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain", 62, 0.99),
    ("wtfpl", "do what the fuck", "do what the fuck you want to public license", 62, 0.99),
    ("bsl-1", "boost", "distributed under the boost software license version 1 0", 62, 0.99),
    ("artistic-2", "artistic", "the artistic license 2 0", 55, 0.95),
    ("python-2", "psf is making python", "psf is making python available to licensee on an as is basis", 60, 0.97),
    ("ruby", "same terms as ruby", "under the same terms as ruby itself", 55, 0.95),
    ("perl", "same terms as perl", "under the same terms as perl itself", 55, 0.95),
    ("php-3", "php software", "this product includes php software", 55, 0.95),
    ("openssl", "openssl project", "software developed by the openssl project for use in the openssl toolkit", 60, 0.97),
    ("postgresql", "postgresql", "permission to use copy modify and distribute postgresql", 58, 0.9),
    ("ofl-1.1", "sil open font", "this font software is licensed under the sil open font license version 1 1", 62, 0.99),
    ("ofl-1.1", "reserved font name", "with reserved font name", 50, 0.9),
    ("cc0", "to the extent possible under law", "to the extent possible under law(?: [a-z0-9]+){1,8} has waived all copyright and related or neighboring rights", 62, 0.98),
    ("cc0", "creativecommons org", "creativecommons org publicdomain zero 1 0", 62, 0.99),
    ("cc-by-nc-nd", "creativecommons org", "creativecommons org licenses by nc nd [1-4] [05]", 62, 0.99),
    ("cc-by-nc-sa", "creativecommons org", "creativecommons org licenses by nc sa [1-4] [05]", 62, 0.99),
    ("cc-by-nc", "creativecommons org", "creativecommons org licenses by nc [1-4] [05]", 61, 0.99),
    ("cc-by-nd", "creativecommons org", "creativecommons org licenses by nd [1-4] [05]", 61, 0.99),
    ("cc-by-sa", "creativecommons org", "creativecommons org licenses by sa [1-4] [05]", 61, 0.99),
    ("cc-by", "creativecommons org", "creativecommons org licenses by [1-4] [05]", 60, 0.99),
    ("odbl", "open database license", "made available under the open database license", 60, 0.98),
    ("public-domain", "dedicated", "dedicated to the public domain", 45, 0.9),
    ("public-domain", "in the public domain", "(?:is|are) in the public domain", 45, 0.8),
    ("public-domain", "no copyright", "(?:has|have) no copyright", 30, 0.6),
    ("cc-by-nc", "cc by", "cc by nc(?: [1-4] [05])?", 25, 0.8),
    ("beerware", "beer ware", "beer ware license", 50, 0.95),
    ("json", "good not evil", "the software shall be used for good not evil", 62, 0.99),
    ("elastic-2", "elastic license", "elastic license(?: version)? 2(?: 0)?", 50, 0.95),
    ("sspl-1", "server side public license", "server side public license(?: version)?(?: 1)?", 50, 0.95),
    ("busl-1.1", "business source license", "business source license(?: 1 1)?", 50, 0.95),
    ("commons-clause", "commons clause", "commons clause license condition", 50, 0.95),
    ("proprietary", "proprietary and confidential", "(?:is |are )?proprietary and confidential", 40, 0.8),
    ("proprietary", "strictly prohibited", "unauthorized (?:copying|reproduction|use|distribution)(?: [a-z]+){0,6} is strictly prohibited", 40, 0.8),
    ("proprietary", "may not be reproduced", "may not be reproduced(?: [a-z]+){0,8} without(?: the)?(?: prior)?(?: express)?(?: written)? (?:permission|consent)", 35, 0.7),
    ("proprietary", "reserved", "all rights reserved", 5, 0.5),
)
NEAR, BLOCK = 64, 4096


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, expression, priority, confidence) in order."""
    made = []
    for _, form, rank, sure in FORMS:
        for label, names, spdx in FAMILIES:
            if "{id}" in form:
                made.append((label, TAG, form.format(id=spdx), rank, sure))
            else:
                made += [(label, key, form.format(name=name), rank, sure) for key, name in names]
    return sorted([*TEXTS, *made], key=lambda r: -r[3])


#: Each match of a rule has its keyword at the beginning of a word: a text without all of these has no match.
GATE = tuple(sorted({f" {key}" for _, key, *_ in rules()}))


def normal(text: Column) -> Column:
    """' word word ' of the lower-cased text; ' ' where there is no word."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def detections(words: Column, keys: Column) -> Column:
    """Every rule's matches in words, which have the keywords `keys` of GATE: array of label, first, stop (words, from 0), priority, confidence, rule."""
    table = rules()
    sql = ", ".join(f"named_struct('rule', {i}, 'label', '{a}', 'key', ' {k}', 'form', ' {f}(?= )', 'rank', {p}, 'sure', {s}D)" for i, (a, k, f, p, s) in enumerate(table))
    known = F.filter(F.expr(f"array({sql})"), lambda r: F.array_contains(keys, r["key"]))

    def matched(r: Column) -> Column:
        # Matches are set off by marks that no text has in its words; then a word's place is its index.
        each = F.split(F.regexp_replace(words, F.concat(F.lit("( )("), F.substr(r["form"], F.lit(2), F.length(r["form"]) - 6), F.lit(")(?= )")), F.lit("$1\x01$2\x02")), " ")
        first = F.filter(F.transform(each, lambda w, i: F.when(F.startswith(w, F.lit("\x01")), i - 1)), lambda x: x.isNotNull())
        last = F.filter(F.transform(each, lambda w, i: F.when(F.endswith(w, F.lit("\x02")), i)), lambda x: x.isNotNull())
        return F.zip_with(first, last, lambda a, z: F.struct(r["label"].alias("label"), a.alias("first"), z.alias("stop"), r["rank"].alias("rank"), r["sure"].alias("sure"), r["rule"].alias("rule")))

    return F.flatten(F.transform(F.filter(known, lambda r: F.rlike(words, r["form"])), matched))


def kept(found: Column) -> Column:
    """The detections that no other suppresses."""

    def over(d: Column, o: Column) -> Column:
        inside = (o["first"] <= d["first"]) & (o["stop"] >= d["stop"]) & (o["rank"] >= d["rank"])
        longer = (o["stop"] - o["first"]) > (d["stop"] - d["first"])
        return inside & (longer | (o["rank"] > d["rank"]) | (o["rule"] < d["rule"]))

    def among(some: Column, others: Column) -> Column:
        return F.filter(some, lambda d: ~F.exists(others, lambda o: over(d, o)))

    def block(b: Column) -> Column:
        near = F.filter(found, lambda o: (o["first"] >= b * BLOCK - NEAR) & (o["first"] < (b + 1) * BLOCK + NEAR))
        own = lambda near: among(F.filter(near, lambda d: F.floor(d["first"] / BLOCK) == b), near)
        return F.element_at(F.transform(F.array(near), own), 1)

    blocks = F.array_sort(F.array_distinct(F.transform(found, lambda d: F.floor(d["first"] / BLOCK))))
    return F.when(F.size(found) <= 100, among(found, found)).otherwise(F.flatten(F.transform(blocks, block)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (the detections kept) of each text.

    score is the highest confidence of what is found: 0 where nothing is, 0.9 at least where a base phrase is.
    """
    words = F.col("__words")
    out = docs.select(F.col(id_col).alias("__id"), normal(F.col(text_col)).alias("__words"))
    base = []
    for phrase, label in BASE:
        k = len(phrase.split())
        between = F.transform(F.split(words, f" {phrase}(?= )"), spaces)
        n = F.size(between) - 1
        last = F.aggregate(F.slice(between, 1, n), F.lit(0), lambda a, b: a + b) + (n - 1) * k
        base.append(F.when(F.contains(words, F.lit(f" {phrase} ")), F.struct(n.alias("n"), F.element_at(between, 1).alias("first"), last.alias("last"), F.lit(label).alias("label"))))
    out = out.withColumn("__base", F.array_compact(F.array(*base)))
    keys = F.array_compact(F.array(*[F.when(F.contains(words, F.lit(g)), F.lit(g)) for g in GATE]))
    out = out.withColumn("__keys", keys)
    none = F.expr("cast(array() as array<struct<label: string, first: int, stop: int, rank: int, sure: double, rule: int>>)")
    out = out.withColumn("__found", F.when(F.size("__keys") > 0, detections(words, F.col("__keys"))).otherwise(none)).withColumn("spans", kept(F.col("__found")))
    b = F.col("__base")
    labels = F.array_sort(F.array_distinct(F.concat(F.transform(b, lambda x: x["label"]), F.transform("spans", lambda x: x["label"]))))
    return out.select(
        F.col("__id").alias(id_col),
        F.when(words == "  ", 0).otherwise(spaces(words) - 1).cast("long").alias("n_words"),
        F.aggregate(b, F.lit(0), lambda a, x: a + x["n"]).cast("long").alias("n_base"),
        F.array_min(F.transform(b, lambda x: x["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(b, lambda x: x["last"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(b, lambda x: x["label"]))), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.size(b) > 0, 0.9).otherwise(0.0), F.coalesce(F.array_max(F.transform("spans", lambda x: x["sure"])), F.lit(0.0))).alias("score"),
        "spans",
    )
