"""Operator 4 [native]: license scan with ordered signature rules.

A text becomes its words in lower case between single spaces, so a signature is a regex over words. Signatures are
written by hand: license names in a few forms of wording, and sentences of license bodies, file notices and addresses;
that makes some 360 ordered regexes, the last of them for families of licenses whose version isn't told. A rule runs only if the text contains one of its keywords as whole words; whatever
the rule matches holds one of them, so nothing is lost. Detections carry word intervals; a detection that lies inside an
interval of a rule of higher priority (or of a longer one, or an earlier rule, of the same) is suppressed, in one walk
along the sorted intervals, in blocks of about the square root of their number. Built-in functions only, one pass, no shuffle.

Base phrases are rules of their own that nothing suppresses.

Edge cases: a null or empty text has no words and no labels (empty strings, score 0, null places); very long texts are
scanned whole; the same phrase standing several times gives one detection each; repeated rows give repeated results; a
null id stays null; an empty table gives an empty result; only the id and text columns are read. Letters beyond A-Z
are also lower-cased, which changes no word border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed phrases: words -> label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label -> (keywords, of which each alternative of the name contains one as whole words; regex of the name in words).
#: Hand-written.
NAMES: dict[str, tuple[str, str]] = {
    "mit": ("mit|expat", "mit|expat"),
    "mit-0": ("mit", "mit no attribution|mit 0"),
    "apache-1": ("apache", "apache(?: software)?(?: licen[sc]e)?(?: version)? v?1 [01]"),
    "apache-2": ("apache", "apache(?: software)?(?: licen[sc]e)?(?: version)? v?2(?: 0)?"),
    "bsd-2-clause": ("bsd|freebsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    "bsd-3-clause": ("bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    "bsd-4-clause": ("bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    "0bsd": ("bsd|0bsd", "(?:0bsd|zero clause bsd|bsd zero clause)"),
    "isc": ("isc", "isc"),
    "gpl-1": ("gpl|general public", "(?:gnu )?(?:gpl|general public licen[sc]e)(?: version)? v?1(?: 0)?"),
    "gpl-2": ("gpl|general public|gplv2", "(?:gnu )?(?:gpl|general public licen[sc]e)(?: version)? v?2(?: 0)?|gplv2"),
    "gpl-3": ("gpl|general public|gplv3", "(?:gnu )?(?:gpl|general public licen[sc]e)(?: version)? v?3(?: 0)?|gplv3"),
    "lgpl-2": ("lgpl|general public|lgplv2", "(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)(?: version)? v?2(?: [01])?|lgplv2"),
    "lgpl-3": ("lgpl|general public|lgplv3", "(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version)? v?3(?: 0)?|lgplv3"),
    "agpl-3": ("agpl|affero|agplv3", "(?:gnu )?(?:agpl|affero general public licen[sc]e)(?: version)? v?3(?: 0)?|agplv3"),
    "gfdl": ("free documentation|gfdl", "gnu free documentation licen[sc]e|gfdl(?: 1 [123])?"),
    "mpl-1": ("mozilla|mpl", "(?:mozilla public licen[sc]e|mpl)(?: version)? v?1 [01]"),
    "mpl-2": ("mozilla|mpl", "(?:mozilla public licen[sc]e|mpl)(?: version)? v?2(?: 0)?"),
    "epl-1": ("eclipse public|epl", "(?:eclipse public licen[sc]e|epl)(?: version)? v?1(?: 0)?"),
    "epl-2": ("eclipse public|epl", "(?:eclipse public licen[sc]e|epl)(?: version)? v?2(?: 0)?"),
    "cddl-1": ("common development|cddl", "(?:common development and distribution licen[sc]e|cddl)(?: version)?(?: 1 [01])?"),
    "cpl-1": ("common public|cpl", "(?:common public licen[sc]e|cpl)(?: version)? 1 0"),
    "eupl-1": ("european union|eupl", "(?:european union public licen[sc]e|eupl)(?: version)?(?: v?1 [012])?"),
    "artistic-1": ("artistic", "artistic licen[sc]e(?: version)? 1(?: 0)?|artistic 1 0"),
    "artistic-2": ("artistic", "artistic licen[sc]e(?: version)? 2(?: 0)?|artistic 2 0"),
    "zlib": ("zlib", "zlib(?: libpng)?"),
    "libpng": ("libpng", "libpng(?: 2 0)?"),
    "boost-1": ("boost software|bsl", "boost software(?: licen[sc]e)?(?: version)?(?: 1 0)?|bsl 1 0"),
    "bsl-1.1": ("business", "business source(?: licen[sc]e)?(?: version)? ?1 1"),
    "unlicense": ("unlicense", "(?:the )?unlicense"),
    "wtfpl": ("wtfpl|do what the fuck", "wtfpl|do what the fuck you want to public licen[sc]e"),
    "cc0-1": ("cc0|commons zero|cc zero", "cc0(?: 1 0)?|creative commons zero|cc zero"),
    "cc-by-2": ("cc by", "cc by 2 [05]"),
    "cc-by-3": ("cc by", "cc by 3 0"),
    "cc-by-4": ("cc by", "cc by 4 0"),
    "cc-by": ("cc by|creative commons", "cc by|creative commons attribution"),
    "cc-by-sa": ("cc by|creative commons", "cc by sa(?: [234] [05])?|creative commons attribution share ?alike"),
    "cc-by-nd": ("cc by|creative commons", "cc by nd(?: [234] [05])?|creative commons attribution no derivatives"),
    "cc-by-nc": ("cc by|creative commons", "cc by nc(?: [234] [05])?|creative commons attribution non ?commercial"),
    "cc-by-nc-sa": ("cc by|creative commons", "cc by nc sa(?: [234] [05])?|creative commons attribution non ?commercial share ?alike"),
    "cc-by-nc-nd": ("cc by|creative commons", "cc by nc nd(?: [234] [05])?|creative commons attribution non ?commercial no derivatives"),
    "odbl": ("odbl|open database", "odbl(?: 1 0)?|open database licen[sc]e"),
    "odc-by": ("odc by|open data commons", "odc by(?: 1 0)?|open data commons attribution"),
    "pddl": ("pddl|public domain dedication", "pddl(?: 1 0)?|public domain dedication"),
    "ofl-1": ("sil open font|ofl", "sil open font(?: licen[sc]e)?(?: 1 [01])?|ofl 1 [01]"),
    "psf-2": ("python software|psf", "python software foundation(?: licen[sc]e)?(?: version)?(?: 2(?: 0)?)?|psf 2 0"),
    "php-3": ("php", "php(?: licen[sc]e)?(?: version)? 3(?: 01?)?"),
    "ruby": ("ruby", "ruby"),
    "vim": ("vim", "vim"),
    "postgresql": ("postgresql", "postgresql"),
    "openssl": ("openssl", "openssl"),
    "ncsa": ("ncsa", "ncsa|university of illinois ncsa open source"),
    "ms-pl": ("ms pl|microsoft public", "ms pl|microsoft public"),
    "ms-rl": ("ms rl|microsoft reciprocal", "ms rl|microsoft reciprocal"),
    "osl-3": ("osl|open software", "osl(?: v?3 0)?|open software licen[sc]e(?: v?3 0)?"),
    "afl-3": ("afl|academic free", "afl(?: v?3 0)?|academic free(?: licen[sc]e)?(?: v?3 0)?"),
    "sspl-1": ("sspl|server side public", "sspl(?: v?1)?|server side public"),
    "elastic-2": ("elastic", "elastic(?: licen[sc]e)?(?: v?2(?: 0)?)?"),
    "commons-clause": ("commons clause", "commons clause"),
    "openrail": ("openrail|rail", "(?:bigscience |creativeml )?(?:open ?rail(?: [ms])?|rail)(?: licen[sc]e)?"),
}
#: (label, keywords of which every match contains one as whole words, regex in words). Hand-written from the licenses' own
#: bodies, the notices that they ask for, and their addresses.
BODIES: list[tuple[str, str, str]] = [
    ("mit", "permission is hereby granted free", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "opensource org", "opensource org licen[sc]es? mit"),
    ("isc", "with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote products", "neither the names? of (?:[^ ]+ ){1,24}?may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", "apache", "licensed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache-2", "apache org", "apache org licen[sc]es licen[sc]e 2 0"),
    ("apache-1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache-1", "apache group", "this product includes software developed by the apache group"),
    ("gpl-2", "general public", "gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e"),
    ("gpl-3", "general public", "gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e"),
    ("gpl-2", "june 1991", "gnu general public licen[sc]e version 2 june 1991"),
    ("gpl-3", "29 june 2007", "gnu general public licen[sc]e version 3 29 june 2007"),
    ("lgpl-2", "general public", "gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation either version 2(?: [01])? of the licen[sc]e"),
    ("lgpl-3", "general public", "gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e"),
    ("agpl-3", "affero", "gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e"),
    ("gpl", "gnu org", "gnu org (?:licen[sc]es|copyleft) gpl"),
    ("lgpl", "gnu org", "gnu org (?:licen[sc]es|copyleft) lgpl"),
    ("agpl", "gnu org", "gnu org licen[sc]es agpl"),
    ("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("mpl-2", "mozilla org", "mozilla org mpl 2 0"),
    ("mpl-1", "mozilla", "the contents of this file are subject to the mozilla public licen[sc]e version 1 [01]"),
    ("epl-1", "eclipse public", "accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v1 0|version 1 0)"),
    ("epl-2", "eclipse public", "accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v ?2 0|version 2 0)"),
    ("cddl-1", "common development", "contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", "unlicense org"),
    ("wtfpl", "changing it is allowed", "verbatim or modified copies of this licen[sc]e document and changing it is allowed as long as the name is changed"),
    ("wtfpl", "do what the fuck", "do what the fuck you want to(?: public licen[sc]e)?"),
    ("wtfpl", "wtfpl net", "wtfpl net"),
    ("zlib", "in no event will the authors", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such"),
    ("boost-1", "permission is hereby granted free", "permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation"),
    ("boost-1", "boost org", "boost org licen[sc]e 1 0"),
    ("cc0-1", "publicdomain", "creativecommons org publicdomain zero 1 0"),
    ("cc0-1", "has dedicated the work", "has dedicated the work to the public domain by waiving all of (?:his|her|their)(?: or (?:his|her))? rights"),
    ("cc-by", "creativecommons org", "creativecommons org licen[sc]es by"),
    ("cc-by-sa", "creativecommons org", "creativecommons org licen[sc]es by sa"),
    ("cc-by-nd", "creativecommons org", "creativecommons org licen[sc]es by nd"),
    ("cc-by-nc", "creativecommons org", "creativecommons org licen[sc]es by nc"),
    ("cc-by-nc-sa", "creativecommons org", "creativecommons org licen[sc]es by nc sa"),
    ("cc-by-nc-nd", "creativecommons org", "creativecommons org licen[sc]es by nc nd"),
    ("odbl", "opendatacommons", "opendatacommons org licen[sc]es odbl"),
    ("odc-by", "opendatacommons", "opendatacommons org licen[sc]es by"),
    ("pddl", "opendatacommons", "opendatacommons org licen[sc]es pddl"),
    ("ofl-1", "open font", "this font software is licensed under the sil open font licen[sc]e"),
    ("ofl-1", "open font", "the goals of the open font licen[sc]e ofl are to stimulate worldwide development"),
    ("artistic-1", "the intent of this document", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", "given free software package", "terms under which a given free software package may be copied modified distributed"),
    ("psf-2", "python software foundation", "this licen[sc]e agreement is between the python software foundation psf and the individual or organi[sz]ation"),
    ("php-3", "php", "this product includes php software freely available from"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("ncsa", "following disclaimers", "retain the above copyright notice this list of conditions and the following disclaimers"),
    ("postgresql", "without a written agreement", "for any purpose without fee and without a written agreement is hereby granted"),
    ("vim", "unmodified copies of vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("ms-pl", "governs use of the accompanying", "this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e"),
    ("sspl-1", "functionality of the program", "make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "right to sell the software", "does not grant to you the right to sell the software"),
    ("bsl-1.1", "non production use", "redistribute and make non production use of the licensed work"),
    ("openrail", "derivatives of the model", "you agree not to use the model or derivatives of the model"),
    ("bsd", "source code must retain", "redistributions of source code must retain(?: the)?(?: above)?(?: copyright notice)?"),
    ("gpl", "verbatim copies of this", "verbatim copies of this licen[sc]e document"),
    ("proprietary", "confidential|proprietary software", "proprietary and confidential|confidential and proprietary|proprietary software licen[sc]e"),
    ("public-domain", "public domain", "(?:has been placed|is placed|is hereby placed|is released|is dedicated|released|placed) (?:in|into|to) the public domain"),
]
BODY_PRIORITY, BODY_CONFIDENCE = 60, 0.9
#: (form, priority, confidence, regex around a name N, whether N is the label's words). Earlier and higher wins.
FORMS: tuple[tuple[str, int, float, str], ...] = (
    ("identifier", 90, 1.0, "spdx licen[sc]e identifier (?:N)(?: or later| only)?"),
    ("grant", 80, 0.95, "(?:licen[sc]ed|released|distributed|available|published|provided|covered|redistributed) under (?:an? |the )?(?:terms of )?(?:an? |the )?(?:N)(?: licen[sc]e)?"),
    ("under", 70, 0.9, "under (?:the )?(?:terms of the )?(?:N) licen[sc]e"),
    ("name", 50, 0.8, "(?:N) (?:public )?licen[sc]e"),
)
ALONE_PRIORITY = 40
#: label -> (keywords, regex of the name in words, whether the name is plain enough to be detected alone), where no version
#: is told. Below all other rules, so a version that stands there too suppresses them.
FAMILIES: dict[str, tuple[str, str, bool]] = {
    "gpl": ("gpl|general public", "(?:gnu )?(?:gpl|general public licen[sc]e)", True),
    "lgpl": ("lgpl|general public", "(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)", True),
    "agpl": ("agpl|affero", "(?:gnu )?(?:agpl|affero general public licen[sc]e)", True),
    "apache": ("apache", "apache(?: software)?", False),
    "bsd": ("bsd", "bsd(?: style| type)?", False),
    "mpl": ("mozilla|mpl", "mozilla public|mpl", False),
    "epl": ("eclipse public|epl", "eclipse public|epl", False),
    "artistic": ("artistic", "artistic", False),
    "cc": ("creative commons|cc", "creative commons|cc", False),
    "proprietary": ("proprietary", "proprietary", False),
    "all-rights-reserved": ("all rights reserved", "all rights reserved", True),
}
FAMILY_PRIORITY, FAMILY_CONFIDENCE = 30, 0.6
#: The priorities of the method's rules, from the highest.
RANKS = sorted({priority for _, priority, _, _ in FORMS} | {BODY_PRIORITY, ALONE_PRIORITY, FAMILY_PRIORITY}, reverse=True)
#: Names that are plain enough to be detected alone.
ALONE = ("apache-2", "gpl-2", "gpl-3", "lgpl-2", "lgpl-3", "agpl-3", "mpl-2", "cc0-1", "cc-by-2", "cc-by-3", "cc-by-4", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd")


def signatures() -> list[tuple[int, str, list[str], str, int, float]]:
    """(number, label, keywords, regex, priority, confidence) of every rule, base phrases first (priority 100)."""
    rules = [(label, words, words, 100, 1.0) for words, label in BASE.items()]
    for _, priority, confidence, form in FORMS:
        rules += [(label, keywords, form.replace("N", name), priority, confidence) for label, (keywords, name) in NAMES.items()]
    rules += [(label, keywords, regex, BODY_PRIORITY, BODY_CONFIDENCE) for label, keywords, regex in BODIES]
    rules += [(label, NAMES[label][0], f"(?:{NAMES[label][1]})", ALONE_PRIORITY, 0.7) for label in ALONE]
    for form, _, _, regex in FORMS[1:]:
        rules += [(label, keywords, regex.replace("N", name), FAMILY_PRIORITY, FAMILY_CONFIDENCE) for label, (keywords, name, alone) in FAMILIES.items() if not (alone and form == "name")]
    rules += [(label, keywords, f"(?:{name})", FAMILY_PRIORITY, FAMILY_CONFIDENCE) for label, (keywords, name, alone) in FAMILIES.items() if alone]
    return [(i, label, [f" {k} " for k in keywords.split("|")], f"(?<= )(?:{regex})(?= )", priority, confidence) for i, (label, keywords, regex, priority, confidence) in enumerate(rules)]


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _detections(norm: Column) -> Column:
    """Array of (rule, label, priority, confidence, first, last): every match of every rule of which a keyword stands in the text."""
    text = lambda x: "'" + x + "'"  # noqa: E731  no rule holds a quote or a backslash
    texts = lambda xs: f"array({', '.join(map(text, xs))})"
    some = signatures()
    # one SQL text, since thousands of literals made one by one take seconds
    rules = F.expr("array(" + ", ".join(f"named_struct('rule', {i}, 'label', {text(label)}, 'kws', {texts(kws)}, 'rx', {text(rx)}, 'priority', {p}, 'confidence', {conf}D)" for i, label, kws, rx, p, conf in some) + ")")
    keywords = F.expr(texts(sorted({kw for _, _, kws, _, _, _ in some for kw in kws})))

    def found(r: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(norm, r["rx"], F.lit("\x01$0"))), " ")  # a match starts at a word, which is marked
        starts = F.array_compact(F.transform(words, lambda w, k: F.when(F.startswith(w, F.lit("\x01")), k)))
        fields = [r[k].alias(k) for k in ("rule", "label", "priority", "confidence")]
        return F.zip_with(starts, F.regexp_extract_all(norm, r["rx"], F.lit(0)), lambda k, m: F.struct(*fields, k.cast("long").alias("first"), (k + _spaces(m)).cast("long").alias("last")))

    def ran(held: Column) -> Column:
        return F.flatten(F.transform(F.filter(rules, lambda r: F.arrays_overlap(r["kws"], held) & F.regexp_like(norm, r["rx"])), found))

    held = F.filter(keywords, lambda kw: F.contains(norm, kw))
    # an array of one, so that a text is searched for keywords once; without any it runs no rule
    return F.flatten(F.transform(F.filter(F.array(held), lambda x: F.size(x) > 0), ran))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, base array, detections array) of every text; ``detections`` are what suppression leaves of the
    method's rules, ``base`` all places of base phrases."""
    words = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    df = docs.select(F.col(id_col), F.concat(F.lit(" "), F.trim(words), F.lit(" ")).alias("_norm"))
    n_words = F.when(F.length("_norm") > 2, _spaces(F.col("_norm")) - 1).otherwise(F.lit(0)).cast("long")
    df = df.select(id_col, n_words.alias("n_words"), _detections(F.col("_norm")).alias("_all"))
    detections = "array<struct<rule:int,label:string,priority:int,confidence:double,first:bigint,last:bigint>>"
    none = F.array().cast(detections)
    level = lambda d: F.array_position(F.array(*map(F.lit, RANKS)), d["priority"]).cast("int")
    # whatever may suppress a detection comes before it in this order
    own = F.transform(F.filter("_all", lambda d: d["priority"] < 100), lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("back"), level(d).alias("level"), d["rule"].alias("rule"), d.alias("d")))

    def walk(state: Column, x: Column) -> Column:
        """``reach`` holds the furthest end of the detections so far, for each priority of those that high or higher."""
        last = x["d"]["last"]
        kept = F.when(F.element_at(state["reach"], x["level"]) >= last, state["kept"]).otherwise(F.concat(state["kept"], F.array(x["d"])))
        return F.struct(kept.alias("kept"), F.transform(state["reach"], lambda y, k: F.when(k >= x["level"] - 1, F.greatest(y, last)).otherwise(y)).alias("reach"))

    def walk_block(state: Column, block: Column) -> Column:
        """A walk copies what it has kept with every detection, so blocks are walked alone and put side by side."""
        start = F.struct(none.alias("kept"), state["reach"].alias("reach"))
        return F.aggregate(block, start, walk, lambda x: F.struct(F.concat(state["kept"], F.array(x["kept"])).alias("kept"), x["reach"].alias("reach")))

    def walked(found: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(found))).cast("int")
        starts = F.when(F.size(found) > 0, F.sequence(F.lit(1), F.size(found), F.greatest(size, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.array().cast(f"array<{detections}>").alias("kept"), F.array(*[F.lit(-1).cast("long")] * len(RANKS)).alias("reach"))
        return F.aggregate(F.transform(starts, lambda k: F.slice(found, k, size)), start, walk_block, lambda x: F.flatten(x["kept"]))

    # an array of one, so that detections are sorted once
    kept = F.flatten(F.transform(F.array(F.sort_array(own)), walked))
    return df.select(id_col, "n_words", F.coalesce(F.filter("_all", lambda d: d["priority"] == 100), none).alias("base"), F.coalesce(kept, none).alias("detections"))


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per text: counts, places, labels and the best confidence."""
    names = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    labels = lambda c: F.transform(c, lambda d: d["label"])
    return scanned.select(
        id_col,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["first"])).alias("last_word"),
        names(labels(F.col("base"))).alias("base_labels"),
        names(F.concat(labels(F.col("base")), labels(F.col("detections")))).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("base", "detections"), lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
