"""License scan by ordered signature rules, as one projection of built-in functions.

A text's words (runs of letters, digits and non-ASCII characters; A-Z lower-cased) are joined by single blanks. A rule is a hand-written expression
over that line with a label, a priority, a confidence and the keywords without which it cannot match; rules whose keywords are missing are never
tried. Detections are intervals of the line. One that lies inside an earlier or equal interval of at least its own priority is suppressed, so that
"Apache License, Version 2.0" hides the plain "Apache License" in it. Base phrases are counted apart and never suppressed.

Nothing is shuffled and no row depends on another. Null and empty texts have no words, no detections and the score 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_EITHER_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

TEXT, NAME, GRANT, VERSIONED, IDENTIFIER = 1, 2, 3, 4, 5  # priorities
CONFIDENCE = {TEXT: 0.7, NAME: 0.6, GRANT: 0.85, VERSIONED: 0.95, IDENTIFIER: 1.0}

# label; expression of the name; keywords it needs; versions, each as words; identifier as words
FAMILIES = [
    ("apache", r"apache(?: software)? licen[cs]e", "apache", ["1 0", "1 1", "2 0", "2"], "apache"),
    ("mit", r"mit(?: x11)? licen[cs]e", "mit", [], "mit"),
    ("gpl", r"gnu (?:general public licen[cs]e|gpl)", "gnu", ["1", "1 0", "2", "2 0", "2 1", "3", "3 0"], "gpl"),
    ("lgpl", r"gnu (?:lesser|library) general public licen[cs]e", "gnu", ["2", "2 0", "2 1", "3", "3 0"], "lgpl"),
    ("agpl", r"gnu affero general public licen[cs]e", "affero", ["1 0", "3", "3 0"], "agpl"),
    ("gfdl", r"gnu free documentation licen[cs]e", "gnu", ["1 1", "1 2", "1 3"], "gfdl"),
    ("bsd", r"(?:new |modified |simplified |revised )?(?:[0-4] clause )?bsd(?: style)?(?: [0-4] clause)? licen[cs]e", "bsd", [], "bsd"),
    ("mpl", r"mozilla public licen[cs]e", "mozilla", ["1 0", "1 1", "2 0"], "mpl"),
    ("epl", r"eclipse public licen[cs]e", "eclipse", ["1 0", "2 0"], "epl"),
    ("edl", r"eclipse distribution licen[cs]e", "eclipse", ["1 0"], "edl"),
    ("cddl", r"common development and distribution licen[cs]e", "development", ["1 0", "1 1"], "cddl"),
    ("cpl", r"common public licen[cs]e", "common", ["0 5", "1 0"], "cpl"),
    ("cpal", r"common public attribution licen[cs]e", "attribution", ["1 0"], "cpal"),
    ("eupl", r"european union public licen[cs]e", "european", ["1 0", "1 1", "1 2"], "eupl"),
    ("isc", r"isc licen[cs]e", "isc", [], "isc"),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib", [], "zlib"),
    ("boost", r"boost software licen[cs]e", "boost", ["1 0"], "bsl"),
    ("artistic", r"artistic licen[cs]e", "artistic", ["1 0", "2 0"], "artistic"),
    ("psf", r"python(?: software foundation)? licen[cs]e", "python", ["2", "2 0", "2 1"], "psf"),
    ("php", r"php licen[cs]e", "php", ["3 0", "3 01"], "php"),
    ("ruby", r"ruby licen[cs]e", "ruby", [], "ruby"),
    ("perl", r"perl licen[cs]e", "perl", [], "perl"),
    ("ofl", r"(?:sil )?open font licen[cs]e", "font", ["1 0", "1 1"], "ofl"),
    ("osl", r"open software licen[cs]e", "open", ["1 0", "2 0", "2 1", "3 0"], "osl"),
    ("afl", r"academic free licen[cs]e", "academic", ["1 1", "1 2", "2 0", "2 1", "3 0"], "afl"),
    ("apsl", r"apple public source licen[cs]e", "apple", ["1 0", "1 1", "1 2", "2 0"], "apsl"),
    ("ms-pl", r"microsoft public licen[cs]e", "microsoft", [], "ms pl"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "microsoft", [], "ms rl"),
    ("ibm-pl", r"ibm public licen[cs]e", "ibm", ["1 0"], "ipl"),
    ("intel", r"intel open source licen[cs]e", "intel", [], "intel"),
    ("nasa", r"nasa open source agreement", "nasa", ["1 3"], "nasa"),
    ("ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", "ncsa", [], "ncsa"),
    ("netscape", r"netscape public licen[cs]e", "netscape", ["1 0", "1 1"], "npl"),
    ("openssl", r"openssl(?: and ssleay)? licen[cs]e", "openssl", [], "openssl"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", [], "postgresql"),
    ("qpl", r"q public licen[cs]e", "q", ["1 0"], "qpl"),
    ("sleepycat", r"sleepycat licen[cs]e", "sleepycat", [], "sleepycat"),
    ("sun-pl", r"sun public licen[cs]e", "sun", ["1 0"], "spl"),
    ("unicode", r"unicode(?: inc)? licen[cs]e", "unicode", [], "unicode"),
    ("upl", r"universal permissive licen[cs]e", "universal", ["1 0"], "upl"),
    ("vim", r"vim licen[cs]e", "vim", [], "vim"),
    ("w3c", r"w3c(?: software(?: notice and)?)? licen[cs]e", "w3c", [], "w3c"),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e", "want", ["2"], "wtfpl"),
    ("zpl", r"zope public licen[cs]e", "zope", ["1 1", "2 0", "2 1"], "zpl"),
    ("beerware", r"beer ?ware licen[cs]e", "licen", [], "beerware"),
    ("sspl", r"server side public licen[cs]e", "server", ["1", "1 0"], "sspl"),
    ("busl", r"business source licen[cs]e", "business", ["1 0", "1 1"], "busl"),
    ("elastic", r"elastic licen[cs]e", "elastic", ["1 0", "2 0"], "elastic"),
    ("commons-clause", r"commons clause(?: licen[cs]e)? condition", "clause", ["1 0"], "commons clause"),
    ("odbl", r"open (?:data commons open )?database licen[cs]e", "database", ["1 0"], "odbl"),
    ("odc-by", r"open data commons attribution licen[cs]e", "commons", ["1 0"], "odc by"),
    ("cc-by", r"creative commons attribution(?: licen[cs]e)?", "creative", ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc by"),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: licen[cs]e)?", "creative", ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc by sa"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: licen[cs]e)?", "creative", ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc by nc"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: licen[cs]e)?", "creative", ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc by nd"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?", "creative", ["2 0", "2 5", "3 0", "4 0"], "cc by nc sa"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: licen[cs]e)?", "creative", ["2 0", "2 5", "3 0", "4 0"], "cc by nc nd"),
]

# label; expression; keywords; priority
SINGLE = [
    ("cc-by", r"cc by(?: [1-4](?: [05])?)?", "cc by", VERSIONED),
    ("cc-by-sa", r"cc by sa(?: [1-4](?: [05])?)?", "cc by sa", IDENTIFIER),
    ("cc-by-nc", r"cc by nc(?: [1-4](?: [05])?)?", "cc by nc", IDENTIFIER),
    ("cc-by-nd", r"cc by nd(?: [1-4](?: [05])?)?", "cc by nd", IDENTIFIER),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1-4](?: [05])?)?", "cc by nc sa", IDENTIFIER),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1-4](?: [05])?)?", "cc by nc nd", IDENTIFIER),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0", VERSIONED),
    ("cc0", r"creative commons zero(?: licen[cs]e)?", "creative", VERSIONED),
    ("cc0", r"creativecommons org publicdomain zero", "publicdomain", VERSIONED),
    ("unlicense", r"(?:the )?unlicense(?: org)?", "unlicense", NAME),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", VERSIONED),
    ("public-domain", r"(?:released|placed|dedicated|donated) (?:in|into|to) the public domain", "public domain", GRANT),
    ("public-domain", r"public domain dedication", "dedication", NAME),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", "permission", VERSIONED),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "permission", TEXT),
    ("mit", r"opensource org licenses mit", "opensource mit", VERSIONED),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission", VERSIONED),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution", VERSIONED),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions", TEXT),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions", TEXT),
    ("bsd", r"neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse", "neither endorse", TEXT),
    ("bsd", r"opensource org licenses bsd(?: [0-4] clause)?", "opensource bsd", VERSIONED),
    ("apache", r"apache org licenses license 2 0", "apache", VERSIONED),
    ("apache", r"you may not use this file except in compliance with the license", "compliance", TEXT),
    ("apache", r"unless required by applicable law or agreed to in writing software distributed under the license", "unless applicable", TEXT),
    ("gpl", r"gpl v?[23](?: 0)?(?: or later| only)?", "gpl", NAME),
    ("gpl", r"gpl2(?: 0)?(?: or later| only)?", "gpl2", NAME),
    ("gpl", r"gpl3(?: 0)?(?: or later| only)?", "gpl3", NAME),
    ("gpl", r"gplv2(?: 0)?(?: or later| only)?", "gplv2", NAME),
    ("gpl", r"gplv3(?: 0)?(?: or later| only)?", "gplv3", NAME),
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public license", "gnu redistribute", VERSIONED),
    ("gpl", r"gnu org licenses (?:old licenses )?gpl(?: [23] 0)?", "gnu gpl", VERSIONED),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser", VERSIONED),
    ("lgpl", r"gnu org licenses (?:old licenses )?lgpl(?: [23] [01])?", "gnu lgpl", VERSIONED),
    ("agpl", r"gnu org licenses agpl(?: 3 0)?", "gnu agpl", VERSIONED),
    ("mpl", r"mozilla org mpl(?: 2 0)?", "mozilla", VERSIONED),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license", "mozilla", VERSIONED),
    ("boost", r"boost org license 1 0", "boost", VERSIONED),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "authors liable", VERSIONED),
    ("zlib", r"altered source versions must be plainly marked as such", "altered", TEXT),
    ("ofl", r"this font software is licensed under the sil open font license", "font", VERSIONED),
    ("wtfpl", r"wtfpl(?: v?2)?", "wtfpl", NAME),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", "retain stuff", VERSIONED),
    ("artistic", r"same terms as perl itself", "perl", GRANT),
    ("cc-by", r"creativecommons org licenses by [1-4] [05]", "creativecommons by", VERSIONED),
    ("cc-by-sa", r"creativecommons org licenses by sa [1-4] [05]", "creativecommons by", VERSIONED),
    ("cc-by-nc", r"creativecommons org licenses by nc [1-4] [05]", "creativecommons by", VERSIONED),
    ("cc-by-nd", r"creativecommons org licenses by nd [1-4] [05]", "creativecommons by", VERSIONED),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa [1-4] [05]", "creativecommons by", VERSIONED),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd [1-4] [05]", "creativecommons by", VERSIONED),
    ("proprietary", r"all rights reserved", "rights reserved", TEXT),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", GRANT),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|distribution) of this (?:file|document|software|work) is (?:strictly )?prohibited", "prohibited", GRANT),
    ("proprietary", r"end user licen[cs]e agreement", "agreement", GRANT),
    ("notice", r"copyright(?: c)? (?:19|20)[0-9]{2}", "copyright", TEXT),
]

EXPAT = r"expat(?: x11)? licen[cs]e"
HOW = ("under", "according to", "subject to")
GRANTED = r"(?:is |are )?(?:licen[cs]ed|released|distributed|available|provided|published|offered) (?:to you )?{how} (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?"
# No rule matches a text without any of these: each is part of one word, so it stands in the raw text as it does in the joined line, whatever lies between
# words there. "cc" and "by" are looked for as words that follow each other.
STEMS = ("licen", "spdx", "copyright", "domain", "commons", "unencumbered", "permission", "redistribut", "compliance",
         "warranty", "gpl", "wtfpl", "cc0", "proprietary", "prohibited", "reserved", "agreement", "altered", "perl", "opensource", "mozilla", "boost", "retain", "dedication", "endorse", "apache", "clause")
CC_BY = r"(?i)cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"


@dataclass(frozen=True)
class Rule:
    label: str
    expression: str
    keywords: tuple[str, ...]
    priority: int
    base: bool = False

    @property
    def pattern(self) -> str:
        return rf"(?<= )(?:{self.expression})(?= )"


def _granted(label: str, name: str, need: tuple[str, ...]) -> list[Rule]:
    return [Rule(label, GRANTED.replace("{how}", how) + name, (*need, *how.split()), GRANT) for how in HOW]


def rules() -> list[Rule]:
    """All rules in order: base phrases, single rules, another name of one family, and the forms of each family."""
    out = [Rule(label, phrase, tuple(phrase.split()), NAME, True) for phrase, label in BASE.items()]
    out += [Rule(label, expression, tuple(words.split()), priority) for label, expression, words, priority in SINGLE]
    out += [Rule("mit", EXPAT, ("expat",), NAME), *_granted("mit", EXPAT, ("expat",))]
    for label, name, word, versions, identifier in FAMILIES:
        need = () if word == "licen" else (word,)
        out.append(Rule(label, name, need, NAME))
        out += _granted(label, name, need)
        out.append(Rule(label, rf"spdx license identifier {identifier}(?: [0-9]+){{0,2}}(?: only| or later)?", ("spdx", "license", "identifier", *identifier.split()), IDENTIFIER))
        out += [Rule(f"{label}-{v.replace(' ', '.')}", rf"{name}(?: version| v)? {v}", (*need, *v.split()), VERSIONED) for v in versions]
    return out


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _literal(all_rules: list[Rule]) -> Column:
    return F.array(*(
        F.struct(F.lit(k).alias("no"), F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"), F.array(*map(F.lit, r.keywords or ("",))).alias("keywords"), F.lit(r.priority).alias("priority"), F.lit(r.base).alias("base"))
        for k, r in enumerate(all_rules)
    ))


def _intervals(line: Column, rule: Column) -> Column:
    """All places of a rule, from the lengths of its matches and of what lies between them."""
    empty = F.expr("CAST(array() AS array<struct<s:int,e:int,priority:int,no:int,label:string,base:boolean>>)")
    zipped = F.arrays_zip(F.split(line, rule["pattern"], -1).alias("gap"), F.regexp_extract_all(line, rule["pattern"], F.lit(0)).alias("hit"))

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["gap"])
        end = start + F.length(z["hit"])
        found = F.struct(start.alias("s"), end.alias("e"), rule["priority"].alias("priority"), rule["no"].alias("no"), rule["label"].alias("label"), rule["base"].alias("base"))
        return F.when(z["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], found).alias("out")))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def _surviving(found: Column) -> Column:
    """Detections outside every interval of at least their priority that starts no later and ends no earlier; of equal ones the first rule's."""
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("back"), (-d["priority"]).alias("rank"), d["no"].alias("no"), d["label"].alias("label"))))
    none = F.expr("CAST(array() AS array<struct<label:string,priority:int,s:int,e:int>>)")
    first = F.struct(*(F.lit(-1).alias(f"p{p}") for p in CONFIDENCE), none.alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["back"], -d["rank"]
        covered = F.greatest(*(F.when(F.lit(p) >= priority, acc[f"p{p}"]).otherwise(F.lit(-1)) for p in CONFIDENCE)) >= end
        reach = [F.when(priority == p, F.greatest(acc[f"p{p}"], end)).otherwise(acc[f"p{p}"]).alias(f"p{p}") for p in CONFIDENCE]
        item = F.struct(d["label"].alias("label"), priority.alias("priority"), d["s"].alias("s"), end.alias("e"))
        return F.struct(*reach, F.when(covered, acc["kept"]).otherwise(F.array_append(acc["kept"], item)).alias("kept"))

    return F.aggregate(ordered, first, step, lambda acc: acc["kept"])


def _word_no(line: Column, place: Column) -> Column:
    """Index of the word that starts at a place of the line: the blanks before it, less the leading one."""
    return (place - F.length(F.replace(F.substring(line, F.lit(1), place), F.lit(" "), F.lit(""))) - 1).cast("long")


def scanned(docs: DataFrame, text: str = "text", out: str = "license") -> DataFrame:
    """``docs`` with a struct: n_words, n_base, first_word, last_word, base_labels, labels, detections (label, priority, s, e in the joined line), score."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    every = rules()
    keywords = F.array(*map(F.lit, sorted({k for r in every for k in r.keywords} | {""})))
    folded = F.lower(body)
    gate = F.lit(False)
    for stem in STEMS:
        gate = gate | folded.contains(stem)
    gate = gate | body.rlike(CC_BY)

    def judge(line: Column) -> Column:
        present = F.array_union(F.array_intersect(F.split(line, " "), keywords), F.array(F.lit("")))
        tried = _let(present, lambda have: F.filter(_literal(every), lambda r: F.forall(r["keywords"], lambda k: F.array_contains(have, k))))
        found = F.flatten(F.transform(tried, lambda r: _intervals(line, r)))
        return _let(found, lambda d: F.struct(
            F.filter(d, lambda x: x["base"]).alias("base"), _surviving(F.filter(d, lambda x: ~x["base"])).alias("kept"),
        ).withField("line", line))

    line = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.translate(body, UPPER, LOWER), F.lit(WORD), F.lit(0)), " "), F.lit(" "))
    judged = F.when(gate, _let(line, judge))

    def summary(j: Column) -> Column:
        base_labels = F.coalesce(F.array_sort(F.array_distinct(F.transform(j["base"], lambda d: d["label"]))), F.array().cast("array<string>"))
        starts = F.transform(j["base"], lambda d: d["s"])
        kept = F.coalesce(j["kept"], F.expr("CAST(array() AS array<struct<label:string,priority:int,s:int,e:int>>)"))
        trust = F.create_map(*(x for p, c in CONFIDENCE.items() for x in (F.lit(p), F.lit(c))))
        base_score = F.when(F.size(base_labels) > 0, F.lit(CONFIDENCE[NAME])).otherwise(F.lit(0.0))
        return F.struct(
            F.size(F.regexp_extract_all(body, F.lit(WORD_EITHER_CASE), F.lit(0))).cast("long").alias("n_words"),
            F.coalesce(F.size(j["base"]), F.lit(0)).cast("long").alias("n_base"),
            _word_no(j["line"], F.array_min(starts)).alias("first_word"), _word_no(j["line"], F.array_max(starts)).alias("last_word"),
            base_labels.alias("base_labels"), F.array_sort(F.array_union(base_labels, F.transform(kept, lambda d: d["label"]))).alias("labels"), kept.alias("detections"),
            F.greatest(base_score, F.coalesce(F.array_max(F.transform(kept, lambda d: trust[d["priority"]])), F.lit(0.0))).alias("score"),
        )

    return docs.withColumn(out, _let(judged, summary))
