"""License scans: ordered signature rules with a keyword gate, priority and interval containment.

Only DataFrame functions are used. A text becomes a canonical line: A-Z lower-cased, words joined by single spaces. A few
keywords decide at once whether any rule can match at all; documents without one are done after counting words. For the others
each rule's own keyword gates its regex. Matches get word intervals from the lengths of what lies between them. An interval inside
another one is suppressed; of equal intervals the rule of higher priority (the earlier one) stays. Everything happens inside the document's
row, so no key can be hot and nothing is shuffled.

Defined results: null and empty texts have no words, no detections and score 0; repeated rows are judged alike; columns of
the input stay, result columns replace those of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.common import aside

#: What separates words: ASCII without digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@dataclass(frozen=True)
class Rule:
    """A detection: keyword that must occur in the canonical line, there at a word's beginning, regex over whole words, label, weight of the evidence (0 to 1)."""

    keyword: str
    regex: str
    label: str
    weight: float


V = r"(?: (?:version|v))? ?"
#: Licenses by priority: label, name as it is written, further spellings, identifier in the style of SPDX.
NAMED = (
    ("agpl-3.0", rf"gnu affero general public license(?:{V}(?:3|3 0))?", "affero general public license", "agpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", rf"gnu lesser general public license{V}2 1", "lesser general public license 2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", rf"gnu lesser general public license{V}3(?: 0)?", "lesser general public license 3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", rf"gnu library general public license(?:{V}2)?", "library general public license", "lgpl 2 0(?: only| or later)?"),
    ("lgpl", "gnu lesser general public license", "lesser general public license", "lgpl"),
    ("gfdl", rf"gnu free documentation license(?:{V}1 [123])?", "free documentation license", "gfdl 1 [123](?: only| or later)?"),
    ("gpl-1.0", rf"gnu general public license{V}1(?: 0)?", "general public license version 1", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", rf"gnu general public license{V}2(?: 0)?", "general public license version 2", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", rf"gnu general public license{V}3(?: 0)?", "general public license version 3", "gpl 3 0(?: only| or later)?"),
    ("gpl", "(?:gnu )?general public license", "gnu gpl", "gpl(?:v[123])?"),
    ("apache-1.0", rf"apache(?: software)? license{V}1(?: 0)?", "apache group license", "apache 1 0"),
    ("apache-1.1", rf"apache(?: software)? license{V}1 1", "apache software license 1 1", "apache 1 1"),
    ("apache-2.0", rf"apache(?: software)? license{V}2(?: 0)?", "www apache org licenses license 2 0", "apache 2 0"),
    ("apache", "apache(?: software)? license", "apache software foundation license", "asl"),
    ("mit-0", "mit no attribution(?: license)?", "mit license no attribution", "mit 0"),
    ("mit", "(?:the )?mit license", "licensed under the mit", "mit"),
    ("x11", "(?:the )?x11 license", "x consortium license", "x11"),
    ("expat", "(?:the )?expat license", "expat style license", "expat"),
    ("isc", "(?:the )?isc license", "internet systems consortium license", "isc"),
    ("bsd-4-clause", "(?:4|four) clause bsd license", "original bsd license", "bsd 4 clause"),
    ("bsd-3-clause", "(?:3|three) clause bsd license", "(?:new|modified|revised) bsd license", "bsd 3 clause"),
    ("bsd-2-clause", "(?:2|two) clause bsd license", "simplified bsd license", "bsd 2 clause"),
    ("bsd-0-clause", "(?:0|zero) clause bsd license", "free public license 1 0 0", "0bsd"),
    ("bsd", "bsd(?: style)? license", "berkeley software distribution license", "bsd"),
    ("mpl-1.0", rf"mozilla public license{V}1(?: 0)", "mozilla public license 1 0", "mpl 1 0"),
    ("mpl-1.1", rf"mozilla public license{V}1 1", "mozilla public license 1 1", "mpl 1 1"),
    ("mpl-2.0", rf"mozilla public license{V}2(?: 0)?", "mozilla org mpl 2 0", "mpl 2 0"),
    ("mpl", "mozilla public license", "terms of the mozilla public", "mpl"),
    ("epl-1.0", rf"eclipse public license{V}1(?: 0)?", "eclipse org legal epl v10", "epl 1 0"),
    ("epl-2.0", rf"eclipse public license{V}2(?: 0)?", "eclipse org legal epl 2 0", "epl 2 0"),
    ("epl", "eclipse public license", "eclipse distribution license", "epl"),
    ("cddl-1.0", rf"common development and distribution license(?:{V}1(?: 0)?)?", "sun cddl", "cddl 1 [01]"),
    ("cpl-1.0", rf"common public license(?:{V}1(?: 0)?)?", "ibm common public license", "cpl 1 0"),
    ("eupl", rf"european union public licen[cs]e(?:{V}1 [012])?", "eupl licen[cs]e", "eupl 1 [012]"),
    ("cecill", "cecill(?: free software)? licen[cs]e", "licence cecill", "cecill [bc12](?: [01])?"),
    ("cc0", "cc0(?: 1 0)?(?: universal)?", "creative commons zero", "cc0 1 0"),
    ("cc-by-nc-nd", "cc by nc nd(?: [1234] [05])?", "attribution noncommercial noderiv(?:ative)?s", "cc by nc nd [1234] [05]"),
    ("cc-by-nc-sa", "cc by nc sa(?: [1234] [05])?", "attribution noncommercial sharealike", "cc by nc sa [1234] [05]"),
    ("cc-by-nc", "cc by nc(?: [1234] [05])?", "attribution noncommercial", "cc by nc [1234] [05]"),
    ("cc-by-nd", "cc by nd(?: [1234] [05])?", "attribution noderiv(?:ative)?s", "cc by nd [1234] [05]"),
    ("cc-by-sa", "cc by sa(?: [1234] [05])?", "attribution share ?alike", "cc by sa [1234] [05]"),
    ("cc-by", "cc by(?: [1234] [05])?", "creative commons attribution(?: [1234] [05])?(?: international)?", "cc by [1234] [05]"),
    ("cc", "creative commons(?: public)? license", "creativecommons org licenses", "cc license"),
    ("odbl", "open database license", "open data commons open database license", "odbl 1 0"),
    ("odc-by", "open data commons attribution license", "odc attribution license", "odc by 1 0"),
    ("pddl", "public domain dedication and license", "open data commons public domain dedication", "pddl 1 0"),
    ("unlicense", "(?:the )?unlicense", "unlicense org", "unlicense"),
    ("wtfpl", "wtfpl(?: license)?", "do what the fuck you want to public license", "wtfpl"),
    ("zlib", "(?:the )?zlib(?: libpng)? license", "zlib style license", "zlib"),
    ("libpng", "(?:the )?libpng license", "png reference library license", "libpng 2 0"),
    ("bsl-1.0", rf"boost software license(?:{V}1(?: 0)?)?", "www boost org license 1 0", "bsl 1 0"),
    ("artistic-1.0", rf"artistic license{V}1(?: 0)?", "perl artistic license", "artistic 1 0"),
    ("artistic-2.0", rf"artistic license{V}2(?: 0)?", "artistic license 2 0", "artistic 2 0"),
    ("artistic", "artistic license", "clarified artistic license", "clartistic"),
    ("python", "python software foundation license", "psf license", "python 2 0"),
    ("php", rf"php license(?:{V}3(?: 0[01])?)?", "php net license", "php 3 0[01]?"),
    ("ruby", "(?:the )?ruby license", "same terms as ruby", "ruby"),
    ("openssl", "openssl license", "openssl toolkit license", "openssl"),
    ("ofl", rf"(?:sil )?open font license(?:{V}1 [01])?", "scripts sil org ofl", "ofl 1 [01]"),
    ("postgresql", "postgresql licen[cs]e", "postgres licen[cs]e", "postgresql"),
    ("w3c", "w3c(?: software)?(?: notice and)? license", "w3c document license", "w3c"),
    ("ncsa", "ncsa(?: open source)? license", "university of illinois ncsa open source license", "ncsa"),
    ("ms-pl", "microsoft public license", "microsoft permissive license", "ms pl"),
    ("ms-rl", "microsoft reciprocal license", "microsoft community license", "ms rl"),
    ("upl", "universal permissive license", "oracle universal permissive license", "upl 1 0"),
    ("sspl", "server side public license", "sspl license", "sspl 1 0"),
    ("busl", "business source license(?: 1 1)?", "mariadb business source license", "busl 1 1"),
    ("elastic", "elastic license(?: 2 0)?", "elastic co licensing elastic license", "elastic 2 0"),
    ("rail", "(?:open)?rail(?: m)? license", "responsible ai licenses?", "openrail"),
    ("llama", "llama(?: [23])?(?: [0-9])? community license", "meta llama license", "llama[23]"),
)
#: What is done under a license; a rule each, as none of them is a keyword for the others.
VERBS = ("licensed", "licenced", "released", "distributed", "available", "published")
#: Wordings without a name: label, regex, weight.
WORDINGS = (
    ("permissive-text", "permission is hereby granted free of charge", 0.8),
    ("warranty-disclaimer", "(?:provided )?as is without warranty of any kind", 0.5),
    ("warranty-disclaimer", "without warranties or conditions of any kind", 0.5),
    ("redistribution", "redistribution and use in source and binary forms", 0.8),
    ("copyleft-notice", "you can redistribute it and or modify it under the terms", 0.8),
    ("rights-reserved", "all rights reserved", 0.4),
    ("copyright-notice", "(?:c )?copyright(?: c)? (?:19|20)[0-9]{2}", 0.4),
    ("public-domain", "(?:released |dedicated )?(?:in|into|to) the public domain", 0.6),
    ("proprietary", "proprietary and confidential", 0.6),
    ("no-commercial-use", "(?:not|non)(?: | ?for )commercial use(?: only)?", 0.4),
    ("no-commercial-use", "noncommercial use(?: only)?", 0.4),
    ("no-commercial-use", "notcommercial use(?: only)?", 0.4),
    ("fair-use", "fair use (?:notice|policy)", 0.3),
    ("spdx", "spdx license identifier", 0.6),
)


def literal(regex: str) -> str:
    """The longest run of plain characters in a regex that begins at a word's beginning in every match; every match contains it."""
    group = r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)[?]?|\[[^\]]*\][?]?|.\?"  # groups, classes and optional characters
    whole, at, begins = [], 0, True
    for m in [*re.finditer(group, regex), None]:
        plain = regex[at : m.start() if m else None]
        if begins or plain.startswith(" "):
            whole.append(plain.strip())
        begins = plain.endswith(" ") if plain else begins
        if m:
            spaced = all(part.rstrip("?)").endswith(" ") for part in m[0].split("|"))
            begins, at = spaced and (begins or not m[0].endswith("?")), m.end()
    return max(whole, key=len)


def signatures() -> list[Rule]:
    """All rules in order of priority: versions before families, names before bare identifiers, wordings last."""
    rules = []
    for label, name, also, spdx in NAMED:
        rules.append(Rule("spdx", f"spdx license identifier {spdx}", label, 1.0))
        for verb in VERBS:
            rules.append(Rule(f"{verb} under", f"{verb} under (?:the )?(?:terms of (?:the )?)?(?:{name}|{spdx}(?: licen[cs]e)?)", label, 1.0))
        rules.append(Rule("licen", f"licen[cs]e (?:is )?(?:{spdx})", label, 0.8))
        rules.append(Rule(literal(name), name, label, 0.9))
        rules.append(Rule(literal(also), also, label, 0.7))
    rules += [Rule(literal(regex), regex, label, weight) for label, regex, weight in WORDINGS]
    return rules


def gate(rules: list[Rule]) -> str:
    """One regex over lower-case words, joined by single spaces, that finds any keyword at a word's beginning."""
    keys = sorted({r.keyword for r in rules} | {p for p, _ in PHRASES})
    shortest = [k for k in keys if not any(k != o and k.startswith(o) for o in keys)]
    by_letter = {c: "|".join(k[1:] for k in shortest if k[0] == c) for c in sorted({k[0] for k in shortest})}
    return "(?:^| )(?:" + "|".join(f"{c}(?:{rest})" for c, rest in by_letter.items()) + ")"


def intervals(line: Column, regex: Column) -> Column:
    """(start, stop) in words of all matches of a regex over whole words in a canonical line, which begins and ends with a space.

    split() gives what lies between the matches that regexp_extract_all() gives, so adding up their spaces gives the word numbers.
    """
    whole = F.concat(F.lit("(?<= )(?:"), regex, F.lit(")(?= )"))
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    pairs = F.zip_with(F.split(line, whole), F.regexp_extract_all(line, whole, 0), lambda before, hit: F.struct(spaces(before).alias("b"), spaces(hit).alias("h"), hit.isNotNull().alias("is")))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        first = acc["at"] + p["b"]
        stop = first + p["h"] + 1
        return F.when(p["is"], F.struct((stop - 1).alias("at"), F.concat(acc["found"], F.array(F.struct(first.alias("start"), stop.alias("stop")))).alias("found"))).otherwise(acc)

    return F.aggregate(pairs, start, step, lambda acc: acc["found"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with n_words, base (places of the base phrases: label, start, stop) and detections (label, start, stop, weight) left after
    suppression, in order of their places."""
    rules = signatures()
    safe, back = aside(docs, ("_words", "_line"))
    stay = [k for k, c in enumerate(docs.columns) if c not in ("n_words", "base", "detections")]
    kept = [F.col(safe.columns[k]) for k in stay]
    body = F.coalesce(F.col(safe.columns[docs.columns.index(text)]), F.lit(""))
    split = safe.select(*kept, F.array_remove(F.split(body, SEPARATORS), "").alias("_words"))
    # lower() changes more letters than A-Z, which only opens the gate more often.
    line = F.when(F.lower(F.array_join("_words", " ")).rlike(gate(rules)), F.concat(F.lit(" "), F.translate(F.array_join("_words", " "), UPPER, LOWER), F.lit(" ")))
    lined = split.select(*kept, F.size("_words").cast("long").alias("n_words"), line.alias("_line"))

    def let(value: Column, of: Callable[[Column], Column]) -> Column:
        return F.element_at(F.transform(F.array(value), of), 1)

    phrases = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(label).alias("label")) for p, label in PHRASES])
    at_phrase = lambda r: F.transform(intervals(F.col("_line"), r["p"]), lambda m: F.struct(r["label"].alias("label"), m["start"].cast("long").alias("start"), m["stop"].cast("long").alias("stop")))
    base = F.flatten(F.transform(F.filter(phrases, lambda r: F.contains(F.col("_line"), r["p"])), at_phrase))

    by_keyword: dict[str, list[Column]] = {}
    for i, r in enumerate(rules):
        by_keyword.setdefault(r.keyword, []).append(F.struct(F.lit(r.regex).alias("x"), F.lit(r.label).alias("label"), F.lit(r.weight).alias("w"), F.lit(i).alias("rank")))
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*of).alias("of")) for k, of in by_keyword.items()])
    opened = F.flatten(F.transform(F.filter(known, lambda r: F.contains(F.col("_line"), r["k"])), lambda r: r["of"]))
    # By start, longest first, then priority: an interval is inside an earlier one if it ends no later than one of them.
    place = lambda r: F.transform(intervals(F.col("_line"), r["x"]), lambda m: F.struct(m["start"].alias("start"), (-m["stop"]).alias("neg"), r["rank"].alias("rank"), r["label"].alias("label"), r["w"].alias("w")))
    found = F.sort_array(F.flatten(F.transform(opened, place)))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<label:string,start:bigint,stop:bigint,weight:double>>").alias("kept"))

    def keep(acc: Column, d: Column) -> Column:
        one = F.struct(d["label"].alias("label"), d["start"].cast("long").alias("start"), (-d["neg"]).cast("long").alias("stop"), d["w"].alias("weight"))
        return F.when(-d["neg"] > acc["end"], F.struct((-d["neg"]).alias("end"), F.concat(acc["kept"], F.array(one)).alias("kept"))).otherwise(acc)

    gated = lambda value, kind: F.when(F.col("_line").isNotNull(), value).otherwise(F.array().cast(kind))
    return lined.select(
        *[back[k] for k in stay],
        "n_words",
        gated(base, "array<struct<label:string,start:bigint,stop:bigint>>").alias("base"),
        gated(F.aggregate(found, none, keep, lambda acc: acc["kept"]), "array<struct<label:string,start:bigint,stop:bigint,weight:double>>").alias("detections"),
    )


def score() -> Column:
    """Probability-like sum of the evidence: 1 minus the product of what each distinct label's best weight leaves open. Base phrases weigh 0.9."""
    weights = F.concat(F.transform("base", lambda b: F.struct(b["label"].alias("l"), F.lit(0.9).alias("w"))), F.transform("detections", lambda d: F.struct(d["label"].alias("l"), d["weight"].alias("w"))))
    return F.round(1 - F.aggregate(F.array_distinct(weights), F.lit(1.0), lambda left, x: left * (1 - F.least(x["w"], F.lit(0.95)))), 6)


__all__ = ["PHRASES", "Rule", "gate", "intervals", "scan", "score", "signatures"]
