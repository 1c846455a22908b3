"""License rules against the same regexes without any keyword."""

import re
from itertools import product

from catalens.llm import licenses

SENTENCES = [
    "released under MIT", "It is distributed under GPL 3.0 today", "available under BSD 3-Clause", "published under the terms of the Apache-2.0", "Licensed under ISC", "licenced under the MPL 2.0",
    "relicensed under mit", "released under a mit", "unrelated words", None, "", "the code is released under MIT and the data available under CC BY 4.0", "a license; released under MIT",
]


def ungated(text):
    """Detections by regexes alone."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    line = " " + " ".join(w) + " "
    found = []
    for rank, rule in enumerate(licenses.signatures()):
        for m in re.finditer(f"(?<= )(?:{rule.regex})(?= )", line):
            start = line[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, rank, rule.label))
    kept = [f for f in found if not any(o != f and o[0] <= f[0] and f[1] <= o[1] and ((o[0], o[1]) != (f[0], f[1]) or o[2] < f[2]) for o in found)]
    return sorted((a, b, label) for a, b, _, label in kept)


def scanned(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["doc_id"]: [(d["start"], d["stop"], d["label"]) for d in r["detections"]] for r in rows}


def test_each_verb_is_found_without_the_word_license(spark):
    got = scanned(spark, SENTENCES)
    assert got == {i: ungated(t) for i, t in enumerate(SENTENCES)}
    assert [[label for _, _, label in got[i]] for i in range(6)] == [["mit"], ["gpl-3.0"], ["bsd-3-clause"], ["apache-2.0"], ["isc"], ["mpl-2.0"]]
    assert got[0][0][:2] == (0, 3) and got[12][-1] == (2, 5, "mit")


def matches(regex):
    """All strings that a regex of plain characters, classes, groups and optional parts matches."""
    from re import _parser as sre

    def all_of(items):
        return {"".join(p) for p in product(*[one(op, value) for op, value in items])}

    def one(op, value):
        name = str(op)
        if name == "LITERAL":
            return {chr(value)}
        if name == "IN":
            return {chr(c) for kind, v in value for c in (range(v[0], v[1] + 1) if str(kind) == "RANGE" else [v])}
        if name == "BRANCH":
            return set().union(*[all_of(b) for b in value[1]])
        if name == "SUBPATTERN":
            return all_of(value[3])
        low, high, of = value  # MAX_REPEAT
        return set().union(*[{"".join(p) for p in product(all_of(of), repeat=k)} for k in range(low, high + 1)])

    return all_of(sre.parse(regex))


def test_all_matches_of_all_rules_open_the_gate_and_their_rule():
    gate = re.compile(licenses.gate(licenses.signatures()))
    for rule in licenses.signatures():
        for line in matches(rule.regex):
            assert re.fullmatch(rule.regex, line) and f" {rule.keyword}" in f" {line}" and gate.search(line), (rule, line)


def test_commercial_use_is_found_in_one_word_and_in_several(spark):
    texts = ["for noncommercial use only", "Non-commercial use", "not for commercial use only", "notcommercial use", "nonfor commercial use", "non for commercial use", "for commercial use", "notcommercial"]
    got = scanned(spark, texts)
    assert got == {i: ungated(t) for i, t in enumerate(texts)}
    assert [[label for _, _, label in got[i]] for i in range(8)] == [["no-commercial-use"]] * 6 + [[]] * 2 and got[0] == [(1, 4, "no-commercial-use")]


def test_forms_of_commercial_use_are_those_of_one_rule():
    forms = set().union(*[matches(r.regex) for r in licenses.signatures() if r.label == "no-commercial-use"])
    assert forms == {" ".join((a + b + c + "commercial use" + d).split()) for a in ("not", "non") for b in ("", " ") for c in ("", "for ") for d in ("", " only")}
