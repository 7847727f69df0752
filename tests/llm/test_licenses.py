"""License scans against brute force: every rule, the suppression, long texts, clashing columns."""

import random
import re

import pytest

from marlstone.llm import license_rules, licenses

LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def brute(text):
    """(start, end, label, kept) of every rule's matches, suppressed one against all others."""
    form = " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))) + " "
    found = []
    for number, rule in enumerate(license_rules.rules()):
        if all(k in form for k in rule.keywords):
            for m in re.finditer(f"(?<= )(?:{rule.regex})(?= )", form):
                start = form[: m.start()].count(" ") - 1
                found.append((start, start + m[0].count(" "), rule.priority, number, rule.label))
    rank = lambda d: (d[0], -d[1], d[2], d[3])
    kept = [not any(o is not d and o[0] <= d[0] and o[1] >= d[1] and o[2] <= d[2] and rank(o) < rank(d) for o in found) for d in found]
    return sorted((d[0], d[1], d[4], k) for d, k in zip(found, kept, strict=True))


def sample(regex, rng):
    """A text that a rule's regex matches: choices taken at random, options left out or put in."""
    text = regex
    while m := re.search(r"\((?:\?:)?([^()]*)\)(\?|\{\d+\})?", text):
        chosen = rng.choice(m[1].split("|")) if m[2] != "?" or rng.random() < 0.5 else ""
        text = text[: m.start()] + chosen + text[m.end() :]
    text = re.sub(r"\.\{(\d+),\d+\}\?", lambda m: "some one "[: int(m[1])].strip() or "", text)
    text = re.sub(r"\[([^\]])[^\]]*\](?:\{(\d+)\}|\+)?", lambda m: m[1].replace("0", "1") * int(m[2] or 1), text)
    return re.sub(" +", " ", re.sub(r"(.)\?", lambda m: m[1] if rng.random() < 0.5 else "", text))


def test_rules_are_sound():
    rng = random.Random(4)
    rules = license_rules.rules()
    assert len(license_rules.clauses()) > 200 and {r.label for r in rules} >= {"mit", "gpl", "apache", "bsd", "mpl", "sspl", "ofl"}
    gates = license_rules.gates()
    for rule in rules:
        texts = [t for t in (sample(rule.regex, rng) for _ in range(20)) if re.fullmatch(rule.regex, t)]
        assert texts, rule
        assert all(k in t for k in rule.keywords for t in texts), rule
        assert all(any(g in t for g in gates) for t in texts), rule


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    rules, out = license_rules.rules(), []
    for _ in range(60):
        parts = [sample(rng.choice(rules).regex, rng) if rng.random() < 0.7 else rng.choice(["Licensed under the", "MIT License", "the é", "version 2", "GNU", "\n"]) for _ in range(rng.randrange(1, 8))]
        out.append(rng.choice([" ", ", ", "\n"]).join(parts))
    return [*out, "", None, "no rule at all", "mit license mit license cc by cc by sa"]


def test_detections_are_those_of_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "x", True) for i, t in enumerate(texts)], "doc_id long, text string, found int, form string, kept boolean")
    rows = {r.doc_id: r.found for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert sorted((d.start, d.end, d.label, d.kept) for d in rows[i]) == brute(t), t


def test_long_texts_take_time_in_proportion(spark):
    n = 60_000
    docs = spark.createDataFrame([(1, "mit license " * n), (2, "w " * 300_000 + "Apache License 2.0")], "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.summary(licenses.scan(docs)).collect()}
    assert (found[1].n_base, found[1].last_word, found[1].n_detections, found[1].labels) == (n, 2 * n - 2, n, "mit")
    assert (found[2].first_word, found[2].labels) == (300_000, "apache")
