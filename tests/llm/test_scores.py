"""Distances of operator 4 and severities of operator 5 against plain arithmetic."""

from __future__ import annotations

import math
import re

import pytest

from srcquarry.llm import quality_rules, toxicity


def counts_of(text: str | None, lang: str | None) -> dict[str, list[int]]:
    """Histograms by looking at one character and one word after the other."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    chars = "".join(words)
    classes = []
    for pattern in quality_rules.CLASSES.values():
        classes.append(sum(bool(re.fullmatch(pattern, c)) for c in chars))
    classes.append(len(chars.encode()) - len(chars))
    plain = max(len(chars) - sum(classes), 0)
    common = [words.count(w) for w in quality_rules.COMMON.get(lang, [])] or [0] * quality_rules.K
    return {"chars": [*classes, plain], "words": [*common, max(len(words) - sum(common), 0)]}


def distance(p: list[float], q: list[float]) -> float:
    m = [(a + b) / 2 for a, b in zip(p, q)]
    part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    return math.sqrt(max((part(p) + part(q)) / 2, 0.0))


def test_distances_equal_plain_arithmetic(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: (counts_of(r.text, (r.lang or "").lower()), (r.lang or "").lower(), len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()}
    refs: dict = {}
    for counts, lang, _ in rows.values():
        if lang in quality_rules.COMMON:
            for kind, c in counts.items():
                have = refs.setdefault(lang, {}).setdefault(kind, [0] * len(c))
                refs[lang][kind] = [a + b for a, b in zip(have, c)]
    shares = {lang: {kind: [(x + 0.5) / (sum(c) + 0.5 * len(c)) for x in c] for kind, c in kinds.items()} for lang, kinds in refs.items()}
    seen = 0
    for r in quality_rules.quality_rules(docs).collect():
        counts, lang, n = rows[r.doc_id]
        if lang not in shares:
            assert r.chars_distance is None and r.words_distance is None
            continue
        want = {}
        for kind, c in counts.items():
            q = shares[lang][kind]
            total = sum(c) + 20.0
            want[kind] = distance([(x + 20.0 * s) / total for x, s in zip(c, q)], q)
        assert r.chars_distance == pytest.approx(want["chars"], abs=1e-6) and r.words_distance == pytest.approx(want["words"], abs=1e-6)
        far = n >= 50 and (want["chars"] > 0.32 or want["words"] > 0.22)
        assert r.kept == (not r.base_failed and not far)
        seen += 1
    assert seen > 100


def test_severities_equal_plain_arithmetic(spark, sf):
    """Expected grade of each text from the model's weights and thresholds alone, and the cut."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: (r.severity, r.toxic) for r in toxicity.score(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        found = set().union(*map(toxicity._features, set((r.text or "").lower().split())), set())
        z = sum(model.weights.get(f, 0.0) for f in found)
        want = sum(1 / (1 + math.exp(-(z - t))) for t in model.thresholds)
        assert got[r.doc_id][0] == pytest.approx(want, abs=1e-3) and got[r.doc_id][1] == (got[r.doc_id][0] >= toxicity.CUT)
