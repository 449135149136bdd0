"""The quality classifier against plain statistics and a plain walk down the trees."""

import math
import os
import re
from collections import Counter

import pytest

from sparkveil.llm import quality, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain_statistics(text):
    raw = (text or "").encode()
    n = len(raw)
    per = max(n, 1)
    count = lambda chars: sum(raw.count(c.encode()) for c in chars)
    upper, lower, digit = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("abcdefghijklmnopqrstuvwxyz"), count("0123456789")
    marks = sum(33 <= b < 127 and not chr(b).isalnum() for b in raw)
    wide, space, lines = sum(b > 127 for b in raw), count(" \t\n\r"), raw.count(b"\n")
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    nw = len(words)
    pw = max(nw, 1)
    often = Counter(words)
    pairs = list(zip(words, words[1:])) if nw > 2 else []
    each = raw.split(b"\n")
    letters = max(upper + lower, 1)
    return [math.log1p(n), math.log1p(nw), (n - space) / pw, upper / letters, digit / per, marks / per, count("!?") / per, count("|") / per,
            count("#$%&*~^@<>{}\\=+_") / per, count(".,;:") / per, wide / per, space / per, len(often) / pw, sum(a == b for a, b in zip(words, words[1:])) / pw,
            max(often.values(), default=0) / pw, math.log1p(lines), nw / (lines + 1), 1 - len(set(each)) / len(each) if n else 0.0, (upper + lower + wide) / per, (len(pairs) - len(set(pairs))) / pw]


def plain_score(model, x):
    total = model.bias
    for at in model.roots:
        while model.left[at] != at:
            at = model.left[at] + (1 if x[model.feature[at]] > model.threshold[at] else 0)
        total += model.value[at]
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_scores_equal_a_plain_walk(spark):
    docs = queries.table(spark, SF, "documents")
    labels = quality.training_labels(queries.table(spark, SF, "labels"), "quality", 5, 0)
    model = quality.fit_quality(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert len(model.roots) > 10 and set(got) == set(texts)
    for i, text in texts.items():
        assert got[i] == pytest.approx(plain_score(model, plain_statistics(text)), abs=1e-9), i
