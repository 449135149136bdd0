"""Plain single-machine versions of the training-data operators, for comparison in tests."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate, combinations


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard_components(docs):
    """docs: list of (doc_id, text); pairs come from an inverted list of all shingles."""
    sets = [(i, shingles(t)) for i, t in docs]
    by = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    count = {}
    for rows in by.values():
        for a, b in combinations(rows, 2):
            count[a, b] = count.get((a, b), 0) + 1
    links = [(sets[a][0], sets[b][0]) for (a, b), n in count.items()
             if 100 * n >= 75 * (len(sets[a][1]) + len(sets[b][1]) - n)]
    comp = components({i for i, _ in sets}, links)
    return sorted((i, len(s), comp[i]) for i, s in sets)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items):
    """(doc_id, n_words, n_hit, n_items, sha256, contaminated) of each document."""
    windows = {}
    for item, text in items:
        words = bench_words(text)
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[i:i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = bench_words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if got := windows.get(tuple(words[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out)


def line_dedup(docs, min_words=50):
    """doc_id to text without later copies of line runs of min_words words, for documents of distinct ids."""
    lines = {i: t.split("\n") for i, t in sorted(docs) if t is not None}
    count = {i: [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in ls] for i, ls in lines.items()}
    seen = {}
    for ls in lines.values():
        for x in ls:
            seen[x] = seen.get(x, 0) + 1
    runs = {}
    for i, ls in lines.items():
        for s in range(len(ls)):
            words, name = 0, 0
            for e in range(s, len(ls)):
                if seen[ls[e]] < 2:  # no run with this line repeats
                    break
                words, name = words + count[i][e], hash((name, ls[e]))
                if words >= min_words:
                    runs.setdefault((name, e - s), []).append((i, s))
    gone = {i: set() for i in lines}
    for (_, last), at in runs.items():
        first, *later = sorted(at)
        for i, s in later:
            if i == first[0] and s <= first[1] + last:  # overlaps the run that stays
                continue
            gone[i].update(range(s, s + last + 1))
    return {i: "\n".join(x for n, x in enumerate(ls) if n not in gone[i]) for i, ls in lines.items()}


def toxicity(docs, known, k=15, telling=(3, 20, 3.0)):
    """{doc_id: (score, ids of the nearest)} of (doc_id, text) rows by the examples ``known``, {doc_id: label}: dictionaries, no index."""
    def terms(text):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
        words = [w.lower() for w in words]
        out = {}
        for t in [("word", w) for w in words] + [("start", w[:4]) for w in words]:
            out[t] = out.get(t, 0) + 1
        return out

    first = {}
    for i, text in docs:
        if i in known:
            first[i] = min(first.get(i, text or ""), text or "")
    by_text = {}
    for i, text in first.items():
        by_text[text] = min(by_text.get(text, i), i)
    examples = {i: terms(text) for text, i in by_text.items()}
    df = dict.fromkeys((t for e in examples.values() for t in e), 0)
    counted = [(i, terms(text)) for i, text in docs]
    for _, found in counted:
        for t in found:
            if t in df:
                df[t] += 1

    def unit(found):
        weights = {t: (1 + math.log(n)) * (math.log((len(docs) + 1) / (df[t] + 1)) + 1e-3) for t, n in found.items() if t in df}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()}

    lists, seen = {}, {}
    for i, found in examples.items():
        for t, w in unit(found).items():
            lists.setdefault(t, []).append((i, w))
            seen.setdefault(t, [0, 0])[1 - known[i]] += 1
    total = [sum(known[i] == y for i in examples) for y in (1, 0)]

    def speaks(t):
        a, b = (x + 0.5 for x in seen[t])
        c, d = (n - x + 0.5 for n, x in zip(total, seen[t]))
        odds = math.log(a / c) - math.log(b / d)
        return seen[t][0] >= telling[0] and odds >= math.log(telling[1]) and odds / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d) >= telling[2]

    tells = {t for t in lists if speaks(t)}

    def search(found, without=None):
        score, told = {}, {}
        for t, w in unit(found).items():
            for i, v in lists[t]:
                score[i] = score.get(i, 0.0) + w * v
                told[i] = told.get(i, 0.0) + w * v * (t in tells)
        near = sorted((i for i in score if i != without), key=lambda i: (-round(score[i], 12), i))[:k]
        return near, sum(told[i] * known[i] for i in near) / sum(score[i] for i in near) if near else None

    votes = [(search(found, i)[1], known[i]) for i, found in examples.items()]
    lone = [y for v, y in votes if v is None]
    steps = sorted({v for v, _ in votes if v is not None})
    groups = [[y for v, y in votes if v == s] for s in steps]
    sums, sizes = [0, *accumulate(map(sum, groups))], [0, *accumulate(map(len, groups))]
    level, tops = [], [0.0] * len(steps)
    for i in range(len(steps)):  # isotonic regression: the largest over starts of the smallest mean over ends
        for a in range(i + 1):
            tops[a] = min((sums[b + 1] - sums[a]) / (sizes[b + 1] - sizes[a]) for b in range(i, len(steps)))
        level.append(max(tops[: i + 1]))
    out = {}
    for i, found in counted:
        near, vote = search(found)
        at = max(bisect_right(steps, vote + 1e-12) - 1, 0) if near else None
        out[i] = (level[at] if near else sum(lone) / (len(lone) + 1e-9)), near
    return out
