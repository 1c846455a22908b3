"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {x for v in at.values() if len(v) > 1 for i in v for x in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def removed(docs, size):
    """(id, text) rows in id order → for each row the set of removed word numbers."""
    seen, out = set(), []
    for _, text in docs:
        w, gone = words(text), set()
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                gone.update(range(i, i + size))
            seen.add(key)
        out.append(gone)
    return out


def shingles(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def components(docs, size, percent):
    """id → smallest id of its component."""
    sets = {i: shingles(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def tiling(doc, item, size):
    """Greedy string tiling by trying all matches each time."""
    used_doc, used_item, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in used_doc and b + n not in used_item:
                    n += 1
                if n >= size and n > best[0]:
                    best = (n, a, b)
        if not best[0]:
            return sorted((a, b, n) for n, a, b in tiles)
        tiles.append(best)
        used_doc.update(range(best[1], best[1] + best[0]))
        used_item.update(range(best[2], best[2] + best[0]))


def segment(word, scores, byte_score):
    """(score, tokens) of the best segmentation, fewer tokens on ties."""
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        n = len(word[i - 1].encode())
        options = [(best[i - 1][0] + n * byte_score, -(best[i - 1][1] + n))]
        options += [(best[j][0] + scores[word[j:i]], -(best[j][1] + 1)) for j in range(i) if word[j:i] in scores]
        score, count = max(options)
        best.append((score, -count))
    return best[-1]
