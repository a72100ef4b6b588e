"""Near copies the plain way, for comparison."""

import re


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(words[i:i + size]) for i in range(max(len(words) - size, 0) + 1)} if words else set()


def all_pairs(rows):
    """Least doc_id reachable by pairs of texts whose five-word shingle sets are at least 0.8 alike."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or (sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}
