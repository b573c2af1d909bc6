"""Plain versions of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def shingles(text, n=5):
    w = words(text, lower=True)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_duplicates(docs):
    """Rows (doc_id, n_shingles, component_id)."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)]


def remove_repeats(docs, size=50):
    """Rows (doc_id, n_words, n_removed, kept text)."""
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    runs = {}
    for k in range(len(w) - 4):
        runs.setdefault(tuple(w[k : k + 5]), []).append(k)
    repeated = {p for at in runs.values() if len(at) > 1 for k in at for p in range(k, k + 5)}
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated), len(w) < 10 or 100 * len(repeated) > 20 * len(w)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
