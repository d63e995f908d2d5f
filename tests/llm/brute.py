"""Plain restatements of the operators' definitions, over small lists."""

import re

import xxhash

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, size=5):
    words = BLANK_WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def near_duplicates(rows, percent=85):
    """``(id, n_shingles, component_id, kept)`` by comparing all pairs."""
    sets = [shingle_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for k, (name, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((name, len(sets[k]), least, name == least))
    return out


def spark_hash(*values):
    """Spark's ``xxhash64`` of strings and longs."""
    seed = 42
    for value in values:
        data = value.encode() if isinstance(value, str) else (value & (2**64 - 1)).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def quality_counts(text):
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    text = text or ""
    words = BLANK_WORD.findall(text)
    windows = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {p for places in windows.values() if len(places) > 1 for k in places for p in range(k, k + 3)}
    lines = [line for line in text.split("\n") if BLANK_WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def longest_first_tiles(a, b, least):
    """Greedy tiling by trying every length and every pair of starts; returns the covered count of ``a``."""
    free_a, free_b = [True] * len(a), [True] * len(b)
    covered = 0
    for size in range(min(len(a), len(b)), least - 1, -1):
        for i in range(len(a) - size + 1):
            for j in range(len(b) - size + 1):
                if a[i : i + size] == b[j : j + size] and all(free_a[i : i + size]) and all(free_b[j : j + size]):
                    free_a[i : i + size] = free_b[j : j + size] = [False] * size
                    covered += size
                    break
    return covered


def best_segments(scores):
    """All maximal scoring segments by their recursive definition: the best subsequence, then left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            key = (total, -(j - i))
            if total > 0 and (best is None or key > best[0]):
                best = (key, i, j + 1)
    if best is None:
        return []
    _, i, j = best
    left, right = best_segments(scores[:i]), best_segments(scores[j:])
    return left + [(i, j)] + [(s + j, e + j) for s, e in right]


def spark_hash_int(number, other, text):
    """Place of a document: ``xxhash64(int, int, string) >>> 2`` as Spark computes it."""
    seed = 42
    for value in (number, other):
        seed = _hash_int(value, seed)
    return xxhash.xxh64_intdigest(text.encode(), seed=seed) >> 2


def _hash_int(value, seed):
    return xxhash.xxh64_intdigest((value & 0xFFFFFFFF).to_bytes(4, "little"), seed=seed)
