"""Brute-force twins and nasty tables for the corpus operators."""

from __future__ import annotations

from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))

#: Nulls in any column, empty and very long texts, ties, repeated rows.
NASTY = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, " \t\n ", "en", "a", 3),
    (4, "one two three", "en", None, 13),
    (4, "one two three", "en", None, 13),
    (5, "One  TWO\tthree", "fr", "b", 14),
    (None, "one two three", "en", "a", 13),
    (6, LONG, "en", "b", len(LONG)),
    (7, LONG + " tail", "en", "b", len(LONG) + 5),
    (8, "12 34 56 !!", "de", "c", 11),
    (9, "é à ü ñ ß", "de", "c", 9),
]


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(ws, k):
    return {b" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({b" ".join(ws)} if ws else set())


def components(rows, k=4, num=85, den=100):
    """{doc_id: (set size, least linked id)} by an inverted index and union-find."""
    sets = [shingle_set(words(t), k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in seen[x]).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for x in s:
            seen[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def later_lines(rows, k=5, num=80, den=100):
    """{doc_id: numbers of lines that an earlier line matches}."""
    sets = [(d, i, shingle_set(words(line), k)) for d, t in sorted(rows) for i, line in enumerate((t or "").split("\n")) if words(line)]
    seen, out = defaultdict(list), defaultdict(list)
    for x, (d, i, s) in enumerate(sets):
        hits = Counter(y for z in s for y in seen[z])
        if any(den * n >= num * (len(s) + len(sets[y][2]) - n) for y, n in hits.items()):
            out[d].append(i)
        for z in s:
            seen[z].append(x)
    return dict(out)
