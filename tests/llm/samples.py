"""Documents for the tests: edge cases, and texts with planted copies from a seed."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row_id long, cls long, n long"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
EDGE = [
    (1, None, None, None, None, None, 5, 6, 7), (2, "", "en", "a", 0, True, 5, 6, 7), (3, " \t\n ", "en", "a", 4, True, 5, 6, 7),
    (4, "one two", "en", None, 7, None, 5, 6, 7), (5, "One  TWO\n", "en", "b", 9, None, 5, 6, 7),
    (5, "One  TWO\n", "en", "b", 9, None, 5, 6, 7), (None, "one two", None, "b", 7, None, 5, 6, 7),
    (7, LONG, "en", "c", None, None, 5, 6, 7), (8, LONG + " tail", "en", "c", None, None, 5, 6, 7),
    (9, "123 456 !!! 789", "xx", "c", None, None, 5, 6, 7), (10, "ſecret = abcdef12 Ünï😀 x", "de", "c", None, None, 5, 6, 7)]


def corpus(spark, rows):
    """Rows (doc_id, text) or full rows as a documents table with clashing extra columns."""
    full = [r if len(r) == 9 else (*r, "en", "src", None, True, 1, 2, 3) for r in rows]
    return spark.createDataFrame(full, DOCS)


def copies(seed, groups=6, size=9, words=60, most=14):
    """Texts in groups: a base and variants with some words replaced, plus a common passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    common = [word() for _ in range(25)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(words // 3, words))]
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.randint(0, most) // 3):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own += common
            if rng.random() < 0.3:
                own = own[rng.randint(0, 6):]
            out.append(" ".join(own))
    out += out[:3]
    rng.shuffle(out)
    return list(enumerate(out))


def components(n, pairs):
    """Least member of the component of each of ``n`` items."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]
