"""Brute-force versions of what the operators return."""

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def near_components(rows):
    """doc_id -> (set size, smallest reachable id), comparing every pair that shares a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    shared = Counter((a, b) for members in lists.values() for a in members for b in members if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def quality_row(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if count[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def coverage(text, limits, line_limit, symbol_limit):
    """Whether the method keeps the text, counted on word tuples."""
    w = WORD.findall(text or "")
    total = sum(map(len, w))
    ok = sum(c in "#*$%&|<>" for c in text or "") <= symbol_limit * len(w)
    for n, most in limits.items():
        count = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        hit = {j for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        ok &= sum(len(w[j]) for j in hit) <= most * total
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line in seen:
            dup += sum(map(len, WORD.findall(line)))
        seen.add(line)
    return ok and dup <= line_limit * total


def prose(rng, n):
    return " ".join(rng.choice(("the", "of", "and")) if rng.random() < 0.2 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else w + "x" for w in text.split(" "))


def awkward_rows():
    """Nulls, empties, ties, repeats, odd white space, a long text, other scripts."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    texts = [None, "", " \t\n\r\x0b\x0c ", "one", "One two", "a b c d e", "A B C D E", "a b c d e f g", "same same same same same same same same same same same same", "line\nline\n\nline\nother words here", "x" * 5000, "naïve café ß Ω Σίσυφος 日本語 テスト 😀 😀\u00a0z", "\u2003em\u2003space\x85next\x1cfs", "<|endoftext|> it's we'll 123 4567  8\n\n9<|startoftext|>", "# | * $ % & < > #|*", long, edited(rng, long, 0.01), prose(rng, 60)]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows


def rows_of(df):
    return [tuple(r) for r in df.collect()]
