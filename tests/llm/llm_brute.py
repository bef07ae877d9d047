"""Slow, plain versions of the operators, and awkward rows that all of them must take."""

import collections
import hashlib
import re

SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONG = "In the beginning there were many words that nobody had read before, and then they were all read. "
ODD_TEXTS = [
    None, "", " ", "\n\n", "word", "A b\tC", "\x00\x01", "é", LONG * 3, LONG * 3, LONG * 3 + "tail", LONG.upper() * 3,
    "same words " * 3000, "x" * 70_000, "日本語のテキスト。" * 20, "the\x0bmit license \r\n and\x1cmore", "12 34 5", "<|endoftext|> x",
    "é ​ \U0001F44D\U0001F3FD " * 5, "a\n a \nA\nb", LONG + "\n" + LONG,
]


def odd_rows(spark, extra=True):
    """Null and repeated ids, null columns, odd texts, and columns whose names the operators use themselves."""
    rows = [(i, t, "src" if i % 3 else None, "en" if i % 2 else None, i) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, LONG * 2, None, None, None), (None, None, "src", "en", 1), (8, LONG * 3, "src", "en", 2), (3, "other text", "x", "fr", 3)]
    names = "doc_id long, text string, source string, lang string, n_words long"
    df = spark.createDataFrame(rows, names)
    return df.selectExpr("*", "'mine' AS score", "1 AS n", "2 AS row", "'k' AS kept", "3 AS n_lines", "0 AS spans") if extra else df


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def shingles(text, k=5):
    w = re.findall(SPACE_WORD, lower(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def groups(texts, percent=80):
    """For each text the smallest index that links lead to."""
    sets, inverted, common = [shingles(t) for t in texts], collections.defaultdict(list), collections.Counter()
    for i, s in enumerate(sets):
        for g in s:
            inverted[g].append(i)
    for found in inverted.values():
        common.update((a, b) for x, a in enumerate(found) for b in found[x + 1:])
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if (100 + percent) * c >= percent * (len(sets[a]) + len(sets[b])):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def repeats(texts, length=50):
    """(bytes, removed, runs, digest of the rest) of texts in the order of their ids."""
    raw, first = [(t or "").encode() for t in texts], {}
    for i, b in enumerate(raw):
        for j in range(len(b) - length + 1):
            first.setdefault(b[j:j + length], i)
    out = []
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first[b[j:j + length]] < i:
                gone[j:j + length] = b"\x01" * length
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def common_lines(texts, min_docs=10, keep_first=False):
    """(lines, dropped, rest)."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    lines, where = [(t or "").split("\n") for t in texts], collections.defaultdict(list)
    for i, own in enumerate(lines):
        for k in {key(x) for x in own} - {""}:
            where[k].append(i)
    out = []
    for i, own in enumerate(lines):
        kept = [x for x in own if len(where[key(x)]) < min_docs or keep_first and where[key(x)][0] == i]
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def contamination(texts, items, n=10):
    """(words, hit words, items found)."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = re.findall(ALNUM_WORD, lower(text))
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i:i + k])].add("" if item is None else str(item))
    out = []
    for t in texts:
        w, hit, found = re.findall(ALNUM_WORD, lower(t)), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(w[i:i + k])]
        out.append((len(w), len(hit), sorted(found)))
    return out


def quality(text):
    """(words, code points in words, symbols, repeated lines, words in repeated windows)."""
    text = text or ""
    w = re.findall(SPACE_WORD, text)
    lines = [x for x in text.split("\n") if re.search(SPACE_WORD, x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    again = {p for found in at.values() if len(found) > 1 for i in found for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)
