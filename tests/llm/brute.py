"""Plain versions of the operators, for small tables."""

import re
import zlib
from collections import Counter, defaultdict

#: Texts that every operator must take: null, empty, no words, ties, repeats, long words, odd characters.
EDGES = [None, "", " ", "\n\n", "a", "a a a a", "\0x\x7f", "naïve Ünïcödé ßtraße 東京 🙂🙂", "same text", "same text", "x" * 5000, "word " * 3000, "…—“”", "cc by all rights reserved", "tab\tsep\r\nlines\n\n\nend"]


def crc_ids(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def covered(words, n):
    """Marks the words in n-word windows that occur twice or more."""
    count = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = [False] * len(words)
    for i in range(len(words) - n + 1):
        if count[tuple(words[i : i + n])] > 1:
            out[i : i + n] = [True] * n
    return out


def quality(text, limits, line_limit, symbol_limit):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = Counter(lines)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(count), "n_repeat_words": sum(covered(words, 8))}
    out["base_failed"] = len(words) < 20 or 100 * out["n_repeat_words"] > 30 * len(words)
    fine = sum(len(x) for x in lines if count[x] > 1) <= line_limit * len(text) and out["n_symbols"] <= symbol_limit * len(words)
    for n, most in limits.items():
        fine &= sum(len(w) for w, c in zip(words, covered(words, n)) if c) <= most * out["word_chars"]
    return out | {"kept": not out["base_failed"] and fine}


def letter_grams(text):
    """N-grams of one to three letters, runs of anything else as one gap; a gap stands at both ends."""
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    text = re.sub(" +", " ", f" {letters} ")
    for i in range(len(text)):
        if text[i] != " ":
            yield text[i]
        if i + 1 < len(text):
            yield text[i : i + 2]
        if i + 2 < len(text) and text[i + 1] != " ":
            yield text[i : i + 3]


def grams(text, n=5):
    """The set of word n-grams."""
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[0-9A-Za-z\u0080-\U0010FFFF]+", text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def near_groups(texts, threshold=0.8):
    """For each text the least index of its group, by all pairs."""
    sets = [grams(t) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    links = [set() for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = a == b
            if same or (a and b and len(a & b) >= threshold * len(a | b) - 1e-9):
                x, y = sorted((find(i), find(j)))
                label[y] = x
                if not same:
                    links[i].add(b)
                    links[j].add(a)
    return [find(i) for i in range(len(texts))], [len(x) for x in links]


def without_passages(texts, length):
    """(bytes left, removed bytes, removed runs) of each text: bytes in windows that start twice or more anywhere go."""
    raw = [(t or "").encode() for t in texts]
    starts = defaultdict(int)
    for x in raw:
        for i in range(len(x) - length + 1):
            starts[x[i : i + length]] += 1
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if starts[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((bytes(b for b, g in zip(x, gone) if not g), sum(gone), len(re.findall(b"\1+", bytes(gone)))))
    return out


def best_fit(lengths, capacity):
    """The number of bins of best-fit decreasing, one piece after the other."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [x for x in left if x >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left.append(capacity - n)
    return len(left)
