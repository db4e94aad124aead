"""Edge rows and plain, slow versions of what the operators compute."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def words(text):
    return WORD.findall(text or "")


def sentence(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, changes):
    draw, parts = random.Random(seed), text.split(" ")
    for _ in range(changes):
        parts[draw.randrange(len(parts))] = f"e{draw.randrange(10**6)}"
    return " ".join(parts)


LONG = sentence(1, 4000)
EDGE_TEXTS = [
    (1, ""),
    (2, None),
    (3, "one"),
    (4, "The cat sat on the mat\nand the dog\nand the dog"),
    (5, "The cat sat on the mat\nand the dog\nand the dog"),
    (6, LONG),
    (7, edited(LONG, 2, 40)),
    (8, "\x1c weird text 日本語 \U0001f600 é ½ <|endoftext|> it's  two\t\n tabs "),
    (9, LONG.upper()),
    (10, "a" * 20_000),
    (11, "word " * 3000),
    (4, "The cat sat on the mat\nand the dog\nand the dog"),  # the same row again
    (None, "a text without an id, " + sentence(3, 60)),
    (-5, sentence(4, 300) + " " + sentence(1, 60)),
    (12, " \n\t "),
    (13, sentence(4, 300)),
    (14, "İSTANBUL ß ÀÉ mail me: x.y@mail7.example.com, +1 (559) 555-3817 4539 1488 0343 6467 10.0.0.256 10.0.0.25"),
]


def edge_docs(spark, rows=EDGE_TEXTS):
    """The rows with columns whose names the operators use themselves."""
    clash = [
        "id", "rid", "row", "key", "part", "place", "block", "train", "word", "c", "n", "size", "n_words", "whole", "runs",
        "bucket", "border", "_key", "_text", "_first", "content", "prefix", "start", "kept", "score", "quality", "spans",
    ]
    data = [(doc_id, text, *[i * j for j in range(len(clash))]) for i, (doc_id, text) in enumerate(rows)]
    schema = "doc_id BIGINT, text STRING, " + ", ".join(f"`{name}` INT" for name in clash)
    return spark.createDataFrame(data, schema)


def empty_docs(spark):
    return edge_docs(spark, [])


def shingles(text, n=5):
    found = words(lower(text or ""))
    if len(found) >= n:
        return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)}
    return {tuple(found)} if found else set()


def components(sets, percent=80):
    """Smallest id reachable, for {id: set}."""
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def without_repeats(texts, length=20):
    """{id: kept words}; windows judged on the input, ids in order."""
    seen, kept = {}, {}
    for i in sorted(texts):
        found = words(texts[i])
        covered = [False] * len(found)
        for at in range(len(found) - length + 1):
            window = tuple(found[at : at + length])
            if window in seen:
                covered[at : at + length] = [True] * length
            else:
                seen[window] = i
        kept[i] = [word for word, gone in zip(found, covered) if not gone]
    return kept


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    def digits(m):
        return re.sub("[^0-9]", "", m)

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(kind, m.start(), m.end()) for kind, p, ok in rules for m in re.finditer(p, text or "") if ok(m.group())]
