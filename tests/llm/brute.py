"""Plain versions of the contracts, for comparison on small tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width=5):
    w = WORD.findall(lower(text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def jaccard_links(sets, percent=80):
    items = [(k, s) for k, s in sets.items() if s]
    by_item = {}
    for k, s in items:
        for x in s:
            by_item.setdefault(x, []).append(k)
    pairs = {(min(a, b), max(a, b)) for ks in by_item.values() if len(ks) < 3000 for i, a in enumerate(ks) for b in ks[i + 1 :] if a != b}
    return [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def stored(spark, folder, rows, schema):
    """Rows as a Parquet table: large texts inside a plan would slow planning down."""
    import uuid

    path = f"{folder}/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)
