import random

import numpy as np
import xxhash
from llm_cases import as_rows, both, empty, frame

from cardflow.llm import simhash


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, budget=4):
    """Smallest id reachable over all pairs of rows."""
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(pairs))]


def test_equals_all_pairs(spark):
    docs, pairs = both(spark)
    prints = [(i, brute_print(t)) for i, t in pairs]
    expected = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, components(prints), strict=True)]
    found = as_rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert found == sorted(expected, key=repr)


def planted(seed, centres=30, near=12):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        centre = rng.getrandbits(64)
        out.append(centre)
        for _ in range(near):
            flips = rng.sample(range(64), rng.choice([1, 3, 4, 5, 6]))
            out.append(centre ^ sum(1 << b for b in flips))
    # Many prints under one trie node.
    out += [0xABCDEF << 40 | rng.getrandbits(40) & ~0x3FF for _ in range(200)] + [0, (1 << 64) - 1]
    return out


def test_opened_nodes_lose_no_link(spark):
    prints = planted(3)
    pairs = list(enumerate(prints))
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in pairs]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    expected = sorted(zip((r[1] for r in rows), components(pairs), strict=True))
    for node_rows in (1 << 16, 8):
        found = {r["fp"]: r["component_id"] for r in simhash.components_of(df, node_rows).collect()}
        assert sorted((fp, found[fp]) for fp, _ in expected) == expected


def test_traversal_finds_every_pair():
    bits = np.unique(np.array(planted(4), np.uint64))
    got = {(int(i), int(j)) for a, b in simhash.linked_pairs(bits, np.array([0, len(bits)])) for i, j in zip(a, b, strict=True)}
    every = {(i, j) for j in range(len(bits)) for i in range(j) if int(bits[i] ^ bits[j]).bit_count() <= 4}
    assert got == every


def test_one_row_of_each_group_stays(spark):
    docs = frame(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    pairs = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    groups = components([(i, p) for i, (_, p) in enumerate(pairs)])
    assert kept.count() == len(set(groups))
    alone = [pairs[i][0] for i, g in enumerate(groups) if groups.count(g) == 1]
    assert set(alone) <= {r["doc_id"] for r in kept.collect()}


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0
