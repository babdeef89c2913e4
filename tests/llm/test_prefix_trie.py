import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from cardflow.llm import prefix_trie as p

SCHEMA = "conv_id long, turn long, role string, text string, key string, block string, row string, x string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
EMPTY = hashlib.sha256(b"").hexdigest()


def conversations(rows):
    made = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            made[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in made.items()}


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain(made):
    members, last = defaultdict(list), {}
    for c, turns in sorted(made.items()):
        name = b""
        for d in range(len(turns) + 1):
            if d:
                name = hashlib.sha256(name + repr(turns[d - 1]).encode()).digest()
            members[d, name].append(c)
            last[d, name] = (None if not d else up, len(turns[d - 1][1]) if d else 0)
            up = (d, name)
    children, sums = defaultdict(list), {}
    for node, (up, _) in last.items():
        if up:
            children[up].append(node)
    for node in sorted(members, reverse=True, key=lambda n: n[0]):
        own = (len(members[node]) - 1) * last[node][1]
        below = [sums[k] for k in children[node]]
        sums[node] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    out = []
    for node, who in members.items():
        ends = [c for c in who if len(made[c]) == node[0]]
        up = last[node][0]
        out.append((who[0], node[0], members[up][0] if up else None, len(who), len(children[node]), *sums[node],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else EMPTY))
    return sorted(out, key=repr)


def cases(seed, families=3, deep=0):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(100 * families), 40 * families):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ok", "", None, "été 漢", f"own {c}"])))
    first = [("user", "same first turn"), ("assistant", "and answer")]
    for c in range(1000, 1030):
        rows += [(c, t, *first[t]) for t in range(2)] + [(c, 5, "user", f"q{c % 3}")] * (c % 2)
    # Exact copies, a null turn, a conversation of one turn and a deep one with a near copy.
    rows += [(c, t, "user", f"copy {t}") for c in range(2000, 2025) for t in (2, 0, 1)]
    rows += [(3001, None, "user", "before all"), (3001, 0, "user", "then"), (-150, 0, "u", "negative"), (-105, 3, None, None)]
    rows += [(c, t, "user", f"t{t}") for c in (4000, 4007) for t in range(deep + (c == 4007) * 3)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, partitions=4):
    return spark.createDataFrame([(*r, "k", "b", "r", "x") for r in rows], SCHEMA).repartition(partitions)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("heavy_rows", [10**6, 3])
def test_rebuilt_equals_plain(spark, heavy_rows):
    rows = cases(1, deep=600)
    found = p.rebuilt_trie(frame(spark, rows), heavy_rows)
    assert result(found) == plain(rebuild(conversations(rows)))


def test_given_conversations_over_many_tasks(spark):
    rows = cases(2, deep=2000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = result(p.conversation_trie(frame(spark, rows)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == plain(conversations(rows))


def test_shards_of_many_small_blocks(spark):
    # Wide enough for several blocks: 1,300 conversations that all begin alike.
    rows = [(c, t, "u", f"{t}-{c % (3 if t < 2 else 50) if t else 0}") for c in range(1300) for t in range(c % 4 + 1)]
    assert result(p.conversation_trie(frame(spark, rows), 50)) == plain(conversations(rows))


def test_nested_chains_need_many_jumps(spark):
    # Conversation k shares k turns with the one before it.
    rows = [(k, t, "u", f"s{t}" if t < k else f"own {k}") for k in range(1, 60) for t in range(k + 1)]
    assert result(p.conversation_trie(frame(spark, rows))) == plain(conversations(rows))


def test_turns_of_equal_number_and_repeated_rows(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (1, 0, "u", "b"), (2, 0, "u", "b"), (2, 0, "u", "a"), (2, 0, "u", "a"), (None, 0, "u", "a")]
    found = result(p.conversation_trie(frame(spark, rows)))
    # Both have the same turns in one order: four nodes, all shared.
    assert [r[1:6] for r in sorted(found, key=lambda r: r[1])] == [(d, None if not d else 1, 2, int(d < 3), 1) for d in range(4)]


def test_turnless_conversation_is_a_member_of_the_root(spark):
    c = next(c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6 > 1 and c % 100)
    rows = [(c, 0, "u", "dropped"), (300, 0, "u", "x")]
    found = result(p.rebuilt_trie(frame(spark, rows)))
    assert found == plain(rebuild(conversations(rows)))
    assert found[0][-1] == hashlib.sha256(str(c).encode()).hexdigest() and found[0][3] == 2


def test_very_long_text_and_empty_table(spark):
    rows = [(c, t, "u", ("long " * 200_000) + str(c * t)) for c in (1, 2) for t in (0, 1)]
    assert result(p.conversation_trie(frame(spark, rows))) == plain(conversations(rows))
    assert p.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0
