import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from boxrates.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth long, node string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()[:16]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(turns, key=lambda t: t[:3])] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in sorted(paths.items()):
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves = sum(sums[c][0] for c in children[node]) if children[node] else 1
        sums[node] = leaves, (len(members[node]) - 1) * words + sum(sums[c][1] for c in children[node])
    return sorted(
        (
            members[n][0], len(n), members[n[:-1]][0] if n else -1, len(members[n]), len(children[n]), *sums[n],
            hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest(),
        )
        for n in members
    )


def got(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def some(seed, n=120):
    rng = random.Random(seed)
    said = ["hello there", "", None, "a  b\tc", "how are you", "x\x0by\xa0z", "fine"]
    rows = []
    for c in [*range(n), 1000, 1013, -20, -7, 2003]:
        length = 12 if c == 17 else rng.choice([1, 1, 2, 3, 4, 6])
        turns = list(range(length))
        if rng.random() < 0.2:
            turns[0] = None
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(said[: 3 + c % 5])) for t in turns]
    rows += [(40, 0, "user", "tie"), (40, 0, "bot", "tie"), (40, 0, "bot", "tie"), (None, 0, "user", "lost")]
    rows += [(c, t, "user", "copied words here") for c in range(300, 340) for t in range(4)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowded", [1, 60, 10**6])
def test_nodes_equal_brute_force_however_work_is_split(spark, crowded):
    rows = some(crowded)
    assert got(P.prefix_nodes(conversations(spark, rows), crowded=crowded)) == brute(rows)


def test_a_long_conversation_and_a_long_text(spark):
    rows = [(3, t, "user", f"w{t}") for t in range(150)] + [(23, 0, "user", "long " * 400_000), (24, 0, "a", "")]
    for crowded in (10, 10**6):
        assert got(P.prefix_nodes(conversations(spark, rows), crowded=crowded)) == brute(rows)


def test_conversations_without_turns_and_absent_bases(spark):
    rows = [(c, 0, "user", "only one") for c in (1, 2, 3, 4, 5, 21, 45, 46, 47)]
    found = got(P.prefix_nodes(conversations(spark, rows)))
    assert found == brute(rows)
    assert found[0][1] == 0 and found[0][7] != P.NO_ENDS  # some end at the root


def test_many_ids_end_at_one_node_in_several_chunks(spark):
    rows = [(c * 997, 0, "u", "same") for c in range(1, 400)]
    assert got(P.prefix_nodes(conversations(spark, rows), crowded=5)) == brute(rows)


def test_empty_tables(spark):
    assert P.prefix_nodes(conversations(spark, [])).count() == 0
    assert P.prefix_nodes(conversations(spark, [(None, 0, "user", "x")])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_double_array_holds_its_sequences_and_no_others(seed, monkeypatch):
    monkeypatch.setattr(P, "_TRIED", 40)
    rng = random.Random(seed)
    paths = [[rng.randrange(30) for _ in range(rng.randint(1, 6))] for _ in range(200)]
    path = np.array([i for i, p in enumerate(paths) for _ in p])
    level = np.array([j for p in paths for j in range(len(p))])
    codes = np.array([c for p in paths for c in p])
    trie = P.DoubleArray(path, level, codes)
    cells = trie.walk(path, level, codes)
    prefixes = {tuple(paths[i][: j + 1]) for i, j in zip(path, level)}
    assert len(set(cells)) == len(prefixes) == (trie.check >= 0).sum() - 1
    with pytest.raises(KeyError):
        absent = next(p for a in range(30) for b in range(30) if (p := (a, b, 31)) not in prefixes)
        trie.walk(np.zeros(3, int), np.arange(3), np.array(absent))
