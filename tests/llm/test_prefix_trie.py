"""The conversation trie against a brute force over all prefixes, and the search against its definition."""
import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from strata.llm import prefix_trie
from strata.llm.prefix_trie import conversation_trie, order_turns, probes, regrown, two_fattest


def brute(sequences):
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        n = len(members[k])
        below = [out[x] for x in children[k]]
        out[k] = (min(members[k]), len(k), min(members[k[:-1]]) if k else None, n, len(below), sum(b[5] for b in below) or 1,
                  sum(b[6] for b in below) + ((n - 1) * len(k[-1][1].encode()) if k else 0),
                  hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if len(sequences[c]) == len(k)))).encode()).hexdigest())
    return sorted(out.values(), key=str)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[:h[c]] + own[c][h[c]:] for c in own}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 4)
    rnd, rows = random.Random(4), []
    shared = [("user" if k % 2 else None, f"t\xe9xt {k}") for k in range(30)]
    for c in range(60):
        if c % 10 == 5:
            continue   # a base that is absent
        n = rnd.choice([1, 3, 8, 12, 30])
        for k in range(n):
            role, text = shared[k] if rnd.random() < 0.93 else ("assistant", rnd.choice(["", None, "other", "more"]))
            rows.append((c, k * 3 - 1, role, text))
    rows += [(3, None, "system", "first"), (3, None, "system", "first"), (None, 1, "user", "nobody"), (7, 2, "user", "tie"), (7, 2, "user", "tie")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn int, role string, text string, place string, h1 int").repartition(3)
    turns = prefix_trie.materialise(order_turns(df), "turns")
    got = sorted((tuple(r) for r in conversation_trie(*regrown(turns)).collect()), key=str)
    assert got == brute(rebuilt(rows))
    none = order_turns(df.where("false"))
    assert conversation_trie(none, none.select("conv")).count() == 0


def test_numbers_of_the_fat_search(spark):
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 40)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", two_fattest(F.col("a"), F.col("b")).alias("f"),
                                                                probes(F.col("a"), F.col("b")).alias("p")).collect()

    def fattest(a, b):
        return max(range(a + 1, b + 1), key=lambda x: x & -x)
    for r in rows:
        asked, b = [], r["b"]
        while b > r["a"]:   # what the search asks for as long as nothing is hit
            asked.append(fattest(r["a"], b))
            b = asked[-1] - 1
        assert r["f"] == fattest(r["a"], r["b"]) and sorted(r["p"]) == sorted(asked)


def test_the_driver_is_cleared_after_each_batch(spark, monkeypatch):
    """Plans, broadcasts and shuffles of all batches once stayed until the driver's memory was full."""
    released, batches, plain, insert = [], [], prefix_trie.release, prefix_trie.insert_batch
    monkeypatch.setattr(prefix_trie, "release", lambda s: released.append(len(batches)) or plain(s))
    monkeypatch.setattr(prefix_trie, "insert_batch", lambda *a: batches.append(1) or insert(*a))
    rows = [(c, k, "user", f"{k} {c % 2}") for c in (0, 1, 5, 6) for k in range(3)]
    turns = prefix_trie.materialise(order_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")), "turns")
    got = sorted((tuple(r) for r in conversation_trie(*regrown(turns)).collect()), key=str)
    assert got == brute(rebuilt(rows)) and set(released) >= set(range(1, len(batches) + 1))
