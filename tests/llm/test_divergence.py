"""Source divergences against a brute force over all cells."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strata.llm import divergence
from strata.llm.divergence import shares, source_divergence


def brute(rows, min_df, smooth, top):
    df, count, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        for t in set(terms):
            df[lang, t] += 1
        for t in terms:
            count[lang, source, t] += 1
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= min_df:
            kept[lang].append(t)
    out = []
    for lang, source in groups:
        v, mine = len(kept[lang]), sorted(s for k, s in groups if k == lang)

        def p(names, t):
            n = sum(count[lang, s, u] for s in names for u in kept[lang])
            return 1 + 10**9 * (sum(count[lang, s, t] for s in names) + smooth) // (n + smooth * v)
        own = {t: p([source], t) for t in kept[lang]}
        pairs = [(s, sum(abs(own[t] - p([s], t)) for t in kept[lang])) for s in mine if s != source]
        terms = [(t, own[t] - p(mine, t)) for t in kept[lang] if count[lang, source, t] and own[t] > p(mine, t)]
        for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
            for r, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit], 1):
                out.append((lang, source, part, item, value, r))
    return sorted(out)


@pytest.mark.parametrize("entries", [400_000, 7])
def test_against_brute_force(spark, monkeypatch, entries):
    monkeypatch.setattr(divergence, "FOLD_ENTRIES", entries)
    monkeypatch.setattr(divergence, "SALT_STRIPES", 10)
    rnd = random.Random(2)
    words = [*"abcdefghijklmnop", "Éa", "日本", "İx", "AB", "ab", "1", "-", "z_z"]
    rows = [(" ".join(rnd.choices(words, k=rnd.randint(0, 12))), rnd.choice(["x", "x", "x", "y", None]),
             rnd.choice(["hot", "hot", "hot", "s1", "s2", None, ""])) for _ in range(200)]
    rows += [(None, "x", "silent"), ("", "lonely", "one"), ("few words", "rare", "s1"), ("few", "rare", "s2"), rows[0], rows[0]]
    df = spark.createDataFrame([(t, l, s, 1, "clash", 2) for t, l, s in rows],
                               "text string, lang string, source string, term int, value string, df int").repartition(4)
    got = sorted(tuple(r) for r in source_divergence(df, min_df=5, smooth=5, top=4).collect())
    assert got == brute(rows, 5, 5, 4)
    empty = source_divergence(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_blocks_of_sources_and_spilled_sums(monkeypatch):
    rnd = random.Random(4)
    sources = [f"s{k}" for k in range(11)]
    stripes = [(f"t{k}", *zip(*((s, rnd.randint(1, 9)) for s in rnd.sample(sources, rnd.randint(1, 6))))) for k in range(40)]
    totals = [sum(c for _, ss, cs in stripes for x, c in zip(ss, cs) if x == s) for s in sources]

    def run():
        emitter, out = divergence._Emitter("x", sources, totals, len(stripes), 5, 3), Counter()
        for k in range(0, 40, 8):
            emitter.stripes = stripes[k:k + 8]
            for batch in [*emitter.flush(), *emitter.pairs()]:
                for r in batch.to_pylist():
                    if r["part"] == "pair":
                        out[r["source"], r["item"]] += r["value"]
        return out
    want = run()
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "SUMS", 2)
    assert run() == want and len(want) == 110


def test_shares_are_exact_for_large_counts():
    rnd = random.Random(1)
    for _ in range(1000):
        total = rnd.randint(1, 9 * 10**15)
        count = rnd.randint(0, total)
        assert shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total


def test_long_texts_and_long_terms(monkeypatch):
    monkeypatch.setattr(divergence, "FOLD_BYTES", 5)
    text = b"ab cd abcdefghijk  Ab cd-e" * 3
    assert divergence._terms(text) == Counter(re.findall(rb"[a-z]+", text.lower()))
