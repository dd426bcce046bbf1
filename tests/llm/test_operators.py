"""The other operators against brute force, round trips and held-out labels, on small tables."""
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from strata.llm import decontam, html_extract, langid, packing, queries, secrets, simhash, toxicity, vptree, wavelet
from strata.llm.components import connected_components
from strata.llm.tokens import PieceEncoder
from strata.sources.tables import read_table
from tests.conftest import SF_SMALL

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "  two  spaces\n\n and \t tabs ", "x" * 5000, "é § ^ 日本 😀 <|endoftext|>\x1c\x85 'll don't", "The same text", "The same text"]


def odd_docs(spark):
    rows = [(i, t, "en", "s", 0, "extra") for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, "extra"), (3, "a", "en", "s", 1, "extra")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def empty_docs(spark):
    return odd_docs(spark).where("false")


def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in read_table(spark, SF_SMALL, "documents").collect()]


@pytest.mark.parametrize("path,cut", [(BYTE, "space"), (WORD, "white")])
def test_pieces_give_the_ids_of_the_whole_text(path, cut):
    rnd, encoder = random.Random(3), PieceEncoder(path, cut, max_pieces=100)
    signs = ["a", "b", "The", " ", "  ", "\n", " \n", "\t", " ", "é", "́", "'s", "12", "§", "^", ".", "!!", "<|endoftext|>", "\x1c", " ", "日"]
    plain = Tokenizer.from_file(path)
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    signs += [*added, *[a[:-3] for a in added], *[a.upper() for a in added]]
    fixed = [t for a in added for t in (a, f"{a} b", f"a {a} b", f"a{a}b", f"x {a}{a}", f" {a} ", f"a\n{a}\n", f"{a}\u0301")]
    for turn in range(100):
        texts = fixed if not turn else ["".join(rnd.choices(signs, k=rnd.randint(0, 12))) for _ in range(8)]
        ids, n = encoder.encode([t.encode() for t in texts], 7)
        want = [plain.encode(t, add_special_tokens=False).ids + [7] for t in texts]
        assert ids.tolist() == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]


def check_packing(rows, texts):
    encoder = PieceEncoder(BYTE, "space")
    want = sorted(encoder.encode([t.encode()], 0)[0].tobytes() for t in texts)
    sequences, by_doc = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and 0 < r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"]))
    for parts in sequences.values():
        at = 0
        for offset, length, tier in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    whole, piece = [], b""
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["doc_tokens"], r["start"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert sum(r["length"] for r in rows) == sum(len(w) // 4 for w in want)
    totals = [sum(x[1] for x in s) for s in sequences.values()]
    return sum(1024 - t for t in totals if t & (t - 1)), totals, by_doc, want


def test_packing_of_documents(spark):
    texts = dict(documents(spark))
    rows = packing.pack_documents(read_table(spark, SF_SMALL, "documents"), BYTE).collect()
    padding, _, by_doc, _ = check_packing(rows, texts.values())
    assert padding <= 1024
    encoder = PieceEncoder(BYTE, "space")
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in parts) == encoder.encode([texts[i].encode()], 0)[0].tobytes()


def test_packing_of_odd_rows(spark):
    rows = packing.pack_documents(odd_docs(spark), BYTE).collect()
    check_packing(rows, [t or "" for t in ODD] + ["no id", "a"])
    assert packing.pack_documents(empty_docs(spark), BYTE).count() == 0
    with pytest.raises(ValueError):
        packing.TierPacker((100, 1024), 8)


def test_extraction(spark):
    page = ("<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>"
            "<div class='sidebar'>Side <b>bar</b></div><article><h1>Head</h1><p>One <b>tw</b>o &amp; &lt;x&gt;<p>Three\n four<ul><li>item</ul>"
            "<form><input>Send</form><div id=comments><p>Nice!</p></div></article><footer>&copy; F</footer>")
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>loose"), (None, "u", page), (1, "u", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["text"]) for r in html_extract.extract(pages).collect()]
    want = "Head One two & <x> Three four item"
    assert sorted(got, key=str) == sorted([(1, want), (2, ""), (3, ""), (4, dict(got)[4]), (None, want), (1, want)], key=str)
    assert html_extract.extract(pages.where("false")).count() == 0


def test_extraction_of_pages(spark):
    import html as H
    got = {r["page_id"]: r["text"] for r in queries.op2_html(spark, SF_SMALL).collect()}
    for r in read_table(spark, SF_SMALL, "pages").collect():
        body = re.split("</article>", r["html"].split("<article>", 1)[1])[0]
        body = re.sub(r"</?(b|a|i)\b[^>]*>", "", re.sub(r"</?(p|h1|br|li|ul)\b[^>]*>", " ", body))
        assert got[r["page_id"]] == " ".join(H.unescape(body).split())


def test_messages_give_the_marginals_of_enumeration():
    rng = np.random.default_rng(1)
    parents, depths = np.array([-1, 0, 0, 1, 1, 2]), np.array([0, 1, 1, 2, 2, 2])
    unary, edge = rng.normal(size=6), np.array([[0.8, 0.2], [0.3, 0.7]])
    total, ones = 0.0, np.zeros(6)
    for k in range(64):
        y = [k >> b & 1 for b in range(6)]
        p = np.exp(sum(u for u, v in zip(unary, y) if v)) * np.prod([edge[y[parents[j]], y[j]] for j in range(1, 6)])
        total, ones = total + p, ones + p * np.array(y)
    assert np.allclose(html_extract.marginals(unary, parents, depths, edge), ones / total)


def brute_neighbours(rows, k):
    out = {}
    for q, a in rows:
        if q % 50 == 0:
            scored = [(-float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), i) for i, b in rows if i != q]
            out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in scored)[:k]]
    return out


def test_neighbours_are_exact_with_factor_one(spark):
    table = read_table(spark, SF_SMALL, "embeddings")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in table.collect()]
    want = brute_neighbours(rows, 5)
    for factor, least in ((1.0, 1.0), (1.1, 0.9)):
        got = {}
        for r in vptree.nearest(table, queries=F.col("vec_id") % 50 == 0, factor=factor, shard_rows=150, leaf=8).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        got = {q: [i for _, i in sorted(v)] for q, v in got.items()}
        assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= least
        assert factor > 1 or got == want


def test_neighbours_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (7, [1.0]),
            (None, [1.0, 1.0]), (50, [0.0, 3.0]), (8, [0.0, 1.0])] + [(i, [1.0, 0.0]) for i in range(9, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vptree.nearest(df, queries=F.col("vec_id") % 50 == 0, shard_rows=4).collect()}
    assert [got[0, k] for k in range(1, 6)] == [1, 2, 9, 10, 11] and got[50, 1] == 8 and len(got) == 10
    assert vptree.nearest(df.where("false"), queries=F.lit(True)).count() == 0


def test_toxicity_on_held_out_sentences(spark):
    rnd = random.Random(1)
    syllables = ["ba", "do", "mi", "ren", "sol", "ta", "ver", "lin"]
    rows = []
    for i in range(400):
        words = ["".join(rnd.choices(syllables, k=rnd.randint(1, 3))) for _ in range(30)]
        if i % 5 == 0:
            for w in rnd.sample(["idiotic", "scumbag", "moronic"], 2) * 2:
                words.insert(rnd.randrange(30), w)
        rows.append((" ".join(words), int(i % 5 == 0)))
    model = toxicity.fit(rows[:300])
    p = model.probability(toxicity.evidence([t for t, _ in rows[300:]], model))
    assert np.mean((p >= 0.5) == np.array([y for _, y in rows[300:]])) > 0.97
    plain = model.margins(["badomi"])[0]
    for hidden in ("idiotics", "i.d.i.o.t.i.c", "i d i o t i c", "idio*tic", "moroniic"):
        assert model.margins(toxicity.words_of(hidden)).max() > max(plain, 0) - 0.3, hidden
    out = toxicity.toxicity(odd_docs(spark), model).collect()
    assert len(out) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity(empty_docs(spark), model).count() == 0
    assert toxicity.fit([("a", 1)]) == 1.0 and toxicity.fit([]) == 0.0


def test_shard_files(spark):
    docs = odd_docs(spark)
    files = wavelet.write_shards(docs, WORD, shard_bytes=1500)
    assert files.count() > 1
    rows = sorted(wavelet.read_shards(files, docs.schema["doc_id"].dataType).collect(), key=lambda r: r["start"])
    encoder, at, want = PieceEncoder(WORD, "white"), 0, []
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    want = sorted((str(r["doc_id"]), encoder.encode([(r["text"] or "").encode()], 2)[0].tobytes()) for r in docs.collect())
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in rows) == want
    assert [r["doc_id"] for r in rows] == [None, *sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)]
    shard = wavelet.ShardFile(files.orderBy("shard").first()["path"])
    ids = np.concatenate(list(shard.ids()))
    token = int(ids[0])
    assert all(shard.access(k) == ids[k] for k in range(0, len(ids), 7))
    assert shard.occurrences(token) == np.flatnonzero(ids == token).tolist() and shard.rank(token, len(ids) // 2) == (ids[:len(ids) // 2] == token).sum()
    empty = wavelet.write_shards(empty_docs(spark), WORD)
    assert empty.count() == 0 and wavelet.read_shards(empty, docs.schema["doc_id"].dataType).count() == 0


def test_language_of_documents(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [r for r in queries.op7_language(spark, SF_SMALL).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in got]) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_out_of_place_distance(spark):
    texts = ["abc abd", "Zzz yy!", "", "12 34", "ab" * 300]
    profiles = {"x": ["a", "b", "ab", " a"], "y": ["z", "y", "zz"]}
    got, most = langid._distances(texts, profiles, 4)
    for t, far, total in zip(texts, got, most):
        counts = {}
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            for n in (1, 2, 3):
                for i in range(len(f" {w} ") - n + 1):
                    g = f" {w} "[i:i + n]
                    if g.strip() and not (n > 1 and g == " " * n):
                        counts[g] = counts.get(g, 0) + 1
        top = sorted(counts, key=lambda g: (-counts[g], len(g), g))[:4]
        assert far.tolist() == [sum(abs(p.index(g) - r) if g in p else 4 for r, g in enumerate(top)) for p in profiles.values()]
        assert total == 4 * len(top)
    out = langid.predict_language(odd_docs(spark), profiles, keep=["doc_id"], depth=4).collect()
    assert len(out) == len(ODD) + 2 and {r["lang_pred"] for r in out if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert langid.identify(empty_docs(spark), train=F.lit(True), keep=["doc_id"]).count() == 0


def test_decontamination_in_blocks_and_spans(spark):
    items = spark.createDataFrame([(1, "Alpha beta, gamma"), (2, " ".join(f"w{k}" for k in range(20))), (3, None), (4, "--"), (2, "delta")], "item_id long, text string")
    long = "start " + " ".join(f"W{k}" for k in range(3, 17)) + " end " + "pad " * 300
    rows = [(1, "x alpha BETA gamma y", "c"), (2, long, "c"), (3, None, "c"), (4, "", "c"), (5, "no hit", "c"), (None, "delta", "c"), (5, "alpha-beta.gamma", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit string")
    want = None
    for size in (1 << 20, 30):
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in decontam.scan_contamination(docs, items, max_broadcast_bytes=size).collect())
        assert got == (want or got)
        want = got
    assert want == sorted([("1", 5, 3, ["1"]), ("2", 316, 14, ["2"]), ("3", 0, 0, []), ("4", 0, 0, []), ("5", 2, 0, []), ("None", 1, 1, ["2"]), ("5", 3, 3, ["1"])])
    kept = decontam.decontaminate(docs.drop("n_hit"), items).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["2", "3", "4", "5"]
    cut = {r["text"] for r in decontam.decontaminate(docs.drop("n_hit"), items, remove="spans").collect()}
    assert "x  y" in cut and "no hit" in cut and None in cut
    assert decontam.scan_contamination(docs, items.where("false")).where("n_hit > 0").count() == 0
    assert decontam.scan_contamination(docs.where("false"), items).count() == 0


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, max_bits):
    group = {p: p for p in set(prints)}

    def root(p):
        while group[p] != p:
            p = group[p]
        return p
    each = list(group)
    for i, a in enumerate(each):
        for b in each[:i]:
            if (a ^ b).bit_count() <= max_bits:
                group[root(a)] = root(b)
    return {p: root(p) for p in each}


def test_fingerprints_of_odd_texts(spark):
    got = simhash.fingerprints(odd_docs(spark)).collect()
    want = sorted([(str(r["doc_id"]), brute_print(r["text"])) for r in odd_docs(spark).collect()])
    assert sorted((str(r["doc_id"]), r["fingerprint"] % (1 << 64)) for r in got) == want


@pytest.mark.parametrize("max_bits,max_list", [(2, 64), (2, 2), (1, 2), (0, 2)])
def test_links_of_a_dense_group(spark, max_bits, max_list):
    rnd = random.Random(9)
    prints = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(150):
        p = rnd.choice(prints)
        for _ in range(rnd.randint(1, 3)):
            p ^= 1 << rnd.randrange(64)
        prints.append(p)
    table = spark.createDataFrame([(p - (1 << 64) * (p >> 63),) for p in prints], "fingerprint long")
    links = simhash.fingerprint_links(table, max_bits=max_bits, max_list=max_list)
    got = {r["node"] % (1 << 64): r["component"] % (1 << 64) for r in connected_components(links, "a", "b").collect()}
    want = brute_groups(prints, max_bits)
    mine = {p: got.get(p, p) for p in want}
    by_want, by_mine = {}, {}
    for p in want:
        by_want.setdefault(want[p], set()).add(p)
        by_mine.setdefault(mine[p], set()).add(p)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_mine.values()))


def test_one_document_of_each_group_stays(spark):
    docs = odd_docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]) for r in kept.collect()))
    assert got == sorted(["0", "3", "4", "5", "6", "7", "None"])  # 1, 2 are empty as 0 is; 8 copies 7; one row of id 3
    assert simhash.keep_one(empty_docs(spark)).count() == 0


def test_secrets(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(200):
        value = "".join(rnd.choices("0123456789abcdef", k=18))
        rows.append((i, f"some words password={value} more" if i % 2 else f"order {rnd.randrange(10**15, 10**16)} shipped"))
    rows += [(1000, None), (1001, ""), (None, "token = \"1234567890abcdef1234\""), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("value", F.lit("clash"))
    out = secrets.scan(docs, train_on=F.coalesce(F.col("doc_id"), F.lit(0)) % 4 != 2).collect()
    assert len(out) == 202 and all(r["secret"] == bool(r["label"]) for r in out)
    texts = dict(rows)
    assert all(texts[r["doc_id"]][r["position"]:].startswith(r["value"]) for r in out)
    assert secrets.scan(docs.where("false"), train_on=F.lit(True)).count() == 0


def test_digest_of_items(spark):
    row = queries.op9_decontamination(spark, SF_SMALL).where("n_items = 0").first()
    assert row["items_sha256"] == hashlib.sha256(b"").hexdigest()
