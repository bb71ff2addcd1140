"""Operators against brute force over small, awkward documents."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loomspan.llm import decontaminate, elias_fano, langid, media, mixing, ngram_lm, pii, sharding, simhash, substring, token_store
from loomspan.llm.common import Store, work_folder
from loomspan.llm.components import components
from loomspan.llm.elias_fano import EliasFano

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall(t or "")


def multi(df):
    return sorted(map(tuple, df.collect()), key=str)


# Token ids


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    e, plain = token_store.encoder(token_store.default_tokenizer()), Tokenizer.from_file(token_store.default_tokenizer())
    r = random.Random(3)
    bits = [" ", " ", "\n", "  ", "\n\n", "\t", "a", "word", "The", "é", "ß", ".", ",", "!!", "...", "'s", "'", "12", "\xa0", "\r\n", "<|endoftext|>", "日本", "🙂", "\u200d", ";)", "\x1c", "Ġ", "Ċ", "\x00", "-", "e\u0301", "\u2028", "!?!?!?"]
    texts = ["", None, " ", "a  b", "don't stop.\nNow", "x \n\n y", "tab\tend ", "é ñ ½ ² !!", "foo.\nBar baz, qux; 12 3.4", " lead", "a\x1cb c", "　wide　space", "<|endoftext|> x", "a <|endoftext|> b", "q <|endoftext|> z", "\n", "\n\n", " \n", "\n ", "a\n", "a \n b"]
    texts += ["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(4000)]
    flat, ends = e.encode(pa.array(texts, pa.string()), 2)
    starts = [0, *ends[:-1]]
    for t, a, z in zip(texts, starts, ends):
        assert flat[a:z].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 2], t


def test_encoder_holds_little(monkeypatch):
    """A remembered word takes less than 100 bytes, texts that are encoded as they are go to the tokenizer a few at a time, and what is forgotten is encoded anew."""
    import gc
    import tracemalloc

    e, r = token_store.Encoder(token_store.default_tokenizer()), random.Random(6)
    texts = [" ".join("".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(5000)) for _ in range(20)]
    gc.collect()
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    try:
        e.encode(pa.array(texts), 2)
        gc.collect()
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert held < 100 * 100_000
    monkeypatch.setattr(token_store, "CACHE", 3000)
    for t in texts + texts[:2]:
        flat, _ = e.encode(pa.array([t]), 2)
        assert flat.tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2]
    calls, whole = [], e._whole
    monkeypatch.setattr(e, "_whole", lambda few: calls.append(sum(map(len, few))) or whole(few))
    e.encode(pa.array([t + "\t" for t in texts]), 2)
    assert sum(calls) >= 20 * len(texts[0]) and max(calls) <= 1 << 18


def test_reading_a_store_holds_no_ids_of_other_documents():
    runs = list(token_store._runs(np.array([5, 2 << 20, 1 << 19, 1 << 19, 1, 0])))
    assert runs == [(0, 1), (1, 2), (2, 4), (4, 6)] and list(token_store._runs(np.zeros(0, np.int64))) == []


def test_cuts_follow_content():
    r = np.random.default_rng(1)
    x = r.integers(0, 50000, 60000).astype(np.uint16)
    a = token_store.cuts(x, np.array([60000]))[0]
    b = token_store.cuts(np.concatenate((x[:5000], x[5001:])), np.array([59999]))[0]
    assert a[-1] == 60000 and len({v - 1 for v in a if v > 20000} & set(b)) > 20
    assert max(np.diff([0, *a])) <= token_store.MOST


def test_token_store(spark, docs, rows, none, monkeypatch):
    at = work_folder(spark, "t")
    token_store.write_store(docs, at, token_store.default_tokenizer())
    got = token_store.read_store(spark, at).collect()
    e = token_store.encoder(token_store.default_tokenizer())
    want = sorted(((r[0], tuple(e.tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in rows), key=str)
    assert sorted(((g["doc_id"], tuple(g["ids"])) for g in got), key=str) == want
    got.sort(key=lambda g: g["start"])
    ids = [g["doc_id"] for g in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    at_ = 0
    for g in got:
        assert (g["start"], g["n_tokens"]) == (at_, len(g["ids"])) and g["ids_crc32"] == zlib.crc32(np.array(g["ids"], "<u4").tobytes())
        at_ += g["n_tokens"]
    # Files stand in ascending doc_id order, part after part; the roots notice a recipe that is missing.
    stand = [(r["part"], r["rank"]) for r in sorted(spark.read.parquet(f"{at}/recipes").collect(), key=lambda r: r["start"])]
    assert stand == sorted(stand) and len(stand) == len(rows)
    part = max(p for p, _ in stand)
    whole = token_store._recipes
    monkeypatch.setattr(token_store, "_recipes", lambda *a: whole(*a).where(f"NOT (part = {part} AND rank = 1)"))
    assert not token_store.verify_store(spark, at)
    monkeypatch.undo()
    index = spark.read.parquet(f"{at}/index")
    assert index.count() == index.select("digest").distinct().count() and token_store.verify_store(spark, at)
    name = index.select("pack").first()[0]
    with Store(at).open(f"packs/{name}.bin") as f:
        data = bytearray(f.read())
    data[10] ^= 255
    Store(at).write(f"packs/{name}.bin", [bytes(data)])
    with pytest.raises(Exception, match="damaged|[Zz]std|decompress"):
        token_store.read_store(spark, at).collect()
    empty = work_folder(spark, "t")
    token_store.write_store(none, empty, token_store.default_tokenizer())
    assert token_store.read_store(spark, empty).count() == 0


# Shards and mixes


def test_shards(spark, docs, rows, none):
    got = sharding.interleave(docs, 4).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for g in got:
        slots[g["shard"]].append(g["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    of = Counter()
    for g in sharding.interleave(docs, 4, carry=docs.columns).collect():
        of[g["shard"], g["row"]["source"]] += 1
    for s in {r[3] for r in rows}:
        n = sum(r[3] == s for r in rows)
        assert all(abs(of[k, s] - n / 4) < 2 for k in range(4))
    assert multi(sharding.interleave(docs, 4)) == multi(sharding.interleave(docs.repartition(7), 4))
    # The placement, from ranks over whole sources and the whole table.
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    t = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), sharding.source_key(F.col("source")).alias("s"))
    t = t.withColumn("h", F.xxhash64(F.lit(7), "doc_id", "text_crc32", "size"))
    rank, n = F.row_number().over(Window.partitionBy("s").orderBy(F.expr("shiftrightunsigned(h, 52)"), "h", "doc_id")), F.count("*").over(Window.partitionBy("s"))
    plain = sorted(t.withColumn("f", (rank - sharding.unit(F.concat(F.lit("7:"), "s"))) / n).collect(), key=lambda r: (r["f"], r["h"], r["s"]))
    want = Counter((r["doc_id"], k * 4 // len(plain), k - -(-(k * 4 // len(plain)) * len(plain) // 4)) for k, r in enumerate(plain))
    assert Counter((g["doc_id"], g["shard"], g["slot"]) for g in got) == want
    assert sharding.interleave(none, 4).count() == 0


def level(sizes, weights, total):
    """Targets by resharing the excess until none is above."""
    target, open_ = {}, set(sizes)
    while True:
        rest = total - sum(target.values())
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if rest * weights[s] / w > 2 * sizes[s]]
        if not over:
            return target | {s: rest * weights[s] / w for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            open_.discard(s)
        if not open_:
            return target


def test_mix(docs, rows, none):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = level(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    by_size = {sizes[s]: want[s] for s in names}
    taken, most = Counter(), Counter()
    for g in got:
        assert g["target"] == pytest.approx(by_size[g["source_size"]]) and g["taken"] <= 2 * g["size"] and g["taken"] == g["copies"] * g["size"]
        taken[g["source_size"]] += g["taken"]
        most[g["source_size"]] = max(most[g["source_size"]], g["size"])
    assert all(abs(taken[k] - by_size[k]) <= 2 * most[k] for k in taken)
    assert multi(mixing.mix(docs)) == multi(mixing.mix(docs.repartition(5))) and mixing.mix(none).count() == 0


# Near duplicates


def brute_simhash(t):
    w = words((t or "").translate(LOW))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    fp = [brute_simhash(r[1]) for r in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {c: min((r[0] for r, d in zip(rows, comp) if d == c and r[0] is not None), default=None) for c in comp}
    want = Counter((r[0], f"{f:016x}", least[c]) for r, f, c in zip(rows, fp, comp))
    assert Counter((g["doc_id"], g["fingerprint"], g["component_id"]) for g in got) == want
    left = simhash.deduplicate(docs).collect()
    assert Counter(x["doc_id"] for x in left if x["doc_id"] is not None) == Counter(set(least.values()) - {None})
    assert simhash.near_duplicates(none).count() == 0


def test_chain_misses_no_pair(spark):
    r = np.random.default_rng(3)
    base = r.integers(-(1 << 62), 1 << 62, 60)
    near = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in r.integers(0, 63, (6, 2))]
    every = sorted({int(b) for b in base} | set(near))
    got = {x["fp"]: x["root"] for x in simhash.classes(spark.createDataFrame([(x,) for x in every], "fp long")).collect()}
    root = {x: x for x in every}
    changed = True
    while changed:
        changed = False
        for a in every:
            for b in every:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert len(set(got.values())) == len(set(root.values())) and all((got[a] == got[b]) == (root[a] == root[b]) for a in every for b in every[:40])


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 7), (101, 102), (300, 200), (5, 30)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 1 for k in range(2, 41)} | {101: 100, 102: 100, 300: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# Substrings


def test_substrings(docs, rows, none):
    got = Counter((g["doc_id"], g["n_words"], g["n_removed"], g["kept"]) for g in substring.dedupe(docs).collect())
    all_words, seen = [words(r[1]) for r in rows], defaultdict(list)
    for d, w in enumerate(all_words):
        for s in range(len(w) - 34):
            seen[tuple(w[s:s + 35])].append((d, s))
    gone = {(d, i) for at in seen.values() if len(at) > 1 for d, s in at for i in range(s, s + 35)}
    want = Counter()
    for d, (r, w) in enumerate(zip(rows, all_words)):
        kept = [x for i, x in enumerate(w) if (d, i) not in gone]
        want[r[0], len(w), len(w) - len(kept), " ".join(kept)] += 1
    assert got == want and substring.dedupe(none).count() == 0


def test_entries_depend_on_the_text_alone(rows, monkeypatch):
    def found(texts):
        out = [[] for _ in texts]
        for block in substring.entries(pa.array(texts, pa.string())):
            for d, *entry in zip(*(x.tolist() for x in block)):
                out[d].append(tuple(entry))
        return out

    texts = [r[1] for r in rows]
    whole = [found([t])[0] for t in texts]
    monkeypatch.setattr(substring, "BLOCK", 300)
    assert sum(map(len, whole)) > 100 and found(texts) == whole and found(texts[7:]) == whole[7:] and [found([t])[0] for t in texts] == whole


def test_index_merges_runs(spark):
    index = substring.FingerprintIndex(spark, work_folder(spark, "i"), 2, most=2)
    for batch in ([(1, 1, 1), (2, 2, 1)], [(2, 3, 1)], [(4, 4, 2)], [(1, 1, 1)]):
        index.append(spark.createDataFrame(batch, "fp long, span long, n long"))
    assert len(index.runs) <= 2
    assert multi(index.shared()) == [(1, 1, 2, 1), (2, 2, 1, 2), (2, 3, 1, 2), (4, 4, 2, 1)]
    index.close()


# Decontamination


def test_leaks(spark, docs, rows, none):
    item = rows[15][1].split()[45:75]
    some = list(item)
    some[3], some[15], some[22] = "zz", "yy", "xx"
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item).upper()), (3, " ".join(some)), (4, "too short"), (5, None), (6, ""), (7, " ".join(f"other{k}" for k in range(30)))], "item_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    leaky = {r[0] for r in rows if " ".join(item) in (r[1] or "")}
    assert leaky and {g["doc_id"] for g in got if g["item_id"] == 1} == leaky == {g["doc_id"] for g in got if g["item_id"] == 3}
    assert {g["item_id"] for g in got} == {1, 3} and all(g["overlap"] == 1 for g in got if g["item_id"] == 1) and len(got) == 2 * len(leaky)
    clean = decontaminate.clean(docs, bench)
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r[0] for r in rows if r[0] not in leaky) and clean.columns == docs.columns
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_masks_miss_nothing():
    """For an item of any length, whatever fifth of its tokens differs, some mask stands where none does."""
    from itertools import combinations

    for n in range(1, decontaminate.WINDOW + 1):
        places = [{p + o for o in (*range(a), *range(a + g, a + g + b))} for a, g, b in decontaminate.masks_of(n) for p in range(n - (a + g + b) + 1)]
        for bad in combinations(range(n), n - -(-decontaminate.P * n // decontaminate.Q)):
            assert any(not s & set(bad) for s in places), (n, bad)


def test_leaks_equal_a_plain_scan(spark):
    r = random.Random(11)
    word = lambda: r.choice("abcdefghij")
    items = [[word() + word() for _ in range(n)] for n in (1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, 11, 12, 15, 19, 20, 21, 35, 70, 140)]
    items += [items[5], []]
    docs = [None, "", "--"]
    for k in range(160):
        own = list(r.choice(items[:-1]))
        for at in r.sample(range(len(own)), r.randint(0, max(1, len(own) // 4))):
            own[at] = word() + word() + word()
        own = own[r.choice([0, 0, 0, 1, 3]):]
        docs.append(" ".join([word() for _ in range(r.randint(0, 30))] + own + [word() for _ in range(r.choice([0, 5, 30]))]))
    docs.append(docs[20])
    cut = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = set()
    for d, t in enumerate(docs):
        w = cut(t)
        for i, m in enumerate(items[:-2]):
            if m in items[:i]:
                continue
            n, found = min(20, len(m)), []
            for place in range(-len(m) + 1, len(w)):
                same = [0 <= place + j < len(w) and w[place + j] == x for j, x in enumerate(m)]
                best = max(sum(same[s:s + n]) for s in range(len(m) - n + 1))
                if 5 * best >= 4 * n:
                    found.append((-best, place))
            if found:
                want.add((d, i, min(found)[1], -min(found)[0], n))
    clash = "doc_id long, text string, w string, m string, h string, p string, item_id string"
    docs_df = spark.createDataFrame([(d, t, *"wmhpi") for d, t in enumerate(docs)] + [(None, " ".join(items[-3]), *"wmhpi")], clash)
    got = decontaminate.leaks(docs_df, spark.createDataFrame([(i, " ".join(m), "n") for i, m in enumerate(items)], "item_id long, text string, b string"))
    rows = {(x["doc_id"], x["item_id"], x["place"], x["matched"], x["compared"]) for x in got.collect()}
    assert {x for x in rows if x[0] is not None} == want and {x[1] for x in rows if x[0] is None} >= {len(items) - 3}
    assert len({x[1] for x in want}) > 15


# Languages


def test_languages(spark, none):
    import random

    r = random.Random(1)
    make = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(n))
    one, two = ["the", "ing", "er", "ou"], ["schw", "ö", "ich", "ung"]
    train = spark.createDataFrame([(make(one, 80), "en", 1) for _ in range(30)] + [(make(two, 80), "de", 2) for _ in range(30)] + [(make(one, 5), None, 3), (None, "en", 4)], "text string, lang string, score int")
    model = langid.fit(train)
    assert model.languages == ["de", "en"]
    mixed = make(one, 60) + " " + make(two, 30)
    parts = model.proportions(mixed)
    assert set(parts) == {"de", "en"} and 0.4 < parts["en"] < 0.8
    assert model.proportions(make(two, 50)) == {"de": 1.0}
    rows = spark.createDataFrame([(1, make(one, 50), "x"), (2, make(two, 2), "x"), (3, None, "x"), (4, "", "x"), (5, "123 !?", "x"), (6, mixed, "x")], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.predict(rows, model, keep=["doc_id"]).collect()}
    assert {k: v["lang_pred"] for k, v in got.items()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en"}
    assert got[3]["score"] == 0 and all(0 <= v["score"] <= 1 for v in got.values())
    assert langid.fit(none).languages == [] and langid.fit(none).predict("abc") == ("und", 0.0)
    assert langid.predict(rows, model, keep=rows.columns).columns == [*rows.columns, "lang_pred", "score"]


def test_mixtures_equal_plain_inference(spark, none):
    """Proportions and the chosen set against EM in plain loops over the same probabilities; odd texts, ties and clashing names."""
    r = random.Random(8)
    sounds = {"aa": ["ka", "ro", "mi"], "bb": ["the", "ing", "er"], "cc": ["sch", "ung", "ei"]}
    make = lambda lang, n: " ".join("".join(r.choice(sounds[lang]) for _ in range(3)) for _ in range(n))
    rows = [(k, make(lang, 60), lang) for lang in sounds for k in range(25)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]

    def em(at, c, langs, pi):
        for _ in range(langid.ROUNDS):
            new = [0.0] * len(langs)
            for b, n in zip(at, c):
                total = sum(q * model.p[b, k] for q, k in zip(pi, langs))
                for j, k in enumerate(langs):
                    new[j] += n * pi[j] * model.p[b, k] / total
            pi = [x / sum(new) for x in new]
        return pi, sum(n * math.log(sum(q * model.p[b, k] for q, k in zip(pi, langs))) for b, n in zip(at, c))

    for text in [make("aa", 30), make("aa", 30) + " " + make("bb", 20), make("bb", 9) + " " + make("cc", 9), make("aa", 20) + " " + make("bb", 20) + " " + make("cc", 20), "ka"]:
        at, c = (x.tolist() for x in langid.trigrams(text))
        single = [sum(n * math.log(model.p[b, k]) for b, n in zip(at, c)) for k in range(3)]
        chosen, best, pi = [max(range(3), key=lambda k: (single[k], -k))], max(single), [1.0]
        whole, _ = em(at, c, [0, 1, 2], [1 / 3] * 3)
        for k in sorted(range(3), key=lambda k: -whole[k]):
            if k not in chosen:
                w = max(whole[k], 0.05)
                more, ll = em(at, c, [*chosen, k], [q * (1 - w) for q in pi] + [w])
                if ll - best <= langid.PENALTY * math.log(1 + sum(c)):
                    break
                chosen, best, pi = [*chosen, k], ll, more
        assert model.proportions(text) == pytest.approx({model.languages[k]: q for k, q in zip(chosen, pi)}, abs=1e-9), text
    assert len(model.proportions(make("aa", 30) + " " + make("bb", 30))) == 2
    odd = [(1, None, "x", 1.0), (2, "", "x", 1.0), (3, "12 !?", "x", 1.0), (4, "schung " * 200_000, "x", 1.0), (4, "schung " * 200_000, "x", 1.0), (None, "therer", "x", 1.0)]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, p double")
    got = langid.predict(df, model, keep=["doc_id", "p"]).collect()
    assert [(g["doc_id"], g["lang_pred"]) for g in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "cc"), (4, "cc"), (None, "bb")] and got[3] == got[4] and all(0 <= g["score"] <= 1 for g in got)
    same = langid.Model(["aa", "bb"], np.ones((langid.BUCKETS, 2)))
    assert same.predict("any words at all")[0] == "aa"
    assert langid.predict(none, model, keep=["doc_id"]).count() == 0 and langid.fit(none).predict("words") == ("und", 0.0)


# Personal data

_EMAIL, _IPX, _CARDX, _PHONEX = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_spans(t):
    n = lambda s: len(re.sub("[^0-9]", "", s))
    checks = (("email", _EMAIL, lambda s: True), ("ip", _IPX, lambda s: all(int(p) <= 255 for p in s.split("."))), ("card", _CARDX, lambda s: 12 <= n(s) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))), ("phone", _PHONEX, lambda s: 9 <= n(s) <= 15))
    found = [(m.start(), k, m.end()) for k, p, ok in checks for m in re.finditer(p, t) if ok(m[0])]
    return sorted(((s, e, k) for s, k, e in found), key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_base_spans():
    import random

    r = random.Random(2)
    fixed = ["a@b.co", "x@y", "a.b@c-d.e.f@g.h", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111-1111 1111", "+1 (917) 555-2670 x", "+12", "@", "a@@b.c", "4111111111111111 5", "é+1 917 555 2670"]
    for t in fixed + ["".join(r.choice("ab@.-+ 0123456789()4") for _ in range(r.randint(0, 60))) for _ in range(3000)]:
        assert pii.base_spans(t) == brute_spans(t), t
    pii.base_spans("a" * 200_000 + "1" * 200_000 + "+1" + " " * 200_000)


def test_gradients():
    from loomspan.llm.bilstm_crf import BiLstmCrf

    r = np.random.default_rng(1)
    m = BiLstmCrf(6, 3, embed=3, hidden=4)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x, y = r.integers(0, 6, (3, 5)), r.integers(0, 3, (3, 5))
    _, g = m._gradients(x, y)
    for k, v in m.w.items():
        at = tuple(r.integers(0, n) for n in v.shape)
        old, e = v[at], 1e-5
        v[at] = old + e
        up = m._gradients(x, y)[0]
        v[at] = old - e
        down = m._gradients(x, y)[0]
        v[at] = old
        assert (up - down) / (2 * e) == pytest.approx(g[k][at], abs=2e-4), k


def test_model_adds_spans(spark, none):
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("thernoile") for _ in range(r.randint(2, 7)))
    data = lambda: r.choice([f"{word()}.{word()}@{word()}.example.com", ".".join(str(r.randrange(256)) for _ in range(4)), "4111111111111111", f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"])
    texts = [" ".join([*(word() for _ in range(20)), data(), *(word() for _ in range(20)), str(r.randrange(10**6))]) for _ in range(120)]
    model = pii.train(texts)
    found = sum(bool(pii.model_spans(model, [f"{word()} {word()} {n} {word()} {word()}"])[0]) for n in ["(917) 555-2670", "joe.smith @ mail.example.com", "10[.]20[.]30[.]40", "4111.1111.1111.1111"])
    assert found >= 3
    assert not any(pii.model_spans(model, [" ".join(word() for _ in range(60)) + " 1999 12" for _ in range(20)]))
    rows = [(1, texts[0]), (2, None), (3, ""), (None, "plain words"), (1, texts[0]), (4, "call (917) 555-2670 now")]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert Counter((g["doc_id"], g["base_sha256"]) for g in got) == Counter((d, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in brute_spans(t or "")).encode()).hexdigest()) for d, t in rows)
    with pytest.warns(UserWarning, match="email, ip, card, phone"):
        assert pii.find(none, None).count() == 0 and pii.train([]) is None
    # Around signs the spans are those of scoring and decoding whole texts; a very long text, other columns and copies change nothing.
    long = [" ".join(word() for _ in range(r.randint(0, 40))).join(["", data(), " joe dot smith at mail dot example ", f" 10[.]20[.]30[.]{r.randrange(99)} ", ""]) for _ in range(60)]
    assert pii.model_spans(model, long) == pii.model_spans(model, long, whole=True) and sum(map(len, pii.model_spans(model, long))) > 60
    huge = " ".join(long) * 8
    clash = spark.createDataFrame([(1, huge, "x", 5), (1, huge, "y", 6)], "doc_id long, text string, spans string, n_email int")
    a, b = pii.find(clash, model).collect()
    assert a == b and a["n_email"] == sum(k == "email" for _, _, k in brute_spans(huge))


def test_forms_that_were_held_out(spark):
    """Recall on respellings that training never sees: separators and brackets of other kinds."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("thernoile") for _ in range(r.randint(2, 7)))
    data = lambda: r.choice([f"{word()}.{word()}@{word()}.example.com", ".".join(str(r.randrange(256)) for _ in range(4)), "4111111111111111", f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"])
    model = pii.train([" ".join([*(word() for _ in range(20)), data(), *(word() for _ in range(20)), str(r.randrange(10**6))]) for _ in range(160)])
    forms = [lambda: f"{word()}{{@}}{word()}.example.com", lambda: f"{word()} [at] {word()} dot example dot org", lambda: "10{.}20{.}30{.}" + str(r.randrange(256)), lambda: "4111:1111:1111:1111", lambda: f"{r.randrange(200, 999)}/{r.randrange(200, 999)}/{r.randrange(1000, 9999)}"]
    hit = [bool(pii.model_spans(model, [f"{word()} {word()} {f()} {word()} {word()}"])[0]) for f in forms for _ in range(20)]
    assert sum(hit) >= 0.4 * len(hit), [sum(hit[i:i + 20]) for i in range(0, 100, 20)]


# Scores


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1 << 56), (7, 7), (500, 1 << 50), (5000, 6000), (300, 20)])
def test_elias_fano(n, universe):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, universe, n, dtype=np.uint64))
    e = EliasFano(EliasFano.build(v, universe))
    assert (e.get(np.arange(n)) == v).all()
    q = np.concatenate((v, r.integers(0, universe, 300, dtype=np.uint64)))
    at = e.find(q)
    assert ((at >= 0) == np.isin(q, v)).all() and (n == 0 or (v[at[at >= 0]] == q[at >= 0]).all())
    assert n == 0 or (e.successor(q) == np.searchsorted(v, q)).all()


def test_lookups_select_once(monkeypatch):
    """What a scoring task does most: a search selects one bit for each number asked for, a step from a number to the next one too."""
    r = np.random.default_rng(5)
    crowd = np.uint64(77 << 40) + r.integers(0, 1 << 20, 3000, dtype=np.uint64)  # buckets and gaps longer than a word
    v = np.unique(np.concatenate((r.integers(0, 1 << 55, 20000, dtype=np.uint64), crowd, np.array([(1 << 56) - 1], np.uint64))))
    e, asked, select = EliasFano(EliasFano.build(v, 1 << 56)), [], elias_fano._select
    monkeypatch.setattr(elias_fano, "_select", lambda word, k: asked.append(len(word)) or select(word, k))
    q = np.sort(np.concatenate((v[::2], r.integers(0, 1 << 55, 10000, dtype=np.uint64))))
    at = e.find(q)
    assert ((at >= 0) == np.isin(q, v)).all() and (v[at[at >= 0]] == q[at >= 0]).all()
    assert sum(asked) < 1.2 * len(q)  # once more only in such a bucket
    asked.clear()
    assert (e.step(np.arange(len(v) - 1)) == np.diff(v)).all()
    assert sum(asked) < 1.2 * len(v)
    for width in (1, 8, 64):
        ones = r.integers(0, 1 << 63, 500, dtype=np.uint64) | np.uint64(1) << np.uint64(width - 1)
        for k in range(int(np.bitwise_count(ones).min())):
            want = [[b for b in range(64) if int(x) >> b & 1][k] for x in ones]
            assert (select(ones, np.full(len(ones), k)) == want).all()


def test_scores(spark, docs, rows, none):
    at = work_folder(spark, "m")
    train = [r for r in rows if zlib.crc32((str(r[0]) if r[0] is not None else "").encode()) % 5 != 1]
    ngram_lm.fit(docs.where(~langid.held_out(docs["doc_id"], 5, 1)), at)
    got = ngram_lm.score(docs, at, keep=["doc_id", "n_chars"]).collect()
    tokens = lambda t: [*words((t or "").translate(LOW)), "\n"]
    c, pair, triple = Counter(), Counter(), Counter()
    for r in train:
        w = tokens(r[1])
        c.update(w)
        pair.update(zip(["^", *w], w))
        triple.update(zip(["^", *w], w, w[1:]))
    n, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    want = Counter((r[0], len(w := tokens(r[1])), sum(x in c for x in w), n, round(sum(math.log10(p1(x)) for x in w), 6)) for r in rows)
    assert Counter((g["doc_id"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 6)) for g in got) == want
    # The model's own sum, with each shard's discounts. Counts of the small corpus have fewer than 256 values: quantising changes nothing.
    trie = ngram_lm.Trie(at)
    name = lambda a: np.uint64(ngram_lm._hash({"^": ngram_lm.START, "\n": ngram_lm.END}.get(a, a.encode())))
    home = {p: int(trie.layout.of_pair(np.array([name(p[0])]), np.array([name(p[1])]))[0]) for p in pair}
    per = defaultdict(lambda: ([], []))
    for p, k in home.items():
        per[k][0].append(pair[p])
    for (a, b, _), k in triple.items():
        per[home[a, b]][1].append(k)
    rate = lambda x: x.count(1) / (x.count(1) + 2 * x.count(2)) if x.count(1) and x.count(2) else 0.5
    discount = {k: (rate(x), rate(y)) for k, (x, y) in per.items()}
    ctx, mass, more = Counter(), Counter(), Counter((a, b) for a, b, _ in triple)
    for (a, b), k in pair.items():
        ctx[a] += k
        mass[a] += discount[home[a, b]][0]

    def p2(a, b):
        return ((pair[a, b] - discount[home[a, b]][0] if pair[a, b] else 0) + mass[a] * p1(b)) / ctx[a] if ctx[a] else p1(b)

    def p3(a, b, w):
        if not more[a, b]:
            return p2(b, w)
        d = discount[home[a, b]][1]
        return ((triple[a, b, w] - d if triple[a, b, w] else 0) + d * more[a, b] * p2(b, w)) / pair[a, b]

    for g in got:
        text = next(r[1] for r in rows if r[0] == g["doc_id"] and r[4] == g["n_chars"])
        w = tokens(text)
        want = math.log10(p2("^", w[0])) + sum(math.log10(p3(a, b, x)) for a, b, x in zip(["^", *w], w, w[1:]))
        assert g["score"] == pytest.approx(want, rel=1e-6), text
    vocabulary = [*c, "never seen"]
    assert sum(p2("^", w) for w in c) == pytest.approx(1, abs=0.01) and len(vocabulary) > 10
    empty = work_folder(spark, "m")
    ngram_lm.fit(none, empty)
    assert ngram_lm.score(none, empty).count() == 0
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in ngram_lm.score(docs.limit(3), empty).collect())


def test_files_are_mapped_once_for_many_blocks(spark, docs, rows, monkeypatch):
    at = work_folder(spark, "m")
    ngram_lm.fit(docs, at)
    trie, mapped, real = ngram_lm.Trie(at), [], ngram_lm.Store.mapped
    monkeypatch.setattr(ngram_lm.Store, "mapped", lambda self, name: mapped.append(name) or real(self, name))
    parts = [pa.array([r[1] for r in rows[i::5]] + ["never seen", None], pa.string()) for i in range(5)]
    alone = [trie.score(x) for x in parts]
    mapped.clear()
    both = list(trie.scores([ngram_lm.Asked(x, trie.layout) for x in parts]))
    assert len(mapped) == len(set(mapped)) <= trie.layout.shards
    assert all((x[k] == y[k]).all() for x, y in zip(alone, both) for k in x)


# Media


def test_media(spark, docs, rows, none):
    spark.dataSource.register(media.MediaArchive)
    at = work_folder(spark, "a")
    media.to_media(docs).write.format("media_archive").mode("append").option("path", at).save()
    got = media.features(spark.read.format("media_archive").option("path", at).option("range_bytes", "300").load()).collect()
    want = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want[r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((g["doc_id"], g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) for g in got) == want
    same = defaultdict(set)
    for r in got:
        same[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in same.values())
    for r in rows:
        # Each stored form is an image of these samples, and the feature is that of its cells.
        b = (r[1] or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        png = media.to_png(p)
        x = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(float)
        cells = [x[i * len(x) // 8:(i + 1) * len(x) // 8, j * 8:j * 8 + 8] for i in range(8) for j in range(8)]
        bits = "".join(str(int(c.size and c.mean() > x.mean() + 1e-9)) for c in cells)
        assert same[hashlib.sha256(p).hexdigest()] == {(len(png), hashlib.sha256(png).hexdigest(), f"{len(x)}x64:{int(x.mean())}:{int(bits, 2):016x}")}
    for r in got:
        assert r["media_bytes"] > 0 and re.fullmatch(r"\d+x64:\d+:[0-9a-f]{16}", r["feature"])
    empty = work_folder(spark, "a")
    media.to_media(none).write.format("media_archive").mode("append").option("path", empty).save()
    assert spark.read.format("media_archive").option("path", empty).load().count() == 0


def test_directory_blocks(spark, tmp_path, monkeypatch):
    """Ranges of any size give each member once, whatever blocks the directory has; very long members and clashing names too."""
    monkeypatch.setattr(media, "RANGE_BYTES", 700)
    writer = media._Writer({"path": str(tmp_path)}, spark.createDataFrame([], "doc_id long, n_bytes long, media binary").schema, False)
    members = [bytes([k]) * n for k, n in enumerate([10, 5000, 1, 699, 700, 701, 0, 20] * 4)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(m)], pa.int64()), pa.array([m])], names=["doc_id", "n_bytes", "media"]) for k, m in enumerate(members)]
    done = writer.write(iter(batches))
    store = Store(str(tmp_path))
    assert media.directory(store, done.name)["id"].to_pylist() == list(range(len(members)))
    for step in (100, 700, 1500, 10**6):
        got = [i for a in range(0, done.size + 1, step) for i in media.directory(store, done.name, a, a + step)["id"].to_pylist()]
        assert got == list(range(len(members)))
    long = spark.createDataFrame([(1, "x y " * 200_000, "m"), (2, None, "n")], "doc_id long, text string, media string")
    at = work_folder(spark, "a")
    media.to_media(long).write.format("media_archive").mode("append").option("path", at).save()
    assert sorted((r["doc_id"], r["n_bytes"]) for r in spark.read.format("media_archive").option("path", at).load().collect()) == [(1, 800_000), (2, 0)]


def test_member_is_read_again(tmp_path):
    store, data = Store(str(tmp_path)), b"abcdefgh" * 10
    store.write("a.arc", [data])

    class Flaky:
        def __init__(self):
            self.opened = 0

        def open(self, name):
            self.opened += 1
            if self.opened < 3:
                raise OSError("gone")
            return store.open(name)

    f = Flaky()
    assert media.read_member(f, "a.arc", 8, 16, zlib.crc32(data[8:24])) == data[8:24] and f.opened == 3
    with pytest.raises(ValueError, match="CRC"):
        media.read_member(store, "a.arc", 8, 16, 1)
    with pytest.raises(ValueError, match="damaged"):
        media.from_png(media.to_png(bytes(64))[:-2] + b"xx")
