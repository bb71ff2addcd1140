"""Spelling variants, token counts and repaired conversations against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest

from loomspan.llm import spelling, token_counts, turns
from loomspan.llm.common import work_folder

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Spelling


def plain_variants(rows, least=5, count=3, every=97, factor=2):
    n: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % every == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1:]
            n[w] += 1
    n = Counter({w: k for w, k in n.items() if len(w) >= least and k >= count})

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out, forms = {}, {}
    for w in n:
        own = [x for x in n if near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= factor * n[w] else None
        out[w] = len(own)

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return sorted(((w, forms[w], root(w), n[w], out[w], n[forms[w]] if forms[w] else None) for w in n), key=str)


def test_variants(spark, docs, rows, none):
    r = random.Random(4)
    letters = "abç"
    typed = ["".join(r.choice(letters) for _ in range(r.randint(5, 6))) for _ in range(300)]
    texts = [(k, " ".join(r.choices(typed, k=40)) + r.choice(["", " ABAAA×÷ é1é"])) for k in range(60)]
    # Chains of forms, ties of counts, repeated letters, runs that lose a letter, a very long run with a near one.
    texts += [(100, "horses " * 3 + "horse " * 7 + "worse " * 15 + "worsen " * 15 + "hhorse " * 3 + "lllll " * 9 + "llllll " * 4 + "lllllll " * 3), (None, "abcde " * 5 + "abcdf " * 5 + "abcdg " * 2)]
    texts += [(101, f"{'xy' * 3000} " * 3 + f"{'xy' * 1500}z{'xy' * 1500} " * 9), (102, None), (103, ""), (100, "horses")]
    for every in (97, 3):
        got = spelling.variants(spark.createDataFrame(texts, "doc_id long, text string"), every=every)
        assert sorted(map(tuple, got.collect()), key=str) == plain_variants(texts, every=every)
    assert sorted(map(tuple, spelling.variants(docs).collect()), key=str) == plain_variants([x[:2] for x in rows])
    empty = spelling.variants(none)
    assert empty.collect() == [] and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_offers_leave_sequences():
    r = random.Random(1)
    for _ in range(200):
        w = "".join(r.choice("abé") for _ in range(r.randint(1, 9)))
        left = [w[:i] + w[i + 1:] for i in range(len(w))]
        assert [(k, s) for _, k, s, _ in spelling.offers_of(w)] == [spelling.key_of(x) for x in left]
        assert sorted(left[i] for i, _, _, opens in spelling.offers_of(w) if opens) == sorted(set(left))


def test_long_texts_are_cut_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 7)
    text = "abc defghijklmnop, q " * 9 + "r" * 40
    parts = list(spelling._stretches(text))
    assert "".join(parts) == text and len(parts) > 3
    assert [w for p in parts for w in re.findall("[a-z]+", p)] == re.findall("[a-z]+", text)


# Token counts


def test_normal_forms_have_equal_counts(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_counts.default_tokenizer())
    r = random.Random(5)
    bits = [" ", "  ", "\n", "\t\x0b\x0c\r", "a", "Word", "É", "ß", "İ", "ǅ", ".", "'S", "'ll", "'", "12", "\xa0", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "日本", "🙂", "H̱", "é", "İ", " ", "K", "ϓ", "ΑΣ ", "\x00", "\x1c", "\x85", "Ⱥ"]
    texts = [None, "", " ", "<|startoftext|> a <|endoftext|>"] + ["".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    rows = list(enumerate(texts)) + [(None, "Two words"), (3, "again"), (3, "again")]
    cache = work_folder(spark, "cache")
    docs = spark.createDataFrame([(*x, "n", 7, "d") for x in rows], "doc_id long, text string, n_tokens string, n_bytes int, digest string").repartition(5)
    got = token_counts.count_tokens(docs, cache, token_counts.default_tokenizer(), limit=9).collect()
    want = [(d, len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
    assert sorted(((g[0], g[1], g[2]) for g in got), key=str) == sorted(want, key=str)
    assert all(g["over_limit"] == (g["n_tokens"] > 9) for g in got)


@pytest.mark.parametrize("bound", [48 << 20, 0])
def test_cache(spark, docs, rows, none, bound, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "BROADCAST_BYTES", bound)
    path, cache = token_counts.default_tokenizer(), work_folder(spark, "cache")
    plain = Tokenizer.from_file(path)
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(plain.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in rows), key=str)
    stored = lambda: spark.read.parquet(f"{cache}/tokenizer={token_counts.version(path)}").count()
    first = docs.where("doc_id % 2 = 0")
    token_counts.count_tokens(first, cache, path).collect()
    half = stored()
    assert sorted(map(tuple, token_counts.count_tokens(docs, cache, path).collect()), key=str) == want
    whole = stored()  # only what missed was encoded, copies once
    assert 0 < half < whole == len({" ".join(re.split("[\x20\x09-\x0D]+", (r[1] or "").lower())).strip() for r in rows})
    assert sorted(map(tuple, token_counts.count_tokens(docs, cache, path).collect()), key=str) == want and stored() == whole
    assert token_counts.count_tokens(none, cache, path).collect() == [] and stored() == whole
    # What stands in the cache is what is answered; a digest that two calls appended counts once.
    spark.read.parquet(f"{cache}/tokenizer={token_counts.version(path)}").write.mode("append").parquet(f"{cache}/tokenizer={token_counts.version(path)}")
    assert sorted(map(tuple, token_counts.count_tokens(docs, cache, path).collect()), key=str) == want


# Conversations


def plain_repair(rows):
    """rows (conv_id, turn, role, text): the contract, by shortest paths over (row, state) with whole audits."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        say = lambda x: " " if x is None else x
        k = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            own += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            t = re.sub("[\x20\x09-\x0D]+$", "", text)
            faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
            seen.add((role, text))
        heap, done, result = [(0, "", 0, "", ())], set(), None
        while heap:
            cost, audit, i, made, rows_made = heapq.heappop(heap)
            state = made if made in ("", "s") else made[-1]
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == len(own) and state in ("", "a"):
                result = cost, audit, rows_made
                break
            legal = lambda r: r == {"": "su", "s": "u", "u": "a", "a": "u"}[state] or state == "" and r in ("s", "u")
            for name in ("user", "assistant"):
                if legal(name[0]):
                    heapq.heappush(heap, (cost + 5, audit + "I", i, made + name[0], (*rows_made, f"{name}:")))
            if i < len(own):
                _, role, text = own[i]
                more = 5 if faults[i] == "truncated" else 0
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, made, rows_made))
                if faults[i] not in ("blank", "duplicate"):
                    if role[:1] and legal(role[:1]):
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, made + role[:1], (*rows_made, f"{role}:{text}")))
                    for name in ("user", "assistant"):
                        if legal(name[0]):
                            heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, made + name[0], (*rows_made, f"{name}:{text}")))
        cost, audit, rows_made = result
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(rows_made).encode()).hexdigest()))
    return sorted(out, key=str)


def some_turns(r, conv, n, long=False):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "uber", "User"]
    texts = ["Hi.", "Fine!", "Why?", "cut off", "", None, " \n", "Ends with space. \t", "x", "é"]
    turn = lambda k: r.choice([None, k % 9 if not long else 5, k]) if r.random() < 0.3 else k
    own = [(conv, turn(k), r.choice(roles) if r.random() < 0.5 else ("user", "assistant")[k % 2], r.choice(texts) if r.random() < 0.5 else f"t{k}.") for k in range(n)]
    return own + r.choices(own, k=n // 7)


def test_repair(spark):
    r = random.Random(9)
    rows = [x for conv in range(300) for x in some_turns(r, conv, r.randint(1, 11))] + some_turns(r, None, 8) + some_turns(r, 1000, 90)
    rows += [(2000 + k, None, "user", None) for k in range(40)] + [(3000 + k, k, "system", "Only this.") for k in range(30)]
    frame = spark.createDataFrame([(*x, 3, "f") for x in rows], "conv_id long, turn long, role string, text string, copies int, fault string").repartition(5)
    want = plain_repair(rows)
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    # Repaired at once, and by stretches: the same.
    for whole in (turns.WHOLE, 5):
        got = turns.repair(turns.damaged(frame), whole)
        assert got.columns == columns and sorted(map(tuple, got.collect()), key=str) == want
    assert turns.repair(turns.damaged(frame.where("false"))).collect() == []


def test_repair_of_long_conversations(spark):
    r = random.Random(10)
    rows = some_turns(r, 1, 700, long=True) + some_turns(r, 2, 900) + [(3, 7, "user", f"Line {k}.") for k in range(600)] + [(4, None, "assistant", "Same.")] * 600 + some_turns(r, 5, 4)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert sorted(map(tuple, turns.repair(turns.damaged(frame), 300).collect()), key=str) == plain_repair(rows)


# What a call leaves


def test_substrings_leave_no_tables(spark, docs):
    from loomspan.llm import substring

    before = set(spark.catalog.listTables())
    rows = substring.dedupe(docs)
    assert set(spark.catalog.listTables()) == before and rows.count() == docs.count()
