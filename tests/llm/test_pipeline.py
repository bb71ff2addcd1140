"""Each stage of the pipeline against its operator's meaning, on the small awkward documents."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from loomspan.llm import registry

ROOT = "/root/testdata/sf0.001"
NAMES = [f"op{n}_" for n in range(1, 11)]


def test_registry():
    names = list(registry.queries())
    assert "pipeline" in names and all(sum(x.startswith(n) for x in names) == 1 for n in NAMES)
    assert set(registry.oracles()) <= set(names)


def test_language_keeps_texts_with_letters(spark, docs, rows):
    out = p.language(spark, docs, ROOT)
    assert out.columns == docs.columns
    gone = Counter(r[0] for r in rows) - Counter(r["doc_id"] for r in out.collect())
    assert gone == Counter(r[0] for r in rows if not any(map(str.isalpha, r[1] or "")))


def test_near_duplicates_by_shingles(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = [None, " ", "one two", "One  two", "two one"]
    for _ in range(12):
        base = [word() for _ in range(120)]
        for changes in (0, 1, 2, 2, 3, 6):
            own = list(base)
            for at in r.sample(range(120), changes):
                own[at] = "new" + word()
            texts.append(" ".join(own))
    texts += ["same opening line of many pages " * 3 + word() + " " + " ".join(word() for _ in range(r.randint(2, 30))) for _ in range(30)]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    want = sorted({c: i for i, c in reversed(list(enumerate(comp)))}.values())
    out = p.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), ROOT)
    assert out.columns == ["doc_id", "text"] and sorted(x["doc_id"] for x in out.collect()) == want
    assert 20 < len(want) < len(texts) - 20


def _copies(r: random.Random, n: int, changes: tuple[int, int], words: int = 150) -> list[str]:
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(words)]
    texts = [" ".join(base)]
    for _ in range(n - 1):
        own = list(base)
        for at in r.sample(range(words), r.randint(*changes)):
            own[at] = word()
        texts.append(" ".join(own))
    return texts


def _pairs_of_classes(spark, monkeypatch, texts: list[str]) -> tuple[list[list[tuple]], dict]:
    """The pairs that are looked at, first and last ones, and each text's class."""
    from loomspan.llm import near_copies

    seen, near = [], near_copies._near

    def counted(pairs, *rest):
        seen.append([tuple(x) for x in pairs.collect()])
        return near(pairs, *rest)

    monkeypatch.setattr(near_copies, "_near", counted)
    out = near_copies.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    return seen, {x["doc_id"]: x["component_id"] for x in out}


def test_near_copies_of_a_large_group_do_not_meet_as_pairs(spark, monkeypatch):
    """Of 300 copies of one text most are too far from any other, some are near to the first: pairs don't grow with the group's square."""
    texts = _copies(random.Random(3), 300, (1, 9))
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if comp[i] != comp[j] and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    seen, got = _pairs_of_classes(spark, monkeypatch, texts)
    assert got == dict(enumerate(comp)) and 50 < len(set(comp)) < 250
    assert sum(map(len, seen)) < 20 * len(texts)


def test_near_copies_come_through_fingerprints(spark, monkeypatch):
    """Operator 9's fingerprints of five-word shingles give first candidates: copies of a long text that its ring brings together."""
    from loomspan.llm import near_copies, simhash

    r = random.Random(4)
    texts = [t for _ in range(6) for t in _copies(r, 4, (1, 1), 3000)]
    asked = []
    monkeypatch.setattr(near_copies.simhash, "beside", lambda fps, real=simhash.beside: asked.append(real(fps).collect()) or real(fps))
    monkeypatch.setattr(near_copies, "CENTERS", 0)  # so that only fingerprints name candidates at first
    seen, got = _pairs_of_classes(spark, monkeypatch, texts)
    assert got == {k: k // 4 * 4 for k in range(24)}
    assert len(asked) == 1 and len(seen[0]) >= 6 and len(seen) == 2
    assert asked[0] and all(((u ^ v) & (1 << 64) - 1).bit_count() <= 2 for u, v in asked[0])


def test_mix_repeats_rows(spark, docs):
    from loomspan.llm import mixing

    out = p.mixed(spark, docs, ROOT)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["copies"]
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == +want


def test_decontaminated_keeps_the_rest(spark, docs, rows, tmp_path):
    leak = rows[15][1].split()[45:80]
    leak[4], leak[20] = "zz", "yy"
    spark.createDataFrame([(1, " ".join(leak)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = p.decontaminated(spark, docs, str(tmp_path))
    gone = Counter(r[0] for r in rows) - Counter(r["doc_id"] for r in out.collect())
    assert out.columns == docs.columns and gone == Counter(r[0] for r in rows if " ".join(rows[15][1].split()[45:49]) in (r[1] or ""))


def test_token_ids(spark, docs, rows):
    from tokenizers import Tokenizer

    from loomspan.llm import token_store

    t, out = Tokenizer.from_file(token_store.default_tokenizer()), p.token_ids(spark, docs, ROOT).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == Counter((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    assert p.token_ids(spark, docs.limit(0), ROOT).count() == 0


def test_token_ids_are_given_and_verified(spark, docs, rows, monkeypatch):
    """The result holds the ids themselves; a store that doesn't match its roots stops the stage."""
    from tokenizers import Tokenizer

    from loomspan.llm import token_store

    t = Tokenizer.from_file(token_store.default_tokenizer())
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in p.token_ids(spark, docs, ROOT).collect())
    assert got == Counter((r[0], (*t.encode(r[1] or "", add_special_tokens=False).ids, 2)) for r in rows)
    monkeypatch.setattr(token_store, "_top", lambda roots, real=token_store._top, calls=[]: calls.append(0) or real(roots) + "x" * (len(calls) > 1))
    with pytest.raises(ValueError, match="doesn't match its root"):
        p.token_ids(spark, docs, ROOT)


def test_run_is_its_stages(spark, docs, none, tmp_path):
    """run() on documents equals the stages one after the other; on an empty table it gives nothing."""
    spark.createDataFrame([(1, "some words of a benchmark that nobody copied at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step = docs
    for _, stage in p.STAGES:
        step = stage(spark, step, str(tmp_path))
    pick = lambda df: Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in df.collect())
    got = pick(p.run(spark, str(tmp_path)))
    assert got == pick(step) and sum(got.values()) > 10
    none.write.mode("overwrite").parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/e/benchmark.parquet")
    assert p.run(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n in registry.queries() if n in registry.oracles()])
def test_sql(spark, name):
    import numbers

    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    got, want = registry.queries()[name](spark, ROOT), con.execute(registry.oracles()[name]).df()
    cols = sorted(want.columns)
    plain = lambda v: "-" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, numbers.Real) else str(v)
    tidy = lambda df: sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False)), key=str)
    assert sorted(got.columns) == cols and tidy(got.toPandas()) == tidy(want)


def _kinds_of_joins(df) -> list[str]:
    import re

    return re.findall(r"(\w+Join)\b", df._jdf.queryExecution().sparkPlan().toString())


def test_rows_that_grow_are_not_broadcast(spark, monkeypatch):
    """A ring, or shingles one by one, are many times what Spark sizes them as: however few they look, they are joined by a shuffle."""
    from loomspan.llm import near_copies, simhash

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    seen, kept, stored = [], {}, near_copies.stored
    monkeypatch.setattr(simhash, "components", lambda links, real=simhash.components: seen.append(links) or real(links))
    monkeypatch.setattr(near_copies, "stored", lambda df, path: kept.update({path.rsplit("/", 1)[1]: _kinds_of_joins(df)}) or stored(df, path))
    assert simhash.classes(spark.range(5000).select(F.xxhash64("id").alias("fp"))).count() == 5000
    assert len(seen) == 2 and not [x for df in seen for x in _kinds_of_joins(df) if x.startswith("Broadcast")]
    texts = [t for _ in range(3) for t in _copies(random.Random(1), 4, (1, 3))]
    assert near_copies.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 12
    assert set(kept["shared"]) == set(kept["rest"]) == {"SortMergeJoin"}
