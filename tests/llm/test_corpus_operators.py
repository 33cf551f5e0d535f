import random
import zlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], KIND)


ODD = [None, "", "   \n\t ", "a", "A", "a b c d", "a b c d e", "A B C D E", "x " * 3000, "é" * 5000, "|#|", "▁ x", "word " * 60]


def near_copies(n, seed=1, length=120):
    """Groups of near copies at all distances, chains, and a passage that all share."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = r.choices(vocabulary, k=60)
    out = []
    for g in range(6):
        base = r.choices(vocabulary, k=length)
        for _ in range(n):
            own = list(base)
            for _ in range(r.randint(0, 7)):
                own[r.randrange(length)] = r.choice(vocabulary)
            out.append(" ".join(own))
            if r.random() < 0.5:
                base = own  # drifts: chains whose ends don't link
        for _ in range(n // 2):
            out.append(" ".join(passage + r.choices(vocabulary, k=r.randint(5, 60))))
    r.shuffle(out)
    return out + ["", None, "short one", "short one"]


def test_join_matches_all_pairs(spark, documents):
    from parallaxis.llm.ngram_join import join

    rows = spark.createDataFrame(documents, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join(rows).collect()}
    assert got == brute.components(documents)


@pytest.mark.parametrize("heavy,table", [(16, 1 << 19), (4, 50), (1000, 10)])
def test_join_on_groups_chains_and_shared_passages(spark, heavy, table):
    from parallaxis.llm.ngram_join import join

    texts = near_copies(24)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join(frame(spark, texts), heavy=heavy, table=table).collect()}
    assert got == brute.components(list(enumerate(texts)))


def test_join_odd_rows(spark):
    from parallaxis.llm.ngram_join import dedupe, join

    rows = list(enumerate(ODD))
    docs = frame(spark, ODD).withColumn("node", F.lit(1)).withColumn("component_id", F.lit("x"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in join(docs).collect()} == brute.components(rows)
    assert join(docs.where("false")).collect() == []
    kept = dedupe(docs)
    assert kept.columns == docs.columns
    want = brute.components(rows)
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in want.items() if d == c}
    assert dedupe(docs.union(docs)).count() == kept.count()


def test_least_shared_of_two_sizes(spark):
    """Both forms of the bound, for every two sizes that can link; sets of 100 and 109 may share only 6."""
    import numpy as np
    from parallaxis.llm.ngram_join import Prefixes, _least_shared

    percent = 80
    aside = lambda x: -(-percent * x // 100) - 1
    needed = lambda s, x: max(1, -(-percent * (s + x) // (100 + percent)) - max(aside(s), aside(x)))
    pairs = [(s, x) for s in range(1, 160) for x in range(-(-percent * s // 100), 100 * s // percent + 1)]
    rows = spark.createDataFrame(pairs, "size long, other long")
    assert needed(100, 109) == 6
    assert all(r.n == needed(r["size"], r.other) for r in rows.select("size", "other", _least_shared("other", percent).alias("n")).collect())
    one = np.ones(1, np.int64)
    held = Prefixes(one, one, one, one, percent)
    every = np.array([(s, x) for s in range(1, 160) for x in range(1, 201)])
    want = [needed(s, x) if 100 * min(s, x) >= percent * max(s, x) else 1 << 40 for s, x in every.tolist()]
    assert held.least(*every.T).tolist() == want


def test_occurrences_in_lists_of_many_queries():
    """The merged search against sets, chunk by chunk."""
    import numpy as np
    from parallaxis.llm import ngram_join

    r, percent = random.Random(8), 80
    rows = sorted({(n, r.randrange(40)) for n in range(60) for _ in range(r.randint(1, 25))})
    node, token = (np.array(c) for c in zip(*rows, strict=True))
    size, component = 40 + node % 7, node // 3
    before = ngram_join.EXPANDED
    ngram_join.EXPANDED = 500
    try:
        held = ngram_join.Prefixes(token, node, size, component, percent)
        got = {(int(node[q]), int(held.nodes[f]), int(m)) for a, b, c in held.search(token, node, size, component) for q, f, m in zip(a, b, c, strict=True)}
    finally:
        ngram_join.EXPANDED = before
    lists = {n: {t for m, t in rows if m == n} for n in range(60)}
    aside = lambda x: -(-percent * x // 100) - 1
    want = set()
    for a in range(60):
        for b in range(60):
            s, x = 40 + a % 7, 40 + b % 7
            more = len(lists[a] & lists[b]) - max(1, -(-percent * (s + x) // (100 + percent)) - max(aside(s), aside(x)))
            if a // 3 != b // 3 and lists[a] & lists[b] and more >= 0:
                want.add((a, b, more))
    assert got == want and want


def test_join_at_the_threshold(spark):
    """Two sets of 100 and 109 shingles that overlap in 93, between groups that make their common shingles long lists."""
    from parallaxis.llm.ngram_join import join

    common = [f"c{i}" for i in range(97)]
    texts = [" ".join(common + [f"a{i}" for i in range(7)]), " ".join(common + [f"b{i}" for i in range(16)])]
    texts += [" ".join(common[: 20 + i] + [f"x{i}_{j}" for j in range(60 + i)]) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join(frame(spark, texts)).collect()}
    want = brute.components(list(enumerate(texts)))
    assert (want[0], want[1]) == ((100, 0), (109, 0)) and got == want


def test_join_of_one_huge_group_and_a_common_line(spark):
    """Near copies of one text that all link, and one line in every text: rounds, cells of several blocks and pieces."""
    from parallaxis.llm import ngram_join

    r = random.Random(9)
    base, line = [f"v{i}" for i in range(200)], "this very line stands in each of all the texts"
    texts = []
    for i in range(260):
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(200)] = f"n{i}"
        texts.append(" ".join(own if i % 2 else own[:40] + [f"u{i}_{j}" for j in range(80)]) + " " + line)
    docs = frame(spark, texts)
    want = brute.components(list(enumerate(texts)))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join(docs).collect()} == want
    entries = spark.createDataFrame([(t, n, 10, n) for t in range(12) for n in range(40)], ngram_join.LIST + ", component long")
    found = {(x.node, x.target) for x in ngram_join.candidates(entries, False, index=100, piece=60).collect()}
    assert found == {(a, b) for a in range(40) for b in range(a + 1, 40)}
    assert {x.node for x in ngram_join.candidates(entries, True, index=100, piece=60).collect()} == set(range(40))


def test_divide_skip_counts():
    from parallaxis.llm.ngram_join import divide_skip

    r = random.Random(3)
    for _ in range(200):
        lists = [sorted(r.sample(range(30), r.randint(0, 20))) for _ in range(r.randint(1, 25))]
        seen = Counter(x for y in lists for x in y)
        t = r.randint(1, 12)
        assert sorted(divide_skip(lists, t)) == sorted((x, n) for x, n in seen.items() if n >= t)


def test_quality_measures(spark, documents):
    from parallaxis.llm.quality import MEASURES, clean, verdicts

    texts = [t for _, t in documents] + ODD + ["a b c a b c", "a b c d a b c d", "x\nx\n\n \nx", "a a a a", "p q \x85 r", "a b c\x0b d\x0c e"]
    got = verdicts(frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert (*[r[m] for m in MEASURES], r.base_failed) == brute.quality(t), t
        assert not (r.base_failed and r.kept)
    docs = frame(spark, texts).withColumn("n_words", F.lit("x"))
    kept = clean(docs)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert verdicts(docs.where("false")).count() == 0


def test_quality_ablation(spark):
    from parallaxis.llm.quality import RULES, POLICIES, ablation, ledger

    texts = ODD + ["a b c " * 40, " ".join(map(str, range(80))), "| # " * 100]
    entries = ledger(frame(spark, texts))
    rows = [r.failed for r in entries.collect()]
    for version, names in POLICIES.items():
        bits = {r.name: r.bit for r in RULES if r.name in names}
        mask = sum(1 << b for b in bits.values())
        want = {n: (sum(x >> b & 1 for x in rows), sum((x & mask) == 1 << b for x in rows)) for n, b in bits.items()}
        assert {r.rule: (r.n_failed, r.n_only) for r in ablation(entries, version).collect()} == want


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_decontamination(spark, documents, block):
    from parallaxis.llm.decontaminate import clean, scan

    r = random.Random(5)
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    items += [(900, "one two"), (901, "Solo"), (902, None), (903, ""), (None, "null id words here"), (1, "one two"), (904, "a b a b a b a b a b a b a b a b")]
    texts = [t for _, t in documents] + ODD + ["say one two three", "solo", "x a b a b a b a b a b a b a b a b y", "a b a b a b a b a b a b a"]
    for _, t in items[:20]:
        w = t.split()
        a = r.randrange(max(1, len(w) - 14))
        for n in (12, 13, 14):
            texts.append("pre fix " + " ".join(w[a : a + n]).upper() + ", post")
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [(i, t) for i, t in items if i is not None]
    docs = frame(spark, texts).selectExpr("*", "1 as __row0", "'x' as n_words", "2 as row")
    want = [brute.contamination(t, known) for t in texts]
    got = scan(docs, bench, block_words=block).orderBy("doc_id").collect()
    assert [(x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got] == want
    kept = clean(docs, bench, block_words=block)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, x in enumerate(want) if not x[4]}
    assert scan(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert scan(docs.where("false"), bench).count() == 0


@pytest.mark.parametrize("block", [2_000_000, 100])
def test_decontamination_of_repeated_words(spark, block):
    """A document of one word 100000 times against an item of 2000, and words with periods."""
    import hashlib
    from parallaxis.llm.decontaminate import scan

    bench = spark.createDataFrame([(1, "a " * 2000), (2, "b c " * 300), (3, "b c d")], "item_id long, text string")
    got = scan(frame(spark, ["a " * 100_000, "x " * 50 + "b c " * 500, "A " * 12, "c d b c d"]), bench, block_words=block).orderBy("doc_id").collect()
    names = [hashlib.sha256(x).hexdigest() for x in (b"1", b"2", b"", b"3")]
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == [
        (100_000, 100_000, 1, names[0], True), (1050, 1000, 1, names[1], True), (12, 0, 0, names[2], False), (5, 3, 1, names[3], True)
    ]
    assert [tuple(x) for x in got[0].spans] == [(0, 100_000, "1")] and [tuple(x) for x in got[1].spans] == [(50, 1050, "2")]


def test_large_benchmark_without_a_checkpoint_folder(tmp_path):
    """In a session of its own, that names no folder; a large benchmark takes the join of fingerprints."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from parallaxis.llm.decontaminate import clean
docs = s.createDataFrame([(1, "one two three four"), (2, "five six"), (2, "five six seven eight nine ten"), (None, None)], "doc_id long, text string")
items = s.createDataFrame([("a", "two three"), ("b", "six")], "item_id string, text string")
print("KEPT", sorted((r.doc_id or 0, r.text or "") for r in clean(docs, items, block_words=1).collect()))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=300)
    assert "KEPT [(0, '')]" in done.stdout, done.stderr[-3000:]


def test_sharding(spark):
    from parallaxis.llm.sharding import interleave

    texts = ["t%d" % (i % 7) for i in range(1000)] + ODD + [None]
    docs = spark.createDataFrame([(i if i % 50 else None, t, "a" if i % 3 else "b" if i % 11 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string").withColumn("slot", F.lit("x"))
    got = interleave(docs, 24).collect()
    assert len(got) == len(texts)
    per = Counter(r.shard for r in got)
    assert set(per) == set(range(24)) and max(per.values()) - min(per.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))
    sources = Counter(r.source for r in got)
    for key, n in Counter((r.shard, r.source) for r in got).items():
        assert abs(n - sources[key[1]] / 24) <= 2
    want = sorted((i if i % 50 else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert [sorted((str(r.doc_id), r.shard, r.slot) for r in got if r.doc_id)] == [sorted((str(r.doc_id), r.shard, r.slot) for r in interleave(docs.repartition(7), 24).collect() if r.doc_id)]
    assert interleave(docs.where("false")).count() == 0
