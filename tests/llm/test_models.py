"""Language ID, language model, segmentation, token counts and license scans against plain versions."""

import math
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
ODD = [None, "", "   \n\t ", "a", "12 34 !?", "x " * 3000, "é" * 5000, "▁ x▁▁  ", "🙂日本\n", "\x00\x01 b", "Ж"]


def frame(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'x' as score", "1 as n_tokens")


# --- language ---------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    from parallaxis.llm.queries import op1_language_id

    got = {r.doc_id: r for r in op1_language_id(spark, DIR).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").collect()}
    assert set(got) == set(truth)
    assert all(r.held_out == (brute.remainder(d, 5) == 0) and 0 <= r.score <= 1 for d, r in got.items())
    held = [d for d, r in got.items() if r.held_out]
    assert sum(got[d].lang_pred == truth[d] for d in held) / len(held) > 0.95


def test_language_mixtures_and_odd_rows(spark):
    from parallaxis.llm import language

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = language.train(docs)
    by = defaultdict(list)
    for r in docs.collect():
        if r.lang and len(r.text) > 800 and "|" not in r.text:
            by[r.lang].append(r.text.split())
    mixed = " ".join([" ".join(by["en"][0][:120]), " ".join(by["fr"][0][:120])])
    texts = [*ODD, mixed, mixed]
    rows = frame(spark, texts)
    got = language.predict(rows, model).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")), t
    assert {m.lang for m in got[-1].mixture} == {"en", "fr"} and 0.3 < got[-1].score < 0.7
    assert got[-1].lang_pred == got[-2].lang_pred
    kept = language.clean(rows, model)
    assert kept.columns == rows.columns and kept.where("text is null").count() == 0
    assert language.predict(rows.where("false"), model).count() == 0
    nothing = language.train(rows.where("false"))
    assert {r.lang_pred for r in language.predict(rows, nothing).collect()} == {"und"}


class PlainMixture:
    """Training, EM and selection for one text at a time, in dictionaries and Python's floats."""

    def __init__(self, rows):
        from parallaxis.llm import language as L

        self.L, self.cells = L, 1 << L.BITS
        self.counts = {lang: Counter() for _, lang in rows}
        for text, lang in rows:
            for word in self.words(text):
                self.counts[lang].update(word)
        self.names = sorted(self.counts)
        self.total = {n: sum(c.values()) + L.SMOOTH * self.cells for n, c in self.counts.items()}

    def words(self, text):
        """The cells of each word's four-grams, with a border on both sides; a one-letter word has a border more."""
        low = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in (text or "").encode())
        words, now = [], b""
        for b in low + b" ":
            if 0x61 <= b <= 0x7A or b >= 0x80:
                now += bytes([b])
            elif now:
                words.append(b" " + now + b" ")
                now = b""
        out = []
        for i, w in enumerate(words):
            after = words[i + 1] if i + 1 < len(words) else b" " * 4
            grams = [w[k : k + 4] for k in range(len(w) - 3)] or [(w + after)[:4]]
            out.append([(int.from_bytes(g, "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - self.L.BITS for g in grams])
        return out

    def em(self, like, names):
        shares = {n: 1 / len(names) for n in names}
        for _ in range(self.L.ROUNDS):
            after = dict.fromkeys(names, 0.0)
            for row in like:
                top = max(row[n] for n in names)
                part = {n: math.exp(row[n] - top) * shares[n] for n in names}
                for n in names:
                    after[n] += part[n] / sum(part.values()) / len(like)
            moved = max(abs(after[n] - shares[n]) for n in names)
            shares = after
            if moved < self.L.TOLERANCE:
                break
        value = 0.0
        for row in like:
            top = max(row[n] for n in names)
            value += top + math.log(sum(math.exp(row[n] - top) * shares[n] for n in names))
        return shares, value

    def __call__(self, text):
        words = self.words(text)
        if not words or not any(c.isalpha() for c in text):
            return "und", 0.0, []
        like = [{n: sum(math.log((self.counts[n][g] + self.L.SMOOTH) / self.total[n]) for g in w) for n in self.names} for w in words]
        everywhere, _ = self.em(like, self.names)
        alone = {n: sum(row[n] for row in like) for n in self.names}
        first = max(self.names, key=lambda n: alone[n])
        rest = [n for n in sorted(self.names, key=lambda n: -everywhere[n]) if n != first]
        best, score, tried = {first: 1.0}, alone[first], [first]
        for k, n in enumerate(rest, 1):
            if everywhere[n] * len(words) < 0.5:
                break
            tried.append(n)
            shares, value = self.em(like, tried)
            value -= self.L.PENALTY * 0.5 * k * math.log(max(len(words), 2))
            if value > score:
                best, score = shares, value
        main = max(best, key=lambda n: best[n])
        return main, best[main], sorted(best)


def test_language_against_a_plain_version(spark):
    from parallaxis.llm import language

    r = random.Random(5)
    rows = [(x.text, x.lang) for x in spark.read.parquet(f"{DIR}/documents.parquet").collect() if x.lang and x.text]
    model = language.train(spark.createDataFrame(rows[:80], "text string, lang string"))
    plain = PlainMixture(rows[:80])
    assert model.languages == plain.names
    texts = [t for t, _ in rows[80:110]] + ODD
    for _ in range(15):  # mixtures of two and three
        texts.append(" ".join(" ".join(r.choice(rows)[0].split()[: r.randint(1, 60)]) for _ in range(r.randint(2, 3))))
    got = language.predict(frame(spark, texts), model).orderBy("doc_id").collect()
    for x, t in zip(got, texts, strict=True):
        lang, share, chosen = plain(t)
        assert (x.lang_pred, sorted(m.lang for m in x.mixture)) == (lang, chosen) and x.score == pytest.approx(share, abs=2e-3), t
    alone = language.predict(frame(spark, texts).coalesce(1), model).orderBy("doc_id").collect()
    apart = language.predict(frame(spark, texts).repartition(13), model).orderBy("doc_id").collect()
    assert [tuple(x) for x in alone] == [tuple(x) for x in apart]
    many = spark.createDataFrame([("a b", f"l{i}") for i in range(language.LANGUAGES + 1)], "text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language.train(many)


def test_language_clean_keeps_what_predict_says(spark):
    from parallaxis.llm import language

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = language.train(docs)
    want = {r.doc_id for r in language.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= language.REJECT}
    assert {r.doc_id for r in language.clean(docs, model).collect()} == want and want


def test_language_em_finds_proportions():
    from parallaxis.llm.language import infer

    r = np.random.default_rng(1)
    which = r.choice(3, 900, p=[0.6, 0.3, 0.1])
    log = np.full((900, 3), -12.0, np.float32)
    log[np.arange(900), which] = -4.0
    shares, chosen = infer(log, np.array([0, 900]))
    assert chosen.all() and np.allclose(shares[0], np.bincount(which) / 900, atol=0.01)


# --- language model ---------------------------------------------------------------------------------------------------


class PlainKatz:
    """The model over whole words in dictionaries, with discounts of its own."""

    def __init__(self, train, order=3, least=2):
        self.uni, self.bi, self.tri, self.context, self.order = Counter(), Counter(), Counter(), Counter(), order
        for words in train:
            row = [("start",), *words, ("end",)]
            for i in range(1, len(row)):
                self.uni[row[i]] += 1
                self.bi[row[i - 1], row[i]] += 1
                self.context[row[i - 1]] += 1
                if i > 1:
                    self.tri[row[i - 2], row[i - 1], row[i]] += 1
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.d1, self.d2, self.d3 = map(self.discounts, (self.uni, self.bi, self.tri))
        given = sum(map(self.d1, self.uni.values()))
        self.unknown = max(1 - given / self.n, 1 / (self.n + 1)) if self.n else 1.0
        self.scale = (1 - self.unknown) / given if self.n else 0
        self.after, self.after2 = defaultdict(list), defaultdict(list)
        for h, w in self.bi:
            self.after[h].append(w)
        for u, v, w in self.tri:
            if self.tri[u, v, w] >= least:
                self.after2[u, v].append(w)

    @staticmethod
    def discounts(counts):
        """Good-Turing up to five, half a count where that isn't between 0 and the count; a hundredth above."""
        n = Counter(counts.values())
        common = 6 * n[6] / n[1] if n[1] else 1.0
        table = {}
        for r in range(1, 6):
            got = r * ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) if n[r] and common < 1 else 0
            table[r] = got if 0 < got < r else r - 0.5
        return lambda r: table[r] if r <= 5 else r - 0.01

    def p1(self, w):
        return self.d1(self.uni[w]) * self.scale if self.uni[w] else self.unknown

    def p(self, w, h):
        if not self.context[h]:
            return self.p1(w)
        if self.bi[h, w]:
            return self.d2(self.bi[h, w]) / self.context[h]
        left = sum(self.bi[h, x] - self.d2(self.bi[h, x]) for x in self.after[h]) / self.context[h]
        return left / (1 - sum(self.p1(x) for x in self.after[h])) * self.p1(w)

    def p3(self, w, u, v):
        kept, n = self.after2.get((u, v), []), self.bi[u, v]
        if not kept or self.order < 3:
            return self.p(w, v)
        if w in kept:
            return self.d3(self.tri[u, v, w]) / n
        left = n - sum(self.d3(self.tri[u, v, x]) for x in kept)
        return left / n / (1 - sum(self.p(x, v) for x in kept)) * self.p(w, v)

    def score(self, words):
        row = [("start",), *words, ("end",)]
        base = sum(math.log10((self.uni[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in row[1:])
        got = math.log10(self.p(row[1], row[0])) + sum(math.log10(self.p3(row[i], row[i - 2], row[i - 1])) for i in range(2, len(row)))
        return len(row) - 1, sum(self.uni[w] > 0 for w in row[1:]), base, got


def words(text):
    return brute.WORD.findall(brute.low(text))


def test_katz(spark):
    from parallaxis.llm.katz import evaluate

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()][:60]
    texts = [t for _, t in docs] + ODD + ["The of and the of", "the the the"]
    model = PlainKatz([words(t) for i, t in enumerate(texts) if brute.remainder(i, 10)])
    for h in [("start",), *list(model.context)[:20]]:  # sums to 1 over known words and the unknown one
        assert sum(model.p(w, h) for w in model.uni) + model.p("never seen", h) == pytest.approx(1)
    for u, v in list(model.after2)[:20]:
        assert sum(model.p3(w, u, v) for w in model.uni) + model.p3("never seen", u, v) == pytest.approx(1)
    assert len(model.after2) > 50
    got = {r.doc_id: r for r in evaluate(frame(spark, texts)).collect()}
    two = PlainKatz([words(t) for i, t in enumerate(texts) if brute.remainder(i, 10)], 2)
    for r in evaluate(frame(spark, texts), 2).collect():
        assert r.score == pytest.approx(two.score(words(texts[r.doc_id]))[3], rel=1e-6, abs=1e-6)
    with pytest.raises(ValueError, match="order"):
        evaluate(frame(spark, texts), 4)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, known, base, score = model.score(words(t))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.remainder(i, 10) == 0, n, known, model.n)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9) and r.score == pytest.approx(score, rel=1e-5, abs=1e-5)


def test_katz_split_parts(spark, monkeypatch):
    """Parts so small that frequent words and contexts are split over many of them."""
    from parallaxis.llm import katz

    r = random.Random(1)
    texts = [" ".join(r.choice(["a", "b", "a b a", f"w{r.randrange(9)}"]) for _ in range(r.randint(1, 60))) for _ in range(80)]
    model = PlainKatz([words(t) for i, t in enumerate(texts) if brute.remainder(i, 10)])
    monkeypatch.setattr(katz, "PART", 40)
    got = {x.doc_id: x.score for x in katz.evaluate(frame(spark, texts)).collect()}
    assert got == pytest.approx({i: model.score(words(t))[3] for i, t in enumerate(texts)}, rel=1e-6)


def test_katz_very_frequent_bigram(spark):
    """A context whose one continuation was seen a million times keeps 0.01 for others."""
    from parallaxis.llm.katz import evaluate

    texts = ["a b " * 1_000_000 if i == 1 else "a c" if brute.remainder(i, 10) else "a d a e a" for i in range(40)]
    texts = [t.replace("a c", "c c d") for t in texts]
    model = PlainKatz([words(t) for i, t in enumerate(texts) if brute.remainder(i, 10)])
    assert brute.remainder(1, 10) and model.after[("a")] == ["b"] and model.bi["a", "b"] == 1_000_000
    got = {r.doc_id: r.score for r in evaluate(frame(spark, texts)).collect()}
    held = [i for i in range(40) if not brute.remainder(i, 10)]
    assert held
    for i in held:
        assert got[i] == pytest.approx(model.score(words(texts[i]))[3], rel=1e-5)


def test_katz_trigram_remainder(spark):
    """Contexts whose kept trigrams leave the bigram model next to nothing, beside many words seen once."""
    from parallaxis.llm.katz import evaluate

    texts, once = [], 0
    for i in range(2300):
        if not brute.remainder(i, 10):
            texts.append("a b c")
        elif i % 21 == 0:
            texts.append("a b " * 2000)
        else:
            texts.append(" ".join(f"n{once + k}" for k in range(20)))
            once += 20
    held = [i for i in range(len(texts)) if not brute.remainder(i, 10)]
    for least in (2, 1):
        model = PlainKatz([words(t) for i, t in enumerate(texts) if brute.remainder(i, 10)], least=least)
        assert sum(model.p3(w, "a", "b") for w in model.uni) + model.p3("never seen", "a", "b") == pytest.approx(1)
        got = {r.doc_id: r.score for r in evaluate(frame(spark, texts), least=least).collect()}
        want = model.score(words("a b c"))[3]
        assert all(got[i] == pytest.approx(want, rel=1e-6) for i in held), (least, got[held[0]], want)
        assert got[1] == pytest.approx(model.score(words(texts[1]))[3], rel=1e-6)


def test_katz_grouped_by_one_sort(monkeypatch):
    """Words and contexts that the sorted bits don't tell apart are still kept together; only they are sorted again."""
    from parallaxis.llm import katz

    g, real, sizes = np.random.default_rng(3), np.lexsort, []
    monkeypatch.setattr(np, "lexsort", lambda keys: sizes.append(len(keys[0])) or real(keys))
    for wide in (False, True):
        word = g.integers(0, 1 << 20, 50_000).astype(np.uint64) << np.uint64(44)
        context = g.integers(0, 1 << 40, 50_000).astype(np.uint64) if not wide else g.integers(0, 1 << 20, 50_000).astype(np.uint64) << np.uint64(44)
        word[:300] = (np.uint64(7) << np.uint64(32)) + g.integers(0, 3, 300).astype(np.uint64)  # alike in the upper 32 bits
        word[300:600] = np.uint64(9) << np.uint64(32)
        context[:600] = (np.uint64(5) << np.uint64(32 if wide else 8)) + g.integers(0, 4, 600).astype(np.uint64)
        part = (word >> np.uint64(44)) % np.uint64(8)
        for top, first in ((word, word >> np.uint64(32)), (part << np.uint64(61) | word >> np.uint64(3), part)):
            order = katz._grouped(word, context, top, wide)
            assert sorted(order.tolist()) == list(range(50_000)) and (np.diff(first[order].astype(np.int64)) >= 0).all()
            w, c = word[order], context[order]
            assert 1 + np.count_nonzero(w[1:] != w[:-1]) == len(np.unique(word))
            assert 1 + np.count_nonzero((w[1:] != w[:-1]) | (c[1:] != c[:-1])) == len(set(zip(word.tolist(), context.tolist(), strict=True)))
    assert len(sizes) == 4 and max(sizes) < 1000


def test_katz_repeated_ids_and_empty(spark):
    from parallaxis.llm.katz import evaluate

    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (2, "c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in evaluate(rows).collect())
    assert got == [(0, 2), (1, 3), (1, 3), (2, 2)]
    assert evaluate(rows.where("false")).count() == 0


# --- segmentation -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    from parallaxis.llm.nbest import load

    return load()


def every_segmentation(chunk, pieces):
    """(score, ids) of all paths of a short chunk."""
    if not chunk:
        return [(0.0, ())]
    out = []
    for size in range(1, len(chunk) + 1):
        heads = [pieces.table[chunk[:size]]] if chunk[:size] in pieces.table else []
        if size == 1:
            heads.append((int(pieces.byte_ids[0x20 if chunk[0] == 0xFF else chunk[0]]), pieces.byte_score))
        for i, s in heads:
            out += [(s + t, (i, *rest)) for t, rest in every_segmentation(chunk[size:], pieces)]
    return out


def test_nbest_is_exact(pieces):
    from parallaxis.llm.nbest import edited, encode_column

    r = random.Random(2)
    for _ in range(25):
        text = "".join(r.choice("the ofa ngé") for _ in range(r.randint(1, 6)))
        raw = b"\xff" + text.encode().replace(b" ", b"\xff")
        want = sorted((-s for s, _ in every_segmentation(raw, pieces)))[:3]
        ids, _, score, more = (c.to_pylist()[0] for c in encode_column(pa.array([text]), pieces, 3))
        got = [-score, *(-score + a["loss"] for a in more)]
        assert got == pytest.approx(want)
        costs = {i: s for i, s in pieces.table.values()} | {int(i): pieces.byte_score for i in pieces.byte_ids}
        for cost, own in zip(got, [ids, *(edited(ids, a["edits"]) for a in more)], strict=True):
            assert -sum(costs[i] for i in own) == pytest.approx(cost)


def test_encode_round_trip(spark, pieces):
    from parallaxis.llm.nbest import decode, edited, encode

    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()][:40] + ODD
    got = {r.doc_id: r for r in encode(frame(spark, texts), pieces).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert decode(r.ids, pieces) == t and r.n_tokens == len(r.ids or [])
        losses = [a.loss for a in r.alternatives]
        assert losses == sorted(losses) and all(x >= 0 for x in losses)
        seen = {tuple(r.ids or [])}
        for a in r.alternatives:
            own = edited(r.ids, [e.asDict() for e in a.edits])
            assert decode(own, pieces) == t
            seen.add(tuple(own))
        assert len(seen) == 1 + len(losses)
    assert encode(frame(spark, texts).where("false"), pieces).count() == 0


# --- token counts -----------------------------------------------------------------------------------------------------


def test_edits_keep_counts_exact():
    from parallaxis.llm.token_counts import Encoder, Tree, edit, load_ranks

    e, r = Encoder(load_ranks()), random.Random(8)
    whole = lambda s: len(e.encoding.encode_ordinary(s))
    part = lambda: r.choice(["", "a", " ", "  ", "\n", "'", "'s", "'r", "e", "12", "é ", "...", "  \n x", "word word"])
    for turn in range(3000):
        s = "".join(part() for _ in range(r.randint(0, 60 if turn % 20 else 900)))
        tree = Tree.of(s, e)
        for _ in range(5):
            a = r.randint(0, len(s) + 2)
            new = "".join(part() for _ in range(r.randint(0, 6 if turn % 10 else 600)))
            s, work = edit(s, tree, a, a + r.choice([0, 0, 1, 3, 30, 500]), new, e)
            assert (tree.tokens, tree.chars) == (whole(s), len(s))
    s = "word " * 20_000
    tree = Tree.of(s, e)
    assert edit(s, tree, 50_000, 50_001, "x", e)[1] < 10


def test_stored_trees():
    from parallaxis.llm.token_counts import Tree, pack, unpack

    r = random.Random(4)
    for n in (0, 1, 63, 64, 65, 700):
        tree = Tree([[(r.choice([1, 5, 127, 128, 70_000, 1 << 29]), r.randint(1, 300)) for _ in range(min(64, n - i))] for i in range(0, n, 64)])
        back = unpack(pack(tree))
        assert back.leaves == tree.leaves and back.sums == tree.sums
    assert unpack(None).tokens == unpack(b"").chars == 0


def test_token_counts_tables(spark, tmp_path):
    from parallaxis.llm.token_counts import Encoder, apply_edits, build, count_edited, load_ranks, revision

    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()][:30] + ODD + ["y" * 300_000, " ".join(map(str, range(60_000)))]
    docs, e = frame(spark, texts), Encoder(load_ranks())
    edits = revision(F.col("text"))
    got = {r.doc_id: r for r in count_edited(docs, edits).collect()}
    build(docs).write.parquet(f"{tmp_path}/trees")
    kept = spark.read.parquet(f"{tmp_path}/trees")
    after = {r.doc_id: r for r in apply_edits(kept, edits).collect()}
    twice = {r.doc_id: r for r in apply_edits(apply_edits(kept, edits), edits).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(e.encoding.encode_ordinary(t or ""))
        assert got[i].n_tokens_edited == after[i].n_tokens == len(e.encoding.encode_ordinary(after[i].text or ""))
        assert twice[i].n_tokens == len(e.encoding.encode_ordinary(twice[i].text or ""))
        assert got[i].n_edits == after[i].n_edits == 3 and got[i].n_reencoded == after[i].n_reencoded
    assert got[len(texts) - 1].n_reencoded < 60  # of some 120000 pre-tokens
    none = count_edited(docs, F.lit(None)).collect()
    assert all(r.n_reencoded == 0 and r.n_tokens == r.n_tokens_edited for r in none)
    assert count_edited(docs.where("false"), edits).count() == 0
    with pytest.raises(Exception, match="doesn't fit"):
        apply_edits(kept.withColumn("text", F.concat("text", F.lit("z"))), edits).collect()


def test_long_chunks_of_segmentation(pieces):
    """100 KB without a space, periodic and random, and both ways of a chunk against each other."""
    import time

    from parallaxis.llm import nbest

    r, start = random.Random(6), time.time()
    for text in ("abcdefghij" * 10_000, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "é" * 50_000):
        ids, _, _, more = (c.to_pylist()[0] for c in nbest.encode_column(pa.array([text]), pieces, 3))
        assert nbest.decode(ids, pieces) == text and len(more) == 2
        assert all(nbest.decode(nbest.edited(ids, a["edits"]), pieces) == text for a in more)
    assert time.time() - start < 60
    for n in (1, 2, 7, 30, 199):
        chunk = b"\xff" + "".join(r.choice("theofangé") for _ in range(n)).encode()
        found = nbest.segmentations(chunk, 5, pieces)
        rows = np.frombuffer(chunk, np.uint8)[None]
        best, loss, ids, has = nbest._viterbi(rows, np.array([len(chunk)]), pieces)
        assert found[0][0] == pytest.approx(best[0]) and (len(found) == 1 or found[0][0] - found[1][0] == pytest.approx(loss[0], abs=1e-9))
        scores = [s for s, _ in found]
        assert scores == sorted(scores, reverse=True) and len({x for _, x in found}) == len(found)
        if n < 12:
            assert scores == pytest.approx(sorted((s for s, _ in every_segmentation(chunk, pieces)), reverse=True)[:5])


def test_unigram_model_against_its_library(tmp_path):
    """A unigram model written by hand: true log probabilities, n-best lists equal to the library's."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    from parallaxis.llm import nbest

    words = {"▁": 6, "a": 9, "b": 7, "c": 5, "ab": 6, "bc": 4, "abc": 2, "▁a": 5, "▁ab": 3, "ca": 3, "cab": 1, "aa": 2, "▁b": 1}
    total = sum(words.values())
    model = pb.ModelProto()
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = True
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        model.pieces.add(piece=piece, score=0, type=kind)
    for b in range(256):
        model.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    for piece, n in words.items():
        model.pieces.add(piece=piece, score=math.log(n / total), type=1)
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    library, own, r = sentencepiece.SentencePieceProcessor(model_file=path), nbest.load(path), random.Random(7)
    cost = {i: s for i, s in own.table.values()}
    for _ in range(60):
        text = "".join(r.choice("abc a") for _ in range(r.randint(1, 14)))
        ids, _, score, more = (c.to_pylist()[0] for c in nbest.encode_column(pa.array([text]), own, 4))
        got = [(score, ids), *((score - a["loss"], nbest.edited(ids, a["edits"])) for a in more)]
        want = [sum(cost[i] for i in x) for x in library.nbest_encode_as_ids(text, nbest_size=4)]
        plain = [x for x, own_ids in got if all(i in cost for i in own_ids)]  # the library has no byte pieces beside others
        assert plain and plain == pytest.approx(want[: len(plain)], rel=1e-5), text
        assert nbest.decode(ids, own) == text


def test_decoded_tables(spark, pieces):
    from parallaxis.llm.nbest import decoded, encode
    from parallaxis.llm.queries import op3_sentencepiece_nbest

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert {r.doc_id: r.round_trip for r in op3_sentencepiece_nbest(spark, DIR).collect()} == dict.fromkeys(docs, True)
    rows = encode(frame(spark, ODD), pieces)
    assert all(r.round_trip for r in rows.collect())
    assert {r.doc_id: r.text for r in decoded(rows, pieces).collect()} == dict(enumerate(ODD))
    wrong = spark.createDataFrame([(1, [300, 301]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decoded(wrong, pieces).collect()} == {1: (pieces.text[300] + pieces.text[301]).replace(b"\xff", b" ")[1:].decode("utf-8", "replace"), 2: None, 3: ""}


def test_decoding_makes_no_object_for_each_id(pieces):
    """2 MB of text are decoded in a few times their size."""
    import tracemalloc

    from parallaxis.llm.nbest import decode, decode_column

    r = random.Random(5)
    plain = sorted(i for i, _ in pieces.table.values())
    ids = [[pieces.table[b"\xff"][0], *(r.choice(plain) for _ in range(500))] for _ in range(600)]
    column = pa.array([*ids, None, [], [int(pieces.byte_ids[0xE2])]], pa.list_(pa.int32()))
    tracemalloc.start()
    try:
        decode_column(column.slice(0, 600), pieces)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    size = sum(len(pieces.text[i]) for own in ids for i in own)
    assert peak < 4 * size, (peak, size)
    odd = column.slice(595)
    assert decode_column(odd, pieces).to_pylist() == [decode(x, pieces) for x in odd.to_pylist()]


def test_tasks_give_memory_back():
    """Freed arrays of some MB don't stay with a Python worker that waits for its next task."""
    from parallaxis.llm import _text, ngram_join

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def taken():  # small blocks, and one at the top that keeps the system from taking them back by itself
        blocks = [np.zeros(1 << 12) for _ in range(4000)]  # 128 MB
        for b in blocks:
            b[:] = 1
        return blocks[-1]

    text = pa.record_batch([pa.array(["a b c"])], ["text"])
    cell = pa.record_batch([pa.array([1, 1])], ["cell"])
    row = pa.record_batch([pa.array([1]), pa.array([b"x"])], ["bucket", "keys"])
    for tail in (_text.pieces_of(iter([text])), ngram_join._cells(iter([cell])), ngram_join._by_bucket(iter([row]))):
        last = taken()
        before = resident()
        list(tail)
        assert resident() < before - (64 << 20)
        del last


# --- licenses ---------------------------------------------------------------------------------------------------------


def test_alignment():
    from parallaxis.llm.licenses import align, longest_increasing

    r = random.Random(3)
    for _ in range(100):
        v = [r.randrange(30) for _ in range(r.randint(0, 30))]
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        got = longest_increasing(v)
        assert len(got) == max(best, default=0) and all(v[a] < v[b] for a, b in zip(got, got[1:], strict=False))
    assert align([1, 2, 3, 4], [1, 3, 4]) == [(0, 0), (2, 1), (3, 2)]
    assert len(align([9, 5, 5, 7, 5, 8], [5, 5, 7, 5])) == 4


def plain_alignment(a, b):
    """Pairs of the patience alignment of two word lists, by definition and recursion."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in plain_alignment(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return plain_alignment(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    anchors = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == b.count(w) == 1]
    best = []  # chains that end at each anchor: the longest, of these the one with the least places in b from its end
    rank = lambda c: (len(c), [-j for _, j in reversed(c)])
    for k, (i, j) in enumerate(anchors):
        before = max((best[m] for m in range(k) if anchors[m][1] < j), key=rank, default=[])
        best.append([*before, (i, j)])
    chain = max(best, key=rank, default=[])
    if not chain:
        return []
    out, edges = [], [(-1, -1), *chain, (len(a), len(b))]
    for (p, q), (r, s) in zip(edges, edges[1:], strict=False):
        out += [(i + p + 1, j + q + 1) for i, j in plain_alignment(a[p + 1 : r], b[q + 1 : s])]
        if r < len(a):
            out.append((r, s))
    return out


def test_alignment_against_a_plain_one():
    from parallaxis.llm.licenses import align

    r = random.Random(12)
    for turn in range(3000):
        a = [r.randrange(30 if turn % 2 else 8) for _ in range(r.randint(0, 24))]
        b = [x for x in a if r.random() < 0.8] if turn % 3 else [r.randrange(12) for _ in range(r.randint(0, 24))]
        for _ in range(r.randint(0, 3)):
            b.insert(r.randint(0, len(b)), r.randrange(30))
        got, want = align(a, b), plain_alignment(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p < q and s < t for (p, s), (q, t) in zip(got, got[1:], strict=False))
        assert got == want
        # no more words than any order allows
        assert len(got) <= sum((Counter(a) & Counter(b)).values())


def test_license_windows_against_all_windows():
    """The windows that the bound passes over could not have won."""
    from parallaxis.llm import _text as T
    from parallaxis.llm.licenses import REACH, Templates

    r = random.Random(2)
    template = [f"t{r.randrange(14)}" for _ in range(20)]
    held = Templates([("x", " ".join(template))])
    for _ in range(40):
        text = []
        for _ in range(r.randint(1, 3)):
            text += [f"t{r.randrange(18)}" for _ in range(r.randint(0, 30))] + [w for w in template if r.random() < 0.9]
        words, bounds = T.word_hashes(pa.array([" ".join(text)]), T.ALNUM)
        found = held.scan(words, bounds, 0.5)[0]
        own = held.rows[0][1].tolist()
        mine = [i for i, w in enumerate(words.tolist()) if w in set(own)]
        best = len(plain_alignment([int(words[i]) for i in mine], own))
        for reach in REACH:
            n = math.ceil(reach * len(own))
            best = max([best, *(len(plain_alignment([int(words[j]) for j in mine if i <= j < i + n], own)) for i in mine)])
        assert (found[0][1] if found else 0) == (best / len(own) if best >= 0.5 * len(own) else 0)


def test_license_scan(spark):
    from parallaxis.llm.licenses import NOTICES, TEMPLATES, scan

    names = dict(TEMPLATES)
    filler = "some words of no meaning in the text and of the work " * 40
    texts = [names["mit"], filler + names["apache-2.0"].upper() + "\n" + filler, "Released under the MIT License.", filler, filler + " license software " + filler]
    texts += [" ".join(w for i, w in enumerate(names["mit"].split()) if i % 12), " ".join(names["mit"].split()[::3]), *ODD]
    docs = frame(spark, texts).selectExpr("*", "1 as license", "2 as matches", "'x' as referred", "3 as coverage")
    got = scan(docs).orderBy("doc_id").collect()
    assert [r.license for r in got[:7]] == ["mit", "apache-2.0", "mit", None, None, "mit", None]
    assert [r.kind for r in got[:3]] == ["text", "text", "notice"]
    assert [r.referred for r in got[:4]] == [[], ["apache-2.0"], ["mit"], []]
    assert got[0].coverage == 1 and 0.8 <= got[5].coverage < 1
    assert all(r.license is None and r.referred == [] for r in got[7:])
    assert scan(docs.where("false")).count() == 0
    assert scan(docs, templates=(), notices=()).where("license is not null or size(referred) > 0").count() == 0
    for name in names:  # each is its own best, and is found inside a long text
        row = scan(frame(spark, [filler * 20 + names[name] + filler * 20])).first()
        assert (row.license, row.coverage) == (name, 1.0)
    table = spark.createDataFrame([("own", "a b c d e f g h"), ("own", "a b c d e f g h i j"), ("own", None), (None, "x"), ("empty", " .. ")], "name string, text string")
    row = scan(frame(spark, ["zz a b c d e f g h i j"]), templates=table, notices=table.where("false")).first()
    assert (row.license, row.coverage, len(row.matches)) == ("own", 1.0, 1)
    phrases = frame(spark, [f"{filler} {text}. {filler}" for _, text in NOTICES])
    for r in scan(phrases).collect():
        assert (r.license, r.kind, r.referred) == (NOTICES[r.doc_id][0], "notice", [NOTICES[r.doc_id][0]])
    # all words of a notice, but not as it stands
    assert all(r.license is None for r in scan(frame(spark, ["license MIT the under released", "released under the very MIT license"])).collect())


def test_license_of_texts_within_texts(spark):
    """Templates whose words another one contains: the longer match is the license, the other one is marked."""
    from parallaxis.llm.licenses import TEMPLATES, scan

    names = dict(TEMPLATES)
    got = scan(frame(spark, [f"prose before it. {names[x]} prose after it" for x in ("bsd-3-clause", "lgpl-3.0", "agpl-3.0", "bsd-2-clause", "gpl-3.0")])).orderBy("doc_id").collect()
    assert [(r.license, r.coverage) for r in got] == [("bsd-3-clause", 1.0), ("lgpl-3.0", 1.0), ("agpl-3.0", 1.0), ("bsd-2-clause", 1.0), ("gpl-3.0", 1.0)]
    inner = {m.license: m for m in got[0].matches}
    assert inner["bsd-2-clause"].contained and not inner["bsd-3-clause"].contained and inner["bsd-2-clause"].words < inner["bsd-3-clause"].words
    both = scan(frame(spark, [f"{names['mit']} and then {names['isc']}. Released under the MIT License"])).first()
    assert both.license == "mit" and not any(m.contained for m in both.matches if not m.notice) and both.referred == ["mit"]


def test_license_scan_misleading_words(spark):
    """Copies that lack a word which the prose has once, given twice or beside rows of common words."""
    from parallaxis.llm.licenses import TEMPLATES, scan

    mit = dict(TEMPLATES)["mit"].split()
    prose = "to the of and in this of the to any and is " * 60
    lacking = [" ".join(w for i, w in enumerate(mit) if w.strip(",.").lower() != word and i % 19 != 5) for word in ("sublicense", "portions", "furnished")]
    texts = []
    for word, copy in zip(("sublicense", "portions", "furnished"), lacking, strict=True):
        texts += [f"{word} {prose} {copy} {prose} {copy} {prose}", f"{prose} {copy} {copy} {prose} {word}", f"{copy} {prose} {word} {prose} {copy}"]
    got = scan(frame(spark, texts)).orderBy("doc_id").collect()
    alone = scan(frame(spark, lacking)).orderBy("doc_id").collect()
    for i, r in enumerate(got):
        assert r.license == "mit" and r.coverage >= alone[i // 3].coverage >= 0.8, (i, r)
    # the prose's own words make no license
    assert scan(frame(spark, [prose, f"{prose} sublicense {prose} portions"])).where("license is not null").count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as p
    from parallaxis.llm.quality import RULES

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert [n for n, _ in p.STAGES] == ["language_id", "quality_rules", "near_duplicates", "decontamination", "sentencepiece"]
    now = docs
    for name, stage in p.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in now.collect()]
        now = spark.createDataFrame(stage(spark, now, DIR).collect(), docs.schema)
        after = {r.doc_id for r in now.collect()}
        assert now.columns == docs.columns
        if name == "language_id":
            plain = PlainMixture([(r.text, r.lang) for r in docs.collect() if r.text is not None and r.lang is not None and brute.remainder(r.doc_id, 5)])
            judged = {d: plain(t) for d, t in before}
            sure = {d for d, (lang, share, _) in judged.items() if lang != "und" and share >= 0.505}
            assert sure <= after <= {d for d, (lang, share, _) in judged.items() if lang != "und" and share >= 0.495}
        elif name == "quality_rules":
            assert after == {d for d, t in before if not brute.policy_fails(t)} and len(RULES) == 6
        elif name == "near_duplicates":
            assert after == {d for d, (_, c) in brute.components(before).items() if c == d}
        elif name == "decontamination":
            assert after == {d for d, t in before if not brute.contamination(t, items)[4]}
    from parallaxis.llm.nbest import decode, load

    pieces, last = load(), {r.doc_id: r for r in p.run(spark, DIR).collect()}
    assert set(last) == after
    texts = {r.doc_id: r.text for r in now.collect()}
    assert all(r.round_trip and decode(r.ids, pieces) == texts[d] and r.n_tokens == len(r.ids) for d, r in last.items())
