"""The ten operators against brute force, round trips and held-out accuracy, with the awkward cases of each."""

import collections
import hashlib
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.llm import _text, bpe, fingerprints, html, jpeg, kneser_ney, langid, licenses, mixing, set_join, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, node long, slot int, part int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, white space, ties, repeated rows, copies, a long text, null ids and clashing columns."""
    rng = random.Random(5)
    base = " ".join(rng.choice(["the", "and", "of", "to", "Ångström", "naïve", "x,", "y."]) + str(rng.randint(0, 40)) for _ in range(120))
    near = base.replace(base.split()[60], "changed", 1)
    texts = [None, "", "   \n\t", "one", "one two three", base, base, near, "".join(c.upper() if c.isascii() else c for c in base), "x" * 3000, "lorem ipsum " * 6000, "日本語 テキスト 😀", "123 456 !!!", base + " tail"]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", len(t or ""), "clash", 1, 2, 3) for i, t in enumerate(texts)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def test_words_and_shingles_of_blocks():
    cases = ["", " a", "a  b\tc\x0bd", "É É e", "one two three four five six", " x y"]
    got = _text.shingles(*_text.word_hashes([c.encode() for c in cases]))
    assert [len(g) for g in got] == [len(shingle_set(c)) for c in cases]
    alone = [_text.shingles(*_text.word_hashes([c.encode()]))[0] for c in cases]
    assert all((a == b).all() for a, b in zip(got, alone, strict=True))


def test_fingerprints(spark, documents, texts):
    rows = {r.doc_id: r for r in fingerprints.neighbour_fingerprints(documents).collect()}
    ids = sorted(texts)
    errors = []
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        t, nxt = texts[a] or "", texts[b] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert rows[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[a].n_chars == len(t)
        for other, got in ((edited, rows[a].near_edited), (nxt, rows[a].near_next)):
            x, y = shingle_set(t), shingle_set(other)
            errors.append(got - (len(x & y) / len(x | y) if x | y else 1.0))
    assert np.std(errors) < 0.04 and abs(np.mean(errors)) < 0.01


def test_fingerprints_odd(odd, empty):
    rows = fingerprints.neighbour_fingerprints(odd).orderBy("doc_id").collect()
    assert len(rows) == 15 and rows[0].fingerprint == rows[1].fingerprint == "" and rows[0].near_next == 1.0
    assert len({r.fingerprint for r in rows if r.doc_id in (5, 6)}) == 1
    assert fingerprints.neighbour_fingerprints(empty).count() == 0


def test_densification_is_even():
    v = fingerprints.bin_values(np.sort(_text.mix64(np.arange(3, dtype=np.uint64))))
    assert v is not None and len(v) == fingerprints.BINS
    assert fingerprints.likeness(v, v) == 1.0 and fingerprints.likeness(v, None) == 0.0


def test_mixing_margins(spark):
    """The kept tokens of the registered query have the wanted margins, up to single documents being kept or not."""
    got = mixing.op2_mixing(spark, "/root/testdata/sf0.1")
    for r in mixing.margins(got).collect():
        if r.margin != "source":
            assert r.kept_share == pytest.approx(r.wanted_share, rel=0.04), r
        assert abs(r.kept_share - r.wanted_share) < 0.01
    rows = got.toPandas()
    assert (rows.rate * rows.n_tokens).sum() == pytest.approx(mixing.BUDGET * rows.n_tokens.sum(), rel=1e-4)
    # in expectation the margins are exact
    for m in mixing.MARGINS:
        have = rows.groupby(m).n_tokens.sum() ** mixing.ALPHA
        assert np.allclose((rows.rate * rows.n_tokens).groupby(rows[m]).sum() / (rows.rate * rows.n_tokens).sum(), have / have.sum(), rtol=1e-3)


def test_mixing_full_values():
    """Without repetition small values are used up, and the others have what is left by their shares."""
    assert mixing.fill(np.array([100.0, 10, 1]), np.array([10.0, 3, 1]), 80, 1).tolist() == pytest.approx([69, 10, 1])
    assert mixing.fill(np.array([100.0, 10, 1]), np.array([10.0, 3, 1]), 14, 4).tolist() == pytest.approx([10, 3, 1])
    cells = pd.DataFrame([(s, l, "t", n) for s, l, n in (("a", "x", 900), ("a", "y", 40), ("b", "x", 50), ("b", "y", 10), ("c", "y", 0))], columns=["source", "lang", "topic", "tokens"])
    targets = mixing.wanted(cells, 0.5, 800, 1.0)
    rate = mixing.rake(cells, targets, 0.8, 1.0, 200)
    assert rate.max() <= 1 and rate[4] == 1
    for m in ("source", "lang"):
        for value, want in targets[m].items():
            assert (rate * cells.tokens)[cells[m] == value].sum() == pytest.approx(want, rel=1e-3)


def test_mixing_wide_equals_local(odd, empty, spark):
    key = lambda df: sorted((r.doc_id, r.source, r.topic, r.n_tokens, round(r.rate, 4)) for r in df.collect())
    assert key(mixing.mix(odd)) == key(mixing.mix(odd, local=0))
    assert mixing.mix(empty).count() == 0 and mixing.sample(empty).count() == 0
    clash = odd.withColumn("_cell0", F.lit(1)).withColumn("_Topic0", F.lit("x")).withColumn("rate", F.lit(2))
    assert mixing.sample(clash, 1.0).count() == 15 and mixing.sample(clash).columns == clash.columns
    nulls = spark.createDataFrame([(None, None, None, None)] * 3, "doc_id long, text string, source string, lang string")
    assert [(r.rate, r.copies) for r in mixing.mix(nulls).collect()] == [(1.0, 1)] * 3


def test_mixing_sql(spark):
    from differential import connect, difference

    assert difference(mixing.op2_mixing(spark, SF), connect(SF), mixing.oracle()) is None


@pytest.fixture(scope="module")
def ranks():
    return bpe.vocabulary()


def test_bpe(ranks, texts):
    import public_tokenizers
    import tiktoken

    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "s", "t", "re", "ve", "ll", "'", "'", " ", " ", "\n", "\t", "1", "٣", "é", "漢", "😀", " ", "　", ".", "'s", "'ll", "X", "\x1c", "\x85", "ß", "<|endoftext|>"]
    cases = [t or "" for t in texts.values()] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000)] + ["x" * 5000, ""]
    encoder = bpe.Encoder(ranks)
    for _, _, raws in _text.blocks(cases):
        ids, bounds = encoder.encode(raws)
        for raw, a, b in zip(raws, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == want.encode_ordinary(raw.decode()) and encoder.decode(ids[a:b].tolist()) == raw


def test_perfect_hash(ranks):
    tokens = list(ranks)[:5000]
    table = bpe.PerfectHash(tokens)
    assert sorted(table.owner) == list(range(5000))
    raws = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum([len(t) for t in tokens])
    starts = ends - np.array([len(t) for t in tokens])
    assert (table.find(raws, starts, ends)[0] == np.arange(5000)).all()
    others = np.frombuffer(b"".join(bytes(b ^ 0x15 for b in t) for t in tokens), np.uint8)
    known = {t: i for i, t in enumerate(tokens)}
    assert table.find(others, starts, ends)[0].tolist() == [known.get(others[a:b].tobytes(), -1) for a, b in zip(starts, ends, strict=True)]


def test_bpe_odd(odd, empty, ranks):
    got = {r.doc_id: r for r in bpe.token_digests(odd, ranks).collect()}
    assert got[0].n_tokens == got[1].n_tokens == 0 and got[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[11].decoded_sha256 == hashlib.sha256("日本語 テキスト 😀".encode()).hexdigest()
    assert bpe.token_digests(empty, ranks).count() == 0


def test_bpe_digests(documents, texts, ranks):
    import public_tokenizers
    import tiktoken

    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.token_digests(documents, ranks).collect():
        ids = want.encode_ordinary(texts[r.doc_id] or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest, hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())


def brute_kneser_ney(texts, learned=lambda i: zlib.crc32(str(i).encode()) % 7 != 2):
    """Values of each text, the probability of a word after another, and the words of the training texts with the end."""
    docs = {i: words(t) for i, t in texts.items()}
    train = {i for i in docs if learned(i)}
    one, two = collections.Counter(), collections.Counter()
    for i in train:
        w = [*docs[i], "</s>"]
        one.update(w)
        two.update(zip(["<s>", *docs[i]], w, strict=True))
    n, v = sum(one.values()), len(one)
    before, context = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0, 0])
    for (a, b), c in two.items():
        before[b] += 1
        context[a][0] += c
        context[a][min(c, 3)] += 1
    many = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    d2, d1 = kneser_ney.discounts(*many(two)), kneser_ney.discounts(*many(before))
    m = many(before)
    left = (d1[1] * m[0] + d1[2] * m[1] + d1[3] * sum(x > 2 for x in before.values())) / len(two)

    def probability(a, b):
        low = max(before[b] - d1[min(before[b], 3)], 0) / len(two) + left / (v + 1)
        x = context.get(a)
        return max(two[a, b] - d2[min(two[a, b], 3)], 0) / x[0] + (d2[1:] @ x[1:]) / x[0] * low if x else low

    out = {}
    for i, w in docs.items():
        pairs = list(zip(["<s>", *w], [*w, "</s>"], strict=True))
        base = sum(math.log10((one[b] + 1) / (n + v + 1)) for _, b in pairs)
        out[i] = (i not in train, len(w) + 1, sum(one[b] > 0 for _, b in pairs), n, base, sum(math.log10(probability(a, b)) for a, b in pairs))
    return out, probability, set(one)


def same_scores(got, want):
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-6) and r.score == pytest.approx(w[5], abs=1e-6)


def test_kneser_ney(documents, texts, monkeypatch):
    want = brute_kneser_ney(texts)[0]
    same_scores(kneser_ney.score_texts(documents).collect(), want)
    # many parts, blocks of a few texts, and most frequent words dealt by successor
    for name, value in (("PART", 9000), ("HEAVY", 30), ("_FLUSH", 5000)):
        monkeypatch.setattr(kneser_ney, name, value)
    same_scores(kneser_ney.score_texts(documents).collect(), want)


def test_kneser_ney_sums_to_one(spark):
    """Over the vocabulary, the end and one unknown word, the probabilities after any context sum to 1."""
    texts = dict(enumerate(["a b c", "a b d", "b c", "c a a b", "d d d d d a", "b a c d c"])) | {100: "a zz zz b", 101: "zz", 102: ""}
    want, probability, vocabulary = brute_kneser_ney(texts, lambda i: i < 100)
    for context in ["<s>", "a", "b", "c", "d", "zz"]:
        assert sum(probability(context, w) for w in [*vocabulary, "unknown"]) == pytest.approx(1)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    same_scores(kneser_ney.score_texts(df, trained=F.col("doc_id") < 100).collect(), want)


def test_kneser_ney_odd(odd, empty, spark):
    rows = kneser_ney.score_texts(odd).collect()
    got = {r.doc_id: r for r in rows}
    assert got[0].n_tokens == 1 and got[5].n_tokens == 121 and len(rows) == 15 and len(got) == 14
    nulls = spark.createDataFrame([(None, "a b"), (None, "c"), (1, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_tokens) for r in kneser_ney.score_texts(nulls).collect()) == [(False, 3), (True, 2), (True, 3)]
    assert kneser_ney.score_texts(empty).count() == 0
    none = kneser_ney.score_texts(odd, trained=F.lit(False)).collect()
    assert all(r.score == pytest.approx(0) and r.n_known == 0 for r in none)


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_complementary_words_differ(spark, ranks):
    """Words that any polynomial modulo a power of two hashes alike."""
    pairs = [(thue_morse(n, 0), thue_morse(n, 1)) for n in (512, 1024, 2048, 4096)]
    raws = [w.encode() for p in pairs for w in p]
    data, at = _text.join(raws)
    assert len(set(_text.span_hashes(data, at[:-1], at[1:] - 1).tolist())) == len(raws)
    encoder = bpe.Encoder(ranks)
    for a, b in pairs:
        assert [encoder.decode(encoder.encode([w.encode()])[0].tolist()).decode() for w in (a, b)] == [a, b]
        ids, bounds = encoder.encode([a.encode(), b.encode()])
        assert encoder.decode(ids[: bounds[1]].tolist()).decode() == a and encoder.decode(ids[bounds[1] :].tolist()).decode() == b
    texts = {i: f"one two {w} three four" for i, w in enumerate(w for p in pairs for w in p)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in set_join.similar_components(df).collect())
    assert len({r.fingerprint for r in fingerprints.neighbour_fingerprints(df).collect()}) == len(texts)
    same_scores(kneser_ney.score_texts(df).collect(), brute_kneser_ney(texts)[0])


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    index = collections.defaultdict(list)
    for i in ids:
        shared = collections.Counter(j for g in sets[i] for j in index[g])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
        for g in sets[i]:
            index[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_set_join(documents, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in set_join.similar_components(documents).collect()} == brute_components(texts)


def test_set_join_chains(spark):
    """Near copies in chains, at and around the threshold, so that components exceed the leaders' links."""
    rng = random.Random(3)
    texts, now = {}, [f"w{i}" for i in range(60)]
    for i in range(120):
        if i % 30 == 0:
            now = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
        k = rng.choice([0, 58, 59, 30])
        now = now[:k] + [f"n{rng.randint(0, 10**6)}"] + now[k + 1 :]
        texts[(i * 37) % 120] = " ".join(now)
    texts |= {500: None, 501: "", 502: "a b", 503: "a b", 504: "a b c"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in set_join.similar_components(df).collect()} == brute_components(texts)


def test_set_join_nested_shortest_first(spark):
    # the shortest leads the lists, is near the middle one and too short for the longest, which links to the middle one
    rng = random.Random(11)
    texts = {}
    for k in range(40):
        w = [f"g{k}w{rng.randint(0, 10**6)}" for _ in range(125)]
        cut = w[:104] if k % 2 else w[21:]
        for j, own in enumerate((cut[:50] + cut[55:] if k % 3 else cut[:99], cut, w)):
            texts[100 * j + k] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in set_join.similar_components(df).collect()} == brute_components(texts)


def test_set_join_common_passages(spark, monkeypatch):
    """Pairs of near copies that share a passage with all others: the passage isn't in their prefixes, and results don't change."""
    rng = random.Random(12)
    passage, texts = " ".join(f"p{i}" for i in range(12)), {}
    for k in range(150):
        own = [f"k{k}w{rng.randint(0, 10**6)}" for _ in range(80)]
        texts[2 * k], texts[2 * k + 1] = " ".join([*own, passage]), " ".join([*own[:-1], f"x{k}", passage])
    monkeypatch.setattr(set_join, "COMMON", 100)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = set_join._sets(df.withColumnRenamed("doc_id", "node"), 5)
    tokens, counts = set_join.common_shingles(sets)
    assert len(tokens) == 8 and (counts == 300).all()
    longest = set_join._prefixes(sets, 80, (tokens, counts)).groupBy("token").count().agg(F.max("count")).first()[0]
    assert longest == 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in set_join.similar_components(df).collect()} == brute_components(texts)


def test_set_join_odd(odd, empty, spark):
    got = {r.doc_id: r.component_id for r in set_join.similar_components(odd).collect()}
    assert got[5] == got[6] == got[7] == got[8] == got[13] == 5 and got[0] == 0 and got[1] == 1
    kept = set_join.keep_representatives(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 9, 10, 11, 12]
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, 1), (1, a, 2), (None, a, 3), (None, b, 4), (None, b + " end", 5), (2, c, 6), (2, c + " more", 7), (None, None, 8), (None, None, 8), (3, "", 9)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, _node0 int").withColumn("_mark0", F.lit("x"))
    kept = set_join.keep_representatives(clash)
    got = kept.collect()
    assert kept.columns == clash.columns and len(got) == 5 and {r.text for r in got if r.doc_id is not None} == {a, c, ""} and {r.text for r in got if r.doc_id is None} < {None, b, b + " end"}
    assert set_join.keep_representatives(empty).count() == 0
    assert set_join.similar_components(empty).count() == 0


def test_licenses(documents, texts):
    plain = {"MIT": "Released under the MIT License", "Apache-2.0": "Licensed under the Apache License, Version 2.0", "CC-BY-NC": "Licensed under CC BY-NC 4.0", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3"}
    found = licenses.scan_licenses(documents).collect()
    for name, notice in plain.items():
        want = sorted((i, m.start()) for i, t in texts.items() for m in re.finditer(re.escape(notice), t or ""))
        assert want == sorted((r.doc_id, r.start_char) for r in found if r.license == name and r.coverage == 1.0)


def test_licenses_edited(spark):
    grant = licenses.TEMPLATES["MIT-grant"].split()
    text = "Intro words. " + " ".join(w for i, w in enumerate(grant) if i % 11 != 5).upper() + " and more."
    got = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [r.license for r in got] == ["MIT-grant"] and 0.85 < got[0].coverage < 1 and text[got[0].start_char :].startswith("PERMISSION")
    assert licenses.patience([1, 2, 3, 9, 4], [1, 3, 9, 2, 4]) == [(0, 0), (2, 1), (3, 2), (4, 4)]
    assert licenses.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])


def test_licenses_recall(spark):
    """Words put in, left out and exchanged: findings of edited notices, and none in texts of their common words."""
    rng = random.Random(7)
    grant, cases = licenses.TEMPLATES["MIT-grant"].split(), {}
    for k in (10, 20, 30, 40, 60):
        cases[f"in{k}"] = ("MIT-grant", " ".join([*grant[:30], *(f"foreign{i}" for i in range(k)), *grant[30:]]))
    for name, template in licenses.TEMPLATES.items():
        for k in range(8):
            own = [w for w in template.split() if rng.random() > 0.06 or len(template.split()) < 20]
            own = [f"x{rng.random()}" if rng.random() < 0.06 and len(own) >= 20 else w for w in own]
            at = rng.randrange(len(own) + 1)
            own[at:at] = [f"y{i}" for i in range(rng.randint(0, 6 if len(own) < 20 else 30))]
            around = [f"w{rng.randint(0, 99)}" for _ in range(50)]
            cases[f"{name}{k}"] = (name, " ".join([*around, *own, *around, *(["the", "of", "and", "to"] * 20)]))
    common = sorted({w for t in licenses.TEMPLATES.values() for w in t.lower().split() if len(w) < 6})
    rows = list(cases.items()) + [("none", ("", " ".join(rng.choice(common) for _ in range(5000)))), ("twice", ("MIT", "a Released under the MIT License b " * 300))]
    df = spark.createDataFrame([(i, text) for i, (_, (_, text)) in enumerate(rows)], "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in licenses.scan_licenses(df).collect():
        got[r.doc_id].append((r.license, r.coverage))
    hits = [any(x == name for x, _ in got[i]) for i, (_, (name, _)) in enumerate(rows)]
    assert all(dict(got[i]).get("MIT-grant") == 1.0 for i in range(5))
    assert np.mean(hits[: len(cases)]) > 0.97
    assert not got[len(cases)] and len(got[len(cases) + 1]) == 300


def longest_common(a, b):
    """Length of the longest common subsequence, by the table of all pairs."""
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
    return row[-1]


def test_patience_against_all_alignments():
    """Never more words than the best alignment, all of them equal and increasing, and nearly as many on edited texts."""
    rng = random.Random(4)
    got = best = 0
    for _ in range(60):
        a = [rng.randint(0, 60) for _ in range(rng.randint(0, 120))]
        b = [w if rng.random() > 0.1 else rng.randint(0, 60) for w in a if rng.random() > 0.05]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= longest_common(a, b)
        got, best = got + len(pairs), best + longest_common(a, b)
    assert got > 0.9 * best


def test_whole_licences_from_a_folder(spark, tmp_path):
    """Full texts of thousands of words as templates: found verbatim and edited, with coverage and place against the best alignment; halves aren't."""
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("grant", "licens", "work", "notic", "patent", "warrant", "distribut", "the", "of", "and") for b in ("", "e", "or", "ed", "ing", "s")]
    vocabulary += [f"{rng.choice(vocabulary)}{chr(97 + i % 26)}{i}" for i in range(700)]
    often = [min(1.0, 40 / (i + 1)) for i in range(len(vocabulary))]
    texts_ = {f"Licence-{k}.txt": " ".join(rng.choices(vocabulary, often)[0] + rng.choice(["", "", ".", ",", ";\n"]) for _ in range(1500 + 700 * k)) for k in range(2)}
    folder = tmp_path / "licences"
    folder.mkdir()
    for name, text in texts_.items():
        (folder / name).write_text(text)
    templates = licenses.read_templates(spark, str(folder))
    assert templates == texts_
    edit = lambda t: " ".join(rng.choice(["changed", w + " added", ""]) if rng.random() < 0.06 else w for w in t.split(" "))
    docs, want = [], {}
    for i, (name, text) in enumerate(list(texts_.items()) * 2):
        body = text if i < 2 else edit(text)
        docs.append((i, "before it " * 20 + body + " behind it" * 20))
        want[i] = (name, longest_common([w.strip(".,;") for w in body.split()], [w.strip(".,;") for w in text.split()]) / len(text.split()))
    docs.append((9, " ".join(texts_["Licence-0.txt"].split()[:800])))
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect()}
    assert set(found) == set(want)
    for i, (name, best) in want.items():
        r = found[i]
        assert r.license == name and 0.97 * best <= r.coverage <= best + 1e-9
        assert abs(r.start_char - 200) < 40 and abs(len(docs[i][1]) - 200 - r.end_char) < 40
    with pytest.raises(ValueError, match="go to every task"):
        (folder / "large").write_bytes(b"x " * (5 << 20))
        licenses.read_templates(spark, str(folder))


def test_words_without_marks():
    for n in (1, 16, 17, 40):
        low, starts, ends, bounds = langid.trimmed_words([f"{'-' * n}foo{'.' * n} {'*' * n} a-b".encode()])
        assert [bytes(low[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"foo", b"", b"a-b"] and bounds.tolist() == [0, 3]


def test_licenses_odd(odd, empty):
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(empty).count() == 0


def test_html(spark):
    pages = [
        ("<article><h1>T &amp; U</h1><p>One<br>two  three<p><b>Four <div class='ad'>buy</div></article><footer>f</footer>", "T & U\nOne two three\nFour"),
        ("<body><nav><ul><li>a</ul></nav><div id=main-content><h2>H</h2><p>Long enough text of the page, with sentences.</p><ul><li>x<li>y</ul></div><div class='comments'><p>I read it and liked it a lot</p></div>", "H\nLong enough text of the page, with sentences.\nx\ny"),
        ("<main><p>Text</p><form>name</form><script>var a='<p>';</script><aside>side</aside></main>", "Text"),
        ("<head><title>t</title><div class=header>Site</div><div class=entry><p>A text without a body element.</p></div>", "A text without a body element."),
        (None, ""), ("", ""), ("<nav>only menus</nav>", ""), ("plain words", "plain words"),
    ]
    df = spark.createDataFrame([(i, "u", h, "x") for i, (h, _) in enumerate(pages)], "page_id long, url string, html string, text string")
    assert [r.text for r in html.extract_main_text(df).orderBy("page_id").collect()] == [t for _, t in pages]
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_html_whole_articles():
    long = [f"Paragraph {i} has a good many words, so that its ratio of text to tags is a high one." for i in range(8)]
    p = [f"<p>{t}</p>" for t in long]
    menu = "<nav><ul><li><a>Home</a><li><a>News</a></ul></nav>"
    # no article: three quarters of the text in one block and a quarter in its sibling
    assert html.main_text(f"<body>{menu}<div id=page><div>{''.join(p[:6])}</div><div>{''.join(p[6:])}</div></div></body>") == "\n".join(long)
    # several articles, one of them short
    assert html.main_text(f"<main>{menu}<article>{''.join(p[:5])}</article><article>{''.join(p[5:])}</article><article><h2>End</h2></article></main>") == "\n".join([*long, "End"])
    # articles in sections of their own
    assert html.main_text(f"<body><section><article>{''.join(p[:5])}</article></section><section><article>{''.join(p[5:])}</article></section>") == "\n".join(long)
    # a short article element doesn't displace the main one's text
    assert html.main_text(f"<main>{''.join(p)}<article>Short</article></main>") == "\n".join([*long, "Short"])
    for name in ("class=has-sidebar", "class=with-sidebar", "class='page no-comments'", "class=page-with-nav", "id=discussion", "id=related"):
        assert html.main_text(f"<body><div {name}>{''.join(p)}</div></body>") == "\n".join(long)
    for name in ("class=sidebar", "class=left-sidebar", "id=comments", "class=related"):
        assert html.main_text(f"<body><div>{''.join(p)}</div><div {name}><p>{'Other words here. ' * 9}</p></div></body>") == "\n".join(long)


def brute_regions(page, clustered=True):
    """The blocks of a page of div, p, ul and a without names, by the plain rule: blocks of the section that holds those over the mean of the means."""
    sections = re.findall(r"<div>(.*?)</div>", page, re.S)
    blocks = [[re.sub("<[^>]+>", "", b).strip() for b in re.split(r"</?(?:p|li|ul|h2)>", x)] for x in sections]
    blocks = [[b for b in x if b] for x in blocks]
    kept = [x for x in blocks if not clustered or any(len(b) > 60 for b in x)]
    return "\n".join(b for x in kept for b in x)


def test_html_clusters_choose(monkeypatch):
    """Pages whose menus and footers have no telling tags or names: what stays is the work of ratios and clusters."""
    rng = random.Random(8)
    for _ in range(40):
        words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
        menu = "<ul>" + "".join(f"<li><a href=x>{words(1)}</a></li>" for _ in range(rng.randint(4, 9))) + "</ul>"
        body = "<h2>" + words(3) + "</h2>" + "".join(f"<p>{words(rng.randint(40, 80))}</p>" for _ in range(rng.randint(3, 7))) + "<p>" + words(4) + "</p>"
        foot = "".join(f"<p><a href=y>{words(1)}</a></p>" for _ in range(rng.randint(3, 6)))
        page = f"<html><body><div>{menu}</div><div>{body}</div><div>{menu}</div><div>{foot}</div></body></html>"
        assert html.main_text(page) == brute_regions(page)
        # without the clusters the menus stay
        with monkeypatch.context() as m:
            m.setattr(html, "threshold", min)
            assert html.main_text(page) == brute_regions(page, False)
    # teasers in article elements don't outweigh the text beside them
    teaser = "<article><a href=z>More of this</a></article>"
    text = "".join(f"<p>{words(60)}</p>" for _ in range(5))
    assert html.main_text(f"<body><div>{text}</div><div>{teaser * 4}</div></body>") == "\n".join(re.findall("<p>(.*?)</p>", text))


def test_html_sections_and_nesting():
    p = "<p>" + "A paragraph of the text, with quite some words in it. " * 3 + "</p>"
    line = p[3:-4].strip()
    for name in ("class=related-work", "id=notice-period", "class=social-history"):
        assert html.main_text(f"<article>{p}<section {name}><h2>Own</h2>{p}</section>{p}</article>") == "\n".join([line, "Own", line, line])
    for name in ("class=ad-box", "id=cookie-notice", "class='share-buttons x'", "class=related-posts", "id=ad-300x250", "class=comment-list"):
        assert html.main_text(f"<article>{p}<div {name}>{p}</div>{p}</article>") == "\n".join([line, line])
    assert html.main_text(f"<article>{p}<span class=ad>buy <span>this</span> now</span> rest{p}</article>") == "\n".join([line, "rest", line])
    # open elements without end: time grows with the length
    for piece, want in (("<b>x<p>y</p>", "x\ny"), ("<div><h1>x", "x"), ("<ul><li>x", "x"), ("<span class=ad>x<p>y", ""), ("<main><p>x", "x"), ("<table><tr><td>x", "x")):
        began = time.monotonic()
        assert html.main_text("<article>" + piece * 100_000).startswith(want)
        assert time.monotonic() - began < 30


def test_html_names_formulas_and_short_lines():
    """Names that only end like page parts, formulas, buttons in a sentence and short sentences around the text stay."""
    p = "<p>" + "A paragraph of the text, with quite some words in it. " * 3 + "</p>"
    line = p[3:-4].strip()
    for attr in ("class=market-share", "class=product-widget", "id=consent", "class=stock-market-share", "class='press-promotion'", "id=notification", "class=speaker-popup-history"):
        assert html.main_text(f"<article>{p}<div {attr}><p>Own text here.</p></div>{p}</article>") == "\n".join([line, "Own text here.", line]), attr
    for attr in ("class=left-sidebar", "class=site-footer", "class=post-share", "class=main-nav", "id=cookie-consent", "class=article-comments", "class=js-modal", "class=wp-widget", "id=ad-1"):
        assert html.main_text(f"<article>{p}<div {attr}><p>Not this one.</p></div>{p}</article>") == "\n".join([line, line]), attr
    assert html.main_text("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> as shown.</p></article>") == "Energy is E=mc2 as shown."
    assert html.main_text("<article><p>Energy <svg><title>icon</title><text>x</text></svg>is <button>Copy</button>shown.</p></article>") == "Energy is shown."
    many = p * 4
    want = "\n".join([line] * 4)
    # beside the sections or paragraphs of the text
    for body in (many, f"<div>{p * 2}</div><div>{p * 2}</div>"):
        assert html.main_text(f"<body><div>Short intro line.</div>{body}</body>") == f"Short intro line.\n{want}"
        assert html.main_text(f"<body>{body}<div>A last word!</div><div><a href=x>Terms.</a></div></body>") == f"{want}\nA last word!"
        assert html.main_text(f"<body><div>Site name</div>{body}<div>Example Ltd</div></body>") == want


def test_html_lists_only_take_out_what_regions_hold():
    """Menus in listed elements lie outside the regions by ratios alone; reader comments are taken out by name, however long."""
    p = "<p>" + "A paragraph of the text, with quite some words in it. " * 3 + "</p>"
    menu = "<ul>" + "<li><a href=x>Menu</a></li>" * 8 + "</ul>"
    comments = "<p>" + "I read it all and have very much to say about each of its points. " * 4 + "</p>"
    page = f"<body><nav>{menu}</nav><article>{p * 3}</article><div class=comments>{comments * 9}</div><footer>{menu}</footer></body>"
    parser = html.LineParser()
    parser.feed(page)
    parser.close()
    kept = html.content_lines(parser, html.upper_cluster(parser.lines))
    assert [k for k, line in zip(kept, parser.lines, strict=True) if not line[4]] == [True] * 3
    assert not any(k for k, line in zip(kept, parser.lines, strict=True) if line[0] == "Menu")
    assert html.main_text(page) == "\n".join([p[3:-4].strip()] * 3)
    assert html.main_text(f"<body><div class=comments>{comments * 9}</div><div>Short text.</div></body>") == "Short text."


def test_html_pages(spark):
    import html as entities

    for r in spark.read.parquet(f"{SF}/pages.parquet").join(html.extract_main_text(spark.read.parquet(f"{SF}/pages.parquet")), ["page_id", "url"]).collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = (" ".join(entities.unescape(b.replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1|b)>", inner))
        assert r.text == "\n".join(b for b in blocks if b)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert len(got) and got["score"].between(0, 1).all()
    own = got[got.held_out]
    assert ((own.predicted == 1) & (own.toxic == 0)).sum() <= 1
    assert ((own.predicted == 1) & (own.toxic == 1)).sum() >= 0.5 * (own.toxic == 1).sum()


def test_toxicity_parts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0)).astype(float)
    trees = toxicity.Trees(rounds=40).fit(x[:3000], y[:3000])
    assert ((trees.margin(x[3000:]) > 0) == y[3000:]).mean() > 0.97
    px, py = toxicity.isotonic(np.array([0, 1, 2, 3.0]), np.array([0, 1, 0, 1]))
    assert (np.diff(py) >= 0).all() and len(px) == len(py)
    f = toxicity.features([b"You are an 1d10t!", b"you IDIOT", b""], (np.zeros(0, np.uint64), np.zeros(0)))
    name = toxicity.FEATURES.index
    assert f[0, name("hidden")] > 0 and f[1, name("seed_hits")] == 1 and f[1, name("near_you")] > 0 and not f[2].any()


def test_toxicity_columns(spark):
    """The registered query's columns, its scores by trees walked one node at a time, and its calibration by the definition of isotonic means."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(texts)

    def walk(x):
        out = model.trees.start
        for feature, cut, value in model.trees.nodes:
            at = 0
            for _ in range(model.trees.depth):
                at = 2 * at + 1 + (x[feature[at]] > cut[at])
            out += value[at - len(feature)]
        return out

    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
        if i % 20 == 0:
            m = walk(toxicity.features([texts[i].encode()], model.lexicon)[0])
            sigmoid = 1 / (1 + math.exp(-m))
            assert r.score == pytest.approx(min(1, max(0, np.interp(m, *model.steps) + 0.002 * (sigmoid - 0.5))), abs=1e-9)
    rng = np.random.default_rng(3)
    x, y = rng.permutation(60).astype(float), rng.integers(0, 2, 60).astype(float)
    px, py = toxicity.isotonic(x, y)
    ordered = y[np.argsort(x)]
    means = [max(min(ordered[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    sizes = collections.Counter(np.round(means, 9))
    want = np.maximum.accumulate([(m * sizes[round(m, 9)] + 0.25) / (sizes[round(m, 9)] + 0.5) for m in means])
    assert np.allclose(np.interp(np.arange(60.0), px, py), want)


def plain_features(text, weights):
    """The features by loops over a text's characters and words."""
    marks = {chr(b) for b in range(33, 127) if not chr(b).isalnum()}
    low = lambda s: s.translate(LOWER)
    insults, you = set(toxicity.INSULTS), set(toxicity.YOU)
    plain = [w for w in ("".join(c for c in w if c not in marks) for w in WORD.findall(low(text))) if w]
    leet = str.maketrans("013457@$", "oieastas")
    undone = [w for w in ("".join(c for c in w if c in "@$" or c not in marks).translate(leet) for w in WORD.findall(low(text))) if w]
    gains = [weights.get(w.encode(), 0.0) for w in plain]
    stems = [max([0.0, *(weights.get((w.encode()[:k], k), 0.0) for k in toxicity.STEMS if len(w.encode()) > k)]) for w in plain]
    hit = [w in insults or g > 0 for w, g in zip(plain, gains, strict=True)]
    second = [w in you for w in plain]
    near = [h and any(second[max(0, i - 5) : i + 6]) for i, h in enumerate(hit)]
    raw, n, words_ = text.encode(), max(1, len(plain)), [w.encode() for w in WORD.findall(text)]
    size, word_n = max(1, len(raw)), max(1, len(words_))
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    shouted = sum(sum(65 <= b <= 90 for b in w) > 2 and all(65 <= b <= 90 for b in w if letter(b)) for w in words_)
    mixed = sum(any(map(letter, w)) and (any(48 <= b <= 57 for b in w) or any(chr(b) in marks for b in w[1:-1])) for w in words_)
    same = sum(raw[i] == raw[i - 1] == raw[i - 2] and raw[i] not in (9, 10, 11, 12, 13, 32) for i in range(2, len(raw)))
    seeds = sum(w in insults for w in plain)
    count = lambda f: sum(map(f, raw)) / size
    return [
        math.log1p(len(plain)), seeds / n, seeds, max(0, sum(w in insults or w.encode() in weights for w in undone) - sum(hit)) / n, sum(gains) / n, max([0, *gains]), sum(g > 0 for g in gains),
        sum(stems) / n, max([0, *stems]), sum(x > 0 for x in stems), sum(near) / n, sum(second) / n, count(lambda b: 65 <= b <= 90), shouted / word_n,
        count(lambda b: chr(b) in marks), count(lambda b: b == 33), count(lambda b: b in b"#$%&*@"), mixed / word_n, same / size, sum(len(w.encode()) for w in plain) / n, count(lambda b: b == 10),
    ]


def test_toxicity_features_of_a_text_alone(texts):
    """Every feature by plain loops, and bit-equal alone, in blocks and in any order: insults end texts and "you" begins the next."""
    rng = random.Random(11)
    some = ["you", "You", "idiot", "1d10t", "id.iot", "SHOUT", "aaargh!!!", "b4d", "it's", "été", "x", "...", "m$n", "hate", "trottel", "\n", "12"]
    made = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    made += ["this text ends with idiot", "you begin this one", "", "idiot", "you", "you " + "x " * 5 + "idiot", "you " + "x " * 4 + "idiot"] + [t or "" for t in list(texts.values())[:60]]
    weights = {b"b4d": 0.75, "été".encode(): 0.5, (b"shou", 4): 0.25, (b"trott", 5): 1.5}
    keys = {}
    for item, w in weights.items():
        raw, add = item if isinstance(item, tuple) else (item, 0)
        keys[int(_text.span_hashes(np.frombuffer(raw + b" ", np.uint8), np.array([0]), np.array([len(raw)]))[0]) + add & (1 << 64) - 1] = w
    lexicon = (np.array(sorted(keys), np.uint64), np.array([keys[k] for k in sorted(keys)]))
    raws = [t.encode() for t in made]
    block = toxicity.features(raws, lexicon)
    assert np.allclose(block, [plain_features(t, weights) for t in made], atol=1e-12)
    alone = np.concatenate([toxicity.features([r], lexicon) for r in raws])
    assert (block == alone).all() and (toxicity.features(raws[::-1], lexicon)[::-1] == alone).all()
    name = toxicity.FEATURES.index("near_you")
    assert toxicity.features([b"this text ends with idiot", b"you begin"], lexicon)[0, name] == 0


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)] + [(3, None), (99, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.scores(odd, model).count() == 15
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    none = toxicity.fit(empty, labels.limit(0))
    assert toxicity.scores(empty, none).count() == 0 and toxicity.scores(odd, none).count() == 15


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    scores, bounds, moves = rng.normal(size=(400, 3)), np.array([0, 0, 3, 70, 70, 400]), rng.normal(size=(3, 3))
    got = langid.marginals(scores, bounds, moves)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        e, step, n = np.exp(scores[a:b]), np.exp(moves), b - a
        ahead, behind, v = np.zeros((n, 3)), np.ones((n, 3)), np.ones(3)
        for t in range(n):
            v = (v @ step) * e[t]
            v = ahead[t] = v / v.sum()
        for t in range(n - 2, -1, -1):
            w = step @ (e[t + 1] * behind[t + 1])
            behind[t] = w / w.sum()
        want = ahead * behind
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True)) if n else True


def test_language_held_out(documents):
    got = langid.predict(documents, langid.fit(documents)).join(documents, "doc_id").toPandas()
    own = got[got.held_out]
    assert (own.lang_pred == own.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_columns(documents, texts):
    """The registered query's columns against forward-backward over each text in plain loops."""
    model = langid.fit(documents)
    weights = model.weights.astype(np.float32)
    got = {r.doc_id: r for r in langid.op9_langid(documents.sparkSession, SF).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.lang_pred in (*model.langs, "und") and 0 <= r.score <= 1
        raw = (texts[i] or "").encode()
        if i % 8 or not 0 < len(raw) < 4000:
            continue
        low, starts, ends, _ = langid.trimmed_words([raw])
        *features, word_like = langid.word_features(low, starts, ends)
        e, step = np.exp(langid.word_scores(weights, *features)), np.exp(model.moves)
        ahead, behind, v = np.zeros_like(e), np.ones_like(e), np.ones(e.shape[1])
        for t in range(len(e)):
            v = ahead[t] = (v @ step) * e[t] / ((v @ step) * e[t]).sum()
        for t in range(len(e) - 2, -1, -1):
            w = step @ (e[t + 1] * behind[t + 1])
            behind[t] = w / w.sum()
        m = ahead * behind
        share = (m / m.sum(axis=1, keepdims=True))[word_like].sum(axis=0)
        if share.sum():
            share /= share.sum()
            assert r.lang_pred == model.langs[share.argmax()] and r.score == pytest.approx(share.max(), abs=1e-5)


def test_language_switches(documents):
    """Words of two joined texts get the languages of their parts."""
    model = langid.fit(documents)
    held = documents.where(langid.held_out(F.col("doc_id")) & (F.length("text") > 600)).toPandas()
    a, b = (held[held.lang == x].iloc[0].text for x in ("de", "fr"))
    a, b = " ".join(a.split()[:60]), " ".join(b.split()[:60])
    m, _, _ = model.word_marginals([f"{a} {b}".encode()])
    best = [model.langs[i] for i in m.argmax(axis=1)]
    assert best[:50].count("de") > 45 and best[-50:].count("fr") > 45


def test_language_learns_every_language(spark, monkeypatch):
    # 70 languages, the first ones frequent enough to fill the words; the text of the rarest is longer than its share
    rows = [(k, (f"l{k % 3} " * 300).strip(), f"f{k % 3}") for k in range(600)]
    rows += [(1000 + 20 * k + j, f"w{k} " * (60_000 if k == 66 else 4), f"r{k}") for k in range(67) for j in range(20 if k < 66 else 8)]
    monkeypatch.setattr(langid, "WORDS", 12_000)
    learned = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: learned.extend(zip(texts, langs, strict=True)))
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=40)
    assert {lang for _, lang in learned} == {r[2] for r in rows}
    assert sum(len(t) for t, _ in learned) <= 6 * 12_000


def test_language_odd(odd, empty):
    model = langid.train(["hello there my friend"] * 3 + ["bonjour mon ami"] * 3, ["en"] * 3 + ["fr"] * 3, rounds=5)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 12)) and got[11].lang_pred != "und"
    assert langid.label_words(odd, model).count() == 15 and langid.keep_identified(odd, model).columns == odd.columns
    nothing = langid.fit(empty)
    assert langid.predict(empty, nothing).count() == 0 and {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_jpeg_round_trip():
    rng = random.Random(2)
    raws = [b"", b"a", b"hello" * 100, rng.randbytes(5000), b"\xff" * 1000, rng.randbytes(64 * 8191 + 640)]
    payloads = [jpeg.payload(r) for r in raws]
    for p, images in zip(payloads, jpeg.thumbnails(jpeg.encode(payloads)), strict=True):
        assert b"".join(x[2].tobytes() for x in images) == p and len(p) % 64 == 0 and p
    assert jpeg.parse(b"not an image") == [] and jpeg.parse(b"\xff\xd8\xff\xd9") == []


def test_jpeg_with_colour_and_coefficients():
    """A 4:2:0 image with AC coefficients and no restart intervals, written symbol by symbol."""
    dc = {s: (c, n) for s, c, n in jpeg.code_table([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7, list(range(12)))}
    ac = {s: (c, n) for s, c, n in jpeg.code_table([0, 2, 1] + [0] * 13, [0x00, 0x01, 0xF0])}
    bits, last = "", {0: 0, 1: 0, 2: 0}
    rng, luma = random.Random(4), np.zeros((4, 6), int)

    def put(code):
        return format(code[0], f"0{code[1]}b")

    for my in range(2):
        for mx in range(3):
            for c, k in ((0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (2, 0)):
                level = rng.randint(-100, 100)
                if c == 0:
                    luma[2 * my + k // 2, 2 * mx + k % 2] = level
                d, last[c] = level - last[c], level
                size = abs(d).bit_length()
                bits += put(dc[size]) + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else "")
                bits += put(ac[0xF0]) + put(ac[1]) + "1" + put(ac[1]) + "0" + put(ac[0])
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    image = b"\xff\xd8" + seg(0xDB, bytes([0, 8] + [1] * 63)) + seg(0xC0, bytes([8, 0, 30, 0, 45, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    image += seg(0xC4, bytes([0, 0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7 + list(range(12)))) + seg(0xC4, bytes([0x10, 0, 2, 1] + [0] * 13 + [0x00, 0x01, 0xF0]))
    image += seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    ((width, height, pixels),) = jpeg.thumbnails([image])[0]
    assert (width, height) == (45, 30) and (pixels == np.clip(luma + 128, 0, 255)).all()


def test_jpeg_broken():
    """Whatever the bytes are, reading ends without an error; what is cut short or lacks a table isn't an image."""
    rng = random.Random(6)
    good = jpeg.encode([jpeg.payload(rng.randbytes(n)) for n in (10, 400, 3000)])
    for stream in good:
        assert len(jpeg.thumbnails([stream])[0]) == 1
        for cut in (len(stream) // 2, len(stream) - 40, 200, 100, 20, 3):
            assert cut >= len(stream) - 4 or jpeg.thumbnails([stream[:cut]]) == [[]]
        for marker in (b"\xff\xc4", b"\xff\xda"):
            assert jpeg.thumbnails([stream.replace(marker, b"\xff\xe0")]) == [[]]
        at = stream.index(b"\xff\xda")
        assert jpeg.thumbnails([stream[: at + 2] + b"\0\2" + stream[at + 10 :]]) == [[]]  # an empty scan header
    for _ in range(1500):
        stream = bytearray(rng.choice(good))
        for _ in range(rng.randint(1, 6)):
            kind, at = rng.randint(0, 3), rng.randrange(min(len(stream), 300))
            if kind == 0:
                stream[at] = rng.randrange(256)
            elif kind == 1:
                del stream[at : at + rng.randint(1, 20)]
            elif kind == 2:
                stream[at:at] = rng.randbytes(rng.randint(1, 10))
            else:
                stream[at] ^= 1 << rng.randrange(8)
        jpeg.thumbnails([bytes(stream), good[0]])
        assert len(jpeg.thumbnails([good[0]])[0]) == 1


def test_media(documents, texts):
    """Columns of the registered query against the standard library."""
    rows = jpeg.op10_media(documents.sparkSession, SF).collect()
    stored = {r.doc_id: bytes(r.media) for r in jpeg.store_texts(documents).collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        media = stored[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        size, images, first = r.feature.split(":")
        assert size == f"512x{len(payload) // 8}" and int(images) == 1 and len(first) == 16


def test_media_odd(odd, empty):
    stored = jpeg.store_texts(odd)
    got = {r.doc_id: r for r in jpeg.read_media(stored).collect()}
    assert bytes(got[0].thumbnail) == bytes(got[1].thumbnail) == bytes(64) and got[5].thumbnail_hash == got[6].thumbnail_hash
    assert jpeg.read_media(jpeg.store_texts(empty)).count() == 0
    broken = stored.withColumn("media", F.lit(b"junk")).withColumn("width", F.lit(3))
    assert jpeg.read_media(broken).where("width is not null").count() == 0
    short = stored.withColumn("media", F.expr("substring(media, 1, length(media) - 30)"))
    assert jpeg.read_media(short).where("thumbnail is not null or images > 0").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "encoding":
            assert after.columns == columns and after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "near_copies":
            want = brute_components({r.doc_id: r.text for r in before.collect()})
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
        if name == "encoding":
            assert after.count() == before.count()
            ranks = bpe.vocabulary()
            want = {r.doc_id: r.text or "" for r in before.collect()}
            for r in after.collect():
                raw = b"".join({i: t for t, i in ranks.items()}[i] for i in r.ids) if r.doc_id % 50 == 0 else None
                assert len(r.ids) == r.n_tokens and (raw is None or raw.decode() == want[r.doc_id])
        before = after
    assert corpus_pipeline.run(spark, SF).count() == before.count()
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"


def test_pipeline_odd(odd, empty, spark, tmp_path):
    """Whole runs over awkward documents and over none."""
    import corpus_pipeline

    labels = spark.createDataFrame([(i, 0) for i in range(14)], "doc_id long, toxic int")
    for name, docs in (("odd", odd), ("empty", empty)):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert {"doc_id", "n_tokens", "ids"} <= set(out.columns)
        kept = [r.doc_id for r in out.collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= set(range(14))
