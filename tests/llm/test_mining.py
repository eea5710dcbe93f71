"""Vector codes, collocations and repeated passages against brute force, with the awkward cases of each."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from skyloom.llm import collocations, repeats, vector_codes
from skyloom.llm._shards import Known

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, shard long, keys binary, back string, n long, words string"


def rows_of(df, columns=None):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# vector codes


def brute_codes(rows, entries=256, rounds=4, parts=4, scale=1024):
    """Plain integer Lloyd: every part against every entry."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    split = [[r[1][p * width : (p + 1) * width] for r in kept] for p in range(parts)]
    books = [[list(v) for v in s[:entries]] for s in split]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, book: min(range(len(book)), key=lambda e: (gap(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for v in split[p]:
                own[near(v, books[p])].append(v)
            for e, vs in own.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    errors, out = collections.Counter(), []
    for k, (i, _, label) in enumerate(kept):
        codes = [near(split[p][k], books[p]) for p in range(parts)]
        error = sum(gap(split[p][k], books[p][c]) for p, c in enumerate(codes))
        errors[label] += error
        out.append((i, "".join(f"{c:02x}" for c in codes), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, errors[label], sha) for i, code, error, label in out]


def coded(df, **options):
    out, books = vector_codes.compressed(df, **options)
    return [(*r, vector_codes.digest(books)) for r in vector_codes.with_label_error(out).select("vec_id", "code", "error", "label_error").collect()]


def test_vector_codes_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_codes([(r.vec_id, r.embedding, r.label) for r in df.collect()], rounds=2)
    assert sorted(coded(df, rounds=2)) == sorted(want)
    whole = vector_codes.op11_vector_codes(spark, SF)
    assert whole.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert whole.count() == df.count() and whole.select("codebooks_sha256").distinct().count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_vector_codes_with_ties(spark, seed):
    """Few different integer points, so entries are equal and distances tie; several blocks and partitions."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-2.0, -0.5, 0.0, 0.25, 1.0, 3.0]) / 1024 * rng.choice([1, 1, 900]) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(700)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    want = brute_codes([tuple(r) for r in df.collect()], entries=40)
    assert sorted(coded(df, entries=40)) == sorted(want)


def test_vector_codes_odd(spark):
    rows = [(3, [1.0, 2.0, 3.0, 4.0], 1, "x"), (1, None, 1, "x"), (2, [1.0, None, 3.0, 4.0], 1, "x"), (4, [1.0, float("nan"), 3.0, 4.0], 1, "x"), (5, [1.0, float("-inf"), 3.0, 4.0], 1, "x"), (6, [], 1, "x"), (None, [9.0, 9.0, 9.0, 9.0], None, "x"), (7, [1.0, 2.0, 3.0, 4.5], None, "x"), (3, [1.0, 2.0, 3.0, 4.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long, code string")
    want = brute_codes([r[:3] for r in rows])
    assert sorted(coded(df), key=repr) == sorted(want, key=repr)
    assert coded(df.where("vec_id < 0")) == []
    with pytest.raises(Exception, match="one length"):
        coded(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], "vec_id long, embedding array<double>, label long").coalesce(1))
    with pytest.raises(Exception, match="too large"):
        coded(spark.createDataFrame([(1, [1e9] * 4, 1)], "vec_id long, embedding array<double>, label long"))


def test_filter_equals_search():
    """Trees of any shape assign as a search of all entries does, also where integers are wide."""
    rng = np.random.default_rng(1)
    for n, width, scale in itertools.product((1, 7, 33, 500), (1, 3, 16), (3, 1000, 1 << 27)):
        points = rng.integers(-scale, scale, (n, width)) // rng.integers(1, 4, (n, 1))
        book = np.concatenate([points[: min(n, 20)], points[: min(n, 3)]])
        order, levels = vector_codes.build(points, leaf=8)
        got = np.empty(n, np.int64)
        found = vector_codes.assigned(vector_codes.Codebook(book, scale), points[order], levels)
        got[order] = found
        gaps = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (got == gaps.argmin(axis=1)).all()
        sums, counts = vector_codes.totals(vector_codes.Codebook(book, scale), points[order], levels)
        assert (counts == np.bincount(got, minlength=len(book))).all() and (sums.sum(axis=0) == points.sum(axis=0)).all()


def test_boxes_leave_entries_out():
    """Clustered points: nearly all go with whole subtrees."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-(10**6), 10**6, (50, 4))
    points = (centres[rng.integers(0, 50, 5000)] + rng.integers(-50, 50, (5000, 4))).astype(np.int64)
    order, levels = vector_codes.build(points)
    whole = sum(int(n.sum()) for _, _, n, first, end in vector_codes.descend(vector_codes.Codebook(centres, 2 * 10**6), points[order], levels) if (end - first).max() > 1)
    assert whole > 2500


# collocations


def brute_collocations(docs, least=30, longest=4, percent=80, top=2000):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[i : i + k]) for p, a in found.items() for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1) if 100 * a >= percent * f[(p[0], *p[i : i + k])]}
    out = collections.defaultdict(list)
    for p, a in found.items():
        if p not in gone:
            score, _, l, r = min((2000000 * a // (f[p[: k + 1]] + f[p[:1] + p[k + 1 :]]), k, f[p[: k + 1]], f[p[:1] + p[k + 1 :]]) for k in range(1, len(p) - 1))
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top]))


def test_collocations_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows_of(collocations.op12_collocations(spark, SF)) == sorted(brute_collocations([(r.lang, r.text) for r in df.collect()]), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_collocations_of_small_shards(spark, seed, monkeypatch):
    """Few words, so phrases of all lengths recur, overlap and tie; several shards, groups and parts."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", 900)
    monkeypatch.setattr(collocations, "GROUP", 16)
    rng = random.Random(seed)
    some = ["a", "A", "b", "ab", "é", "日本", "x\x00y", "\x1f"]
    docs = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(some) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!?"]) for _ in range(rng.randint(0, 120)))) for _ in range(60)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = collocations.collocations(df, least=4, top=50)
    assert rows_of(got) == sorted(brute_collocations(docs, 4, top=50), key=repr)


def test_collocations_odd(spark):
    rows = [(1, None, "en", 1, None, "x", 1, "w"), (2, "", "en", 1, None, "x", 1, "w"), (3, " \t\n", None, 1, None, "x", 1, "w"), (4, ".,;", "de", 1, None, "x", 1, "w"), (5, "one", "fr", 1, None, "x", 1, "w"), (6, "A b, a B " * 2, None, 1, None, "x", 1, "w"), (6, "A b, a B " * 2, None, 1, None, "x", 1, "w"), (7, "same " * 70000, "en", 1, None, "x", 1, "w"), (8, "y" * 5000 + " z", "en", 1, None, "x", 1, "w")]
    df = spark.createDataFrame(rows, DOC)
    assert rows_of(collocations.collocations(df, least=4)) == sorted(brute_collocations([(r[2], r[1]) for r in rows], 4), key=repr)
    assert collocations.collocations(df.limit(0)).collect() == []
    assert [t for t in collocations.collocations(df).dtypes] == [(c, "string" if c in ("lang", "phrase") else "bigint") for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]


def test_collocations_sql(spark):
    from differential import connect, difference

    assert difference(collocations.op12_collocations(spark, SF), connect(SF), collocations.oracle()) is None


def test_scores_beyond_64_bits(spark):
    """The floor of the score is exact where products pass 64 bits."""
    cut = spark.sql("select (2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as s from values (9000000000000000000L, 9000000000000000001L, 9000000000000000003L) t(a, l, r)")
    assert cut.first().s == 2000000 * 9000000000000000000 // 18000000000000000004


# repeated passages


def brute_repeats(docs, width=35):
    texts = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in docs]
    seen = collections.Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(docs, texts, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_of_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(repeats.op13_repeats(spark, SF))
    assert got == brute_repeats(docs) and sum(r[2] for r in got)


@pytest.mark.parametrize("width", [1, 2, 5, 35])
def test_repeats_planted(spark, width, monkeypatch):
    """Passages cut anywhere, in any document, beside themselves and overlapping; several shards and automata."""
    monkeypatch.setattr(repeats, "SHARD_BYTES", 3000)
    monkeypatch.setattr(repeats, "NODES", 300)
    rng = random.Random(width)
    word = lambda: rng.choice(["", "W", "é", "語"]) + str(rng.randint(0, 400 if width > 2 else 10**6))
    passages = [[word() for _ in range(rng.randint(width - 1, 4 * width))] for _ in range(6)]
    docs = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [word() for _ in range(rng.randint(0, 30))]
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            w += p[a : rng.randint(a, len(p))]
        docs.append((i, "".join(x + rng.choice([" ", "\n", "  ", "\t"]) for x in w)))
    docs += [docs[3], (200, "Case " * 100), (201, "case " * 34), (None, None), (202, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rows_of(repeats.repeat_digests(df, width=width)) == brute_repeats(docs, width)


def test_repeats_spans_and_odd(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"start {passage} end", *["x"] * 6), (2, f"{passage}", *["x"] * 6), (3, None, *["x"] * 6), (None, "short", *["x"] * 6), (4, passage.upper(), *["x"] * 6), (5, "long " * 60000, *["x"] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, shard string, ids string, back string, n string, texts string")
    got = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    assert got[1].text == "start end" and [(s.first, s.end) for s in got[1].spans] == [(1, 41)]
    assert got[2].text == "" and got[3].n_words == 0 and got[None].text == "short" and not got[4].spans and got[5].text == ""
    assert rows_of(repeats.repeat_digests(df)) == brute_repeats([r[:2] for r in rows])
    assert repeats.repeat_digests(df.limit(0)).collect() == []


def test_keys_that_only_look_equal_are_kept(monkeypatch):
    """A window whose hash came back for other words isn't covered unless its own words recur."""
    a, b = [" ".join(f"{x}{i}" for i in range(35)).encode() for x in "pq"]
    words, bounds = repeats._text.word_hashes([a, b], lower=False)
    at, keys, _ = repeats.windows(words, bounds, 35)
    monkeypatch.setattr(repeats, "windows", lambda *_: (at, np.full(len(at), 7, np.uint64), None))
    gone, _ = repeats.covered([a, b], Known([{"keys": np.array([7], np.uint64).tobytes()}]), 35)
    assert gone[:35].all() and not gone[35:].any()
