"""Near-duplicates and shared spans against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pitloom.llm import near_dup, spans
from pitloom.llm.hashing import Rolling, word_shingles

WORDS = [f"w{i}" for i in range(300)]


def news(seed, n=160):
    rng = random.Random(seed)
    boiler = " ".join(rng.choice(WORDS) for _ in range(25))
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.5:
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 0, 1, 3, 8, 15])):
                k = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[k] = rng.choice(WORDS)
                else:
                    w.insert(k, rng.choice(WORDS))
            t = " ".join(w)
        else:
            t = " ".join(rng.choice(WORDS) for _ in range(rng.choice([30, 45, 60, 120, 200])))
            if rng.random() < 0.5:
                t += " " + boiler
        texts.append(t)
        rows.append((i, 1, t, "x"))
    rows += [(5, 2, "short now", "x"), (6, 0, "older text that loses", "x"), (500, 1, None, "x"), (501, 1, "", "x"), (None, 1, texts[0], "x"), (502, 1, "Word, " * 60, "x"), (503, 1, "word " * 45, "x"), (504, 1, "word " * 50 + "other", "x")]
    rows += rows[:10]
    rows += [(600, 1, " ".join(rng.choice(WORDS) for _ in range(60_000)), "x")]
    rows += [(601, 1, rows[-1][2] + " end", "x")]
    return rows


def pairs_of(rows, width, threshold, least):
    best = {}
    for i, v, t, _ in rows:
        if i is not None and (i not in best or v > best[i][0]):
            best[i] = (v, t)
    sets = {}
    for i, (_, t) in best.items():
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if len(w) >= least and len(w) >= width:
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("width,threshold,least,longest", [(3, 0.5, 40, 16), (3, 0.5, 40, 2), (5, 0.8, 1, 16)])
@pytest.mark.parametrize("wide", [False, True])
def test_near_duplicates(spark, monkeypatch, width, threshold, least, longest, wide):
    if wide:  # the way that large tables take
        monkeypatch.setattr(near_dup, "small", lambda df, rows=0: df)
    rows = news(width)
    df = spark.createDataFrame(rows, "id long, version int, text string, sketch string")
    links, members = near_dup.near_duplicates(df, width, threshold, least, longest=longest)
    got = [tuple(r) for r in near_dup.expand(links, members).collect()]
    assert len(got) == len(set(got))
    assert set(got) == pairs_of(rows, width, threshold, least)


def variants(n, words=152, seed=11):
    """Variants of one text, of which each has 3 to 13 words replaced."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(words), rng.randrange(3, 14)):
            w[k] = f"x{i}y{k}"
        rows.append((i, 1, " ".join(w)))
    return rows


def exact(rows, width, threshold):
    """Pairs of rows with the exact similarity, from products of indicator matrices."""
    number, at = {}, []
    for i, (_, _, t) in enumerate(rows):
        w = t.split()
        at += [(i, number.setdefault(tuple(w[k : k + width]), len(number))) for k in range(len(w) - width + 1)]
    at = np.array(sorted(set(at)))
    size = np.bincount(at[:, 0], minlength=len(rows))
    common = np.bincount(at[:, 1])[at[:, 1]] > 1
    at = at[common]
    of = np.unique(at[:, 1], return_inverse=True)[1]
    m = np.zeros((len(rows), of.max() + 1), dtype=np.float32)
    m[at[:, 0], of] = 1
    c = m @ m.T
    j = c / (size[:, None] + size[None, :] - c)
    a, b = np.nonzero(np.triu(j >= threshold, 1))
    return dict(zip(zip(a.tolist(), b.tolist()), j[a, b].tolist()))


def test_large_group_keeps_its_pairs(spark, monkeypatch):
    """Lists that most of a large group are in lose no pairs, in several parts either."""
    monkeypatch.setattr(near_dup, "BLOCK", 60, raising=False)
    rows = variants(150)
    _, sketched = near_dup.sketches(spark.createDataFrame(rows, "id long, version int, text string"), 3, 40)
    got = near_dup.candidates(sketched, 2).filter(f"shared >= {getattr(near_dup, 'SHARED', 2)}").toPandas()
    got, want = list(zip(got["a"].tolist(), got["b"].tolist())), set(exact(rows, 3, 0.5))
    assert len(got) == len(set(got)) and len(want & set(got)) >= 0.9998 * len(want)


@pytest.mark.parametrize("held", [1, 40])
def test_lists_that_are_not_held_lose_no_pairs(spark, held):
    """Lists of more postings than are held at once are sent again, to the same lists in the end."""
    rows = variants(150) + [(1000 + i, 1, " ".join(f"y{i % 7}z{k}" for k in range(40 + i))) for i in range(20)]
    _, sketched = near_dup.sketches(spark.createDataFrame(rows, "id long, version int, text string"), 3, 40)
    got = {(r.a, r.b) for r in near_dup.candidates(sketched, 2, held=held).collect()}
    want = {(rows[a][0], rows[b][0]) for a, b in exact(rows, 3, 0.5)}
    assert len(want & got) >= 0.9998 * len(want)


def test_chance_pairs_stay_out_of_the_shuffle(spark, monkeypatch):
    """On a vocabulary that stays the same, lists grow with the table; what is written from them must not grow faster by much."""
    staged = []
    stage = near_dup.stage

    def counted(df, *args, **kwargs):
        out = stage(df, *args, **kwargs)
        staged.append(out.count())
        return out

    rng = random.Random(8)
    rows = [(i, 1, " ".join(rng.choice(WORDS[:12]) for _ in range(100))) for i in range(2400)]
    written = []
    for n in (600, 2400):
        _, sketched = near_dup.sketches(spark.createDataFrame(rows[:n], "id long, version int, text string"), 3, 40)
        with monkeypatch.context() as m:
            m.setattr(near_dup, "stage", counted)
            near_dup.candidates(sketched, least=0.275)
        written.append(sum(staged) / n)
        staged.clear()
    assert written[1] <= 47  # rows for each text, which has 47 keys


def test_near_duplicates_of_nothing(spark):
    for rows in ([], [(1, 1, None)], [(1, 1, "one two three four five six")]):
        links, members = near_dup.near_duplicates(spark.createDataFrame(rows, "id long, version int, text string"))
        assert links.count() == 0 and near_dup.expand(links, members).count() == 0


def test_shingles_do_not_cross_texts():
    h, owner, words = word_shingles(["a b c", "d e", "A  b-C d", ""], 3)
    assert list(words) == [3, 2, 4, 0] and list(owner) == [0, 2, 2] and h[0] == h[1] != h[2]


@pytest.mark.parametrize("final", [False, True])
def test_lists_across_batches(final):
    rng = random.Random(3)
    post = sorted((rng.choice([1, 2, 3, 4, 5, 6, 7, 7, 7, 7, 7]), d) for d in range(80))
    want, hot = set(), set()
    for k in range(1, 8):
        docs = [d for x, d in post if x == k]
        if final or len(docs) <= 9:
            want |= {(a, b) for i, a in enumerate(docs) for b in docs[i + 1 :]}
        else:
            hot |= set(docs)
    for size in (1, 3, 7, 80):
        batches = [pa.RecordBatch.from_pydict({"key": [k for k, _ in part], "doc": [d for _, d in part], "places": pa.array([0] * len(part), pa.int64())}) for part in (post[i : i + size] for i in range(0, 80, size))]
        rows = [(a, b) for out in near_dup._list_batches(batches, 9, final) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist())]
        assert {r for r in rows if r[1] is not None} == want
        assert {a for a, b in rows if b is None} == hot


def documents(seed, n=60):
    rng = random.Random(seed)
    alphabet = "abcdefgh  ÄΩ漢字😀\n"
    fresh = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    pool = [fresh(k) for k in (150, 199, 200, 201, 230, 400, 900)]
    footer = fresh(185)
    rows = []
    for i in range(n):
        t = fresh(rng.randrange(0, 600))
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(pool)
            if rng.random() < 0.3:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice(alphabet) + p[k:]
            t = t + p + fresh(rng.randrange(0, 50))
        if rng.random() < 0.5:
            t += footer
        rows.append((i, t, 1))
    rows += [(100, None, 1), (101, "", 1), (102, "=" * 700, 1), (103, "x" + "=" * 250 + "y", 1), (104, "ab" * 300, 1), (105, "q" + "ab" * 120, 1), (106, rows[3][1] + fresh(200), 1), (107, rows[106 % 60][1] + fresh(250), 1), (108, pool[2], 1), (109, pool[2], 1)]
    return rows


def common_pairs(rows, span):
    grams = {}
    for i, t, _ in rows:
        for k in range(len(t or "") - span + 1):
            grams.setdefault(t[k : k + span], set()).add(i)
    return {(a, b) for s in grams.values() for a in s for b in s if a < b}


def covered(rows, span):
    grams, out = {}, {}
    for i, t, _ in rows:
        for k in range(len(t or "") - span + 1):
            grams.setdefault(t[k : k + span], set()).add(i)
    for i, t, _ in rows:
        hit = np.zeros(len(t or ""), dtype=bool)
        for k in range(len(t or "") - span + 1):
            if len(grams[t[k : k + span]]) > 1:
                hit[k : k + span] = True
        out[i] = int(hit.sum())
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("wide", [False, True])
def test_shared_spans(spark, monkeypatch, seed, wide):
    if wide:
        monkeypatch.setattr(spans, "BLOCK", 3)
        monkeypatch.setattr(spans, "small", lambda df, rows=0: df)
    rows = documents(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    matches, members = spans.shared_spans(df)
    got = [tuple(r) for r in spans.expand(matches, members).collect()]
    assert len(got) == len(set(got)) and set(got) == common_pairs(rows, 200)
    assert all(r.length >= 200 for r in matches.collect())
    text = {i: t for i, t, _ in rows}
    for r in matches.collect():
        assert text[r.doc_id_a][r.start_a : r.start_a + r.length] == text[r.doc_id_b][r.start_b : r.start_b + r.length]
    assert {r.doc_id: r.shared_chars for r in spans.shared_part(df).collect()} == covered(rows, 200)
    texts = {i: t for i, t, _ in rows if t and len(t) >= 200}
    got = {r.doc_id: (r.class_id, r.n_links) for r in spans.classes(matches, members).collect()}
    for i, t in texts.items():
        same = {j for j, u in texts.items() if u == t}
        others = {texts[b if a in same else a] for a, b in common_pairs(rows, 200) if (a in same) != (b in same)}
        assert got[i] == (min(same), len(others))


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 1500)
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij ") for _ in range(9000))
    rows = [(1, long, 0)] + [(10 + k, "z" * k + long[a : a + 200] + "!", 0) for k, a in enumerate(range(0, 8800, 137))]
    cut = spans.chunks([long], 200)
    assert len(cut["start"]) and cut["start"].max() > 8000
    found = 0
    whole = {(d, int(s)) for d, s in zip(cut["digest"], cut["start"])}
    for _, t, _ in rows[1:]:
        c = spans.chunks([t], 200)
        found += any(d in {x for x, _ in whole} for d in c["digest"])
    assert found == len(rows) - 1


def test_no_documents(spark):
    df = spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")
    matches, members = spans.shared_spans(df)
    assert matches.count() == 0 and members.count() == 0
    assert {r.doc_id: (r.n_chars, r.shared_chars, r.shared_part) for r in spans.shared_part(df).collect()} == {1: (0, 0, 0.0), 2: (5, 0, 0.0)}


def test_rolling_hash_of_spans():
    data = np.frombuffer(b"abcabcabd", dtype=np.uint8)
    h = Rolling(data).spans(np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[1] != h[2]


def test_likely_loses_no_partner(spark, monkeypatch):
    from pitloom.llm import bloom

    df, keys = spark.range(5000), spark.range(0, 5000, 50)
    for bits, most in ((1 << 26, 1000), (256, 3000), (64, 5000)):  # the last is too small to be of use
        monkeypatch.setattr(bloom, "MOST", bits)
        got = {r.id for r in bloom.likely(df, keys, "id").collect()}
        assert {r.id for r in keys.collect()} <= got and len(got) <= most
    assert bloom.likely(df, keys.limit(0), "id").count() == 0


@pytest.mark.parametrize("hot", [3, 1000])
def test_representatives_of_hot_groups(spark, hot):
    from pitloom.llm.copies import representatives

    rows = [(i, "hot" if i % 3 == 0 else f"d{i % 40}") for i in range(200)]
    got = {r.id: r.rep for r in representatives(spark.createDataFrame(rows, "id long, digest string"), "id", ["digest"], hot).collect()}
    want = {}
    for i, d in rows:
        want.setdefault(d, i)
    assert got == {i: want[d] for i, d in rows}
    assert representatives(spark.createDataFrame([], "id long, digest string"), "id", ["digest"]).count() == 0
