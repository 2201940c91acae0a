"""Packing and mixing against their definitions."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitloom.llm import tokens
from pitloom.llm.mixing import mix
from pitloom.llm.packing import Packer, fill_report, pack
from pitloom.llm.tokens import with_tokens


def test_counts_are_whole_texts(spark):
    texts = {1: "Über 漢字 and plain words <|endoftext|>", 2: "", 3: None, 4: "word " * 50_000}
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, tokens string")
    got = {r.doc_id: r.tokens for r in with_tokens(df, ["doc_id"]).collect()}
    enc = tokens.encoding(tokens.VOCABULARY)
    assert got == {k: len(enc.encode_ordinary(v or "")) for k, v in texts.items()}
    assert enc.decode(enc.encode_ordinary(texts[1])) == texts[1]


@pytest.mark.parametrize("open_bins", [1, 3, 500])
def test_packer_is_bounded_best_fit(open_bins):
    rng = random.Random(open_bins)
    capacity, packer = 50, Packer(50, open_bins)
    free, order = {}, []
    for _ in range(2000):
        n = rng.randrange(1, 51)
        fits = [b for b in order if free[b] >= n]
        if fits:
            want = min(fits, key=lambda b: free[b])
            level = [b for b in order if free[b] == free[want]]
        else:
            if len(order) == open_bins:
                order.remove(next(b for b in order if free[b] == min(free[x] for x in order)))
            level = None
        got = packer.add(n)
        if level:
            assert got in level
            order.remove(got)
            free[got] -= n
        else:
            free[got] = capacity - n
        if free[got]:
            order.append(got)
        assert free[got] >= 0 and packer.open == len(order) <= open_bins


SPEC = "spec_name string, capacity_tokens int"


def test_pack(spark):
    rng = random.Random(4)
    sizes = [(i, rng.choice([1, 5, 20, 64, 90, 100, 101, 250, 1000]), 1) for i in range(900)] + [(900, 0, 1), (901, None, 1), (902, 7, 1), (902, 7, 1)]
    out = pack(spark.createDataFrame(sizes, "doc_id long, tokens int, bin int"), spark.createDataFrame([("s", 100), ("l", 512)], SPEC), open_bins=16, items_per_packer=200)
    rows = out.toPandas()
    for spec, capacity in (("s", 100), ("l", 512)):
        own = rows[rows.spec_name == spec]
        assert own.groupby("bin").tokens.sum().max() <= capacity
        assert own.groupby("doc_id").tokens.sum().to_dict() == pd.DataFrame([s for s in sizes if s[1]], columns=["d", "t", "x"]).groupby("d").t.sum().to_dict()
        whole = {d for d, t, _ in sizes if t and t <= capacity}
        assert (own[own.doc_id.isin(whole - {902})].groupby("doc_id").size() == 1).all()
        assert (own.token_start == own.piece * capacity).all()
    report = {r.spec_name: r.fill for r in fill_report(out).collect()}
    assert report["s"] > 0.9 and report["l"] > 0.9


def test_specs_of_equal_capacity_are_packed_alike(spark):
    rng = random.Random(9)
    sizes = spark.createDataFrame([(i, rng.randrange(1, 130)) for i in range(600)] + [(7, 150)] * 3, "doc_id long, tokens int")
    out = pack(sizes, spark.createDataFrame([("a", 100), ("b", 100)], SPEC), open_bins=16, items_per_packer=200).toPandas()
    own = {s: sorted(zip(r.doc_id, r.piece, r.tokens, r.bin)) for s, r in out.groupby("spec_name")}
    one = pack(sizes.repartition(5), spark.createDataFrame([("b", 100)], SPEC), open_bins=16, items_per_packer=200).toPandas()
    assert own["a"] == own["b"] == sorted(zip(one.doc_id, one.piece, one.tokens, one.bin))
    assert out.groupby(["spec_name", "bin"]).tokens.sum().max() <= 100


def test_pack_of_nothing(spark):
    items, specs = spark.createDataFrame([], "doc_id long, tokens int"), spark.createDataFrame([("s", 10)], SPEC)
    assert pack(items, specs).count() == 0
    assert pack(spark.createDataFrame([(1, 5)], "doc_id long, tokens int"), specs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack(items, spark.createDataFrame([("s", None)], SPEC))


TARGETS = "source string, target_share double, max_repeats int"


def test_mix_meets_shares(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["big"] * 20 + ["mid"] * 5 + ["small"]), rng.randrange(1, 400)) for i in range(6000)] + [(9001, None, 50), (9002, "other", 50), (9003, "big", 0), (9004, "mid", None)]
    targets = [("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.15, 4), ("absent", 0.05, 2), ("small", 0.15, 4), (None, 0.1, 1)]
    sizes = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, tokens int, budget string")
    chosen, report = mix(sizes, spark.createDataFrame(targets, TARGETS))
    rep = {r.source: r for r in report.collect()}
    rows = chosen.toPandas()
    assert set(rep) == {"big", "mid", "small", "absent"} and rep["absent"].tokens == 0
    for s, share, most in targets[:3]:
        assert rep[s].budget - 5 <= rep[s].tokens <= rep[s].budget
        assert abs(rep[s].share - share / 0.95) < 0.001
        assert rows[rows.source == s].times.max() <= most
        assert (rows[rows.source == s].tokens * rows[rows.source == s].times).sum() == rep[s].tokens
    again = mix(sizes.repartition(7), spark.createDataFrame(targets, TARGETS))[0].toPandas()
    key = ["doc_id", "times"]
    assert sorted(map(tuple, again[key].values)) == sorted(map(tuple, rows[key].values))


def test_mix_of_a_given_size_and_of_nothing(spark):
    sizes = spark.createDataFrame([(i, "a" if i % 2 else "b", 10) for i in range(100)], "doc_id long, source string, tokens int")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], TARGETS)
    rep = {r.source: (r.budget, r.tokens, r.repeats) for r in mix(sizes, t, total=1600)[1].collect()}
    assert rep == {"a": (800, 800, 2), "b": (500, 500, 1)}
    chosen, report = mix(sizes.limit(0), t)
    assert chosen.count() == 0 and {r.tokens for r in report.collect()} == {0}
    chosen, report = mix(sizes, t.limit(0))
    assert chosen.count() == 0 and report.agg(F.count("*").alias("n")).collect()[0].n == 0
