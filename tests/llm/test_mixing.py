import os
import random

import pytest

from panelmill.llm.mixing import TOKENIZERS, apportion, mix, reached, token_count
from pyspark.sql import functions as F


def brute(shares, caps, seats):
    got = dict.fromkeys(shares, 0)
    for _ in range(seats):
        open_ = [s for s in shares if got[s] < caps[s] and shares[s] > 0]
        if not open_:
            break
        got[min(open_, key=lambda s: (-shares[s] / (2 * got[s] + 1), -shares[s], s))] += 1
    return got


def test_apportionment_is_highest_quotients():
    r = random.Random(0)
    for _ in range(60):
        shares = {c: r.choice([0.0, r.random(), r.random()]) for c in "abcdef"}
        caps = {c: r.choice([0, 3, 50, 1000]) for c in "abcdef"}
        seats = r.randint(0, 400)
        assert apportion(shares, caps, seats) == brute(shares, caps, seats)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(2)
    docs = []
    for i in range(6000):
        s = r.choices(["big", " BIG ", "mid", "small", "stray", None], [30, 10, 20, 1, 5, 1])[0]
        docs.append((i, s, r.choice([0, r.randint(50, 900), 3000]) if i % 50 == 0 else r.randint(50, 900), "clash"))
    return spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, repeats string"), spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 3), ("small", 0.15, 4), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")


def test_shares_limits_and_report(tables):
    docs, targets = tables
    out = mix(docs.drop("repeats"), targets, total_tokens=1_500_000, block_tokens=2000, shard_tokens=300_000)
    rows = out.collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) and all(1 <= r["repeats"] <= {"big": 2, "mid": 3, "small": 4}[r["source"]] for r in rows)
    rep = {r["source"]: r for r in reached(out, docs, targets).collect()}
    assert rep["absent"]["tokens"] == 0 and rep["small"]["at_limit"]
    total = sum(r["n_tokens"] * r["repeats"] for r in rows)
    assert abs(total - 1_500_000) < 0.02 * 1_500_000
    assert abs(rep["big"]["tokens"] / rep["mid"]["tokens"] - 5 / 3) < 0.05
    assert abs(sum(r["reached_share"] for r in rep.values()) - 1) < 1e-9
    again = {(r["doc_id"], r["repeats"]) for r in mix(docs.drop("repeats"), targets, total_tokens=1_500_000, block_tokens=2000, shard_tokens=300_000).collect()}
    assert again == {(r["doc_id"], r["repeats"]) for r in rows}


def test_empty_corpus(tables):
    docs, targets = tables
    assert mix(docs.drop("repeats").limit(0), targets).count() == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZERS), reason="no vocabulary files")
def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "hello world" * 5000), (5, "<|endoftext|>")], "id long, t string")
    got = {r["id"]: r["n"] for r in df.select("id", token_count(F.col("t")).alias("n")).collect()}
    assert got[1] == got[2] == 0 and 2 <= got[3] <= 4 and got[4] >= 10_000 and got[5] > 1


def test_sources_too_small_for_their_seats_are_taken_whole(spark):
    docs = [(i, "large", 1000) for i in range(400)] + [(1000 + i, "tiny", 300) for i in range(3)] + [(2000 + i, "odd", 1000) for i in range(11)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("large", 0.7, 2), ("tiny", 0.1, 2), ("odd", 0.2, 3)], "source string, target_share double, max_repeats int")
    rows = mix(df, targets, total_tokens=300_000, block_tokens=4096).collect()
    got = {s: sum(r["n_tokens"] * r["repeats"] for r in rows if r["source"] == s) for s in ("large", "tiny", "odd")}
    assert got["tiny"] == 900 * 2 and got["odd"] == 11_000 * 3
    assert abs(sum(got.values()) - 300_000) <= 2 * 4096


def test_seats_of_shards_are_those_of_handing_out_one_by_one(spark):
    import random

    from panelmill.llm.mixing import shard_seats

    r = random.Random(7)
    rows, want = [], {}
    for name, seats in (("a", 40), ("b", 7), ("c", 0), ("d", 333)):
        own = {k: r.choice([r.randint(1, 9), r.randint(50, 4000)]) for k in range(12)}
        rows += [(name, k, v, seats) for k, v in own.items()]
        got = dict.fromkeys(own, 0)
        for _ in range(seats):
            best = min(own, key=lambda k: (-own[k] / (2 * got[k] + 1), k))
            got[best] += 1
        want |= {(name, k): v for k, v in got.items()}
    df = spark.createDataFrame(rows, "source string, shard long, own long, seats long")
    assert {(x["source"], x["shard"]): x["due"] for x in shard_seats(df).collect()} == want
    assert {(x["source"], x["shard"]): x["due"] for x in shard_seats(df, reach=0).collect()} == want


def test_apportionment_equals_handing_out_seats(spark):
    import random

    from panelmill.llm.mixing import apportion

    r = random.Random(5)
    for _ in range(200):
        names = [f"s{i}" for i in range(r.randint(1, 8))]
        shares, caps, seats = {s: r.random() for s in names}, {s: r.choice([0, 2, 50, 1000]) for s in names}, r.randint(0, 300)
        got = dict.fromkeys(names, 0)
        for _ in range(seats):
            free = [s for s in names if got[s] < caps[s]]
            if not free:
                break
            got[min(free, key=lambda s: (-shares[s] / (2 * got[s] + 1), -shares[s], s))] += 1
        assert apportion(shares, caps, seats) == got
