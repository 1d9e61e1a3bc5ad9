import math
from collections import defaultdict

import numpy as np
import pytest

from cairn.llm.packing import LOSS_SHARE, Limits, fill_report, pack, packed

C = "container string, capacity_tokens int, tokens long"


def test_pack_keeps_every_limit_and_wastes_little():
    rng = np.random.default_rng(2)
    tokens = np.minimum(1000, np.exp(rng.normal(5, 1, 5000)).astype(np.int64))
    loss = np.minimum(700, (tokens * rng.uniform(0, 1, 5000)).astype(np.int64))
    for limits in (Limits(1000, 40, 1000), Limits(1000, 6, 700), Limits(4000, 400, 2100)):
        bins = pack(tokens, loss, limits)
        n = bins.max() + 1
        t, s, lo = np.bincount(bins, tokens, n), np.bincount(bins, minlength=n), np.bincount(bins, loss, n)
        assert (t <= limits.tokens).all() and (s <= limits.segments).all() and (lo <= limits.loss).all()
        least = max(tokens.sum() / limits.tokens, len(tokens) / limits.segments, loss.sum() / limits.loss)
        assert n <= math.ceil(least * 1.2)
    assert len(pack(np.array([], dtype=np.int64), np.array([], dtype=np.int64), Limits(10, 1, 1))) == 0
    assert list(pack(np.zeros(5, dtype=np.int64), np.zeros(5, dtype=np.int64), Limits(10, 2, 10))).count(0) == 2


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, tokens long, loss_tokens long, bin string")


def test_every_token_is_placed_once_and_only_large_documents_are_split(spark):
    rows = [(k, (k * 37) % 90, max(0, (k * 37) % 90 - 3)) for k in range(400)] + [(1000, 250, 249), (1001, 100, 100), (1002, 0, 0)]
    caps = spark.createDataFrame([("small", 100, 1), ("large", 1000, 1), (None, 5, 1), ("none", None, 1)], C)
    out = packed(docs(spark, rows), caps).collect()
    assert {r.container for r in out} == {"small", "large"}
    for name, cap in (("small", 100), ("large", 1000)):
        mine, fill, total = [r for r in out if r.container == name], defaultdict(int), defaultdict(int)
        for r in mine:
            fill[r.bin] += r.tokens
            total[r.doc_id] += r.tokens
        assert max(fill.values()) <= cap and dict(total) == {d: t for d, t, _ in rows} and len({(r.doc_id, r.piece) for r in mine}) == len(mine)
        assert {d for d in total if sum(r.doc_id == d for r in mine) > 1} == {d for d, t, _ in rows if t > cap}
        assert sum(r.loss_tokens for r in mine) == sum(min(lo, int(t * LOSS_SHARE)) for _, t, lo in rows)
        assert len(fill) <= 1.1 * sum(total.values()) / cap + 2
        bears, held = defaultdict(int), defaultdict(int)
        for r in mine:
            bears[r.bin] += r.loss_tokens
            held[r.bin] += 1
        limits = Limits.of(cap)
        assert max(bears.values()) <= limits.loss and max(held.values()) <= limits.segments
    report = {r.container: r for r in fill_report(packed(docs(spark, rows), caps), caps.where("container IS NOT NULL AND capacity_tokens > 0")).collect()}
    assert report["small"].documents == len(rows) and report["small"].split_documents == 1 and report["large"].split_documents == 0


def test_empty_tables(spark):
    caps = spark.createDataFrame([("small", 100, 1)], C)
    assert packed(docs(spark, []), caps).count() == 0
    assert packed(docs(spark, [(1, 5, 4)]), caps.limit(0)).count() == 0


def test_no_group_grows_with_what_packs_badly(spark):
    for tokens, n, least in ((60, 60_000, 100), (1, 30_000, 10)):
        out = packed(docs(spark, []).unionByName(spark.range(n).selectExpr("id AS doc_id", f"{tokens}L AS tokens", "0L AS loss_tokens", "'x' AS bin")), spark.createDataFrame([("small", 100, 1)], C))
        groups = out.selectExpr("substring_index(bin, '.', 2) AS g", "bin").groupBy("g").agg({"*": "count"}).collect()
        assert len(groups) > least and max(r[1] for r in groups) < 4 * n / len(groups)
        limits, per = Limits.of(100), out.groupBy("bin").agg({"tokens": "sum", "doc_id": "count"}).collect()
        assert all(r["sum(tokens)"] <= limits.tokens and r["count(doc_id)"] <= limits.segments for r in per) and sum(r["count(doc_id)"] for r in per) == n


def test_long_prompts_are_cut_at_every_limit(spark):
    caps, rows = spark.createDataFrame([("small", 100, 1)], C), [(1, 1000, 10), (2, 300, 0), (3, 250, 100), (4, 305, 303), (5, 200, 100)]
    out = packed(docs(spark, rows), caps).collect()
    limits = Limits.of(100)
    for doc, size, loss in rows:
        mine = sorted((r.piece, r.tokens, r.loss_tokens) for r in out if r.doc_id == doc)
        assert [p for p, _, _ in mine] == list(range(len(mine))) and sum(t for _, t, _ in mine) == size and sum(lo for _, _, lo in mine) == min(loss, int(size * LOSS_SHARE))
        assert all(0 < t <= limits.tokens and 0 <= lo <= min(t, limits.loss) for _, t, lo in mine)


def test_an_item_over_a_limit_is_an_error():
    with pytest.raises(ValueError):
        pack(np.array([11]), np.array([0]), Limits(10, 2, 10))


def test_report_and_limits_by_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(4)
    tokens = np.minimum(3000, np.exp(rng.normal(4.5, 1.2, 4000)).astype(int))
    rows = [(k, int(t), int(max(0, t - rng.integers(0, 12)))) for k, t in enumerate(tokens)]
    caps = spark.createDataFrame([("small", 128, 1), ("middle", 512, 1), ("large", 4096, 1)], C)
    out = packed(docs(spark, rows), caps)
    placed, capacities = out.toPandas(), caps.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("placed", placed)
    con.register("capacities", capacities)
    want = con.sql("""SELECT p.container, count(DISTINCT bin) AS bins, count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) FILTER (piece > 0) AS split_documents, sum(p.tokens)::BIGINT AS tokens,
        round(1 - sum(p.tokens) / (count(DISTINCT bin) * max(capacity_tokens)), 6) AS unused FROM placed p JOIN capacities c ON c.container = p.container GROUP BY 1""").fetchall()
    assert {tuple(r) for r in fill_report(out, caps).collect()} == set(want) and all(r[5] < 0.03 for r in want)
    over = con.sql("""SELECT count(*) FROM (SELECT p.container, bin, sum(p.tokens) AS t, sum(p.loss_tokens) AS l, count(*) AS n, max(capacity_tokens) AS c FROM placed p JOIN capacities k ON k.container = p.container GROUP BY 1, 2)
        WHERE t > c OR l > greatest(1, floor(c * 0.995)) OR n > greatest(1, c // 16)""").fetchall()
    assert over == [(0,)]
