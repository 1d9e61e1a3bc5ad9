from collections import defaultdict

import pytest

from cairn.llm.mixing import Mix

T = "source string, target_share double, max_repeats int, tokens long"


def mix(spark, docs, targets, **more):
    return Mix(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, source string, tokens long, repeats long"), spark.createDataFrame([(*t, 1) for t in targets], T), **more)


def test_shares_caps_and_schedule(spark):
    docs = [(k, "big", 50 + k % 7) for k in range(4000)] + [(10_000 + k, " Small-Set", 40) for k in range(200)] + [(20_000, "other", 9), (None, "big", 5), (20_001, None, 5), (20_002, "big", 0), (20_003, "big", None)]
    targets = [("big", 0.7, 1), ("small_set", 0.3, 3), ("absent", 0.2, 2), (None, 0.1, 1), ("zero", 0.0, 1)]
    m = mix(spark, docs, targets)
    uses = m.uses().collect()
    by, repeats = defaultdict(int), defaultdict(int)
    for u in uses:
        by[u.source] += u.tokens
        repeats[u.source, u.doc_id] += 1
    total = sum(by.values())
    assert by["small_set"] / total == pytest.approx(0.3, abs=0.01) and by["big"] / total == pytest.approx(0.7, abs=0.01)
    assert max(v for (s, _), v in repeats.items() if s == "small_set") == 3 and max(v for (s, _), v in repeats.items() if s == "big") == 1
    assert len({(u.doc_id, u.copy) for u in uses}) == len(uses)
    # Every part of the schedule is near the weights.
    uses.sort(key=lambda u: u.slot)
    half = uses[: len(uses) // 2]
    assert sum(u.tokens for u in half if u.source == "small_set") / sum(u.tokens for u in half) == pytest.approx(0.3, abs=0.02)
    assert {(r.doc_id, r.repeats) for r in m.chosen().collect()} == {(d, v) for (_, d), v in repeats.items()}
    shares = {r.source: r for r in m.shares().collect()}
    assert shares["absent"].reached_share == 0 and shares["small_set"].reached_share == pytest.approx(by["small_set"] / total, abs=1e-6)


def test_a_total_and_empty_tables(spark):
    docs, targets = [(k, "a" if k % 2 else "b", 10) for k in range(2000)], [("a", 0.5, 1), ("b", 0.5, 1)]
    assert sum(u.tokens for u in mix(spark, docs, targets, total=1000).uses().collect()) == pytest.approx(1000, abs=40)
    assert mix(spark, [], targets).uses().count() == 0 == mix(spark, docs, []).uses().count()
    assert {r.reached_share for r in mix(spark, [], targets).shares().collect()} == {0.0}
