import hashlib

import pytest
from conftest import WORD, make

from frameloom.llm.mixing import mix, mix_sizes


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Share, cap, and share the excess again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, left = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        goal = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if goal[s] > cap * sizes[s] + 1e-9]
        if not over:
            return capped | goal
        for s in over:
            capped[s] = cap * sizes[s]
            left -= capped[s]


def h(doc_id):
    return int(hashlib.md5(f"mix:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:12], 16)


def test_targets_and_takes(docs, rows):
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    got = mix_sizes(docs).collect()
    assert len(got) == len(rows)
    for s, goal in want.items():
        own = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(goal) and r["source_size"] == sizes[s] for r in own)
        taken = sum(r["size"] * r["takes"] for r in own)
        assert abs(taken - goal) <= max(r["size"] for r in own)
        assert all(0 <= r["takes"] <= 2 for r in own)
        # nested: within a source, smaller hashes are taken at least as often
        order = [r["takes"] for r in sorted(own, key=lambda r: h(r["doc_id"]))]
        assert order == sorted(order, reverse=True)


def test_runs_agree_and_rows_repeat(docs):
    a, b = (sorted(map(repr, mix(docs).select("doc_id", "text", "source").collect())) for _ in range(2))
    assert a == b
    takes = {(r["doc_id"], r["source"]): r["takes"] for r in mix_sizes(docs).collect() if r["size"]}
    assert any(n == 2 for n in takes.values()) or any(n == 0 for n in takes.values())


def test_one_source_and_empty(spark, none):
    assert mix_sizes(none).count() == 0
    one = mix_sizes(make(spark, [(i, "a b c", "en", "s") for i in range(100)])).collect()
    assert abs(sum(r["size"] * r["takes"] for r in one) - 450) <= 3
    blank = mix_sizes(make(spark, [(1, None, "en", "s"), (2, " ", "en", None)])).collect()
    assert [(r["size"], r["target"]) for r in blank] == [(0, 0.0), (0, 0.0)]
