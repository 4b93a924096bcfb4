from collections import defaultdict

import pytest
from conftest import WORD, make

from frameloom.llm.ngram_join import join, keep_one, meeting


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, size, percent):
    sets = []
    for _, text, _, _ in rows:
        w = WORD.findall(lower(text))
        sets.append(frozenset(zip(*[w[i:] for i in range(size)], strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[top(i)] if sets[i] else rows[i][0], links[i]) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize(("size", "percent", "spread", "chunk"), [(3, 90, 2.0, 96), (5, 80, 1.3, 96), (2, 60, 1.0, 4), (5, 80, 1.3, 3)])
def test_components_and_links(docs, rows, size, percent, spread, chunk):
    got = join(docs, size=size, percent=percent, spread=spread, chunk=chunk).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, size, percent)


def test_one_document_of_each_group_stays(docs, rows):
    want = brute(rows, 5, 80)
    kept = keep_one(docs, size=5, percent=80)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    # id 100 stands on two texts that are not linked: both stay
    assert ids == sorted(i for i, _ in {r[:2] for r in want if r[0] is not None and r[0] == r[2]})
    assert ids.count(100) == 2


def test_chain_of_near_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = [*words[:i * 3], f"new{i}", *words[i * 3 + 1:]]
        rows.append((i, " ".join(words), "en", "a"))
    got = join(make(spark, rows), size=3, percent=90, spread=2.0, chunk=7).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 3, 90)
    assert {r["component_id"] for r in got} == {0}


def test_empty_and_blank(spark, none):
    assert join(none).count() == 0 and keep_one(none).count() == 0
    blank = make(spark, [(1, None, "en", "a"), (2, " ", "en", "a"), (3, "", "en", "a")])
    assert sorted(tuple(r) for r in join(blank).collect()) == [(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0)]
    assert keep_one(blank).count() == 3


@pytest.mark.parametrize("swap", [False, True])
def test_an_id_on_two_texts_stays_with_the_one_that_is_its_own(spark, swap):
    near, own = " ".join(f"w{i}" for i in range(100)), " ".join(f"v{i}" for i in range(100))
    two = [(5, near + " end", "en", "a"), (5, own, "en", "a")]
    docs = make(spark, [(3, near, "en", "a"), *(two[::-1] if swap else two), (7, None, "en", "a")]).coalesce(1)
    got = keep_one(docs, size=5, percent=80).select("doc_id", "text").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(3, near), (5, own), (7, None)]


def test_an_id_on_linked_and_unlinked_texts(spark):
    near, other = " ".join(f"w{i}" for i in range(100)), " ".join(f"v{i}" for i in range(100))
    docs = make(spark, [(3, near, "en", "a"), (3, near + " end", "en", "a"), (3, other, "en", "a"), (3, other, "en", "a"), (4, other + " end", "en", "a")])
    got = sorted(r["text"].split()[0] for r in keep_one(docs, size=5, percent=80).collect())
    assert got == ["v0", "w0"]


def test_edges_keep_what_shares_a_signature_together(spark):
    import random

    rng = random.Random(8)
    posts = {(s, rng.randrange(200)) for s in range(150) for _ in range(rng.randrange(1, 4))}
    lead = {}
    for s, n in posts:
        lead[s] = min(lead.get(s, n), n)
    edges = meeting(spark.createDataFrame([(n, lead[s]) for s, n in posts], "node long, lead long")).collect()
    assert len(edges) <= len({n for _, n in posts}) + 150

    def groups(pairs):
        parent = {n: n for _, n in posts}

        def top(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            parent[top(a)] = top(b)
        out = defaultdict(set)
        for n in parent:
            out[top(n)].add(n)
        return {frozenset(g) for g in out.values()}

    assert groups([(r["a"], r["b"]) for r in edges]) == groups([(n, lead[s]) for s, n in posts])
