import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from knotwork.llm import jaccard
from knotwork.operators.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    parent = {i: i for i in sets}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in lists[x]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined(df).collect())


def corpus(n, seed, longest=60):
    """Texts with copies, near copies of every distance, shared passages and frequent words."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    word = lambda: rnd.choice(vocabulary[:5] if rnd.random() < 0.3 else vocabulary)
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(n):
        if i and rnd.random() < 0.5:
            w = rows[rnd.randrange(len(rows))][1].split()
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                if w:
                    k = rnd.randrange(len(w))
                    w[k : k + rnd.randint(0, 1)] = [word()] * rnd.randint(0, 1)
        else:
            w = [word() for _ in range(rnd.randint(1, longest))]
        if rnd.random() < 0.3:
            w = passage + w
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(x.upper() if rnd.random() < 0.1 else x for x in w)))
    return rows


@pytest.mark.parametrize(("n", "seed", "longest"), [(300, 1, 12), (250, 2, 60), (150, 3, 400)])
def test_equals_brute_force(spark, n, seed, longest):
    rows = corpus(n, seed, longest)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("small", [0, 5, 30, 64])
def test_any_boundary_gives_the_same(spark, monkeypatch, small):
    """Subsets alone, lists alone, and both; long lists in blocks."""
    monkeypatch.setattr(jaccard, "boundary", lambda *_: small)
    rows = corpus(250, 5, 40)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("length", [20, 2048])
def test_hot_groups(spark, monkeypatch, length):
    """Long lists; also dealt to blocks by their exact lengths."""
    monkeypatch.setattr(jaccard, "LIST", length)
    rnd = random.Random(9)
    base = [f"b{k}" for k in range(50)]
    rows = [(i, " ".join(base)) for i in range(200)]
    for i in range(200, 400):
        w = list(base)
        w[rnd.randrange(50)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join([*base[:30], *(f"y{i}_{k}" for k in range(12))])) for i in range(400, 600)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    words = " ".join(f"q{k}" for k in range(9))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, words), (8, words.upper() + "\n"), (9, "É é"), (10, "é é"), (11, "z" * 3_000_000), (12, "z" * 3_000_000 + " "), (13, "w " * 300_000), (14, "a\x00b c"), (15, "a\x00b  c")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, "p q r", 1), (3, "p q r", 1), (None, "lonely", 1), (5, "same id", 1), (5, "same id", 1)], "doc_id long, text string, n long")
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1) for r in jaccard.joined(df).collect())
    assert got == [(-1, 1, -1), (-1, 1, 3), (3, 1, 3), (5, 1, 5), (5, 1, 5)]
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 3, 5]


def test_word_hashes_do_not_depend_on_stretches(monkeypatch):
    text = " ".join(f"word{k}" for k in range(3000)) + " " + "L" * 700 + " end "
    data = np.frombuffer(text.encode(), np.uint8)
    whole = jaccard.word_hashes(data)
    monkeypatch.setattr(jaccard, "CHUNK", 512)
    monkeypatch.setattr(jaccard, "LONG", 1 << 18)
    parts = jaccard.word_hashes(data)
    assert whole[1].tolist() == parts[1].tolist()
    other = np.flatnonzero(whole[0] != parts[0])
    assert len(other) <= 1  # only the word longer than a stretch


def test_prefixes_and_needs():
    for a in range(1, 80):
        for b in range(1, 80):
            n = jaccard.needed(a, b)
            assert 100 * n >= 80 * (a + b - n) and 100 * (n - 1) < 80 * (a + b - n + 1)
    assert [int(jaccard.prefix(n, 1)) for n in (1, 4, 5, 10)] == [1, 1, 2, 3]


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in links if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_are_summed_by_a_tree(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAN", 2)
    docs = spark.createDataFrame([(i, f"a b c d e f{i}") for i in range(40)], "doc_id long, text string").repartition(7)
    sketch = jaccard.sketch_of(jaccard.signatures(docs))
    assert sketch.sum() == 80 and sketch.max() >= 40 and len(sketch) == 1 << 22


def test_the_join_finds_the_links(spark):
    phases = {}
    rows = corpus(200, 6, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    jaccard.joined(df, phases).count()
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    different = {c for _, _, c in brute(rows)}
    assert sum(phases.values()) >= len(set(sets.values()) - {frozenset()}) - len({c for c in different if sets[c]})
