import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellgrid.llm import minhash as M
from cellgrid.llm.components import connected_components
from cellgrid.llm.shingles import shingle_set


def brute(rows, width=4, percent=80):
    """Row by row: (id, set size, component) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < k).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if sets[k] and i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((repr(i), len(sets[k]), repr(least.get(find(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def got(frame, **options):
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in M.near_duplicates(frame, **options).collect())


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(rng.randint(5, 150))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:25]:
        for _ in range(rng.randint(1, 6)):
            c = list(b)
            for _ in range(rng.randint(0, max(1, len(c) // 20))):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
    texts += [texts[3].upper(), texts[3].replace(" ", "\n\t"), "", None, "   ", "one", "ONE", "one two three", "one  two three", "é É", texts[0]]
    return texts


def test_equals_brute_force(spark):
    rows = list(enumerate(corpus()))
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")
    assert got(frame) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    texts = corpus(3)[:80]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, t) for i, t in enumerate(texts[:20])] + [(None, t) for t in texts[5:12]] + [(7, texts[50]), (None, "only without an id here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(frame) == brute(rows)


def test_the_way_for_the_rest_finds_what_leaders_miss(spark, monkeypatch):
    """A chain in which each text is near the next only: leaders alone cannot link it."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(M, "BLOCK", 4)
    assert got(frame) == brute(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_duplicates(empty).count() == 0 and M.keep_one(empty).count() == 0


def test_keep_one(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "A b c d e f g", "y"), (1, "a b c d e f g", "x"), (3, "", "z"), (4, None, "z"), (1, "quite another text with this id", "w"), (None, "a b c d e f g", "n"), (None, "no id but alone in the world", "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    kept = sorted((repr(r.doc_id), repr(r.text)) for r in M.keep_one(frame).collect())
    assert kept == sorted([("1", repr("a b c d e f g")), ("3", "''"), ("4", "None"), ("1", repr("quite another text with this id")), ("None", repr("no id but alone in the world"))])


def test_odd_sketch_estimates():
    rng = np.random.default_rng(5)
    for share in (0.95, 0.85, 0.7, 0.5):
        off = []
        for _ in range(30):
            both = rng.integers(0, 2**63, 2000, dtype=np.uint64)
            n = round(1000 * 2 * share / (1 + share))
            a, b = both[:1000], np.concatenate([both[:n], both[1000 : 2000 - n]])
            x, y = (np.frombuffer(M.odd_sketch(M.min_samples(s)), np.uint64) for s in (a, b))
            off.append(int(np.bitwise_count(x ^ y).sum()))
        assert abs(np.mean(off) - M.most_bits(share)) < 12


def test_short_texts_have_one_shingle():
    assert len(shingle_set(b"", 4)) == 0 and len(shingle_set(b" \x0b\x0c", 4)) == 0
    assert len(shingle_set(b"a b c", 4)) == 1 and len(shingle_set(b"a b c d", 4)) == 1
    assert shingle_set(b"a b", 4)[0] != shingle_set(b"b a", 4)[0]
    assert shingle_set(b"A\nB", 4)[0] == shingle_set(b"a b", 4)[0]


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51), (51, 50), (60, 60)]])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.comp for r in connected_components(frame).collect()}
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert found == want


def test_given_documents_equal_brute_force(spark):
    """No link is lost on the given tables: components of all pairs, by full sets."""
    from cellgrid.llm.common import table

    documents = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    want = sorted(brute([(r.doc_id, r.text) for r in documents.collect()]))
    found = got(documents)
    assert found == want and len({c for *_, c in found}) < len(found)
