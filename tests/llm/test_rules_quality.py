import zlib

import numpy as np

from cellgrid.llm import quality, rules
from cellgrid.llm.textstats import base_stats, features


def brute(text):
    raw = text or ""
    words, word = [], ""
    for c in raw + " ":
        if c in "\t\n\x0b\x0c\r ":
            words += [word] if word else []
            word = ""
        else:
            word += c
    seen, dup = set(), 0
    for line in raw.split("\n"):
        if line.strip("\t\n\x0b\x0c\r "):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    in_run = set()
    for i, r in enumerate(runs):
        if runs.count(r) > 1:
            in_run |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(raw.count(c) for c in "#*$%&|<>"), dup, len(in_run)


TEXTS = ["", "   ", "a", "a b c d e f g h " * 4, "x\ny\nx\n\n \nx", "é # % ü z q", "a b c d e f g h i a b c d e f g h j a b c d e f g h", "w " * 30, "line one\r\nline one\r\n", "日本 <b> & |"]


def test_base_statistics_equal_brute_force():
    for text in TEXTS:
        assert base_stats(text.encode())[0] == brute(text), text


def test_features_are_finite():
    for text in [*TEXTS, "x" * 100_000, "\x00\x01"]:
        assert np.isfinite(features(text.encode())[1]).all()


def documents(spark, n=400):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(rng.integers(30, 80))]
        bad = k % 10 == 0
        rows.append((k, " ".join(w + "###" for w in words) if bad else " ".join(words) + ".", "clash"))
        labels.append((k, int(not bad), 0))
    rows += [(None, None, "x"), (3, rows[3][1], "x"), (n, "", "x"), (n + 1, "few words", "x"), (n + 2, "word " * 50_000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_rules_query(spark):
    frame, labels, rows = documents(spark)
    got = rules.judge(frame, rules.fit(frame, labels)).collect()
    assert len(got) == len(rows)
    want = sorted((repr(i), *(brute(t)[:4] if len(t or "") < 9000 else ())) for i, t, _ in rows if len(t or "") < 9000)
    assert sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) for r in got if r.n_words < 9000) == want
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[None] and not kept[400] and not kept[401] and not kept[402]
    good = [kept[k] for k in range(400) if k % 10]
    assert np.mean(good) > 0.99 and np.mean([kept[k] for k in range(0, 400, 10)]) < 0.3
    assert rules.judge(frame.limit(0), rules.fit(frame, labels.limit(0))).count() == 0


def test_classifier_query(spark):
    frame, labels, rows = documents(spark)
    got = quality.scores(frame, quality.fit(frame, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == int(r.doc_id % 10 > 0) for r in held]) > 0.97
    none = quality.scores(frame, quality.fit(frame, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.accepted(frame, quality.fit(frame, labels)).columns == frame.columns


def test_labels_of_held_out_rows_do_not_matter(spark):
    frame, labels, _ = documents(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = quality.fit(frame, labels), quality.fit(frame, flipped)
    assert (a.value == b.value).all() and (a.cut == b.cut).all()


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.train(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_isolation_scores_rank_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(990, 3)), rng.normal(6, 1, size=(10, 3))])
    score = rules.grow(x).score(x)
    assert score[990:].min() > np.quantile(score[:990], 0.98)


def walked(forest, row):
    """Mean path length of one row, node by node."""
    total = 0.0
    for column, cut, left, length in zip(forest.column, forest.cut, forest.left, forest.length, strict=True):
        k = 0
        while left[k] != k:
            k = int(left[k]) + int(row[int(column[k])] >= cut[k])
        total += length[k]
    return 2.0 ** (-total / len(forest.column) / rules.mean_path(forest.per_tree))


def test_verdicts_equal_a_walk_over_brute_statistics(spark):
    frame, labels, rows = documents(spark, 150)
    forest = rules.fit(frame, labels)
    texts = {(i, t): brute(t) for i, t, _ in rows if len(t or "") < 9000}
    want = []
    for (i, t), stats in texts.items():
        failed = stats[0] < 20 or 100 * stats[4] > 30 * stats[0]
        score = walked(forest, rules.ratios(np.array([stats]))[0])
        want.append((repr(i), failed, not failed and score <= forest.threshold))
    got = [(repr(r.doc_id), r.base_failed, r.kept) for r in rules.judge(frame.filter("text IS NULL OR length(text) < 9000").dropDuplicates(["doc_id", "text"]), forest).collect()]
    assert sorted(got) == sorted(want)


def test_boosted_scores_equal_a_walk():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(600, 4)), rng.integers(0, 2, 600).astype(float)
    model = quality.train(x, y)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        margin = model.start
        for column, cut, value in zip(model.column, model.cut, model.value, strict=True):
            k = 0
            while k < len(column):
                k = 2 * k + 1 + int(row[column[k]] > cut[k])
            margin += value[k - len(column)]
        assert abs(1 / (1 + np.exp(-margin)) - score) < 1e-12


def test_splits_equal_an_exhaustive_search():
    rng = np.random.default_rng(6)
    n, bins = 300, 8
    binned, node = rng.integers(0, bins, (n, 3)), rng.integers(0, 2, n)
    slope, bend = rng.normal(size=n), rng.uniform(0.1, 0.25, n)
    column, cut = quality.best_splits(binned, node, 2, slope, bend, bins)
    value = lambda on: slope[on].sum() ** 2 / (bend[on].sum() + quality.SMOOTH)
    for k in range(2):
        own, best = node == k, (1e-9, 0, -1)
        for c in range(3):
            for b in range(bins):
                left, right = own & (binned[:, c] <= b), own & (binned[:, c] > b)
                if left.sum() >= quality.LEAST_ROWS and right.sum() >= quality.LEAST_ROWS:
                    gain = value(left) + value(right) - value(own)
                    best = (gain, c, b) if gain > best[0] + 1e-9 else best
        assert (column[k], cut[k]) == best[1:]


def test_the_threshold_counts_every_held_document(spark):
    rng = np.random.default_rng(12)
    marks = rng.random(24_000) ** 4
    rows = [(k, " ".join(["word#" if x < marks[k] else "longer"[: 1 + int(6 * x)] for x in rng.random(25)])) for k in range(24_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.range(24_000).selectExpr("id AS doc_id", "1 AS quality")
    forest = rules.fit(frame, labels)
    held = rules.judge(frame, forest).filter("NOT base_failed AND pmod(xxhash64(doc_id, 3), 3) = 1").select("anomaly").toPandas()["anomaly"]
    assert len(held) > 7_000 and forest.threshold == np.sort(held)[int(np.ceil(0.998 * len(held))) - 1]
