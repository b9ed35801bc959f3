import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from cellgrid.llm import bpe_codec, mixing, quality
from cellgrid.llm.textstats import features
from tests.llm.test_minhash import brute
from tests.llm.test_mixing_lines import brute_lines, brute_targets


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for k in range(360):
        bad = k % 9 == 0
        words = [word() + ("%%%" if bad else "") for _ in range(rng.randint(40, 90))]
        text = " ".join(words[:20]) + ".\n" + " ".join(words[20:]) + "."
        if k % 5 == 1:
            text = "The line that stands on every site.\n" + text
        docs.append([k, text, "en", f"s{k % 12}", len(text)])
        labels.append((k, int(not bad), 0))
    for k in range(60):
        source = docs[rng.randrange(300)]
        words = source[1].split(" ")
        if k % 2:
            words[rng.randrange(25, 30)] = word()
        docs.append([1000 + k, " ".join(words), "en", f"s{k % 12}", len(source[1])])
    docs.append([2000, "", "en", "s1", 0])
    docs.append([2001, None, None, None, None])
    return docs, labels


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels = corpus()
    frame = spark.createDataFrame([tuple(d) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))

    model = quality.fit(frame, marks)
    kept = [d for d in docs if model.score(np.array([features((d[1] or "").encode())[1]]))[0] >= quality.CUT]
    assert len(kept) >= 350 and not any("%%%" in (d[1] or "") for d in kept)

    by_id = {i: (cut, text) for i, _, cut, text in brute_lines([(d[0], d[1], d[3]) for d in kept], 10, spare_whole=True)}
    lines = [[d[0], by_id[repr(d[0])][1] if by_id[repr(d[0])][0] else d[1], d[3]] for d in kept]
    assert sum(a[1] != b[1] for a, b in zip(lines, kept, strict=True)) > 50

    groups = brute([(d[0], d[1]) for d in lines])
    unique = [d for d in lines if (repr(d[0]), repr(d[0])) in {(i, c) for i, _, c in groups}]
    assert len(unique) < len(lines) - 30

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own = defaultdict(list)
    for d in unique:
        own[d[2]].append((hashlib.md5(f"{mixing.SEED}:{d[0]}".encode()).hexdigest(), size(d[1]), d))
    totals = {s: sum(x[1] for x in rows) for s, rows in own.items()}
    rows = []
    for s, target in brute_targets(totals).items():
        full = int(target // totals[s]) if totals[s] else 0
        left, before = target - full * totals[s], 0
        for _, n, d in sorted(own[s], key=lambda x: x[0]):
            times = (full + (2 * before + n <= 2 * left + 1e-6)) if n else 0
            before += n
            rows += [d] * times

    encoding = bpe_codec.load_encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = sorted((d[0], np.array(encoding.encode_ordinary(d[1]), "<u4").tobytes(), hashlib.sha256(d[1].encode()).hexdigest()) for d in rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in got) == want


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
