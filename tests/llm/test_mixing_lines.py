import hashlib
import re
from collections import defaultdict

from cellgrid.llm import linededup, mixing


def brute_targets(sizes, epochs=3):
    """The contract's words as a loop: share by weight, stop at the caps, share out the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, free = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if target[s] >= epochs * sizes[s]:
                left += target[s] - epochs * sizes[s]
                target[s] = float(epochs * sizes[s])
                free.discard(s)
    return target


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def rows():
    out = [(k, "w " * (k % 13), f"s{k % 7}", "clash") for k in range(300)]
    out += [(1000 + k, "v " * 40, "huge", "c") for k in range(200)] + [(2000, "tiny", "tiny", "c"), (2001, None, "void", "c"), (2002, "", None, "c"), (2003, "a b c\x0bd", None, "c")]
    return out + [(5, "same text here", "s5", "c")] * 4 + [(None, "no id", "s1", "c"), (None, None, "s1", "c")]


def test_mix_reaches_its_targets(spark):
    found = mixing.mix(frame(spark, rows())).collect()
    assert len(found) == len(rows())
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    want = brute_targets(dict(sizes))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(want[s], 1)
        assert abs(taken[s] - target[s]) <= 20.5, s
    again = mixing.mix(frame(spark, rows()).repartition(5)).collect()
    assert sorted(map(repr, ((r.doc_id, r.size, r.taken) for r in again))) == sorted(map(repr, ((r.doc_id, r.size, r.taken) for r in found)))


def test_mixed_rows_repeat_as_counted(spark):
    f = frame(spark, rows())
    counted, made = defaultdict(int), defaultdict(int)
    for r in mixing.mix(f).collect():
        counted[r.doc_id, r.source, r.size] += r.times
    out = mixing.mixed_rows(f)
    assert out.columns == f.columns
    for r in out.collect():
        made[r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))] += 1
    assert {k: v for k, v in counted.items() if v} == dict(made)
    empty = f.limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_keys_follow_the_id():
    assert hashlib.md5(b"mix-1:7").hexdigest() < "g"


def brute_lines(docs, least, spare_whole=False):
    spread = defaultdict(set)
    for _, text, source in docs:
        for line in (text or "").split("\n"):
            if line.strip(" \t\r\x0b\x0c") and source is not None:
                spread[line].add(source)
    out = []
    for i, text, _ in docs:
        lines = text.split("\n") if text else []
        kept = [x for x in lines if len(spread.get(x, ())) < least]
        if len(kept) < len(lines) and not (spare_whole and not any(x.strip(" \t\r\x0b\x0c") for x in kept)):
            out.append((repr(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
        else:
            out.append((repr(i), len(lines), 0, repr(text)))
    return sorted(out)


def test_lines_equal_brute_force_on_both_ways(spark):
    docs = []
    for k in range(120):
        body = f"Body of document {k} is long enough to stand alone.\n\n"
        head = "Common head\n" if k % 3 == 0 else ""
        tail = "\nNine sites only" if k < 90 and k % 10 < 9 else ""
        docs.append((k, head + body + ("Common head" if k % 6 == 0 else "") + tail + "\r\n \n", f"site{k % 10}" if k % 17 else None))
    docs += [(500 + k, "Shared by all copies\nand this line too", f"site{k % 12}") for k in range(24)]
    docs += [(None, None, "site1"), (None, "", "site2"), (7, docs[7][1], docs[7][2]), (900, "Common head", "site3"), (901, "z" * 200_000 + "\nCommon head", None)]
    f = spark.createDataFrame([(i, t, s, 1, 2, "x") for i, t, s in docs], "doc_id long, text string, source string, _cut int, _lines int, line string")
    assert linededup.count_names(f) == ("__lines", "__cut")
    for least, spare in ((9, False), (10, False), (10, True)):
        want = brute_lines(docs, least, spare)
        for bound in (1_000_000, -1):
            out = linededup.dedup_lines(f, least, send_up_to=bound, spare_whole=spare)
            assert out.columns == [*f.columns, "__lines", "__cut"]
            got = out.collect()
            assert sorted((repr(r.doc_id), r["__lines"], r["__cut"], r.text if r["__cut"] else repr(r.text)) for r in got) == want
            assert all((r._cut, r._lines, r.line) == (1, 2, "x") for r in got)
    assert linededup.dedup_lines(f.limit(0)).count() == 0
