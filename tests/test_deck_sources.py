import gzip

import pytest
from pyspark.sql import functions as F

from cellgrid.operators import annotate, deck
from cellgrid.plans.config import DEFAULTS, load_config, merged
from cellgrid.sources import formats
from cellgrid.streaming import totals


def test_expressions(spark):
    frame = spark.createDataFrame([(1, "a", 5.0), (2, "b", -1.0), (3, "c", 7.5)], "k long, s string, v double")
    keep = lambda e: [r.k for r in frame.filter(deck.expression(e, frame.columns)).collect()]
    assert keep("v > 0 and not s in ['c']") == [1] and keep("(ds.ca.v < 0) | (ds.ca.k == 3)") == [2, 3] and keep("1 <= k < 3") == [1, 2] and keep("k % 2 == 1 and -v < 0") == [1, 3]
    for bad in ("__import__('os')", "s.lower()", "unknown > 1", "[x for x in s]", "lambda: 1", "k ** 2 > 1"):
        with pytest.raises((ValueError, SyntaxError)):
            deck.expression(bad, frame.columns)


def write(folder, **cards):
    for name, body in cards.items():
        path = folder / f"{name}.yaml"
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text(body)


def test_deck_loads_and_orders(tmp_path):
    write(tmp_path, Root="A: {include: [[x], [y]]}\nB: {include: []}\n", A="C: {include: [t], onlyif: 'v > 1'}\nD: {include: []}\n")
    (tmp_path / "views").mkdir()
    (tmp_path / "views" / "V.yaml").write_text("sources: [A_C, B]\ninclude: []\n")
    d = deck.Deck(str(tmp_path))
    assert set(d.subsets()) == {"A", "B", "A_C", "A_D"} and d.leaves() == ["B", "A_C", "A_D"]
    order = deck.topological(d.tasks())
    assert order.index("A") < order.index("A_C") < order.index("V") and order[-1] == "Pool" or order.index("Pool") > order.index("A_D")


def test_bad_decks(tmp_path):
    for k, (body, view) in enumerate((("Pool: {}", None), ("'a b': {}", None), ("A: {onlyif: 'v > 1'}", None), ("A: {}", "include: []"), ("V: {}", "sources: [V]"))):
        folder = tmp_path / str(k)
        write(folder, Root=body)
        if view:
            (folder / "views").mkdir()
            (folder / "views" / "V.yaml").write_text(view)
        with pytest.raises(ValueError):
            deck.Deck(str(folder))


def test_cycles_are_named():
    with pytest.raises(ValueError, match="need each other"):
        deck.topological({"a": ["b"], "b": ["a"]})
    with pytest.raises(ValueError, match="no task"):
        deck.topological({"a": ["x"]})


def test_first_match_is_a_partition(spark):
    cells = spark.createDataFrame([(1, "x y", 1.0), (2, "y", 2.0), (3, "z", 3.0), (4, "", 4.0)], "cell long, tags string, v double")
    subsets = [deck.Subset("P", ["x"]), deck.Subset("Q", [["y", "cat"]], "v >= 2"), deck.Subset("R", [], "v < 4")]
    got = {r.cell: r.subset for r in deck.first_match(cells, subsets, categories={"cat": ["w"]}).collect()}
    assert got == {1: "P", 2: "Q", 3: "R", 4: None}


def test_pool_offsets(spark):
    part = lambda rows: spark.createDataFrame(rows, "cell long, clusters long")
    got = deck.pooled([("a", part([(1, 0), (2, 2)])), ("b", part([(3, 0)])), ("c", part([(4, 1)]))]).collect()
    assert {(r.cell, r.source, r.source_clusters, r.clusters) for r in got} == {(1, "a", 0, 0), (2, "a", 2, 2), (3, "b", 0, 3), (4, "c", 1, 5)}


def test_split_names_and_cards():
    assert [deck.split_name(i) for i in (0, 25, 26, 53)] == ["A", "Z", "AA", "BBB"]
    card = deck.yaml.safe_load(deck.emit_card([(0, 90), (1, 1_900_000)], 128))
    assert card == {"A": {"include": [], "onlyif": "split == 0", "execution": {"n_cpus": 1, "memory": 128}}, "B": {"include": [], "onlyif": "split == 1", "execution": {"n_cpus": 56, "memory": 750}}}


def test_config_layers(tmp_path):
    (tmp_path / "config.yaml").write_text("params: {k: 7}\n")
    found = load_config(str(tmp_path), deck.Subset("S", params={"n_genes": 50}, steps=["nn"]), home=str(tmp_path / "none"))
    assert found["params"]["k"] == 7 and found["params"]["n_genes"] == 50 and found["steps"] == ["nn"] and DEFAULTS["params"]["k"] == 25
    with pytest.raises(KeyError):
        merged(DEFAULTS, {"params": {"no_such": 1}})


def test_readers(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("SampleID\tAge\nS1\t4\nS2\t5\n")
    assert formats.sample_metadata(spark, str(tmp_path / "s.tsv"), "S2").first().age == "5"
    (tmp_path / "m.csv").write_text("SampleID:string;Age:int\nS1;4\n")
    assert formats.typed_metadata(spark, str(tmp_path / "m.csv")).columns == ["SampleID", "Age"]
    with gzip.open(tmp_path / "v.vcf.gz", "wt") as f:
        f.write("##meta\n#CHROM\tPOS\tID\tD1\nchr1\t100\t.\t1/1\nchr2\t7\t.\t0/1\n")
    assert [(r.CHROM, r.POS, r.D1) for r in formats.vcf(spark, str(tmp_path / "v.vcf.gz")).collect()] == [("chr1", 100, "1/1"), ("chr2", 7, "0/1")]
    (tmp_path / "a.mtx").write_text("%%MatrixMarket\n% c\n3 2 2\n1 1 5\n3 2 1.5\n")
    assert {tuple(r) for r in formats.matrix_market(spark, str(tmp_path / "a.mtx")).collect()} == {(0, 0, 5.0), (2, 1, 1.5)}
    (tmp_path / "g.gmt").write_text("set1\tdesc\t12\t345\nempty\tdesc\n")
    assert {tuple(r) for r in formats.gene_sets(spark, str(tmp_path / "g.gmt"), "G%05d").collect()} == {("set1", "G00012"), ("set1", "G00345")}
    names = spark.createDataFrame([("a_R1.fastq",), ("a_R2.fastq",), ("b.txt",)], "name string")
    assert [r.name for r in formats.matching_files(names, "*_R1*.fastq").collect()] == ["a_R1.fastq"]


def test_annotation_rules(spark):
    rules = annotate.parse_definitions(spark, [("T", "+A +B -C")])
    assert {(r.gene, r.sign) for r in rules.collect()} == {("A", 1), ("B", 1), ("C", -1)}
    with pytest.raises(ValueError):
        annotate.parse_definitions(spark, [("T", "A")])
    scores = spark.createDataFrame([("a", g, 10.0 - g) for g in range(4)] + [("b", g, 10.0 - g) for g in range(4)], "cluster string, gene long, e double")
    got = sorted((r.cluster, r.gene) for r in annotate.greedy_unique(scores, "cluster", "gene", "e", 2).collect())
    assert got == [("a", 0), ("a", 1), ("b", 2), ("b", 3)]


def test_marker_sets_narrow_down(spark):
    rows = [("a", 1, 0.99, 5.0), ("a", 2, 0.99, 1.0), ("b", 1, 0.99, 2.0), ("b", 3, 0.99, 9.0), ("c", 2, 0.99, 4.0), ("c", 3, 0.1, 1.0)]
    frame = spark.createDataFrame(rows, "cluster string, gene long, trinary double, enrichment double")
    got = {(r.cluster, r.ord): (r.gene, r.breadth) for r in annotate.marker_sets(frame, 0.05, 2).collect()}
    assert got[("a", 0)] == (1, 2) and got[("a", 1)] == (2, 1) and got[("b", 0)] == (3, 1)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"2024-01-0{1 + k % 3} 0{k % 9}:00:00", k % 4, "ab"[k % 2], float(k), "{}") for k in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = totals.run_to_table(totals.windowed_totals(totals.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"), ["start", "user_id"])
    batch = totals.windowed_totals(events)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_annotation_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "README.md").write_text("nothing")
    (tmp_path / "a.yaml").write_text("name: A\nabbreviation: AA\ndefinition: '+G1 -G2'\ncategories: x y\n")
    (tmp_path / "sub" / "b.md").write_text("---\nname: B\nabbreviation: BB\ndefinition: '+G9'\n---\ntext\n")
    (tmp_path / "bad.yaml").write_text("abbreviation: C\n")
    rules, categories = formats.annotation_folder(spark, str(tmp_path))
    assert {tuple(r) for r in rules.collect()} == {("AA", 1, "G1"), ("AA", -1, "G2"), ("BB", 1, "G9")}
    assert {tuple(r) for r in categories.collect()} == {("AA", "x"), ("AA", "y")}
    assert {r.tag for r in formats.annotation_folder(spark, str(tmp_path), {"G1", "G2"})[0].collect()} == {"AA"}


def test_publish_and_replicates(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (3, 5):
        formats.publish(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    formats.publish(spark.range(2), str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    (tmp_path / "r.csv").write_text("a,b\n\nc\n")
    rows = formats.replicate_sets(spark, str(tmp_path / "r.csv")).collect()
    assert sorted(r.sample for r in rows) == ["a", "b", "c"] and len({r.replicate for r in rows}) == 2


def test_build_runs_a_deck(spark, tmp_path):
    import numpy as np

    from cellgrid.model import CellMatrix
    from cellgrid.plans.workflow import Build, load_deck
    from cellgrid.sources.tables import write_matrix

    x = np.random.default_rng(0).poisson(0.8, size=(24, 12))
    cells = spark.createDataFrame([(i, "left" if i < 12 else "right") for i in range(24)], "cell long, cluster string")
    genes = spark.createDataFrame([(j, f"g{j}") for j in range(12)], "gene long, name string")
    entries = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "cell long, gene long, x double")
    write_matrix(CellMatrix(cells, genes, entries), str(tmp_path / "samples"))
    write(tmp_path / "deck", Root="L: {include: [left]}\n")
    build = Build(spark, load_deck(str(tmp_path / "deck")), str(tmp_path / "samples"), str(tmp_path / "out"), DEFAULTS)
    assert build.run(dry=True) == ["L", "Pool"]
    chosen = build.collect("L")
    assert sorted(r.cell for r in chosen.cells.collect()) == list(range(12)) and chosen.entries.agg(F.sum("x")).first()[0] == x[:12].sum()
    chosen.cells.withColumn("clusters", F.col("cell") % 2).write.parquet(str(tmp_path / "out" / "L" / "cells"))
    assert build.run() == ["Pool"] and build.plan() == []
    assert {r.source for r in spark.read.parquet(str(tmp_path / "out" / "Pool" / "cells")).collect()} == {"L"}
