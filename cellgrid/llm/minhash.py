"""MinHash near-duplicates with odd sketches.

1. One pass over the texts gives each document the digest of its shingle set, MinHash bands and
   an odd sketch: the samples (function number, least value) are folded into a parity bitmap, so
   the XOR of two bitmaps has the parity bits of the samples in which they differ, and its
   population count estimates high similarities far more precisely than agreeing bands do.
2. Documents with one set are one node. Equal texts cost a row each and nothing more.
3. Nodes that share a band bucket are candidates. A bucket gives each node one candidate, the
   bucket's leader, not all pairs. Leaders follow one order in all buckets, so a node meets
   few different ones.
4. Candidates whose bitmaps are too far apart (six standard errors beyond the threshold) go;
   the rest are confirmed on full shingle sets.
5. Buckets whose nodes are then still in several components get the exact way for the rest:
   their nodes outside the largest component meet all others of other components in blocks. There
   the bitmaps are compared in numpy, each pair in the first bucket that it shares, and only the
   nodes that some other one is near to are sent on, with their full sets, to a second pass over
   the same blocks. It confirms pairs in place and returns the links that join something new, at
   most one less than a block has nodes. Blocks are repeated, pairs of nodes never become rows.

A pair at the threshold shares no bucket with a probability of (1 - 0.8^4)^32 = 5e-8.

Null and empty texts, and such without words, have an empty set: they link with nothing, and
their component is their own id. Rows are not told apart by id: repeated rows are one node and
get the same component, and a null id takes the component of its copies (null if it has none
with an id). Only the named columns are read. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm.common import arrow_map, scratch, staged, table, utf8_rows
from cellgrid.llm.components import connected_components
from cellgrid.llm.shingles import mixed, shingle_set

WIDTH = 4
PERCENT = 80
BANDS = 32
ROWS = 4
SAMPLES = 256
SKETCH_BITS = 1024
#: Candidates are dropped if their bitmaps suggest a similarity below this: about six standard errors under the threshold.
LEAST_ESTIMATE = 0.6
#: Nodes, and shingles of all its nodes, that a block of the comparison in blocks is meant to hold.
BLOCK = 512
BLOCK_SHINGLES = 500_000

_RANDOM = np.random.default_rng(20240501)
_FACTORS = (_RANDOM.integers(0, 2**32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_SHIFTS = _RANDOM.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_NUMBERS = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)


def min_samples(shingles: np.ndarray, step: int = 1024) -> np.ndarray:
    """The least value of each hash function over a set of shingles."""
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), step):
        values = _FACTORS * low[None, start : start + step]
        values += _SHIFTS
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        np.minimum(least, values.min(axis=1), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    rows = samples[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    """The parity bitmap of the samples."""
    bits = mixed(_NUMBERS | samples.astype(np.uint64)) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def most_bits(similarity: float) -> int:
    """Bits in which the bitmaps of two sets of this similarity are expected to differ."""
    return round(SKETCH_BITS / 2 * (1 - np.exp(-2 * 2 * SAMPLES * (1 - similarity) / SKETCH_BITS)))


def fingerprints(documents: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, node (digest of the set; null if it is empty), bands and sketch of each row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, nodes, bands, sketches = [], [], [], []
        for text in utf8_rows(batch.column(1)):
            shingles = shingle_set(text, width)
            sizes.append(len(shingles))
            if not len(shingles):
                nodes.append(None), bands.append(None), sketches.append(None)
                continue
            samples = min_samples(shingles)
            nodes.append(digest(shingles))
            bands.append(band_keys(samples))
            sketches.append(np.frombuffer(odd_sketch(samples), np.int64))
        return pa.record_batch(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "node", "bands", "sketch"],
        )

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, kernel, f"doc_id {kind}, n_shingles long, node binary, bands array<long>, sketch array<long>")


def shingle_sets(documents: DataFrame, width: int, text_col: str) -> DataFrame:
    """(node, shingles) of each row, the shingles sorted."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(text, width) for text in utf8_rows(batch.column(0))]
        nodes = [digest(x) if len(x) else None for x in sets]
        return pa.record_batch([pa.array(nodes, pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return arrow_map(documents.select(F.col(text_col).alias("text")), kernel, "node binary, shingles array<long>")


def differing_bits(a: str, b: str) -> Column:
    words = SKETCH_BITS // 64
    total = F.lit(0)
    for k in range(words):
        total = total + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return total


def _with_sketches(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), given by the places (pa, pb) of their nodes, whose bitmaps and sizes allow the threshold, with ``off``, the bits in which they differ."""
    side = lambda x: nodes.select(F.col("place").alias(f"p{x}"), F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    met = pairs.join(side("a"), "pa").join(side("b"), "pb").filter("a <> b").withColumn("off", differing_bits("sa", "sb"))
    near = (F.col("off") <= most_bits(least)) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
    return met.filter(near).select("a", "b", "na", "nb", "off")


def shared_buckets(bands: DataFrame) -> DataFrame:
    """(no, band, place, lead) of every bucket with two nodes or more; lead is the least of its places.

    Rows are 64-bit numbers only, as each node has one for each of its bands. A place is a hash of
    the node: should two nodes have one place, both stand for it from here on, which only adds candidates.
    """
    leaders = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("place").alias("lead")).filter("n > 1").select("band", "lead")
    return bands.join(leaders, "band")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b, na, nb) whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set{x}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a")
    met = met.withColumn("both", F.size(F.array_intersect("seta", "setb")))
    return met.filter(F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


BLOCK_ROW = "block long, side int, at int, node binary, n_shingles long, near array<int>"


def rest_blocks(shared: DataFrame, labels: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Of buckets that hold several components, the nodes whose bitmaps are near to one of another component.

    In each such bucket the nodes outside its largest component (side 0) are dealt into blocks, and
    each block meets every block of the bucket (side 1). A row of side 0 has the places of the near
    nodes of side 1 in the same pair of blocks. A pair is looked at in the first bucket it shares.
    """
    named = shared.join(nodes.select("place", "node", "n_shingles"), "place").drop("place", "lead")
    known = named.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = known.groupBy("band", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    several = per.groupBy("band").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "size", "comp")).alias("top")).filter("comps > 1")
    count = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    several = several.select(
        "band", F.col("top.comp").alias("top"), count(F.col("n"), F.col("size")).alias("blocks"),
        F.greatest(count(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")), F.lit(1)).alias("odd_blocks"),
    )
    members = known.join(several, "band").join(nodes.select("node", "sketch", "bands"), "node").withColumn("odd", F.col("comp") != F.col("top"))
    member = F.struct("node", "comp", "n_shingles", "sketch", "bands", "odd")
    spread = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(2**31))
    odd = members.filter("odd").withColumn("x", (spread % F.col("odd_blocks")).cast("int"))
    odd = odd.groupBy("no", "band", "x", "blocks").agg(F.collect_list(member).alias("left"))
    odd = odd.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = members.withColumn("y", (spread % F.col("blocks")).cast("int")).groupBy("band", "y").agg(F.collect_list(member).alias("right"))
    limit = most_bits(least)

    def near_of(no: int, left: list[dict], right: list[dict]) -> list[np.ndarray]:
        """For each node of the left block the places of its near ones on the right."""
        pack = lambda side, name: np.array([x[name] for x in side], np.int64)
        maps, bands = pack(right, "sketch").view(np.uint64), pack(right, "bands")
        sizes, comps = pack(right, "n_shingles"), np.array([x["comp"] for x in right], object)
        names, odds = np.array([x["node"] for x in right], object), np.array([x["odd"] for x in right])
        out = []
        for x in left:
            off = np.bitwise_count(maps ^ np.array(x["sketch"], np.int64).view(np.uint64)).sum(axis=1)
            close = (off <= limit) & (np.minimum(sizes, x["n_shingles"]) * 100 >= np.maximum(sizes, x["n_shingles"]) * PERCENT)
            own = np.flatnonzero(close)
            own = own[(comps[own] != x["comp"]) & (~odds[own] | (names[own] > x["node"]))]
            out.append(own[(bands[own] == np.array(x["bands"], np.int64)).argmax(axis=1) == no] if len(own) else own)
        return out

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for no, block, left, right in zip(*batch.columns, strict=True):
            left, right = left.as_py(), right.as_py()
            near = near_of(no.as_py(), left, right)
            used = np.unique(np.concatenate(near))
            rows += [(block.as_py(), 0, i, left[i]["node"], left[i]["n_shingles"], own.tolist()) for i, own in enumerate(near) if len(own)]
            rows += [(block.as_py(), 1, int(j), right[j]["node"], right[j]["n_shingles"], None) for j in used]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int32()))
        names = ("block", "side", "at", "node", "n_shingles", "near")
        return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    met = odd.join(every, ["band", "y"]).select("no", F.xxhash64("band", "x", "y").alias("block"), "left", "right")
    return arrow_map(met, kernel, BLOCK_ROW)


def rest_links(blocks: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) among the near nodes of each pair of blocks, confirmed on full sets; one that joins nothing new is left out."""
    row = F.struct("side", "at", "node", "n_shingles", "near", "shingles")
    met = blocks.join(sets, "node").groupBy("block").agg(F.collect_list(row).alias("rows")).select("rows")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[tuple[bytes, bytes]] = []
        for value in batch.column(0):
            rows = value.as_py()
            right = {r["at"]: r for r in rows if r["side"] == 1}
            whole = {r["node"]: np.array(r["shingles"], np.int64) for r in rows}
            root: dict[bytes, bytes] = {}

            def top(x: bytes) -> bytes:
                while (up := root.get(x, x)) != x:  # noqa: B023
                    x = up
                return x

            for a in (r for r in rows if r["side"] == 0):
                for b in (right[j] for j in a["near"]):
                    p, q = top(a["node"]), top(b["node"])
                    if p == q:
                        continue
                    both = len(np.intersect1d(whole[a["node"]], whole[b["node"]], assume_unique=True))
                    if both * 100 >= percent * (a["n_shingles"] + b["n_shingles"] - both):
                        root[p] = q
                        found.append((a["node"], b["node"]))
        return pa.record_batch([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return arrow_map(met, kernel, "a binary, b binary")


def near_duplicates(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_ESTIMATE) -> DataFrame:
    """doc_id, n_shingles, node (the set), comp (a node that stands for its group) and component_id of each row of ``documents``."""
    prints = staged(fingerprints(documents, width, id_col, text_col), "fingerprints")
    short = prints.select("doc_id", "n_shingles", "node")
    nodes = staged(
        prints.filter("node IS NOT NULL").groupBy("node").agg(
            F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
        ),
        "nodes",
    )
    nodes = nodes.withColumn("place", F.xxhash64("node"))
    with scratch(documents.sparkSession):  # only fingerprints, nodes and labels are read by the result
        shared = staged(shared_buckets(nodes.select("place", F.posexplode("bands").alias("no", "band"))), "buckets")
        stars = shared.filter("place <> lead").select(F.col("place").alias("pa"), F.col("lead").alias("pb")).distinct()
        candidates = staged(_with_sketches(stars, nodes, least), "candidates")
        sets = _sets_of(documents, prints, nodes, shared.select("place").distinct(), width, id_col, text_col)
        edges = staged(confirmed(candidates, sets, percent), "links")
        labels = staged(connected_components(edges), "labels", up=1)
        more = staged(rest_links(rest_blocks(shared, labels, nodes, least), sets, percent), "links")
        if not more.isEmpty():
            labels = staged(connected_components(edges.unionByName(more)), "labels", up=1)
    of = nodes.select("node", "least_id").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least_of = of.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    return _labelled(short, of.join(least_of, "comp").select("node", "comp", "component_id"))


def _sets_of(documents: DataFrame, prints: DataFrame, nodes: DataFrame, places: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Full sets of the nodes at the given places, from the texts of their documents with the least id."""
    wanted = staged(nodes.join(places, "place", "left_semi").select("node", "least_id"), "wanted")
    ids = wanted.select("least_id").distinct()
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = shingle_sets(texts.join(ids, F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi"), width, "text")
    rows = prints.select("doc_id").join(ids, F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi").count()
    if rows == wanted.count() and wanted.filter("least_id IS NULL").isEmpty() and ids.count() == rows:
        return staged(sets, "sets")  # every wanted id is one row, that of its node
    return staged(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _labelled(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with comp and component_id of their node; rows without a node are on their own."""
    full = rows.filter("node IS NOT NULL").join(ids, "node")
    alone = rows.filter("node IS NULL").withColumn("comp", F.lit(None).cast("binary")).withColumn("component_id", F.col("doc_id"))
    return full.select(*rows.columns, "comp", "component_id").unionByName(alone)


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id, with the columns of ``documents``.

    Documents with an empty set are in no group and all stay. Of rows that repeat the kept
    document's id in one group, one stays. A group that has no id at all keeps one row too.
    """
    id_col, text_col, width = (options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("width", WIDTH)))
    found = near_duplicates(documents, **options)
    dropped = staged(found.filter("node IS NOT NULL AND NOT doc_id <=> component_id").select("doc_id", "node"), "dropped")
    repeats = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    repeats = staged(repeats, "repeated-ids")
    same_id = F.col(id_col).eqNullSafe(F.col("_id"))
    if repeats.isEmpty():
        once = dropped.select(F.col("doc_id").alias("_id")).distinct()
        return documents.join(once, same_id, "left_anti")
    # Ids are no keys here: sets are taken again for the rows whose id repeats or is dropped.
    unclear = dropped.select("doc_id").unionByName(repeats).distinct().select(F.col("doc_id").alias("_id"))
    rows = documents.join(unclear, same_id, "left_semi").withColumn("_row", F.struct(*documents.columns))
    kind = documents.select(F.struct(*documents.columns).alias("_row")).schema["_row"].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(text, width) for text in utf8_rows(batch.column(0))]
        return pa.record_batch([pa.array([digest(x) if len(x) else None for x in sets], pa.binary()), batch.column(1)], names=["node", "_row"])

    keyed = arrow_map(rows.select(F.col(text_col).alias("text"), "_row"), kernel, f"node binary, _row {kind}")
    empty = keyed.filter("node IS NULL").select("_row")
    stay = keyed.filter("node IS NOT NULL").join(dropped.distinct(), (F.col("_row")[id_col].eqNullSafe(F.col("doc_id"))) & (keyed["node"] == dropped["node"]), "left_anti")
    comps = found.filter("node IS NOT NULL").select(F.col("node").alias("_node"), "comp").distinct()
    stay = stay.join(comps, F.col("node") == F.col("_node")).groupBy("comp").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    kept = empty.unionByName(stay.select("_row")).select(*[F.col("_row")[c].alias(c) for c in documents.columns])
    return documents.join(unclear, same_id, "left_anti").unionByName(kept)


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
