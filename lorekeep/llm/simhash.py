"""SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints of word shingles link at ``within`` or fewer differing bits. The bits are put into partitions of
correlated bits; partition i gets a threshold t_i, with the sum of thresholds = within - partitions + 1, so any linked
pair differs in at most t_i bits of at least one partition i (t_i = -1: not probed). The thresholds come from dynamic
programming over the candidate pairs each threshold is estimated to give, from counts over all fingerprints.

Probing: a fingerprint has one key for each way to leave t_i bits of partition i out; two fingerprints that agree in a
key are candidates, and are verified on all 64 bits. A key that more than GROUP fingerprints share is split: the pair
still differs in at most ``within`` of the bits outside the key, so it agrees in at least one of within + 1 parts of
those bits, and (key, part) is the finer key. As all fingerprints are distinct, this ends. Nothing is capped or dropped.

Within a key's group only the edges of a spanning forest of its links are emitted, never all pairs.

A fingerprint of 64 bits says little about texts of likeness 0.8: their bits differ by ten on average. deduplicated()
therefore also takes as candidates the texts that agree in a band of shingle minima, from the same shingle hashes, and
checks all candidates by their shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_written, free_name, prepare, quoted, written
from .scaled_sketch import with_sketch

BITS = 64
GROUP = 2048
#: About this many texts, or 1024 times as many shingles, are a block of an exact check.
BLOCK = 512
#: Hot keys are sent to all tasks up to this many (16 bytes each), and joined by a shuffle beyond.
BROADCAST_KEYS = 100_000
#: Texts of likeness s agree in one of BANDS bands of ROWS minima with probability 1 - (1 - s^ROWS)^BANDS: 0.98 at 0.8.
BANDS, ROWS = 10, 5
_ODD = [((2 * i + 1) * 0x9E3779B97F4A7C15 ^ (i * 0xD6E8FEB86659FD93)) & (2**64 - 1) | 1 for i in range(1, BANDS * ROWS + 1)]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included, in order; none where there is no word."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z only; ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        return np.array([h(joined, seed)], np.uint64)
    starts = [0, *(ends[: -shingle] + 1).tolist()]
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """Unsigned. Bit is 1 if it is set in over half of the hashes; no hash: 0."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: bytes, shingle: int, seed: int) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def minima(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of the hashes under as many permutations, 32 bits each; none of no hashes."""
    odd, least = np.array(_ODD, np.uint64), None
    for at in range(0, len(hashes), 1024):
        some = (hashes[at : at + 1024, None] * odd[None]).min(0)
        least = some if least is None else np.minimum(least, some)
    return np.zeros(0, np.uint32) if least is None else (least >> np.uint64(32)).astype(np.uint32)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of minima."""
    if not len(least):
        return np.zeros(0, np.int64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.astype(np.uint64).reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, banded: bool = False) -> DataFrame:
    """(doc_id, th, fp): fp is the signed 64-bit fingerprint of the whole text, th Spark's hash of it; null and wordless
    texts have fp 0. banded: also least, the shingle minima as little-endian u32 binary."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, least = np.zeros(b.num_rows, np.uint64), []
            for i, t in enumerate(b.column(2).to_pylist()):
                hashes = shingle_hashes(t or b"", shingle, seed)
                fps[i] = majority(hashes)
                if banded:
                    least.append(minima(hashes).astype("<u4").tobytes())
            out = [b.column(0), b.column(1), pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(least, pa.binary())] if banded else out, names=["doc_id", "th", "fp", "least"][: 3 + banded])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, th long, fp long" + ", least binary" * banded)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Count of fingerprints and the 64 x 64 counts of bits set together, over all rows; 4097 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, total = n + len(x), total + x.T @ x
        cell = np.append(np.arange(BITS * BITS), -1)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.append(total.reshape(-1), n).astype(np.int64))], names=["cell", "n"])

    found = {r[0]: r[1] for r in fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect()}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def correlated_parts(n: int, together: np.ndarray, bits: list[int], parts: int) -> list[list[int]]:
    """Parts of nearly equal size; each starts at the most balanced bit left and takes the bits most correlated with it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = list(bits), []
    for k in range(parts):
        size, part = -(-len(left) // (parts - k)), []
        while len(part) < size:
            best = max(left, key=lambda b: (sum(corr[b, c] for c in part), spread[b], -b))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def mask_of(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def estimated_candidates(fps: DataFrame, n: int, together: np.ndarray, parts: list[list[int]], most: int) -> list[list[float]]:
    """[part][t + 1]: pairs that differ in at most t bits of the part, and the keys that finding them takes. t = 0 is counted over all rows; further bits
    multiply it by the odds, from all rows, that each of them differs."""
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(mask_of(b))) for b in parts])
    same = {r[0]: r[1] for r in fps.select(F.posexplode(keys)).groupBy("pos", "col").count().groupBy("pos").agg(F.sum(F.col("count") * F.col("count").cast("double"))).collect()}
    p = np.diag(together) / max(n, 1)
    odds = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)
    out = []
    for i, bits in enumerate(parts):
        ways = [1.0]
        for b in bits:  # elementary symmetric sums of the odds
            ways = [w + (ways[k - 1] * odds[b] if k else 0) for k, w in enumerate([*ways, 0.0])][: most + 1]
        pairs = same.get(i, 0.0) * np.cumsum([*ways, *[0.0] * (most + 1 - len(ways))])
        out.append([0.0, *(x + max(n, 1) * comb(len(bits), t) for t, x in enumerate(pairs))])
    return out


def thresholds(costs: list[list[float]], total: int) -> list[int]:
    """One threshold >= -1 per part, with the given total, at the least summed cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t in range(-1, len(c) - 1):
                if s + t not in step or cost + c[t + 1] < step[s + t][0]:
                    step[s + t] = (cost + c[t + 1], [*chosen, t])
        best = step
    return best[total][1]


def spanning_links(values: np.ndarray, within: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    x, left, out = values.view(np.uint64), np.ones(len(values), bool), []
    for i in range(len(x)):
        if not left[i]:
            continue
        left[i], front = False, [i]
        while front:
            j = front.pop()
            near = np.nonzero(left & (np.bitwise_count(x ^ x[j]) <= within))[0]
            left[near] = False
            out += [(int(values[j]), int(values[k])) for k in near]
            front += near.tolist()
    return out


def linked(fps: DataFrame, within: int = 2, parts: int = 3, group: int = GROUP) -> DataFrame:
    """(a, b): edges between distinct fingerprints (fps has one row each) whose components are those of all links."""
    n, together = bit_counts(fps)
    if n < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    split = correlated_parts(n, together, list(range(BITS)), parts)
    chosen = thresholds(estimated_candidates(fps, n, together, split, within), within - parts + 1)
    masks = [mask_of(set(bits) - set(gone)) for bits, t in zip(split, chosen, strict=True) if t >= 0 for gone in combinations(bits, t)]
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [e for x in b.column(0) for e in spanning_links(x.values.to_numpy(zero_copy_only=False).astype(np.int64), within)]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    out, level = None, 0
    while True:
        hot = written(keyed.groupBy("mask", "key").count().where(F.col("count") > group).select("mask", "key"), "hot-keys")
        k = hot.count()
        known = F.broadcast(hot) if k <= BROADCAST_KEYS else hot
        cold = keyed.join(known, ["mask", "key"], "left_anti") if k else keyed
        groups = cold.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
        edges = groups.mapInArrow(verify, "a long, b long")
        out = edges if out is None else out.union(edges)
        if not k:
            return out
        level += 1
        used = [r[0] for r in hot.select("mask").distinct().collect()]  # a few masks, known from the driver's own list
        finer = []
        for m in used:
            rest = [b for b in range(BITS) if not (m >> b) & 1]
            finer += [F.when(F.col("mask") == m, F.array(*[F.lit(mask_of([*(b for b in range(BITS) if (m >> b) & 1), *part])).cast("long") for part in correlated_parts(n, together, rest, within + 1)]))]
        hot_rows = keyed.join(known, ["mask", "key"], "left_semi").select("fp", F.explode(F.coalesce(*finer)).alias("mask"))
        keyed = written(hot_rows.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).distinct(), "finer-keys")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, within: int = 2, parts: int = 3, group: int = GROUP) -> DataFrame:
    """(doc_id, th, fp, component_id): component_id is the smallest doc_id reachable by links, the document itself included.

    Equal fingerprints always link, so components are sought among distinct fingerprints. Null, empty and wordless
    texts share fingerprint 0 and link as any other. Repeated rows give repeated rows; null doc_ids are never a
    component_id unless the whole component has none. An empty table gives no rows.
    """
    docs_fps = written(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = written(docs_fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = connected_components(linked(distinct.select("fp"), within, parts, group), "fingerprint-components")
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = written(joined.join(least, "root").select("fp", "component_id"), "fingerprint-classes")
    drop_written(distinct, roots)
    return docs_fps.join(classes, "fp").select("doc_id", "th", "fp", "component_id")


def band_links(texts: DataFrame, group: int = GROUP, likeness: float = 0.6) -> DataFrame:
    """(a, b): edges between texts (th, least) that agree in a band of minima.

    Of up to ``group`` texts that share a key, those are linked whose minima agree to at least ``likeness``, as a
    spanning forest; it is well below what is sought, so that an estimate from minima loses nothing, and well above
    chance, so that groups do not run together. More texts than that are all linked with the least one, which takes no
    gathering; the check that follows tells them apart.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [band_keys(np.frombuffer(x, "<u4")) for x in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            key = np.concatenate([*found, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(key)], names=["th", "key"])

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = [], []
            for rows in b.column(0):
                th, least = rows.values.field("th").to_numpy(), rows.values.field("least").to_pylist()
                x, left = np.stack([np.frombuffer(v, "<u4") for v in least]), np.arange(len(th))
                while len(left):
                    front, left = [left[0]], left[1:]
                    while front and len(left):
                        i = front.pop()
                        near = (x[left] == x[i]).mean(1) >= likeness
                        a += [int(th[i])] * int(near.sum())
                        z += th[left[near]].tolist()
                        front += left[near].tolist()
                        left = left[~near]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    keyed = written(texts.select("th", "least").mapInArrow(keys, "th long, key long"), "band-keys")
    shared = written(keyed.groupBy("key").agg(F.min("th").alias("first"), F.count("*").alias("n")).where("n > 1"), "shared-bands")
    known = F.broadcast(shared) if shared.count() <= BROADCAST_KEYS else shared
    met = written(keyed.join(known, "key"), "band-members")
    stars = met.where(F.col("n") > group).select(F.col("first").alias("a"), F.col("th").alias("b")).where("a <> b")
    few = met.where(F.col("n") <= group).select("th", "key").join(texts.select("th", "least"), "th")
    gathered = few.groupBy("key").agg(F.collect_list(F.struct("th", "least")).alias("rows")).select("rows")
    edges = written(gathered.mapInArrow(forest, "a long, b long").union(stars).distinct(), "band-links")
    drop_written(keyed, shared, met)
    return edges


def verified_links(sizes: np.ndarray, hashes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges (row numbers) of a spanning forest of the links whose shingle sets are alike, exactly: a pair goes untested
    only if it is joined already, or if one set is too small to be so much like the other. hashes has the distinct
    shingle hashes of all rows in order, sizes their counts."""
    ends, codes = np.cumsum(sizes), np.unique(hashes, return_inverse=True)[1]
    sets = np.split(codes, ends[:-1])
    marks, root, out = np.zeros(len(codes), bool), np.arange(len(sizes)), []
    for i in range(len(sizes)):
        rest = sizes[i + 1 :]
        near = i + 1 + np.nonzero((root[i + 1 :] != root[i]) & (np.minimum(rest, sizes[i]) >= similarity * np.maximum(rest, sizes[i])))[0]
        if not len(near):
            continue
        marks[sets[i]] = True
        both = np.array([np.count_nonzero(marks[sets[k]]) for k in near])
        marks[sets[i]] = False
        union = sizes[i] + sizes[near] - both
        for k in near[np.where(union == 0, 1.0, both / np.maximum(union, 1)) >= similarity]:
            if root[k] != root[i]:
                out.append((i, int(k)))
                root[root == root[k]] = root[i]
    return out


def alike(docs: DataFrame, firsts: DataFrame, shingle: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between texts (by th) whose components are those of all pairs of one root whose shingle sets are of
    at least that Jaccard likeness, exactly.

    firsts has th, root and the doc_id of one document of each text; root is the same for texts that candidate links
    join, so only pairs of one root can be linked. A root's texts are dealt to blocks of about ``block``, and each two
    blocks of a root meet in one group, so every pair is seen and no task has a large root whole.
    """
    prepare(docs.sparkSession)
    crowded = firsts.groupBy("root").count().where("count > 1").select("root")
    wanted = firsts.join(crowded, "root", "left_semi").select("root", F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    lowered = F.translate("text", UPPER, LOWER)  # the words of fingerprint_of()
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), lowered.alias("t")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).dropDuplicates(["th"])
    sets = written(with_sketch(texts.select("th", "root", "t"), "t", "s", shingle, 1.0).select("th", "root", "s"), "shingle-sets")
    blocks = written(sets.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.size("s")) / (block * 1024))).cast("int").alias("k")), "root-blocks")
    blocks = F.broadcast(blocks) if blocks.count() <= BROADCAST_KEYS else blocks
    own = F.pmod(F.xxhash64(F.lit("block"), "th"), F.greatest("k", F.lit(1))).cast("int")
    other = F.when(F.col("k") > 1, F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda j: j != F.col("own"))).otherwise(F.array("own"))
    met = sets.join(blocks, "root").withColumn("own", own).withColumn("other", F.explode(other))
    met = met.select("th", "s", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def verify(table: pa.Table) -> pa.Table:
        th, s = table.column("th").to_numpy(), table.column("s")
        found = verified_links(pc.list_value_length(s).to_numpy(), pc.list_flatten(s).to_numpy(), similarity)
        return pa.table([pa.array([int(th[e[i]]) for e in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    # Dealt anew: rows that a join has dealt by root would stay so, and all blocks of a root would meet in one task.
    return met.repartition("root", "i", "j").groupBy("root", "i", "j").applyInArrow(verify, "a long, b long")


def deduplicated(docs: DataFrame, shingle: int = 5, seed: int = 42, within: int = 6, parts: int = 4, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the least doc_id; all columns stay.

    Candidates are texts whose fingerprints differ in at most ``within`` bits and texts that agree in a band of shingle
    minima; near-duplicates are those of one set of candidates whose shingle sets (A-Z lower-cased) are at least
    ``similarity`` alike, and a group is joined by such pairs, whichever they are. Texts of equal fingerprints are
    checked as any others. Rows with the same doc_id and text are one document, and of texts with the same doc_id one
    stays. Documents without doc_id stay if no document with one is near them, each distinct text once. An empty table
    gives no rows.
    """
    docs_fps = written(fingerprints(docs, shingle, seed, banded=True), "fingerprints")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("m")
    distinct = written(docs_fps.groupBy("th", "fp").agg(one, F.first("least").alias("least")).select("th", "fp", "m.doc_id", "least"), "distinct-texts")
    of_fp = written(distinct.groupBy("fp").agg(F.min("th").alias("rep")), "distinct-fingerprints")
    near = written(linked(of_fp.select("fp"), within, parts), "fingerprint-links")
    end = lambda c, out: of_fp.select(F.col("fp").alias(c), F.col("rep").alias(out))
    edges = near.join(end("a", "_a"), "a").join(end("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    edges = edges.union(distinct.join(of_fp, "fp").where("th <> rep").select("rep", "th")).union(band_links(distinct))
    reach = connected_components(edges, "candidate-components")
    firsts = written(distinct.join(reach.withColumnRenamed("node", "th"), "th").select("th", "root", "doc_id"), "candidate-roots")
    roots = connected_components(alike(docs, firsts, shingle, similarity), "text-components")
    joined = distinct.join(roots.withColumnRenamed("node", "th"), "th", "left").withColumn("root", F.coalesce("root", "th"))
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = written(joined.select("th", "root").join(least, "root").select("th", "component_id"), "text-classes")
    found = docs_fps.join(classes, "th").where("doc_id <=> component_id")
    kept = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("th").alias("th"))
    kept = written(kept.unionByName(found.where("doc_id IS NULL").select("doc_id", "th").distinct()), "kept-texts")
    drop_written(docs_fps, distinct, of_fp, near, reach, firsts, roots, classes)
    th = free_name("_th", docs)
    rows = docs.withColumn(th, F.xxhash64("text")).alias("d")
    rows = rows.join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{th}") == F.col("k.th")), "left_semi")
    return rows.dropDuplicates(["doc_id", th]).select(*[quoted(c) for c in docs.columns])
