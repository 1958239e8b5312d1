"""First-fit decreasing of token pieces into fixed-length sequences, with a tournament tree of bin capacities.

Documents are dealt to groups of about GROUP_DOCS by a hash, and each group is packed on its own, so no task holds more
than one group. A document longer than a sequence is cut at every sequence length; whole pieces fill a sequence each,
the rests are packed. Repeated documents are packed as often as they occur; a null text is its end id alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import prepare

GROUP_DOCS = 1024
#: Words a worker keeps per generation; packing leaves room for more than the default.
CACHE_WORDS = 600_000
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Tournament:
    """Bins by number at the leaves; each inner node has the largest free capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(bins, 1) - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """The lowest-numbered bin with room for size, which is then taken from it."""
        free, i = self.free, 1
        while i < self.leaves:
            i *= 2
            if free[i] < size:
                i += 1
        bin_ = i - self.leaves
        free[i] -= size
        while i > 1:
            i //= 2
            free[i] = max(free[2 * i], free[2 * i + 1])
        return bin_


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size, in the order given; ties keep that order."""
    tree, fill, out = Tournament(len(sizes), capacity), {}, [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = tree.first_fit(sizes[i])
        out[i] = (b, fill.get(b, 0))
        fill[b] = fill.get(b, 0) + sizes[i]
    return out


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int | None = 1, group_docs: int = GROUP_DOCS, seed: int = 17) -> DataFrame:
    """A row per piece (PIECES; ids are little-endian u32): pieces of a sequence_id joined by offset are the sequence.

    Sequences are to be padded to length, except where their own length is a power of two.
    """
    prepare(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    kind = bpe.id_type(tokenizer_path)
    step = length * kind.itemsize

    def group(table: pa.Table) -> pa.Table:
        order = sorted(zip(table.column("doc_id").to_pylist(), table.column("ids").to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        number, rows = table.column("grp")[0].as_py(), []
        for doc, ids in order:
            for at in range(0, len(ids), step):
                rows.append((doc, at // kind.itemsize, len(ids) // kind.itemsize, ids[at : at + step]))
        placed = first_fit_decreasing([len(x[3]) // kind.itemsize for x in rows], length)
        columns = [
            [x[0] for x in rows], [x[1] for x in rows], [len(x[3]) // kind.itemsize for x in rows], [x[2] for x in rows],
            [(number << 32) + b for b, _ in placed], [o for _, o in placed], [np.frombuffer(x[3], kind).astype("<u4").tobytes() for x in rows],
        ]
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.table([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)

    ids = bpe.encoded(docs, tokenizer_path, end_id, cache_words=CACHE_WORDS)
    dealt = ids.select(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "ids"), F.lit(groups)).alias("grp"), "doc_id", "ids")
    return dealt.groupBy("grp").applyInArrow(group, PIECES)
