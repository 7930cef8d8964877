"""SimHash near-duplicates by a grid over segment bit counts.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of
two embeddings never exceeds the Hamming distance of the fingerprints. Coordinates are dealt to six
slabs; a Manhattan ball of radius 3 can reach out of at most 3 slabs, so two fingerprints within it
share the counts of 3 slabs at least, that is, one of the 20 grid cells over 3 slabs. Fingerprints
meet in those cells, pairs within Manhattan distance 3 pass, and the Hamming distance decides.

Copies share a fingerprint and enter once. Cells with many fingerprints are dealt to tasks by pairs
of bounded chunks, each of which returns a spanning forest of its links in place of all pairs, so
the components stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, text_of
from .components import components

EVEN_BITS = 0x5555555555555555
SLABS = 6
#: Fingerprints in a cell up to which all pairs are compared in a join; beyond, chunks of CHUNK fingerprints are.
FEW, CHUNK = 24, 1024


def shingle_hashes(text: str, width: int) -> bytes:
    """XXH64 (seed 42) of each word shingle in order, big-endian; words as in ``fingerprint``, fewer than ``width`` make one shingle, none none."""
    import xxhash

    words = text.encode().lower().split()
    width = min(width, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts, found = [0, *(e + 1 for e in ends[:-1])], bytearray()
    for lo in range(0, len(words) - width + 1 if words else 0, 1 << 15):
        found += b"".join([digest(joined[a:b], 42) for a, b in zip(starts[lo : lo + (1 << 15)], ends[lo + width - 1 :], strict=False)])
    return bytes(found)


def fingerprint_of(hashes: bytes) -> int:
    """The bits that are set in over half of the hashes, as a signed long."""
    import numpy as np

    each, total = np.frombuffer(hashes, np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for lo in range(0, len(each), 1 << 15):
        total += np.unpackbits(each[lo : lo + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(each)).tobytes(), "big", signed=True)


def _fingerprint(text: str, width: int) -> int:
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint(text: Column, width: int = 3) -> Column:
    """64-bit SimHash (as a signed long) of the XXH64 (seed 42) of word shingles, words being split at ASCII white space and A-Z lower-cased.

    Fewer words than ``width`` make one shingle, none the fingerprint zero.
    """

    @F.arrow_udf("bigint")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_fingerprint(t, width) for t in texts.to_pylist()], pa.int64())

    return found(text)


def embedding(fp: Column) -> Column:
    """The 32 counts as thermometer codes of two bits (00, 01, 11), whose Hamming distance is the counts' Manhattan distance."""
    low, high = fp.bitwiseAND(F.lit(EVEN_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN_BITS))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def masks() -> list[int]:
    """Bit masks of the choices of three slabs, each slab holding every sixth segment."""
    slabs = [sum(3 << (2 * k) for k in range(slab, 32, SLABS)) for slab in range(SLABS)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(three)) for three in combinations(slabs, SLABS // 2)]


def _forest(fps, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of fingerprints that differ in ``most`` bits or fewer."""
    import numpy as np

    x = np.unique(np.asarray(fps, np.int64)).view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= most
    unseen, links = np.ones(len(x), bool), []
    for root in range(len(x)):
        if unseen[root]:
            unseen[root], stack = False, [root]
            while stack:
                i = stack.pop()
                fresh = np.flatnonzero(near[i] & unseen)
                unseen[fresh] = False
                stack += fresh.tolist()
                links += [(i, j) for j in fresh]
    signed = x.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in links]


def links(prints: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that differ in at most ``most`` (up to 3) bits.

    All links within sparse cells, a spanning forest per pair of chunks within dense ones: the components are those of all links.
    """
    if not 0 <= most <= SLABS // 2:
        raise ValueError("the grid covers distances up to 3")
    u = embedding(F.col("fp"))
    keys = F.array(*(F.xxhash64(F.lit(i), u.bitwiseAND(F.lit(m))) for i, m in enumerate(masks())))
    cells = prints.select("fp", F.explode(keys).alias("cell"))
    crowd = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    cells = stored(cells.join(crowd, "cell"), "cells")
    few = cells.where(F.col("n") <= FEW)
    a, b = few.select("cell", F.col("fp").alias("a")), few.select("cell", F.col("fp").alias("b"))
    manhattan = F.bit_count(embedding(F.col("a")).bitwiseXOR(embedding(F.col("b"))))
    hamming = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    sparse = a.join(b, (a["cell"] == b["cell"]) & (F.col("a") < F.col("b")) & (manhattan <= most) & (hamming <= most)).select("a", "b")

    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), chunks).cast("int")
    dense = (
        cells.where(F.col("n") > FEW)
        .select("cell", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .select("cell", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def forest(pdf):
        import pandas as pd

        return pd.DataFrame(_forest(pdf["fp"], most), columns=["a", "b"]).astype("int64")

    return sparse.unionByName(dense.groupBy("cell", "i", "j").applyInPandas(forest, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, column: str = "text", width: int = 3, most: int = 3, carry: tuple = ()) -> DataFrame:
    """doc_id, ``fp``, ``component_id`` (least doc_id of the component) and the columns ``carry`` for each document.

    A null text is empty; empty texts share the fingerprint zero, which links like any other. Repeated rows stay repeated and
    link to each other. A null doc_id takes part but names no component unless it is alone. A very long text is hashed whole. An empty table gives no
    rows; columns not in ``carry`` are left out, whatever their names.
    """
    rows = stored(docs.select("doc_id", *carry, fingerprint(text_of(docs, column), width).alias("fp")), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(prints, most))
    linked = stored(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "linked")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    names = linked.join(ids, "root").select("fp", "component_id")
    return rows.join(names, "fp", "left")


def dedup(docs: DataFrame, column: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """``docs`` with one row per component, all columns kept: the row of the least doc_id (of repeated rows, one)."""
    row = fresh(docs, "_row")
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "dedup")
    found = near_duplicates(keyed.select("doc_id", column, keyed[row].alias("_uid")), column, width, most, carry=("_uid",))
    # The survivor by (doc_id, row) of each component; counts combine before the shuffle. A component without any doc_id keeps its first row.
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    first = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_uid"))["_uid"].alias(row))
    return keyed.join(first.select(row), row, "left_semi").select(docs.columns)
