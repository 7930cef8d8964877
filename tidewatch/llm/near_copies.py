"""Near copies by the Jaccard similarity of their sets of word shingles, each link checked exactly.

Candidates are, first, those of ``simhash``: fingerprints of the same shingles, repeats included, that its grid and its Hamming check
link at GRID bits or fewer. Copies at 0.8 differ in about ten bits, too many for a grid, so candidates meet in cells of
min-hashes as well: BANDS cells a document, each of ROWS minima over pseudorandom orders. Two sets of similarity 0.8 share no
cell with probability (1 - 0.8 ** 4) ** 24 = 3e-6, sets of 0.9 with 1e-11.

Documents with the same set enter once. A first round checks the pairs of the grid, and each member of a cell against the least
of it; a second one checks all pairs in a cell that are not linked yet, in a join for small cells and by pairs of bounded chunks for large
ones, each of which returns a spanning forest. So the components are those of all links between members of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import simhash
from .common import fresh, stored, text_of
from .components import components

#: Bits that the grid covers.
GRID = 3
BANDS, ROWS = 24, 4
#: Members of a cell up to which all pairs meet in a join; beyond, chunks of about VOLUME shingles do.
FEW, VOLUME = 24, 250_000
#: Shingles whose minima are taken at once.
SLICE = 2048


def shingles(hashes):
    """Sorted distinct hashes of ``simhash.shingle_hashes``."""
    import numpy as np

    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def _orders():
    import numpy as np

    rng = np.random.default_rng(4)
    draw = lambda n: rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)
    return draw(BANDS * ROWS)[:, None] | np.uint64(1), draw(BANDS * ROWS)[:, None], draw(ROWS) | np.uint64(1), draw(BANDS)


def cells_of(hashes, orders):
    """The BANDS cell numbers of a set that isn't empty."""
    import numpy as np

    times, plus, weights, salts = orders
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), SLICE):
        x = hashes[None, lo : lo + SLICE] * times
        x += plus
        np.minimum(least, x.min(axis=1), out=least)
    least ^= least >> np.uint64(31)
    mixed = (least.reshape(BANDS, ROWS) * weights).sum(axis=1, dtype=np.uint64) ^ salts
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _sketched(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, _uid, _text) to (doc_id, _uid, sig, size, fp, cells): ``sig`` is a hash of the set, which names it, ``fp`` the SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        orders = _orders()
        for batch in batches:
            sigs, sizes, prints, cells = [], [], [], []
            for text in batch.column("_text"):
                hashes = simhash.shingle_hashes(text.as_py(), width)
                prints.append(simhash.fingerprint_of(hashes))
                found = shingles(hashes)
                sigs.append(int.from_bytes(xxhash.xxh64_digest(found.tobytes(), 42), "big", signed=True))
                sizes.append(len(found))
                cells.append(cells_of(found, orders) if len(found) else [])
            columns = [batch.column("doc_id"), batch.column("_uid"), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(cells, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_uid", "sig", "size", "fp", "cells"])

    more = [StructField("sig", LongType()), StructField("size", LongType()), StructField("fp", LongType()), StructField("cells", ArrayType(LongType()))]
    return rows.mapInArrow(run, StructType([*rows.select("doc_id", "_uid").schema.fields, *more]))


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(sig, _text) to (sig, words): the set as an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            found = [shingles(simhash.shingle_hashes(t.as_py(), width)).view(np.int64) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.array(found, pa.list_(pa.int64()))], names=["sig", "words"])

    return rows.mapInArrow(run, "sig bigint, words array<bigint>")


def _may(a: Column, b: Column, least: float) -> Column:
    """Sets of these sizes can be as similar as ``least``."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as ``least``."""
    one, two = sets.select(F.col("sig").alias("a"), F.col("words").alias("x")), sets.select(F.col("sig").alias("b"), F.col("words").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(two, "b").join(one, "a").where(both >= least * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def _forest(sigs, roots, words: list, least: float) -> list[tuple[int, int]]:
    """Links that, with those within each root, connect what all links among the sets would."""
    import numpy as np

    sizes = np.array([len(w) for w in words])
    flat = np.unique(np.concatenate(words), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    parts = [flat[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    mark = np.zeros(len(flat), bool)
    unseen, links = np.ones(len(sigs), bool), []
    for start in range(len(sigs)):
        if not unseen[start]:
            continue
        unseen[start], stack = False, [start]
        while stack:
            i = stack.pop()
            free = np.flatnonzero(unseen & (roots == roots[i]))
            unseen[free] = False
            stack += free.tolist()
            others = np.flatnonzero(unseen & (np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i]) - 1e-9))
            if not len(others):
                continue
            mark[parts[i]] = True
            both = np.array([np.count_nonzero(mark[parts[j]]) for j in others])
            mark[parts[i]] = False
            near = others[both >= least * (sizes[others] + sizes[i] - both) - 1e-9]
            unseen[near] = False
            stack += near.tolist()
            links += [(int(sigs[i]), int(sigs[j])) for j in near]
    return links


def grid_pairs(members: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of sets (sig, size, fp) that SimHash links: those of one fingerprint with its least set, and the least sets of fingerprints at GRID bits or fewer."""
    members = members.where("size > 0")
    prints = stored(members.groupBy("fp").agg(F.min(F.struct("sig", "size")).alias("first"), F.count("*").alias("n")), "prints")
    same = members.join(prints.where("n > 1"), "fp").select(F.col("first").alias("p"), F.struct("sig", "size").alias("q"))
    found = simhash.links(prints.select("fp"), GRID)
    one, two = (prints.select(F.col("fp").alias(k), F.col("first").alias(name)) for k, name in (("a", "p"), ("b", "q")))
    both = same.unionByName(found.join(one, "a").join(two, "b").select("p", "q"))
    return both.where((F.col("p.sig") != F.col("q.sig")) & _may(F.col("p.size"), F.col("q.size"), least)).select(F.greatest("p.sig", "q.sig").alias("a"), F.least("p.sig", "q.sig").alias("b"))


def roots_of(members: DataFrame, sets_of, least: float) -> DataFrame:
    """(node, root) as of ``components`` for the links between sets (sig, size, fp, cells) that the grid links or that share a cell; ``sets_of`` looks sets up."""
    grid = stored(grid_pairs(members, least).distinct(), "grid")
    cells = members.select("sig", "size", F.explode("cells").alias("cell"))
    crowd = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min(F.struct("sig", "size")).alias("first"), F.sum("size").alias("volume")).where("n > 1")
    cells = stored(cells.join(crowd, "cell"), "cells")
    wanted = cells.select("sig").union(grid.select("a")).union(grid.select("b")).distinct()
    sets = stored(sets_of(wanted), "sets")
    pairs = cells.where((F.col("sig") != F.col("first.sig")) & _may(F.col("size"), F.col("first.size"), least)).select(F.col("sig").alias("a"), F.col("first.sig").alias("b"))
    pairs = pairs.unionByName(grid).distinct()
    linked = stored(_checked(pairs, sets, least), "links")
    roots = components(linked)

    # Cells with more than one root: pairs across roots, but for those with the first member, which have been checked.
    placed = cells.join(roots, cells["sig"] == roots["node"], "left").withColumn("root", F.coalesce("root", "sig")).drop("node")
    mixed = placed.groupBy("cell").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s")
    rest = stored(placed.where(F.col("sig") != F.col("first.sig")).join(mixed.select("cell"), "cell"), "rest")
    few = rest.where(F.col("n") <= FEW)
    one = few.select("cell", F.col("sig").alias("a"), F.col("size").alias("m"), F.col("root").alias("r"))
    two = few.select(F.col("cell").alias("c"), F.col("sig").alias("b"), F.col("size").alias("k"), F.col("root").alias("s"))
    across = one.join(two, (one["cell"] == two["c"]) & (F.col("a") < F.col("b")) & (F.col("r") != F.col("s")) & _may(F.col("m"), F.col("k"), least)).select("a", "b").distinct()

    chunks = F.ceil(F.col("volume") / VOLUME).cast("int")
    own = F.pmod(F.xxhash64("sig", F.lit(1)), chunks).cast("int")
    dense = (
        rest.where(F.col("n") > FEW)
        .select("cell", "sig", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .select("cell", "sig", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .join(sets, "sig")
    )

    def forest(table: pa.Table) -> pa.Table:
        import numpy as np

        words = [np.asarray(w.values) for chunk in table.column("words").chunks for w in chunk]
        found = _forest(table.column("sig").to_numpy(), table.column("root").to_numpy(), words, least)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    more = stored(_checked(across, sets, least).unionByName(dense.groupBy("cell", "i", "j").applyInArrow(forest, "a bigint, b bigint")), "links")
    return roots if more.isEmpty() else components(linked.unionByName(more))


def dedup(docs: DataFrame, column: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row per group of near copies (``width``-word Jaccard of ``least`` or more, and what such links chain), all columns kept: the row of the least doc_id (of repeated rows, one).

    A null text is empty; empty texts are copies of each other. A null doc_id takes part and survives only where no row of its group has an id. A very long text is
    shingled whole, an empty table stays empty, and further columns pass through, whatever their names.
    """
    row = fresh(docs, "_row")
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "dedup")
    slim = keyed.select("doc_id", keyed[row].alias("_uid"), text_of(keyed, column).alias("_text"))
    rows = stored(_sketched(slim, width), "sketches")
    names = stored(rows.groupBy("sig").agg(F.min("_uid").alias("_uid")), "names")
    members = rows.join(names.select("_uid"), "_uid", "left_semi").select("sig", "size", "fp", "cells")

    def sets_of(sigs: DataFrame) -> DataFrame:
        wanted = names.join(sigs, "sig", "left_semi")
        return _sets(slim.select("_uid", "_text").join(wanted, "_uid").select("sig", "_text"), width)

    roots = roots_of(members, sets_of, least)
    found = rows.select("doc_id", "_uid", "sig").join(roots, rows["sig"] == roots["node"], "left").withColumn("g", F.coalesce("root", "sig"))
    first = found.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_uid"))["_uid"].alias(row))
    return keyed.join(first.select(row), row, "left_semi").select(docs.columns)
