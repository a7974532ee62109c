"""A Merkle manifest of a dataset: a hash tree over the rows of each source, one over the sources' roots,
and a proof for every row.

Rows are sorted in ranges of (source, doc_id). A range holds a run of one source's rows, then whole sources,
then a run of the last one; so one number per range, the rows of its first source in the ranges before, gives
all of its rows their index. With it a task builds the complete subtrees that lie in its run. Only the ragged
nodes at both ends, fewer than 2 * FAN a level, are shuffled by coordinate (source, level, index) and finish
the upper levels. Proofs go down again: nodes at the level of blocks (FAN ** HEIGHT rows) get the siblings
above them, and each block's rows are given theirs inside the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import Scratch
from kinweave.operators.ordered import number_within
from kinweave.sources.scratch import saved

#: Nodes hashed into one.
FAN = 16
#: Levels built inside a task; a block has FAN ** HEIGHT leaves.
HEIGHT = 3
_SORTED = "g string, digest string, tampered string, doc_id long, p int, at long"
_NODES = "g string, level int, index long, digest string"
_PATH = "array<struct<left:string,right:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- leaves ------------------------------------------------------------------------------------


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column | None = None) -> Column:
    """The SHA-256 of doc_id, source, lang, n_chars and text, each with its length in bytes, `-` if null."""
    fields = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*fields, _field(F.col("text") if text is None else text)).cast("binary"), 256)


def tampered_text() -> Column:
    """The text with A-Z in lower case where 5 divides crc32(doc_id), else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, F.translate("text", _UPPER, _LOWER))


# ---- building ----------------------------------------------------------------------------------


def _place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their range's number and their place in their source's run."""
    p, group, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for g in batch.column("g").to_pylist():
            at, group = (at + 1, g) if g == group else (0, g)
            places.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())], names=["g", "digest", "tampered", "doc_id", "p", "at"])


def _bases(rows: DataFrame) -> dict[int, tuple[str, int]]:
    """Range -> its first source and that source's rows in earlier ranges, where there are any. One row per
    range reaches the driver."""
    counts = rows.groupBy("p", "g").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy("p").agg(F.min(F.struct("g", "n")).alias("first"), F.max(F.struct("g", "n")).alias("last")).orderBy("p")
    out, open_group, carried = {}, None, 0
    for r in ends.toLocalIterator():
        if r.first.g == open_group:
            out[r.p] = (open_group, carried)
        carried = carried + r.last.n if r.first.g == r.last.g == open_group else r.last.n
        open_group = r.last.g
    return out


def _levels(digests: list[str], fan: int) -> list[list[str]]:
    """All levels of the tree over consecutive nodes, the last one with one node."""
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_hash("".join(below[k : k + fan])) for k in range(0, len(below), fan)])
    return levels


def _subtrees(fan: int, height: int, bases: dict[int, tuple[str, int]]):
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes at `height` of complete subtrees, and ragged nodes below; a run is held block by block."""
        found: list[tuple[str, int, int, str]] = []

        def climb(g: str, low: int, nodes: list[str]) -> None:
            for level in range(height):
                high, left, right = low + len(nodes), -low % fan, (low + len(nodes)) % fan
                if high // fan * fan < low + left:  # no boundary between two whole runs
                    left, right = len(nodes), 0
                found.extend((g, level, low + k, nodes[k]) for k in [*range(left), *range(len(nodes) - right, len(nodes))])
                nodes, low = [_hash("".join(nodes[k : k + fan])) for k in range(left, len(nodes) - right, fan)], (low + left) // fan
                if not nodes:
                    return
            found.extend((g, height, low + k, x) for k, x in enumerate(nodes))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["g", "level", "index", "digest"])
            found.clear()
            return out

        run: list[str] = []
        key, start = None, 0  # (g, the index after the run)
        for batch in batches:
            columns = zip(*[batch.column(c).to_pylist() for c in ("p", "g", "at", "digest")], strict=True)
            for p, g, at, digest in columns:
                base = bases.get(p)
                index = at + (base[1] if base and base[0] == g else 0)
                if key != (g, index) or index % fan**height == 0:
                    if run:
                        climb(key[0], start, run)
                    run, start = [], index
                run.append(digest)
                key = (g, index + 1)
            yield flush()
        if run:
            climb(key[0], start, run)
            yield flush()

    return build


def _up(nodes: DataFrame, fan: int) -> DataFrame:
    """One level up: (g, index, digest, children) from (g, index, digest). A group has `fan` rows at most."""
    children = F.transform(F.array_sort(F.collect_list(F.struct("index", "digest"))), lambda x: x["digest"])
    got = nodes.withColumn("parent", F.floor(F.col("index") / fan)).groupBy("g", F.col("parent").alias("index")).agg(children.alias("children"))
    return got.withColumn("digest", F.sha2(F.array_join("children", "").cast("binary"), 256))


class Forest:
    """A tree over the rows of each g: `rows` (g, digest, tampered, doc_id, index), `roots` (g, n, digest)
    and `paths` (g, block, path): the siblings above each block of trees of several blocks, from below."""

    def __init__(self, scratch: Scratch, leaves: DataFrame, fan: int, height: int):
        spark = leaves.sparkSession
        keys = [F.col("g"), F.asc_nulls_first("doc_id"), F.col("digest")]
        placed = scratch.save(leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_place, _SORTED))
        bases = _bases(placed)
        counts = saved(placed.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
        most = counts.agg(F.max("n")).first()[0] or 0
        nodes = scratch.save(placed.select("p", "g", "at", "digest").mapInArrow(_subtrees(fan, height, bases), _NODES))
        local = lambda level: nodes.filter(F.col("level") == level).select("g", "index", "digest")
        # up to the blocks only ragged nodes climb, from there on all; a tree ends where its width is 1
        roots: list[DataFrame] = []
        above: list[DataFrame] = []
        level, at_level = 0, local(0)
        while True:
            known = at_level.join(counts, "g").withColumn("width", F.ceil(F.col("n") / fan**level))
            roots.append(known.filter("width = 1").select("g", "n", "digest"))
            if fan**level >= most:
                break
            up = saved(_up(known.filter("width > 1"), fan))
            at_level, level = up.select("g", "index", "digest"), level + 1
            if level <= height:
                at_level = at_level.unionByName(local(level))
            else:
                above.append(up)
        self.roots = saved(reduce(DataFrame.unionByName, roots))
        self.paths = self._down(above, fan)
        starts = spark.createDataFrame([(p, g, n) for p, (g, n) in bases.items()], "p int, g string, base long")  # a row per range at most
        self.rows = placed.join(F.broadcast(starts), ["p", "g"], "left").select("g", "digest", "tampered", "doc_id", (F.col("at") + F.coalesce("base", F.lit(0))).alias("index"))

    @staticmethod
    def _down(above: list[DataFrame], fan: int) -> DataFrame | None:
        """From the top: a node's siblings, then its parent's path. Trees end at different levels, so a parent
        without a path is a root."""
        path, none = None, F.array().cast(_PATH)
        for up in reversed(above):
            parents = up.select("g", F.col("index").alias("parent"), "children").withColumn("path", none)
            if path is not None:
                parents = parents.drop("path").join(path.withColumnRenamed("index", "parent"), ["g", "parent"], "left").withColumn("path", F.coalesce("path", none))
            each = parents.select("g", "parent", "children", "path", F.posexplode("children").alias("k", "_"))
            step = F.struct(F.array_join(F.slice("children", F.lit(1), F.col("k")), "").alias("left"), F.array_join(F.slice("children", F.col("k") + 2, F.size("children")), "").alias("right"))
            path = each.select("g", (F.col("parent") * fan + F.col("k")).alias("index"), F.concat(F.array(step), "path").alias("path"))
        return path.withColumnRenamed("index", "block") if path is not None else None

    def proofs(self, fan: int, height: int, beyond: DataFrame | None = None) -> DataFrame:
        """rows with `root` (their tree's) and `proof`: their siblings in the block, above it, and `beyond` (g,
        path): above the tree. Blocks have FAN ** HEIGHT rows at most, so no group is large."""
        single = self.roots.filter(F.col("n") <= fan**height).select("g", F.lit(0).cast("long").alias("block"), F.array().cast(_PATH).alias("path"), F.lit(False).alias("deep"))
        paths = single if self.paths is None else single.unionByName(self.paths.withColumn("deep", F.lit(True)))
        paths = paths.join(self.roots.select("g", F.col("digest").alias("root")), "g")
        if beyond is not None:
            paths = paths.join(beyond.withColumnRenamed("path", "beyond"), "g").withColumn("path", F.concat("path", "beyond")).drop("beyond")
        paths = saved(paths)
        rows = self.rows.withColumn("block", F.floor(F.col("index") / fan**height))
        return rows.groupBy("g", "block").cogroup(paths.groupBy("g", "block")).applyInArrow(_prove(fan, height), f"g string, doc_id long, digest string, tampered string, root string, proof {_PATH}")


def _prove(fan: int, height: int):
    def siblings(nodes: list[str]) -> tuple[list[str], list[str]]:
        run = lambda k: k // fan * fan
        return ["".join(nodes[run(k) : k]) for k in range(len(nodes))], ["".join(nodes[k + 1 : run(k) + fan]) for k in range(len(nodes))]

    def prove(rows: pa.Table, paths: pa.Table) -> pa.Table:
        rows = rows.sort_by("index")
        digests, upper = rows.column("digest").to_pylist(), paths.column("path")[0].as_py()
        levels, nodes = [], digests
        while len(levels) < height if paths.column("deep")[0].as_py() else len(nodes) > 1:
            levels.append(siblings(nodes))
            nodes = [_hash("".join(nodes[k : k + fan])) for k in range(0, len(nodes), fan)]
        steps = ([], [])
        for side, name in enumerate(("left", "right")):
            rest = [x[name] for x in upper]
            for k in range(len(digests)):
                steps[side].extend([level[side][k // fan**n] for n, level in enumerate(levels)])
                steps[side].extend(rest)
        each = len(levels) + len(upper)
        struct = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in steps], names=["left", "right"])
        proof = pa.ListArray.from_arrays(pa.array(range(0, each * len(digests) + 1, each) if each else [0] * (len(digests) + 1), pa.int32()), struct)
        root = pa.array([paths.column("root")[0].as_py()] * len(digests), pa.string())
        return pa.table([*[rows.column(c) for c in ("g", "doc_id", "digest", "tampered")], root, proof], names=["g", "doc_id", "digest", "tampered", "root", "proof"])

    return prove


# ---- the manifest ------------------------------------------------------------------------------


def manifest(docs: DataFrame, tampered: Column | None = None, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """One row per document: doc_id, source, leaf, subroot, root, proof, and tampered: the leaf with `tampered`
    as its text where that is not null, else null.

    A leaf is the SHA-256 of the row's fields. Per source, leaves go by doc_id; every `fan` consecutive nodes
    of a level become the hash of their digests, until one is left, the subroot (a lone leaf is one). The
    subroots, by source in UTF-8 order with null first, become the root likewise. `proof` has a step for each
    level from the leaf to the root: the digests left and right of the node in its run, each side joined.

    Null fields, doc_ids and sources have their place (`-` in a leaf, first in order, a source of its own);
    rows that share source and doc_id go by leaf, so the root doesn't depend on the order of the input; rows
    equal in all fields are leaves of their own. An empty text is no null. Texts of any length are hashed in
    one expression. An empty table has no rows. Other columns are ignored. A source of most rows is sorted
    and built in ranges, and proven in blocks of fan ** height rows.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    g = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    again = F.when(tampered.isNotNull(), leaf_digest(tampered)) if tampered is not None else F.lit(None).cast("string")
    leaves = scratch.save(docs.select(g.alias("g"), leaf_digest().alias("digest"), again.alias("tampered"), F.col("doc_id").cast("long").alias("doc_id")))
    forest = Forest(scratch, leaves, fan, height)
    # the tree over subroots: one group; its rows are named by their source
    top_leaves = saved(number_within(forest.roots, [], [F.col("g")], "at").select(F.lit("").alias("g"), "digest", F.col("g").alias("tampered"), F.col("at").alias("doc_id")))
    top = Forest(scratch, top_leaves, fan, height)
    beyond = saved(top.proofs(fan, height).select(F.col("tampered").alias("g"), F.col("proof").alias("path"), F.col("root").alias("top")))
    out = forest.proofs(fan, height, beyond.select("g", "path"))
    roots = beyond.select("top").limit(1).collect()
    return out.select("doc_id", F.when(F.col("g") != "-", F.expr("substring(g, 2)")).alias("source"), F.col("digest").alias("leaf"), F.col("root").alias("subroot"), F.lit(roots[0].top if roots else None).cast("string").alias("root"), "proof", "tampered")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def audited(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: whether a row with `tampered` as its
    text (its own text where that is null) still folds to the root. Cases as in `manifest`."""
    m = manifest(docs, tampered).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
