"""Merkle manifest of a table: a tree of digests per source, and one over the sources, with a proof for every row.

1. Each row becomes a leaf digest (``leaf_digest``); texts go no further than this.
2. Leaves are range-sorted by source, doc_id and digest. Counts per partition and source, summed up along each source's
   partitions, give every partition the number of its first leaf; only a partition's first and last source can go
   on elsewhere, so that is three numbers a partition.
3. Each partition builds all aligned subtrees that it holds wholly, and hands on only the nodes whose parent it doesn't:
   a few per level at either end.
4. These ragged nodes are shuffled by coordinate (source, level, number) and joined to their parents level by level.
5. A proof is the path inside the partition, then the siblings of the ragged node's ancestors, found by coordinate, then
   the path in the tree of sources, which is built the same way.

A row's path inside its partition is made again from the stored leaves when it is asked for; nothing of it is kept.

Defined results
* null in any column: ``-`` in the digest; null source: a source of its own, the first;
* null doc_id: first in its source; rows of one doc_id are in the order of their leaf digests, equal rows in any;
* a lone leaf is its tree's root, and a lone source's root is the root: no siblings, the proof is the digest of nothing;
* empty and long texts: digested whole; empty table: empty result;
* extra columns and columns with clashing names are not part of a leaf.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import by_broadcast_if_small, cut, ship_package
from tidewatch.llm.periodic import CRC_SQL

#: Children of a node.
ARITY = 3
#: Leaves of a partition, about 150 bytes each.
LEAVES = 200_000
#: Up to so many upper paths (some 2 KB each) travel to the leaves by broadcast; more are joined by shuffle.
BROADCAST_PATHS = 10_000

STEP = "struct<left:string,right:string>"


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Lowercase hex sha256 of the fields, each with its length in bytes, so that no two rows run into each other."""
    told = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
            for c in (doc_id, source, lang, n_chars, text)]
    return F.sha2(F.concat(*told), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def _levels(digests: list[str], start: int, total: int) -> list[tuple[int, list[str]]]:
    """Per level the number of the first node held wholly, and those nodes; ``total`` leaves make the whole tree."""
    out, at = [(start, digests)], start
    while total > 1:
        first, upto = -(-at // ARITY), at + len(digests)
        last = -(-total // ARITY) if upto == total else upto // ARITY
        digests = [hashlib.sha256("".join(digests[max(0, ARITY * i - at):ARITY * (i + 1) - at]).encode()).hexdigest() for i in range(first, last)]
        at, total = first, -(-total // ARITY)
        if not digests:
            break
        out.append((at, digests))
    return out


def _runs(batches: Iterator[pa.RecordBatch], ends: dict[int, tuple]) -> Iterator[tuple[str, int, int, dict]]:
    """A partition's stretches of one group: group, number of its first leaf, leaves of the whole group, columns."""
    held: dict[str, list] = {}
    for batch in batches:
        for name in batch.schema.names:
            held.setdefault(name, []).extend(batch.column(name).to_pylist())
    if not held or not held["_g"]:
        return
    groups = held["_g"]
    start, first_total, last_total = ends[held["_pid"][0]]
    begin = 0
    while begin < len(groups):
        end = begin
        while end < len(groups) and groups[end] == groups[begin]:
            end += 1
        total = first_total if begin == 0 else last_total if end == len(groups) else end - begin
        yield groups[begin], start if begin == 0 else 0, total, {k: v[begin:end] for k, v in held.items()}
        begin = end


_NODE = "_g string, total long, level int, i long, h string"


#: Rows of a batch handed on by a task; small groups share one.
_ROWS = 4096


def _ragged(rows: DataFrame, ends: dict[int, tuple]) -> DataFrame:
    """The nodes held wholly by a partition whose parents are not, roots among them."""
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["_g", "total", "level", "i", "h"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group, start, total, held in _runs(batches, ends):
            levels, above = _levels(held["leaf"], start, total), range(0)
            for level in range(len(levels) - 1, -1, -1):
                at, digests = levels[level]
                out += [(group, total, level, at + k, h) for k, h in enumerate(digests) if (at + k) // ARITY not in above]
                above = range(at, at + len(digests))
            if len(out) >= _ROWS:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return cut(rows.select("_pid", "_g", "leaf").mapInArrow(work, _NODE))


def _local_paths(rows: DataFrame, ends: dict[int, tuple]) -> DataFrame:
    """Rows with the ragged node above them (level, i) and the siblings on the way to it (inner)."""
    key = rows.schema["key"].dataType.simpleString()
    kinds = {"_g": pa.string(), "key": pa.int64() if key == "bigint" else pa.string(), "leaf": pa.string(), "seen": pa.string(), "level": pa.int32(), "i": pa.int64()}

    def batch(rows: list[tuple], steps: list[tuple], offsets: list[int]) -> pa.RecordBatch:
        sides = [pa.array([x[side] for x in steps], pa.string()) for side in (0, 1)]
        paths = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(sides, ["left", "right"]))
        return pa.RecordBatch.from_arrays([*[pa.array(c, kind) for c, kind in zip(zip(*rows), kinds.values())], paths], [*kinds, "inner"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, steps, offsets = [], [], [0]
        for group, start, total, held in _runs(batches, ends):
            levels = _levels(held["leaf"], start, total)
            for k, row in enumerate(zip(held["key"], held["leaf"], held["seen"])):
                i, level = start + k, 0
                while level + 1 < len(levels):
                    at, digests = levels[level + 1]
                    up = i // ARITY
                    if not at <= up < at + len(digests):
                        break
                    first, own = levels[level]
                    steps.append(("".join(own[ARITY * up - first:i - first]), "".join(own[i + 1 - first:ARITY * (up + 1) - first])))
                    i, level = up, level + 1
                offsets.append(len(steps))
                out.append((group, *row, level, i))
                if len(out) >= _ROWS:
                    yield batch(out, steps, offsets)
                    out, steps, offsets = [], [], [0]
        if out:
            yield batch(out, steps, offsets)

    return rows.mapInArrow(work, f"_g string, key {key}, leaf string, seen string, level int, i long, inner array<{STEP}>")


def _at_level(level: str) -> str:
    """Nodes of a level of a tree, by its leaves."""
    return f"((total + {_power(level)} - 1) div {_power(level)})"


def _power(n: str) -> str:
    return f"element_at(powers, {n} + 1)"


_POWERS = "array(" + ", ".join(f"{ARITY ** k}L" for k in range(40)) + ") AS powers"
_DEPTH = "size(filter(powers, p -> p < total))"


def _nodes(ragged: DataFrame, most: int) -> DataFrame:
    """All nodes that no partition holds wholly, and the ragged ones: level by level, each a shuffle of a few rows a partition."""
    done = [ragged]
    made = None
    for level in range(sum(ARITY ** k < most for k in range(40))):
        known = ragged.where(F.col("level") == level)
        known = known.unionByName(made) if made is not None else known
        open_ = known.selectExpr("*", _POWERS).where(f"level < {_DEPTH}")
        made = open_.groupBy("_g", F.expr(f"i div {ARITY}").alias("_up")).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("i", "h"))).alias("_c"))
        made = cut(made.select("_g", "total", F.lit(level + 1).alias("level"), F.col("_up").alias("i"), F.sha2(F.array_join(F.col("_c.h"), ""), 256).alias("h")))
        done.append(made)
    return cut(reduce(DataFrame.unionByName, done))


def _upper_paths(ragged: DataFrame, nodes: DataFrame) -> DataFrame:
    """For every ragged node (_g, level, i) the siblings on the way from it to its tree's root (outer)."""
    own = ragged.selectExpr("_g", "total", "level", "i", _POWERS)
    own = own.selectExpr("*", f"{_DEPTH} AS depth")
    asked = own.selectExpr("_g", "total", "level", "i", "powers", "depth", "explode_outer(CASE WHEN level < depth THEN sequence(level, depth - 1) END) AS l")
    asked = asked.selectExpr("*", f"i div {_power('l - level')} AS a")
    siblings = f"filter(transform(sequence(0, {ARITY - 1}), k -> (a div {ARITY}) * {ARITY} + k), x -> x <> a AND x < {_at_level('l')})"
    asked = asked.selectExpr("_g", "level", "i", "l", "a", f"explode_outer(CASE WHEN l IS NOT NULL THEN {siblings} END) AS x")
    found = asked.join(nodes.select(F.col("_g").alias("_n"), F.col("level").alias("_l"), F.col("i").alias("_x"), "h"),
                       (F.col("_g") == F.col("_n")) & (F.col("l") == F.col("_l")) & (F.col("x") == F.col("_x")), "left")
    steps = found.groupBy("_g", "level", "i", "l", "a").agg(F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("x", "h")))).alias("s"))
    side = lambda sign: f"array_join(transform(filter(s, y -> y.x {sign} a), y -> y.h), '')"
    steps = steps.selectExpr("_g", "level", "i", f"CASE WHEN l IS NOT NULL THEN named_struct('l', l, 'left', {side('<')}, 'right', {side('>')}) END AS step")
    return steps.groupBy("_g", "level", "i").agg(F.array_sort(F.collect_list("step")).alias("o")).selectExpr(
        "_g", "level", "i", "transform(o, y -> named_struct('left', y.left, 'right', y.right)) AS outer")


def _tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """leaves: _g (not null), key, leaf, seen. The rows with the ragged node above them and the path to it; the paths from the
    ragged nodes to their trees' roots; the roots (_g, root)."""
    leaves = cut(leaves)
    n = leaves.count()
    parts = max(1, min(leaves.sparkSession.sparkContext.defaultParallelism, n), math.ceil(n / LEAVES))
    # equal rows are told apart by the place they were stored at, so that many of them need not be one partition's
    order = ["_g", "key", "leaf", "_tie"]
    rows = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = cut(rows.drop("_tie").withColumn("_pid", F.spark_partition_id()))
    # a row for each partition and group: where the group's leaves in it begin, and how many the group has
    counts = rows.groupBy("_pid", "_g").agg(F.count("*").alias("n"))
    group = Window.partitionBy("_g")
    before = F.coalesce(F.sum("n").over(group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_pid", "_g", before.alias("start"), F.sum("n").over(group).alias("total"))
    ends = counts.groupBy("_pid").agg(F.min_by(F.struct("start", "total"), "_g").alias("first"), F.max_by("total", "_g").alias("last"), F.max("total").alias("most"))
    found = ends.collect()  # four numbers a partition
    ends = {r["_pid"]: (r["first"]["start"], r["first"]["total"], r["last"]) for r in found}
    ragged = _ragged(rows, ends)
    nodes = _nodes(ragged, max((r["most"] for r in found), default=0))
    roots = nodes.selectExpr("*", _POWERS).where(f"level = {_DEPTH}").select("_g", F.col("h").alias("root"))
    return _local_paths(rows, ends), _upper_paths(ragged, nodes), roots


def manifest(docs: DataFrame, seen: Column | None = None) -> DataFrame:
    """A row per document: source, doc_id, leaf, subroot (of its source), root, proof (from the leaf up, per level the siblings to
    the left and those to the right, digests run together) and seen.

    seen: a column of ``docs`` that is carried along, such as the leaf digest of what is read now; the leaf, if none."""
    ship_package(docs.sparkSession)
    field = lambda c, kind: F.col(f"`{c}`").cast(kind)
    leaf = leaf_digest(field("doc_id", "long"), field("source", "string"), field("lang", "string"), field("n_chars", "long"), field("text", "string"))
    group = F.coalesce(F.concat(F.lit("s"), field("source", "string")), F.lit("n"))  # null first, then by bytes
    rows, upper, roots = _tree(docs.select(group.alias("_g"), field("doc_id", "long").alias("key"), leaf.alias("leaf"), (leaf if seen is None else seen).alias("seen")))
    # the sources' roots are the leaves of one more tree, in the order of their names
    over, above, top = _tree(roots.select(F.lit("").alias("_g"), F.col("_g").alias("key"), F.col("root").alias("leaf"), F.lit("").alias("seen")))
    over = over.join(above, ["_g", "level", "i"]).join(top, "_g").select(F.col("key").alias("_g"), F.col("leaf").alias("subroot"), "root", F.concat("inner", "outer").alias("over"))
    upper = upper.join(over, "_g").select("_g", "level", "i", "subroot", "root", F.concat("outer", "over").alias("outer"))
    out = rows.join(by_broadcast_if_small(upper, BROADCAST_PATHS), ["_g", "level", "i"])
    source = F.when(F.col("_g") != "n", F.substring("_g", F.lit(2), F.length("_g")))
    return out.select(source.alias("source"), F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.concat("inner", "outer").alias("proof"), "seen")


def verify(manifest_rows: DataFrame) -> DataFrame:
    """Rows of ``manifest`` with the root that what was seen leads to (folded_root), and whether it is the root (verified)."""
    rows = manifest_rows.withColumn("folded_root", folded(F.col("seen"), F.col("proof")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_digests(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, leaf, subroot, root, digest of its proof, and what its proof makes of the document after line feeds were
    taken out of every second text (by hash of doc_id; rows without one are left alone)."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    seen = leaf_digest(F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), text)
    rows = verify(manifest(docs, seen))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(F.transform("proof", lambda x: F.concat(x["left"], x["right"])), ""), 256).alias("proof_sha256"),
                       "folded_root", "verified")


#: Digests of levels by recursion over (source, number of node); the sources' roots make one more tree; proofs and folds walk up from each leaf.
MERKLE_SQL = "WITH RECURSIVE " + CRC_SQL + r""",
d AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN h % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents LEFT JOIN crc USING (doc_id)),
fixed AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
            || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM d),
digests AS (SELECT doc_id, coalesce('s' || source, 'n') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS seen FROM fixed),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM digests),
nodes AS (SELECT g, 0 AS level, i, leaf AS h FROM leaves
          UNION ALL SELECT g, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM nodes) WHERE c > 1 GROUP BY g, level, i // 3),
subroots AS (SELECT g, arg_max(h, level) AS h, max(level) AS depth FROM nodes GROUP BY g),
tops AS (SELECT 0 AS level, row_number() OVER (ORDER BY CAST(g AS BLOB)) - 1 AS i, g, h FROM subroots
         UNION ALL SELECT level + 1, i // 3, '', sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM tops) WHERE c > 1 GROUP BY level, i // 3),
root AS (SELECT arg_max(h, level) AS h FROM tops),
walk AS (SELECT l.*, 0 AS level, FALSE AS upper, l.i AS pos, l.seen AS fold, '' AS proof FROM leaves l
         UNION ALL
         SELECT w.doc_id, w.g, w.leaf, w.seen, w.i, CASE WHEN w.level < depth THEN w.level + 1 ELSE 0 END, w.level = depth, CASE WHEN w.level < depth THEN w.pos // 3 ELSE t.i END,
                CASE WHEN w.level < depth THEN sha256(coalesce((SELECT string_agg(h, '' ORDER BY n.i) FROM nodes n WHERE n.g = w.g AND n.level = w.level AND n.i // 3 = w.pos // 3 AND n.i < w.pos), '') || fold
                  || coalesce((SELECT string_agg(h, '' ORDER BY n.i) FROM nodes n WHERE n.g = w.g AND n.level = w.level AND n.i // 3 = w.pos // 3 AND n.i > w.pos), '')) ELSE fold END,
                proof || CASE WHEN w.level < depth THEN coalesce((SELECT string_agg(h, '' ORDER BY n.i) FROM nodes n WHERE n.g = w.g AND n.level = w.level AND n.i // 3 = w.pos // 3 AND n.i <> w.pos), '') ELSE '' END
         FROM walk w JOIN subroots s ON s.g = w.g JOIN tops t ON t.level = 0 AND t.g = w.g WHERE NOT upper),
climb AS (SELECT doc_id, g, leaf, i, level, pos, fold, proof FROM walk WHERE upper
          UNION ALL
          SELECT c.doc_id, c.g, c.leaf, c.i, c.level + 1, c.pos // 3,
                 sha256(coalesce((SELECT string_agg(h, '' ORDER BY n.i) FROM tops n WHERE n.level = c.level AND n.i // 3 = c.pos // 3 AND n.i < c.pos), '') || fold
                   || coalesce((SELECT string_agg(h, '' ORDER BY n.i) FROM tops n WHERE n.level = c.level AND n.i // 3 = c.pos // 3 AND n.i > c.pos), '')),
                 proof || coalesce((SELECT string_agg(h, '' ORDER BY n.i) FROM tops n WHERE n.level = c.level AND n.i // 3 = c.pos // 3 AND n.i <> c.pos), '')
          FROM climb c WHERE c.level < (SELECT max(level) FROM tops))
SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root.h AS verified
FROM climb c JOIN subroots s USING (g), root WHERE c.level = (SELECT max(level) FROM tops)
"""
