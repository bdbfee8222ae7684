"""A Merkle manifest of a table: a content-addressed tree of digests, and proofs by descent.

Every row is a leaf. The leaves of a group ascend by key; every two neighbours become one node until one is left, the
group's root, and the groups' roots become the root of all likewise. The tree is kept as records: the digest of a
segment's top (ten levels at most) -> the digests of the nodes that the segment's bottom holds, in order. Requests of
leaves descend from the root: a request's rank, read in digits of ten bits, says which child it goes to, and the
unselected children on the way are its path segment. Requests that go to the same segment travel as one row, so
each join has a row a segment and none a leaf, and only the last one unfolds. Reversed, the path segments are the
proof, from the leaf to the root.

Ranks are places in sorted partitions plus the counts of the partitions before: no group, however large, is sorted
by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.types import StringType

from .shared import cut

BITS = 10
ALL = "all"
TAMPERED = 7


def digest(*parts: str) -> str:
    """Lowercase hex sha256 of the parts, joined."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """The digest of a row's values: each ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def fold(level: list[str], levels: int | None = None) -> list[list[str]]:
    """The levels above ``level``, itself first: as many as given, or until one node is left."""
    out = [level]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        now = out[-1]
        out.append([digest(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return out


def path(tree: list[list[str]], at: int) -> list[str]:
    """What is unselected on the way down to place ``at`` of the bottom, from the top: ``L`` or ``R`` and the digest, or nothing."""
    out = []
    for level in reversed(range(len(tree) - 1)):
        place = at >> level
        other = place ^ 1
        out.append(("L" if other < place else "R") + tree[level][other] if other < len(tree[level]) else "")
    return out


def climb(start: str, proof: list[str]) -> str:
    """The root that a proof, from the leaf on, leads to."""
    for step in proof:
        start = digest(step[1:], start) if step[:1] == "L" else digest(start, step[1:])
    return start


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` (checkpointed) with ``rank``, from 0, and ``size`` within their group by ``order``; nulls come first."""
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    held = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))
    sizes = held.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    parts = Window.partitionBy(group)
    sizes = sizes.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.sum("_n").over(parts.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(parts).alias("size"))
    placed = held.mapInArrow(_placed(held.columns.index(group)), ", ".join(f"`{n}` {k}" for n, k in [*held.dtypes, ("_i", "bigint")]))
    found = placed.join(sizes, placed[group].eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return found.select(*rows.columns, (F.col("_i") + F.col("_before")).alias("rank"), "size")


def _placed(column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = (), 0
        for batch in batches:
            places = []
            for g in batch.column(column).to_pylist():
                if (g,) != now:
                    now, seen = (g,), 0
                places.append(seen)
                seen += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "_i"])

    return run


def _top(bits: int):
    """Column function: the digest at the top of a segment."""
    return F.udf(lambda children, whole: fold(list(children), None if whole else bits)[-1][0], StringType(), useArrow=True)


def bundles(nodes: DataFrame, bits: int, *carried: str) -> DataFrame:
    """(grp, block, whole, size, held): nodes (grp, rank, size, digest) and what they carry, by blocks of neighbours."""
    held = F.array_sort(F.collect_list(F.struct("rank", "digest", *carried))).alias("held")
    return nodes.groupBy("grp", F.shiftright("rank", bits).alias("block"), "size").agg(held).withColumn("whole", F.col("size") <= 1 << bits)


def segments(bottom: DataFrame, bits: int) -> list[DataFrame]:
    """The records of the trees over ``bottom`` (bundles of nodes), one table a layer, from the leaves up.

    A record is (grp, block, size, whole, digest, children): ``digest`` is the top of the nodes ``children``, block
    number ``block`` of their layer, and ``whole`` says that the layer has no other, so that its top is the root.
    """
    layers = []
    while True:
        found = bottom.withColumn("children", F.transform("held", lambda x: x["digest"]))
        layers.append(cut(found.select("grp", "block", "size", "whole", _top(bits)("children", "whole").alias("digest"), "children")))
        more = layers[-1].where("not whole")
        if more.isEmpty():
            return layers
        bottom = bundles(more.select("grp", F.col("block").alias("rank"), F.shiftright(F.col("size") + (1 << bits) - 1, bits).alias("size"), "digest"), bits)


def roots(layers: list[DataFrame]) -> DataFrame:
    """(grp, digest) of every group's root."""
    out = None
    for layer in layers:
        found = layer.where("whole").select("grp", "digest")
        out = found if out is None else out.unionByName(found)
    return out


def store(layer: DataFrame) -> DataFrame:
    """digest -> (children, whole): each digest of a layer once, wherever its nodes lie."""
    return layer.groupBy("digest").agg(F.first("children").alias("children"), F.first("whole").alias("whole"))


REQUEST = "grp string, block bigint, digest string, via array<string>, proof array<string>"
_REQUEST = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("digest", pa.string()), ("via", pa.list_(pa.string())), ("proof", pa.list_(pa.string()))])


def _down(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Requests at a segment -> one for each child of it, with the path there."""
    for batch in batches:
        for row in batch.to_pylist():
            tree = fold(row["children"], None if row["whole"] else bits)
            first = row["block"] << bits
            yield from _batches([(row["grp"], first + i, d, row["via"], row["proof"] + path(tree, i)) for i, d in enumerate(row["children"])], _REQUEST)


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 256], strict=True), schema, strict=True)], schema=schema)


def descend(requests: DataFrame, layers: list[DataFrame], bits: int) -> DataFrame:
    """Requests (grp, digest, via, proof) of groups' roots -> requests at the lowest segments, with their records.

    One layer is one digit of the rank. A group whose tree has fewer layers joins at its own.
    """
    asked = None
    for i in reversed(range(len(layers))):
        own = layers[i].where("whole").select("grp", "block").join(requests, "grp").select("grp", "block", "digest", "via", "proof")
        asked = own if asked is None else asked.unionByName(own)
        asked = asked.join(store(layers[i]), "digest")
        if i:
            asked = asked.select("grp", "block", "via", "proof", "children", "whole").mapInArrow(lambda batches: _down(batches, bits), REQUEST)
    return asked


PROOF = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PROOF = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def _proofs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Requests at the lowest segments with their leaves -> a row for each leaf."""
    for batch in batches:
        for row in batch.to_pylist():
            tree = fold(row["children"], None if row["whole"] else bits)
            root, subroot = row["via"]
            out = []
            for i, asked in enumerate(row["held"]):
                proof = (row["proof"] + path(tree, i))[::-1]
                folded = climb(asked["changed"] or row["children"][i], proof)
                out.append((asked["key"], row["children"][i], subroot, root, digest(*(step[1:] for step in proof)), folded, folded == root))
            yield from _batches(out, _PROOF)


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: str = "n_chars", bits: int = BITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; the key is a whole number.

    The root is folded again from each leaf and the siblings of its proof; where 7 divides the crc32 of the key, from
    the leaf with 1 added to ``changed``. Nulls are values of their own: a null group is the first group, null keys
    come first in theirs and are never changed, a null text differs from an empty one. Rows of one key are ordered by
    their digests, and equal rows are equal leaves, each with its own proof. A table of one row is its leaf; an empty
    one gives no rows. Columns other than ``columns`` do not matter.
    """
    values = [docs[c] for c in columns]
    altered = [docs[c] + 1 if c == changed else docs[c] for c in columns]
    hit = F.crc32(docs[key].cast("string").cast("binary")) % TAMPERED == 0
    # a group's name as text that keeps null apart and first
    name = F.coalesce(F.concat(F.lit("="), docs[group]), F.lit(""))
    leaves = docs.select(docs[key].cast("bigint").alias("key"), name.alias("grp"), leaf(*values).alias("digest"), F.when(hit, leaf(*altered)).alias("changed"), F.monotonically_increasing_id().alias("tie"))
    bottom = cut(bundles(ranked(leaves, "grp", "key", "digest", "tie"), bits, "key", "changed"))
    layers = segments(bottom, bits)
    names = roots(layers).select(F.lit(ALL).alias("kind"), F.col("grp").alias("name"), "digest")
    above = cut(bundles(ranked(names, "kind", "name").withColumnRenamed("kind", "grp"), bits, "name"))
    upper = segments(above, bits)

    start = roots(upper).select("grp", "digest", F.array("digest").alias("via"), F.array().cast("array<string>").alias("proof"))
    met = descend(start, upper, bits).join(above.select("grp", "block", "held"), ["grp", "block"])
    subroots = cut(met.select("grp", "block", "via", "proof", "children", "whole", "held").mapInArrow(lambda batches: _named(batches, bits), "grp string, digest string, via array<string>, proof array<string>"))
    asked = descend(subroots, layers, bits).join(bottom.select("grp", "block", "held"), ["grp", "block"])
    return asked.select("grp", "block", "via", "proof", "children", "whole", "held").mapInArrow(lambda batches: _proofs(batches, bits), PROOF)


def _named(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Requests at the lowest segments over the groups' roots -> a request for each group."""
    schema = pa.schema([("grp", pa.string()), ("digest", pa.string()), ("via", pa.list_(pa.string())), ("proof", pa.list_(pa.string()))])
    for batch in batches:
        for row in batch.to_pylist():
            tree = fold(row["children"], None if row["whole"] else bits)
            yield from _batches([(x["name"], d, [*row["via"], d], row["proof"] + path(tree, i)) for i, (x, d) in enumerate(zip(row["held"], row["children"], strict=True))], schema)
