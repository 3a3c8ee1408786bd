"""Merkle manifest of a dataset: one tree a group, one tree over the groups, a proof for every row.

The trees are computed by time-forward processing. Every node has a label
(group, level, place) and is worked on in the order of labels; what it computes is
a message to a node with a later label. Within a block of ``2 ** HEIGHT`` aligned
leaves the messages wait in a priority queue (``raise_block``): all messages to the
least label are taken, their digests are hashed, and the result goes to the
parent. Between blocks the queue is external: the digests of the blocks' tops are
rows that Spark's shuffle deals by (group, block) and sorts by place, one round for
every ``HEIGHT`` levels. A reversed sweep runs the rounds backwards: a block's
message from above is the proof suffix of its top, it is sorted before the
block's nodes, and each node passes its own siblings in front of that suffix on.

Places come from ranges of (group, key, leaf): rows are counted by group and range,
and numbered from the sums of the counts before. No task sees a whole group, texts
never move, and a round shrinks the rows by ``2 ** HEIGHT``. All tables that are read
again are written to the shared folder.

Defined cases: a null group is a group of its own, ordered first; rows ascend by
key, nulls first, and rows of one key by their leaf; repeated rows are leaves each;
a lone leaf is its group's subroot, and the only subroot the root; no rows: no
leaves, no root; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shotgrid.llm.common import map_arrow, stash

HEIGHT = 12            # levels of a block: 4096 leaves
TAMPERED = 7           # rows whose checksum it divides are tampered with
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

NODES = "grp string, place long, n long, digest binary"
PROVEN = ("grp string, place long, key long, digest binary, tampered binary, "
          "subroot string, root string, proof array<string>")


def field(value: Column) -> Column:
    """A field as bytes: ``-`` for null, else its UTF-8 length, a colon and the value."""
    data = value.cast("string").cast("binary")
    return F.coalesce(F.concat(F.concat(F.octet_length(data).cast("string"), F.lit(":")).cast("binary"), data),
                      F.lit("-").cast("binary"))


def leaf(values: list[Column]) -> Column:
    """The leaf digest of a row in hex."""
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf digest gives with a proof: per level ``L`` or ``R`` (the sibling's side) and the
    sibling's digest, or an empty string where the node has none."""
    step = lambda own, s: F.sha2(
        F.when(F.left(s, F.lit(1)) == "L", F.concat(F.substr(s, F.lit(2)), own))
        .when(F.left(s, F.lit(1)) == "R", F.concat(own, F.substr(s, F.lit(2)))).otherwise(own).cast("binary"), 256)
    return F.aggregate(proof, digest, step)


def siblings(proof: Column) -> Column:
    """The digests of a proof, joined."""
    return F.array_join(F.transform(proof, lambda s: F.substr(s, F.lit(2))), "")


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with ``grp``) and their place in the group, from 0, and the group's size ``n``."""
    ranged = rows.withColumn("salt", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first(c) for c in ("grp", *order, "salt")]
    dealt = stash(ranged.repartitionByRange(*keys).sortWithinPartitions(*keys)
                  .withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id())
                  .drop("salt"), "places")
    counts = dealt.groupBy("grp", "range").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    group = Window.partitionBy("grp")
    before = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(F.col("grp").alias("g"), F.col("range").alias("r"),
                         (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                         F.sum("here").over(group).alias("n"))
    return (dealt.join(sums, F.col("grp").eqNullSafe(F.col("g")) & (F.col("range") == F.col("r")))
            .withColumn("place", F.col("at") + F.col("shift")).drop("g", "r", "range", "at", "shift"))


def raise_block(first: int, digests: list[str], top: int | None) -> dict[tuple[int, int], str]:
    """All nodes (level, place) above consecutive nodes of one level, by time-forward processing.

    ``top`` is the level to stop at; None: stop where one node is left.
    """
    queue = [(0, first + i, d) for i, d in enumerate(digests)]       # (level, place, digest), in order: a heap
    done: dict[tuple[int, int], str] = {}
    waiting: list[str] = []
    while queue:
        level, place, digest = heapq.heappop(queue)
        done[level, place] = digest
        if level == top or top is None and not queue and not waiting:
            continue
        waiting.append(digest)
        if not place % 2 and queue and queue[0][:2] == (level, place + 1):
            continue                                                 # its sibling's message comes next
        heapq.heappush(queue, (level + 1, place // 2, hashlib.sha256("".join(waiting).encode()).hexdigest()))
        waiting = []
    return done


def path(nodes: dict[tuple[int, int], str], place: int, levels: int) -> list[str]:
    """Siblings of a node on its way up, each with its side; empty where there is none."""
    out = []
    for level in range(levels):
        other = nodes.get((level, place ^ 1))
        out.append("" if other is None else ("R" if place % 2 == 0 else "L") + other)
        place //= 2
    return out


def _blocks(batches, columns: int, height: int):
    """((group, block), rows) of sorted input."""
    key, rows = None, []
    for batch in batches:
        values = [c.to_pylist() for c in batch.columns[:columns]]
        for row in zip(*values):
            at = row[0], row[1] >> height
            if rows and at != key:
                yield key, rows
                rows = []
            key = at
            rows.append(row)
    if rows:
        yield key, rows


def _levels(n: int) -> int:
    """Levels between a group's n nodes and its only one."""
    return max(n - 1, 0).bit_length()


def _up(height: int):
    """Nodes of a level -> the tops of their blocks, ``height`` levels up or where the group's tree ends."""
    def run(batches):
        for (group, _), rows in _blocks(batches, 4, height):
            n = rows[0][2]
            levels = min(height, _levels(n))
            nodes = raise_block(rows[0][1], [r[3].hex() for r in rows], levels)
            place = rows[0][1] >> levels
            yield pa.RecordBatch.from_arrays(
                [pa.array([group], pa.string()), pa.array([place], pa.int64()),
                 pa.array([-(-n >> levels)], pa.int64()),
                 pa.array([bytes.fromhex(nodes[levels, place])], pa.binary())], ["grp", "place", "n", "digest"])
    return run


def _down(names: list[str], height: int):
    """Messages from above and nodes of a level -> the nodes' own messages."""
    def run(batches):
        # (grp, place, kind, n, digest, key, tampered, subroot, root, proof), a block's message before its nodes
        for (group, _), rows in _blocks(batches, 10, height):
            message, nodes = rows[0], [r for r in rows if r[2] == 1]
            if not nodes:
                continue
            levels = min(height, _levels(nodes[0][3]))
            tree = raise_block(nodes[0][1], [r[4].hex() for r in nodes], levels)
            subroot, root, above = message[7:]
            for i in range(0, len(nodes), 512):
                some = nodes[i:i + 512]
                out = {"grp": pa.array([group] * len(some), pa.string()),
                       "place": pa.array([r[1] for r in some], pa.int64()),
                       "key": pa.array([r[5] for r in some], pa.int64()),
                       "digest": pa.array([r[4] for r in some], pa.binary()),
                       "tampered": pa.array([r[6] for r in some], pa.binary()),
                       "subroot": pa.array([subroot] * len(some), pa.string()),
                       "root": pa.array([root] * len(some), pa.string()),
                       "proof": pa.array([path(tree, r[1], levels) + above for r in some], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([out[c] for c in names], names)
    return run


def _by_block(df: DataFrame, height: int, *more: str) -> DataFrame:
    block = F.shiftright("place", height)
    return (df.withColumn("block", block).repartition("grp", "block").sortWithinPartitions("grp", "place", *more)
            .drop("block"))


def forest(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The levels of all trees at multiples of ``height``, from the leaves to the groups' subroots (n = 1)."""
    levels = [nodes]
    while levels[-1].where("n > 1").limit(1).count():
        last = levels[-1]
        blocks = _by_block(last.select("grp", "place", "n", "digest"), height)
        levels.append(stash(map_arrow(blocks, _up(height), NODES), "level"))
    return levels


def deliver(levels: list[DataFrame], messages: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Reversed sweep: ``messages`` to the subroots go down to the leaves and come out as ``PROVEN``."""
    def null(kind, name):
        return F.lit(None).cast(kind).alias(name)

    own = [null("long", "key"), null("binary", "tampered")]
    for k in range(len(levels) - 2, -1, -1):
        nodes = levels[k].select(
            "grp", "place", F.lit(1).alias("kind"), "n", "digest", *(["key", "tampered"] if k == 0 else own),
            null("string", "subroot"), null("string", "root"), null("array<string>", "proof"))
        # a top's message is sorted before the first node of its block
        down = messages.select("grp", F.shiftleft("place", height).alias("place"), F.lit(0).alias("kind"),
                               null("long", "n"), null("binary", "digest"), *own, "subroot", "root", "proof")
        names = [f.split()[0] for f in PROVEN.split(", ")]
        messages = map_arrow(_by_block(nodes.union(down), height, "kind"), _down(names, height), PROVEN)
        if k:
            messages = stash(messages, "messages")
    return messages


def manifest(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``PROVEN`` of leaves (grp, place, n, digest, key, tampered); see ``fold`` for the proof's form.

    Groups order by their UTF-8 bytes, null first. ``root`` is the tree over the groups' subroots.
    """
    none = F.lit(None).cast("string")
    levels = forest(rows, height)
    if len(levels) == 1:
        levels.append(levels[0].select("grp", "place", "n", "digest"))   # groups of one leaf each, or no rows
    tops = placed(levels[-1].select(F.col("grp").alias("name"), none.alias("grp"), "digest"), "name")
    upper = forest(stash(tops.withColumns({"key": F.lit(None).cast("long"), "tampered": F.lit(None).cast("binary")}), "tops"), height)
    if len(upper) == 1:
        upper.append(upper[0].select("grp", "place", "n", "digest"))
    root = upper[-1].select("grp", "place", none.alias("subroot"), F.lower(F.hex("digest")).alias("root"),
                            F.array().cast("array<string>").alias("proof"))
    proofs = deliver(upper, root, height).select(F.col("place").alias("p"), "root", "proof")
    named = upper[0].select("name", "place", "digest")
    messages = (named.join(proofs, F.col("place") == F.col("p"))
                .select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("place"),
                        F.lower(F.hex("digest")).alias("subroot"), "root", "proof"))
    return deliver(levels, stash(messages, "messages"), height)


def prove(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: list[str] = FIELDS,
          height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, proof) of every row.

    ``tampered`` is the leaf with 1 added to ``n_chars`` where ``TAMPERED`` divides the
    checksum of the key, null elsewhere.
    """
    chosen = F.crc32(F.col(key).cast("string").cast("binary")) % TAMPERED == 0
    other = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in fields]
    leaves = docs.select(F.col(group).cast("string").alias("grp"), F.col(key).cast("long").alias("key"),
                         F.unhex(leaf([F.col(f) for f in fields])).alias("digest"),
                         F.when(chosen, F.unhex(leaf(other))).alias("tampered"))
    proven = manifest(stash(placed(leaves, "key", "digest"), "leaves"), height)
    return proven.select(F.col("key").alias("doc_id"), F.lower(F.hex("digest")).alias("leaf"),
                         F.lower(F.hex("tampered")).alias("tampered"), "subroot", "root", "proof")


def verified(proven: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of ``prove``'s rows."""
    folded = fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    return (proven.select("doc_id", "leaf", "subroot", "root",
                          F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
                          folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
