"""Merkle manifest of a dataset by time-forward processing, with a proof for every row.

Every group's leaves, in order of id, are nodes of level 0; ``FAN`` consecutive nodes make one of the next level. A node's label is (the last leaf below
it, its level), so labels rise from children to parents. The external priority queue is Spark's sorted shuffle with a heap in each task: nodes stream in
by label, send their digests to their parents' labels, and a node is made when the sweep reaches its label and takes its children's messages off the
queue, which never holds more than one open run a level. A round raises blocks of FAN**LEVELS nodes (4096) by LEVELS
levels, so a table of n rows takes log(n) / log(4096) rounds, each over the block digests of the one before. The reversed sweep takes the rounds
back: a block's proof suffix, delivered by a join, goes down to its nodes by falling label, each parent sending its children their siblings and its own suffix.

Subroots of the groups, ordered by group (null first, bytewise), are the leaves of one more tree by the same functions.

Defined results: null fields are ``-``; null ids come first; equal ids are ordered by leaf digest, and identical rows (which have one digest) are as many
leaves as there are rows, dealt out block by block; an empty table has no rows and no root; a null id is never tampered with; columns
beyond the five are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from podium.plans.ordered import join_null_safe

from .tables import pin

FAN = 8
LEVELS = 4
BLOCK = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SQL = """
WITH RECURSIVE fields AS (
    SELECT doc_id, lang, concat(
        coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', CAST(doc_id AS VARCHAR)), '-'),
        coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'),
        coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', CAST(n_chars AS VARCHAR)), '-')) AS head,
        coalesce(concat(strlen(text), ':', text), '-') AS body,
        coalesce(concat(strlen(text), ':', translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '-') AS low_body,
        list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
                                 lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS UBIGINT))),
            lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: CAST(i AS UBIGINT))),
                                     lambda a, k: xor(a >> 1, (a & 1) * CAST(3988292384 AS UBIGINT)))) AS state
    FROM documents),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
    FROM (SELECT doc_id, lang, sha256(concat(head, body)) AS leaf,
                 CASE WHEN xor(state, CAST(4294967295 AS UBIGINT)) % 3 = 0 THEN sha256(concat(head, low_body))
                      ELSE sha256(concat(head, body)) END AS claim FROM fields)),
up AS (
    SELECT lang, 0 AS l, i, leaf AS d, n FROM leaves
    UNION ALL
    SELECT lang, l + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 7) // 8) FROM up WHERE n > 1 GROUP BY lang, l, i // 8),
subroots AS (
    SELECT lang, l AS height, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
    SELECT 0 AS l, i, subroot AS d, n FROM subroots
    UNION ALL
    SELECT l + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 7) // 8) FROM top WHERE n > 1 GROUP BY l, i // 8),
siblings AS (
    SELECT lang, l, i,
           coalesce(string_agg(d, '') OVER (PARTITION BY lang, l, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
           coalesce(string_agg(d, '') OVER (PARTITION BY lang, l, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM up WHERE n > 1),
top_siblings AS (
    SELECT l, i,
           coalesce(string_agg(d, '') OVER (PARTITION BY l, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
           coalesce(string_agg(d, '') OVER (PARTITION BY l, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM top WHERE n > 1),
fold AS (
    SELECT lang, i AS leaf_no, 0 AS l, i, '' AS proof, claim AS h FROM leaves
    UNION ALL
    SELECT f.lang, f.leaf_no, f.l + 1, f.i // 8, concat(f.proof, s.before, s.after), sha256(concat(s.before, f.h, s.after))
    FROM fold f JOIN siblings s ON s.lang IS NOT DISTINCT FROM f.lang AND s.l = f.l AND s.i = f.i),
last AS (
    SELECT f.lang, f.leaf_no, 0 AS l, s.i, f.proof, f.h FROM fold f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang AND s.height = f.l
    UNION ALL
    SELECT f.lang, f.leaf_no, f.l + 1, f.i // 8, concat(f.proof, s.before, s.after), sha256(concat(s.before, f.h, s.after))
    FROM last f JOIN top_siblings s ON s.l = f.l AND s.i = f.i)
SELECT v.doc_id, v.leaf, s.subroot, r.d AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.d AS verified
FROM leaves v JOIN subroots s ON s.lang IS NOT DISTINCT FROM v.lang
JOIN (SELECT l, d FROM top WHERE n = 1) r ON true
JOIN last f ON f.lang IS NOT DISTINCT FROM v.lang AND f.leaf_no = v.i AND f.l = r.l
"""


def encoded(*values: Column) -> Column:
    """Values as one string in which no two different rows agree: byte count, colon and value each, ``-`` for null."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def leaves(documents: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(grp, id, leaf, claim): the digest of every row of documents under its language, and the digest to verify.

    Where ``tampered`` holds, the claim is that of the row with A-Z of its text in lower case.
    """
    value = {name: F.col(name).cast("string") for name in FIELDS}
    changed = value | {"text": F.translate(value["text"], UPPER, UPPER.lower())}
    own, other = (F.sha2(encoded(*[v[name] for name in FIELDS]).cast("binary"), 256) for v in (value, changed))
    return documents.select(value["lang"].alias("grp"), F.col("doc_id").cast("long").alias("id"), own.alias("leaf"),
                            (F.when(tampered, other) if tampered is not None else F.lit(None).cast("string")).alias("claim"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _before(group: Sequence[str]):
    """Within a sorted partition, the copies ahead of each row in its group; the group's columns come first, ``copies`` last."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(group))])) if group else [()] * batch.num_rows
            before = np.zeros(batch.num_rows, np.int64)
            for i, (key, copies) in enumerate(zip(keys, batch.column(batch.num_columns - 1).to_pylist())):
                if key != last:
                    last, total = key, 0
                before[i] = total
                total += copies
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], names=[*batch.schema.names, "before"])

    return count


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` (with a column ``copies``) with ``start``, the ordinal of the first copy in its group, and ``total``, the group's copies.

    Range partitions are ordered on their own; one row per partition and group carries the offsets.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in rows.columns if c not in group and c != "copies"]
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    placed = (rows.select(*group, *rest, F.spark_partition_id().alias("chunk"), "copies")
              .repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
              .withColumn("chunk", F.spark_partition_id()))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    placed = pin(placed.mapInArrow(_before(group), f"{types}, before bigint"))
    sums = placed.groupBy(*group, "chunk").agg(F.sum("copies").alias("in_chunk"))
    ahead = W.partitionBy(*group).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("in_chunk").over(ahead), F.lit(0))) \
        .withColumn("total", F.sum("in_chunk").over(W.partitionBy(*group))).drop("in_chunk")
    return (join_null_safe(placed, offsets, [*group, "chunk"])
            .withColumn("start", F.col("before") + F.col("offset")).drop("chunk", "before", "offset"))


def height(total: int) -> int:
    """Levels of a round over a group of so many nodes."""
    levels = 0
    while total > 1 and levels < LEVELS:
        total, levels = -(-total // FAN), levels + 1
    return levels


class Sweep:
    """One block, forward: nodes in order of their labels, then backward: suffixes to the block's nodes."""

    def __init__(self, first: int, total: int):
        self.total, self.height, self.next = total, height(total), first
        self.queue: list[tuple] = []
        self.nodes: list[tuple] = []  # label, digest, labels of its children
        self.digest = ""

    def _label(self, at: int, level: int) -> tuple[int, int]:
        """Of the node above ordinal ``at`` on this level."""
        span = FAN ** level
        return min((at // span + 1) * span, self.total) - 1, level

    def take(self, digest: str) -> None:
        """The next node of level 0, and every node above it that is complete with it."""
        at, level, children = self.next, 0, []
        self.next += 1
        while True:
            self.nodes.append((self._label(at, level), digest, children))
            if level == self.height:
                self.digest = digest
                return
            level += 1
            heapq.heappush(self.queue, (self._label(at, level), len(self.nodes) - 1))
            if self.queue[0][0] != (at, level):
                return
            children = []
            while self.queue and self.queue[0][0] == (at, level):
                children.append(heapq.heappop(self.queue)[1])
            digest = _sha("".join(self.nodes[c][1] for c in children))

    def suffixes(self, suffix: str) -> list[str]:
        """The proof suffix of each node of level 0, in order: per level a digit, the place in the run, and the siblings' digests."""
        queue = [(-len(self.nodes) + 1, suffix)]
        out = []
        while queue:
            node, suffix = heapq.heappop(queue)
            children = self.nodes[-node][2]
            if not children:
                out.append(suffix)
                continue
            digests = [self.nodes[c][1] for c in children]
            for place, child in enumerate(children):
                heapq.heappush(queue, (-child, f"{place}{''.join(digests[:place] + digests[place + 1:])}/{suffix}"))
        return out[::-1]


def fold(claim: str, proof: str) -> tuple[str, str]:
    """(root that a claimed leaf leads to, all siblings' digests in order)."""
    levels = proof.split("/")[:-1]
    for level in levels:
        cut = 1 + 64 * int(level[0])
        claim = _sha(level[1:cut] + claim + level[cut:])
    return claim, "".join(level[1:] for level in levels)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Blocks of a partition sorted by (grp, block, start), one at a time."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            here = (row["grp"], row["block"])
            if here != key and held:
                yield key, held
                held = []
            key = here
            held.append(row)
    if held:
        yield key, held


def _swept(block: int, rows: list[dict]) -> tuple[Sweep, list[dict]]:
    """A block after its forward sweep, and the row of each of its nodes (copies are nodes of their own)."""
    first = block * BLOCK
    sweep, of = Sweep(first, rows[0]["total"]), []
    for row in rows:
        for _ in range(max(row["start"], first), min(row["start"] + row["copies"], first + BLOCK)):
            sweep.take(row["digest"])
            of.append(row)
    return sweep, of


_UP = pa.schema([("grp", pa.string()), ("start", pa.int64()), ("digest", pa.string()), ("total", pa.int64())])
_DOWN = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("suffix", pa.string()), ("peak", pa.string())])
_OUT = pa.schema([("grp", pa.string()), ("id", pa.int64()), ("leaf", pa.string()), ("peak", pa.string()), ("proof_sha256", pa.string()),
                  ("folded", pa.string()), ("proof", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint'}" for f in schema)


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = []
    for (grp, block), rows in _blocks(batches):
        sweep, _ = _swept(block, rows)
        made.append((grp, block, sweep.digest, -(-sweep.total // FAN ** sweep.height)))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 4, _UP.types)], schema=_UP)


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (grp, block), rows in _blocks(batches):
        sweep, of = _swept(block, rows)
        found = sweep.suffixes(rows[0]["suffix"])
        first = block * BLOCK
        yield pa.RecordBatch.from_arrays([pa.array([grp] * len(of), pa.string()), pa.array(range(first, first + len(of)), pa.int64()),
                                          pa.array(found, pa.string()), pa.array([rows[0]["peak"]] * len(of), pa.string())], schema=_DOWN)


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (grp, block), rows in _blocks(batches):
        sweep, of = _swept(block, rows)
        out = []
        for row, proof in zip(of, sweep.suffixes(rows[0]["suffix"])):
            folded, siblings = fold(row["claim"] or row["digest"], proof)
            out.append((grp, row["id"], row["digest"], row["peak"], _sha(siblings), folded, proof))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _OUT.types)], schema=_OUT)


def _dealt(nodes: DataFrame) -> DataFrame:
    """Nodes with the block they are in; many copies of one leaf span several."""
    last = F.col("start") + F.col("copies") - 1
    return nodes.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(last / BLOCK))))


def _sorted(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("grp", "block").sortWithinPartitions(F.col("grp").asc_nulls_first(), "block", "start")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes, from (grp, start, copies, total, digest, ...) up to one node a group."""
    tables = [pin(_dealt(nodes))]
    most = tables[0].agg(F.max("total")).first()[0] or 1
    while most > 1:
        above = _sorted(tables[-1].select("grp", "block", "start", "copies", "total", "digest")).mapInArrow(_up, _ddl(_UP))
        tables.append(pin(_dealt(above.withColumn("copies", F.lit(1).cast("long")))))
        most = -(-most // BLOCK)
    return tables


def _delivered(nodes: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Each node with its block's suffix, blocks together and in order."""
    return _sorted(join_null_safe(nodes, suffixes, ["grp", "block"]))


def swept_down(tables: list[DataFrame], suffixes: DataFrame) -> DataFrame:
    """Suffixes (grp, block, suffix, peak) of the blocks of the lowest table, from those of the groups' last nodes.

    The last table has one node a group, of block 0; in all others a block's suffix is that of the node it became.
    """
    for nodes in reversed(tables[1:]):
        suffixes = pin(_delivered(nodes.select("grp", "block", "start", "copies", "total", "digest"), suffixes).mapInArrow(_down, _ddl(_DOWN)))
    return suffixes


def manifest(rows: DataFrame) -> DataFrame:
    """(grp, id, leaf, subroot, root, proof, proof_sha256, folded_root, verified) for rows of ``leaves``."""
    counted = rows.groupBy("grp", "id", "leaf", "claim").agg(F.count(F.lit(1)).alias("copies"))
    ordered = numbered(counted, ["grp"], ["id", "leaf"]).withColumnRenamed("leaf", "digest")
    tables = rounds(ordered)
    subroots = tables[-1].select(F.col("grp").alias("of"), "digest", F.lit(1).cast("long").alias("copies"))
    top = rounds(numbered(subroots, [], ["of"]).withColumn("grp", F.lit(None).cast("string")))
    peak = top[-1].select("digest").first()
    root = F.lit(peak[0] if peak else None).cast("string")
    start = top[-1].select("grp", "block", F.lit("").alias("suffix"), root.alias("peak"))
    down = _delivered(top[0], swept_down(top, start))
    given = pin(down.select("grp", "block", "start", "copies", "total", "digest", "suffix", "peak", "of")
                .mapInArrow(_named, "grp string, block bigint, suffix string, peak string"))
    proofs = _delivered(tables[0], swept_down(tables, given)).mapInArrow(_proofs, _ddl(_OUT))
    return proofs.select("grp", "id", "leaf", F.col("peak").alias("subroot"), root.alias("root"), "proof", "proof_sha256",
                         F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of the subroots, each under its group, as the one block of that group's last table."""
    for (_, block), rows in _blocks(batches):
        sweep, of = _swept(block, rows)
        found = sweep.suffixes(rows[0]["suffix"])
        yield pa.RecordBatch.from_arrays([pa.array([r["of"] for r in of], pa.string()), pa.array([0] * len(of), pa.int64()),
                                          pa.array(found, pa.string()), pa.array([r["digest"] for r in of], pa.string())], schema=_DOWN)


def digest(documents: DataFrame) -> DataFrame:
    """The manifest of documents per language, where each row whose id's crc32 3 divides is verified against a tampered text."""
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    return manifest(leaves(documents, tampered)).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256",
                                                        "folded_root", "verified")
