"""Conversation prefix trie (operator 12) by Patricia construction.

Method. Each prefix of a conversation has a hash that grows with it, so equal
prefixes meet by grouping; a group is a node, known by its smallest member.
The nodes of a member are sorted by depth, and a run of nodes with the same
count of members is one compressed edge: only its last node, a branch, an end
or a leaf, becomes a point. Leaves and saved tokens are summed over the
compressed tree by pointer doubling. Unary nodes are then expanded from their
edge: leaves are the point's, saved tokens add the edge's suffix sum, which is
a difference of running word counts.

Scale. Nothing holds a conversation or a group of copies: turns are numbered,
and hashes and word counts run, over ranges of (conversation, turn), so one
that is cut by a range goes on from the range before (``running``; what is
broadcast is at most one row a range). Groups are combined before they are
shuffled; joins have a unique side, and Spark splits the other where it is
skewed. The ids that end at a node are hashed in order from pieces that ranges
of them make, so a group of copies is a few rows to its last task. The
compressed tree of depth n takes log2(n) rounds.

Defined results: rows without conv_id belong to no conversation. Turns are
ordered by ``turn``, null first; turns that tie, repeated rows among them, by
the SHA-256 of role and text (in UTF-8: role's bytes counted, a colon, role,
text). A null role or text is empty. A rebuilt conversation may be turnless:
it is a member of the root alone. Empty tables give no rows. Only the columns
named are read, so others cannot clash. Prefixes are told apart by two 64-bit
hashes over digests of their turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, release, table

#: Conversations share turns with the first of so many ids.
FAMILY = 20
#: At most one less than so many turns come from it.
SHARED = 4
NODE = ("depth", "a", "b")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, tuple], label: str) -> DataFrame:
    """``rows`` with running totals within each key; no key is held by one task.

    ``sums``: name -> (aggregate, how a total before joins one after it). Rows
    are dealt by ranges of (key, order). Each range has its own totals; a key
    that goes on from the range before adds what that has of it.
    """
    placed = materialize(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), label)
    ends = placed.groupBy("_range").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    cut = placed.join(F.broadcast(ends), "_range").where((F.col(key) == F.col("_lo")) | (F.col(key) == F.col("_hi")))
    totals = cut.groupBy(key, "_range").agg(*[agg.alias(n) for n, (agg, _) in sums.items()])
    earlier = Window.partitionBy(key).orderBy("_range")
    before = totals.select(key, "_range", *[agg_of_totals(n, f).over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_{n}") for n, (_, f) in sums.items()])
    first = next(iter(sums))
    here = Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select("*", *[agg.over(here).alias(n) for n, (agg, _) in sums.items()])
    met = local.join(F.broadcast(before.where(F.col(f"_{first}").isNotNull())), [key, "_range"], "left")
    return met.select(*rows.columns, *[joined(F.col(n), F.coalesce(f"_{n}", F.lit(0).cast("long")), f).alias(n) for n, (_, f) in sums.items()])


def agg_of_totals(name: str, how: str) -> Column:
    return F.sum(name) if how == "+" else F.bit_xor(name)


def joined(a: Column, b: Column, how: str) -> Column:
    return (a + b if how == "+" else a.bitwiseXOR(b)).cast("long")


def numbered_turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv, digest, words, i)``: the turns of each conversation from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long").alias("words"),
    )
    return running(rows, "conv", ["turn", "digest"], {"i": (F.count(F.lit(1)), "+")}, "turns").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: ``(conv, length)`` of all, and their turns ``(conv, depth, digest, words, length)``."""
    lengths = turns.groupBy("conv").agg(F.max("i").alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    own = lengths.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("head"))
    known = own.join(lengths.select(F.col("conv").alias("head"), F.col("n").alias("head_n")), "head", "left")
    shared = F.least("h", F.coalesce("head_n", F.lit(0).cast("long")))
    info = known.select("conv", "head", "h", shared.alias("k"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    info = materialize(info, "conversations")
    first = turns.where(F.col("i") < SHARED).withColumnRenamed("conv", "head")
    heads = info.where("k > 0").join(first, "head").where("i <= k").select("conv", F.col("i").alias("depth"), "digest", "words", "length")
    rest = turns.where(F.col("i") > h).join(info, "conv").select("conv", (F.col("k") + F.col("i") - F.col("h")).alias("depth"), "digest", "words", "length")
    return info.select("conv", "length"), heads.unionByName(rest)


def trie_nodes(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """``depth, a, b`` (the prefix), ``pa, pb`` (its parent), smallest member, members, words of the last turn and of all."""
    found = prefixes.groupBy(*NODE).agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.min("words").alias("words"), F.min("cum").alias("cum"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = lengths.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv")).where("n > 0")
    return found.unionByName(root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), "conv", "n", zero.alias("words"), zero.alias("cum")))


def compressed_edges(nodes: DataFrame) -> DataFrame:
    """One row an edge: ``conv, n``, its top node and its point, from sorted runs of nodes with the same members."""
    names = ["conv", "n", "top", "pa", "pb", "before", "depth", "a", "b", "cum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:  # an edge cut by a batch or a range is put together below
            if not x.num_rows:
                continue
            conv, n = x.column("conv").to_numpy(), x.column("n").to_numpy()
            new = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (n[1:] != n[:-1])))
            top, last = x.take(pa.array(new)), x.take(pa.array(np.append(new[1:], len(n)) - 1))
            before = pa.array(top.column("cum").to_numpy() - top.column("words").to_numpy())
            yield pa.RecordBatch.from_arrays([top.column("conv"), top.column("n"), top.column("depth"), top.column("pa"), top.column("pb"), before, *[last.column(c) for c in ("depth", "a", "b", "cum")]], names=names)

    chosen = nodes.select("conv", "depth", "n", "a", "b", "pa", "pb", "words", "cum").repartitionByRange("conv", "depth").sortWithinPartitions("conv", "depth")
    runs = chosen.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    whole = runs.groupBy("conv", "n").agg(F.min(F.struct("top", "pa", "pb", "before")).alias("t"), F.max(F.struct("depth", "a", "b", "cum")).alias("p"))
    return whole.select("conv", "n", "t.*", "p.*")


def tree_sums(edges: DataFrame) -> DataFrame:
    """Edges with ``up_conv`` (the parent point's), ``n_children``, ``n_leaves`` and ``below`` (saved tokens under the point).

    Pointer doubling: after round k a point has the sums of all points less
    than 2^k below it, and points to the one 2^k above it.
    """
    point = edges.select(F.col("depth").alias("d"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.struct("conv", "depth").alias("up"))
    linked = edges.withColumn("d", F.col("top") - 1).join(point, ["d", "pa", "pb"], "left")
    linked = materialize(linked.select("conv", "n", "top", "before", "depth", "a", "b", "cum", F.struct("conv", "depth").alias("id"), "up"), "edges")
    children = linked.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    full = linked.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    full = materialize(full.withColumn("own", (F.col("n") - 1) * (F.col("cum") - F.col("before"))), "points")
    state = full.select("id", "up", (F.col("n_children") == 0).cast("long").alias("leaves"), F.col("own").alias("saved"))
    last = None
    while not state.where("up is not null").isEmpty():
        below = state.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        hop = state.where("up is not null").select(F.col("id").alias("up"), F.col("up").alias("next"))
        met = state.join(below, "id", "left").join(hop, "up", "left")
        plus = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0).cast("long"))).alias(c)
        state = materialize(met.select("id", F.col("next").alias("up"), plus("leaves"), plus("saved")), "sums")
        if last is not None:
            release(last)
        last = state
    sums = state.select("id", F.col("leaves").alias("n_leaves"), "saved")
    found = full.join(sums, "id").select("conv", "n", "top", "depth", "a", "b", "cum", F.col("up.conv").alias("up_conv"), "n_children", "n_leaves", (F.col("saved") - F.col("own")).alias("below"))
    found = materialize(found, "tree")
    release(linked, full, *([last] if last is not None else []))
    return found


def end_digests(ends: DataFrame) -> DataFrame:
    """``depth, a, b, sha``: SHA-256 of the ids that end at a node, ascending, comma-joined.

    Ranges of sorted ids first become pieces of text, then one pass hashes
    the pieces of a node in order without holding them.
    """
    kind = "depth long, a long, b long, "

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            key = np.column_stack([x.column(c).to_numpy() for c in NODE])
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            conv = x.column("conv").to_pylist()
            text = [",".join(map(str, conv[lo:hi])) for lo, hi in zip(new, [*new[1:], len(conv)])]
            top = x.take(pa.array(new))
            yield pa.RecordBatch.from_arrays([*[top.column(c) for c in (*NODE, "conv")], pa.array(text, pa.string())], names=[*NODE, "conv", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for x in batches:
            out = []
            for *key, piece in zip(*[x.column(c).to_pylist() for c in (*NODE, "piece")]):
                if key == last:
                    sha.update(b"," + piece.encode())
                else:
                    if last:
                        out.append((*last, sha.hexdigest()))
                    last, sha = key, hashlib.sha256(piece.encode())
            yield packed(out)
        if last:
            yield packed([(*last, sha.hexdigest())])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=[*NODE, "sha"])

    sorted_ids = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
    cut = sorted_ids.mapInArrow(pieces, kind + "conv long, piece string")
    return cut.repartition(*NODE).sortWithinPartitions(*NODE, "conv").mapInArrow(hashed, kind + "sha string")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node of the trie of rebuilt conversations."""
    bounded_batches(conversations.sparkSession)
    turns = materialize(numbered_turns(conversations, id_col, turn_col, role_col, text_col), "numbered")
    lengths, rows = rebuilt(turns)
    lane = lambda n: F.bit_xor(F.xxhash64(F.lit(n), "digest", "depth"))
    prefixes = running(rows, "conv", ["depth"], {"cum": (F.sum("words"), "+"), "a": (lane(1), "^"), "b": (lane(2), "^")}, "rebuilt")
    own = lambda n: F.xxhash64(F.lit(n), "digest", "depth")
    prefixes = prefixes.select("conv", "depth", "length", "words", "cum", "a", "b", F.col("a").bitwiseXOR(own(1)).alias("pa"), F.col("b").bitwiseXOR(own(2)).alias("pb"))
    prefixes = materialize(prefixes, "prefixes")
    nodes = materialize(trie_nodes(prefixes, lengths), "nodes")
    tree = tree_sums(materialize(compressed_edges(nodes), "runs"))
    zero = F.lit(0).cast("long")
    ends = prefixes.where("depth = length").select(*NODE, "conv").unionByName(lengths.where("length = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv"))
    points = tree.join(end_digests(ends), list(NODE), "left").drop("a", "b").withColumnRenamed("depth", "last").withColumnRenamed("cum", "last_cum")
    at = F.col("depth") == F.col("last")
    return nodes.drop("a", "b", "pa", "pb").join(points, ["conv", "n"]).select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("top"), F.col("up_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(at, F.col("n_children")).otherwise(1).alias("n_children"),
        "n_leaves",
        (F.col("below") + (F.col("n") - 1) * (F.col("last_cum") - F.col("cum") + F.col("words"))).alias("saved_tokens"),
        F.when(at, F.coalesce("sha", F.lit(EMPTY_SHA))).otherwise(EMPTY_SHA).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all ``conversations``."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def plain_trie(rows: list[tuple]) -> list[tuple]:
    """Brute force for tests: (conv_id, turn, role, text) -> node rows, every node against every conversation."""
    import re
    import zlib

    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(head, [])[:h] + v[h:])
    members: dict[tuple, list] = {}
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], []).append(c)
    tokens = lambda k: len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
    out = []
    for k, v in members.items():
        under = [u for u in members if u[: len(k)] == k]
        out.append((
            v[0], len(k), members[k[:-1]][0] if k else None, len(v), sum(len(u) == len(k) + 1 for u in under), sum(not any(len(w) == len(u) + 1 and w[:-1] == u for w in under) for u in under),
            sum((len(members[u]) - 1) * tokens(u) for u in under), hashlib.sha256(",".join(str(c) for c in v if whole[c] == k).encode()).hexdigest(),
        ))
    return out


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(said)) AS ts FROM t GROUP BY conv_id
), h AS (
  SELECT conv_id, ts, conv_id - conv_id % 20 AS head, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(8 * length(conv_id::VARCHAR)), lambda k: (ascii(substring(conv_id::VARCHAR, k // 8 + 1, 1)) >> (k % 8)::INTEGER) & 1)),
    lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1))), 4294967295) % 4 AS h
  FROM o
), b AS (
  SELECT h.conv_id, list_concat(coalesce(o.ts[1 : h.h], []), h.ts[h.h + 1 :]) AS ts FROM h LEFT JOIN o ON o.conv_id = h.head
), p AS (
  SELECT conv_id, d, ts[1 : d] AS k, len(ts) = d AS ends FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM b)
), n AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends,
    (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].text, '[^\x20\x09-\x0D]+')) END) AS saved
  FROM p GROUP BY d, k
), c AS (SELECT d - 1 AS d, k[1 : d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2
), m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (d, k)
), up AS (SELECT u AS d, k[1 : u] AS k, sum((n_children = 0)::INTEGER) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS u FROM m) GROUP BY 1, 2)
SELECT m.conv_id, m.d::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN up USING (d, k) LEFT JOIN n q ON q.d = m.d - 1 AND q.k = m.k[1 : m.d - 1]
"""
