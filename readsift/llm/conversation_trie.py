"""Prefix trie of conversations (operator 11).

Each conversation is one array of turns: a path of 16 octets a turn (SHA-256 of role and text, cut to
128 bits) and the octets of each text. Paths are range-sorted globally; a partition walks its sorted
paths, computes the longest common prefix (LCP) of each with the one before, and sweeps a stack over
the LCP intervals: a path closes the nodes deeper than its LCP and opens those below it. A node's
members lie side by side, so one pass sees each node once.

Stitching. Only nodes on the path of a partition's first row, and those still open after its last,
can have members in other partitions. These spines leave as fragments, with what the partition alone
knows of them; nothing of theirs is summed into their parents yet. Fragments are few (two paths a
partition) and are grouped by depth and prefix; what a stitched node adds to the nodes above it is
summed along one spine that holds it. All of that are joins and windows of fragments: no driver, no
task that sees all partitions, and a prefix that a third of all conversations share is a fragment in
each of its partitions. Equal paths are told apart by conv_id in the sort, so copies of one
conversation spread over partitions too. The list of conversations that end at one node is hashed
in place; only lists at the edges of partitions are passed on, in pieces, and streamed in order
through one hash each, which is serial by nature but holds no list.

A conversation is one value: some 40 octets a turn meet in one row. A partition holds its nodes while
it runs (some 100 octets each), so partitions are made for ``TURNS`` turns.

Defined results: ties of a turn number follow the turns' digests; repeated turns stay, each in its
place; rows with a null conv_id are left out; null role or text counts as empty; an empty table has
no nodes, not even a root; other columns are ignored. ``c - c % 5`` is 0 for -4 to 4, as in SQL.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

WIDTH = 16
#: Turns of one range partition.
TURNS = 250_000
#: Conversations of one piece of a list that leaves its partition.
PIECE = 4096
#: A conversation takes its first ``hash(id) % LENGTHS`` turns from the one at the next lower multiple of ``STEP``.
STEP, LENGTHS = 5, 9

_NODE, _PART, _ENDS = 0, 1, 2
_ROW = "kind int, pid int, idx long, side int, first boolean, key binary, above binary, up long, conv_id long, parent_conv_id long, depth long, bytes long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, at long"
_LONGS = ("conv_id", "depth", "bytes", "n_convs", "n_children", "n_leaves", "saved_tokens")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as structs of digest and octets."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("t"), digest.alias("d"), F.octet_length(text).cast("long").alias("n")).alias("x"))
    # Structs sort field by field, nulls first.
    return t.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["d"].alias("d"), x["n"].alias("n"))).alias("turns"))


def rebuilt(convs: DataFrame, step: int = STEP, lengths: int = LENGTHS) -> DataFrame:
    """Conversations whose first turns come from the one at the next lower multiple of ``step``."""
    h = (F.crc32(F.col("conv_id").cast("string")) % lengths).cast("int")
    base = convs.where(F.col("conv_id") % step == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, lengths - 1).alias("head"))
    d = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % step).join(base, "base", "left")
    none = F.array().cast(convs.schema["turns"].dataType)
    own = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(1)))).otherwise(none)
    return d.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), own).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns of the longest common prefix, by bisection over whole comparisons."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


class Sweep:
    """The nodes of one partition's sorted paths; node 0 is the root, and parents come before children."""

    def __init__(self):
        self.of = {c: array("q") for c in (*_LONGS, "up")}
        self.ends: dict[int, bytes] = {}
        self.stack: list[int] = []
        self.path, self.rows, self.spine = b"", 0, 0
        self.run, self.runs, self.held = array("q"), 0, []

    def _open(self, depth: int, octets: int) -> None:
        up = self.stack[-1] if self.stack else -1
        self.stack.append(len(self.of["up"]))
        for c, v in (("up", up), ("conv_id", 2**63 - 1), ("depth", depth), ("bytes", octets), ("n_convs", 0), ("n_children", 0), ("n_leaves", 0), ("saved_tokens", 0)):
            self.of[c].append(v)

    def _close(self, whole: bool) -> None:
        """Take the top off the stack; a whole node has all its members here and counts for the one above it."""
        i, o = self.stack.pop(), self.of
        p = o["up"][i]
        if p >= 0:
            o["n_convs"][p] += o["n_convs"][i]
            o["conv_id"][p] = min(o["conv_id"][p], o["conv_id"][i])
        if whole:
            o["n_leaves"][i] += o["n_children"][i] == 0
            o["saved_tokens"][i] += (o["n_convs"][i] - 1) * o["bytes"][i]
            o["n_children"][p] += 1
            o["n_leaves"][p] += o["n_leaves"][i]
            o["saved_tokens"][p] += o["saved_tokens"][i]

    def _end_run(self, last: bool) -> None:
        """The conversations of equal paths are complete unless they touch an edge of the partition."""
        if not self.run:
            return
        self.runs += 1
        if last or self.runs == 1:
            self.held.append((self.stack[-1], self.run))
        else:
            self.ends[self.stack[-1]] = hashlib.sha256(",".join(map(str, self.run)).encode()).digest()
        self.run = array("q")

    def add(self, conv: int, path: bytes, octets: list[int]) -> None:
        if not self.rows:
            self._open(0, 0)
        same = common_turns(self.path, path)
        if self.rows and path != self.path:
            self._end_run(False)
        while len(self.stack) - 1 > same:
            self._close(self.stack[-1] > self.spine)
        for d in range(same, len(path) // WIDTH):
            self._open(d + 1, octets[d])
        if not self.rows:
            self.spine = self.stack[-1]
        top = self.stack[-1]
        self.of["n_convs"][top] += 1
        self.of["conv_id"][top] = min(self.of["conv_id"][top], conv)
        self.run.append(conv)
        self.path, self.rows = path, self.rows + 1

    def finish(self) -> list[int]:
        """Close what is open; returns the spine of the last path, root first."""
        self._end_run(True)
        right = self.stack[:]
        while self.stack:
            self._close(False)
        return right


def _spine_keys(path: bytes) -> list[bytes]:
    """A key of each prefix of a path, the empty one first."""
    h, out = hashlib.sha256(), [b""]
    for at in range(0, len(path), WIDTH):
        h.update(path[at : at + WIDTH])
        out.append(h.copy().digest()[:WIDTH])
    return out


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, path, octets) come sorted by path and conv_id; out come nodes, fragments and lists."""
    from pyspark import TaskContext

    pid, s, first = TaskContext.get().partitionId(), Sweep(), b""
    for b in batches:
        for conv, path, octets in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if not s.rows:
                first = path
            s.add(conv, path, octets)
    if not s.rows:
        return
    last, right = s.path, s.finish()
    left = list(range(s.spine + 1))
    o = {c: np.frombuffer(v, np.int64) for c, v in s.of.items()}
    n = len(o["up"])
    open_ = np.zeros(n, bool)
    open_[left] = open_[right] = True
    empty = hashlib.sha256(b"").hexdigest()
    whole = np.flatnonzero(~open_)
    for at in range(0, len(whole), 8192):
        i = whole[at : at + 8192]
        up = o["up"][i]
        inside = ~open_[up]
        ends = [s.ends[k].hex() if k in s.ends else empty for k in i.tolist()]
        yield _rows(len(i), kind=_NODE, pid=pid, idx=i, up=pa.array(up, mask=inside), parent_conv_id=pa.array(o["conv_id"][up], mask=~inside), ends=ends, **{c: o[c][i] for c in _LONGS})
    keys = {}
    for side, (nodes, path) in enumerate(((left, first), (right, last))):
        k = _spine_keys(path)
        keys.update(zip(nodes, k))
        new = np.array([side == 0 or i > s.spine for i in nodes])  # nodes on both spines count once
        i = np.array(nodes)
        counts = {c: o[c][i] * new for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
        yield _rows(len(i), kind=_PART, pid=pid, idx=i, side=side, first=new, key=k, above=[None, *k[:-1]], conv_id=o["conv_id"][i], depth=o["depth"][i], bytes=o["bytes"][i], ends=[s.ends[k].hex() if k in s.ends else None for k in nodes], **counts)
    for i, run in s.held:
        for at in range(0, len(run), PIECE):
            yield _rows(1, kind=_ENDS, pid=pid, key=[keys[i]], depth=o["depth"][i : i + 1], ends=[",".join(map(str, run[at : at + PIECE]))], at=np.array(run[at : at + 1]))


def _rows(n: int, **cols) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    names, arrays = [], []
    for field in _ROW.split(", "):
        name, kind = field.split(" ")
        v = cols.get(name)
        names.append(name)
        if isinstance(v, int):
            v = np.full(n, v)
        arrays.append(pa.nulls(n, kinds[kind]) if v is None else v if isinstance(v, pa.Array) else pa.array(v, kinds[kind]))
    return pa.RecordBatch.from_arrays(arrays, names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces come sorted by (key, depth, at): one hash runs over those of each node."""
    now, h = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.binary()), pa.array([now[1]], pa.int64()), pa.array([h.hexdigest()])], ["key", "depth", "ends_sha256"])

    for b in batches:
        for key, depth, piece in zip(*(c.to_pylist() for c in b.columns)):
            if (key, depth) != now:
                if h is not None:
                    yield done()
                now, h = (key, depth), hashlib.sha256(piece.encode())
            else:
                h.update(b"," + piece.encode())
    if h is not None:
        yield done()


def trie(convs: DataFrame, turns: int = TURNS) -> DataFrame:
    """The nodes of (conv_id, turns): see the module's text for the columns' meaning.

    conv_id and depth name a node: the smallest member's first ``depth`` turns are its prefix.
    """
    spark = convs.sparkSession
    path = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["d"])), ""))
    d = cut(convs.select("conv_id", path.alias("path"), F.transform("turns", lambda x: x["n"]).alias("octets")), "paths")
    total = d.agg(F.sum(F.size("octets") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // turns + 1)
    rows = cut(d.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_sweep, _ROW), "sweep")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

    parts_ = rows.where(F.col("kind") == _PART)
    node = ["depth", "key"]
    mine = parts_.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.max("above").alias("above"), F.max("bytes").alias("bytes"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.min(F.struct("pid", "side")).alias("by"), F.max("ends").alias("ends"),
    )
    mine = cut(mine, "stitched")  # a row for each node on a spine
    kids = mine.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    mine = mine.join(kids, node, "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    mine = mine.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes"))
    mine = cut(mine.drop("more"), "counted")
    # Each node's own sums enter on one of its spines; on a spine, all nodes below are in the subtree.
    on = parts_.select("pid", "side", *node).join(mine.select(*node, "by", "n_leaves", "saved_tokens"), node)
    here = (F.col("by.pid") == F.col("pid")) & (F.col("by.side") == F.col("side"))
    deeper = Window.partitionBy("pid", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = on.select(*node, *[F.sum(F.when(here, F.col(c)).otherwise(0)).over(deeper).alias(c) for c in ("n_leaves", "saved_tokens")])
    sums = below.groupBy(*node).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    pieces = rows.where(F.col("kind") == _ENDS).select("key", "depth", "ends", "at")
    ends = pieces.repartition("key", "depth").sortWithinPartitions("key", "depth", "at").select("key", "depth", "ends").mapInArrow(_hashed, "key binary, depth long, ends_sha256 string")
    above = mine.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    edge = mine.drop("n_leaves", "saved_tokens", "by").join(sums, node).join(ends, node, "left").join(above, ["depth", "above"], "left")
    edge = edge.withColumn("ends_sha256", F.coalesce("ends_sha256", "ends", F.sha2(F.lit(""), 256))).select(*out)

    inner = rows.where(F.col("kind") == _NODE).withColumnRenamed("ends", "ends_sha256")
    ids = parts_.where("first").select("pid", F.col("idx").alias("up"), *node).join(mine.select(*node, F.col("conv_id").alias("found")), node).select("pid", "up", "found")
    hung = inner.where("up is not null").join(ids, ["pid", "up"]).withColumn("parent_conv_id", F.col("found")).select(*out)
    return inner.where("up is null").select(*out).unionByName(hung).unionByName(edge)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(conversations(table(spark, sf_dir, "conversations"))))


_SQL = """
WITH RECURSIVE
bits AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) t(i))),
own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM own, bits),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM built),
pre AS (SELECT conv_id, depth, len(turns) AS n, md5(turns[1:depth]::VARCHAR) AS k, CASE WHEN depth > 0 THEN md5(turns[1:depth - 1]::VARCHAR) END AS up,
               CASE WHEN depth > 0 THEN strlen(turns[depth].t) ELSE 0 END AS bytes FROM steps),
node AS (
  SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM pre GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (depth, k)),
sub AS (
  -- a node counts for every prefix of its smallest member up to its own depth
  SELECT p.depth, p.k, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
  FROM full_ f JOIN pre p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY 1, 2)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, sub.n_leaves, sub.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sub USING (depth, k) LEFT JOIN full_ u ON u.depth = f.depth - 1 AND u.k = f.up
"""

QUERIES = {"op11_conversation_trie": op11_conversation_trie}
ORACLES = {"op11_conversation_trie": _SQL}
