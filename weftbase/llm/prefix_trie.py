"""Prefix trie of conversations from adaptive radix trees.

A turn's id is the MD5 of its role and text, ``WIDTH`` bytes, and a conversation's key its turns' ids one after the
other. Distinct keys are sorted over the cluster and cut into ranges; a task builds the radix tree of its range:
inner nodes of 4, 16, 48 or 256 places that grow as children come, with compressed paths. Only byte depths at turn
borders are nodes of the trie.

A node that keys of several ranges begin with gets a part from each: members, leaves and words of text add up,
since each range counts as new only what its neighbours' nearest keys don't begin with. All other nodes are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftbase.llm.scratch import keep

WIDTH = 16
#: Turns of a range's keys.
RANGE_TURNS = 400_000
#: Ids that are gathered at once for a list of conversations.
IDS = 16_384


class Leaf:
    """The end of a key: its path below the parent, and what is stored for it."""

    __slots__ = ("path", "value")

    def __init__(self, path: bytes, value: tuple) -> None:
        self.path, self.value = path, value


class Node:
    """An inner node. ``path``: the bytes from its parent to it. With 4 or 16 places, ``keys`` are the children's
    first bytes in order; with 48, an index of 256 places into ``kids``; with 256, ``kids`` stand at their byte."""

    __slots__ = ("path", "value", "places", "keys", "kids")

    def __init__(self, path: bytes) -> None:
        self.path, self.value, self.places, self.keys, self.kids = path, None, 4, bytearray(), []

    def child(self, byte: int) -> Leaf | Node | None:
        if self.places == 256:
            return self.kids[byte]
        if self.places == 48:
            return self.kids[self.keys[byte]] if self.keys[byte] != 255 else None
        at = self.keys.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, kid: Leaf | Node) -> None:
        """Set the child that begins with ``byte``; a full node grows."""
        if self.places == 256:
            self.kids[byte] = kid
        elif self.places == 48:
            if self.keys[byte] != 255:
                self.kids[self.keys[byte]] = kid
            elif len(self.kids) < 48:
                self.keys[byte] = len(self.kids)
                self.kids.append(kid)
            else:
                self.kids = [self.kids[i] if i != 255 else None for i in self.keys]
                self.places, self.keys = 256, bytearray()
                self.kids[byte] = kid
        elif (at := self.keys.find(byte)) >= 0:
            self.kids[at] = kid
        elif len(self.keys) < self.places:
            at = sum(k < byte for k in self.keys)
            self.keys.insert(at, byte)
            self.kids.insert(at, kid)
        elif self.places == 4:
            self.places = 16
            self.put(byte, kid)
        else:
            index = bytearray(b"\xff" * 256)
            for i, k in enumerate(self.keys):
                index[k] = i
            self.places, self.keys = 48, index
            self.put(byte, kid)

    def children(self) -> Iterator[Leaf | Node]:
        """In order of their first bytes."""
        if self.places == 48:
            return iter([self.kids[i] for i in self.keys if i != 255])
        return (kid for kid in self.kids if kid is not None)


def common(a: bytes, b: bytes) -> int:
    """Bytes that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Tree:
    """Keys with values; the root has no path."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, value: tuple) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.value = value
                return
            kid = node.child(key[at])
            if kid is None:
                node.put(key[at], Leaf(key[at:], value))
                return
            same = common(kid.path, key[at : at + len(kid.path)])
            if same < len(kid.path) or isinstance(kid, Leaf):
                split = Node(kid.path[:same])
                node.put(key[at], split)
                if same < len(kid.path):
                    kid.path = kid.path[same:]
                    split.put(kid.path[0], kid)
                else:
                    split.value = kid.value
                kid = split
            node, at = kid, at + same


def _nodes(keys: list[bytes], values: list[tuple[int, int, str]], sizes: dict[bytes, int], before: bytes | None, after: bytes | None) -> list[list]:
    """The trie's nodes of one range of sorted, distinct keys.

    ``values``: least member, members and name of each key; ``sizes``: bytes of each turn's text; ``before`` and
    ``after``: the nearest keys of other ranges. A row: MD5 of the node's path if it is not whole, of the parent's
    if that is not, depth, the parent's row, least member, members, new children, leaves, saved bytes, name of the
    key that ends here.
    """
    tree = Tree()
    for at, (key, value) in enumerate(zip(keys, values, strict=True)):
        tree.insert(key, (*value, at))
    first, last = keys[0], keys[-1]
    shared = [common(first, before) // WIDTH if before is not None else -1, common(last, after) // WIDTH if after is not None else -1]
    extended = after is not None and after.startswith(last)
    # node, byte depths of its top and bottom, how many bytes it shares with the first and the last key, parent
    order: list[tuple] = []
    stack: list[tuple] = [(tree.root, 0, 0, 0, -1)]
    while stack:
        node, top, on_first, on_last, parent = stack.pop()
        bottom = top + len(node.path)
        if on_first == top:
            on_first += common(first[top:bottom], node.path)
        if on_last == top:
            on_last += common(last[top:bottom], node.path)
        order.append((node, top, bottom, on_first, on_last, parent))
        if isinstance(node, Node):
            stack += [(kid, bottom, on_first, on_last, len(order) - 1) for kid in node.children()]
    names = [_names(first, shared[0]), _names(last, shared[1])]
    rows: list[list] = []
    least: list[int | None] = [None] * len(order)
    members, leaves, saved, tops = ([0] * len(order) for _ in range(4))  # tops: new nodes at the next turn border
    any_key = [-1] * len(order)
    below: list[list[int]] = [[] for _ in order]  # rows that have no parent yet
    for i in range(len(order) - 1, -1, -1):
        node, top, bottom, on_first, on_last, parent = order[i]
        ends = node.value
        if ends is not None:
            least[i] = ends[0] if least[i] is None else min(least[i], ends[0])
            members[i] += ends[1]
            any_key[i] = ends[3]
        for depth in range(bottom // WIDTH, top // WIDTH if i else -1, -1):
            end = depth * WIDTH
            here = ends if end == bottom else None
            old = end <= on_first and depth <= shared[0]
            if here is not None and not below[i] and not (extended and end == len(last) == on_last):
                leaves[i] += 1
            if depth:
                saved[i] += (members[i] - (not old)) * sizes[keys[any_key[i]][end - WIDTH : end]]
            name = names[0][depth] if old else names[1][depth] if end <= on_last and depth <= shared[1] else None
            if not depth:
                name = names[0][0]
            for r in below[i]:
                rows[r][1], rows[r][3] = name, len(rows)
            below[i] = [len(rows)]
            rows.append([name, None, depth, -1, least[i], members[i], tops[i], leaves[i], saved[i], here[2] if here is not None else None])
            tops[i] = int(not old)
        if i:
            least[parent] = least[i] if least[parent] is None else min(least[parent], least[i])
            members[parent] += members[i]
            leaves[parent] += leaves[i]
            saved[parent] += saved[i]
            tops[parent] += tops[i]
            any_key[parent] = any_key[i]
            below[parent] += below[i]
            below[i] = []
    return rows


def _names(key: bytes, turns: int) -> list[str]:
    """MD5 of the first 0, 1, .. ``turns`` turns."""
    made, own = [hashlib.md5(b"").hexdigest()], hashlib.md5()
    for i in range(turns):
        own.update(key[i * WIDTH : (i + 1) * WIDTH])
        made.append(own.copy().hexdigest())
    return made


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and ``turns``, array of (turn, id, size) in order of turn, null first; turns that tie are in order of
    their ids. A null role or text is empty; size: UTF-8 bytes of the text. Rows without conv_id are left out."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    made = F.struct("turn", F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.octet_length(text).cast("long").alias("size"))
    return conversations.filter("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(made)).alias("turns"))


def rebuilt(turns: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """conv_id and turns: the first h turns of conversation c - c % ``every`` (all if fewer, none if that is absent),
    then c's own after its first h; h = crc32(c in decimals) % (``most`` + 1)."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    heads = turns.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    both = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
    begin = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return both.select("conv_id", F.concat(begin, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def ending_ids(named: DataFrame) -> DataFrame:
    """key and sha256 of the conversations (conv_id, key) of each key: their ids in decimals, ascending, joined by
    commas. Ids are gathered in pieces of at most IDS, and each key's pieces are hashed one after the other."""
    pieces = named.groupBy("key", F.floor(F.col("conv_id") / IDS).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("key", "piece", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        now, made = None, hashlib.sha256()
        for batch in batches:
            keys, hashes = [], []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == now:
                    made.update(b",")
                else:
                    if now is not None:
                        keys.append(now)
                        hashes.append(made.hexdigest())
                    now, made = key, hashlib.sha256()
                made.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([made.hexdigest()])], ["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(run, "key string, ends_sha256 string")


ROWS = "node string, above string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, key string"


def prefix_trie(conversations: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """A row per node of the trie of conversations (conv_id, turns): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Members of a node are the conversations that begin with its turns, of which those without turns are members
    of the root only. n_leaves and saved_tokens are sums over the subtree: childless nodes, and (n_convs - 1) times
    the bytes of a node's last turn. ends_sha256 hashes the ids of the conversations that end at the node. Copies
    are merged before a tree is built. No conversation: no row. Memory of a task: the keys of one range of about
    ``range_turns`` turns, a conversation's own key being whole (WIDTH bytes a turn).
    """
    path = F.array_join(F.transform("turns", lambda t: t["id"]), "")
    named = conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes")).withColumn("key", F.md5(F.col("path")))
    named = keep(named, "paths")
    distinct = named.groupBy("key").agg(F.min("conv_id").alias("least"), F.count("*").alias("members"), F.any_value("path").alias("path"), F.any_value("sizes").alias("sizes"))
    n = named.agg(F.sum(F.size("sizes") + 1)).head()[0] or 0
    ranges = distinct.repartitionByRange(max(1, -(-n // range_turns)), "path").withColumn("range", F.spark_partition_id())
    ranges = keep(ranges, "ranges")
    ordered = Window.orderBy("range")
    # one row a range
    borders = ranges.groupBy("range").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    borders = borders.select(F.col("range").alias("of"), F.lag("high").over(ordered).alias("before"), F.lead("low").over(ordered).alias("after"))

    def build(own: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("path")
        keys = [bytes.fromhex(p) for p in own["path"]]
        sizes = {k[i * WIDTH : (i + 1) * WIDTH]: int(s) for k, row in zip(keys, own["sizes"], strict=True) for i, s in enumerate(row)}
        near = [bytes.fromhex(x) if isinstance(x, str) else None for x in (border["before"].iloc[0], border["after"].iloc[0])]
        rows = _nodes(keys, list(zip(own["least"].tolist(), own["members"].tolist(), own["key"], strict=True)), sizes, *near)
        made = [[r[0], r[1], r[2], r[4], rows[r[3]][4] if r[3] >= 0 else None, *r[5:]] for r in rows]
        out = pd.DataFrame(made, columns=[c.split()[0] for c in ROWS.split(", ")])
        return out.astype({"parent_conv_id": "Int64"})

    nodes = keep(ranges.groupBy("range").cogroup(borders.groupBy("of")).applyInPandas(build, ROWS), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = nodes.filter("node IS NOT NULL").groupBy("node").agg(F.max("above").alias("above"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("key").alias("key"))
    parts = keep(parts, "parts")
    parents = parts.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "key"]
    whole = nodes.filter("node IS NULL")
    inner = whole.filter("above IS NULL").select(*names)
    outer = whole.filter("above IS NOT NULL").drop("parent_conv_id").join(parents, "above").select(*names)
    made = inner.union(outer).union(parts.join(parents, "above", "left").select(*names))
    ends = ending_ids(named.select("conv_id", "key"))
    return made.join(ends, "key", "left").select(*names[:-1], F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
