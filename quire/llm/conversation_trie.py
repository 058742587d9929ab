"""Prefix trie of conversations from adaptive radix trees over turn ids.

A turn becomes an id of fixed width: 16 bytes of a digest of its role and text, then the
text's byte length, big-endian. A conversation is the bytes of its turns' ids, so turns
are compared byte by byte and a node of the trie is a path of whole ids. Equal
conversations are one key with a count.

Every task puts its keys into adaptive radix trees: nodes of 4, 16, 48 or 256 children
that grow when full, with compressed paths. A tree is walked once, children first, and
only depths that are whole turns give nodes; a compressed path gives one at each whole
turn on it. A tree that outgrows its share of memory is handed on and a new one begun.

Any division of keys into trees is right, as the trees are then merged by node. A node
that one tree reports is complete: all its members, and so all below it, are in that
tree. The others, which are few if keys come in order, form the top of the trie; what
lies below them is added up along its paths by doubling, a logarithm of the depth in
rounds. Node ids are digests of paths, so no path travels.

The digest of a node's own ends is one hash over its members' ids in order. Ids are
sorted and written out in ranges, however many end in one node; only the hash itself
runs over a node's ranges one after the other, as a stream.

Rows: null roles and texts are empty; turns are ordered by number, null first, and equal
numbers by digest; rows without a conversation id belong to none and are left out; rows
that repeat a turn count as another turn; an empty table has no nodes, not even a root;
``c % 5`` and the order of ids also hold below zero, where the remainder is that of a
floor; other columns are not read. A conversation's ids (not its texts) stand in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import prepared
from quire.session import stage_table

#: Bytes of a turn's digest and of its text's length.
DIGEST, LENGTH = 16, 8
WIDTH = DIGEST + LENGTH
#: Bytes of keys in a tree before it is handed on.
TREE_BYTES = 1 << 26
#: Turns of a key that place it in the order of tasks; bounds what Spark samples.
PLACED = 32
#: Conversation ids in a range of a node's ends.
RANGE = 1 << 14
FAMILY, TURNS = 5, 9
NODE = "node binary, parent binary, depth long, n_convs long, conv_id long, n_bytes long, n_children long, n_leaves long, saved_tokens long"


class Node:
    """A compressed path, up to 4, 16, 48 or 256 children by byte, and the conversations that end after the path.

    The two small layouts keep sorted bytes beside the children, the third a table from
    byte to place, the largest a place per byte.
    """

    __slots__ = ("path", "kind", "bytes", "children", "count", "first")

    def __init__(self, path: bytes):
        self.path, self.kind = path, 4
        self.bytes: bytearray | None = bytearray()
        self.children: list[Node | None] = []
        self.count, self.first = 0, 0

    def child(self, byte: int) -> Node | None:
        if self.kind <= 16:
            at = self.bytes.find(byte)
            return self.children[at] if at >= 0 else None
        if self.kind == 48:
            at = self.bytes[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def replace(self, byte: int, node: Node) -> None:
        if self.kind <= 16:
            self.children[self.bytes.find(byte)] = node
        elif self.kind == 48:
            self.children[self.bytes[byte] - 1] = node
        else:
            self.children[byte] = node

    def add(self, byte: int, node: Node) -> None:
        """Add a child for a byte that has none."""
        if self.kind < 256 and len(self.children) == self.kind:
            self._grow()
        if self.kind <= 16:
            at = sum(b < byte for b in self.bytes)
            self.bytes.insert(at, byte)
            self.children.insert(at, node)
        elif self.kind == 48:
            self.children.append(node)
            self.bytes[byte] = len(self.children)
        else:
            self.children[byte] = node

    def _grow(self) -> None:
        if self.kind == 4:
            self.kind = 16
        elif self.kind == 16:
            places = bytearray(256)
            for at, b in enumerate(self.bytes):
                places[b] = at + 1
            self.kind, self.bytes = 48, places
        else:
            children: list[Node | None] = [None] * 256
            for b, at in enumerate(self.bytes):
                if at:
                    children[b] = self.children[at - 1]
            self.kind, self.bytes, self.children = 256, None, children

    def each(self) -> list[Node]:
        return [c for c in self.children if c is not None]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    diff = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (diff.bit_length() + 7) // 8


class Tree:
    """An adaptive radix tree of keys, each with a count and its smallest conversation."""

    def __init__(self):
        self.root = Node(b"")
        self.bytes = 0

    def insert(self, key: bytes, count: int, first: int) -> None:
        self.bytes += len(key)
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.first = min(node.first, first) if node.count else first
                node.count += count
                return
            byte = key[at]
            child = node.child(byte)
            if child is None:
                leaf = Node(key[at:])
                leaf.count, leaf.first = count, first
                node.add(byte, leaf)
                return
            shared = common_prefix(child.path, key[at : at + len(child.path)])
            if shared < len(child.path):
                # The path forks, or the key ends on it: a new node takes its first part.
                upper = Node(child.path[:shared])
                node.replace(byte, upper)
                child.path = child.path[shared:]
                upper.add(child.path[0], child)
                child = upper
            node, at = child, at + shared

    def nodes(self) -> Iterator[tuple]:
        """The trie's nodes as far as this tree knows them, as rows of ``NODE``; children come before their parents."""
        # Going down, each tree node learns the whole turns on its path: (digest of the path so far, text length).
        start = hashlib.sha256()
        stack: list[tuple] = [(self.root, 0, start, b"", [(start.digest()[:DIGEST], None, 0)], False)]
        done: list[tuple[int, int, int, int, int]] = []
        while stack:
            node, depth, digest, part, turns, back = stack.pop()
            if not back:
                stack.append((node, depth, digest, part, turns, True))
                for child in node.each():
                    run, own, above = part + child.path, [], turns[-1][0] if turns else None
                    d, walked = digest, 0
                    while len(run) - walked >= WIDTH:
                        turn = run[walked : walked + WIDTH]
                        d = d.copy()
                        d.update(turn)
                        own.append((d.digest()[:DIGEST], above, int.from_bytes(turn[DIGEST:], "big")))
                        above, walked = own[-1][0], walked + WIDTH
                    # Between whole turns the last digest is carried in an empty list's stead.
                    stack.append((child, depth + len(own), d, run[walked:], own or [(above, None, -1)], False))
                continue
            below = [done.pop() for _ in node.each()]
            n = node.count + sum(b[0] for b in below)
            first = min([node.first] * (node.count > 0) + [b[1] for b in below], default=0)
            children, leaves, saved = (sum(b[k] for b in below) for k in (2, 3, 4))
            at = depth
            for digest_, above, size in reversed(turns if turns[0][2] >= 0 else []):
                leaves += children == 0
                saved += (n - 1) * size
                yield digest_, above, at, n, first, size, children, leaves, saved
                children, at = 1, at - 1
            done.append((n, first, children, leaves, saved))


def _nodes(batches: Iterator[pa.RecordBatch], tree_bytes: int) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in NODE.split(", ")]
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7]

    def table(tree: Tree) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in tree.nodes():
            rows.append(row)
            if len(rows) == RANGE:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    tree, held = Tree(), 0
    for b in batches:
        for key, n, first in zip(*(b.column(c).to_pylist() for c in ("key", "n", "first")), strict=True):
            tree.insert(key, n, first)
            held += 1
            if tree.bytes > tree_bytes:
                yield from table(tree)
                tree, held = Tree(), 0
    if held:
        yield from table(tree)


def turn_id() -> Column:
    """Digest of role and text, then the text's length; in hexadecimal digits."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The role's length keeps role and text apart.
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(whole, 256), 1, 2 * DIGEST), F.lpad(F.lower(F.hex(F.octet_length(text).cast("long"))), 2 * LENGTH, "0"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``(conv_id, key)`` of every conversation of ``turns`` (conv_id, turn, role, text), its first turns those of its family's head."""
    slim = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", turn_id().alias("id")).alias("t"))
    # A null number sorts first.
    own = slim.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"))["id"].alias("ids"))
    head = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(FAMILY))
    own = stage_table(own.select("conv_id", "ids", head.alias("head"), (F.crc32(F.col("conv_id").cast("string")) % TURNS).cast("int").alias("h")), "conversations")
    heads = own.where("conv_id = head").select("head", F.slice("ids", 1, TURNS - 1).alias("given"))
    # At most five conversations meet a head.
    both = own.join(heads, "head", "left")
    given = F.when(F.col("h") > 0, F.slice(F.coalesce("given", F.array().cast("array<string>")), F.lit(1), F.greatest("h", F.lit(1))))
    rest = F.slice("ids", F.col("h") + 1, F.greatest(F.size("ids"), F.lit(1)))
    ids = F.concat(F.coalesce(given, F.array().cast("array<string>")), rest)
    return both.select("conv_id", F.unhex(F.array_join(ids, "")).alias("key"))


def node_of(key: Column) -> Column:
    """The id of the node where a key ends."""
    return F.unhex(F.substring(F.sha2(key, 256), 1, 2 * DIGEST))


def tree_nodes(keys: DataFrame, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """Rows of ``NODE`` of all trees over ``keys`` (key, n, first; distinct)."""
    placed = keys.withColumn("place", F.substring("key", 1, PLACED * WIDTH)).withColumn("spread", F.xxhash64("key"))
    return placed.repartitionByRange("place", "spread").select("key", "n", "first").mapInArrow(lambda batches: _nodes(batches, tree_bytes), NODE)


def top_sums(top: DataFrame) -> DataFrame:
    """``(node, n_leaves, saved_tokens)`` of every row of ``top`` (node, parent, own_leaves, own_saved), summed over what is below."""
    sums = stage_table(top.select("node", F.col("parent").alias("up"), F.col("own_leaves").alias("n_leaves"), F.col("own_saved").alias("saved_tokens")), "sums")
    while True:
        # ``up`` is so many levels above as rounds so far allow; what has none is done.
        reaching = sums.where("up is not null")
        if reaching.isEmpty():
            return sums.select("node", "n_leaves", "saved_tokens")
        more = reaching.groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        higher = sums.select(F.col("node").alias("up"), F.col("up").alias("higher"))
        joined = sums.join(more, "node", "left").join(higher, "up", "left")
        sums = stage_table(joined.select(
            "node", F.col("higher").alias("up"),
            (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
        ), "sums")


def _written(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Ids in order become ranges: ``(node, first, ids)`` with the ids' digits joined by commas."""
    names = ["node", "first", "ids"]
    node, ids = None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=names)

    for b in batches:
        for n, i in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if ids and (n != node or len(ids) == size):
                yield made()
                ids = []
            node = n
            ids.append(i)
    if ids:
        yield made()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node over its ranges, which come in order."""
    node, digest = None, None

    def made(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends_sha256"])

    for b in batches:
        rows = []
        nodes, ids = b.column("node"), b.column("ids")
        for r in range(b.num_rows):
            n = nodes[r].as_py()
            if n != node:
                if digest is not None:
                    rows.append((node, digest.hexdigest()))
                node, digest = n, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids[r].as_py().encode())
        yield made(rows)
    if digest is not None:
        yield made([(node, digest.hexdigest())])


def ends(convs: DataFrame, size: int = RANGE) -> DataFrame:
    """``(node, ends_sha256)`` of every node where conversations of ``convs`` (node, conv_id) end."""
    # Ranges cut a node with very many ends, so that its ids are sorted in many tasks.
    spread = convs.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    spread = spread.mapInArrow(lambda batches: _written(batches, size), "node binary, first long, ids string")
    return spread.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def conversation_trie(turns: DataFrame, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """A row per node of the trie of rebuilt conversations."""
    prepared(turns.sparkSession)
    convs = stage_table(rebuilt(turns), "rebuilt")
    keys = stage_table(convs.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("first")), "keys")
    parts = stage_table(tree_nodes(keys, tree_bytes), "trees")
    # Of a node in several trees the sums and the children are not known yet.
    alone = F.count("*") == 1
    merged = parts.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.first("n_bytes").alias("n_bytes"), *[F.when(alone, F.first(c)).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
    )
    merged = stage_table(merged, "nodes")
    complete, top = merged.where("n_leaves is not null"), merged.where("n_leaves is null")
    # What a top node has right below it: complete nodes with all that is in them, and other top nodes.
    below = merged.join(top.select(F.col("node").alias("parent")), "parent", "left_semi")
    below = below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    top = top.drop("n_children", "n_leaves", "saved_tokens").join(below, "node", "left")
    top = stage_table(top.select(
        "node", "parent", "depth", "n_convs", "conv_id", "n_bytes", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(F.coalesce("leaves", F.lit(0))).alias("own_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes") + F.coalesce("saved", F.lit(0))).alias("own_saved"),
    ), "top")
    nodes = complete.unionByName(top.join(top_sums(top), "node").select(complete.columns))
    # A node's parent has the node's conversation or a smaller one.
    named = nodes.join(merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    named = named.join(ends(convs.select(node_of(F.col("key")).alias("node"), "conv_id")), "node", "left")
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
