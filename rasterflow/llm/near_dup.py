"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets.

1. One pass over the texts gives each document its number of distinct five-word shingles,
   a 128-bit key of the set, the low four bits of its 128 minima, and 32 band keys, each of four whole
   minima. Two sets of similarity 0.75 share no band with probability (1 - 0.75^4)^32 = 5e-6.
2. Documents with equal sets become one class, which its smallest id stands for.
3. Bands with more than one class are candidates. First, the members of each band are compared
   with its smallest. A group of near copies so costs its size,
   not its square. Then what is left in bands of two or more components is compared in full: small bands by pairs, large ones by pairs of blocks, each one task's:
   first by signatures alone, which gives the members that have a possible partner outside their component; these are dealt again with their texts, and only links leave.
   So no candidate pair that could join two components is left out.
4. A pair is screened by its packed signatures: exclusive or and bit counts give the
   share of equal low bits, and (share - 1/16) / (1 - 1/16) estimates the similarity.
   Below SCREEN it is dropped, which is more than six standard deviations off for a pair of 0.75.
   All others are decided by their whole shingle sets.
5. Components come from the links by joins; see ``components``.

Shingles are compared by 64-bit hashes of their words.

6. Classes that hold texts of one id are linked too: a document is its id. ``row_component`` leaves these links out.

Defined cases: a null or empty text, or one of white space, has no shingle and is linked with
nothing; fewer than five words are one shingle; rows with the same id are one node, whatever their texts; a row
with a null id isn't linked, has a null component and is kept; repeated rows have a row each; very long texts are
read whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import materialize
from rasterflow.llm.components import components

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BITS = 4
SCREEN = 0.5
#: Members of a band up to which its pairs are taken one by one in the end; larger bands go by blocks.
SMALL_BAND = 32
BLOCK = 512
#: Shingles for each slice of a block's matrix.
MATRIX_COLUMNS = 4096
#: Words whose hashes a worker keeps, some 15 MB.
CACHE_WORDS = 100_000
#: Shingles hashed at once.
CHUNK = 1 << 16

#: At most this number of classes are joined by broadcast, those of the most rows, so that no task of a join has more than 1 / LARGE_CLASSES of all rows' share.
LARGE_CLASSES = 10_000
#: Rows of a table of components up to which it is broadcast.
BROADCAST_ROWS = 100_000
SIGNED = "doc_id bigint, text_mark bigint, n_shingles bigint, key_a bigint, key_b bigint, signature array<bigint>, bands array<bigint>"
KEYS = ["n_shingles", "key_a", "key_b"]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


_hashes = _Hashes()


def _mix(x, salt: int):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9 ^ salt)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS):
    """The sorted distinct hashes of a text's shingles."""
    import numpy as np

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n, by = len(found), np.uint64(0x9E3779B97F4A7C15)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, n)
    if n < words:
        total = np.full(min(n, 1), n, np.uint64)
        for x in h:
            total = total * by + x
    else:
        total = np.zeros(n - words + 1, np.uint64)
        for k in range(words):
            total = total * by + h[k : n - words + 1 + k]
    return np.unique(_mix(total, 0))


@functools.lru_cache(maxsize=1)
def _functions():
    import numpy as np

    random = np.random.default_rng(20240607)
    return random.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), random.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def minima(sets):
    """For each non-empty set of shingle hashes, the least value of each hash function."""
    import numpy as np

    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint32)
    for k, (a, b) in enumerate(zip(*_functions())):
        out[:, k] = np.minimum.reduceat(x * a + b, starts)
    return out


def band_keys(least):
    import numpy as np

    rows = least.astype(np.uint64).reshape(len(least), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93) + np.zeros((len(least), 1), np.uint64)
    for k in range(ROWS):
        key = _mix(key + rows[:, :, k], 0)
    return key.view(np.int64)


def pack_low_bits(least):
    import numpy as np

    low = (least & np.uint32(15)).astype(np.uint64).reshape(len(least), -1, 16)
    return np.bitwise_or.reduce(low << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def _sign(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ids, at, texts, marks = batch.column(0), 0, batch.column(1), batch.column(2)
        while at < len(texts):
            sets, size, begin = [], 0, at
            while at < len(texts) and (size < CHUNK or not sets):
                sets.append(shingles(texts[at].as_py()))
                size += len(sets[-1])
                at += 1
            full = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
            n = np.array([len(s) for s in sets], np.int64)
            keys, widths = np.zeros((2, len(sets)), np.uint64), np.where(n > 0, 1, 0)
            signature, bands = np.zeros((0, HASHES * BITS // 64), np.int64), np.zeros((0, BANDS), np.int64)
            if len(full):
                least = minima([sets[k] for k in full])
                signature, bands = pack_low_bits(least), band_keys(least)
                starts, every = np.cumsum([0, *n[full][:-1]]), np.concatenate([sets[k] for k in full])
                for row, salt in enumerate((0x5BF03635, 0x27D4EB2F)):
                    keys[row, full] = np.add.reduceat(_mix(every, salt << 8), starts)
            as_lists = lambda v: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(widths * v.shape[1])]), pa.int32()), pa.array(np.ascontiguousarray(v).reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids.slice(begin, at - begin), marks.slice(begin, at - begin), pa.array(n), *(pa.array(k.view(np.int64)) for k in keys), as_lists(signature), as_lists(bands)], ["doc_id", "text_mark", *KEYS, "signature", "bands"])


def text_mark(text: str) -> Column:
    """A 64-bit hash that tells texts of one id apart."""
    return F.xxhash64(text)


def signatures(docs: DataFrame) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text), as in SIGNED."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_mark("text").alias("mark")).mapInArrow(_sign, SIGNED)


def estimate(a: str, b: str) -> Column:
    """The similarity that two packed signatures suggest, corrected for chance collisions."""
    lanes = F.lit(0x1111111111111111).cast("long")

    def unequal(k: int) -> Column:
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(lanes))

    share = 1 - functools.reduce(add, [unequal(k) for k in range(HASHES * BITS // 64)]) / HASHES
    return (share - 1 / 2**BITS) / (1 - 1 / 2**BITS)


def _confirm(percent: int):
    def confirm(batches):
        import pyarrow as pa

        last, right = None, None
        for batch in batches:
            x, y, texts, others = (batch.column(k) for k in range(4))
            keep = []
            for k in range(batch.num_rows):
                if last is None or y[k].as_py() != last[0] or others[k] != last[1]:
                    last, right = (y[k].as_py(), others[k]), shingles(others[k].as_py())
                left = shingles(texts[k].as_py())
                common = _common(left, right)
                keep.append(100 * common >= percent * (len(left) + len(right) - common))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.filter(chosen), y.filter(chosen)], ["u", "v"])

    return confirm


def _common(left, right) -> int:
    import numpy as np

    if not len(left) or not len(right):
        return 0
    at = np.searchsorted(right, left)
    return int((right[np.minimum(at, len(right) - 1)] == left).sum())


def _links_of_blocks(percent: int):
    """Compares every node of block i with every one of block j; gives the links that join components."""

    def links(table):
        import numpy as np
        import pyarrow as pa

        nodes, start = table["node"].to_pylist(), table["component"].to_pylist()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        block = table["block"].to_numpy()
        rows, columns = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sets = [shingles(t.as_py()) for t in table["text"]]
        sizes = np.array([len(s) for s in sets])
        owner, (words, column, n) = np.repeat(np.arange(len(sets)), sizes), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        held = n[column] > 1  # a shingle of one node alone is common to no two
        owner, column = owner[held], np.cumsum(n > 1)[column[held]] - 1
        common = np.zeros((len(rows), len(columns)), np.float32)
        by_column = np.argsort(column, kind="stable")
        owner, column = owner[by_column], column[by_column]
        for low in range(0, int((n > 1).sum()), MATRIX_COLUMNS):
            part = slice(*np.searchsorted(column, [low, low + MATRIX_COLUMNS]))
            bits = np.zeros((len(sets), MATRIX_COLUMNS), np.float32)
            bits[owner[part], column[part] - low] = 1
            common += bits[rows] @ bits[columns].T
        union = sizes[rows][:, None] + sizes[columns][None] - common
        root = {c: c for c in start}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        u, v = [], []
        for a, b in zip(*np.nonzero(100.0 * common >= percent * union)):
            a, b = int(rows[a]), int(columns[b])
            x, y = find(start[a]), find(start[b])
            if x != y:
                root[max(x, y)] = min(x, y)
                u.append(nodes[a])
                v.append(nodes[b])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return links


def _possible(table):
    """Compares block i's signatures with block j's: the nodes with a possible partner in another component."""
    import numpy as np
    import pyarrow as pa

    nodes, start = table["node"].to_numpy(), table["component"].to_numpy()
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    block = table["block"].to_numpy()
    lanes = table["signature"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(nodes), -1)
    rows, columns = np.flatnonzero(block == i), np.flatnonzero(block == j)
    unequal = np.zeros((len(rows), len(columns)), np.int32)
    for lane in lanes.T:
        x = lane[rows][:, None] ^ lane[columns][None]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        unequal += np.bitwise_count(x & np.uint64(0x1111111111111111))
    share = 1 - unequal / HASHES
    fits = ((share - 1 / 2**BITS) / (1 - 1 / 2**BITS) >= SCREEN) & (start[rows][:, None] != start[columns][None])
    found = np.unique(np.concatenate([nodes[rows[fits.any(axis=1)]], nodes[columns[fits.any(axis=0)]]]))
    return pa.table({"node": pa.array(found, pa.int64())})


class _Graph:
    """Candidate bands of the classes, and the components found so far."""

    def __init__(self, signed: DataFrame, docs: DataFrame, percent: int):
        self.percent, self.component = percent, None
        full = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        classes = full.groupBy(*KEYS).agg(F.min(F.struct("doc_id", "signature", "bands")).alias("first"), F.count(F.lit(1)).alias("n_rows"))
        first = materialize(classes.select(*KEYS, "n_rows", F.col("first.doc_id").alias("node"), "first.signature", "first.bands"), "classes")
        self.classes = first.select(*KEYS, "n_rows", "node")
        bands = first.select("node", "signature", F.explode("bands").alias("band"))
        shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
        self.members = materialize(bands.join(shared, "band"), "bands")
        nodes = self.members.select("node").distinct()
        self.texts = materialize(docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").join(nodes, "node", "left_semi"), "texts")

    def star(self) -> None:
        """Links the members of each band with its smallest node."""
        centre = self.members.groupBy("band").agg(F.min(F.struct("node", "signature")).alias("c"))
        pairs = self.members.join(centre, "band").where(F.col("node") > F.col("c.node"))
        self.link(pairs.select(F.col("node").alias("u"), F.col("c.node").alias("v"), F.col("signature").alias("u_signature"), F.col("c.signature").alias("v_signature")))

    def rest(self) -> None:
        """Compares what is left in bands of two components: small bands by pairs, large ones in blocks."""
        placed = self.members.join(self.component.withColumnRenamed("component", "low"), "node", "left").select("band", "node", "signature", F.coalesce("low", "node").alias("component"))
        span = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("v"), F.count(F.lit(1)).alias("size"))
        split = materialize(placed.join(span.where(F.col("low") < F.col("high")), "band").select("band", "node", "signature", "component", "v", "size"), "open")
        small = split.where(F.col("size") <= SMALL_BAND)
        u, v = (small.select("band", F.col("node").alias(x), F.col("signature").alias(f"{x}_signature"), F.col("component").alias(f"{x}_component")) for x in "uv")
        pairs = u.join(v, "band").where((F.col("u") > F.col("v")) & (F.col("u_component") != F.col("v_component")))
        self.link(pairs.select("u", "v", "u_signature", "v_signature"), self.blocks(split.where(F.col("size") > SMALL_BAND)))

    def blocks(self, open_members: DataFrame) -> DataFrame:
        """All links between components among the nodes that large bands join, a few of each.

        Nodes that such bands join directly or in turn are one cluster. Each cluster is cut
        into blocks of about BLOCK nodes, and each pair of blocks is one task's
        group: whole shingle sets are compared there and only links leave it.
        """
        cluster = components(open_members.where(F.col("node") != F.col("v")).select(F.col("node").alias("u"), "v")).withColumnRenamed("component", "cluster")
        nodes = open_members.groupBy("node").agg(F.first("component").alias("component"), F.first("signature").alias("signature")).join(cluster, "node", "left")
        nodes = materialize(nodes.withColumn("cluster", F.coalesce("cluster", "node")), "clusters")
        possible = self.dealt(nodes).groupBy("cluster", "i", "j").applyInArrow(_possible, "node bigint").distinct()
        left = nodes.drop("signature").join(materialize(possible, "possible"), "node", "left_semi").join(self.texts, "node")
        return self.dealt(left).groupBy("cluster", "i", "j").applyInArrow(_links_of_blocks(self.percent), "u bigint, v bigint")

    @staticmethod
    def dealt(nodes: DataFrame) -> DataFrame:
        """The nodes of each cluster for each pair of its blocks (i, j) that they belong to."""
        count = nodes.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
        blocks = nodes.join(count, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
        blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        return blocks.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("k", "other")

    def link(self, pairs: DataFrame, known: DataFrame | None = None) -> None:
        """Joins the components of the pairs (u, v, signatures) that are confirmed, and of links known."""
        near = pairs.where(estimate("u_signature", "v_signature") >= SCREEN).select("u", "v").distinct()
        near = near.join(self.texts.toDF("u", "u_text"), "u").join(self.texts.toDF("v", "v_text"), "v").select("u", "v", "u_text", "v_text")
        links = near.mapInArrow(_confirm(self.percent), "u bigint, v bigint")
        for more in (known, self.component):
            if more is not None:
                links = links.unionAll(more.toDF("u", "v"))
        self.component = components(links)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept.

    ``by_row`` adds text_mark, which with doc_id tells rows apart, and row_component: the smallest id that the row's
    text reaches by links between texts, where an id with several texts doesn't join them.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(rows), "signed")
    graph = _Graph(signed, rows, percent)
    graph.star()
    graph.rest()
    low = graph.classes.join(graph.component, "node", "left").select(*KEYS, "n_rows", F.coalesce("component", "node").alias("low"))
    low = materialize(low, "class-components")
    known = ["doc_id", "text_mark", "n_shingles"]
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    # classes of very many rows - at most LARGE_CLASSES of them - meet their rows by broadcast, so no task has a whole class
    share = max(1, signed.count() // LARGE_CLASSES)
    large = low.where(F.col("n_rows") > share)
    placed = signed.where(linked).select("doc_id", "text_mark", *KEYS)
    near = placed.join(F.broadcast(large.drop("n_rows")), KEYS).select(*known, "low")
    if not large.isEmpty():
        placed = placed.join(F.broadcast(large.select(*KEYS)), KEYS, "left_anti")
    near = near.unionAll(placed.join(low.where(F.col("n_rows") <= share).drop("n_rows"), KEYS).select(*known, "low"))
    alone = signed.where(~linked).select(*known, F.col("doc_id").alias("low"))
    found = materialize(near.unionAll(alone), "rows")
    # ids in several components: these are one
    several = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("low").alias("least"), F.max("low").alias("most")).where(F.col("least") < F.col("most"))
    several = materialize(several.select("doc_id"), "ids")
    if several.isEmpty():
        found = found.withColumn("component_id", F.col("low"))
    else:
        ties = found.join(several, "doc_id").select(F.col("doc_id").alias("u"), F.col("low").alias("v"))
        joined = materialize(components(ties), "joined")
        of_low, of_id = joined.select(F.col("node").alias("low"), F.col("component").alias("_low")), joined.select(F.col("node").alias("doc_id"), F.col("component").alias("_id"))
        few = F.broadcast if joined.count() <= BROADCAST_ROWS else (lambda df: df)
        found = found.join(few(of_low), "low", "left").join(few(of_id), "doc_id", "left").withColumn("component_id", F.coalesce("_low", "_id", "low"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    more = ["text_mark", F.col("low").alias("row_component")] if by_row else []
    return found.select("doc_id", "n_shingles", "component_id", kept, *more)
