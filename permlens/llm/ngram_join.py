"""Operator 1: n-gram Jaccard join with signature trees.

A document is the set of its SHINGLE-word sequences; two documents link where 100 * intersection >= PERCENT * union. The result is exact.

1. Documents with equal sets become one node (combined before the shuffle, so copies of any number cost one row).
2. The top of the tree is spread over the cluster. The first level is the set size: linked sets lie in one or in neighbouring size classes.
   The second are parts of a set: sets of one class that link differ in at most k tokens, so of k + 1 + SPARE parts of the token space at
   least 1 + SPARE hold the same tokens in both. Sets that share no part are never brought together; what shares parts, directly or over
   others, forms a class of candidates. Only two numbers per set and part are shuffled.
   Where a part would hold too few tokens (`rare` candidates, for lower similarities) the second level are tokens instead: by any one order
   of all tokens, sets that link share s of the first n - ceil(PERCENT * n / 100) + s tokens of each, for any s. The order is rarest first,
   by the tokens' documents in a bounded sample, so passages that many documents quote come last; it decides the work and never the
   result. A set that shares fewer than s of them with sets near its size links with none and forms no class.
3. In a class the sets form a tree by size whose nodes hold the OR of the token bitmaps, the range of sizes and the largest number of
   tokens that share bits. A traversal of node pairs leaves out a pair whose sizes are too far apart, whose largest possible overlap
   (common bits plus shared ones) is too small, or whose sets are already connected. Pairs of sets that remain are compared token by token.
   A class beyond BLOCK_TOKENS is dealt to blocks by size class and hash, and pairs of blocks of equal or neighbouring size classes are
   joined in tasks of their own, so no task holds more than two blocks.
4. The links found (a spanning forest per task) are contracted to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permlens.llm import bloom
from permlens.llm.common import Out, WordNumbers, hidden, mix, packed_table, rows, sequence_hashes, text_of, words_of
from permlens.llm.components import components
from permlens.session import broadcast_if_small, written

SHINGLE = 3
PERCENT = 90
SPARE = 2
BLOCK_TOKENS = 1_000_000
LEAF, FAN = 32, 8
CHUNK_CHARS = 8 << 20
ORDER_DOCS = 4_000  # documents of the sample that the order of tokens is taken from, about
SHARED_PERCENT = 15  # of a set's size: tokens that linked sets are held to share, beyond one
ORDER_BITS = 24  # of a token's hash, by which they are counted
NODE = "decimal(20,0)"  # wider than an id
NODES = pa.decimal128(20, 0)
NULL_IDS = Decimal(2**63)  # beyond every id: nodes from here on are rows without one, by their text


class Sizes:
    """Size classes: the largest partner of a set lies in its own class or the next."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        bounds = [1]
        while bounds[-1] < 2**40:
            bounds.append(bounds[-1] * 100 // percent + 1)
        self.bounds = np.array(bounds, np.int64)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def parts(self, level: int) -> int:
        """Parts for pairs whose larger set is of this class; 0 where only equal sets link."""
        most = int(self.bounds[level + 1]) - 1
        differ = 2 * most * (100 - self.percent) // (100 + self.percent)
        return differ + 1 + SPARE if differ else 0


@lru_cache(maxsize=8)
def _sizes(percent: int) -> Sizes:
    return Sizes(percent)


def shingles(text: str | None, numbers: WordNumbers, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: A-Z lower-cased, words by ASCII white space; a shorter text is one sequence."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = numbers([w.lower() for w in words])  # bytes: A-Z only
    if len(words) < n:
        return mix(sequence_hashes(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(sequence_hashes(hashes, n))


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    import xxhash

    key = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def node_id(id_column: str, text_column: str) -> Column:
    by_text = F.xxhash64(text_of(text_column)).cast(NODE) + F.lit(Decimal(2**64))  # hashes from -2**63 on
    return F.coalesce(F.col(id_column).cast("long").cast(NODE), by_text.cast(NODE))


def part_signatures(tokens: np.ndarray, sizes: Sizes) -> np.ndarray:
    """One hash for every part that the set can share with a partner, for its own size class and the next."""
    level, found = sizes.of(len(tokens)), []
    mixed = mix(tokens + np.uint64(1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    for at in (level, level + 1):
        parts = sizes.parts(at)
        if not parts:
            continue
        of = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # ascending, as the tokens are
        edges = np.searchsorted(of, np.arange(parts + 1, dtype=np.uint64))
        count = np.diff(edges)
        content = sums[edges[1:]] - sums[edges[:-1]]
        name = mix(np.arange(parts, dtype=np.uint64) + np.uint64(at << 40))
        own = mix(content ^ name)
        full = count > 0
        found.append(own if parts - full.sum() > SPARE else own[full])  # with few empty parts, a shared one with tokens is left
    return np.concatenate(found) if found else np.empty(0, np.uint64)


# The tree


class Tree:
    """Sets in order of size under nodes of FAN children; leaves hold LEAF sets."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        self.size = np.array([len(s) for s in sets])
        self.map = np.zeros((len(sets), bits // 64), np.uint64)
        shift = np.uint64(64 - (bits.bit_length() - 1))
        for i, s in enumerate(sets):
            at = mix(s) >> shift
            np.bitwise_or.at(self.map[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.shared = self.size - np.bitwise_count(self.map).sum(1).astype(np.int64)
        low = np.arange(0, len(sets), LEAF)
        ends = np.append(low[1:], len(sets))
        level = [(int(a), int(b)) for a, b in zip(low, ends)]
        self.levels = [level]
        self.maps = [np.bitwise_or.reduceat(self.map, low)]
        self.least, self.most, self.extra = [np.minimum.reduceat(self.size, low)], [np.maximum.reduceat(self.size, low)], [np.maximum.reduceat(self.shared, low)]
        while len(level) > 1:
            at = np.arange(0, len(level), FAN)
            for values, combine in ((self.maps, np.bitwise_or), (self.least, np.minimum), (self.most, np.maximum), (self.extra, np.maximum)):
                values.append(combine.reduceat(values[-1], at))
            level = [(int(i), min(int(i) + FAN, len(level))) for i in at]
            self.levels.append(level)


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def tree_links(sets: list[np.ndarray], side: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect all sets that link, directly or over others, as a spanning forest. side: 0 for all, or 0 and 1 where only pairs of
    different sides are wanted (each side has been joined with itself elsewhere). Every size class has a tree of its own, and so have
    two neighbouring ones together, so that bitmaps are as wide as their sets need."""
    sizes, forest, links = _sizes(percent), Forest(len(sets)), []
    levels: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        if len(s):
            levels.setdefault(sizes.of(len(s)), []).append(i)
    apart = np.array(side) if len(set(side)) > 1 else None
    for level, own in sorted(levels.items()):
        if len(own) > 1:
            _join_tree(sets, own, None, apart, percent, forest, links)
        if above := levels.get(level + 1):
            _join_tree(sets, own + above, np.array([0] * len(own) + [1] * len(above)), apart, percent, forest, links)
    return links


def _join_tree(sets: list[np.ndarray], members: list[int], classes: np.ndarray | None, apart: np.ndarray | None, percent: int, forest: Forest, links: list[tuple[int, int]]) -> None:
    """Joins a tree of the members with itself and adds the links found. classes: where given, only pairs of different classes are wanted."""
    ranked = sorted(range(len(members)), key=lambda i: (len(sets[members[i]]), int(sets[members[i]][0])))
    order = [members[i] for i in ranked]
    own = [sets[i] for i in order]
    tree = Tree(own, 1 << max(9, (4 * len(own[-1])).bit_length()))
    kinds = [np.array([classes[i] for i in ranked])] if classes is not None else []
    if apart is not None:
        kinds.append(apart[order])
    need = lambda total: -(-percent * total // (100 + percent))  # noqa: E731  the least intersection that two sizes need
    one_root: list[dict[int, int]] = [{} for _ in tree.levels]
    split = int((kinds[0] == 0).sum()) if classes is not None else 0  # members are in order of size, so of class

    def uniform(level: int, node: int) -> int:
        """A set of the component that holds the whole node, or -1."""
        known = one_root[level].get(node)
        if known is not None:
            return forest.root(known)
        low, high = tree.levels[level][node]
        first = forest.root(order[low]) if level == 0 else uniform(level - 1, low)
        if first < 0:
            return -1
        for i in range(low + 1, high):
            if (forest.root(order[i]) if level == 0 else uniform(level - 1, i)) != first:
                return -1
        one_root[level][node] = first
        return first

    def leaves(a: int, b: int) -> None:
        (a0, a1), (b0, b1) = tree.levels[0][a], tree.levels[0][b]
        common = np.bitwise_count(tree.map[a0:a1, None] & tree.map[None, b0:b1]).sum(2, dtype=np.int64)
        common += np.minimum(tree.shared[a0:a1, None], tree.shared[None, b0:b1])
        possible = common * (100 + percent) >= percent * (tree.size[a0:a1, None] + tree.size[None, b0:b1])
        for kind in kinds:
            possible &= kind[a0:a1, None] != kind[None, b0:b1]
        for x, y in np.argwhere(possible).tolist():
            i, j = a0 + x, b0 + y
            if i >= j or (p := forest.root(order[i])) == (q := forest.root(order[j])):
                continue
            small, large = (own[i], own[j]) if len(own[i]) <= len(own[j]) else (own[j], own[i])
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            if 100 * both >= percent * (len(small) + len(large) - both):
                forest.up[max(p, q)] = min(p, q)
                links.append((order[i], order[j]))

    width = [LEAF * FAN**n for n in range(len(tree.levels))]  # sets below a node of each level
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, a, b = stack.pop()
        if split and (a * width[level] >= split or (b + 1) * width[level] <= split):
            continue  # both of one class
        if a != b:
            least_a, least_b = int(tree.least[level][a]), int(tree.least[level][b])
            if int(tree.most[level][a]) * 100 < percent * least_b or int(tree.most[level][b]) * 100 < percent * least_a:
                continue
            common = int(np.bitwise_count(tree.maps[level][a] & tree.maps[level][b]).sum(dtype=np.int64))
            if common + int(min(tree.extra[level][a], tree.extra[level][b])) < need(least_a + least_b):
                continue
        if (p := uniform(level, a)) >= 0 and p == uniform(level, b):
            continue
        if level == 0:
            leaves(a, b)
            continue
        (a0, a1), (b0, b1) = tree.levels[level][a], tree.levels[level][b]
        pairs = [(level - 1, x, y) for x in range(a0, a1) for y in range(b0, b1) if x < y] if a == b else [(level - 1, x, y) for x in range(a0, a1) for y in range(b0, b1)]
        stack += pairs[::-1]
        if a == b:
            stack += [(level - 1, x, x) for x in range(a0, a1)][::-1]  # popped first


# Spark jobs


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[Decimal, str]]]:
    held, size = [], 0
    for node, text in rows(batches, "node", "text"):
        if held and size + len(text) > CHUNK_CHARS:
            yield held
            held, size = [], 0
        held.append((node, text))
        size += len(text)
    if held:
        yield held


SETS = pa.schema([("node", NODES), ("key1", pa.int64()), ("key2", pa.int64()), ("n", pa.int64())])


def sets_of(nodes: DataFrame, n: int = SHINGLE) -> DataFrame:
    """node, key1, key2 (the set's digest) and n (its size) of every row of node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, out = WordNumbers(), Out(SETS)
        for chunk in _chunks(batches):
            for node, text in chunk:
                tokens = shingles(text, numbers, n)
                if out.add(node, *set_key(tokens), len(tokens)):
                    yield out.take()
        yield from out.rest()

    return nodes.mapInArrow(run, f"node {NODE}, key1 long, key2 long, n long")


def candidate_pairs(nodes: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """a, b: of the sets (by the first half of their digests) that share a part, each with the smallest one. Sets that link are connected."""
    sizes = Sizes(percent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for chunk in _chunks(batches):
            seen, keys, signatures = set(), [], []
            for _, text in chunk:
                tokens = shingles(text, numbers, n)
                key = set_key(tokens)[0]
                if key not in seen:  # copies within a chunk
                    seen.add(key)
                    own = part_signatures(tokens, sizes)
                    keys.append(np.full(len(own), key, np.int64))
                    signatures.append(own)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signatures).view(np.int64)), pa.array(np.concatenate(keys))], ["part", "key"])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, 0  # the part that is being read and its smallest set
        for batch in batches:
            part, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(part):
                continue
            new = np.flatnonzero(np.concatenate([[last is None or part[0] != last], part[1:] != part[:-1]]))
            group = np.searchsorted(new, np.arange(len(part)), "right") - 1  # -1: goes on from the batch before
            leader = np.where(group < 0, first, key[new[group]] if len(new) else 0)
            last, first = int(part[-1]), int(leader[-1])
            pairs = np.unique(np.stack([leader, key], 1)[leader != key], axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    parts = nodes.select("node", "text").mapInArrow(emit, "part long, key long").repartition("part").sortWithinPartitions("part", "key")
    return parts.mapInArrow(star, "a long, b long").distinct()


def token_order(nodes: DataFrame, n: int = SHINGLE, docs: int = ORDER_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Leading bits of the tokens that more than one document of a sample of about `docs` has, and how often, as powers of two."""
    total, part = nodes.count(), 1 << 30
    share = part if total <= docs else int(part * docs / total)
    drawn = nodes.where(F.pmod(F.xxhash64("node", F.lit("order")), F.lit(part)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for chunk in _chunks(batches):
            for _, text in chunk:
                at = np.unique(shingles(text, numbers, n) >> np.uint64(64 - ORDER_BITS))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32))], ["at"])

    counted = drawn.select("node", "text").mapInArrow(run, "at int").groupBy("at").agg(F.count("*").alias("n")).where("n > 1")
    found = counted.select("at", F.floor(F.log2("n")).cast("int").alias("often")).toArrow()  # of a bounded sample
    return found.column("at").to_numpy(), found.column("often").to_numpy().astype(np.uint8)


def shared_least(n: int) -> int:
    """How many of their rarest tokens two linked sets share at least, the smaller of which has n."""
    return 1 + n * SHARED_PERCENT // 100


def rare_pairs(nodes: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """a, b: of the sets (by the first half of their digests) that share one of their rarest tokens and whose sizes follow each other closely
    enough, each with the smallest one. Sets that link are connected. A set that shares fewer of its rarest tokens with sets near its
    size than two linked ones share with each other links with none and is left out, so it connects no others either."""
    held = nodes.sparkSession.sparkContext.broadcast(token_order(nodes, n))
    least_of = lambda size: -(-percent * size // 100)  # noqa: E731  of a partner, and of the tokens it shares with one

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, often = WordNumbers(), np.zeros(1 << ORDER_BITS, np.uint8)
        often[held.value[0]] = held.value[1]
        for chunk in _chunks(batches):
            seen, keys, sizes, first = set(), [], [], []
            for _, text in chunk:
                tokens = shingles(text, numbers, n)
                key = set_key(tokens)[0]
                if len(tokens) and key not in seen:  # copies within a chunk
                    seen.add(key)
                    size = len(tokens)
                    rarest = np.argsort(often[tokens >> np.uint64(64 - ORDER_BITS)], kind="stable")
                    first.append(tokens[rarest[: size - least_of(size) + shared_least(size)]])
                    keys.append(key)
                    sizes.append(size)
            if keys:
                count = [len(f) for f in first]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(np.repeat(sizes, count)), pa.array(np.repeat(np.array(keys, np.int64), count))], ["token", "n", "key"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows beside which, in order of size, one of the same token and a size near enough stands. Copies in other chunks are one row."""
        held_row, held_met = None, False
        for batch in batches:
            rows_ = np.stack([batch.column(i).to_numpy() for i in range(3)])
            if held_row is not None:
                rows_ = np.concatenate([held_row, rows_], axis=1)
            if not rows_.shape[1]:
                continue
            rows_ = rows_[:, np.concatenate([[True], (rows_[:, 1:] != rows_[:, :-1]).any(0)])]
            token, size, _ = rows_
            near = (token[1:] == token[:-1]) & (100 * size[:-1] >= percent * size[1:])
            before = np.concatenate([[held_met], near])
            met = before[:-1] | near
            held_row, held_met = rows_[:, -1:], bool(before[-1])
            if met.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[:-1][met])) for c in rows_], ["token", "n", "key"])
        if held_row is not None and held_met:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in held_row], ["token", "n", "key"])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, size, first = None, 0, 0  # the token that is being read, its largest set so far, and the set that its run began with
        for batch in batches:
            token, count, key = (batch.column(i).to_numpy() for i in range(3))
            if not len(token):
                continue
            before, smaller = np.append(token[:1] - 1 if last is None else last, token[:-1]), np.append(size, count[:-1])
            new = np.flatnonzero((token != before) | (100 * smaller < percent * count))
            group = np.searchsorted(new, np.arange(len(token)), "right") - 1  # -1: goes on from the batch before
            leader = np.where(group < 0, first, key[new[group]] if len(new) else 0)
            last, size, first = token[-1], int(count[-1]), int(leader[-1])
            pairs = np.unique(np.stack([leader, key], 1)[leader != key], axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    row = "token long, n long, key long"
    emitted = nodes.select("node", "text").mapInArrow(emit, row).repartition("token").sortWithinPartitions("token", "n", "key")
    met = packed_table(emitted.mapInArrow(shared, row), "tokens-shared")
    partner = F.ceil(F.col("n") * percent / 100)
    linking = met.groupBy("key").agg(F.count("*").alias("shared"), F.max("n").alias("n")).where(F.col("shared") >= 1 + F.floor(partner * SHARED_PERCENT / 100)).select("key")
    found = met.join(broadcast_if_small(linking), "key", "left_semi").select("token", "n", "key").repartition("token").sortWithinPartitions("token", "n", "key")
    return found.mapInArrow(star, "a long, b long").distinct()


def _tasks(members: DataFrame, level: Column, block_tokens: int) -> DataFrame:
    """task, side for every node: one task for a class that fits, else one for each pair of its blocks that may hold links."""
    sized = members.withColumn("level", level)
    total = sized.groupBy("class", "level").agg(F.sum("n").alias("tokens"))
    whole = total.groupBy("class").agg((F.sum("tokens") <= block_tokens).alias("fits"))
    blocks = total.select("class", "level", F.ceil(F.col("tokens") / block_tokens).cast("int").alias("blocks"))
    following = blocks.select("class", (F.col("level") - 1).alias("level"), F.col("blocks").alias("above"))
    before = blocks.select("class", (F.col("level") + 1).alias("level"), F.col("blocks").alias("below"))
    plan = blocks.join(following, ["class", "level"], "left").join(before, ["class", "level"], "left").join(whole, "class").na.fill(0, ["above", "below"])
    own = sized.join(plan, ["class", "level"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    count = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda la, a, lb, b, side: F.struct(F.concat_ws(":", "class", la.cast("string"), a.cast("string"), lb.cast("string"), b.cast("string")).alias("task"), side.cast("int").alias("side"))
    here, lv = F.col("block"), F.col("level")
    same = F.transform(count("blocks"), lambda o: pair(lv, F.least(here, o), lv, F.greatest(here, o), F.when(here > o, 1).otherwise(0)))
    up = F.transform(count("above"), lambda o: pair(lv, here, lv + 1, o, F.lit(0)))
    down = F.transform(count("below"), lambda o: pair(lv - 1, o, lv, here, F.lit(1)))
    alone = F.array(F.struct(F.concat_ws(":", F.lit("class"), "class").alias("task"), F.lit(0).alias("side")))
    return own.select("node", "level", F.explode(F.when(F.col("fits"), alone).otherwise(F.concat(same, up, down))).alias("t")).select("node", "t.task", "t.side")


LINKS = pa.schema([("a", NODES), ("b", NODES)])


def set_links(nodes: DataFrame, sets: DataFrame, percent: int = PERCENT, n: int = SHINGLE, block_tokens: int = BLOCK_TOKENS, rare: bool = False) -> DataFrame:
    """a, b: links between different sets, by their smallest nodes, that connect all sets that link."""
    sizes = Sizes(percent)
    first = sets.where("n > 0").groupBy("key1", "key2").agg(F.min("node").alias("node"), F.first("n").alias("n"))
    classes = components((rare_pairs if rare else candidate_pairs)(nodes, percent, n), "candidates")
    grouped = classes.unionByName(classes.select(F.col("root").alias("node"), "root").distinct())
    members = written(first.join(grouped.select(F.col("node").alias("key1"), F.col("root").alias("class")), "key1").select("node", "key1", "key2", "class", "n"), "members")
    bounds = sizes.bounds[sizes.bounds <= 2**40].tolist()
    level = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("n"))) - 1
    tasks = _tasks(members, level, block_tokens).distinct()
    some = nodes.where(bloom.likely(members.select(F.col("node").alias("key")).distinct(), F.col("node")))  # the texts of other documents are not shuffled
    wanted = some.join(tasks.hint("merge"), "node").repartition("task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, out = WordNumbers(), Out(LINKS)
        for _, group in groupby(rows(batches, "task", "node", "side", "text"), key=lambda r: r[0]):
            held = [(node, side, shingles(text, numbers, n)) for _, node, side, text in group]
            for i, j in tree_links([s for *_, s in held], [side for _, side, _ in held], percent):
                if out.add(held[i][0], held[j][0]):
                    yield out.take()
        yield from out.rest()

    return wanted.mapInArrow(run, f"a {NODE}, b {NODE}")


def linked(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text", block_tokens: int = BLOCK_TOKENS, rare: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included).

    Null and empty texts have an empty set and link with nothing. Rows of one doc_id are one document: what is linked with one of them is
    linked with all. A null doc_id stays null and counts as larger than all others (a component without any id has a null id); rows
    without an id are told apart by their texts. Other columns are not looked at; no rows give no rows."""
    nodes = docs.select(node_id(id_column, text_column).alias("node"), text_of(text_column).alias("text"))
    sets = written(sets_of(nodes, n), "sets")
    first = sets.where("n > 0").groupBy("key1", "key2").agg(F.min("node").alias("first"))
    set_key_of = F.struct("key1", "key2")
    several = sets.groupBy("node").agg(F.min(set_key_of).alias("least"), F.max(set_key_of).alias("most")).where("least <> most").select("node")
    one_document = sets.join(several, "node").join(first, ["key1", "key2"]).select(F.col("node").alias("a"), F.col("first").alias("b"))
    roots = components(set_links(nodes, sets, percent, n, block_tokens, rare).unionByName(one_document), "links")
    named = first.join(roots.select(F.col("node").alias("first"), "root"), "first", "left").select("key1", "key2", F.coalesce("root", "first").alias("root"))
    with_words = sets.where("n > 0").join(named, ["key1", "key2"]).select("node", "n", "root")
    empty = sets.where("n = 0").join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    found = with_words.unionByName(empty)
    known = lambda c: F.when(F.col(c) < F.lit(NULL_IDS), F.col(c)).cast("long")
    return found.select(known("node").alias("doc_id"), F.col("n").alias("n_shingles"), known("root").alias("component_id"), F.col("node").alias("_node"), F.col("root").alias("_root"))


def representatives(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text", rare: bool = True) -> DataFrame:
    """The documents of which none with a smaller id is linked with them, directly or over others: one of each group, with all columns as they
    were. Of rows that repeat an id and a text one stays; documents with an empty set all stay."""
    found = linked(docs, percent, n, id_column, text_column, rare=rare)
    node, empty, text = hidden("node"), hidden("empty"), hidden("text")
    stay = found.where("_node = _root").select(F.col("_node").alias(node)).distinct()
    no_words = F.trim(F.translate(text_of(text_column), "\t\n\x0b\x0c\r", "     ")) == ""
    marked = docs.withColumns({node: node_id(id_column, text_column), empty: no_words})
    once = marked.where(~F.col(empty)).join(stay, node, "left_semi").withColumn(text, F.xxhash64(text_of(text_column))).dropDuplicates([node, text]).drop(text)
    return once.unionByName(marked.where(F.col(empty))).select(docs.columns)
