"""Operator 1, n-gram Jaccard join: a metric-space join. Pivots create Voronoi regions, windows by the triangle inequality replicate
the documents near a border, and regions join recursively and exactly.

A-Z in lower case; words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return. A
document's set is its distinct shingles of `k` words; with fewer words, the whole sequence as one; without words, empty. Documents
link when 100 * |intersection| >= percent * |union|; the distance 1 - Jaccard is a metric, and EPS = 1 - percent / 100 its limit.

1. Documents with equal sets are one class, and its smallest doc_id stands for it.
2. Seeds: under one order of all shingles, two linked sets share one of their first n - ceil(percent * n / 100) + 1. Frequent
   shingles come last in the order (at most HOT of them; any order is right, this one keeps regions small). The documents that share
   a seed belong to the region of the seed's smallest doc_id, the pivot: every link lies within a region. A document alone with all
   its seeds has no link and goes no further.
   A region's documents are first compared by how their shingles spread over cells of the hash space: the counts of two linked sets
   differ by no more than the sets do, so a document that is too far from all others of the region by that measure has no link in it.
   Regions of more than COMPARED documents skip that step.
3. Every region divides into Voronoi cells. Pivots are drawn, a document is at home in the cell of the nearest, and is replicated to
   each cell whose pivot is at most 2 * EPS farther (the window: if x is at home in a cell and y is linked with x, then by the
   triangle inequality y is in that cell). Documents within EPS of a pivot link to it there and then; a cell whose documents are all
   connected is done; the other cells divide in the same way, until they hold two documents, or have no more than their parent.
   A region of at most LEAF documents and LEAF_SHINGLES shingles is divided within one task (`divided`), its pivots being documents far
   from one another. A larger one is divided by Spark (`cells`), its pivots drawn by hash, up to LEVELS times; one that its cells don't
   divide (they hold more than twice its documents, or one of them nearly all) is joined exactly by pairs of blocks: documents that
   are not yet connected with the region's largest component, against all. Each pair of blocks is divided within a task again.
4. Components of the links, by stars.

Only connections leave a region (a tree for each of its components), not all links of a group.

Defined cases: a null or empty text has no shingles and links with nothing; a very long text is one row of a task, with some numbers of
8 bytes for each of its words, and is joined in regions that few others share; a row with a null doc_id links with nothing and has no
component; rows with one doc_id are compared each and share its component; an empty table gives no rows; extra columns, whatever their
names, are ignored by `components_of` and kept by `one_of_each`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE_A, Rolling, WordHash, apart, join_hot, list_array, map_arrow, raw_texts, record_batch, signed, small, table, word_hashes, worker_state, written
from .graph import components

K, PERCENT = 4, 85
HOT, HOT_FROM, LEAF, LEAF_SHINGLES, LEVELS, PIVOTS, COMPARED = 1 << 18, 64, 512, 4_000_000, 2, 24, 4096
BROADCAST_ROWS = 250_000

def tools() -> tuple[WordHash, Rolling]:
    return worker_state("shingles", lambda: (WordHash(), Rolling(BASE_A)))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    words = text.lower().split() if text else []
    seen, rolling = tools()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return rolling(word_hashes(words, seen), len(words)) ^ np.uint64(len(words))
    return np.unique(rolling(word_hashes(words, seen), k))


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1 if n else 0


def frequent(documents: DataFrame, k: int, percent: int) -> np.ndarray:
    """The most frequent shingles among the first of all documents, ascending; at most HOT of them."""

    def run(batch: pa.RecordBatch) -> dict:
        parts = []
        for text in raw_texts(batch):
            s = shingles(text, k)
            parts.append(s[: prefix_length(len(s), percent) + 8])
        every, counts = np.unique(np.concatenate(parts), return_counts=True)
        return {"token": signed(every), "n": counts}

    counts = map_arrow(documents.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_FROM)
    top = counts.orderBy(F.desc("n"), "token").limit(HOT).select("token")
    return np.sort(top.toArrow()["token"].to_numpy().view(np.uint64))


def in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def n_cells(n: int) -> int:
    """Cells for a set of n: fine enough to tell unrelated sets apart, a power of two from 64 to 4096."""
    return min(4096, max(64, 1 << max(0, (n - 1) // 8).bit_length()))


def spread(s: np.ndarray) -> np.ndarray:
    """How many shingles each cell of the hash space has, to 255; a cell is a value of the leading bits, so cells fold in pairs."""
    c = n_cells(len(s))
    return np.minimum(np.bincount((s >> np.uint64(65 - c.bit_length())).astype(np.int64), minlength=c), 255).astype(np.uint8)


def with_company(n: np.ndarray, spreads: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets can be linked with another, by their sizes and spreads; n ascending."""
    keep = np.zeros(len(n), bool)
    folded: dict = {}
    last = np.searchsorted(n, n * 100 // percent, side="right")
    for i in range(len(n)):
        if last[i] <= i + 1:
            continue
        c = len(spreads[i])
        if c not in folded:  # the sets from the first with so many cells on
            first = next(j for j in range(len(n)) if len(spreads[j]) >= c)
            folded[c] = first, np.array([x.reshape(c, -1).sum(1, dtype=np.int32).clip(max=255) for x in spreads[first:]], np.int16)
        first, cells = folded[c]
        apart = np.abs(cells[i + 1 - first : last[i] - first] - cells[i - first]).sum(1, dtype=np.int64)
        # |x - y| of linked sets is at most (100 - percent) / (100 + percent) of the sum of their sizes
        near = apart * (100 + percent) <= (100 - percent) * (n[i] + n[i + 1 : last[i]])
        if near.any():
            keep[i] = True
            keep[i + 1 : last[i]] |= near
    return keep


def sketched(documents: DataFrame, hot, k: int, percent: int) -> DataFrame:
    """doc_id, n, two halves of the set's digest, the spread, and the seeds; written."""

    def run(batch: pa.RecordBatch) -> dict:
        last, n, d1, d2, seeds, spreads = hot.value, [], [], [], [], []
        for text in raw_texts(batch):
            s = shingles(text, k)
            h = xxhash.xxh3_128_intdigest(s.tobytes())
            n.append(len(s))
            d1.append((h >> 64) - (1 << 63))
            d2.append((h & (1 << 64) - 1) - (1 << 63))
            spreads.append(spread(s).tobytes())
            p = prefix_length(len(s), percent)
            head = s[: 4 * p]
            frequent = in_sorted(head, last)
            if frequent.any():
                if len(head) - frequent.sum() < p:
                    head, frequent = s, in_sorted(s, last)
                head = np.concatenate([head[~frequent], head[frequent]])
            seeds.append(signed(head[:p]))
        return {"doc_id": batch.column("doc_id"), "n": n, "d1": d1, "d2": d2, "spread": spreads, "seeds": list_array(np.concatenate(seeds), [len(x) for x in seeds])}

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(map_arrow(rows, run, "doc_id long, n long, d1 long, d2 long, spread binary, seeds array<long>"), "shingled")


def seeded(rows: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """region (its pivot's doc_id), doc_id and n of the documents that share seeds and can have a link in the region; written."""
    again = small(copies.select("doc_id", "d1").distinct(), BROADCAST_ROWS)
    tokens = rows.filter("doc_id is not null and n > 0").join(again, ["doc_id", "d1"], "left_anti").select(F.explode("seeds").alias("token"), "doc_id")
    shared = tokens.groupBy("token").agg(F.min("doc_id").alias("region"), F.max("doc_id").alias("other"), F.count("*").alias("n")).filter("region < other").select("token", "region", "n")
    members = written(join_hot(tokens, written(shared, "seeds"), ["token"]).select("region", "doc_id").distinct(), "members")
    # large regions go on as they are: no task gets one whole
    large = small(written(members.groupBy("region").agg(F.count("*").alias("m")).filter(F.col("m") > COMPARED).select("region"), "large"), BROADCAST_ROWS)
    sizes = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.max("n").alias("n"))
    through = members.join(large, "region", "left_semi").join(sizes, "doc_id").select("region", "doc_id", "n")
    sized = members.join(large, "region", "left_anti").join(rows.select("doc_id", "n", "spread"), "doc_id")

    def run(batches):
        now, held = None, []

        def done():
            held.sort(key=lambda x: x[1])
            keep = with_company(np.array([x[1] for x in held], np.int64), [np.frombuffer(x[2], np.uint8) for x in held], percent)
            left = {x[0]: x[1] for x, k in zip(held, keep) if k}
            return pa.RecordBatch.from_pydict({"region": pa.array([now] * len(left), pa.int64()), "doc_id": pa.array(list(left), pa.int64()), "n": pa.array(list(left.values()), pa.int64())})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("region", "doc_id", "n", "spread"))):
                if row[0] != now:
                    if held:
                        yield done()
                    now, held = row[0], []
                held.append(row[1:])
        if held:
            yield done()

    near = sized.repartition("region").sortWithinPartitions("region").mapInArrow(run, "region long, doc_id long, n long")
    return written(near.unionByName(through), "regions")


def with_sets(documents: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """members (region, doc_id and more) with the set of each document; a document's text is read once, however many regions it is in."""
    more = [c for c in members.columns if c != "doc_id"]
    per_doc = written(members.groupBy("doc_id").agg(F.collect_list(F.struct(*more)).alias("at")), "members")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(per_doc, BROADCAST_ROWS, F.size("at") * (16 * len(more) + 16)), "doc_id")
    sets = map_arrow(rows, lambda b: {"doc_id": b.column("doc_id"), "at": b.column("at"), "items": [shingles(t, k).tobytes() for t in raw_texts(b)]}, f"doc_id long, at {dict(per_doc.dtypes)['at']}, items binary")
    return sets.select("doc_id", "items", F.explode("at").alias("at")).select("at.*", "doc_id", "items")


def shared_with(pivots: list[np.ndarray], sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set with each pivot."""
    every, inverse = np.unique(np.concatenate(pivots), return_inverse=True)
    has = np.zeros((len(every) + 1, len(pivots)), np.int32)
    has[inverse, np.repeat(np.arange(len(pivots)), [len(p) for p in pivots])] = 1
    flat = np.concatenate(sets)
    at = np.searchsorted(every, flat)
    at[every[np.minimum(at, len(every) - 1)] != flat] = len(every)
    return np.add.reduceat(has[at], np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]), axis=0)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of the matrix of shingles that two sets or more have, by parts."""
    sizes = [len(s) for s in sets]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    token = np.cumsum(new) - 1
    often = np.bincount(token)[token] > 1
    token, owner = token[often], owner[often]
    token = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1 if len(token) else token
    out = np.zeros((len(sets), len(sets)), np.float32)
    part = 8192
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, part):
        a, b = np.searchsorted(token, [first, first + part])
        m = np.zeros((part, len(sets)), np.float32)
        m[token[a:b] - first, owner[a:b]] = 1
        out += m.T @ m
    return out


class Forest:
    """What is connected so far, and a tree of connections for each component."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def connect(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        if a != b:
            self.up[a] = b
            self.links.append((i, j))


def divided(sets: list[np.ndarray], percent: int, tally: dict | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) of linked sets that connect all sets that links connect: Voronoi cells with windows, again and again.

    Pivots are the first set and then, in turn, the one farthest from all pivots so far, while it is beyond the window of them; two
    sets of a cell are compared themselves. tally counts cells, replicated sets and pairs compared."""
    eps, forest = 1 - percent / 100, Forest(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    count = lambda what, n=1: tally.__setitem__(what, tally.get(what, 0) + n) if tally is not None else None

    def linked(i: int, j: int) -> None:
        count("pairs")
        low, high = sorted((sizes[i], sizes[j]))
        if 100 * low < percent * high or forest.top(i) == forest.top(j):
            return
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * both >= percent * (sizes[i] + sizes[j] - both):
            forest.connect(i, j)

    todo = [np.arange(len(sets))]
    while todo:
        own = todo.pop()
        if len(own) <= 2:
            if len(own) == 2:
                linked(int(own[0]), int(own[1]))
            continue
        pivots, d = [], np.zeros((len(own), 0))
        most = max(2, min(PIVOTS, int(len(own) ** 0.5) + 1))
        following = 0
        while len(pivots) < most:
            p = int(own[following])
            pivots.append(p)
            both = shared_with([sets[p]], [sets[i] for i in own])[:, 0].astype(np.int64)
            union = sizes[own] + sizes[p] - both
            for i in own[100 * both >= percent * union].tolist():
                if i != p:
                    forest.connect(i, p)
            d = np.hstack([d, (1 - both / union)[:, None]])
            following = int(d.min(1).argmax())
            if d[following].min() <= 2 * eps:
                break
        near = d.min(1)
        parts = [own[d[:, j] <= near + 2 * eps + 1e-9] for j in range(len(pivots))]
        count("cells", len(parts))
        count("replicas", sum(map(len, parts)) - len(own))
        parts = [x for x in parts if len({forest.top(int(i)) for i in x}) > 1]
        if sum(map(len, parts)) <= 2 * len(own) and max(map(len, parts), default=0) <= 0.9 * len(own):
            todo += parts
        elif parts:  # no division to speak of: all pairs of the region
            count("pairs", len(own) * (len(own) - 1) // 2)
            both = overlaps([sets[i] for i in own]).astype(np.int64)
            near_by = np.triu(100 * both >= percent * (sizes[own][:, None] + sizes[own][None, :] - both), 1)
            for i, j in zip(*np.nonzero(near_by)):
                forest.connect(int(own[i]), int(own[j]))
    return forest.links


def stars(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of ids that connect all documents that links connect."""
    return [(int(ids[i]), int(ids[j])) for i, j in divided(sets, percent)]


def joined(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is connected in each region; region, doc_id, items in, a region within the bounds of LEAF."""

    def run(batches):
        now, ids, sets, out = None, [], [], []
        for batch in batches:
            for region, doc_id, items in zip(batch.column("region").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("items").to_pylist()):
                if region != now:
                    if len(ids) > 1:
                        out += stars(np.array(ids), sets, percent)
                    now, ids, sets = region, [], []
                ids.append(doc_id)
                sets.append(np.frombuffer(items, np.uint64))
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
                out = []
        if len(ids) > 1 and (out := stars(np.array(ids), sets, percent)):
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return members.select("region", "doc_id", "items").repartition("region").sortWithinPartitions("region").mapInArrow(run, "a long, b long")


def cells(documents: DataFrame, members: DataFrame, sizes: DataFrame, k: int, percent: int, level: int) -> DataFrame:
    """One Voronoi step for the regions of sizes (region, m): parent, region (the cell), cell (its pivot), doc_id, and d, the distance
    from the pivot; a linked document has -1 - d in its place, so that the limit is decided in whole numbers; written."""
    eps = 1 - percent / 100
    part = F.lit(4 * LEAF)
    sized = members.join(sizes, "region").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("m") / part)).cast("int"))
    # about PIVOTS of a region's documents: those whose hash falls below that share
    drawn = F.pmod(F.xxhash64("doc_id", "region", F.lit(level)), F.lit(1 << 30)) < F.lit(PIVOTS * (1 << 30)) / F.col("m")
    pivots = sized.filter(drawn).select("region", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("m") / part) - 1).cast("int"))).alias("salt"), F.lit(0).alias("kind"), "doc_id")
    rows = with_sets(documents, pivots.unionByName(sized.select("region", "salt", F.lit(1).alias("kind"), "doc_id")), k)
    schema = pa.schema([("region", pa.int64()), ("cell", pa.int64()), ("doc_id", pa.int64()), ("d", pa.float64())])

    def run(batches):
        now, names, flat, owner, lengths, ready = None, [], [], [], [], None
        for batch in batches:
            out: list = []
            for region, salt, kind, doc_id, items in zip(*(batch.column(c).to_pylist() for c in ("region", "salt", "kind", "doc_id", "items"))):
                own = np.frombuffer(items, np.uint64)
                if (region, salt) != now:
                    now, names, flat, owner, lengths, ready = (region, salt), [], [], [], [], None
                if kind == 0:
                    owner.append(np.full(len(own), len(names)))
                    names.append(doc_id)
                    flat.append(own)
                    lengths.append(len(own))
                    continue
                if not names:  # no pivot was drawn: the region goes on as it is
                    out.append((region, region, doc_id, 1.0))
                    continue
                if ready is None:
                    every, inverse = np.unique(np.concatenate(flat), return_inverse=True)
                    has = np.zeros((len(every), len(names)), np.uint16)
                    has[inverse, np.concatenate(owner)] = 1
                    ready = every, has, np.array(lengths)
                every, has, size = ready
                at = np.searchsorted(every, own)
                at[at == len(every)] = 0
                both = has[at[every[at] == own]].sum(0, dtype=np.int64)
                d = 1 - both / (size + len(own) - both)
                exact = 100 * both >= percent * (size + len(own) - both)
                for j in np.flatnonzero(d <= d.min() + 2 * eps + 1e-9):
                    out.append((region, names[j], doc_id, -1 - d[j] if exact[j] else d[j]))
            if out:
                yield record_batch({c: list(x) for c, x in zip(("region", "cell", "doc_id", "d"), zip(*out))}, schema)

    found = rows.repartition("region", "salt").sortWithinPartitions("region", "salt", "kind").mapInArrow(run, "region long, cell long, doc_id long, d double")
    return written(found.select(F.col("region").alias("parent"), F.xxhash64("region", "cell", F.lit(level)).alias("region"), "cell", "doc_id", "d"), "cells")


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with label: what their document is connected with so far, by its smallest doc_id; written."""
    known = components(links)
    out = members.join(known, F.col("doc_id") == F.col("node"), "left")
    return written(out.select(*members.columns, F.coalesce("component", "doc_id").alias("label")), "labelled")


def blocks(members: DataFrame) -> DataFrame:
    """Regions of members (region, doc_id, n, label) as pairs of a block of documents outside the region's largest label and a block of any.

    Documents of one label are connected already, so every link that is still missing has an end outside the largest one."""
    small_block, block = LEAF // 4, 3 * LEAF // 4
    per_label = members.groupBy("region", "label").agg(F.count("*").alias("n"), F.sum("n").alias("w"))
    per_region = per_label.groupBy("region").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("m"), F.sum("w").alias("w"))
    rows = members.join(per_region, "region")
    parts = lambda m, size, share: F.ceil(F.greatest(m / size, F.col("w") / (share * LEAF_SHINGLES))).cast("int")
    n_out, n_all = parts(F.col("m") - F.col("top.n"), small_block, 0.25), parts(F.col("m"), block, 0.75)
    h = F.xxhash64("doc_id")
    rows = rows.filter(F.col("m") > F.col("top.n")).select("region", "doc_id", (F.col("label") != F.col("top.label")).alias("out"), n_out.alias("n_out"), n_all.alias("n_all"), F.pmod(h, n_out).alias("i"), F.pmod(h, n_all).alias("j"))
    of_all = rows.select("region", "doc_id", "j", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("i"))
    of_out = rows.filter("out").select("region", "doc_id", "i", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"))
    return of_all.unionByName(of_out).select(F.xxhash64("region", "i", "j", F.lit("pair")).alias("region"), "doc_id").distinct()


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def links(documents: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that connect all documents that links connect."""
    near, leaves = [], []
    for level in range(LEVELS):
        sizes = written(members.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("w")).filter("m > 1"), "sizes")
        fits = (F.col("m") <= LEAF) & ((F.col("w") <= LEAF_SHINGLES) | (F.col("m") == 2))
        leaves.append(members.join(sizes.filter(fits).select("region"), "region", "left_semi").select("region", "doc_id"))
        large = sizes.filter(~fits).select("region", "m")
        if not large.limit(1).count():
            break
        found = cells(documents, members.select("region", "doc_id"), large, k, percent, level)
        near.append(found.filter("d < 0 and doc_id <> cell").select(F.col("doc_id").alias("a"), F.col("cell").alias("b")))
        per_doc = members.groupBy("doc_id").agg(F.max("n").alias("n"))
        found = labelled(found.select("parent", "region", "doc_id").distinct().join(per_doc, "doc_id"), union(near))
        # a cell whose documents are all connected is done
        open_cells = found.groupBy("parent", "region").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).filter("low < high")
        # a region whose cells hold more than twice its documents gains nothing by them
        parents = open_cells.groupBy("parent").agg(F.sum("m").alias("all"), F.max("m").alias("most")).join(large.withColumnRenamed("region", "parent"), "parent").withColumn("worse", F.expr(f"all > 2 * m or most > 0.9 * m or {level + 1} = {LEVELS}"))
        parents = written(parents.select("parent", "worse"), "parents")
        worse = found.join(parents.filter("worse").select("parent"), "parent", "left_semi").select(F.col("parent").alias("region"), "doc_id", "n", "label").distinct()
        leaves.append(blocks(worse))
        better = open_cells.join(parents.filter("not worse"), "parent", "left_semi").select("region")
        members = written(found.join(better, "region", "left_semi").select("region", "doc_id", "n"), "regions")
    return written(union([joined(with_sets(documents, union(leaves), k), percent), *near]), "links")


def components_of(documents: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of documents."""
    hot = documents.sparkSession.sparkContext.broadcast(frequent(documents, k, percent))
    rows = sketched(documents, hot, k, percent)
    classes = rows.filter("doc_id is not null and n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"), F.count("*").alias("count")).filter("rep < other").select("d1", "d2", "rep", F.col("count").alias("n"))
    known = written(join_hot(rows.select("doc_id", F.col("n").alias("size"), "d1", "d2"), written(classes, "copies"), ["d1", "d2"], "left").withColumnRenamed("size", "n"), "classes")
    members = seeded(rows, known.filter("doc_id > rep"), percent)
    found = written(components(links(documents, members, k, percent)), "components")
    own = known.withColumn("rep", F.coalesce("rep", "doc_id"))
    out = own.join(found, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def one_of_each(documents: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of documents whose doc_id is the smallest of its component, and those without a doc_id."""
    keep = components_of(documents, k, percent).filter("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    own, names = apart(documents)
    doc_id = F.col(names["doc_id"])
    out = own.join(written(keep, "kept"), doc_id == F.col("kept"), "left_semi").unionByName(own.filter(doc_id.isNull()))
    return out.toDF(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents"))


def brute(documents: list[tuple], k: int = K, percent: int = PERCENT) -> dict:
    """doc_id -> (n_shingles, component_id), by comparing all pairs of sets that share a shingle."""
    sets: dict = {}
    for d, text in documents:
        w = (text or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    holders: dict = {}
    for d in sets:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    for d, own in sets.items():
        counts: dict = {}
        for s in own:
            for o in holders[s]:
                counts[o] = counts.get(o, 0) + 1
        for o, both in counts.items():
            if o != d and 100 * both >= percent * (len(own) + len(sets[o]) - both):
                a, b = sorted((top(d), top(o)))
                up[b] = a
    return {d: (len(sets[d]), top(d)) for d in sets}
