"""N-gram Jaccard self-join of texts by chosen paths.

Every text is a set of five-word shingles. Texts with the same words collapse into one set. A set stands
in the join as its min-hash sketch: two sets hold the same token at a coordinate with the
probability of their similarity. In a run, sets are split recursively: a node of the tree samples one or
two of the coordinates, and for each of them sends a set to the child of its token there; so a set takes
several paths, and similar sets share one. A bucket small enough ends a path and is compared by brute
force on the sketches; a larger one is split again, once the sets nearly equal to one of a few
chosen from it are linked to that one and have left it. Runs repeat until a pair at the threshold shares a path to the last
level with the wanted recall. What was found alike is a loose class; within a loose class every pair of
sets whose sizes allow it is then decided by exact Jaccard similarity, in blocks, so links are exact
and counted once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.shared import Words, attach, byte_slices, extent, materialize, mix, signed

COORDINATES = 64
#: Levels of the tree at most, and how often a node samples a second coordinate.
LEVELS, SECOND = 4, 0.5
#: A bucket of at most so many sets is compared by brute force.
BUCKET = 96
#: Sketches that agree in this much less than the threshold are still taken as a possible link (over 3 sigma).
SLACK = 0.2
#: A set that agrees so much with one of a few chosen from its bucket leaves it: what is similar to it is then linked to that one too.
NEAR = 0.85
#: Each chooses a set of a bucket: that whose id is smallest once its bits are turned so.
CHOICES = (0, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x3C6EF372FE94F82B)
#: Sets of a loose class whose texts are broadcast by id, at most.
BROADCAST = 200_000
#: A block of a loose class holds about so many sets and shingles at most; it is compared in tiles of so many.
BLOCK_SETS, BLOCK_SHINGLES, TILE_SETS, TILE_SHINGLES = 8192, 2_000_000, 384, 300_000

_A = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix(_A)


def survival(threshold: float, levels: int = LEVELS) -> float:
    """The chance that two sets at the threshold share a path to the last level: a branching process."""
    lost = 0.0
    for _ in range(levels):
        one = 1 - threshold + threshold * lost
        lost = (1 - SECOND) * one + SECOND * one**2
    return 1 - lost


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has shared a path to the last level with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold)))


def sketches(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Min-hash sketch of each set that isn't empty: uint32, (sets, COORDINATES)."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), COORDINATES), np.uint32)
    for k in range(COORDINATES if len(starts) else 0):
        out[:, k] = np.minimum.reduceat((((shingles ^ _B[k]) * _A[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def children(nodes: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two children of each row's node, uint64 (rows, 2), and which of them are taken: what a node samples is told by its key alone."""
    rows = np.arange(len(nodes))
    drawn = mix((nodes[:, None] ^ _A[None, :]) * np.uint64(0xA24BAED4963EE407))
    first = drawn.argmin(axis=1)
    drawn[rows, first] = np.iinfo(np.uint64).max
    at = np.stack([first, drawn.argmin(axis=1)], axis=1)
    keys = mix(mix(nodes)[:, None] + _B[at] * (sketch[rows[:, None], at].astype(np.uint64) + np.uint64(1)))
    second = (mix(nodes ^ np.uint64(0x51ED270B)) >> np.uint64(40)).astype(np.float64) / 2.0**24 < SECOND
    return keys, np.stack([np.ones(len(nodes), bool), second], axis=1)


def roots(sketch: np.ndarray, runs: int) -> np.ndarray:
    """The nodes of the first level of all runs: int64, (sets, nodes)."""
    out = []
    for run in range(runs):
        keys, taken = children(np.full(len(sketch), mix(np.array([run + 1], np.uint64))[0]), sketch)
        out += [keys[:, k] for k in (0, 1) if len(sketch) == 0 or taken[0, k]]
    return signed(np.ascontiguousarray(np.stack(out, axis=1)))


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as one binary column."""
    width = rows.shape[1] * rows.itemsize
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(-1)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(data)])


def _sketched(width: int, runs: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in byte_slices(batch.column(1)):
                words = Words(texts)
                high, low = words.fingerprints()
                shingles, offsets = words.shingles(width)
                some = np.flatnonzero(np.diff(offsets) > 0)
                sketch = sketches(shingles, offsets)
                keys = roots(sketch, runs)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)).take(pa.array(some)),
                        pa.array(signed(high[some])),
                        pa.array(signed(low[some])),
                        _binary(sketch),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1))),
                    ],
                    ["id", "high", "low", "sketch", "path"],
                )

    return over


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups and the groups' bounds, from rows that arrive sorted by the keys."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        bounds = _bounds(held, keys)
        if len(bounds) > 2:
            yield held.slice(0, bounds[-2]).combine_chunks(), bounds[:-1]
            held = held.slice(bounds[-2])
    if held is not None and held.num_rows:
        yield held.combine_chunks(), _bounds(held, keys)


def _bounds(table: pa.Table, keys: list[str]) -> list[int]:
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for key in keys:
        new |= np.diff(table[key].to_numpy()) != 0
    return [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]


def _roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each member of the left and of the right reaches over a boolean matrix of links between them."""
    none = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(linked, right[None, :], none).min(axis=1))
        new_right = np.minimum(right, np.where(linked, new_left[:, None], none).min(axis=0))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _sketch_rows(column: pa.Array) -> np.ndarray:
    """The sketches of a binary column without nulls, (rows, COORDINATES)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, COORDINATES), np.uint32)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(np.uint32).reshape(-1, COORDINATES)


def _compare_buckets(least: float):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _groups(batches, ["node"]):
            ids, sketch = table["set_id"].to_numpy(), _sketch_rows(table["sketch"])
            found_a, found_b = [], []
            for a, b in zip(bounds, bounds[1:], strict=False):
                alike = (sketch[a:b, None, :] == sketch[None, a:b, :]).sum(axis=2) >= least * COORDINATES
                root = _roots(alike, ids[a:b], ids[a:b])[0]
                other = root != ids[a:b]
                found_a.append(ids[a:b][other])
                found_b.append(root[other])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])

    return over


def _merged(sketch: np.ndarray, least: float) -> np.ndarray:
    """For a few sets the first of those that they are linked to, over others or not."""
    linked = (sketch[:, None, :] == sketch[None, :, :]).mean(axis=2) >= least
    return _roots(linked, np.arange(len(sketch)), np.arange(len(sketch)))[0]


def _split(least: float, last: bool):
    """Rows (set_id, node, sketch, chosen) as (set_id, children, stars): the node's children that a set goes on to, and the chosen sets of
    the node that it may be like, one of those that are like each other. Sets near a chosen one go no further; at the last level none
    does, and all are linked to the first."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nodes, sketch = batch.column("set_id").to_numpy(), batch.column("node").to_numpy(), _sketch_rows(batch.column("sketch"))
            lists, n = batch.column("chosen"), len(batch)
            chosen, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
            cand, cand_sketch = chosen.field("candidate").to_numpy(), _sketch_rows(chosen.field("candidate_sketch"))
            start, owner = np.cumsum(count) - count, np.repeat(np.arange(n), count)
            merged = np.empty(len(cand), np.int64)  # the chosen set that stands for each, as a place in cand
            for row in np.unique(nodes, return_index=True)[1]:
                merged[start[row] : start[row] + count[row]] = _merged(cand_sketch[start[row] : start[row] + count[row]], least)
            told = np.unique(nodes, return_index=True, return_inverse=True)
            merged = start[owner] + merged[start[told[1][told[2]]][owner] + np.arange(len(cand)) - start[owner]]
            agree, own = (sketch[owner] == cand_sketch).mean(axis=1), cand == ids[owner]
            if last:
                stars = np.stack([np.arange(n), cand[start]], axis=1)
            else:
                stars = np.unique(np.stack([owner, cand[merged]], axis=1)[agree >= least], axis=0)
            stars = stars[stars[:, 1] != ids[stars[:, 0]]]
            leaves, is_chosen = np.zeros(n, bool), np.zeros(n, bool)
            leaves[owner[agree >= NEAR]] = True
            is_chosen[owner[own]] = True
            stays = (~leaves | is_chosen) & (not last)
            keys, taken = children(nodes.view(np.uint64), sketch)
            taken &= stays[:, None]
            kept = taken.any(axis=1) | (np.bincount(stars[:, 0], minlength=n) > 0)
            lists_of = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts[kept])).astype(np.int32)), pa.array(values))
            found = lists_of(taken.sum(axis=1), signed(np.ascontiguousarray(keys))[taken]), lists_of(np.bincount(stars[:, 0], minlength=n), stars[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), *found], ["set_id", "children", "stars"])

    return over


def _tiles(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of sets of at most TILE_SETS sets, and about TILE_SHINGLES shingles."""
    number = np.maximum(np.arange(len(sizes)) // TILE_SETS, np.cumsum(sizes) // TILE_SHINGLES)
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)]
    return list(zip(cuts, cuts[1:], strict=False))


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of the left shares with each of the right; each set holds a shingle once."""
    n, m = len(left), len(right)
    row = np.repeat(np.arange(n + m), [len(x) for x in (*left, *right)])
    _, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    mine = row < n
    total = int(column.max(initial=-1)) + 1
    in_left, in_right = np.bincount(column[mine], minlength=total), np.bincount(column[~mine], minlength=total)
    everywhere = (in_left == n) & (in_right == m)
    some = (in_left > 0) & (in_right > 0) & ~everywhere
    number = np.where(some, np.cumsum(some) - 1, -1)[column]
    row, number = row[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    shared, most = np.full((n, m), float(everywhere.sum()), np.float32), 4096
    for first in range(0, int(some.sum()), most):
        a, b = np.searchsorted(number, (first, first + most))
        held = np.zeros((n + m, most), np.float32)
        held[row[a:b], number[a:b] - first] = 1
        shared += held[:n] @ held[n:].T
    return shared


def _exact_links(threshold: float):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _groups(batches, ["loose", "block_a", "block_b"]):
            ids, copies, own, left = (table[c].to_numpy() for c in ("set_id", "copies", "block", "block_a"))
            crossing = left != table["block_b"].to_numpy()
            shingles = table["shingles"].combine_chunks()
            out_id, out_root, out_links = [], [], []
            for start, end in zip(bounds, bounds[1:], strict=False):
                order = start + np.argsort(own[start:end] != left[start:end], kind="stable")  # one block's sets, then the other's
                split = int((own[start:end] == left[start:end]).sum())
                sets = [np.frombuffer(shingles[int(k)].as_buffer(), np.uint64) for k in order]
                size, links = np.array([len(x) for x in sets]), np.zeros(len(sets), np.int64)
                sides = (_tiles(size[:split]), [(a + split, b + split) for a, b in _tiles(size[split:])]) if crossing[start] else (_tiles(size), None)
                for t, (a, b) in enumerate(sides[0]):
                    for c, d in sides[0][t:] if sides[1] is None else sides[1]:
                        shared = _shared(sets[a:b], sets[c:d])
                        linked = shared >= threshold * (size[a:b, None] + size[None, c:d] - shared) - 1e-6
                        if a == c:
                            np.fill_diagonal(linked, False)
                        links[a:b] += linked @ copies[order[c:d]]
                        if a != c:
                            links[c:d] += linked.T @ copies[order[a:b]]
                        for some, root in zip((order[a:b], order[c:d]), _roots(linked, ids[order[a:b]], ids[order[c:d]]), strict=True):
                            joined = root != ids[some]
                            out_id.append(ids[some][joined])
                            out_root.append(root[joined])
                            out_links.append(np.zeros(int(joined.sum()), np.int64))
                some = links > 0
                out_id.append(ids[order[some]])
                out_root.append(ids[order[some]])
                out_links.append(links[some])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_id, out_root, out_links)], ["set_id", "root", "links"])

    return over


def _shingled(width: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in byte_slices(batch.column("text")):
                words = Words(texts)
                high, low = words.fingerprints()
                shingles, offsets = words.shingles(width)
                rows = batch.slice(at, len(texts))
                own = (signed(high) == rows.column("high").to_numpy()) & (signed(low) == rows.column("low").to_numpy())
                packed = [np.unique(shingles[offsets[k] : offsets[k + 1]]) for k in np.flatnonzero(own)]
                kept = rows.filter(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [kept.column("set_id"), kept.column("loose"), kept.column("copies"), pa.array([len(x) for x in packed], pa.int64()), pa.array([x.tobytes() for x in packed], pa.binary())],
                    ["set_id", "loose", "copies", "size", "shingles"],
                )

    return over


def _loose_edges(sets: DataFrame, runs: int, least: float) -> DataFrame:
    """Edges between sets (set_id, sketch, path) that meet in some bucket and look alike: small buckets by brute force, large ones by a few sets chosen from each."""
    rows, small, stars = sets.select("set_id", F.explode("path").alias("node")), None, None
    for level in range(LEVELS):
        sizes = materialize(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
        known = extent(sizes)
        met = materialize(attach(rows, sizes, "node", known), "met")
        few = met.filter(F.col("n") <= BUCKET).select("node", "set_id")
        small = few if small is None else small.union(few)
        if known[1] <= BUCKET:
            break
        many = met.filter(F.col("n") > BUCKET)
        picks = many.groupBy("node").agg(F.max("n").alias("n"), *(F.min(F.col("set_id").bitwiseXOR(F.lit(m))).alias(f"m{k}") for k, m in enumerate(CHOICES)))
        some = picks.select("node", "n", F.explode(F.array_distinct(F.array(*(F.col(f"m{k}").bitwiseXOR(F.lit(m)) for k, m in enumerate(CHOICES))))).alias("candidate"))
        of = sets.select(F.col("set_id").alias("candidate"), F.col("sketch").alias("candidate_sketch"))
        chosen = some.join(of, "candidate").groupBy("node").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("candidate", "candidate_sketch"))).alias("chosen"))
        sketched = attach(many.select("set_id", "node").join(sets.select("set_id", "sketch"), "set_id"), chosen, "node", known)
        went = sketched.select("set_id", "node", "sketch", "chosen").mapInArrow(_split(least, level == LEVELS - 1), "set_id long, children array<bigint>, stars array<bigint>")
        went = materialize(went, "split")
        linked = went.select(F.col("set_id").alias("a"), F.explode("stars").alias("b"))
        stars = linked if stars is None else stars.union(linked)
        rows = went.select("set_id", F.explode("children").alias("node"))
    near = small.join(sets.select("set_id", "sketch"), "set_id").select("node", "set_id", "sketch")
    compared = near.repartition("node").sortWithinPartitions("node").mapInArrow(_compare_buckets(least), "a long, b long")
    return compared if stars is None else compared.union(stars)


def _level(size: Column, threshold: float) -> Column:
    """A number of a size such that sizes of a pair at the threshold differ in it by one at most."""
    return F.floor(F.log(size.cast("double")) / (-1.001 * math.log(threshold))).cast("long")


def _meetings(shingled: DataFrame, threshold: float) -> DataFrame:
    """Sets (set_id, loose, copies, size, shingles) once for each pair of blocks in which they may have a partner: (loose, block_a, block_b, block, ...).

    A loose class is cut into blocks by size and by a hash; blocks of sizes too far apart don't meet. Blocks grow with their class, so
    that a set is sent about 16 times, or once for each BLOCK_SETS of the sets of about its size, if that is more.
    """
    sized = shingled.withColumn("level", _level(F.col("size"), threshold))
    counts = sized.groupBy("loose", "level").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    sets = F.least(F.lit(BLOCK_SETS), F.greatest(F.lit(TILE_SETS), F.ceil(F.col("n") / 16)))
    cut = counts.withColumn("blocks", F.ceil(F.greatest(F.col("n") / sets, F.col("shingles") / F.lit(BLOCK_SHINGLES))).cast("int"))
    # a class has no more levels than its longest text's size has digits, so to say: a few dozen
    held = cut.groupBy("loose").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("level", "blocks"))).alias("blocks"))
    blocks_of = lambda level: F.coalesce(F.try_element_at("blocks", level), F.lit(0))
    named = lambda level, part: level * F.lit(1 << 32) + part
    own = named(F.col("level"), F.pmod(F.xxhash64("set_id"), blocks_of(F.col("level"))))

    def parts(step: int) -> Column:
        level = F.col("level") + step
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), blocks_of(level))), lambda k: F.when(k <= blocks_of(level), named(level, k - 1)))

    others = F.array_compact(F.concat(parts(-1), parts(0), parts(1)))
    dealt = attach(sized, materialize(held, "blocks"), "loose").withColumn("block", own).withColumn("other", F.explode(others))
    return dealt.select("loose", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), "block", "set_id", "copies", "shingles")


def jaccard_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.8, width: int = 5, recall: float = 0.995) -> DataFrame:
    """(id, class_id, n_links, n_copies) for each distinct id and text of docs.

    class_id is the smallest id of the connected group of texts; n_links counts the other documents
    at the threshold, copies among them; n_copies those of the same words, itself included.

    Repeated rows count once. A text without words (null, empty, marks only) has no shingles and is a
    class of its own; so is a row with a null id, whose class_id is null. A very long text is one set, whose shingles
    must fit in a task. Columns besides the two are not looked at, whatever their names. An empty table gives no rows.
    """
    runs = runs_for(threshold, recall)
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    named = docs.filter("id IS NOT NULL")
    rows = materialize(named.mapInArrow(_sketched(width, runs), "id long, high long, low long, sketch binary, path array<bigint>"), "sketched")
    members = rows.select("id", "high", "low").distinct()
    sets = materialize(members.groupBy("high", "low").agg(F.min("id").alias("set_id"), F.count("*").alias("copies")), "sets")
    first = sets.join(rows, (sets.high == rows.high) & (sets.low == rows.low) & (sets.set_id == rows.id)).select("set_id", "sketch", "path").dropDuplicates(["set_id"])
    loose = materialize(components(_loose_edges(materialize(first, "first"), runs, threshold - SLACK)), "loose")

    wanted = materialize(loose.join(sets, loose.node == sets.set_id).select("set_id", F.col("label").alias("loose"), "copies", "high", "low"), "wanted")
    side = F.broadcast(wanted) if wanted.limit(BROADCAST + 1).count() <= BROADCAST else wanted
    texts = named.join(side, named.id == side.set_id).select("set_id", "loose", "copies", "high", "low", "text")
    shingled = materialize(texts.mapInArrow(_shingled(width), "set_id long, loose long, copies long, size long, shingles binary").dropDuplicates(["set_id"]), "shingled")
    keys = ["loose", "block_a", "block_b"]
    met = _meetings(shingled, threshold).repartition(*keys).sortWithinPartitions(*keys)
    links = materialize(met.mapInArrow(_exact_links(threshold), "set_id long, root long, links long"), "links")
    classes = components(links.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    decided = (
        sets.join(linked, "set_id", "left")
        .join(classes.withColumnRenamed("node", "set_id"), "set_id", "left")
        .select("high", "low", F.coalesce("label", "set_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    )
    with_words = members.join(decided, ["high", "low"]).select("id", "class_id", "n_links", "n_copies")
    wordless = docs.filter(F.col("id").isNull() | ~F.lower(F.coalesce("text", F.lit(""))).rlike("[0-9a-z\\x{80}-\\x{10FFFF}]"))
    alone = wordless.distinct().select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return with_words.union(alone).withColumnRenamed("id", id_column)
