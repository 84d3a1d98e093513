"""An exact Jaccard join of documents' shingle sets as a metric-space join.

Jaccard distance is a metric, but texts without a common shingle are all at distance 1 from each other, so a few
documents as pivots part nothing. The join therefore goes from coarse to fine, and each step loses no link:

1. Equal sets are one node. A set can only link if three quarters of its shingles are in other sets too, for
   its partner has them. Shingles are counted over all documents, in ranges of hash space, and what fails goes.
2. The least pivots are single shingles: a set is at distance below 1 from just those in it. Ordered by rarity, the
   first pivot of a set is its Voronoi region. A partner lacks at most a quarter of the set, so replicating the set
   into the regions of the first pivots of this quarter and one more is a window that no partner escapes.
   Regions that share sets are one; rare pivots come first, so passages that many documents share join nothing.
   Shingles that very many sets hold are the last in this order, and are known by a filter, so none is counted twice.
3. In a region documents are the pivots. Sets go to the Voronoi cell of the nearest pivot and, by the triangle
   inequality, to every cell whose pivot is at most twice the radius farther and shares a shingle; sets far from all
   pivots are a cell of their own, which needs no window. Cells are joined in turn, until they are small: by tasks
   that hold a block of the region and all its pivots, while cells are large, and within one task from then on.
   Links to pivots are found on the way, and pairs already in one component need no look.
4. Cells that pivots don't part, since all are near all, are dealt into blocks, which are joined on their own. What
   they leave in more than one component is compared with everything outside it, block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, spread_join, table
from .components import components
from .shingles import mixed, set_id, shingle_sets
from .vector_dedup import arrow_rows

#: A link: 100 times the intersection is at least 75 times the union.
PERCENT = 75
RADIUS = 1 - PERCENT / 100
#: Shingles of a range and of a message of one task, sets of a block, and of a cell that is joined as it is.
RANGE, MESSAGE, BLOCK, LEAF = 2_000_000, 1_000_000, 1_000, 8
#: Ranges there are at least, so that small tables are dealt evenly too.
LEAST_RANGES = 24
#: Pivots of a cell within a task, and on average of one that many tasks share; how often the latter are parted.
PIVOTS, FAR_PIVOTS, LEVELS = 8, 16, 8
#: Sets that hold a shingle from which on it is known by a filter only.
HOT = 1_000
#: Bits of a filter for each entry, and at most: 32 MB. Fuller filters let more pass, which loses nothing.
ENTRY_BITS, MOST_BITS = 16, 1 << 28
#: Documents handed to Python at once.
DOCS = 500


def linked(common, n, m):
    return 100 * common >= PERCENT * (n + m - common)


def least_common(n):
    """The least intersection that a set of ``n`` can link with."""
    return -(-n * PERCENT // 100)


def voronoi(far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells from the distances ``far`` of pivots (rows) to sets: which sets each cell has, and which cells own any.

    The last cell has the sets that are far from all pivots. Let x and y link, and p be the pivot nearest to y, less
    than 1 - RADIUS away. Then x shares a shingle with p, and is at most twice RADIUS farther from it than from its own
    nearest pivot, so both are in the cell of p. If both are far from all pivots, they are in the last cell; if only
    one is, it is x for the pivot of the other."""
    near = far.min(axis=0) if len(far) else np.ones(far.shape[1])
    lone = near >= 1 - RADIUS
    inside = (far < 1) & (far <= near + 2 * RADIUS + 1e-9)
    owners = np.append(np.bincount(far.argmin(axis=0)[~lone], minlength=len(far)) > 0 if len(far) else np.zeros(0, bool), lone.any())
    return np.vstack([inside, lone]), owners


def separate(between: np.ndarray) -> list[int]:
    """Pivots that are far from each other, in their order, by the distances between them: others would only share cells."""
    chosen: list[int] = []
    for i, row in enumerate(between):
        if (row[chosen] >= 1 - RADIUS).all():
            chosen.append(i)
    return chosen


def parted(sizes, whole: int) -> bool:
    """Whether cells of these sizes are worth being joined apart, in place of the whole."""
    return sum(sizes) <= 1.5 * whole and max(sizes) <= 0.75 * whole


# ---------------------------------------------------------------- one region, in one task


class Join:
    """Links among sets held in memory. ``sets``: sorted arrays of hashes; ``root``: which are known to be connected."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        _, self.items = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
        self.root = np.arange(len(sets))
        self.edges: list[tuple[int, int]] = []
        self.splits = 0
        order = np.argsort(self.items, kind="stable")
        self.holders = np.repeat(np.arange(len(sets)), self.size)[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.items))]) if len(self.items) else np.zeros(1, np.int64)

    def common(self, x: int) -> np.ndarray:
        """Sizes of the intersections of set ``x`` with all sets."""
        items = self.items[self.ends[x] : self.ends[x + 1]]
        begin, n = self.starts[items], self.starts[items + 1] - self.starts[items]
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.holders[at], minlength=len(self.size))

    def connect(self, x: int, others: np.ndarray) -> None:
        for y in others:
            a, b = self.root[x], self.root[y]
            if a != b:
                self.edges.append((x, int(y)))
                self.root[self.root == max(a, b)] = min(a, b)

    def look(self, x: int) -> np.ndarray:
        """Connect ``x`` with all that it links to; its distances to all sets."""
        common = self.common(x)
        union = self.size + self.size[x] - common
        near = np.flatnonzero(linked(common, self.size[x], self.size))
        self.connect(x, near[self.root[near] != self.root[x]])
        return 1 - common / np.maximum(union, 1)

    def cell(self, own: np.ndarray, known: list[np.ndarray]) -> None:
        """Join the sets ``own``. ``known``: distances to earlier pivots, for windows of the triangle inequality."""
        todo = [(own, known)]
        while todo:
            own, known = todo.pop()
            if len(np.unique(self.root[own])) < 2:
                continue
            if len(own) > LEAF:
                pivots = own[np.linspace(0, len(own) - 1, max(2, min(PIVOTS, len(own) // 4))).astype(np.int64)]
                far = [self.look(int(p)) for p in pivots]
                far = [far[i] for i in separate(np.stack([d[pivots] for d in far]))]
                inside, owners = voronoi(np.stack([d[own] for d in far]))
                inside = inside[owners]
                if parted(inside.sum(axis=1), len(own)):
                    self.splits += 1
                    todo += [(own[row], far) for row in inside]
                    continue
                known = [*known, *far]  # all are near all: cells would be copies of the whole
            self.pairs(own, known)

    def pairs(self, own: np.ndarray, known: list[np.ndarray]) -> None:
        """Join the sets ``own`` one by one, each only if some other may link to it that isn't connected yet."""
        far = np.stack([d[own] for d in known]) if known else np.zeros((0, len(own)))
        size = self.size[own]
        for i, x in enumerate(own):
            fit = self.root[own] != self.root[x]
            fit &= (100 * size >= PERCENT * size[i]) & (PERCENT * size <= 100 * size[i])
            if fit.any():
                fit &= (np.abs(far - far[:, i : i + 1]) <= RADIUS + 1e-9).all(axis=0)
            if fit.any():
                self.look(int(x))

    def all(self) -> list[tuple[int, int]]:
        self.cell(np.arange(len(self.size)), [])
        return self.edges

    def across(self, asked: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
        """Connect each of ``asked`` with sets of another ``group``."""
        for x in asked:
            if (self.root[group != group[x]] != self.root[x]).any():
                self.look(int(x))
        return self.edges


# ---------------------------------------------------------------- counting shingles over all documents


def _sets(batch: pa.RecordBatch):
    return shingle_sets(t.as_buffer().to_pybytes() if t.is_valid else None for t in batch["text"].cast(pa.binary()))


#: Stands for the sets of a message where several hold a shingle. Sets of a message are fewer.
MANY = 2**16 - 1


def _ranged(rows_of, ranges: int, once: bool = False):
    """Messages of (range, keys, of, nodes, held): shingles of many sets by range.

    With ``once`` a shingle that several sets of a message hold is in it once, held by MANY, so that no range gets more
    of one shingle than there are messages; ``held`` is the number of sets of each such shingle, in their order. A
    message (None, counts, None, nodes, None) has how many of those each set has."""
    nodes, sets, total = [], [], 0

    def send():
        keys = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
        slot = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        if once:  # equal is what the ranges take for equal: what a set has twice then isn't lost either
            short = slot.astype(np.uint64) << np.uint64(8 * KEY) | keys & np.uint64(2 ** (8 * KEY) - 1)
            order = np.argsort(short)
            short, of = short[order], of[order]
            starts = np.concatenate([[0], np.flatnonzero(short[1:] != short[:-1]) + 1])
            times = np.diff(np.append(starts, len(short)))
            many = times > 1
            counts = np.bincount(of[np.repeat(many, times)], minlength=len(sets))
            of[starts[many]] = MANY
            order, of = order[starts], of[starts]
            keys, slot = keys[order], slot[order]
            if counts.any():
                yield None, counts[counts > 0], None, np.array(nodes, np.uint64)[counts > 0], None
        else:
            order = np.argsort(slot, kind="stable")
            keys, of, slot, times = keys[order], of[order], slot[order], np.ones(len(keys), np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(slot)) + 1, [len(slot)]])
        for a, b in zip(cuts, cuts[1:]):
            one = of[a:b] != MANY
            used, local = np.unique(of[a:b][one], return_inverse=True)
            held = np.full(b - a, MANY)
            held[one] = local
            yield int(slot[a]), keys[a:b], held, np.array([nodes[u] for u in used], np.uint64), times[a:b][~one]

    for node, s in rows_of:
        nodes.append(node)
        sets.append(s)
        total += len(s)
        if total >= MESSAGE or len(sets) >= 60_000:
            yield from send()
            nodes, sets, total = [], [], 0
    if total:
        yield from send()


ROW = pa.schema([("slot", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("keys", pa.binary()), ("of", pa.binary()), ("nodes", pa.binary()), ("counts", pa.binary())])
ROW_SQL = "slot int, doc_id long, n long, node long, keys binary, of binary, nodes binary, counts binary"


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


#: Bytes of a shingle in a message: with its range, enough to tell which are equal but for one in thousands, and
#: one that is taken for shared only keeps a set for the next step. Bytes of a node's name, of which no two are
#: expected to be equal among less than ten million; a pair of them would have to link besides.
KEY, NAME = 5, 6
#: Bits beside a shingle in 64: so many sets of a range can be told apart in one number with it.
BESIDE = 64 - 8 * KEY


def _low(x: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, ``width`` of each."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def _messages(docs: DataFrame, ranges: int) -> DataFrame:
    """A row per document (doc_id, n, node) and messages of its partition's shingles by range."""

    def run(batches):
        seen: set[int] = set()
        held: list = []

        def documents():
            for batch in batches:
                ids = batch["doc_id"].to_pylist()
                for doc_id, s in zip(ids, _sets(batch)):
                    node = set_id(s)
                    held.append((doc_id, len(s), node))
                    if len(s) and node not in seen:  # copies within a partition count once
                        seen.add(node)
                        yield node, s

        def rows():
            while held:
                part, held[:] = held[:10_000], held[10_000:]
                yield pa.RecordBatch.from_pylist([{"slot": i % ranges, "doc_id": d, "n": n, "node": signed(node)} for i, (d, n, node) in enumerate(part)], ROW)

        for slot, keys, local, nodes, times in _ranged(documents(), ranges, once=True):
            if slot is None:
                yield pa.RecordBatch.from_pylist([{"slot": int(nodes[0]) % ranges, "nodes": _low(nodes, NAME), "counts": keys.astype(np.uint32).tobytes()}], ROW)
                continue
            yield pa.RecordBatch.from_pylist([{"slot": slot, "keys": _low(keys, KEY), "of": local.astype(np.uint16).tobytes(), "nodes": _low(nodes, NAME), "counts": times.astype(np.uint32).tobytes()}], ROW)
            if len(held) >= 10_000:
                yield from rows()
        yield from rows()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROW_SQL)


def _shared(keys: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """For each of ``owners`` how many of its keys another one has too. Pairs of a key and an owner may repeat."""
    if owners <= 1 << BESIDE:
        pairs = np.unique(keys << np.uint64(BESIDE) | owner.astype(np.uint64))
        keys, owner = pairs >> np.uint64(BESIDE), (pairs & np.uint64(2**BESIDE - 1)).astype(np.int64)
    else:
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
        keys, owner = keys[first], owner[first]
    same = keys[1:] == keys[:-1]
    return np.bincount(owner[np.concatenate([[False], same]) | np.concatenate([same, [False]])], minlength=owners)


def _count_shared(buckets: int):
    """Of one range: its documents' rows, for each node how many of its shingles another node has too, by bucket of
    nodes, and the shingles that HOT sets or more hold.

    A copy of a set in another partition may count what its messages shared once more; that only keeps a set."""

    def run(group: pa.Table) -> pa.Table:
        messages = group.filter(pc.is_valid(group["keys"]))
        counted = group.filter(pc.and_(pc.is_valid(group["counts"]), pc.is_null(group["keys"])))
        out = [group.filter(pc.is_valid(group["node"]))]
        if messages.num_rows or counted.num_rows:
            of, names, at = [np.zeros(0, np.int64)], [], 0
            for o, n in zip(messages["of"], messages["nodes"]):
                of.append(np.frombuffer(o.as_py(), np.uint16).astype(np.int64))
                of[-1] = np.where(of[-1] == MANY, -1, of[-1] + at)
                names.append(_wide(n.as_py(), NAME))
                at += len(names[-1])
            names += [_wide(n.as_py(), NAME) for n in counted["nodes"]]
            keys = np.concatenate([np.zeros(0, np.uint64), *(_wide(k.as_py(), KEY) for k in messages["keys"])])
            before = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(c.as_py(), np.uint32) for c in counted["counts"])])
            nodes, dense = np.unique(np.concatenate(names), return_inverse=True)
            of = np.concatenate(of)
            held = np.ones(len(of), np.int64)
            if len(of):
                held[of < 0] = np.concatenate([np.frombuffer(c.as_py(), np.uint32) for c in messages["counts"]])
                different, at_key = np.unique(keys, return_inverse=True)
                hot = different[np.bincount(at_key, held) >= HOT]
                if len(hot):
                    out.append(pa.Table.from_pylist([{"slot": int(group["slot"][0].as_py()), "keys": _low(hot, KEY)}], ROW))
            owner = np.append(dense, len(nodes))[of]  # MANY is one more, unlike any node
            counts = _shared(keys, owner, len(nodes) + 1)[:-1] + np.bincount(dense[at:], before, minlength=len(nodes)).astype(np.int64)
            bucket = (nodes % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(bucket[counts > 0]):
                own = (bucket == b) & (counts > 0)
                out.append(pa.Table.from_pylist([{"slot": int(b), "nodes": _low(nodes[own], NAME), "counts": counts[own].astype(np.uint32).tobytes()}], ROW))
        return pa.concat_tables([t.cast(ROW) for t in out])

    return run


def _shared_counts(group: pa.Table) -> pa.Table:
    """Of a bucket of nodes: each with its shingles that other nodes have."""
    nodes, dense = np.unique(np.concatenate([_wide(n.as_py(), NAME) for n in group["nodes"]]), return_inverse=True)
    counts = np.concatenate([np.frombuffer(k.as_py(), np.uint32) for k in group["counts"]])
    return pa.table({"name": pa.array(nodes.view(np.int64)), "shared": pa.array(np.bincount(dense, counts).astype(np.int64))})


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of ``hashes`` (h: long): bits in 64-bit words, as many as the entries need, MOST_BITS at most."""
    size = min(MOST_BITS, max(1 << 16, 1 << (ENTRY_BITS * hashes.count()).bit_length()))
    at = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(size - 1), F.shiftrightunsigned(F.col("h"), 32).bitwiseAND(size - 1))).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` (64-bit) the filter may have."""
    last = np.uint64(len(bits) * 64 - 1)
    found = np.ones(len(hashes), bool)
    for at in (hashes & last, (hashes >> np.uint64(32)) & last):
        found &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def hot_names(slot: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """What a shingle is known by in the filter of hot ones: a hash of its range and the bits that travel."""
    return mixed(slot.astype(np.uint64) << np.uint64(8 * KEY) | keys & np.uint64(2 ** (8 * KEY) - 1))


def _hot_hashes(batches):
    for batch in batches:
        for slot, keys in zip(batch["slot"].to_pylist(), batch["keys"]):
            keys = _wide(keys.as_py(), KEY)
            yield pa.RecordBatch.from_arrays([pa.array(hot_names(np.full(len(keys), slot), keys).view(np.int64))], ["h"])


def _member_messages(docs: DataFrame, members, hot, ranges: int) -> DataFrame:
    """Messages of the whole shingles of the sets that may link. ``members``, ``hot``: filters, broadcast.

    Hot shingles don't go to the range that counts holders, but, already marked, to any range for their buckets."""

    def run(batches):
        seen: set[int] = set()

        def documents():
            for batch in batches:
                for s in _sets(batch):
                    if len(s):
                        node = set_id(s)
                        if node not in seen and may_hold(members.value, np.array([node], np.uint64))[0]:
                            seen.add(node)
                            yield node, s

        for slot, keys, local, nodes, _ in _ranged(documents(), ranges):
            known = may_hold(hot.value, hot_names(np.full(len(keys), slot), keys))
            for part, to in ((~known, slot), (known, int(nodes[0]) % ranges)):
                if part.any():
                    marks = {"counts": np.full(part.sum(), EVERYWHERE).astype(np.uint32).tobytes()} if part is known else {}
                    yield pa.RecordBatch.from_pylist([{"slot": to, "keys": keys[part].tobytes(), "of": local[part].astype(np.uint16).tobytes(), "nodes": nodes.tobytes(), **marks}], ROW)

    return docs.select(F.lit(None).cast("long").alias("doc_id"), "text").mapInArrow(run, ROW_SQL)


#: The number of holders of a hot shingle, whatever it is: the most.
EVERYWHERE = 2**32 - 1


def _holders(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and their nodes of the messages in ``group``."""
    keys = [np.frombuffer(k.as_py(), np.uint64) for k in group["keys"]]
    owner = [np.frombuffer(n.as_py(), np.uint64)[np.frombuffer(o.as_py(), np.uint16)] for n, o in zip(group["nodes"], group["of"])]
    return tuple(np.concatenate([np.zeros(0, np.uint64), *x]) for x in (keys, owner))


def _count_holders(buckets: int):
    """Of one range: each node's shingles with the number of nodes that hold them, by bucket of nodes."""

    def run(group: pa.Table) -> pa.Table:
        keys, owner = _holders(group.filter(pc.is_null(group["counts"])))
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys, owner = keys[first], owner[first]
        _, dense, held = np.unique(keys, return_inverse=True, return_counts=True)
        hot_keys, hot_owner = _holders(group.filter(pc.is_valid(group["counts"])))
        held = np.concatenate([held[dense] if len(keys) else held, np.full(len(hot_keys), EVERYWHERE)])
        keys, owner = np.concatenate([keys, hot_keys]), np.concatenate([owner, hot_owner])
        bucket = (owner % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, owner, held, bucket = keys[order], owner[order], held[order], bucket[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        out = [{"slot": int(bucket[a]), "keys": keys[a:b].tobytes(), "nodes": owner[a:b].tobytes(), "counts": held[a:b].astype(np.uint32).tobytes()} for a, b in zip(cuts, cuts[1:]) if b > a]
        return pa.Table.from_pylist(out, ROW)

    return run


def _windows(group: pa.Table) -> pa.Table:
    """Sets of a bucket of nodes, with their window of pivots: the rarest shingles, as many as a partner may lack and one more.

    Any order that all sets agree on will do; hot shingles are last, among themselves by their hash."""
    nodes, keys = (np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group[c]]) for c in ("nodes", "keys"))
    held = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group["counts"]])
    order = np.lexsort((keys, held, nodes))
    nodes, keys, held = nodes[order], keys[order], held[order]
    first = np.ones(len(keys), bool)  # copies of a set in several partitions send their hot shingles more than once
    first[1:] = (nodes[1:] != nodes[:-1]) | (keys[1:] != keys[:-1])
    nodes, keys, held = nodes[first], keys[first], held[first]
    cuts = np.concatenate([[0], np.flatnonzero(nodes[1:] != nodes[:-1]) + 1, [len(nodes)]])
    out = {"node": [], "n": [], "shingles": [], "pivots": []}
    for a, b in zip(cuts, cuts[1:]):
        pivots = keys[a : a + (b - a) - least_common(b - a) + 1]
        shared = pivots[held[a : a + len(pivots)] > 1]
        if len(shared):
            out["node"].append(signed(int(nodes[a])))
            out["n"].append(b - a)
            out["shingles"].append(np.sort(keys[a:b]).tobytes())
            out["pivots"].append(shared.view(np.int64))
    return pa.table({"node": pa.array(out["node"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "shingles": pa.array(out["shingles"], pa.binary()), "pivots": pa.array(out["pivots"], pa.list_(pa.int64()))})


def by_slot(rows: DataFrame, slots: int, of, schema: str) -> DataFrame:
    """``of`` over the rows of each ``slot`` (0 to ``slots`` - 1), each slot a task of its own."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            yield from of(pa.Table.from_batches(batches)).to_batches()

    return rows.repartitionById(slots, F.col("slot")).mapInArrow(run, schema)


# ---------------------------------------------------------------- regions


#: A node is known by the least id of its rows and the name of its set, so that components are named by least ids.
NODE = pa.struct([("first", pa.int64()), ("node", pa.int64())])
EDGE = "a struct<first: long, node: long>, b struct<first: long, node: long>"


def _edges(group: pa.Table, edges: list[tuple[int, int]]) -> pa.Table:
    ends = pa.StructArray.from_arrays([group[c].combine_chunks() for c in ("first", "node")], ["first", "node"])
    return pa.table({c: ends.take(pa.array([e[i] for e in edges], pa.int64())).cast(NODE) for i, c in enumerate("ab")})


def _sets_of(group: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in group["shingles"]]


def _roots(names: list) -> np.ndarray:
    """For rows by the name of their component the first row of each."""
    first: dict = {}
    return np.array([first.setdefault(c, i) for i, c in enumerate(names)], np.int64)


def _join_group(group: pa.Table) -> pa.Table:
    """Links of the sets of a group; ``comp``, if there, says which are connected already."""
    join = Join(_sets_of(group))
    if "comp" in group.column_names:
        join.root = _roots([tuple(c.values()) for c in group["comp"].to_pylist()])
    return _edges(group, join.all())


def _join_across(group: pa.Table) -> pa.Table:
    """Links of the sets that ask with the sets of a block, between different components."""
    join = Join(_sets_of(group))
    join.root = _roots([tuple(c.values()) for c in group["comp"].to_pylist()])
    asks = group["asks"].to_numpy(zero_copy_only=False)
    return _edges(group, join.across(np.flatnonzero(asks), join.root.copy()))


CELLS = f"cell long, node long, first long, child long, {EDGE}"


def _to_cells(group: pa.Table) -> pa.Table:
    """Of a block of a cell and all pivots of the cell: the cells that each set of the block goes to, and its links to pivots."""
    pivot = group["pivot"].to_numpy(zero_copy_only=False)
    join = Join(_sets_of(group))
    nodes, cell = group["node"].to_numpy(), np.uint64(group["cell"][0].as_py() % 2**64)
    at, own, edges = np.flatnonzero(pivot), np.flatnonzero(~pivot), []
    at = at[np.argsort(nodes[at], kind="stable")]  # the same pivots are chosen for all blocks
    far = np.zeros((len(at), len(pivot)))
    for row, p in enumerate(at):
        common = join.common(int(p))
        far[row] = 1 - common / np.maximum(join.size + join.size[p] - common, 1)
        near = own[linked(common, join.size[p], join.size)[own] & (nodes[own] != nodes[p])]
        edges += [(int(x), int(p)) for x in near]
    chosen = separate(far[:, at])
    at, far = at[chosen], far[chosen][:, own]
    inside, _ = voronoi(far)
    names = np.append(nodes[at].view(np.uint64), np.uint64(0))
    child = mixed(mixed(names + np.uint64(1)) ^ cell).view(np.int64)
    to, of = np.nonzero(inside)
    placed = pa.table({
        "cell": pa.array(np.full(len(to), cell).view(np.int64)), "node": pa.array(nodes[own[of]]), "first": group["first"].combine_chunks().take(pa.array(own[of])),
        "child": pa.array(child[to]), "a": pa.nulls(len(to), NODE), "b": pa.nulls(len(to), NODE),
    })
    linked_ = _edges(group, edges)
    none = {c: pa.nulls(len(edges), pa.int64()) for c in ("cell", "node", "first", "child")}
    return pa.concat_tables([placed, pa.table({**none, "a": linked_["a"], "b": linked_["b"]})])


def blocks(members: str = "members"):
    return F.greatest(F.lit(1), F.ceil(F.col(members) / BLOCK))


def part_cells(sets: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Part large cells by pivots, level by level: what one task can join, what pivots don't part, and links to pivots.

    ``sets``: node, first, shingles; ``cells``: cell, node. The first two come as (cell, node, and members of the second)."""
    small, tight, edges = None, None, None
    add = lambda x, y: y if x is None else x.unionByName(y)
    for level in range(LEVELS + 1):
        cells = settled(cells)
        sizes = cells.groupBy("cell").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK)
        sizes = settled(sizes)
        if not sizes.limit(1).count():
            return add(small, cells.select("cell", "node")), tight, edges
        known = settled(spread_join(cells, sizes, "cell", "node", "left"))
        small = add(small, known.where("members is null").select("cell", "node"))
        large = known.where("members is not null")
        if level == LEVELS:
            return small, add(tight, large.select("cell", "node", "members")), edges
        held = large.join(sets, "node").withColumn("block", F.pmod(F.xxhash64("node"), blocks()))
        chance = F.pmod(F.xxhash64("node", F.lit(level)), F.col("members")) < FAR_PIVOTS
        pivots = held.where(chance).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks().cast("long") - 1)))
        columns = ["cell", "block", "node", "first", "shingles"]
        both = held.select(*columns, F.lit(False).alias("pivot")).unionByName(pivots.select(*columns, F.lit(True).alias("pivot")))
        found = settled(both.groupBy("cell", "block").applyInArrow(_to_cells, CELLS))
        edges = add(edges, found.where("a is not null").select("a", "b"))
        placed = found.where("child is not null")
        sized = placed.groupBy("cell", "child").agg(F.count("*").alias("n")).groupBy("cell").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
        apart = sized.join(sizes, "cell").where((F.col("total") <= 1.5 * F.col("members")) & (F.col("most") <= 0.75 * F.col("members"))).select("cell", F.lit(True).alias("parted"))
        apart = settled(apart)
        tight = add(tight, spread_join(large, apart, "cell", "node", "left").where("parted is null").select("cell", "node", "members"))
        cells = spread_join(placed.select("cell", "child", "node"), apart, "cell", "node").select(F.col("child").alias("cell"), "node")
    raise AssertionError


def join_regions(sets: DataFrame, regions: DataFrame) -> DataFrame:
    """Edges that connect all linked sets. ``sets``: node, first, shingles; ``regions``: node, region."""
    small, tight, edges = part_cells(sets, regions.select(F.col("region").alias("cell"), "node"))
    own = small.join(sets, "node").select("cell", "node", "first", "shingles")
    found = settled(own.groupBy("cell").applyInArrow(_join_group, EDGE))
    edges = found if edges is None else settled(edges.unionByName(found))
    if tight is None or not tight.limit(1).count():
        return edges
    whole = settled(tight.join(sets.select("node", "first"), "node").withColumn("self", F.struct("first", "node")))
    shingles = sets.select("node", "shingles")

    def known() -> tuple[DataFrame, DataFrame, DataFrame]:
        """The sets of tight cells with their component, the components of each cell, and their number and the largest."""
        comp = components(edges).select(F.col("node").alias("self"), F.col("component").alias("comp"))
        rows = settled(whole.join(comp, "self", "left").withColumn("comp", F.coalesce("comp", "self")))
        parts = rows.groupBy("cell", "comp").agg(F.count("*").alias("n"), F.min_by("node", F.hash("node")).alias("one"))
        most = parts.groupBy("cell").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("comps"))
        return rows, settled(parts), settled(most.where("comps > 1").select("cell", F.col("m.comp").alias("most"), (F.col("all") - F.col("m.n")).alias("rest"), "comps"))

    columns = ["cell", "block", "node", "first", "shingles", "comp"]
    rows, parts, most = known()
    if most.limit(1).count():
        open_ = settled(spread_join(rows, most.select("cell", "comps"), "cell", "node"))
        dealt = open_.withColumn("block", F.pmod(F.xxhash64("node"), blocks())).join(shingles, "node").select(*columns)
        edges = settled(edges.unionByName(dealt.groupBy("cell", "block").applyInArrow(_join_group, EDGE)))
        rows, parts, most = known()
    if most.limit(1).count():
        # One set of each component meets those of others: what copies of one text leave is joined here.
        some = spread_join(parts, most, "cell", "one").withColumn("block", F.pmod(F.xxhash64("one", F.lit(1)), blocks("comps")))
        met = some.select("cell", "block", F.col("one").alias("node"), "comp").join(sets, "node").select(*columns)
        edges = settled(edges.unionByName(met.groupBy("cell", "block").applyInArrow(_join_group, EDGE)))
        rows, parts, most = known()
    if not most.limit(1).count():
        return edges
    # Sets outside the largest component of their cell ask all others of it, chunk by chunk and block by block.
    open_ = settled(spread_join(rows, most, "cell", "node").join(shingles, "node"))
    whole_blocks, chunks = blocks().cast("long"), blocks("rest").cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asked = open_.select(*[c for c in columns if c != "block"], F.pmod(F.xxhash64("node"), whole_blocks).alias("block"), each(chunks).alias("chunk"), F.lit(False).alias("asks"))
    asking = open_.where("comp <> most").select(*[c for c in columns if c != "block"], each(whole_blocks).alias("block"), F.pmod(F.xxhash64("node", F.lit(2)), chunks).alias("chunk"), F.lit(True).alias("asks"))
    both = asked.unionByName(asking.select(asked.columns))
    return settled(edges.unionByName(both.groupBy("cell", "block", "chunk").applyInArrow(_join_across, EDGE)))


#: The id of rows without one, in names of nodes: after all others.
NO_ID = 2**63 - 1


def linked_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per row of ``docs`` its doc_id, n and node (the name of its set); per node its first id; and edges that connect all nodes that link."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(1 << BESIDE, max(LEAST_RANGES, -(-int(size) // (6 * RANGE))))
    with arrow_rows(spark, DOCS):
        counted = settled(by_slot(_messages(docs, ranges), ranges, _count_shared(ranges), ROW_SQL))
        rows = counted.where("node is not null").select("doc_id", "n", "node")
        shared = by_slot(counted.where("counts is not null"), ranges, _shared_counts, "name long, shared long")
        named = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("first"))
        named = settled(named.withColumn("name", F.col("node").bitwiseAND((1 << 8 * NAME) - 1)))
        members = settled(named.join(shared, "name").where(F.col("shared") * 100 >= F.col("n") * PERCENT).select("node", "first"))
        hot = counted.where("keys is not null and nodes is null").select("slot", "keys").mapInArrow(_hot_hashes, "h long")
        filters = [spark.sparkContext.broadcast(bit_filter(settled(x))) for x in (members.select(F.col("node").alias("h")), hot)]
        held = by_slot(_member_messages(docs, *filters, ranges), ranges, _count_holders(ranges), ROW_SQL)
        sets = settled(by_slot(held, ranges, _windows, "node long, n long, shingles binary, pivots array<long>"))
    pivots = sets.select("node", F.explode("pivots").alias("pivot"))
    first = pivots.groupBy("pivot").agg(F.min("node").alias("least"), F.count("*").alias("k")).where("k > 1")
    star = spread_join(pivots, first, "pivot", "node").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    regions = components(star).withColumnRenamed("component", "region")
    return rows, named.select("node", "first"), join_regions(sets.join(members, "node").select("node", "first", "shingles"), regions)


def _named(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` doc_id, n, node (the name of its set), comp (of its component) and component_id.

    A row without shingles is a component of its own: comp is null."""
    rows, nodes, edges = linked_sets(docs)
    comp = components(edges).select(F.col("node").alias("self"), "component")
    nodes = nodes.withColumn("self", F.struct("first", "node")).join(comp, "self", "left").select("node", F.coalesce("component", "self").alias("c"))
    named = nodes.select("node", F.col("c.node").alias("comp"), F.nullif(F.col("c.first"), F.lit(NO_ID)).alias("component_id"))
    found = spread_join(rows.where("n > 0"), named, "node", "doc_id").select("doc_id", "n", "node", "comp", "component_id")
    return found.unionByName(rows.where("n = 0").select("doc_id", "n", "node", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id")))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    A null text or one without words has no shingles and links with nothing; one of fewer than five words is one
    shingle. Rows with equal sets are in one component; a component is named by its smallest id, nulls aside.
    A row without id gets its component's name, null if there is none. Other columns are ignored."""
    return _named(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def _with_node(docs: DataFrame) -> DataFrame:
    """``docs`` as a struct ``row``, with the name of the set of its text as ``node``."""

    def run(batches):
        for batch in batches:
            nodes = pa.array([signed(set_id(s)) for s in _sets(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], [*batch.schema.names, "node"])

    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return row.mapInArrow(run, f"row {row.schema['row'].dataType.simpleString()}, text string, node long")


def near_duplicates_dropped(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that name their component: of each group of near copies the document with the smallest id.

    Rows without an id stay; of rows that repeat an id and a text one stays. Rows that repeat an id with unlinked texts
    are in different groups, each of which keeps its own; of a group's rows with one id the least set's and text stays."""
    named = settled(_named(docs).where("doc_id is not null").select("doc_id", "node", "comp", "component_id"))
    no_id, with_id = docs.where("doc_id is null"), docs.where("doc_id is not null")
    naming = named.where("doc_id = component_id")
    repeated = settled(named.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = naming.select("doc_id").distinct()
    if not repeated.limit(1).count():
        return with_id.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(no_id)
    once = with_id.join(repeated, "doc_id", "left_anti").join(kept, "doc_id", "left_semi").select(*docs.columns)
    # Rows of one id are told apart by their sets.
    chosen = naming.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "node")).alias("m")).select("m.*")
    chosen = chosen.unionByName(naming.where("comp is null").select("doc_id", "node").distinct())
    chosen = chosen.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    some = _with_node(with_id.join(repeated, "doc_id", "left_semi").select(*docs.columns))
    some = some.join(chosen, (F.col("row.doc_id") == F.col("_id")) & (F.col("node") == F.col("_node")))
    # Texts without words are no copies of each other: each stays once.
    some = some.groupBy("_id", "node", F.when(F.col("node") == signed(set_id(np.zeros(0, np.uint64))), F.col("text")).alias("own"))
    some = some.agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return once.unionByName(some).unionByName(no_id)


OP4_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end g from w),
e as (select doc_id, len(g) n, unnest(g) t from s),
p as (select a.doc_id a, b.doc_id b, count(*) c, any_value(a.n) n, any_value(b.n) m from e a join e b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p where 100 * c >= 75 * (n + m - c)),
l2 as (select a, b from l union all select b, a from l),
r as (select doc_id a, doc_id b from documents union select r.a, l2.b from r join l2 on l2.a = r.b),
c as (select a, min(b) component_id from r group by a)
select s.doc_id, len(g)::bigint n_shingles, component_id from s join c on c.a = s.doc_id
"""
