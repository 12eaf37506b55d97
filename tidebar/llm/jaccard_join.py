"""N-gram Jaccard join by universe partitions (operator 4).

Sets link when intersection / union >= threshold. A linked pair of sizes r and s differs in at most
H = (r + s) (1 - t) / (1 + t) elements.

Signatures. Sizes fall into bands. For a band, hashing cuts the universe into segments; a set's non-empty segments,
each with all elements in it, are its tokens. Linked sets differ in at most H of them. Tokens are ordered by cost
(how common the rarest element of the segment is, by a fixed-size count sketch of the corpus) and a set gives out
only its H + 1 cheapest; by the prefix principle two linked sets still share one. A set with no more than H
non-empty segments gives out its segments' one-deletion neighbourhoods as well (two such sets share one, as
evading a segment of several elements takes two differences), and single elements where even these are too few. A
set also signs in the band below when partners can be there. Costs only order tokens: no result depends on them.

Candidates. Tokens go, packed, to hash buckets; sets that share one form a group, and groups of equal members are
one group. Tokens that the sketch calls common aren't gathered: each of their sets is a row. First each set is
verified against one member of its groups. What these links join needs no more work.

Large groups that still hold several components are never paired: their sets are recoded by how they differ from
the group's centre. If X and Y link and not both link with the centre, their differences from it overlap in a known
number of elements, so that cheapest-first prefixes of the differences share one (see edit_tokens); these are new,
smaller groups. Pairs of different components within small groups are verified, if sizes and parity
sketches (whose differing bits are at most the differing elements) allow: first the likeliest pair of each two
components, in the end all that are still apart. Verification counts exactly.

Equal sets are one node throughout, named by 128 bits, so copies are never expanded into pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, WordHashes, frugal, grams, in_batches, keep, mix, partitions, raw_texts, sum_blobs
from .components import components
from .substring_dedup import _rows, by_batch, split_by_top_bits

CELLS = 1 << 19
BANDS = [4**k for k in range(16)]
PARITY = 1024
WORDS = PARITY // 64
WIDE = 8192
NODE = "doc_id long, bid long, row long, n_shingles long, node binary, " + ", ".join(f"p{i} long" for i in range(WORDS)) + ", counts binary"
TOKENS = "bucket long, blob binary"
GROUPS = "gid long, nodes array<binary>"
RECODED = "u binary, v binary, linked boolean, edits array<long>"
SLICE = 512
#: Partners of a set that are verified in one task at a time.
LOT = 256
#: Groups with more members outside their largest component are recoded by their centre; in others these are paired with all.
LARGE = 256
#: A large group is recoded so many times; what is then still large is paired.
ROUNDS = 3
#: Where ranges of numbers of differing elements begin: about a quarter more each time.
RANGES = sorted({int(1.25**k) for k in range(130)})
#: Tokens whose rarest element is in about so many documents or more (20 bytes each) aren't gathered in one task.
COMMON = 500_000


class Shingles:
    """Distinct n-word shingles of texts as 64-bit hashes."""

    def __init__(self, n: int):
        self.n, self.hashes = n, WordHashes()

    def __call__(self, text: bytes) -> np.ndarray:
        h = self.hashes.of(text.lower().split())
        if not len(h):
            return np.empty(0, dtype=np.uint64)
        return np.unique(grams(h, min(self.n, len(h))))


def node_of(items: np.ndarray) -> bytes:
    """Name of a set: 128 bits of a cryptographic hash of its sorted elements."""
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _names(nodes: np.ndarray) -> pa.Array:
    """Rows of two 64-bit numbers as binary values."""
    return pa.Array.from_buffers(pa.binary(16), len(nodes), [None, pa.py_buffer(np.ascontiguousarray(nodes))]).cast(pa.binary())


def _lists(nodes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), type=pa.int32()), _names(nodes))


def _nodes(shingle: int):
    """A row for each document; behind them, for each partition, its part of the count sketch of the corpus.

    The sketch says how many documents hold an element of each of CELLS hash cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, acc = Shingles(shingle), np.zeros(CELLS)
        names = [c.split()[0] for c in NODE.split(", ")]
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                items = [sets(t) for t in raw_texts(batch.column("text"))]
                size = np.array([len(x) for x in items], dtype=np.int64)
                flat = np.concatenate(items)
                acc += np.bincount((flat & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                cell = np.repeat(np.arange(len(items)), size) * PARITY + (flat & np.uint64(PARITY - 1)).astype(np.int64)
                odd = (np.bincount(cell, minlength=len(items) * PARITY) & 1).astype(np.uint8).reshape(len(items), PARITY)
                sketch = np.packbits(odd, axis=1).view(np.int64)
                columns = [batch.column("doc_id"), batch.column("bid"), batch.column("row"), pa.array(size), pa.array([node_of(x) if len(x) else None for x in items], type=pa.binary())]
                columns += [pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(WORDS)]
                columns.append(pa.nulls(len(items), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary() if n == "node" else pa.int64()) for n in names[:-1]] + [pa.array([acc.tobytes()], type=pa.binary())], names)

    return run


def cost_levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale, as small whole numbers."""
    return np.minimum(255, np.round(12 * np.log1p(counts))).astype(np.uint8)


def signatures(sets: list[np.ndarray], levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the set, token, cost level) of all tokens that the sets give out."""
    out_set, out_token, out_cost = [], [], []
    size = np.array([len(x) for x in sets], dtype=np.int64)
    band = np.searchsorted(BANDS, size, side="right") - 1  # -1: empty
    for b in np.unique(band[band >= 0]):
        for role in (0, 1):
            low = BANDS[b]
            if role and b == 0:
                continue
            top = BANDS[b + 1] - 1 if not role else low - 1  # largest size of the band signed in
            who = np.flatnonzero(band == b)
            if role:
                who = who[size[who] * percent <= 100 * top]
            if not len(who):
                continue
            n = size[who]
            partner = n * 100 // percent if not role else np.full(len(who), top)
            need = (n + partner) * (100 - percent) // (100 + percent) + 1
            tokens = _tokens_in([sets[i] for i in who], n, need, int(b) - role, int(top), levels)
            out_set.append(who[tokens[0]])
            out_token.append(tokens[1])
            out_cost.append(tokens[2])
    if not out_set:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint8)
    return np.concatenate(out_set), np.concatenate(out_token), np.concatenate(out_cost)


def _tokens_in(sets: list[np.ndarray], n: np.ndarray, need: np.ndarray, band: int, segments: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens for one band; need: H + 1 of each set."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint64), n)
    salt = np.uint64((0x5851F42D4C957F2D * (band + 1)) & ((1 << 64) - 1))
    place = (mix(flat ^ salt) >> np.uint64(33)) % np.uint64(segments)
    key = owner << np.uint64(32) | place
    order = np.argsort(key)
    flat, key = flat[order], key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    mixed = mix(flat + salt)
    token = mix(np.add.reduceat(mixed, first) ^ mix(key[first] << np.uint64(32)))
    level = levels[(flat & np.uint64(CELLS - 1)).astype(np.int64)]
    cost = np.minimum.reduceat(level, first)
    holder = (key[first] >> np.uint64(32)).astype(np.int64)
    have = np.bincount(holder, minlength=len(sets))

    by = np.argsort((holder.astype(np.uint64) << np.uint64(40)) | (cost.astype(np.uint64) << np.uint64(32)) | (token >> np.uint64(32)))
    rank = np.arange(len(by)) - np.repeat(np.cumsum(have) - have, have)
    pick = by[rank < need[holder[by]]]
    out = [(holder[pick], token[pick], cost[pick])]

    few = have < need
    if few.any():
        count = np.diff(np.append(first, len(flat)))
        some = few[holder]
        multi = np.bincount(holder, weights=count > 1, minlength=len(sets))
        # the neighbourhood: each whole segment, and it without any one of its elements unless that empties it
        tag = np.uint64(0xA0761D6478BD642F)
        sums = np.add.reduceat(mixed, first)
        where = mix(key[first] << np.uint64(32)) ^ tag
        out.append((holder[some], mix(sums[some] ^ where[some]), cost[some]))
        seg = np.repeat(np.arange(len(first)), count)
        less = some[seg] & (count[seg] > 1)
        # without an element the rarest can be another: the second rarest bounds it
        rest = level.copy()
        rest[np.lexsort((level, seg))[np.cumsum(count) - count]] = 255
        second = np.minimum.reduceat(rest, first)
        out.append((holder[seg[less]], mix((sums[seg[less]] - mixed[less]) ^ where[seg[less]]), second[seg[less]]))
        lone = few & (have + multi < need)
        if lone.any():
            who = (key >> np.uint64(32)).astype(np.int64)
            single = lone[who]
            out.append((who[single], mix(mixed[single] ^ np.uint64(0xE7037ED1A0B428DB)), level[single]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _give_out(shingle: int, levels: np.ndarray, percent: int, bits: int):
    """Tokens and the sets that give them out, packed by hash bucket; common tokens under a negative number of the batch."""
    common = cost_levels(np.array([COMMON]))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingles(shingle)
        for whole in batches:
            for bid, part in by_batch(whole):
                sets = list({x.tobytes(): x for t in raw_texts(part.column("text")) if len(x := made(t))}.values())  # equal sets once
                if not sets:
                    continue
                names = np.frombuffer(b"".join(map(node_of, sets)), dtype=np.uint64).reshape(-1, 2)
                who, token, cost = signatures(sets, levels, percent)
                hot = cost >= common
                rows = [(-1 - (bid & (1 << 62) - 1), token[hot].tobytes() + names[who[hot]].tobytes())] if hot.any() else []
                who, token = who[~hot], token[~hot]
                order = np.argsort(token)
                who, token = who[order], token[order]
                lows = ((token << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                nodes = names[who]
                rows += [(k, lows[a:b].tobytes() + nodes[a:b].tobytes()) for k, a, b in split_by_top_bits(token, bits)]
                yield _rows(TOKENS, rows)

    return run


def _group(key: tuple, table: pa.Table) -> pa.Table:
    """Groups of nodes that share a token; a group is named by its members, so that repeats of it fall together.

    The common tokens of a batch (a negative key) are their groups' names themselves, a row for each member, as the other
    members are elsewhere.
    """
    wide = key[0].as_py() < 0
    low, node = [], []
    for blob in table.column("blob").to_pylist():
        n = len(blob) // (24 if wide else 20)
        low.append(np.frombuffer(blob, dtype=np.uint64 if wide else np.uint32, count=n))
        node.append(np.frombuffer(blob, dtype=np.uint64, offset=(8 if wide else 4) * n).reshape(-1, 2))
    low, node = np.concatenate(low), np.concatenate(node)
    if wide:
        return pa.table({"gid": low.view(np.int64), "nodes": _lists(node, np.ones(len(node), np.int64))})
    order = np.argsort(low, kind="stable")
    low, node = low[order], node[order]
    shared = np.zeros(len(low), dtype=bool)
    same = low[1:] == low[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    low, node = low[shared], node[shared]
    if not len(low):
        return pa.table({"gid": np.empty(0, np.int64), "nodes": _lists(node, np.empty(0, np.int64))})
    order = np.lexsort((node[:, 1], node[:, 0], low))
    low, node = low[order], node[order]
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (node[1:] != node[:-1]).any(1)))
    low, node = low[new], node[new]
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    size = np.diff(np.append(first, len(low)))
    name = mix(np.add.reduceat(mix(node[:, 0] ^ mix(node[:, 1])), first) + size.astype(np.uint64)).view(np.int64)
    _, one = np.unique(name, return_index=True)
    good = np.zeros(len(first), dtype=bool)
    good[one] = True
    good &= size > 1
    return pa.table({"gid": name[good], "nodes": _lists(node[np.repeat(good, size)], size[good])})


def _plausible(x: str, y: str, percent: int) -> Column:
    """What a linked pair meets: sizes, and differing parity bits."""
    a, b = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    apart = sum((F.bit_count(F.col(f"{x}.p{i}").bitwiseXOR(F.col(f"{y}.p{i}"))) for i in range(WORDS)), F.lit(0))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (apart * (100 + percent) <= (a + b) * (100 - percent))


def _beside(pairs: DataFrame, sets: DataFrame, run, schema: str) -> DataFrame:
    """run(u, items of u, partners, their items) -> rows, for pairs (u, v).

    The sets of v go to u's; partners of a u come in lots of LOT at about the most, each with u's set beside it. pairs
    is a kept table, read more than once.
    """

    def meet(held: pa.Table, come: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for u, x in zip(held.column("u1").to_pylist(), held.column("items1").to_pylist()):
            rows += run(u, np.frombuffer(x, dtype=np.uint64), zip(come.column("v2").to_pylist(), come.column("items2").to_pylist()))
        return pa.Table.from_batches([_rows(schema, rows)])

    few = pairs.count() <= BROADCAST_ROWS
    sent = F.broadcast if few else lambda df: df
    lots = pairs.groupBy("u").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    come = pairs.join(lots, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("lots")).cast("int").alias("lot"))
    come = sets.select(F.col("node").alias("v"), "items").join(sent(come), "v").select("u", "v", "lot", "items")
    held = sets.select(F.col("node").alias("u"), "items").join(sent(lots), "u")
    held = held.select("u", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "items")
    held, come = (df.select(*[F.col(c).alias(f"{c}{side}") for c in df.columns]) for df, side in ((held, 1), (come, 2)))
    return held.groupBy("u1", "lot1").cogroup(come.groupBy("u2", "lot2")).applyInArrow(meet, schema)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v) whose sets link, by exact counts."""

    def run(u, a, partners):
        for v, y in partners:
            b = np.frombuffer(y, dtype=np.uint64)
            inter = _common(a, b)
            if 100 * inter >= percent * (len(a) + len(b) - inter):
                yield u, v

    return _beside(pairs, sets, run, "u binary, v binary")


def edit_tokens(x: np.ndarray, centre: np.ndarray, levels: np.ndarray, percent: int) -> tuple[bool, np.ndarray]:
    """Whether x links with the centre, and tokens of how it differs from it.

    With c = (1 - t) / (1 + t), sets link when they differ in c (r + s) elements or fewer. Let E be x's differing
    elements, d their number, and e, y's number. |E of x and y together| = o with 2 o >= d + e - c (|x| + |y|) if x and
    y link, and |y| <= |centre| + e. Bounds on o follow for every range of e; x gives out, for each of RANGES,
    the first d - o + 1 of E, rarest first. If both link with the centre, nothing needs to be found; else, if
    x does and y doesn't, e > c (|y| + |centre|), so 2 o > d - c (|x| - |centre|).
    """
    c = (100 - percent) / (100 + percent)
    edits = np.setxor1d(x, centre, assume_unique=True)
    d = len(edits)
    over = d - c * (len(x) + len(centre))
    linked = d * (100 + percent) <= (len(x) + len(centre)) * (100 - percent)
    own = np.isin(edits, centre, assume_unique=True)
    edits = edits[np.lexsort((edits, levels[(edits & np.uint64(CELLS - 1)).astype(np.int64)], own))]
    least = np.floor((d - c * (len(x) - len(centre))) / 2 - 1e-9) + 1 if linked else np.ceil(over / (1 + c) - 1e-9)
    mine, out = int(np.searchsorted(RANGES, d, side="right")), []
    for band, low in enumerate(RANGES, 1):
        high = RANGES[band] - 1 if band < len(RANGES) else 1 << 62
        shared = int(max(1, least, np.ceil((over + (1 - c) * low) / 2 - 1e-9)))
        if shared > d:
            break
        if shared <= high:
            label = mix(np.array([min(mine, band) * len(RANGES) + max(mine, band)]))
            out.append(mix(edits[: d - shared + 1] ^ label))
    return linked, np.concatenate(out) if out else np.empty(0, np.uint64)


def _recode(pairs: DataFrame, sets: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """For pairs (centre u, v) whether they link, and v's tokens of how it differs from u."""

    def run(u, a, partners):
        for v, y in partners:
            linked, tokens = edit_tokens(np.frombuffer(y, dtype=np.uint64), a, levels, percent)
            yield u, v, linked, tokens.view(np.int64)

    return _beside(pairs, sets, run, RECODED)


def _screen(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs without those whose wide sketches differ in more bits than linked sets have different elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y, size in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("size").to_pylist()):
                bits = int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum())
                good.append(bits * (100 + percent) <= size * (100 - percent))
            yield batch.select(["u", "v", "times"]).filter(pa.array(good, type=pa.bool_()))

    x = sets.select(F.col("node").alias("u"), F.col("n").alias("n1"), F.col("wide").alias("x"))
    y = sets.select(F.col("node").alias("v"), F.col("n").alias("n2"), F.col("wide").alias("y"))
    both = pairs.join(x, "u").join(y, "v").select("u", "v", "times", "x", "y", (F.col("n1") + F.col("n2")).alias("size"))
    return both.mapInArrow(run, "u binary, v binary, times long")


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, n, wide (a parity sketch of WIDE bits) and items (packed) of one document of each wanted node (node, bid, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingles(shingle)
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            items = [made(t) for t in raw_texts(batch.column("text"))]
            wide = [np.packbits(np.bincount((x & np.uint64(WIDE - 1)).astype(np.int64), minlength=WIDE) & 1).tobytes() for x in items]
            columns = [batch.column("node"), pa.array([len(x) for x in items], type=pa.int64()), pa.array(wide, type=pa.binary()), pa.array([x.tobytes() for x in items], type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "wide", "items"])

    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return docs.select("bid", "row", "text").join(wanted, ["bid", "row"]).select("node", "text").mapInArrow(frugal(run), "node binary, n long, wide binary, items binary")


def _with_root(df: DataFrame, node: str, root: str, joined: DataFrame) -> DataFrame:
    """df with the component of column `node`, itself if it is alone."""
    named = joined.select(F.col("u").alias(f"_{root}"), F.col("v").alias(root))
    return df.join(named, F.col(node) == F.col(f"_{root}"), "left").drop(f"_{root}").withColumn(root, F.coalesce(root, node))


def _central(groups: DataFrame) -> DataFrame:
    """gid, u: the member that is in the most groups, for it is likest to the others."""
    often = groups.groupBy("node").agg(F.count("*").alias("often"))
    return groups.join(often, "node").groupBy("gid").agg(F.max(F.struct("often", "node")).alias("x")).select("gid", F.col("x.node").alias("u"))


def _apart(groups: DataFrame, joined: DataFrame) -> DataFrame:
    """gid, node, root, minor, odd of the groups that hold several components.

    minor: not of the component that most members are of; odd: the number of such members. What is to be paired in
    a group is its odd members with all.
    """
    mixed = _with_root(groups, "node", "root", joined)
    each = mixed.groupBy("gid", "root").agg(F.count("*").alias("n"))
    several = each.groupBy("gid").agg(F.max(F.struct("n", "root")).alias("x"), F.sum("n").alias("n")).where("n > x.n")
    several = several.select("gid", F.col("x.root").alias("most"), (F.col("n") - F.col("x.n")).alias("odd"))
    return mixed.join(several, "gid").select("gid", "node", "root", (F.col("root") != F.col("most")).alias("minor"), "odd")


def _rooted(docs: DataFrame, shingle: int, percent: int, t: Scratch) -> DataFrame:
    """doc_id, bid, row, n_shingles, node, root of every row of a table in batches; node and root null for empty sets."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    bits = max(6, (8 * partitions(docs.sparkSession) - 1).bit_length())
    made = t.keep(docs.mapInArrow(frugal(_nodes(shingle)), NODE))
    levels = cost_levels(sum_blobs(made.where("counts is not null").select("counts"), CELLS))
    nodes = made.where("bid is not null").drop("counts")
    tokens = docs.select("text", "bid").mapInArrow(frugal(_give_out(shingle, levels, percent, bits)), TOKENS)
    found = t.keep(tokens.groupBy("bucket").applyInArrow(_group, GROUPS))
    whole = t.keep(found.where(F.size("nodes") > 1).groupBy("gid").agg(F.first("nodes").alias("nodes")))
    common = found.where(F.size("nodes") == 1).select("gid", F.col("nodes")[0].alias("node")).distinct()
    groups = whole.select("gid", F.explode("nodes").alias("node")).unionByName(common)

    # One document stands for each node that has a partner at all.
    sketch = [f"p{i}" for i in range(WORDS)]
    stands = nodes.where("node is not null").groupBy("node").agg(F.min(F.struct("bid", "row", "n_shingles", *sketch)).alias("x")).select("node", "x.*")
    stands = t.keep(stands.join(groups.select("node").distinct(), "node", "left_semi"))
    x, y = stands.alias("x"), stands.alias("y")

    def sets_for(pairs: DataFrame) -> DataFrame:
        wanted = t.keep(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(stands.select("node", "bid", "row"), "node"))
        return t.keep(_sets_of(docs, wanted, shingle))

    # Each node against the member that most of its groups name first.
    first = common.groupBy("gid").agg(F.min("node").alias("u"))
    pairs = whole.select(F.col("nodes")[0].alias("u"), F.explode("nodes").alias("v"))
    pairs = pairs.unionByName(common.join(first, "gid").select("u", F.col("node").alias("v")))
    star = pairs.where("v != u").groupBy("u", "v").agg(F.count("*").alias("times"))
    star = star.join(x, F.col("u") == F.col("x.node")).join(y, F.col("v") == F.col("y.node")).where(_plausible("x", "y", percent))
    star = t.keep(star.select("u", "v", "times"))
    sets = sets_for(star)
    star = t.keep(_screen(star, sets, percent).groupBy("v").agg(F.max(F.struct("times", "u")).alias("x")).select("x.u", "v"))
    links = t.keep(_verify(star, sets, percent))
    joined = components(links)

    # Large groups that hold several components, by what tells their sets from a centre; the small ones wait.
    waiting, large = None, groups
    for last in [False] * ROUNDS + [True]:
        apart = t.keep(_apart(large, joined))
        small = apart.select("gid", "node") if last else apart.where(F.col("odd") <= LARGE).select("gid", "node")
        waiting = small if waiting is None else waiting.unionByName(small)
        large = apart.where(F.col("odd") > LARGE).select("gid", "node")
        if last or large.isEmpty():
            break
        told = t.keep(large.join(_central(large), "gid").where("node != u").select("u", F.col("node").alias("v")).distinct())
        told = t.keep(_recode(told, sets_for(told), levels, percent))
        links = links.unionByName(told.where("linked").select("u", "v"))
        joined = components(links)
        large = told.select(F.explode("edits").alias("e"), "u", "v").select(F.xxhash64("u", "e").alias("gid"), F.col("v").alias("node")).distinct()

    # Pairs of different components that share a group.
    open_ = t.keep(_apart(waiting, joined).drop("odd").join(stands.drop("bid", "row"), "node"))
    x, y = open_.where("minor").alias("x"), open_.alias("y")
    apart = (F.col("x.gid") == F.col("y.gid")) & (F.col("x.root") != F.col("y.root")) & (~F.col("y.minor") | (F.col("x.node") < F.col("y.node")))
    left = x.join(y, apart & _plausible("x", "y", percent)).select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v"))
    left = t.keep(left.groupBy("u", "v").agg(F.count("*").alias("times")))
    sets = sets_for(left)
    left = t.keep(_screen(left, sets, percent))
    for last in (False, True) if left.count() > 2 * open_.count() else (True,):
        # Where pairs are many, first the likeliest of each two components; then all that are still apart.
        tried = left
        if not last:
            one = F.max_by(F.struct("u", "v"), F.struct("times", "u", "v")).alias("x")
            rooted = _with_root(_with_root(left, "u", "a", joined), "v", "b", joined)
            tried = t.keep(rooted.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(one).select("x.*"))
        links = links.unionByName(t.keep(_verify(tried, sets, percent)))
        joined = components(links)
        if not last:
            rooted = _with_root(_with_root(left, "u", "a", joined), "v", "b", joined)
            left = t.keep(rooted.where("a != b").join(tried, ["u", "v"], "left_anti").select("u", "v", "times"))
    final = joined.select(F.col("u").alias("node"), F.col("v").alias("root"))

    whole = nodes.select("doc_id", "bid", "row", "n_shingles", "node")
    full = whole.where("node is not null").join(final, "node", "left").withColumn("root", F.coalesce("root", "node")).select(*whole.columns, "root")
    return full.unionByName(whole.where("node is null").withColumn("root", F.lit(None).cast("binary")))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a set holds the distinct shingles of `shingle` words, or
    of a shorter text its whole word sequence. Documents link when 100 * intersection >= percent * union;
    component_id is the least doc_id reachable by links. A null or wordless text has an empty set, links with
    nothing and keeps its own doc_id. A null doc_id counts as larger than all, and a component of null doc_ids only
    has none. Repeated rows are equal sets; other columns are ignored; an empty table gives no rows.
    """
    with Scratch() as t:
        whole = keep(_rooted(in_batches(docs), shingle, percent, t))
    full = whole.where("root is not null")
    least = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = full.join(least, "root").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(whole.where("root is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """Rows of docs, all columns: of each component the row with the least doc_id (null last), and all empty ones."""
    named = in_batches(docs, {f"_{i}": c for i, c in enumerate(docs.columns)})
    with Scratch() as t:
        whole = t.keep(_rooted(named.select("doc_id", "text", "bid", "row"), shingle, percent, t).where("root is not null"))
        order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "bid", "row")
        first = whole.groupBy("root").agg(F.min(order).alias("x")).select("root", F.col("x.bid").alias("b"), F.col("x.row").alias("r"))
        gone = keep(whole.join(first, "root").where("bid != b or row != r").select("bid", "row"))
    # by a merge at every size: the list of rows grows with the table, so texts are shuffled to it
    return named.join(gone.hint("merge"), ["bid", "row"], "left_anti").select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
