"""SimHash near-dedup with a Gray-order hierarchical index over fingerprints.

Fingerprints (64 bits) link when at most ``radius`` bits differ. Distinct fingerprints are dealt to
buckets by bits of ``radius + 1`` bands: two that differ in at most ``radius`` bits agree on a whole
band. The bits taken per band follow the number of fingerprints, so a bucket holds some thousand. In
a bucket, codes are sorted by Gray rank; runs of them form the leaves of a tree whose nodes hold the
bits that all members share (a mask and a pattern), with bits shared higher up factored out. A
search carries the differences gathered on the way down and drops a node once they pass the radius.
A bucket beyond ``chunk_rows`` is cut into chunks by hash, and each pair of chunks is searched, so
one task never holds more than two chunks. A task returns a spanning forest of its links, never the
pairs; ``components`` joins the forests.

Larger radii, where such a tree drops little, are searched by groups that agree in AGREE bands (``near_pairs``).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm import words as words_of
from convlake.llm.common import components, perhaps_among, staged, unused

FAN = 16  # children of a tree node, codes of a leaf
QUERIES = 128  # codes searched at a time, which bounds the memory of a search
SHINGLES = 1 << 16  # shingles of a text whose bits are counted at a time
AGREE = 3  # bands that two codes within the radius agree in, of radius + AGREE
MANY = 256  # codes of a group that are all compared
PAIRS = 1 << 20  # held until they are united
BLOCK = 1 << 14  # codes compared with QUERIES others at a time
DEALT = 1 << 17  # nodes whose codes are dealt at a time
NODE_BYTES = 1024  # counted for a text besides its bytes, which bounds the texts of a chunk


def text_fingerprint(text: bytes | None, words: int) -> int:
    """SimHash of one UTF-8 text over XXH64 (seed 42) of its word shingles; 0 without words."""
    parts = (text or b"").lower().split()  # for bytes: A-Z only, and the six ASCII spaces
    if not parts:
        return 0
    joined = memoryview(b" ".join(parts))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    span = min(words, len(parts))
    n = len(parts) - span + 1
    hash_of, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES):
        to = min(n, at + SHINGLES)
        pairs = zip(starts[at:to].tolist(), ends[at + span - 1 : to + span - 1].tolist())
        h = np.array([hash_of(joined[a:b], 42) for a, b in pairs], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    """Fingerprint of a text column as long (its bits are the 64 of the SimHash)."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([text_fingerprint(x, words) for x in batch], dtype="int64")

    return prints(text.cast("binary"))


def hex16(code: Column) -> Column:
    return F.lpad(F.lower(F.hex(code)), 16, "0")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code (uint64) in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The tree over codes in Gray order. Level 0 holds the codes, each level above one node per FAN."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        every = [(self.codes, self.codes)]  # bits set in all members, bits set in any
        while len(every[-1][0]) > FAN:
            cuts = np.arange(0, len(every[-1][0]), FAN)
            every.append((np.bitwise_and.reduceat(every[-1][0], cuts), np.bitwise_or.reduceat(every[-1][1], cuts)))
        masks = [~(a ^ o) for a, o in every]
        self.patterns = [a for a, _ in every]
        self.top = len(every) - 1
        # the part of a node's mask that its parent does not hold
        self.own = [m & ~np.repeat(masks[k + 1], FAN)[: len(m)] if k < self.top else m for k, m in enumerate(masks)]

    def search(self, queries: np.ndarray, radius: int, later: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (query, code in Gray order) at distance ``radius`` or less, a few queries at a time.

        later: queries are this index's codes, and only codes behind the query are wanted.
        """
        for at in range(0, len(queries), QUERIES):
            n, top = min(QUERIES, len(queries) - at), len(self.patterns[self.top])
            q, node = np.repeat(np.arange(at, at + n), top), np.tile(np.arange(top), n)
            gathered = np.zeros(len(q), np.uint8)
            for level in range(self.top, -1, -1):
                if level < self.top:
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    q, gathered = np.repeat(q, FAN), np.repeat(gathered, FAN)
                    there = node < len(self.patterns[level])
                    q, node, gathered = q[there], node[there], gathered[there]
                gathered = gathered + np.bitwise_count((queries[q] ^ self.patterns[level][node]) & self.own[level][node])
                near = gathered <= radius
                if later:  # the node's last code lies behind the query
                    near &= (node + 1) * FAN**level - 1 > q if level else node > q
                q, node, gathered = q[near], node[near], gathered[near]
            yield q, node


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (least positions) after the links a-b."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up


def forest(codes: np.ndarray, others: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among codes, or of those between codes and others."""
    index = GrayIndex(codes)
    if others is None:
        every, found = index.codes, index.search(index.codes, radius, later=True)
    else:
        every = np.concatenate([index.codes, others])
        found = ((q + len(codes), node) for q, node in index.search(others, radius))
    root = np.arange(len(every))
    for a, b in found:
        root = _unite(root, a, b)
    moved = np.flatnonzero(root != np.arange(len(every)))
    return every[moved], every[root[moved]]


def links(prints: DataFrame, code: str, radius: int = 4, bucket_rows: int = 2048, chunk_rows: int = 32768) -> DataFrame:
    """Edges (a, b) between distinct codes that keep every link's two ends in one component."""
    distinct = prints.select(F.col(code).alias("code")).distinct()
    n = distinct.count()
    bands = radius + 1
    wide = 64 // bands
    bits = min(wide, max(0, math.ceil(math.log2(max(n, 1) / bucket_rows))))
    shifts = [64 - wide * k - bits for k in range(bands)] if bits else [0]
    keys = [F.struct(F.lit(k).alias("band"), (F.shiftrightunsigned("code", s) if bits else F.lit(0)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("key")) for k, s in enumerate(shifts)]
    dealt = distinct.select("code", F.explode(F.array(*keys)).alias("_")).select("code", "_.*")
    # at most (radius + 1) * 2^(64 / (radius + 1)) buckets
    counts = dealt.groupBy("band", "key").agg(F.ceil(F.count("*") / float(chunk_rows)).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int")
    cut = dealt.join(counts, ["band", "key"]).withColumn("chunk", chunk)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, "chunk").alias("lo"), F.greatest(c, "chunk").alias("hi"))))
    tiles = cut.withColumn("_", pair).select("code", "band", "key", "chunk", "_.lo", "_.hi")

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        codes = rows["code"].to_numpy().astype(np.int64).view(np.uint64)
        lo, hi = key[2], key[3]
        first = rows["chunk"].to_numpy() == lo
        a, b = forest(codes, None, radius) if lo == hi else forest(codes[first], codes[~first], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return tiles.groupBy("band", "key", "lo", "hi").applyInPandas(solve, "a long, b long")


def with_components(prints: DataFrame, code: str, member: Column, radius: int = 4, bucket_rows: int = 2048, chunk_rows: int = 32768) -> DataFrame:
    """Rows of ``prints`` (a stored table) with the least ``member`` of their component as ``first``.

    Null members count only where a component has no other.
    """
    roots = components(links(prints, code, radius, bucket_rows, chunk_rows)).withColumnRenamed("node", code)
    rooted = prints.join(roots, code, "left").withColumn("root", F.coalesce("root", code))
    # stored, so that the join deals both sides anew and a large component's rows can be split
    first = staged(rooted.groupBy("root").agg(F.min(member).alias("first")), "first")
    return rooted.join(first, "root").drop("root")


def near_copies(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, fingerprint (16 hex digits) and component_id, the least id reachable over links.

    A null or empty text has fingerprint zero and links like any other. Equal texts share a
    fingerprint, so groups of copies cost one code. Repeated ids keep one row each; a component
    whose ids are all null has a null component_id. Other columns are not read.
    """
    prints = staged(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("code")), "prints")
    out = with_components(prints, "code", F.col("id"), radius)
    return out.select(F.col("id").alias(id_col), hex16(F.col("code")).alias("fingerprint"), F.col("first").alias("component_id"))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Distinct hashes of a UTF-8 text's runs of ``size`` words (a-z for A-Z), ascending; a shorter text is one run."""
    data = (text or b"").lower()
    starts, ends = words_of.places(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    h = words_of.hashes(data, starts, ends)
    return np.unique(words_of.runs(h, min(size, len(h))))


def independent_fingerprints(h: np.ndarray, count: int) -> list[int]:
    """``count`` SimHashes of a set of hashes, each over another scramble of them; zeros for none."""
    out = []
    for k in range(count if len(h) else 0):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), SHINGLES):
            bits = np.unpackbits(words_of.mix(h[at : at + SHINGLES], k + 1).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
            ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            ones += bits[whole:].sum(axis=0, dtype=np.uint8)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]))
    return out or [0] * count


def bands(count: int) -> list[tuple[int, int]]:
    """(shift, width) of ``count`` runs of a code's bits, from the highest on, the wider ones first."""
    out, at = [], 64
    for k in range(count):
        width = 64 // count + (k < 64 % count)
        at -= width
        out.append((at, width))
    return out


def _near_in_groups(codes: np.ndarray, key: np.ndarray, radius: int, late: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of pairs within ``radius`` bits, all that join codes of equal ``key`` among them.

    In the order of the keys each code is compared with the next one, with the one after it, and so on: as many
    steps as the largest group has rows. Groups beyond MANY are searched from code to code instead.
    """
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(starts, len(order)))
    for at, n in zip(starts[sizes > MANY], sizes[sizes > MANY]):
        yield from _near_from(codes, order[at : at + n], radius, late)
    order = order[np.repeat((sizes > 1) & (sizes <= MANY), sizes)]
    ordered = codes[order]
    differ, bits = np.empty(len(order), np.uint64), np.empty(len(order), np.uint8)
    for step in range(1, sizes.max(where=sizes <= MANY, initial=1)):
        n = len(order) - step
        np.bitwise_xor(ordered[step:], ordered[:n], out=differ[:n])
        np.bitwise_count(differ[:n], out=bits[:n])
        found = np.flatnonzero(bits[:n] <= radius)
        if late is not None:
            found = found[late[order[found]] != late[order[found + step]]]
        if len(found):
            yield order[found], order[found + step]


def _near_from(codes: np.ndarray, left: np.ndarray, radius: int, late: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the near pairs among the codes at ``left``: what has been reached is not compared again."""
    reached = left[:0]
    while len(left):
        if not len(reached):
            reached, left = left[:1], left[1:]
        asked, reached = reached[:QUERIES], reached[QUERIES:]
        first = np.full(len(left), -1)
        for k in range(0, len(left), BLOCK):
            part = left[k : k + BLOCK]
            near = np.bitwise_count(codes[asked][:, None] ^ codes[part]) <= radius
            if late is not None:
                near &= late[asked][:, None] != late[part]
            first[k : k + BLOCK] = np.where(near.any(axis=0), near.argmax(axis=0), -1)
        found = first >= 0
        yield asked[first[found]], left[found]
        reached, left = np.concatenate([reached, left[found]]), left[~found]


def near_pairs(codes: np.ndarray, others: np.ndarray | None, radius: int, band: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of near pairs among codes, or between codes and others: so many that they join what all of them join.

    Of ``radius + AGREE`` bands, two codes within the radius agree in AGREE at least. Each choice of so many bands makes
    groups of codes that agree, whose members are compared. band: all codes agree in it, and pairs that agree in one before it
    are left to that one, so the others are behind it.
    """
    every = codes if others is None else np.concatenate([codes, others])
    late = None if others is None else np.arange(len(every)) >= len(codes)
    cut = bands(radius + AGREE)
    values = [(every >> np.uint64(shift)) & np.uint64((1 << width) - 1) for shift, width in cut]
    root, held, many = np.arange(len(every)), [], 0
    for chosen in itertools.combinations(range(len(cut)), AGREE) if band is None else itertools.combinations(range(band + 1, len(cut)), AGREE - 1):
        key, width = values[chosen[0]], sum(cut[k][1] for k in chosen)
        for k in chosen[1:]:
            key = key << np.uint64(cut[k][1]) | values[k]
        for pair in _near_in_groups(every, key.astype(np.uint16) if width <= 16 else key, radius, late):
            held.append(pair)
            many += len(pair[0])
            if many > PAIRS:
                root, held, many = _unite(root, *map(np.concatenate, zip(*held))), [], 0
    if held:
        root = _unite(root, *map(np.concatenate, zip(*held)))
    moved = np.flatnonzero(root != np.arange(len(root)))
    return moved, root[moved]


def _sorted_buckets(codes: np.ndarray, cut: list[tuple[int, int]], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each column of codes and each band: its number, an order by the band's first ``bits``, and the keys there with their rows."""
    for which in range(codes.shape[1]):
        for k, (shift, width) in enumerate(cut):
            held = min(bits, width)
            key = ((codes[:, which] >> np.uint64(shift + width - held)) & np.uint64((1 << held) - 1)).astype(np.uint16)
            rows = np.bincount(key, minlength=1)
            found = np.flatnonzero(rows)
            yield which * len(cut) + k, np.argsort(key, kind="stable"), found, rows[found]


def candidates(nodes: DataFrame, prints: int, radius: int, bucket_rows: int = 8192, chunk_rows: int = 1 << 18) -> DataFrame:
    """Pairs (a < b) of nodes (node, codes) that join all nodes which are near in any of their fingerprints.

    Each fingerprint is dealt by the bits of its first bands, as many as can be the first that two near ones agree in
    (see ``near_pairs``). A bucket beyond ``chunk_rows`` is cut into chunks by hash, and each pair of chunks is searched.
    Nodes and codes travel in blocks, the part of a bucket that comes from DEALT nodes.
    """
    n = nodes.count()
    cut = bands(radius + AGREE)[: radius + 1]
    bits = max(0, math.ceil(math.log2(max(n, 1) / bucket_rows)))
    kinds = {"band": pa.int32(), "key": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "late": pa.bool_(), "block": pa.binary()}

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if held and (batch is None or sum(map(len, held)) >= DEALT):
                codes = np.concatenate([x.column("codes").flatten().to_numpy() for x in held]).view(np.uint64)
                yield np.concatenate([x.column("node").to_numpy() for x in held]), codes.reshape(-1, prints)
                held = []
            if batch is not None and len(batch):
                held.append(batch)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes in gathered(batches):
            for band, _, key, rows in _sorted_buckets(codes, cut, bits):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), band), pa.int32()), pa.array(key, pa.int32()), pa.array(rows, pa.int64())], ["band", "key", "rows"])

    # at most prints * (radius + 1) * 2^(width of a band) buckets
    sizes = nodes.mapInArrow(counted, "band int, key int, rows long").groupBy("band", "key").agg(F.sum("rows").alias("rows"))
    chunks = {(r.band, r.key): -(-r.rows // chunk_rows) for r in sizes.where(F.col("rows") > chunk_rows).collect()}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, codes in gathered(batches):
            for band, order, keys, rows in _sorted_buckets(codes, cut, bits):
                pairs = np.stack([node[order], codes[order, band // len(cut)].view(np.int64)], axis=1)
                out = []
                for key, part in zip(keys.tolist(), np.split(pairs, np.cumsum(rows)[:-1])):
                    m = chunks.get((band, key), 1)
                    chunk = words_of.mix(part[:, 0].view(np.uint64)) % np.uint64(m)
                    for c in range(m):
                        block = (part if m == 1 else part[chunk == c]).tobytes()
                        out += [(band, key, min(c, d), max(c, d), c > d, block) for d in range(m)]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds.values())], list(kinds))

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first, behind = (np.frombuffer(b"".join(rows["block"][rows["late"] == late]), np.int64).reshape(-1, 2) for late in (False, True))
        first, behind = (x[np.argsort(x[:, 0])] for x in (first, behind))  # one order whatever that of arrival
        code = lambda x: np.ascontiguousarray(x[:, 1]).view(np.uint64)
        a, b = near_pairs(code(first), code(behind) if key[2] != key[3] else None, radius, key[0] % len(cut))
        node = np.concatenate([first[:, 0], behind[:, 0]])
        return pd.DataFrame({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})

    tiles = nodes.mapInArrow(dealt, "band int, key int, lo int, hi int, late boolean, block binary")
    return tiles.groupBy("band", "key", "lo", "hi").applyInPandas(solve, "a long, b long").distinct()


def similar_forest(sets: list[np.ndarray], label: np.ndarray, late: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of links that join all sets of a Jaccard similarity of ``similarity`` or more.

    Sets of one label count as joined. late: only links between late sets and others. Overlaps are counted
    through lists of the sets that hold an element. Sets whose elements are the most frequent are
    asked first, as these are the centres of groups: what they join is not compared again.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    values, element, frequency = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    central = np.bincount(owner, frequency[element], n) / np.maximum(size, 1)
    lists, starts = owner[np.argsort(element, kind="stable")], np.cumsum(frequency) - frequency
    ends = np.cumsum(size)
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    root = first[of]
    out = [(np.zeros(0, np.int64),) * 2]
    for q in np.argsort(-central, kind="stable"):
        # no product is rounded to more than the overlap that the test below would need
        wanted = (root != root[q]) & (similarity * size <= size[q]) & (similarity * size[q] <= size)
        if late is not None:
            wanted &= late != late[q]
        if not wanted.any():
            continue
        own = element[ends[q] - size[q] : ends[q]]
        own = own[frequency[own] > 1]
        many = frequency[own]
        held = lists[np.repeat(starts[own] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        both = np.bincount(held, minlength=n)
        near = np.flatnonzero(wanted & (both >= similarity * (size + size[q] - both)))
        if len(near):
            near = near[np.unique(root[near], return_index=True)[1]]  # one of each part
            out.append((np.full(len(near), q), near))
            joined = np.isin(root, root[near]) | (root == root[q])
            root[joined] = root[joined].min()
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def similar_links(tiles: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) in each tile: rows (reach, lo, hi, chunk, node, label, text), whose chunk is lo or hi.

    A tile of two chunks is searched for links between them only. See ``similar_forest``.
    """

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        late = None if key[1] == key[2] else (rows["chunk"] != key[1]).to_numpy()
        a, b = similar_forest([shingles(x, words) for x in rows["text"]], rows["label"].to_numpy(), late, similarity)
        node = rows["node"].to_numpy()
        return pd.DataFrame({"a": node[a], "b": node[b]})

    return tiles.groupBy("reach", "lo", "hi").applyInPandas(solve, "a long, b long")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8, prints: int = 8, radius: int = 8, chunk_bytes: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies: of each component the row with the least id stays.

    Two texts link if the Jaccard similarity of their sets of word shingles, which is computed from the
    texts, is ``similarity`` or more. Candidates are the pairs of texts within ``radius`` bits in one
    of ``prints`` independent fingerprints. The texts that candidates join meet in a task, which
    finds the links among them and returns a spanning forest, never the pairs. A group
    beyond ``chunk_bytes`` is cut into chunks by hash: links inside each chunk first, then,
    where these leave a group in parts, those between the parts of each two chunks. So no candidate
    link is lost, and one task never holds more than two chunks.

    Rows are told apart by id and text (two 64-bit hashes); of rows equal in both, one stays. A null
    id comes after all others. All columns are kept as they are.
    """
    text, of = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("string")
    keys = [F.xxhash64(F.lit(1), of, text), F.xxhash64(F.lit(2), text, of)]

    @F.pandas_udf("array<long>")
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([independent_fingerprints(shingles(x, words), prints) for x in batch], dtype=object)

    rows = docs.select(F.col(id_col).alias("id"), keys[0].alias("k1"), keys[1].alias("k2"), F.xxhash64(F.lit(3), text).alias("t1"), F.xxhash64(text, F.lit(4)).alias("t2"), codes(text.cast("binary")).alias("codes"))
    rows = staged(rows, "prints")
    # a node for each distinct text, with one of its rows
    nodes = rows.groupBy("t1", "t2").agg(F.first("codes").alias("codes"), F.min(F.struct("k1", "k2")).alias("row"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("node"), "t1", "t2", "codes", F.col("row.k1").alias("k1"), F.col("row.k2").alias("k2")), "nodes")
    keyed = docs.select(keys[0].alias("k1"), keys[1].alias("k2"), text.cast("binary").alias("text"))

    tried = staged(candidates(nodes.select("node", "codes"), prints, radius), "tried")
    reach = components(tried).withColumnRenamed("root", "reach")
    chosen = staged(nodes.join(reach, "node").select("node", "reach", "k1", "k2"), "chosen")
    # few texts are candidates: the join deals those alone
    texts = staged(perhaps_among(keyed, F.col("k1"), chosen, "k1").join(chosen, ["k1", "k2"]).dropDuplicates(["node"]).select("node", "reach", "text"), "texts")
    # stored, so that the join deals both sides anew and a large group's rows can be split
    held = F.sum(F.length("text") + F.lit(NODE_BYTES)) / float(chunk_bytes)
    sizes = staged(texts.groupBy("reach").agg(F.ceil(held).cast("int").alias("chunks")), "sizes")
    cut = texts.join(sizes, "reach").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    inside = cut.select("reach", F.col("chunk").alias("lo"), F.col("chunk").alias("hi"), "chunk", "node", F.col("node").alias("label"), "text")
    linked = staged(similar_links(inside, words, similarity), "linked")
    label = F.coalesce("root", "node")
    large = sizes.where("chunks > 1")
    if not large.isEmpty():
        parts = chosen.join(large, "reach").join(components(linked), "node", "left").select("node", "reach", "chunks", label.alias("label"))
        parts = staged(parts, "parts")
        torn = staged(parts.groupBy("reach").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("reach"), "torn")
        parts = parts.join(torn, "reach").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        other = F.explode(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("chunk")))
        tiles = parts.withColumn("other", other).select("node", "reach", "label", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
        linked = linked.union(staged(similar_links(tiles.join(texts.select("node", "text"), "node"), words, similarity), "linked"))

    rooted = nodes.join(components(linked), "node", "left").select("t1", "t2", label.alias("root"))
    rooted = staged(rooted, "rooted")
    member = F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2")).alias("first")
    kept = staged(rows.drop("codes").join(rooted, ["t1", "t2"]).groupBy("root").agg(member).select("first.k1", "first.k2"), "kept")
    k1, k2 = unused(docs, "_k1"), unused(docs, "_k2")
    return docs.withColumns({k1: keys[0], k2: keys[1]}).join(kept, (F.col(k1) == kept["k1"]) & (F.col(k2) == kept["k2"]), "left_semi").dropDuplicates([k1, k2]).drop(k1, k2)
