"""SimHash near-duplicates by bit-sliced comparison.

``near_duplicates`` links fingerprints within a radius.  Equal ones are collapsed first.  The distinct ones are cut into five
blocks of bits; three differing bits leave two blocks untouched, so each of the
ten pairs of blocks is a key under which every link is found at least once.
Rows that share a key are compared in ``links``: the bits of a block of 64
fingerprints lie in one word per bit position, distances of a whole block are
counted at once in carry-save counters, and blocks are given up as soon as all
their distances exceed the radius.  A key with many rows is dealt into
sub-blocks and every pair of sub-blocks is a group of its own, so that no task
holds more than two of them; each group returns a forest of its links, at most
one row per fingerprint.  Components come from large-star and small-star rounds
over these forests, whose edges never reach the driver.

``near_copies`` links texts whose sets of five-word shingles have Jaccard
similarity ``SIMILAR`` (four fifths) or more; ``keep_one`` keeps one row of each
component.  At that similarity fingerprints differ in ten of 64 bits and often
in fifteen, and no keys of blocks of bits stay exact so far out.  So there

1. equal sets are collapsed, and each distinct one gets ``BANDS`` keys of three
   min-hashes; a pair at 0.8 shares none with a chance of 1e-10;
2. each set is first held against one other that shares a key with it, which is
   linear and settles groups of copies;
3. under keys whose sets are not yet of one component, bit-sliced comparison
   passes the pairs at ``REACH`` or fewer bits (five standard deviations beyond
   the mean at 0.8; sets of few shingles all pass), a signature of the sets'
   counts in buckets rejects nearly all dissimilar ones of these, and one pair
   for each two components is taken, then, for what is left, all of them;
4. every pair is verified on the whole shingle sets, made again from the texts.

Shingles and sets are compared by 64-bit hashes there.

Defined cases: a null text is the empty one and has fingerprint zero, linked
like any other; all texts without a word are copies of each other; a text with
fewer words than a shingle has one shingle, the words themselves; equal rows are
returned as often as they come, with one component, of which ``keep_one`` keeps
one; a null id counts for nothing in the choice of the smallest id, and
``keep_one`` keeps a row with an id before one without, then the one with the
smallest id, then the smallest hash of the row; rows with one id but different
texts are different documents; texts of any length count in whole; an empty
table gives no rows; other columns are not read, or stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrove.llm.common import bounded_batches, cut, ddl, free, map_texts, similar_pairs, text_or_empty
from veilgrove.llm.line_dedup import WIDE, _mix, chunks, differing, signature, word_hashes

#: Words in a shingle, differing bits in a link, rows of a sub-block, and bits (from, count) of the five blocks.
SHINGLE, RADIUS, ROWS = 3, 3, 1024
PIECES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


# -- fingerprints ---------------------------------------------------------------
def fingerprint(text: str, words: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, repeats included."""
    w = text.encode().lower().split()  # of bytes: only A-Z, and the six ASCII blanks
    if not w:
        return 0
    grams = [b" ".join(g) for g in zip(*(w[k:] for k in range(words)), strict=False)] if len(w) >= words else [b" ".join(w)]
    h64 = xxhash.xxh64_intdigest
    n, ones = len(grams), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([h64(g, 42) for g in grams[at : at + (1 << 16)]], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """id, fp (the fingerprint's 64 bits as a signed long)."""

    def make() -> Callable[[list[str]], list[pa.Array]]:
        return lambda texts: [pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))]

    return map_texts(text_or_empty(docs, id_col, text_col), [id_col], text_col, "fp bigint", make)


# -- bit-sliced comparison -----------------------------------------------------------
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def links(lanes: np.ndarray, queries: np.ndarray, radius: int = RADIUS, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, lane) of all pairs at ``radius`` or fewer differing bits.

    ``planes[p]`` holds bit p of all lanes, 64 to a word.  A pair of query and
    word is carried until, at one of the stops after every ``step`` planes, all
    of its 64 counters have passed the radius.
    """
    n, m = len(lanes), len(queries)
    if not n or not m:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = -(-n // 64)
    packed = np.zeros((64, words * 8), np.uint8)
    packed[:, : -(-n // 8)] = np.packbits(_bits(lanes).T, axis=1, bitorder="little")
    planes = packed.view("<u8")
    ask = (np.uint64(0) - _bits(queries).astype(np.uint64)).T.copy()  # all ones where the query's bit is set
    depth = radius.bit_length()
    chunk, found_q, found_l = max(1, (1 << 16) // words), [], []
    spare = np.zeros(words, np.uint64)
    if n % 64:
        spare[-1] = _ALL << np.uint64(n % 64)
    for at in range(0, m, chunk):
        q = np.repeat(np.arange(at, min(m, at + chunk)), words)
        w = np.tile(np.arange(words), len(q) // words)
        over = spare[w]
        count = [np.zeros(len(q), np.uint64) for _ in range(depth)]
        for p in range(64):
            carry = planes[p][w] ^ ask[p][q]
            for k in range(depth):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if p % step == step - 1:
                dead = over
                if p == 63 and radius + 1 < 1 << depth:
                    dead = over | _above(count, radius)
                live = np.flatnonzero(dead != _ALL)
                over = dead
                if len(live) < len(q):
                    q, w, over, count = q[live], w[live], over[live], [c[live] for c in count]
                if not len(q):
                    break
        if len(q):
            hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, b = np.nonzero(hit)
            found_q.append(q[i])
            found_l.append(w[i] * 64 + b)
    return (np.concatenate(found_q), np.concatenate(found_l)) if found_q else (np.empty(0, np.int64), np.empty(0, np.int64))


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is larger than ``radius``."""
    more, same = np.zeros_like(count[0]), np.full_like(count[0], _ALL)
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same &= count[k]
        else:
            more |= same & count[k]
            same &= ~count[k]
    return more


def _forest(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star to its smallest value for each component of the links a-b."""
    up = np.arange(len(values))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            if values[x] > values[y]:
                x, y = y, x
            up[y] = x
    at = np.array([root(x) for x in range(len(values))])
    moved = np.flatnonzero(values[at] != values)
    return values[moved], values[at[moved]]


def _compare(fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links of a group: across its two sides, or all of them where it has one."""
    u = fp.view(np.uint64)
    if side.any() and not side.all():
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        q, lane = links(u[left], u[right], radius)
        return _forest(fp, right[q], left[lane])
    q, lane = links(u, u, radius)
    keep = q < lane
    return _forest(fp, q[keep], lane[keep])


def candidate_keys(fp: Column) -> Column:
    """The ten keys of a fingerprint: the pair of blocks and their bits."""
    piece = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in PIECES]
    return F.array(*[F.shiftleft(piece[a], 13).bitwiseOR(piece[b]) + F.lit(t << 26) for t, (a, b) in enumerate(combinations(range(5), 2))])


def link_forest(fps: DataFrame, rows: int = ROWS, radius: int = RADIUS) -> DataFrame:
    """src, dst: forests that connect what the links between distinct ``fp`` connect."""
    if radius > 3:
        raise ValueError("two of five blocks stay equal only up to three differing bits")
    keyed = fps.select("fp", F.explode(candidate_keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / rows).cast("int").alias("parts"))
    both = keyed.join(shared, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = both.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", (F.col("own") > F.col("other")).alias("side"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; small groups are compared together."""
        held: list[np.ndarray] = []
        small: list[np.ndarray] = []

        def out(fp: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _compare(fp, side, radius)], names=["src", "dst"])

        def done(group: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(group) < 64:
                small.append(group["fp"])
                if sum(map(len, small)) >= 256:
                    yield flush()
            else:
                yield out(group["fp"], group["side"])

        def flush() -> pa.RecordBatch:
            fp = np.unique(np.concatenate(small))
            small.clear()
            return out(fp, np.zeros(len(fp), bool))

        for b in batches:
            rows = np.empty(b.num_rows, [("key", "i8"), ("i", "i4"), ("j", "i4"), ("fp", "i8"), ("side", "?")])
            for name in rows.dtype.names:
                rows[name] = b.column(name).to_numpy(zero_copy_only=False)
            held.append(rows)
            rows = np.concatenate(held)
            new = np.flatnonzero((rows["key"][1:] != rows["key"][:-1]) | (rows["i"][1:] != rows["i"][:-1]) | (rows["j"][1:] != rows["j"][:-1])) + 1
            for group in np.split(rows[: new[-1]], new[:-1]) if len(new) else []:
                yield from done(group)
            held = [rows[new[-1] :]] if len(new) else [rows]
        if held and len(held[0]):
            yield from done(np.concatenate(held))
        if small:
            yield flush()

    parts = fps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return dealt.repartition(int(parts), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "src bigint, dst bigint")


# -- components ----------------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for every node of src-dst that is not a root itself.

    Large-star and small-star rounds; each is materialised in the checkpoint
    folder, and the rounds end when one changes no edge.
    """
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    mark = lambda x: x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    seen = mark(e)
    while seen[0]:
        sym = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = sym.groupBy("u").agg(F.min("v").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        e = cut(small.distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS, rows: int = ROWS) -> DataFrame:
    """id, fp, component_id: the smallest id that links lead to, the row's own included."""
    own = cut(fingerprints(docs, id_col, text_col, words))
    fps = own.groupBy("fp").agg(F.min(id_col).alias("_first"))
    star = components(link_forest(fps, rows, radius))
    rooted = fps.join(star, fps.fp == star.node, "left").select("fp", "_first", F.coalesce("root", "fp").alias("_root"))
    label = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(label, "_root").select("fp", "component_id")
    return own.join(named, "fp").select(id_col, "fp", "component_id")


# -- near copies by similarity -------------------------------------------------------------------
COPY_SHINGLE, SIMILAR = 5, (4, 5)
#: Keys of a set and min-hashes of a key; bits that a candidate's fingerprint may differ in; shingles below which it says nothing.
BANDS, BAND_ROWS, REACH, SMALL = 32, 3, 24, 20
#: Rows of a block of a key's group; rows that are compared at once, in small groups; ids that may be broadcast.
COPY_ROWS, TOGETHER, BROADCAST_IDS = 2048, 256, 500_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.random.default_rng(20240301).integers(1, 2**63, (BANDS * BAND_ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row, distinct shingles sorted by row, and the row (from the first) of each; rows without a word have none."""
    for at, to, raw, starts, _, number in chunks(batch, text_col):
        word, row = word_hashes(_LOWER[raw], starts[number == 0])
        n = np.bincount(row, minlength=to - at)
        first = np.cumsum(n) - n
        many = np.minimum(n, COPY_SHINGLE)[row]
        place = np.arange(len(word)) - first[row]
        head = np.flatnonzero(place + many <= n[row])
        h = many[head].astype(np.uint64)
        for k in range(COPY_SHINGLE):
            next_word = word[np.minimum(head + k, len(word) - 1)]
            h = np.where(k < many[head], h * _R + next_word, h)
        h, row = _mix(h, 7), row[head]
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield at, to, h[keep], row[keep]


def _nodes(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: shingles and the set's key; and the rows with a word, and where their shingles begin."""
    n = np.bincount(row, minlength=rows)
    full = np.flatnonzero(n)
    edge = (np.cumsum(n) - n)[full]
    node = np.zeros(rows, np.uint64)
    if len(full):
        node[full] = _mix(np.add.reduceat(_mix(h, 8), edge) + n[full].astype(np.uint64), 9)
    return n, node, full, edge


def _fingerprints(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each row's set."""
    ones = np.zeros((len(n), 64), np.int64)
    for at in range(0, len(h), 1 << 16):
        own = row[at : at + (1 << 16)]
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[edge]] += np.add.reduceat(_bits(h[at : at + (1 << 16)]), edge, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def sketches(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep``, node (the key of the shingle set), n (its size), fp, sig, keys (of the bands, the band's number within)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, h, row in shingle_sets(b, text_col):
                n, node, full, edge = _nodes(h, row, to - at)
                keys = np.zeros((to - at, BANDS), np.uint64)
                for k in range(BANDS if len(full) else 0):
                    own = np.full(len(full), k, np.uint64)
                    for x, y in _SALT[k * BAND_ROWS : (k + 1) * BAND_ROWS]:
                        own = _mix(own * _R + np.minimum.reduceat((h ^ x) * y, edge))
                    keys[full, k] = own
                bounds = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[full].reshape(-1).view(np.int64)))
                sig = signature(h, row, to - at, WIDE).astype("<u8").tobytes()
                sigs = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(np.arange(to - at + 1, dtype=np.int32) * (8 * WIDE)), pa.py_buffer(sig)])
                made = [pa.array(node.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(_fingerprints(h, row, n).view(np.int64)), sigs, lists]
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(at, to - at) for c in keep], *made], names=[*keep, "node", "n", "fp", "sig", "keys"])

    bounded_batches(docs.sparkSession)
    src = text_or_empty(docs, keep[0], text_col, *keep[1:])
    return src.mapInArrow(run, f"{ddl(docs, *keep)}, node bigint, n int, fp bigint, sig binary, keys array<bigint>")


def whole_sets(texts: DataFrame, wanted: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """node, shingles of the sets of the rows whose key is in ``wanted`` (``_first``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, h, row in shingle_sets(b, text_col):
                n, node, _, _ = _nodes(h, row, to - at)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), lists], names=["node", "shingles"])

    few = wanted.count() <= BROADCAST_IDS
    name = free(texts, "_first")
    wanted = wanted.select(F.col("_first").alias(name))
    own = text_or_empty(texts, key_col, text_col).join(F.broadcast(wanted) if few else wanted, F.col(key_col).eqNullSafe(F.col(name)), "left_semi")
    return own.select(text_col).mapInArrow(run, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def _copies_verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """src, dst: those of ``pairs`` whose shingle sets are similar."""
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    wanted = cut(sets.select("node", "_first").join(nodes, "node").select("_first").distinct())
    got = cut(whole_sets(texts, wanted, key_col, text_col))
    return similar_pairs(pairs, got, ["node"], ["src"], ["dst"], "shingles", SIMILAR)


_CELL = ("key", "i", "j", "node", "comp", "n", "fp", "lane", "query")


def compare_copies(c: dict[str, np.ndarray], group: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of nodes between a group's queries and lanes of other components: one for each two components, or all."""
    a, b = SIMILAR
    fp, n = c["fp"].view(np.uint64), c["n"].astype(np.int64)
    lanes, queries = np.flatnonzero(c["lane"]), np.flatnonzero(c["query"])
    src, dst = [], []
    for at in range(0, len(queries), 256):
        own = queries[at : at + 256]
        q, lane = links(fp[lanes], fp[own], REACH)
        q, lane = own[q], lanes[lane]
        little, few = own[n[own] < SMALL], lanes[n[lanes] < SMALL]
        if len(little) and len(few):
            q, lane = np.concatenate([q, np.repeat(little, len(few))]), np.concatenate([lane, np.tile(few, len(little))])
        on = (group[q] == group[lane]) & (c["comp"][q] != c["comp"][lane])
        on &= b * np.minimum(n[q], n[lane]) >= a * np.maximum(n[q], n[lane])
        q, lane = q[on], lane[on]
        on = (a + b) * differing(c["sig"][q], c["sig"][lane]) <= (b - a) * (n[q] + n[lane])
        src.append(q[on])
        dst.append(lane[on])
    q, lane = (np.concatenate(x) if x else np.empty(0, int) for x in (src, dst))
    if not every and len(q):
        comp = c["comp"]
        _, first = np.unique(np.stack([np.minimum(comp[q], comp[lane]), np.maximum(comp[q], comp[lane])]), axis=1, return_index=True)
        q, lane = q[first], lane[first]
    x, y = c["node"][q], c["node"][lane]
    return np.maximum(x, y), np.minimum(x, y)


def copy_candidates(rows: DataFrame, every: bool) -> DataFrame:
    """src, dst (src larger): candidates among rows key, node, comp, n, fp, sig between different components of a key.

    Rows of a key's largest component are lanes only; all others are held
    against all lanes, in a grid of blocks of up to ``COPY_ROWS`` each.
    """
    by = rows.groupBy("key", "comp").agg(F.count("*").alias("_c")).groupBy("key").agg(F.max(F.struct("_c", "comp")).alias("_m"), F.sum("_c").alias("_n"))
    by = by.select("key", F.col("_m.comp").alias("_main"), F.ceil(F.col("_n") / COPY_ROWS).cast("int").alias("_i"), F.ceil((F.col("_n") - F.col("_m._c")) / COPY_ROWS).cast("int").alias("_j"))
    both = rows.join(by, "key")
    lane = both.select("key", "node", "comp", "n", "fp", "sig", F.pmod(F.xxhash64("node"), F.col("_i")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_j") - 1)).alias("j"), F.lit(True).alias("lane"), F.lit(False).alias("query"))
    asks = both.where("comp <> _main").select("key", "node", "comp", "n", "fp", "sig", F.explode(F.sequence(F.lit(0), F.col("_i") - 1)).alias("i"), F.pmod(F.xxhash64("node"), F.col("_j")).cast("int").alias("j"), F.lit(False).alias("lane"), F.lit(True).alias("query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def out(c: dict[str, np.ndarray], group: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in compare_copies(c, group, every)], names=["src", "dst"])

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            new = (c["key"][1:] != c["key"][:-1]) | (c["i"][1:] != c["i"][:-1]) | (c["j"][1:] != c["j"][:-1])
            group = np.concatenate([[0], np.cumsum(new)])
            starts = np.append(np.flatnonzero(np.concatenate([[True], new])), len(group) if last else [])
            at = 0
            for s in starts.astype(int).tolist():
                if s - at >= TOGETHER or s == len(group) and s > at:
                    yield out({k: v[at:s] for k, v in c.items()}, group[at:s])
                    at = s
            held[:] = [{k: v[at:] for k, v in c.items()}]

        for b in batches:
            if not b.num_rows:
                continue
            c = {k: b.column(k).to_numpy(zero_copy_only=False) for k in _CELL}
            c["sig"] = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u8").reshape(b.num_rows, WIDE)
            held.append(c)
            yield from ready(False)
        if held:
            yield from ready(True)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lane.unionByName(asks).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.select(*_CELL, "sig").mapInArrow(run, "src bigint, dst bigint")


def copy_components(sets: DataFrame, texts: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """node, root for nodes that are not a root themselves; from node, _first (a row of ``texts`` with the set), n, fp, sig, keys of the distinct sets."""
    a, b = SIMILAR
    keyed = sets.select("node", "n", "fp", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min(F.struct("node", "n", "fp")).alias("p"), F.count("*").alias("_c")).where("_c > 1").select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.fp").alias("pfp"))
    held = cut(keyed.join(shared, "key").select("key", "node", "n", "pivot", "pn", F.bit_count(F.col("fp").bitwiseXOR(F.col("pfp"))).alias("bits")))
    near = (F.col("node") != F.col("pivot")) & (b * F.least("n", "pn") >= a * F.greatest("n", "pn")) & ((F.col("bits") <= REACH) | (F.least("n", "pn") < SMALL))
    stars = cut(held.where(near).groupBy("node").agg(F.min("pivot").alias("dst")).select(F.col("node").alias("src"), "dst"))
    known = cut(_copies_verified(stars, sets, texts, key_col, text_col))
    root = components(known)
    for every in (False, True):
        placed = held.select("key", "node").join(root, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
        mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        rest = cut(placed.join(mixed, "key").join(sets.select("node", "n", "fp", "sig"), "node"))
        pairs = cut(copy_candidates(rest, every).distinct().join(stars, ["src", "dst"], "left_anti"))
        if pairs.isEmpty():
            break
        known = cut(known.unionByName(_copies_verified(pairs, sets, texts, key_col, text_col)))
        root = components(known)
    return root


def _distinct_sets(own: DataFrame, key_col: str) -> DataFrame:
    return own.groupBy("node").agg(F.min(key_col).alias("_first"), *[F.first(c).alias(c) for c in ("n", "fp", "sig", "keys")])


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, node, component_id: the smallest id that links lead to, the row's own included."""
    own = cut(sketches(docs, [id_col], text_col))
    sets = _distinct_sets(own, id_col)
    root = copy_components(sets, docs, id_col, text_col)
    rooted = sets.select("node", "_first").join(root, "node", "left").select("node", "_first", F.coalesce("root", "node").alias("_root"))
    label = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    return own.select(id_col, "node").join(rooted.join(label, "_root").select("node", "component_id"), "node").select(id_col, "node", "component_id")


def row_keys(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two hashes of the whole row, and their names; rows with equal hashes are equal (in all but maps, which have none)."""
    a, b = free(docs, "_row_a"), free(docs, "_row_b")
    whole = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return docs.withColumns({a: F.xxhash64(*whole), b: F.xxhash64(F.lit(1), *whole)}), a, b


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, with all its columns."""
    tagged, a, b = row_keys(docs)
    own = cut(sketches(tagged.select(id_col, a, b, text_col), [id_col, a, b], text_col).select(F.col(id_col).alias("_id"), F.col(a).alias("_a"), F.col(b).alias("_b"), "node", "n", "fp", "sig", "keys"))
    sets = _distinct_sets(own, "_a")
    root = copy_components(sets, tagged, a, text_col)
    rows = own.groupBy("node", "_id", "_a", "_b").agg(F.count("*").alias("_c")).join(root, "node", "left")
    first = F.min(F.struct(F.col("_id").isNull().alias("_n"), "_id", "_a", "_b", "_c")).alias("r")
    stay = cut(rows.groupBy(F.coalesce("root", "node").alias("_root")).agg(first).select(F.col("r._a").alias(a), F.col("r._b").alias(b), F.col("r._c").alias("_c")))
    few = stay.count() <= BROADCAST_IDS
    sent = lambda x: F.broadcast(x.select(a, b)) if few else x.select(a, b)
    kept = tagged.join(sent(stay.where("_c = 1")), [a, b], "left_semi")
    again = stay.where("_c > 1")
    if not again.isEmpty():
        kept = kept.unionByName(tagged.join(sent(again), [a, b], "left_semi").dropDuplicates([a, b]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
