"""Line dedup: an exact set-similarity join of lines, and removal of later matches.

A line is the set of its words (runs of anything but the six ASCII blanks).  A
line is removed if an earlier line, by document id and then by line number, has
a word set with Jaccard similarity ``THRESHOLD`` (four fifths) or more, however
short it is.  With ``min_words``, which is off by default, lines of fewer distinct
words match only an equal set in their own document.  Lines without a word stay.

1. Words are counted into a sketch of fixed size over all documents; it orders
   words by rarity, the same way for all, whatever collides in it.
2. Equal sets are collapsed to their first line by a partial aggregation.
3. Every set's rarest words, as many as the prefix filter needs, are the join
   keys.  Candidates must pass the length filter, the positional filter, and a
   bound on the difference from either set's word counts in buckets, modulo 4
   (``SIGNATURE``); all three keep every true pair.  Sets of up to three words
   are similar to equal ones only, so they have no key.
4. Groups of up to ``COLD`` rows are compared in whole, larger ones in blocks of
   about that size, each with ``PIVOTS`` early rows of the group.  Each line keeps
   its first ``TRIES`` candidates for each key.  The earliest of them is verified
   on the full word sets, which settles nearly all; then those of the lines that
   it does not settle.  A line is done where no key has more.  If few have, up
   to ``MORE_TRIES`` candidates of these under such keys are verified, as many
   as give no more pairs than there are lines.
5. For the others, lines of groups whose pairs lie about the threshold, the keys
   with more, and those with blocks, are searched in whole with wide signatures
   (``WIDE``) that tell nearly all dissimilar pairs: the earliest candidate is
   verified, and where it fails, all of them.  So the result is exact, and no
   step lists the pairs of a group.

Words are compared by 64-bit hashes and equal sets by 128 bits; that is the only
approximation.  Only fixed-size or size-checked things reach the driver or are
broadcast: the sketch, the hot keys, the wanted lines.

Defined cases: a null text is the empty one; a null id comes before all others;
rows with one id but different texts are different documents, in the order of a
hash of the text; rows equal in both are one document and keep or lose the same
lines; a text that loses all lines is the empty text; lines of any length count;
an empty table gives no rows; all other columns stay as they are, whatever their
names.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrove.llm.common import bounded_batches, cut, ddl, free, release, similar_pairs, stored

THRESHOLD = (4, 5)
#: Distinct words below which a line matches only in its own document; none by default.
MIN_WORDS = 0
#: Counters of the rarity sketch; rows of a group or block; early rows of a large group that each of its blocks has.
SKETCH, COLD, PIVOTS = 1 << 16, 4096, 16
#: Candidates that a line keeps for each key; the same of a second look, if that gives no more pairs than there are lines.
TRIES, MORE_TRIES = 4, 1024
#: 64-bit words of a line's signature, 32 buckets to a word: of every line, and of those looked up again.
SIGNATURE, WIDE = 2, 16
#: Hot keys, unsettled lines, wanted lines, repeated sets that may be broadcast; lines that meet one earlier line before its set is sent in copies.
BROADCAST_KEYS, BROADCAST_ROWS, BROADCAST_LINES, BROADCAST_SETS, MET = 500_000, 100_000, 2_000_000, 500_000, 256
#: Bytes of text that are taken apart at a time.
CHUNK = 1 << 17


# -- words of lines, without a loop over words ------------------------------------------------------
#: Bytes of a word that are mixed in one eight after the other.
LONG = 64
#: Masks of the first 0 to 8 bytes of a number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(int(_R), -1, 2**64))
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK)
        for name, r in (("up", _R), ("down", _R_INV)):
            a = np.full(size, r, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"]


def word_hashes(raw: np.ndarray, line_starts: np.ndarray, lines: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """64-bit hash of every word of ``raw``, and the line it is in; no word goes over a line's start.

    Bytes are mixed in by eights.  Of words of more than ``LONG`` bytes a
    polynomial over the whole buffer gives the rest, as a difference of two
    running sums, shifted back to the word's start.
    """
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    solid = (raw != 32) & ((raw - np.uint8(9)) > 4)
    first = np.zeros(n + 1, bool)
    first[line_starts[line_starts < n]] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    size = e - s
    from_each = np.ndarray(n, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=1).copy()
    h = _mix((from_each[s] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * _R)
    rest = np.flatnonzero(size > 8)
    for k in range(8, LONG, 8):
        if not len(rest):
            break
        h[rest] = _mix(h[rest] * _R + (from_each[s[rest] + k] & _FIRST[np.minimum(size[rest] - k, 8)]))
        rest = rest[size[rest] > k + 8]
    if len(rest):
        up, down = _power(n)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up, out=run[1:])
        h[rest] = _mix(h[rest] * _R + (run[e[rest]] - run[s[rest]]) * down[s[rest]])
    return h, np.searchsorted(line_starts, s, "right") - 1 if lines else None


def chunks(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of whole texts: first row, last row, bytes, starts of lines, and each line's row and number."""
    col = batch.column(text_col)
    col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        raw = data[offsets[at] : offsets[to]]
        rows = offsets[at:to] - offsets[at]
        breaks = np.flatnonzero(raw == 10) + 1
        owner = np.searchsorted(rows, breaks - 1, "right") - 1
        row = np.concatenate([np.arange(to - at), owner])
        starts = np.concatenate([rows, breaks])
        order = np.lexsort((np.concatenate([np.zeros(to - at, int), np.ones(len(breaks), int)]), starts, row))
        starts, row = starts[order], row[order]
        number = np.arange(len(row)) - np.searchsorted(row, row, "left")
        yield at, to, raw, starts, row, number
        at = to


# -- sets ------------------------------------------------------------------------------------------
def rarity(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each of the sketch's counters, rarest first, ties by number; and the counts in order of rank."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            for _, _, raw, starts, _, _ in chunks(b, text_col):
                h, _ = word_hashes(raw, starts, False)
                total += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], names=["k", "n"])

    got = docs.select(text_col).mapInArrow(count, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(SKETCH, np.int64)
    total[got.column("k").to_numpy()] = got.column("n").to_numpy()
    rank = np.empty(SKETCH, np.uint64)
    order = np.lexsort((np.arange(SKETCH), total))
    rank[order] = np.arange(SKETCH, dtype=np.uint64)
    return rank, total[order]


def ordered_sets(h: np.ndarray, line: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each line in order of rarity, as numbers whose order is that order; and their lines."""
    o = rank[(h & np.uint64(SKETCH - 1)).astype(np.int64)] << np.uint64(48) | h >> np.uint64(16)
    key = line.astype(np.uint64) << np.uint64(44) | o >> np.uint64(20) if len(line) and line[-1] < 1 << 20 else None
    order = np.lexsort((o, line)) if key is None else np.argsort(key)
    o2, l2 = o[order], line[order]
    if key is not None and bool(np.any((l2[1:] == l2[:-1]) & (o2[1:] < o2[:-1]))):
        order = np.lexsort((o, line))
        o2, l2 = o[order], line[order]
    keep = np.ones(len(o2), bool)
    keep[1:] = (o2[1:] != o2[:-1]) | (l2[1:] != l2[:-1])
    return o2[keep], l2[keep]


_LOW = np.uint64(0x5555555555555555)


def signature(o: np.ndarray, line: np.ndarray, lines: int, words: int) -> np.ndarray:
    """Words of each line in 32 buckets to a number, modulo 4, in pairs of bits; ``line`` ascends."""
    size = 32 * words
    bucket = (_mix(o, 5) & np.uint64(size - 1)).astype(np.int64)
    shift = np.uint64(2) * np.arange(32, dtype=np.uint64)
    out, step = np.empty((lines, words), np.uint64), max(1, (1 << 20) // size)
    for a in range(0, lines, step):
        b = min(lines, a + step)
        i, j = np.searchsorted(line, [a, b])
        counts = np.bincount((line[i:j] - a) * size + bucket[i:j], minlength=(b - a) * size).reshape(b - a, words, 32) & 3
        out[a:b] = (counts.astype(np.uint64) << shift).sum(2, dtype=np.uint64)
    return out


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum over buckets of their distance modulo 4: no more than the words that only one of two sets has."""
    d = x ^ y ^ ((~x & y & _LOW) << np.uint64(1))
    one, two = d & _LOW, (d >> np.uint64(1)) & ~d & _LOW
    return (np.bitwise_count(one).astype(np.int32) + 2 * np.bitwise_count(two).astype(np.int32)).sum(1, dtype=np.int32)


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Rarest words of which a similar set that is not equal must share one; none if there can be no such set."""
    a, b = THRESHOLD
    return np.where(b * n >= a * (n + 1), n - -(-a * n // b) + 1, 0)


def line_sets(docs: DataFrame, rank: np.ndarray, hot_from: int, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each line with a word: doc, line, n, s1, s2 (the set's 128-bit key), b1, b2 (the signature), prefix, perhaps.

    ``perhaps`` is the part of the prefix whose words the sketch counts at rank
    ``hot_from`` or above; only those can be in a large group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(id_col).to_numpy(zero_copy_only=False)
            for at, _, raw, starts, row, number in chunks(b, text_col):
                o, line = ordered_sets(*word_hashes(raw, starts), rank)
                if not len(o):
                    continue
                edge = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
                own = line[edge]
                n = np.diff(np.append(edge, len(o)))
                doc = ids[at + row[own]]
                s1, s2 = np.add.reduceat(_mix(o, 1), edge), np.add.reduceat(_mix(o, 2), edge)
                short = n < min_words
                s1[short] += _mix(doc[short].view(np.uint64), 3)
                s2[short] += _mix(doc[short].view(np.uint64), 4)
                b1, b2 = np.ascontiguousarray(signature(o, np.repeat(np.arange(len(n)), n), len(n), SIGNATURE).T)
                p = np.where(short, 0, prefix_length(n))
                ends = np.cumsum(p)
                take = np.repeat(edge - (ends - p), p) + np.arange(ends[-1])
                keys = (_mix(o[take], 6) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(keys))
                often = (o[take] >> np.uint64(48)) >= np.uint64(hot_from)
                bounds = np.concatenate([[0], np.cumsum(often)])[np.concatenate([[0], ends])]
                perhaps = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys[often]))
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(number[own].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(b1.view(np.int64)), pa.array(b2.view(np.int64)), prefix, perhaps], names=["doc", "line", "n", "s1", "s2", "b1", "b2", "prefix", "perhaps"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc bigint, line int, n int, s1 bigint, s2 bigint, b1 bigint, b2 bigint, prefix array<int>, perhaps array<int>")


# -- candidates ---------------------------------------------------------------------------------------
def compare_groups(group: np.ndarray, c: dict[str, np.ndarray], most: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(later row, earlier row) of rows sorted by group, doc and line: the first ``most`` candidates of each row that is ``later``, all for 0.

    The filters by length and place come first; signatures are compared only
    where these two leave a pair.
    """
    a, b = THRESHOLD
    kind = np.int32 if int(c["n"].max(initial=0)) < 1 << 27 else np.int64
    n, sig, doc, line = c["n"].astype(kind), c["sig"], c["doc"], c["line"]
    # Of sizes x and y the smaller is a/b of the larger at least, and what is left of each from its place on a/(a+b) of both.
    spare = (a + b) * (n - c["place"].astype(kind)) - a * n
    start = np.searchsorted(group, group, "left")
    back = np.arange(len(group)) - start
    todo = np.flatnonzero(back > 0 if "later" not in c else (back > 0) & c["later"])
    todo = todo[np.argsort(-back[todo], kind="stable")]  # those with the most rows before them, so that the others drop out at the end
    low, high, need = -(-a * n[todo] // b), np.minimum(b * n[todo] // a, spare[todo] // a), a * n[todo]
    first, ends = start[todo], -back[todo]
    found = np.zeros(len(group), np.int32)
    later, earlier = [], []
    d = done = 0
    while m := int(np.searchsorted(ends, -d)):
        # From the group's first row on, so that copies of an early line are settled at once.
        other = first[:m] + d
        y = n[other]
        near = np.flatnonzero((y >= low[:m]) & (y <= high[:m]) & (spare[other] >= need[:m]))
        p, q = todo[near], other[near]
        if most:
            on = found[p] < most
            p, q = p[on], q[on]
        hit = (a + b) * differing(sig[p], sig[q]) <= (b - a) * (n[p] + n[q])
        hit &= (doc[p] != doc[q]) | (line[p] != line[q])
        p, q = p[hit], q[hit]
        later.append(p)
        earlier.append(q)
        found[p] += 1
        d += 1
        done += int(np.count_nonzero(found[p] == most))
        if most and 8 * done > m:
            on = np.flatnonzero(found[todo[:m]] < most)
            todo, low, high, need, first, ends = (v[on] for v in (todo, low, high, need, first, ends))
            done = 0
    return (np.concatenate(later), np.concatenate(earlier)) if later else (np.empty(0, int), np.empty(0, int))


_ROW = ("key", "doc", "line", "n", "place")
_PAIR = "doc bigint, line int, doc2 bigint, line2 int, more int"


def _columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The row's columns out of the longs of ``_packed``, and its signature as a row of a matrix: from the two longs or from the binary that it has."""
    out = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "block", "later") if c in b.schema.names}
    for c, d, both in (("key", "place", "_kp"), ("line", "n", "_ln")):
        v = b.column(both).to_numpy(zero_copy_only=False)
        out[c], out[d] = (v >> 32).astype(np.int32), v.astype(np.int32)
    if "sig" in b.schema.names:
        raw = b.column("sig")
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        out["sig"] = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view("<u8").reshape(len(raw), -1)
    else:
        out["sig"] = np.stack([b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("b1", "b2")], 1)
    return out


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` with two of the ints of ``_ROW`` in one long each, none of which but the key is negative; Spark's rows spend eight bytes on an int."""
    two = lambda a, b: F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.col(b).cast("long"))
    return rows.select(two("key", "place").alias("_kp"), two("line", "n").alias("_ln"), *[c for c in rows.columns if c not in _ROW or c == "doc"])


def in_order(group: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Order of rows by group, doc and line; of one number for all three where they fit."""
    low = int(doc.min())
    docs, lines = int(doc.max()) - low + 1, int(line.max()) + 1
    if (int(group[-1]) + 1) * docs * lines >= 1 << 63:
        return np.lexsort((line, doc, group))
    return np.argsort((group * docs + (doc - low)) * lines + line)


def candidates(rows: DataFrame, most: int = 1) -> DataFrame:
    """doc, line, doc2, line2, more: earlier candidates of rows by key, and block where there is one; the first ``most`` of each, all for 0.

    Of rows with a column ``later`` only those that are get candidates; ``more``
    is the key where a row has as many as that, and perhaps others, else null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def groups(c: dict[str, np.ndarray]) -> np.ndarray:
            new = c["key"][1:] != c["key"][:-1]
            if "block" in c:
                new = new | (c["block"][1:] != c["block"][:-1])
            return np.cumsum(np.concatenate([[0], new]))

        def out(c: dict[str, np.ndarray], group: np.ndarray) -> pa.RecordBatch:
            b, a = compare_groups(group, c, most)
            full = np.bincount(b, minlength=len(group))[b] >= most if most else np.zeros(len(b), bool)
            found = [c["doc"][b], c["line"][b], c["doc"][a], c["line"][a], np.where(full, c["key"][b], 0), full]
            order = np.lexsort(found)
            found = [v[order] for v in found]
            keep = np.ones(len(order), bool)
            keep[1:] = np.any([v[1:] != v[:-1] for v in found], 0)
            found = [v[keep] for v in found]
            return pa.RecordBatch.from_arrays([*map(pa.array, found[:4]), pa.array(found[4], mask=~found[5])], names=["doc", "line", "doc2", "line2", "more"])

        def whole() -> dict[str, np.ndarray]:
            return {k: np.concatenate([h[k] for h in held]) for k in held[0]}

        def ordered(c: dict[str, np.ndarray], group: np.ndarray) -> pa.RecordBatch:
            order = in_order(group, c["doc"], c["line"])
            return out({k: v[order] for k, v in c.items()}, group)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(_columns(b))
            if sum(len(h["key"]) for h in held) < 100_000:
                continue
            c = whole()
            group = groups(c)
            last = int(np.searchsorted(group, group[-1], "left"))  # the last group may go on
            held = [{k: v[last:] for k, v in c.items()}]
            if last:
                yield ordered({k: v[:last] for k, v in c.items()}, group[:last])
        if held:
            c = whole()
            yield ordered(c, groups(c))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By one long, which Spark sorts by its digits without comparing rows; the order within a group is made here.
    key = F.shiftright("_kp", 32)
    by = F.shiftleft(key, 32).bitwiseOR(F.col("block").cast("long")) if "block" in rows.columns else key
    return _packed(rows).repartition(parts, by).sortWithinPartitions(by).mapInArrow(run, _PAIR)


def _one(pairs: DataFrame) -> DataFrame:
    """The earliest candidate of each line."""
    return pairs.groupBy("doc", "line").agg(F.min(F.struct("doc2", "line2")).alias("p")).select("doc", "line", "p.doc2", "p.line2")


def _own_block() -> Column:
    return F.pmod(F.xxhash64("doc", "line"), F.col("parts")).cast("int")


def first_look(rows: DataFrame, hot: DataFrame | None, tries: int = TRIES) -> DataFrame:
    """Candidates of all lines within their keys' groups; in blocks, with pivots, under the keys of ``hot`` (key, parts)."""
    if hot is None:
        return candidates(rows.select(*_ROW, "b1", "b2"), tries)
    flat = lambda df, later: df.withColumn("later", F.lit(later)).select(*_ROW, "block", "later", "b1", "b2")
    cold = rows.join(hot, "key", "left_anti").withColumn("block", F.lit(0))
    held = rows.join(hot, "key").withColumn("block", _own_block())
    early = held.groupBy("key", F.pmod(F.xxhash64("line", "doc"), F.lit(PIVOTS)).alias("_k")).agg(F.min(F.struct("doc", "line", "n", "place", "b1", "b2", "block", "parts")).alias("p")).select("key", "p.*")
    sent = early.withColumn("_own", F.col("block")).drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("block <> _own")
    return candidates(flat(cold, True).unionByName(flat(held, True)).unionByName(flat(sent, False)), tries)


def key_rows(firsts: DataFrame) -> DataFrame:
    """A row for each line and word of its prefix."""
    return firsts.where(F.size("prefix") > 0).select(F.posexplode("prefix").alias("place", "key"), "doc", "line", "n", "b1", "b2")


def looked_up(firsts: DataFrame, open_: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The rows under the keys of ``open_`` (doc, line, key), of which these are ``later`` and come in every block of a key of ``hot``."""
    keys = cut(open_.select("key").distinct())
    rows = key_rows(firsts).join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", "left_semi")
    mark = open_.select("doc", "line", "key", F.lit(True).alias("later"))
    rows = rows.join(F.broadcast(mark) if open_.count() <= BROADCAST_ROWS else mark, ["doc", "line", "key"], "left").withColumn("later", F.coalesce("later", F.lit(False)))
    rows = rows.select(*_ROW, "later", "b1", "b2")
    if hot is None:
        return rows
    parted = rows.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    blocks = F.when(F.col("later"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_own_block()))
    return parted.withColumn("block", F.explode(blocks)).drop("parts")


def wide_signatures(rows: DataFrame, docs: DataFrame, rank: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc, line and the wide signature of the lines of ``rows``, made again from the texts."""

    def wide(o: np.ndarray, edge: np.ndarray, n: np.ndarray) -> pa.Array:
        sig = signature(o, np.repeat(np.arange(len(n)), n), len(n), WIDE)
        offsets = np.arange(len(n) + 1, dtype=np.int32) * (8 * WIDE)
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(sig.astype("<u8").tobytes())])

    return line_values(docs, cut(rows.select("doc", "line").distinct()), rank, id_col, text_col, "sig binary", wide)


def _among(doc: np.ndarray, number: np.ndarray, known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which lines are wanted: ``wanted`` has the place in ``known`` of a line's document, and below it its number, in order."""
    if not len(wanted):
        return np.zeros(len(doc), bool)
    at = np.minimum(np.searchsorted(known, doc), len(known) - 1)
    key = at << 32 | number
    return (known[at] == doc) & (wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)


def _by_doc(lines: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, where each one's lines begin, and the lines, in order; called behind a check of the size only."""
    got = lines.select("doc", "line").toArrow()
    doc, line = got.column("doc").to_numpy(), got.column("line").to_numpy()
    order = np.lexsort((line, doc))
    doc, line = doc[order], line[order]
    known, first = np.unique(doc, return_index=True)
    return known, np.append(first, len(doc)), line


def line_values(docs: DataFrame, wanted: DataFrame, rank: np.ndarray, id_col: str, text_col: str, field: str, make: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
    """doc, line and ``field`` of the lines in ``wanted`` (doc, line): what ``make`` gives for their words, where each line's begin, and their numbers."""
    sc = docs.sparkSession.sparkContext
    name = field.split(" ")[0]
    fields = f"doc bigint, line int, {field}"

    def emit(doc: np.ndarray, keep: Callable, chunk: tuple) -> pa.RecordBatch | None:
        at, _, raw, starts, row, number = chunk
        mine = np.flatnonzero(keep(doc[at + row], number, row + at))
        if not len(mine):
            return None
        # Only the wanted lines are taken apart.
        a, b = starts[mine], np.append(starts[1:], len(raw))[mine]
        own = np.concatenate([[0], np.cumsum(b - a)])
        part = np.concatenate([raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)])
        o, line = ordered_sets(*word_hashes(part, own[:-1]), rank)
        if not len(o):
            return None
        edge = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        which = mine[line[edge]]
        return pa.RecordBatch.from_arrays([pa.array(doc[at + row[which]]), pa.array(number[which].astype(np.int32)), make(o, edge, np.diff(np.append(edge, len(o))))], names=["doc", "line", name])

    if wanted.count() <= BROADCAST_LINES:
        sent = sc.broadcast(_by_doc(wanted))
        if len(sent.value[0]) <= BROADCAST_ROWS:
            # Only documents with such a line go to Python.
            few = docs.sparkSession.createDataFrame(pa.table({"_wanted": pa.array(sent.value[0], pa.int64())}))
            docs = docs.select(id_col, text_col).join(F.broadcast(few), F.col(id_col) == F.col("_wanted"), "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, edges, numbers = sent.value
            wanted = np.repeat(np.arange(len(known)), np.diff(edges)) << 32 | numbers
            keep = lambda doc, number, _: _among(doc, number, known, wanted)

            for b in batches:
                ids = b.column(id_col).to_numpy(zero_copy_only=False)
                yield from filter(None, (emit(ids, keep, c) for c in chunks(b, text_col)))

        return docs.select(id_col, text_col).mapInArrow(run, fields).dropDuplicates(["doc", "line"])

    listed = wanted.groupBy("doc").agg(F.collect_list("line").alias("_lines"))
    keyed = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text")).join(listed, "doc")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [set(x) for x in b.column("_lines").to_pylist()]
            keep = lambda doc, number, row: np.array([k in lists[r] for k, r in zip(number.tolist(), row.tolist(), strict=True)], bool)  # noqa: B023, E731
            yield from filter(None, (emit(b.column("doc").to_numpy(), keep, c) for c in chunks(b, "_text")))

    return keyed.mapInArrow(run_joined, fields).dropDuplicates(["doc", "line"])


def word_sets(docs: DataFrame, wanted: DataFrame, rank: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc, line, words of the lines in ``wanted`` (doc, line)."""
    lists = lambda o, edge, n: pa.ListArray.from_arrays(pa.array(np.append(edge, len(o)).astype(np.int32)), pa.array(o.view(np.int64)))
    return line_values(docs, wanted, rank, id_col, text_col, "words array<bigint>", lists)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (doc, line, doc2, line2) whose word sets are similar."""
    return similar_pairs(pairs, sets, ["doc", "line"], ["doc", "line"], ["doc2", "line2"], "words", THRESHOLD, MET, BROADCAST_KEYS)


# -- the whole -------------------------------------------------------------------------------------------
def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a long of its own for each document, in the documents' order, and that column's name.

    It is the id where no id is null or repeated.  Otherwise the pairs of id and
    text hash are sorted and numbered.
    """
    key = free(docs, "_doc")
    n = docs.select(id_col).groupBy(id_col).count().agg(F.count(F.when(F.col(id_col).isNull() | (F.col("count") > 1), 1))).first()[0]
    if not n:
        return docs.withColumn(key, F.col(id_col).cast("long")), key
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    own = docs.select(F.col(id_col).alias("_i"), hashed.alias("_h")).distinct().orderBy(F.asc_nulls_first("_i"), "_h")
    own = cut(own.select(F.col("_i").alias(free(docs, "_i")), F.col("_h").alias(free(docs, "_h")), F.monotonically_increasing_id().alias(key)))
    i, h = own.columns[:2]
    own = F.broadcast(own) if own.count() <= BROADCAST_SETS else own
    return docs.join(own, F.col(id_col).eqNullSafe(F.col(i)) & (hashed == F.col(h))).drop(i, h), key


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cold: int = COLD, min_words: int = MIN_WORDS, tries: int = TRIES) -> DataFrame:
    """doc, line (from 0) of every line to be removed, once each; ids are longs, none null, that tell documents apart."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rank, counts = rarity(docs, text_col)
    lines = stored(line_sets(docs, rank, int(np.searchsorted(counts, cold, "right")), id_col, text_col, min_words), "lines")
    firsts = lines.groupBy("s1", "s2").agg(F.min(F.struct("doc", "line")).alias("f"), F.first("n").alias("n"), F.first("b1").alias("b1"), F.first("b2").alias("b2"), F.first("prefix").alias("prefix"), F.first("perhaps").alias("perhaps"), F.count("*").alias("copies"))
    firsts = stored(firsts.select("s1", "s2", "f.doc", "f.line", "n", "b1", "b2", "prefix", "perhaps", "copies"), "firsts")
    release(spark)

    hot = firsts.select(F.explode("perhaps").alias("key")).groupBy("key").agg(F.count("*").alias("_c")).where(F.col("_c") > cold)
    hot = cut(hot.select("key", F.ceil(F.col("_c") / cold).cast("int").alias("parts")))
    n_hot = hot.count()
    release(spark)
    hot = None if not n_hot else F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    found = cut(first_look(key_rows(firsts), hot, tries))
    release(spark)
    settle = lambda pairs: _settle(docs, pairs, rank, id_col, text_col)
    pairs = cut(_one(found))
    gone = cut(settle(pairs))
    rest = found.select("doc", "line", "doc2", "line2").distinct().join(gone, ["doc", "line"], "left_anti").join(pairs, ["doc", "line", "doc2", "line2"], "left_anti")
    rest = cut(rest)
    gone = cut(gone.unionByName(settle(rest)).distinct())
    release(spark)

    # Lines and keys with candidates that have not been tried.
    open_ = found.where("more IS NOT NULL").select("doc", "line", F.col("more").alias("key"))
    if hot is not None:
        open_ = open_.unionByName(key_rows(firsts).join(hot, "key", "left_semi").select("doc", "line", "key"))
    open_ = cut(open_.distinct().join(gone, ["doc", "line"], "left_anti"))
    looks = open_ if hot is None else open_.join(hot, "key", "left")
    looks = looks.agg(F.count("*") if hot is None else F.sum(F.coalesce("parts", F.lit(1)))).first()[0] or 0
    if looks and (most := min(MORE_TRIES, firsts.count() // looks)) > tries:
        more = cut(candidates(looked_up(firsts, open_, hot), most))
        gone = cut(gone.unionByName(settle(more.drop("more").distinct())).distinct())
        open_ = more.where("more IS NOT NULL").select("doc", "line", F.col("more").alias("key"))
        open_ = cut(open_.distinct().join(gone, ["doc", "line"], "left_anti"))
        release(spark)
    signed = None
    for most in (1, 0):
        if open_.isEmpty():
            break
        rows = looked_up(firsts, open_, hot)
        # The second time's rows are among the first's.
        signed = signed if signed is not None else cut(wide_signatures(rows, docs, rank, id_col, text_col))
        more = candidates(rows.drop("b1", "b2").join(signed, ["doc", "line"]), most).drop("more")
        more = cut(_one(more) if most else more.distinct())
        gone = cut(gone.unionByName(settle(more)).distinct())
        left = more.select("doc", "line").distinct().join(gone, ["doc", "line"], "left_anti")
        open_ = cut(open_.join(left, ["doc", "line"], "left_semi"))
        release(spark)

    repeated = firsts.where("copies > 1").select("s1", "s2", F.col("doc").alias("d1"), F.col("line").alias("l1"))
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_SETS else repeated
    own = lines.select("doc", "line", "s1", "s2").join(repeated, ["s1", "s2"])
    copies = own.where((F.col("doc") != F.col("d1")) | (F.col("line") != F.col("l1"))).select("doc", "line")
    return copies.unionByName(gone).distinct()


def _settle(docs: DataFrame, pairs: DataFrame, rank: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    if pairs.isEmpty():
        return pairs.select("doc", "line")
    wanted = cut(pairs.select("doc", "line").union(pairs.select("doc2", "line2")).distinct())
    return verified(pairs, word_sets(docs, wanted, rank, id_col, text_col)).select("doc", "line").distinct()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cold: int = COLD, min_words: int = MIN_WORDS, tries: int = TRIES) -> DataFrame:
    """All rows and columns of ``docs``, the text without its removed lines, and n_lines, n_removed; these two get an underscore where ``docs`` has such a column."""
    names = docs.columns
    added = [free(docs, "n_lines"), free(docs, "n_removed")]
    docs, key = keyed(docs, id_col, text_col)
    gone = cut(removed_lines(docs, key, text_col, cold, min_words, tries))
    release(docs.sparkSession)
    fields = f"{ddl(docs, *names)}, " + ", ".join(f"`{c}` bigint" for c in added)

    def cleared(b: pa.RecordBatch, drops: list) -> pa.RecordBatch:
        texts, all_lines, lost = [], [], []
        for t, g in zip(b.column(text_col).to_pylist(), drops, strict=True):
            t, drop = t or "", set(g if g is not None else ())
            texts.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop) if drop else t)
            all_lines.append(t.count("\n") + 1)
            lost.append(len(drop))
        cols = [pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*cols, pa.array(all_lines, pa.int64()), pa.array(lost, pa.int64())], names=[*names, *added])

    if gone.count() <= BROADCAST_LINES:
        sent = docs.sparkSession.sparkContext.broadcast(_by_doc(gone))

        def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, edges, numbers = sent.value
            for b in batches:
                ids = b.column(key).to_numpy(zero_copy_only=False)
                at = np.searchsorted(known, ids)
                yield cleared(b, [numbers[edges[k] : edges[k + 1]].tolist() if k < len(known) and known[k] == i else None for k, i in zip(at.tolist(), ids.tolist(), strict=True)])

        return docs.mapInArrow(in_place, fields)

    lists = free(docs, "_gone")
    listed = gone.groupBy(F.col("doc").alias(key)).agg(F.collect_list("line").alias(lists))
    return docs.join(listed, key, "left").mapInArrow(lambda batches: (cleared(b, b.column(lists).to_pylist()) for b in batches), fields)
