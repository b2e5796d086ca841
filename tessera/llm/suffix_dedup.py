"""Removal of long repeated strings by a sparse suffix array, built as a distributed merge sort.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else.

Which suffixes. Every string of LENGTH bytes has an anchor: its leftmost position with the
smallest hash of the next GRAM bytes. Equal strings have equal anchors, so only suffixes at
anchors are sorted (about one in (LENGTH - GRAM) / 2 positions), each together with the run
of strings that it anchors. Anchors whose GRAM bytes stand nowhere else are left out by a
count of their hashes: each block of text asks for its distinct hashes, and gets back the
repeated ones.

The sort. Key of a suffix: the hash (equal ranges of which are the splitters), the text from
the anchor on, the text before it in reverse. A block sorts its suffixes, merges equal ones into
one with several places, and sends each range a front-coded run, a packet that is never empty: for each key the length
of the prefix it shares with the one before, and the rest. A range joins its runs with
loser trees whose nodes keep the prefix length known to be shared with the last winner:
a comparison starts behind it, and two different lengths decide without looking at the text.

The answer. Keys met more than once are repeated with all their strings. For others the
common prefixes with their neighbours bound which strings can be repeated; those not settled
by the neighbours are searched for within the keys of one anchor hash by rolling hashes, and compared.
An anchor hash with more than HOT occurrences is not sorted: its strings are counted like
the hashes, by a 128-bit hash, so that no group of keys outgrows a task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLOCK_BYTES, Packets, as_bytes, blocks_of, drop_dir, lean, lean_group, materialize, read_block, read_packet, shared_dir, write_block

LENGTH, GRAM = 200, 32
HOT = 100_000
RANGE_BYTES, MOST_TASKS = 12 << 20, 20_000
FAN_IN = 64
_CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 22) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if n not in _tables:
        letters = np.random.default_rng(20).integers(1, 1 << 63, 256).astype(np.uint64)
        _tables[n] = letters, _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    return _tables[n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def anchors(text: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, first start, last start, hash): runs of strings of one anchor in the texts that end at `ends` in the concatenation."""
    wide = length - gram + 1
    letters, power, inverse = _table(_CHUNK + length + 1)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out = []
    for base in range(0, max(0, len(text) - length + 1), _CHUNK):
        piece = text[base : base + _CHUNK + length - 1]
        n = len(piece)
        h = np.zeros(n + 1, np.uint64)
        np.cumsum(letters[piece] * power[:n], out=h[1:])
        h = _mixed((h[gram:] - h[:-gram]) * inverse[: n - gram + 1])
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= wide:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < wide:
            low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
        inside = np.zeros(len(low) + 1, np.int32)  # is base + k the start of a string within one text?
        first, last = np.searchsorted(ends, base, "right"), np.searchsorted(starts, base + len(low), "left")
        a, b = np.maximum(starts[first:last] - base, 0), np.minimum(ends[first:last] - length + 1 - base, len(low))
        fits = a < b
        np.add.at(inside, a[fits], 1)
        np.add.at(inside, b[fits], -1)
        p = np.flatnonzero(np.cumsum(inside[:-1]))
        if not len(p):
            continue
        at = (low[p] & _LOW).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
        out.append((at[cut[:-1]] + base, p[cut[:-1]] + base, p[cut[1:] - 1] + base, h[at[cut[:-1]]]))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    at, first, last, h = (np.concatenate(x) for x in zip(*out, strict=True))
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
    return at[cut[:-1]], first[cut[:-1]], last[cut[1:] - 1], h[cut[:-1]]


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be `at` or more."""
    n = min(len(a), len(b))
    x, y = a[at:n], b[at:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


# --- runs and their merge -----------------------------------------------------------------


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, bytes]:
    """(shared prefix lengths, all rests): keys ascend."""
    shared, rests, before = [], [], b""
    for k in keys:
        n = common(before, k)
        shared.append(n)
        rests.append(k[n:])
        before = k
    return np.array(shared, np.uint16), b"".join(rests)


def decoded(lengths: np.ndarray, shared: np.ndarray, rests: bytes, payloads: Iterable) -> Iterator[tuple[bytes, int, object]]:
    """(key, prefix shared with the key before, payload) along a front-coded run."""
    at, key = 0, b""
    for size, n, payload in zip(lengths.tolist(), shared.tolist(), payloads, strict=True):
        key = key[:n] + rests[at : at + size - n]
        at += size - n
        yield key, n, payload


def loser_tree(runs: list[Iterator[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """Merge ascending runs of (key, prefix shared with the one before, payload) into one such run.

    Each inner node keeps the loser of its last match and how long a prefix it shares with the
    winner that passed. Both players of a match know their prefix in common with the last key
    given out: unequal lengths decide the match, equal ones are the place to start comparing.
    """
    if len(runs) > FAN_IN:
        runs = [loser_tree(runs[i : i + FAN_IN]) for i in range(0, len(runs), FAN_IN)]
        yield from loser_tree(runs)
        return
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[tuple[bytes, int, object] | None] = [next(r, None) for r in runs] + [None] * (k - len(runs))
    known = [0] * k
    loser = [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser), the loser's prefix in common with the winner being known afterwards."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        la, lb = known[a], known[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        p, q = x[0], y[0]
        n = common(p, q, la)
        if n == len(p) or n < len(q) and p[n] < q[n]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def first(node: int) -> int:
        if node >= k:
            return node - k
        win, loser[node] = match(first(2 * node), first(2 * node + 1))
        return win

    win = first(1)
    while heads[win] is not None:
        key, _, payload = heads[win]
        yield key, known[win], payload
        heads[win] = next(runs[win], None)
        if heads[win] is not None:
            known[win] = heads[win][1]
        node = (win + k) // 2
        while node:
            win, loser[node] = match(win, loser[node])
            node //= 2


class Suffix:
    """A key of the merge: its text from the anchor on, the text before it reversed, and the places where the first string starts."""

    __slots__ = ("after", "before", "places", "shared")

    def __init__(self, after: bytes, before: bytes, places: list, shared: int):
        self.after, self.before, self.places, self.shared = after, before, places, shared


def repeated_strings(group: list[Suffix], length: int) -> Iterator[tuple[Suffix, int, int]]:
    """(suffix, first, last): the strings that start first .. last bytes before the anchor are repeated.

    group: the different suffixes of one anchor hash in order; shared: bytes from the anchor on shared with the one before.
    """
    if len(group) == 1 and len(group[0].places) < 2:
        return
    by_before = sorted(range(len(group)), key=lambda i: group[i].before)
    left = [0] * (len(group) + 1)  # between neighbours in the order of what stands before the anchor
    for k in range(1, len(group)):
        left[k] = common(group[by_before[k - 1]].before, group[by_before[k]].before)
    reach = [0] * len(group)
    for k, i in enumerate(by_before):
        reach[i] = max(left[k], left[k + 1])
    open_ones = []
    for i, s in enumerate(group):
        low, high = length - len(s.after), len(s.before)
        if len(s.places) > 1:
            yield s, low, high
            continue
        to_next = group[i + 1].shared if i + 1 < len(group) else 0
        low, high = max(low, length - max(s.shared if i else 0, to_next)), min(high, reach[i])
        if low > high:
            continue
        for j, n in ((i - 1, s.shared), (i + 1, to_next)):
            if 0 <= j < len(group) and length - n <= low and common(s.before, group[j].before) >= high:
                yield s, low, high
                break
        else:
            open_ones.append((s, low, high))
    if not open_ones:
        return
    yield from _settled(group, open_ones, length)


def _settled(group: list[Suffix], open_ones: list[tuple[Suffix, int, int]], length: int) -> Iterator[tuple[Suffix, int, int]]:
    """The repeated strings of the open suffixes, string by string.

    One that starts d bytes before the anchor is d bytes of what stands before and length - d of
    what comes after. Rolling hashes of all suffixes tell for each d which may be equal; a
    witness is then compared by its bytes, which settles all d up to where the two differ.
    """
    first, last = min(x[1] for x in open_ones), max(x[2] for x in open_ones)
    g = len(group)
    n_after, n_before = np.array([len(s.after) for s in group]), np.array([len(s.before) for s in group])
    after, before = np.zeros((g, length), np.uint8), np.zeros((g, last + 1), np.uint8)
    for i, s in enumerate(group):
        after[i, : n_after[i]] = np.frombuffer(s.after, np.uint8)
        before[i, : min(n_before[i], last + 1)] = np.frombuffer(s.before, np.uint8)[: last + 1]
    letters, power, _ = _table(length + 1)
    head, tail = np.zeros(g, np.uint64), np.zeros(g, np.uint64)
    for i in range(length - first):
        tail += letters[after[:, i]] * power[i]
    for i in range(first):
        head += letters[before[:, i]] * power[i]
    place = {id(s): i for i, s in enumerate(group)}
    own = np.array([place[id(s)] for s, _, _ in open_ones])
    low, high = np.array([x[1] for x in open_ones]), np.array([x[2] for x in open_ones])
    until, since = low - 1, np.full(len(open_ones), -1)  # settled as repeated up to here, from since on
    for d in range(first, last + 1):
        asking = np.flatnonzero((low <= d) & (d <= high) & (until < d))
        if len(asking):
            fits = np.flatnonzero((n_after >= length - d) & (n_before >= d))
            h = _mixed(_mixed(head[fits]) + tail[fits])
            order = np.argsort(h)
            h, who = h[order], fits[order]
            at = np.zeros(g, np.int64)
            at[who] = np.arange(len(who))
            like = h[1:] == h[:-1]
            met = (np.append(False, like) | np.append(like, False))[at[own[asking]]]
            alone = asking[~met].tolist()
            for k in asking[met].tolist():
                i, s = int(at[own[k]]), open_ones[k][0]
                j = i - 1  # equal hashes stand together; nearly always the first neighbour is the witness
                while True:
                    if j < i and (j < 0 or h[j] != h[i]):
                        j = i + 1
                    if j > i and (j >= len(who) or h[j] != h[i]):
                        alone.append(k)
                        break
                    t = group[who[j]]
                    both = common(s.before, t.before)
                    if both >= d and common(s.after, t.after) >= length - d:
                        until[k] = min(high[k], both)
                        since[k] = d if since[k] < 0 else since[k]
                        break
                    j = j - 1 if j < i else j + 1
            for k in alone:
                if since[k] >= 0:
                    yield open_ones[k][0], int(since[k]), d - 1
                    since[k] = -1
        head += letters[before[:, d]] * power[d]
        if length - d - 1 >= 0:
            tail -= letters[after[:, length - d - 1]] * power[length - d - 1]
    for k in np.flatnonzero(since >= 0).tolist():
        yield open_ones[k][0], int(since[k]), int(until[k])


# --- the distributed steps ----------------------------------------------------------------


def _block_text(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    return b"".join(texts), np.cumsum([len(t) for t in texts])


def _repeated(asked: DataFrame, *keys: str) -> DataFrame:
    """Rows of asked(keys.., block, n) whose key has an n of 2 or more over all blocks, with the total; and each block's mark, of null keys."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    return asked.withColumn("total", total).where((F.col("total") >= 2) | F.col(keys[0]).isNull()).drop("n")


def _range_of(h: np.ndarray, n: int) -> np.ndarray:
    return np.minimum(h // np.uint64(((1 << 64) - 1) // n), np.uint64(n - 1)).astype(np.int64)


def removals(docs: DataFrame, uri: str, length: int, gram: int, hot: int, ranges: int | None) -> tuple[DataFrame, int]:
    """(block, spans): pairs of first and last starts of repeated strings per block, as little-endian longs; and each block once with none. With it, the number of blocks."""
    spark = docs.sparkSession

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks_of(batches, BLOCK_BYTES):
            # a name of its own for each attempt: only the names of finished ones are told
            block = uuid.uuid4().hex
            write_block(f"{uri}/blocks", block, ids, texts)
            text, ends = _block_text(texts)
            h, n = np.unique(anchors(np.frombuffer(text, np.uint8), ends, length, gram)[3], return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array([None], pa.int64()), "block": [block], "n": [len(text)]})
            for i in range(0, len(h), 1 << 16):
                j = min(len(h), i + (1 << 16))
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[i:j].view(np.int64)), "block": [block] * (j - i), "n": pa.array(n[i:j])})

    asked = materialize(as_bytes(docs).mapInArrow(lean(store), "h long, block string, n long"), f"{uri}/asked")
    marks = asked.where("h is null").select("block", "n")
    size, n_blocks = marks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_blocks = max(1, n_blocks)
    ranges = ranges or max(1, -(-size // RANGE_BYTES))
    repeated = materialize(_repeated(asked, "h"), f"{uri}/repeated")
    drop_dir(spark, f"{uri}/asked")

    def wanted(table: pa.Table) -> tuple:
        block = table.column("block")[0].as_py()
        text, ends = _block_text(read_block(f"{uri}/blocks", block)[1])
        real = table.filter(table.column("h").is_valid())
        keys = real.column("h").to_numpy().astype(np.int64).view(np.uint64)
        total = real.column("total").to_numpy()
        order = np.argsort(keys)
        keys, total = keys[order], total[order]
        at, first, last, h = anchors(np.frombuffer(text, np.uint8), ends, length, gram)
        if not len(keys) or not len(h):
            return block, text, at[:0], first[:0], last[:0], h[:0], total[:0]
        where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        keep = keys[where] == h
        return block, text, at[keep], first[keep], last[keep], h[keep], total[where[keep]]

    def send(table: pa.Table) -> pa.Table:
        """A block's sorted run for each range."""
        block, text, at, first, last, h, total = wanted(table)
        found: dict[bytes, list[int]] = {}
        size: dict[bytes, int] = {}
        cold = np.flatnonzero(total <= hot)
        for a, p, q, name in zip(at[cold].tolist(), first[cold].tolist(), last[cold].tolist(), h[cold].tolist(), strict=True):
            # the length of the part after the anchor stands in the key, so that equal keys are equal suffixes
            after = text[a : q + length]
            key = name.to_bytes(8, "big") + after + text[p:a][::-1]
            tag = key + len(after).to_bytes(2, "big")
            found.setdefault(tag, []).append(p)
            size[tag] = len(after)
        tags = sorted(found)
        of = _range_of(np.array([int.from_bytes(t[:8], "big") for t in tags], np.uint64), ranges) if tags else np.empty(0, np.int64)
        out: list[tuple[int, int, int]] = []
        packets = Packets(f"{uri}/runs", block)
        for r in np.unique(of).tolist():
            own = tags[int(np.searchsorted(of, r)) : int(np.searchsorted(of, r, "right"))]
            keys = [t[:-2] for t in own]
            shared, rests = front_coded(keys)
            out.append((r, *packets.add([
                np.array([len(k) for k in keys], "<u2").tobytes(), np.array([size[t] for t in own], "<u2").tobytes(), shared.astype("<u2").tobytes(), rests,
                np.array([len(found[t]) for t in own], "<u4").tobytes(), np.array([p for t in own for p in found[t]], "<i8").tobytes(),
            ])))
        packets.commit()
        ranges_of, at_of, size_of = np.array(out, np.int64).reshape(-1, 3).T
        return pa.table({"range": pa.array(ranges_of.astype(np.int32)), "block": pa.array([block] * len(out), pa.string()), "at": pa.array(at_of), "size": pa.array(size_of)})

    # explicit numbers of partitions, here and below: the rows are small and the work behind them isn't
    runs = repeated.repartition(n_blocks, "block").groupBy("block").applyInArrow(lean_group(send), "range int, block string, at long, size long")
    runs = materialize(runs, f"{uri}/run-places")

    def merge(table: pa.Table) -> pa.Table:
        names = table.column("block").to_pylist()
        out: dict[int, list[int]] = {}

        def run(i: int) -> Iterator[tuple[bytes, int, object]]:
            sizes, afters, shared, rests, counts, places = read_packet(f"{uri}/runs", names[i], table.column("at")[i].as_py(), table.column("size")[i].as_py(), 6)
            places = np.frombuffer(places, "<i8")
            n = np.frombuffer(counts, "<u4").astype(np.int64)
            stop = np.cumsum(n)
            payloads = ((a, i, places[e - k : e]) for a, k, e in zip(np.frombuffer(afters, "<u2").tolist(), n.tolist(), stop.tolist(), strict=True))
            return decoded(np.frombuffer(sizes, "<u2"), np.frombuffer(shared, "<u2"), rests, payloads)

        def close(group: list[Suffix]) -> None:
            for s, low, high in repeated_strings(group, length):
                for i, p in s.places:
                    p += len(s.before)
                    out.setdefault(i, []).extend((p - high, p - low))

        group: list[Suffix] = []
        name, before = None, None
        for key, shared, (after, i, places) in loser_tree([run(i) for i in range(table.num_rows)]):
            here = [(i, p) for p in places.tolist()]
            if before is not None and key == before and len(group[-1].after) == after:
                group[-1].places += here
                continue
            if key[:8] != name:
                close(group)
                group, name = [], key[:8]
            s = Suffix(key[8 : 8 + after], key[8 + after :], here, 0)
            if group:
                s.shared = min(shared - 8, len(s.after), len(group[-1].after))
            group.append(s)
            before = key
        close(group)
        return pa.table({"block": pa.array([names[i] for i in out], pa.string()), "spans": pa.array([np.array(v, "<i8").tobytes() for v in out.values()], pa.binary())})

    spans = runs.repartition(min(ranges, MOST_TASKS), "range").groupBy("range").applyInArrow(lean_group(merge), "block string, spans binary")
    if repeated.where(F.col("h").isNotNull() & (F.col("total") > hot)).limit(1).count():
        spans = spans.unionByName(_hot_spans(repeated, wanted, uri, length, hot, n_blocks))
    return spans.unionByName(marks_of(repeated)), n_blocks


def marks_of(repeated: DataFrame) -> DataFrame:
    return repeated.where("h is null").select("block", F.lit(b"").alias("spans"))


def _hot_spans(repeated: DataFrame, wanted, uri: str, length: int, hot: int, n_blocks: int) -> DataFrame:
    """Spans of the anchors of hot hashes: their strings are counted over all blocks by a 128-bit hash."""

    def strings(table: pa.Table) -> tuple[str, dict[bytes, list[int]]]:
        block, text, _, first, last, _, total = wanted(table)
        found: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(total > hot).tolist():
            for p in range(int(first[k]), int(last[k]) + 1):
                found.setdefault(hashlib.blake2b(text[p : p + length], digest_size=16).digest(), []).append(p)
        return block, found

    def ask(table: pa.Table) -> pa.Table:
        block, found = strings(table)
        return pa.table({"w": pa.array(list(found), pa.binary()), "block": pa.array([block] * len(found), pa.string()), "n": pa.array([len(v) for v in found.values()], pa.int64())})

    hot_only = repeated.where(F.col("h").isNull() | (F.col("total") > hot))
    asked = materialize(hot_only.repartition(n_blocks, "block").groupBy("block").applyInArrow(ask, "w binary, block string, n long"), f"{uri}/asked-hot")
    told = _repeated(asked, "w").select("block", "w", F.lit(None).cast("long").alias("h"), F.lit(0).cast("long").alias("total"))
    both = hot_only.select("block", F.lit(None).cast("binary").alias("w"), "h", "total").unionByName(told)

    def spans(table: pa.Table) -> pa.Table:
        names = set(table.column("w").drop_null().to_pylist())
        rest = table.filter(table.column("w").is_null())
        block, found = strings(rest)
        starts = [x for w, v in found.items() if w in names for p in v for x in (p, p)]
        return pa.table({"block": pa.array([block], pa.string()), "spans": pa.array([np.array(starts, "<i8").tobytes()], pa.binary())})

    return both.repartition(n_blocks, "block").groupBy("block").applyInArrow(spans, "block string, spans binary")


def merged_spans(pairs: np.ndarray, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal [start, end) covered by strings of `length` bytes that start in first .. last."""
    cover = np.zeros(size + 1, np.int32)
    np.add.at(cover, pairs[0::2], 1)
    np.add.at(cover, pairs[1::2] + length, -1)
    inside = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).view(np.int8), [0]])
    edge = np.diff(inside)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, ranges: int | None = None, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row of docs(doc_id, text).

    Strings never cross documents; they are judged on the input. A null text is empty. Rows
    that repeat are documents of their own, so that all their strings are repeated. Null ids are
    kept. An empty table gives no rows. A very long text is a block of its own. Other columns, of whatever
    names, are ignored. Texts are bytes: with_text
    gives what is left as binary, as a cut may fall inside a character.
    """
    uri = shared_dir(docs.sparkSession, "suffixes")
    spans, n_blocks = removals(docs, uri, length, gram, hot, ranges)
    spans = materialize(spans, f"{uri}/spans")

    def cut(table: pa.Table) -> pa.Table:
        ids, texts = read_block(f"{uri}/blocks", table.column("block")[0].as_py())
        ends = np.cumsum([len(t) for t in texts])
        pairs = np.frombuffer(b"".join(table.column("spans").to_pylist()), "<i8")
        pairs = pairs.reshape(-1, 2)[np.argsort(pairs[0::2], kind="stable")]
        starts = np.concatenate([[0], ends]).astype(np.int64)
        at = np.searchsorted(pairs[:, 0], starts)
        out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for k, t in enumerate(texts):
            own = pairs[at[k] : at[k + 1]] - starts[k]
            gone = merged_spans(own.ravel(), len(t), length) if len(own) else []
            if gone:
                edges = [0, *(x for s in gone for x in s), len(t)]
                kept = b"".join([t[i:j] for i, j in zip(edges[0::2], edges[1::2], strict=True)])
            else:
                kept = t
            out["n_bytes"].append(len(t))
            out["n_removed"].append(len(t) - len(kept))
            out["n_spans"].append(len(gone))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out["kept"].append(kept)
        columns = {"doc_id": pa.array(ids, pa.int64())} | {n: pa.array(out[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")} | {"kept_sha256": pa.array(out["kept_sha256"], pa.string())}
        return pa.table(columns | ({"kept": pa.array(out["kept"], pa.binary())} if with_text else {}))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return spans.repartition(n_blocks, "block").groupBy("block").applyInArrow(lean_group(cut), schema)
