"""Near-duplicate records with small edits (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, small, stage
from .bloom import likely
from .copies import representatives
from .hashing import U, distinct_sorted, mix, word_shingles

#: Values that a sketch retains, and the bytes kept of each (the highest ones).
RETAINED, BYTES = 48, 5
#: An inverted list up to this length gives its pairs; a longer one is cut by one more value of its sketches, and once again. Of
#: lists that are longer even then, only pairs that pass the estimate come out.
LIST = 16
#: A posting has the values that come next behind its key, with 16 bits of each, so that lists are cut where they are.
AHEAD = 4
#: The next value that a long list is cut by lies up to so many places behind the last.
GAP = 3
#: A list of more postings is not held at once: its postings are sent again under one more value.
HELD = 1 << 18
#: A longer list is cut into parts of about this many sketches; every two parts are compared by a task of their own.
BLOCK = 2048
#: Hot lists are compared together up to this many cells (pairs) at a time, and pairs listed up to STEP at a time.
CELLS, STEP = 1 << 22, 1 << 21
#: Keys have 41 bits, which leaves 7 of 6 bytes: two that are equal by chance cost candidates, but lose none.
SHORT = U(23)
#: Stands for the end of a sketch that retains its whole set.
END = U(0x5851F42D4C957F2D)
#: Shared lists that make two sketches candidates; to share a list is to have one more value in common behind its key.
SHARED = 2
#: Sets up to twice this size are also listed under single values, with the weight SHARED, as few neighbours are left to share in them.
TINY = 12
#: Texts are hashed in parts of about this many characters.
PART = 2_000_000


def _parts(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def _groups(owner: np.ndarray, n: int) -> np.ndarray:
    """Start of each owner's part in a sorted array of owners, and the end of the last."""
    return np.searchsorted(owner, np.arange(n + 1))


def _pack(values: np.ndarray) -> bytes:
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def _unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All retained values of a batch one after the other, and where each sketch starts."""
    sizes = np.fromiter((len(p) // BYTES for p in packed), dtype=np.int64, count=len(packed))
    raw = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(-1, BYTES)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 8 - BYTES :] = raw
    return wide.view(">u8").ravel().astype(U), np.concatenate([[0], np.cumsum(sizes)])


def _binary(data: bytes, sizes: np.ndarray) -> pa.Array:
    """A binary array of parts of `data` of the given sizes, one after the other."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _sketch_batches(batches, width: int, min_words: int, retained: int):
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        digests, sizes, packed, kept = [], [], [], []
        for lo, hi in _parts(texts, PART):
            h, owner, words = word_shingles(texts[lo:hi], width)
            long = words[owner] >= min_words
            h, owner = distinct_sorted(h[long], owner[long])
            n = np.bincount(owner, minlength=hi - lo)
            at = np.concatenate([[0], np.cumsum(n)])
            some = np.flatnonzero(n)
            sums, mixed = np.zeros(hi - lo, dtype=U), np.zeros(hi - lo, dtype=U)
            if len(some):
                sums[some], mixed[some] = np.add.reduceat(h, at[some]), np.bitwise_xor.reduceat(h, at[some])
            two = mix(np.stack([sums + mixed * U(5) + n.astype(U), sums * U(2) + mixed * U(5) + mix(sums ^ mixed)], axis=1))
            digests.append(two.astype(">u8").tobytes())
            sizes.append(n)
            keep = np.arange(len(h)) - at[owner] < retained
            packed.append(_pack(h[keep]))
            kept.append(np.minimum(n, retained))
        n, k = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (sizes, kept))
        columns = [b.column("id"), b.column("version"), _binary(b"".join(digests), np.full(len(n), 16)), pa.array(n.astype(np.int32)), _binary(b"".join(packed), k * BYTES)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "version", "digest", "n", "sketch"])


def _version():
    """Orders the rows of an id; equal versions by content, everywhere alike."""
    return F.struct(F.col("version").alias("v"), F.xxhash64("text").alias("h")).alias("version")


def sketches(texts: DataFrame, width: int, min_words: int, retained: int = RETAINED) -> tuple[DataFrame, DataFrame]:
    """Bottom-k sketches of the distinct shingles of each id's latest text. texts: id, version, text.

    Returns (members, sketches), both staged. members: id, rep (smallest id whose set of shingles is the same). sketches: one
    row per rep: rep, n (size of the set), sketch.
    """
    one = texts.select("id", _version(), "text").filter(F.col("id").isNotNull())
    kinds = dict(one.dtypes)
    rows = one.mapInArrow(partial(_sketch_batches, width=width, min_words=min_words, retained=retained), f"id {kinds['id']}, version {kinds['version']}, digest binary, n int, sketch binary")
    newest = rows.groupBy("id").agg(F.max_by(F.struct("digest", "n", "sketch"), "version").alias("_x")).select("id", "_x.*").filter(F.col("n") > 0)
    newest = stage(newest, arrow_batch=2000)
    members = stage(representatives(newest, "id", ["digest"]))
    copies = small(members.filter(F.col("id") != F.col("rep")).select("id"))
    return members, newest.join(copies, "id", "left_anti").select(F.col("id").alias("rep"), "n", "sketch")


def _keys(values: np.ndarray, start: np.ndarray, owner: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A key over the values at some places of a sketch; bit p of `places` stands for its value p, the place behind its last for END."""
    size, rest = np.diff(start)[owner], places.copy()
    key = np.zeros(len(places), dtype=U)
    while rest.any():
        lowest = rest & -rest
        at = np.where(lowest, np.frexp(lowest.astype(np.float64))[1] - 1, 0)
        value = np.where(at < size, values[np.minimum(start[owner] + at, max(len(values) - 1, 0))], END)
        key = np.where(lowest != 0, mix(key + value + U(1)), key)
        rest ^= lowest
    return key


def _post_batches(batches, retained: int):
    """Keys of two values in a row. A whole set ends with END, so that small sets have keys as well; tiny ones also have single values.

    key: 41 bits, then one bit for single values, then 6 bits for the place of the first value; next: what comes behind.
    """
    for b in batches:
        values, start = _unpack(b.column("sketch").to_pylist())
        docs = b.column("rep").to_numpy(zero_copy_only=False)
        n = b.column("n").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(docs)), np.diff(start))
        at = np.arange(len(values)) - start[owner]
        follows = (at + 1 < np.diff(start)[owner]) | (n[owner] <= retained)
        tiny = n[owner] <= 2 * TINY
        single = np.repeat([0, 1], [follows.sum(), tiny.sum()])
        at, owner = np.concatenate([at[follows], at[tiny]]), np.concatenate([owner[follows], owner[tiny]])
        key = _keys(values, start, owner, (np.int64(3) - 2 * single) << at)
        key = (key >> SHORT << U(7)) | (single << 6 | at).astype(U)
        pieces = _piece(values)
        end = np.where(n <= retained, _piece(np.array([END]))[0], 0)[owner]
        ahead = np.empty((len(at), AHEAD), dtype="<u2")
        size = np.diff(start)[owner]
        for k in range(AHEAD):
            to = at + 2 - single + k
            ahead[:, k] = np.where(to < size, pieces[np.minimum(start[owner] + to, len(values) - 1)], end) if len(at) else 0
        yield pa.RecordBatch.from_arrays([pa.array(ahead.view("<i8").ravel()), pa.array(key.view(np.int64)), pa.array(docs[owner])], names=["next", "key", "doc"])


def _piece(values: np.ndarray) -> np.ndarray:
    """16 bits of each value, never 0, which stands for no value."""
    return np.maximum(mix(values) >> U(48), U(1)).astype(np.uint16)


def _listed(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Owner and places of the hot keys of a batch of sketches."""
    lists = [np.array(x, dtype=np.int64) for x in b.column("places").to_pylist()]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return owner, np.concatenate(lists) if lists else np.empty(0, dtype=np.int64)


def _cut(key: np.ndarray, doc: np.ndarray, places: np.ndarray, ahead: np.ndarray, gap: int):
    """The postings under one more value each, up to `gap` places behind the last; from: the numbers of the old postings."""
    got = []
    last = np.frexp(places.astype(np.float64))[1].astype(np.int64) - 1
    for k in range(gap):
        at = np.flatnonzero((ahead[:, k] > 0) & (ahead[:, k] != ahead[:, k - 1] if k else True))  # END comes once
        rest = np.zeros((len(at), AHEAD), dtype=np.uint16)
        rest[:, : AHEAD - k - 1] = ahead[at, k + 1 :]
        got.append((mix(key[at] + ahead[at, k].astype(U) + U(1)), doc[at], places[at] | (np.int64(1) << (last[at] + k + 1)), rest, at))
    return tuple(np.concatenate(x) for x in zip(*got))


def _meet(key: np.ndarray, doc: np.ndarray, places: np.ndarray, ahead: np.ndarray, single: np.ndarray, depth: int, longest: int):
    """Pairs of whole lists, sorted by key (a, b, number of a posting in their list), and the postings of those that are long to the end (doc, places).

    depth: how many values the lists have been cut by. Two postings of a list that is not cut also need a value in common among
    those that come next, unless the list is one of single values.
    """
    a, b, origin = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    hot = [(np.empty(0, dtype=np.int64),) * 2]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
    length = np.diff(np.append(first, len(key)))
    for size in np.unique(length[(length > 1) & (length <= longest)]):
        at = first[length == size]
        i, j = np.triu_indices(size, 1)
        x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
        if depth == 0:
            both = single[x].copy()
            for k in range(AHEAD):
                u = ahead[x, k]
                some = u > 0
                for m in range(AHEAD):
                    both |= some & (u == ahead[y, m])
            x, y = x[both], y[both]
        differ = doc[x] != doc[y]
        x, y = x[differ], y[differ]
        a.append(np.minimum(doc[x], doc[y]))
        b.append(np.maximum(doc[x], doc[y]))
        origin.append(x)
    at = np.flatnonzero(np.repeat(length, length) > longest)
    if len(at) and depth == 2:
        hot.append((doc[at], places[at]))
    elif len(at):
        start = np.repeat(first, length)[at]  # stands for the list
        k2, d2, p2, n2, back = _cut(key[at], doc[at], places[at], ahead[at], AHEAD if depth else GAP)
        order = np.argsort(k2, kind="stable")
        u, v, of, left = _meet(k2[order], d2[order], p2[order], n2[order], single[at][back[order]], depth + 1, longest)
        of = start[back[order[of]]]
        once = np.unique(mix(mix(of.astype(U) + mix(u)) + v.astype(U)), return_index=True)[1]  # a pair counts once in a list
        a.append(u[once])
        b.append(v[once])
        origin.append(of[once])
        hot.append(left)
    return np.concatenate(a), np.concatenate(b), np.concatenate(origin), tuple(np.concatenate(x) for x in zip(*hot))


MET = "a long, b long, places long, key long, next long"


def _meet_batches(batches, longest: int, held: int, depth: int):
    """Reads postings sorted by key: pairs of lists (see `_meet`), postings that are left in long lists (b and key are NULL), and
    the postings of lists of more than `held` under one more value (b is NULL). No more than `held` and a batch are held.
    """

    def rows(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(columns["a"])
        return pa.RecordBatch.from_arrays([pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(n, pa.int64()) for c in ("a", "b", "places", "key", "next")], names=["a", "b", "places", "key", "next"])

    def again(key, doc, places, ahead, single):
        k, d, p, n, _ = _cut(key, doc, places, ahead, AHEAD if depth else GAP)
        return rows({"a": d, "places": p, "key": k.view(np.int64), "next": np.ascontiguousarray(n).view("<i8").ravel()})

    def whole(*lists):
        a, b, origin, (d, p) = _meet(*lists, depth, longest)
        single = lists[4][origin]
        if len(a):
            a, b = (np.concatenate([x, *[x[single]] * (SHARED - 1)]) for x in (a, b))
            yield rows({"a": a, "b": b})
        if len(d):
            yield rows({"a": d, "places": p})

    kept, long = None, None
    for batch in batches:
        key, doc, ahead = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc", "next"))
        if not len(key):
            continue
        if depth:
            places, single = batch.column("places").to_numpy(zero_copy_only=False), np.zeros(len(key), dtype=bool)
        else:
            single = (key >> 6 & 1).astype(bool)
            places = (np.int64(3) - 2 * single) << (key & 63)
            key = key >> 6
        t = (key.astype(U), doc, places, np.ascontiguousarray(ahead).view("<u2").reshape(-1, AHEAD), single)
        more = int(np.searchsorted(key, key[0], side="right")) if long == key[0] else 0
        if more:
            yield again(*(x[:more] for x in t))
            t = tuple(x[more:] for x in t)
            if more == len(key):
                continue
        if kept is not None:
            t = tuple(np.concatenate(x) for x in zip(kept, t))
        key = t[0].view(np.int64)
        cut = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
        if cut:
            yield from whole(*(x[:cut] for x in t))
        kept = tuple(x[cut:].copy() for x in t)
        if len(kept[0]) > held:
            yield again(*kept)
            kept, long = None, key[-1]
    if kept is not None:
        yield from whole(*kept)


def _list_batches(batches, longest: int, final: bool):
    """Reads postings sorted by key: pairs of lists up to `longest`, and the postings of longer lists (b is NULL then).

    Only the last `longest` postings of an open list are held; in the final round a list of any length gives its pairs, in blocks.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    open_key, count = None, 0

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.zeros(len(a), dtype=np.int64))], names=["a", "b", "places"])

    def pairs(docs: np.ndarray):
        docs = np.unique(docs)
        i, j = np.triu_indices(len(docs), 1)
        return docs[i], docs[j]

    def close():
        docs = np.concatenate([d for d, _ in held]) if held else np.empty(0, dtype=np.int64)
        if len(docs) <= 2000:
            a, b = pairs(docs)
            if len(a):
                yield out(a, b)
            return
        docs = np.unique(docs)
        for i in range(len(docs) - 1):
            rest = docs[i + 1 :]
            yield out(np.full(len(rest), docs[i]), rest)

    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False)
        doc = batch.column("doc").to_numpy(zero_copy_only=False)
        pos = batch.column("places").to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        last = np.r_[first[1:], len(key)]
        got_a, got_b, hot_d, hot_p = [], [], [], []
        for s, e in ((first[0], last[0]), *(((first[-1], last[-1]),) if len(first) > 1 else ())):
            if key[s] != open_key:
                if count and (final or count <= longest):
                    yield from close()
                held, open_key, count = [], key[s], 0
            before, count = count, count + (e - s)
            if final or count <= longest:
                held.append((doc[s:e].copy(), pos[s:e].copy()))
            else:
                if before <= longest:
                    for d, p in held:
                        hot_d.append(d)
                        hot_p.append(p)
                    held = []
                hot_d.append(doc[s:e])
                hot_p.append(pos[s:e])
        if len(first) > 2:  # lists that begin and end in this batch are worked on by length
            s, n = first[1:-1], (last - first)[1:-1]
            for size in np.unique(n[(n > 1)]):
                at = s[n == size]
                if size > longest and not final:
                    idx = (at[:, None] + np.arange(size)).ravel()
                    hot_d.append(doc[idx])
                    hot_p.append(pos[idx])
                elif size <= 2000:
                    block = np.sort(doc[at[:, None] + np.arange(size)], axis=1)
                    i, j = np.triu_indices(size, 1)
                    a, b = block[:, i].ravel(), block[:, j].ravel()
                    keep = a != b
                    got_a.append(a[keep])
                    got_b.append(b[keep])
                else:
                    for x in at:
                        docs = np.unique(doc[x : x + size])
                        for i in range(len(docs) - 1):
                            got_a.append(np.full(len(docs) - 1 - i, docs[i]))
                            got_b.append(docs[i + 1 :])
        if got_a:
            a, b = np.concatenate(got_a), np.concatenate(got_b)
            yield out(a, b)
        if hot_d:
            d = np.concatenate(hot_d)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.nulls(len(d), pa.int64()), pa.array(np.concatenate(hot_p), pa.int64())], names=["a", "b", "places"])
    if count and (final or count <= longest):
        yield from close()


def _hot_batches(batches):
    """The sketches in hot lists with the keys of these lists."""
    for b in batches:
        values, start = _unpack(b.column("sketch").to_pylist())
        owner, places = _listed(b)
        key, owner = distinct_sorted(_keys(values, start, owner, places), owner)
        offsets = _groups(owner, b.num_rows).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("sketch"), keys], names=["rep", "sketch", "keys"])


def _together(code: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (first < second) that have a code in common, once for each such code, in steps."""
    order = np.lexsort((row, code))
    code, row = code[order], row[order]
    end = np.searchsorted(code, code, side="right")
    ahead = end - np.arange(len(code)) - 1
    total = np.concatenate([[0], np.cumsum(ahead)])
    lo = 0
    while lo < len(code):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + STEP, side="right")) - 1)
        first = np.repeat(np.arange(lo, hi), ahead[lo:hi])
        second = first + 1 + np.arange(len(first)) - (total[first] - total[lo])
        yield row[first], row[second]
        lo = hi


def _hot_pairs(group, key, part, split, docs, packed, keys, key_start, least: float, retained: int):
    """Pairs of the rows of each group that pass the estimate. Rows are sorted by group; group counts from 0.

    Nothing that passes is lost: it shares at least least * k of the k values of either sketch, so both have one of these among
    their k - least * k + 1 values that are rarest in the group. A pair comes out of the least of the hot keys it shares only.
    """
    values, start = _unpack(packed)
    k = np.diff(start)
    owner = np.repeat(np.arange(len(k)), k)
    _, code, count = np.unique((group[owner].astype(U) << U(8 * BYTES)) | values, return_inverse=True, return_counts=True)
    order = np.lexsort((code, count[code], owner))
    code = code[order]
    needed = np.maximum(1, np.ceil(least * k - 1e-9)).astype(np.int64)
    keep = (np.arange(len(code)) - start[owner] < (k - needed + 1)[owner]) & (count[code] > 1)
    begin = np.searchsorted(group, group)
    width = (np.searchsorted(group, group, side="right") - begin).astype(np.int64)
    strip = np.concatenate([[0], np.cumsum(width)])
    met = np.zeros(strip[-1], dtype=bool)
    for i, j in _together(code[keep], owner[keep]):
        met[strip[i] + j - begin[i]] = True
    holder = np.repeat(np.arange(len(k)), np.diff(key_start))
    smaller = keys < key[holder]
    _, code = np.unique(keys[smaller], return_inverse=True)
    for i, j in _together(group[holder[smaller]].astype(np.int64) * len(keys) + code, holder[smaller]):
        met[strip[i] + j - begin[i]] = False
    matrix = _matrix(packed, retained)
    for lo in range(0, len(met), STEP):
        cell = np.flatnonzero(met[lo : lo + STEP]) + lo
        i = np.searchsorted(strip, cell, side="right") - 1
        j = cell - strip[i] + begin[i]
        across = (i < j) & (~split[i] | (part[i] != part[j]))
        i, j = i[across], j[across]
        for at in range(0, len(i), 50_000):
            x, y = i[at : at + 50_000], j[at : at + 50_000]
            good = _alike(np.concatenate([matrix[x], matrix[y]], axis=1), least, retained)
            if good.any():
                a, b = docs[x[good]], docs[y[good]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _block_batches(batches, least: float, retained: int):
    """Reads postings sorted by key, i, j; each group of equal ones has at most about two parts of a list."""
    held: pa.Table | None = None

    def new_group(t: pa.Table) -> np.ndarray:
        columns = [t.column(c).to_numpy() for c in ("key", "i", "j")]
        return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))

    def work(t: pa.Table, first: np.ndarray):
        size = np.diff(np.append(first, t.num_rows))
        cells = np.cumsum(size.astype(np.int64) ** 2)
        lo = 0
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(cells, (cells[lo - 1] if lo else 0) + CELLS, side="right")))
            rows = t.slice(first[lo], size[lo:hi].sum()).combine_chunks()
            group = np.repeat(np.arange(hi - lo), size[lo:hi])
            lists = rows.column("keys").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            offsets = lists.offsets.to_numpy()
            number = {c: rows.column(c).to_numpy() for c in ("key", "i", "j", "part", "rep")}
            yield from _hot_pairs(group, number["key"], number["part"], number["i"] != number["j"], number["rep"], rows.column("sketch").to_pylist(), lists.flatten().to_numpy(), offsets - offsets[0], least, retained)
            lo = hi

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        first = new_group(t)
        if len(first) > 1:
            yield from work(t.slice(0, first[-1]), first[:-1])
        held = t.slice(first[-1])
    if held is not None:
        yield from work(held, np.array([0]))


def hot_pairs(hot: DataFrame, least: float, retained: int = RETAINED, block: int | None = None) -> DataFrame:
    """Pairs a, b that meet in a hot list and pass the estimate. hot: rep, sketch, places (those of the keys of its hot lists)."""
    block = block or BLOCK
    kind = dict(hot.dtypes)["rep"]
    docs = stage(hot.select("rep", "sketch", "places").mapInArrow(_hot_batches, f"rep {kind}, sketch binary, keys array<long>"))
    long = docs.select(F.explode("keys").alias("key")).groupBy("key").count().filter(F.col("count") > block)
    long = small(stage(long.select("key", F.ceil(F.col("count") / block).cast("int").alias("parts"))))
    posted = docs.select("*", F.explode("keys").alias("key")).join(long, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    posted = posted.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    posted = posted.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "sketch", "keys")
    return posted.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(partial(_block_batches, least=least, retained=retained), "a long, b long")


def candidates(sketched: DataFrame, longest: int = LIST, retained: int = RETAINED, least: float = 0.0, held: int | None = None) -> DataFrame:
    """Pairs of representatives that share SHARED lists of retained values: a, b, shared (weight of the shared lists); staged.

    A list holds the sketches in which the same two retained values follow each other. Two sketches share it if they also have one
    of the next AHEAD values in common. Postings carry these, so lists longer than `longest`, which say little, are cut by one
    more value and once again where they are; only those of more than `held` postings are sent again for that. Of lists that are
    long to the end, all pairs come out that pass the estimate with `least`, with the weight SHARED. No list is left out or cut short.
    """
    held = max(longest, held or HELD)
    work = partial(_meet_batches, longest=longest, held=held)
    posted = sketched.mapInArrow(partial(_post_batches, retained=retained), "next long, key long, doc long")
    levels = [stage(posted.repartition(F.shiftrightunsigned("key", 6)).sortWithinPartitions("key").mapInArrow(partial(work, depth=0), MET))]
    for depth in (1, 2):
        longer = levels[-1].filter(F.col("key").isNotNull())
        if longer.isEmpty():
            break
        longer = longer.select("key", F.col("a").alias("doc"), "places", "next").repartition("key").sortWithinPartitions("key")
        levels.append(stage(longer.mapInArrow(partial(work, depth=1), MET) if depth == 1 else longer.mapInArrow(partial(_list_batches, longest=longest, final=False), "a long, b long, places long").withColumn("key", F.lit(None).cast("long"))))
    met = reduce(DataFrame.unionByName, [x.select("a", "b", "places", "key") for x in levels])
    hot = stage(met.filter("b IS NULL AND key IS NULL").groupBy(F.col("a").alias("rep")).agg(F.collect_set("places").alias("places")))  # a sketch has few places
    last = stage(hot_pairs(likely(sketched, hot.select("rep"), "rep").join(hot, "rep"), least, retained))
    pairs = met.filter("b IS NOT NULL").select("a", "b", F.lit(1).alias("weight")).unionByName(last.withColumn("weight", F.lit(SHARED)))
    out = stage(pairs.groupBy("a", "b").agg(F.sum("weight").alias("shared")).filter(F.col("shared") >= SHARED))
    discard(*levels, hot, last)
    return out


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows, filled up with the greatest number."""
    values, start = _unpack(packed)
    out = np.full((len(packed), width), np.iinfo(U).max, dtype=U)
    row = np.repeat(np.arange(len(packed)), np.diff(start))
    out[row, np.arange(len(values)) - start[row]] = values
    return out


def _alike(both: np.ndarray, least: float, retained: int) -> np.ndarray:
    """Union-sketch estimate: of the smallest values of both sketches together, the part that both retain. Sorts in place."""
    both.sort(axis=1)
    real = both < np.iinfo(U).max
    twice = np.zeros(both.shape, dtype=bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~twice, axis=1)
    common = np.count_nonzero(twice & (rank <= retained), axis=1)
    return common >= least * np.minimum(retained, rank[:, -1]) if len(rank) else np.zeros(0, dtype=bool)


def _estimate_batches(batches, least: float, retained: int):
    for b in batches:
        both = np.concatenate([_matrix(b.column(c).to_pylist(), retained) for c in ("sketch_a", "sketch_b")], axis=1)
        yield b.filter(pa.array(_alike(both, least, retained))).select(["a", "b"])


def _verify_batches(batches, least: float, width: int):
    """Exact similarity of pairs of texts; each text of a batch is hashed once."""
    for b in batches:
        both = [b.column(c).dictionary_encode() for c in ("text_a", "text_b")]
        texts = list(dict.fromkeys(t for d in both for t in d.dictionary.to_pylist()))
        at, sets = {t: i for i, t in enumerate(texts)}, []
        for lo, hi in _parts(texts, PART):
            h, owner, _ = word_shingles(texts[lo:hi], width)
            h, owner = distinct_sorted(h, owner)
            part = _groups(owner, hi - lo)
            sets += [h[part[i] : part[i + 1]] for i in range(hi - lo)]
        score = np.zeros(b.num_rows)
        for k, (x, y) in enumerate(zip(*(d.to_pylist() for d in both))):
            u, v = sets[at[x]], sets[at[y]]
            common = len(np.intersect1d(u, v, assume_unique=True))
            score[k] = common / max(1, len(u) + len(v) - common)
        kept = b.select(["a", "b"]).append_column("jaccard", pa.array(score, pa.float64()))
        yield kept.filter(pa.array(score >= least, pa.bool_()))


def near_duplicates(texts: DataFrame, width: int = 5, threshold: float = 0.8, min_words: int = 1, retained: int = RETAINED, longest: int = LIST) -> tuple[DataFrame, DataFrame]:
    """Records whose sets of word shingles have a Jaccard similarity of at least `threshold`.

    texts: id long, version (any ordered type), text. Of each id the row with the greatest version counts. Returns
    (links, members). members: id, rep: one row per id with enough words; rep is the smallest id with exactly the same set.
    links: a, b, jaccard: pairs of different sets, by their representatives, a < b. Copies are never expanded into pairs.

    Method: a sketch retains the smallest values of one hash function over the shingles. Inverted lists of retained values
    give pairs and their overlap (see `candidates`); pairs that share fewer than SHARED lists fall out; so do pairs whose estimate
    from the union of both sketches is below 0.55 of the threshold; the rest is verified by the exact similarity of the whole
    sets. Which pairs are missed depends on chance, not on the size of a group; the README has measured recall.

    NULL ids are left out; a NULL or empty text has no words. Texts of any length are hashed whole. Repeated rows change
    nothing, equal versions are decided by content. An empty table gives two empty results. Extra columns are ignored.
    """
    members, sketched = sketches(texts, width, min_words, retained)
    pairs = candidates(sketched, longest, retained, 0.55 * threshold).select("a", "b")
    ends = stage(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    own = likely(sketched.select("rep", "sketch"), ends, "rep")
    both = pairs.join(own.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(own.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    close = stage(both.mapInArrow(partial(_estimate_batches, least=0.55 * threshold, retained=retained), "a long, b long"))
    needed = stage(close.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    # texts are sent instead of their sets of hashes, as they are shorter when compressed
    whole = likely(texts.select("id", "version", "text"), needed, "id").join(needed, "id")
    whole = stage(whole.groupBy("id").agg(F.max_by("text", _version()).alias("text")), arrow_batch=1000)
    full = close.join(whole.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(whole.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    links = stage(full.mapInArrow(partial(_verify_batches, least=threshold, width=width), "a long, b long, jaccard double"), arrow_batch=2000)
    return links, members


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of ids (id_a < id_b) behind links between representatives, pairs within a class included."""
    a, b = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.join(a, "a").join(b, "b").select("x", "y")
    copies = members.filter(F.col("id") != F.col("rep"))
    inside = copies.select(F.col("rep").alias("x"), F.col("id").alias("y")).unionByName(copies.select("rep", F.col("id").alias("x")).join(copies.select("rep", F.col("id").alias("y")), "rep").filter("x < y").select("x", "y"))
    return across.unionByName(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
