"""Long exact spans shared between records (problem 10)."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small, stage
from .bloom import likely
from .copies import representatives
from .hashing import U, Rolling, Rolling2, mix

#: Characters that the gear hash of a position covers.
GEAR = 16
#: A chunk starts at the smallest gear hash of every COARSE characters, and ends at the first cut from LEAST characters on,
#: a cut being the smallest gear hash of every FINE characters.
LEAST, FINE = 48, 16
#: Texts are worked on in pieces of this many characters, which overlap by more than a span.
PIECE = 1 << 20
#: Equal chunks of more documents than this are compared in blocks of about as many, each two of them by a task of their own.
BLOCK = 1000
#: Windows around a chunk of which one must be equal in both texts if a span covers the chunk.
WINDOWS = 4


def coarse(span: int) -> int:
    """The widest distance of chunk starts at which every common span still holds a whole chunk that is cut alike."""
    return span - LEAST - 2 * FINE


def gear_hashes(symbols: np.ndarray) -> np.ndarray:
    """Gear hash at each position, over it and the GEAR - 1 symbols before: h = (h << 2) + gear[symbol] in 32 bits.

    The shift pushes a symbol out after 16 steps, so the hash is a sum over a window and doubles up in four steps.
    """
    g = symbols * np.uint32(0x9E3779B1)
    g ^= g >> np.uint32(15)
    g *= np.uint32(0x85EBCA77)
    g ^= g >> np.uint32(13)
    step = 1
    while step < GEAR:
        g[step:] = g[step:] + (g[:-step] << np.uint32(2 * step))
        step *= 2
    g *= np.uint32(0xC2B2AE3D)
    return g ^ (g >> np.uint32(16))


def _window_minima(packed: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window of `width`, by doubling."""
    out, have = packed, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def cuts(hashes: np.ndarray, width: int, inside: np.ndarray) -> np.ndarray:
    """Positions that are the smallest (of equals the last) of some window of `width` that lies inside one text.

    `inside`: for each position, how many positions up to it belong to the same text and have a whole gear window.
    """
    if len(hashes) < width:
        return np.empty(0, dtype=np.int64)
    n = len(hashes)
    packed = (hashes.astype(U) << U(32)) | (U(0xFFFFFFFF) - np.arange(n, dtype=U))
    low = _window_minima(packed, width)[inside[width - 1 :] >= width]
    at = np.int64(0xFFFFFFFF) - (low & U(0xFFFFFFFF)).astype(np.int64)
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


def chunks(texts: list[str], span: int) -> dict[str, np.ndarray]:
    """Chunks of a batch of texts: owner, start, size, digest, a hash of each window (-1: outside the text), and `same`: ranges of
    the starts of all chunks of the text with the same surroundings, where there are several."""
    owner_of, offset, parts = [], [], []
    for i, t in enumerate(texts):
        step = PIECE - 2 * span
        for at in range(0, max(1, len(t) - 2 * span), step) if len(t) > PIECE else (0,):
            if len(t) - at >= span:
                owner_of.append(i)
                offset.append(at)
                parts.append(t[at : at + PIECE])
    empty = {k: np.empty(0, dtype=np.int64) for k in ("owner", "start", "size", "digest", *[f"w{k}" for k in range(WINDOWS)], "same")}
    if not parts:
        return empty
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    data = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    part = np.repeat(np.arange(len(parts)), sizes)
    local = np.arange(len(data)) - begin[part]
    inside = local - (GEAR - 2)
    h = gear_hashes(data.copy())
    starts = cuts(h, coarse(span), inside) - (GEAR - 1)
    ends = cuts(h, FINE, inside)
    nxt = np.searchsorted(ends, starts + LEAST)
    ok = nxt < len(ends)
    starts, stops = starts[ok], ends[np.minimum(nxt[ok], max(len(ends) - 1, 0))] + 1
    ok = part[starts] == part[np.minimum(stops, len(data)) - 1]
    starts, stops = starts[ok], stops[ok]
    if not len(starts):
        return empty
    roll = Rolling(data)
    p = part[starts]
    room = span - (stops - starts)
    step = -(-room // WINDOWS)
    out = {"owner": np.array(owner_of)[p], "start": starts - begin[p] + np.array(offset)[p], "size": stops - starts, "digest": roll.spans(starts, stops).view(np.int64)}
    for k in range(WINDOWS):
        a, b = starts - step * k, stops + np.maximum(0, room - step * (k + 1))
        fits = (a >= begin[p]) & (b <= begin[p + 1])
        w = np.full(len(starts), -1, dtype=np.int64)
        w[fits] = (roll.spans(a[fits], b[fits]) & U(0x7FFFFFFF)).astype(np.int64)
        out[f"w{k}"] = w
    # equal surroundings as far as a span through the chunk can reach: one place stands for all, which it names
    a, b = np.maximum(starts - room, begin[p]), np.minimum(stops + room, begin[p + 1])
    around = mix(roll.spans(a, b) + out["owner"].astype(U) * U(0x9E3779B97F4A7C15) + (starts - a).astype(U))
    _, first, group, count = np.unique(around, return_index=True, return_inverse=True, return_counts=True)
    same: dict[int, bytes] = {}
    if len(first) < len(around):
        order = np.lexsort((out["start"], group))
        many = order[count[group[order]] > 1]
        for places in np.split(many, np.flatnonzero(np.diff(group[many])) + 1):
            same[int(first[group[places[0]]])] = _ranges(out["start"][places])
    keep = np.sort(first)
    out = {k: v[keep] for k, v in out.items()}
    out["same"] = np.array([same.get(int(i)) for i in keep], dtype=object)
    return out


def _ranges(starts: np.ndarray) -> bytes:
    """Ascending starts as pairs of first and last start of those that lie closer than a chunk is long."""
    far = np.flatnonzero(np.diff(starts) > LEAST)
    return np.stack([starts[np.r_[0, far + 1]], starts[np.r_[far, len(starts) - 1]]], axis=1).astype("<i4").tobytes()


def _range_batches(batches):
    for b in batches:
        doc, start, size = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "start", "size"))
        parts = [np.frombuffer(x, dtype="<i4").reshape(-1, 2) for x in b.column("same").to_pylist()]
        n = [len(x) for x in parts]
        both = np.concatenate(parts) if parts else np.empty((0, 2), dtype="<i4")
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(doc, n)), pa.array(np.repeat(start, n)), pa.array(np.repeat(size, n)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc_id", "start", "size", "lo", "hi"])


def _chunk_batches(batches, span: int):
    for b in batches:
        texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_numpy(zero_copy_only=False)
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= PIECE):
                size += len(texts[hi])
                hi += 1
            c = chunks(texts[lo:hi], span)
            cols = [pa.array(c["digest"]), pa.array(ids[lo:hi][c["owner"]]), pa.array(c["start"].astype(np.int32)), pa.array(c["size"].astype(np.int16))]
            cols += [pa.array(c[f"w{k}"].astype(np.int32)) for k in range(WINDOWS)] + [pa.array(c["same"].tolist(), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["digest", "doc_id", "start", "size", *[f"w{k}" for k in range(WINDOWS)], "same"])
            lo = hi


def _reach(x: bytes, y: bytes, back: bool) -> int:
    """Length of the common beginning (or end) of two arrays of code points, given as bytes."""
    n = min(len(x), len(y)) // 4
    if not n:
        return 0
    u, v = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
    d = u[len(u) - n :][::-1] != v[len(v) - n :][::-1] if back else u[:n] != v[:n]
    at = int(np.argmax(d))
    return at if d[at] else n


def _match_batches(batches, span: int):
    """Checks pairs of chunks in their surroundings, character by character: keeps those inside a common span."""
    for b in batches:
        n = b.num_rows
        left, right, keep = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32), np.zeros(n, dtype=bool)
        size = b.column("size").to_numpy(zero_copy_only=False)
        code = lambda name: [t.encode("utf-32-le", "surrogatepass") for t in b.column(name).to_pylist()]
        for i, (la, lb, ca, cb, ra, rb) in enumerate(zip(code("left_a"), code("left_b"), code("chunk_a"), code("chunk_b"), code("right_a"), code("right_b"))):
            if ca == cb:
                left[i], right[i] = _reach(la, lb, True), _reach(ra, rb, False)
                keep[i] = left[i] + right[i] + size[i] >= span
        out = [pa.array(left), pa.array(right)]
        names = ["doc_id_a", "start_a", "doc_id_b", "start_b", "size"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *out], names=[*names, "left", "right"]).filter(pa.array(keep))


def _window_batches(batches, span: int):
    """Hashes of all windows of `span` characters that begin in the given ranges (first, last) of a text."""
    for b in batches:
        ids, out = b.column("doc_id").to_numpy(zero_copy_only=False), []
        for i, (text, ranges) in enumerate(zip(b.column("text").to_pylist(), b.column("ranges").to_pylist())):
            data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            edge = np.zeros(len(data) + 2, dtype=np.int32)
            a = np.array([[max(0, r["a"]), min(len(data) - span, r["b"])] for r in ranges]).reshape(-1, 2)
            a = a[a[:, 0] <= a[:, 1]]
            np.add.at(edge, a[:, 0], 1)
            np.add.at(edge, a[:, 1] + 1, -1)
            at = np.flatnonzero(np.cumsum(edge) > 0)
            out.append((np.full(len(at), ids[i]), at.astype(np.int32), Rolling(data).spans(at, at + span).view(np.int64), Rolling2(data).spans(at, at + span).view(np.int64)))
        if out:
            columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "h", "g"])


class SharedChunks:
    """Chunks that may lie in a span which two documents share. All tables are staged.

    members: doc_id, rep: one row per document of at least `span` characters; rep is the smallest doc_id with the same text.
    texts: the representatives' texts. places: digest, k, w (a window around the chunk, equal in two texts at least), doc_id,
    start, size. repeats: doc_id, start, size, lo, hi: a chunk at `start` that occurs with the same surroundings all along lo to hi.
    """

    def __init__(self, documents: DataFrame, span: int) -> None:
        whole = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.length("text") >= span))
        marks = stage(whole.select("doc_id", F.xxhash64("text").alias("_h"), F.xxhash64(F.lit(1), "text").alias("_g")).distinct())
        self.members = stage(representatives(marks, "doc_id", ["_h", "_g"]))
        copies = small(self.members.filter("doc_id != rep").select("doc_id").distinct())
        self.texts = whole.join(copies, "doc_id", "left_anti")

        windows = [f"w{k}" for k in range(WINDOWS)]
        cut = self.texts.mapInArrow(partial(_chunk_batches, span=span), "digest long, doc_id long, start int, size short, " + ", ".join(f"{w} int" for w in windows) + ", same binary")
        cut = stage(cut, arrow_batch=1000)
        several = stage(cut.groupBy("digest").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).filter("_lo < _hi").select("digest"))
        shared = stage(likely(cut, several, "digest").join(several, "digest"))  # each digest once; a semi join would be pushed below the filter
        long = shared.select("digest", "doc_id", "start", "size", F.posexplode(F.array(*windows)).alias("k", "w")).filter("w >= 0")
        wide = long.groupBy(*KEY).agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).filter("_lo < _hi").select(*KEY)
        self.places = stage(long.join(wide, KEY))
        self.repeats = shared.filter("same IS NOT NULL").select("doc_id", "start", "size", "same").mapInArrow(_range_batches, "doc_id long, start int, size short, lo int, hi int").distinct()
        self.held = stage(self.places.select("doc_id").distinct())


#: What chunks have in common that may lie in the same span.
KEY = ["digest", "k", "w"]


def shared_spans(documents: DataFrame, span: int = 200) -> tuple[DataFrame, DataFrame]:
    """Places where two texts have at least `span` identical consecutive characters (code points, nothing normalised).

    documents: doc_id long (unique), text. Returns (matches, members). members: doc_id, rep: one row per document of at least
    `span` characters; rep is the smallest doc_id with the same text. matches: doc_id_a < doc_id_b (representatives only,
    copies are not expanded), start_a, start_b, length: common passages, each of at least `span` characters. A passage may come
    out in several overlapping pieces; of a chunk that repeats with the same surroundings in a text, one place is given.

    Method: content-defined chunking. A gear rolling hash gives cut points; as they depend on the near text alone, they
    move along with insertions. Chunks are compared by digest. Each span of `span` characters holds a whole chunk that is cut
    alike wherever the span occurs, because a cut is the smallest hash of a window rather than a value below a bound.
    Chunks that many texts share are told apart by four windows around the chunk, one of which lies in any span
    through it; only equal windows make pairs, in blocks where they are many, which are verified character by character.

    NULL, empty and short texts have no spans and no row in members. Texts of any length are worked on whole, in pieces that
    overlap. Repeated doc_ids are taken as one if the text is the same. An empty table gives two empty results.
    """
    c = SharedChunks(documents, span)
    at = c.places.groupBy("doc_id").agg(F.collect_set(F.struct("start", "size")).alias("_at"))  # places in one text
    room = F.lit(span) - F.col("size")
    first = F.greatest(F.col("start") - room, F.lit(0))
    around = (
        likely(c.texts, c.held, "doc_id").join(at, "doc_id").select("doc_id", "text", F.inline("_at"))
        .select("doc_id", "start", "size", F.substring("text", first + 1, F.col("start") - first).alias("left"), F.substring("text", F.col("start") + 1, F.col("size")).alias("chunk"), F.substring("text", F.col("start") + F.col("size") + 1, room).alias("right"))
    )
    around = stage(around)
    key = [*KEY, "size"]
    many = c.places.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK)
    many = small(stage(many.select(*key, F.ceil(F.col("_n") / BLOCK).cast("int").alias("_parts"))))
    parts = F.coalesce("_parts", F.lit(1))
    split = c.places.join(many, key, "left").withColumn("_part", F.pmod(F.xxhash64("doc_id"), parts).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    split = split.withColumn("_i", F.least("_part", "_other")).withColumn("_j", F.greatest("_part", "_other")).drop("_parts", "_other")
    placed = split.join(around, ["doc_id", "start", "size"])
    side = lambda x: placed.select(*key, "_i", "_j", *[F.col(n).alias(f"{n}_{x}") for n in ("_part", "doc_id", "start", "left", "chunk", "right")])
    pairs = side("a").join(side("b"), [*key, "_i", "_j"]).filter("doc_id_a < doc_id_b AND (_i = _j OR _part_a != _part_b)")
    found = pairs.mapInArrow(partial(_match_batches, span=span), "doc_id_a long, start_a int, doc_id_b long, start_b int, size short, left int, right int")
    matches = found.select("doc_id_a", (F.col("start_a") - F.col("left")).alias("start_a"), "doc_id_b", (F.col("start_b") - F.col("left")).alias("start_b"), (F.col("left") + F.col("size") + F.col("right")).alias("length")).distinct()
    return stage(matches, arrow_batch=2000), c.members


def expand(matches: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of doc_ids behind matches of representatives; copies of one text are pairs as well."""
    links = matches.select("doc_id_a", "doc_id_b").distinct()
    a, b = members.select(F.col("rep").alias("doc_id_a"), F.col("doc_id").alias("x")), members.select(F.col("rep").alias("doc_id_b"), F.col("doc_id").alias("y"))
    across = links.join(a, "doc_id_a").join(b, "doc_id_b").select("x", "y")
    copies = members.filter("doc_id != rep")
    inside = copies.select(F.col("rep").alias("x"), F.col("doc_id").alias("y")).unionByName(copies.select("rep", F.col("doc_id").alias("x")).join(copies.select("rep", F.col("doc_id").alias("y")), "rep").filter("x < y").select("x", "y"))
    return across.unionByName(inside).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def classes(matches: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the same text), n_links (other classes with a common span), of documents of at least a span."""
    links = matches.select("doc_id_a", "doc_id_b").distinct()
    ends = links.select(F.explode(F.array("doc_id_a", "doc_id_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(ends, "rep", "left").select("doc_id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def shared_part(documents: DataFrame, span: int = 200) -> DataFrame:
    """Per document: n_chars, shared_chars (characters that lie in a span shared elsewhere) and shared_part of n_chars.

    Overlapping passages count once. A text that has a copy is shared as a whole; a NULL text has 0 characters.

    Method: the chunks of shared_spans, but no pairs. All windows of `span` characters around a chunk that may be shared are
    hashed (128 bits); one that occurs in two texts covers its characters. So a passage that a million documents share costs
    a million rows for each of its windows, counted before the shuffle, and no product.
    """
    c = SharedChunks(documents, span)
    begin = F.struct((F.col("start") + F.col("size") - span).alias("a"), F.col("start").alias("b"))
    again = c.repeats.join(c.places.select("doc_id", "start").distinct(), ["doc_id", "start"]).select("doc_id", F.struct((F.col("lo") + F.col("size") - span).alias("a"), F.col("hi").alias("b")).alias("r"))
    ranges = c.places.select("doc_id", begin.alias("r")).unionByName(again).groupBy("doc_id").agg(F.collect_set("r").alias("ranges"))  # places in one text
    windows = likely(c.texts, c.held, "doc_id").join(ranges, "doc_id").select("doc_id", "text", "ranges").mapInArrow(partial(_window_batches, span=span), "doc_id long, at int, h long, g long")
    windows = stage(windows, arrow_batch=200)
    owned = stage(windows.groupBy("h", "g").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).filter("_lo < _hi").select("h", "g"))
    covers = likely(windows, owned, "h").join(owned, ["h", "g"]).select("doc_id", "at").distinct()
    step = F.col("at") - F.lag("at").over(Window.partitionBy("doc_id").orderBy("at"))
    covered = covers.withColumn("_c", F.least(F.lit(span), F.coalesce(step, F.lit(span)))).groupBy(F.col("doc_id").alias("rep")).agg(F.sum("_c").alias("_c"))
    copied = c.members.groupBy("rep").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    per_doc = c.members.join(covered, "rep", "left").join(copied, "rep", "left").groupBy("doc_id").agg(F.max("_c").alias("_c"), F.max("_n").alias("_n"))
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    out = documents.select("doc_id", chars.alias("n_chars")).join(per_doc, "doc_id", "left")
    amount = F.when(F.col("_n") > 1, F.col("n_chars")).otherwise(F.coalesce("_c", F.lit(0)))
    return out.select("doc_id", "n_chars", amount.cast("long").alias("shared_chars"), F.coalesce(F.try_divide(amount, F.col("n_chars")), F.lit(0.0)).alias("shared_part"))
