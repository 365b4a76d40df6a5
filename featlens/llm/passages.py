"""Substring dedup: near-duplicate passages by compact windows of token min-hashes.

The tokens of a document are its word 5-grams (64-bit hashes). Under a hash function, the Cartesian tree of the
token hashes splits all subsequences of at least ``least`` tokens into compact windows (l, c, r): every
subsequence that begins in l..c and ends in c..r has token c as its minimum. Only the tree's large nodes are
made: a token is one if it is the minimum of some stretch of ``least`` tokens, which is found by sliding
minima; the ends of a window are the nearest smaller tokens among these. There are about ``2 / (least + 1)``
windows a token and function.

Two passages share a min-hash where windows with the same hash meet. Windows are grouped by hash and
surroundings, in seven ways: by the token at each of four places near the centre, and by each of three stretches
of two thirds of ``least`` tokens beside or around it, one of which lies inside any passage of ``least`` tokens.
Each group is tied to its window of the smallest document (a star, never all pairs). So an exact passage
can be missed only where an earlier document, or an earlier place of the same one, has such a stretch (35 words in a
row of 50) but not the passage, and has it under every hash function. For every pair of documents so tied, the
windows' intervals are joined where they overlap; where at least ``enough`` hash functions meet, the passages are
verified on their tokens: at least ``least`` tokens long, and a Jaccard similarity of the token sets of at least
``similarity``.

All windows are dealt out by their hash once, and the groups of a hash are made in one task. Hashes of more than
about ``HOT`` windows, told from a part of the documents, take another way: windows that are alike in hash and surroundings
are put together first, and only these kinds meet their groups' partial minima in a join. Which way a hash goes
changes no result.

Defined cases: null, empty and short texts (under ``least`` + 4 words) have no passages; a passage that is
repeated within one document only isn't reported; rows with the same doc_id are one document, rows without a doc_id
take no part; equal tokens are broken to the left; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.llm.common import WordHashes, mix64, shingles, signed, texts
from featlens.session import materialize, owned_tables

GRAM = 5
#: Tokens of the shortest passage: 50 words.
LEAST = 46
#: Min-hash functions, how many of them must meet before a passage is verified, similarity that verification asks for.
#: One is enough: groups are stars, so the meetings of two documents may be spread over several stars.
FUNCTIONS, ENOUGH, SIMILARITY = 4, 1, 0.8
#: Unmatched tokens in a row that belong to a passage without more ado (two changed words side by side); longer gaps are
#: joined where the whole stays similar enough.
GAP = 10
_TOGETHER = 1 << 18
#: Windows of one hash up to which they are grouped within one task; counted on a part of the documents in which a
#: hash at that limit has some ``_SEEN`` windows.
HOT = 4096
_SEEN = 256
_PARTS = 256  # in which the windows of one kind are put together
_STARS = 200_000  # windows grouped at a time
_BATCH = 2000  # texts or windows that a task's Python function has at once


def _slide(v: np.ndarray, n: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``n`` consecutive values."""
    have = 1
    while have * 2 <= n:
        v = best(v[:-have], v[have:])
        have *= 2
    return best(v[:len(v) - (n - have)], v[n - have:]) if have < n else v


def compact_windows(v: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the compact windows of at least ``least`` tokens; zeros in ``v`` part documents and belong to none."""
    empty = np.empty(0, np.int64)
    if len(v) < least:
        return empty, empty, empty
    low = _slide(v, least, np.minimum)
    pad = np.zeros(least - 1, v.dtype)
    node = (_slide(np.concatenate([pad, low, pad]), least, np.maximum) == v)
    at = np.flatnonzero(node | (v == 0))
    x = np.concatenate([[0], v[at], [0]]).astype(v.dtype)
    at = np.concatenate([[-1], at, [len(v)]])
    left, right = np.arange(-1, len(x) - 1), np.arange(1, len(x) + 1)
    todo = np.flatnonzero(x > 0)
    while len(todo):  # to the nearest one on the left that isn't larger
        todo = todo[x[left[todo]] > x[todo]]
        left[todo] = left[left[todo]]
    todo = np.flatnonzero(x > 0)
    while len(todo):  # to the nearest one on the right that is smaller
        todo = todo[x[right[todo]] >= x[todo]]
        right[todo] = right[right[todo]]
    c = np.flatnonzero(x > 0)
    lo, hi = at[left[c]] + 1, at[right[c]] - 1
    big = hi - lo + 1 >= least
    return lo[big], at[c][big], hi[big]


def hashed(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash function number ``k``, never zero."""
    return mix64(tokens * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + np.uint64(0xD1B54A32D192ED03 * (k + 1) % 2**64)) | np.uint64(1)


def around(least: int) -> tuple[int, ...]:
    """Where, from its centre, a window's neighbourhood is looked at: a passage of ``least`` tokens around the centre
    reaches two of the four places, so windows that agree at none of them share no passage there."""
    return least // 6, least // 3, -(least // 6), -(least // 3)


def stretches(tokens: np.ndarray, c: np.ndarray, begin: np.ndarray, stop: np.ndarray, least: int) -> np.ndarray:
    """Three 21-bit hashes in one number, of the stretches that begin 0, 1 and 2 steps before the centre (zero: not inside
    the document). Wherever a passage of ``least`` tokens has its centre, it holds one of them."""
    step = least // 3 + 1
    n = least + 1 - step
    p = 0x9E3779B97F4A7C15
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(tokens), p, np.uint64)], dtype=np.uint64)
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(tokens), pow(p, -1, 1 << 64), np.uint64)], dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(tokens * powers[:-1], dtype=np.uint64)]
    out = np.zeros(len(c), np.uint64)
    for j in range(3):
        i = c - j * step
        inside = (i >= begin) & (i + n <= stop)
        i = np.where(inside, i, 0)
        h = mix64((sums[np.minimum(i + n, len(tokens))] - sums[i]) * back[i]) >> np.uint64(43)
        out |= np.where(inside, h | np.uint64(1), np.uint64(0)) << np.uint64(21 * j)
    return out


_WINDOW = ["k", "l", "c", "r", "near", "far"]


def _hot(d: DataFrame, keys) -> np.ndarray:
    """The hashes of more than about ``HOT`` windows, sorted; there is at most one for every ``HOT`` windows."""
    one_in = max(1, HOT // _SEEN)
    part = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0) if one_in > 1 else d
    counts = part.mapInArrow(keys, "key bigint").groupBy("key").count().where(F.col("count") > HOT // one_in).select("key")
    return np.sort(np.array([r.key for r in materialize(counts).collect()], np.int64).view(np.uint64))


def _is_in(hot: np.ndarray, v: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v if len(hot) else np.zeros(len(v), bool)


_SURROUNDINGS = [("near", 16, j) for j in range(4)] + [("far", 21, j) for j in range(3)]
_MET = ["k", "shift", "l", "r", "rl", "rr", "c"]


def _stars(batches):
    """The windows of a task, sorted by hash, each beside the first one of each of its groups (partner_id, doc_id, k, shift, l, r, rl, rr, c)."""
    def tied(t: pa.Table) -> pa.RecordBatch:
        get = {c: t.column(c).to_numpy() for c in ("key", "k", "l", "c", "r", "near", "far")}
        ids = t.column("doc_id").combine_chunks()
        code = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = np.lexsort((get["c"], code, get["key"]))
        get, code = {c: x[order] for c, x in get.items()}, code[order]
        group = np.cumsum(np.r_[0, get["key"][1:] != get["key"][:-1]])
        links = []
        for name, width, j in _SURROUNDINGS:
            v = (get[name].view(np.uint64) >> np.uint64(width * j) & np.uint64((1 << width) - 1)).astype(np.int64)
            rows = np.flatnonzero(v)
            g = (group[rows] << width) | v[rows]
            by = np.argsort(g, kind="stable")
            rows, g = rows[by], g[by]
            new = np.r_[True, g[1:] != g[:-1]][:len(g)]
            first = rows[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))] if len(g) else rows
            apart = code[rows] != code[first]
            links.append(rows[apart] * len(code) + first[apart])
        row, rep = np.divmod(np.unique(np.concatenate(links)), max(len(code), 1))
        shift = get["c"][row] - get["c"][rep]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(order[rep])), ids.take(pa.array(order[row])), *map(pa.array, (
            get["k"][row], shift, get["l"][row], get["r"][row], get["l"][rep], get["r"][rep], get["c"][row]))], ["partner_id", "doc_id", *_MET])
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < _STARS:
            continue
        t = pa.Table.from_batches(held)
        key = t.column("key").to_numpy()
        ends = np.flatnonzero(key[1:] != key[:-1])
        if len(ends):  # up to the last hash, which may go on
            yield tied(t.slice(0, int(ends[-1]) + 1))
            t = t.slice(int(ends[-1]) + 1)
        held, n = t.to_batches(), t.num_rows
    if n:
        yield tied(pa.Table.from_batches(held))


def _stars_of_hot(windows: DataFrame) -> DataFrame:
    """The same for hashes of any number of windows. Windows of one kind (alike in hash and surroundings) have the same
    groups, so only the kinds meet the minima of the groups; of the windows of a kind, ``_PARTS`` rows at most do."""
    kind = ["key", "near", "far"]
    values = [F.shiftrightunsigned(name, width * j).bitwiseAND(F.lit((1 << width) - 1)) for name, width, j in _SURROUNDINGS]
    parts = materialize(windows.groupBy(*kind, F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS)).alias("part")).agg(
        F.min(F.struct("doc_id", "c", "l", "r")).alias("first"), F.max("doc_id").alias("last"), F.collect_list(F.struct("doc_id", "k", "l", "c", "r")).alias("members")))
    kinds = parts.groupBy(*kind).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    each = kinds.select(*kind, "first", "last", F.posexplode(F.array(*values)).alias("place", "token")).where("token <> 0")
    reps = each.groupBy("key", "place", "token").agg(F.min("first").alias("rep"), F.max("last").alias("latest")).where("latest <> rep.doc_id").drop("latest")
    stars = each.join(reps, ["key", "place", "token"]).groupBy(*kind).agg(F.collect_set("rep").alias("reps"))
    tied = parts.join(stars, kind).select("reps", F.explode("members").alias("w")).select("w", F.explode("reps").alias("rep"))
    return tied.where("w.doc_id <> rep.doc_id").select(
        F.col("rep.doc_id").alias("partner_id"), "w.doc_id", "w.k", (F.col("w.c") - F.col("rep.c")).alias("shift"), "w.l", "w.r",
        F.col("rep.l").alias("rl"), F.col("rep.r").alias("rr"), "w.c")


def _windows(least: int, functions: int, hashes=None, hot: bool = False):
    """key of all windows; with the (broadcast) hot hashes all columns, either of the windows that have one or of the others."""
    def run(batches):
        words = WordHashes()
        for batch in batches:
            ids = batch.column(0)
            held, who, n = [], [], 0
            for i, s in enumerate(words.shingles(texts(batch), GRAM)):
                if len(s) >= least:
                    held.append(s)
                    who.append(i)
                    n += len(s)
                if n >= _TOGETHER:
                    yield emit(ids, held, who)
                    held, who, n = [], [], 0
            if held:
                yield emit(ids, held, who)

    def emit(ids, held, who):
        sizes = np.array([len(s) + 1 for s in held])
        begin = np.cumsum(sizes) - sizes
        stop = begin + sizes - 1
        flat = np.zeros(int(sizes.sum()), np.uint64)
        body = np.ones(len(flat), bool)
        body[stop] = False
        flat[body] = np.concatenate(held)
        cols = []
        for k in range(functions):
            v = np.where(body, hashed(flat, k), np.uint64(0))
            lo, c, hi = compact_windows(v, least)
            if hashes is None:
                cols.append((signed(v[c]),))
                continue
            wanted = _is_in(hashes.value, v[c]) == hot
            lo, c, hi = lo[wanted], c[wanted], hi[wanted]
            doc = np.searchsorted(stop, c)
            b = begin[doc]
            near = np.zeros(len(c), np.uint64)
            for j, off in enumerate(around(least)):
                at = np.clip(c + off, 0, len(flat) - 1)
                inside = (c + off >= b) & (c + off < stop[doc])
                near |= np.where(inside, (flat[at] >> np.uint64(48)) | np.uint64(1), np.uint64(0)) << np.uint64(16 * j)
            far = stretches(flat, c, b, stop[doc], least)
            cols.append((signed(v[c]), np.array(who)[doc], np.full(len(c), k, np.int32), *((x - b).astype(np.int32) for x in (lo, c, hi)), signed(near), signed(far)))
        if hashes is None:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, in cols]))], ["key"])
        key, doc, *rest = (np.concatenate(x) for x in zip(*cols))
        return pa.RecordBatch.from_arrays([pa.array(key), ids.take(pa.array(doc)), *map(pa.array, rest)], ["key", "doc_id", *_WINDOW])
    return run


def regions(k: np.ndarray, lo: np.ndarray, hi: np.ndarray, enough: int) -> list[tuple[int, int, np.ndarray]]:
    """Stretches covered by overlapping windows of at least ``enough`` hash functions: (first, last, windows)."""
    order = np.argsort(lo, kind="stable")
    reach = np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[order][1:] > reach[:-1]]
    out = []
    for part in np.split(order, np.flatnonzero(new)[1:]):
        if len(np.unique(k[part])) >= enough:
            out.append((int(lo[part].min()), int(hi[part].max()), part))
    return out


def _runs(match: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """First and last position of the stretches of ``match`` without more than ``gap`` misses in a row."""
    at = np.flatnonzero(match)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > gap + 1)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), at[np.r_[cut, len(at) - 1]].tolist()))


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which values of ``x`` occur in ``y``."""
    u = np.unique(y)
    return u[np.minimum(np.searchsorted(u, x), len(u) - 1)] == x


def _joined(match: np.ndarray, runs: list[tuple[int, int]], similarity: float) -> list[tuple[int, int]]:
    """Indices (i, j) of the first and last of neighbouring runs, two or more, of whose tokens together, gaps included, at
    least ``similarity`` match: for each i the farthest j, without those inside another."""
    if len(runs) < 2:
        return []
    first, last = (np.array(x) for x in zip(*runs))
    hits = np.r_[0, np.cumsum(match)]
    more = hits - similarity * np.arange(len(hits))
    start, end = more[first], more[last + 1]
    best = np.maximum.accumulate(end[::-1])[::-1]  # falls, so the farthest j is found by bisection
    far = len(best) - np.searchsorted(best[::-1], start - 1e-9, side="left") - 1
    out, reach = [], 0
    for i, j in enumerate(far.tolist()):
        if j > i and j > reach:
            out.append((i, j))
            reach = j
    return out


def _partner(own: np.ndarray, y: np.ndarray, partners: list[int], gap: int, least: int, similarity: float) -> tuple[int, int, float] | None:
    """(first, last, similarity) of the stretch of ``y`` around one of ``partners`` that is most like the tokens ``own``.

    Tried are its runs for ``gap`` and for every longer gap that leaves the similarity possible.
    """
    match = _among(y, own)
    gaps = np.diff(np.flatnonzero(match)) - 1
    best, seen = None, set()
    for g in [gap, *np.unique(gaps[(gaps > gap) & (gaps <= len(own) * (1 - similarity) / similarity)]).tolist()]:
        for u, w in _runs(match, g):
            if w - u + 1 >= least and (u, w) not in seen and any(u <= v <= w for v in partners):
                seen.add((u, w))
                other = np.unique(y[u:w + 1])
                both = len(np.intersect1d(own, other, assume_unique=True))
                s = both / (len(own) + len(other) - both)
                if best is None or s > best[2]:
                    best = (u, w, s)
    return best


def verified(x: np.ndarray, y: np.ndarray, centres: list[tuple[int, int]], least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(first, last in x, first, last in y, similarity) of the passages that two stretches of tokens share.

    A passage of ``x`` is a run of tokens that ``y`` has too, a few misses allowed, or several such runs with the longer
    gaps between them where the whole is similar enough (a phrase inserted on either side); its counterpart is the like stretch
    of ``y`` that holds the partner of a window's centre. Joined runs that aren't similar enough are parted at their longest
    gap, down to single runs, and of these the unbroken runs are tried. ``centres``: positions of centres in x and their partners in y.
    """
    out, match = [], _among(x, y)

    def found(a, b, gap):
        partners = [v for u, v in centres if a <= u <= b]
        best = _partner(np.unique(x[a:b + 1]), y, partners, gap, least, similarity) if partners and b - a + 1 >= least else None
        if best and best[2] >= similarity:
            out.append((a, b, *best))
            return True
        return False

    runs = _runs(match, GAP)
    hits = np.r_[0, np.cumsum(match)]
    todo, done = _joined(match, runs, similarity), set()
    while todo:
        i, j = todo.pop(0)
        a, b = runs[i][0], runs[j][1]
        if i == j:
            continue
        free = [k for k in range(i, j + 1) if k not in done]
        if len(free) <= j - i:  # another stretch has some of these
            todo += [(int(g[0]), int(g[-1])) for g in np.split(free, np.flatnonzero(np.diff(free) > 1) + 1) if len(g)]
            continue
        if hits[b + 1] - hits[a] >= similarity * (b - a + 1) and found(a, b, GAP):
            done.update(range(i, j + 1))
        else:
            cut = max(range(i, j), key=lambda k: runs[k + 1][0] - runs[k][1])
            todo += [(i, cut), (cut + 1, j)]
    for k, (a, b) in enumerate(runs):
        if k not in done and not found(a, b, GAP):
            for p, q in _runs(match[a:b + 1], 0):
                found(a + p, a + q, 0)
    return out


def _unfolded(w: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The windows (k, l, r, rl, rr, c, shift) of a batch of pairs below each other, and where each pair's begin and end."""
    groups = w.flatten()
    get = dict(zip((f.name for f in groups.type), groups.flatten()))
    many = pc.list_value_length(get["cs"]).to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(many)][np.r_[0, np.cumsum(pc.list_value_length(w).to_numpy(zero_copy_only=False))]]
    k, l, r, rl, rr, shift = (np.repeat(get[c].to_numpy(zero_copy_only=False), many) for c in ("k", "l", "r", "rl", "rr", "shift"))
    return np.column_stack([k, l, r, rl, rr, get["cs"].flatten().to_numpy(zero_copy_only=False), shift]).astype(np.int64), ends


_FOUND = "start int, `end` int, partner_start int, partner_end int, hashes int, similarity double"


def _check(least: int, enough: int, similarity: float):
    def run(batches):
        words, last = WordHashes(), {"x": (None, None), "y": (None, None)}

        def tokens(side, text):
            if last[side][0] != text:
                last[side] = (text, shingles(words.of(text), GRAM))
            return last[side][1]
        for batch in batches:
            rows, keep = [], []
            xs, ys = texts(batch, "x"), texts(batch, "y")
            windows, ends = _unfolded(batch.column(batch.schema.get_field_index("w")))
            for i, (xt, yt) in enumerate(zip(xs, ys)):
                x, y = tokens("x", xt), tokens("y", yt)
                t = windows[ends[i]:ends[i + 1]]
                for a, b, part in regions(t[:, 0], t[:, 1], t[:, 2], enough):
                    u, v = int(t[part, 3].min()), int(t[part, 4].max())
                    centres = sorted({(c - a, c - shift - u) for c, shift in t[part, 5:].tolist()})
                    for c, d, e, f, s in verified(x[a:b + 1], y[u:v + 1], centres, least, similarity):
                        rows.append((a + c, a + d + GRAM, u + e, u + f + GRAM, len(np.unique(t[part, 0])), s))
                        keep.append(i)
            at = pa.array(keep, pa.int64())
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, pa.int32()) for c in cols[:5]],
                                              pa.array(cols[5], pa.float64())],
                                             ["doc_id", "partner_id", "start", "end", "partner_start", "partner_end", "hashes", "similarity"])
    return run


def find(docs: DataFrame, least: int = LEAST, functions: int = FUNCTIONS, enough: int = ENOUGH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, partner_id, start, end, partner_start, partner_end (words, ends exclusive), hashes, similarity.

    One row for each passage of a document that repeats one of an earlier document (a smaller doc_id).
    """
    d = docs.where("doc_id is not null").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"key bigint, doc_id {kind}, k int, l int, c int, r int, near bigint, far bigint"
    with owned_tables(docs.sparkSession) as owned:  # of the tables on the way only the pairs outlive the block
        hot = docs.sparkSession.sparkContext.broadcast(_hot(d, _windows(least, functions)))
        # made again rather than written: once for the windows of few and once for those of many
        met = d.mapInArrow(_windows(least, functions, hot), schema).repartition("key").sortWithinPartitions("key").mapInArrow(
            _stars, f"partner_id {kind}, doc_id {kind}, k int, shift int, l int, r int, rl int, rr int, c int")
        # written one after the other: the windows' shuffle files go before the groups' are made
        few = materialize(met, _BATCH)
        many = materialize(_stars_of_hot(materialize(d.mapInArrow(_windows(least, functions, hot, hot=True), schema), _BATCH)))
        # dealt out by the pair once, which serves both groupings
        met = few.union(many).repartition("doc_id", "partner_id").groupBy("partner_id", "doc_id", "k", "shift").agg(
            F.min("l").alias("l"), F.max("r").alias("r"), F.min("rl").alias("rl"), F.max("rr").alias("rr"), F.collect_set("c").alias("cs"))
        pairs = owned.keep(met.groupBy("doc_id", "partner_id").agg(F.collect_list(F.struct("k", "l", "r", "rl", "rr", "shift", "cs")).alias("w"))
                           .where(F.size(F.array_distinct("w.k")) >= enough))
    x = d.select(F.col("doc_id").alias("x_"), F.col("text").alias("x"))
    y = d.select(F.col("doc_id").alias("y_"), F.col("text").alias("y"))
    both = pairs.join(x, F.col("doc_id") == F.col("x_")).join(y, F.col("partner_id") == F.col("y_"))
    return both.select("doc_id", "partner_id", "w", "x", "y").mapInArrow(
        _check(least, enough, similarity), f"doc_id {kind}, partner_id {kind}, {_FOUND}")
