"""Exact n-gram Jaccard join with adaptive multi-match prefixes (operator 3).

A document is the set of its distinct five-word shingles; two link at a Jaccard similarity of 0.8 or more.
Rows with equal texts are one class (by SHA-256), of which one member goes on; so are, later, equal sets.

Counts. How many documents have a shingle is counted exactly: sets travel in blocks of packed hashes, a block asks
the owner of each hash range for the counts of its distinct members and gets them back in order. Nothing is
broadcast, and a shingle that all documents have is asked for once a block. A member that no other document has is
in no intersection, so a document can only link if ``need`` of its n members are left, ``need`` being 0.8 n rounded
up. A first count takes the members in the lowest ``LOW`` of the hash space only: where over n - need of these alone
are in no other document, as in most documents, the document is done. The others are counted with all members.

Filter. Sets are ordered by count, then hash. Two sets of similarity t share at least l members of their prefixes of
length n - ceil(t n) + l, for any l. Each document takes the l of least estimated cost: what reading the posting
lists of a longer prefix costs against the candidates that l common members still leave. A pair must share the
smaller l of the two. With a and b members that no other document has, a pair differs in a + b at least, and
cannot link if that is over a ninth of both sizes.

Candidates. Shingles with few documents give their pairs. Where many documents share one, each is first only
compared with one of them, the one with the fewest members of its own; verified links are merged into components,
and of the shingle only pairs between different components follow, without those that the bound above rules out.
So a group of near copies costs what its members do, not its pairs, and no pair is given up. Lists are dealt in
parts of about ``PART`` by the exact count of their shingle; the second step covers pairs across parts.

Verification. Sets meet as packed arrays, a pair at a time beside the one that many are compared with, and are
intersected exactly. A document's likeliest candidate is tried first, and candidates within one component are
dropped, as they cannot change it.

Defined results: null texts, and texts without words, have no shingles, link with nothing and are their own
component; texts of fewer than five words are one shingle; texts of any length are read whole, one at a time in
memory; each row is judged by its own text, but classes whose least doc_id is the same are one node; of rows that
tie, repeated ones included, the least doc_id names the component; a null doc_id gives a null component and links
with nothing; an empty table gives an empty result; other columns, whatever their names, are not read, and
``drop_near_duplicates`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .graph import connected_components
from .idfilter import Near, maybe_in
from .textops import SPACE_WORDS, U64, mix, shingle_set, slices, words
from .workspace import drop_table, materialize, release, unused

NGRAM = 5
#: Similarity 0.8 as 4/5: links when 5 * intersection >= 4 * union.
MOST_SHARED = 6
SMALL_LIST = 12
#: Members of a block of sets, and of the hash range that one owner counts.
BLOCK, RANGE = 1 << 15, 1 << 19
#: Share of the hash space that the first count takes: more than a fifth, as so many members of its own end a document.
LOW = 0.3
#: Rows of a posting list, or of the pairs of one document, that go to one task; more are dealt.
PART = 1000
#: Bits of a bitmap for each member.
SPREAD = 4


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, data, offsets in slices(texts):
        w = words(data, offsets, SPACE_WORDS)
        for a, b in zip(w.first[:-1], w.first[1:]):
            yield shingle_set(w.hashes[a:b], NGRAM)


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return tuple(int(np.add.reduce(mix(s ^ salt)).view(np.int64)) for salt in (U64(0x51ED270B), U64(0xC2B2AE3D)))


def _need(n):
    """Least intersection with any linked set: ceil(0.8 n)."""
    return (4 * n + 4) // 5


#: docs, hs, ns and sizes: of each set the document, the digest of its text, all its members, and those that are in ``tokens`` (packed, ordered within a set).
BLOCK_SCHEMA = "block bigint, docs array<bigint>, hs array<binary>, ns array<bigint>, sizes array<bigint>, tokens binary"
BLOCK_NAMES = ["block", "docs", "hs", "ns", "sizes", "tokens"]


class _Blocks:
    """Gathers sets of one task into blocks of about ``BLOCK`` members with numbers of their own."""

    def __init__(self):
        self.next = TaskContext.get().partitionId() << 32
        self.clear()

    def clear(self):
        self.docs, self.hs, self.ns, self.sets, self.size = [], [], [], [], 0

    def add(self, doc: int | None, h: bytes | None, n: int, members: np.ndarray) -> Iterator[pa.RecordBatch]:
        for values, value in ((self.docs, doc), (self.hs, h), (self.ns, n), (self.sets, members)):
            values.append(value)
        self.size += len(members) + 16
        if self.size >= BLOCK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.docs:
            numbers, kinds = pa.list_(pa.int64()), pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array([self.next], pa.int64()), pa.array([self.docs], numbers), pa.array([self.hs], kinds), pa.array([self.ns], numbers),
                pa.array([[len(s) for s in self.sets]], numbers), pa.array([np.concatenate(self.sets).tobytes()], pa.binary()),
            ], names=BLOCK_NAMES)
            self.next += 1
            self.clear()


def low_sets(texts: DataFrame) -> DataFrame:
    """(doc, h, n, tokens) of each row of (doc, text, h): its members in the lowest part of the hash space, packed."""
    below = U64(int(LOW * 2**64))

    def run(batches):
        for batch in batches:
            ns, tokens = [], []
            for s in _sets(batch.column("text")):
                ns.append(len(s))
                tokens.append(s[: np.searchsorted(s, below)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("h"), pa.array(ns, pa.int64()), pa.array(tokens, pa.binary())], names=["doc", "h", "n", "tokens"])

    return texts.select("doc", "text", "h").mapInArrow(run, "doc bigint, h binary, n bigint, tokens binary")


def low_blocks(sets: DataFrame, but: Near | None = None) -> DataFrame:
    """BLOCK_SCHEMA of the rows of ``low_sets``, without those whose ``row_id`` may be in ``but``."""

    def run(batches):
        blocks = _Blocks()
        for batch in batches:
            if but:
                batch = batch.filter(pa.array(~but.test(batch.column("id").to_numpy(zero_copy_only=False))))
            for doc, h, n, tokens in zip(*[batch.column(c).to_pylist() for c in ("doc", "h", "n")], batch.column("tokens")):
                yield from blocks.add(doc, h, n, np.frombuffer(tokens.as_buffer(), dtype=U64))
        yield from blocks.flush()

    return sets.select("doc", "h", "n", "tokens", row_id().alias("id")).mapInArrow(run, BLOCK_SCHEMA)


def row_id() -> Column:
    """64 bits of a row's id and text."""
    return F.xxhash64("doc", "h")


def set_blocks(texts: DataFrame) -> DataFrame:
    """BLOCK_SCHEMA of the whole sets of (doc, text, h)."""

    def run(batches):
        blocks = _Blocks()
        for batch in batches:
            for doc, h, s in zip(batch.column("doc").to_pylist(), batch.column("h").to_pylist(), _sets(batch.column("text"))):
                yield from blocks.add(doc, h, len(s), s)
        yield from blocks.flush()

    return texts.select("doc", "text", "h").mapInArrow(run, BLOCK_SCHEMA)


def _requests(blocks: DataFrame, bits: int) -> DataFrame:
    """A row for each block and hash range: the distinct members in order, and how often each occurs in the block."""

    def run(batches):
        for batch in batches:
            for block, tokens in zip(batch.column("block").to_pylist(), batch.column("tokens")):
                members, counts = np.unique(np.frombuffer(tokens.as_buffer(), dtype=U64), return_counts=True)
                if not len(members):
                    continue
                owner = (members >> U64(64 - bits)).astype(np.int32)
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                spans = list(zip(first, [*first[1:], len(members)]))
                packed = [members[a:b].tobytes() for a, b in spans]
                times = [counts[a:b].astype(np.uint32).tobytes() if (counts[a:b] > 1).any() else b"" for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array(owner[first]), pa.array([block] * len(first), pa.int64()), pa.array(packed, pa.binary()), pa.array(times, pa.binary())], names=["owner", "block", "tokens", "times"])

    return blocks.select("block", "tokens").mapInArrow(run, "owner int, block bigint, tokens binary, times binary")


def _counts(requests: DataFrame) -> DataFrame:
    """For each request the counts of its members over all blocks, packed. requests: the rows of an owner lie together."""

    def run(batches):
        owner, held = None, []
        for batch in batches:
            for own, block, tokens, times in zip(batch.column("owner").to_pylist(), batch.column("block").to_pylist(), batch.column("tokens"), batch.column("times")):
                if own != owner and held:
                    yield answer(owner, held)
                    held = []
                owner = own
                held.append((block, np.frombuffer(tokens.as_buffer(), dtype=U64), np.frombuffer(times.as_buffer(), dtype=np.uint32)))
        if held:
            yield answer(owner, held)

    def answer(owner, held):
        parts = [p for _, p, _ in held]
        weights = np.concatenate([t if len(t) else np.ones(len(p), dtype=np.uint32) for _, p, t in held])
        _, place = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.minimum(np.bincount(place, weights=weights), 2**32 - 1).astype(np.uint32)[place]
        cuts = np.cumsum([0, *map(len, parts)])
        return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in held], pa.int64()), pa.array([owner] * len(held), pa.int32()), pa.array([total[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["block", "owner", "counts"])

    return requests.mapInArrow(run, "block bigint, owner int, counts binary")


#: A set that may still link: u members no other document has, and the others' hashes and counts, by count, then hash.
LIVE_SCHEMA = "doc bigint, n bigint, u bigint, k1 bigint, k2 bigint, tokens binary, counts binary, bits binary"
LIVE_NAMES = ["doc", "n", "u", "k1", "k2", "tokens", "counts", "bits"]


def _answered(blocks: DataFrame, replies: DataFrame, schema: str, make) -> DataFrame:
    """What the generators of ``make()`` give for every block and the counts of its members; replies are merged in order of the hash ranges."""
    needed = BLOCK_NAMES[1:]

    def run(batches):
        one, row, parts = make(), None, []
        for batch in batches:
            owners = batch.column("owner").to_pylist()
            for i, owner in enumerate(owners):
                if owner < 0:
                    yield from finish(one, row, parts)
                    row, parts = {c: batch.column(c)[i] for c in needed}, []
                else:
                    parts.append(np.frombuffer(batch.column("counts")[i].as_buffer(), dtype=np.uint32))
        yield from finish(one, row, parts)
        yield from one.last()

    def finish(one, row, parts):
        if row is None:
            return
        tokens = np.frombuffer(row["tokens"].as_buffer(), dtype=U64)
        _, place = np.unique(tokens, return_inverse=True)
        counts = np.concatenate([np.zeros(0, dtype=np.uint32), *parts])[place]
        cuts = np.cumsum([0, *row["sizes"].as_py()])
        for doc, h, n, a, b in zip(*[row[c].as_py() for c in ("docs", "hs", "ns")], cuts[:-1], cuts[1:]):
            shared = counts[a:b] > 1
            if doc is not None and n and n - int((~shared).sum()) >= _need(n):
                yield from one.take(doc, h, n, tokens[a:b][shared], counts[a:b][shared])

    kinds = {f.name: f.dataType for f in blocks.schema}
    asked = blocks.select("block", F.lit(-1).alias("owner"), *needed, F.lit(None).cast("binary").alias("counts"))
    told = replies.select("block", "owner", *[F.lit(None).cast(kinds[c]).alias(c) for c in needed], "counts")
    return asked.unionAll(told).repartition("block").sortWithinPartitions("block", "owner").mapInArrow(run, schema)


def parity_bitmap(members: np.ndarray, n: int) -> bytes:
    """A bit for each residue of the hashes: whether an odd number of ``members`` has it. At least 64 bits and ``SPREAD`` for each of n, a power of 2."""
    width = max(64, 1 << (SPREAD * n - 1).bit_length())
    return np.packbits(np.bincount((members >> U64(20) & U64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def fold(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps as 64-bit words, folded to a smaller power of 2 of ``words``."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


class _AsNames:
    """Sets that may link, as rows of (doc, h)."""

    def __init__(self):
        self.rows = []

    def take(self, doc, h, n, members, counts):
        self.rows.append((doc, h))
        if len(self.rows) >= 10_000:
            yield from self.last()

    def last(self):
        if self.rows:
            docs, hs = zip(*self.rows)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hs, pa.binary())], names=["doc", "h"])
            self.rows = []


class _AsRows:
    """Sets that may link, as LIVE_SCHEMA rows."""

    def __init__(self):
        self.rows, self.size = [], 0

    def take(self, doc, h, n, members, counts):
        order = np.lexsort((members, counts))
        self.rows.append((doc, n, n - len(members), *_key(members), members[order].tobytes(), counts[order].tobytes(), parity_bitmap(members, n)))
        self.size += len(members)
        if self.size > 1 << 17:
            yield from self.last()

    def last(self):
        if self.rows:
            kinds = [pa.int64()] * 5 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*self.rows), kinds)], names=LIVE_NAMES)
            self.rows, self.size = [], 0


def may_link(blocks: DataFrame, schema: str, make) -> DataFrame:
    """The sets of the written table ``blocks`` of whose members enough occur in others, as ``make`` puts them."""
    total = blocks.agg(F.sum(F.length("tokens"))).first()[0] or 0
    bits = max(8, int(total // 8 // RANGE).bit_length())
    replies = _counts(_requests(blocks, bits).repartition("owner").sortWithinPartitions("owner"))
    return _answered(blocks, replies, schema, make)


def choose_shared(n: int, left: int, freq: np.ndarray) -> int:
    """The l of least estimated cost for a set of n members of which ``left`` are shared; ``freq``: their counts in order.

    Postings read cost 1 each; candidates are at most the postings over l, and verifying one costs about n / 16.
    """
    base, most = left - _need(n), min(MOST_SHARED, _need(n))
    sums = np.cumsum(freq[: base + most].astype(np.float64))
    best, least = 1, np.inf
    for shared in range(1, most + 1):
        read = float(sums[base + shared - 1])
        cost = read + read / shared**2 * n / 16
        if cost < least:
            best, least = shared, cost
    return best


POSTING_NAMES = ["token", "part", "doc", "n", "u", "l", "level", "hot"]


def postings(live: DataFrame) -> DataFrame:
    """(token, part, doc, n, u, l, level, hot) of each prefix member that other documents have. hot: dealt in parts."""

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for doc, n, u, tokens, counts in zip(*[batch.column(c).to_pylist() for c in ("doc", "n", "u")], batch.column("tokens"), batch.column("counts")):
                own, freq = np.frombuffer(tokens.as_buffer(), dtype=np.int64), np.frombuffer(counts.as_buffer(), dtype=np.uint32)
                base = len(own) - _need(n)
                shared = choose_shared(n, len(own), freq)
                size_ = base + shared
                own, freq = own[:size_], freq[:size_]
                parts = freq.astype(np.int64) // PART + 1
                level = np.maximum(1, np.arange(1, size_ + 1) - base)
                hot = parts > 1
                part = np.where(hot, (mix(own.view(U64) ^ U64(doc * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % parts.astype(U64)).astype(np.int64), 0)
                rows.append(np.column_stack([own, part, *[np.full(size_, x) for x in (doc, n, u, shared)], level, hot]))
                size += size_
                if size > 1 << 17:
                    yield emit(rows)
                    rows, size = [], 0
            if rows:
                yield emit(rows)

    def emit(rows):
        table = np.concatenate(rows)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], names=POSTING_NAMES)

    return live.select("doc", "n", "u", "tokens", "counts").mapInArrow(run, ", ".join(f"{c} bigint" for c in POSTING_NAMES))


#: kind 0: x and y share a token that counts; 1: y is to be compared with x, the first of a long list; 2: x is the token of a long list.
FOUND_SCHEMA = "kind int, x bigint, y bigint, l bigint"


def _may_link(nx, ux, ny, uy):
    """Sizes allow it, and members of their own are at most a ninth of both sizes."""
    return (5 * np.minimum(nx, ny) >= 4 * np.maximum(nx, ny)) & (9 * (ux + uy) <= nx + ny)


def scan_lists(sorted_postings: DataFrame) -> DataFrame:
    """FOUND_SCHEMA from postings sorted by token, part, u and doc within partitions; a list is never held as a whole."""
    names = ["token", "part", "doc", "n", "u", "l", "level", "hot"]
    small = SMALL_LIST

    def run(batches):
        empty = {c: np.zeros(0, dtype=np.int64) for c in names}
        pending, going = empty, None  # going: token, part, leader, its n and u of a long list that earlier batches began
        for batch in batches:
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if going is not None:
                same = (now["token"] == going[0]) & (now["part"] == going[1])
                run_ = len(same) if same.all() else int(same.argmin())
                if run_:
                    yield from stars(*[np.full(run_, x) for x in going[2:]], *[now[c][:run_] for c in ("doc", "n", "u")])
                    now = {c: a[run_:] for c, a in now.items()}
                if not len(now["doc"]):
                    continue
                going = None
            now = {c: np.concatenate([pending[c], a]) for c, a in now.items()}
            size = len(now["doc"])
            new = np.flatnonzero((np.diff(now["token"]) != 0) | (np.diff(now["part"]) != 0)) + 1
            first = np.concatenate([[0], new])
            last = int(first[-1])
            if size - last > small or now["hot"][last]:
                going = tuple(now[c][last] for c in ("token", "part", "doc", "n", "u"))
                pending = empty
            else:
                pending = {c: a[last:] for c, a in now.items()}
                now, first = {c: a[:last] for c, a in now.items()}, first[:-1]
            yield from lists(now, first)
        if len(pending["doc"]):
            yield from lists(pending, np.zeros(1, dtype=np.int64))

    def lists(now, first):
        if not len(first):
            return
        sizes = np.diff(np.concatenate([first, [len(now["doc"])]]))
        long = (sizes > small) | (now["hot"][first] > 0)
        own, rows = np.repeat(first, sizes), np.repeat(long, sizes)
        yield from stars(*[now[c][own[rows]] for c in ("doc", "n", "u")], *[now[c][rows] for c in ("doc", "n", "u")])
        if long.any():
            token = now["token"][first[long]]
            yield out(2, token, token, np.zeros(len(token), dtype=np.int64))
        for k in range(2, small + 1):
            at = first[(sizes == k) & ~long]
            if not len(at):
                continue
            a, b = np.triu_indices(k, 1)
            i, j = (at[:, None] + a).ravel(), (at[:, None] + b).ravel()
            shared = np.minimum(now["l"][i], now["l"][j])
            use = (np.maximum(now["level"][i], now["level"][j]) <= shared) & _may_link(now["n"][i], now["u"][i], now["n"][j], now["u"][j]) & (now["doc"][i] != now["doc"][j])
            yield out(0, now["doc"][i][use], now["doc"][j][use], shared[use])

    def stars(leader, its_n, its_u, doc, n, u):
        use = (leader != doc) & _may_link(its_n, its_u, n, u)
        if use.any():
            pairs, count = np.unique(np.column_stack([leader[use], doc[use]]), axis=0, return_counts=True)
            yield out(1, pairs[:, 0], pairs[:, 1], count)

    def out(kind, x, y, shared):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, dtype=np.int32)), pa.array(np.ascontiguousarray(x)), pa.array(np.ascontiguousarray(y)), pa.array(shared)], names=["kind", "x", "y", "l"])

    return sorted_postings.mapInArrow(run, FOUND_SCHEMA)


def _deals(spark: SparkSession) -> int:
    """Into how many parts the pairs of a document may be dealt: as many as a shuffle has tasks."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def verify(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """The pairs (x, y) whose sets link. pairs: a written table.

    For each x the others stream past its set; pairs of one x are dealt over tasks, each with the set once.
    """
    dealt = pairs.select("x", "y", F.pmod(F.xxhash64("y"), F.lit(_deals(pairs.sparkSession))).alias("part"))
    sets = live.select(F.col("doc"), "n", "tokens")
    heads = dealt.select("x", "part").distinct().join(sets.withColumnRenamed("doc", "x"), "x").select("x", "part", F.lit(None).cast("bigint").alias("y"), "n", "tokens")
    rest = dealt.join(sets.withColumnRenamed("doc", "y"), "y").select("x", "part", "y", "n", "tokens")

    def run(batches):
        at, held = None, []
        for batch in batches:
            xs, ys = [], []
            for x, part, y, n, tokens in zip(*[batch.column(c).to_pylist() for c in ("x", "part", "y", "n")], batch.column("tokens")):
                own = np.frombuffer(tokens.as_buffer(), dtype=U64)
                if (x, part) != at:
                    at, held = (x, part), []
                if y is None:
                    held.append((n, np.sort(own)))
                elif any(_linked(other, n, own, m) for m, other in held):
                    xs.append(x)
                    ys.append(y)
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    together = heads.unionAll(rest).repartition("x", "part").sortWithinPartitions("x", "part", F.col("y").asc_nulls_first())
    return together.mapInArrow(run, "x bigint, y bigint").distinct()


def _linked(s: np.ndarray, n: int, other: np.ndarray, m: int) -> bool:
    """Whether 100 * intersection >= 80 * union, for sorted members ``s`` of a set of size m and ``other`` of one of size n."""
    at = np.searchsorted(s, other)
    at[at == len(s)] = 0
    both = int((s[at] == other).sum())
    return 100 * both >= 80 * (n + m - both)


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (x, y, ...) that lie in different components."""
    root = lambda side: parts.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    met = pairs.join(root("x"), "x", "left").join(root("y"), "y", "left")
    return met.where("coalesce(rx, x) <> coalesce(ry, y)").drop("rx", "ry")


def _merge(links: DataFrame, parts: DataFrame | None) -> DataFrame:
    edges = links.select(F.col("x").alias("a"), F.col("y").alias("b"))
    if parts is not None:
        edges = edges.unionAll(parts.where("node <> root").select("node", "root"))
    return materialize(connected_components(edges), "components")


def _link(pairs: DataFrame, parts: DataFrame | None, live: DataFrame) -> DataFrame | None:
    """Components once the links among ``pairs`` (x, y, k: common members seen) are added to ``parts``."""
    left = materialize(_apart(pairs, parts) if parts is not None else pairs, "pairs")
    if left.isEmpty():
        return parts
    best = materialize(left.groupBy("y").agg(F.min(F.struct((-F.col("k")).alias("k"), "x")).alias("b")).select("b.x", "y"), "pairs")
    parts = _merge(verify(best, live), parts)
    rest = materialize(_apart(left.join(best, ["x", "y"], "left_anti"), parts).select("x", "y"), "pairs")
    if not rest.isEmpty():
        parts = _merge(verify(rest, live), parts)
    return parts


def _long_lists(lists: DataFrame, tokens: DataFrame, parts: DataFrame | None, short: DataFrame, live: DataFrame) -> DataFrame:
    """(x, y, k) of documents of different components that share enough tokens, one in a long list at least. lists: the written postings.

    short: (x, y, k, l) of the pairs with k common tokens in short lists, fewer than the l they need; the count in
    long lists adds to k.

    ``slack`` is n - 9 u: two documents can only link if theirs add up to 0 or more. Of a list only the documents go
    on that could link with the greatest slack outside their own component; so end edited copies that are too far
    from all others. Of those the members outside the largest component meet all others in ``meet``. What two sets share
    beyond their prefixes is at most need - l of one of them, so the k seen must make up the rest of what a link takes.
    """
    rows = lists.join(tokens, "token").select("token", "doc", "n", "l", "level", (F.col("n") - 9 * F.col("u")).alias("slack"))
    comp = F.col("doc")
    if parts is not None:
        rows = rows.join(parts.select(F.col("node").alias("doc"), "root"), "doc", "left")
        comp = F.coalesce("root", "doc")
    rows = materialize(rows.withColumn("c", comp).drop("root"), "long-lists")
    for _ in range(2):  # the second time among those that the first left
        shares = rows.groupBy("token", "c").agg(F.count("*").alias("k"), F.max("slack").alias("slack"))
        two = shares.groupBy("token").agg(F.max(F.struct("slack", "c")).alias("m"), F.max(F.struct("k", "c")).alias("w"), F.count("*").alias("parts")).where("parts > 1")
        second = shares.join(two.select("token", F.col("m.c").alias("mc")), "token").where("c <> mc").groupBy("token").agg(F.max("slack").alias("next"))
        bounds = two.select("token", F.col("m.slack").alias("most"), F.col("m.c").alias("most_c"), F.col("w.c").alias("major")).join(second, "token")
        rows = materialize(rows.drop("major").join(bounds, "token").where("slack + if(c = most_c, next, most) >= 0").drop("most", "most_c", "next"), "long-lists")
    met = meet(rows, live).groupBy("x", "y").agg(F.sum("k").alias("k"), F.max("nx").alias("nx"), F.max("ny").alias("ny"), F.min("l").alias("l"))
    met = met.join(short.select("x", "y", F.col("k").alias("ks")), ["x", "y"], "left").withColumn("k", F.col("k") + F.coalesce("ks", F.lit(0)))
    beyond = "greatest((4 * nx + 4) div 5, (4 * ny + 4) div 5) - l"  # common members that are not in both prefixes
    return met.where(f"9 * (k + {beyond}) >= 4 * (nx + ny)").select("x", "y", "k")


def meet(rows: DataFrame, live: DataFrame) -> DataFrame:
    """(x, y, k, nx, ny, l) of members x outside the largest component of a list (token, major) and others whose bitmaps allow a link.

    A part of the members outside is held, the list streams past: no more than ``PART`` against ``16 * PART`` in a task,
    whatever the length of the list, and only pairs near a link leave it.
    """
    sizes = rows.groupBy("token").agg(F.count("*").alias("all"), F.count_if(F.expr("c <> major")).alias("outside"))
    deals = sizes.select("token", F.expr(f"outside div {PART} + 1").alias("own"), F.expr(f"all div {16 * PART} + 1").alias("other"))
    full = rows.join(deals, "token").join(live.select("doc", "n", "bits").distinct(), ["doc", "n"])
    dealt = lambda by: F.pmod(F.xxhash64("doc"), F.col(by))
    cast = ["token", "doc", "n", "l", "level", "slack", "c", "major", "bits"]
    every = lambda by: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(by) - 1))
    held = full.where("c <> major").select(*cast, dealt("own").alias("p"), every("other").alias("q"), F.lit(0).alias("role"))
    passing = full.select(*cast, every("own").alias("p"), dealt("other").alias("q"), F.lit(1).alias("role"))
    return _meet_sorted(held.unionAll(passing).repartition("token", "p", "q").sortWithinPartitions("token", "p", "q", "role"))


def _meet_sorted(dealt: DataFrame) -> DataFrame:
    numbers = ["doc", "n", "l", "level", "slack", "c", "major"]

    def run(batches):
        at, held = None, {}
        for batch in batches:
            now = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("token", "p", "q", "role", *numbers)}
            bits = [np.frombuffer(b.as_buffer(), dtype=np.uint8) for b in batch.column("bits")]
            found = []
            for i, role in enumerate(now["role"].tolist()):
                if (where := (now["token"][i], now["p"][i], now["q"][i])) != at:
                    at, held = where, {}
                row = [int(now[k][i]) for k in numbers]
                if not role:
                    rows = held.setdefault(len(bits[i]) // 8, [])
                    if isinstance(rows, tuple):
                        raise ValueError("rows are not in order")
                    rows.append((row, bits[i].copy()))
                else:
                    found += against(held, row, bits[i])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in np.concatenate(found).T], names=["x", "y", "k", "nx", "ny", "l"])

    def against(held, row, bits):
        doc, n, l, level, slack, c, major = row
        words = len(bits) // 8
        for width in (words // 2, words, words * 2):
            if width not in held:
                continue
            if not isinstance(held[width], tuple):
                rows, maps = zip(*held[width])
                held[width] = (np.array(rows, dtype=np.int64).T, np.stack(maps).view(np.uint64))
            (xd, xn, xl, xv, xs, xc, _), maps = held[width]
            near = (xc != c) & (5 * np.minimum(xn, n) >= 4 * np.maximum(xn, n)) & (xs + slack >= 0) & (np.maximum(xv, level) <= np.minimum(xl, l))
            if c != major:
                near &= xd < doc
            near = np.flatnonzero(near)
            if not len(near):
                continue
            least = min(width, words)
            apart = np.bitwise_count(fold(maps[near], least) ^ fold(bits.view(np.uint64)[None], least)).sum(axis=1, dtype=np.int64)
            near = near[9 * apart <= xs[near] + slack]
            if len(near):
                y, ny = np.full(len(near), doc), np.full(len(near), n)
                first = xd[near] < doc
                yield np.column_stack([np.where(first, xd[near], y), np.where(first, y, xd[near]), np.ones(len(near), dtype=np.int64), np.where(first, xn[near], ny), np.where(first, ny, xn[near]), np.minimum(xl[near], l)])

    return dealt.mapInArrow(run, "x bigint, y bigint, k bigint, nx bigint, ny bigint, l bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = rows.withColumn("h", F.unhex(F.sha2("text", 256)))
    low = materialize(low_sets(hashed), "low-sets")
    each = materialize(low.select("doc", "h", "n"), "each")
    classes = materialize(each.groupBy("h").agg(F.min("doc").alias("node"), F.min("n").alias("n"), F.count("*").alias("members")), "classes")
    several = classes.where("members > 1").select(F.col("h").alias("ch"), "node")
    copies = each.join(several, (F.col("h") == F.col("ch")) & ~F.col("doc").eqNullSafe(F.col("node"))).select(F.col("doc").alias("cd"), "ch").distinct()
    copies = materialize(copies, "copies")
    copied = maybe_in(copies.select(F.xxhash64("cd", "ch").alias("id")))
    checked = (materialize(low.where(copied(row_id())), "low-checked") if copied else low).join(copies, F.col("doc").eqNullSafe(F.col("cd")) & (F.col("h") == F.col("ch")), "left_anti")
    blocks = materialize(low_blocks(low, copied).unionAll(low_blocks(checked)) if copied else low_blocks(checked), "low-blocks")
    drop_table(low)
    release(spark)
    some = materialize(may_link(blocks, "doc bigint, h binary", _AsNames), "candidates")
    drop_table(blocks)
    release(spark)
    wanted = maybe_in(some.select(row_id().alias("id")))
    near = materialize(hashed.where(wanted(row_id())), "near-texts") if wanted else hashed
    blocks = materialize(set_blocks(near.join(some.distinct(), ["doc", "h"], "left_semi")), "set-blocks")
    if wanted:
        drop_table(near)
    release(spark)
    live = materialize(may_link(blocks, LIVE_SCHEMA, _AsRows), "live")
    drop_table(blocks)
    release(spark)
    parts = _components(live)
    drop_table(live)
    release(spark)

    known = classes.select("h", "n", "node")
    if parts is not None:
        known = known.join(parts, "node", "left").withColumn("node", F.coalesce("root", "node"))
    known = materialize(known.select("h", "n", "node"), "known")
    component = F.when(F.col("doc").isNull() | (F.col("n") == 0), F.col("doc")).otherwise(F.col("node"))
    return each.select("doc", "h").join(known, "h").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _components(live: DataFrame) -> DataFrame | None:
    """(node, root) of the documents of ``live`` that link; None if none does."""
    # equal sets have no members of their own; the keys are of shared members only
    equal = live.where("u = 0").groupBy("n", "k1", "k2").agg(F.min("doc").alias("x"), F.count("*").alias("members")).where("members > 1")
    equal = materialize(live.where("u = 0").select("doc", "n", "k1", "k2").join(equal, ["n", "k1", "k2"]).where("doc <> x").select("x", F.col("doc").alias("y"), "n", "k1", "k2").distinct(), "equal-sets")
    parts = None if equal.isEmpty() else _merge(equal, None)
    others = equal.select(F.col("y").alias("doc"), "n", "k1", "k2")
    live = live.join(others, ["doc", "n", "k1", "k2"], "left_anti")
    lists = materialize(postings(live), "postings")
    dealt = lists.repartition("token", "part").sortWithinPartitions("token", "part", "u", "doc")
    found = materialize(scan_lists(dealt), "found")
    few = found.where("kind = 0").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count("*").alias("k"), F.min("l").alias("l"))
    stars = found.where("kind = 1").groupBy("x", "y").agg(F.sum("l").alias("k"))
    pairs = few.where("k >= l").select("x", "y", "k").unionAll(stars).groupBy("x", "y").agg(F.sum("k").alias("k"))
    parts = _link(pairs, parts, live)
    tokens = materialize(found.where("kind = 2").select(F.col("x").alias("token")).distinct(), "tokens")
    if not tokens.isEmpty():
        parts = _link(_long_lists(lists, tokens, parts, few.where("k < l"), live), parts, live)
    drop_table(found)
    drop_table(lists)
    return parts


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component: that of the least doc_id, once; rows with a null doc_id stay."""
    groups = materialize(near_duplicates(docs), "groups")
    taken, own = unused(docs, "taken"), [F.col(f"`{c}`") for c in docs.columns]
    dropped = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(taken)).distinct()
    dropped = materialize(dropped, "dropped")
    near, key = maybe_in(dropped.select(F.xxhash64(taken).alias("id"))), F.xxhash64(F.col("doc_id").cast("bigint"))
    same = F.col("doc_id") == F.col(taken)
    kept = docs.where(~near(key)).unionAll(docs.where(near(key)).join(dropped, same, "left_anti")) if near else docs.join(dropped, same, "left_anti")
    again = materialize(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(taken)), "repeated")
    if again.isEmpty():
        return kept
    order = W.Window.partitionBy("doc_id").orderBy(F.xxhash64(*own))
    once = kept.join(again, same, "left_semi").withColumn(taken, F.row_number().over(order)).where(F.col(taken) == 1).select(*own)
    return kept.join(again, same, "left_anti").unionAll(once)
